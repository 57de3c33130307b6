"""Data-quality checks of bar tables: each returns the rows at fault, or a count of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.frames import by


def missing_sessions(bars: DataFrame) -> DataFrame:
    """``entity, date``: weekdays between an entity's first and last bar on which it has none."""
    spans = bars.groupBy("entity").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = spans.select("entity", F.explode(F.sequence(F.to_date("a"), F.to_date("b"))).alias("day")).where(F.weekday("day") < 5)
    return days.join(bars.select("entity", F.to_date("date").alias("day")), ["entity", "day"], "left_anti").select("entity", F.col("day").cast("timestamp").alias("date"))


def stale_prices(bars: DataFrame, least: int = 2) -> DataFrame:
    """Runs of ``least`` or more equal closes: start, end, bars."""
    changed = F.coalesce((F.col("close") != F.lag("close").over(by())).cast("int"), F.lit(1))
    runs = bars.withColumn("changed", changed).withColumn("run", F.sum("changed").over(by().rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("entity", "run").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("bars")).where(F.col("bars") >= least).drop("run")


def volume_anomalies(bars: DataFrame, n: int = 20, share: float = 0.1) -> DataFrame:
    """Bars without volume, or under ``share`` of the median of the ``n`` bars before (at least max(3, n/2) of them)."""
    w = by().rowsBetween(-n, -1)
    out = bars.withColumn("usual", F.when(F.count("volume").over(w) >= max(3, n // 2), F.percentile("volume", F.lit(0.5)).over(w)))
    return out.where((F.col("volume") == 0) | (F.col("volume") < share * F.col("usual"))).select("entity", "date", "volume", "usual")


def price_jumps(bars: DataFrame, limit: float = 0.5) -> DataFrame:
    """Bars whose close moved by more than ``limit`` and the simple split ratio nearest to the move, within 2 %."""
    ratio = F.col("close") / F.lag("close").over(by())
    out = bars.withColumn("ratio", ratio).where(F.abs(F.col("ratio") - 1) > limit)
    near = F.array(*(F.struct(F.abs(F.col("ratio") / F.lit(s) - 1).alias("d"), F.lit(s).alias("s")) for s in (2.0, 3.0, 4.0, 5.0, 10.0, 1 / 2, 1 / 3, 1 / 4, 1 / 5, 1 / 10)))
    best = F.array_min(near)
    return out.select("entity", "date", "ratio", F.when(best.d <= 0.02, best.s).alias("split"))


def duplicate_timestamps(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def out_of_order(df: DataFrame, seq: str, ts: str, entity: str) -> DataFrame:
    """Rows whose time is before that of an earlier row of their entity."""
    before = F.max(ts).over(W.partitionBy(entity).orderBy(seq).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("latest", before).where(F.col(ts) < F.col("latest"))


def ohlc_faults(bars: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """``entity, date, fault``: each rule that a bar breaks, beyond a relative tolerance."""
    slack = tolerance * F.abs("high")
    rules = {"high<low": F.col("high") < F.col("low") - slack, "high<close": F.col("high") < F.col("close") - slack, "high<open": F.col("high") < F.col("open") - slack, "low>close": F.col("low") > F.col("close") + slack, "low>open": F.col("low") > F.col("open") + slack, "price<=0": F.least("open", "high", "low", "close") <= 0, "volume<0": F.col("volume") < 0}
    return bars.select("entity", "date", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))).alias("fault"))


def content_hash(df: DataFrame) -> DataFrame:
    """One row: rows and an order-free hash of the table."""
    return df.select(F.xxhash64(*sorted(df.columns)).alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("hash"))


def usable_bars(bars: DataFrame, columns: tuple[str, ...] = ("open", "close")) -> DataFrame:
    """Bars with all ``columns``; ``dropped_missing`` and ``dropped_placeholder`` say how many of the entity's went.

    A bar without them is a placeholder after the entity's last usable bar and
    missing before; entities without a usable bar give no rows.
    """
    usable = F.lit(True)
    for c in columns:
        usable = usable & F.nanvl(F.col(c), F.lit(None)).isNotNull()
    w = W.partitionBy("entity")
    out = bars.withColumn("__ok", usable).withColumn("__last", F.max(F.when(usable, F.col("date"))).over(w))
    gone = lambda after: F.sum(F.when(~F.col("__ok") & ((F.col("date") > F.col("__last")) == after), 1).otherwise(0)).over(w)
    return out.withColumns({"dropped_missing": gone(False), "dropped_placeholder": gone(True)}).where("__ok").drop("__ok", "__last")


def membership_faults(df: DataFrame, allowed: dict[str, list]) -> DataFrame:
    """``column, value, n``: values of the columns of ``allowed`` that are not in its lists, nulls among them; an empty frame where all are."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.coalesce(F.col(c).isin(v), F.lit(False)).alias("ok")) for c, v in allowed.items()))).alias("x")
    return df.select(pairs).where("not x.ok").groupBy("x.column", "x.value").agg(F.count("*").alias("n"))


def lost_rows(df: DataFrame, features: list[str], target: str, by: str = "entity") -> DataFrame:
    """Rows that a drop of missing values costs, by cause: ``rows, no_features, no_target, both, kept``, and each feature's share of the misses."""
    missing = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None)).isNull()
    some, none = F.lit(False), missing(target)
    for c in features:
        some = some | missing(c)
    return df.groupBy(by).agg(
        F.count("*").alias("rows"), F.count_if(some & ~none).alias("no_features"), F.count_if(none & ~some).alias("no_target"), F.count_if(some & none).alias("both"), F.count_if(~some & ~none).alias("kept"),
        *(F.count_if(missing(c)).alias(f"missing_{c}") for c in features),
    )


def versions(records: DataFrame, key: list[str], version: str) -> DataFrame:
    """``versions`` and ``restated`` of each key: distinct versions of what is known of it."""
    out = records.groupBy(*key).agg(F.countDistinct(version).alias("versions"))
    return out.withColumn("restated", F.col("versions") > 1)


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """``n`` and ``share`` of each combination of ``columns``, nulls among them."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__t")))).withColumn("share", F.col("n") / F.col("__t")).drop("__t")

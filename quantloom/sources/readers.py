"""Readers of external tables: formats, column contracts of each kind, inclusive date bounds, writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that each kind of table must have.
KINDS: dict[str, tuple[str, ...]] = {
    "price_panel": ("entity", "date", "open", "high", "low", "close", "volume"),
    "returns_panel": ("entity", "date", "ret"),
    "signal_panel": ("entity", "date", "signal"),
    "score_panel": ("entity", "date", "score"),
    "weight_panel": ("entity", "date", "weight"),
    "equity_curve": ("date", "equity"),
    "trade_log": ("entity", "entry", "exit", "direction", "return_pct"),
    "tick_tape": ("symbol", "ts", "price", "size"),
    "quote_panel": ("symbol", "ts", "bid_price", "ask_price"),
    "order_event_panel": ("symbol", "ts", "order_id", "action", "side", "price", "size"),
    "order_book_panel": ("symbol", "ts", "bid_price_0", "bid_size_0", "ask_price_0", "ask_size_0"),
    "predictions": ("date", "entity", "prediction"),
    "event_panel": ("entity", "event_time", "available_time"),
    "indicator_panel": ("entity", "date"),
    "covariance": ("i", "j", "value"),
}
#: Conversions between kinds: rename of the value column.
CONVERSIONS = {("predictions", "signal_panel"): ("prediction", "signal"), ("predictions", "score_panel"): ("prediction", "score"), ("score_panel", "weight_panel"): ("score", "weight"), ("signal_panel", "score_panel"): ("signal", "score")}

FORMATS = ("parquet", "csv", "json", "orc")
_providers: dict[str, Callable[..., DataFrame]] = {}


def register_provider(name: str, read: Callable[..., DataFrame]) -> None:
    """``read(spark, symbols, start, end, **options)`` for ``provider(name)``."""
    _providers[name] = read


def provider(name: str) -> Callable[..., DataFrame]:
    if name not in _providers:
        raise ValueError(f"unknown provider {name!r}; known: {sorted(_providers)}")
    return _providers[name]


def validate(df: DataFrame, kind: str) -> DataFrame:
    """``df``, or a refusal before any action that names the missing columns."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {sorted(KINDS)}")
    missing = [c for c in KINDS[kind] if c not in df.columns]
    if missing:
        raise ValueError(f"{kind} lacks {missing}")
    return df


def between(df: DataFrame, c: str, start=None, end=None) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; a plain filter, so it reaches the scan."""
    if start is not None:
        df = df.where(F.col(c) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(c) <= F.lit(end).cast("timestamp"))
    return df


def read(spark: SparkSession, path: str, kind: str | None = None, columns: list[str] | None = None, start=None, end=None, format: str | None = None, schema: str | None = None) -> DataFrame:
    """A lazy table; the column list and the bounds are pushed to the scan."""
    format = format or next((f for f in FORMATS if path.rstrip("/").endswith(f)), "parquet")
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}; known: {FORMATS}")
    reader = spark.read.schema(schema) if schema else spark.read
    if format == "csv":
        reader = reader.option("header", True)
        reader = reader if schema else reader.option("inferSchema", True)
    df = reader.format(format).load(path)
    if kind:
        df = validate(df, kind)
    time = next((c for c in ("date", "ts", "event_time") if c in df.columns), None)
    if time:
        df = between(df, time, start, end)
    if columns:
        unknown = [c for c in columns if c not in df.columns]
        if unknown:
            raise ValueError(f"no columns {unknown}")
        df = df.select(*columns)
    return df


def write(df: DataFrame, path: str, kind: str | None = None, format: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}; known: {FORMATS}")
    writer = (validate(df, kind) if kind else df).write.mode(mode).format(format)
    if format == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def convert(df: DataFrame, source: str, target: str) -> DataFrame:
    if source == "equity_curve" and target == "returns_panel":
        from pyspark.sql import Window as W

        w = W.partitionBy(*(["entity"] if "entity" in df.columns else [])).orderBy("date")
        out = df.withColumn("ret", F.col("equity") / F.lag("equity").over(w) - 1)
        return validate(out if "entity" in df.columns else out.withColumn("entity", F.lit("book")), target)
    if (source, target) not in CONVERSIONS:
        raise ValueError(f"no conversion from {source} to {target}")
    a, b = CONVERSIONS[(source, target)]
    return validate(df.withColumnRenamed(a, b), target)


def normalize_book(df: DataFrame, levels: int) -> DataFrame:
    """Arrays of levels from numbered columns; levels without a price are left out."""
    side = lambda s: F.filter(F.array(*(F.struct(F.col(f"{s}_price_{i}").alias("price"), F.col(f"{s}_size_{i}").alias("size")) for i in range(levels))), lambda x: x.price.isNotNull())
    return df.select("symbol", "ts", side("bid").alias("bids"), side("ask").alias("asks"))

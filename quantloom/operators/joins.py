"""Time joins: as-of in both directions, interval joins, date intersections.

The as-of joins tag and union both sides and carry the last (or next) record
along one window, so they cost one shuffle on the key and one sort, and never
pair rows.  Spark spills the window's sort; a hot key is one task's sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, fields: list[str], *, tie: list[str] | None = None, direction: str = "backward", exact: bool = True, max_age: str | None = None, suffix: str = ""
) -> DataFrame:
    """``left`` with ``fields`` of the last record of ``right`` at or before each row (``forward``: the first at or after).

    ``exact=False`` leaves out records at the same moment; ``tie`` orders
    records of one moment; ``max_age`` (an interval) makes older matches null.
    Rows of ``left`` all stay, repeated rows too; a null key or time matches nothing.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    record = F.struct(F.col(right_on).alias("__at"), *fields)
    known = right.where(F.col(right_on).isNotNull() & F.col(key).isNotNull())
    ties = [F.struct(*tie).alias("__tie")] if tie else [F.lit(None).alias("__tie")]
    a = left.select(F.struct(*left.columns).alias("__row"), F.col(key).alias("__key"), F.col(left_on).alias("__ts"), F.lit(None).alias("__tie"))
    b = known.select(F.col(key).alias("__key"), F.col(right_on).alias("__ts"), *ties, record.alias("__record"))
    both = a.unionByName(b, allowMissingColumns=True)
    backward = direction == "backward"
    # Records first on equal moments if they count, last if not.
    side = F.when(F.col("__record").isNotNull() == F.lit(exact), 0).otherwise(1)
    order: list[Column] = [F.col("__ts").asc_nulls_first() if backward else F.col("__ts").desc_nulls_first(), side]
    order.append(F.col("__tie").asc_nulls_first() if backward else F.col("__tie").desc_nulls_first())
    w = W.partitionBy("__key").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("__match", F.last("__record", ignorenulls=True).over(w)).where(F.col("__row").isNotNull())
    fresh = F.col("__key").isNotNull() & F.col("__ts").isNotNull()
    if max_age is not None:
        limit = F.expr(f"INTERVAL {max_age}")
        fresh = fresh & ((F.col("__ts") - limit <= F.col("__match.__at")) if backward else (F.col("__ts") + limit >= F.col("__match.__at")))
    return out.select("__row.*", *(F.when(fresh, F.col(f"__match.{f}")).alias(f + suffix) for f in fields))


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, begin: str, end: str, days: int = 30) -> DataFrame:
    """Rows of ``points`` inside ``[begin, end]`` of a span of the same key.

    Spans are put into every bucket of ``days`` days that they touch, points
    into one, so the join is an equi-join on key and bucket.
    """
    number = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01")) / days)
    dealt = spans.where(F.col(begin) <= F.col(end)).withColumn("__bucket", F.explode(F.sequence(number(begin), number(end))))
    return points.withColumn("__bucket", number(at)).join(dealt, [key, "__bucket"]).where(F.col(at).between(F.col(begin), F.col(end))).drop("__bucket")


def common_dates(streams: DataFrame, stream: str = "entity", date: str = "date", group: str | None = None) -> DataFrame:
    """Rows on the dates that every stream (of the row's ``group``) has."""
    keys = [group] if group else []
    n = streams.groupBy(*keys).agg(F.countDistinct(stream).alias("__n"))
    dates = streams.groupBy(*keys, date).agg(F.countDistinct(stream).alias("__c"))
    dates = dates.join(n, group) if group else dates.crossJoin(F.broadcast(n))
    return streams.join(dates.where("__c = __n").select(*keys, date), [*keys, date], "left_semi")


def date_union(streams: DataFrame, stream: str = "entity", date: str = "date", c: str = "ret") -> DataFrame:
    """``date, streams, present, missing``: every date of any stream, and how many streams have a value on it."""
    n = streams.agg(F.countDistinct(stream).alias("streams"))
    out = streams.groupBy(date).agg(F.countDistinct(F.when(F.col(c).isNotNull(), F.col(stream))).alias("present")).crossJoin(F.broadcast(n))
    return out.select(date, "streams", "present", (F.col("streams") - F.col("present")).alias("missing"))


def onto_calendar(df: DataFrame, calendar: DataFrame, c: str, policy: str = "hold", entity: str = "entity") -> DataFrame:
    """``c`` on every date of ``calendar(entity, date)``: held, flat (0), or refused where it is missing."""
    out = calendar.join(df.select(entity, "date", c), [entity, "date"], "left")
    if policy == "hold":
        return out.withColumn(c, F.last(c, ignorenulls=True).over(W.partitionBy(entity).orderBy("date").rowsBetween(W.unboundedPreceding, 0)))
    if policy == "flat":
        return out.withColumn(c, F.coalesce(c, F.lit(0.0)))
    if policy == "error":
        return out.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing on a date"))).otherwise(F.col(c)))
    raise ValueError(f"unknown policy {policy!r}")

"""Window frames over ordered panels, and the full-window rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by(entity: str = "entity", order: str = "date") -> WindowSpec:
    return W.partitionBy(entity).orderBy(order)


def rows(n: int, entity: str = "entity", order: str = "date") -> WindowSpec:
    """The current row and the ``n - 1`` before it."""
    return by(entity, order).rowsBetween(-(n - 1), 0)


def running(entity: str = "entity", order: str = "date") -> WindowSpec:
    return by(entity, order).rowsBetween(W.unboundedPreceding, 0)


def across(date: str = "date") -> WindowSpec:
    """All entities of a date."""
    return W.partitionBy(date)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full(aggregate: Callable[[Column], Column], c: Column | str, n: int, frame: WindowSpec | None = None, entity: str = "entity", order: str = "date") -> Column:
    """An aggregate of the last ``n`` rows; null until there are ``n`` and where one is missing."""
    frame = frame if frame is not None else rows(n, entity, order)
    return F.when(F.count(col(c)).over(frame) == n, aggregate(col(c)).over(frame))


#: Bytes of a partition of ``dealt``, as the plan estimates them; columnar files hold about a sixth of the rows' size.
PART_BYTES = 8 << 20


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over a number of partitions that grows with its size, so that a task's share does not."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)), *keys)


def average_rank(df: DataFrame, c: str, keys: list[str], name: str) -> DataFrame:
    """``df`` with rank from 1 of ``c`` within ``keys`` as ``name``; ties at their mean, null for null."""
    first = F.rank().over(W.partitionBy(*keys).orderBy(F.col(c).asc_nulls_last()))
    ties = F.count("*").over(W.partitionBy(*keys, c))
    return df.withColumn(name, F.when(F.col(c).isNotNull(), first + (ties - 1) / 2))


def clipped(c: Column) -> Column:
    """At least 0; null for null."""
    return F.when(c > 0, c).when(c.isNotNull(), F.lit(0.0))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, NaN to null; what lies halfway goes up, with room for the last bits."""

    def near(name: str) -> Column:
        value = F.nanvl(F.col(name), F.lit(None).cast("double"))
        # ``floor`` gives a long; what is too large for one is whole (or infinite) without it.
        up = value * 10.0**digits + 0.5000001
        return (F.when(F.abs(value) * 10.0**digits < 2.0**62, F.floor(up).cast("double")).otherwise(up) / 10.0**digits).alias(name)

    return df.select(*(near(c) if t == "double" else F.col(c) for c, t in df.dtypes))

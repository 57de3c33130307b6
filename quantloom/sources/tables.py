"""Analytic views over the driver's tables: bars, returns, ticks, records, sectors, positions.

Each view is a lazy DataFrame; entity and date columns carry the order that the
operators need.  ``SQL`` holds the same views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.frames import by, dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, date, open, high, low, close, volume``: line items of a supplier and ship date.

    Line items are dealt by supplier, so that bars, their windows and their
    recursions share one shuffle and one sort.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    lines = dealt(lines, "l_suppkey").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return lines.groupBy(F.col("l_suppkey").alias("entity"), F.col("l_shipdate").alias("date")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("l_quantity").alias("volume")
    )


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, date, ret``: change of the close, null on the first bar, never filled forward."""
    return bars(spark, sf_dir).select("entity", "date", (F.col("close") / F.lag("close").over(by()) - 1).alias("ret"))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``date, market_ret``: average return of the entities present."""
    return returns(spark, sf_dir).groupBy("date").agg(F.avg("ret").alias("market_ret"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``symbol, ts, seq, price, size`` of the event stream."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("size"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, event_time, available_time, value, seq``: orders, known 30 days after their date."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("event_time"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("available_time"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq")
    )


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, sector``: a supplier's region."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("entity"), F.col("r_name").alias("sector"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, quantity, price``: last close of each entity and its cumulative volume."""
    return bars(spark, sf_dir).groupBy("entity").agg(F.sum("volume").alias("quantity"), F.max_by("close", "date").alias("price"))


#: The views in DuckDB SQL, as common table expressions.
SQL = {
    "bars": """bars AS MATERIALIZED (SELECT entity, date, first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS open, max(price) AS high, min(price) AS low,
      last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS close, sum(l_quantity) AS volume
      FROM (SELECT *, l_suppkey AS entity, l_shipdate AS date, l_extendedprice / l_quantity AS price FROM lineitem) GROUP BY entity, date)""",
    "returns": "returns AS MATERIALIZED (SELECT entity, date, close / lag(close) OVER (PARTITION BY entity ORDER BY date) - 1 AS ret FROM bars)",
    "market": "market AS MATERIALIZED (SELECT date, avg(ret) AS market_ret FROM returns GROUP BY date)",
    "ticks": "ticks AS MATERIALIZED (SELECT user_id AS symbol, ts, event_id AS seq, value AS price, 1.0::DOUBLE AS size FROM events)",
    "records": "records AS MATERIALIZED (SELECT o_custkey AS entity, o_orderdate AS event_time, o_orderdate + INTERVAL 30 DAY AS available_time, o_totalprice AS value, o_orderkey AS seq FROM orders)",
    "sectors": "sectors AS MATERIALIZED (SELECT s_suppkey AS entity, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "positions": "positions AS MATERIALIZED (SELECT entity, sum(volume) AS quantity, last(close ORDER BY date) AS price FROM bars GROUP BY entity)",
}


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the named views."""
    return "WITH " + ",\n".join(SQL[n] for n in names)

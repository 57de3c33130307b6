"""Queries of delta-one trading and correlation networks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.frames import rounded
from quantloom.operators import delta_one as d1
from quantloom.operators import network as nw
from quantloom.operators import statistics as st
from quantloom.plans.catalog import query
from quantloom.sources.tables import bars, market, positions, returns

_RET = ("bars", "returns")


@query(
    """, c AS (SELECT entity % 5 AS root, date, date + to_days(((entity // 5) * 30)::INTEGER) AS expiry, close AS price FROM bars), k AS (SELECT *, row_number() OVER w AS rank, ln(lead(price) OVER w / price) / nullif(date_diff('day', expiry::DATE, (lead(expiry) OVER w)::DATE) / 365.0, 0) AS carry FROM c WINDOW w AS (PARTITION BY root, date ORDER BY expiry))
    SELECT root, date, expiry, rank::INTEGER AS rank, round(carry, 6) AS carry FROM k""",
    ("bars",),
)
def futures_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities stand for contracts of five roots, a month apart."""
    b = bars(spark, sf_dir)
    c = b.select((F.col("entity") % 5).alias("root"), "date", F.expr("date + make_dt_interval(cast(entity div 5 * 30 AS int))").alias("expiry"), F.col("close").alias("price"))
    return rounded(d1.futures_curve(c).select("root", "date", "expiry", "rank", "carry"))


@query(
    """, w AS (SELECT entity, quantity * price / sum(quantity * price) OVER () AS a FROM positions), v AS (SELECT entity, 1.0 / count(*) OVER () AS b FROM positions WHERE entity % 2 = 0)
    SELECT entity, round(coalesce(b, 0) - coalesce(a, 0), 6) AS change, round((coalesce(b, 0) - coalesce(a, 0)) * 1e6, 2) AS flow FROM w FULL JOIN v USING (entity)""",
    ("bars", "positions"),
)
def rebalance_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir).withColumn("v", F.col("quantity") * F.col("price"))
    old = p.crossJoin(F.broadcast(p.agg(F.sum("v").alias("t")))).select("entity", (F.col("v") / F.col("t")).alias("weight"))
    even = p.where("entity % 2 = 0")
    new = even.crossJoin(F.broadcast(even.agg(F.count("*").alias("n")))).select("entity", (1.0 / F.col("n")).alias("weight"))
    out = d1.rebalance_flow(old, new, 1e6)
    return rounded(rounded(out.select("entity", "flow"), 2).join(out.drop("flow"), "entity"))


@query(
    """, r AS (SELECT entity, date, close, 0.03 + (month(date) % 4) / 100.0 AS rate FROM bars), x AS (SELECT entity, date, 1e6 * (close / lag(close) OVER w - 1) AS e, 1e6 * (lag(rate) OVER w + 0.005) * date_diff('day', (lag(date) OVER w)::DATE, date::DATE) / 360 AS f FROM r WINDOW w AS (PARTITION BY entity ORDER BY date))
    SELECT entity, date, round(e, 3) AS equity_leg, round(f, 3) AS funding_leg, round(e - f, 3) AS net FROM x WHERE e - f IS NOT NULL""",
    ("bars",),
)
def total_return_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bars(spark, sf_dir).select("entity", "date", "close", (0.03 + (F.month("date") % 4) / 100.0).alias("rate"))
    return rounded(d1.total_return_swap(path, 1e6, 0.005), 3)


@query(
    """, p AS (SELECT a.date, ln(a.close) - ln(b.close) AS spread FROM bars a JOIN bars b ON a.date = b.date AND a.entity = 1 AND b.entity = 2), z AS (SELECT *, CASE WHEN count(spread) OVER w = 30 THEN (spread - avg(spread) OVER w) / nullif(stddev_samp(spread) OVER w, 0) END AS z FROM p WINDOW w AS (ORDER BY date ROWS 29 PRECEDING)),
    k AS (SELECT *, coalesce(last_value(CASE WHEN abs(z) <= 0.5 THEN 0.0 WHEN z >= 1.5 THEN -1.0 WHEN z <= -1.5 THEN 1.0 END IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 0.0) AS position FROM z)
    SELECT date, round(spread, 6) AS spread, round(z, 6) AS z, position::DOUBLE AS position, round(coalesce(lag(position) OVER w * (spread - lag(spread) OVER w), 0), 6) AS pnl FROM k WINDOW w AS (ORDER BY date)""",
    ("bars",),
)
def pair_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    s = st.spread(b.where("entity = 1"), b.where("entity = 2"), 1.0)
    return rounded(d1.pair_backtest(s.select("date", "spread"), 1.5, 0.5, 30))


@query(
    """, s AS (SELECT * FROM (VALUES ('first', TIMESTAMP '1996-01-01', TIMESTAMP '1996-02-01'), ('second', TIMESTAMP '1998-06-01', TIMESTAMP '1998-07-15')) v(name, a, b)) SELECT name, entity, count(*) AS bars, round(product(greatest(1 + ret / 500, 0)) - 1, 6) AS ret, round(min(ret / 500), 6) AS worst FROM returns JOIN s ON date BETWEEN a AND b WHERE ret IS NOT NULL GROUP BY name, entity""",
    _RET,
)
def stress_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = spark.createDataFrame([("first", dt.datetime(1996, 1, 1), dt.datetime(1996, 2, 1)), ("second", dt.datetime(1998, 6, 1), dt.datetime(1998, 7, 15))], "name string, begin timestamp_ntz, end timestamp_ntz")
    r = returns(spark, sf_dir)
    return rounded(d1.stress_windows(r.withColumn("ret", r.ret / 500), w))


@query(", d AS (SELECT r.ret - m.market_ret AS d FROM returns r JOIN market m USING (date) WHERE r.entity = 1 AND r.ret IS NOT NULL AND m.market_ret IS NOT NULL) SELECT count(*) AS n, round(stddev_samp(d) * sqrt(252), 6) AS tracking_error, round(avg(d) * 252, 6) AS active_return FROM d", (*_RET, "market"))
def tracking_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(d1.tracking_error(returns(spark, sf_dir).where("entity = 1"), market(spark, sf_dir).withColumnRenamed("market_ret", "ret")))


@query(
    """, k AS (SELECT date_trunc('quarter', date) AS period, date, entity, ret FROM returns WHERE ret IS NOT NULL), c AS (SELECT a.period, a.entity, b.entity AS o, covar_samp(a.ret, b.ret) / nullif(stddev_samp(a.ret) * stddev_samp(b.ret), 0) AS c FROM k a JOIN k b ON a.date = b.date AND a.entity <> b.entity GROUP BY ALL HAVING count(*) >= 3)
    SELECT period::TIMESTAMP AS period, entity, round(avg(c), 5) AS avg_corr, count(c) AS pairs FROM c GROUP BY ALL""",
    _RET,
)
def average_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nw.average_correlation(returns(spark, sf_dir)), 5).withColumn("period", F.col("period").cast("timestamp_ntz"))


@query()
def mst_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.mst_degree(returns(spark, sf_dir))


@query()
def pca_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nw.pca(returns(spark, sf_dir)), 4)

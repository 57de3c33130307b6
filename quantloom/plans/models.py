"""Queries of allocation and of model experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.frames import rounded
from quantloom.functions.quantiles import stored
from quantloom.operators import allocation as al
from quantloom.operators import features as ft
from quantloom.operators import learning as ln
from quantloom.operators import models as md
from quantloom.plans.catalog import query
from quantloom.sources.tables import bars, returns

_RET = ("bars", "returns")


@query(
    """, k AS (SELECT * FROM returns WHERE ret IS NOT NULL), p AS (SELECT entity, date, list(ret * ret) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING) AS p FROM k),
    v AS (SELECT entity, date, sqrt(252 * list_sum(list_transform(p, lambda x, i: x * power(power(0.5, 1 / 20.0), len(p) - i))) / list_sum(list_transform(p, lambda x, i: power(power(0.5, 1 / 20.0), len(p) - i)))) AS vol FROM p)
    SELECT entity, date, round(vol, 5) AS vol FROM v""",
    _RET,
)
def ewma_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(al.ewma_volatility(returns(spark, sf_dir), 20.0).select("entity", "date", "vol"), 5)


@query(", a AS (SELECT entity, avg(ret) AS m, var_pop(ret) AS v FROM returns WHERE ret IS NOT NULL GROUP BY entity) SELECT entity, round(m / v, 6) AS fraction, round(m * m / v / 2, 6) AS log_growth FROM a", _RET)
def kelly_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(al.kelly(returns(spark, sf_dir)))


@query(
    """, a AS (SELECT entity, avg(ret) / stddev_samp(ret) * sqrt(252) AS s FROM returns WHERE ret IS NOT NULL GROUP BY entity) SELECT entity, round(s, 6) AS sharpe, round(0.5 * s + 0.5 * (SELECT avg(s) FROM a), 6) AS shrunk FROM a""",
    _RET,
)
def shrunk_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(al.shrunk_sharpe(returns(spark, sf_dir)))


@query(
    """, a AS (SELECT entity, avg(close * volume) AS adv, stddev_samp(ln(close / open)) AS vol FROM bars GROUP BY entity), s AS (SELECT *, unnest([1e5, 1e6, 1e7]) AS size FROM a)
    SELECT entity, round(adv, 4) AS adv, size::DOUBLE AS size, ceil(size / (adv * 0.1))::BIGINT AS days, round(0.1 * coalesce(vol, 0) * sqrt(size / adv) * 1e4, 4) AS impact_bps FROM s""",
    ("bars",),
)
def capacity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(al.capacity(bars(spark, sf_dir), [1e5, 1e6, 1e7]).select("entity", "adv", "size", "days", "impact_bps"), 4)


@query(
    """, k AS (SELECT entity, date, ret FROM returns WHERE ret IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM k),
    v AS (SELECT a.entity, a.date, sqrt(sum(power(0.5, (a.i - 1 - b.i) / 20.0) * b.ret * b.ret) / sum(power(0.5, (a.i - 1 - b.i) / 20.0)) * 252) AS vol FROM n a LEFT JOIN n b ON a.entity = b.entity AND b.i < a.i AND b.i >= a.i - 500 GROUP BY a.entity, a.date),
    r AS (SELECT *, CASE WHEN vol > 0 THEN 1 / vol END AS r FROM v) SELECT entity, date, round(least(coalesce(r / sum(r) OVER (PARTITION BY date), 0.0), 1.0), 6) AS weight FROM r""",
    ("bars", "returns"),
)
def inverse_volatility_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(al.inverse_volatility(returns(spark, sf_dir)).select("entity", "date", "weight"))


@query()
def walk_forward_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-sample predictions of forward returns from window features, two steps and ridge regression."""
    run = md.Experiment(["momentum", "rolling_drawdown", "volume_surprise"], steps=[("winsorize", {}), ("zscore", {})])
    panel = stored(ft.window_features(bars(spark, sf_dir), also=ln.forward_columns(5)).select("entity", "date", *run.features, "target", "label_end_date"))
    n = panel.select("date").distinct().count()
    return rounded(run.walk_forward(panel, n // 2, n // 4, 5).select("entity", "date", "fold", "prediction"), 4)

"""Queries of statistics, finance and screening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.frames import rounded
from quantloom.operators import finance as fi
from quantloom.operators import screener as sc
from quantloom.operators import statistics as st
from quantloom.plans.catalog import query
from quantloom.sources.tables import bars, positions, returns, table

_RET = ("bars", "returns")


@query(
    """, p AS (SELECT a.date, ln(a.close) AS x, ln(b.close) AS y FROM bars a JOIN bars b ON a.date = b.date AND a.entity = 1 AND b.entity = 2), h AS (SELECT regr_slope(x, y) AS h FROM p) SELECT date, round(x - h * y, 6) AS spread, round(h, 6) AS hedge FROM p, h""",
    ("bars",),
)
def pair_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return rounded(st.spread(b.where("entity = 1"), b.where("entity = 2")))


@query(
    """, l AS (SELECT entity, close - lag(close) OVER w AS d, lag(close) OVER w AS l FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)), a AS (SELECT entity, count(*) AS n, regr_slope(d, l) AS b FROM l WHERE d IS NOT NULL GROUP BY entity)
    SELECT entity, n, round(b, 6) AS slope, round(ln(0.5) / ln(abs(1 + b)), 5) AS half_life FROM a""",
    ("bars",),
)
def half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.half_life(bars(spark, sf_dir), "close")
    return rounded(rounded(out.select("entity", "half_life"), 5).join(out.drop("half_life"), "entity"))


@query(
    """, x AS (SELECT entity, date, ret - avg(ret) OVER (PARTITION BY entity) AS x FROM returns WHERE ret IS NOT NULL), l AS (SELECT *, lag(x, 1) OVER w AS a, lag(x, 2) OVER w AS b, lag(x, 3) OVER w AS c FROM x WINDOW w AS (PARTITION BY entity ORDER BY date)),
    s AS (SELECT entity, count(*) AS n, sum(x * a) / sum(x * x) AS r1, sum(x * b) / sum(x * x) AS r2, sum(x * c) / sum(x * x) AS r3 FROM l GROUP BY entity) SELECT entity, n, round(r1, 6) AS rho_1, round(n * (n + 2) * (r1 * r1 / (n - 1) + r2 * r2 / (n - 2) + r3 * r3 / (n - 3)), 5) AS ljung_box FROM s""",
    _RET,
)
def ljung_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.autocorrelation(returns(spark, sf_dir), "ret", 3)
    return rounded(rounded(out.select("entity", "ljung_box"), 5).join(out.drop("ljung_box"), "entity"))


@query(
    """, k AS (SELECT entity, ret, CASE WHEN count(ret) OVER w = 5 THEN sum(ret) OVER w END AS s FROM (SELECT * FROM returns WHERE ret IS NOT NULL) WINDOW w AS (PARTITION BY entity ORDER BY date ROWS 4 PRECEDING)) SELECT entity, round(var_samp(s) / (5 * var_samp(ret)), 6) AS variance_ratio FROM k GROUP BY entity""",
    _RET,
)
def variance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.variance_ratio(returns(spark, sf_dir), "ret", 5))


@query("SELECT month(date)::INTEGER AS period, count(*) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS std, round(avg(ret) / (stddev_samp(ret) / sqrt(count(*))), 6) AS t FROM returns WHERE ret IS NOT NULL GROUP BY 1", _RET)
def seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.seasonality(returns(spark, sf_dir), "ret"))


@query(
    """, k AS (SELECT entity, date, ret AS x FROM returns WHERE ret IS NOT NULL), a AS (SELECT entity AS j, date, 0 AS lag, x AS y FROM k UNION ALL SELECT entity, date, 1, lead(x, 1) OVER (PARTITION BY entity ORDER BY date) FROM k UNION ALL SELECT entity, date, 2, lead(x, 2) OVER (PARTITION BY entity ORDER BY date) FROM k)
    SELECT k.entity AS i, j, lag, count(*) AS n, round(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), 6) AS corr FROM k JOIN a USING (date) WHERE k.entity <> j AND y IS NOT NULL GROUP BY ALL""",
    _RET,
)
def lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.lead_lag(returns(spark, sf_dir), "ret", 2))


@query(
    """, x AS (SELECT entity, ret, min(ret) OVER w AS lo, max(ret) OVER w AS hi FROM returns WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY entity)), b AS (SELECT entity, least(floor((ret - lo) / nullif(hi - lo, 0) * 10), 9) AS bin FROM x), k AS (SELECT entity, count(*) AS k FROM b GROUP BY entity, bin), p AS (SELECT entity, k / sum(k) OVER (PARTITION BY entity) AS p FROM k)
    SELECT entity, round(-sum(p * ln(p)), 6) AS entropy, round(-sum(p * ln(p)) / ln(10), 6) AS normalized FROM p GROUP BY entity""",
    _RET,
)
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.entropy(returns(spark, sf_dir), "ret"))


@query(
    """, v AS (SELECT entity, date, CASE WHEN count(ret) OVER w = 60 THEN stddev_samp(ret) OVER w END AS vol FROM returns WINDOW w AS (PARTITION BY entity ORDER BY date ROWS 59 PRECEDING)), k AS (SELECT * FROM v WHERE vol IS NOT NULL), q AS (SELECT entity, quantile_cont(vol, 0.25) AS a, quantile_cont(vol, 0.75) AS b FROM k GROUP BY entity)
    SELECT entity, date, round(vol, 6) AS vol, CASE WHEN vol < a THEN 'low' WHEN vol > b THEN 'high' ELSE 'normal' END AS regime FROM k JOIN q USING (entity)""",
    _RET,
)
def volatility_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.regimes(returns(spark, sf_dir), "ret"))


@query()
def hurst_exponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.hurst(returns(spark, sf_dir), "ret"))


@query()
def garch_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.garch(returns(spark, sf_dir), "ret"))


@query()
def kalman_hedge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.kalman_hedge(bars(spark, sf_dir), "close", "open"))


@query()
def bootstrap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.block_bootstrap(returns(spark, sf_dir), "ret"))


@query()
def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.deflated_sharpe(returns(spark, sf_dir), 20))


@query()
def overfitting_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.overfitting_probability(returns(spark, sf_dir).where("ret is not null").select(F.col("entity").alias("config"), "date", "ret")))


@query(
    """, p AS (SELECT entity, quantity * (CASE WHEN entity % 2 = 0 THEN 1 ELSE -1 END) AS q, price, CASE WHEN entity % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM positions), v AS (SELECT *, q::DECIMAL(28,8) * 1.0 AS z, (q * price) * CASE WHEN currency = 'EUR' THEN 1.1 ELSE 1.0 END AS n FROM p)
    SELECT currency, count(*) AS lines, round(sum(abs(n)), 1) AS gross, round(sum(n), 1) AS net, round(sum(CASE WHEN n > 0 THEN n ELSE 0 END), 1) AS long, round(sum(CASE WHEN n < 0 THEN n ELSE 0 END), 1) AS short FROM v GROUP BY ROLLUP (currency)""",
    ("bars", "positions"),
)
def currency_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir).select(F.col("entity").alias("instrument"), (F.col("quantity") * F.when(F.col("entity") % 2 == 0, 1).otherwise(-1)).alias("quantity"), "price", F.when(F.col("entity") % 3 == 0, "EUR").otherwise("USD").alias("currency"))
    rates = spark.createDataFrame([("EUR", 1.1)], ["currency", "rate"])
    return rounded(fi.exposure_summary(fi.position_values(p, rates)), 1)


@query("SELECT o_custkey AS key, round(sum(o_totalprice * power(1.05, -(date_diff('day', DATE '1995-01-01', o_orderdate::DATE) / 365.0))), 2) AS npv FROM orders GROUP BY o_custkey")
def net_present_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), (F.datediff("o_orderdate", F.lit("1995-01-01")) / 365.0).alias("years"), F.col("o_totalprice").alias("amount"))
    return rounded(fi.net_present_value(o, 0.05), 2)


@query(
    """, f AS (SELECT entity, last(close ORDER BY date) AS price, avg(volume) AS volume FROM bars GROUP BY entity) SELECT entity, round(price, 6) AS price, round(volume, 6) AS volume, CASE WHEN NOT coalesce(price >= 1000, false) THEN 'price_min' WHEN NOT coalesce(volume >= 25, false) THEN 'volume_min' END AS failed, coalesce(price >= 1000, false) AND coalesce(volume >= 25, false) AS passed FROM f""",
    ("bars",),
)
def screener(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = bars(spark, sf_dir).groupBy("entity").agg(F.max_by("close", "date").alias("price"), F.avg("volume").alias("volume"))
    return rounded(sc.screen(f, price_min=1000, volume_min=25))

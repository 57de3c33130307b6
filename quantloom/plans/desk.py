"""Queries of portfolio simulation, fills, factor models, cointegration, risk forecasts and data hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.frames import by, full, rounded
from quantloom.operators import backtest as bt
from quantloom.operators import metrics as mt
from quantloom.operators import microstructure as ms
from quantloom.operators import quality
from quantloom.operators import statistics as st
from quantloom.plans.catalog import query
from quantloom.plans.metrics import _CURVE, _curve
from quantloom.plans.panels import _SMA
from quantloom.sources.tables import bars, market, records, returns, table, ticks

_RET = ("bars", "returns")


@query(
    f"""{_SMA}, x AS (SELECT *, coalesce(lag(signal) OVER w, 0.0) AS executed, lag(close) OVER w AS c0 FROM s WINDOW w AS (PARTITION BY entity ORDER BY date)), y AS (SELECT *, coalesce(lag(executed) OVER (PARTITION BY entity ORDER BY date), 0.0) AS held FROM x),
    z AS (SELECT *, coalesce((1 + held * (open / c0 - 1)) * (1 + executed * (close / open - 1)) - 1, 0) AS gross, abs(executed - held) * (0.05 / open + 0.0005) AS cost FROM y)
    SELECT entity, date, executed::DOUBLE AS executed, round(gross, 6) AS gross, round(cost, 6) AS cost, round(gross - cost, 6) AS net FROM z""",
    ("bars",),
)
def next_open_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-leg fills at the open, five cents a share."""
    book = bt.run_strategy(bt.sma_signal(bars(spark, sf_dir)), commission=0.05, fill="next_open", commission_model="per_share")
    return rounded(book.select("entity", "date", "executed", "gross", "cost", "net"))


@query(
    """, x AS (SELECT entity, date, CASE WHEN lag(close) OVER w IS NULL THEN 0.0 ELSE 1.0 END AS executed, close / lag(close) OVER w - 1 AS r FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)), y AS (SELECT *, coalesce(executed * r, 0) - abs(executed - coalesce(lag(executed) OVER (PARTITION BY entity ORDER BY date), 0)) * 0.0015 AS net FROM x)
    SELECT entity, count(*) AS bars, round(avg(net), 6) AS mean, round(min(net), 6) AS worst, round(max(net), 6) AS best FROM y GROUP BY entity""",
    ("bars",),
)
def buy_and_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = bt.run_strategy(bt.buy_and_hold_signal(bars(spark, sf_dir)))
    return rounded(book.groupBy("entity").agg(F.count("*").alias("bars"), F.avg("net").alias("mean"), F.min("net").alias("worst"), F.max("net").alias("best")))


def _with_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns with the market's of the date and the entity's before."""
    return returns(spark, sf_dir).where("ret is not null").join(market(spark, sf_dir), "date").withColumn("before", F.lag("ret").over(by()))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns(spark, sf_dir).where("ret is not null").withColumnRenamed("ret", "score")


@query(
    """, k AS (SELECT entity, date, ret FROM returns WHERE ret IS NOT NULL), r AS (SELECT *, sign(ret) AS a, coalesce((ret - avg(ret) OVER d) / nullif(stddev_samp(ret) OVER d, 0), 0) AS b, CASE WHEN percent_rank() OVER (PARTITION BY date ORDER BY ret, entity) >= 0.8 THEN 1.0 WHEN percent_rank() OVER (PARTITION BY date ORDER BY ret, entity) <= 0.2 THEN -1.0 ELSE 0.0 END AS c FROM k WINDOW d AS (PARTITION BY date))
    SELECT entity, date, round(coalesce(a / nullif(sum(abs(a)) OVER d, 0), 0), 6) AS w_sign, round(coalesce(b / nullif(sum(abs(b)) OVER d, 0), 0), 6) AS w_zscore, round(coalesce(c / nullif(sum(abs(c)) OVER d, 0), 0), 6) AS w_quantile FROM r WINDOW d AS (PARTITION BY date)""",
    _RET,
)
def prediction_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _scores(spark, sf_dir)
    for method in ("sign", "zscore", "quantile"):
        out = bt.prediction_weights(out, method).withColumnRenamed("weight", f"w_{method}")
    return rounded(out.drop("score"))


@query(
    """, k AS (SELECT entity, date, ret FROM returns WHERE ret IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2 AS rk FROM k), d AS (SELECT *, rk - avg(rk) OVER (PARTITION BY date) AS d FROM r),
    f AS (SELECT min(date) AS date FROM k GROUP BY date_trunc('month', date)), t AS (SELECT entity, date, coalesce(d / nullif(sum(abs(d)) OVER (PARTITION BY date), 0), 0) AS target FROM d SEMI JOIN f USING (date)),
    h AS (SELECT entity, date, ret, target, coalesce(last_value(target IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM k FULL JOIN t USING (entity, date)),
    y AS (SELECT date, sum(held * coalesce(ret, 0) / 100) AS gross, coalesce(sum(abs(target - held)), 0) AS turnover FROM h GROUP BY date)
    SELECT date, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(turnover * 0.0015, 6) AS cost, round(gross - turnover * 0.0015, 6) AS net FROM y""",
    _RET,
)
def portfolio_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of returns as targets, taken on once a month; a hundredth of each return."""
    r = returns(spark, sf_dir).where("ret is not null")
    weights = bt.rank_weights(r.withColumnRenamed("ret", "score")).select("entity", "date", "weight")
    return rounded(bt.simulate_portfolio(weights, r.withColumn("ret", F.col("ret") / 100)).drop("equity"))


@query("SELECT entity, date, CASE WHEN date_trunc('week', date) = lag(date_trunc('week', date)) OVER (PARTITION BY entity ORDER BY date) THEN 0.0 ELSE 1.0 END AS rehedge FROM bars", ("bars",))
def rehedge_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.rehedge_dates(bars(spark, sf_dir).select("entity", "date"), "week")


@query(
    """, q AS (SELECT r.entity, r.ret AS y, market_ret AS a, lag(r.ret) OVER (PARTITION BY r.entity ORDER BY r.date) AS b FROM returns r JOIN market USING (date) WHERE ret IS NOT NULL), p AS (SELECT * FROM q WHERE a IS NOT NULL AND b IS NOT NULL),
    m AS (SELECT entity, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS yb, var_pop(y) * count(*) AS yy FROM p GROUP BY entity),
    c AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS b1, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM m), e AS (SELECT *, my - b1 * ma - b2 * mb AS b0, (yy - b1 * ay - b2 * yb) / (n - 3) AS s2 FROM c)
    SELECT entity, n, round(1 - s2 * (n - 3) / yy, 5) AS r2, round(b0, 4) AS alpha, round(b1, 4) AS beta_market_ret, round(b2, 4) AS beta_before, round(b0 / sqrt(s2 * (1.0 / n + (ma * ma * bb + mb * mb * aa - 2 * ma * mb * ab) / (aa * bb - ab * ab))), 4) AS t_alpha,
      round(b1 / sqrt(s2 * bb / (aa * bb - ab * ab)), 4) AS t_beta_market_ret, round(b2 / sqrt(s2 * aa / (aa * bb - ab * ab)), 4) AS t_beta_before FROM e""",
    ("bars", "returns", "market"),
)
def factor_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns on the market's and on the return before."""
    out = st.factor_regression(_with_before(spark, sf_dir), "ret", ["market_ret", "before"])
    return rounded(rounded(out.select("entity", "r2"), 5).join(rounded(out.drop("r2"), 4), "entity"))


@query(
    """, x AS (SELECT entity, date, ln(close) AS x FROM bars WHERE close > 0), p AS (SELECT a.entity AS i, b.entity AS j, a.date, a.x AS a, b.x AS b FROM x a JOIN x b ON a.date = b.date AND a.entity < b.entity), f AS (SELECT i, j, count(*) AS n, regr_slope(a, b) AS hedge, regr_intercept(a, b) AS alpha FROM p GROUP BY i, j HAVING count(*) >= 30),
    e AS (SELECT *, a - alpha - hedge * b AS e FROM p JOIN f USING (i, j)), l AS (SELECT *, lag(e) OVER (PARTITION BY i, j ORDER BY date) AS l FROM e), s AS (SELECT i, j, any_value(n) AS n, any_value(hedge) AS hedge, any_value(alpha) AS alpha, count(*) AS m, regr_slope(e - l, l) AS rho, regr_sxx(e - l, l) AS sxx, regr_syy(e - l, l) AS syy FROM l WHERE l IS NOT NULL GROUP BY i, j)
    SELECT i, j, n, round(hedge, 5) AS hedge, round(alpha, 5) AS alpha, round(rho / nullif(sqrt((syy - rho * rho * sxx) / (m - 2) / sxx), 0), 5) AS adf, CASE WHEN rho < 0 AND rho > -1 THEN round(ln(0.5) / ln(1 + rho), 5) END AS half_life FROM s""",
    ("bars",),
)
def cointegration_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.cointegration_scan(bars(spark, sf_dir)), 5)


@query(
    """, k AS (SELECT entity, date, ret FROM returns WHERE ret IS NOT NULL), m AS (SELECT *, count(ret) OVER w AS n, avg(ret) OVER w AS mu, stddev_samp(ret) OVER w AS sd, avg(ret * ret) OVER w AS r2, avg(power(ret, 3)) OVER w AS r3, avg(power(ret, 4)) OVER w AS r4 FROM k WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, r2 - mu * mu AS c2, r3 - 3 * mu * r2 + 2 * power(mu, 3) AS c3, r4 - 4 * mu * r3 + 6 * mu * mu * r2 - 3 * power(mu, 4) AS c4, -1.6448536269514726::DOUBLE AS z FROM m WHERE n = 100), s AS (SELECT *, c3 / power(c2, 1.5) AS s, c4 / (c2 * c2) - 3 AS k FROM c)
    SELECT entity, date, round(-(mu + z * sd), 5) AS var_normal, round(-(mu + sd * (z + (z * z - 1) * s / 6 + (z * z * z - 3 * z) * k / 24 - (2 * z * z * z - 5 * z) * s * s / 36)), 5) AS var_cornish_fisher FROM s""",
    _RET,
)
def var_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mt.var_forecasts(returns(spark, sf_dir), ["normal", "cornish_fisher"])
    return rounded(out.drop("ret"), 5)


@query(
    """, k AS (SELECT entity, date, ret FROM returns WHERE ret IS NOT NULL), l AS (SELECT *, list(ret * ret) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM k), f AS (SELECT entity, date, list_reduce(list_concat([list_avg(p[1:100])], p[101:]), lambda a, x: 0.94 * a + 0.06 * x) AS v FROM l WHERE len(p) >= 100)
    SELECT entity, date, round(1.6448536269514726 * sqrt(v), 6) AS var_ewma FROM f""",
    _RET,
)
def var_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mt.var_forecast(returns(spark, sf_dir), "ewma").select("entity", "date", F.col("var").alias("var_ewma")))


@query(
    f"""{_CURVE}, i AS (SELECT *, drawdown < 0 AS under, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING) AS island, min(CASE WHEN drawdown >= 0 THEN date END) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np FROM d),
    x AS (SELECT entity, min(date) AS start, max(np) FILTER (under) AS "end", min(drawdown) FILTER (under) AS depth FROM i GROUP BY entity, island HAVING count(*) FILTER (under) > 0), y AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY depth, start) AS place FROM x WHERE depth <= -0.002), u AS (SELECT entity, avg((drawdown < 0)::INTEGER) AS underwater FROM d GROUP BY entity)
    SELECT entity, start, "end", round(depth, 6) AS depth, place::INTEGER AS place, "end" IS NULL AS open, round(underwater, 6) AS underwater FROM y JOIN u USING (entity) WHERE place <= 3""",
    _RET,
)
def material_drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mt.material_drawdowns(_curve(spark, sf_dir), 0.002, 3).drop("trough", "bars"))


@query(
    """, p AS (SELECT r.entity, r.ret AS a, m.market_ret AS b, lag(r.ret) OVER (PARTITION BY r.entity ORDER BY r.date) AS g FROM returns r JOIN market m USING (date) WHERE r.ret IS NOT NULL), k AS (SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND g IS NOT NULL),
    c AS (SELECT entity, count(*) AS n, covar_samp(a, b) / (stddev_samp(a) * stddev_samp(b)) AS r, covar_samp(a, g) / (stddev_samp(a) * stddev_samp(g)) AS u, covar_samp(b, g) / (stddev_samp(b) * stddev_samp(g)) AS v FROM k GROUP BY entity) SELECT entity, n, round(r, 6) AS corr, round((r - u * v) / sqrt((1 - u * u) * (1 - v * v)), 6) AS partial FROM c""",
    ("bars", "returns", "market"),
)
def partial_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.partial_correlation(_with_before(spark, sf_dir), "ret", "market_ret", "before"))


@query(
    """, h AS (SELECT entity, date, CASE WHEN volume < 5 THEN NULL ELSE close END AS close FROM bars), l AS (SELECT entity, max(date) FILTER (close IS NOT NULL) AS last FROM h GROUP BY entity), c AS (SELECT entity, count(*) FILTER (close IS NULL AND date <= last) AS m, count(*) FILTER (close IS NULL AND date > last) AS p FROM h JOIN l USING (entity) GROUP BY entity)
    SELECT entity, date, round(close, 6) AS close, m AS dropped_missing, p AS dropped_placeholder FROM h JOIN c USING (entity) WHERE close IS NOT NULL""",
    ("bars",),
)
def usable_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).select("entity", "date", F.when(F.col("volume") >= 5, F.col("close")).alias("close"))
    return rounded(quality.usable_bars(b, ("close",)))


@query("SELECT 'event_type' AS \"column\", event_type AS value, count(*) AS n FROM events WHERE event_type IS NULL OR event_type NOT IN ('click', 'view') GROUP BY event_type")
def membership_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.membership_faults(table(spark, sf_dir, "events"), {"event_type": ["click", "view"]})


@query(
    """, x AS (SELECT entity, CASE WHEN count(close) OVER f = 20 THEN avg(close) OVER f END AS sma, CASE WHEN count(close) OVER g = 60 THEN avg(close) OVER g END AS slow, lead(close, 5) OVER w AS target FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date), f AS (PARTITION BY entity ORDER BY date ROWS 19 PRECEDING), g AS (PARTITION BY entity ORDER BY date ROWS 59 PRECEDING)),
    y AS (SELECT *, sma IS NULL OR slow IS NULL AS f, target IS NULL AS t FROM x) SELECT entity, count(*) AS rows, count(*) FILTER (f AND NOT t) AS no_features, count(*) FILTER (t AND NOT f) AS no_target, count(*) FILTER (f AND t) AS both, count(*) FILTER (NOT f AND NOT t) AS kept, count(*) FILTER (sma IS NULL) AS missing_sma, count(*) FILTER (slow IS NULL) AS missing_slow FROM y GROUP BY entity""",
    ("bars",),
)
def lost_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bars(spark, sf_dir).select("entity", full(F.avg, "close", 20).alias("sma"), full(F.avg, "close", 60).alias("slow"), F.lead("close", 5).over(by()).alias("target"))
    return quality.lost_rows(x, ["sma", "slow"], "target")


@query(", v AS (SELECT entity, date_trunc('month', event_time) AS month, count(DISTINCT value) AS versions FROM records GROUP BY 1, 2) SELECT entity, month, versions, versions > 1 AS restated FROM v", ("records",))
def record_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.versions(records(spark, sf_dir).withColumn("month", F.date_trunc("month", "event_time")), ["entity", "month"], "value")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY l_returnflag, l_linestatus")
def frequency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.frequencies(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]))


@query(
    """, f AS (SELECT entity, year(date) AS fold, avg(ret) AS mean, count(ret) AS n FROM returns GROUP BY 1, 2) SELECT entity, round(avg(mean), 6) AS mean, round(sum(mean * n) / sum(n), 6) AS weighted, round(min(mean), 6) AS worst, count(*) AS folds FROM f WHERE mean IS NOT NULL GROUP BY entity""",
    _RET,
)
def fold_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = returns(spark, sf_dir).groupBy("entity", F.year("date").alias("fold")).agg(F.avg("ret").alias("score"), F.count("ret").alias("n"))
    return rounded(st.fold_average(f, "score", "n", ["entity"]))


@query(
    """, d AS (SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq) AS d FROM ticks), s AS (SELECT *, coalesce(last_value(nullif(sign(d), 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0) AS side FROM d)
    SELECT symbol, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS intensity, round(sum(size), 6) AS volume, round(sum(price * size), 4) AS dollar_volume, round(sum(side * size), 6) AS signed_flow, round(max(price) - min(price), 6) AS "range", round(sum(abs(d)), 4) AS path FROM s GROUP BY 1, 2""",
    ("ticks",),
)
def liquidity_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ms.liquidity_channels(ticks(spark, sf_dir), "1 day")
    coarse = ["dollar_volume", "path"]
    return rounded(out.drop(*coarse)).join(rounded(out.select("symbol", "start", *coarse), 4), ["symbol", "start"])

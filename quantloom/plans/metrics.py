"""Queries of the risk and return metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.functions.frames import rounded
from quantloom.operators import metrics as m
from quantloom.plans.catalog import query
from quantloom.sources.tables import market, returns

_RET = ("bars", "returns")
_MKT = (*_RET, "market")


@query(
    """, a AS (SELECT entity, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS std, avg(power(least(ret, 0), 2)) AS down2, exp(sum(ln(1 + ret))) AS g, quantile_cont(ret, 0.05) AS q FROM returns WHERE ret IS NOT NULL GROUP BY entity)
    SELECT entity, n, round(g - 1, 6) AS cumulative_return, round(power(g, 252.0 / n) - 1, 4) AS cagr, round(std * sqrt(252), 6) AS volatility, round(mean / std * sqrt(252), 6) AS sharpe, round(mean * 252 / (sqrt(down2) * sqrt(252)), 6) AS sortino, round(-q, 6) AS var_95, round(-(mean - 1.6448536269514722 * std), 6) AS var_parametric FROM a""",
    _RET,
)
def risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = m.summary(returns(spark, sf_dir)).drop("skew", "excess_kurtosis")
    return rounded(rounded(out.select("cagr", "entity"), 4).join(out.drop("cagr"), "entity"))


@query(", q AS (SELECT entity, quantile_cont(ret, 0.05) AS q FROM returns GROUP BY entity) SELECT entity, round(-avg(ret) FILTER (ret <= q), 6) AS cvar, count(*) FILTER (ret <= q) AS n_tail FROM returns JOIN q USING (entity) GROUP BY entity", _RET)
def conditional_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.tail_mean(returns(spark, sf_dir)))


_CURVE = ", e AS (SELECT entity, date, product(greatest(1 + coalesce(ret / 500, 0), 0)) OVER w AS equity FROM returns WINDOW w AS (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING)), d AS (SELECT *, max(equity) OVER w AS peak, equity / max(equity) OVER w - 1 AS drawdown FROM e WINDOW w AS (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING))"


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity of a five-hundredth of each return: the test bars move too much to compound whole."""
    r = returns(spark, sf_dir)
    return m.equity(r.withColumn("ret", r.ret / 500))


@query(f"{_CURVE} SELECT entity, date, round(equity, 6) AS equity, round(peak, 6) AS peak, round(drawdown, 6) AS drawdown FROM d", _RET)
def equity_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.drawdowns(_curve(spark, sf_dir)).select("entity", "date", "equity", "peak", "drawdown"))


@query(
    f"""{_CURVE}, i AS (SELECT *, drawdown < 0 AS under, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING) AS island, min(CASE WHEN drawdown >= 0 THEN date END) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np FROM d)
    SELECT entity, min(date) AS start, first(date ORDER BY drawdown, date) FILTER (under) AS trough, max(np) FILTER (under) AS "end", round(min(drawdown) FILTER (under), 6) AS depth, count(*) FILTER (under) AS bars FROM i GROUP BY entity, island HAVING count(*) FILTER (under) > 0""",
    _RET,
)
def drawdown_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.drawdown_episodes(_curve(spark, sf_dir)))


@query(
    """, b AS (SELECT *, ret - market_ret AS active FROM returns JOIN market USING (date) WHERE ret IS NOT NULL AND market_ret IS NOT NULL), a AS (SELECT entity, count(*) AS n, covar_samp(ret, market_ret) AS cov, var_samp(market_ret) AS vm, var_samp(ret) AS va, avg(ret) AS mr, avg(market_ret) AS mm, avg(active) AS ma, stddev_samp(active) AS sa FROM b GROUP BY entity)
    SELECT entity, n, round(cov / vm, 6) AS beta, round((mr - cov / vm * mm) * 252, 6) AS alpha, round(cov * cov / (va * vm), 6) AS r2, round(sa * sqrt(252), 6) AS tracking_error, round(ma * 252 / (sa * sqrt(252)), 6) AS information_ratio, round(mr * 252 / (cov / vm), 4) AS treynor FROM a""",
    _MKT,
)
def relative_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = m.relative_to(returns(spark, sf_dir), market(spark, sf_dir))
    return rounded(rounded(out.select("entity", "treynor"), 4).join(out.drop("treynor"), "entity"))


@query(
    """, b AS (SELECT * FROM returns JOIN market USING (date) WHERE ret IS NOT NULL AND market_ret IS NOT NULL)
    SELECT entity, date, round(CASE WHEN count(*) OVER w = 60 THEN covar_samp(ret, market_ret) OVER w / nullif(var_samp(market_ret) OVER w, 0) END, 5) AS beta FROM b WINDOW w AS (PARTITION BY entity ORDER BY date ROWS 59 PRECEDING)""",
    _MKT,
)
def rolling_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.rolling_beta(returns(spark, sf_dir), market(spark, sf_dir)), 5)


_EXC = ", k AS (SELECT * FROM returns WHERE ret IS NOT NULL), v AS (SELECT *, CASE WHEN count(ret) OVER w = 100 THEN -quantile_cont(ret, 0.05) OVER w END AS var FROM k WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)), x AS (SELECT entity, date, ret, var, (ret < -var)::INTEGER AS exception FROM v WHERE var IS NOT NULL)"


@query(f"{_EXC} SELECT entity, date, round(ret, 6) AS ret, round(var, 6) AS var, exception FROM x", _RET)
def var_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.var_exceptions(returns(spark, sf_dir)).select("entity", "date", "ret", "var", "exception"))


@query(
    f"""{_EXC}, y AS (SELECT *, lag(exception) OVER (PARTITION BY entity ORDER BY date) AS b FROM x), a AS (SELECT entity, count(*) AS n, sum(exception)::BIGINT AS x, count(*) FILTER (b = 0 AND exception = 0) AS a, count(*) FILTER (b = 0 AND exception = 1) AS c, count(*) FILTER (b = 1 AND exception = 0) AS d, count(*) FILTER (b = 1 AND exception = 1) AS e FROM y GROUP BY entity),
    r AS (SELECT *, x / n AS rate, coalesce(c / nullif(a + c, 0), 0) AS p01, coalesce(e / nullif(d + e, 0), 0) AS p11, coalesce((c + e) / nullif(a + c + d + e, 0), 0) AS p FROM a)
    SELECT entity, n, x, round(-2 * ((n - x) * ln(0.95) + x * ln(0.05) - CASE WHEN n = x THEN 0 ELSE (n - x) * ln(1 - rate) END - CASE WHEN x = 0 THEN 0 ELSE x * ln(rate) END), 5) AS lr_pof,
      round(-2 * (CASE WHEN a + d = 0 THEN 0 ELSE (a + d) * ln(1 - p) END + CASE WHEN c + e = 0 THEN 0 ELSE (c + e) * ln(p) END - CASE WHEN a = 0 THEN 0 ELSE a * ln(1 - p01) END - CASE WHEN c = 0 THEN 0 ELSE c * ln(p01) END - CASE WHEN d = 0 THEN 0 ELSE d * ln(1 - p11) END - CASE WHEN e = 0 THEN 0 ELSE e * ln(p11) END), 5) AS lr_independence FROM r""",
    _RET,
)
def var_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.kupiec(m.var_exceptions(returns(spark, sf_dir))), 5)

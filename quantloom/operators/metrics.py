"""Risk and return aggregates of return series ``entity, date, ret``.

All are ``groupBy`` aggregates with partial sums on the map side, except the
path-dependent ones, which are running windows.  Missing returns are left out.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions import blocks as bl
from quantloom.functions.frames import by, running

#: Bars in a year by interval.
PER_YEAR = {"1d": 252, "5d": 52, "1wk": 52, "1mo": 12, "3mo": 4}


def periods_per_year(interval: str) -> int:
    if interval not in PER_YEAR:
        raise ValueError(f"unknown interval {interval!r}; known: {sorted(PER_YEAR)}")
    return PER_YEAR[interval]


def dispersed(mean: Column, spread: Column) -> Column:
    """Whether a spread is more than rounding, relative to the mean."""
    return spread > 1e-12 * F.greatest(F.abs(mean), F.lit(1e-300))


def summary(returns: DataFrame, rf: float = 0.0, per_year: int = 252, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Count, compounded return, CAGR, volatility, Sharpe and Sortino ratios, historical VaR and CVaR at 95 %."""
    r = F.col("ret")
    excess = r - rf / per_year
    known = returns.where(r.isNotNull())
    base = known.groupBy(*keys).agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.avg(F.pow(F.least(excess, F.lit(0.0)), 2)).alias("down2"),
        F.min(r).alias("worst"), F.exp(F.sum(F.when(r > -1, F.log1p(r)))).alias("growth"), F.percentile(r, F.lit(0.05)).alias("q"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("excess_kurtosis"),
    )
    growth = F.when(F.col("worst") <= -1, 0.0).otherwise(F.col("growth"))
    gain = F.col("mean") - rf / per_year
    return base.select(
        *keys, "n", (growth - 1).alias("cumulative_return"), F.when(growth <= 0, -1.0).otherwise(F.pow(growth, per_year / F.col("n")) - 1).alias("cagr"), (F.col("std") * math.sqrt(per_year)).alias("volatility"),
        F.when(dispersed(F.col("mean"), F.col("std")), gain / F.col("std") * math.sqrt(per_year)).alias("sharpe"),
        F.when(F.col("down2") > 0, gain * per_year / (F.sqrt("down2") * math.sqrt(per_year))).when(gain > 0, float("inf")).alias("sortino"),
        (-F.col("q")).alias("var_95"), (-(F.col("mean") - 1.6448536269514722 * F.col("std"))).alias("var_parametric"), "skew", "excess_kurtosis",
    )


def tail_mean(returns: DataFrame, level: float = 0.95) -> DataFrame:
    """``entity, cvar``: mean loss at or beyond the historical VaR; one more pass, joined on the entity."""
    known = returns.where("ret is not null")
    q = known.groupBy("entity").agg(F.percentile("ret", F.lit(1 - level)).alias("q"))
    return known.join(q, "entity").groupBy("entity").agg((-F.avg(F.when(F.col("ret") <= F.col("q"), F.col("ret")))).alias("cvar"), F.count_if(F.col("ret") <= F.col("q")).alias("n_tail"))


def equity(returns: DataFrame, capital: float = 1.0) -> DataFrame:
    """``equity``: capital times the running product of 1 + return, not below 0; a missing return changes nothing."""
    r = F.greatest(1 + F.coalesce("ret", F.lit(0.0)), F.lit(0.0))
    return returns.withColumn("equity", capital * F.product(r).over(running()))


def drawdowns(curve: DataFrame) -> DataFrame:
    """``peak`` and ``drawdown`` of an equity curve."""
    return curve.withColumn("peak", F.max("equity").over(running())).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def drawdown_episodes(curve: DataFrame) -> DataFrame:
    """Episodes under water: start (last peak), trough, end (first recovery; null while open), depth, bars under water."""
    d = drawdowns(curve).withColumn("under", F.col("drawdown") < 0)
    # A new island begins at every bar at its peak; the bars under water after it are its episode.
    d = d.withColumn("island", F.sum(F.when(~F.col("under"), 1).otherwise(0)).over(running())).withColumn("next_peak", F.min(F.when(~F.col("under"), F.col("date"))).over(by().rowsBetween(0, W.unboundedFollowing)))
    out = d.groupBy("entity", "island").agg(
        F.min("date").alias("start"), F.min(F.when(F.col("under"), F.struct("drawdown", "date"))).alias("low"), F.max(F.when(F.col("under"), F.col("next_peak"))).alias("end"), F.count_if("under").alias("bars")
    )
    return out.where("bars > 0").select("entity", "start", F.col("low.date").alias("trough"), "end", F.col("low.drawdown").alias("depth"), "bars")


def max_drawdown(curve: DataFrame) -> DataFrame:
    return drawdowns(curve).groupBy("entity").agg(F.min("drawdown").alias("max_drawdown"))


def relative_to(returns: DataFrame, market: DataFrame, per_year: int = 252) -> DataFrame:
    """Beta, alpha, R², tracking error, information and Treynor ratio against ``date, market_ret``, on common dates."""
    both = returns.join(market, "date").where("ret is not null and market_ret is not null").withColumn("active", F.col("ret") - F.col("market_ret"))
    a = both.groupBy("entity").agg(
        F.count("*").alias("n"), F.covar_samp("ret", "market_ret").alias("cov"), F.var_samp("market_ret").alias("vm"), F.var_samp("ret").alias("va"), F.avg("ret").alias("mean"), F.avg("market_ret").alias("mean_market"), F.avg("active").alias("ma"), F.stddev_samp("active").alias("sa")
    )
    beta = F.when(F.col("vm") > 0, F.col("cov") / F.nullif("vm", F.lit(0.0)))
    return a.select(
        "entity", "n", beta.alias("beta"), ((F.col("mean") - beta * F.col("mean_market")) * per_year).alias("alpha"), F.when((F.col("va") > 0) & (F.col("vm") > 0), F.pow("cov", F.lit(2)) / F.nullif(F.col("va") * F.col("vm"), F.lit(0.0))).alias("r2"),
        (F.col("sa") * math.sqrt(per_year)).alias("tracking_error"), F.when(dispersed(F.col("ma"), F.col("sa")), F.col("ma") * per_year / (F.col("sa") * math.sqrt(per_year))).alias("information_ratio"), F.when(beta != 0, F.col("mean") * per_year / F.nullif(beta, F.lit(0.0))).alias("treynor"),
    )


def rolling_beta(returns: DataFrame, market: DataFrame, n: int = 60) -> DataFrame:
    """``beta`` of the last ``n`` common dates, by windowed covariance over variance."""
    # A row for each date, which does not grow with the names: the returns stay as they are dealt.
    both = returns.join(F.broadcast(market), "date").where("ret is not null and market_ret is not null")

    def run(block: bl.Block) -> bl.Block:
        x, y = block["ret"], block["market_ret"]
        cov, var = bl.window_moments(n, (x, y), (y, y))
        return {"beta": np.where(var > 0, cov / var, np.nan)}

    return bl.per_block(both, run, ["ret", "market_ret"], ["beta"])


def var_exceptions(returns: DataFrame, window: int = 100, level: float = 0.95) -> DataFrame:
    """Historical VaR of the ``window`` rows before each date, and whether the loss went beyond it."""
    out = var_forecast(returns, "historical", window, level)
    return out.withColumn("exception", (F.col("ret") < -F.col("var")).cast("int"))


def kupiec(exceptions: DataFrame, level: float = 0.95) -> DataFrame:
    """Proportion-of-failures likelihood ratio and Christoffersen's independence ratio of each entity."""
    p = 1 - level
    e = exceptions.withColumn("before", F.lag("exception").over(by()))
    a = e.groupBy("entity").agg(F.count("*").alias("n"), F.sum("exception").alias("x"), *(F.count_if((F.col("before") == i) & (F.col("exception") == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)))
    log = lambda k, q: F.when(k == 0, 0.0).otherwise(k * F.log(q))
    n, x = F.col("n"), F.col("x")
    rate = x / n
    pof = -2 * (log(n - x, F.lit(1 - p)) + log(x, F.lit(p)) - log(n - x, 1 - rate) - log(x, rate))
    n00, n01, n10, n11 = (F.col(f"n{i}{j}") for i in (0, 1) for j in (0, 1))
    ratio = lambda a, b: F.coalesce(a / F.nullif(a + b, F.lit(0)), F.lit(0.0))
    p01, p11, pi = ratio(n01, n00), ratio(n11, n10), ratio(n01 + n11, n00 + n10)
    ind = -2 * (log(n00 + n10, 1 - pi) + log(n01 + n11, pi) - log(n00, 1 - p01) - log(n01, p01) - log(n10, 1 - p11) - log(n11, p11))
    return a.select("entity", "n", "x", pof.alias("lr_pof"), ind.alias("lr_independence"))


def var_forecast(returns: DataFrame, method: str = "historical", window: int = 100, level: float = 0.95, decay: float = 0.94) -> DataFrame:
    """``var`` of each date from the ``window`` returns before it.

    ``historical`` quantile; ``normal``; ``cornish_fisher`` (the normal quantile
    moved by the window's skewness and excess kurtosis); ``ewma`` (zero mean,
    variances of all returns before, seeded with the first window's mean square).
    """
    if method not in ("historical", "normal", "cornish_fisher", "ewma"):
        raise ValueError(f"unknown method {method!r}")
    return var_forecasts(returns, [method], window, level, decay).withColumnRenamed(f"var_{method}", "var")


def var_forecasts(returns: DataFrame, methods: list[str], window: int = 100, level: float = 0.95, decay: float = 0.94) -> DataFrame:
    """``var_<method>`` of each of the methods of ``var_forecast``, from one pass over the series."""
    z = NormalDist().inv_cdf(1 - level)

    def run(block: bl.Block) -> bl.Block:
        x, out = block["ret"], {}
        if "historical" in methods:
            out["historical"] = -bl.window_quantile(x, window, 1 - level)
        if "normal" in methods or "cornish_fisher" in methods:
            mean, s2, s3, s4 = bl.window_powers(x, window)
            std = np.sqrt(s2 / (window - 1))
            s, k = np.sqrt(window) * s3 / s2**1.5, window * s4 / (s2 * s2) - 3
            moved = z + (z * z - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s * s / 36
            out |= {"normal": -(mean + z * std), "cornish_fisher": -(mean + std * moved)}
        if "ewma" in methods:
            out["ewma"] = -z * np.sqrt(_ewma(x * x, window, decay))
        return {f"var_{m}": bl.lagged(out[m]) for m in methods}

    names = [f"var_{m}" for m in methods]
    made = bl.per_block(returns.where("ret is not null"), run, ["ret"], names, keep=returns.columns)
    return made.where(F.coalesce(*names).isNotNull())


def _ewma(x: np.ndarray, n: int, decay: float) -> np.ndarray:
    """Mean of the first ``n`` values, then decayed; NaN before the ``n``-th."""
    out = np.full(x.shape, np.nan)
    if len(x) >= n:
        out[n - 1] = bl.window_sum(x[:n], n)[-1] / n
        for i in range(n, len(x)):
            out[i] = decay * out[i - 1] + (1 - decay) * x[i]
    return out


def material_drawdowns(curve: DataFrame, threshold: float = 0.05, top: int = 5) -> DataFrame:
    """The ``top`` deepest episodes of ``threshold`` or more of each entity, whether each is open, and the share of all bars under water."""
    d = drawdowns(curve).groupBy("entity").agg(F.avg((F.col("drawdown") < 0).cast("double")).alias("underwater"))
    deep = drawdown_episodes(curve).where(F.col("depth") <= -threshold)
    order = W.partitionBy("entity").orderBy("depth", "start")
    deep = deep.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).withColumn("open", F.col("end").isNull())
    return deep.join(d, "entity")

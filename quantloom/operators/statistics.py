"""Statistical analytics of series: spreads, persistence, dependence, resampling, overfitting.

What is a sum over rows is a grouped aggregate; what walks a series in order or
resamples it runs once for each entity on its Arrow group.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions import blocks as bl
from quantloom.functions import pairs as pr
from quantloom.functions.frames import by, full
from quantloom.functions.special import normal_cdf
from quantloom.operators.indicators import per_entity


def spread(a: DataFrame, b: DataFrame, hedge: float | None = None) -> DataFrame:
    """``date, spread, hedge``: log price of ``a`` less the hedge ratio times that of ``b``, on common dates; the ratio is the slope if none is given."""
    both = a.select("date", F.log("close").alias("x")).join(b.select("date", F.log("close").alias("y")), "date")
    ratio = both.agg(F.regr_slope("x", "y").alias("hedge")) if hedge is None else both.sparkSession.createDataFrame([(float(hedge),)], ["hedge"])
    return both.crossJoin(F.broadcast(ratio)).select("date", (F.col("x") - F.col("hedge") * F.col("y")).alias("spread"), "hedge")


def zscore(df: DataFrame, c: str, n: int | None = None) -> DataFrame:
    """Against the whole sample, or the last ``n`` rows; null on a flat window."""
    if n is None:
        w = W.partitionBy("entity")
        mean, std = F.avg(c).over(w), F.stddev_samp(c).over(w)
    else:
        mean, std = full(F.avg, c, n), full(F.stddev_samp, c, n)
    return df.withColumn("z", (F.col(c) - mean) / F.when(std > 1e-12 * F.abs(mean), std))


def half_life(df: DataFrame, c: str) -> DataFrame:
    """Half-life of mean reversion from the slope of changes on levels; infinite where there is none."""
    d = df.withColumn("__l", F.lag(c).over(by())).withColumn("__d", F.col(c) - F.col("__l")).where("__d is not null")
    a = d.groupBy("entity").agg(F.regr_slope("__d", "__l").alias("b"), F.count("*").alias("n"))
    phi = F.abs(1 + F.col("b"))
    return a.select("entity", "n", F.col("b").alias("slope"), F.when((F.col("b") >= 0) | (phi >= 1), float("inf")).when(phi == 0, 0.0).otherwise(math.log(0.5) / F.log(phi)).alias("half_life"))


def autocorrelation(df: DataFrame, c: str, lags: int) -> DataFrame:
    """Ljung-Box statistic of ``lags`` autocorrelations, from one pass over lagged products."""
    w = W.partitionBy("entity")
    x = df.where(F.col(c).isNotNull()).withColumn("__x", F.col(c) - F.avg(c).over(w))
    x = x.withColumns({f"__l{k}": F.lag("__x", k).over(by()) for k in range(1, lags + 1)})
    a = x.groupBy("entity").agg(F.count("*").alias("n"), F.sum(F.col("__x") * F.col("__x")).alias("s"), *(F.sum(F.col("__x") * F.col(f"__l{k}")).alias(f"c{k}") for k in range(1, lags + 1)))
    rho = [F.col(f"c{k}") / F.nullif("s", F.lit(0.0)) for k in range(1, lags + 1)]
    q = sum((r * r / (F.col("n") - k) for k, r in enumerate(rho, 1)), F.lit(0.0)) * F.col("n") * (F.col("n") + 2)
    return a.select("entity", "n", rho[0].alias("rho_1"), q.alias("ljung_box"))


def variance_ratio(df: DataFrame, c: str, k: int) -> DataFrame:
    """Variance of overlapping ``k``-step sums over ``k`` times that of steps, without drift correction of the sample."""
    x = df.where(F.col(c).isNotNull()).withColumn("__k", full(F.sum, c, k))
    a = x.groupBy("entity").agg(F.var_samp(c).alias("v"), F.var_samp("__k").alias("vk"))
    return a.select("entity", (F.col("vk") / F.nullif(k * F.col("v"), F.lit(0.0))).alias("variance_ratio"))


def seasonality(df: DataFrame, c: str, period: str = "month") -> DataFrame:
    """Count, mean, deviation and t statistic by month or weekday over all entities."""
    key = {"month": F.month("date"), "weekday": F.weekday("date")}[period]
    a = df.where(F.col(c).isNotNull()).groupBy(key.alias("period")).agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))
    return a.withColumn("t", F.col("mean") / F.nullif(F.col("std") / F.sqrt("n"), F.lit(0.0)))


def lead_lag(df: DataFrame, c: str, most: int) -> DataFrame:
    """``i, j, lag, n, corr``: correlation of ``i`` with ``j`` so many rows later, for all ordered pairs of names."""
    leads = df.where(F.col(c).isNotNull()).select("entity", "date", *(F.lead(c, k).over(by()).alias(f"x{k}") for k in range(most + 1)))
    kind = df.schema["entity"].dataType.simpleString()

    def run(first: dict, second: dict | None):
        dates = np.unique(np.concatenate([first["date"], (second or first)["date"]]))
        a = pr.Side(first, dates)
        b = pr.Side(second, dates) if second else a
        for left, right in ((a, b), (b, a)) if second else ((a, a),):
            x = left.matrix("x0")
            for lag in range(most + 1):
                y = right.matrix(f"x{lag}")
                for s in pr.slices(len(left.names), len(right.names)):
                    n, *rest = pr.moments((x[0][s], x[1][s]), y)
                    i, j = np.nonzero((n > 0) & (left.names[s, None] != right.names[None]))
                    yield {"i": left.names[s][i], "j": right.names[j], "lag": np.full(len(i), lag, np.int32), "n": n[i, j].astype(np.int64), "corr": np.where(n > 1, pr.correlation(*rest), np.nan)[i, j]}

    return pr.block_pairs(leads, [f"x{k}" for k in range(most + 1)], run, f"i {kind}, j {kind}, lag int, n long, corr double")


def entropy(df: DataFrame, c: str, bins: int = 10) -> DataFrame:
    """Shannon entropy of equal-width bins over each entity's range, and its share of the highest."""
    w = W.partitionBy("entity")
    x = df.where(F.col(c).isNotNull()).withColumn("lo", F.min(c).over(w)).withColumn("hi", F.max(c).over(w))
    x = x.withColumn("bin", F.least(F.floor((F.col(c) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1)))
    k = x.where("bin is not null").groupBy("entity", "bin").agg(F.count("*").alias("k")).withColumn("p", F.col("k") / F.sum("k").over(w))
    return k.groupBy("entity").agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy")).withColumn("normalized", F.col("entropy") / math.log(bins))


def hurst_values(x: np.ndarray, method: str = "dfa") -> float:
    """Hurst exponent by detrended fluctuation or rescaled range, limited to [0, 1.5]; NaN for under 32 values."""
    n = len(x)
    if n < 32:
        return math.nan
    top = n // 4 if method == "dfa" else n // 2
    sizes = np.unique(np.geomspace(8, top, 12).astype(int))
    path = np.cumsum(x - x.mean())
    out = []
    for s in sizes:
        m = n // s
        if method == "dfa":
            parts = path[: m * s].reshape(m, s)
            t = np.arange(s) - (s - 1) / 2
            slope = parts @ t / (t @ t)
            rest = parts - parts.mean(axis=1, keepdims=True) - slope[:, None] * t
            out.append(np.sqrt((rest**2).mean()))
        else:
            parts = x[: m * s].reshape(m, s)
            z = np.cumsum(parts - parts.mean(axis=1, keepdims=True), axis=1)
            std = parts.std(axis=1, ddof=1)
            ok = std > 0
            out.append(((z.max(axis=1) - z.min(axis=1))[ok] / std[ok]).mean() if ok.any() else np.nan)
    out = np.array(out)
    good = out > 0
    return float(np.clip(np.polyfit(np.log(sizes[good]), np.log(out[good]), 1)[0], 0, 1.5)) if good.sum() > 1 else math.nan


def hurst(df: DataFrame, c: str, method: str = "dfa") -> DataFrame:
    if method not in ("dfa", "rs"):
        raise ValueError(f"unknown method {method!r}")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x = p.sort_values("date")[c].dropna().to_numpy(float)
        return pd.DataFrame({"entity": [p["entity"].iloc[0]], "hurst": [hurst_values(x, method)]})

    return df.select("entity", "date", c).groupBy("entity").applyInPandas(run, f"entity {df.schema['entity'].dataType.simpleString()}, hurst double")


def adf(x: np.ndarray, lags: int = 1) -> float:
    """t statistic of the level in a regression of changes on level, constant and lagged changes."""
    d = np.diff(x)
    rows = np.column_stack([x[lags:-1], np.ones(len(d) - lags), *(d[lags - k : len(d) - k] for k in range(1, lags + 1))])
    y = d[lags:]
    beta, *_ = np.linalg.lstsq(rows, y, rcond=None)
    rest = y - rows @ beta
    var = rest @ rest / (len(y) - rows.shape[1]) * np.linalg.inv(rows.T @ rows)[0, 0]
    return float(beta[0] / math.sqrt(var))


def kalman_hedge(df: DataFrame, y: str, x: str, delta: float = 1e-4, noise: float = 1e-3) -> DataFrame:
    """Hedge ratio and intercept that follow a random walk."""

    def run(block: bl.Block) -> bl.Block:
        u, v = block["y"], block["x"]
        hedge, intercept, error = (np.full(u.shape, np.nan) for _ in range(3))
        b0, b1 = np.zeros(u.shape[1]), np.zeros(u.shape[1])
        # The symmetric covariance of the two states.
        p00, p01, p11 = np.ones(u.shape[1]), np.zeros(u.shape[1]), np.ones(u.shape[1])
        q = delta / (1 - delta)
        for i in range(len(u)):
            known = ~(np.isnan(u[i]) | np.isnan(v[i]))
            a, h = p00 + q, v[i]
            d = p11 + q
            g0, g1 = a * h + p01, p01 * h + d
            s = h * g0 + g1 + noise
            e = u[i] - h * b0 - b1
            b0, b1 = np.where(known, b0 + g0 / s * e, b0), np.where(known, b1 + g1 / s * e, b1)
            p00, p01, p11 = np.where(known, a - g0 / s * g0, p00), np.where(known, p01 - g0 / s * g1, p01), np.where(known, d - g1 / s * g1, p11)
            hedge[i], intercept[i], error[i] = (np.where(known, z, np.nan) for z in (b0, b1, e))
        return {"hedge": hedge, "intercept": intercept, "error": error}

    return bl.per_block(df.select("entity", "date", F.col(y).alias("y"), F.col(x).alias("x")), run, ["y", "x"], ["hedge", "intercept", "error"])


def garch(df: DataFrame, c: str, alpha: float = 0.05, beta: float = 0.9) -> DataFrame:
    """Conditional volatility of GARCH(1,1) with variance targeting."""

    def run(p: pd.DataFrame) -> dict[str, np.ndarray]:
        x = p[c].to_numpy(float)
        long_ = np.nanvar(x) if np.isfinite(x).any() else np.nan
        state, out = long_, np.full(len(x), np.nan)
        for i, v in enumerate(x):
            out[i] = math.sqrt(state) if state >= 0 else np.nan
            if not np.isnan(v):
                state = long_ * (1 - alpha - beta) + alpha * v * v + beta * state
        return {"garch_vol": out}

    return per_entity(df.select("entity", "date", c), run, ["garch_vol"])


def regimes(df: DataFrame, c: str, n: int = 60) -> DataFrame:
    """``low``, ``normal`` or ``high`` by the trailing deviation against its own quartiles over each entity."""

    def run(block: bl.Block) -> bl.Block:
        vol = np.sqrt(bl.window_moments(n, (block[c], block[c]))[0] / (n - 1))
        some = ~np.isnan(vol).all(axis=0)
        q = np.full((2, vol.shape[1]), np.nan)
        q[:, some] = np.nanquantile(vol[:, some], [0.25, 0.75], axis=0)
        return {"vol": vol, "side": np.where(np.isnan(vol), np.nan, np.where(vol < q[0], -1.0, np.where(vol > q[1], 1.0, 0.0)))}

    v = bl.per_block(df, run, [c], ["vol", "side"]).where("vol is not null")
    return v.select("entity", "date", "vol", F.when(F.col("side") < 0, "low").when(F.col("side") > 0, "high").otherwise("normal").alias("regime"))


def block_bootstrap(df: DataFrame, c: str, draws: int = 200, block: int = 10, seed: int = 0) -> DataFrame:
    """5, 50 and 95 % points of the mean under a moving-block bootstrap of each entity's rows."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x = p.sort_values("date")[c].dropna().to_numpy(float)
        key = p["entity"].iloc[0]
        if len(x) < block:
            return pd.DataFrame({"entity": [key], "lo": [np.nan], "mid": [np.nan], "hi": [np.nan]})
        rng = np.random.default_rng([seed, abs(hash(str(key))) % 2**32 if not isinstance(key, (int, np.integer)) else int(key)])
        starts = rng.integers(0, len(x) - block + 1, (draws, -(-len(x) // block)))
        paths = x[(starts[:, :, None] + np.arange(block)).reshape(draws, -1)[:, : len(x)]]
        lo, mid, hi = np.percentile(paths.mean(axis=1), [5, 50, 95])
        return pd.DataFrame({"entity": [key], "lo": [lo], "mid": [mid], "hi": [hi]})

    return df.select("entity", "date", c).groupBy("entity").applyInPandas(run, f"entity {df.schema['entity'].dataType.simpleString()}, lo double, mid double, hi double")


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def expected_max_sharpe(std: float, trials: int) -> float:
    """Expected highest Sharpe ratio of ``trials`` without skill."""
    if trials <= 1:
        return 0.0
    g = 0.5772156649015329
    return std * ((1 - g) * normal_quantile(1 - 1 / trials) + g * normal_quantile(1 - 1 / (trials * math.e)))


def deflated_sharpe(returns: DataFrame, trials: int) -> DataFrame:
    """Probability that each entity's Sharpe ratio beats the best of ``trials`` chance ones."""
    a = returns.where("ret is not null").groupBy("entity").agg(F.count("ret").alias("n"), (F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0))).alias("sr"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"))
    spread_ = a.agg(F.coalesce(F.stddev_samp("sr"), F.lit(0.0)).alias("s"))
    sr0 = expected_max_sharpe(1.0, trials)
    out = a.crossJoin(F.broadcast(spread_))
    z = (F.col("sr") - sr0 * F.col("s")) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr"))
    return out.select("entity", "n", "sr", normal_cdf(z).alias("deflated_sharpe"))


def overfitting_probability(grid: DataFrame, chunks: int = 8) -> DataFrame:
    """PBO of ``config, date, ret``: ranks out of sample of the in-sample winner over all halves of contiguous chunks.

    Sums of each configuration and chunk are made in Spark; the halves are
    counted on that small table of configurations times chunks.
    """
    dates = grid.select("date").distinct().withColumn("chunk", F.ntile(chunks).over(W.orderBy("date")) - 1)
    sums = grid.join(F.broadcast(dates), "date").groupBy("config", "chunk").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    halves = grid.sparkSession.createDataFrame([(h, c, c in half) for h, half in enumerate(itertools.combinations(range(chunks), chunks // 2)) for c in range(chunks)], "half int, chunk int, inside boolean")
    a = sums.join(F.broadcast(halves), "chunk").groupBy("half", "config", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    a = a.withColumn("sharpe", mean / F.nullif(F.sqrt((F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1)), F.lit(0.0)))
    best = a.where("inside").groupBy("half").agg(F.max_by("config", F.struct("sharpe", "config")).alias("config"))
    outside = a.where("not inside")
    won = outside.join(best, ["half", "config"]).select("half", F.col("sharpe").alias("own"), F.col("config").alias("winner"))
    ranks = outside.join(won, "half").where("config <> winner").groupBy("half").agg(F.avg(F.when(F.col("sharpe") < F.col("own"), 1.0).when(F.col("sharpe") == F.col("own"), 0.5).otherwise(0.0)).alias("rank"))
    logit = F.log(F.greatest(F.least("rank", F.lit(1 - 1e-6)), F.lit(1e-6)) / (1 - F.greatest(F.least("rank", F.lit(1 - 1e-6)), F.lit(1e-6))))
    return ranks.agg(F.count("*").alias("halves"), F.avg(F.when(F.col("rank") < 0.5, 1.0).when(F.col("rank") == 0.5, 0.5).otherwise(0.0)).alias("pbo"), F.avg(logit).alias("mean_logit"))


def forward_paths(returns: DataFrame, horizon: int, draws: int = 200, block: int = 10, capital: float = 1.0, seed: int = 0) -> DataFrame:
    """5, 50 and 95 % of simulated equity at each step: draws are dealt to tasks, each a moving-block path of the pooled series."""
    x = np.array([r.ret for r in returns.where("ret is not null").orderBy("date").select("ret").toLocalIterator()])
    shared = returns.sparkSession.sparkContext.broadcast(x)

    def run(parts):
        for p in parts:
            rows = []
            for draw in p["id"]:
                rng = np.random.default_rng([seed, int(draw)])
                s = rng.integers(0, len(shared.value) - block + 1, -(-horizon // block))
                path = shared.value[(s[:, None] + np.arange(block)).reshape(-1)[:horizon]]
                rows.append(pd.DataFrame({"step": np.arange(1, horizon + 1), "equity": capital * np.cumprod(np.maximum(1 + path, 0))}))
            yield pd.concat(rows)

    paths = returns.sparkSession.range(draws).mapInPandas(run, "step int, equity double")
    return paths.groupBy("step").agg(*(F.percentile("equity", F.lit(q)).alias(n) for q, n in ((0.05, "p5"), (0.5, "p50"), (0.95, "p95"))))


def factor_regression(panel: DataFrame, y: str, factors: list[str], by: str = "entity") -> DataFrame:
    """Least squares of ``y`` on a constant and ``factors``: ``n, r2, alpha, beta_<factor>`` and ``t_`` of each.

    Only moment sums are shuffled, a row for each entity; the normal equations
    are solved from them.  Rows with a missing value are left out; an entity
    with too few rows or dependent factors gets null coefficients.
    """
    names = ["alpha", *(f"beta_{f}" for f in factors)]
    known = panel.select(by, *(F.col(c).cast("double") for c in (y, *factors))).dropna()
    # Values less their entity's first make the sums well conditioned.
    xs = [F.lit(1.0), *(F.col(f) for f in factors)]
    sums = [F.sum(a * b).alias(f"x{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if i <= j]
    sums += [F.sum(a * F.col(y)).alias(f"y{i}") for i, a in enumerate(xs)] + [F.sum(F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n")]
    k = len(xs)
    schema = f"{by} {panel.schema[by].dataType.simpleString()}, n long, r2 double, " + ", ".join(f"{c} double" for c in [*names, *(f"t_{c}" for c in names)])

    def solve(batches):
        for p in batches:
            rows = []
            for r in p.to_dict("records"):
                x = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                v, n = np.array([r[f"y{i}"] for i in range(k)]), r["n"]
                out = [np.nan] * (2 * k + 1)
                if n > k and np.linalg.matrix_rank(x / np.sqrt(np.outer(np.diag(x), np.diag(x)).clip(1e-300)), tol=1e-10) == k:
                    inverse = np.linalg.inv(x)
                    b = inverse @ v
                    residual, total = max(r["yy"] - b @ v, 0.0), r["yy"] - v[0] ** 2 / n
                    error = np.sqrt(residual / (n - k) * np.diag(inverse))
                    out = [1 - residual / total if total > 0 else np.nan, *b, *(b / error if residual > 1e-12 * r["yy"] else [np.nan] * k)]
                rows.append((r[by], n, *out))
            yield pd.DataFrame(rows, columns=[by, "n", "r2", *names, *(f"t_{c}" for c in names)])

    return known.groupBy(by).agg(*sums).mapInPandas(solve, schema)


def cointegration_scan(bars: DataFrame, c: str = "close", least: int = 30) -> DataFrame:
    """Engle-Granger of each pair i < j on common dates: ``n, hedge, alpha, adf, half_life``, residuals of log ``c``.

    ``adf``: t-statistic of the residual's change on its level before, with a
    constant.  A name meets a block of names at once, on the dates it has.
    """
    kind = bars.schema["entity"].dataType.simpleString()

    def run(first: dict, second: dict | None):
        dates = np.unique(np.concatenate([first["date"], (second or first)["date"]]))
        names, others = first["names"], (second or first)["names"]
        y = np.full((len(others), len(dates)), np.nan)
        other = second or first
        y[other["row"], np.searchsorted(dates, other["date"])] = other["x"]
        order = np.lexsort((first["date"], first["row"]))
        bounds = np.searchsorted(first["row"][order], np.arange(len(names) + 1))
        held: list[tuple] = []
        size = 0
        for i, name in enumerate(names):
            mine = order[bounds[i] : bounds[i + 1]]
            made = _engle_granger(first["x"][mine], y[i + 1 if second is None else 0 :, np.searchsorted(dates, first["date"][mine])], least)
            j = made[0] + (i + 1 if second is None else 0)
            held.append((np.full(len(j), name, names.dtype), others[j], *made[1:]))
            size += len(j)
            if size >= pr.BATCH or i == len(names) - 1:
                yield dict(zip(("i", "j", "n", "hedge", "alpha", "adf", "half_life"), map(np.concatenate, zip(*held, strict=True)), strict=True))
                held, size = [], 0

    x = bars.where(F.col(c) > 0).select("entity", "date", F.log(c).alias("x"))
    return pr.block_pairs(x, ["x"], run, f"i {kind}, j {kind}, n long, hedge double, alpha double, adf double, half_life double")


def _engle_granger(a: np.ndarray, others: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """``j, n, hedge, alpha, adf, half_life`` of ``a`` against each row of ``others`` (NaN: no common date) with ``least`` dates or more."""
    known = ~np.isnan(others)
    j = np.flatnonzero(known.sum(axis=1) >= max(least, 1))
    row, place = np.nonzero(known[j])
    sums = lambda v, r=row: np.bincount(r, v, minlength=len(j))
    n = np.bincount(row, minlength=len(j))
    u, v = a[place], others[j][row, place]
    with np.errstate(all="ignore"):
        mu, mv = sums(u) / n, sums(v) / n
        du, dv = u - mu[row], v - mv[row]
        sxx = sums(dv * dv)
        hedge = np.where(sxx > 0, sums(du * dv) / sxx, np.nan)
        alpha = mu - hedge * mv
        e = u - alpha[row] - hedge[row] * v
        same = row[1:] == row[:-1]
        level, change, r = e[:-1][same], np.diff(e)[same], row[1:][same]
        m = np.bincount(r, minlength=len(j))
        dl, dd = level - (sums(level, r) / m)[r], change - (sums(change, r) / m)[r]
        ll, dd2 = sums(dl * dl, r), sums(dd * dd, r)
        rho = np.where(ll > 0, sums(dl * dd, r) / ll, np.nan)
        error = np.sqrt((dd2 - rho * rho * ll) / (m - 2) / ll)
        adf = np.where(error != 0, rho / error, np.nan)
        half = np.where((rho < 0) & (rho > -1), math.log(0.5) / np.log1p(rho), np.nan)
    keep = ~np.isnan(hedge) & (m > 0)
    return tuple(z[keep] for z in (j, n.astype(np.int64), hedge, alpha, adf, half))


def fold_average(folds: DataFrame, metric: str, weight: str, by: list[str]) -> DataFrame:
    """``mean, weighted, worst, folds`` of a metric over folds, weighted by their rows; folds without the metric count in neither."""
    known = folds.where(F.col(metric).isNotNull())
    return known.groupBy(*by).agg(F.avg(metric).alias("mean"), (F.sum(F.col(metric) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))).alias("weighted"), F.min(metric).alias("worst"), F.count("*").alias("folds"))


def partial_correlation(panel: DataFrame, a: str, b: str, given: str, by: str = "entity") -> DataFrame:
    """``n, corr, partial``: correlation of ``a`` and ``b``, and with ``given`` held fixed."""
    known = panel.select(by, a, b, given).dropna()
    r = lambda x, y: F.covar_samp(x, y) / F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0))
    s = known.groupBy(by).agg(F.count("*").alias("n"), r(a, b).alias("corr"), r(a, given).alias("u"), r(b, given).alias("v"))
    return s.select(by, "n", "corr", ((F.col("corr") - F.col("u") * F.col("v")) / F.nullif(F.sqrt((1 - F.col("u") * F.col("u")) * (1 - F.col("v") * F.col("v"))), F.lit(0.0))).alias("partial"))

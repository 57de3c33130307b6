"""Options, carry, futures and hedges, row by row or by group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import special as sp
from quantloom.functions.frames import rows


def price_options(chain: DataFrame) -> DataFrame:
    """Black-Scholes price and Greeks of ``spot, strike, years, rate, vol, is_call``."""
    c = F.col
    return chain.withColumns(sp.black_scholes(c("spot"), c("strike"), c("years"), c("rate"), c("vol"), c("is_call")))


def scenario_grid(chain: DataFrame, spots: list[float], vols: list[float]) -> DataFrame:
    """The chain under every pair of spot and volatility shocks, priced; the grid is as long as its arguments."""
    shocked = chain.withColumn("spot_shock", F.explode(F.array(*map(F.lit, spots)))).withColumn("vol_shock", F.explode(F.array(*map(F.lit, vols))))
    return price_options(shocked.withColumn("spot", F.col("spot") * (1 + F.col("spot_shock"))).withColumn("vol", F.greatest(F.col("vol") + F.col("vol_shock"), F.lit(1e-6))))


def _cdf(x: np.ndarray) -> np.ndarray:
    return np.fromiter((0.5 * math.erfc(-v / math.sqrt(2)) for v in x), float, len(x))


def implied_volatility(chain: DataFrame, price: str = "price") -> DataFrame:
    """``implied_vol`` by bisection on whole batches; null where the price is outside its bounds."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            s, k, t, r, y = (p[c].to_numpy(float) for c in ("spot", "strike", "years", "rate", price))
            sign = np.where(p["is_call"], 1.0, -1.0)
            lo, hi = np.full(len(p), 1e-6), np.full(len(p), 5.0)

            def value(v: np.ndarray) -> np.ndarray:
                root = v * np.sqrt(t)
                d1 = (np.log(s / k) + (r + v * v / 2) * t) / root
                return sign * (s * _cdf(sign * d1) - k * np.exp(-r * t) * _cdf(sign * (d1 - root)))

            good = (value(lo) <= y + 1e-12) & (value(hi) >= y)
            for _ in range(60):
                mid = (lo + hi) / 2
                low = value(mid) < y
                lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
            yield p.assign(implied_vol=np.where(good, (lo + hi) / 2, np.nan))

    return chain.mapInPandas(solve, _with(chain, "implied_vol"))


def _with(df: DataFrame, name: str) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in [*df.dtypes, (name, "double")])


def binomial_price(spot: float, strike: float, years: float, rate: float, vol: float, call: bool, steps: int = 200, american: bool = False) -> float:
    """Cox-Ross-Rubinstein tree for one option."""
    dt = years / steps
    up = math.exp(vol * math.sqrt(dt))
    p = (math.exp(rate * dt) - 1 / up) / (up - 1 / up)
    disc = math.exp(-rate * dt)
    s = spot * up ** np.arange(steps, -steps - 1, -2.0)
    v = np.maximum((s - strike) if call else (strike - s), 0)
    for n in range(steps - 1, -1, -1):
        v = disc * (p * v[:-1] + (1 - p) * v[1:])
        if american:
            s = spot * up ** np.arange(n, -n - 1, -2.0)
            v = np.maximum(v, (s - strike) if call else (strike - s))
    return float(v[0])


def put_call_parity(pairs: DataFrame) -> DataFrame:
    """Gap of ``call_price - put_price`` to parity and the forward that it implies."""
    disc = F.exp(-F.col("rate") * F.col("years"))
    return pairs.withColumn("gap", F.col("call_price") - F.col("put_price") - (F.col("spot") - F.col("strike") * disc)).withColumn("implied_forward", F.col("strike") + (F.col("call_price") - F.col("put_price")) / disc)


def aggregate_book(book: DataFrame) -> DataFrame:
    """Greeks of positions, by underlying and in total."""
    priced = price_options(book)
    return priced.rollup("underlying").agg(*(F.sum(F.col("quantity") * F.col(g)).alias(g) for g in ("price", "delta", "gamma", "vega", "theta", "rho")))


def forward_basis(df: DataFrame, convention: str = "ACT/365F") -> DataFrame:
    """Fair forward, basis and annualised basis of ``spot, future, rate, yield, date, expiry``."""
    years = sp.day_count(F.col("date"), F.col("expiry"), convention)
    fair = F.col("spot") * F.exp((F.col("rate") - F.col("yield")) * years)
    return df.withColumns({"years": years, "fair": fair, "basis": F.col("future") - F.col("spot"), "mispricing_bps": (F.col("future") / fair - 1) * 1e4, "implied_carry": F.log(F.col("future") / F.col("spot")) / F.nullif(years, F.lit(0.0))})


def hedge_ratio(returns: DataFrame, market: DataFrame) -> DataFrame:
    """Minimum-variance futures hedge: ratio, correlation and variance removed."""
    both = returns.join(market, "date").where("ret is not null and market_ret is not null")
    a = both.groupBy("entity").agg(F.covar_samp("ret", "market_ret").alias("c"), F.var_samp("market_ret").alias("v"), F.var_samp("ret").alias("u"))
    ratio = F.col("c") / F.nullif("v", F.lit(0.0))
    return a.select("entity", ratio.alias("hedge_ratio"), (F.col("c") * F.col("c") / F.nullif(F.col("u") * F.col("v"), F.lit(0.0))).alias("effectiveness"))


def volatility_cone(returns: DataFrame, windows: list[int], per_year: int = 252) -> DataFrame:
    """Quartiles of realised volatility over each window length."""
    out = None
    for n in windows:
        v = returns.where("ret is not null").select("entity", F.when(F.count("ret").over(rows(n)) == n, F.stddev_samp("ret").over(rows(n)) * math.sqrt(per_year)).alias("v"))
        q = v.where("v is not null").groupBy("entity").agg(F.percentile("v", F.lit(0.25)).alias("q25"), F.percentile("v", F.lit(0.5)).alias("q50"), F.percentile("v", F.lit(0.75)).alias("q75")).withColumn("window", F.lit(n))
        out = q if out is None else out.unionByName(q)
    return out


def continuous_future(contracts: DataFrame) -> DataFrame:
    """Front contracts of ``root, expiry, date, close`` joined back to front, ratio-adjusted at each roll."""
    from pyspark.sql import Window as W

    front = contracts.where("date <= expiry").withColumn("__n", F.row_number().over(W.partitionBy("root", "date").orderBy("expiry"))).where("__n = 1").drop("__n")
    w = W.partitionBy("root").orderBy("date")
    rolled = front.withColumn("__next", F.lead("expiry").over(w))
    old = contracts.select("root", F.col("expiry").alias("__next"), "date", F.col("close").alias("__new"))
    factor = F.when(F.col("__next") != F.col("expiry"), F.col("__new") / F.col("close")).otherwise(1.0)
    out = rolled.join(old, ["root", "__next", "date"], "left").withColumn("__f", F.coalesce(factor, F.lit(1.0)))
    back = W.partitionBy("root").orderBy(F.desc("date")).rowsBetween(W.unboundedPreceding, 0)
    return out.withColumn("adjusted", F.col("close") * F.product("__f").over(back)).select("root", "date", "expiry", "close", "adjusted")

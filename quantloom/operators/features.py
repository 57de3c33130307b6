"""Feature catalogue: window, cross-sectional and derived features of a panel, with a registry."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.frames import across, average_rank, by, full
from quantloom.functions.quantiles import exact_quantiles, stored


@dataclass(frozen=True)
class Feature:
    """``build(bars, **params)`` returns ``entity, date`` and the feature's column."""

    name: str
    scope: str  # ENTITY, UNIVERSE or POINT_IN_TIME
    build: Callable[..., DataFrame]
    lookback: int


_registry: dict[str, Feature] = {}


def register_feature(feature: Feature) -> Feature:
    if feature.scope not in ("ENTITY", "UNIVERSE", "POINT_IN_TIME"):
        raise ValueError(f"unknown scope {feature.scope!r}")
    if feature.name in _registry:
        raise ValueError(f"feature {feature.name!r} exists")
    _registry[feature.name] = feature
    return feature


def get_feature(name: str) -> Feature:
    if name not in _registry:
        raise ValueError(f"unknown feature {name!r}; known: {sorted(_registry)}")
    return _registry[name]


def list_features() -> list[str]:
    return sorted(_registry)


def window_features(bars: DataFrame, n: int = 20, lookback: int = 10, per_year: int = 252, also: tuple[Column, ...] = ()) -> DataFrame:
    """Momentum, breakout, realised measures, drawdown, illiquidity and volume surprise, and ``also``, in one window pass."""
    r = F.col("close") / F.lag("close").over(by()) - 1
    out = bars.withColumn("r", r)
    out = out.withColumns({"neg": F.when(F.col("r") < 0, F.col("r") * F.col("r")).when(F.col("r").isNotNull(), 0.0), "bp": F.abs("r") * F.abs(F.lag("r").over(by())), "ill": F.abs("r") / F.nullif(F.col("close") * F.col("volume"), F.lit(0.0))})
    prior = full(F.max, "high", n, by().rowsBetween(-n, -1))
    return out.select(
        "entity", "date",
        (F.col("close") / F.lag("close", lookback).over(by()) - 1).alias("momentum"),
        F.when(prior.isNotNull(), (F.col("close") > prior).cast("int")).alias("new_high"),
        F.sqrt(full(F.avg, "neg", n) * per_year).alias("semivolatility"),
        F.sqrt(math.pi / 2 * full(F.avg, "bp", n) * per_year).alias("bipower"),
        (F.col("close") / full(F.max, "close", n) - 1).alias("rolling_drawdown"),
        (1e6 * full(F.avg, "ill", n)).alias("amihud"),
        (F.col("volume") / full(F.avg, "volume", n) - 1).alias("volume_surprise"),
        *also,
    )


for _name, _column, _n in (("market.momentum", "momentum", 11), ("market.new_high_breakout", "new_high", 21), ("risk.realized_semivariance", "semivolatility", 21), ("risk.bipower_variation", "bipower", 22), ("risk.rolling_drawdown", "rolling_drawdown", 20), ("volume.amihud_illiquidity", "amihud", 21), ("volume.volume_surprise", "volume_surprise", 20)):
    register_feature(Feature(_name, "ENTITY", lambda bars, c=_column, **p: window_features(bars, **p).select("entity", "date", c), _n))


def standardize_by_date(df: DataFrame, c: str, name: str | None = None) -> DataFrame:
    """Z-score of each date's entities; null where they have no dispersion."""
    w = across()
    spread = F.stddev_samp(c).over(w)
    return df.withColumn(name or f"{c}_z", F.when(spread > 1e-12 * F.greatest(F.max(F.abs(c)).over(w), F.lit(1e-300)), (F.col(c) - F.avg(c).over(w)) / F.nullif(spread, F.lit(0.0))))


def rank_by_date(df: DataFrame, c: str, name: str | None = None) -> DataFrame:
    """Average rank scaled to [-0.5, 0.5] within each date; a single name is null."""
    out = average_rank(df, c, ["date"], "__rank").withColumn("__n", F.count(c).over(across()))
    return out.withColumn(name or f"{c}_rank", F.when(F.col("__n") > 1, (F.col("__rank") - 1) / F.nullif(F.col("__n") - 1, F.lit(0)) - 0.5)).drop("__rank", "__n")


def group_demean(df: DataFrame, c: str, group: str, name: str | None = None) -> DataFrame:
    """Value less the mean of its group on its date."""
    from pyspark.sql import Window as W

    return df.withColumn(name or f"{c}_neutral", F.col(c) - F.avg(c).over(W.partitionBy("date", group)))


def winsorize(df: DataFrame, c: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values limited to the exact quantiles of the whole column."""
    df = stored(df)
    lo, hi = exact_quantiles(df, {c: [low, high]})[c]
    return df.withColumn(c, F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))))


def derived(df: DataFrame, name: str, kind: str, a: str, b: str) -> DataFrame:
    """``ratio``, ``difference``, ``product`` or ``sum`` of two columns; what is not finite is null."""
    x, y = F.col(a), F.col(b)
    kinds: dict[str, Column] = {"ratio": x / F.nullif(y, F.lit(0.0)), "difference": x - y, "product": x * y, "sum": x + y}
    if kind not in kinds:
        raise ValueError(f"unknown derived feature {kind!r}")
    value = kinds[kind]
    return df.withColumn(name, F.when(F.abs(value) < float("inf"), value))


def lags(df: DataFrame, c: str, steps: list[int]) -> DataFrame:
    """Columns ``<c>__lag<k>``."""
    if any(k < 1 for k in steps) or len(set(steps)) != len(steps):
        raise ValueError("lags are distinct positive numbers")
    return df.withColumns({f"{c}__lag{k}": F.lag(c, k).over(by()) for k in steps})


def forward_fill(df: DataFrame, c: str, most: int) -> DataFrame:
    """Missing values filled with the last known one, at most ``most`` rows old."""
    return df.withColumn(c, F.last(c, ignorenulls=True).over(by().rowsBetween(-most, 0)))

"""Capital allocation across return streams and its capacity."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import blocks as bl
from quantloom.functions.frames import across, by, running


def ewma_volatility(returns: DataFrame, half_life: float, most: int = 500, per_year: int = 252) -> DataFrame:
    """Exponentially weighted volatility over the last ``most`` rows, known before each date."""
    decay = 0.5 ** (1 / half_life)

    def run(block: bl.Block) -> bl.Block:
        x = block["ret"] ** 2
        out, total, weight = np.full(x.shape, np.nan), np.zeros(x.shape[1]), 0.0
        for i in range(1, len(x)):
            total, weight = total * decay + x[i - 1], weight * decay + 1
            if i > most:  # the row that leaves has decayed this far
                total, weight = np.maximum(total - decay**most * x[i - 1 - most], 0.0), weight - decay**most
            out[i] = np.sqrt(total / weight * per_year)
        return {"vol": out}

    return bl.per_block(returns.where("ret is not null"), run, ["ret"], ["vol"], keep=returns.columns)


def inverse_volatility(returns: DataFrame, half_life: float = 20.0, cap: float = 1.0) -> DataFrame:
    """``weight`` of each date in proportion to one over the volatility known before it, at most ``cap``."""
    v = ewma_volatility(returns, half_life)
    raw = F.when(F.col("vol") > 0, 1 / F.col("vol"))
    out = v.withColumn("__r", raw)
    return out.withColumn("weight", F.least(F.coalesce(F.col("__r") / F.sum("__r").over(across()), F.lit(0.0)), F.lit(cap))).drop("__r")


def volatility_target(returns: DataFrame, target: float, half_life: float = 20.0, most: float = 3.0) -> DataFrame:
    """``scale``: target over the volatility known before each date, at most ``most``."""
    v = ewma_volatility(returns, half_life)
    return v.withColumn("scale", F.when(F.col("vol") > 0, F.least(target / F.col("vol"), F.lit(most))).otherwise(0.0)).withColumn("overlay_ret", F.col("scale") * F.col("ret"))


def combine(streams: DataFrame, weights: DataFrame) -> DataFrame:
    """``date, ret`` of streams at the weights of each date."""
    return streams.join(weights.select("entity", "date", "weight"), ["entity", "date"]).groupBy("date").agg(F.sum(F.col("ret") * F.col("weight")).alias("ret"), F.sum(F.abs("weight")).alias("gross"))


def shrunk_sharpe(returns: DataFrame, strength: float = 0.5, per_year: int = 252) -> DataFrame:
    """Sharpe ratios drawn ``strength`` of the way to their mean."""
    a = returns.where("ret is not null").groupBy("entity").agg((F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * math.sqrt(per_year)).alias("sharpe"))
    mean = a.agg(F.avg("sharpe").alias("__m"))
    return a.crossJoin(F.broadcast(mean)).select("entity", "sharpe", ((1 - strength) * F.col("sharpe") + strength * F.col("__m")).alias("shrunk"))


def kelly(returns: DataFrame) -> DataFrame:
    """Growth-optimal fraction by mean over variance, and the log growth at it."""
    a = returns.where("ret is not null").groupBy("entity").agg(F.avg("ret").alias("m"), F.var_pop("ret").alias("v"))
    f = F.col("m") / F.nullif("v", F.lit(0.0))
    return a.select("entity", f.alias("fraction"), (f * F.col("m") - f * f * F.col("v") / 2).alias("log_growth"))


def capacity(bars: DataFrame, sizes: list[float], share: float = 0.1, impact: float = 0.1) -> DataFrame:
    """Days to trade each size at ``share`` of the mean dollar volume, and square-root impact in basis points."""
    a = bars.groupBy("entity").agg(F.avg(F.col("close") * F.col("volume")).alias("adv"), F.stddev_samp(F.log(F.col("close") / F.col("open"))).alias("vol"))
    out = a.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    return out.withColumn("days", F.ceil(F.col("size") / (F.col("adv") * share))).withColumn("impact_bps", impact * F.coalesce("vol", F.lit(0.0)) * F.sqrt(F.col("size") / F.col("adv")) * 1e4)


def drawdown_probability(curve: DataFrame, depth: float) -> DataFrame:
    """Share of bars at a drawdown of ``depth`` or more, and whether it was ever reached."""
    d = curve.withColumn("__d", F.col("equity") / F.max("equity").over(running()) - 1)
    return d.groupBy("entity").agg(F.avg((F.col("__d") <= -depth).cast("double")).alias("share"), F.max((F.col("__d") <= -depth).cast("int")).alias("reached"))

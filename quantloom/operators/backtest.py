"""Signals, single-name and portfolio backtests, and their logs.

A signal decided on a bar is carried to the next one, so that no bar trades on
its own close.  All state is a running window: latches are the last non-null
mark, lots are islands of a non-zero position.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.frames import by, full, running
from quantloom.operators import indicators as ind


def latch(enter: Column, leave: Column) -> Column:
    """1 from an entry to the next exit; an exit wins on its own bar; null marks hold."""
    return F.coalesce(F.last(F.when(leave, 0.0).when(enter, 1.0), ignorenulls=True).over(running()), F.lit(0.0))


def sma_signal(bars: DataFrame, fast: int = 10, slow: int = 30) -> DataFrame:
    if fast >= slow:
        raise ValueError("fast must be less than slow")
    return bars.withColumn("signal", F.when(full(F.avg, "close", fast) > full(F.avg, "close", slow), 1.0).otherwise(0.0))


def momentum_signal(bars: DataFrame, lookback: int = 20, threshold: float = 0.0) -> DataFrame:
    return bars.withColumn("signal", F.when(F.col("close") / F.lag("close", lookback).over(by()) - 1 > threshold, 1.0).otherwise(0.0))


def vwap_reversion_signal(bars: DataFrame, n: int = 20, t: float = 0.02) -> DataFrame:
    out = bars.withColumn("__v", ind.vwap(n))
    return out.withColumn("signal", latch(F.col("close") <= F.col("__v") * (1 - t), F.col("close") >= F.col("__v"))).drop("__v")


def state_machine(df: DataFrame, enter: str, leave: str) -> DataFrame:
    """``signal``: enters when flat on ``enter`` and leaves when in on ``leave``; toggles where both hold."""

    def run(p: pd.DataFrame) -> dict[str, np.ndarray]:
        state, out = 0.0, np.zeros(len(p))
        for i, (a, b) in enumerate(zip(p[enter].eq(True), p[leave].eq(True), strict=True)):
            state = (0.0 if b else 1.0) if state else (1.0 if a else 0.0)
            out[i] = state
        return {"signal": out}

    return ind.per_entity(df, run, ["signal"], keep=[c for c in df.columns if c not in (enter, leave)])


def donchian_signal(bars: DataFrame, n: int = 20, m: int = 10) -> DataFrame:
    high, low = ind.donchian(n, m)
    return state_machine(bars.withColumns({"__in": F.col("close") >= high, "__out": F.col("close") <= low}), "__in", "__out")


def bollinger_signal(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    low, middle, _ = ind.bollinger("close", n, k)
    return state_machine(bars.withColumns({"__in": F.col("close") <= low, "__out": F.col("close") >= middle}), "__in", "__out")


def recursive_signal(bars: DataFrame, kind: str, oversold: float = 30, overbought: float = 70, strength: float = 25) -> DataFrame:
    """``rsi``, ``macd`` or ``adx`` signals from one pass over the recursive indicators; bars without a value hold the state."""
    needed = {"macd": ("macd", "macd_signal"), "adx": ("adx", "plus_di", "minus_di"), "rsi": ("rsi",)}
    if kind not in needed:
        raise ValueError(f"unknown signal {kind!r}")
    panel = ind.recursive_panel(bars, only=needed[kind], keep=bars.columns)
    if kind == "macd":
        up = F.nanvl(F.col("macd") - F.col("macd_signal"), F.lit(None)) > 0
        signal = latch(up, ~up)
    elif kind == "adx":
        known = [F.nanvl(F.col(c), F.lit(None)) for c in ("adx", "plus_di", "minus_di")]
        up = F.when(known[0].isNotNull() & known[1].isNotNull() & known[2].isNotNull(), (known[0] > strength) & (known[1] > known[2]))
        signal = latch(up, ~up)
    else:
        rsi = F.nanvl(F.col("rsi"), F.lit(None))
        signal = latch(rsi < oversold, rsi > overbought)
    return panel.withColumn("signal", signal).select(*bars.columns, "signal")


def buy_and_hold_signal(bars: DataFrame) -> DataFrame:
    return bars.withColumn("signal", F.lit(1.0))


def run_strategy(signals: DataFrame, capital: float = 10_000.0, commission: float = 0.001, slippage: float = 0.0005, fill: str = "close", commission_model: str = "pct") -> DataFrame:
    """``executed, gross, cost, net, equity`` of ``entity, date, close, signal``.

    ``fill``: ``close``, or the two legs of ``next_open`` (``open``) and ``hl2``
    (the middle of ``high`` and ``low``): yesterday's position to that price,
    today's from it; a bar without it, or without a close before, counts 0.
    ``commission_model``: ``pct`` of the traded share of capital, or
    ``per_share``, an amount for each share at the fill price.
    """
    out = signals.withColumn("executed", F.coalesce(F.lag("signal").over(by()), F.lit(0.0)))
    held, last = F.coalesce(F.lag("executed").over(by()), F.lit(0.0)), F.lag("close").over(by())
    if fill == "close":
        price, gross = F.col("close"), F.col("executed") * (F.col("close") / last - 1)
    elif fill in ("next_open", "hl2"):
        price = F.col("open") if fill == "next_open" else (F.col("high") + F.col("low")) / 2
        gross = (1 + held * (price / last - 1)) * (1 + F.col("executed") * (F.col("close") / price - 1)) - 1
    else:
        raise ValueError(f"unknown fill {fill!r}")
    if commission_model not in ("pct", "per_share"):
        raise ValueError(f"unknown commission model {commission_model!r}")
    rate = F.lit(commission) if commission_model == "pct" else commission / price
    out = out.withColumns({"gross": F.coalesce(gross, F.lit(0.0)), "cost": F.abs(F.col("executed") - held) * (rate + slippage)})
    out = out.withColumn("net", F.col("gross") - F.col("cost"))
    return out.withColumn("equity", capital * F.product(F.greatest(1 + F.col("net"), F.lit(0.0))).over(running()))


def trade_log(book: DataFrame) -> DataFrame:
    """Lots of ``run_strategy``: from leaving zero to returning to it; a change of sign closes one and opens one."""
    before = F.coalesce(F.lag(F.signum("executed")).over(by()), F.lit(0.0))
    lots = book.withColumn("__new", F.when(F.signum("executed") != before, 1).otherwise(0)).withColumn("lot", F.sum("__new").over(running()))
    return lots.where("executed <> 0").groupBy("entity", "lot").agg(F.min("date").alias("entry"), F.max("date").alias("exit"), F.count("*").alias("bars"), F.max(F.signum("executed")).alias("direction"), (F.product(F.greatest(1 + F.col("net"), F.lit(0.0))) - 1).alias("return_pct"))


def trade_expectancy(trades: DataFrame) -> DataFrame:
    """Win rate, mean winner and loser, expectancy, payoff and longest losing streak of each entity."""
    r = F.col("return_pct")
    order = W.partitionBy("entity").orderBy("entry")
    runs = trades.withColumn("__broke", F.when(r >= 0, 1).otherwise(0)).withColumn("__run", F.sum("__broke").over(order.rowsBetween(W.unboundedPreceding, 0)))
    streak = runs.where(r < 0).groupBy("entity", "__run").count().groupBy("entity").agg(F.max("count").alias("losing_streak"))
    a = trades.groupBy("entity").agg(F.count("*").alias("n"), F.count_if(r > 0).alias("wins"), F.avg(F.when(r > 0, r)).alias("winner"), F.avg(F.when(r < 0, r)).alias("loser"), F.count_if(r < 0).alias("losses"))
    out = a.join(streak, "entity", "left")
    return out.select("entity", "n", (F.col("wins") / F.col("n")).alias("win_rate"), "winner", "loser", (F.coalesce(F.col("wins") / F.col("n") * F.col("winner"), F.lit(0.0)) + F.coalesce(F.col("losses") / F.col("n") * F.col("loser"), F.lit(0.0))).alias("expectancy"), F.when(F.col("wins") > 0, F.coalesce(F.abs(F.col("winner") / F.col("loser")), F.lit(float("inf")))).alias("payoff"), F.coalesce("losing_streak", F.lit(0)).alias("losing_streak"))


def exposure(book: DataFrame) -> DataFrame:
    e = F.col("executed")
    return book.groupBy("entity").agg(F.avg((e != 0).cast("double")).alias("in_market"), F.avg(F.abs(e)).alias("mean_abs"), F.avg(e).alias("mean"), F.avg((e > 0).cast("double")).alias("long"), F.avg((e < 0).cast("double")).alias("short"))


def excursions(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Best and worst close of each lot against its first close, by an interval join."""
    from quantloom.operators.joins import interval_join

    held = interval_join(bars.select("entity", "date", "close"), trades.select("entity", "lot", "entry", "exit"), "entity", "date", "entry", "exit")
    return held.groupBy("entity", "lot").agg((F.max("close") / F.min_by("close", "date") - 1).alias("mfe"), (F.min("close") / F.min_by("close", "date") - 1).alias("mae"))


def rank_weights(scores: DataFrame, c: str = "score") -> DataFrame:
    """``weight``: average rank less the date's mean rank, over the sum of absolute values."""
    from quantloom.functions.frames import across, average_rank

    out = average_rank(scores.where(F.col(c).isNotNull()), c, ["date"], "__rank")
    out = out.withColumn("__d", F.col("__rank") - F.avg("__rank").over(across()))
    return out.withColumn("weight", F.coalesce(F.col("__d") / F.nullif(F.sum(F.abs("__d")).over(across()), F.lit(0.0)), F.lit(0.0))).drop("__rank", "__d")


def top_bottom_weights(scores: DataFrame, n: int, c: str = "score") -> DataFrame:
    """Equal weights of the ``n`` best and ``n`` worst of each date; either side half of the gross if both are there."""
    w = W.partitionBy("date")
    out = scores.withColumn("__top", F.row_number().over(w.orderBy(F.col(c).desc_nulls_last(), "entity"))).withColumn("__low", F.row_number().over(w.orderBy(F.col(c).asc_nulls_last(), "entity")))
    side = F.when(F.col("__top") <= n, 1).when(F.col("__low") <= n, -1).otherwise(0)
    out = out.withColumn("__side", side)
    both = F.when((F.max("__side").over(w) == 1) & (F.min("__side").over(w) == -1), 0.5).otherwise(1.0)
    size = F.count("*").over(W.partitionBy("date", "__side"))
    return out.withColumn("weight", F.when(F.col("__side") == 0, 0.0).otherwise(F.col("__side") * both / size)).drop("__top", "__low", "__side")


def portfolio_returns(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """``date, ret, turnover, gross``: weights of a date earn its next date's returns of their entities."""
    held = weights.withColumn("__next", F.lead("date").over(by()))
    earned = held.join(returns.select(F.col("entity").alias("__e"), F.col("date").alias("__d"), "ret"), (F.col("entity") == F.col("__e")) & (F.col("__next") == F.col("__d")))
    turn = weights.withColumn("__before", F.coalesce(F.lag("weight").over(by()), F.lit(0.0))).groupBy("date").agg(F.sum(F.abs(F.col("weight") - F.col("__before"))).alias("turnover"), F.sum(F.abs("weight")).alias("gross"))
    pnl = earned.groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    return turn.join(pnl, "date", "left").select("date", F.coalesce("ret", F.lit(0.0)).alias("ret"), "turnover", "gross")


def prediction_weights(scores: DataFrame, method: str, c: str = "score", quantile: float = 0.2) -> DataFrame:
    """``weight`` of each date's predictions, gross 1: ``sign``, ``zscore`` or ``quantile`` (best and worst share, half each); null scores get 0."""
    x, w = F.col(c), W.partitionBy("date")
    if method == "sign":
        raw = F.signum(x)
    elif method == "zscore":
        raw = (x - F.avg(x).over(w)) / F.nullif(F.stddev_samp(x).over(w), F.lit(0.0))
    elif method == "quantile":
        share = F.percent_rank().over(w.orderBy(x.asc_nulls_last(), "entity"))
        raw = F.when(x.isNull(), None).when(share >= 1 - quantile, 1.0).when(share <= quantile, -1.0).otherwise(0.0)
    else:
        raise ValueError(f"unknown method {method!r}")
    out = scores.withColumn("__w", F.coalesce(raw, F.lit(0.0)))
    return out.withColumn("weight", F.coalesce(F.col("__w") / F.nullif(F.sum(F.abs("__w")).over(w), F.lit(0.0)), F.lit(0.0))).drop("__w")


def simulate_portfolio(weights: DataFrame, returns: DataFrame, rebalance: str = "month", cost: float = 0.0015, capital: float = 1.0) -> DataFrame:
    """``date, gross, cost, net, turnover, equity`` of target weights that are taken on at rebalances and held between.

    The targets of the first date of each ``rebalance`` period (``day``,
    ``week``, ``month``) are in force from the entity's next return on; a target
    is the whole weight until the next one, and trades the difference.  Missing
    returns earn nothing.  Equity runs along dates: one row for each.
    """
    firsts = weights.groupBy(F.date_trunc(rebalance, "date")).agg(F.min("date").alias("date")).select("date")
    targets = weights.join(firsts, "date", "left_semi").select("entity", "date", F.col("weight").alias("target"))
    both = returns.select("entity", "date", "ret").join(targets, ["entity", "date"], "full")
    # A rebalance that leaves an entity out is its exit.
    w = by().rowsBetween(W.unboundedPreceding, -1)
    both = both.withColumn("held", F.coalesce(F.last("target", ignorenulls=True).over(w), F.lit(0.0)))
    both = both.withColumn("trade", F.abs(F.col("target") - F.col("held")))
    daily = both.groupBy("date").agg(F.sum(F.col("held") * F.coalesce("ret", F.lit(0.0))).alias("gross"), F.coalesce(F.sum("trade"), F.lit(0.0)).alias("turnover"))
    daily = daily.withColumn("cost", F.col("turnover") * cost).withColumn("net", F.col("gross") - F.col("cost"))
    order = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return daily.withColumn("equity", capital * F.product(F.greatest(1 + F.col("net"), F.lit(0.0))).over(order))


def rehedge_dates(df: DataFrame, rule: str, c: str = "ratio", band: float = 0.1) -> DataFrame:
    """``df`` with ``rehedge``: first bar of each ``day``, ``week`` or ``month``, or (``drift``) a move of ``c`` beyond ``band`` of its value at the last hedge."""
    if rule == "drift":

        def run(p: pd.DataFrame) -> dict[str, np.ndarray]:
            out, last = np.zeros(len(p)), np.nan
            for i, x in enumerate(p[c].to_numpy(float)):
                if not np.isnan(x) and (np.isnan(last) or abs(x - last) > band * abs(last)):
                    out[i], last = 1.0, x
            return {"rehedge": out}

        return ind.per_entity(df, run, ["rehedge"], keep=df.columns)
    if rule not in ("day", "week", "month"):
        raise ValueError(f"unknown rule {rule!r}")
    period = F.date_trunc(rule, "date")
    return df.withColumn("rehedge", F.when(F.lag(period).over(by()) == period, 0.0).otherwise(1.0))

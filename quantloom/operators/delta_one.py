"""Delta-one: futures curves and rolls, baskets, index flows, swaps, pair and hedge backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.frames import by, running


def futures_curve(contracts: DataFrame) -> DataFrame:
    """Annualised carry between neighbouring expiries of ``root, date, expiry, price``; positive in contango."""
    w = W.partitionBy("root", "date").orderBy("expiry")
    gap = F.datediff(F.lead("expiry").over(w), F.col("expiry")) / 365.0
    return contracts.withColumn("carry", F.log(F.lead("price").over(w) / F.col("price")) / F.nullif(gap, F.lit(0.0))).withColumn("rank", F.row_number().over(w))


def roll_cost(contracts: DataFrame) -> DataFrame:
    """Relative price of the second over the first contract of each date."""
    c = futures_curve(contracts)
    first, second = (c.where(F.col("rank") == i).select("root", "date", F.col("price").alias(f"p{i}")) for i in (1, 2))
    return first.join(second, ["root", "date"]).select("root", "date", (F.col("p2") / F.col("p1") - 1).alias("roll_cost"))


def rebalance_flow(old: DataFrame, new: DataFrame, value: float) -> DataFrame:
    """``entity, change, flow``: trade of an index fund of ``value`` from old to new weights."""
    both = old.select("entity", F.col("weight").alias("a")).join(new.select("entity", F.col("weight").alias("b")), "entity", "full")
    change = F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))
    return both.select("entity", change.alias("change"), (change * value).alias("flow"))


def basket_value(weights: DataFrame, prices: DataFrame, divisor: float = 1.0, cash: float = 0.0) -> DataFrame:
    """``date, value, coverage``: units times price over a divisor, plus cash; the share of names with a price."""
    n = weights.agg(F.count("*").alias("n"))
    held = prices.join(weights.select("entity", "units"), "entity")
    return held.groupBy("date").agg(((F.sum(F.col("units") * F.col("close")) + cash) / divisor).alias("value"), F.count("*").alias("c")).crossJoin(F.broadcast(n)).select("date", "value", (F.col("c") / F.col("n")).alias("coverage"))


def tracking_error(a: DataFrame, b: DataFrame, per_year: int = 252) -> DataFrame:
    """One row: annualised deviation and mean of the difference of two return series on common dates."""
    d = a.select("date", F.col("ret").alias("x")).join(b.select("date", F.col("ret").alias("y")), "date").where("x is not null and y is not null")
    return d.agg(F.count("*").alias("n"), (F.stddev_samp(F.col("x") - F.col("y")) * per_year**0.5).alias("tracking_error"), (F.avg(F.col("x") - F.col("y")) * per_year).alias("active_return"))


def total_return_swap(path: DataFrame, notional: float, spread: float, basis: int = 360) -> DataFrame:
    """Equity leg, financing leg and net of each period of ``entity, date, close, rate``."""
    before = F.lag("close").over(by())
    days = F.datediff(F.col("date"), F.lag("date").over(by()))
    equity = notional * (F.col("close") / before - 1)
    funding = notional * (F.lag("rate").over(by()) + spread) * days / basis
    return path.select("entity", "date", equity.alias("equity_leg"), funding.alias("funding_leg"), (equity - funding).alias("net")).where("net is not null")


def pair_backtest(spread: DataFrame, enter: float = 2.0, leave: float = 0.5, n: int = 60) -> DataFrame:
    """Position against a rolling z-score of ``date, spread``: short above ``enter``, long below its negative, out inside ``leave``.

    ``spread`` is one pair's series (a row a date); the position is the last mark.
    """
    one = spread.withColumn("entity", F.lit(0))
    w = by().rowsBetween(-(n - 1), 0)
    z = F.when(F.count("spread").over(w) == n, (F.col("spread") - F.avg("spread").over(w)) / F.nullif(F.stddev_samp("spread").over(w), F.lit(0.0)))
    out = one.withColumn("z", z)
    mark = F.when(F.abs("z") <= leave, 0.0).when(F.col("z") >= enter, -1.0).when(F.col("z") <= -enter, 1.0)
    out = out.withColumn("position", F.coalesce(F.last(mark, ignorenulls=True).over(running()), F.lit(0.0)))
    return out.withColumn("pnl", F.coalesce(F.lag("position").over(by()) * (F.col("spread") - F.lag("spread").over(by())), F.lit(0.0))).select("date", "spread", "z", "position", "pnl")


def stress_windows(returns: DataFrame, windows: DataFrame) -> DataFrame:
    """Compounded return and worst bar of each entity in each window ``name, begin, end``; windows are few."""
    held = returns.where("ret is not null").join(F.broadcast(windows), F.col("date").between(F.col("begin"), F.col("end")))
    return held.groupBy("name", "entity").agg(F.count("*").alias("bars"), (F.product(F.greatest(1 + F.col("ret"), F.lit(0.0))) - 1).alias("ret"), F.min("ret").alias("worst"))


def accrued_financing(book: DataFrame, rate: float, basis: int = 360) -> DataFrame:
    """Interest on negative ``cash`` over the calendar days to each bar."""
    days = F.datediff(F.col("date"), F.lag("date").over(by()))
    return book.withColumn("interest", F.coalesce(F.greatest(-F.lag("cash").over(by()), F.lit(0.0)) * rate * days / basis, F.lit(0.0)))


def by_regime(returns: DataFrame, regimes: DataFrame, per_year: int = 252) -> DataFrame:
    """Count, mean and Sharpe ratio of each entity and regime."""
    j = returns.where("ret is not null").join(regimes.select("entity", "date", "regime"), ["entity", "date"])
    return j.groupBy("entity", "regime").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), (F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * per_year**0.5).alias("sharpe"))

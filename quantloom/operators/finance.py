"""Positions, currencies, margin, financing and cash flows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Initial and maintenance shares of a stock position, long and short.
INITIAL = {"long": 0.5, "short": 0.5}
MAINTENANCE = {"long": 0.25, "short": 0.30}


def position_values(positions: DataFrame, rates: DataFrame, base: str = "USD") -> DataFrame:
    """``notional_local, notional`` of ``instrument, quantity, price, currency[, multiplier]`` in the base currency, in exact decimals.

    A currency without a rate fails the action by name.
    """
    multiplier = F.col("multiplier") if "multiplier" in positions.columns else F.lit(1.0)
    exact = lambda c: c.cast("decimal(28,8)")
    out = positions.join(F.broadcast(rates.select("currency", F.col("rate").alias("__rate"))), "currency", "left")
    rate = F.when(F.col("currency") == base, F.lit(1.0)).otherwise(F.coalesce("__rate", F.raise_error(F.concat(F.lit("no rate for "), "currency")).cast("double")))
    local = exact(F.col("quantity")) * exact(F.col("price") * multiplier)
    return out.withColumn("notional_local", local.cast("double")).withColumn("notional", (local.cast("decimal(28,6)") * rate.cast("decimal(10,6)")).cast("double")).drop("__rate")


def exposure_summary(valued: DataFrame) -> DataFrame:
    """Gross, net, long and short by currency and in total."""
    n = F.col("notional").cast("decimal(38,6)")
    return valued.rollup("currency").agg(F.count("*").alias("lines"), *(F.sum(e).cast("double").alias(k) for k, e in (("gross", F.abs(n)), ("net", n), ("long", F.when(n > 0, n).otherwise(0)), ("short", F.when(n < 0, n).otherwise(0)))))


def margin_requirement(valued: DataFrame) -> DataFrame:
    """Initial and maintenance margin of each line."""
    size, long = F.abs("notional"), F.col("notional") > 0
    return valued.withColumn("initial", size * F.when(long, INITIAL["long"]).otherwise(INITIAL["short"])).withColumn("maintenance", size * F.when(long, MAINTENANCE["long"]).otherwise(MAINTENANCE["short"]))


def financing_cost(valued: DataFrame, equity: float, debit: float, credit: float, borrow_bps: float, days: int, basis: int = 360) -> DataFrame:
    """One row: interest on borrowed or idle cash and short borrow over ``days``."""
    n = F.col("notional")
    a = valued.agg(F.sum(F.when(n > 0, n).otherwise(0.0)).alias("long"), F.sum(F.when(n < 0, -n).otherwise(0.0)).alias("short"))
    cash = F.lit(equity) - F.col("long")
    return a.select("long", "short", (F.greatest(-cash, F.lit(0.0)) * debit * days / basis).alias("debit_interest"), (F.greatest(cash, F.lit(0.0)) * credit * days / basis).alias("credit_interest"), (F.col("short") * borrow_bps / 1e4 * days / basis).alias("short_borrow"))


def margin_runway(changes: DataFrame, equity: float) -> DataFrame:
    """First date of each entity on which equity after ``change``s is under ``maintenance``; null where there is none."""
    from quantloom.functions.frames import running

    path = changes.withColumn("equity", equity + F.sum("change").over(running()))
    return path.groupBy("entity").agg(F.min(F.when(F.col("equity") < F.col("maintenance"), F.col("date"))).alias("call_date"), F.min("equity").alias("least_equity"))


def covered_interest_forward(df: DataFrame) -> DataFrame:
    return df.withColumn("forward", F.col("spot") * (1 + F.col("second_rate") * F.col("second_years")) / (1 + F.col("first_rate") * F.col("first_years")))


def net_present_value(flows: DataFrame, rate: float) -> DataFrame:
    """``key, npv`` of ``key, years, amount`` at an annual rate."""
    return flows.groupBy("key").agg(F.sum(F.col("amount") * F.pow(F.lit(1 + rate), -F.col("years"))).alias("npv"))


def rate_roots(times: np.ndarray, amounts: np.ndarray, low: float = -2.0, high: float = 3.0, steps: int = 2000) -> list[float]:
    """Continuously compounded rates at which the flows are worth nothing, by sign changes on a grid and bisection."""
    value = lambda u: float((amounts * np.exp(-u * times)).sum())
    grid = np.linspace(low, high, steps)
    v = [value(u) for u in grid]
    out = []
    for a, b, x, y in zip(grid, grid[1:], v, v[1:], strict=False):
        if x == 0:
            out.append(float(a))
        elif x * y < 0:
            for _ in range(80):
                m = (a + b) / 2
                a, b = (m, b) if value(m) * x > 0 else (a, m)
            out.append(float((a + b) / 2))
    return out


def internal_rates(flows: DataFrame) -> DataFrame:
    """``key, rates, unique`` of each stream of flows."""
    import pandas as pd

    def run(p: pd.DataFrame) -> pd.DataFrame:
        roots = [math.expm1(u) for u in rate_roots(p["years"].to_numpy(float), p["amount"].to_numpy(float))]
        return pd.DataFrame({"key": [p["key"].iloc[0]], "rates": [roots], "unique": [len(roots) == 1]})

    return flows.groupBy("key").applyInPandas(run, f"key {flows.schema['key'].dataType.simpleString()}, rates array<double>, unique boolean")


def unlever_beta(beta: float, debt_to_equity: float, tax: float) -> float:
    return beta / (1 + (1 - tax) * debt_to_equity)


def relever_beta(beta: float, debt_to_equity: float, tax: float) -> float:
    return beta * (1 + (1 - tax) * debt_to_equity)


def cost_of_capital(rf: float, beta: float, premium: float, equity: float, debt: float, cost_of_debt: float, tax: float) -> float:
    total = equity + debt
    return equity / total * (rf + beta * premium) + debt / total * cost_of_debt * (1 - tax)


def dcf(flows: list[float], rate: float, growth: float) -> float:
    """Value of yearly flows and a growing perpetuity after them."""
    if rate <= growth:
        raise ValueError("the discount rate must be above the terminal growth")
    terminal = flows[-1] * (1 + growth) / (rate - growth)
    return sum(f / (1 + rate) ** (i + 1) for i, f in enumerate(flows)) + terminal / (1 + rate) ** len(flows)

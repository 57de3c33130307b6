"""Screener: predicates over a table of fundamentals, with the first that each name fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Filter -> column and whether the bound is the most or the least.
FILTERS = {
    "pe_ratio_max": ("pe_ratio", "max"), "pe_ratio_min": ("pe_ratio", "min"), "price_to_book_max": ("price_to_book", "max"), "debt_to_equity_max": ("debt_to_equity", "max"), "return_on_equity_min": ("return_on_equity", "min"), "profit_margin_min": ("profit_margin", "min"), "dividend_yield_min": ("dividend_yield", "min"),
    "market_cap_min": ("market_cap", "min"), "market_cap_max": ("market_cap", "max"), "volume_min": ("volume", "min"), "price_min": ("price", "min"), "beta_max": ("beta", "max"), "beta_min": ("beta", "min"),
}


def screen(table: DataFrame, **bounds: float) -> DataFrame:
    """``passed`` and ``failed`` (the first filter, in the order given, that a row fails; missing values fail)."""
    unknown = set(bounds) - set(FILTERS)
    if unknown:
        raise ValueError(f"unknown filters {sorted(unknown)}; known: {sorted(FILTERS)}")
    reasons = []
    for name, bound in bounds.items():
        column, side = FILTERS[name]
        good = F.col(column) <= bound if side == "max" else F.col(column) >= bound
        reasons.append(F.when(~F.coalesce(good, F.lit(False)), F.lit(name)))
    failed = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    return table.withColumn("failed", failed).withColumn("passed", F.col("failed").isNull())

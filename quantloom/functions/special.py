"""Special functions as column expressions, and option formulas built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of a published double-precision rational approximation of the normal distribution function.
NUMERATOR = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
DENOMINATOR = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) * 0.3989422804014327


def normal_cdf(x: Column) -> Column:
    """Distribution function of the standard normal, to about 1e-15."""
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    middle = e * _horner(a, NUMERATOR) / _horner(a, DENOMINATOR)
    far = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, middle).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_cdf_sql(x: str) -> str:
    """The same in SQL, for |x| below 7."""
    def poly(c: tuple[float, ...]) -> str:
        out = repr(c[0])
        for v in c[1:]:
            out = f"({out} * abs({x}) + {v!r})"
        return out

    tail = f"(exp(-({x}) * ({x}) / 2) * {poly(NUMERATOR)} / {poly(DENOMINATOR)})"
    return f"(CASE WHEN ({x}) > 0 THEN 1 - {tail} ELSE {tail} END)"


def black_scholes(spot: Column, strike: Column, years: Column, rate: Column, vol: Column, call: Column, carry: Column | float = 0.0) -> dict[str, Column]:
    """``price, delta, gamma, vega, theta, rho`` of European options; ``carry``: dividend yield."""
    root = vol * F.sqrt(years)
    d1 = (F.log(spot / strike) + (rate - carry + vol * vol / 2) * years) / root
    d2 = d1 - root
    fwd, disc = F.exp(-F.lit(carry) * years) if not isinstance(carry, Column) else F.exp(-carry * years), F.exp(-rate * years)
    sign = F.when(call, 1.0).otherwise(-1.0)
    n1, n2 = normal_cdf(sign * d1), normal_cdf(sign * d2)
    density = normal_pdf(d1)
    return {
        "price": sign * (spot * fwd * n1 - strike * disc * n2),
        "delta": sign * fwd * n1,
        "gamma": fwd * density / (spot * root),
        "vega": spot * fwd * density * F.sqrt(years),
        "theta": -spot * fwd * density * vol / (2 * F.sqrt(years)) - sign * rate * strike * disc * n2 + sign * carry * spot * fwd * n1,
        "rho": sign * strike * years * disc * n2,
    }


def black_76(forward: Column, strike: Column, years: Column, rate: Column, vol: Column, call: Column) -> Column:
    root = vol * F.sqrt(years)
    d1 = F.log(forward / strike) / root + root / 2
    sign = F.when(call, 1.0).otherwise(-1.0)
    return sign * F.exp(-rate * years) * (forward * normal_cdf(sign * d1) - strike * normal_cdf(sign * (d1 - root)))


def bachelier(forward: Column, strike: Column, years: Column, rate: Column, vol: Column, call: Column) -> Column:
    root = vol * F.sqrt(years)
    d = (forward - strike) / root
    sign = F.when(call, 1.0).otherwise(-1.0)
    return F.exp(-rate * years) * (sign * (forward - strike) * normal_cdf(sign * d) + root * normal_pdf(d))


def day_count(begin: Column, end: Column, convention: str) -> Column:
    """Years between two dates: ``ACT/365F``, ``ACT/360``, ``30/360`` or ``ACT/ACT``."""
    days = F.datediff(end, begin)
    if convention == "ACT/365F":
        return days / 365.0
    if convention == "ACT/360":
        return days / 360.0
    if convention == "30/360":
        d1 = F.least(F.day(begin), F.lit(30))
        d2 = F.when((F.day(end) == 31) & (d1 == 30), 30).otherwise(F.day(end))
        return (360 * (F.year(end) - F.year(begin)) + 30 * (F.month(end) - F.month(begin)) + (d2 - d1)) / 360.0
    if convention == "ACT/ACT":
        length = lambda c: F.dayofyear(F.make_date(F.year(c), F.lit(12), F.lit(31)))
        into = lambda c: (F.dayofyear(c) - 1) / length(c)
        return F.year(end) - F.year(begin) + into(end) - into(begin)
    raise ValueError(f"unknown day count {convention!r}")

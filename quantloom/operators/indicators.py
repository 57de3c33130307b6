"""Technical indicators over bars ``entity, date, open, high, low, close, volume``.

Fixed windows are Catalyst window expressions, all over one partitioning and
order, so a panel of them costs one shuffle and one sort.  Recursions (EMA,
Wilder, parabolic SAR) run once for each entity over Arrow groups.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import blocks as bl
from quantloom.functions.frames import by, clipped, col, full, rows, running


def refuse_infinities(df: DataFrame, *columns: str) -> DataFrame:
    """``df``; an action fails with the column's name where a value is infinite."""
    for c in columns:
        bad = F.col(c).isin(float("inf"), float("-inf"))
        df = df.withColumn(c, F.when(bad, F.raise_error(F.lit(f"{c} holds an infinite value"))).otherwise(F.col(c)))
    return df


def sma(c: Column | str, n: int) -> Column:
    return full(F.avg, c, n)


def bollinger(c: str = "close", n: int = 20, k: float = 2.0) -> tuple[Column, Column, Column]:
    """Lower, middle, upper band; a flat window gives its price for all three."""
    flat = full(F.max, c, n) == full(F.min, c, n)
    middle, spread = full(F.avg, c, n), full(F.stddev_samp, c, n)
    return tuple(F.when(flat, F.col(c)).otherwise(middle + s * k * spread) for s in (-1, 0, 1))


def true_range() -> Column:
    """Null on the first bar."""
    before = F.lag("close").over(by())
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return bars.withColumn("tr", true_range()).withColumn("atr", full(F.avg, "tr", n))


def stochastic(bars: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    """``stoch_k`` (0 on a zero range) and ``stoch_d``, its mean over ``d`` rows."""
    low, high = full(F.min, "low", k), full(F.max, "high", k)
    value = F.when(high == low, 0.0).otherwise(100 * (F.col("close") - low) / F.nullif(high - low, F.lit(0.0)))
    return bars.withColumn("stoch_k", F.when(low.isNotNull() & high.isNotNull(), value)).withColumn("stoch_d", full(F.avg, "stoch_k", d))


def williams_r(n: int = 14) -> Column:
    """Null on a zero range."""
    low, high = full(F.min, "low", n), full(F.max, "high", n)
    return -100 * (high - F.col("close")) / F.nullif(high - low, F.lit(0.0))


def obv(bars: DataFrame) -> DataFrame:
    change = F.coalesce(F.col("close") - F.lag("close").over(by()), F.lit(0.0))
    return bars.withColumn("__flow", F.signum(change) * F.col("volume")).withColumn("obv", F.sum("__flow").over(running())).drop("__flow")


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def vwap(n: int | None = None) -> Column:
    """Running, or over ``n`` rows."""
    if n is None:
        return F.sum(typical() * F.col("volume")).over(running()) / F.nullif(F.sum("volume").over(running()), F.lit(0.0))
    return full(F.sum, typical() * F.col("volume"), n) / F.nullif(full(F.sum, "volume", n), F.lit(0.0))


def mfi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Money flow index; no negative flow 100, no positive flow 0, neither null."""
    change = typical() - F.lag(typical()).over(by())
    flow = typical() * F.col("volume")
    out = bars.withColumns({"__up": F.when(change > 0, flow).when(change.isNotNull(), 0.0), "__down": F.when(change <= 0, flow).when(change.isNotNull(), 0.0)})
    up, down = full(F.sum, "__up", n), full(F.sum, "__down", n)
    value = F.when((up == 0) & (down == 0), F.lit(None)).when(down == 0, 100.0).when(up == 0, 0.0).otherwise(100 - 100 / (1 + up / F.nullif(down, F.lit(0.0))))
    return out.withColumn("mfi", value).drop("__up", "__down")


def donchian(n: int = 20, m: int = 10) -> tuple[Column, Column]:
    """Highest high of the ``n`` bars before and lowest low of the ``m`` before."""
    return full(F.max, "high", n, by().rowsBetween(-n, -1)), full(F.min, "low", m, by().rowsBetween(-m, -1))


def volatility(kind: str, n: int = 20, per_year: int = 252) -> Column:
    """``parkinson``, ``garman_klass`` or ``yang_zhang`` volatility over ``n`` bars, annualised; the last needs ``with_overnight``."""
    hl, co = F.log(F.col("high") / F.col("low")), F.log(F.col("close") / F.col("open"))
    if kind == "parkinson":
        variance = full(F.avg, hl * hl, n) / (4 * np.log(2))
    elif kind == "garman_klass":
        variance = full(F.avg, 0.5 * hl * hl - (2 * np.log(2) - 1) * co * co, n)
    elif kind == "yang_zhang":
        rs = F.log(F.col("high") / F.col("close")) * F.log(F.col("high") / F.col("open")) + F.log(F.col("low") / F.col("close")) * F.log(F.col("low") / F.col("open"))
        k = 0.34 / (1.34 + (n + 1) / (n - 1))
        variance = full(F.var_samp, "overnight", n) + k * full(F.var_samp, co, n) + (1 - k) * full(F.avg, rs, n)
    else:
        raise ValueError(f"unknown volatility {kind!r}")
    return F.sqrt(clipped(variance) * per_year)


def with_overnight(bars: DataFrame) -> DataFrame:
    return bars.withColumn("overnight", F.log(F.col("open") / F.lag("close").over(by())))


def range_volatilities(bars: DataFrame, n: int = 20, per_year: int = 252) -> DataFrame:
    """``parkinson``, ``garman_klass`` and ``yang_zhang`` as ``volatility`` has them, over blocks of entities."""
    k = 0.34 / (1.34 + (n + 1) / (n - 1))

    def run(block: bl.Block) -> bl.Block:
        o, h, lo, c = (np.log(np.where(block[x] > 0, block[x], np.nan)) for x in ("open", "high", "low", "close"))
        gap, co = o - bl.lagged(c), c - o
        mean = lambda x: bl.window_sum(x, n) / n
        gaps, moves = bl.window_moments(n, (gap, gap), (co, co))
        variances = {"parkinson": mean((h - lo) ** 2) / (4 * np.log(2)), "garman_klass": mean(0.5 * (h - lo) ** 2 - (2 * np.log(2) - 1) * co * co)}
        variances["yang_zhang"] = gaps / (n - 1) + k * moves / (n - 1) + (1 - k) * mean((h - c) * (h - o) + (lo - c) * (lo - o))
        return {name: np.sqrt(np.maximum(v, 0.0) * per_year) for name, v in variances.items()}

    return bl.per_block(bars, run, ["open", "high", "low", "close"], ["parkinson", "garman_klass", "yang_zhang"])


# Recursions -----------------------------------------------------------------


def ema_values(x: np.ndarray, span: int) -> np.ndarray:
    """Seeded with the first value; missing values hold the state and give none."""
    alpha, state = 2 / (span + 1), np.nan
    out = np.full(len(x), np.nan)
    for i, v in enumerate(x):
        if not np.isnan(v):
            state = v if np.isnan(state) else state + alpha * (v - state)
            out[i] = state
    return out


def rsi_values(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's mean gain and loss, seeded with the mean of the first ``n`` changes; missing prices are skipped."""
    out = np.full(len(x), np.nan)
    known = np.flatnonzero(~np.isnan(x))
    change = np.diff(x[known])
    if len(change) < n:
        return out
    gain, loss = np.maximum(change, 0), np.maximum(-change, 0)
    up, down = gain[:n].mean(), loss[:n].mean()
    for i in range(n - 1, len(change)):
        if i >= n:
            up, down = (up * (n - 1) + gain[i]) / n, (down * (n - 1) + loss[i]) / n
        out[known[i + 1]] = 100.0 if down == 0 else 100 - 100 / (1 + up / down)
    return out


def wilder_mean(x: np.ndarray, n: int) -> np.ndarray:
    """Mean of the first ``n`` values, then (mean (n - 1) + x) / n."""
    out = np.full(len(x), np.nan)
    known = np.flatnonzero(~np.isnan(x))
    if len(known) >= n:
        state = x[known[:n]].mean()
        out[known[n - 1]] = state
        for i in known[n:]:
            state = (state * (n - 1) + x[i]) / n
            out[i] = state
    return out


def adx_values(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ADX, +DI, -DI from Wilder sums; zero denominators give 0."""
    size = len(close)
    adx, plus, minus = (np.full(size, np.nan) for _ in range(3))
    if size < n + 1:
        return adx, plus, minus
    up, down = np.diff(high), -np.diff(low)
    dm_up, dm_down = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    tr = np.maximum.reduce([high[1:] - low[1:], np.abs(high[1:] - close[:-1]), np.abs(low[1:] - close[:-1])])
    s, p, m = tr[:n].sum(), dm_up[:n].sum(), dm_down[:n].sum()
    dx = []
    for i in range(n - 1, size - 1):
        if i >= n:
            s, p, m = s - s / n + tr[i], p - p / n + dm_up[i], m - m / n + dm_down[i]
        a, b = (100 * p / s, 100 * m / s) if s > 0 else (0.0, 0.0)
        plus[i + 1], minus[i + 1] = a, b
        dx.append(100 * abs(a - b) / (a + b) if a + b > 0 else 0.0)
        if len(dx) == n:
            adx[i + 1] = state = float(np.mean(dx))
        elif len(dx) > n:
            adx[i + 1] = state = (state * (n - 1) + dx[-1]) / n
    return adx, plus, minus


def psar_values(high: np.ndarray, low: np.ndarray, step: float = 0.02, most: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Parabolic stop and trend (1 up, -1 down); starts up from the first low."""
    size = len(high)
    sar, trend = np.full(size, np.nan), np.full(size, np.nan)
    if not size:
        return sar, trend
    up, stop, extreme, speed = True, low[0], high[0], step
    sar[0], trend[0] = stop, 1
    for i in range(1, size):
        stop = stop + speed * (extreme - stop)
        stop = min(stop, low[i - 1], low[max(i - 2, 0)]) if up else max(stop, high[i - 1], high[max(i - 2, 0)])
        if (low[i] < stop) if up else (high[i] > stop):
            up, stop, speed = not up, extreme, step
            extreme = high[i] if up else low[i]
        elif (high[i] > extreme) if up else (low[i] < extreme):
            extreme, speed = (high[i] if up else low[i]), min(speed + step, most)
        sar[i], trend[i] = stop, 1 if up else -1
    return sar, trend


def gapless(values: Callable[..., tuple[np.ndarray, ...]], *series: np.ndarray) -> tuple[np.ndarray, ...]:
    """``values`` of the bars on which no series is missing, put back in their places; the other bars are skipped and get none."""
    known = ~np.isnan(np.vstack(series)).any(axis=0)
    out = []
    for made in values(*(x[known] for x in series)):
        whole = np.full(len(known), np.nan)
        whole[known] = made
        out.append(whole)
    return tuple(out)


def per_entity(df: DataFrame, run: Callable[[pd.DataFrame], dict[str, np.ndarray]], names: list[str], keep: list[str] | None = None, entity: str = "entity", order: str = "date") -> DataFrame:
    """Columns ``names`` that ``run`` makes from each entity's rows in order, beside ``keep``."""
    keep = keep or [entity, order]
    schema = df.select(*keep).schema
    for n in names:
        schema = schema.add(n, "double")

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        made = run(pdf)
        out = pdf[keep].copy()
        for n in names:
            out[n] = pd.Series(made[n]).astype(float)
        return out

    return df.groupBy(entity).applyInPandas(group, schema)


def ema_block(x: np.ndarray, span: int) -> np.ndarray:
    """``ema_values`` of each column."""
    alpha, state = 2 / (span + 1), np.full(x.shape[1], np.nan)
    out = np.empty(x.shape)
    for i, v in enumerate(x):
        missing = np.isnan(v)
        state = np.where(missing, state, np.where(np.isnan(state), v, state + alpha * (v - state)))
        out[i] = np.where(missing, np.nan, state)
    return out


def _wilder_block(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder means of columns without gaps."""
    out = np.full(x.shape, np.nan)
    if len(x) >= n:
        out[n - 1] = x[:n].sum(axis=0) / n
        for i in range(n, len(x)):
            out[i] = (out[i - 1] * (n - 1) + x[i]) / n
    return out


def wilder_block(x: np.ndarray, n: int) -> np.ndarray:
    """``wilder_mean`` of each column."""
    return bl.packed(lambda y: (_wilder_block(y, n),), x)[0]


def rsi_block(x: np.ndarray, n: int) -> np.ndarray:
    """``rsi_values`` of each column."""

    def run(y: np.ndarray) -> tuple[np.ndarray]:
        change = y - bl.lagged(y)
        up, down = (np.full(y.shape, np.nan) for _ in range(2))
        up[1:], down[1:] = _wilder_block(np.maximum(change[1:], 0), n), _wilder_block(np.maximum(-change[1:], 0), n)
        return (np.where(down == 0, 100.0, 100 - 100 / (1 + up / down)),)

    return bl.packed(run, x)[0]


def adx_block(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``adx_values`` of each column, bars with a missing value skipped."""

    def run(h: np.ndarray, lo: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        up, down, before = h - bl.lagged(h), bl.lagged(lo) - lo, bl.lagged(c)
        tr = np.maximum(np.maximum(h - lo, np.abs(h - before)), np.abs(lo - before))
        moves = tr, np.where(np.isnan(tr), np.nan, np.where((up > down) & (up > 0), up, 0.0)), np.where(np.isnan(tr), np.nan, np.where((down > up) & (down > 0), down, 0.0))
        sums = [np.full(h.shape, np.nan) for _ in moves]
        if len(h) > n:
            for s, x in zip(sums, moves, strict=True):
                s[n] = x[1 : n + 1].sum(axis=0)
                for i in range(n + 1, len(h)):
                    s[i] = s[i - 1] - s[i - 1] / n + x[i]
        s, p, m = sums
        plus, minus = (np.where(s > 0, 100 * x / s, np.where(np.isnan(s), np.nan, 0.0)) for x in (p, m))
        dx = np.where(plus + minus > 0, 100 * np.abs(plus - minus) / (plus + minus), np.where(np.isnan(plus), np.nan, 0.0))
        adx = np.full(h.shape, np.nan)
        adx[n:] = _wilder_block(dx[n:], n)
        return adx, plus, minus

    return bl.packed(run, high, low, close)


def psar_block(high: np.ndarray, low: np.ndarray, step: float = 0.02, most: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """``psar_values`` of each column, bars with a missing value skipped."""

    def run(h: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sar, trend = np.full(h.shape, np.nan), np.full(h.shape, np.nan)
        up, stop, extreme, speed = np.ones(h.shape[1], bool), lo[0], h[0], np.full(h.shape[1], step)
        sar[0], trend[0] = stop, 1
        for i in range(1, len(h)):
            stop = stop + speed * (extreme - stop)
            j = max(i - 2, 0)
            stop = np.where(up, np.minimum(np.minimum(stop, lo[i - 1]), lo[j]), np.maximum(np.maximum(stop, h[i - 1]), h[j]))
            turn = np.where(up, lo[i] < stop, h[i] > stop)
            far = ~turn & np.where(up, h[i] > extreme, lo[i] < extreme)
            stop = np.where(turn, extreme, stop)
            speed = np.where(turn, step, np.where(far, np.minimum(speed + step, most), speed))
            up = up ^ turn
            extreme = np.where(turn | far, np.where(up, h[i], lo[i]), extreme)
            sar[i], trend[i] = stop, np.where(up, 1.0, -1.0)
        return sar, trend

    return bl.packed(run, high, low)


PANEL = ("ema", "macd", "macd_signal", "macd_hist", "rsi", "adx", "plus_di", "minus_di", "wilder_atr", "psar", "psar_trend")


def recursive_panel(bars: DataFrame, rsi: int = 14, adx: int = 14, fast: int = 12, slow: int = 26, signal: int = 9, span: int = 20, wilder: int = 14, only: tuple[str, ...] = PANEL, keep: list[str] | None = None) -> DataFrame:
    """EMA, MACD, RSI, ADX, Wilder ATR and parabolic SAR (or ``only`` some) of each entity beside ``keep``, in one pass over blocks of entities."""
    if fast >= slow:
        raise ValueError("fast must be less than slow")

    def run(block: bl.Block) -> bl.Block:
        high, low, close = (block[c] for c in ("high", "low", "close"))
        out = {}
        if {"macd", "macd_signal", "macd_hist"} & set(only):
            macd = ema_block(close, fast) - ema_block(close, slow)
            line = ema_block(macd, signal)
            out |= {"macd": macd, "macd_signal": line, "macd_hist": macd - line}
        if {"adx", "plus_di", "minus_di"} & set(only):
            out |= dict(zip(("adx", "plus_di", "minus_di"), adx_block(high, low, close, adx), strict=True))
        if {"psar", "psar_trend"} & set(only):
            out |= dict(zip(("psar", "psar_trend"), psar_block(high, low), strict=True))
        if "ema" in only:
            out["ema"] = ema_block(close, span)
        if "rsi" in only:
            out["rsi"] = rsi_block(close, rsi)
        if "wilder_atr" in only:
            before = bl.lagged(close)
            out["wilder_atr"] = wilder_block(np.maximum(np.maximum(high - low, np.abs(high - before)), np.abs(low - before)), wilder)
        return {n: out[n] for n in only}

    return bl.per_block(bars, run, ["high", "low", "close"], list(only), keep=keep)

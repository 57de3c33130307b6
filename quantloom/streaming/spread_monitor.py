"""Stateful spread monitor: a warm-up baseline, then a two-sided CUSUM with one alert for each crossing."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "n long, mean double, m2 double, up double, down double, above boolean"
OUT = "label string, ts timestamp, value double, z double, up double, down double, alert string"


def new_state() -> tuple:
    return (0, 0.0, 0.0, 0.0, 0.0, False)


def update(state: tuple, value: float, warmup: int, slack: float, threshold: float) -> tuple[tuple, tuple]:
    """The next state, and (z, up, down, alert) of one value; Welford's sums until ``warmup``, then frozen."""
    n, mean, m2, up, down, above = state
    if n < warmup:
        n += 1
        delta = value - mean
        mean += delta / n
        m2 += delta * (value - mean)
        return (n, mean, m2, up, down, above), (None, up, down, None)
    std = (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
    z = (value - mean) / std if std > 0 else 0.0
    up, down = max(0.0, up + z - slack), max(0.0, down - z - slack)
    over = max(up, down) > threshold
    alert = ("up" if up >= down else "down") if over and not above else None
    return (n, mean, m2, up, down, over), (z, up, down, alert)


def channel(df: DataFrame, kind: str) -> DataFrame:
    """``value`` of ``label, ts, leg_a, leg_b[, years]``: ``relative_bps``, ``annualized_bps`` or ``absolute_points``."""
    if kind == "absolute_points":
        return df.withColumn("value", F.col("leg_a") - F.col("leg_b"))
    bps = (F.col("leg_a") / F.col("leg_b") - 1) * 1e4
    if kind == "relative_bps":
        return df.withColumn("value", bps)
    if kind == "annualized_bps":
        return df.withColumn("value", bps / F.nullif("years", F.lit(0.0)))
    raise ValueError(f"unknown channel {kind!r}")


def monitor(df: DataFrame, warmup: int = 30, slack: float = 0.5, threshold: float = 9.0) -> DataFrame:
    """Rows of ``label, ts, value`` (a stream or a table) with the monitor's values; state is kept for each label."""

    def run(rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
        rows = rows.sort_values("ts", kind="stable")
        out = []
        for value in rows["value"]:
            if pd.isna(value):
                out.append((None, state[3], state[4], None))
                continue
            state, seen = update(state, float(value), warmup, slack, threshold)
            out.append(seen)
        made = pd.DataFrame(out, columns=["z", "up", "down", "alert"], index=rows.index)
        return pd.concat([rows[["label", "ts", "value"]], made.astype({"z": float, "up": float, "down": float, "alert": object})], axis=1), state

    rows = df.select(F.col("label").cast("string"), F.col("ts").cast("timestamp"), "value")
    if not df.isStreaming:
        return rows.groupBy("label").applyInPandas(lambda p: run(p, new_state())[0], OUT)

    def step(key: Any, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(held.get) if held.exists else new_state()
        parts = list(batches)
        out, state = run(pd.concat(parts), state)
        held.update(state)
        yield out

    return rows.groupBy("label").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, late: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts and means of ``symbol, ts, price`` in tumbling or sliding windows, with a watermark for late rows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "symbol").agg(F.count("*").alias("n"), F.avg("price").alias("mean_price")).select("symbol", F.col("w.start").alias("start"), "n", "mean_price")


def sessions(stream: DataFrame, late: str, gap: str) -> DataFrame:
    """Sessions of each symbol that end after ``gap`` without rows."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "symbol").agg(F.count("*").alias("n")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

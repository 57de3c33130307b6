"""Exact quantiles of whole columns with bounded memory."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a sketch, and distinct values of all brackets together that are brought to the driver.
ACCURACY, VALUES = 20_000, 200_000


def stored(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept on the executors' disks until it is no longer used; its partitioning and order stay."""
    return df.localCheckpoint(True, StorageLevel.DISK_ONLY)


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Interpolated quantiles of each column, missing values left out (all missing: None); the same values as ``percentile``.

    ``percentile`` brings every distinct value of a column into one task.  Here
    a sketch brackets the ranks, the values below each bracket are counted, and
    only those inside come to the driver; a bracket that is still too wide is
    sketched again, one that misses its ranks is widened to the whole column.
    """
    found: dict[tuple[str, float], float | None] = {}
    # Bounds of each column and quantile (None: open).
    todo: dict[tuple[str, float], tuple[float | None, float | None]] = {(c, q): (None, None) for c, qs in wanted.items() for q in qs}
    margin = dict.fromkeys(todo, 4 / ACCURACY)

    def inside(c: str, bounds: tuple[float | None, float | None]):
        ok = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        lo, hi = bounds
        ok = ok & (F.col(c) >= lo) if lo is not None else ok
        return ok & (F.col(c) <= hi) if hi is not None else ok

    first = True
    totals: dict[str, int] = {}
    while todo:
        keys = list(todo)
        counts = []
        for i, (c, q) in enumerate(keys):
            lo, _ = todo[c, q]
            counts += [F.count_if(inside(c, todo[c, q])).alias(f"n{i}"), (F.count_if(inside(c, (None, None)) & (F.col(c) < lo)) if lo is not None else F.lit(0)).alias(f"b{i}"), F.approx_count_distinct(F.when(inside(c, todo[c, q]), F.col(c)), 0.05).alias(f"d{i}")]
            if first:
                counts.append(F.percentile_approx(F.when(inside(c, (None, None)), F.col(c).cast("double")), [max(q - margin[c, q], 0.0), min(q + margin[c, q], 1.0)], ACCURACY).alias(f"s{i}"))
        row = df.agg(*counts).first()
        collect = []
        for i, (c, q) in enumerate(keys):
            n, below, distinct = row[f"n{i}"], row[f"b{i}"], row[f"d{i}"]
            if first:
                totals[c] = n
            if not totals[c]:
                found[c, q] = None
                del todo[c, q]
                continue
            place = q * (totals[c] - 1)
            low, high = math.floor(place), math.ceil(place)
            if not below <= low or not high < below + n:  # the sketch was off
                todo[c, q], margin[c, q] = (None, None), margin[c, q] * 8
                below, n, distinct = 0, totals[c], VALUES + 1
            if distinct * 1.2 <= VALUES / len(keys):
                collect.append((i, c, q, place, below))
            elif first:
                todo[c, q] = tuple(row[f"s{i}"])
            else:
                # Sketch the bracket's own values around the rank's place in it.
                p = (place - below) / max(n - 1, 1)
                bounds = df.where(inside(c, todo[c, q])).agg(F.percentile_approx(F.col(c).cast("double"), [max(p - margin[c, q], 0.0), min(p + margin[c, q], 1.0)], ACCURACY).alias("s")).first().s
                if tuple(bounds) == todo[c, q]:
                    raise ValueError(f"{c}: no bracket of {VALUES} values around quantile {q}")
                todo[c, q] = tuple(bounds)
        if collect:
            tagged = F.array_compact(F.array(*(F.when(inside(c, todo[c, q]), F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x"))) for i, c, q, _, _ in collect)))
            values: dict[int, list[tuple[float, int]]] = {}
            for r in df.select(F.explode(tagged).alias("t")).groupBy("t.i", "t.x").agg(F.count("*").alias("k")).collect():
                values.setdefault(r.i, []).append((r.x, r.k))
            for i, c, q, place, below in collect:
                low, high = math.floor(place), math.ceil(place)
                at, pair = below, {}
                for x, k in sorted(values.get(i, [])):
                    for rank in (low, high):
                        if at <= rank < at + k:
                            pair[rank] = x
                    at += k
                found[c, q] = pair[low] if low == high else (high - place) * pair[low] + (place - low) * pair[high]
                del todo[c, q]
        first = False
    return {c: [found[c, q] for q in qs] for c, qs in wanted.items()}

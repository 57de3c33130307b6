"""Operator 8: document fingerprints from closed syncmers.

A run of ``K`` code points is an anchor if the least of its inner runs of
``S`` lies at its first or last place: a rule that looks at nothing outside
the run, so a stretch that two texts share has the same anchors in both, at
the same distances (``anchors``, ``offset`` for positional matching).  At least
one of any ``K - S + 1`` runs in a row is an anchor.  A fingerprint is the
``SIZE`` least hashes of a text's anchors; the likeness of two fingerprints is
the share of the least hashes of both that both have.

For the neighbour in descending order of ids, documents are dealt by ranges of
ids whose ends are ids of the table; the first document of each range is also
sent to the range before it.  Texts move once.

Defined results: null text is empty; texts under ``K`` code points are one
anchor; empty texts have an empty fingerprint, of likeness 1 to each other and
0 to others; rows with null ids come last; rows with equal ids follow in order
of their texts; one row alone is its own next; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix64, shuffle_partitions
from .near_duplicates import step
from .passages import sliding_minimum

K, S = 12, 5
SHORT, SHORT_K, SHORT_S = 32, 4, 2  # for texts under SHORT code points
SIZE = 64
_LEAST = -(2**63)  # stands for a null id


def _runs(codes: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(codes) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x100000001B3) + codes[i : len(codes) - k + 1 + i]
    return mix64(out + step(k))


def anchors(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's closed syncmers."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    k, s = (K, S) if len(codes) >= SHORT else (SHORT_K, SHORT_S)
    if len(codes) < k:
        return np.zeros(min(1, len(codes)), np.int64), _runs(codes, len(codes))[:1] if len(codes) else codes
    inner = _runs(codes, s)
    width = k - s + 1
    least = sliding_minimum(inner, width)
    places = np.flatnonzero((inner[: len(least)] == least) | (inner[width - 1 :] == least))
    hashes = np.zeros(len(places), np.uint64)
    for i in range(k):
        hashes = hashes * np.uint64(0x100000001B3) + codes[places + i]
    return places, mix64(hashes + step(k))


def offset(a: str | None, b: str | None) -> tuple[int, int]:
    """The distance at which most anchors of ``a`` recur in ``b``, and how many do; (0, 0) for none."""
    (pa_, ha), (pb, hb) = anchors(a), anchors(b)
    ua, ia = np.unique(ha, return_index=True)
    ub, ib = np.unique(hb, return_index=True)
    _, x, y = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if not len(x):
        return 0, 0
    value, n = np.unique(pb[ib[y]] - pa_[ia[x]], return_counts=True)
    return int(value[n.argmax()]), int(n.max())


def sketch(text: str | None) -> np.ndarray:
    """The ``SIZE`` least hashes of a text's anchors, in 32 bits, rising."""
    hashes = np.unique((anchors(text)[1] >> np.uint64(32)).astype(np.uint32))
    return hashes[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the anchors behind two sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[: max(min(SIZE, len(a) + len(b)), 1)]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def written(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u4").tobytes()).decode()


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of each row.

    The edited text: the last third of a text replaced by the beginning of the
    next document's, in descending order of ids; the first follows the last.
    """
    spark = docs.sparkSession
    n_ranges = 8 * shuffle_partitions(spark)
    order = F.coalesce("doc_id", F.lit(_LEAST))
    shares = [(i + 1) / n_ranges for i in range(n_ranges)]
    found = docs.agg(F.percentile_approx(order, shares, max(10_000, 20 * n_ranges)).alias("q"), F.max(order).alias("most")).first()
    cuts = np.array(sorted({*(found.q or []), *([found.most] if found.most is not None else [])}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "after", "place", "doc_id", "text", "print"]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            prints = [sketch(t).tobytes() for t in texts]
            keys = np.array([_LEAST if i is None else i for i in ids], np.int64)
            own = np.searchsorted(cuts, keys)
            # The first of a range, in descending order, also follows the last of the range above; the very first follows the very last.
            again = np.flatnonzero(cuts[np.minimum(own, len(cuts) - 1)] == keys)
            take = np.concatenate([np.arange(len(ids)), again])
            ranges = np.concatenate([own, (own[again] + 1) % len(cuts)])
            after = np.arange(len(take)) >= len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ranges.astype(np.int32)), pa.array(after), pa.array(keys[take]), pa.array([ids[i] for i in take.tolist()], pa.int64()), pa.array([texts[i] for i in take.tolist()], pa.string()), pa.array([prints[i] for i in take.tolist()], pa.binary())],
                names,
            )

    dealt = arrow_map(docs.select("doc_id", "text"), deal, "range int, after boolean, place long, doc_id long, text string, print binary")
    dealt = dealt.repartition(shuffle_partitions(spark), "range").sortWithinPartitions("range", "after", F.desc("place"), "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        before = None  # the row that waits for the one after it
        for batch in batches:
            rows = []
            for here, after, doc, text, mark in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
                mark = np.frombuffer(mark, np.uint32)
                if before is not None and before[0] == here:
                    _, id_, own, fingerprint = before
                    n = len(own) // 3
                    edited = own[: len(own) - n] + text[:n]
                    changed = sketch(edited) if n else fingerprint
                    rows.append((id_, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(fingerprint), written(changed), likeness(fingerprint, changed), likeness(fingerprint, mark)))
                before = None if after else (here, doc, text, mark)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return arrow_map(
        dealt.select("range", "after", "place", "doc_id", "text", "print"), compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )

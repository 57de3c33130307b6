"""Operator 6: benchmark passages in documents, by n-gram seeds and alignment.

Every run of ``GRAM`` words of the benchmark is looked up in every document,
however many documents hold it.  A document with two runs of an item near one
diagonal (one, if the item is short) is aligned with it (Smith-Waterman over
words: match 2, mismatch -1, gap -1), unless too few words of the item occur
there for a copy.  The score is the share of the highest that the item allows;
``SCORE`` or a common run of ``RUN`` words counts as a copy.

The benchmark is a stated query set: it is read in blocks of ``BLOCK_CHARS``
characters, each broadcast and held against all documents in one pass.  Only
the copies found move.

Defined results: null or wordless texts match nothing; an item of fewer than
``GRAM`` words is one run; rows with equal item or document ids count as one
each, and the best score stays; rows with null ids are left out; other columns
are not read; an empty benchmark gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, shingle_hashes, word_hashes, words_of, worker_table
from .near_duplicates import _slices

GRAM = 4
SCORE, RUN = 0.5, 13
BLOCK_CHARS = 32_000_000
_NEAR = 12  # diagonals that count as one


class Index:
    """The runs of a block of items: sorted hashes, and (item, place) of each."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words = {i: word_hashes(words_of(t)) for i, t in items}
        grams, owners = [], []
        for item, words in self.words.items():
            g = shingle_hashes(words, GRAM)
            grams.append(g)
            owners.append(np.stack([np.full(len(g), item, np.int64), np.arange(len(g))], 1))
        grams, owners = (np.concatenate(x) if x else np.zeros(0) for x in (grams, owners))
        order = np.argsort(grams, kind="stable")
        self.grams, self.owners = grams[order].astype(np.uint64), owners[order]
        #: Items under GRAM words are one run of their length: such lengths are looked up too.
        self.lengths = sorted({min(len(w), GRAM) for w in self.words.values() if len(w)})

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``words``, hashes and lengths of the runs that some item has."""
        at, found, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for length in self.lengths:
            if len(words) < length:
                continue
            g = shingle_hashes(words, length)
            i = np.searchsorted(self.grams, g)
            here = np.flatnonzero(self.grams[np.minimum(i, len(self.grams) - 1)] == g)
            at.append(here)
            found.append(g[here])
            sizes.append(np.full(len(here), length))
        return np.concatenate(at), np.concatenate(found), np.concatenate(sizes)


def _index(items: tuple[tuple[int, str], ...]) -> Index:
    return worker_table(("index", items), lambda: Index(list(items)))


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local score, and begin and end of its stretch of ``text``."""
    m = len(text)
    steps = np.arange(m + 1)
    score, begin = np.zeros(m + 1, np.int64), steps.copy()
    best = (0, 0, 0)
    for word in item:
        side = np.where(text == word, 2, -1)
        new, source = np.zeros(m + 1, np.int64), steps.copy()
        diagonal, up = score[:-1] + side, score[1:] - 1
        new[1:] = np.maximum(np.maximum(diagonal, up), 0)
        source[1:] = np.where(new[1:] == 0, steps[1:], np.where(diagonal >= up, begin[:-1], begin[1:]))
        # A gap in the item costs 1 a word: the best cell to the left, less its distance.
        reach = np.maximum.accumulate((new + steps) * (m + 2) + steps)
        cell = reach % (m + 2)
        score, begin = new[cell] - (steps - cell), source[cell]
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (int(score[j]), int(begin[j]), j)
    return best


def longest_run(item: np.ndarray, text: np.ndarray) -> int:
    """Words of the longest common run."""
    best, before = 0, np.zeros(len(text) + 1, np.int64)
    for word in item:
        now = np.zeros_like(before)
        now[1:] = np.where(text == word, before[:-1] + 1, 0)
        best, before = max(best, int(now.max())), now
    return best


def copies_in(index: Index, words: np.ndarray, at: np.ndarray, grams: np.ndarray) -> list[tuple[int, float, int, int, int]]:
    """(item, score, begin word, end word, longest run) of the items that ``words`` copies; the best place of each.

    ``at``, ``grams``: the hits of ``words``.
    """
    low, high = np.searchsorted(index.grams, grams, "left"), np.searchsorted(index.grams, grams, "right")
    n = high - low
    owners = index.owners[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    items, offsets = owners[:, 0], owners[:, 1]
    diagonals = np.repeat(at, n) - offsets
    order = np.lexsort((offsets, diagonals, items))
    items, diagonals, offsets = items[order], diagonals[order], offsets[order]
    # Groups: hits of one item whose diagonals follow each other within _NEAR.
    cuts = np.flatnonzero((np.diff(items) != 0) | (np.diff(diagonals) > _NEAR)) + 1
    near: dict[int, list[tuple[int, int]]] = {}
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(items)], strict=True):
        item = int(items[begin])
        if end - begin >= 2 and (offsets[begin:end] != offsets[begin]).any() or len(index.words[item]) < 2 * GRAM:
            near.setdefault(item, []).append((int(diagonals[begin]), int(diagonals[end - 1])))
    out = []
    for item, groups in near.items():
        own = index.words[item]
        best: tuple[float, int, int, int] | None = None
        done = set()
        for first, last in groups:
            low = max(0, first - len(own) // 4 - 2)
            high = min(len(words), last + len(own) + len(own) // 4 + 2)
            part = words[low:high]
            if (seen := part.tobytes()) in done:
                continue
            done.add(seen)
            # Neither the matches nor the longest run can be more than the words of the item that occur here.
            if np.isin(own, part).sum() < min(SCORE * len(own), RUN):
                continue
            score, begin, end = smith_waterman(own, part)
            share = score / (2 * len(own))
            run = longest_run(own, part)
            if (share >= SCORE or run >= RUN) and (best is None or share > best[0]):
                best = (share, low + begin, low + end, run)
        if best is not None:
            out.append((item, *best))
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks; one block is in the driver's memory at a time."""
    block, chars = [], 0
    for row in benchmark.where("item_id is not null and text is not null").groupBy("item_id", "text").count().toLocalIterator():
        block.append((row.item_id, row.text))
        chars += len(row.text)
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def copies_of(index: Index, texts: list[str | None]) -> Iterator[tuple[int, tuple[int, float, int, int, int]]]:
    """(place of the text, what ``copies_in`` gives for it) for every copy of an item in ``texts``."""
    for begin, end in _slices(texts, 2_000_000):
        parts = [word_hashes(words_of(t)) for t in texts[begin:end]]
        n = np.array([len(p) for p in parts])
        owner = np.repeat(np.arange(len(parts)), n)
        start = np.cumsum(n) - n
        at, grams, sizes = index.hits(np.concatenate(parts))
        # Runs that go over the end of a text are none of its own.
        inside = owner[at] == owner[at + sizes - 1]
        at, grams = at[inside], grams[inside]
        order = np.argsort(at, kind="stable")
        at, grams = at[order], grams[order]
        hit, firsts = np.unique(owner[at], return_index=True)
        bounds = [*firsts.tolist(), len(at)]
        for t, i, j in zip(hit.tolist(), bounds[:-1], bounds[1:], strict=True):
            for x in copies_in(index, parts[t], at[i:j] - start[t], grams[i:j]):
                yield begin + t, x


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, score, begin_word, end_word, run``: a row for each document and item it copies."""
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    schema = "doc_id long, item_id long, score double, begin_word int, end_word int, run int"
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark):
        items = spark.sparkContext.broadcast(tuple(block))

        def look(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = _index(items.value)
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[t], *x) for t, x in copies_of(index, batch.column(1).to_pylist())]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "score", "begin_word", "end_word", "run"])

        out = out.unionByName(arrow_map(texts, look, schema))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "begin_word", "end_word", "run")).alias("x"))
    return best.select("doc_id", "item_id", "x.score", "x.begin_word", "x.end_word", "x.run")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text copies an item, whatever their ids; all columns as they are.

    The blocks of items follow each other in one pass: no join, no second scan.
    """
    place = docs.columns.index("text")
    for block in _blocks(benchmark):
        items = docs.sparkSession.sparkContext.broadcast(tuple(block))

        def clean(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = _index(items.value)
            for batch in batches:
                gone = np.zeros(batch.num_rows, bool)
                for t, _ in copies_of(index, batch.column(place).to_pylist()):
                    gone[t] = True
                yield batch.filter(pa.array(~gone))

        docs = arrow_map(docs, clean, docs.schema)
    return docs

"""Operator 2: near-duplicate documents by BagMinHash, banding and verification.

A document is the multiset of its runs of ``SHINGLE`` words.  BagMinHash gives
each shingle a hierarchy of Poisson processes over its discretised weight: one
process for the weights [0, 1), one for each [2^k, 2^(k+1)).  A point counts
where its weight lies below the shingle's; the earliest point of each of
``ROWS * BANDS`` registers is the signature, so that two documents agree in a
register with the probability of their weighted Jaccard similarity.  Points
are drawn in order of time, and a process ends once it is past the latest
register of its document.

Equal texts are one node from the start.  Documents that agree in all rows of
a band meet in a bucket (a pair at similarity 0.8 in none with a chance below
1e-7), and all of a bucket are compared with its least document.  That puts
most groups of copies into one class without making their pairs.  What still
lies in several classes is then gone through in blocks of about ``BLOCK``
documents: pairs from two classes that share a bucket, and whose signatures
agree in ``AGREE`` registers (one at similarity 0.8 does not with a chance of
4e-5), are compared until they are in one class.  Comparison is exact, on the
multisets of both texts.

Defined results: null or wordless texts equal only the same text; texts under
``SHINGLE`` words are one shingle; rows with equal ids are one document, of the
least of their texts; rows
with a null id are kept, with a null class; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, forgotten, materialize, mix64, one_text_each, release, shingle_hashes, text_key, word_hashes, words_of
from .components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 4, 32
AGREE = 84
BLOCK, FAMILY = 256, 20_000
#: Ids (8 bytes each) that are broadcast at most; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 2.0**-53


def step(i: int) -> np.uint64:
    return np.uint64(i * int(_GOLD) & 0xFFFFFFFFFFFFFFFF)


def bag_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """Signatures (n_docs, size) of weighted sets given as rows (document, element hash, whole weight)."""
    registers = np.full((n_docs, size), np.inf)
    flat = registers.reshape(-1)
    # One process for each element and block of weights that begins below its weight.
    parts, low, k = [], 0, 0
    while len(element) and (here := weight > low).any():
        width = max(1, low)
        parts.append((doc[here], mix64(element[here] + step(k)), weight[here], np.full(here.sum(), low), np.full(here.sum(), width)))
        low, k = low + width, k + 1
    if not parts:
        return registers
    doc, key, weight, low, width = (np.concatenate(x) for x in zip(*parts, strict=True))
    time, turn = np.zeros(len(doc)), 0
    while len(doc):
        turn += 1
        draw = mix64(key + step(turn))
        time = time - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * _UNIT) / width
        draw = mix64(draw)
        counts = low + width * ((draw >> np.uint64(32)).astype(np.float64) * 2.0**-32) < weight
        at = doc * size + (draw & np.uint64(0xFFFFFFFF)).astype(np.int64) % size
        np.minimum.at(flat, at[counts], time[counts])
        goes_on = time < registers.max(axis=1)[doc]
        doc, key, weight, low, width, time = (x[goes_on] for x in (doc, key, weight, low, width, time))
    return registers


def _bags(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for text in texts:
        yield np.unique(shingle_hashes(word_hashes(words_of(text)), SHINGLE), return_counts=True)


def signatures(texts: list[str | None]) -> tuple[list[np.ndarray], list[bytes]]:
    """Keys of the ``BANDS`` bands of each text, and its registers in 16 bits; none for a text without words."""
    out: list[np.ndarray] = []
    registers: list[bytes] = []
    for begin, end in _slices(texts, 1_000_000):
        bags = list(_bags(texts[begin:end]))
        n = [len(h) for h, _ in bags]
        doc = np.repeat(np.arange(len(bags)), n)
        signature = bag_min_hash(doc, np.concatenate([h for h, _ in bags]), np.concatenate([c for _, c in bags]), len(bags), ROWS * BANDS)
        bits = mix64(signature.view(np.uint64))
        short = bits.astype(np.uint16)
        bits = bits.reshape(len(bags), BANDS, ROWS)
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, (len(bags), BANDS)).copy()
        for r in range(ROWS):
            keys = mix64(keys * np.uint64(31) + bits[:, :, r])
        out += [keys[i].view(np.int64) if n[i] else np.zeros(0, np.int64) for i in range(len(bags))]
        registers += [short[i].tobytes() if n[i] else b"" for i in range(len(bags))]
    return out, registers


def band_keys(texts: list[str | None]) -> list[np.ndarray]:
    return signatures(texts)[0]


def _slices(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters, at least one text each."""
    begin = total = 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= chars:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


@lru_cache(maxsize=64)
def _bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return next(_bags([text]))


forgotten(_bag.cache_clear)


def similarity(a: str | None, b: str | None) -> float:
    """Weighted Jaccard similarity of the shingle multisets; 0 where either has none and the texts differ."""
    if (a or "") == (b or ""):
        return 1.0
    return overlap(_bag(a), _bag(b))


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets, given as sorted values and their counts; 0 where one is empty."""
    (ha, ca), (hb, cb) = a, b
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[i], cb[j]).sum())
    return both / (int(ca.sum() + cb.sum()) - both) if both else 0.0


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs(a, b, ...)`` with ``text_a`` and ``text_b``; rows of one ``b`` come together."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b")


def only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts(doc_id, text)`` whose id is in ``ids(doc_id)``."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("text_a"), batch.column("text_b")
            close = [similarity(x.as_py(), y.as_py()) >= least for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(close, pa.bool_()))

    return arrow_map(with_texts(pairs, texts).select("a", "b", "text_a", "text_b"), run, "a long, b long")


def _across(buckets: DataFrame, pairs: DataFrame, roots: DataFrame, signed: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links ``a, b`` between classes that share a bucket, as many as join all of them that are linked.

    Documents that meet in buckets, by chains, are a family; one with several
    classes is dealt to blocks, and every two blocks meet in one group.  (A
    family of more than ``FAMILY`` documents is dealt bucket by bucket.)  In a
    group, pairs of two classes that share a bucket and whose signatures agree
    are compared, until they are in one class.  So a group is bounded, rows
    grow with the documents times the blocks, and only links leave it.
    """
    families = materialize(connected_components(pairs), "families").select(F.col("id").alias("node"), F.col("root").alias("family"))
    placed = families.join(roots.select(F.col("id").alias("node"), "root"), "node", "left").select("node", "family", F.coalesce("root", "node").alias("root"))
    open_ = placed.groupBy("family").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where("r0 < r1")
    rows = placed.join(open_.select("family", "n"), "family")
    small = rows.where(F.col("n") <= FAMILY).select("node", "root", F.col("family").alias("meeting"), "n", F.lit(False).alias("bucketed"))
    large = rows.where(F.col("n") > FAMILY).select("node", "root").join(buckets, "node")
    sizes = large.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1")
    large = large.join(sizes.select("bucket", "n"), "bucket").select("node", "root", F.col("bucket").alias("meeting"), "n", F.lit(True).alias("bucketed"))
    rows = small.unionByName(large).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    registers = signed.select(F.col("doc_id").alias("node"), "bands", "registers").join(rows.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    rows = rows.join(registers, "node").join(texts.withColumnRenamed("doc_id", "node"), "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", "meeting"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucketed", "meeting", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "root", "bands", "registers", "text")

    def meet(group: pa.Table) -> pa.Table:
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        block, node = group.column("block").to_numpy(), group.column("node").to_numpy()
        root = group.column("root").to_numpy().copy()
        bands = np.stack(group.column("bands").to_numpy())
        registers = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(len(node), -1)
        text, bags = group.column("text"), {}

        def bag(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in bags:
                bags[i] = next(_bags([text[i].as_py()]))
            return bags[i]

        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        found: list[tuple[int, int]] = []
        for i in left.tolist():
            js = right[root[right] != root[i]]
            if x == y:
                js = js[js > i]
            js = js[(registers[js] == registers[i]).sum(axis=1) >= AGREE]
            js = js[(bands[js] == bands[i]).any(axis=1)]
            for j in js.tolist():
                if root[i] != root[j] and overlap(bag(i), bag(j)) >= least:
                    found.append((int(max(node[i], node[j])), int(min(node[i], node[j]))))
                    root[root == root[j]] = root[i]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("bucketed", "meeting", "x", "y").applyInArrow(meet, "a long, b long")


def near_duplicate_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, class_size, keep``: a row for each row of ``docs``.

    Class: documents joined by chains of similarity ``least`` or more;
    ``class_id`` is its least id, and ``keep`` marks that document.
    """
    spark = docs.sparkSession
    texts = one_text_each(docs)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, registers = signatures(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(registers, pa.binary())], ["doc_id", "same", "bands", "registers"])

    signed = materialize(arrow_map(texts.select("doc_id", text_key().alias("same"), "text"), sign, "doc_id long, same string, bands array<long>, registers binary"), "signatures")
    nodes = signed.groupBy("same").agg(F.min("doc_id").alias("node"))
    copies = materialize(signed.select("doc_id", "same").join(nodes, "same").select("doc_id", "node").distinct(), "copies")
    buckets = signed.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket")).distinct()
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("bucket")
    buckets = materialize(buckets.join(shared, "bucket").select("bucket", "node"), "buckets")
    some = only(texts, buckets.select(F.col("node").alias("doc_id")).distinct())
    some = materialize(some, "texts")

    centres = buckets.groupBy("bucket").agg(F.min("node").alias("centre"))
    pairs = materialize(buckets.join(centres, "bucket").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")
    links = materialize(_verified(pairs, some, least), "links")
    roots = materialize(connected_components(links), "roots")
    links = links.unionByName(materialize(_across(buckets, pairs, roots, signed, some, least), "links"))
    roots = materialize(connected_components(links), "roots")

    classes = copies.join(roots, copies.node == roots.id, "left").select("doc_id", F.coalesce("root", "node").alias("class_id"))
    classes = classes.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    sizes = docs.select("doc_id").join(classes, "doc_id").groupBy("class_id").agg(F.count("*").alias("class_size"))
    out = docs.select("doc_id").join(classes, "doc_id", "left").join(sizes, "class_id", "left")
    return out.select("doc_id", "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"), F.expr("doc_id is null or doc_id = class_id").alias("keep"))


def drop_near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows that ``near_duplicate_classes`` does not keep; of rows with an equal id one of the least text stays.

    Rows with a null id stay.  All columns are kept as they are.
    """
    gone = near_duplicate_classes(docs, least).where("not keep").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    repeated = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        release(repeated)
        return left.select(*docs.columns)
    # An aggregate and not a window, so that a repeated id is summed before it is shuffled.
    every = F.struct(*(F.col(c) for c in docs.columns))
    one = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(every, F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(one)

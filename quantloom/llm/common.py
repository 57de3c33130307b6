"""Shared pieces of the text operators: scratch tables, hashing, word handling."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, SparkSession] = {}
#: Settings of a session that ``arrow_map`` and ``materialize`` use.
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where a session has none and runs on this machine alone (tests,
    notebooks) a folder of this machine is made; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quantloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage with files that every executor can read again after
    a loss, and keeps a table that several branches use from being made twice.
    The shuffle files of the write go when it ends: nothing else reads them.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quantloom-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(path: str) -> None:
    spark = _made.pop(path, None)
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may be gone at exit
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` of which nothing is read any more."""
    for table in tables:
        _delete(table._scratch_path)


def scratch_tables() -> frozenset[str]:
    """The tables of ``materialize`` that are there now."""
    return frozenset(_made)


def release_scratch(*keep: DataFrame, older: frozenset[str] = frozenset()) -> None:
    """Delete the tables that ``materialize`` has written, but for ``keep`` and ``older``."""
    for path in {*_made} - older - {k._scratch_path for k in keep}:
        _delete(path)


atexit.register(release_scratch)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(f, schema)`` with bounded memory.

    Batches that Spark sends are kept to 2 MB (one row at least): the session's
    limit is lowered to that if it is higher.  When a task ends, what its worker
    remembers of texts is forgotten, since the process serves later tasks.
    """
    conf = df.sparkSession.conf
    if _bytes(conf.get(_BATCH, "64m")) > _BATCH_BYTES:
        conf.set(_BATCH, str(_BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            forget()

    return df.mapInArrow(run, schema)


def _bytes(setting: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", setting.strip().lower()).groups()
    n = int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[unit[:1]]
    return n if n > 0 else 1 << 62


#: Called when a task ends.
_forgets: list[Callable[[], None]] = []


def forgotten(clear: Callable[[], None]) -> None:
    """Have ``clear`` called when a task of ``arrow_map`` ends."""
    _forgets.append(clear)


def forget() -> None:
    for clear in _forgets:
        clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems than glibc's
        ctypes.CDLL(None).malloc_trim(0)


_table: list = [None, None]


def worker_table(key, make: Callable):
    """What ``make`` gives, kept by the worker process for later tasks until another key is asked for.

    So of the large tables of all operators a worker holds one at a time.
    """
    if _table[0] != key:
        _table[:] = None, None
        _table[:] = key, make()
    return _table[1]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def one_text_each(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with every id once, without null ids; of rows with an equal id the least text stays (null as empty).

    Only the ids are counted over all rows; texts move where an id is repeated.
    """
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    repeated = materialize(texts.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        release(repeated)
        return texts
    one = texts.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return texts.join(repeated, "doc_id", "left_anti").unionByName(one)


WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of word characters; none for null."""
    return WORD.findall(text.lower()) if text else []


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 on 64-bit lanes (a bijection)."""
    x = x ^ (x >> _S33)
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


class Memo(dict):
    """Remembers what ``make`` gave for the last keys: the newest ``limit``, and those of the ``limit`` before.

    Keys asked for again move to the newest, so frequent ones stay.
    """

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 128:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


_GOLD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word (none empty): the mixed sum of its mixed code points and their places."""
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(lengths) - lengths
    place = (np.arange(len(codes)) - np.repeat(begins, lengths)).astype(np.uint64)
    return mix64(np.add.reduceat(mix64(place * _GOLD + codes), begins))


_word_characters: list[np.ndarray] = []


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes(words_of(text))`` of all texts in a row, and the number of each text's words; texts are cut together."""
    if not _word_characters:
        points = np.arange(0x110000, dtype=np.uint32)
        every = points.tobytes().decode("utf-32-le", "surrogatepass")
        _word_characters.append(np.isin(points, np.array([ord(c) for c in re.findall(r"\w", every)], np.uint32)))
    lower = [t.lower() if t else "" for t in texts]
    codes = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = _word_characters[0][codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    lengths = edges[1::2] - edges[::2]
    starts = np.cumsum([0, *(len(t) + 1 for t in lower)])
    numbers = np.diff(np.searchsorted(edges[::2], starts))
    if not len(lengths):
        return np.zeros(0, np.uint64), numbers
    begins = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(begins, lengths)
    return mix64(np.add.reduceat(mix64(place.astype(np.uint64) * _GOLD + codes[inside[1:-1]]), begins)), numbers


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; one hash of all words where there are fewer."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - k + 1 + i] + np.uint64(i + 1))
    return out


def text_key(col: str = "text"):
    """SHA-256 of a text (null as empty): equal keys mean equal texts."""
    return F.sha2(F.coalesce(F.col(col), F.lit("")), 256)

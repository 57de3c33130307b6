"""Operator 1: exact token counts at every prefix of a text.

The vocabulary is a sentencepiece BPE model.  Its merges never cross from a
non-space into a space (no piece holds a space after another character), so a
text falls into chunks ``spaces + word`` that are encoded independently.
Within a chunk a dynamic programme runs over prefixes: the encoding of prefix
``i`` ends in the one piece ``t`` for which (last piece of prefix ``i-len(t)``,
``t``) is a pair that BPE leaves alone, and its count is one more than that of
the shorter prefix.  So every prefix has its exact count, and truncation or
budget questions are lookups.

Rows: one Python pass over Arrow batches, no shuffle.  Defined results: null
text counts as empty (0 tokens); a text of spaces is one chunk; repeated rows
and rows with null ids give a row each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, worker_table

SPACE = "▁"
LONG = 64  # characters; states of longer chunks are not remembered


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Field number and value of each field of a serialised protocol buffer."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class PrefixCounter:
    """Token counts at every prefix under one sentencepiece BPE model.

    ``memo_limit`` bounds the prefixes that are remembered; it changes no result.
    """

    def __init__(self, model: bytes, memo_limit: int = 800_000):
        import struct

        self.rank: dict[str, int] = {}
        at = 0
        for field, value in _fields(model):
            if field != 1:
                continue
            piece, kind, score = "", 1, 0.0
            for f, v in _fields(value):
                if f == 1:
                    piece = v.decode()
                elif f == 2:
                    score = struct.unpack("<f", v)[0]
                elif f == 3:
                    kind = v
            if kind == 1:
                self.rank[piece] = (-score, at)
            at += 1
        order = sorted(self.rank, key=self.rank.get)
        self.rank = {p: i for i, p in enumerate(order)}
        if any(SPACE in p.lstrip(SPACE) for p in order):
            raise ValueError("a piece holds a space after another character; chunks would not be independent")
        self.longest = max(map(len, order), default=1)
        ends: dict[str, set[int]] = {}
        for p in order:
            ends.setdefault(p[-2:], {1}).add(len(p))
        #: Last two characters -> lengths of the pieces that end so, longest first.
        self.lengths = {e: tuple(sorted(n, reverse=True)) for e, n in ends.items()}
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.split: dict[str, tuple[str, str] | None] = {}
        #: Piece -> piece before it -> whether the pair is stable; and the same for characters without a piece.
        self.after: dict[str, dict[str, bool]] = {p: {} for p in order}
        self.bare: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.memo_limit = memo_limit
        self.states: dict[str, tuple[int, str]] = {"": (0, "")}  # prefix of a chunk -> its tokens and its last piece
        self.memo: dict[str, int] = _Counts(self)

    def merged(self, text: str) -> list[str]:
        """BPE by definition: merge the best-ranked adjacent pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, where = r, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def stable(self, left: str, right: str) -> bool:
        """Whether BPE of ``left + right`` gives these two pieces ("": none)."""
        pairs = self.after.get(right)
        if pairs is None:
            pairs = self.bare.setdefault(right, {})
        known = pairs.get(left)
        if known is None:
            if self.n_pairs >= 1_000_000:
                self.n_pairs = 0
                self.bare.clear()
                for kept in self.after.values():
                    kept.clear()
            self.n_pairs += 1
            known = pairs[left] = self.apart(left, right) if left else self.merged(right) == [right]
        return known

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that BPE last merges into ``piece``; None for a character."""
        if piece not in self.split:
            parts = list(piece)
            while len(parts) > 2:
                where = min((r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None)[1]
                parts[where : where + 2] = [parts[where] + parts[where + 1]]
            self.split[piece] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.split[piece]

    def apart(self, left: str, right: str) -> bool:
        """Whether no merge joins ``left`` and ``right``.

        Goes back through their merges, the later first, and looks whether at
        any moment the two pieces then touching had a merge that came before
        the next one on either side (at equal ranks, the left one).
        """
        rank, after = self.rank, None  # the merge that comes next at this moment: (rank, 0 in the left part, 1 in the right)
        while True:
            joint = rank.get(left + right)
            if joint is not None and (after is None or (joint, 0.5) < after):
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and (rank[left], 0) > (rank[right], 1):
                after, left = (rank[left], 0), a[1]
            else:
                after, right = (rank[right], 1), b[0]

    def chunk_count(self, chunk: str) -> int:
        """Tokens of ``chunk``; its prefixes share their states with those of other chunks."""
        states, n = self.states, len(chunk)
        if len(states) + n > self.memo_limit:
            states.clear()
            states[""] = 0, ""
        at = n
        while chunk[:at] not in states:
            at -= 1
        after, lengths = self.after, self.lengths
        for i in range(at + 1, n + 1):
            for size in lengths.get(chunk[i - 2 : i] if i > 1 else chunk[:1], (1,)):
                j = i - size
                if j < 0:
                    continue
                piece = chunk[j:i]
                pairs = after.get(piece)
                if pairs is not None:
                    count, left = states[chunk[:j]]
                    known = pairs.get(left)
                    if known if known is not None else self.stable(left, piece):
                        states[chunk[:i]] = count + 1, piece
                        break
                elif size == 1:
                    count, left = states[chunk[:j]]
                    if self.stable(left, piece):
                        states[chunk[:i]] = count + len(piece.encode("utf-8", "surrogatepass")), piece  # byte fallback
                        break
            else:
                raise AssertionError(f"no last piece for {chunk[:i]!r}")
        return states[chunk][0]

    def chunk_counts(self, chunk: str) -> list[int]:
        """Tokens of ``chunk[:i]`` for i = 0 .. len(chunk)."""
        if len(chunk) <= LONG:
            self.chunk_count(chunk)
            return [0, *(self.states[chunk[:i]][0] for i in range(1, len(chunk) + 1))]
        return self.long_counts(chunk)

    def long_counts(self, chunk: str) -> list[int]:
        """The same by arrays, for chunks whose prefixes are not worth remembering."""
        rank, longest, n = self.rank, self.longest, len(chunk)
        counts, last = [0] * (n + 1), [""] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):
                piece = chunk[j:i]
                if (piece in rank or j == i - 1) and self.stable(last[j], piece):
                    counts[i] = counts[j] + (1 if piece in rank else len(piece.encode("utf-8", "surrogatepass")))
                    last[i] = piece
                    break
            else:
                raise AssertionError(f"no last piece for {chunk[:i]!r}")
        return counts

    def normal(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def count(self, text: str | None) -> int:
        return sum(map(self.memo.__getitem__, self.chunk.findall(self.normal(text or ""))))

    def prefix_counts(self, text: str | None) -> list[int]:
        """Tokens of ``text[:i]`` for i = 0 .. len(text)."""
        text = text or ""
        out, base = [], 0
        for chunk in self.chunk.findall(self.normal(text)):
            counts = self.chunk_counts(chunk)
            out += [base + c for c in counts[1:]]
            base += counts[-1]
        # The first position is that of the space put before the text.
        return [0, *out[1:]]

    def fit(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix, of those that end a chunk or lie in the first one over, within ``budget`` tokens."""
        text = text or ""
        at, base = -1, 0
        for chunk in self.chunk.findall(self.normal(text)):
            c = self.memo[chunk]
            if base + c > budget:
                counts = self.chunk_counts(chunk)
                inside = max((i for i in range(len(chunk) + 1) if base + counts[i] <= budget), default=0)
                return max(0, at + inside)
            base += c
            at += len(chunk)
        return len(text)


class _Counts(dict):
    """Chunk -> tokens; forgets everything when it is full."""

    def __init__(self, owner: PrefixCounter):
        super().__init__()
        self.owner = owner

    def __missing__(self, chunk: str) -> int:
        if len(chunk) > LONG:
            return self.owner.long_counts(chunk)[-1]
        if len(self) >= self.owner.memo_limit // 2:
            self.clear()
        n = self[chunk] = self.owner.chunk_count(chunk)
        return n


def counter_of(model: bytes) -> PrefixCounter:
    """One counter for each worker process and model."""
    return worker_table(("counter", hash(model)), lambda: PrefixCounter(model))


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, fit_chars`` of each row of ``docs``.

    ``fit_chars``: characters of the text that fit in ``limit`` tokens.  The
    model file (half a megabyte) is read by the driver and broadcast.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model.value)
        for batch in batches:
            n_bytes, n_tokens, fit = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                n = counter.count(text)
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                n_tokens.append(n)
                fit.append(len(text) if n <= limit else counter.fit(text, limit))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fit, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")

"""Operator 3: BPE encoding and decoding with a lexicon automaton.

Frequent words are compiled with their ids into a minimal acyclic automaton:
words share prefixes and suffixes, and the sum of the numbers on a word's path
is its place in the table of ids.  The automaton is one block of bytes that
each worker maps into memory.  Words that it does not hold are merged exactly
by the ranks of the vocabulary, in n log n steps.  Which words are frequent changes no result.

The vocabulary is a ``tokenizers`` JSON file: NFC, white space, lower case; a
split into contractions, letters, single digits and other signs; bytes as
characters; an end-of-word suffix; special tokens matched in the raw text.

Rows: two Python passes over Arrow batches (count words, encode); only word
counts are shuffled, summed in each batch's worker first.  Defined results:
null text encodes as empty (no ids, empty decoded text); rows with repeated or
null ids give a row each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, arrow_map, worker_table

# Characters for which NFC is the identity, lower-casing is one to
# one and the classes of letters, digits and signs are as written here.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿŒœ“”‘’–—…«»¡¿€£§°·]*")
PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^\sa-zß-öø-ÿœ0-9]+")


#: Parts of a word up to which pairs are scanned and not queued; both ways give the same ids.
SCANNED = 64


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Automaton:
    """Minimal acyclic automaton over byte strings, with an id list for each.

    ``build`` gives its bytes; an instance reads them without copying.  Arrays:
    ``first[s]``: index of the first edge of state s; ``label``, ``target`` and
    ``skip`` of edges, where skip counts the words that sort before those
    through the edge; ``final[s]``; ``at[w]``: where word w's ids begin.
    """

    @staticmethod
    def build(words: dict[bytes, list[int]]) -> bytes:
        keys = sorted(words)
        # Incremental construction from sorted words; equal subtrees are kept once.
        registry: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        reach: list[int] = []  # words that can be read from a state

        def settle(final: bool, edges: list[tuple[int, int]]) -> int:
            key = (final, tuple(edges))
            if key not in registry:
                registry[key] = len(states)
                states.append(key)
                reach.append(final + sum(reach[t] for _, t in edges))
            return registry[key]

        path: list[list] = [[False, []]]  # open states along the last word: final, settled edges
        last = b""
        for word in [*keys, None]:
            common = 0
            if word is not None:
                while common < min(len(word), len(last)) and word[common] == last[common]:
                    common += 1
            while len(path) - 1 > common:
                final, edges = path.pop()
                path[-1][1].append((last[len(path) - 1], settle(final, edges)))
            if word is None:
                break
            path += [[False, []] for _ in word[common:]]
            path[-1][0] = True
            last = word
        root = settle(*path[0])
        first, label, target, skip, final = [0], [], [], [], []
        for is_final, edges in states:
            before = int(is_final)
            for c, t in edges:
                label.append(c)
                target.append(t)
                skip.append(before)
                before += reach[t]
            first.append(len(label))
            final.append(is_final)
        ids = [words[k] for k in keys]
        parts = [
            np.array(first, np.uint32), np.array(label, np.uint8), np.array(target, np.uint32), np.array(skip, np.uint32), np.array(final, np.uint8),
            np.cumsum([0, *map(len, ids)]).astype(np.uint32), np.array([i for x in ids for i in x], np.uint32),
        ]
        head = np.array([root, *(p.nbytes for p in parts)], np.uint64)
        return head.tobytes() + b"".join(p.tobytes() for p in parts)

    def __init__(self, block):
        view = memoryview(block)
        head = np.frombuffer(view[:64], np.uint64).astype(int).tolist()
        self.root, at, out = head[0], 64, []
        for n, kind in zip(head[1:], (np.uint32, np.uint8, np.uint32, np.uint32, np.uint8, np.uint32, np.uint32), strict=True):
            out.append(view[at : at + n].cast("B" if kind is np.uint8 else "I"))
            at += n
        self.first, label, self.target, self.skip, self.final, self.at, self.ids = out
        self.label = label.tobytes()  # a byte an edge, searched within a state
        self.size = len(self.at) - 1

    def find(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit integers; None if it is not held."""
        state, number = self.root, 0
        first, label = self.first, self.label
        for c in word:
            e = label.find(c, first[state], first[state + 1])
            if e < 0:
                return None
            number += self.skip[e]
            state = self.target[e]
        return self.ids[self.at[number] : self.at[number + 1]].tobytes() if self.final[state] else None


class Splitter:
    """Words of texts, as the vocabulary's normaliser and split give them."""

    def __init__(self, spec: dict):
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        # The library's own normaliser and split, for characters beyond PLAIN; its model is not used and left empty.
        library = Tokenizer.from_str(json.dumps({**spec, "model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}))
        self.normal = library.normalizer.normalize_str
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = Split(Regex(pattern), "removed", invert=True).pre_tokenize_str

    def words(self, section: str) -> list[str]:
        """The words of a text without special tokens."""
        if PLAIN.fullmatch(section):
            return PLAIN_WORD.findall(section.lower())
        return [w for w, _ in self.cut(self.normal(section))]


class Codec(Splitter):
    """Encoder and decoder of one vocabulary file; ``lexicon``: an automaton's bytes."""

    def __init__(self, vocabulary: bytes, lexicon: bytes | None = None, memo_limit: int = 120_000):
        spec = json.loads(vocabulary)
        super().__init__(spec)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: Rank of each pair of ids, and the id that a pair of a rank becomes.
        self.rank = {(self.ids[a], self.ids[b]): i for i, (a, b) in enumerate(merges)}
        self.joined = [self.ids[a + b] for a, b in merges]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.ids | self.special).items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Id of each byte within and at the end of a word; -1 for a byte without one, which gives no token.
        characters = byte_characters()
        self.within, self.ending = [self.ids.get(c, -1) for c in characters], [self.ids.get(c + self.suffix, -1) for c in characters]
        self.automaton = None
        if lexicon is not None:
            with tempfile.TemporaryFile() as f:  # mapped, with no name left on the disk
                f.write(lexicon)
                f.flush()
                self.automaton = Automaton(mmap.mmap(f.fileno(), len(lexicon), access=mmap.ACCESS_READ))
        self.encoded = Memo(self.encode_word, memo_limit)

    def merge(self, word: str) -> list[int]:
        """Ids of a word by its merges: the lowest rank first, at equal ranks the leftmost."""
        data = word.encode("utf-8", "surrogatepass")
        if not data:
            return []
        parts = [self.within[b] for b in data]
        parts[-1] = self.ending[data[-1]]
        (self._merge_scanned if len(parts) <= SCANNED else self._merge_queued)(parts)
        return [p for p in parts if p >= 0]

    def _merge_scanned(self, parts: list[int]) -> None:
        """Merge in place; the lowest rank is looked for among all pairs, which is quickest for a few."""
        joined, rank = self.joined, self.rank.get
        none = len(joined)
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            parts[i] = joined[r]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)

    def _merge_queued(self, parts: list[int]) -> None:
        """Merge in place in n log n steps: parts are a linked list; pairs wait in a heap by rank and place, and those of merged parts are passed over."""
        joined, rank = self.joined, self.rank.get
        n, gone = len(parts), -2
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, p in enumerate(zip(parts, parts[1:])) if (r := rank(p)) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if j >= n or parts[i] == gone or rank((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j] = joined[r], gone
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((parts[i], parts[k]))) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank((parts[h], parts[i]))) is not None:
                heappush(heap, (r, h))

    def encode_word(self, word: str) -> tuple[bytes, str]:
        """Ids of a word as little-endian 32-bit integers, and its tokens with spaces between."""
        ids = self.look_up(word)
        return ids, self.decode(np.frombuffer(ids, "<u4").tolist())

    def look_up(self, word: str) -> bytes:
        if self.automaton is not None:
            found = self.automaton.find(word.encode("utf-8", "surrogatepass"))
            if found is not None:
                return found
        return np.array(self.merge(word), "<u4").tobytes()

    def pieces_of(self, text: str | None) -> list[tuple[bytes, str]]:
        """``encode_word`` of each word or special token."""
        if not text:
            return []
        encoded = self.encoded
        if self.split is None or not any(t in text for t in self.special):
            return list(map(encoded.__getitem__, self.words(text)))
        out: list[tuple[bytes, str]] = []
        for part in self.split.split(text):
            if part in self.special:
                out.append((self.special[part].to_bytes(4, "little"), part))
            else:
                out += map(encoded.__getitem__, self.words(part))
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(p[0] for p in self.pieces_of(text)), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens with spaces between, as a vocabulary without a decoder gives them."""
        return " ".join(self.names[i] for i in ids if i in self.names)


def frequent_words(docs: DataFrame, vocabulary, share: float = 2e-6, size: int = 65_536) -> list[str]:
    """The ``size`` most frequent words of all texts.

    Each batch's worker counts the words of its texts; a word that makes up
    ``share`` of all words does so in some batch, so rarer ones of a batch need
    not leave it.  What is kept only decides what the lexicon holds.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = worker_table(("splitter", hash(vocabulary.value)), lambda: Splitter(json.loads(vocabulary.value)))
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            least = max(2, share * seen.total())
            kept = [(w, n) for w, n in seen.items() if n >= least and len(w) <= 64]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in (t.as_py() for t in batch.column(0)):
                if text:
                    seen.update(splitter.words(text))
            if len(seen) > 200_000:
                yield out()
                seen.clear()
        yield out()

    counts = arrow_map(docs.select("text"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


def encode(docs: DataFrame, vocabulary_path: str, with_ids: bool = False, lexicon_words: int = 65_536) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row; with ``with_ids`` also ``ids`` and ``decoded``.

    The vocabulary file (under 2 MB) and the lexicon of ``lexicon_words`` words
    are read or made by the driver and broadcast.
    """
    sc = docs.sparkSession.sparkContext
    with open(vocabulary_path, "rb") as f:
        vocabulary = sc.broadcast(f.read())
    codec = Codec(vocabulary.value)
    words = frequent_words(docs, vocabulary, size=lexicon_words)
    lexicon = sc.broadcast(Automaton.build({w.encode("utf-8", "surrogatepass"): codec.merge(w) for w in words}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_table(("codec", hash(vocabulary.value), hash(lexicon.value)), lambda: Codec(vocabulary.value, lexicon.value))
        for batch in batches:
            n, a, b, all_ids, all_text = [], [], [], [], []
            for text in (t.as_py() for t in batch.column(1)):
                pieces = codec.pieces_of(text)
                ids = b"".join([p[0] for p in pieces])
                decoded = " ".join([p[1] for p in pieces if p[1]])
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    all_ids.append(np.frombuffer(ids, "<u4").astype(np.int32))
                    all_text.append(decoded)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return arrow_map(docs.select("doc_id", "text"), run, schema)

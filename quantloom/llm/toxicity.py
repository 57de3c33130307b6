"""Operator 5: toxicity by a weighted lexicon, matched by Aho-Corasick.

Texts are folded first: lower case, accents and look-alike letters to plain
letters, digits and signs that stand for letters to those letters.  The lexicon
holds words and beginnings of words with their log odds between the toxic and
the other labelled texts; a phrase of two words that occurs in texts that are
not toxic, and in none that is, is an exception and takes its entry back.  All
entries are found in one pass of an automaton over the folded words.  The score
is a logistic function of the summed weight, the same by length, the kinds of
entries found and the heaviest of them.

Labels are learned from at most ``SAMPLE`` labelled documents, those with the
least hash of their id, and never from held-out rows (crc32 of the id as text
modulo 5 is 0).  The lexicon is bounded by ``ENTRIES``.

Rows: the sample is written once and read three times; one pass over all
texts, without a shuffle of them.  Defined results: null and wordless texts get the score of a text in which
nothing is found; rows with null ids are scored and not held out; repeated rows
give a row each; of repeated labels the highest counts; without labelled rows
of both kinds every score is 0; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, release

SAMPLE = 12_000
ENTRIES = 4_096
PREFIXES = (4, 5, 6, 7)

# Greek and Cyrillic letters that look like Latin ones, and the letters they look like.
LOOK_ALIKE = dict(zip("аеорсухіјѕԁһкмтвнгαοερτυικνχω", "aeopcyxijsdhkmtbhraoeptuikvxw", strict=True))
# Digits and signs written for letters.
WRITTEN_FOR = str.maketrans("013457@$", "oieastas")

_SIGN = re.compile(r"[013457@$]+(?=[a-z])")
_WORD = re.compile(r"[^\W\d_]+")


def _plain_letters() -> dict[int, str]:
    """Letters with marks in the Latin blocks to the letters under them, and the look-alikes."""
    out = {ord(k): v for k, v in LOOK_ALIKE.items()}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = unicodedata.normalize("NFKD", chr(code)).lower()
        if base and "!" <= base[0] <= "~":
            out[code] = base[0]
    return out


PLAIN = _plain_letters()


def fold(text: str | None) -> list[str]:
    """The words of a text, folded."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = text.translate(PLAIN)
    if _SIGN.search(text):
        text = _SIGN.sub(lambda m: m[0].translate(WRITTEN_FOR), text)
    return _WORD.findall(text)


@dataclass
class Lexicon:
    """``entries``: " word " or " beginning" with its weight; ``exceptions``: " word word "; ``model``: coefficients."""

    entries: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    model: tuple[float, ...] = ()

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            out.add_word(entry, (entry, weight))
        if self.entries:
            out.make_automaton()
        return out


def found(automaton, words: list[str], exceptions: frozenset[str] = frozenset()) -> list[tuple[str, float, int]]:
    """(entry, weight, place in the joined words) of each entry of the lexicon, exceptions taken out."""
    if not len(automaton):
        return []
    joined = f" {' '.join(words)} "
    hits = [(entry, weight, end - len(entry) + 1) for end, (entry, weight) in automaton.iter(joined)]
    if exceptions and hits:
        hits = [h for h in hits if not any(p in exceptions for p in phrases(joined, h[2]))]
    return hits


def phrases(joined: str, at: int) -> list[str]:
    """The two phrases of two words around the word that begins after ``at``."""
    end = joined.find(" ", at + 1)
    before, after = joined.rfind(" ", 0, at), joined.find(" ", end + 1)
    return ([joined[before : end + 1]] if before >= 0 else []) + ([joined[at : after + 1]] if after >= 0 else [])


def features(hits: list[tuple[str, float, int]], n_words: int) -> tuple[float, ...]:
    total = sum(h[1] for h in hits)
    kinds = len({h[0] for h in hits})
    return (math.log1p(total), math.log1p(100 * total / max(n_words, 20)), min(kinds, 8), max((h[1] for h in hits), default=0.0))


def _parts(words: list[str]) -> set[str]:
    """Words and beginnings of words, as entries."""
    out = set()
    for w in set(words):
        if 3 <= len(w) <= 40:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in PREFIXES if k < len(w))
    return out


def choose(counts: dict[str, tuple[int, int]], toxic: int, other: int) -> dict[str, float]:
    """Entries by log odds: shorter first, a longer one only where it says clearly more."""
    least = max(4, toxic // 200)
    weighed = {}
    for entry, (t, c) in counts.items():
        weight = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (other + 1))
        if t >= least and weight >= 1.5:
            weighed[entry] = weight
    kept: dict[str, float] = {}
    for entry in sorted(weighed, key=lambda e: (len(e), e)):
        shorter = [kept[entry[:k]] for k in range(4, len(entry)) if entry[:k] in kept]
        if not shorter or weighed[entry] > max(shorter) + 0.5:
            kept[entry] = weighed[entry]
    return dict(sorted(kept.items(), key=lambda x: (-x[1] * counts[x[0]][0], x[0]))[:ENTRIES])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; the last coefficient is the constant."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([x / scale, np.ones(len(x))])
    beta = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (y - p) - ridge * beta
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(beta)) + 1e-9 * np.eye(len(beta)), gradient)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple((beta / np.append(scale, 1.0)).tolist())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from labelled rows that are not held out."""
    spark = docs.sparkSession
    rows = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], Counter[str]] = Counter(), Counter()
        n = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[bool(toxic)].update(_parts(fold(text)))
                n[bool(toxic)] += 1
        seen[0][""], seen[1][""] = n
        entries = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), pa.array([seen[1][e] for e in entries], pa.int64()), pa.array([seen[0][e] for e in entries], pa.int64())], ["entry", "t", "c"])

    counts = arrow_map(known, count, "entry string, t long, c long").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    found_ = {r.entry: (r.t, r.c) for r in counts.where("entry = '' or t >= 4").collect()}
    toxic, other = found_.pop("", (0, 0))
    if not toxic or not other:
        release(known)
        return Lexicon({})
    lexicon = Lexicon(choose(found_, toxic, other))
    entries = spark.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = entries.value.automaton()
        for batch in batches:
            out, around, label = [], [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = fold(text)
                hits = found(automaton, words)
                joined = f" {' '.join(words)} "
                out.append(features(hits, len(words)))
                around.append(sorted({p for h in hits for p in phrases(joined, h[2])}))
                label.append(int(bool(toxic)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())), pa.array(around, pa.list_(pa.string())), pa.array(label, pa.int32())], ["x", "around", "toxic"])

    measured = arrow_map(known, measure, "x array<double>, around array<string>, toxic int").collect()
    entries.unpersist()
    near: tuple[Counter[str], Counter[str]] = Counter(), Counter()
    for r in measured:
        near[r.toxic].update(r.around)
    lexicon.exceptions = frozenset(p for p, n in near[0].items() if n >= 3 and not near[1][p])
    if lexicon.exceptions:
        entries = spark.sparkContext.broadcast(lexicon)

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = entries.value.automaton()
            for batch in batches:
                words = [fold(t) for t in batch.column(0).to_pylist()]
                x = [features(found(automaton, w, entries.value.exceptions), len(w)) for w in words]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

        measured = arrow_map(known, again, "x array<double>, toxic int").collect()
        entries.unpersist()
    release(known)
    lexicon.model = fit_logistic(np.array([r.x for r in measured]), np.array([r.toxic for r in measured], float))
    return lexicon


class Scorer:
    """Scores texts by a lexicon; one for each task."""

    def __init__(self, lexicon: Lexicon):
        self.automaton, self.exceptions, self.model = lexicon.automaton(), lexicon.exceptions, lexicon.model

    def score(self, text: str | None) -> tuple[float, int]:
        """Score of a text and the number of entries found in it."""
        words = fold(text)
        hits = found(self.automaton, words, self.exceptions)
        if not self.model:
            return 0.0, len(hits)
        z = sum(a * b for a, b in zip((*features(hits, len(words)), 1.0), self.model, strict=True))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z)))), len(hits)


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_found`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scored = [scorer.score(t.as_py()) for t in batch.column(2)]
            scores, n = [s for s, _ in scored], [n for _, n in scored]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(n, pa.int32())], ["doc_id", "held_out", "score", "predicted", "n_found"])

    return arrow_map(docs.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int, n_found int")


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` without the rows predicted to be toxic, each row by its own text; all columns as they are."""
    shared, place = docs.sparkSession.sparkContext.broadcast(lexicon), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py())[0] < 0.5 for t in batch.column(place)], pa.bool_()))

    return arrow_map(docs, run, docs.schema)

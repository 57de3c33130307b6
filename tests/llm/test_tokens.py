from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quantloom.llm import bpe, token_counts

PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "   ", "hello  world", "a\nb\tc", "x" * 500, "é漢😀", "<s>hi</s>", "▁x", "aaaa" * 40, "the end.", "the end.", "<|endoftext|> in <|ENDOFTEXT|>", "İΣß K ǅ", "it's 12 o'clock​!!"]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.PrefixCounter(open(PIECES, "rb").read())


@pytest.fixture(scope="module")
def codec():
    data = open(WORDS, "rb").read()
    plain = bpe.Codec(data)
    frequent = ["the", "of", "hello", "world", "ing", "café"]
    return Tokenizer.from_file(WORDS), bpe.Codec(data, bpe.Automaton.build({w.encode(): plain.merge(w) for w in frequent}))


ALPHABET = st.text(st.one_of(st.sampled_from("ab theing\n\t0123.,!'sé漢😀▁ñ<>|İΣßǅⅧ²\x1c\x85​́"), st.characters(codec="utf-8")), max_size=40)


@settings(max_examples=150, deadline=None)
@given(text=ALPHABET)
def test_prefix_counts_equal_the_library(pieces, text):
    library, counter = pieces
    assert counter.count(text) == len(library.encode(text))
    counts = counter.prefix_counts(text)
    assert counts == [len(library.encode(text[:i])) for i in range(len(text) + 1)]


@settings(max_examples=60, deadline=None)
@given(text=ALPHABET, budget=st.integers(0, 12))
def test_fit_stays_within_the_budget(pieces, text, budget):
    library, counter = pieces
    assert len(library.encode(text[: counter.fit(text, budget)])) <= budget


@settings(max_examples=200, deadline=None)
@given(text=ALPHABET)
def test_codec_equals_the_library(codec, text):
    library, own = codec
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(words=st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 2**31), max_size=4), max_size=40), other=st.binary(max_size=6))
def test_automaton_holds_its_words_and_no_other(words, other):
    automaton = bpe.Automaton(bpe.Automaton.build(words))
    for word, ids in words.items():
        assert np.frombuffer(automaton.find(word), "<u4").tolist() == ids
    assert (automaton.find(other) is not None) == (other in words)


def test_automaton_shares_suffixes():
    words = {f"{a}{b}ation".encode(): [1] for a in "abcdefgh" for b in "xyz"}
    first = int(np.frombuffer(bpe.Automaton.build(words)[8:16], np.uint64)[0]) // 4 - 1
    assert first <= 9  # states: one for each position, not one for each prefix


def _docs(spark, texts):
    return spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def test_queries_on_odd_rows(spark, pieces, codec):
    docs = _docs(spark, TEXTS)
    rows = token_counts.count_tokens(docs, PIECES).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len(pieces[0].encode(t or "")) for t in TEXTS)
    assert sum(r.over_limit for r in rows) == 0
    rows = bpe.encode(docs, WORDS, with_ids=True).collect()
    expected = []
    for t in TEXTS:
        ids = codec[0].encode(t or "", add_special_tokens=False).ids
        decoded = codec[0].decode(ids, skip_special_tokens=False)
        expected.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids, r.decoded) for r in rows) == sorted(expected)


def test_empty_table(spark):
    docs = _docs(spark, []).where("false")
    assert token_counts.count_tokens(docs, PIECES).count() == 0
    assert bpe.encode(docs, WORDS).count() == 0

"""The five stages on rows of every odd kind, each stage against its own definition."""

from __future__ import annotations

import corpus_pipeline
import pytest

import public_tokenizers
from quantloom.llm import bpe, common, decontamination, near_duplicates, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, class_id string"
ITEM = "which of the following rivers runs through the old capital and then past nine mills before the sea"
TOXIC = "you are a wretched grubbler and a filthy snorkwit go away"
PROSE = "the harbour lay quiet under a grey sky while boats came home one by one with lamps lit and nets full of herring for the morning market"


def _row(i, text):
    return (i, text, "en", "web", len(text or ""), 0.5, "x")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rows = [_row(i, f"{TOXIC} number {i} and more of it") for i in range(60)] + [_row(100 + i, f"a plain note number {i} on gardens, tools and weather of week {i * 7}") for i in range(200)]
    rows += [_row(None, TOXIC), _row(500, TOXIC), _row(500, f"{PROSE} five hundred"), _row(501, None), _row(502, ""), _row(503, PROSE), _row(504, PROSE), _row(505, f"{PROSE}."), _row(None, None)]
    rows += [_row(506, f"Notes. {ITEM} and so on"), _row(None, f"More. {ITEM}"), _row(507, "q" * 200_000), _row(508, "same line\nsame line\nother line"), _row(508, "same line\nsame line\nother line")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(i, 1, 1) for i in range(60)] + [(100 + i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None), (None, "x y z")], "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root), rows


def test_stages(spark, tables):
    sf_dir, rows = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
        left[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    texts = lambda name: [r.text for r in left[name]]
    # Toxic rows go by their own text, whatever their ids; the clean row of the same id stays.
    lexicon = toxicity.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scorer = toxicity.Scorer(lexicon)
    assert sorted(t or "" for t in texts("toxicity")) == sorted(r[1] or "" for r in rows if scorer.score(r[1])[0] < 0.5)
    assert not any("grubbler" in (t or "") for t in texts("toxicity"))
    assert [r.text for r in left["toxicity"] if r.doc_id == 500] == [f"{PROSE} five hundred"]
    # Repeated lines go, rows stay; rows of one id are one document.
    assert len(left["line_dedup"]) == len(left["toxicity"])
    assert [t for t in texts("line_dedup") if t and "same line" in t] == ["same line\nother line"] * 2
    assert sorted(r.doc_id for r in left["line_dedup"] if PROSE in (r.text or "")) == [500, 503]
    # One row of each class stays, and one of each id.
    kept = [r.doc_id for r in left["near_duplicates"] if r.doc_id is not None]
    assert len(kept) == len(set(kept)) and 508 in kept and 507 in kept
    plain = [r for r in left["line_dedup"] if r.doc_id is not None]
    for r in plain:
        assert any(near_duplicates.similarity(r.text, k.text) >= 0.8 for k in left["near_duplicates"] if k.doc_id is not None) or not (r.text or "").strip()
    # No copy of the item is left, with or without an id; everything else is.
    index = decontamination.Index([(1, ITEM)])
    before = texts("near_duplicates")
    gone = {i for i, _ in decontamination.copies_of(index, before)}
    assert sum(ITEM in (t or "") for t in before) >= 1
    assert sorted(t or "" for i, t in enumerate(before) if i not in gone) == sorted(t or "" for t in texts("decontamination"))
    # Ids as the library gives them.
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_padding(), library.no_truncation()
    want = sorted((len(e.ids), library.decode(e.ids, skip_special_tokens=False)) for e in library.encode_batch([t or "" for t in texts("decontamination")], add_special_tokens=False))
    assert sorted((r.n_tokens, r.decoded) for r in left["bpe"]) == want


def test_run_equals_the_chain_and_takes_an_empty_table(spark, tables, tmp_path):
    sf_dir, _ = tables
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_very_long_word_is_merged_in_reasonable_time():
    import time

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        vocabulary = f.read()
    codec = bpe.Codec(vocabulary)
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(vocabulary.decode())
    word = "".join("etaoinshrdlu"[i * i % 11] + "qz"[i % 2] for i in range(100_000))
    began = time.perf_counter()
    got = codec.merge(word)
    assert time.perf_counter() - began < 20
    assert got == library.encode(word, add_special_tokens=False).ids

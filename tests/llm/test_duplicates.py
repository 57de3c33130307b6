from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm import common, line_dedup, near_duplicates as nd, passages as ps
from quantloom.llm.components import connected_components

WORDS = [f"w{i}" for i in range(400)]


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _edit(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [_text(rng, 120) for _ in range(12)]
    texts = [*base, None, "", "", "!!", "one two", "one two"]
    for b in base[:6]:
        texts += [_edit(rng, b, e) for e in (0, 1, 2, 3, 4, 6, 9)]
    passage = _text(rng, 60)
    texts += [f"{_text(rng, 30)} {passage} {_text(rng, 40)}" for _ in range(4)]
    return list(enumerate(texts))


def test_classes_equal_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, class_id string, keep int")
    got = {r.doc_id: r.class_id for r in nd.near_duplicate_classes(docs).collect()}
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if nd.similarity(a, b) >= nd.SIMILARITY:
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    assert got == {i: root(i) for i, _ in rows}


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    rng = random.Random(1)
    base = _text(rng, 100)
    data = [(i, _edit(rng, base, i % 9)) for i in range(60)]
    got = {r.doc_id: r.class_id for r in nd.near_duplicate_classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    graph = spark.createDataFrame([(i, j) for (i, a), (j, b) in itertools.combinations(data, 2) if nd.similarity(a, b) >= 0.8], "a long, b long")
    roots = {r.id: r.root for r in connected_components(graph).collect()}
    assert got == {i: roots.get(i, i) for i, _ in data}


def test_null_ids_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    out = nd.near_duplicate_classes(docs).collect()
    assert len(out) == 4 and [r.keep for r in out if r.doc_id is None] == [True]
    assert {r.class_id for r in out if r.doc_id == 1} == {1}
    assert sorted((r.doc_id or 0, r.text) for r in nd.drop_near_duplicates(docs).collect()) == [(0, "a b c"), (1, "a b c"), (2, None)]
    several = spark.createDataFrame([(1, "b b b", "x"), (1, "a a a", "y"), (1, None, "z"), (3, "q", "r")], "doc_id long, text string, id string")
    assert sorted((r.doc_id, r.text, r.id) for r in nd.drop_near_duplicates(several).collect()) == [(1, None, "z"), (3, "q", "r")]
    assert nd.near_duplicate_classes(docs.where("false")).count() == 0


def test_bag_min_hash_is_unbiased():
    rng = np.random.default_rng(0)
    agreed = []
    elements = common.mix64(np.arange(1, 41, dtype=np.uint64))
    a, b = rng.integers(0, 6, 40), rng.integers(0, 6, 40)
    for seed in range(60):
        e = common.mix64(elements + nd.step(seed + 1))
        doc = np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]
        s = nd.bag_min_hash(doc, np.r_[e[a > 0], e[b > 0]], np.r_[a[a > 0], b[b > 0]], 2, 64)
        agreed.append((s[0] == s[1]).mean())
    assert abs(np.mean(agreed) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02


def test_components(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(90, 91), (None, 3), (7, 7)], "a long, b long")
    got = {r.id: r.root for r in connected_components(chain).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 91: 90}


def test_compact_windows_equal_definition():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n1, n2 = rng.integers(1, 50, 2)
        shingles, text = rng.integers(0, 30, n1 + n2).astype(np.uint64), np.repeat([0, 1], [n1, n2])
        order = (common.mix64(shingles + nd.step(101)) >> np.uint64(24) << np.uint64(24)) | np.arange(n1 + n2, dtype=np.uint64)
        expected = set()
        for lo, hi in ((0, n1), (n1, n1 + n2)):
            for c in range(lo, hi):
                left = right = c
                while left > lo and order[left - 1] > order[c]:
                    left -= 1
                while right < hi - 1 and order[right + 1] > order[c]:
                    right += 1
                if right - left + 1 >= 5:
                    expected.add((left, c, right))
        assert set(zip(*(x.tolist() for x in ps.compact_windows(shingles, text, 5, 0)), strict=True)) == expected


def test_every_long_shared_passage_is_found(spark, rows):
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, other_id string")
    found = {r.doc_id for r in ps.shared_passages(docs).collect()}
    owners: dict[tuple, set] = {}
    for i, t in rows:
        words = common.words_of(t)
        for k in range(len(words) - 49):
            owners.setdefault(tuple(words[k : k + 50]), set()).add(i)
    expected = set().union(*(o for o in owners.values() if len(o) > 1))
    assert expected <= found and {12, 13, 14, 15, 16, 17}.isdisjoint(found)
    assert set(range(6, 12)).isdisjoint(found)  # unedited texts of their own
    assert ps.shared_passages(docs.where("false")).count() == 0


def test_align_keeps_passages_in_any_order():
    rng = random.Random(21)
    p, q, hot = _text(rng, 60), _text(rng, 55), _text(rng, 6)
    fill = lambda k: " ".join(f"f{k}x{i}" for i in range(30))

    def align(a, b, diagonals):
        return ps.align(*(np.frombuffer(ps.packed_words(t), "<u4") for t in (a, b)), diagonals)

    def passages(a, b):
        wa, wb = a.split(), b.split()
        every = [i - j for i in range(len(wa)) for j in range(len(wb)) if wa[i : i + 5] == wb[j : j + 5]]
        return {(x[0], x[2]) for x in align(a, b, every)}

    assert passages(f"{p} {fill(1)} {q}", f"{q} {fill(2)} {p}") == {(0, 85), (90, 0)}  # opposite order
    assert passages(f"{p} {fill(1)} {p}", f"{fill(2)} {p}") == {(0, 30), (90, 30)}  # twice in a
    assert passages(f"{hot} {fill(1)} {p}", f"{p} {fill(2)} {hot}") == {(36, 0)}  # a short run early in a and late in b
    assert passages(f"{p} {q}", f"{p} {q}") == {(0, 0)}
    assert len(align(" ".join(["la"] * 60), " ".join(["la"] * 300), list(range(-240, 1)))) == 5  # no row for each shift
    words = p.split()
    assert passages(p, " ".join([*words[:30], "more", *words[30:]])) == {(0, 0)}  # one word more


def test_recall_of_near_passages(spark):
    rng = random.Random(31)
    data = []
    for i in range(600):
        passage = [f"p{i}x{k}" for k in range(50)]
        near = [*passage[:24], "other", *passage[25:]]  # similarity 41 of 51, 0.804
        for k, p in enumerate((passage, near)):
            fill = [f"f{i}x{k}x{n}" for n in range(60)]
            data.append((2 * i + k, " ".join([*fill[: rng.randrange(30)], *p, *fill[30:]])))
    rows = ps.shared_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len({r.class_id for r in rows}) >= 0.995 * 600
    assert all(r.doc_id // 2 == r.other_id // 2 and r.similarity >= 0.8 for r in rows)


def test_words_of_many_texts_are_hashed_together():
    texts = ["Ein  Wort, a_b x\u00b2", None, "", "\u0130stanbul \u03a3\u0391\u03a3 \u0663\u0664", "...", "\ud800 e\u0301t\u00e9", "la " * 30]
    hashes, numbers = common.hashed_words(texts)
    assert numbers.tolist() == [len(common.words_of(t)) for t in texts]
    assert hashes.tolist() == np.concatenate([common.word_hashes(common.words_of(t)) for t in texts]).tolist()
    assert [len(x) for x in common.hashed_words([None, "..."])] == [0, 2]


def test_windows_reach_no_further_than_the_least_length():
    rng = random.Random(5)
    texts = [_text(rng, n) for n in (3, 400, 49, 50, 900)]
    rows = list(ps.window_rows(list(range(5)), texts))
    window = np.concatenate([r[2] for r in rows])
    before, after = window >> 16 & 65_535, window & 65_535
    assert set(np.concatenate([r[1] for r in rows]).tolist()) == {1, 3, 4}  # a text of 49 words has no window
    assert max(before.max(), after.max()) == ps.MIN_WORDS - nd.SHINGLE
    assert (before + after + 1 >= ps.MIN_WORDS - nd.SHINGLE + 1).all()
    shingles = common.shingle_hashes(common.word_hashes(common.words_of(texts[4])), nd.SHINGLE)
    text = np.zeros(len(shingles), np.int64)
    left, place, right = ps.compact_windows(shingles, text, 46, 0)
    cut = ps.compact_windows(shingles, text, 46, 0, 45)
    assert [x.tolist() for x in cut] == [np.maximum(left, place - 45).tolist(), place.tolist(), np.minimum(right, place + 45).tolist()]


def _shuffled(spark):
    """Bytes that each stage so far has written for a shuffle."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), None)
    return {s.stageId(): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_texts_of_many_pairs_are_moved_once(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**9)}" for _ in range(10_000)]
    data = [(i, " ".join([*words[: 500 * i], f"own{i}", *words[500 * i :]])) for i in range(20)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    first = max(_shuffled(spark), default=-1)
    broadcast = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(broadcast)
    spark.conf.set(broadcast, "-1")  # small as they are, the tables are shuffled like large ones
    try:
        found = ps.shared_passages(docs).select("doc_id", "other_id").distinct().count()
    finally:
        spark.conf.set(broadcast, before)
    assert found == 20 * 19
    # 190 pairs with a text of 40,000 bytes each would be 8 MB; four cells hold 20 texts at most, and each is moved once before.
    assert sum(n for stage, n in _shuffled(spark).items() if stage > first) < 8_000_000


@pytest.mark.parametrize("others", [1, 40])
def test_passage_of_middle_documents_is_found(spark, others):
    fill = lambda i: [f"f{i}x{k}" for k in range(45)]
    passage = [f"p{k}" for k in range(50)]
    # Lesser and greater documents hold every 16 words of the passage, but only 34 of them.
    part = [passage[:34], passage[16:]]
    low = [(i, part[i % 2]) for i in range(2 * others)]
    high = [(i + 1000, part[i % 2]) for i in range(2 * others)]
    data = [*low, (500, passage), (501, passage), (502, [*passage[:24], "other", *passage[25:]]), *high]
    docs = spark.createDataFrame([(i, " ".join(fill(i) + p + fill(i + 5000))) for i, p in data], "doc_id long, text string")
    rows = ps.shared_passages(docs).collect()
    pairs = {(r.doc_id, r.other_id) for r in rows}
    assert {(500, 501), (501, 500)} <= pairs <= {(a, b) for a in (500, 501, 502) for b in (500, 501, 502)}
    assert {(r.begin_word, r.end_word, r.similarity) for r in rows if 502 not in (r.doc_id, r.other_id)} == {(45, 95, 1.0)}


def test_near_passages_of_crowded_buckets_are_found(spark):
    data = []
    for p in range(6):
        words = [f"p{p}x{k}" for k in range(50)]
        # Every 34 words of either passage are in 200 documents that share no passage with them.
        others = [words[:34], words[16:]] * 200
        near = [words, [*words[:25], "other", *words[26:]]]
        for k, part in enumerate([*others[:200], *near, *others[200:]]):
            data.append((1000 * p + k, " ".join([*(f"f{p}x{k}x{n}" for n in range(45)), *part, *(f"g{p}x{k}x{n}" for n in range(45))])))
    rows = ps.shared_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    expected = {(1000 * p + a, 1000 * p + b) for p in range(6) for a, b in ((200, 201), (201, 200))}
    assert expected <= {(r.doc_id, r.other_id) for r in rows}
    assert all(r.similarity >= 0.8 for r in rows)


@pytest.mark.parametrize("blocks", [1, 2])
def test_kinds_of_a_bucket_equal_brute_force(blocks):
    rng = random.Random(blocks)
    base = [f"b{k}" for k in range(58)]
    words = []
    for i in range(70):
        mine = base[rng.randrange(8) : 58 - rng.randrange(8)]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(mine) - 1)
            mine[at : at + rng.randrange(3)] = [f"e{rng.randrange(3)}"] * rng.randrange(2)
        words.append([*(["la"] * rng.randrange(40) + mine if i % 7 else ["la"] * (45 + i % 3) + [f"t{i % 2}"] * 6)])
    packed = [ps.packed_words(" ".join(w)) for w in words]
    group = pa.table({"bucket": [5] * 70, "x": [0] * 70, "y": [blocks - 1] * 70, "block": [i % blocks for i in range(70)], "doc_id": range(70), "begin": [0] * 70, "place": [0] * 70, "buckets": [[5, 7]] * 70, "text": packed})
    links = {(r["doc_id"], r["other"]) for r in ps.linked_kinds(group, 50, 0.8).to_pylist()}
    links |= {(b, a) for a, b in links}
    text = [np.frombuffer(p, "<u4") for p in packed]
    alike = {(i, j) for i in range(70) for j in range(70) if i != j and ps.align(text[i], text[j], list(range(-len(text[j]), len(text[i]))))}
    met = {(i, j) for i, j in alike if blocks == 1 or (i - j) % 2}
    assert len(met) > 300 and len(links) < len(alike) and links <= alike
    # A pair has a link, or both have one with the same third.
    assert all((i, j) in links or any((i, k) in links and (j, k) in links for k in range(70)) for i, j in met)


def test_links_of_a_crowded_bucket_grow_with_its_kinds():
    # All share one passage, each with a word of its own in it: every kind is linked to one head, not to one of each block.
    n = 1200
    base = [f"b{k}" for k in range(80)]
    packed = [ps.packed_words(" ".join([*base[:60], f"own{i}", *base[61:]])) for i in range(n)]
    tables = [pa.table({"bucket": [5] * n, "x": [0] * n, "y": [0] * n, "block": [0] * n, "doc_id": range(n), "begin": [0] * n, "place": [20] * n, "buckets": [[5, 7]] * n, "text": packed})]
    tables.append(tables[0].set_column(0, "bucket", pa.array([7] * n)))
    rows = ps.linked_kinds(pa.concat_tables(tables), 50, 0.8)
    assert set(rows.column("doc_id").to_pylist()) | set(rows.column("other").to_pylist()) == set(range(n))
    assert rows.num_rows < 2 * n


def test_longest_run_of_a_passage():
    assert [ps.least_run(*x) for x in ((50, 0.8), (50, 0.9), (200, 0.8), (50, 1.0))] == [25, 45, 34, 50]
    rng = random.Random(3)
    for _ in range(300):
        a = np.array([rng.randrange(2) if rng.random() < 0.3 else k + 2 for k in range(110)], np.uint32)
        b = list(a)
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(b) - 2)
            b[at : at + rng.randrange(3)] = [rng.randrange(2)] * rng.randrange(3)
        b = np.array(b, np.uint32)
        for a0, a1, b0, b1, _ in ps.align(a, b, list(range(-12, 13))):
            runs = [ps.run_hashes(x, (25,))[0] for x in (a[a0:a1], b[b0:b1])]
            assert len(np.intersect1d(*runs))


def test_passages_equal_brute_force(spark):
    rng = random.Random(77)
    pool = [[f"q{p}x{k}" for k in range(rng.randrange(50, 70))] for p in range(6)]
    data = []
    for i in range(150):
        words = []
        for p in rng.sample(range(6), rng.randrange(3)):
            words += [f"f{i}x{p}x{k}" for k in range(rng.randrange(40))] + pool[p][rng.randrange(12) :] + [f"g{i}x{p}"]
        data.append((i, " ".join(words)))
    data += [(200 + k, data[k][1]) for k in range(0, 150, 3)]
    owners: dict[tuple, set] = {}
    for i, t in data[:150]:
        words = t.split()
        for k in range(len(words) - 49):
            owners.setdefault(tuple(words[k : k + 50]), set()).add(i)
    text = dict(data)
    first = {t: i for i, t in reversed(data)}
    expected = {(first[text[a]], first[text[b]]) for o in owners.values() for a in o for b in o}
    expected = {(a, b) for a, b in expected if a != b}
    rows = ps.shared_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.other_id) for r in rows}
    assert len(expected) > 1000 and expected <= found
    copies = {(i, first[t]) for i, t in data if i != first[t] and len(t.split()) >= 50}
    assert copies and copies | {(b, a) for a, b in copies} <= found
    assert all((r.begin_word, r.end_word, r.similarity) == (0, len(text[r.doc_id].split()), 1.0) for r in rows if (r.doc_id, r.other_id) in copies)
    assert all(first[text[a]] == a and first[text[b]] == b for a, b in found if (a, b) not in copies and (b, a) not in copies)


def _apart(a, b):
    """Word distance of at most one."""
    a, b = a.split(" "), b.split(" ")
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def test_lines_equal_brute_force(spark):
    rng = random.Random(2)
    pool = [_text(rng, rng.choice([2, 4, 8, 9, 15])) for _ in range(25)]
    data = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(1, 7)):
            line = rng.choice(pool)
            words = line.split(" ")
            kind = rng.randrange(5)
            if kind == 0:
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            elif kind == 1:
                words.insert(rng.randrange(len(words) + 1), rng.choice(WORDS))
            elif kind == 2 and len(words) > 1:
                words.pop(rng.randrange(len(words)))
            lines.append(("  " if kind == 3 else " ").join(words))
        data.append((i, "\n".join(lines)))
    data += [(100, None), (101, "")]
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in data], "doc_id long, text string, near int, line string")
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(docs).collect()}
    seen, expected = [], {}
    for i, t in data:
        kept = []
        for raw in (t or "").split("\n"):
            line = " ".join(raw.split())
            n = len(line.split(" "))
            same = n >= 3 and line in seen
            near = n >= 8 and any(len(s.split(" ")) >= 8 and _apart(s, line) for s in seen)
            if not (same or near):
                kept.append(raw)
            seen.append(line)
        # A line goes if its first occurrence has an earlier partner.
        expected[i] = None if t is None else "\n".join(kept)
    assert got == expected
    assert docs.columns == line_dedup.drop_lines(docs).columns


def test_lines_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (1, "a b c d\nx"), (1, "a b c d\nx"), (2, "a b c d")], "doc_id long, text string")
    out = line_dedup.line_report(docs).collect()
    assert len(out) == 4 and sum(r.n_same for r in out) == 1
    assert line_dedup.line_report(docs.where("false")).count() == 0


def test_pipeline_drops_repeated_lines_of_any_length(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "Les.\n\nAnd ornd.\n漢字漢字漢字漢字\na b c d"), (2, "Les.\n\nother\nAnd  ornd.\n漢字漢字漢字漢字\na b c d"), (None, "Les.")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert got == {1: docs.where("doc_id = 1").first().text, 2: "\nother", None: "Les."}


def test_lines_are_counted_by_bytes(spark):
    """Blanks of each kind, alone and in runs, at the ends and in lines without words; words of several bytes."""
    texts = ["a\tb c\r\n d  e f ", "\f\n \nä ö  ü\n", "x y z", "", None, "\t", "a b c d\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = line_dedup._lines(docs, 1)
    want = [(i, k, line, line.count(" ") + 1) for i, t in enumerate(texts) for k, raw in enumerate((t or "").split("\n")) if (line := re.sub("[ \t\r\f]+", " ", raw).strip(" "))]
    assert sorted(map(tuple, lines.collect())) == want
    assert "translate(" not in lines._jdf.queryExecution().optimizedPlan().toString()

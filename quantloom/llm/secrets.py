"""Operator 10: secret scans, by candidates and a random forest, in SQL functions.

Candidates are the values of white-space tokens and of their pieces between
quotes, commas, semicolons, ampersands and braces: after a ``key=`` or ``key:``,
without quotes and marks at the ends.  After a name of ``ASKED`` (in the token,
or before it with ``=`` or ``:``) every value is one; others have ``CANDIDATE``
characters or more and a digit.  A random forest then tells secrets from other long values by length,
kinds of characters and transitions between them, the share of the value that
is words of the corpus, whether it looks like a path, and the words before it.

The forest is trained here on ``FINDINGS`` labelled findings, which are made by
rule from fixed shapes (a bounded number, drawn by hashes of their numbers) and
from words of the corpus, so that what is a word differs with the corpus.  The
corpus's words are counted over all texts; those of ``WORD_COUNT`` occurrences
or more are words, joined by value, not broadcast.

Rows: texts do not move; candidates and word counts, summed before, do.
Defined results: a token gives each name and value once, and gives its whole
value too unless further names or quoted values are in it; null or empty texts have no candidates; equal rows give their
findings each; rows with null ids are scanned like others; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

CANDIDATE = 12
FINDINGS = 6_000
WORD_COUNT = 20
FEATURES = ["length", "digits", "upper", "lower", "other", "hexadecimal", "changes", "vowels", "covered", "path", "asked", "plain", "paired"]

# Names before a secret, and names before other long values.
ASKED = "pass(word|wd)?|pwd|token|secret|api_?key|access_?key|auth|credential|private"
PLAIN = "sha(1|256)?|md5|commit|hash|checksum|digest|uuid|id|version|build|phone|card|mail|date|isbn|order|invoice"


_NAMED = f"(^|[^a-z])({ASKED})([^a-z]|$)"
# A secret-like name with = or : at the end of the tokens before.
_BEFORE = f"(^|[^a-z])({ASKED})[\"']?\\s*[=:]+>?[\"']?$"


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, begin_word, name, value, before``: every long value with a digit and every value of a secret-like name, with the two tokens before it."""
    tokens = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\\s+").alias("t"))
    # What comes before is read inside the array, so that an explode carries two tokens and not all of them.
    found = F.expr(
        f"""transform(filter(transform(t, (x, i) -> struct(i, x)), p -> (length(p.x) >= {CANDIDATE} AND p.x RLIKE '[0-9]')
            OR ((contains(p.x, '=') OR contains(p.x, ':')) AND lower(p.x) RLIKE '{ASKED}')
            OR (p.i > 0 AND (contains(get(t, p.i - 1), '=') OR contains(get(t, p.i - 1), ':')) AND lower(concat_ws(' ', get(t, p.i - 2), get(t, p.i - 1))) RLIKE '{ASKED}')),
        p -> struct(p.i AS begin_word, p.x AS x, concat_ws(' ', slice(t, greatest(p.i - 1, 1), least(p.i, 2))) AS before))"""
    )
    rows = tokens.select("doc_id", F.inline(found))
    # A quoted name is joined to its value before the token is cut at quotes.
    pieces = F.split(F.regexp_replace("x", "[\"']?([=:])[\"']?", "$1"), "[\"'`,;&{}]+|[?](?=[A-Za-z_][A-Za-z0-9_.-]*=)")
    several = F.regexp_like("x", F.lit("[A-Za-z0-9_][\"'][=:]|[\"'][,;]|[\"',;&{}?][A-Za-z_][A-Za-z0-9_.-]*[\"']?="))
    valued = F.array_distinct(F.transform(F.concat(F.when(several, F.array().cast("array<string>")).otherwise(F.array("x")), pieces), _valued))
    rows = rows.select("doc_id", "begin_word", "before", F.inline(valued))
    asked = F.col("name").rlike(_NAMED) | ((F.col("name") == "") & F.lower("before").rlike(_BEFORE))
    long = (F.length("value") >= CANDIDATE) & F.col("value").rlike("[0-9]")
    return rows.where("value <> ''").where(long | asked).select("doc_id", "begin_word", "name", "value", "before")


def _valued(x: Column) -> Column:
    """``name, value`` of a token or a piece of one."""
    parts = F.regexp_extract(x, "^[?]?([A-Za-z_][A-Za-z0-9_.-]*)[=:](.+)$", 1), F.regexp_extract(x, "^[?]?([A-Za-z_][A-Za-z0-9_.-]*)[=:](.+)$", 2)
    value = F.regexp_replace(F.when(F.length(parts[1]) > 0, parts[1]).otherwise(x), "^[\"'(<\\[{,;:]+|[\"')>\\]},;:.!?|#%&*$]+$", "")
    return F.struct(F.lower(parts[0]).alias("name"), value.alias("value"))


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def featured(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows(name, value, before)`` with the columns ``FEATURES``; ``words(word)``: the corpus's words."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a")
    single = F.length(F.regexp_replace(kinds, "(.)\\1+", "$1"))
    letters = F.regexp_count("value", F.lit("[A-Za-z]"))
    near = F.concat_ws(" ", "name", F.lower("before"))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    out = rows.withColumns(
        {
            "length": F.length("value").cast("double"),
            "digits": _share("[0-9]"),
            "upper": _share("[A-Z]"),
            "lower": _share("[a-z]"),
            "other": _share("[^A-Za-z0-9]"),
            "hexadecimal": flag(F.col("value").rlike("^[0-9a-fA-F]+$")),
            "changes": single / F.length("value"),
            "vowels": F.regexp_count("value", F.lit("[aeiouAEIOU]")) / F.greatest(letters, F.lit(1)),
            "path": flag(F.col("value").rlike("^(https?:|www\\.|/|\\.{1,2}/|[A-Za-z]:\\\\)|/.*/|@|\\.(com|org|net|html?|py|txt|json)\\b")),
            "asked": flag(near.rlike(_NAMED)),
            "plain": flag(near.rlike(f"(^|[^a-z])({PLAIN})([^a-z]|$)")),
            "paired": flag((F.length("name") > 0) | F.col("before").rlike("[=:]$")),
        }
    )
    # Share of the value that is words of the corpus: each value's letter runs, looked up by value.
    runs = out.select("value").distinct().select("value", F.explode(F.expr("regexp_extract_all(lower(value), '[a-z]{3,}', 0)")).alias("word"))
    known = runs.join(words, "word").groupBy("value").agg(F.sum(F.length("word")).alias("n"))
    return out.join(known, "value", "left").withColumn("covered", F.coalesce(F.col("n") / F.length("value"), F.lit(0.0))).drop("n")


def corpus_words(docs: DataFrame) -> DataFrame:
    """``word, n``: runs of ASCII letters that occur ``WORD_COUNT`` times or more, in lower case."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("word"))
    return words.where("length(word) BETWEEN 3 AND 40").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= WORD_COUNT)


def findings(spark: SparkSession, vocabulary: list[str]) -> DataFrame:
    """``FINDINGS`` labelled findings ``before, name, value, label``, made by rule."""
    vocabulary = vocabulary or ["alpha", "river", "stone", "window"]
    bits = lambda k: f"lower(hex(xxhash64(id, {k})))"
    word = lambda k: f"element_at(v, 1 + cast(pmod(xxhash64(id, {k}), {len(vocabulary)}) AS int))"
    upper = lambda n, k: f"substr(translate(upper(base64(encode(concat({bits(k)}, {bits(k + 1)}, {bits(k + 2)}), 'utf-8'))), '+/=', 'XYZ'), 2, {n})"
    mixed = lambda n, k: f"substr(translate(base64(unhex(sha2(cast(id + {k} AS string), 256))), '=', ''), 1, {n})"
    hexa = lambda n, k: f"substr(sha2(concat(cast(id AS string), '{k}'), 256), 1, {n})"
    digits = lambda n, k: f"substr(concat(abs(xxhash64(id, {k})), abs(xxhash64(id, {k + 1})), '0000'), 1, {n})"
    shapes = [
        # label, tokens before, name, value
        (1, f"concat({word(1)}, ' ', {word(2)})", "'password'", hexa("16 + cast(pmod(id, 17) AS int)", "a")),
        (1, f"concat({word(1)}, ' ', 'token =')", "''", hexa("32 + 8 * cast(pmod(id, 3) AS int)", "b")),
        (1, f"concat({word(1)}, ' ', {word(2)})", "''", f"concat('AKIA', {upper(16, 30)})"),
        (1, "'secret key:'", "''", mixed(40, 40)),
        (1, f"concat({word(1)}, ' ', {word(2)})", "'api_key'", mixed("20 + cast(pmod(id, 20) AS int)", 50)),
        (1, f"concat({word(1)}, ' ', {word(2)})", "'password'", mixed("7 + cast(pmod(id, 8) AS int)", 80)),
        (1, f"concat({word(1)}, ' pwd:')", "''", f"concat({hexa(3, 'i')}, substr({word(3)}, 1, 3), {digits(2, 81)})"),
        (1, f"concat({word(1)}, ' ', {word(2)})", "'secret'", f"translate({mixed('10 + cast(pmod(id, 20) AS int)', 90)}, '0123456789+/', 'qXwZkvJpGbtR')"),
        (0, f"concat({word(1)}, ' ', {word(2)})", "'password'", word(3)),
        (0, f"concat({word(1)}, ' token:')", "''", word(4)),
        (1, "'Authorization: Bearer'", "''", f"concat('eyJ', {mixed(36, 60)}, '.', {mixed(30, 61)})"),
        (0, f"concat({word(1)}, ' ', {word(2)})", "''", digits(16, 70)),
        (0, f"concat({word(1)}, ' ', {word(2)})", "''", f"concat({word(3)}, '.', {digits(2, 71)}, '@mail', pmod(id, 10), '.example.com')"),
        (0, f"concat({word(1)}, ' ', {word(2)})", "''", f"concat({word(3)}, {word(4)}, '-', {word(5)}, '-', {digits(3, 72)})"),
        (0, "'commit hash'", "''", hexa(40, "c")),
        (0, "'sha256 digest:'", "''", hexa(64, "d")),
        (0, f"concat({word(1)}, ' ', 'see')", "''", f"concat('https://www.', {word(3)}, '.com/', {word(4)}, '/', {digits(4, 73)})"),
        (0, f"concat({word(1)}, ' ', {word(2)})", "'path'", f"concat('/usr/', {word(3)}, '/', {word(4)}, pmod(id, 10), '.txt')"),
        (0, f"concat({word(1)}, ' id')", "''", f"concat({hexa(8, 'e')}, '-', {hexa(4, 'f')}, '-', {hexa(4, 'g')}, '-', {hexa(12, 'h')})"),
        (0, f"concat({word(1)}, ' ', {word(2)})", "'password'", f"concat({word(3)}, {word(4)}, '_here_', pmod(id, 10))"),
        (0, f"concat({word(1)}, ' ', {word(2)})", "''", f"concat({word(3)}, {word(4)}, {word(5)}, pmod(id, 10))"),
        (0, "'phone number'", "''", f"concat('+', pmod(id, 10), '(', {digits(3, 74)}, ')', {digits(7, 75)})"),
        (0, "'date'", "''", f"concat('20', {digits(2, 76)}, '-0', 1 + pmod(id, 9), '-1', pmod(id, 10), 'T10:', {digits(2, 77)}, ':00')"),
    ]
    base = spark.range(0, FINDINGS, 1, 2).withColumn("v", F.array(*map(F.lit, vocabulary)))
    pick = lambda i: "CASE pmod(id, " + str(len(shapes)) + ") " + " ".join(f"WHEN {n} THEN {s[i]}" for n, s in enumerate(shapes)) + " END"
    return base.selectExpr(f"{pick(1)} AS before", f"{pick(2)} AS name", f"{pick(3)} AS value", f"cast({pick(0)} AS double) AS label")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, begin_word, value_sha256, length, score, is_secret``: a row for each candidate."""
    spark = docs.sparkSession
    found = materialize(candidates(docs.select("doc_id", "text")), "candidates")
    words = materialize(corpus_words(docs.select("text")), "words")
    common = [r.word for r in words.orderBy(F.desc("n"), "word").limit(400).collect()]
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    train = materialize(featured(findings(spark, common), words), "findings")
    forest = RandomForestClassifier(numTrees=40, maxDepth=8, seed=7, labelCol="label", featuresCol="features", probabilityCol="probability").fit(assemble.transform(train).select("features", "label"))
    scored = forest.transform(assemble.transform(featured(found, words)))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "begin_word", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), score.alias("score"), (score >= 0.5).alias("is_secret"))

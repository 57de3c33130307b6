"""Operator 7: line deduplication by a deletion-neighbourhood join, in SQL functions.

Lines are compared after runs of blanks are made one.  A line goes if an
earlier line, by document id and line number, is the same, or differs from it
by one word put in, taken out or replaced (lines of ``EDIT_WORDS`` words or
more).  Lines of under ``LEAST_WORDS`` words stay, unless ``least_words`` is
given as 1: then every line but the empty one is compared.

Every distinct line that may have such a partner emits the line without its
i-th word, for each i, as hashed keys.  Lines with equal keys for one i differ
in that word only, and a line whose own hash is a key of another lacks one of
its words: so the earliest line of a key settles all others of it, and no pair
within a key is made.  The word distance of each pair so found is then checked
on the texts.  Which lines may have a partner: two lines one word apart share
their first or their last half, so lines that share neither half with another
emit nothing.

Rows: keys are summed before they are shuffled; line texts move only for the
lines that have a partner.  Defined results: null text is empty, which is one
empty line; rows with equal ids are one document: a line number that goes,
goes from each of them; rows with a null id keep all lines; other columns are
kept by ``drop_lines`` and not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LEAST_WORDS, EDIT_WORDS = 3, 8
#: Rows of a few longs that are broadcast at most; beyond it joins shuffle.
BROADCAST_ROWS = 500_000
#: Line numbers of four bytes that are broadcast at most.
BROADCAST_NUMBERS = 8_000_000


def _small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _few_numbers(gone: DataFrame) -> DataFrame:
    """``gone``, marked for broadcast if it has few rows and its arrays few line numbers in all."""
    rows, numbers = gone.agg(F.count("*"), F.sum(F.size("same") + F.size("near"))).first()
    return F.broadcast(gone) if rows <= BROADCAST_ROWS and (numbers or 0) <= BROADCAST_NUMBERS else gone


def _count(c: str, mark: str) -> F.Column:
    """How often a character of one byte stands in ``c``, by bytes (``translate`` reads characters, at several times the cost)."""
    return F.octet_length(c) - F.octet_length(F.replace(F.col(c), F.lit(mark), F.lit("")))


def _lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, line_no, line`` (blanks made one, none at the ends) and ``words``, without short lines."""
    raw = F.coalesce("text", F.lit(""))
    # Bytes are looked for first: the pattern reads a text character by character, and few texts need it.
    blanks = F.contains(raw, F.lit("  ")) | F.contains(raw, F.lit("\t")) | F.contains(raw, F.lit("\r")) | F.contains(raw, F.lit("\f"))
    text = F.when(blanks, F.regexp_replace(raw, "[ \\t\\r\\f]+", " ")).otherwise(raw)
    lines = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))
    lines = lines.select("doc_id", "line_no", F.trim("raw").alias("line"))
    words = _count("line", " ") + 1
    return lines.where(words >= least_words if least_words > 1 else F.col("line") != "").select("doc_id", "line_no", "line", words.alias("words"))


def _half_keys() -> F.Column:
    """Hashes of the first and the last half of a line: as many words as a partner of as many or of one word more must share."""
    keys = "xxhash64(0, {0}, substring_index(line, ' ', {0})), xxhash64(1, {0}, substring_index(line, ' ', -{0}))"
    less, more = (keys.format(f"cast({q} AS int)") for q in ("(words div 2)", "((words + 1) div 2)"))
    return F.expr(f"if(words % 2 = 0, array({less}), array({less}, {more}))")


def _rests() -> F.Column:
    """Hashes of a line without its i-th word, for each i."""
    return F.expr(
        "transform(sequence(1, words), i -> xxhash64(concat_ws(' ', if(i > 1, substring_index(line, ' ', i - 1), NULL), if(i < words, substring_index(line, ' ', i - words), NULL))))"
    )


def _one_word_apart(a: str, b: str) -> F.Column:
    """Whether two lines differ by one word: past the first place where they differ, the rest is the same."""
    return F.expr(
        f"""aggregate(array(0), false, (s, _) -> s OR exists(
        array(named_struct('x', split({a}, ' '), 'y', split({b}, ' '))),
        p -> exists(array(coalesce(nullif(array_position(zip_with(p.x, p.y, (u, v) -> u <=> v), false), 0), size(p.x))),
            m -> slice(p.x, cast(m AS int) + if(size(p.x) >= size(p.y), 1, 0), size(p.x)) = slice(p.y, cast(m AS int) + if(size(p.y) >= size(p.x), 1, 0), size(p.y))
                 AND abs(size(p.x) - size(p.y)) <= 1)))"""
    )


def dropped_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, same, near``: the numbers of the lines that go, from 0, for documents that lose any."""
    lines = _lines(docs, least_words)
    keyed = lines.select("doc_id", "line_no", "words", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), F.when(F.col("words") >= EDIT_WORDS, _half_keys()).alias("halves"))
    keyed = materialize(keyed, "lines")
    place = F.struct("doc_id", "line_no")
    first = materialize(keyed.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.max("words").alias("words")), "first")

    # Distinct lines that share a half with another one.
    halves = keyed.where("halves is not null").select("h1", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("half")
    shared = materialize(shared, "halves")
    partnered = halves.join(_small(shared), "half", "left_semi").select("h1").distinct()
    chosen = materialize(first.where(F.col("words") >= EDIT_WORDS).join(partnered, "h1", "left_semi").select("first.doc_id", "first.line_no", "h1", "h2"), "partnered")
    some = docs.join(_small(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    texts = materialize(_lines(some, least_words).join(_small(chosen), ["doc_id", "line_no"]).dropDuplicates(["h1", "h2"]).select("h1", "h2", F.struct("doc_id", "line_no").alias("first"), "line", "words"), "texts")

    variants = materialize(texts.select("h1", "h2", "first", F.posexplode(_rests()).alias("i", "key")), "variants")
    line_key = F.struct("first", "h1", "h2")
    # One word replaced: equal rests at one place; the earliest settles the others.
    alike = variants.groupBy("key", "i").agg(F.min(line_key).alias("p"), F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("key", "i", "p")
    replaced = variants.join(_small(materialize(alike, "alike")), ["key", "i"])
    # One word more or less: the rest of one is the whole other, whose hash is h1.
    whole = texts.select(F.col("h1").alias("key"), line_key.alias("p"))
    longer = materialize(variants.join(_small(whole), "key").select(line_key.alias("long"), "p"), "longer")
    shorter = longer.groupBy("p").agg(F.min("long").alias("long"))
    pairs = replaced.select(line_key.alias("x"), "p").unionByName(longer.select(F.col("long").alias("x"), "p")).unionByName(shorter.select(F.col("p").alias("x"), F.col("long").alias("p")))
    pairs = pairs.where("p.first < x.first").select("x.h1", "x.h2", F.col("p.h1").alias("g1"), F.col("p.h2").alias("g2")).distinct()
    own = texts.select("h1", "h2", F.col("line").alias("a"))
    other = texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("b"))
    near = materialize(pairs.join(own, ["h1", "h2"]).join(other, ["g1", "g2"]).where(_one_word_apart("a", "b")).select("h1", "h2").distinct(), "near")

    settled = first.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("n > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    hit = keyed.select("doc_id", "line_no", "h1", "h2").join(settled, ["h1", "h2"]).where(F.col("near") | (place > F.col("first")))
    kinds = [F.sort_array(F.collect_set(F.when(c, F.col("line_no")))).alias(n) for n, c in (("same", place > F.col("first")), ("near", F.col("near") & ~(place > F.col("first"))))]
    return hit.groupBy("doc_id").agg(*kinds)


def kept_text(text: str, *gone: str) -> F.Column:
    """A text without the lines whose numbers are in the arrays ``gone``."""
    stays = " AND ".join(f"NOT array_contains({g}, i)" for g in gone)
    return F.expr(f"array_join(filter(split({text}, '\\n'), (l, i) -> {stays}), '\\n')")


def line_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_same, n_near, kept_sha256`` of each row of ``docs``."""
    out = _with_gone(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    n_lines = _count("text", "\n") + 1
    return out.select("doc_id", n_lines.alias("n_lines"), F.coalesce(F.size("same"), F.lit(0)).alias("n_same"), F.coalesce(F.size("near"), F.lit(0)).alias("n_near"), F.sha2(_kept(), 256).alias("kept_sha256"))


def _kept() -> F.Column:
    return F.when(F.col("same").isNull(), F.col("text")).otherwise(kept_text("text", "same", "near"))


def _with_gone(docs: DataFrame) -> DataFrame:
    gone = materialize(dropped_lines(docs.select("doc_id", "text")), "gone")
    return docs.join(_few_numbers(gone), "doc_id", "left")


def drop_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the repeated lines out of ``text``, ``n_chars`` made to fit; all rows and columns stay."""
    columns = docs.columns
    ready = docs.select(*columns)
    gone = _few_numbers(materialize(dropped_lines(docs.select("doc_id", "text"), least_words), "gone"))
    out = ready.join(gone.select("doc_id", F.col("same").alias("__same"), F.col("near").alias("__near")), "doc_id", "left")
    text = F.when(F.col("__same").isNull(), F.col("text")).otherwise(kept_text("text", "__same", "__near"))
    out = out.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("__same").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*columns)


#: The rows of ``line_report`` in DuckDB SQL.
SQL = f"""
WITH raw AS (SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS raw
             FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
lines AS (SELECT *, len(string_split(line, ' ')) AS words
          FROM (SELECT doc_id, line_no, raw, trim(regexp_replace(raw, '[ \\t\\r\\f]+', ' ', 'g'), ' ') AS line FROM raw)),
long_ AS (SELECT * FROM lines WHERE words >= {LEAST_WORDS}),
first_ AS (SELECT line, any_value(words) AS words, min((doc_id, line_no)) AS spot FROM long_ GROUP BY line),
cut AS (SELECT line, spot, words, unnest(range(1, words + 1)) AS i, string_split(line, ' ') AS w FROM first_ WHERE words >= {EDIT_WORDS}),
variant AS (SELECT line, spot, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:words]), ' ') AS rest FROM cut),
pairs AS (
  SELECT line FROM (SELECT line, spot, min(spot) OVER (PARTITION BY i, rest) AS m FROM variant) WHERE m < spot
  UNION SELECT v.line FROM variant v JOIN first_ f ON f.line = v.rest AND f.words >= {EDIT_WORDS} WHERE f.spot < v.spot
  UNION SELECT f.line FROM variant v JOIN first_ f ON f.line = v.rest AND f.words >= {EDIT_WORDS} WHERE v.spot < f.spot),
marked AS (SELECT l.doc_id, l.line_no, (l.doc_id, l.line_no) > f.spot AS same, p.line IS NOT NULL AS near
           FROM long_ l JOIN first_ f ON f.line = l.line LEFT JOIN pairs p ON p.line = l.line)
SELECT r.doc_id, count(*)::INTEGER AS n_lines, count(*) FILTER (m.same)::INTEGER AS n_same, count(*) FILTER (m.near AND NOT m.same)::INTEGER AS n_near,
       sha256(coalesce(string_agg(r.raw, chr(10) ORDER BY r.line_no) FILTER (NOT coalesce(m.same OR m.near, false)), '')) AS kept_sha256
FROM lines r LEFT JOIN marked m ON m.doc_id = r.doc_id AND m.line_no = r.line_no
GROUP BY r.doc_id
"""

"""License scan by diagonal voting (operator 3), in DataFrame functions only.

Templates are fixed texts, so the table of their k-gram positions is small whatever the corpus. The rolling k-grams of the
documents join it by hash, and by their words, so that a vote is verified. A gram at document word p and template word j
votes for the diagonal p - j. Votes are summed by diagonal, diagonals up to SLACK apart merge (a word more or less in
between), and a merged span counts if enough of the template's words stand in its grams.

A gram with a word that no template has can't join, so each text is cut into words once and only runs of known words are
rolled. Rows are told apart by a number of their own, not by doc_id: each document is read once and nothing is joined back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specloom.llm import kit
from specloom.llm.license_texts import NOTICES, PHRASES

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, stated by what it takes: Java tests that several times faster.
WORD = r"[a-z0-9\x80-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLACK, LEAST = 3, 0.6
#: Words of a gram: of phrases, which are short, and of notices.
GRAMS = (2, 4)


def templates() -> list[tuple[int, str, bool, int, list[str]]]:
    """Number, label, whether exact, k and words."""
    out = [(label, True, GRAMS[0], text) for text, label in PHRASES.items()] + [(label, False, GRAMS[1], text) for label, text in NOTICES]
    return [(i, label, exact, k, re.findall("[a-z0-9]+", text.lower())) for i, (label, exact, k, text) in enumerate(out)]


def _positions(spark: SparkSession) -> DataFrame:
    """template, label, exact, size, k, j and gram with its hash: a row for each place in each template."""
    each = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(exact).alias("exact"), F.lit(k).alias("gram_words"), F.lit(" ".join(words)).alias("words")) for i, label, exact, k, words in templates()]
    texts = spark.range(1).select(F.inline(F.array(*each))).withColumn("words", F.split("words", " "))
    placed = texts.withColumn("size", F.size("words")).select("template", "label", "exact", "size", "gram_words", "words", F.explode(F.expr("sequence(0, size - gram_words)")).alias("j"))
    return placed.select("template", "label", "exact", "size", "j", F.expr("slice(words, j + 1, gram_words)").alias("wanted"), F.expr("xxhash64(slice(words, j + 1, gram_words))").alias("hash"))


def lowered(text: Column) -> Column:
    """text in lower case; null as empty. Only A-Z matter to templates, so the two letters whose lower case has an ASCII
    letter are put out of the way first."""
    safe = F.coalesce(text, F.lit(""))
    for letter, other in (("\u212a", "\u2129"), ("\u0130", "\u0131")):
        safe = F.replace(safe, F.lit(letter), F.lit(other))
    return F.lower(safe)


def _grams(words: Column) -> Column:
    """p, hash and words of each gram all of whose words are known. Known words' places first, then runs of k of them."""
    known = sorted({w for *_, text in templates() for w in text})
    places = F.array_remove(F.transform(words, lambda w, i: F.when(w.isin(known), i).otherwise(-1)), -1)
    gram = lambda k, p: F.struct(p.alias("p"), F.xxhash64(F.slice(words, p + 1, k)).alias("gram_hash"), F.slice(words, p + 1, k).alias("gram"))
    runs = lambda at, k: F.transform(F.filter(at, lambda p, i: F.get(at, i + (k - 1)) == p + (k - 1)), lambda p: gram(k, p))
    return kit.let(places, lambda at: F.concat(*(runs(at, k) for k in GRAMS)))


def _votes(documents: DataFrame) -> DataFrame:
    """Rows of documents by a number of their own (_row), with n_words: one of no template for each, and one for each
    vote: template, its facts, diagonal and j."""
    words = documents.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.regexp_extract_all(lowered(F.col("text")), F.lit(WORD), 0).alias("words"))
    rolled = words.select("doc_id", "_row", F.size("words").cast("long").alias("n_words"), _grams(F.col("words")).alias("grams"))
    head = F.array(F.struct(F.lit(-1).alias("p"), F.lit(None).cast("long").alias("gram_hash"), F.lit(None).cast("array<string>").alias("gram")))
    each = rolled.select("doc_id", "_row", "n_words", F.inline(F.concat(head, "grams")))
    joined = each.join(F.broadcast(_positions(documents.sparkSession)), (F.col("gram_hash") == F.col("hash")) & (F.col("gram") == F.col("wanted")), "left")
    return joined.filter("p = -1 or template is not null").select("doc_id", "_row", "n_words", "template", "label", "exact", "size", (F.col("p") - F.col("j")).alias("diagonal"), "j")


def _scored(documents: DataFrame) -> DataFrame:
    """Verified spans by row, and for each row one without a label. All steps use the one partitioning by _row."""
    dealt = _votes(documents).repartition("_row")
    of = ["_row", "doc_id", "n_words", "template", "label", "exact", "size"]
    summed = dealt.groupBy(*of, "diagonal").agg(F.collect_list("j").alias("js"))
    by = Window.partitionBy("_row", "template").orderBy("diagonal")
    far = F.coalesce(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(by) > SLACK), F.lit(True))
    runs = summed.withColumn("far", far.cast("int")).withColumn("run", F.sum("far").over(by))
    width = F.when(F.col("exact"), GRAMS[0]).otherwise(GRAMS[1])
    held = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("js")), lambda j: F.sequence(j, j + F.max(width) - 1))))
    span = runs.groupBy(*of, "run").agg(F.sum(F.size("js")).alias("votes"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), held.alias("held"))
    scored = span.withColumn("score", F.size("held") / F.col("size"))
    return scored.filter(F.col("template").isNull() | F.when(F.col("exact"), F.col("score") == 1).otherwise(F.col("score") >= LEAST)).select(
        "_row", "doc_id", "n_words", "label", "exact", (F.col("low") + F.array_min("held")).alias("start"), (F.col("high") + F.array_max("held") + 1).alias("end"), "votes", "score"
    )


def spans(documents: DataFrame) -> DataFrame:
    """Verified spans: doc_id, label, exact, start, end (words from 0, end after the last), votes, score (0 to 1)."""
    return _scored(documents).filter("label is not null").select("doc_id", "label", "exact", "start", "end", "votes", "score")


def license_scan(documents: DataFrame) -> DataFrame:
    """A row for each row of documents(doc_id, text, ...), whether or not a license is in it.

    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. Null and empty texts have no words, no
    places and score 0. Each row is judged by its own text: null and repeated doc_ids give a row each. Other columns are
    ignored. Only counts and votes leave the scan, so nothing of the texts is shuffled.
    """
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    at = F.when(F.col("exact"), F.col("start").cast("long"))
    made = _scored(documents).groupBy("_row", "doc_id", "n_words").agg(
        F.count(at).alias("n_base"), F.min(at).alias("first_word"), F.max(at).alias("last_word"), names(F.when(F.col("exact"), F.col("label"))).alias("base_labels"), names("label").alias("labels"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score")
    )
    return made.drop("_row")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(kit.table(spark, sf_dir, "documents"))


def _sql() -> str:
    values = ", ".join(f"({i}, '{label}', {str(exact).lower()}, {k}, string_split('{' '.join(words)}', ' '))" for i, label, exact, k, words in templates())
    return rf"""
WITH t(template, label, exact, k, want) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tg AS (SELECT template, k, j, array_to_string(want[j:j + k - 1], ' ') AS g FROM t, unnest(range(1, len(want) - k + 2)) AS r(j)),
dg AS (SELECT doc_id, n.k, p, array_to_string(w[p:p + n.k - 1], ' ') AS g FROM d, (VALUES {', '.join(f'({k})' for k in GRAMS)}) AS n(k), unnest(range(1, len(w) - n.k + 2)) AS r(p)),
diag AS (SELECT doc_id, template, p - j AS diagonal, flatten(list(range(j, j + dg.k))) AS h FROM dg JOIN tg ON dg.g = tg.g AND dg.k = tg.k GROUP BY ALL),
runs AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN exact OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {SLACK} IS NOT TRUE THEN 1 ELSE 0 END AS far
  FROM (SELECT doc_id, template, diagonal, list_distinct(flatten(list(h))) AS h FROM diag GROUP BY ALL) JOIN t USING (template))),
span AS (SELECT doc_id, template, label, exact, len(want) AS size, min(diagonal) AS low, list_distinct(flatten(list(h))) AS h FROM runs GROUP BY doc_id, template, label, exact, want, run),
ok AS (SELECT *, low + list_min(h) - 1 AS start, len(h) / size AS score FROM span WHERE CASE WHEN exact THEN len(h) = size ELSE len(h) / size >= {LEAST} END),
f AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM ok GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN f USING (doc_id)
"""


OP3_SQL = _sql()

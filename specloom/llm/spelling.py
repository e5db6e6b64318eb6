"""Spelling variant grouping (operator 13) by asymmetric q-chunks, in DataFrame functions only.

Two words one edit apart share one of two disjoint chunks: the shorter word (either of two of one length) contributes its
two halves, the other its positional grams of their lengths, at the chunk's place or one further, as an insertion may shift
it. So that no list grows long, a chunk is joined together with that half of the other chunk which the same edit spares: a
word has four keys, each all of it but about a quarter. Keys are joined as 64-bit hashes and every pair is verified.

Words are counted where they are read and summed by word; only words that are long and frequent enough are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm import kit
from specloom.llm.merkle import CRC_SQL, crc_sql

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO, TYPO_MODULUS = 6, 5, 5, 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(word: Column) -> Column:
    """A-Z lower-cased; lower() would also touch other letters, so it serves words of ASCII only."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def counted(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, modulus: int = TYPO_MODULUS) -> DataFrame:
    """word and n: the words of documents(doc_id, text) of that length and count at least.

    Where modulus divides the CRC-32 of <doc_id>:<word>, a code point of the word is deleted first; 0 deletes none. A null
    text has no words; a null doc_id is written as nothing.
    """
    runs = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), 0)).alias("run"))
    words = runs.select("id", lower_ascii(F.col("run")).alias("word"))
    if modulus:
        hashed = words.select("word", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")).alias("h"))
        at = (F.col("h") % F.length("word")).cast("int")
        words = hashed.select(F.when(F.col("h") % modulus == 0, F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))).otherwise(F.col("word")).alias("word"))
        words = words.filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _keys(length: Column, word: Column, shift: int) -> Column:
    """Four hashes of what a chunk word of that length shares with word, which is longer by shift, if the edit is in the
    last, third, first or second of its quarters."""
    half = F.floor(length / 2).cast("int")
    first, third = F.floor(half / 2).cast("int"), half + F.floor((length - half) / 2).cast("int")  # where the second and the fourth quarter start
    part = lambda a, b: F.substring(word, a + 1, b - a)
    end, start = length + shift, F.lit(0)
    kept = [
        (part(start, half), part(half, third)),  # first chunk in place, third quarter
        (part(start, half), part(third + shift, end)),  # first chunk in place, last quarter
        (part(half + shift, end), part(first + shift, half + shift)),  # second chunk shifted, second quarter
        (part(half + shift, end), part(start, first)),  # second chunk shifted, first quarter
    ]
    return F.array(*(F.xxhash64(F.lit(i), length, *texts) for i, texts in enumerate(kept)))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n of words(word, n): both directions of each pair that one inserted, deleted or replaced code point
    parts. A pair may come up under more than one key."""
    length = F.length("word")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(_keys(length, F.col("word"), 0)).alias("key"))
    grams = F.concat(F.transform(_keys(length, F.col("word"), 0), lambda k: F.struct(k.alias("key"), F.lit(0).alias("shift"))), F.transform(_keys(length - 1, F.col("word"), 1), lambda k: F.struct(k.alias("key"), F.lit(1).alias("shift"))))
    grams = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.inline(grams))
    longer = (F.length("b") - F.length("a") == F.col("shift")) & ((F.col("shift") == 1) | (F.col("a") < F.col("b")))
    found = chunks.join(grams, "key").filter(longer & (F.levenshtein("a", "b", 1) == 1))
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    return found.select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of forms(word, form): forms followed to the last one, by pointer doubling.

    Counts grow along a chain by the ratio at least, so a chain is short and has no circle.
    """
    reached = kit.cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = reached.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        stepped = kit.cut(reached.join(onward, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        moved = not stepped.filter("moved").isEmpty()
        reached = stepped.select("word", "root")
        if not moved:
            return reached


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of words(word, n), whose words are distinct.

    form is the near word of largest n (ties: the smallest in code-point order) if its n is at least ratio times the
    word's; root is the last form that follows from word, or word itself. An empty table gives an empty one.
    """
    near = near_pairs(words).repartition("word").distinct().groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best_n = -F.col("best.less")
    taken = best_n >= ratio * F.col("n")
    formed = kit.cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, best_n).alias("form_n")))
    rooted = roots(formed.filter("form is not null"))
    return formed.join(rooted, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Repeated rows count again; columns other than doc_id and text are ignored."""
    words = kit.cut(counted(kit.table(spark, sf_dir, "documents")))
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


#: Pairs by brute force: every word with each code point left out, or replaced by a mark.
OP13_SQL = rf"""
WITH RECURSIVE {CRC_SQL},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS c FROM r WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, c, {crc_sql("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM d, crc),
w AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cut AS (SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS masked, left(word, i) || substr(word, i + 2) AS shorter FROM w, unnest(range(0, length(word))) AS p(i)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.masked = b.masked AND a.word <> b.word UNION SELECT w.word, cut.word, cut.n FROM w JOIN cut ON cut.shorter = w.word UNION SELECT cut.word, w.word, w.n FROM w JOIN cut ON cut.shorter = w.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -near_n, near := near)) AS b FROM pairs GROUP BY word),
f AS (SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.less >= 5 * n THEN b.near END AS form, CASE WHEN -b.less >= 5 * n THEN (-b.less)::BIGINT END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS last_form, form FROM f UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON f.word = chain.form)
SELECT f.word, f.form, last_form AS root, n, n_near, form_n FROM f JOIN chain ON chain.word = f.word AND chain.form IS NULL
"""

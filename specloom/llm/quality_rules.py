"""Quality rules as a bitmask ledger (operator 1), in DataFrame functions only.

Each document is measured once. Every rule is a predicate over the measurements and owns one bit; the ledger keeps the
measurements and the failed bits. A policy is a versioned set of rules, so a mask: a document passes if no bit of the
mask is set. Applying another policy or leaving a rule out reads the ledger, never the texts.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm import kit
from specloom.llm.kit import let

WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
WINDOW = 8

#: Name and failing condition; the place is the bit. Add at the end only, so that old ledgers keep their meaning.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines AND n_dup_lines >= 3"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
)

POLICIES = {1: ("few_words", "repeated_windows"), 2: ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length")}


def mask(names) -> int:
    order = [name for name, _ in RULES]
    return sum(1 << order.index(name) for name in names)


def _covered(places: Column) -> Column:
    """Words that windows starting at sorted places cover."""
    gap = lambda i: F.least(F.coalesce(F.get(places, i + 1) - F.get(places, i), F.lit(WINDOW)), F.lit(WINDOW))
    return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), F.lit(0), lambda a, i: a + gap(i))


def _repeated(hashes: Column) -> Column:
    """Sorted starts of the windows that occur twice or more: equal neighbours once windows are sorted by hash."""
    same = lambda s, i, j: F.get(s, i).h == F.get(s, j).h
    found = lambda s: F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(s, i, i - 1) | same(s, i, i + 1)), lambda i: F.get(s, i).p)
    return F.sort_array(let(F.sort_array(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p")))), found))


def _repeat_words(words: Column) -> Column:
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
    count = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(_repeated(w), _covered))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count))


MEASURES = {"n_words": "w.n", "word_chars": "c", "n_symbols": "s", "n_lines": "l.n", "n_dup_lines": "l.d", "n_repeat_words": "w.r"}


def measured(documents: DataFrame, name: str) -> DataFrame:
    """documents with their measurements, all long, in a struct column of that name; null and empty texts measure 0.

    Windows are compared by 64-bit hashes of their words within one text. Each row is measured by its own text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    of_words = let(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    of_lines = let(F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)), lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("d")))
    made = F.struct(of_words.alias("w"), of_lines.alias("l"), F.length(F.regexp_replace(text, GAP, "")).alias("c"), F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).alias("s"))
    taken = documents.select("*", F.explode(F.array(made)).alias(name))  # the generator keeps it from being measured again for each use
    return taken.withColumn(name, F.struct(*(F.col(f"{name}.{c}").cast("long").alias(n) for n, c in MEASURES.items())))


def fail_bits(name: str) -> Column:
    """Bits of the rules that the measurements in the struct column of that name fail."""
    failing = lambda text: F.expr(re.sub(r"\b(" + "|".join(MEASURES) + r")\b", rf"`{name}`.\1", text))
    bits = [F.when(failing(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, condition) in enumerate(RULES)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def ledger(documents: DataFrame, keep=("doc_id",)) -> DataFrame:
    """A row for each row of documents(doc_id, text, ...): keep, measurements and fail_bits.

    Other columns are ignored; of keep, a column named as a measurement or fail_bits gives way to the ledger's own.
    Repeated rows give repeated rows, an empty table none.
    """
    name = kit.fresh(documents, "ledger")
    own = [*MEASURES, "fail_bits"]
    kept = [kit.named(c) for c in keep if c.lower() not in own]
    return measured(documents, name).select(*kept, f"{name}.*", fail_bits(name).alias("fail_bits"))


def passing(documents: DataFrame, version: int) -> DataFrame:
    """The rows of documents, with their own columns only and whatever these are called, that pass a policy."""
    name = kit.fresh(documents, "ledger")
    return measured(documents, name).filter(passes(version, fail_bits(name))).select(*kit.own(documents))


def passes(version: int, bits: Column | str = "fail_bits") -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0


def ablation(made: DataFrame, policies=POLICIES) -> DataFrame:
    """For each policy and rule of it: documents kept, kept without the rule, failed by the rule, and by it alone.

    The ledger first shrinks to its distinct bit patterns, at most 2 to the number of rules.
    """
    patterns = made.groupBy("fail_bits").agg(F.count("*").alias("n"))
    order = [name for name, _ in RULES]
    cases = [F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(mask(rules)).cast("long").alias("mask"), F.lit(1 << order.index(r)).cast("long").alias("bit")) for v, rules in policies.items() for r in rules]
    each = patterns.select("fail_bits", "n", F.inline(F.array(*cases)))
    counted = lambda condition, name: F.sum(F.when(F.expr(condition), F.col("n")).otherwise(0)).alias(name)
    return each.groupBy("version", "rule").agg(
        counted("fail_bits & mask = 0", "kept"), counted("fail_bits & (mask & ~bit) = 0", "kept_without"), counted("fail_bits & bit <> 0", "failed"), counted("fail_bits & mask = bit", "failed_alone"), F.bit_or("fail_bits").alias("bits_seen")
    )


def op1_quality_rules(spark, sf_dir: str, version: int = 2) -> DataFrame:
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[1])).cast("long")) != 0
    made = ledger(kit.table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes(version)).alias("kept"), "fail_bits")


def rule_ablation(spark, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs, from a ledger that is written once."""
    made = ledger(kit.table(spark, sf_dir, "documents"))
    return ablation(kit.cut(made)).select("version", "rule", "kept", "kept_without", "failed", "failed_alone")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 6, 1))) AS r(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
reps AS (SELECT doc_id, count(DISTINCT p) AS n FROM rep, unnest(range(i, i + 8)) AS r(p) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  coalesce(lines.n, 0)::BIGINT AS n_lines, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(reps.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN reps USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END
  + CASE WHEN 100 * n_dup_lines > 50 * n_lines AND n_dup_lines >= 3 THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 16 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

_CASES = ", ".join(f"({v}, '{name}', {mask(names)}, {mask([name])})" for v, names in POLICIES.items() for name in names)
ABLATION_SQL = f"""
SELECT version, rule, count(*) FILTER (fail_bits & mask = 0) AS kept, count(*) FILTER (fail_bits & (mask - bit) = 0) AS kept_without, count(*) FILTER (fail_bits & bit <> 0) AS failed, count(*) FILTER (fail_bits & mask = bit) AS failed_alone
FROM ({OP1_SQL}), (VALUES {_CASES}) AS c(version, rule, mask, bit) GROUP BY version, rule
"""

"""URL filter by association rules (operator 7), in DataFrame functions and Spark ML only.

A short list of host and path rules decides first. The pages that it reaches, with its verdicts as labels, are what
FP-growth mines for combinations of URL tokens that go with a verdict. Rules pruned by support and confidence judge the
URLs that no listed rule fits, through an inverted index: a rule is filed under its rarest token only, then its other
tokens are tested. Rules that can never decide, as one with fewer tokens always comes first, are dropped before.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm import kit

#: Host, path and verdict.
LISTED = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
SUPPORT, CONFIDENCE = 0.01, 0.9


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(listing=LISTED) -> tuple[Column, Column]:
    """Rule and verdict of the longest listed rule that fits host and path, else null. For lists that fit in a plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(listing, key=lambda r: len(r[0] + r[1])):  # the longest is tested first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, path segments (digits as one #), query keys, fragment."""
    digits = lambda c: F.regexp_replace(c, r"\d+", "#")
    tagged = lambda tag, a: F.transform(F.filter(a, lambda x: x != ""), lambda x: F.concat(F.lit(tag + ":"), x))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.split(x, "=", 2)[0])
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    parts = [tagged("scheme", F.array(scheme)), tagged("host", F.split("host", r"\.")), tagged("path", F.transform(F.split("path", "/"), digits)), tagged("key", keys), tagged("part", F.array(F.regexp_extract(url, r"(?s)#(.+)$", 1)))]
    return F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in parts)))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """rule_tokens, learned, confidence, support of all rules from (tokens, verdict) rows."""
    spark = labelled.sparkSession
    if labelled.isEmpty():
        return spark.createDataFrame([], "rule_tokens array<string>, learned string, confidence double, support double")
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))
    rules = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items).associationRules
    return rules.filter(F.get("consequent", F.lit(0)).startswith("verdict:")).select(F.array_sort("antecedent").alias("rule_tokens"), F.substring(F.get("consequent", F.lit(0)), 9, 99).alias("learned"), "confidence", "support")


def alike(labelled: DataFrame, support: float) -> DataFrame:
    """token, chosen and members of labelled(row, tokens): tokens of enough rows, with the first of those that stand in exactly the same rows.

    Rows of a token are compared by count and two sums of hashes, so a token is one row before the shuffle.
    """
    least = F.ceil(F.lit(support) * labelled.count())
    each = labelled.select(F.xxhash64("row").alias("h"), F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("h").alias("a"), F.sum(F.shiftright("h", 24)).alias("b")).filter(F.col("n") >= least)
    return seen.groupBy("n", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("members")).select(F.explode("members").alias("token"), F.get("members", F.lit(0)).alias("chosen"), "members")


def mine_deciding(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """The rules of mine that can decide, and perhaps others, without growing the sets that can't.

    Tokens that always occur together make rules of equal confidence and support, and a rule with two of them comes after
    the one without the second. So only one of them is mined, and then stands for each of the others in turn: what
    prune leaves is the same, but a path of many segments that always come together costs its length, not all its subsets.
    """
    labelled = kit.cut(labelled.withColumn("row", F.monotonically_increasing_id()))
    if labelled.isEmpty():
        return mine(labelled, support, confidence)
    classes = kit.cut(alike(labelled, support))
    chosen = kit.few(classes.filter("token = chosen").select("token"), 64)
    kept = labelled.select("row", F.explode("tokens").alias("token")).join(chosen, "token", "left_semi").groupBy("row").agg(F.collect_list("token").alias("held"))
    reduced = labelled.select("row", "verdict").join(kept, "row", "left").select(F.coalesce("held", F.array().cast("array<string>")).alias("tokens"), "verdict")
    rules = kit.cut(mine(kit.cut(reduced), support, confidence).withColumn("rule", F.monotonically_increasing_id()))
    members = rules.select("rule", F.explode("rule_tokens").alias("chosen")).join(kit.few(classes.filter("token = chosen").select("chosen", "members"), 256), "chosen").groupBy("rule").agg(F.collect_list("members").alias("each"))
    put = lambda sets, members: F.flatten(F.transform(sets, lambda s: F.transform(members, lambda m: F.concat(s, F.array(m)))))
    sets = F.aggregate("each", F.array(F.array().cast("array<string>")), put)
    return rules.join(members, "rule").select(F.explode(F.transform(sets, lambda s: F.array_sort(s))).alias("rule_tokens"), "learned", "confidence", "support")


def place() -> Column:
    """Order in which rules decide: confidence, support, fewest tokens, text."""
    return F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("rule_tokens").alias("n"), F.array_join("rule_tokens", " ").alias("name"), F.col("learned").alias("v"))


def prune(rules: DataFrame) -> DataFrame:
    """rules but those whose tokens include all of a rule that comes before: wherever such a rule fits, the other decides."""
    rules = kit.cut(rules.withColumn("place", place()))
    filed = _filed(rules, rules.select(F.explode("rule_tokens").alias("token"))).select("token", F.col("rule_tokens").alias("less"), F.col("place").alias("before"))
    pairs = rules.select("rule_tokens", "learned", "place", F.explode("rule_tokens").alias("token")).join(filed, "token")
    idle = pairs.filter((F.size(F.array_except("less", "rule_tokens")) == 0) & (F.col("before") < F.col("place"))).select("rule_tokens", "learned").distinct()
    return rules.join(idle, ["rule_tokens", "learned"], "left_anti").select(rules.columns)


def _filed(rules: DataFrame, seen: DataFrame) -> DataFrame:
    """rules with the token each is filed under: the one that is rarest in seen."""
    counts = seen.groupBy("token").count()
    rarest = rules.select("rule_tokens", F.explode("rule_tokens").alias("token")).join(counts, "token", "left").groupBy("rule_tokens").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    return rules.join(rarest, "rule_tokens")


def url_filter(pages: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, listing=LISTED) -> DataFrame:
    """A row for each row of pages(page_id, url, ...): page_id, host, path, rule, verdict, learned_rule (tokens of the rule used).

    A null url or one without :// has empty host and path, no tokens, and is allowed unless a listed rule fits. Of
    several learned rules the most confident decides, then the best supported, the shortest, the first in order of text.
    Without any, the verdict is allow. Each row is judged by its own url, whatever its page_id. An empty table gives none;
    other columns are ignored.
    """
    rule, verdict = listed(listing)
    url = F.col("url")
    parsed = pages.select("page_id", "url", host(url).alias("host"), path(url).alias("path"))
    judged = parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.when(url.contains("://"), tokens(url)).otherwise(F.array().cast("array<string>")).alias("tokens"))
    learned = kit.cut(prune(mine_deciding(judged.select("tokens", "verdict").filter("verdict is not null"), support, confidence)))
    index = _filed(learned, judged.select(F.explode("tokens").alias("token"))).select(F.col("token").alias("filed"), "rule_tokens", "learned", "place")
    # Rows are told apart by a number of their own; of each, its first token stays even if no rule is filed there.
    each = judged.withColumn("row", F.monotonically_increasing_id()).select("*", F.posexplode_outer(F.when(F.col("verdict").isNull(), F.col("tokens"))).alias("at", "token"))
    fits = (F.col("token") == F.col("filed")) & (F.size(F.array_except("rule_tokens", "tokens")) == 0)
    tested = each.join(kit.few(index, 256), fits, "left").filter("filed is not null or coalesce(at, 0) = 0")
    found = tested.groupBy("row", "page_id", "host", "path", "rule", "verdict").agg(F.min_by(F.struct("learned", F.array_join("rule_tokens", " ").alias("name")), "place").alias("best"))
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", "best.learned", F.lit("allow")).alias("verdict"), F.col("best.name").alias("learned_rule"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(kit.table(spark, sf_dir, "pages"))


def _sql() -> str:
    """All subsets of each page's tokens, counted: every rule by brute force, without growth, pruning or index."""
    order = sorted(LISTED, key=lambda r: -len(r[0] + r[1]))
    case = lambda of: " ".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN '{of((h, p, v))}'" for h, p, v in order)
    tagged = lambda tag, a: f"list_transform(list_filter({a}, lambda x: x <> ''), lambda x: '{tag}:' || x)"
    parts = [
        tagged("scheme", "[lower(regexp_extract(url, '(?s)^(.*?)://', 1))]"), tagged("host", "string_split(host, '.')"), tagged("path", "list_transform(string_split(path, '/'), lambda x: regexp_replace(x, '[0-9]+', '#', 'g'))"),
        tagged("key", "list_transform(string_split(regexp_extract(url, '(?s)\\?([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1))"), tagged("part", "[regexp_extract(url, '(?s)#(.+)$', 1)]"),
    ]
    return rf"""
WITH p AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT page_id, url, host, path, CASE {case(lambda r: r[0] + r[1])} END AS rule, CASE {case(lambda r: r[2])} END AS listed, CASE WHEN contains(url, '://') THEN list_sort(list_distinct(flatten([{', '.join(parts)}]))) ELSE [] END AS tokens FROM p),
known AS (SELECT listed, list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) AS part FROM j, unnest(range(1, (1 << len(tokens))::BIGINT)) AS r(m) WHERE listed IS NOT NULL),
n AS (SELECT count(*) AS n FROM j WHERE listed IS NOT NULL),
rules AS (SELECT part, listed AS learned, c / sum(c) OVER (PARTITION BY part) AS confidence, c / n AS support, c, n FROM (SELECT part, listed, count(*) AS c FROM known GROUP BY ALL), n),
good AS (SELECT *, array_to_string(part, ' ') AS name FROM rules WHERE c >= ceil({SUPPORT} * n) AND confidence >= {CONFIDENCE}),
open_ AS (SELECT DISTINCT url, tokens FROM j WHERE listed IS NULL),
own AS (SELECT url, list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) AS part FROM open_, unnest(range(1, (1 << len(tokens))::BIGINT)) AS r(m)),
best AS (SELECT url, learned, name FROM own JOIN good USING (part) QUALIFY row_number() OVER (PARTITION BY url ORDER BY confidence DESC, support DESC, len(part), name, learned) = 1)
SELECT page_id, host, path, rule, coalesce(listed, learned, 'allow') AS verdict, CASE WHEN listed IS NULL THEN name END AS learned_rule FROM j LEFT JOIN best USING (url)
"""


OP7_SQL = _sql()

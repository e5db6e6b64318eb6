"""Mixing sources to target weights by Poisson replication (operator 8), in DataFrame functions only.

A source's mean repetition rate is its target size over its size. Each document draws its number of copies by inverting
the Poisson distribution at a number hashed from seed and doc_id (or text, without one), so any run, task or retry draws the same. Copies are
exploded and dealt over all partitions by a hash, then sorted by it: a global shuffle without a range sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm import kit

MOST_RATE = 64
BROADCAST_SOURCES = 100_000
SALTS = 64


def uniform(*parts: Column) -> Column:
    """[0, 1) from 52 bits of the MD5 of the parts joined by colons."""
    key = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def poisson_table(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... copies, as far as 52 bits tell."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def more(a, k):
        p = a.p * rate / k
        return F.struct(p.alias("p"), F.concat(a.c, F.array(F.element_at(a.c, -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, more, lambda a: a.c)


def rates(documents: DataFrame, weights: dict[str, float] | None, exponent: float, epochs: float) -> DataFrame:
    """source, size (characters), rate, and the table for one of parts equal draws that together have the rate."""
    sizes = documents.select("source", "text").groupBy("source").agg(F.sum(F.length(F.coalesce(F.col("text"), F.lit("")))).alias("size"))
    if weights is None:
        target = F.pow(F.col("size").cast("double"), F.lit(float(exponent)))
    else:
        target = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v)))), F.coalesce("source", F.lit(""))), F.lit(0.0)) if weights else F.lit(0.0)
    aimed = sizes.withColumn("target", target)
    whole = aimed.agg(F.sum("size").alias("all_size"), F.sum("target").alias("all_target"))
    rate = F.when((F.col("size") > 0) & (F.col("all_target") > 0), F.col("all_size") * F.lit(float(epochs)) * F.col("target") / F.col("all_target") / F.col("size")).otherwise(0.0)
    rated = aimed.join(F.broadcast(whole)).select("source", "size", rate.alias("rate"))  # one row
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_RATE).cast("int"))
    return rated.withColumn("parts", parts).withColumn("cumulative", poisson_table(F.col("rate") / F.col("parts")))


def mix(documents: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """documents' own columns, with replica (0, 1, ...) and order_key, shuffled.

    weights: target share by source; a source that it leaves out gets none. None: shares in proportion to size to the
    power exponent, size in characters. The output has epochs times the characters of the input in expectation. A null
    source is a source; a null text has no characters and is copied at its source's rate; rows that repeat a doc_id draw
    alike, rows without one draw by their text. A source of no characters gets none. An empty table gives none. A column of documents that is called replica or
    order_key gives way to the result's own; other names may be any.
    """
    own = [kit.named(c) for c in documents.columns if c.lower() not in ("replica", "order_key")]
    identity = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    source, parts, cumulative, copies, salt = (kit.fresh(documents, n) for n in ("of_source", "n_parts", "cumulative", "n_copies", "salt"))
    known = rates(documents, weights, exponent, epochs)
    known = kit.cut(known.select(F.col("source").alias(source), F.col("parts").alias(parts), F.col("cumulative").alias(cumulative)))
    key = F.col("source").eqNullSafe(F.col(source))
    if known.count() <= BROADCAST_SOURCES:
        joined = documents.join(F.broadcast(known), key)
    else:  # a large source's rows are dealt over SALTS tasks
        salted = known.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = documents.join(salted, key & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int") == F.col(salt)))
    drawn = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda a, j: a + kit.let(uniform(F.lit(seed), identity, j), lambda u: F.size(F.filter(cumulative, lambda c: c <= u))))
    counted = joined.select(*own, drawn.alias(copies)).filter(F.col(copies) > 0)
    copied = counted.select(*own, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)).alias("replica"))
    keyed = copied.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(seed), identity, F.col("replica").cast("string"), F.lit("order")).cast("binary")))
    return keyed.repartition("order_key").sortWithinPartitions("order_key")


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(kit.table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE s AS (SELECT source, sum(length(coalesce(text, '')))::BIGINT AS size FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(size) FROM s)::BIGINT::DOUBLE * 1.0 * pow(size::DOUBLE, 0.5) / (SELECT sum(pow(size::DOUBLE, 0.5)) FROM s) / size AS rate FROM s WHERE size > 0),
q AS (SELECT source, greatest(1, ceil(rate / 64)::INT) AS parts, rate / greatest(1, ceil(rate / 64)::INT) AS rate FROM r),
c AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cum FROM q UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cum + p * rate / (k + 1) FROM c WHERE k + 1 <= ceil(rate + 10 * sqrt(rate) + 20)),
t AS (SELECT source, list(cum ORDER BY k) AS cums FROM c GROUP BY source),
u AS (SELECT doc_id, text, lang, d.source AS source, n_chars, cums, unnest(range(1, parts + 1)) AS j FROM documents d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN t ON t.source IS NOT DISTINCT FROM d.source),
n AS (SELECT doc_id, text, lang, source, n_chars, sum(len(list_filter(cums, lambda x: x <= ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) || ':' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)))::BIGINT AS copies FROM u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, r::INT AS replica, md5('17:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) || ':' || r || ':order') AS order_key FROM n, unnest(range(0, copies)) AS x(r)
"""

"""A corpus pipeline: documents through five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm import decontaminate, kit, mixing, ngram_join, quality_model, quality_rules


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among docs, scores 0.5 or more."""
    model, name = quality_model.fit(docs, kit.table(spark, sf_dir, "labels")), kit.fresh(docs, "quality_score")
    return quality_model.score(docs, model, name).filter(F.col(name) >= 0.5).select(*kit.own(docs))


def quality_rule_ledger(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy."""
    return quality_rules.passing(docs, 2)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the row of smallest doc_id, one without a doc_id only
    where no other is. Documents without words stay.

    Documents link from 80 percent of their 5-word shingles on; op5's own 4 words and 85 percent bind only that query.
    Rows are told apart by doc_id and text, so another text under the same doc_id is judged on its own.
    """
    found = kit.cut(ngram_join.ngram_join(docs, k=5, percent=80, count_links=False).filter("group_key is not null").select("doc_id", "row_key", "group_key"))
    kept = found.groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("r")).select("r.doc_id", "r.row_key")
    same = F.col("f.row_key").eqNullSafe(F.col("k.row_key")) & F.col("f.doc_id").eqNullSafe(F.col("k.doc_id"))
    left = kit.without(docs, found.alias("f").join(kept.alias("k"), same, "left_anti"))
    again = found.groupBy("doc_id", "row_key").count().filter("count > 1")
    if again.isEmpty():
        return left
    # Rows that repeat in doc_id and text are one document.
    again = kit.cut(again)
    repeats = left.join(kit.few(again.select(F.col("row_key").alias(row := kit.fresh(docs, "repeated"))), 16), kit.row_key() == F.col(row), "left_semi")
    return kit.without(left, again).union(repeats.dropDuplicates(["doc_id", "text"]))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate.contamination(docs, kit.table(spark, sf_dir, "benchmark"))
    return kit.without(docs, found.filter(F.size("items") > 0))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, shuffled, so that sources have their target shares."""
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rule_ledger),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.table(spark, sf_dir, "documents")
    folder = f"{kit.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The classifier is fitted, so SQL can't express run().
ORACLE_SQL = None

"""Rules as rows: conditions are joined to facts, priority decides within a group, and every evaluation leaves a trace.

Rules are immutable: rows (rule_id, version, status, rule_group, priority, action). The latest version of a rule counts, and
only if it is active. Conditions are rows (rule_id, version, fact, op, number, text); all of a rule's must hold. A rule that
needs others also takes over their conditions, so it can fire only where they do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.operators import relations
from specloom.operators.shared import cut, join_few

ALWAYS = "*"
OPERATIONS = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def facts(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key, fact, number and text: the columns of df as rows, and one row of the fact that always is."""
    kinds = dict(df.dtypes)
    entry = lambda c: F.struct(F.lit(c).alias("fact"), (F.lit(None) if kinds[c] == "string" else F.col(c)).cast("double").alias("number"), (F.col(c) if kinds[c] == "string" else F.lit(None)).cast("string").alias("text"))
    always = F.struct(F.lit(ALWAYS).alias("fact"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("text"))
    return df.select(*key, F.inline(F.array(always, *map(entry, columns))))


def in_force(rules: DataFrame) -> DataFrame:
    """The latest version of each rule, where it is active."""
    latest = rules.groupBy("rule_id").agg(F.max_by(F.struct(*rules.columns), "version").alias("r")).select("r.*")
    return latest.filter("status = 'active'")


def conditions_of(rules: DataFrame, conditions: DataFrame, needs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rule_id, origin, fact, op, number, text) of rules in force, those of what they need included, and refused (rule_id,
    reason): rules in a cycle, above one, or in need of a rule that isn't in force."""
    own = conditions.join(rules.select("rule_id", "version"), ["rule_id", "version"]).select("rule_id", F.col("rule_id").alias("origin"), "fact", "op", "number", "text")
    always = rules.select("rule_id", F.col("rule_id").alias("origin"), F.lit(ALWAYS).alias("fact"), F.lit("any").alias("op"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("text"))
    own = own.unionByName(always)
    if needs is None:
        return own, rules.select("rule_id", F.lit("").alias("reason")).limit(0)
    level = relations.levels(rules.select(F.col("rule_id").alias("id")), needs.select(F.col("rule_id").alias("id"), F.col("needed")))
    cyclic = level.filter("level is null").select(F.col("id").alias("rule_id"), F.lit("cycle").alias("reason"))
    spans = needs.select(F.col("rule_id").alias("source"), F.col("needed").alias("target"), F.lit("0001-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    reach = cut(relations.closure(spans).select(F.col("source").alias("rule_id"), F.col("target").alias("origin")).distinct())
    absent = reach.join(rules.select(F.col("rule_id").alias("origin")), "origin", "left_anti").select("rule_id", F.lit("needs a rule not in force").alias("reason")).distinct()
    refused = cut(cyclic.unionByName(absent.join(cyclic, "rule_id", "left_anti")).join(rules, "rule_id", "left_semi"))
    taken = reach.join(own.drop("rule_id"), "origin").select("rule_id", "origin", "fact", "op", "number", "text")
    return own.unionByName(taken).join(refused, "rule_id", "left_anti"), refused


def evaluate(facts: DataFrame, key: list[str], rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """A trace row for each key and rule: outcome, action, n_met, n_conditions, failed.

    facts is (key, fact, number, text), a fact once for each key; rules are those in force, conditions as conditions_of gives
    them. A condition compares number, or text where the condition has one; a fact that is missing or null meets none. Where
    all hold, the rule fires: of those of its group the one of smallest priority is executed (ties: by rule_id), the others
    are overruled. A rule that doesn't fire is skipped; failed names its conditions that don't hold, each as `fact op value`.

    Facts are dealt once, by a hash of their key (a float in a key would be dealt again for each step); counting and ranking
    need no other shuffle where rules and conditions go to all tasks.
    """
    sizes = conditions.groupBy("rule_id").agg(F.count("*").alias("n_conditions"))
    wanted = cut(conditions.join(sizes, "rule_id").select("rule_id", "n_conditions", "fact", "op", F.col("number").alias("bound"), F.col("text").alias("word")))
    met = F.col("op") == "any"
    for name, holds in OPERATIONS.items():
        same = F.when(F.col("word").isNotNull(), holds(F.col("text"), F.col("word"))).otherwise(holds(F.col("number"), F.col("bound")))
        met = F.when(F.col("op") == name, F.coalesce(same, F.lit(False))).otherwise(met)
    dealt = facts.withColumn("_k", F.xxhash64(*key)).repartition("_k")
    judged = join_few(dealt, wanted, ["fact"], F.struct(*key), 120).withColumn("met", met)
    counted = judged.groupBy("_k", *key, "rule_id").agg(F.count_if("met").alias("n_met"), F.max("n_conditions").alias("n_conditions"), F.collect_set(F.when(F.col("met"), F.xxhash64("fact", "op", "bound", "word"))).alias("_held"))
    expected = cut(wanted.groupBy("rule_id").agg(F.collect_set(F.struct(F.concat_ws(" ", "fact", "op", F.coalesce("word", F.col("bound").cast("string"))).alias("said"), F.xxhash64("fact", "op", "bound", "word").alias("h"))).alias("_all")))
    told = rules.join(expected, "rule_id").select("rule_id", "version", "rule_group", "priority", "action", "_all")
    full = join_few(counted, told, ["rule_id"], F.struct(*key), 400)
    fires = F.col("n_met") == F.col("n_conditions")
    first = F.row_number().over(Window.partitionBy("_k", *key, "rule_group", fires).orderBy("priority", "rule_id"))
    outcome = F.when(~fires, "skipped").when(F.col("_place") == 1, "executed").otherwise("overruled")
    failed = F.array_sort(F.transform(F.filter("_all", lambda c: ~F.array_contains("_held", c.h)), lambda c: c.said))
    return full.withColumn("_place", first).select(*key, "rule_id", "version", "rule_group", outcome.alias("outcome"), F.when(outcome == "executed", F.col("action")).alias("action"), "n_met", "n_conditions", failed.alias("failed"))

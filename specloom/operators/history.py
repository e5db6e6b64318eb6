"""Versioned records: lookup at a point in time, and the difference between two states of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(versions: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of the largest version of each key."""
    return versions.groupBy(*key).agg(F.max_by(F.struct(*(c for c in versions.columns if c not in key)), version).alias("r")).select(*key, "r.*")


def at_time(lookups: DataFrame, versions: DataFrame, key: list[str], at: str, since: str, order: str, bucket: Column, value: list[str]) -> DataFrame:
    """lookups with value: the columns of the version of their key that was in force at their time, null before the first.

    versions hold since their time until the next one; of versions of one key and time the largest order counts. bucket is an
    expression over the column _time that cuts time into slices, in ascending order.

    A key's history never meets in one task: versions and lookups of a key and slice are put in order together, and what a
    slice inherits comes of one row for each key and slice, the last version of the slices before it.
    """
    held = F.struct(*(F.col(c) for c in value))
    kept = [c for c in lookups.columns if c not in key]
    empty = F.struct(*(F.lit(None).cast(lookups.schema[c].dataType).alias(c) for c in kept)) if kept else F.lit(None)
    old = versions.select(*key, F.col(since).alias("_time"), F.lit(0).alias("_asks"), F.col(order).alias("_order"), held.alias("_held"), empty.alias("_row"))
    asked = lookups.select(*key, F.col(at).alias("_time"), F.lit(1).alias("_asks"), F.lit(None).cast(versions.schema[order].dataType).alias("_order"), F.lit(None).cast(old.schema["_held"].dataType).alias("_held"), F.struct(*kept).alias("_row"))
    dealt = old.unionByName(asked).withColumn("_slice", bucket).repartition(*key, "_slice")
    inside = Window.partitionBy(*key, "_slice").orderBy("_time", "_asks", "_order").rowsBetween(Window.unboundedPreceding, 0)
    ordered = dealt.withColumn("_found", F.last("_held", ignorenulls=True).over(inside))
    ends = dealt.groupBy(*key, "_slice").agg(F.max_by("_held", F.when(F.col("_asks") == 0, F.struct("_time", "_order"))).alias("_end"))
    before = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    inherited = ends.withColumn("_inherited", F.last("_end", ignorenulls=True).over(before)).select(*(F.col(k).alias(f"_{k}") for k in key), F.col("_slice").alias("_of"), "_inherited")
    same = F.col("_slice").eqNullSafe(F.col("_of"))
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = ordered.filter("_asks = 1").join(inherited, same, "left")
    return joined.withColumn("_value", F.coalesce("_found", "_inherited")).select(*key, "_row.*", *(F.col(f"_value.{c}").alias(c) for c in value))


def differences(old: DataFrame, new: DataFrame, key: list[str], tolerance: float = 0.0, columns: list[str] | None = None) -> DataFrame:
    """key, column, old, new and kind: what differs between two states, a row for each cell.

    kind is changed; added or removed (column is null) for a key that only one state has; duplicate for one that a state has
    more than once: then old and new are its numbers of rows, and its cells aren't compared. Numbers differ if they are more
    than tolerance apart; a null differs from any value. Values are told as text.

    Both states go through one aggregation by key, which starts where they are read, so a key of many copies is one row
    before the shuffle, and neither state is sorted or joined.
    """
    columns = columns or [c for c in old.columns if c not in key]
    kinds = dict(old.select(*columns).dtypes)
    side = lambda df, is_new: df.select(*key, F.lit(is_new).alias("_new"), F.struct(*columns).alias("_row"))
    both = side(old, False).unionByName(side(new, True))
    met = both.groupBy(*key).agg(F.count_if(~F.col("_new")).alias("_n_old"), F.count_if("_new").alias("_n_new"), F.max(F.when(~F.col("_new"), F.col("_row"))).alias("_old"), F.max(F.when(F.col("_new"), F.col("_row"))).alias("_now"))
    told = lambda column, a, b, kind: F.struct(column.cast("string").alias("column"), a.cast("string").alias("old"), b.cast("string").alias("new"), F.lit(kind).alias("kind"))
    none = F.lit(None)

    def cell(c):
        a, b = F.col(f"_old.{c}"), F.col(f"_now.{c}")
        number = kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
        same = a.eqNullSafe(b) | (F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)) if number else F.lit(False))
        return F.when(~same, told(F.lit(c), a, b, "changed"))

    cells = F.array_compact(F.array(*map(cell, columns)))
    duplicate = (F.col("_n_old") > 1) | (F.col("_n_new") > 1)
    found = F.when(duplicate, F.array(told(none, F.col("_n_old"), F.col("_n_new"), "duplicate")))
    found = found.when(F.col("_n_old") == 0, F.array(told(none, none, none, "added"))).when(F.col("_n_new") == 0, F.array(told(none, none, none, "removed"))).otherwise(cells)
    return met.select(*key, F.inline(found))

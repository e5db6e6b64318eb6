"""Directed relations as edge tables: dependency levels, closure of versioned relations, compatible alternatives."""

from __future__ import annotations

import struct
import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.operators.shared import by_count, cut, join_few

WIDTH = 96  # bytes of an id or edge as a task holds it


def levels(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """id and level of nodes(id): 0 without needs, else one more than the highest of what it needs; null in a cycle or above
    one. needs is (id, needed); edges to nodes that aren't there count for nothing, repeated ones once.

    Peels the edge table: each round takes the nodes without an open need and drops the edges to them, so edges are read
    once for each level and nothing is ordered on the driver. Only nodes that lost an edge are looked at for the next round.
    """
    known = cut(nodes.select("id").distinct())
    n, edges = known.count(), needs.select("id", "needed").distinct()
    for end in ("needed", "id"):
        edges = edges.join(by_count(known.select(F.col("id").alias(end)), n, WIDTH), end, "left_semi")
    edges, done, level = cut(edges), known.limit(0).withColumn("level", F.lit(0)), 0
    free = cut(known.join(by_count(edges.select("id"), edges.count(), WIDTH), "id", "left_anti"))
    while n := free.count():
        done = done.unionByName(free.withColumn("level", F.lit(level)))
        marked = cut(edges.join(by_count(free.select(F.col("id").alias("needed"), F.lit(True).alias("met")), n, WIDTH), "needed", "left"))
        met, edges = cut(marked.filter("met").select("id").distinct()), marked.filter("met is null").drop("met")
        n = met.count()
        waiting = edges.select("id").join(by_count(met, n, WIDTH), "id", "left_semi").distinct()
        free = cut(met.join(by_count(waiting, n, WIDTH), "id", "left_anti"))
        level += 1
    rest = known.filter("id is not null").join(by_count(done.select("id"), done.count(), WIDTH), "id", "left_anti")
    return done.unionByName(rest.withColumn("level", F.lit(None).cast("int")))


def closure(edges: DataFrame) -> DataFrame:
    """source, target, valid_from, valid_to and hops of all paths over edges(source, target, valid_from, valid_to).

    A path holds while all its edges hold, from valid_from until before valid_to (null: for good); one that never does is no
    path. Of paths alike in ends and validity the shortest counts. Paths end where they would come back to their source, so
    cycles end. Semi-naive: each round joins only the paths that the last one found with the edges.
    """
    forever = F.lit("9999-12-31").cast("date")
    ends = F.coalesce("valid_to", forever)
    steps = cut(edges.select("source", "target", "valid_from", ends.alias("valid_to")).filter("source <> target and valid_from < valid_to").distinct())
    onward = steps.select(F.col("source").alias("target"), F.col("target").alias("next"), F.col("valid_from").alias("next_from"), F.col("valid_to").alias("next_to"))
    names = ["source", "target", "valid_from", "valid_to"]
    known = found = steps.withColumn("hops", F.lit(1))
    n_steps = n_known = n = steps.count()
    hops = 1
    while n:
        hops += 1
        met = by_count(found, n, WIDTH).join(onward, "target") if n < n_steps else found.join(by_count(onward, n_steps, WIDTH), "target")
        longer = met.select("source", F.col("next").alias("target"), F.greatest("valid_from", "next_from").alias("valid_from"), F.least("valid_to", "next_to").alias("valid_to"))
        longer = longer.filter("source <> target and valid_from < valid_to").distinct()
        found = cut(longer.join(by_count(known.select(*names), n_known, WIDTH), names, "left_anti").withColumn("hops", F.lit(hops)))
        known, n = known.unionByName(found), found.count()
        n_known += n
    return known.withColumn("valid_to", F.nullif("valid_to", forever))


def _smallest(v: float, width: float) -> float:
    """The smallest double u with v - u <= width as doubles are subtracted: the rounded v - width may miss it by some steps."""
    as_int = lambda x: struct.unpack("<q", struct.pack("<d", x))[0]
    order = lambda x: as_int(x) if as_int(x) >= 0 else -(as_int(x) & (1 << 63) - 1)
    double = lambda n: struct.unpack("<d", struct.pack("<q", n if n >= 0 else (-n | 1 << 63) - (1 << 64)))[0]
    low, high = order(-sys.float_info.max), order(v)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if v - double(middle) <= width else (middle + 1, high)
    return double(low)


def _ranked(products: DataFrame, column: str, width: float) -> DataFrame:
    """column, rank, lo and hi: each value's rank among the distinct ones, and the ranks of the first and last value that
    differ from it by at most width. Values and both ends of their ranges are put in one order, dealt by range."""
    ends = F.udf(lambda v: None if v is None else (_smallest(v, width), -_smallest(-v, width)), "struct<a:double,b:double>")
    values = cut(products.select(F.col(column).cast("double").alias("v")).distinct().withColumn("e", ends("v")))
    marks = values.select("v", F.inline(F.array(F.struct(F.col("e.a").alias("x"), F.lit(0).alias("k")), F.struct(F.col("v").alias("x"), F.lit(1).alias("k")), F.struct(F.col("e.b").alias("x"), F.lit(2).alias("k")))))
    dealt = cut(marks.repartitionByRange("x").withColumn("_part", F.spark_partition_id()))
    one = (F.col("k") == 1).cast("long")
    before = dealt.groupBy("_part").agg(F.sum(one).alias("n")).withColumn("n", F.sum("n").over(Window.orderBy("_part")) - F.col("n"))
    counted = dealt.withColumn("c", F.sum(one).over(Window.partitionBy("_part").orderBy("x", "k").rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(before), "_part")
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("n") + F.col("c")))
    return cut(counted.groupBy("v").agg((at(1) - 1).alias("rank"), at(0).alias("lo"), (at(2) - 1).alias("hi")))


def _nodes(lo: Column, hi: Column, top: int) -> Column:
    """The range from lo to hi as blocks (level, place) of 2 ** level ranks, at most two of a level, each rank in one."""
    none = F.array().cast("array<struct<level:int,place:bigint>>")

    def step(s, level):
        block = lambda place: F.array(F.struct(level.alias("level"), place.alias("place")))
        first = (s.lo < s.end) & (s.lo % 2 == 1)
        lo_ = F.when(first, s.lo + 1).otherwise(s.lo)
        last = (lo_ < s.end) & (s.end % 2 == 1)
        blocks = F.concat(s.blocks, F.when(first, block(s.lo)).otherwise(none), F.when(last, block(s.end - 1)).otherwise(none))
        return F.struct(F.shiftright(lo_, 1).alias("lo"), F.shiftright(F.when(last, s.end - 1).otherwise(s.end), 1).alias("end"), blocks.alias("blocks"))

    start = F.struct(lo.cast("long").alias("lo"), (hi + 1).cast("long").alias("end"), none.alias("blocks"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(top)), start, step, lambda s: s.blocks)


def alternatives(products: DataFrame, key: str, equal: list[str], near: dict[str, float], cost: str, most: int) -> DataFrame:
    """key, alternative and place: for each product the `most` cheapest others that agree in the columns of equal and differ
    by at most the given width in each column of near, compared as doubles (ties: by key). Nulls agree with nothing.

    No product meets all others near it. Each block of 2 ** n neighbouring values keeps its cheapest products, `most` and as
    many as a key has rows; a range of values is a few blocks, and products of one range share its answer. So the work grows
    with products times the logarithm of their values, for each column of near.
    """
    known = products.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_e{i}") for i, c in enumerate(equal)), F.col(cost).alias("_cost"), *(F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(near)))
    for i in range(len(near)):
        known = known.filter(F.col(f"_v{i}").between(-sys.float_info.max, sys.float_info.max))
    same = [f"_e{i}" for i in range(len(equal))]
    known = cut(known.dropna(subset=["_key", *same]))
    keep = most + (known.groupBy("_key").count().agg(F.max("count")).first()[0] or 0)
    tops = []
    for i, width in enumerate(near.values()):
        ranks = _ranked(known, f"_v{i}", width)
        tops.append(int(ranks.agg(F.max(F.expr("hi - lo + 1"))).first()[0] or 1).bit_length() - 1)
        known = known.join(ranks.select(F.col("v").alias(f"_v{i}"), F.col("rank").alias(f"_r{i}"), F.col("lo").alias(f"_lo{i}"), F.col("hi").alias(f"_hi{i}")), f"_v{i}")
    known = cut(known.drop(*(f"_v{i}" for i in range(len(near)))))
    cheapest = lambda df, by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_cost", "_key"))).filter(F.col("_n") <= keep).drop("_n")
    places = [f"_r{i}" for i in range(len(near))]
    ranges = [f"_{end}{i}" for i in range(len(near)) for end in ("lo", "hi")]
    offered, asked = cheapest(known.select(*same, *places, "_cost", "_key"), [*same, *places]), known.select(*same, *ranges).distinct()
    blocks = []
    for i, top in enumerate(tops):
        rank = F.col(f"_r{i}")
        at = F.array(*(F.struct(F.lit(level).alias("level"), F.shiftright(rank, level).alias("place")) for level in range(top + 1)))
        blocks.append(f"_b{i}")
        offered = cheapest(offered.withColumn(f"_b{i}", F.explode(at)).drop(f"_r{i}"), [*same, *blocks, *places[i + 1 :]])
        asked = asked.withColumn(f"_b{i}", F.explode(_nodes(F.col(f"_lo{i}"), F.col(f"_hi{i}"), top)))
    lists = offered.groupBy(*same, *blocks).agg(F.collect_list(F.struct("_cost", "_key")).alias("_list"))
    met = asked.join(lists, [*same, *blocks]).select(*same, *ranges, F.inline("_list"))
    answers = cut(cheapest(met, [*same, *ranges]).groupBy(*same, *ranges).agg(F.array_sort(F.collect_list(F.struct("_cost", "_key"))).alias("_list")))
    found = join_few(known.select("_key", *same, *ranges), answers, [*same, *ranges], F.col("_key"), 100 + 60 * keep)
    others = F.slice(F.filter("_list", lambda x: x["_key"] != F.col("_key")), 1, most)
    pairs = found.select("_key", F.inline(F.transform(others, lambda x: F.struct(x["_cost"].alias("_cost"), x["_key"].alias("alternative")))))
    place = F.row_number().over(Window.partitionBy("_key").orderBy("_cost", "alternative"))
    return pairs.withColumn("place", place).filter(F.col("place") <= most).select(F.col("_key").alias(key), "alternative", "place")

"""Audit log: append-only rows, chained by hashes within each tenant and part, and a check that finds where a chain breaks.

Documented without code where it comes from (tenant, part and correlation columns; events never updated or deleted), so the
chain is a semantics of our own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_CHAIN = 256  # rows of a chain, about


def digest(columns: list[str]) -> Column:
    """SHA-256 of the columns as text, each as - if null, else its UTF-8 byte count, a colon and itself."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _first(chain: list[str]) -> Column:
    return digest(["batch", *chain, "slice"])


def chained(events: DataFrame, chain: list[str], order: list[str], spread: str, batch: int = 0, per: int = PER_CHAIN) -> DataFrame:
    """events with batch, slice, place, before and hash: a row's hash is that of before and of all its own columns, before is
    the hash of the row ahead of it in its chain, in the order given, and that of the chain's name for the first.

    A tenant's part (the columns chain) may hold any number of rows: it is cut into as many slices of about per rows as it
    needs, by spread, an integer column, so no chain grows with its tenant. Rows of a chain that are equal in all columns
    of order must be equal in all others too. Null in chain is a value like any; a null of spread goes to slice 0.
    """
    own = events.columns
    sizes = events.groupBy(*chain).agg(F.ceil(F.count("*") / F.lit(per)).alias("_slices")).select(*(F.col(c).alias(f"_of_{c}") for c in chain), "_slices")
    same = F.lit(True)
    for c in chain:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    cut = F.coalesce(F.pmod(F.col(spread), F.col("_slices")), F.lit(0)).cast("long")
    dealt = events.join(sizes, same).select(*own, F.lit(batch).alias("batch"), cut.alias("slice"))
    rows = dealt.withColumn("_digest", digest(own)).groupBy("batch", *chain, "slice").agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(order)), "_digest", F.struct(*own).alias("_row")))).alias("_rows"))
    hashes = F.aggregate("_rows", F.array(_first(chain)), lambda a, r: F.array_append(a, F.sha2(F.concat(F.element_at(a, -1), r["_digest"]), 256)))
    placed = rows.withColumn("_hashes", hashes).select("batch", "slice", "_hashes", F.posexplode("_rows").alias("_at", "_r"))
    return placed.select("_r._row.*", "batch", "slice", F.col("_at").cast("long").alias("place"), F.get("_hashes", F.col("_at")).alias("before"), F.get("_hashes", F.col("_at") + 1).alias("hash"))


def append(events: DataFrame, path: str, chain: list[str], order: list[str], spread: str, batch: int, per: int = PER_CHAIN) -> None:
    """Adds a batch under path, with its heads beside it, and touches no other; a batch that is there already is refused."""
    log = chained(events, chain, order, spread, batch, per).drop("batch")
    log.write.mode("error").parquet(f"{path}/log/batch={batch}")
    stored = events.sparkSession.read.parquet(f"{path}/log/batch={batch}").withColumn("batch", F.lit(batch))
    heads(stored, chain).drop("batch").write.mode("error").parquet(f"{path}/heads/batch={batch}")


def heads(log: DataFrame, chain: list[str]) -> DataFrame:
    """n and head, the last hash, of each chain; kept apart from the log, they show what was cut off at a chain's end."""
    return log.groupBy("batch", *chain, "slice").agg(F.count("*").alias("n"), F.max_by("hash", "place").alias("head"))


def broken(log: DataFrame, known: DataFrame, chain: list[str]) -> DataFrame:
    """batch, chain, slice, place and kind of each broken link of a log, against its known heads; none if all is whole.

    altered: a row's columns aren't those that its hash was made of. gap: the row ahead of it is gone. unlinked: it is there,
    but its hash isn't the one that this row names. repeated: a place is taken by several rows. ended: rows are missing at the
    end (place is the first of them), or the last hash isn't the known one, or a chain is unknown (place after its last row).
    A change is told once, where it is: a row altered without its hash leaves its neighbours whole.
    """
    names = ["batch", *chain, "slice"]
    own = [c for c in log.columns if c not in ("batch", "slice", "place", "before", "hash")]
    ahead = Window.partitionBy(*names).orderBy("place", "hash")
    seen = log.withColumns({"_was": F.lag("place").over(ahead), "_hash": F.lag("hash").over(ahead)})
    expected = F.when(F.col("place") == 0, _first(chain)).otherwise(F.col("_hash"))
    altered = F.sha2(F.concat("before", digest(own)), 256) != F.col("hash")
    repeated, gap = F.col("_was") == F.col("place"), F.coalesce("_was", F.lit(-1)) + 1 != F.col("place")
    kinds = F.array_compact(F.array(F.when(altered, "altered"), F.when(repeated, "repeated").when(gap, "gap").when(F.col("before") != expected, "unlinked")))
    inside = seen.select(*names, "place", F.explode(kinds).alias("kind"))
    last = log.groupBy(*names).agg(F.max("place").alias("_last"), F.max_by("hash", "place").alias("_end"))
    same = F.lit(True)
    for c in names:
        same &= F.col(f"l.{c}").eqNullSafe(F.col(f"k.{c}"))
    met = last.alias("l").join(known.alias("k"), same, "full")
    whole = F.coalesce((F.col("_last") + 1 == F.col("n")) & (F.col("_end") == F.col("head")), F.lit(False))
    place = F.coalesce(F.col("_last") + 1, F.lit(0))
    ends = met.filter(~whole).select(*(F.coalesce(F.col(f"k.{c}"), F.col(f"l.{c}")).alias(c) for c in names), place.alias("place"), F.lit("ended").alias("kind"))
    return inside.unionByName(ends)

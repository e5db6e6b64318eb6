"""Run traces: links from each output row of a stage to the rows it was made of, walked back to the sources.

Documented without code where they come from (runs that record versions, time and user, and results that name their run), so
the links and the walk are semantics of our own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.operators import shared
from specloom.operators.shared import cut, join_few, stored

HEAVY = 1_000_000  # links of one row from which on they are dealt over tasks
ROWS = 500_000  # of each side of a join that a task gets, about
NAMES = 10_000  # pairs of tables up to which links are looked for by table first
_OUT, _IN = ["run", "made", "made_id"], ["run", "used", "used_id"]


def links(rows: DataFrame, run: str, stage: str, made: str, made_id: Column, used: dict[str, Column]) -> DataFrame:
    """run, stage, made, made_id, used and used_id: a link for each input of each row, once. rows holds a stage's input beside
    the id of the output it went to; used names the tables it came from and their ids. Ids are text; a null one links nothing.
    """
    keys, made_id = [key.cast("string") for key in used.values()], made_id.cast("string").alias("made_id")
    one = rows.select(made_id, keys[0].alias("used_id")) if len(keys) == 1 else rows.select(made_id, F.posexplode(F.array(*keys)).alias("_n", "used_id"))
    name = F.lit(next(iter(used))) if len(keys) == 1 else F.get(F.array(*map(F.lit, used)), F.col("_n"))
    # Names that all rows share come last, so that none is shuffled.
    out = one.filter("made_id is not null and used_id is not null").distinct()
    return out.select(F.lit(run).alias("run"), F.lit(stage).alias("stage"), F.lit(made).alias("made"), "made_id", name.alias("used"), "used_id")


def _meet(df: DataFrame, n: int, side: DataFrame, n_side: int, on: list[str], how: str = "inner") -> DataFrame:
    """df joined with a side, of n and n_side rows: a small side goes to all tasks, else tasks get about ROWS rows of either.
    Left alone, Spark puts together what compresses to 64 MB, many times that in memory."""
    if n_side * 160 <= shared.BROADCAST_BYTES:
        return df.join(F.broadcast(side), on, how)
    parts = max(n, n_side) // ROWS + 1
    return df.repartition(parts, *on).join(side.repartition(parts, *on).hint("merge"), on, how)


def record(run: DataFrame, found: DataFrame, path: str) -> None:
    """Adds the links of one run under path, then its row (run, and whatever versions, time and user it names). A run that is
    there already is refused; links without a row are those of a run that did not end."""
    name = run.select("run").first()["run"]
    found.filter(F.col("run") == name).drop("run").write.mode("error").parquet(f"{path}/links/run={name}")
    run.drop("run").write.mode("error").parquet(f"{path}/runs/run={name}")


def backward(found: DataFrame, start: DataFrame) -> DataFrame:
    """Of each start (run, name, id): start, start_id, run, name, id and hops of all rows that it was made of, in its own run,
    by the fewest hops. Rows met twice count once, so links in a circle end; start itself isn't among them.

    A round of jobs for each hop. Links are written once and read by table: a hop reads those of the tables that the one
    before led to. Links of a row that has more than HEAVY of them are joined where they lie, with the few such rows, so that
    none gathers in a task.
    """
    found = stored(found.select(*_OUT, *_IN[1:]))
    n_found = found.count()
    steps = found.select("made", "used").distinct().limit(NAMES + 1).collect()
    by_table = len(steps) <= NAMES
    hash_ = F.xxhash64(*_OUT).alias("_hash")
    crowded = cut(found.groupBy(hash_).count().filter(F.col("count") > HEAVY))
    hot = not crowded.isEmpty()
    if hot:
        heavy = cut(join_few(found.withColumn("_hash", hash_), crowded.select("_hash"), ["_hash"], F.col("used_id"), 16).groupBy(*_OUT).count().filter(F.col("count") > HEAVY).select(*_OUT))
    light = join_few(found, heavy, _OUT, F.col("used_id"), 64, "left_anti") if hot else found
    ends = ["start", "start_id"]
    front = start.select("run", F.col("name").alias("made"), F.col("id").cast("string").alias("made_id"), F.col("name").alias("start"), F.col("id").cast("string").alias("start_id")).distinct()
    known, hops = stored(front.select("run", *ends, F.col("made").alias("name"), F.col("made_id").alias("id"), F.lit(0).alias("hops"))), 0
    front = known.select("run", F.col("name").alias("made"), F.col("id").alias("made_id"), *ends)
    n_known = n = known.count()
    first = front.select("made").distinct().limit(NAMES + 1).collect()
    names = {r.made for r in steps} if len(first) > NAMES else {r.made for r in first} & {r.made for r in steps}
    while n and (names or not by_table):
        hops += 1
        here = F.col("made").isin(sorted(names)) if by_table else F.lit(True)
        met = _meet(light.filter(here), n_found, front, n, _OUT).select(*_IN, *ends)
        if hot:
            few = front.join(F.broadcast(heavy), _OUT, "left_semi") if heavy.count() * 64 <= 32 << 20 else front.join(heavy, _OUT, "left_semi")
            met = met.union(join_few(found.filter(here), cut(few), _OUT, F.col("used_id"), 128).select(*_IN, *ends))
        new = met.distinct().select("run", *ends, F.col("used").alias("name"), F.col("used_id").alias("id"))
        new = stored(_meet(new, n_found, known, n_known, ["run", *ends, "name", "id"], "left_anti").withColumn("hops", F.lit(hops)))
        known, n = known.unionByName(new), new.count()
        n_known += n
        names = {r.used for r in steps if r.made in names} & {r.made for r in steps}
        front = new.select("run", F.col("name").alias("made"), F.col("id").alias("made_id"), *ends)
    return known.filter("hops > 0")


def forward(found: DataFrame, start: DataFrame) -> DataFrame:
    """As backward, towards all rows that were made of start."""
    turned = {"made": "used", "made_id": "used_id", "used": "made", "used_id": "made_id"}
    return backward(found.withColumnsRenamed({k: f"_{v}" for k, v in turned.items()}).withColumnsRenamed({f"_{v}": v for v in turned.values()}), start)


def unfounded(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Links whose input is neither a row of sources (name, id) nor made in the same run."""
    found = stored(found)
    n = found.count()
    given = sources.select(F.col("name").alias("used"), F.col("id").cast("string").alias("used_id"))
    made = found.select("run", F.col("made").alias("used"), F.col("made_id").alias("used_id"))
    open_ = _meet(found.select(*_IN).dropna(), n, given, given.count(), ["used", "used_id"], "left_anti").distinct()
    open_ = stored(_meet(open_, n, made, n, _IN, "left_anti"))
    names = open_.select("used").distinct().limit(NAMES + 1).collect()
    asked = found.filter(F.col("used").isin([r.used for r in names])) if len(names) <= NAMES else found
    return _meet(asked, n, open_, open_.count(), _IN, "left_semi")

"""N-gram Jaccard self-join by T-occurrence search (operator 5).

A document is the set of its distinct k-word shingles. Two documents link when 100 * |A & B| >= percent * |A | B|.
That needs an overlap of at least T = ceil(percent * larger size / 100), so of the inverted lists of a document's
shingles, all but T - 1 must hold any partner at least once. DivideSkip in two places:

* on the cluster, a document posts only its |A| - T + 1 rarest shingles; the shuffle merges these short lists;
* in a task, a query's lists over a block of candidates divide again: short ones are heap-merged, the long ones are
  binary-probed for those documents that could still reach T.

No list is expanded into all its pairs. First each list links its members to its smallest one (a star). Only lists of
three or more whose members are still in several components are searched in full, by blocks of documents.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.llm import kit

BLOCK = 256
STEP = 10
BUFFERED = 1_500_000
HEAVY_FROM, HEAVY_MOST = 8, 400_000


def need(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def least_shared(size: int) -> int:
    """How many short lists a document posts to beyond those that must hold one partner: as many must be shared.

    With |A| - T + l lists each, partners share at least the smaller l. A document with fewer shared lists than its
    smallest possible partner's l has none.
    """
    return 1 + size // STEP


PROBES = 1 << 20


class Lists:
    """Inverted lists of some sets (sorted distinct values each), made once and searched by any number of queries, of whose
    values wanted holds all."""

    def __init__(self, sets: list[np.ndarray], wanted: np.ndarray):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat, owner = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), self.sizes)
        if len(wanted):
            held = wanted[np.minimum(np.searchsorted(wanted, flat), len(wanted) - 1)] == flat
            flat, owner = flat[held], owner[held]
        order = np.argsort(flat, kind="stable")
        self.values, first = np.unique(flat[order], return_index=True)
        self.bounds, self.members, self.width = np.append(first, len(flat)), owner[order], len(sets) + 1
        self.keys = np.repeat(np.arange(len(first)), np.diff(self.bounds)) * self.width + self.members

    def search(self, query: np.ndarray, percent: int, mu: float = 0.0085) -> np.ndarray:
        """Places of the sets that link with query: short lists are heap-merged, and what they leave possible is looked up
        in the long ones by binary search."""
        size, none = len(query), np.zeros(0, np.int64)
        if not size or not len(self.values):
            return none
        at = np.minimum(np.searchsorted(self.values, query), len(self.values) - 1)
        at = at[self.values[at] == query]  # other values have empty lists
        starts, ends = self.bounds[at], self.bounds[at + 1]
        least = need(size, percent)
        longest = int((ends - starts).max(initial=0))
        n_long = min(least - 1, int(least / (mu * math.log2(max(2, longest)) + 1)))
        by_length = np.argsort(ends - starts, kind="stable")
        n_short = max(0, size - n_long - (size - len(at)))  # the empty lists are the shortest
        short, long = by_length[:n_short], by_length[n_short:]
        merged = heapq.merge(*(self.members[starts[i] : ends[i]].tolist() for i in short))
        counted = [(m, c) for m, c in ((m, sum(1 for _ in run)) for m, run in groupby(merged)) if c >= least - n_long]
        if not counted:
            return none
        found, count = np.array([m for m, _ in counted]), np.array([c for _, c in counted])
        fits = 100 * np.minimum(self.sizes[found], size) >= percent * np.maximum(self.sizes[found], size)
        found, count = found[fits], count[fits]
        step = max(1, PROBES // max(1, len(found)))
        for a in range(0, len(long), step):
            probes = np.sort(at[long[a : a + step]])[:, None] * self.width + found
            place = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
            count = count + (self.keys[place] == probes).sum(axis=0)
        return found[100 * count >= percent * (size + self.sizes[found] - count)]


def t_occurrence(query: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Places in sets of those that link with query. Both hold sorted distinct values."""
    return Lists(sets, query).search(query, percent).tolist()


def _document_sets(batch: pa.RecordBatch, k: int):
    """Row and sorted distinct shingles of each text that has words."""
    data, offsets = kit.text_buffers(batch.column("text"))
    for first, last, hashes, bounds in kit.word_hashes(data, offsets, kit.SPACED):
        for row in range(first, last):
            words = hashes[bounds[row - first] : bounds[row - first + 1]]
            yield row, np.unique(kit.shingles(words, k))


def _summaries(documents: DataFrame, k: int) -> DataFrame:
    """A row for each document (size, fingerprint), and rows of the shingles seen twice or more by one task."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_shingles", pa.int64()), ("mark", pa.binary()), ("frequent", pa.list_(pa.int64())), ("seen", pa.list_(pa.int32()))])

    def run(batches):
        held, marks, amount = [], set(), 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            twice = counts >= 2
            return pa.RecordBatch.from_arrays([*(pa.array([None], pa.int64()) for _ in range(3)), pa.array([None], pa.binary()), pa.array([values[twice].view(np.int64)], pa.list_(pa.int64())), pa.array([counts[twice].astype(np.int32)], pa.list_(pa.int32()))], schema=schema)

        for batch in batches:
            sizes, fingerprints = [], []
            for _, values in _document_sets(batch, k):
                mark = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
                sizes.append(len(values))
                fingerprints.append(mark)
                if mark not in marks and len(values):
                    marks.add(mark)
                    held.append(values)
                    amount += len(values)
                if amount >= BUFFERED:
                    yield flush()
                    held, marks, amount = [], set(), 0
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(sizes, pa.int64()), pa.array(fingerprints, pa.binary()), none.cast(pa.list_(pa.int64())), none.cast(pa.list_(pa.int32()))], schema=schema)
        if held:
            yield flush()

    return documents.mapInArrow(run, "doc_id long, row_key long, n_shingles long, mark binary, frequent array<long>, seen array<int>")


def _prefixes(documents: DataFrame, k: int, percent: int, heavy) -> DataFrame:
    """The short lists that each document posts to: its rarest shingles, first the n_light outside the heavy table."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("post", pa.list_(pa.int64())), ("n_light", pa.int32())])

    def run(batches):
        keys, weights = heavy.value
        for batch in batches:
            ids, out = batch.column("key").to_pylist(), ([], [], [], [])
            for row, values in _document_sets(batch, k):
                n = len(values)
                if not n:
                    continue
                keep = min(n, n - need(n, percent) + least_shared(n))
                weight = np.zeros(n, np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
                    weight = np.where(keys[at] == values, weights[at], 0)
                light = np.flatnonzero(weight == 0)
                chosen = light if len(light) >= keep else np.argsort(weight, kind="stable")
                for x, y in zip(out, (ids[row], n, values[chosen[:keep]].view(np.int64), min(keep, len(light))), strict=True):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, schema.types, strict=True)], schema=schema)

    return documents.mapInArrow(run, "key long, n int, post array<long>, n_light int")


def components(edges: DataFrame) -> DataFrame:
    """Smallest vertex reachable from each vertex of edges (x, y): label spreading with pointer jumps."""
    both = kit.cut(edges.select("x", "y").union(edges.select("y", "x")).distinct())
    label = kit.cut(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")))
    while True:
        near = both.join(label.select(F.col("x").alias("y"), F.col("label").alias("theirs")), "y").groupBy("x").agg(F.min("theirs").alias("theirs"))
        spread = label.join(near, "x").select("x", F.col("label").alias("old"), F.least("label", "theirs").alias("mid"))
        jump = label.select(F.col("x").alias("mid"), F.col("label").alias("far"))
        step = kit.cut(spread.join(jump, "mid", "left").select("x", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")))
        if step.filter("label <> old").isEmpty():
            return step.select(F.col("x").alias("key"), "label")
        label = step.select("x", "label")


def _star_members(pairs: DataFrame) -> DataFrame:
    """Tasks of the stars: each x is a query against its y, BLOCK or so at a time."""
    sizes = pairs.groupBy("x").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_index"))
    dealt = pairs.join(sizes, "x")
    queries = sizes.select(F.col("x").alias("lot"), F.lit(0).alias("q"), F.explode(F.sequence(F.lit(0), F.col("n_index") - 1)).alias("i"), F.lit(0).alias("role"), F.col("x").alias("key"), F.col("x").alias("part"))
    index = dealt.select(F.col("x").alias("lot"), F.lit(0).alias("q"), F.pmod(F.xxhash64("y"), "n_index").cast("int").alias("i"), F.lit(1).alias("role"), F.col("y").alias("key"), F.col("y").alias("part"))
    return queries.unionByName(index)


def _block_members(rest: DataFrame) -> DataFrame:
    """Tasks of what is left (lot, key, part): of each lot, documents outside its largest component are queries against
    all its documents. Both are dealt into blocks of about BLOCK by hash; each pair of blocks is a task."""
    sizes = rest.groupBy("lot", "part").count().groupBy("lot").agg(F.sum("count").alias("all"), F.max_by("part", F.struct("count", "part")).alias("main"), F.max("count").alias("most"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    dealt = rest.join(sizes, "lot").withColumns({"n_index": blocks(F.col("all")), "n_query": blocks(F.col("all") - F.col("most"))}).filter("n_query > 0")
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = dealt.filter("part <> main").select("lot", own("n_query").alias("q"), every("n_index").alias("i"), F.lit(0).alias("role"), "key", "part")
    index = dealt.select("lot", every("n_query").alias("q"), own("n_index").alias("i"), F.lit(1).alias("role"), "key", "part")
    return queries.unionByName(index)


def _component_members(parts: DataFrame) -> DataFrame:
    """Tasks that count links: the sets of a component of three or more in blocks of about BLOCK by hash. Each pair of
    blocks q <= i is a task; those of q are queries against those of i."""
    sizes = parts.groupBy("label").count().filter("count > 2").select("label", F.ceil(F.col("count") / BLOCK).cast("int").alias("n"))
    dealt = parts.join(sizes, "label").withColumn("own", F.pmod(F.xxhash64("key"), F.col("n")).cast("int"))
    queries = dealt.select(F.col("label").alias("lot"), F.col("own").alias("q"), F.explode(F.expr("sequence(own, n - 1)")).alias("i"), F.lit(0).alias("role"), "key", F.col("label").alias("part"))
    index = dealt.select(F.col("label").alias("lot"), F.explode(F.expr("sequence(0, own)")).alias("q"), F.col("own").alias("i"), F.lit(1).alias("role"), "key", F.col("label").alias("part"))
    return queries.unionByName(index)


def _values(rows: list) -> np.ndarray:
    return np.unique(np.concatenate([row[2] for row in rows]))


def _links_of(queries: list, index: list, percent: int) -> list[tuple[int, int]]:
    """Links (key, key) that unite components, of queries against index, both rows (key, part, set)."""
    above: dict[int, int] = {}

    def top(v):
        while above.get(v, v) != v:
            v = above[v]
        return v

    out, lists = [], Lists([row[2] for row in index], _values(queries))
    for x, part, values in queries:
        if all(top(row[1]) == top(part) for row in index):
            continue
        for i in lists.search(values, percent).tolist():
            a, b = top(index[i][1]), top(part)
            if a != b:
                above[a] = b
                out.append((x, index[i][0]))
    return out


def _degrees_of(queries: list, index: list, percent: int) -> list[tuple[int, int]]:
    """(key, number of links) of queries with index. Sets of one block, which are both, count at the query alone."""
    counts: Counter = Counter()
    lists, within = Lists([row[2] for row in index], _values(queries)), {row[0] for row in queries} & {row[0] for row in index}
    for x, _, values in queries:
        for i in lists.search(values, percent).tolist():
            if index[i][0] != x:
                counts[x] += 1
                if not within:
                    counts[index[i][0]] += 1
    return list(counts.items())


def _searched(members: DataFrame, documents: DataFrame, k: int, percent: int, found) -> DataFrame:
    """Pairs (x, y) of longs that found(queries, index, percent) gives within each task (lot, q, i) of members. The texts'
    sets are made once members are known, so only those are shuffled, once for each task that needs them."""
    members = kit.few(kit.cut(members.withColumnRenamed("key", "_key")), 48)
    wanted = documents.join(members, F.col("key") == F.col("_key")).select("lot", "q", "i", "role", "key", "part", "text")
    names = ["lot", "q", "i", "role", "key", "part"]
    pairs = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def sets(batches):
        for batch in batches:
            values = pa.array([v.view(np.int64) for _, v in _document_sets(batch, k)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), values], names=[*names, "shingles"])

    def of_task(held):
        distinct = [list({row[0]: row for row in rows}.values()) for rows in held]  # rows that repeat are one
        return found(*distinct, percent) if all(distinct) else []

    def search(batches):
        task, held = None, ([], [])
        for batch in batches:
            lot, q, i, role, keys, parts = (batch.column(c).to_pylist() for c in names)
            column, out = batch.column("shingles"), []
            flat, at = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
            for r in range(batch.num_rows):
                if (own := (lot[r], q[r], i[r])) != task:
                    out += of_task(held)
                    task, held = own, ([], [])
                held[role[r]].append((keys[r], parts[r], flat[at[r] : at[r + 1]].copy()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], schema=pairs)
        rest = of_task(held)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rest], pa.int64()), pa.array([y for _, y in rest], pa.int64())], schema=pairs)

    made = wanted.mapInArrow(sets, "lot long, q int, i int, role int, key long, part long, shingles array<long>")
    return made.repartition("lot", "q", "i").sortWithinPartitions("lot", "q", "i", "role", "key").mapInArrow(search, "x long, y long")


def _keyed(df: DataFrame, several: DataFrame) -> DataFrame:
    """df with key: its doc_id, or its row_key if it has no doc_id or several texts go by that."""
    flagged = kit.few(several.filter("doc_id is not null").select(F.col("doc_id").alias("_several")), 16)
    own = F.when(F.col("doc_id").isNull() | F.col("_several").isNotNull(), F.col("row_key")).otherwise(F.col("doc_id"))
    return df.join(flagged, F.col("doc_id") == F.col("_several"), "left").withColumn("key", own).drop("_several")


def ngram_join(documents: DataFrame, k: int = 4, percent: int = 85, count_links: bool = True) -> DataFrame:
    """A row for each row of documents(doc_id, text, ...): doc_id, row_key, n_shingles, class_id, component_id, n_links,
    group_key.

    Rows of equal sets are one class; class_id is its smallest doc_id, n_links the number of other classes that it links
    with, component_id the smallest doc_id that links reach, group_key the same for each row of a component and only there
    (null for empty sets). row_key is xxhash64(doc_id, text). Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. A text
    of fewer than k words is one shingle. Null and empty texts have size 0, link with nothing, and are components of their
    own. Rows may repeat a doc_id, with the same or another text, or have none: each belongs where its own text does, and
    component_id is null where no member has a doc_id. Other columns are ignored; an empty table gives none. Without
    count_links there is no n_links, and components aren't searched again to count them.
    """
    spark = documents.sparkSession
    kit.small_batches(spark)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    documents = documents.withColumn("row_key", kit.row_key())
    summary = kit.cut(_summaries(documents, k))
    rows = summary.filter("mark is not null").select("doc_id", "row_key", "n_shingles", "mark")
    lists = summary.filter("mark is null").select(F.explode(F.arrays_zip("frequent", "seen")).alias("s"))
    heavy = lists.groupBy("s.frequent").agg(F.sum("s.seen").alias("n")).filter(F.col("n") >= HEAVY_FROM).orderBy(F.desc("n"), "frequent").limit(HEAVY_MOST).toPandas()
    keys = heavy["frequent"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    table = spark.sparkContext.broadcast((keys[order], heavy["n"].to_numpy(np.int64)[order]))

    several = kit.cut(rows.groupBy("doc_id").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).filter("doc_id is null or a <> b").select("doc_id"))
    documents, rows = _keyed(documents, several), _keyed(rows, several)
    classes = rows.filter("n_shingles > 0").groupBy("mark").agg(F.min("key").alias("class_key"), F.min("doc_id").alias("class_id"))
    member = kit.cut(rows.join(classes, "mark", "left").selectExpr("doc_id", "row_key", "key", "n_shingles", "if(n_shingles > 0, class_key, null) as class_key", "if(n_shingles > 0, class_id, doc_id) as class_id"))

    copies = kit.cut(member.filter("key <> class_key").select("key").distinct())
    posted = _prefixes(documents.select("key", "text"), k, percent, table).join(kit.few(copies, 16), "key", "left_anti")
    # A list of the heavy table can hold any part of the rows, so no window takes it whole: each of its members is in a lane
    # of its own and skips the first prunings; its first member and length come of partial aggregates.
    posts = posted.select("key", "n", "n_light", F.posexplode("post").alias("at", "shingle")).select("shingle", F.expr("if(at >= n_light, key, null)").alias("lane"), "key", "n")
    by_list = Window.partitionBy("shingle", "lane")
    several_in = posts.withColumns({"low": F.min("key").over(by_list), "high": F.max("key").over(by_list)}).filter("lane is not null or low < high").drop("low", "high")
    smallest = F.floor((F.col("n") * percent + 99) / 100)  # size of its smallest possible partner
    enough = F.count("*").over(Window.partitionBy("key")) >= 1 + F.floor(smallest / STEP)
    hopeful = several_in.withColumn("enough", enough).filter("enough")
    shared = hopeful.repartition("shingle", "lane").groupBy("shingle", "lane", "key").agg(F.max("n").alias("n"))
    near = by_list.orderBy("n", "key")
    beside = lambda c: F.coalesce(F.least("n", c) * 100 >= F.greatest("n", c) * percent, F.lit(False))
    shared = shared.withColumn("fits", F.col("lane").isNotNull() | beside(F.lag("n").over(near)) | beside(F.lead("n").over(near))).filter("fits").withColumn("enough", enough).filter("enough")
    shared = kit.cut(shared.select("shingle", "key", "n"))
    firsts = shared.groupBy("shingle").agg(F.min(F.struct("key", "n")).alias("first"), F.count("*").alias("many")).filter("many > 1")
    shared = kit.cut(shared.join(firsts, "shingle"))

    fits = F.least("n", "first.n") * 100 >= F.greatest("n", "first.n") * percent
    pairs = kit.cut(shared.filter(fits & (F.col("key") != F.col("first.key"))).select(F.col("first.key").alias("x"), F.col("key").alias("y")).distinct())
    links = kit.cut(_searched(_star_members(pairs), documents, k, percent, _links_of))
    parts = components(links)

    wide = shared.filter("many > 2").select("shingle", "key")
    known = kit.cut(wide.join(parts, "key", "left").select("shingle", "key", F.coalesce("label", "key").alias("part")))
    ends = known.groupBy("shingle").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b")
    split = known.join(ends, "shingle")
    rest = kit.cut(split.select(F.col("a").alias("lot"), "key", "part").distinct())
    if not rest.isEmpty():
        links = kit.cut(links.union(_searched(_block_members(rest), documents, k, percent, _links_of)))
        parts = components(links)

    # All links of a component lie within it, so they are counted there, and none is sent as a pair.
    linked = parts.join(classes.select(F.col("class_key").alias("key"), "class_id"), "key").withColumn("n_links", F.lit(None).cast("long"))
    if count_links:
        counted = _searched(_component_members(parts), documents, k, percent, _degrees_of).groupBy(F.col("x").alias("key")).agg(F.sum("y").alias("n_links"))
        linked = linked.drop("n_links").join(counted, "key", "left")
    lowest = linked.groupBy("label").agg(F.min("class_id").alias("component_id"))
    facts = linked.join(lowest, "label").select(F.col("key").alias("class_key"), "component_id", F.col("label").alias("group_key"), F.coalesce("n_links", F.lit(1)).alias("n_links"))
    final = member.join(facts, "class_key", "left")
    made = final.select("doc_id", "row_key", "n_shingles", "class_id", F.expr("if(group_key is null, class_id, component_id)").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("group_key", "class_key").alias("group_key"))
    return made if count_links else made.drop("n_links")


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(kit.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "class_id", "component_id", "n_links")


#: By brute force: all pairs that share a shingle, and reachability by repetition.
OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b USING (g) GROUP BY ALL),
l AS (SELECT x, y, both_ = nx.n AND both_ = ny.n AS same FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * both_ >= 85 * (nx.n + ny.n - both_)),
c AS (SELECT x, min(y) AS class_id FROM l WHERE same GROUP BY 1),
deg AS (SELECT l.x, count(DISTINCT c.class_id) AS n_links FROM l JOIN c ON c.x = l.y WHERE NOT same GROUP BY 1),
reach(x, y) AS (SELECT x, x FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(class_id, doc_id)::BIGINT AS class_id, coalesce(low, doc_id)::BIGINT AS component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = doc_id LEFT JOIN deg ON deg.x = doc_id LEFT JOIN (SELECT x, min(y) AS low FROM reach GROUP BY 1) r ON r.x = doc_id
"""

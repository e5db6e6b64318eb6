"""Merkle dataset manifest (operator 11): sibling-shift self-joins, in DataFrame functions only.

Nodes are rows (tree, n, idx, digest): n nodes of the tree at this level, idx from 0. At each level every node equijoins
the others of its run of `fanout` nodes by their computed indices (XOR 1 for two, else each slot offset); the rows of slot
zero then emit the parents. Each level is written to the shared folder. Proofs come down the same tables: each node takes
its parent's path by an equijoin and puts its own siblings before it, so nothing is sent once for each leaf and level.

Keys of these joins are unique or shared by one run, so a tree of any size is spread over all tasks. Levels whose digests
take at most MOST_BYTES, as counted, are joined in one task, several to a plan, and hand down whole paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specloom.llm import kit

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROW_BITS = 33  # monotonically_increasing_id holds the row's place in its partition in so many bits
DIGEST_BYTES = 96
WRITTEN_EVERY = 4  # paths of each fourth level are written on the way down
MOST_BYTES = 1 << 20  # of digests of one level, from which on one task climbs; its paths take some 20 times as much
MOST_SCANS = 8  # of a written level in one plan
PATH = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(values) -> Column:
    """SHA-256 of the values, each as - if null, else its UTF-8 byte count, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def numbered(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """leaves with tree, idx and n: leaves of equal group are a tree, trees are numbered in the order of group (null
    first) and leaves within a tree in the order given, then by digest.

    A range partition puts all in order; offsets of partitions, one row for each, make the places global.
    """
    keys = [kit.named(c) for c in (group, *order, "digest")]
    ranged = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = kit.cut(ranged)
    part, place = F.shiftright("_at", ROW_BITS), F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    sizes = ranged.groupBy(part.alias("_part")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each partition
    at = ranged.join(F.broadcast(sizes.select("_part", before.alias("_before"))), part == F.col("_part")).withColumn("_place", F.col("_before") + place)
    trees = kit.cut(at.groupBy(kit.named(group).alias("_group")).agg(F.min("_place").alias("tree"), F.count("*").alias("n")))
    known = at.join(kit.few(trees, 80), kit.named(group).eqNullSafe(F.col("_group")))
    return known.withColumn("idx", F.col("_place") - F.col("tree")).drop("_at", "_part", "_before", "_place", "_group")


def _siblings(nodes: DataFrame, others: DataFrame, fanout: int) -> DataFrame:
    """nodes with the digests before and after each in its run, in slot order: joined with others (tree, idx, digest) once
    for each slot offset."""
    slot, side, found = F.col("idx") % fanout, nodes, []
    for offset in range(1, fanout):
        other = F.col("idx").bitwiseXOR(F.lit(1)) if fanout == 2 else F.col("idx") - slot + (slot + offset) % fanout
        shifted = others.select(F.col("tree").alias(f"_tree{offset}"), F.col("idx").alias(f"_idx{offset}"), F.col("digest").alias(f"_sibling{offset}"))
        side = side.join(shifted.hint("merge"), (F.col("tree") == F.col(f"_tree{offset}")) & (other == F.col(f"_idx{offset}")), "left")
        found.append(F.struct(((slot + offset) % fanout).alias("slot"), F.col(f"_sibling{offset}").alias("digest")))
    held = F.array_sort(F.filter(F.array(*found), lambda s: s.digest.isNotNull()))
    joined = lambda test: F.concat_ws("", F.transform(F.filter(held, test), lambda s: s.digest))
    return side.select(*nodes.columns, joined(lambda s: s.slot < slot).alias("before"), joined(lambda s: s.slot > slot).alias("after"))


def _parent(n: Column, fanout: int) -> Column:
    """Nodes of the level above one of n nodes."""
    return F.floor((n + (fanout - 1)) / fanout).cast("long")


def _above(idx: Column, fanout: int) -> Column:
    return F.floor(idx / fanout).cast("long")


def _height(n: Column, fanout: int) -> Column:
    """Levels above n leaves."""
    powers = [w for w in (fanout**k for k in range(63)) if w < 1 << 62]
    return F.size(F.filter(F.array(*map(F.lit, powers)), lambda w: n > w))


def _climb(nodes: DataFrame, fanout: int, most: int) -> DataFrame:
    """(tree, idx, root, path) of each of nodes (tree, n, idx, digest), which are few (MOST_BYTES): its siblings level by
    level, and its tree's root.

    One task holds all of them, so joins need no exchange, and a plan goes up several levels before its outcome is written.
    Each node climbs: it joins the others of its run, of which slot zero's first descendant stands for the parent.
    """
    at = nodes.select("tree", F.col("idx").alias("base"), "n", "idx", "digest", F.array().cast(PATH).alias("path")).coalesce(1)
    levels, each = 0, next(k for k in (3, 2, 1) if k == 1 or fanout**k <= MOST_SCANS)
    while most > 1:
        heads = at.filter((F.col("n") > 1) & (F.col("base") == F.col("idx") * F.lit(fanout**levels)))
        found, inner = _siblings(at, heads, fanout), F.col("n") > 1
        path = F.when(inner, F.concat("path", F.array(F.struct("before", "after")).cast(PATH))).otherwise(F.col("path"))
        up = F.when(inner, digest(F.col("before"), F.col("digest"), F.col("after"))).otherwise(F.col("digest"))
        at = found.select("tree", "base", _parent(F.col("n"), fanout).alias("n"), _above(F.col("idx"), fanout).alias("idx"), up.alias("digest"), path.alias("path"))
        levels, most = levels + 1, -(-most // fanout)
        if levels % each == 0 and most > 1:
            at = kit.written(at).coalesce(1)
    return kit.written(at.select("tree", F.col("base").alias("idx"), F.col("digest").alias("root"), "path"))


def trees(leaves: DataFrame, fanout: int, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, tops) of leaves(tree, n, idx, digest, keep): rows are the leaves with tree, digest, keep and path, the siblings
    at each level from the leaf up; tops has (tree, digest) of each tree's root. A tree of one leaf is its own root.

    Large levels are written one by one, and their paths come down the same tables. From the first level of few nodes on,
    these climb to the roots.
    """
    firsts = leaves.filter("idx = 0")
    sizes = firsts.agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.count("*").alias("trees"), F.collect_set(_height(F.col("n"), fanout)).alias("heights")).first()
    most, total, count, heights = sizes.most or 0, sizes.total or 0, sizes.trees, set(sizes.heights)  # as many heights as levels at most
    levels, nodes, tops = [], leaves, []
    while most > 1 and (total // fanout ** len(levels) + count) * DIGEST_BYTES > MOST_BYTES:  # nodes of this level at most
        if len(levels) in heights:
            tops.append(nodes.filter("n = 1").select("tree", "digest"))
        inner = nodes.filter("n > 1").select("tree", "n", "idx", "digest", *(keep if not levels else []))
        level = (kit.written if levels else kit.cut)(_siblings(inner, inner, fanout))  # rows of any columns are cut
        levels.append(level)
        most = -(-most // fanout)
        nodes = level.filter(F.col("idx") % fanout == 0).select("tree", _parent(F.col("n"), fanout).alias("n"), _above(F.col("idx"), fanout).alias("idx"), digest(F.col("digest"), F.col("after")).alias("digest"))
    climbed = _climb(nodes, fanout, most)
    tops.append(climbed.filter("idx = 0").select("tree", F.col("root").alias("digest")))
    above = climbed.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("path").alias("_path"))
    if not levels:
        same = (F.col("tree") == F.col("_tree")) & (F.col("idx") == F.col("_idx"))
        return leaves.join(above.hint("merge"), same).select("tree", "digest", F.col("_path").alias("path"), *keep), tops[0]
    rows = leaves.filter("n = 1").select("tree", "digest", F.array().cast(PATH).alias("path"), *keep)
    none = F.lit(0).cast("long").alias("_idx"), F.array().cast(PATH).alias("_path")
    for k in reversed(range(len(levels))):
        found = levels[k].join(above.hint("merge"), (F.col("tree") == F.col("_tree")) & (_above(F.col("idx"), fanout) == F.col("_idx")))
        path = F.concat(F.array(F.struct("before", "after")).cast(PATH), F.col("_path"))
        if k == 0:
            return rows.union(found.select("tree", "digest", path.alias("path"), *keep)), kit.written(reduce(DataFrame.union, tops))
        above = found.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), path.alias("_path"))
        if k in heights:
            ended = levels[k - 1].filter((F.col("idx") == 0) & (_parent(F.col("n"), fanout) == 1))
            above = above.union(ended.select("tree", *none))
        if k % WRITTEN_EVERY == 0:
            above = kit.written(above)


def manifest(leaves: DataFrame, group: str, order: list[str], fanout: int = 2) -> DataFrame:
    """leaves(digest, group, order, ...) with subroot, root and path: the siblings at each level, from the leaf to root.

    Leaves of equal group make a tree, null a group like any; the trees' roots, in the order of group (null first, UTF-8
    bytewise), make one more, whose root is root. Leaves ascend by order (null first), then by digest; rows equal in all of
    these are interchangeable. Of leaves, the columns digest, group and order must be there; others are carried along. An
    empty table gives an empty one.
    """
    carried = [c for c in leaves.columns if c != "digest"]
    packed = leaves.select("digest", F.struct(*(kit.named(c) for c in carried)).alias("_row"), kit.named(group).alias("_of"), *(kit.named(c).alias(f"_by{i}") for i, c in enumerate(order)))
    rows, tops = trees(numbered(packed, "_of", [f"_by{i}" for i in range(len(order))]), fanout, ["_row"])
    count = tops.count()
    subroots = tops.select(F.col("tree").alias("_of_tree"), "digest")
    if count * DIGEST_BYTES <= MOST_BYTES:
        place = F.row_number().over(Window.orderBy("_of_tree")).cast("long") - 1  # of few rows, as counted
        placed = subroots.select("_of_tree", "digest", F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), place.alias("idx"))
    else:
        placed = numbered(subroots.withColumn("_all", F.lit(0)), "_all", ["_of_tree"])
    upper, whole = trees(placed, fanout, ["_of_tree"])
    upper = upper.select("_of_tree", F.col("digest").alias("subroot"), F.col("path").alias("_upper"))
    named = kit.cut(upper.join(F.broadcast(whole.select(F.col("digest").alias("root")))))  # whole is one row
    found = rows.join(F.broadcast(named) if count * 40 * DIGEST_BYTES <= kit.BROADCAST_BYTES else named, F.col("tree") == F.col("_of_tree"))
    return found.select("digest", "_row.*", "subroot", "root", F.concat("path", "_upper").alias("path"))


def proof(path: Column) -> Column:
    """SHA-256 of the siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s.before, s.after))), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda a, s: digest(s.before, a, s.after))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """A row without a doc_id comes first in its tree and isn't tampered with; rows that repeat a doc_id follow each other by
    leaf. A null text is a field like any null. Columns other than the five are ignored."""
    documents = kit.table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS]
    more = [F.col("n_chars").cast("decimal(38,0)") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf_digest(more))
    leaves = kit.cut(documents.select("doc_id", "lang", leaf_digest(fields).alias("digest"), tampered.alias("tampered")))
    made = manifest(leaves, "lang", ["doc_id"])
    out = made.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of a list of byte values in DuckDB SQL: the table from its polynomial, then a fold.
CRC_SQL = """crc AS (SELECT list(c ORDER BY b) AS tab FROM (SELECT b, list_reduce(range(0, 8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS c FROM range(0, 256) AS r(b)))"""


def crc_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of text's UTF-8 bytes, beside CRC_SQL's crc."""
    bytes_ = f"list_transform(range(0, octet_length(encode({text}))), lambda k: ('0x' || hex(encode({text}))[2 * k + 1:2 * k + 2])::BIGINT)"
    return f"xor(list_reduce({bytes_}, lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


OP11_SQL = rf"""
WITH RECURSIVE {CRC_SQL},
l AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN {crc_sql("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS bad FROM documents, crc),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM l),
up AS (SELECT tree, 0 AS lvl, idx, n, leaf AS h FROM o UNION ALL SELECT tree, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY tree, lvl, idx // 2, n),
subs AS (SELECT tree, h AS subroot, lvl AS height FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, tree AS idx, (SELECT count(*) FROM subs) AS n, subroot AS h FROM subs UNION ALL SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, idx // 2, n),
steps AS (SELECT o.tree, o.idx AS leaf_idx, up.lvl AS step, (o.idx >> up.lvl) % 2 AS slot, s.h FROM o JOIN up ON up.tree = o.tree AND up.idx = o.idx >> up.lvl AND up.n > 1 LEFT JOIN up s ON s.tree = o.tree AND s.lvl = up.lvl AND s.idx = xor(o.idx >> up.lvl, 1)
  UNION ALL SELECT o.tree, o.idx, subs.height + top.lvl, (o.tree >> top.lvl) % 2, s.h FROM o JOIN subs USING (tree) JOIN top ON top.idx = o.tree >> top.lvl AND top.n > 1 LEFT JOIN top s ON s.lvl = top.lvl AND s.idx = xor(o.tree >> top.lvl, 1)),
proofs AS (SELECT tree, leaf_idx AS idx, string_agg(coalesce(h, ''), '' ORDER BY step) AS proof, list(CASE slot WHEN 1 THEN coalesce(h, '') ELSE '' END ORDER BY step) AS b, list(CASE slot WHEN 0 THEN coalesce(h, '') ELSE '' END ORDER BY step) AS a FROM steps GROUP BY ALL),
p AS (SELECT o.*, coalesce(proof, '') AS proof, coalesce(b, []) AS b, coalesce(a, []) AS a FROM o LEFT JOIN proofs USING (tree, idx)),
fold AS (SELECT tree, idx, 0 AS step, coalesce(bad, leaf) AS h, b, a FROM p UNION ALL SELECT tree, idx, step + 1, sha256(b[step + 1] || h || a[step + 1]), b, a FROM fold WHERE step < len(b))
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, fold.h AS folded_root, fold.h = (SELECT h FROM top WHERE n = 1) AS verified
FROM p JOIN subs USING (tree) JOIN fold ON fold.tree = p.tree AND fold.idx = p.idx AND fold.step = len(p.b)
"""

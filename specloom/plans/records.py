"""Queries of rules, relations, versioned records and units over the given tables, with SQL that states their results.

The capabilities are documented without code where they come from, so their semantics are those of the operators' docstrings.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from specloom.functions import units
from specloom.operators import audit, catalog, extract, history, material, products, relations, rules, trace
from specloom.operators.shared import folder
from specloom.plans.registry import _FAMILY_SQL, FAMILIES, query
from specloom.sources.tables import table
from specloom.streaming import ordered

RULES = [
    ("bulk", 1, "active", "price", 1, "Raise Warning"), ("large", 1, "active", "price", 2, "Reject"), ("large", 2, "active", "price", 2, "Validate"), ("any", 1, "active", "price", 9, "Calculate"),
    ("returned", 1, "active", "review", 1, "Add Requirement"), ("returned_bulk", 1, "active", "review", 0, "Raise Error"), ("loop_a", 1, "active", "review", 5, "Select Product"), ("loop_b", 1, "active", "review", 5, "Select Product"),
    ("off", 1, "active", "review", 2, "Validate"), ("off", 2, "retired", "review", 2, "Validate"), ("wants_off", 1, "active", "review", 3, "Validate"),
]
CONDITIONS = [
    ("bulk", 1, "l_quantity", ">", 40.0, None), ("bulk", 1, "l_discount", "<", 0.05, None), ("large", 1, "l_quantity", ">", 1.0, None), ("large", 2, "l_quantity", ">", 20.0, None),
    ("returned", 1, "l_returnflag", "=", None, "R"), ("returned_bulk", 1, "l_tax", "<=", 0.04, None),
]
NEEDS = [("returned_bulk", "returned"), ("returned_bulk", "bulk"), ("loop_a", "loop_b"), ("loop_b", "loop_a"), ("wants_off", "off")]

_B = "struct_pack(said := 'l_quantity > 40.0', ok := l_quantity > 40), struct_pack(said := 'l_discount < 0.05', ok := l_discount < 0.05)"
_R = "struct_pack(said := 'l_returnflag = R', ok := l_returnflag = 'R')"
_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"  # tells line items apart
_RULES_SQL = f"""SELECT {_KEY}, unnest([
    struct_pack(rule_id := 'bulk', rule_group := 'price', priority := 1, act := 'Raise Warning', c := [{_B}]),
    struct_pack(rule_id := 'large', rule_group := 'price', priority := 2, act := 'Validate', c := [struct_pack(said := 'l_quantity > 20.0', ok := l_quantity > 20)]),
    struct_pack(rule_id := 'any', rule_group := 'price', priority := 9, act := 'Calculate', c := []),
    struct_pack(rule_id := 'returned', rule_group := 'review', priority := 1, act := 'Add Requirement', c := [{_R}]),
    struct_pack(rule_id := 'returned_bulk', rule_group := 'review', priority := 0, act := 'Raise Error', c := [struct_pack(said := 'l_tax <= 0.04', ok := l_tax <= 0.04), {_R}, {_B}])], recursive := false) AS r FROM lineitem"""


@query(f"""WITH e AS (SELECT {_KEY}, r.*, list_sort(list_transform(list_filter(r.c, lambda x: NOT coalesce(x.ok, false)), lambda x: x.said)) AS failed FROM ({_RULES_SQL})),
  p AS (SELECT *, row_number() OVER (PARTITION BY {_KEY}, rule_group, len(failed) = 0 ORDER BY priority, rule_id) AS place FROM e)
  SELECT {_KEY}, rule_id, CASE WHEN len(failed) > 0 THEN 'skipped' WHEN place = 1 THEN 'executed' ELSE 'overruled' END AS outcome, CASE WHEN len(failed) = 0 AND place = 1 THEN act END AS action, array_to_string(failed, '; ') AS failed FROM p""")
def d_rule_trace(spark, d):
    """Rules of several versions, groups, priorities and needs over every line item."""
    known = rules.in_force(spark.createDataFrame(RULES, "rule_id string, version int, status string, rule_group string, priority int, action string"))
    conditions, refused = rules.conditions_of(known, spark.createDataFrame(CONDITIONS, "rule_id string, version int, fact string, op string, number double, text string"), spark.createDataFrame(NEEDS, "rule_id string, needed string"))
    key = _KEY.split(", ")
    lines = rules.facts(table(spark, d, "lineitem"), key, ["l_quantity", "l_discount", "l_tax", "l_returnflag"])
    return rules.evaluate(lines, key, known.join(refused, "rule_id", "left_anti"), conditions).select(*key, "rule_id", "outcome", "action", F.array_join("failed", "; ").alias("failed"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS id, p_partkey // 2 AS needed FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2 UNION SELECT p_partkey, p_partkey FROM part WHERE p_size = 50 AND p_partkey > 20),
  bad AS (SELECT id FROM e WHERE id = needed UNION SELECT e.id FROM bad JOIN e ON e.needed = bad.id),
  lv AS (SELECT p_partkey AS id, 0 AS level FROM part UNION SELECT e.id, level + 1 FROM lv JOIN e ON e.needed = lv.id AND e.id <> e.needed)
  SELECT id, CASE WHEN id IN (SELECT id FROM bad) THEN NULL ELSE max(level) END AS level FROM lv GROUP BY id""")
def d_dependency_levels(spark, d):
    """Each part needs those of half and a third of its number; parts of size 50 need themselves."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    needs = [part.filter("id > 1").select("id", F.expr("id div 2").alias("needed")), part.filter("id > 2").select("id", F.expr("id div 3").alias("needed")), part.filter("p_size = 50 and id > 20").select("id", F.col("id").alias("needed"))]
    return relations.levels(part.select("id"), needs[0].union(needs[1]).union(needs[2]))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS source, p_partkey // 2 AS target, DATE '2020-01-01' + p_size * 10 AS f, CASE WHEN p_size % 10 = 0 THEN DATE '9999-12-31' ELSE DATE '2020-01-01' + p_size * 10 + (200 + p_partkey % 300)::INT END AS t FROM part WHERE p_partkey > 1
    UNION SELECT p_partkey, p_partkey * 2, DATE '2020-01-01', DATE '2020-12-01' FROM part WHERE p_partkey <= 5),
  c AS (SELECT * FROM e WHERE source <> target UNION SELECT c.source, e.target, greatest(c.f, e.f), least(c.t, e.t) FROM c JOIN e ON e.source = c.target WHERE c.source <> e.target AND greatest(c.f, e.f) < least(c.t, e.t))
  SELECT source, target, f AS valid_from, CASE WHEN t < DATE '9999-12-31' THEN t END AS valid_to FROM c""")
def d_replacement_paths(spark, d):
    """A part replaces the one of half its number for a time; the first five are also replaced by their doubles."""
    part, start = table(spark, d, "part"), F.lit("2020-01-01").cast("date")
    since = F.date_add(start, F.col("p_size") * 10)
    until = F.when(F.col("p_size") % 10 != 0, F.date_add(since, (F.lit(200) + F.col("p_partkey") % 300).cast("int")))
    down = part.filter("p_partkey > 1").select(F.col("p_partkey").alias("source"), F.expr("p_partkey div 2").alias("target"), since.alias("valid_from"), until.alias("valid_to"))
    up = part.filter("p_partkey <= 5").select(F.col("p_partkey"), F.col("p_partkey") * 2, start, F.lit("2020-12-01").cast("date"))
    return relations.closure(down.union(up)).drop("hops")


@query("""WITH v AS (SELECT l_partkey, l_shipdate, max_by(struct_pack(p := l_extendedprice, s := l_suppkey), l_orderkey * 10 + l_linenumber) AS v FROM lineitem GROUP BY ALL),
  q AS (SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT l_orderkey, l_linenumber, q.l_partkey, v.p AS price, v.s AS supplier FROM q ASOF LEFT JOIN v ON q.l_partkey = v.l_partkey AND q.o_orderdate >= v.l_shipdate""")
def d_price_at_order(spark, d):
    """The price and supplier of a part as last shipped when each order was placed."""
    lines = table(spark, d, "lineitem")
    versions = lines.select("l_partkey", F.col("l_shipdate").alias("since"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version"), F.col("l_extendedprice").alias("price"), F.col("l_suppkey").alias("supplier"))
    placed = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    asked = lines.select("l_orderkey", "l_linenumber", "l_partkey").join(placed, "l_orderkey")
    month = F.year("_time") * 12 + F.month("_time")
    return history.at_time(asked, versions, ["l_partkey"], "o_orderdate", "since", "version", month, ["price", "supplier"]).select("l_orderkey", "l_linenumber", "l_partkey", "price", "supplier")


@query("""SELECT l_partkey, max_by(l_orderkey, l_orderkey * 10 + l_linenumber) AS l_orderkey, max_by(l_extendedprice, l_orderkey * 10 + l_linenumber) AS price FROM lineitem GROUP BY l_partkey""")
def d_latest_version(spark, d):
    """The latest version of each part's price."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", F.col("l_extendedprice").alias("price"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version"))
    return history.latest(lines, ["l_partkey"], "version").select("l_partkey", "l_orderkey", "price")


_CHANGED = """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 3 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_extendedprice + 0.001 AS l_extendedprice, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag FROM lineitem WHERE l_orderkey % 11 <> 0"""
_NEW = f"""SELECT * FROM ({_CHANGED}) UNION ALL SELECT * FROM ({_CHANGED}) WHERE l_orderkey % 17 = 4 UNION ALL SELECT l_orderkey, l_linenumber + 100, l_quantity, l_extendedprice, l_returnflag FROM ({_CHANGED}) WHERE l_orderkey % 19 = 0"""


@query(f"""WITH o AS (SELECT l_orderkey, l_linenumber, count(*) AS n, max(l_quantity) AS q, max(l_extendedprice) AS p, max(l_returnflag) AS f FROM lineitem GROUP BY ALL), w AS (SELECT l_orderkey, l_linenumber, count(*) AS n, max(l_quantity) AS q, max(l_extendedprice) AS p, max(l_returnflag) AS f FROM ({_NEW}) GROUP BY ALL),
  b AS (SELECT coalesce(o.l_orderkey, w.l_orderkey) AS l_orderkey, coalesce(o.l_linenumber, w.l_linenumber) AS l_linenumber, coalesce(o.n, 0) AS n1, coalesce(w.n, 0) AS n2, o.q AS q1, w.q AS q2, o.p AS p1, w.p AS p2, o.f AS f1, w.f AS f2 FROM o FULL JOIN w ON o.l_orderkey = w.l_orderkey AND o.l_linenumber = w.l_linenumber),
  g AS (SELECT * FROM b WHERE n1 = 1 AND n2 = 1)
  SELECT l_orderkey, l_linenumber, NULL AS "column", n1::VARCHAR AS old, n2::VARCHAR AS new, 'duplicate' AS kind FROM b WHERE n1 > 1 OR n2 > 1
  UNION ALL SELECT l_orderkey, l_linenumber, NULL, NULL, NULL, CASE WHEN n1 = 0 THEN 'added' ELSE 'removed' END FROM b WHERE n1 <= 1 AND n2 <= 1 AND n1 + n2 = 1
  UNION ALL SELECT l_orderkey, l_linenumber, 'l_quantity', q1::VARCHAR, q2::VARCHAR, 'changed' FROM g WHERE q1 IS DISTINCT FROM q2 AND coalesce(abs(q1 - q2) > 0.01, true)
  UNION ALL SELECT l_orderkey, l_linenumber, 'l_extendedprice', p1::VARCHAR, p2::VARCHAR, 'changed' FROM g WHERE p1 IS DISTINCT FROM p2 AND coalesce(abs(p1 - p2) > 0.01, true)
  UNION ALL SELECT l_orderkey, l_linenumber, 'l_returnflag', f1, f2, 'changed' FROM g WHERE f1 IS DISTINCT FROM f2""")
def d_differences(spark, d):
    """The line items against a state of them with changed, added, removed and repeated rows."""
    old = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    changed = old.filter("l_orderkey % 11 <> 0").withColumns({"l_quantity": F.expr("if(l_orderkey % 7 = 3, l_quantity + 1, l_quantity)"), "l_extendedprice": F.expr("l_extendedprice + 0.001D"), "l_returnflag": F.expr("if(l_orderkey % 13 = 0, null, l_returnflag)")})
    new = changed.union(changed.filter("l_orderkey % 17 = 4")).union(changed.filter("l_orderkey % 19 = 0").withColumn("l_linenumber", F.col("l_linenumber") + 100))
    return history.differences(old, new, ["l_orderkey", "l_linenumber"], 0.01)


@query("""SELECT p_partkey, alternative, place FROM (SELECT a.p_partkey, b.p_partkey AS alternative, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_retailprice, b.p_partkey) AS place
  FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_partkey <> b.p_partkey AND abs(a.p_size - b.p_size) <= 4 AND abs(a.p_retailprice - b.p_retailprice) <= 200) WHERE place <= 3""")
def d_alternatives(spark, d):
    """The three cheapest compatible alternatives of each part."""
    return relations.alternatives(table(spark, d, "part"), "p_partkey", ["p_type"], {"p_size": 4, "p_retailprice": 200}, "p_retailprice", 3)


_UNIT = "list_extract(['mm', 'cm', 'm', 'inch', 'bar', 'furlong', NULL], l_linenumber)"
_FACTOR = "list_extract([0.001::DOUBLE, 0.01, 1.0, 0.0254, NULL, NULL, NULL], l_linenumber)"
_ERROR = f"CASE {_UNIT} WHEN 'bar' THEN NULL WHEN 'furlong' THEN 'unknown unit furlong' ELSE CASE WHEN {_UNIT} IS NULL THEN 'unknown unit null' END END"


@query(f"""SELECT l_orderkey, l_linenumber, round(((l_quantity * 0.001::DOUBLE) * (l_quantity * 0.001::DOUBLE) * (pi() / 4)) * (l_quantity * {_FACTOR}) / 0.001::DOUBLE, 4) AS litres, CASE {_UNIT} WHEN 'bar' THEN 'isn''t measured in litre' ELSE {_ERROR} END AS volume_error,
  round((l_quantity * {_FACTOR} + 1.0) / 0.01::DOUBLE, 4) AS sum_cm, CASE {_UNIT} WHEN 'bar' THEN 'mixed dimensions' ELSE {_ERROR} END AS sum_error, round((l_extendedprice * (0.001::DOUBLE / 60)) / ((l_quantity * 0.001::DOUBLE) * (l_quantity * 0.001::DOUBLE) * (pi() / 4)), 4) AS velocity FROM lineitem""")
def d_units(spark, d):
    """Pipe volume, a sum and a flow velocity of line items in several units; what doesn't fit is an error."""
    lines, l_unit = table(spark, d, "lineitem"), F.get(F.array(*map(F.lit, ("mm", "cm", "m", "inch", "bar", "furlong", None))), F.col("l_linenumber") - 1)
    diameter, length = units.quantity(F.col("l_quantity"), F.lit("mm")), units.quantity(F.col("l_quantity"), l_unit)
    made = lines.select("l_orderkey", "l_linenumber", "l_extendedprice", diameter.alias("d"), length.alias("l"))
    volume = units.told(units.pipe_volume(F.col("d"), F.col("l")), F.lit("litre"))
    total = units.told(units.plus(F.col("l"), units.quantity(F.lit(1.0), F.lit("m"))), F.lit("cm"))
    speed = units.told(units.flow_velocity(units.quantity(F.col("l_extendedprice"), F.lit("litre/min")), F.col("d")), F.lit("m/s"))
    read = made.select("l_orderkey", "l_linenumber", volume.alias("v"), total.alias("t"), speed.alias("s"))
    return read.select("l_orderkey", "l_linenumber", F.round("v.value", 4).alias("litres"), F.col("v.error").alias("volume_error"), F.round("t.value", 4).alias("sum_cm"), F.col("t.error").alias("sum_error"), F.round("s.value", 4).alias("velocity"))


_F = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
_LOG_SQL = f"""s AS (SELECT event_id, user_id, event_type, props, event_id % ceil(count(*) OVER (PARTITION BY user_id) / 32.0)::BIGINT AS slice FROM events),
  p AS (SELECT *, row_number() OVER (PARTITION BY user_id, slice ORDER BY event_id) - 1 AS place, sha256({" || ".join(map(_F, ("event_id", "user_id", "event_type", "props")))}) AS said FROM s)"""


def _log(spark, d):
    return audit.chained(table(spark, d, "events").select("event_id", "user_id", "event_type", "props"), ["user_id"], ["event_id"], "event_id", per=32)


@query(f"""WITH RECURSIVE {_LOG_SQL}, c AS (SELECT user_id, slice, 0 AS n, sha256('1:0' || {_F("user_id")} || {_F("slice")}) AS head FROM p GROUP BY ALL
    UNION ALL SELECT c.user_id, c.slice, n + 1, sha256(head || said) FROM c JOIN p ON p.user_id IS NOT DISTINCT FROM c.user_id AND p.slice = c.slice AND p.place = c.n)
  SELECT user_id, slice, max(n)::BIGINT AS n, max_by(head, n) AS head FROM c GROUP BY ALL""")
def d_audit_heads(spark, d):
    """The heads of the chains of all events, tenant by tenant."""
    return audit.heads(_log(spark, d), ["user_id"]).select("user_id", "slice", "n", "head")


@query(f"""WITH {_LOG_SQL}, t AS (SELECT *, event_id % 97 = 5 AS altered, event_id % 103 = 7 AND event_id % 97 <> 5 AS forged, event_id % 101 = 3 AS gone FROM p),
  w AS (SELECT *, coalesce(lag(place) OVER x, -1) + 1 AS due, coalesce(lag(forged) OVER x, false) AS after_forged FROM t WHERE NOT gone WINDOW x AS (PARTITION BY user_id, slice ORDER BY place)),
  e AS (SELECT user_id, slice, count(*) AS n, coalesce(max(place) FILTER (NOT gone) + 1, 0) AS place, max_by(forged, place) FILTER (NOT gone) AS forged FROM t GROUP BY ALL)
  SELECT user_id, slice, place, 'altered' AS kind FROM w WHERE altered UNION ALL SELECT user_id, slice, place, CASE WHEN due <> place THEN 'gap' ELSE 'unlinked' END FROM w WHERE due <> place OR after_forged
  UNION ALL SELECT user_id, slice, place, 'ended' FROM e WHERE place <> n OR forged""")
def d_audit_broken(spark, d):
    """Where a log breaks of which rows were altered, altered together with their hash, and taken out."""
    log = _log(spark, d)
    other = F.when((F.col("event_id") % 97 == 5) | (F.col("event_id") % 103 == 7), "forged").otherwise(F.col("event_type"))
    forged = log.filter("event_id % 101 != 3").withColumn("event_type", other)
    own = F.sha2(F.concat("before", audit.digest(["event_id", "user_id", "event_type", "props"])), 256)
    forged = forged.withColumn("hash", F.when((F.col("event_id") % 103 == 7) & (F.col("event_id") % 97 != 5), own).otherwise(F.col("hash")))
    return audit.broken(forged, audit.heads(log, ["user_id"]), ["user_id"]).select("user_id", "slice", "place", "kind")


@query(f"""SELECT category, list_position(['Pipe', 'Fitting', 'Valve', 'Sprinkler', 'Equipment', 'Support', 'Fastener', 'Accessory', 'Other', 'Unknown'], category)::INT AS ord FROM (SELECT DISTINCT {_FAMILY_SQL} AS category FROM part)""")
def o_category_order(spark, d):
    """O2: the place of each category in the report."""
    filed = F.coalesce(*(F.when(F.split("p_type", " ")[0] == k, v) for k, v in FAMILIES.items()), F.lit("misc"))
    return material.category_breakdown(table(spark, d, "part").select(filed.alias("category"), F.lit(None).cast("string").alias("product_id"), F.lit(None).cast("string").alias("matched_product"))).select("category", "ord")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN turn + 1 ELSE turn * 10 END AS page_number FROM conversations")
def x_page_numbers(spark, d):
    """Pages without a number, or with 0, are counted from 1 in their order."""
    pages = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("page_ord"), F.when(F.col("turn") % 3 != 0, F.col("turn") * 10).when(F.col("turn") % 2 == 0, 0).alias("page_number"), "text")
    return extract.normalize_pages(pages).select("conv_id", F.col("page_ord").alias("turn"), "page_number")


@query("SELECT p_partkey, p_name || '|' || p_brand || '|' || p_size AS ratings FROM part")
def x_temperature_split(spark, d):
    """Ratings typed with line ends, commas and semicolons between them."""
    typed = F.concat(F.lit(" ;\n"), "p_name", F.lit(" ,,"), "p_brand", F.lit("\n;  "), "p_size", F.lit(" \n"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(catalog.temperature_ratings(typed), lambda r: r.sprinklerTemp), "|").alias("ratings"))


@query("SELECT p_partkey, p_brand AS manufacturer, p_type AS sub_category FROM part")
def n_alias_variants(spark, d):
    """Every spelling of the maker's and the design's name, misread ones included."""
    name = lambda names: F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names)).cast("int"))
    item = F.to_json(F.map_from_arrays(F.array(name(products.MANUFACTURER), name(products.SUB_CATEGORY), F.lit("SIN")), F.array("p_brand", "p_type", F.col("p_partkey").cast("string"))))
    made, _ = products.normalize(table(spark, d, "part").select(F.lit("i").alias("import_id"), item.alias("json")))
    return made.select(F.col("product_no").cast("long").alias("p_partkey"), "manufacturer", "sub_category")


@query("""SELECT p_partkey::VARCHAR AS product_no, p_brand AS manufacturer, 'list' AS source_document, 'needs_review' AS status, '{"source_row":"1"' || CASE WHEN p_size % 2 = 0 THEN ',"rti":"' || p_size || '"' ELSE '' END || ',"raw_json":{"SIN":"' || p_partkey || '","manufacturer":"' || p_brand || '"' || CASE WHEN p_size % 2 = 0 THEN ',"rti":' || p_size ELSE '' END || '}}' AS raw_text FROM part""")
def p_queue_rows(spark, d):
    """Rows for the review queue; fields that aren't set are left out of the payload."""
    item = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("SIN"), F.col("p_brand").alias("manufacturer"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("rti")))
    made, _ = products.normalize(table(spark, d, "part").select(F.lit("i").alias("import_id"), item.alias("json")))
    return catalog.queue_rows(made, "list").select("product_no", "manufacturer", "source_document", "status", "raw_text")


_PRICED = """WITH l AS (SELECT DISTINCT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, o_orderkey, c_custkey, c_nationkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IS NOT NULL)"""


def _links(spark, d):
    """Links of a run of three stages: what orders, customers and nations are worth, from line items up."""
    lines, orders, customers = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    line = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    first = trace.links(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), "r1", "orders", "order_total", F.col("o_orderkey"), {"line": line})
    second = trace.links(orders.join(customers, F.col("o_custkey") == F.col("c_custkey")), "r1", "customers", "customer_total", F.col("c_custkey"), {"order_total": F.col("o_orderkey")})
    third = trace.links(customers, "r1", "nations", "nation_total", F.col("c_nationkey"), {"customer_total": F.col("c_custkey")})
    return first.union(second).union(third)


@query(f"""{_PRICED} SELECT c_nationkey::VARCHAR AS nation, 'line' AS name, 3 AS hops, count(DISTINCT id) AS n FROM l GROUP BY 1
  UNION ALL SELECT c_nationkey::VARCHAR, 'order_total', 2, count(DISTINCT o_orderkey) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IS NOT NULL GROUP BY 1
  UNION ALL SELECT c_nationkey::VARCHAR, 'customer_total', 1, count(DISTINCT c_custkey) FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1""")
def d_run_trace(spark, d):
    """Each nation's worth walked back to all customers, orders and line items that it was made of."""
    start = table(spark, d, "customer").select(F.lit("r1").alias("run"), F.lit("nation_total").alias("name"), F.col("c_nationkey").alias("id")).filter("id is not null").distinct()
    return trace.backward(_links(spark, d), start).groupBy(F.col("start_id").alias("nation"), "name", "hops").agg(F.count("*").alias("n"))


@query("""SELECT 'customers' AS stage, c_custkey::VARCHAR AS made_id, o_orderkey::VARCHAR AS used_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)
  UNION SELECT 'nations', c_nationkey::VARCHAR, c_custkey::VARCHAR FROM customer WHERE c_nationkey IS NOT NULL AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""")
def d_unfounded_links(spark, d):
    """Links to orders and customers whose worth no stage made, as they have no line or no order."""
    line = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    sources = table(spark, d, "lineitem").select(F.lit("line").alias("name"), line.alias("id"))
    return trace.unfounded(_links(spark, d), sources).select("stage", "made_id", "used_id")


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL),
  o AS (SELECT user_id, event_id, event_type, us, row_number() OVER w AS place, lag(event_type) OVER w AS before FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id::VARCHAR))
  SELECT user_id, event_id, event_type, place, before FROM o WHERE us <= (SELECT (max(us) // 1000 - 3600000) * 1000 FROM e)""")
def d_events_in_order(spark, d):
    """Events as state: all events as a stream that delivers each twice, told once and in order per user as the watermark passes."""
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    path = f"{folder(spark)}/events-{uuid.uuid4().hex}"
    told = ordered.in_order(stream.union(stream))
    told.writeStream.format("parquet").option("path", f"{path}/told").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{path}/told").select(F.col("key").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), "event_type", "place", "before")

"""Queries over the given tables, each with the SQL that states its result independently.

The tables hold no specifications, so some queries render specification text from them and run the operators on it; the
SQL then computes what must come out straight from the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions import classify, numbers, text
from specloom.operators import catalog, extract, material, products
from specloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: First word of p_type, and the category that a material of that type is filed under.
FAMILIES = {"ECONOMY": "Pipe, steel", "SMALL": "fitting", "MEDIUM": " Valve", "LARGE": "Sprinkler head", "STANDARD": "monitoring", "PROMO": "accessory"}
_FAMILY_SQL = "CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN 'Pipe' WHEN 'SMALL' THEN 'Fitting' WHEN 'MEDIUM' THEN 'Valve' WHEN 'LARGE' THEN 'Sprinkler' WHEN 'STANDARD' THEN 'Equipment' WHEN 'PROMO' THEN 'Accessory' ELSE 'Unknown' END"


def _materials(spark, d) -> DataFrame:
    """Line items as material lines: filed by part type, matched where the discount is at least 0.03."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.split("p_type", " ")[0].alias("family"))
    filed = F.coalesce(*(F.when(F.col("family") == k, v) for k, v in FAMILIES.items()), F.lit("misc"))
    joined = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_quantity").join(part, "l_partkey")
    matched = F.when(F.col("l_discount") >= 0.03, F.concat(F.lit("db-"), "l_partkey"))
    return joined.select("l_orderkey", "l_linenumber", filed.alias("category"), matched.alias("product_id"), F.when(F.col("l_discount") >= 0.08, "").otherwise(None).alias("matched_product"), F.col("l_quantity").cast("int").alias("confidence"))


@query(f"""SELECT category, count(*) AS material_items, count(*) FILTER (l_discount >= 0.03) AS matched, count(*) FILTER (l_discount < 0.03) AS missing
  FROM (SELECT l_discount, {_FAMILY_SQL} AS category FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY category""")
def a_category_breakdown(spark, d):
    return material.category_breakdown(_materials(spark, d)).select("category", "material_items", "matched", "missing").orderBy("category")


@query("SELECT round(avg(trunc(l_quantity)))::BIGINT AS average_confidence FROM lineitem")
def a_average_confidence(spark, d):
    return material.average_confidence(table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("confidence")))


@query("SELECT count(*) AS total, count(*) FILTER (l_discount >= 0.03) AS matched, count(*) FILTER (l_discount < 0.03) AS missing, count(*) FILTER (l_discount >= 0.03) + count(*) FILTER (l_discount < 0.03) = count(*) AS balanced FROM lineitem JOIN part ON l_partkey = p_partkey")
def a_balance(spark, d):
    return material.balance(_materials(spark, d))

@query(f"SELECT {_FAMILY_SQL} AS category, min(l_orderkey * 10 + l_linenumber) AS first_seen FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def a_detected_categories(spark, d):
    return material.detected_categories(_materials(spark, d).withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "ord")


@query(f"""SELECT p_partkey, {_FAMILY_SQL} AS category FROM part""")
def a_group_by_category(spark, d):
    filed = F.coalesce(*(F.when(F.split("p_type", " ")[0] == k, v) for k, v in FAMILIES.items()), F.lit("misc"))
    return material.group_by_category(table(spark, d, "part").withColumn("category", filed), "p_partkey").select("p_partkey", F.col("group").alias("category"))

@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_discount = 0 THEN 'no discount' WHEN l_tax > 0.07 THEN 'tax too high' END AS err FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, err IS NULL ORDER BY l_linenumber, err) AS n FROM e),
  f AS (SELECT l_orderkey, string_agg(err, '; ' ORDER BY l_linenumber, err) AS error_message FROM r WHERE err IS NOT NULL AND n <= 5 GROUP BY 1)
  SELECT e.l_orderkey, count(*) AS total, count(*) FILTER (err IS NULL) AS queued, count(*) FILTER (err IS NOT NULL) AS failed, any_value(error_message) AS error_message,
  CASE WHEN count(*) FILTER (err IS NULL) = 0 THEN 'failed' ELSE 'completed' END AS status FROM e LEFT JOIN f USING (l_orderkey) GROUP BY e.l_orderkey""")
def a_import_summary(spark, d):
    error = F.when(F.col("l_discount") == 0, "no discount").when(F.col("l_tax") > 0.07, "tax too high")
    return catalog.import_summary(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), error, ["l_linenumber"], ("l_orderkey",))


@query("SELECT * FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring brand#2')")
def f_search(spark, d):
    return material.search(table(spark, d, "part"), "  RING Brand#2 ", ["p_name", "p_brand", "p_type"])

@query("""SELECT o_orderkey, o_totalprice > 100000 AND c_mktsegment <> '' AS matched FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def f_missing_matched(spark, d):
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    joined = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(customer, "o_custkey", "left")
    named = joined.select("o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("c_mktsegment")).alias("product_id"), F.lit("").alias("matched_product"))
    both = material.matched_lines(named).withColumn("matched", F.lit(True)).unionByName(material.missing_lines(named).withColumn("matched", F.lit(False)))
    return both.select("o_orderkey", "matched")


@query("""SELECT p_partkey AS id, p_name AS name, n AS n_lines, q AS quantity FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def j_catalog_overlay(spark, d):
    details = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"), F.lit("other").alias("name"), F.lit(1).alias("ord"))
    return catalog.overlay(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), details)

@query("""SELECT p_partkey AS id, p_name AS name, l_orderkey AS order_id, l_linenumber AS line, l_quantity AS quantity FROM part
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS r FROM lineitem) ON l_partkey = p_partkey AND r = 1""")
def j_catalog_overlay_lines(spark, d):
    """All line items as details, the last of each part wins."""
    details = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.lit("other").alias("name"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("ord"))
    return catalog.overlay(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), details)


@query("""SELECT n_nationkey, coalesce(string_agg(s_name, ', ' ORDER BY s_name) FILTER (s_acctbal > 0), '') AS names FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey""")
def j_collect_names(spark, d):
    supplier = table(spark, d, "supplier")
    links = supplier.filter("s_acctbal > 0").select(F.col("s_nationkey").cast("string").alias("product_id"), F.col("s_suppkey").cast("string").alias("approval_id"))
    named = catalog.with_approvals(table(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").cast("string").alias("id")), links, supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name")))
    return named.select("n_nationkey", F.array_join("approval_names", ", ").alias("names"))


def _rendered(spark, d, break_unit: bool = False, headings: bool = False, systems: bool = False) -> DataFrame:
    """A page for each order: a heading, then a line for each line item. headings: a heading before the lines 1, 4 and 7 or
    what follows them. systems: the page names up to two systems, and a second page the default one."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    kind = F.get(F.array(*map(F.lit, ("Pipe", "Flange bolt", "Valve", "Sprinkler head", "Pressostat", "Hose clip", "Label"))), F.col("l_linenumber") - 1)
    amount = F.regexp_replace(F.format_number("l_quantity", 2), ",", " ")
    line = F.concat_ws(" ", F.concat_ws(".", F.lit("14.33"), "l_orderkey", "l_linenumber"), kind, F.concat(F.lit("DN"), F.col("p_size") + 10)), F.concat(F.lit("stk "), F.replace(amount, F.lit("."), F.lit(",")))
    whole = F.concat(line[0], F.lit("\n" if break_unit else " "), line[1])
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").join(part, "l_partkey").select("l_orderkey", F.struct("l_linenumber", whole.alias("line")).alias("s"))
    heads = F.array(*(F.struct(F.lit(at).alias("l_linenumber"), F.lit(title).alias("line")) for at, title in ((1, "CHAPTER ONE"), (4, "14.2 CHAPTER FOUR"), (7, "CHAPTER SEVEN")))) if headings else F.array().cast("array<struct<l_linenumber:bigint,line:string>>")
    every = F.concat(F.transform(heads, lambda s: F.struct(s.l_linenumber.cast("long").alias("n"), F.lit(0).alias("k"), s.line.alias("line"))), F.transform(F.collect_list("s"), lambda s: F.struct(s.l_linenumber.cast("long").alias("n"), F.lit(1).alias("k"), s.line.alias("line"))))
    page = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(every), lambda s: s.line), "\n").alias("body"))
    head = F.lit("NFPA 13\nSYSTEM SUMMARY\nDry riser\n") if not systems else F.get(F.array(F.lit("Våtanlegg\nDelugeanlegg\n"), F.lit("deluge, then\nwet sprinkler\n"), F.lit("")), (F.col("doc_id") % 3).cast("int"))
    first = page.select("doc_id", F.lit(0).alias("page_ord"), F.lit(1).alias("page_number"), F.concat(head, "body").alias("text"))
    if systems:
        first = first.unionByName(page.select("doc_id", F.lit(1).alias("page_ord"), F.lit(0).alias("page_number"), F.lit("om sprinkleranlegg  A10 her").alias("text")))
    return extract.normalize_pages(first)


_RENDERED = """SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS ln, concat('14.33.', l_orderkey, '.', l_linenumber) AS post_number, l_quantity AS quantity, 'DN' || (p_size + 10) AS dimension,
  CASE l_linenumber WHEN 1 THEN 'Pipe' WHEN 2 THEN 'Flange bolt' WHEN 3 THEN 'Valve' WHEN 4 THEN 'Sprinkler head' WHEN 5 THEN 'Pressostat' WHEN 6 THEN 'Hose clip' ELSE 'Label' END || ' DN' || (p_size + 10) AS description,
  CASE l_linenumber WHEN 1 THEN 'pipe' WHEN 2 THEN 'fitting' WHEN 3 THEN 'valve' WHEN 4 THEN 'sprinkler' WHEN 5 THEN 'sensor' WHEN 6 THEN 'unknown' ELSE 'marking' END AS category FROM lineitem JOIN part ON l_partkey = p_partkey"""


@query(f"""SELECT doc_id, post_number, CASE WHEN ln % 3 = 1 THEN NULL ELSE '' END IS NULL AS own_title, 'CHAPTER ' || CASE WHEN ln >= 7 THEN 'SEVEN' WHEN ln >= 4 THEN 'FOUR' ELSE 'ONE' END AS section_title FROM ({_RENDERED})""")
def j_asof_title(spark, d):
    """Each row's nearest heading at or above it, on pages of several headings."""
    items = extract.line_items(_rendered(spark, d, headings=True))
    return items.select("doc_id", "post_number", (F.regexp_extract("post_number", r"(\d+)$", 1).cast("int") % 3 == 1).alias("own_title"), "section_title")

@query(f"""SELECT doc_id, post_number, CASE doc_id % 3 WHEN 0 THEN 'Delugeanlegg' WHEN 1 THEN 'Våtanlegg' ELSE 'Sprinkleranlegg A10' END AS system FROM ({_RENDERED})""")
def j_last_on_page(spark, d):
    """The page's last system, else the document's default system, which another page names."""
    return extract.line_items(_rendered(spark, d, systems=True)).select("doc_id", "post_number", "system")

@query("""SELECT doc_id, normalized_name, source_page FROM (SELECT conv_id AS doc_id, turn + 1 AS source_page, CASE role WHEN 'system' THEN 'deluge' WHEN 'user' THEN 'dry-riser' ELSE 'wet-sprinkler' END AS normalized_name,
  row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations) WHERE r = 1""")
def w_dedup_first(spark, d):
    """The first page of each system: a page for each turn, which names a system by its role after the turn's own text."""
    named = F.when(F.col("role") == "system", "DELUGE").when(F.col("role") == "user", "Dry  riser").otherwise("våtanlegg")
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_ord"), (F.col("turn") + 1).alias("page_number"), F.concat_ws("\n", "text", named).alias("text"))
    return extract.systems(extract.normalize_pages(pages)).select("doc_id", "normalized_name", "source_page")

@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey")
def o_review_queue(spark, d):
    """The whole queue in its order."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    return catalog.review_queue(orders, "O").select(F.col("id").alias("o_orderkey"), F.col("created_at").alias("o_orderdate"), "o_totalprice")

@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey")
def o_review_queue_whole(spark, d):
    """The whole queue in its order, keys and dates only."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))
    return catalog.review_queue(orders, "O").select(F.col("id").alias("o_orderkey"), F.col("created_at").alias("o_orderdate"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS parsed FROM lineitem")
def x_number_parse(spark, d):
    price = F.format_number("l_extendedprice", 2)
    norwegian = F.translate(price, ",.", " ,")
    shown = F.when(F.col("l_linenumber") % 3 == 0, norwegian).when(F.col("l_linenumber") % 3 == 1, price).otherwise(F.translate(price, ",.", ".,"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.number(shown).alias("parsed"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'stk' WHEN 2 THEN 'm' WHEN 3 THEN 'm2' WHEN 4 THEN 'sett' WHEN 5 THEN 'RS' WHEN 6 THEN 'l' ELSE 'kg' END AS unit FROM lineitem")
def x_unit_map(spark, d):
    spelled = F.get(F.array(*map(F.lit, ("Pcs", "metre", "M²", "set", "rs", "Litre", "KG"))), F.col("l_linenumber") - 1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.unit(F.coalesce(spelled, F.lit("KG"))).alias("unit"))


@query(f"SELECT doc_id, post_number, description, quantity, 'stk' AS unit, dimension, 'single-line' AS method FROM ({_RENDERED})")
def x_quantity_parse(spark, d):
    items = extract.line_items(_rendered(spark, d))
    return items.select("doc_id", "post_number", "description", "quantity", "unit", "dimension", F.col("extraction_method").alias("method"))


@query(f"SELECT doc_id, post_number, quantity, 'wrapped-line' AS method, description || chr(10) AS shown FROM ({_RENDERED})")
def x_wrapped_rows(spark, d):
    items = extract.line_items(_rendered(spark, d, break_unit=True))
    return items.select("doc_id", "post_number", "quantity", F.col("extraction_method").alias("method"), F.concat("description", F.lit("\n")).alias("shown"))


@query(f"""SELECT doc_id, post_number, category, CASE category WHEN 'unknown' THEN 'unknown-category' ELSE 'high-confidence' END AS flags, CASE category WHEN 'unknown' THEN 52 + 18 + 11 + 5 + 4 - 12 ELSE 99 END AS confidence,
  'Tørropplegg / fire department connection' AS system, 'NFPA 13' AS standards FROM ({_RENDERED})""")
def x_classify_score_flags(spark, d):
    items = extract.line_items(_rendered(spark, d))
    return items.select("doc_id", "post_number", "category", F.array_join("review_flags", ",").alias("flags"), "confidence", "system", F.array_join("standard_refs", ",").alias("standards"))


@query(f"""SELECT doc_id, ln AS line, CASE category WHEN 'pipe' THEN 'Pipe' WHEN 'fitting' THEN 'Fitting' WHEN 'valve' THEN 'Valve' WHEN 'sprinkler' THEN 'Sprinkler' WHEN 'sensor' THEN 'Equipment' WHEN 'marking' THEN 'Other' ELSE 'Unknown' END AS category,
  category IN ('unknown', 'marking') AS missing_from_database, 'Page 1, post ' || post_number AS source_reference, '/projects/demo/upload?postnr=' || post_number || '&page=1' AS document_href
  FROM (SELECT doc_id, post_number, category, row_number() OVER (PARTITION BY doc_id ORDER BY ln, description, replace(printf('%.2f', quantity), '.', ',')) AS ln FROM ({_RENDERED}))""")
def p_material_list(spark, d):
    lines = material.material_lines(extract.line_items(_rendered(spark, d)))
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), "category", "missing_from_database", "source_reference", "document_href")


@query(f"SELECT doc_id, count(*) AS n_matches, count(*) AS n_verified FROM ({_RENDERED}) WHERE category NOT IN ('unknown', 'marking') GROUP BY doc_id")
def p_product_matches(spark, d):
    matches = material.product_matches(material.material_lines(extract.line_items(_rendered(spark, d))))
    return matches.groupBy("doc_id").agg(F.count("*").alias("n_matches"), F.count_if(F.col("status") == "Verified").alias("n_verified"))


@query("""SELECT p_partkey, CASE WHEN p_size >= 10 THEN 'DN' || p_size || ',' ELSE '' END || 'K=' || (p_size + 60) || ',' || (p_size + 20) || '°C,' || 'OD' || p_size || ',' || p_size || 'x' || (p_size + 1) || 'mm,' || (p_size + 1) || 'mm' AS dimensions FROM part""")
def x_dimensions(spark, d):
    """All six forms, by kind, each once; DN takes two digits or more."""
    size = F.col("p_size")
    shown = F.concat(F.lit("Pipe dn "), size, F.lit(" at "), size + 20, F.lit(" ° c, "), size, F.lit(" x "), size + 1, F.lit(" mm, od "), size, F.lit(", k = "), size + 60, F.lit(" and DN"), size)
    return table(spark, d, "part").select("p_partkey", F.array_join(classify.dimensions(shown), ",").alias("dimensions"))

@query("""SELECT p_partkey, CASE WHEN p_size >= 10 THEN 'DN' || p_size || ',' ELSE '' END || (p_size + 20) || '°C,' || p_size || 'x' || (p_size + 1) || 'mm,' || (p_size + 1) || 'mm' AS dimensions FROM part""")
def x_dimensions_all(spark, d):
    """All parts; DN takes two digits or more, so a short size gives none."""
    shown = F.concat(F.lit("Pipe dn "), "p_size", F.lit(" at "), F.col("p_size") + 20, F.lit(" ° c, "), "p_size", F.lit(" x "), F.col("p_size") + 1, F.lit(" mm and DN"), "p_size")
    return table(spark, d, "part").select("p_partkey", F.array_join(classify.dimensions(shown), ",").alias("dimensions"))


#: The whole text of each document, and a line after it in which known marks stand.
_SUFFIXED = "SELECT doc_id, coalesce(text, '') || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'nfpa  13, fm, NFPA13' WHEN 1 THEN 'UL and NFPA 14 (ul)' ELSE 'vds / NFPA13, NS-EN 12845' END || ' at ' || (doc_id % 90 + 1) || ' bar, qR... QR; k = 80, 68 °C, DN ' || (doc_id % 90 + 10) || chr(10) || 'DN' || (doc_id % 90 + 10) AS t FROM documents"


def _suffixed(spark, d, page: int) -> DataFrame:
    marks = F.get(F.array(F.lit("nfpa  13, fm, NFPA13"), F.lit("UL and NFPA 14 (ul)"), F.lit("vds / NFPA13, NS-EN 12845")), (F.col("doc_id") % 3).cast("int"))
    line = F.concat(marks, F.lit(" at "), F.col("doc_id") % 90 + 1, F.lit(" bar, qR... QR; k = 80, 68 °C, DN "), F.col("doc_id") % 90 + 10, F.lit("\nDN"), F.col("doc_id") % 90 + 10)
    text_ = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), line)
    return extract.normalize_pages(table(spark, d, "documents").select("doc_id", F.lit(0).alias("page_ord"), F.lit(page).alias("page_number"), text_.alias("text")))


#: Lines of the rendered texts as the pages hold them: misread characters of no consequence here, blanks squeezed, trimmed.
_LINES = rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '[–—]', '-', 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(rf"""WITH s AS (SELECT doc_id, {_LINES} AS lines, regexp_extract_all(t, '(?i)\b(?:NFPA\s*13|NFPA\s*14|NS-?\s*EN\s*12845|FM|UL|VdS)\b') AS hits FROM ({_SUFFIXED})),
  h AS (SELECT doc_id, lines, regexp_replace(unnest(hits), '\s+', ' ', 'g') AS hit, generate_subscripts(hits, 1) AS pos FROM s),
  c AS (SELECT *, replace(regexp_replace(regexp_replace(upper(hit), '^NS-? ?EN', 'NS-EN '), '^NFPA ?', 'NFPA '), 'VDS', 'VdS') AS code FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, code ORDER BY pos) = 1)
  SELECT doc_id, code, coalesce(list_filter(lines, lambda x: contains(lower(x), lower(hit)))[1], code) AS source_text FROM c""")
def x_standards(spark, d):
    return extract.standards(_suffixed(spark, d, 0)).select("doc_id", "code", "source_text")

@query(rf"""WITH s AS ({_SUFFIXED}),
  h AS (SELECT doc_id, kind, type, unnest(hits) AS hit, generate_subscripts(hits, 1) AS pos FROM (
    SELECT doc_id, 0 AS kind, 'pressure' AS type, regexp_extract_all(t, '(?i)\b\d{{1,3}}(?:[,.]\d+)?\s*bar\b') AS hits FROM s UNION ALL SELECT doc_id, 1, 'property', regexp_extract_all(t, '(?i)\bQR\b') FROM s
    UNION ALL SELECT doc_id, 2, 'property', regexp_extract_all(t, '(?i)\bK\s*=\s*(?:80|115)\b') FROM s UNION ALL SELECT doc_id, 3, 'property', regexp_extract_all(t, '(?i)\b\d{{2,3}}\s*°\s*C\b') FROM s
    UNION ALL SELECT doc_id, 4, 'dimension', regexp_extract_all(t, '(?i)\bDN\s?\d{{2,3}}\b') FROM s)),
  v AS (SELECT *, regexp_replace(regexp_replace(hit, '\s+', ' ', 'g'), '(?i)DN ', 'DN') AS value FROM h),
  f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, type, trim(regexp_replace(lower(value), '[^a-z0-9]+', '-', 'g'), '-') ORDER BY kind, pos) = 1)
  SELECT f.doc_id, type, value, coalesce(list_filter(lines, lambda x: contains(lower(x), lower(regexp_replace(hit, '[ \t]+', ' ', 'g'))))[1], value) AS source_text FROM f JOIN (SELECT doc_id, {_LINES} AS lines FROM s) USING (doc_id)""")
def x_requirements(spark, d):
    """Pressures, properties and dimensions of the whole texts; standards have their own query."""
    return extract.requirements(_suffixed(spark, d, 7)).filter("type <> 'standard'").select("doc_id", "type", "value", "source_text")

@query("""SELECT doc_id, code FROM (SELECT conv_id AS doc_id, unnest(CASE WHEN conv_id % 2 = 0 THEN ['NO_STANDARDS_DETECTED', 'NO_LINE_ITEMS_DETECTED', 'NO_TEXT_EXTRACTED'] ELSE ['NO_STANDARDS_DETECTED', 'UNKNOWN_LINE_ITEMS_INCLUDED', 'MATERIAL_LINES_NEED_REVIEW'] END) AS code FROM (SELECT DISTINCT conv_id FROM conversations))""")
def x_warnings(spark, d):
    pages = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min("turn").alias("t"))
    text_ = F.when(F.col("doc_id") % 2 == 0, "").otherwise("Insulation plate m2 45,5")
    return extract.warnings(extract.normalize_pages(pages.select("doc_id", F.lit(0).alias("page_ord"), F.lit(1).alias("page_number"), text_.alias("text")))).select("doc_id", "code")


@query("""SELECT p_partkey, left(p_name || ' 2024 Rev 3', 255) AS name, '2024' AS project_number, 'Rev 3' AS revision, 74 AS confidence FROM part""")
def x_project(spark, d):
    pages = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("page_ord"), F.lit(1).alias("page_number"), F.concat(F.lit(" "), "p_name", F.lit(" 2024 Rev 3 ")).alias("text"))
    return extract.project(extract.normalize_pages(pages)).select(F.col("doc_id").alias("p_partkey"), "name", "project_number", "revision", "confidence")


@query("SELECT o_orderkey, regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, CASE WHEN o_orderkey % 20 + 80 >= 94 THEN 'high' WHEN o_orderkey % 20 + 80 >= 90 THEN 'medium' ELSE 'low' END AS bucket FROM orders")
def x_slug_bucket(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.slug(F.col("o_orderpriority")).alias("slug"), classify.bucket(F.col("o_orderkey") % 20 + 80).alias("bucket"))

@query("SELECT event_id, json_extract_string(props, '$.k') AS k, upper(event_type) AS kind FROM events")
def n_json_fields(spark, d):
    v = F.try_parse_json(F.concat(F.rtrim(F.regexp_replace("props", r"\}\s*$", "")), F.lit(', "empty": "", "kind": " '), F.upper("event_type"), F.lit(' "}')))
    return table(spark, d, "events").select("event_id", products.read_text(v, ("nothing", "empty", "k")).alias("k"), products.read_text(v, ("kind",)).alias("kind"))


@query("""SELECT l_orderkey, concat(1, CASE WHEN n > 1 THEN '.' || r ELSE '' END) AS source_row, 'Maker ' || l_orderkey AS manufacturer, CASE WHEN n > 1 THEN 'S' || l_linenumber ELSE NULL END AS product_no FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)) WHERE n > 1 OR r = 1""")
def n_explode(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("n"))
    models = F.when(F.size("n") > 1, F.transform("n", lambda x: F.struct(F.concat(F.lit("S"), x).alias("sin")))).otherwise(F.array().cast("array<struct<sin:string>>"))
    shown = F.to_json(F.struct(F.array(F.struct(F.struct(models.alias("sprinklerModels")).alias("data"))).alias("products"), F.struct(F.concat(F.lit("Maker "), "l_orderkey").alias("manufacturer")).alias("documentInfo")))
    made, _ = products.normalize(rows.select(F.col("l_orderkey").alias("import_id"), shown.alias("json")))
    return made.select(F.col("import_id").alias("l_orderkey"), "source_row", "manufacturer", "product_no")


@query("""SELECT p_partkey, (p_size / 10)::DECIMAL(10, 1)::DOUBLE AS a, p_size::BIGINT AS b, 'CE, UL' AS approvals, 'Red, Blue' AS color FROM part""")
def n_kfactor(spark, d):
    tenth = F.col("p_size") / 10
    shown = F.concat(F.lit('[{"kFactor": [{"value": '), tenth, F.lit(', "units": "GPM"}, {"value": '), tenth, F.lit(', "units": "L PM/bar"}], "approvals": {"ceMark": true, "x": false, "ulListed": true}, "color": "Red, Blue", "finish": ["Red"]}]'))
    made, _ = products.normalize(table(spark, d, "part").select(F.col("p_partkey").alias("import_id"), shown.alias("json")))
    k = F.split(F.col("k_value_raw"), " ")
    return made.select(F.col("import_id").alias("p_partkey"), k[0].cast("double").alias("a"), k[3].cast("long").alias("b"), "approvals", "color")


@query("""SELECT conv_id, 'Item is not a JSON object.' AS message FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 4 = 1 UNION ALL SELECT conv_id, 'Invalid JSON. Import file must contain JSON.' FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 4 = 2""")
def n_errors(spark, d):
    ids = table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("t"))
    shown = F.get(F.array(F.lit('{"name": "x"}'), F.lit("[3]"), F.lit("{no"), F.lit("[]")), (F.col("conv_id") % 4).cast("int"))
    _, wrong = products.normalize(ids.select(F.col("conv_id").alias("import_id"), shown.alias("json")))
    return wrong.select(F.col("import_id").alias("conv_id"), "message")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '[{\"t\":' || (event_id % 7) || '}]' ELSE '[]' END AS temperature_ratings, CASE WHEN event_id % 3 = 0 THEN 'Red' ELSE 'old' END AS color FROM events")
def n_backfill(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"data": {"temperatureRatings": [{"t": '), F.col("event_id") % 7, F.lit('}], "color": " Red "}}'))).when(F.col("event_id") % 3 == 1, '{"temperatureRatings": null}').otherwise("{bad")
    return products.backfill(table(spark, d, "events").select("event_id", raw.alias("raw_text"), F.lit("[]").alias("temperature_ratings"), F.lit("old").alias("color"))).select("event_id", "temperature_ratings", "color")


def _catalog(spark, d):
    supplier = table(spark, d, "supplier")
    rows = supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.when(F.col("s_suppkey") % 5 == 0, " ").otherwise(F.col("s_name")).alias("manufacturer"), F.col("s_suppkey").cast("string").alias("product_no"), F.when(F.col("s_acctbal") > 0, "needs_review").otherwise("approved").alias("status"), F.lit(None).cast("timestamp").alias("reviewed_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    links = supplier.filter("s_suppkey % 2 = 0").select(F.concat(F.lit("l"), "s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("product_id"), F.col("s_nationkey").cast("string").alias("approval_id"))
    asked = supplier.join(nation.select(F.col("id").cast("int").alias("s_nationkey"), F.col("name")), "s_nationkey").select(F.col("s_suppkey").cast("string").alias("id"), F.concat("name", F.lit(" , , New "), F.col("s_nationkey") % 3).alias("approvals"))
    return catalog.approve(rows, nation, links, asked, F.lit("2024-01-01").cast("timestamp"))


_GRANTED = "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 5 <> 0"


@query(f"""WITH g AS ({_GRANTED}) SELECT 'approval' AS what, count(*) AS n FROM (SELECT n_name FROM nation UNION SELECT 'New ' || (s_nationkey % 3) FROM g)
  UNION ALL SELECT 'link', count(*) FROM (SELECT s_suppkey, s_nationkey::VARCHAR AS a FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT s_suppkey, s_nationkey::VARCHAR FROM g UNION SELECT s_suppkey, 'New ' || (s_nationkey % 3) FROM g)
  UNION ALL SELECT 'approved', (SELECT count(*) FROM supplier WHERE s_acctbal <= 0) + count(*) FROM g
  UNION ALL SELECT 'refused: ' || CASE WHEN s_acctbal <= 0 THEN 'not in review' ELSE 'manufacturer is required' END, count(*) FROM supplier WHERE NOT (s_acctbal > 0 AND s_suppkey % 5 <> 0) GROUP BY 1""")
def t_approve_upsert(spark, d):
    rows, approvals, links, refused = _catalog(spark, d)
    counted = lambda df, name: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    by_reason = refused.groupBy(F.concat(F.lit("refused: "), "reason").alias("what")).agg(F.count("*").alias("n"))
    return counted(approvals, "approval").union(counted(links, "link")).union(counted(rows.filter("status = 'approved'"), "approved")).union(by_reason)


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'New maker' ELSE '' END ELSE c_name END AS manufacturer, CASE WHEN c_acctbal > 0 AND c_custkey % 2 = 1 THEN NULL ELSE c_mktsegment END AS category FROM customer""")
def t_patch(spark, d):
    customer = table(spark, d, "customer")
    rows = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("manufacturer"), F.col("c_mktsegment").alias("category"), F.when(F.col("c_acctbal") > 0, "needs_review").otherwise("approved").alias("status"))
    edits = customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, " New maker ").otherwise(" ").alias("manufacturer"), F.when(F.col("c_custkey") % 2 == 1, "  ").alias("category"))
    changed, _ = catalog.patch(rows, edits, ["manufacturer", "category"])
    return changed.select(F.col("id").alias("c_custkey"), "manufacturer", "category")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def f_in_list(spark, d):
    wanted = catalog.equals(table(spark, d, "customer"), c_mktsegment="BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return catalog.keep_ids(table(spark, d, "orders").select("o_orderkey", "o_custkey"), wanted, "o_custkey")


def _one_line_pages(spark, d, shown) -> DataFrame:
    """A page for each line item, of the text in shown and nothing else; doc_id is l_orderkey * 10 + l_linenumber."""
    lines = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id")).agg(F.max("l_quantity").cast("int").alias("q"), F.max("l_linenumber").alias("n"), F.max("l_orderkey").alias("o"))
    return extract.normalize_pages(lines.select("doc_id", F.lit(0).alias("page_ord"), F.lit(3).alias("page_number"), shown.alias("text")))


_LINES = "SELECT l_orderkey * 10 + l_linenumber AS doc_id, trunc(max(l_quantity))::INT AS q, l_linenumber AS n, l_orderkey AS o FROM lineitem GROUP BY ALL"


@query(f"""SELECT doc_id, q::DOUBLE AS quantity, CASE n WHEN 1 THEN 'stk' WHEN 2 THEN 'm' WHEN 3 THEN 'sett' WHEN 4 THEN 'stk' WHEN 5 THEN 'kg' WHEN 6 THEN 'm2' ELSE 'stk' END AS unit,
  CASE n WHEN 1 THEN 'Klammer DN25' WHEN 2 THEN 'Pipe DN50' WHEN 3 THEN 'Alarmventil DN100' WHEN 4 THEN 'Bend DN32 galvanized' WHEN 5 THEN 'Pipe support' WHEN 6 THEN 'Insulation plate' ELSE 'Gasket DN65' END AS description,
  CASE n WHEN 1 THEN 'table-row' ELSE 'single-line' END AS method, CASE n WHEN 4 THEN 'Galvanized steel' END AS material, CASE n WHEN 3 THEN 'UB' || (o % 90 + 10) || '.1' WHEN 7 THEN 'X' || (o % 9 + 1) END AS ns_code FROM ({_LINES})""")
def x_row_forms(spark, d):
    """Quantities that trail, lead and stand inside, table cells, labels, codes and prices after a quantity."""
    q, o = F.col("q"), F.col("o")
    forms = (F.concat(F.lit("Klammer DN25 | stk | "), q), F.concat(q, F.lit(" m Pipe DN50")), F.concat(F.lit("UB"), o % 90 + 10, F.lit(".1 set "), q, F.lit(" Alarmventil DN100")), F.concat(F.lit("Bend DN32 stk "), q, F.lit(" galvanized")), F.concat(F.lit("Pipe support kg "), q, F.lit(" NOK 10 000")), F.concat(F.lit("Insulation plate, unit: m² quantity: "), q), F.concat(F.lit("X"), o % 9 + 1, F.lit(" Gasket DN65  "), q, F.lit(" pcs.")))
    items = extract.line_items(_one_line_pages(spark, d, F.get(F.array(*forms), F.col("n") - 1)))
    return items.select("doc_id", "quantity", "unit", "description", F.col("extraction_method").alias("method"), "material", "ns_code")


@query(f"""SELECT doc_id, id, notes, matched_product, product_id, compatible_products, status FROM (SELECT *, 'line-14.33.' || o || '.' || n AS id,
  CASE n WHEN 1 THEN 'SITE WORKS' WHEN 3 THEN 'Tørropplegg / fire department connection' ELSE '' END AS head, CASE n WHEN 2 THEN 'Standards: FM' WHEN 3 THEN 'Standards: NFPA 13, UL' ELSE '' END AS refs FROM ({_LINES})),
  LATERAL (SELECT concat_ws('. ', nullif(head, ''), nullif(refs, ''), CASE WHEN n <= 3 THEN 'Database match found' ELSE 'Missing from database' END) AS notes, CASE WHEN n <= 3 THEN 'Pipe database match DN50' END AS matched_product, CASE WHEN n <= 3 THEN 'db-pipe-dn50' END AS product_id,
  CASE WHEN n <= 3 THEN 'Ahlsell equivalent DN50|Victaulic compatible DN50' END AS compatible_products, CASE WHEN n <= 3 THEN 'Verified' END AS status)""")
def p_notes_and_matches(spark, d):
    """Notes of each material line; of matched lines the product, what is compatible and how sure it is."""
    post = F.concat(F.lit("14.33."), "o", F.lit("."), "n")
    tail = F.concat(F.lit(" stk "), F.col("q"))
    forms = (F.concat(F.lit("SITE WORKS\n"), post, F.lit(" Pipe DN50"), tail), F.concat(F.lit("fm\n"), post, F.lit(" Pipe DN50"), tail), F.concat(F.lit("Dry riser\nnfpa 13, UL\n"), post, F.lit(" Pipe DN50"), tail), *(F.concat(post, F.lit(" Clamp"), tail) for _ in range(4)))
    items = extract.line_items(_one_line_pages(spark, d, F.get(F.array(*forms), F.col("n") - 1)))
    lines = material.with_matches(material.material_lines(items))
    return lines.select("doc_id", "notes", "matched_product", "product_id", F.array_join("match.compatible_products", "|").alias("compatible_products"), "match.status", F.col("item_id").alias("id"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, flags, CASE WHEN data THEN 'missing data' WHEN score < 88 OR flags <> 'high-confidence' OR kind = 'unknown' OR (kind = 'pipe' AND NOT sized) THEN 'needs review' ELSE 'high confidence' END AS badge, score FROM (
  SELECT *, greatest(35, least(99, 52 + CASE WHEN qty IS NOT NULL AND unit <> '' THEN 18 ELSE 0 END + CASE WHEN sized THEN 11 ELSE 0 END + CASE WHEN kind <> 'unknown' THEN 12 ELSE -12 END + CASE WHEN post <> '' THEN 4 ELSE 0 END
    + CASE WHEN n % 2 = 0 THEN 2 ELSE -3 END + CASE WHEN kind = 'pipe' AND NOT sized THEN -7 ELSE 0 END + CASE WHEN weak THEN -10 ELSE 0 END + CASE WHEN n > 3 THEN 5 ELSE 0 END)) AS score,
    coalesce(nullif(concat_ws(',', CASE WHEN kind = 'unknown' THEN 'unknown-category' END, CASE WHEN coalesce(qty, 0) = 0 OR unit = '' THEN 'missing-quantity-or-unit' END, CASE WHEN kind = 'pipe' AND NOT sized THEN 'missing-dimension' END, CASE WHEN weak THEN 'weak-material-evidence' END), ''), 'high-confidence') AS flags
  FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_linenumber AS n, l_discount > 0.08 AS data, CASE WHEN l_quantity > 40 THEN 'unknown' ELSE 'pipe' END AS kind, l_quantity % 2 = 0 AND l_quantity <= 40 AS sized, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'p' END AS post,
    CASE WHEN l_tax < 0.02 THEN NULL WHEN l_tax < 0.04 THEN 0 ELSE 5 END AS qty, CASE WHEN l_tax > 0.06 THEN '' ELSE 'stk' END AS unit, l_quantity > 40 AND l_linenumber % 3 = 0 AS weak FROM lineitem))""")
def x_flags_score_badge(spark, d):
    """All five review flags, what they cost, and the badge."""
    n, q, tax = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_tax")
    kind, sized = F.when(q > 40, "unknown").otherwise("pipe"), (q % 2 == 0) & (q <= 40)
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_discount") > 0.08).alias("data"), kind.alias("kind"), F.when(q > 40, "odd thing").otherwise(F.when(sized, "Pipe DN40").otherwise("Pipe")).alias("text"), F.when(n % 3 == 0, "").otherwise("p").alias("post"),
        F.when(tax < 0.02, None).when(tax < 0.04, 0.0).otherwise(5.0).alias("qty"), F.when(tax > 0.06, "").otherwise("stk").alias("unit"), F.when(n % 2 == 0, "table-row").otherwise("wrapped-line").alias("method"), F.when(n > 3, F.array(F.lit("FM"))).otherwise(F.array().cast("array<string>")).alias("standards"))
    made = line.withColumn("sizes", classify.dimensions(F.col("text")))
    flagged = made.withColumn("flags", classify.review_flags(*map(F.col, ("kind", "text")), F.get("sizes", F.lit(0)), *map(F.col, ("post", "qty", "unit"))))
    scored = flagged.withColumn("score", classify.confidence(*map(F.col, ("kind", "sizes", "method", "post", "qty", "unit", "flags", "standards"))))
    badge = classify.badge(F.col("score"), F.col("flags"), F.col("kind"), (F.col("kind") == "pipe") & (F.size("sizes") == 0), F.col("data"))
    return scored.select("l_orderkey", "l_linenumber", "l_quantity", F.array_join("flags", ",").alias("flags"), badge.alias("badge"), "score")


@query("""SELECT conv_id AS doc_id, 'section-' || row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS id, title, turn % 2 + 1 AS source_page, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, lower(title) ORDER BY turn, k) AS r FROM (
    SELECT conv_id, turn, unnest([0, 1, 2]) AS k, unnest(['PART ' || upper(role) || ' OF IT', 'Delugeanlegg', 'CLOSING ' || chr((65 + turn % 3)::INT) || 'B WORK']) AS title, unnest([78, 72, 78]) AS confidence FROM conversations)) WHERE r = 1""")
def w_sections(spark, d):
    """Headings, numbered and in capitals, and lines that name a system, each once for a page number."""
    text_ = F.concat(F.lit("1.2 PART "), F.upper("role"), F.lit(" OF IT\nom Deluge her\nDeluge DN50 stk 4\nCLOSING "), F.char(F.lit(65) + F.col("turn") % 3), F.lit("B WORK\nPIPE WORK M 12"))
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_ord"), (F.col("turn") % 2 + 1).alias("page_number"), text_.alias("text"))
    return extract.sections(extract.normalize_pages(pages)).select("doc_id", "id", "title", "source_page", "confidence")


@query("""SELECT conv_id AS doc_id, count(*) AS n_pages, count(DISTINCT role) AS n_systems, CASE WHEN bool_or(role = 'user') THEN 2 ELSE 0 END AS n_standards FROM conversations GROUP BY conv_id""")
def a_document_summary(spark, d):
    mark = F.when(F.col("role") == "system", "deluge").when(F.col("role") == "user", "dry riser\nFM / NFPA 14").otherwise("våtanlegg")
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_ord"), F.col("turn").alias("page_number"), mark.alias("text"))
    return extract.summary(extract.normalize_pages(pages))


def _products(spark, d) -> DataFrame:
    """Parts as stored products: some fields are columns, some only in the raw payload, some only in the imported JSON."""
    key, size = F.col("p_partkey"), F.col("p_size")
    item = F.concat(F.lit('{"manufacturer": "M", "rti": "r'), size, F.lit('", "color": [["Red", [["Blue"]]], {"name": "Red"}], "orientation": "up", "temperatureRatings": [{"sprinklerTemp": "'), size, F.lit('°C"}]}'))
    inner = F.when(key % 2 == 0, F.concat(F.lit('{"source": '), item, F.lit("}"))).otherwise(item)
    raw = F.concat(F.lit('{"source_row": '), key % 5, F.lit(', "k_value_raw": "K'), size, F.lit('", "orientation": null, "approvals": ["FM", '), size, F.lit('], "raw_json": '), inner, F.lit("}"))
    return table(spark, d, "part").select(key.cast("string").alias("id"), F.col("p_brand").alias("manufacturer"), F.when(key % 3 > 0, F.concat(F.lit("S"), key)).alias("product_no"), F.col("p_name").alias("product_name"), F.when(key % 4 == 1, "").otherwise(F.col("p_type")).alias("category"), F.lit("needs_review").alias("status"),
        F.when(key % 7 == 0, "Green").alias("color"), F.when(key % 5 == 4, "no json").when(key % 5 < 4, raw).alias("raw_text"), F.when(key % 11 == 0, F.lit('[{"sprinklerTemp": "68", "coverPlateTemp": "57"}, {"temperature": "79"}, {"cover_plate_temperature": "50"}, {}]')).alias("temperature_ratings"))


@query("""SELECT p_partkey::VARCHAR AS id, CASE WHEN ok THEN (p_partkey % 5)::VARCHAR END AS source_row, CASE WHEN ok THEN 'K' || p_size END AS k_value_raw, CASE WHEN ok THEN 'r' || p_size END AS rti, CASE WHEN ok THEN 'up' END AS orientation, CASE WHEN ok THEN 'FM, ' || p_size END AS approvals,
  CASE WHEN p_partkey % 11 = 0 THEN 'own' WHEN ok THEN '[{"sprinklerTemp":"' || p_size || '°C"}]' END AS temperature_ratings, CASE WHEN p_partkey % 7 = 0 THEN 'Green' WHEN ok THEN 'Red, Blue' END AS color, 'JSON import' AS source_file FROM (SELECT *, p_partkey % 5 < 4 AS ok FROM part)""")
def p_review_rows(spark, d):
    """Queue rows with their fields from column, raw payload or the product made anew."""
    shown = catalog.expand_review(_products(spark, d))
    return shown.select("id", "source_row", "k_value_raw", "rti", "orientation", "approvals", F.when(F.col("temperature_ratings").startswith('[{"sprinklerTemp": "68"'), "own").otherwise(F.col("temperature_ratings")).alias("temperature_ratings"), "color", "source_file")


@query("""SELECT p_partkey::VARCHAR AS id, p_brand AS manufacturer, CASE WHEN p_partkey % 3 > 0 THEN 'S' || p_partkey ELSE '-' END AS product_no, p_name AS product_name, CASE WHEN p_partkey % 4 = 1 THEN '-' ELSE p_type END AS category, '-' AS sub_category, CASE WHEN ok THEN 'K' || p_size ELSE '-' END AS k_factor, '-' AS response_type, '-' AS orientation,
  CASE WHEN p_partkey % 11 = 0 THEN '68 (cover 57), 79, 50' ELSE '-' END AS temperature, CASE WHEN p_partkey % 7 = 0 THEN 'Green' ELSE '-' END AS color, CASE WHEN ok THEN 'FM, ' || p_size ELSE '-' END AS approvals, 'needs_review' AS status FROM (SELECT *, p_partkey % 5 < 4 AS ok FROM part)""")
def p_display_columns(spark, d):
    return catalog.display(_products(spark, d))


@query("""SELECT p_partkey::VARCHAR AS id FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 3 = 0 OR p_partkey % 7 = 0""")
def f_search_products(spark, d):
    """A search over all twelve columns of the product table."""
    return catalog.search_products(catalog.display(_products(spark, d)), " gREEN ").select("id")


@query("""SELECT p_partkey AS import_id, 'Unknown' AS manufacturer, 'S' || p_partkey AS product_no, p_name AS product_name, '-' AS k_value_raw, 'fast' AS response_type, CASE WHEN p_size % 2 = 0 THEN '68, 79' ELSE '-' END AS temperature_ratings, 'Red, Blue, White' AS color FROM part""")
def p_import_preview(spark, d):
    temps = F.when(F.col("p_size") % 2 == 0, '[{"sprinklerTemp": "68"}, {"sprinklerTemp": 70}, {"sprinklerTemp": "79"}, 4]').otherwise("[]")
    shown = F.concat(F.lit('{"sin": "S'), "p_partkey", F.lit('", "name": "'), "p_name", F.lit('", "responseType": "fast", "color": {"colour": ["Red", ["Blue,White"]]}, "temperature_ratings": '), temps, F.lit("}"))
    return catalog.preview(products.normalize(table(spark, d, "part").select(F.col("p_partkey").alias("import_id"), shown.alias("json")))[0]).drop("source_row")


@query("""SELECT p_partkey, array_to_string(list_transform(range(1, p_size % 12 + 2), lambda i: 'C' || i), ', ') || ', cULus' AS color, 'UL, cULus, FM' AS approvals FROM part""")
def n_colors_approvals(spark, d):
    """Colours nested up to a dozen deep, in arrays and objects; approvals of all shapes, each once."""
    depth = F.col("p_size") % 12 + 1
    nested = F.aggregate(F.reverse(F.sequence(F.lit(1), depth)), F.lit(""), lambda inner, i: F.concat(F.when(i % 3 == 0, '{"name": ').otherwise("["), F.when(i % 3 == 0, F.concat(F.lit('["C'), i, F.lit('"'))).otherwise(F.concat(F.lit('"C'), i, F.lit('"'))), F.when(inner == "", "").otherwise(F.concat(F.lit(", "), inner)), F.when(i % 3 == 0, "]}").otherwise("]")))
    shown = F.concat(F.lit('[{"approvals": [{"agency": "UL"}, "cULus", {"name": "FM"}, 3], "certifications": ["UL", {"x": 1}], "color": '), nested, F.lit(', "finish": "cULus, C1"}]'))
    made, _ = products.normalize(table(spark, d, "part").select(F.col("p_partkey").alias("import_id"), shown.alias("json")))
    return made.select(F.col("import_id").alias("p_partkey"), "color", F.array_join(F.array_sort(F.split("approvals", ", "), lambda a, b: F.when(F.array_position(F.array(*map(F.lit, ("UL", "cULus", "FM"))), a) < F.array_position(F.array(*map(F.lit, ("UL", "cULus", "FM"))), b), -1).otherwise(1)), ", ").alias("approvals"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'kept' WHEN c_custkey % 3 = 2 THEN '{"color":"Blue","rti":null}' ELSE '{"l":[1,2],"n":5,"o":{"b":1},"s":"5","color":"Blue","rti":null}' END AS raw_text, CASE WHEN c_acctbal > 0 THEN 'Blue' ELSE 'Red' END AS color FROM customer""")
def t_patch_payload(spark, d):
    """Edits of raw fields: other fields keep their types, text that is no object starts anew, and products out of review stay."""
    customer = table(spark, d, "customer")
    raw = F.when(F.col("c_acctbal") <= 0, "kept").when(F.col("c_custkey") % 3 == 0, '{"o": {"b": 1}, "n": 5, "l": [1, 2], "s": "5", "rti": "x", "color": 3}').when(F.col("c_custkey") % 3 == 1, '{"o": {"b": 1}, "n": 5, "l": [1, 2], "s": "5"}').otherwise("[1]")
    rows = customer.select(F.col("c_custkey").alias("id"), F.lit("Red").alias("color"), F.when(F.col("c_acctbal") > 0, "needs_review").otherwise("approved").alias("status"), raw.alias("raw_text"))
    edits = customer.select(F.col("c_custkey").alias("id"), F.lit(" Blue ").alias("color"), F.lit(" ").alias("rti"), F.lit(2).alias("ord")).unionByName(customer.select(F.col("c_custkey").alias("id"), F.lit("Green").alias("color"), F.lit("7").alias("rti"), F.lit(1).alias("ord")))
    changed, _ = catalog.patch(rows, edits, ["color"], order="ord")
    return changed.select(F.col("id").alias("c_custkey"), "raw_text", "color")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'A|B|c' WHEN 1 THEN 'x|y' WHEN 2 THEN '' ELSE '' END AS names FROM events""")
def n_approval_list(spark, d):
    """Approvals as a JSON array, as a comma list, as an array that isn't JSON, and none."""
    raw = F.when(F.col("event_id") % 4 == 0, '[" A", "B", "", "A ", "c"]').when(F.col("event_id") % 4 == 1, "x, ,y ,x").when(F.col("event_id") % 4 == 2, "[broken")
    return table(spark, d, "events").select("event_id", F.array_join(catalog.approval_list(raw), "|").alias("names"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 1000 AND o_orderkey % 5 <> 0""")
def f_active_documents(spark, d):
    from specloom.sources.tables import active_documents

    none = F.array().cast("array<int>")
    shown = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", "s").otherwise("").alias("upload_session_id"), F.when(F.col("o_totalprice") > 1000, "f").alias("file_name"), F.lit(1).alias("extraction_result"), F.when(F.col("o_orderkey") % 5 != 0, none).alias("material_list"), none.alias("product_matches"), none.alias("missing_products"))
    return active_documents(shown).select("o_orderkey")


@query("""SELECT o_orderkey, replace(format('{:,}', c // 100), ',', '_') || CASE WHEN c % 100 = 0 THEN '' WHEN c % 10 = 0 THEN '.' || (c % 100 // 10) ELSE '.' || lpad((c % 100)::VARCHAR, 2, '0') END AS shown FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS c FROM orders)""")
def x_norwegian_number(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.translate(numbers.norwegian(F.col("o_totalprice")), "\u00a0,", "_.").alias("shown"))


from specloom.plans import records  # noqa: E402, F401  (registers its queries here)

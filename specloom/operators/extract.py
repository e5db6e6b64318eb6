"""From pages of text to project, systems, standards, sections, line items, requirements and warnings.

Pages are (doc_id, page_ord, page_number, text and, if known, file_name). page_ord is the order in the document, which
page numbers need not follow. Each result is a flat DataFrame keyed by doc_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions import classify as c
from specloom.functions.text import UNCLEAN, B, S, clean, first, lines, slug, squeeze, trim
from specloom.operators.assemble import ROW, material_rows

REQUIREMENTS = (
    ("pressure", rf"(?i){B}\d{{1,3}}(?:[,.]\d+)?{S}*bar{B}", 92), ("property", rf"(?i){B}QR{B}", 92), ("property", rf"(?i){B}K{S}*={S}*(?:80|115){B}", 92),
    ("property", rf"(?i){B}\d{{2,3}}{S}*°{S}*C{B}", 92), ("dimension", rf"(?i){B}DN{S}?\d{{2,3}}{B}", 86),
)


def _as_it_is(place):
    return F.array(place)


def _from_each_digit(place):
    """What a place may be read as when fewer of its leading digits count: 15 bar holds 5 bar."""
    starts = F.filter(F.sequence(F.lit(1), F.length(place)), lambda i: F.substring(place, i, F.lit(1)).between("0", "9"))
    return F.transform(starts, lambda i: F.substring(place, i, F.length(place)))


def _to_two_digits(place):
    """DN125 holds DN12."""
    return F.array(place, F.regexp_replace(place, r"(\d\d)\d$", "$1"))


REQUIREMENT_FORMS = (_from_each_digit, _as_it_is, _as_it_is, _from_each_digit, _to_two_digits)
#: Where a match of each may start, and what stands in lower case in every line that holds one's text.
REQUIREMENT_SIGNS = (("0-9", ("bar",)), ("Q", ("qr",)), ("K", ("80", "115")), ("0-9", ("°",)), ("D", ("dn",)))
STANDARD_SIGNS = ("NFUV", ("nfpa", "12845", "fm", "ul", "vds"))


def _from_start(starts: str, pattern: str) -> str:
    """The same matches, tried only where one may start; patterns start and end with word characters."""
    body, word = pattern.removeprefix("(?i)"), "[A-Za-z0-9_]"
    body = f"(?<!{word}){body[len(B) : -len(B)]}(?!{word})" if body.startswith(B) else f"(?:{body})"
    return f"(?i)(?=[{starts}]){body}"


STANDARD_HIT = _from_start(STANDARD_SIGNS[0], f"(?i){B}({c.STANDARD}){B}")


def normalize_pages(pages: DataFrame) -> DataFrame:
    number = F.when(F.coalesce("page_number", F.lit(0)) == 0, F.col("page_ord") + 1).otherwise(F.col("page_number"))
    return pages.withColumns({"page_number": number, "text": clean(F.coalesce("text", F.lit("")))})


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_ord, page_number, line_idx, line of normalized pages."""
    return pages.select("doc_id", "page_ord", "page_number", F.posexplode(lines(F.col("text"))).alias("line_idx", "line"))


def _keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def systems(pages: DataFrame) -> DataFrame:
    """The first page of each system that a document mentions."""
    own = lines(F.col("text"))

    def mention(i, key, name, pattern):
        pattern = f"(?iu){pattern}"
        source = F.coalesce(first(F.filter(own, lambda x: x.rlike(pattern))), F.lit(name))
        return F.when(F.col("text").rlike(pattern), F.struct(F.lit(i).alias("ord"), F.lit(key).alias("normalized_name"), F.lit(name).alias("name"), source.alias("source_text")))

    found = pages.select("doc_id", "page_ord", "page_number", F.inline(F.array_compact(F.array(*(mention(i, *system) for i, system in enumerate(c.SYSTEMS))))))
    flat = found.select("doc_id", "page_ord", F.concat(F.lit("system-"), "normalized_name").alias("id"), "name", "normalized_name", F.col("page_number").alias("source_page"), "source_text", F.lit(91).alias("confidence"), "ord")
    return _keep_first(flat, ["doc_id", "normalized_name"], ["page_ord"])


def _page_hits(pages: DataFrame, rules) -> DataFrame:
    """doc_id, page_ord, page_number, kind, pos, value, source_text: the first hit of each key on each page, for rules of
    (pattern, group, value of a hit, key of a value, loose pattern, forms, what stands in each line that the loose one finds).

    source_text is the first line that holds the hit's text, even within a longer word; a hit that no line holds has its
    value there. A page is read once: the loose pattern finds all places of a line where a hit's text may stand, forms the
    texts that stand there, and hits and places of one text meet in one aggregation. So a page costs its lines and hits once.
    """
    page, none = ["doc_id", "page_ord", "page_number"], F.lit(None)
    hit_type, at_type = "struct<pos: int, value: string, key: string>", "struct<line_idx: int, line: string>"
    entry = lambda i, form, hit, at: F.struct(F.lit(i).alias("kind"), form.alias("form"), hit.cast(hit_type).alias("hit"), at.cast(at_type).alias("at"))

    def hits(i, pattern, group, value, key, *_):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), group), lambda h, pos: entry(i, F.lower(h), F.struct(pos.alias("pos"), value(h).alias("value"), key(value(h)).alias("key")), none))

    def places(line, at):
        def of_rule(i, loose, forms, signs):
            low = F.lower(line)
            texts = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(loose), 0), forms))
            found = F.transform(texts, lambda form: entry(i, form, none, F.struct(at.alias("line_idx"), line.alias("line"))))
            return F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(sign)) for sign in signs)), found).otherwise(F.array())

        each = [of_rule(i, *rule[4:]) for i, rule in enumerate(rules)]
        return F.concat(*each)

    # Pages are dealt over all cores, as a file of 128 MB of packed text would be one task's work.
    found = pages.repartition(*page).select(*page, F.inline(F.concat(*(hits(i, *rule) for i, rule in enumerate(rules)), F.flatten(F.transform(lines(F.col("text")), places)))))
    met = found.groupBy(*page, "kind", "form").agg(F.min("hit").alias("hit"), F.min("at").alias("at")).filter("hit is not null")
    first_ = met.groupBy(*page, "kind", "hit.key").agg(F.min(F.struct("hit.pos", "hit.value", F.coalesce("at.line", "hit.value").alias("source_text"))).alias("h"))
    return first_.select(*page, "kind", "h.*")


STANDARD_RULE = (STANDARD_HIT, 1, c.standard_code, lambda code: code, _from_start(STANDARD_SIGNS[0], f"(?i){c.STANDARD}"), _as_it_is, STANDARD_SIGNS[1])


def standards(pages: DataFrame) -> DataFrame:
    """The first mention of each standard, by normalized code."""
    hits = _page_hits(pages, [STANDARD_RULE])
    flat = hits.select("doc_id", "page_ord", "pos", F.concat(F.lit("standard-"), slug(F.col("value"))).alias("id"), F.col("value").alias("code"), F.col("page_number").alias("source_page"), "source_text", F.lit(96).alias("confidence"))
    return _keep_first(flat, ["doc_id", "code"], ["page_ord", "pos"])


def sections(pages: DataFrame) -> DataFrame:
    """Headings, and lines that name a system, once for each page number and title."""
    titled = page_lines(pages).withColumns({"heading": c.section_title(F.col("line")), "system": c.system_name(F.col("line"))})
    open_ = titled.withColumn("title", F.coalesce("heading", "system")).filter(F.col("title").isNotNull() & (F.col("title") != "") & ~c.has_trailing_quantity(F.col("line")))
    kept = _keep_first(open_, ["doc_id", "page_number", F.lower("title")], ["page_ord", "line_idx"])
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_ord", "line_idx"))
    return kept.select("doc_id", F.concat(F.lit("section-"), number).alias("id"), "title", F.col("page_number").alias("source_page"), F.col("line").alias("source_text"), F.when(F.col("heading").isNotNull(), 78).otherwise(72).alias("confidence"))


def _page_entries(pages: DataFrame) -> DataFrame:
    """doc_id, page_ord, page_number, page_system, a10, code, pos, row_ord, r: what a page states, from one reading of it.

    A row for each standard that the page names (code, place of its first mention), for each material row (row_ord, r), and
    one with neither where it names the default system.
    """
    empty = lambda c: F.lit(None).cast(c)
    entry = lambda code, pos, row_ord, r: F.struct(code.alias("code"), pos.cast("int").alias("pos"), row_ord.cast("int").alias("row_ord"), r.alias("r"))
    own = lines(F.col("text"))
    lined = pages.select("doc_id", "page_ord", "page_number", "text", own.alias("lines"))
    cleaned = F.when(F.col("text").rlike(UNCLEAN), F.transform("lines", clean)).otherwise(F.col("lines"))
    codes = F.transform(F.regexp_extract_all("text", F.lit(STANDARD_HIT), 1), c.standard_code)
    read = lined.select(
        "doc_id", "page_ord", "page_number", F.try_element_at(F.filter(F.transform("lines", c.system_name), lambda x: x.isNotNull()), F.lit(-1)).alias("page_system"),
        F.col("text").rlike(f"(?iu){dict((k, p) for k, _, p in c.SYSTEMS)['sprinkler-a10']}").alias("a10"), codes.alias("codes"), material_rows(F.col("text"), F.transform(cleaned, c.title_of_clean)).alias("rows"),
    )
    named = F.transform(F.array_distinct("codes"), lambda x: entry(x, F.array_position("codes", x), empty("int"), empty(ROW)))
    items = F.filter(F.transform("rows", lambda r, i: entry(empty("string"), empty("int"), i, r)), lambda e: F.length(e.r.description) >= 3)
    default = F.when(F.col("a10"), F.array(entry(empty("string"), empty("int"), empty("int"), empty(ROW)))).otherwise(F.array())
    return read.select("doc_id", "page_ord", "page_number", "page_system", "a10", F.inline(F.concat(named, items, default)))


def line_items(pages: DataFrame) -> DataFrame:
    """Material lines, classified and scored, once for each page number, post, description, unit and quantity.

    Pages are read once and what they state is dealt by doc_id once; the document's standards and default system then come
    of windows over it, the nearest title with the row. A document's standards are a few codes, each at its first mention.
    """
    dealt = _page_entries(pages).repartition("doc_id")
    by_code = Window.partitionBy("doc_id", "code").orderBy("page_ord", "pos")
    marked = dealt.withColumn("is_first", F.col("code").isNotNull() & (F.row_number().over(by_code) == 1))
    document = Window.partitionBy("doc_id")
    mention = F.when(F.col("is_first"), F.struct("page_ord", "pos", "code", F.col("page_number").alias("source_page")))
    known = marked.select("*", F.array_sort(F.collect_list(mention).over(document)).alias("standards"), F.when(F.max("a10").over(document), c.DEFAULT_SYSTEM).alias("default_system")).filter("r is not null")
    kind, sizes = c.category(F.col("r.description")), c.dimensions(F.col("r.description"))
    made = known.select("doc_id", "page_ord", "page_number", "row_ord", "standards", "default_system", "r.*", kind.alias("category"), sizes.alias("dimensions"), F.coalesce(c.system_name(F.col("r.description")), "page_system").alias("line_system"))
    kept = _keep_first(made, ["doc_id", "page_number", F.coalesce("post_number", F.lit("")), F.lower("description"), "unit", "quantity"], ["page_ord", "row_ord"])
    every = F.transform("standards", lambda s: s.code)
    own = F.transform(F.filter("standards", lambda s: s.source_page == F.col("page_number")), lambda s: s.code)
    full = kept.withColumns({"standard_refs": F.when(F.size(own) > 0, own).otherwise(every), "dimension": first(F.col("dimensions")), "material": c.material(F.col("description")), "specification_code": F.coalesce("code", c.specification_code(F.col("description"))), "system": F.coalesce("line_system", "default_system")})
    full = full.withColumn("section_title", F.coalesce("near_title", "line_system", "default_system"))
    full = full.withColumn("review_flags", c.review_flags(*map(F.col, ("category", "description", "dimension", "post_number", "quantity", "unit"))))
    full = full.withColumn("confidence", c.confidence(*map(F.col, ("category", "dimensions", "method", "post_number", "quantity", "unit", "review_flags", "standard_refs"))))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_ord", "row_ord"))
    return full.withColumn("item_ord", number).select(
        "doc_id", "item_ord", F.concat(F.lit("line-"), F.coalesce(F.nullif("post_number", F.lit("")), number.cast("string"))).alias("id"), "post_number", F.col("specification_code").alias("ns_code"), "specification_code", "section_title", "category", "description",
        "dimension", "dimensions", "material", "system", "standard_refs", "quantity", "quantity_text", "unit", F.col("page_number").alias("source_page"), "source_text", F.col("source_text").alias("source_text_block"), F.col("method").alias("extraction_method"), "review_flags", "confidence",
    )


def requirements(pages: DataFrame) -> DataFrame:
    """Standards, once for each code, and pressures, properties and dimensions, once for each type, value and page number.

    group is 0 for standards and 1 for the others. Pages are read once for both.
    """
    value = lambda hit: trim(F.regexp_replace(squeeze(hit), rf"(?i)DN{S}+", "DN"))
    own = [(_from_start(starts, pattern), 0, value, slug, _from_start(starts, pattern.replace(B, "")), forms, signs) for (_, pattern, _), forms, (starts, signs) in zip(REQUIREMENTS, REQUIREMENT_FORMS, REQUIREMENT_SIGNS, strict=True)]
    found = _page_hits(pages, [STANDARD_RULE, *own])
    rule = lambda i, standard: F.get(F.array(F.lit(standard), *(F.lit(r[i]) for r in REQUIREMENTS)), F.col("kind"))
    is_standard = F.col("kind") == 0
    id_ = F.concat_ws("-", F.lit("requirement"), rule(0, "standard"), slug(F.col("value")), F.when(~is_standard, F.col("page_number")))
    flat = found.select("doc_id", F.when(is_standard, 0).otherwise(1).alias("group"), "page_ord", F.greatest(F.col("kind") - 1, F.lit(0)).alias("kind"), "pos", id_.alias("id"), rule(0, "standard").alias("type"), "value", F.col("page_number").alias("source_page"), "source_text", rule(2, 96).alias("confidence"))
    return _keep_first(flat, ["doc_id", "group", F.when(F.col("group") == 0, F.col("value")).otherwise(F.col("id"))], ["page_ord", "kind", "pos"])


def warnings(pages: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """What a reviewer should know of each document, from counts."""
    items = items if items is not None else line_items(pages)
    text = pages.groupBy("doc_id").agg(F.max(F.length("text")).alias("longest"))
    n_standards = standards(pages).groupBy("doc_id").agg(F.count("*").alias("n_standards"))
    n_items = items.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.count_if(F.col("category") == "unknown").alias("n_unknown"), F.count_if(F.exists("review_flags", lambda f: f != "high-confidence")).alias("n_review"))
    counts = text.join(n_standards, "doc_id", "left").join(n_items, "doc_id", "left").na.fill(0)
    row = lambda when, key, code, message, severity: F.when(when, F.struct(F.lit(f"warning-{key}").alias("id"), F.lit(code).alias("code"), message.alias("message"), F.lit(severity).alias("severity")))
    made = F.array_compact(F.array(
        row(F.col("longest") == 0, "no-text", "NO_TEXT_EXTRACTED", F.lit("No readable text was extracted from the PDF."), "warning"),
        row(F.col("n_standards") == 0, "no-standards", "NO_STANDARDS_DETECTED", F.lit("No known sprinkler standards were detected."), "warning"),
        row(F.col("n_items") == 0, "no-line-items", "NO_LINE_ITEMS_DETECTED", F.lit("No material-like line items with quantities were detected."), "warning"),
        row(F.col("n_unknown") > 0, "unknown-line-items", "UNKNOWN_LINE_ITEMS_INCLUDED", F.concat("n_unknown", F.lit(" extracted line item(s) need human categorization.")), "info"),
        row(F.col("n_review") > 0, "review-line-items", "MATERIAL_LINES_NEED_REVIEW", F.concat("n_review", F.lit(" measurable material line(s) were extracted with review flags.")), "info"),
    ))
    return counts.select("doc_id", F.inline(made))


def project(pages: DataFrame) -> DataFrame:
    """Name, number, revision and discipline of each document, from its file name, else its first page."""
    if "file_name" not in pages.columns:
        pages = pages.withColumn("file_name", F.lit(None).cast("string"))
    head = pages.groupBy("doc_id").agg(F.min_by(F.struct("file_name", "text", "page_number"), "page_ord").alias("p")).select("doc_id", "p.*")
    both = lambda pattern: F.coalesce(*(F.nullif(F.regexp_extract(x, pattern, 0), F.lit("")) for x in ("file_name", "text")))
    named = F.when(F.coalesce("file_name", F.lit("")) != "", trim(F.regexp_replace("file_name", r"(?i)\.pdf$", ""))).otherwise(first(F.filter(lines(F.col("text")), lambda x: F.length(x) < 90)))
    discipline = F.when(F.concat_ws("\n", F.coalesce("file_name", F.lit("")), "text").rlike("(?i)sprinkler|brann|fire"), "Sprinkler / fire suppression")
    made = head.select("doc_id", named.alias("name"), both(rf"{B}\d{{4}}{B}").alias("project_number"), discipline.alias("discipline"), both(rf"(?i){B}Rev{S}*\d+").alias("revision"), F.col("page_number").alias("source_page"))
    return made.withColumn("confidence", F.when(F.col("project_number").isNotNull() | F.col("revision").isNotNull(), 74).otherwise(46))


def summary(pages: DataFrame) -> DataFrame:
    """Numbers of pages, systems and standards of each document."""
    counted = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    return counted(pages, "n_pages").join(counted(systems(pages), "n_systems"), "doc_id", "left").join(counted(standards(pages), "n_standards"), "doc_id", "left").na.fill(0)

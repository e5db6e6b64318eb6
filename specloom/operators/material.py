"""Material lists, product matches and the category reports over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions.text import slug, trim

#: Fixed values, in report order.
CATEGORIES = ("Pipe", "Fitting", "Valve", "Sprinkler", "Equipment", "Support", "Fastener", "Accessory", "Other", "Unknown")
ITEM_CATEGORIES = {"pipe": "Pipe", "fitting": "Fitting", "valve": "Valve", "sprinkler": "Sprinkler", "sensor": "Equipment", "control": "Equipment", "test": "Equipment", "hose": "Accessory", "marking": "Other"}
SIZED = ("Pipe", "Fitting", "Valve", "Sprinkler")
SUPPLIERS = ("Ahlsell equivalent", "Victaulic compatible")


def item_category(kind: Column) -> Column:
    return reduce(lambda rest, kv: F.when(kind == kv[0], kv[1]).otherwise(rest), ITEM_CATEGORIES.items(), F.lit("Unknown"))


def canonical(category: Column, other: Column | None = None) -> Column:
    """Report category of free text, by how it begins."""
    low = F.lower(trim(F.coalesce(category, other) if other is not None else category))
    out = F.lit("Unknown")
    for name in reversed(CATEGORIES[:-1]):
        fits = low.startswith(name.lower()) | ((low == "monitoring") if name == "Equipment" else F.lit(False))
        out = F.when(fits, name).otherwise(out)
    return out


def is_matched(*names: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(F.length(n) > 0, F.lit(False)) for n in names))


def material_lines(items: DataFrame) -> DataFrame:
    """Line items as numbered material lines, with the rule-made product match. line runs from 1 within a document."""
    kind = item_category(F.col("category"))
    sized = F.coalesce("dimension", F.get("dimensions", F.lit(0)))
    matched = ~kind.isin("Unknown", "Other") & (F.col("confidence") >= 88) & (~kind.isin(*SIZED) | (F.coalesce(sized, F.lit("")) != ""))
    name = F.concat(kind, F.lit(" database match"), F.coalesce(F.concat(F.lit(" "), F.nullif(sized, F.lit(""))), F.lit("")))
    empty = lambda c: F.nullif(c, F.lit(""))
    refs = F.when(F.size("standard_refs") > 0, F.concat(F.lit("Standards: "), F.array_join("standard_refs", ", ")))
    notes = F.concat_ws(". ", empty(F.col("section_title")), refs, F.when(F.coalesce("quantity", F.lit(0.0)) == 0, "Quantity needs review"), F.when(matched, "Database match found").otherwise("Missing from database"))
    post = empty(F.col("post_number"))
    href = F.concat(F.lit("/projects/demo/upload?"), F.concat_ws("&", F.concat(F.lit("postnr="), F.url_encode(post)), F.concat(F.lit("page="), "source_page")))
    return items.select(
        "doc_id", F.col("id").alias("item_id"), F.row_number().over(Window.partitionBy("doc_id").orderBy("item_ord")).alias("line"), kind.alias("category"), kind.alias("product_category"), F.col("description").alias("requirement"), F.when(matched, name).otherwise("Missing database product").alias("selected_product"),
        F.when(matched, "Ahlsell").otherwise("Unassigned").alias("supplier"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"), F.coalesce("unit", F.lit("item")).alias("unit"), F.round("confidence").cast("int").alias("confidence"), notes.alias("notes"), "post_number", "source_page", href.alias("document_href"),
        F.concat(F.lit("Page "), "source_page", F.coalesce(F.concat(F.lit(", post "), post), F.lit(""))).alias("source_reference"), F.coalesce("source_text_block", "source_text").alias("source_text"), sized.alias("dimension"), F.when(matched, name).alias("matched_product"),
        F.when(matched, F.concat(F.lit("db-"), slug(kind), F.lit("-"), slug(F.coalesce(sized, "description")))).alias("product_id"), (~matched).alias("missing_from_database"),
    )


def product_matches(materials: DataFrame) -> DataFrame:
    """The matched material lines as product resolutions."""
    return matched_lines(materials).select(*_resolution())


def with_matches(materials: DataFrame) -> DataFrame:
    """materials with the product resolution of each line as the struct match, null where there is none: what a join with
    product_matches by document and line would give, without reading the lines twice."""
    return materials.withColumn("match", F.when(is_matched(F.col("product_id"), F.col("matched_product")), F.struct(*_resolution())))


def _resolution() -> list:
    size = F.coalesce(F.concat(F.lit(" "), F.nullif("dimension", F.lit(""))), F.lit(""))
    return [
        "doc_id", F.concat(F.lit("match-"), "line").alias("id"), "category", "requirement", F.coalesce("source_text", "requirement").alias("extracted"), "post_number", "source_page", "document_href", "source_reference", "matched_product", "product_id",
        F.array(*(F.concat(F.lit(s), size) for s in SUPPLIERS)).alias("compatible_products"), F.lit("Matched against the active uploaded document using category, dimension and confidence.").alias("compliance"), "confidence",
        F.coalesce("matched_product", "selected_product").alias("selected_product"), F.when(F.col("confidence") >= 92, "Verified").otherwise("Needs review").alias("status"),
    ]


def matched_lines(materials: DataFrame) -> DataFrame:
    return materials.filter(is_matched(F.col("product_id"), F.col("matched_product")))


def missing_lines(materials: DataFrame) -> DataFrame:
    return materials.filter(~is_matched(F.col("product_id"), F.col("matched_product")))


def category_breakdown(materials: DataFrame, matches: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """material_items, matched and missing of each category that has any; ord is the report order.

    One aggregation, even if matches come from a table of their own.
    """
    missing = ~is_matched(F.col("product_id"), F.col("matched_product"))
    rows = materials.select(*keys, canonical(F.col("category")).alias("category"), F.lit(1).alias("m"), F.lit(0).alias("d") if matches is not None else (~missing).cast("int").alias("d"), missing.cast("int").alias("x"))
    if matches is not None:
        rows = rows.unionByName(matches.select(*keys, canonical(F.col("category")).alias("category"), F.lit(0).alias("m"), F.lit(1).alias("d"), F.lit(0).alias("x")))
    made = rows.groupBy(*keys, "category").agg(F.sum("m").alias("material_items"), F.sum("d").alias("matched"), F.sum("x").alias("missing"))
    return made.withColumn("ord", F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")).cast("int"))


def average_confidence(df: DataFrame, column: str = "confidence") -> DataFrame:
    return df.agg(F.coalesce(F.round(F.avg(F.coalesce(F.col(column), F.lit(0)))), F.lit(0.0)).cast("long").alias("average_confidence"))


def detected_categories(df: DataFrame, order: str) -> DataFrame:
    """Categories with the place where each is first seen."""
    return df.groupBy(canonical(F.col("category")).alias("category")).agg(F.min(order).alias("first_seen"))


def group_by_category(df: DataFrame, *order: str) -> DataFrame:
    """Rows under their report category (group), categories in report order, rows by order within each. A category of any
    size is a run of sorted rows, not one value."""
    grouped = df.withColumn("group", canonical(F.col("category")))
    return grouped.orderBy(F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("group")), *order)


def balance(materials: DataFrame) -> DataFrame:
    """Whether matched and missing add up to all."""
    matched = is_matched(F.col("product_id"), F.col("matched_product"))
    return materials.agg(F.count("*").alias("total"), F.count_if(matched).alias("matched"), F.count_if(~matched).alias("missing")).withColumn("balanced", F.col("matched") + F.col("missing") == F.col("total"))


def search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows whose joined columns contain the query, trimmed and in lower case; an empty query keeps all."""
    wanted = query.strip().lower()
    return df.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(wanted))) if wanted else df

"""The product catalog: enrichment, review edits and approval as transforms from snapshot to snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions.numbers import js_text
from specloom.functions.text import blank_to_null, trim
from specloom.operators.material import search
from specloom.operators.products import normalize


#: Fields that an edit sets as columns, and those that live in the raw payload.
DIRECT_FIELDS = ("manufacturer", "product_no", "product_name", "category", "sub_category", "color", "review_notes")
RAW_FIELDS = ("k_value_raw", "rti", "datasheet_url", "response_type", "orientation", "approvals")


def _last_each(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Of several rows of a key the last by order, then by the columns' own values, so that no run decides otherwise."""
    value = F.struct(*columns)
    return df.groupBy(key).agg(F.max(F.struct(F.col(order).alias("_order"), value.alias("_row"))).alias("_last")).select(key, "_last._row.*")


def overlay(left: DataFrame, details: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """left with the columns of details that it lacks. Columns of left win even where null; of several details the last by
    the column order counts, which details must have."""
    extra = [c for c in details.columns if c not in left.columns and c != order]
    return left.join(_last_each(details, key, order, extra), key, "left")


def with_approvals(products: DataFrame, links: DataFrame, approvals: DataFrame) -> DataFrame:
    """products with the sorted names of their approvals, an empty list where there are none."""
    named = links.filter("approval_id <> '' and product_id <> ''").join(approvals.filter("id <> '' and name <> ''").select(F.col("id").alias("approval_id"), "name"), "approval_id")
    by_product = named.groupBy(F.col("product_id").alias("id")).agg(F.array_sort(F.collect_list("name")).alias("approval_names"))
    return products.join(by_product, "id", "left").withColumn("approval_names", F.coalesce("approval_names", F.array().cast("array<string>")))


def rejection(exists: Column = None) -> Column:
    """Why a product can't be approved, or null."""
    blank = lambda c: F.coalesce(trim(F.col(c)) == "", F.lit(True))
    return F.when(F.coalesce(F.col("status") != "needs_review", F.lit(True)), "not in review").when(blank("manufacturer"), "manufacturer is required").when(blank("product_no"), "product_no is required")


def approval_list(raw: Column) -> Column:
    """Names from a JSON array of text, else from a comma list; trimmed, without empty ones, each once."""
    parsed = F.from_json(raw, "array<string>")
    names = F.when(F.ltrim(raw).startswith("["), F.coalesce(parsed, F.array().cast("array<string>"))).otherwise(F.split(F.coalesce(raw, F.lit("")), ","))
    return F.array_distinct(F.filter(F.transform(names, trim), lambda x: x != ""))


def approve(products: DataFrame, approvals: DataFrame, links: DataFrame, wanted: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """New products, approvals and links, and (id, reason) of wanted ids that were refused.

    wanted holds id and approvals (raw text); an id that is asked for several times gets all that is asked. New names and pairs are added, known ones left alone; ids of new approvals
    and links derive from what they stand for, so a run that is repeated adds nothing.
    """
    asked = wanted.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("approvals")), ",").alias("_raw"))
    judged = asked.join(products, "id", "left").withColumn("reason", F.when(F.col("status").isNull(), "not found").otherwise(rejection()))
    refused = judged.filter("reason is not null").select("id", "reason")
    granted = judged.filter("reason is null").select("id", F.explode_outer(approval_list(F.col("_raw"))).alias("name"))
    names = granted.filter("name is not null").select("name").distinct()
    fresh = names.join(approvals.select("name"), "name", "left_anti").select(F.sha1(F.col("name").cast("binary")).alias("id"), "name")
    all_approvals = approvals.unionByName(fresh, allowMissingColumns=True)
    pairs = granted.filter("name is not null").join(all_approvals.select(F.col("id").alias("approval_id"), "name"), "name").select(F.col("id").alias("product_id"), "approval_id").distinct()
    new_links = pairs.join(links.select("product_id", "approval_id"), ["product_id", "approval_id"], "left_anti").withColumn("id", F.sha1(F.concat_ws(":", "product_id", "approval_id").cast("binary")))
    done = granted.select("id").distinct().withColumn("_done", F.lit(True))
    changed = products.join(done, "id", "left").withColumns({"status": F.when(F.col("_done"), "approved").otherwise(F.col("status")), "reviewed_at": F.when(F.col("_done"), at).otherwise(F.col("reviewed_at")), "updated_at": F.when(F.col("_done"), at).otherwise(F.col("updated_at"))}).drop("_done")
    return changed, all_approvals, links.unionByName(new_links, allowMissingColumns=True), refused


def raw_payload(raw_text: Column) -> Column:
    """The fields of a JSON object as VARIANT by name; none for other JSON, text that isn't JSON, or null."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(raw_text), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def patch(products: DataFrame, edits: DataFrame, columns: list[str], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """products in review with the edits that are given (not null), trimmed, blank ones to null but for manufacturer; and
    the ids of edits that hit no product in review.

    Of several edits of an id the last by order counts, else the largest by value. Raw fields, and the colour, are set in
    the JSON object in raw_text, whose other fields keep their types; one that isn't an object starts empty.
    """
    given = [c for c in edits.columns if c in (*columns, *RAW_FIELDS)]
    ordered = edits if order else edits.withColumn(order := "_at", F.lit(0))
    new = _last_each(ordered.select("id", F.col(order).alias("_order_"), *(F.col(c).alias(f"_{c}") for c in given)), "id", "_order_", [f"_{c}" for c in given])
    joined = products.join(new.withColumn("_edited", F.lit(True)), "id", "left")
    edited = F.coalesce(F.col("_edited"), F.lit(False)) & F.coalesce(F.col("status") == "needs_review", F.lit(False))
    value = {c: F.when(edited & F.col(f"_{c}").isNotNull(), trim(F.col(f"_{c}")) if c == "manufacturer" else blank_to_null(F.col(f"_{c}"))).otherwise(F.col(c)) for c in columns}
    if "raw_text" in products.columns:
        mirrored = [c for c in given if c in RAW_FIELDS or c == "color"]
        fields = F.map_filter(F.create_map(*(F.lit(x) if isinstance(x, str) else x for c in mirrored for x in (c, F.struct(F.col(f"_{c}").alias("v"))))), lambda k, e: e.v.isNotNull()) if mirrored else F.create_map().cast("map<string,struct<v:string>>")
        set_ = raw_payload(F.to_json(F.transform_values(fields, lambda k, e: blank_to_null(e.v))))
        kept = F.map_filter(raw_payload(F.col("raw_text")), lambda k, v: ~F.map_contains_key(fields, k))
        value["raw_text"] = F.when(edited, F.to_json(F.map_concat(kept, set_))).otherwise(F.col("raw_text"))
    missed = edits.select("id").distinct().join(products.filter("status = 'needs_review'").select("id"), "id", "left_anti")
    return joined.withColumns(value).select(*products.columns), missed


def variant_text(v: Column) -> Column:
    """Text of a VARIANT: strings as they are, arrays and objects as JSON; null for JSON null."""
    return F.when(F.schema_of_variant(v) == "VOID", None).when(F.schema_of_variant(v).startswith("ARRAY") | F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v)).otherwise(js_text(v))


def _joined(v: Column) -> Column:
    """Elements of a VARIANT array as a comma list; other values as text."""
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(variant_text(x), F.lit("null"))), ", ")).otherwise(variant_text(v))


def expand_review(products: DataFrame) -> DataFrame:
    """Rows of the review queue with what they show: the stored column, else the raw payload's field, else that of the
    product made anew of the payload's raw_json (its source, if it has one); the first that is not null.

    products: id, raw_text, source_document, and temperature_ratings (JSON text) and color, if stored.
    """
    stored = lambda c: F.col(c) if c in products.columns else F.lit(None).cast("string")
    opened = products.withColumn("_raw", raw_payload(F.col("raw_text")))
    json = F.try_element_at("_raw", F.lit("raw_json"))
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    inner = F.try_variant_get(json, "$.source", "variant")
    source = opened.filter(is_object(json)).select(F.col("id").alias("import_id"), F.to_json(F.when(is_object(inner), inner).otherwise(json)).alias("json"))
    place = F.transform(F.split("source_row", r"\."), lambda x: x.cast("int"))
    anew = normalize(source)[0].groupBy(F.col("import_id").alias("id")).agg(F.min_by(F.struct(*RAW_FIELDS, "color", F.to_json("temperature_ratings").alias("temperature_ratings")), place).alias("_new"))
    field = lambda c: F.try_element_at("_raw", F.lit(c))
    shown = {c: F.coalesce(variant_text(field(c)), F.col(f"_new.{c}")) for c in RAW_FIELDS[:-1]} | {
        "source_file": F.coalesce(stored("source_document"), F.lit("JSON import")), "source_row": variant_text(field("source_row")), "approvals": F.coalesce(_joined(field("approvals")), F.col("_new.approvals")),
        "temperature_ratings": F.coalesce(stored("temperature_ratings"), variant_text(field("temperature_ratings")), F.col("_new.temperature_ratings")), "color": F.coalesce(stored("color"), variant_text(field("color")), F.col("_new.color")),
    }
    return opened.join(anew, "id", "left").withColumns(shown).drop("_raw", "_new")


def review_queue(products: DataFrame, status: str = "needs_review") -> DataFrame:
    """Products in review, the oldest first, unknown times last."""
    return products.filter(F.col("status") == status).orderBy(F.col("created_at").asc_nulls_last(), "id")


def queue_rows(normalized: DataFrame, source_document: str) -> DataFrame:
    """Rows for the review queue: the stored columns, and all other fields that are set as JSON text."""
    stored = ["manufacturer", "product_no", "product_name", "category", "sub_category", "color"]
    rest = [c for c in ("source_row", "k_value_raw", "rti", "datasheet_url", "response_type", "orientation", "approvals", "raw_json") if c in normalized.columns]
    return normalized.select(*stored, F.lit(source_document).alias("source_document"), F.lit("needs_review").alias("status"), F.to_json(F.struct(*rest)).alias("raw_text"))


def display_text(c: Column) -> Column:
    """The text of a cell: - for null and empty text."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))


def temperature_display(ratings: Column) -> Column:
    """'t (cover c)', 't', 'c' or '-' of each rating of a VARIANT array, in a comma list; text as it is."""
    def one(r):
        read = lambda *keys: display_text(F.coalesce(*(variant_text(F.try_variant_get(r, f"$.{k}", "variant")) for k in keys)))
        own, cover = read("sprinklerTemp", "sprinkler_temperature", "temperature"), read("coverPlateTemp", "cover_plate_temperature")
        both = F.when(cover == "-", own).when(own == "-", cover).otherwise(F.concat(own, F.lit(" (cover "), cover, F.lit(")")))
        return F.when(F.coalesce(F.schema_of_variant(r).startswith("OBJECT"), F.lit(False)), both).otherwise(display_text(variant_text(r)))

    kind = F.schema_of_variant(ratings)
    listed = F.array_join(F.filter(F.transform(F.try_variant_get(ratings, "$", "array<variant>"), one), lambda x: x != "-"), ", ")
    return F.when(kind.startswith("ARRAY"), F.coalesce(F.nullif(listed, F.lit("")), F.lit("-"))).when(kind == "STRING", js_text(ratings)).otherwise("-")


#: The columns of the product table, in their order.
DISPLAY = ("manufacturer", "product_no", "product_name", "category", "sub_category", "k_factor", "response_type", "orientation", "temperature", "color", "approvals", "status")


def display(products: DataFrame) -> DataFrame:
    """id and the twelve columns of the product table as text, each with its own fallbacks; - for what is empty.

    Columns of products that are missing count as null; raw_text is the raw payload, temperature_ratings JSON text.
    """
    known = {c.lower() for c in products.columns}
    have = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n.lower() in known), F.lit(None).cast("string"))
    raw = lambda k: variant_text(F.try_element_at("_raw", F.lit(k)))
    opened = products.withColumn("_raw", raw_payload(have("raw_text")))
    factors = F.array_join(F.filter(F.array(have("k_factor_imperial"), have("k_factor_si")), lambda x: F.coalesce(x, F.lit("")) != ""), " / ")
    text = have("temperature_ratings")
    quoted = F.try_parse_json(F.get(F.split(F.to_json(F.array(text)), r"^\[|\]$"), 1))  # text that isn't JSON shows as it is
    ratings = F.when(text.isNotNull(), F.coalesce(F.try_parse_json(text), quoted)).otherwise(F.try_element_at("_raw", F.lit("temperature_ratings")))
    names = F.array_join("approval_names", ", ") if "approval_names" in known else F.lit(None).cast("string")
    raw_approvals = F.when(F.schema_of_variant(F.try_element_at("_raw", F.lit("approvals"))).startswith("ARRAY"), _joined(F.try_element_at("_raw", F.lit("approvals"))))
    cells = {
        "manufacturer": F.coalesce(have("manufacturer"), display_text(have("manufacturer_name"))), "product_no": display_text(have("product_no", "sin")), "product_name": display_text(have("product_name", "productName", "name")),
        "category": display_text(have("category")), "sub_category": display_text(have("sub_category")), "k_factor": display_text(F.coalesce(F.nullif(have("k_value_raw"), F.lit("")), F.nullif(raw("k_value_raw"), F.lit("")), factors)),
        "response_type": display_text(F.coalesce(have("response_type"), raw("response_type"))), "orientation": display_text(F.coalesce(have("orientation"), raw("orientation"))), "temperature": temperature_display(ratings),
        "color": display_text(F.coalesce(have("color"), raw("color"))), "approvals": display_text(F.coalesce(names, have("approvals"), raw_approvals)), "status": display_text(have("status")),
    }
    return opened.select("id", *(cells[c].alias(c) for c in DISPLAY))


def search_products(shown: DataFrame, query: str) -> DataFrame:
    """Rows of the product table in which any cell has the query, trimmed and in lower case."""
    return search(shown, query, list(DISPLAY))


#: The columns of the import preview.
PREVIEW = ("manufacturer", "product_no", "product_name", "k_value_raw", "response_type", "temperature_ratings", "color")


def preview(normalized: DataFrame) -> DataFrame:
    """import_id, source_row and the seven columns of the import preview; - for what is empty."""
    temps = F.array_join(F.filter(F.transform("temperature_ratings", lambda r: F.when(F.schema_of_variant(F.try_variant_get(r, "$.sprinklerTemp", "variant")) == "STRING", F.try_variant_get(r, "$.sprinklerTemp", "string"))), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")
    cell = lambda c: display_text(temps if c == "temperature_ratings" else F.col(c)).alias(c)
    return normalized.select("import_id", "source_row", *map(cell, PREVIEW))


def temperature_ratings(text: Column) -> Column:
    """Ratings typed one a line or between commas and semicolons."""
    return F.transform(F.filter(F.transform(F.split(text, "[\n,;]+"), trim), lambda x: x != ""), lambda x: F.struct(x.alias("sprinklerTemp")))


def import_summary(rows: DataFrame, error: Column, order: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """total, queued, failed, the first five errors and the status of an import; failed only if nothing was queued."""
    marked = rows.withColumn("_error", error)
    nth = F.row_number().over(Window.partitionBy(*keys, F.col("_error").isNull()).orderBy(*order, "_error")) if keys else None
    few = marked.filter("_error is not null")
    few = few.withColumn("_n", nth).filter("_n <= 5") if keys else few.orderBy(*order, "_error").limit(5)
    listed = few.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_error"))), lambda s: s["_error"]), "; ").alias("error_message"))
    counts = marked.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("_error").isNull()).alias("queued"), F.count_if(F.col("_error").isNotNull()).alias("failed"))
    joined = counts.join(listed, list(keys), "left") if keys else counts.join(F.broadcast(listed), F.lit(True), "left")  # one row each
    return joined.withColumn("status", F.when((F.col("failed") > 0) & (F.col("queued") == 0), "failed").otherwise("completed"))


def equals(df: DataFrame, **values) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, (F.col(k) == v for k, v in values.items()), F.lit(True)))


def keep_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")

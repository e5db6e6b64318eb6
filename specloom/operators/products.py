"""Product JSON of several shapes to one flat product row, on VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions.numbers import js_text, ten_times
from specloom.functions.text import blank_to_null, join_distinct, trim

# Names under which producers file a field, in order of preference.
MANUFACTURER = ("Leverant\u00f8r", "Leverantor", "Leverant\u00f6r", "Leverant\u00c3\u00b8r", "manufacturer")
SUB_CATEGORY = ("Utf\u00f8relse", "Utforelse", "Utf\u00f6relse", "Utf\u00c3\u00b8relse", "sub_category", "subCategory")
DATASHEET = ("Datablad", "datasheet_url", "datasheetUrl", "source_url")
COLORS = ("color", "colour", "colors", "colours", "bulbColor", "bulbColour", "frameColor", "frameColour", "finish", "finishColor", "coverPlateColor", "coverPlateColour")
SHARE = 4  # tasks for each core
APPROVAL_KEYS = {"ceMark": "CE", "fmApproved": "FM", "ulListed": "UL"}


def _at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f'$["{key}"]', "variant")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _array(v: Column) -> Column:
    """Elements of a VARIANT array; none for anything else."""
    return F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))


def _text(v: Column) -> Column:
    """Text as the origin prints it: arrays joined by commas, an object as [object Object]."""
    return F.when(_is(v, "ARRAY"), F.array_join(F.transform(_array(v), lambda x: F.coalesce(js_text(x), F.lit(""))), ",")).when(_is(v, "OBJECT"), "[object Object]").otherwise(js_text(v))


def _there(record: Column, keys) -> Column:
    """Values of those keys that the record has, so that what follows isn't worked out for names that it lacks."""
    return F.filter(F.array(*(_at(record, k) for k in keys)), lambda x: x.isNotNull())


def read_text(record: Column, keys) -> Column:
    return F.get(F.filter(F.transform(_there(record, keys), lambda x: blank_to_null(_text(x))), lambda x: x.isNotNull()), 0)


def _factor(v: Column) -> Column:
    """Value and unit; values in litres count ten times."""
    units = read_text(v, ("units", "unit"))
    packed = F.replace(F.lower(units), F.lit(" "), F.lit(""))
    raw = trim(_text(_at(v, "value")))
    value = F.when(F.coalesce(packed.contains("lpm") | packed.contains("l/min"), F.lit(False)), ten_times(raw)).otherwise(raw)
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat_ws(" ", value, units))


def k_factor(record: Column) -> Column:
    v = _at(record, "kFactor")
    several = F.nullif(F.array_join(F.filter(F.transform(F.filter(_array(v), lambda x: _is(x, "OBJECT")), _factor), lambda x: x.isNotNull()), " / "), F.lit(""))
    pair = F.nullif(F.concat_ws(" / ", read_text(v, ("imperial", "nominal")), read_text(v, ("si", "metric"))), F.lit(""))
    return F.when(_is(v, "ARRAY"), several).when(_is(v, "OBJECT"), F.coalesce(pair, _factor(v)))


def temperature_ratings(record: Column) -> Column:
    own, other = _at(record, "temperatureRatings"), _at(record, "temperature_ratings")
    found = F.filter(_array(F.when(own.isNotNull() & ~_is(own, "VOID"), own).otherwise(other)), lambda x: _is(x, "OBJECT"))
    return F.when(F.size(found) > 0, found)


def _color_values(v: Column) -> Column:
    """Colour names in a value: comma text, an object's name or colour, or arrays of these, however deeply nested.

    Each step opens what is left closed by one level, as often as brackets stand in the value.
    """
    def open_(x):
        named = F.coalesce(*(F.when(~_is(_at(x, k), "VOID"), _at(x, k)) for k in ("name", "color", "colour")))
        return F.when(_is(x, "ARRAY"), _array(x)).when(_is(x, "OBJECT"), F.array(named)).otherwise(F.array(x))

    levels = F.length(F.regexp_replace(F.coalesce(F.to_json(v), F.lit("")), r"[^\[{]", ""))
    values = F.aggregate(F.sequence(F.lit(0), levels), F.array(v), lambda held, _: F.flatten(F.transform(held, open_)))
    text = lambda x: F.filter(F.transform(F.split(x.try_cast("string"), ","), trim), lambda t: t != "")
    return F.flatten(F.transform(F.filter(values, lambda x: _is(x, "STRING")), text))


def colors(record: Column) -> Column:
    own = lambda r: F.flatten(F.transform(_there(r, COLORS), _color_values))
    rated = F.flatten(F.transform(F.coalesce(temperature_ratings(record), F.array().cast("array<variant>")), own))
    return join_distinct(F.concat(own(record), own(_at(record, "physicalCharacteristics")), rated))


def approvals(record: Column, source: Column) -> Column:
    """Names from approvals text, certifications, an approvals array, and an approvals object in the order of its text.

    source is the JSON text of record's approvals: VARIANT sorts keys, the text keeps them.
    """
    v, empty = _at(record, "approvals"), F.array().cast("array<string>")
    one = lambda x: F.when(_is(x, "OBJECT"), read_text(x, ("agency", "name"))).when(_is(x, "STRING"), blank_to_null(x.try_cast("string")))
    each = lambda a: F.filter(F.transform(_array(a), one), lambda x: x.isNotNull())
    text = F.when(_is(v, "STRING"), F.filter(F.transform(F.split(v.try_cast("string"), ","), trim), lambda x: x != "")).otherwise(empty)
    label = lambda k: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in APPROVAL_KEYS.items() for x in kv)), k), k)
    entries = F.map_entries(F.from_json(source, "map<string,string>"))
    keyed = F.flatten(F.transform(entries, lambda e: F.when(e.value == "true", F.array(label(e.key))).when(F.ltrim(e.value).startswith("["), each(F.try_parse_json(e.value))).otherwise(empty)))
    return join_distinct(F.concat(text, each(_at(record, "certifications")), each(v), F.when(_is(v, "OBJECT"), F.coalesce(keyed, empty)).otherwise(empty)))


def normalize(imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products and errors of imports (import_id, json text).

    A text is an envelope with products, an array, or one item; an item may wrap its data, and may list sprinklerModels,
    each a product. Rows are numbered i or i.j from 1. Text that isn't JSON gives one error with row 0.

    Imports are dealt over all cores first: their table is small beside the work on it, so it may be read by one task.
    """
    dealt = imports.select("import_id", "json").repartition(SHARE * imports.sparkSession.sparkContext.defaultParallelism)
    root = dealt.select("import_id", "json", F.try_parse_json("json").alias("v"))
    listed = _is(_at(F.col("v"), "products"), "ARRAY") & _is(F.col("v"), "OBJECT")
    items = F.when(listed, _array(_at(F.col("v"), "products"))).when(_is(F.col("v"), "ARRAY"), _array(F.col("v"))).otherwise(F.array("v"))
    # The items' own texts, cut once, as VARIANT doesn't keep the order of keys.
    texts = F.when(listed, F.from_json("json", "products array<string>")["products"]).when(_is(F.col("v"), "ARRAY"), F.from_json("json", "array<string>")).otherwise(F.array("json"))
    info = F.when(listed & _is(_at(F.col("v"), "documentInfo"), "OBJECT"), _at(F.col("v"), "documentInfo"))
    bad = root.filter("v is null").select("import_id", F.lit("0").alias("row"), F.lit("Invalid JSON. Import file must contain JSON.").alias("message"))
    each = root.filter("v is not null").select("import_id", info.alias("info"), F.posexplode(F.arrays_zip(items.alias("item"), texts.alias("text"))).alias("i", "s")).select("import_id", "info", "i", "s.item", "s.text")
    wrapped = _is(_at(F.col("item"), "data"), "OBJECT")
    own = F.when(wrapped, F.get_json_object("text", "$.data.approvals")).otherwise(F.get_json_object("text", "$.approvals"))
    opened = each.select("import_id", "info", "i", "item", _is(F.col("item"), "OBJECT").alias("is_object"), F.when(wrapped, _at(F.col("item"), "data")).otherwise(F.col("item")).alias("data"), own.alias("approvals_text"))
    wrong = opened.filter("not is_object").select("import_id", (F.col("i") + 1).cast("string").alias("row"), F.lit("Item is not a JSON object.").alias("message"))
    models = F.filter(F.transform(_array(_at(F.col("data"), "sprinklerModels")), lambda m, j: F.struct(m.alias("m"), j.alias("j"))), lambda s: F.lit(True))
    either = opened.filter("is_object").withColumn("models", models)
    rows = either.select("import_id", "info", "i", "item", "data", "approvals_text", F.explode_outer("models").alias("s")).withColumns({"model": F.col("s.m"), "has_model": F.col("s").isNotNull()})
    not_model = rows.filter(F.col("has_model") & ~_is(F.col("model"), "OBJECT")).select("import_id", F.concat_ws(".", F.col("i") + 1, F.col("s.j") + 1).alias("row"), F.lit("sprinklerModels item is not a JSON object.").alias("message"))
    good = rows.filter(~F.col("has_model") | _is(F.col("model"), "OBJECT"))
    d, m, own = F.col("data"), F.col("model"), F.col("has_model")
    pick = lambda with_model, single: F.when(own, with_model).otherwise(single)
    made = good.select(
        "import_id", pick(F.concat_ws(".", F.col("i") + 1, F.col("s.j") + 1), (F.col("i") + 1).cast("string")).alias("source_row"),
        F.coalesce(read_text(d, MANUFACTURER), read_text(F.col("info"), MANUFACTURER), F.lit("Unknown")).alias("manufacturer"),
        pick(read_text(m, ("sin", "SIN", "product_no")), read_text(d, ("SIN", "sin", "product_no", "productNo"))).alias("product_no"),
        pick(F.coalesce(read_text(m, ("name", "productName", "product_name")), read_text(d, ("productName", "productSeries", "productDescription"))), read_text(d, ("productName", "product_name", "productSeries", "productDescription", "name"))).alias("product_name"),
        read_text(d, ("Type", "category", "sprinklerType")).alias("category"),
        F.coalesce(pick(read_text(m, ("escutcheonType", "sub_category", "subCategory")), F.lit(None)), read_text(d, SUB_CATEGORY)).alias("sub_category"),
        F.coalesce(pick(F.lit(None), read_text(d, ("K-Verdi", "k_value_raw", "kValue"))), k_factor(d)).alias("k_value_raw"),
        F.coalesce(pick(read_text(m, ("RTI", "rti")), F.lit(None)), read_text(d, ("RTI", "rti"))).alias("rti"),
        F.coalesce(read_text(d, DATASHEET), pick(read_text(F.col("item"), ("source_url", "sourceUrl")), F.lit(None))).alias("datasheet_url"),
        pick(read_text(m, ("responseType", "sprinklerResponse")), read_text(d, ("responseType", "sprinklerResponse"))).alias("response_type"),
        pick(read_text(m, ("orientation",)), read_text(d, ("orientation",))).alias("orientation"),
        approvals(d, F.col("approvals_text")).alias("approvals"),
        F.coalesce(pick(temperature_ratings(m), F.lit(None)), temperature_ratings(d)).alias("temperature_ratings"),
        F.coalesce(pick(colors(m), F.lit(None)), colors(d)).alias("color"), F.col("item").alias("raw_json"),
    )
    return made, bad.unionByName(wrong).unionByName(not_model)


def backfill(products: DataFrame) -> DataFrame:
    """products with ratings and colour filled from raw_text: the first of the known paths that holds anything, a JSON
    null included; ratings that aren't an array are left out; text that isn't JSON changes nothing."""
    v = F.try_parse_json("raw_text")
    path = lambda *ks: F.try_variant_get(v, "$" + "".join(f'["{k}"]' for k in ks), "variant")
    ratings = F.coalesce(*(path(*p) for p in (("temperatureRatings",), ("temperature_ratings",), ("data", "temperatureRatings"), ("sprinklerModel", "temperatureRatings"))))
    color = F.coalesce(*(blank_to_null(path(*p).try_cast("string")) for p in (("color",), ("colour",), ("finish",), ("data", "color"), ("data", "finish"), ("sprinklerModel", "color"), ("sprinklerModel", "finish"))))
    return products.withColumns({"temperature_ratings": F.when(_is(ratings, "ARRAY"), F.to_json(ratings)).otherwise(F.col("temperature_ratings")), "color": F.coalesce(color, "color")})

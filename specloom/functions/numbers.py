"""Numbers, units and factors as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from specloom.functions.text import S

#: Unit spellings and the unit each stands for; others keep their lower-cased spelling.
UNITS = {"pcs": "stk", "pc": "stk", "ea": "stk", "each": "stk", "stykk": "stk", "rs": "RS", "set": "sett", "meter": "m", "metre": "m", "lm": "m", "m²": "m2", "m³": "m3", "liter": "l", "litre": "l", "pair": "par", "punkt": "pkt"}


def number(c: Column) -> Column:
    """A number with comma or point: the later of both is the decimal mark; points between groups of three fall away."""
    packed = F.regexp_replace(c, f"{S}", "")
    comma, point = F.length(packed) - F.locate(",", F.reverse(packed)), F.length(packed) - F.locate(".", F.reverse(packed))
    has = lambda mark: F.contains(packed, F.lit(mark))
    first_comma = F.regexp_replace(packed, "^([^,]*),", "$1.")
    plain = (
        F.when(has(",") & has("."), F.when(comma > point, F.regexp_replace(F.replace(packed, F.lit("."), F.lit("")), "^([^,]*),", "$1.")).otherwise(F.replace(packed, F.lit(","), F.lit(""))))
        .when(has(","), first_comma)
        .when(packed.rlike(r"^\d{1,3}(?:\.\d{3})+$"), F.replace(packed, F.lit("."), F.lit("")))
        .otherwise(packed)
    )
    return F.when(plain == "", F.lit(0.0)).when(plain.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), plain.try_cast("double"))


def unit(c: Column) -> Column:
    low = F.regexp_replace(F.lower(c), f"{S}+", "")
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(UNITS.items()))), low), low)


def plain_decimal(c: Column) -> Column:
    """A decimal as its shortest text: no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def ten_times(text: Column) -> Column:
    """Text of ten times a number, rounded to ten places; other text stays."""
    plain = F.regexp_replace(text, "^([^,]*),", "$1.")
    return F.when(plain.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), plain_decimal(F.round(plain.try_cast("double") * 10, 10).try_cast("decimal(38,10)"))).otherwise(text)


def js_text(c: Column) -> Column:
    """Text of a VARIANT scalar as its origin prints it: whole doubles without .0."""
    return F.regexp_replace(c.try_cast("string"), r"^(-?\d+)\.0$", "$1")


def norwegian(c: Column) -> Column:
    """A number as shown in Norwegian: no-break spaces between thousands, a comma, two decimals at most."""
    whole = F.translate(F.format_number(c, 2), ",.", "\u00a0,")
    return F.when(whole.endswith(",00"), F.left(whole, F.length(whole) - 3)).when(whole.endswith("0"), F.left(whole, F.length(whole) - 1)).otherwise(whole)

"""Quantities with units, and formulas over them, as Column expressions that refuse to mix dimensions.

A quantity is a struct of its value in base units (metre, kilogram, second), the exponents of these, and an error: the first
that arose, which every further result passes on with a null value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factor to base units, and exponents of metre, kilogram and second.
UNITS = {
    "mm": (0.001, 1, 0, 0), "cm": (0.01, 1, 0, 0), "m": (1.0, 1, 0, 0), "inch": (0.0254, 1, 0, 0), "mm2": (1e-6, 2, 0, 0), "m2": (1.0, 2, 0, 0), "litre": (0.001, 3, 0, 0),
    "m3": (1.0, 3, 0, 0), "s": (1.0, 0, 0, 1), "min": (60.0, 0, 0, 1), "m/s": (1.0, 1, 0, -1), "litre/min": (0.001 / 60, 3, 0, -1), "bar": (100000.0, -1, 1, -2), "kPa": (1000.0, -1, 1, -2), "Pa": (1.0, -1, 1, -2),
}


def _made(value: Column, l: Column, m: Column, t: Column, error: Column) -> Column:  # noqa: E741
    return F.struct(F.when(error.isNull(), value).alias("value"), l.cast("int").alias("l"), m.cast("int").alias("m"), t.cast("int").alias("t"), error.alias("error"))


def _unit(unit: Column, at: int) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for name, row in UNITS.items() for x in (name, row[at]))), unit)


def quantity(value: Column, unit: Column) -> Column:
    error = F.when(value.isNull(), "no value").when(_unit(unit, 0).isNull(), F.concat(F.lit("unknown unit "), F.coalesce(unit, F.lit("null"))))
    return _made(value.cast("double") * _unit(unit, 0), _unit(unit, 1), _unit(unit, 2), _unit(unit, 3), error)


def _with(body, *arguments: Column) -> Column:
    """body of the arguments, each computed once however often body names it; formulas nest without growing."""
    names = [f"q{i}" for i in range(len(arguments))]
    held = F.struct(*(q.alias(n) for q, n in zip(arguments, names, strict=True)))
    return F.get(F.transform(F.array(held), lambda s: body(*(s[n] for n in names))), 0)


def times(a: Column, b: Column) -> Column:
    return _with(lambda a, b: _made(a.value * b.value, a.l + b.l, a.m + b.m, a.t + b.t, F.coalesce(a.error, b.error)), a, b)


def over(a: Column, b: Column) -> Column:
    error = lambda a, b: F.coalesce(a.error, b.error, F.when(b.value == 0, "division by zero"))
    return _with(lambda a, b: _made(F.try_divide(a.value, b.value), a.l - b.l, a.m - b.m, a.t - b.t, error(a, b)), a, b)


def plus(a: Column, b: Column) -> Column:
    mixed = lambda a, b: (a.l != b.l) | (a.m != b.m) | (a.t != b.t)
    return _with(lambda a, b: _made(a.value + b.value, a.l, a.m, a.t, F.coalesce(a.error, b.error, F.when(mixed(a, b), "mixed dimensions"))), a, b)


def scaled(a: Column, factor: float) -> Column:
    return _with(lambda a: _made(a.value * F.lit(factor), a.l, a.m, a.t, a.error), a)


def told(a: Column, unit: Column) -> Column:
    """Struct of value in that unit and error."""
    def body(a):
        same = (a.l == _unit(unit, 1)) & (a.m == _unit(unit, 2)) & (a.t == _unit(unit, 3))
        unknown = F.when(_unit(unit, 0).isNull(), F.concat(F.lit("unknown unit "), F.coalesce(unit, F.lit("null"))))
        error = F.coalesce(a.error, unknown, F.when(~same, F.concat(F.lit("isn't measured in "), unit)))
        return F.struct(F.when(error.isNull(), a.value / _unit(unit, 0)).alias("value"), error.alias("error"))

    return _with(body, a)


def pipe_area(diameter: Column) -> Column:
    return scaled(times(diameter, diameter), math.pi / 4)


def pipe_volume(diameter: Column, length: Column) -> Column:
    return times(pipe_area(diameter), length)


def flow_velocity(flow: Column, diameter: Column) -> Column:
    return over(flow, pipe_area(diameter))

"""Text functions with the whitespace and word rules of the data's origin (ECMAScript), as Column expressions.

Java's \\s and trim miss Unicode spaces, its \\b is Unicode-aware and its (?i) is ASCII only; the constants below make up
for that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as space, for use inside a class.
SPACES = "\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
S = f"[{SPACES}]"
#: Word boundary over ASCII word characters.
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

#: Misread UTF-8 and what it stood for, in the order of replacement.
MISREAD = (
    ("\u00c3\u00b8", "\u00f8"), ("\u00c3\u0098", "\u00d8"), ("\u00c3\u00a5", "\u00e5"), ("\u00c3\u0085", "\u00c5"), ("\u00c3\u00a6", "\u00e6"), ("\u00c3\u0086", "\u00c6"),
    ("\u00c2\u00b0", "\u00b0"), ("\u00e2\u20ac\u201d", "-"), ("\u00e2\u20ac\u201c", "-"), ("\u00e2\u20ac\u2122", "'"), ("\u00e2\u20ac\u0153", '"'), ("\u00e2\u20ac\ufffd", '"'),
)


#: Found in every trimmed text that cleaning would change.
UNCLEAN = f"[{''.join(sorted({bad[0] for bad, _ in MISREAD}))}\u2013\u2014\r\t]|  "


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{S}+|{S}+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, f"{S}+", " ")


def clean(c: Column) -> Column:
    """Misread characters, dashes, line ends and runs of blanks put right; trimmed."""
    c = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), MISREAD, c)
    for pattern, to in (("[\u2013\u2014]", "-"), ("\r\n?", "\n"), ("[ \t]+", " ")):
        c = F.regexp_replace(c, pattern, to)
    return trim(c)


def lines(c: Column) -> Column:
    """Trimmed lines that aren't empty, in order."""
    ends = lambda x: F.left(x, F.lit(1)).rlike(S) | F.right(x, F.lit(1)).rlike(f"[{SPACES}\u0085]")
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.when(ends(x), trim(x)).otherwise(x)), lambda x: x != "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim(c), F.lit(""))


def first(a: Column) -> Column:
    return F.get(a, 0)


def join_distinct(a: Column) -> Column:
    """Distinct values in the order first seen, as a comma list; null if there are none."""
    return F.nullif(F.array_join(F.array_distinct(a), ", "), F.lit(""))

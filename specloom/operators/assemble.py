"""Material rows of a page: the one step whose outcome at a line depends on what parsed before it.

Wrapped rows are put together again: a line that doesn't parse alone waits, and later lines join it until the joined
text parses or a new row begins. That needs the parse of a concatenation at every line, so it runs as an Arrow UDF over
pages; all that follows is Column algebra.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from specloom.functions import classify
from specloom.functions.numbers import UNITS
from specloom.functions.text import MISREAD, SPACES, S

# The row grammar of the specifications, in the order in which its forms are tried.
_A = re.ASCII | re.IGNORECASE
_WORD = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_Q, _U, _D = classify.QUANTITY, classify.UNIT.lower(), classify.DELIMITER
_END = rf"(?=$|[{SPACES}|;:,\-]+)"
_TRAILING = [re.compile(rf"{_D}(?P<u>{_U})\.?{S}*(?P<q>{_Q}){S}*$", re.ASCII), re.compile(rf"{_D}(?P<q>{_Q}){S}*(?P<u>{_U})\.?{S}*$", re.ASCII)]
_LEADING = [re.compile(rf"^(?P<u>{_U})\.?{S}*(?P<q>{_Q}){S}+(?P<d>.+)$", re.ASCII), re.compile(rf"^(?P<q>{_Q}){S}*(?P<u>{_U})\.?{S}+(?P<d>.+)$", re.ASCII)]
_INSIDE = [re.compile(rf"(?P<lead>{_D})(?P<u>{_U})\.?{S}*(?P<q>{_Q}){_END}", re.ASCII), re.compile(rf"(?P<lead>{_D})(?P<q>{_Q}){S}*(?P<u>{_U})\.?{_END}", re.ASCII)]
_PRICE = re.compile(rf"^(?:nok|kr|eur|sek|sum|pris|enhetspris|bel(?:ø|o)p|amount|price|rate|total|[-{SPACES}.,\d])+$", _A)
_POST = re.compile(rf"^(\d{{2,4}}(?:\.\d+){{2,}})(?:{S}+|$)", re.ASCII)
_CODE = re.compile(rf"^([A-ZÆØÅa-zæøå]{{1,4}}\d[A-Za-z0-9]*(?:\.[A-Za-z0-9]+)*[A-Za-z0-9]?){S}+(?!(?i:bar){_WORD})", re.ASCII)
_NEW_ROW = re.compile(rf"^[A-Z]{{1,4}}\d{{1,4}}(?:\.\d+)?{S}+", _A)
_PAGE = re.compile(rf"^(?:side|page){S}+\d+", _A)
_TABLE = re.compile(rf"\t|{S}{{3,}}|\|")
_LABELS = [re.compile(rf"{_WORD}(?:enhet|unit){_WORD}{S}*[:=]{S}*", _A), re.compile(rf"{_WORD}(?:mengde|quantity|qty){_WORD}{S}*[:=]{S}*", _A)]
_STRIPS = [re.compile(p, _A) for p in (rf"^(?:post|pos\.?|nr\.?){S}*\d+(?:\.\d+)*{S}*", rf"^(?:beskrivelse|description){S}*[:.-]?{S}*", rf"^(?:{classify.STANDARD}){_WORD}{S}*", rf"{_WORD}(?:enhet|unit|mengde|quantity|qty){_WORD}{S}*$")]
_MEASURE = re.compile(rf"^\d+(?:[,.]\d+)?{S}*(?:bar|kpa|mpa|pa|c|°c)$", _A)
_TOTAL = re.compile(rf"^(?:sum|subtotal|total|side|page|kapittel|chapter){_WORD}", _A)
_MATERIAL = re.compile("|".join([classify.MATERIAL_WORDS, *(re.sub(r"^\(\?iu?\)", "", p).replace("(?:Ø|OD)", "(?:Ø|ø|OD)") for p in classify.DIMENSIONS)]).lower(), re.ASCII)
# End of the fixed values.

_SPACE, _BLANKS = re.compile(S), re.compile(rf"{S}{{2,}}")
_DASHES, _BARS, _TABS = re.compile("[–—]"), re.compile(r"[|\t]+"), re.compile("[ \t]+")
_ODD = re.compile(rf"[–—|\t{''.join({bad[0] for bad, _ in MISREAD})}]|{S}{{2,}}")
_DIGIT = re.compile("[0-9]")
_CAPITALS = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

_FIELDS = {"source_text": pa.string(), "method": pa.string(), "description": pa.string(), "quantity_text": pa.string(), "quantity": pa.float64(), "unit": pa.string(), "post_number": pa.string(), "code": pa.string(), "near_title": pa.string()}
ROW = f"struct<{','.join(f'{name}:{kind}' for name, kind in _FIELDS.items())}>"


_SPACE_CHARS = "".join(c for c in map(chr, range(0x10000)) if _SPACE.match(c))


_EDGES = "-:," + _SPACE_CHARS


def _strip(text: str) -> str:
    return text.strip(_SPACE_CHARS)


def number(text: str) -> float | None:
    if text.isascii() and text.isdigit():
        return float(text)
    packed = _SPACE.sub("", text)
    if "," in packed and "." in packed:
        comma_last = packed.rfind(",") > packed.rfind(".")
        packed = packed.replace(".", "").replace(",", ".", 1) if comma_last else packed.replace(",", "")
    elif "," in packed:
        packed = packed.replace(",", ".", 1)
    elif re.fullmatch(r"\d{1,3}(?:\.\d{3})+", packed):
        packed = packed.replace(".", "")
    return float(packed) if re.fullmatch(r"\d+\.?\d*|\.\d+", packed) else None


def _unit(text: str) -> str:
    low = text.lower()
    return UNITS.get(low, low)


def _lower(text: str) -> str:
    """A-Z lower-cased and nothing else, place by place, so that patterns need not ignore case, which costs them most."""
    return text.lower() if text.isascii() else text.translate(_CAPITALS)


def _unclean(text: str) -> bool:
    """Whether there is anything to clean but a blank at the ends: most lines are told by a quick look."""
    if text.isascii() and text.isprintable():
        return "|" in text or "  " in text
    return bool(_ODD.search(text))


def _labelled(text: str) -> bool:
    low = text.lower()
    return "unit" in low or "enhet" in low or "qty" in low or "quantity" in low or "mengde" in low


def clean_line(text: str) -> str:
    if not _unclean(text) and not _labelled(text):
        return _strip(text)
    for bad, good in MISREAD:
        text = text.replace(bad, good)
    text = _DASHES.sub("-", text)
    text = _BLANKS.sub(" ", _BARS.sub(" ", _strip(_TABS.sub(" ", text))))
    for label in _LABELS:
        text = label.sub("", text)
    return _strip(text)


def _described(text: str) -> str:
    for strip in _STRIPS[:-1]:
        if m := strip.match(text):
            text = text[m.end() :]
    if _labelled(text):
        text = _STRIPS[-1].sub("", text)
    return (_BLANKS.sub(" ", text) if _unclean(text) else text).strip(_EDGES)


def _readings(text: str):
    """Description and match of each way to read a quantity, in order of preference; inner ones must look material."""
    low = _lower(text)
    for pattern in _TRAILING:
        if m := pattern.search(low):
            yield text[: m.start()].rstrip(_EDGES).lstrip(_SPACE_CHARS), m
    for pattern in _LEADING:
        if m := pattern.match(low):
            yield text[m.start("d") : m.end("d")].lstrip(_EDGES).rstrip(_SPACE_CHARS), m
    for pattern in _INSIDE:
        for m in pattern.finditer(low):
            before = text[: m.end("lead")].rstrip(_EDGES).lstrip(_SPACE_CHARS)
            after = text[m.end() :].lstrip(_EDGES).rstrip(_SPACE_CHARS)
            whole = before if _PRICE.search(after) else _strip(f"{before} {after}")
            if whole and _MATERIAL.search(whole.lower()):
                yield whole, m


def parse(line: str) -> dict | None:
    """The parts of a material line, or None if it isn't one."""
    if not _DIGIT.search(line):
        return None
    text, post, code = clean_line(line), None, None
    if m := _POST.match(text):
        post, text = m[1], _strip(text[m.end() :])
    if (m := _CODE.match(text)) and not m[1].upper().startswith("DN"):
        code, text = m[1], _strip(text[m.end() :])
    for found, m in _readings(text):
        if (quantity := number(m["q"])) is not None:
            break
    else:
        return None
    description = _described(found)
    wanted = description and quantity > 0 and not _MEASURE.match(description) and not _TOTAL.match(description)
    if not wanted or not (_MATERIAL.search(description.lower()) or post or code):
        return None
    return {"description": description, "quantity_text": m["q"], "quantity": quantity, "unit": _unit(m["u"]), "post_number": post, "code": code}


def _starts(line: str) -> bool:
    return bool(_POST.match(line) or _NEW_ROW.match(line))


def _continues(held: str, line: str) -> bool:
    if _starts(line) or _PAGE.match(line):
        return False
    return bool(_MATERIAL.search(held.lower()) or _MATERIAL.search(line.lower()) or any(p.search(_lower(line)) for p in (*_TRAILING, *_LEADING)))


def assemble(text: str | None) -> list[dict]:
    """Rows of a page's cleaned text, with the lines that each spans."""
    out: list[dict] = []
    held: list[tuple[int, str]] = []
    lines = [x for x in map(_strip, (text or "").split("\n")) if x]
    for i, line in enumerate(lines):
        if parts := parse(line):
            out.append(parts | {"text": line, "source_text": line, "method": "table-row" if _TABLE.search(line) else "single-line", "start_idx": i, "end_idx": i})
            held = []
            continue
        if held:
            joined = " ".join(x for _, x in held)
            if parts := parse(f"{joined} {line}"):
                out.append(parts | {"text": f"{joined} {line}", "source_text": "\n".join([x for _, x in held] + [line]), "method": "wrapped-line", "start_idx": held[0][0], "end_idx": i})
                held = []
                continue
            if _continues(joined, line):
                held.append((i, line))
                continue
            held = []
        if _starts(line) or _MATERIAL.search(line.lower()):
            held.append((i, line))
    return out


def titled(text: str | None, titles) -> list[dict]:
    """Rows of a page, each with the last title at or above its first line; titles has one entry, or None, for each line."""
    rows, near, at = assemble(text), None, 0
    for row in rows:
        while at <= row["start_idx"]:
            near, at = titles[at] or near, at + 1
        row["near_title"] = near
    return rows


def _rows(text: pa.Array, titles: pa.Array) -> pa.Array:
    """Built field by field: rows as Python objects would be looked through once more for their type."""
    pages = [titled(*pair) for pair in zip(text.to_pylist(), titles.to_pylist(), strict=True)]
    ends = [0, *accumulate(map(len, pages))]
    rows = pa.StructArray.from_arrays([pa.array([row[name] for page in pages for row in page], kind) for name, kind in _FIELDS.items()], list(_FIELDS))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def material_rows(text: Column, titles: Column) -> Column:
    """Rows of each cleaned page text, as an array of structs. Not deterministic by name, so that no filter on it is
    pushed below and runs it again."""
    return F.arrow_udf(_rows, f"array<{ROW}>").asNondeterministic()(text, titles)

"""What a material description is: category, dimensions, material, system, review flags and confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from specloom.functions.text import SPACES, B, S, clean, first, squeeze, trim

# The vocabulary of the specifications (Norwegian and English), in order of precedence.
QUANTITY = r"(?:\d{1,3}(?:[ .]\d{3})+(?:[,.]\d+)?|\d+(?:[,.]\d+)?)"
UNIT = "(?:m[23]|m[²³]|lm|meter|metre|stk|stykk|pcs|pc|ea|each|RS|sett|set|kg|l|liter|litre|par|pair|pkt|punkt|m)"
STANDARD = rf"NFPA{S}*13|NFPA{S}*14|NS-?{S}*EN{S}*12845|FM|UL|VdS"
SYSTEMS = (
    ("dry-riser", "Tørropplegg / fire department connection", rf"t(?:ø|o)rropplegg|dry{S}+riser|fire{S}+department{S}+connection|brannvesen"),
    ("sprinkler-a10", "Sprinkleranlegg A10", rf"sprinkleranlegg{S}*a10"),
    ("wet-sprinkler", "Våtanlegg", rf"v(?:å|a)tanlegg|wet{S}+sprinkler"),
    ("deluge", "Delugeanlegg", "delugeanlegg|deluge"),
)
DEFAULT_SYSTEM = "Sprinkleranlegg A10"
CATEGORIES = (
    ("control", rf"{B}i/?o{S}+enhet{B}|{B}input/output{B}|{B}interface{B}|modul|module|kontrollenhet"),
    ("sensor", rf"str(?:ø|o)mningsvakt|flow{S}*switch|pressostat|manometer|sensor|monitor"),
    ("hose", rf"fleksibelslange|flex(?:ible)?{S}*sprinkler{S}*hose"),
    ("sprinkler", rf"standard{S}+spray|sprinklerhode|sprinkler{S}*head|{B}sprinkler{B}|{B}qr{B}|{B}k{S}*=|dyse|nozzle"),
    ("valve", rf"kuleventil|stengeventil|tilbakeslagsventil|alarmventil|butterfly|{B}ventil{B}|{B}valve{B}"),
    ("fitting", "bend|t-r(?:ø|o)r|overgang|reduksjon|nippel|adapter|endebunn|plug|cap|flens|pakning|gasket|bolt|mutter|coupling|kupling|kobling|muffe|albue|fitting|klammer|oppheng|brakett|bracket|support|hanger"),
    ("pipe", rf"rillede{S}+r(?:ø|o)r|{B}riller(?:ø|o)r{B}|{B}r(?:ø|o)r{B}|{B}pipe{B}"),
    ("test", "test|pr(?:ø|o)ving|drenering"),
    ("marking", "merking|marking|skilt|label"),
)
MATERIAL_WORDS = (
    "r(?:ø|o)r|pipe|bend|t-r(?:ø|o)r|overgang|reduksjon|nippel|adapter|endebunn|plug|cap|flens|pakning|gasket|bolt|mutter|coupling|kupling|kobling|muffe|albue|fitting|ventil|valve|sprinkler"
    rf"|standard{S}+spray|dyse|nozzle|fleksibelslange|slange|hose|str(?:ø|o)mningsvakt|flow{S}*switch|i/?o|modul|module|enhet|sensor|pressostat|manometer|klammer|oppheng|brakett|bracket"
    "|support|hanger|isolering|insulation|plate|panel|skap|cabinet|deksel|cover|mansjett|sleeve|merking|skilt|label|test|drenering"
)
DIMENSIONS = (
    rf"(?i){B}DN{S}?\d{{2,4}}{B}", rf"(?i){B}K{S}*={S}*\d{{2,3}}{B}", rf"(?i){B}\d{{2,3}}{S}*°{S}*C{B}", rf"(?iu){B}(?:Ø|OD){S}*\d{{1,4}}(?:[,.]\d+)?{B}",
    rf"(?i){B}\d{{1,4}}(?:[,.]\d+)?{S}*x{S}*\d{{1,4}}(?:[,.]\d+)?(?:{S}*mm)?{B}", rf"(?i){B}\d{{1,4}}(?:[,.]\d+)?{S}*mm{B}",
)
MATERIALS = (("Powder coated", rf"(?i)pulverlakkert|powder{S}*coated"), ("Galvanized steel", "(?i)galvanisert|galvanized|varmforsinket"), ("Steel", "(?iu)st(?:å|a)l|steel"))
NEED_DIMENSION = ("pipe", "fitting", "valve", "hose")

DELIMITER = rf"(?:^|[{SPACES}|;:,\-]+)"
TRAILING = (rf"(?i){DELIMITER}({UNIT})\.?{S}*({QUANTITY}){S}*$", rf"(?i){DELIMITER}({QUANTITY}){S}*({UNIT})\.?{S}*$")


def ladder(rules, c: Column, otherwise=None) -> Column:
    """The name of the first of (name, pattern) found in c."""
    return reduce(lambda rest, rule: F.when(c.rlike(rule[1]), F.lit(rule[0])).otherwise(rest), reversed(rules), F.lit(otherwise))


def category(description: Column) -> Column:
    return ladder(CATEGORIES, F.lower(description), "unknown")


def material(description: Column) -> Column:
    return ladder(MATERIALS, description)


def system_name(text: Column) -> Column:
    return ladder([(name, f"(?iu){pattern}") for _, name, pattern in SYSTEMS], text)


def dimensions(description: Column) -> Column:
    """Normalized dimensions, by kind, then by place, each once."""
    low, none = F.lower(description), F.array().cast("array<string>")
    # A text without the mark that a form needs isn't searched for it.
    marks = (low.contains("dn"), low.contains("="), low.contains("°"), low.rlike("[øo]"), low.contains("x"), low.contains("mm"))
    found = F.when(description.isNotNull(), F.concat(*(F.when(mark, F.regexp_extract_all(description, F.lit(p), 0)).otherwise(none) for p, mark in zip(DIMENSIONS, marks, strict=True))))

    def tidy(x):
        for pattern, to in ((f"{S}+", ""), ("(?i)^dn", "DN"), ("(?i)^k=", "K="), ("(?i)^od", "OD")):
            x = F.regexp_replace(x, pattern, to)
        return F.replace(x, F.lit("°c"), F.lit("°C"))

    return F.array_distinct(F.transform(found, tidy))


def looks_material(description: Column) -> Column:
    return F.lower(description).rlike(MATERIAL_WORDS) | (F.size(dimensions(description)) > 0)


def standard_code(c: Column) -> Column:
    tidy = F.regexp_replace(F.regexp_replace(squeeze(c), rf"(?i)NS-?{S}*EN", "NS-EN "), rf"(?i)NFPA{S}*", "NFPA ")
    return F.replace(F.upper(trim(tidy)), F.lit("VDS"), F.lit("VdS"))


def specification_code(description: Column) -> Column:
    """The first token of letters then digits; none if that is a nominal width."""
    found = F.regexp_extract(description, rf"(?iu){B}([A-ZÆØÅ]{{1,4}}\d[A-Z0-9]*(?:\.[A-Z0-9]+)*[A-Z0-9]?){B}", 1)
    return F.when((found != "") & ~found.rlike("(?i)^DN"), found)


def has_trailing_quantity(line: Column) -> Column:
    return line.rlike(TRAILING[0]) | line.rlike(TRAILING[1])


def title_of_clean(own: Column) -> Column:
    """Title of a numbered heading, or a line in capitals; null for others and for lines that end in a quantity."""
    numbered = F.regexp_extract(own, rf"(?iu)^\d{{1,4}}(?:\.\d+){{1,}}{S}+([A-ZÆØÅ0-9][A-ZÆØÅ0-9{SPACES}/.,:&()–-]{{6,160}})$", 1)
    capitals = F.length(own).between(8, 160) & (own == F.upper(own)) & own.rlike("[A-ZÆØÅ]{3}")
    return F.when(~has_trailing_quantity(own), F.when(numbered != "", trim(numbered)).when(capitals, own))


def section_title(line: Column) -> Column:
    return F.get(F.transform(F.array(clean(line)), title_of_clean), 0)


def review_flags(kind: Column, description: Column, dimension: Column, post: Column, quantity: Column, unit: Column) -> Column:
    empty = lambda c: F.coalesce(c == "", F.lit(True))
    flags = F.array_compact(F.array(
        F.when(kind == "unknown", "unknown-category"),
        F.when((F.coalesce(quantity, F.lit(0.0)) == 0) | empty(unit), "missing-quantity-or-unit"),
        F.when(kind.isin(*NEED_DIMENSION) & dimension.isNull(), "missing-dimension"),
        F.when(empty(post) & ~looks_material(description), "weak-material-evidence"),
    ))
    return F.when(F.size(flags) > 0, flags).otherwise(F.array(F.lit("high-confidence")))


def confidence(kind: Column, sizes: Column, method: Column, post: Column, quantity: Column, unit: Column, flags: Column, standards: Column) -> Column:
    """52 and what speaks for and against, within 35 to 99."""
    has = lambda flag: F.array_contains(flags, flag)
    points = (
        (quantity.isNotNull() & (F.coalesce(unit, F.lit("")) != ""), 18), (F.size(sizes) > 0, 11), (F.size(sizes) > 1, 3), (kind != "unknown", 12), (F.size(standards) > 0, 5),
        (F.coalesce(post, F.lit("")) != "", 4), (method == "table-row", 2), (method == "wrapped-line", -3), (has("unknown-category"), -12), (has("missing-dimension"), -7), (has("weak-material-evidence"), -10),
    )
    total = reduce(lambda a, p: a + F.when(p[0], F.lit(p[1])).otherwise(F.lit(0)), points, F.lit(52))
    return F.greatest(F.lit(35), F.least(total, F.lit(99)))


def badge(score: Column, flags: Column, kind: Column, missing_dimension: Column, missing_data: Column) -> Column:
    review = (score < 88) | F.exists(flags, lambda f: f != "high-confidence") | (kind == "unknown") | missing_dimension
    return F.when(missing_data, "missing data").when(review, "needs review").otherwise("high confidence")


def bucket(score: Column) -> Column:
    return F.when(score >= 94, "high").when(score >= 90, "medium").otherwise("low")


"""Measurements and title-block fields in texts: ordered pattern sets with offsets and confidences, the first of equal facts kept."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import running

#: A place between a character of a word (letter, number, underscore) and another; metre and number endings; a number.
EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
METRES = r"\s*(?:m|metres?|meters?)"
SQUARE = r"\s*(?:m²|m2|sqm|sq\.?\s*m)"
PERCENT = rf"\s*(?:%|{EDGE}per\s*cent{EDGE})"
SIDES = r"(front|rear|side|secondary|primary|northern?|southern?|eastern?|western?)"


@dataclass(frozen=True)
class Pattern:
    """What stands before the value, the value, what stands behind it, words (with | between them) without all of which nothing can match,
    and whether it ends at the edge of a word. A `%s` in the key is the side, the first group of `before`."""

    key: str
    unit: str | None
    confidence: float
    before: str
    value: str
    behind: str = ""
    word: str = ""
    edge: bool = True

    @property
    def whole(self) -> str:
        return f"(?iU){self.before}(?:{self.value}){self.behind}{EDGE if self.edge else ''}"


# Pattern sets in the order in which they are tried, with units and confidences.
SETBACKS = [
    Pattern("proposed_setback_%s_m", "m", 0.80, SIDES + r"[\s\-]*setback[:\s]*", NUMBER, METRES, "setback"),
    Pattern("proposed_setback_%s_m", "m", 0.75, r"setback\s+to\s+" + SIDES + r"[^0-9]{0,40}?", NUMBER, METRES, "setback"),
    Pattern("proposed_setback_m", "m", 0.60, r"setback[^0-9]{0,60}?", NUMBER, METRES, "setback"),
]
AREAS = [
    Pattern("proposed_floor_area_sqm", "sqm", 0.82, r"(?:gross\s+)?floor\s+area[:\s]*", NUMBER, SQUARE, "area"),
    Pattern("site_area_m2", "sqm", 0.82, r"(?:lot|site|land)\s+area[:\s]*", NUMBER, SQUARE, "area"),
    Pattern("proposed_covered_area_m2", "sqm", 0.78, r"(?:building\s+)?footprint[:\s]*", NUMBER, SQUARE, "footprint"),
    Pattern("proposed_open_space_m2", "sqm", 0.75, r"open\s+space[:\s]*", NUMBER, SQUARE, "space"),
    Pattern("proposed_area_sqm", "sqm", 0.50, "", NUMBER, SQUARE, "m²|m2|sq"),
]
PERCENTAGES = [
    Pattern("proposed_site_cover_pct", "%", 0.82, r"site\s+coverage[:\s]*", NUMBER, PERCENT, "coverage", edge=False),
    Pattern("proposed_open_space_pct", "%", 0.78, r"open\s+space\s+(?:ratio|percentage)[:\s]*", NUMBER, PERCENT, "space", edge=False),
    Pattern("proposed_percentage", "%", 0.50, "", NUMBER, PERCENT, "%|cent", edge=False),
]
LINEAR = [
    Pattern("proposed_garage_width_m", "m", 0.78, r"garage\s+width[:\s]*", NUMBER, METRES, "garage"),
    Pattern("proposed_boundary_wall_length_m", "m", 0.76, r"boundary\s+wall(?:\s+length)?[:\s]*", NUMBER, METRES, "boundary"),
]
TITLE_BLOCK = [
    Pattern("drawing_number", None, 0.74, r"(?:drawing|sheet)\s*(?:no\.?|number|#)[:\s]*", r"[A-Z0-9][A-Z0-9._/-]{1,40}", "", "drawing|sheet"),
    Pattern("drawing_revision", None, 0.72, EDGE + r"(?:revision|rev\.?)[:\s]*", r"[A-Z0-9][A-Z0-9._/-]{0,20}", "", "rev"),
    Pattern("drawing_title", None, 0.70, r"(?:drawing|sheet)\s*title[:\s]*", r"[^\n\r]{3,120}", "", "title", edge=False),
    Pattern("drawing_scale", None, 0.68, EDGE + r"scale[:\s]*", r"(?:1\s*:\s*\d{1,5})|(?:NTS)|(?:as\s+shown)", "", "scale"),
]
#: Sides by their word without ends of n; others keep their word.
SIDE_NAMES = {
    "front": "front", "primary": "front", "rear": "rear", "side": "side", "secondary": "side", "north": "north", "northern": "north",
    "south": "south", "southern": "south", "east": "east", "eastern": "east", "west": "west", "western": "west",
}
PATTERNS = [*SETBACKS, *AREAS, *PERCENTAGES, *LINEAR, *TITLE_BLOCK]


def _side(match: Column, p: Pattern) -> Column:
    word = F.lower(F.regexp_extract(match, f"(?iU){p.before}", 1))
    names = F.create_map(*[F.lit(x) for pair in SIDE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.regexp_replace(word, "n+$", "")), word)


def _found(text: Column, low: Column, n: int, p: Pattern) -> Column:
    """Facts of one pattern in the order of their places. The text is scanned again for the places only where there is a match."""
    at = 1 + p.before.count("(") - p.before.count("(?")
    alone = f"(?iUs)^{p.before}({p.value}){p.behind}$"
    holds = reduce(or_, [F.contains(low, F.lit(w)) for w in p.word.split("|")])  # every text holds the empty word
    found = F.when(holds, F.regexp_extract_all(text, F.lit(p.whole), F.lit(0)))
    between = F.transform(F.split(text, p.whole), F.length)

    def fact(m: Column, i: Column, start: Column) -> Column:
        value = F.regexp_extract(m, alone, at)
        words = F.trim(F.regexp_replace(value, r"(?U)\s+", " "))
        key = F.concat(F.lit(p.key.split("%s")[0]), _side(m, p), F.lit(p.key.split("%s")[1])) if "%s" in p.key else F.lit(p.key)
        return F.struct(
            F.lit(n).alias("pattern"), i.alias("n"), key.alias("fact_key"), (value.cast("double") if p.unit else F.lit(None).cast("double")).alias("value"),
            (F.lit(None).cast("string") if p.unit else words).alias("text_value"), F.lit(p.unit).cast("string").alias("unit"), F.lit(p.confidence).alias("confidence"),
            m.alias("source_text"), start.cast("bigint").alias("start"), (start + F.length(m)).cast("bigint").alias("end"),
        )

    def placed(m: Column) -> Column:
        steps = F.transform(m["m"], lambda x, i: F.length(x) + F.get(m["b"], i))
        return F.get(F.transform(F.array(running(steps)), lambda r: F.transform(m["m"], lambda x, i: fact(x, i, F.get(r, i) + F.get(m["b"], i)))), F.lit(0))

    once = lambda m: F.when(F.size(m) > 0, F.get(F.transform(F.array(F.struct(m.alias("m"), between.alias("b"))), placed), F.lit(0))).otherwise(F.array())
    return F.get(F.transform(F.array(found), once), F.lit(0))


def measurements(docs: DataFrame, key: str = "doc_id", text: str = "text", patterns: list[Pattern] = PATTERNS) -> DataFrame:
    """STR-16: fact_key, value or text_value, unit, confidence, source_text, start and end (characters) of every text. Of facts with
    the same key and value (texts without regard to case) the first counts, by the order of patterns and then of places.

    The facts leave each text as an array; only they are shuffled, and combined before that."""
    body = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(F.translate("__t", "\u017f\u212a\u0131\u0130", "skii"))  # letters that equal s, k and i without regard to case
    rows = docs.select(key, body.alias("__t")).withColumn("__low", low)  # a column, so that it is made once
    facts = F.concat(*[_found(F.col("__t"), F.col("__low"), n, p) for n, p in enumerate(patterns)])
    rows = rows.select(key, F.explode(facts).alias("f"))
    rows = rows.where(F.col("f.unit").isNotNull() | (F.col("f.text_value") != ""))
    first = rows.groupBy(key, F.col("f.fact_key").alias("fact_key"), F.col("f.value").alias("value"), F.lower("f.text_value").alias("__same")).agg(F.min("f").alias("f"))
    return first.select(key, "fact_key", "value", *[F.col("f")[c].alias(c) for c in ("text_value", "unit", "confidence", "source_text", "start", "end")])

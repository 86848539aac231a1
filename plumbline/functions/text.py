"""Text expressions: normalising, tokens, numbers, keys, addresses and trigrams."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

# Street abbreviations and their expansions; words that end a street's name; aliases and dropped words of rule keys; spelled numbers; words
# left out of a retrieval query.
STREET = {
    "st": "street", "rd": "road", "ave": "avenue", "av": "avenue", "cres": "crescent", "ct": "court", "pl": "place", "dr": "drive", "drv": "drive",
    "hwy": "highway", "tce": "terrace", "pde": "parade", "bvd": "boulevard", "blvd": "boulevard", "cl": "close", "gr": "grove", "gdns": "gardens",
    "cct": "circuit", "esp": "esplanade", "prom": "promenade", "qy": "quay", "ln": "lane", "wy": "way", "ent": "entrance", "bwl": "bowl",
    "rtt": "retreat", "hts": "heights",
}
ALIKE = 0.86
STREET_TYPES = [
    "st", "street", "rd", "road", "ave", "av", "avenue", "ln", "lane", "way", "wy", "cres", "crescent", "ct", "court", "pl", "place", "dr", "drv",
    "drive", "hwy", "highway", "tce", "terrace", "pde", "parade", "bvd", "blvd", "boulevard", "cl", "close", "gr", "grove", "gdns", "gardens", "cct",
    "circuit", "esp", "esplanade", "prom", "promenade", "qy", "quay", "rise", "loop", "mews", "gate", "vista", "heights", "hts", "entrance", "ent",
    "retreat", "rtt", "square", "sq", "walk", "bend",
]
KEY_ALIASES = {
    "pct": "percent", "percentage": "percent", "metre": "m", "metres": "m", "meter": "m", "meters": "m", "maximum": "max", "minimum": "min",
    "setbacks": "setback", "requirements": "requirement",
}
KEY_DROPPED = ["rule", "rules", "req"]
STOP_WORDS = [
    "a", "about", "an", "and", "are", "as", "brief", "can", "does", "explain", "for", "give", "how", "i", "in", "is", "me", "my", "of", "one",
    "paragraph", "please", "short", "tell", "the", "to", "australia", "australian", "wa", "western", "what", "whats", "with",
]
LONG_FORMS = {"da": "development application", "r-codes": "residential design codes", "rcodes": "residential design codes"}
SPELLED = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}


def _map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def running(sizes: Column, block: int = 128) -> Column:
    """The sum of the elements before each, by sums of blocks, so that work does not grow with the square of the length."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0))), lambda i: i)
    blocks = F.filter(blocks, lambda i: i % block == 0)
    sums = F.transform(blocks, lambda i: total(F.slice(sizes, i + 1, F.lit(block))))
    before = lambda s, i: total(F.slice(s, F.lit(1), F.floor(i / block).cast("int"))) + total(F.slice(sizes, i - i % block + 1, i % block))
    return F.get(F.transform(F.array(sums), lambda s: F.transform(sizes, lambda x, i: before(s, i))), F.lit(0))


def normalise(text: Column) -> Column:
    """PRJ-01: lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def safe_quote(text: Column, limit: int = 240) -> Column:
    """PRJ-02: white space collapsed, cut after `limit` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, limit)


def tokens(text: Column) -> Column:
    """STR-02: runs of a-z and 0-9 in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def token_set(text: Column) -> Column:
    """STR-01: distinct tokens in order of first occurrence."""
    return F.array_distinct(tokens(text))


def numbers_in(text: Column) -> Column:
    """STR-17: decimal numbers in the text."""
    return F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))


def slug(text: Column, limit: int = 40) -> Column:
    """STR-12: anything but a-z and 0-9 as one underscore, at most `limit` characters."""
    return F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), 1, limit)


def rule_key(text: Column) -> Column:
    """STR-11: tokens under their aliases, without dropped words, long plurals made singular, consecutive repeats dropped."""
    words = F.transform(tokens(F.replace(text, F.lit("&"), F.lit(" and "))), lambda w: F.coalesce(F.try_element_at(_map(KEY_ALIASES), w), w))
    kept = F.filter(words, lambda w: ~w.isin(KEY_DROPPED))
    plural = lambda w: (F.length(w) > 4) & F.endswith(w, F.lit("s")) & ~w.rlike(r"^r\d+s?$")
    single = F.transform(kept, lambda w: F.when(plural(w), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.get(F.transform(F.array(single), lambda a: F.array_join(F.filter(a, lambda w, i: (i == 0) | (w != F.get(a, i - 1))), "_")), F.lit(0))


def address_form(address: Column) -> Column:
    """PRJ-01 of an address: commas are white space too."""
    return normalise(F.replace(address, F.lit(","), F.lit(" ")))


def expand_street(address: Column) -> Column:
    """STR-03: tokens after the first replaced by their long forms."""
    words = F.split(address_form(address), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.coalesce(F.try_element_at(_map(STREET), w), w))), " ")


def street_tokens(address: Column) -> Column:
    """STR-05: the words of the street's name: leading numbers dropped, up to the first street type, else the first; none if
    one word is left."""
    words = F.split(address_form(address), " ")
    number = lambda w: (w == "lot") | F.regexp_replace(w, "[/-]", "").rlike(r"^(?=.*[0-9])[\p{L}\p{N}]+$")
    first = F.array_min(F.filter(F.transform(words, lambda w, i: F.when(~number(w), i)), lambda i: i.isNotNull()))

    def name(rest: Column) -> Column:
        at = F.array_min(F.filter(F.transform(rest, lambda w, i: F.when(w.isin(STREET_TYPES), i)), lambda i: i.isNotNull()))
        return F.filter(F.slice(rest, F.lit(1), F.coalesce(at, F.lit(1))), lambda w: F.length(w) >= 2)

    rest = F.coalesce(F.slice(words, first + 1, F.size(words)), F.array().cast("array<string>"))
    return F.when(F.size(rest) > 1, F.get(F.transform(F.array(rest), name), F.lit(0))).otherwise(F.array().cast("array<string>"))


def close_token(asked: Column, has: Column) -> Column:
    """STR-06, its native tests: equal, or one begins with the other where the shorter is long enough."""
    return (asked == has) | ((F.length(asked) >= 3) & F.startswith(has, asked)) | ((F.length(asked) >= 4) & F.startswith(asked, has))


@F.pandas_udf(BooleanType())
def _alike(asked: pd.Series, has: pd.Series) -> pd.Series:
    near = lambda a, b: len(a) >= 5 and len(b) >= 5 and difflib.SequenceMatcher(None, a, b).ratio() >= ALIKE
    return pd.Series([any(near(a, b) for a in x for b in y) for x, y in zip(asked, has)], dtype="bool")


def alike_tokens(asked: Column, has: Column) -> Column:
    """STR-06, its matcher: whether a token of one array and one of the other, both of five characters or more, match in 0.86 of
    them, by matching blocks. Arrow batches; meant for rows that native tests have left."""
    return _alike(asked, has)


def house_number(address: Column) -> Column:
    """STR-04: digits of a leading token that is a number, perhaps after the word lot; else empty."""
    return F.regexp_extract(address_form(address), r"^(?:lot )?([0-9]+)(?: |$)", 1)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the text's words, each padded with two spaces before and one behind."""

    def of(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substr(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(tokens(text), of)))


def _jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    """STR-07: shared trigrams over all trigrams of both."""
    return _jaccard(trigrams(a), trigrams(b))


def _best_extent(asked: str, text: str) -> float:
    """Greatest share of common trigrams between the trigrams of `asked` and those of any run in the sequence of `text`."""
    of = lambda t: [f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", t.lower()) for i in range(len(w) + 1)]
    want, run = set(of(asked)), of(text)
    spots, best = [i for i, g in enumerate(run) if g in want], 0.0
    for n, start in enumerate(spots):
        seen, common, at = set(), 0, start
        for end in spots[n:]:  # a best run begins and ends with a common trigram
            common += run[end] not in seen
            seen.update(run[at : end + 1])
            at = end + 1
            best = max(best, common / (len(want) + len(seen) - common))
    return best


#: Texts of more trigrams are compared one by one; a block of pairs has about so many cells.
LONG_RUN, RUN_CELLS = 128, 1 << 18


def _best_extents(asked: pd.Series, text: pd.Series) -> np.ndarray:
    """`_best_extent` of many pairs at once: trigrams of the batch's distinct texts as numbers, all ends of a run in one pass over the block."""
    (qi, qs), (ti, ts) = pd.factorize(asked), pd.factorize(text)
    vocabulary: dict[str, int] = {}
    of = lambda t: [vocabulary.setdefault(f"  {w} "[i : i + 3], len(vocabulary)) for w in re.findall("[a-z0-9]+", t.lower()) for i in range(len(w) + 1)]
    wants, runs = [set(of(q)) for q in qs], [of(t) for t in ts]
    out, width = np.zeros(len(qi)), max([len(r) for r in runs if len(r) <= LONG_RUN], default=0)
    seq, last = np.full((len(runs), width), len(vocabulary)), np.full((len(runs), width), width)
    for k, run in enumerate(runs):
        if len(run) <= LONG_RUN:
            at: dict[int, int] = {}
            for p, g in enumerate(run):
                seq[k, p], last[k, p], at[g] = g, at.get(g, -1), p  # last: where the trigram stood before; behind the text's end none is new
    size, long = np.array([len(w) for w in wants] or [0]), np.array([len(r) > LONG_RUN for r in runs] or [False])
    for i in np.flatnonzero(long[ti]):
        out[i] = _best_extent(qs[qi[i]], ts[ti[i]])
    order = np.flatnonzero(~long[ti])
    order = order[np.argsort(qi[order], kind="stable")]
    step = max(1, RUN_CELLS // max(1, width))
    for begin in range(0, len(order) if width else 0, step):
        rows = order[begin : begin + step]
        q, t = qi[rows], ti[rows]
        own, back = np.unique(q, return_inverse=True)
        member = np.zeros((len(own), len(vocabulary) + 1), dtype=bool)
        for k, x in enumerate(own):
            member[k, list(wants[x])] = True
        hit, before, n = member[back[:, None], seq[t]], last[t], size[q][:, None]
        best = np.zeros(len(rows))
        for start in range(width):
            new = before[:, start:] < start
            common, seen = np.cumsum(new & hit[:, start:], axis=1, dtype="int32"), np.cumsum(new, axis=1, dtype="int32")
            np.maximum(best, (common / np.maximum(n + seen - common, 1)).max(axis=1), out=best)
        out[rows] = best
    return out


@F.pandas_udf(DoubleType())
def _extents(asked: pd.Series, text: pd.Series) -> pd.Series:
    known = (asked.notna() & text.notna()).to_numpy()
    out = pd.Series([None] * len(asked), dtype="float64")
    out[known] = _best_extents(asked[known], text[known])
    return out


def word_similarity(asked: Column, text: Column) -> Column:
    """STR-07: the greatest similarity of `asked` with a run of the ordered trigrams of `text`, so with parts of words too; 0
    where either has no word, null where one is null. Arrow batches; a run is looked for in one pass from each common trigram."""
    return _extents(asked, text)


def address_score(asked: Column, address: Column, floor: float = 0.45, boost: float = 0.05) -> Column:
    """STR-07, FLT-07: word similarity of the text or its expanded form, more where the house number stands in the address; null
    below the floor."""
    raw = F.greatest(word_similarity(address_form(asked), address), word_similarity(expand_street(asked), address))
    number = house_number(asked)
    same = (number != "") & F.array_contains(tokens(address), number)
    return F.when(raw >= floor, F.least(raw + F.when(same, boost).otherwise(0.0), F.lit(1.0)))


def density_code(raw: Column) -> Column:
    """STR-08: R-AC, RR or R<n> in capitals; null for anything else."""
    t = F.replace(F.regexp_replace(F.upper(raw), r"(?U)\s+", ""), F.lit("_"), F.lit("-"))
    ac, n = F.regexp_extract(t, r"^R-?AC-?(\d{0,2})$", 1), F.regexp_extract(t, r"^R(\d{1,3})$", 1)
    return F.when(t == "RR", "RR").when(t.rlike(r"^R-?AC-?\d{0,2}$"), F.concat(F.lit("R-AC"), ac)).when((n != "") & (n.try_cast("int") > 0), F.concat(F.lit("R"), n.try_cast("int").cast("string")))


def is_density_code(text: Column) -> Column:
    """STR-09."""
    return F.replace(F.trim(text), F.lit(" "), F.lit("")).rlike(r"(?i)^R{1,2}-?(AC)?\d+(\.\d+)?(/\d+(\.\d+)?)?$")


def council_name(text: Column) -> Column:
    """STR-10: City, Shire or Town of X, from either order; all capitals as capitalised words."""
    title = lambda c: F.array_join(F.transform(F.split(normalise(c), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")
    clean = F.trim(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)\(bbox extent\)$", ""))
    behind, before = r"(?i)^(.*?)[ ,]*, (city|shire|town) of$", r"(?i)^(city|shire|town) of (.*)$"
    named = lambda kind, place: F.concat(title(kind), F.lit(" of "), title(place))
    return (
        F.when(clean.rlike(behind), named(F.regexp_extract(clean, behind, 2), F.regexp_extract(clean, behind, 1)))
        .when(clean.rlike(before), named(F.regexp_extract(clean, before, 1), F.regexp_extract(clean, before, 2)))
        .when((clean == F.upper(clean)) & (clean != ""), title(clean))
        .otherwise(clean)
    )


def spelled_numbers(text: Column) -> Column:
    """STR-17: decimal numbers, and words from one to ten as digits; distinct."""
    words = F.filter(F.transform(tokens(text), lambda w: F.try_element_at(_map(SPELLED), w)), lambda d: d.isNotNull())
    return F.array_distinct(F.concat(numbers_in(text), words))


def stands_alone(number: Column, quote: Column) -> Column:
    """STR-18: whether a number occurs in the quote with no digit next to it."""
    pattern = F.concat(F.lit(r"(?<!\d)"), F.replace(number, F.lit("."), F.lit(r"\.")), F.lit(r"(?!\d)"))
    return F.regexp_count(quote, pattern) > 0


def without_reasoning(answer: Column) -> Column:
    """STR-19: a model's answer without its think blocks; an unclosed one goes to the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(answer, r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*$", ""))


def outer_json(text: Column) -> Column:
    """STR-21: the text between the outermost braces, code fences left out; null without braces."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def cited_numbers(answer: Column) -> Column:
    """STR-19: the numbers of [n] and [n, m] markers."""
    return F.flatten(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d[\d,\s]*)\]"), F.lit(1)), lambda m: F.regexp_extract_all(m, F.lit(r"(\d+)"), F.lit(1))))


def compact_query(text: Column, limit: int = 16) -> Column:
    """STR-20: the first tokens of a question without stop words, short forms written out; the question if nothing is left."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9][A-Za-z0-9-]*)"), F.lit(1))
    plain = lambda w: F.lower(F.btrim(w, F.lit("-")))
    kept = F.filter(words, lambda w: ~plain(w).isin(STOP_WORDS))
    long = F.flatten(F.transform(kept, lambda w: F.coalesce(F.split(F.try_element_at(_map(LONG_FORMS), plain(w)), " "), F.array(w))))
    return F.coalesce(F.nullif(F.array_join(F.slice(long, 1, limit), " "), F.lit("")), text)


def renumbered(answer: Column, n_hits: Column) -> Column:
    """STR-19: an answer whose [n] markers within 1..n_hits are numbered from 1 in order; others go."""
    cited = F.array_sort(F.array_distinct(F.transform(cited_numbers(answer), lambda x: x.try_cast("int"))))
    valid = F.filter(cited, lambda x: x.between(1, n_hits))
    marker = r"\[\d[\d,\s]*\]"

    def rewrite(v: Column) -> Column:
        found, between = F.regexp_extract_all(answer, F.lit(marker), F.lit(0)), F.split(answer, marker)

        def one(m: Column) -> Column:
            new = F.transform(F.regexp_extract_all(m, F.lit(r"(\d+)"), F.lit(1)), lambda x: F.array_position(v, x.try_cast("int")))
            kept = F.filter(new, lambda x: x > 0)
            return F.when(F.size(kept) > 0, F.concat(F.lit("["), F.array_join(F.transform(kept, lambda x: x.cast("string")), ", "), F.lit("]"))).otherwise("")

        return F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(one(F.get(found, i)), F.lit("")))), "")

    return F.get(F.transform(F.array(valid), rewrite), F.lit(0))

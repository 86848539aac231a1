"""Advisory rules by relevance, derived rule keys, evidence search and numbers that no promoted quote holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import is_year
from ..functions.numbers import hash_embedding
from ..functions.text import numbers_in
from .search import lexical_hits

# Words that raise and words that lower the relevance of an advisory rule.
RAISING = [
    "setback", "boundary", "wall", "fence", "garage", "carport", "outbuilding", "patio", "shed", "dwelling", "height", "storey", "plot ratio", "site cover",
    "open space", "outdoor living", "landscap", "overlook", "privacy", "solar", "parking", "driveway", "crossover", "building envelope", "facade", "roof",
    "eaves", "porch", "verandah", "retaining", "fill", "excavation", "amenity",
]
LOWERING = [
    "subdivision", "subdivide", "lot design", "road reserve", "developer contribution", "strata", "commercial", "industrial", "rural", "pastoral", "mining",
    "marina", "dredging", "structure plan area", "precinct", "regional", "foreshore reserve",
]


def _hits(words: list[str], text: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)))


def relevance(text: Column, r_codes: list[str], zones: list[str], scoped: Column) -> Column:
    """MTH-12: 6 for each density code of the project that the text names, 3 for each zone, 2 for residential or dwelling, 1 for each
    raising word, 1.5 less for each lowering word, 1 for a rule with a scope of its own."""
    t = F.lower(text)
    score = 6.0 * _hits([c.lower() for c in r_codes], t) if r_codes else F.lit(0.0)
    if zones:
        score = score + 3.0 * _hits([z.lower() for z in zones], t)
    score = score + F.when(F.contains(t, F.lit("residential")) | F.contains(t, F.lit("dwelling")), 2.0).otherwise(0.0)
    return score + _hits(RAISING, t) - 1.5 * _hits(LOWERING, t) + F.when(scoped, 1.0).otherwise(0.0)


def advisory_rules(rules: DataFrame, r_codes: list[str], zones: list[str], limit: int = 80) -> DataFrame:
    """DOM-03: the most relevant rules without numbers that apply to a project, one for each key. All applicable rules are
    scored; the reference's cut before scoring is left out, as its rows were arbitrary."""
    applies = F.col("codes").isNull() | F.arrays_overlap("codes", F.array(*[F.lit(c) for c in r_codes])) if r_codes else F.lit(True)
    scored = rules.where(applies).withColumn("score", relevance(F.col("text"), r_codes, zones, F.col("codes").isNotNull()))
    best = scored.groupBy("rule_key").agg(F.max_by(F.struct("rule_id", "score"), F.struct("score", -F.col("rule_id"))).alias("b"))
    return best.select("rule_key", "b.rule_id", "b.score").orderBy(F.desc("score"), "rule_key").limit(limit)


def derived_rule_key(base: Column, codes: Column, dwelling: Column) -> Column:
    """PRJ-06: a base key with its codes and dwelling type behind dots, where there are any."""
    known = F.when(F.coalesce(dwelling, F.lit("any")) != "any", dwelling)
    return F.concat_ws(".", base, F.nullif(F.array_join(F.array_sort(codes), "_"), F.lit("")), known)


def evidence_search(queries: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """FTS-04: 0.65 of the lexical score and 0.35 of the cosine of hash embeddings, of texts that share a token with the query."""
    with_vector = lambda rows: rows.withColumn("vector", hash_embedding(F.col("text")))
    return lexical_hits(with_vector(queries), with_vector(docs), k, blend=(0.65, 0.35))


#: Characters of a run of digits and dots whose substrings are listed; longer ones are searched.
LONG_RUN = 40


def unclaimed_numbers(clauses: DataFrame, quotes: DataFrame) -> DataFrame:
    """DOM-27, DT-10: numbers of a version's clauses, but for 0 and years, that none of its promoted quotes holds as a substring.

    A number that a quote holds lies within one of its runs of digits and dots, so numbers meet the substrings of the distinct runs in
    an equi-join; only long runs are searched for each distinct number of their version."""
    said = clauses.select("version_id", "clause_key", F.explode(F.array_distinct(numbers_in(F.col("text")))).alias("number"))
    said = said.where((F.col("number") != "0") & ~is_year(F.col("number")))
    runs = quotes.select("version_id", F.explode(F.regexp_extract_all("quote", F.lit(r"([0-9.]+)"), F.lit(1))).alias("run")).distinct()
    size = F.length("run")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substr("run", i, n))))
    held = runs.where(size <= LONG_RUN).select("version_id", F.explode(parts).alias("number")).distinct()
    long = runs.where(size > LONG_RUN).alias("q")
    beside = said.select("version_id", "number").distinct().alias("n").join(long, (F.col("n.version_id") == F.col("q.version_id")) & F.contains("q.run", F.col("n.number")), "left_semi")
    return said.join(held.unionByName(beside), ["version_id", "number"], "left_anti").select("version_id", "clause_key", "number")


def nth_round_rank(df: DataFrame, column: str, n: int = 2) -> DataFrame:
    """WIN-09: rows of the last n values of a column; the distinct values are ranked, not the rows."""
    values = df.select(column).distinct()
    ranked = values.withColumn("__r", F.row_number().over(Window.orderBy(F.desc(column)))).where(F.col("__r") <= n)
    return df.join(F.broadcast(ranked.select(column)), column, "left_semi")  # n values

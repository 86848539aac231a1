"""Checks derived from rule keys, and clauses cut from chunks of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import NO_RULES

TIER1_RULES = 20

# Categories by the first word that a key holds; kinds of units; measured facts by the first word that a key holds;
# words of clauses that bear rules; marks at which clauses begin.
CATEGORIES = [
    ("street_setback", "SETBACK"), ("setback", "SETBACK"), ("garage", "GARAGE"), ("driveway", "DRIVEWAY"), ("crossover", "DRIVEWAY"), ("visitor_parking", "PARKING"),
    ("bicycle_parking", "PARKING"), ("car_bay", "PARKING"), ("parking", "PARKING"), ("bays", "PARKING"), ("fence", "FENCE"), ("retaining_wall", "WALL"),
    ("boundary_wall", "BOUNDARY_WALL"), ("storeys", "STOREYS"), ("storey", "STOREYS"), ("wall_height", "WALL"), ("eave", "HEIGHT"), ("ceiling_height", "HEIGHT"),
    ("floor_height", "HEIGHT"), ("building_height", "HEIGHT"), ("building_envelope", "HEIGHT"), ("height", "HEIGHT"), ("site_cover", "SITE_COVER"), ("plot_ratio", "SITE"),
    ("site_area", "SITE"), ("soft_landscaping", "LANDSCAPE"), ("landscap", "LANDSCAPE"), ("outdoor_living", "LANDSCAPE"), ("communal_open", "OPEN_SPACE"),
    ("private_open", "OPEN_SPACE"), ("open_space", "OPEN_SPACE"), ("balcony", "LANDSCAPE"), ("frontage", "LOT"), ("lot_width", "LOT"), ("lot_depth", "LOT"),
    ("lot_orientation", "LOT"), ("dwelling_area", "LOT"), ("separation", "SETBACK"), ("noise", "OTHER"), ("sign", "OTHER"),
]
UNIT_ENDS = {"m": "m", "mm": "m", "cm": "m", "km": "m", "m2": "m2", "ha": "m2", "%": "pct", "storeys": "storeys", "ratio": "ratio", "degrees": "degrees"}
FACTS = [("plot_ratio", ["proposed_plot_ratio"]), ("site_area", ["lot_area_m2"]), ("frontage", ["lot_width_m", "frontage_width_m"]), ("lot_width", ["lot_width_m"]), ("lot_depth", ["lot_depth_m"])]
RULE_WORDS = ["must", "shall", "not exceed", "at least", "minimum", "maximum", "required", "permitted", "no more than", "no less than", "deemed-to-comply"]
PROCEDURE_WORDS = ["application", "lodgement", "procedure", "process"]
CLAUSE_MARK = r"(?m)^\s*((?:C|P)\d+(?:\.\d+)+|\d+\.\d+(?:\.\d+)?)\s+"
LEAST_CLAUSE = 30


def _first(text: Column, pairs: list, otherwise: Column, value=F.lit) -> Column:
    out = otherwise
    for word, v in reversed(pairs):
        out = F.when(F.contains(text, F.lit(word)), value(v)).otherwise(out)
    return out


def _most(rows: DataFrame, column: str) -> DataFrame:
    """canonical and its most frequent value, of equal ones the smallest; nulls are left out."""
    n = rows.where(F.col(column).isNotNull()).groupBy("canonical", column).agg(F.sum("n").alias("n"))
    return n.groupBy("canonical").agg(F.min(F.struct(-F.col("n"), F.col(column).alias("v")))["v"].alias(column))


def derive_checks(rules: DataFrame, seeds: list[str], least: int = 5) -> DataFrame:
    """DOM-14: check_key, tier, category, unit, fact_keys, n_approved and description of every canonical key with at least `least` approved
    rules (canonical, state, unit, quote, source_version_id) that is no seed, is snake case and has no word that is no rule's.

    Rules are counted once by key, unit and source, in tasks first; the rest works on these counts."""
    kept = rules.where((F.col("state") == "approved") & (F.trim("canonical") != ""))
    longest = F.min(F.when(F.col("quote").isNotNull(), F.struct((-F.length("quote")).alias("l"), "quote"))).alias("q")
    counted = kept.groupBy("canonical", F.coalesce("unit", F.lit("")).alias("unit"), F.col("source_version_id").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"), longest)
    sums = counted.groupBy("canonical").agg(F.sum("n").alias("n_approved"), F.min("q")["quote"].alias("quote")).where(F.col("n_approved") >= least)
    key = F.trim("canonical")
    rows = sums.join(_most(counted, "unit"), "canonical").join(_most(counted, "source"), "canonical", "left").withColumn("check_key", key).withColumn("unit", F.trim("unit"))
    valid = F.col("check_key").rlike(r"^[a-z][a-z0-9_]{2,160}$") & ~F.greatest(*[F.contains("check_key", F.lit(w)) for w in NO_RULES]) & ~F.col("check_key").isin(seeds)
    ends = F.create_map(*[F.lit(x) for pair in UNIT_ENDS.items() for x in pair])
    own = F.array(F.concat(F.lit("proposed_"), F.col("check_key"), F.lit("_"), F.coalesce(F.try_element_at(ends, F.lower("unit")), F.lit("count"))))
    listed = lambda v: F.array(*map(F.lit, v))
    quote = F.substring(F.trim(F.replace(F.trim(F.coalesce("quote", F.lit(""))), F.lit("\n"), F.lit(" "))), 1, 140)
    told = F.concat(
        F.lit("Advisory check derived from "), F.col("n_approved").cast("string"), F.lit(" approved rules for '"), F.replace("check_key", F.lit("_"), F.lit(" ")), F.lit("'."),
        F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit(" Most-cited source_version "), F.col("source"), F.lit("."))).otherwise(""),
        F.when(quote != "", F.concat(F.lit(' e.g. "'), quote, F.lit('"'))).otherwise(""),
    )
    return rows.where(valid).select(
        "check_key", F.when(F.col("n_approved") >= TIER1_RULES, "TIER1").otherwise("TIER2").alias("tier"), _first(F.col("check_key"), CATEGORIES, F.lit("OTHER")).alias("category"),
        "unit", _first(F.col("check_key"), FACTS, own, listed).alias("fact_keys"), "n_approved", told.alias("description"),
    )


def disposition(text: Column) -> Column:
    """DOM-12, PRJ-05: what a clause is for: rules, a definition in its first 200 characters, a procedure, or information."""
    low = F.lower(text)
    has = lambda words: F.greatest(*[F.contains(low, F.lit(w)) for w in words])
    return F.when(has(RULE_WORDS), "rule_bearing").when(F.substring(low, 1, 200).rlike(r"(?U)\bmeans\b|\bis defined\b"), "definition").when(has(PROCEDURE_WORDS), "procedural").otherwise("informational")


def clause_pass(chunks: DataFrame) -> DataFrame:
    """DOM-12: version_id, clause_key, clause_path, disposition and text of the clauses of chunks (version_id, chunk_index, text): from each
    mark to the next, what stands before the first as an intro, a chunk without a mark as a whole. Clauses of fewer than 30
    characters are left out; of equal keys of a version the last one stays. Clauses leave each chunk as an array."""
    mark = "(?d)" + CLAUSE_MARK.replace("(?m)", "(?mU)")
    text = F.coalesce("text", F.lit(""))
    found, paths, between = F.regexp_extract_all(text, F.lit(mark), F.lit(0)), F.regexp_extract_all(text, F.lit(mark), F.lit(1)), F.split(text, mark)
    number = F.format_string("chunk_%03d_", F.col("chunk_index"))
    part = lambda path, key, body: F.struct(path.alias("path"), F.concat(number, key).alias("key"), body.alias("body"))
    own = F.concat(F.lit("chunk-"), F.col("chunk_index").cast("string"))
    marked = F.transform(found, lambda m, i: part(F.get(paths, i), F.regexp_replace(F.get(paths, i), "[^A-Za-z0-9]+", "_"), F.concat(m, F.get(between, i + 1))))
    intro = F.when(F.get(between, F.lit(0)) != "", F.array(part(own, F.lit("intro"), F.get(between, F.lit(0))))).otherwise(F.array())
    parts = F.when(F.size(found) == 0, F.array(part(own, F.lit("full"), text))).otherwise(F.concat(intro, marked))
    rows = chunks.select("version_id", "chunk_index", F.posexplode(parts).alias("ordinal", "p"))
    body = F.regexp_replace("p.body", r"(?U)^\s+|\s+$", "")
    rows = rows.select("version_id", "chunk_index", "ordinal", F.col("p.path").alias("clause_path"), F.col("p.key").alias("clause_key"), body.alias("text"))
    kept = rows.where(F.length(F.regexp_replace("text", r"(?U)\s+", " ")) >= LEAST_CLAUSE)
    last = kept.groupBy("version_id", "clause_key").agg(F.max_by(F.struct("clause_path", "text"), F.struct("chunk_index", "ordinal")).alias("c"))
    return last.select("version_id", "clause_key", "c.clause_path", disposition(F.col("c.text")).alias("disposition"), "c.text")

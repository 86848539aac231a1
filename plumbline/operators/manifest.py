"""Source manifests: import of entries with counters, and what becomes of rows that are pending or blocked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise

# Words and beginnings by which pending rows are sorted out.
PLANNING_TERMS = [
    "planning", "development", "r-codes", "residential design codes", "local planning scheme", "region scheme", "metropolitan region scheme",
    "peel region scheme", "greater bunbury region scheme", "subdivision", "building", "bushfire", "heritage",
]
STANDARDS_TERMS = ["as ", "as/nzs", "australian standard", "standards australia"]
SUPERSESSION_TERMS = ["amendment", "commencement", "citation published", "repeal", "repealed", "repealing", "reprint of", "validation", "savings", "transitional"]
TRIAGE_PREFIXES = ["act and the ", "despite the "]
# Words and beginnings of fragments of blocked rows, and beginnings that a title can lack.
FRAGMENT_TERMS = ["amendment", "assent commencement", "citation published commencement", "commencement", "reprint of", "operation of", "forms "]
FRAGMENT_PREFIXES = ["iii of ", "when ", "wiluna ", "yelbeni ", "western australian planning commission ", "swan valley planning scheme "]
VARIANT_PREFIXES = ["the ", "western australia ", "authority "]


def _has(text: Column, words: list[str]) -> Column:
    return F.greatest(*[F.contains(text, F.lit(w)) for w in words], F.lit(False))


def _begins(text: Column, words: list[str]) -> Column:
    return F.greatest(*[F.startswith(text, F.lit(w)) for w in words], F.lit(False))


def _name(column: str) -> Column:
    return normalise(F.coalesce(column, F.lit("")))


def without_prefixes(name: Column) -> Column:
    """The name without the variant beginnings, again and again."""
    return F.trim(F.regexp_replace(name, "^(?:(?:" + "|".join(p.strip() for p in VARIANT_PREFIXES) + r") +)+", ""))


def triage(rows: DataFrame) -> DataFrame:
    """DOM-26: manifest_id, recommended and reason of pending rows (manifest_id, instrument_name, category, canonical_url): the first
    of standard, fragment, out of scope, has a URL, that holds; else blocked."""
    name, category = _name("instrument_name"), _name("category")
    law = category.isin("act", "regulations")
    decision = (
        F.when((category == "standard") | _has(name, STANDARDS_TERMS), F.struct(F.lit("metadata_only").alias("recommended"), F.lit("standard").alias("reason")))
        .when(law & (_has(name, SUPERSESSION_TERMS) | _begins(name, TRIAGE_PREFIXES)), F.struct(F.lit("out_of_scope").alias("recommended"), F.lit("fragment").alias("reason")))
        .when(law & ~_has(name, PLANNING_TERMS), F.struct(F.lit("out_of_scope").alias("recommended"), F.lit("scope").alias("reason")))
        .when(F.trim(F.coalesce("canonical_url", F.lit(""))) != "", F.struct(F.lit("pending").alias("recommended"), F.lit("url").alias("reason")))
        .otherwise(F.struct(F.lit("blocked").alias("recommended"), F.lit("no_url").alias("reason")))
    )
    return rows.select("manifest_id", decision.alias("d")).select("manifest_id", "d.*")


def reconcile(rows: DataFrame, sources: DataFrame, aliases: dict[str, str] | None = None, superseded: dict[str, str] | None = None) -> DataFrame:
    """DOM-26: manifest_id, recommended and source_id of manifest rows (manifest_id, instrument_name, status) against sources
    (source_id, title): rows that are not blocked keep their status; fragments and superseded names are out of scope, with the
    source that covers them, if any; names that equal a title, as they are, by an alias or without variant beginnings, are
    acquired; others stay blocked.

    Titles are few kinds of one normal form: the smallest id of each meets the names in equi-joins, first the name's own
    forms, then its endings at words, the longest first."""
    titles = sources.groupBy(_name("title").alias("form")).agg(F.min("source_id").alias("source_id"))
    constants = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair]) if d else F.create_map(F.lit(""), F.lit(""))
    target = lambda d, c: normalise(F.try_element_at(constants(d or {}), c))
    name = _name("instrument_name")
    base = rows.withColumn("name", name).withColumn("bare", without_prefixes(F.col("name")))
    base = base.withColumn("over", F.coalesce(target(superseded, F.col("bare")), target(superseded, F.col("name"))))
    fragment = _has(F.col("name"), FRAGMENT_TERMS) | _begins(F.col("name"), FRAGMENT_PREFIXES) | F.col("over").isNotNull()
    base = base.withColumn("kind", F.when(~F.coalesce(F.col("status") == "blocked", F.lit(False)), "kept").when(fragment, "fragment").otherwise("alias"))
    words = F.split("name", " ")
    endings = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))
    alias = target(aliases, F.col("name"))
    own = F.when(alias.isNotNull(), F.array(alias)).otherwise(F.array("name", "bare"))
    forms = F.when(F.col("kind") == "fragment", F.concat(F.array("over"), endings)).when(F.col("kind") == "alias", own)
    wanted = base.select("manifest_id", F.posexplode(forms).alias("place", "form")).where("form <> ''")
    met = wanted.join(titles, "form").groupBy("manifest_id").agg(F.min_by("source_id", "place").alias("source_id"))
    out = base.join(met, "manifest_id", "left")
    status = F.when(F.col("kind") == "kept", F.col("status")).when(F.col("kind") == "fragment", "out_of_scope").when(F.col("source_id").isNotNull(), "acquired").otherwise("blocked")
    return out.select("manifest_id", status.alias("recommended"), F.when(F.col("kind") != "kept", F.col("source_id")).alias("source_id"))


def import_entries(entries: DataFrame, known: DataFrame, local_government: str | None = None) -> DataFrame:
    """SRC-17: entries (ordinal, fields: a map) with identity, metadata_only and outcome: skipped where there are no fields or they
    are of another local government, refused without a title, duplicate where the identity is known (known: identity) or an
    earlier entry has it, else imported. The identity is that of source, version and content; equal ones meet as aggregates."""
    field = lambda c: F.trim(F.coalesce(F.try_element_at("fields", F.lit(c)), F.lit("")))
    label, notes = F.coalesce(F.nullif(field("version_label"), F.lit("")), F.lit("anchor-only")), F.lower(field("licence_notes"))
    elsewhere = F.lit(False) if not local_government else F.lower(field("local_government")) != local_government.strip().lower()
    identity = F.sha2(F.concat_ws("|", field("authority"), field("canonical_url"), field("title"), label, field("content")), 256)
    rows = entries.select(
        "ordinal",
        field("title").alias("title"),
        identity.alias("identity"),
        ((field("content") == "") | (label == "anchor-only") | F.contains(notes, F.lit("metadata only")) | F.contains(notes, F.lit("example fixture"))).alias("metadata_only"),
        F.when(F.size("fields") <= 0, "skipped").when(elsewhere, "skipped").when(field("title") == "", "refused").alias("out"),
    )
    first = rows.where("out IS NULL").groupBy("identity").agg(F.min("ordinal").alias("first"))
    first = first.join(known.select("identity", F.lit(True).alias("held")).distinct(), "identity", "left")
    fresh = (F.col("first") == F.col("ordinal")) & F.col("held").isNull()
    outcome = F.coalesce("out", F.when(fresh, "imported").otherwise("duplicate"))
    return rows.join(first, "identity", "left").select("ordinal", "title", "identity", "metadata_only", outcome.alias("outcome"))


def import_report(imported: DataFrame) -> DataFrame:
    """One row: how many entries were imported, duplicates, skipped and refused."""
    return imported.agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("imported", "imported"), ("duplicate", "duplicates"), ("skipped", "skipped"), ("refused", "refused"))])

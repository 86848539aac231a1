"""Text rank by cover density: how close together the words of a query stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import shared_path
from .latest import rows_per_key

#: Weight of a word that has none of its own.
WEIGHT = 0.1


def parse_query(queries: DataFrame) -> DataFrame:
    """query_id, need and veto: the distinct words that a text must hold, and those, written with a minus, that it must not.
    Words are runs of a-z and 0-9, as in the index; a query without a word to hold finds nothing."""
    parts = F.split(F.trim(F.regexp_replace(F.lower("text"), r"(?U)\s+", " ")), " ")
    minus = lambda w: F.startswith(w, F.lit("-"))
    words = lambda keep: F.array_distinct(F.flatten(F.transform(F.filter(parts, keep), lambda w: T.tokens(w))))
    return queries.select("query_id", words(lambda w: ~minus(w)).alias("need"), words(minus).alias("veto")).where(F.size("need") > 0)


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, pos (from 0) and term of every word."""
    return docs.select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "term"))


def _density(spots: Column, n: Column) -> Column:
    """Sum over the minimal covers of spots (pos, k: the number of the term), in the order of positions: the weight over one plus
    the other words within. One pass: at each spot the least of the terms' last spots begins a cover, a new one if it has moved on."""
    start = F.struct(F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(-1)).alias("last"), F.lit(-1).alias("begun"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"))

    def step(acc: Column, spot: Column) -> Column:
        last = F.transform(acc["last"], lambda x, k: F.when(k == spot["k"], acc["i"]).otherwise(x))

        def then(last: Column) -> Column:
            low = F.array_min(last)
            fresh = (low >= 0) & (low > acc["begun"])
            noise = spot["pos"] - F.get(spots, low)["pos"] - (acc["i"] - low)
            return F.struct(last.alias("last"), F.greatest(acc["begun"], low).alias("begun"), (acc["sum"] + F.when(fresh, WEIGHT / (1 + noise)).otherwise(0.0)).alias("sum"), (acc["i"] + 1).alias("i"))

        return F.get(F.transform(F.array(last), then), F.lit(0))

    return F.aggregate(spots, start, step, lambda acc: acc["sum"])


def cover_density(queries: DataFrame, docs: DataFrame, limit: int = 8) -> DataFrame:
    """FTS-02: query_id, rank, doc_id and score of five times `limit` texts that hold all words of a query and none of its vetoes,
    the highest cover density first, equal ones by id.

    The rank is that of covers: each minimal run of words that holds all terms adds 0.1 over one plus its other words. Positions of
    a word in a text are one row, written to the shared folder, so texts are split once. A query meets the texts on its rarest word,
    and those meet its vetoes and the rest of its words on text and word, so a frequent word costs nothing where the rarest lacks.
    Words are not stemmed and no stop words are left out."""
    asked = parse_query(queries)
    terms = asked.select("query_id", F.size("need").alias("n"), F.posexplode("need").alias("k", "term"))
    vetoes = asked.select("query_id", F.explode("veto").alias("term"))
    words = terms.select("term").unionByName(vetoes.select("term")).distinct()
    index = postings(docs.where("doc_id IS NOT NULL")).join(words, "term").groupBy("doc_id", "term").agg(F.collect_list("pos").alias("at"))
    path = shared_path(docs.sparkSession, "positions")
    index.write.parquet(path)
    index = docs.sparkSession.read.schema(index.schema).parquet(path)
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("texts"))
    rare = terms.join(counts, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("texts", F.lit(0)), "term")).alias("term"))
    found = index.select("doc_id", "term").join(rare, "term").select("query_id", "doc_id")
    barred = found.join(vetoes, "query_id").join(index.select("doc_id", "term"), ["doc_id", "term"]).select("query_id", "doc_id").distinct()
    met = found.join(barred, ["query_id", "doc_id"], "left_anti").join(terms, "query_id").join(index, ["doc_id", "term"])
    spot = F.transform("at", lambda pos: F.struct(pos.alias("pos"), F.col("k").alias("k")))
    whole = met.groupBy("query_id", "doc_id", "n").agg(F.collect_list(spot).alias("spots")).where(F.size("spots") == F.col("n"))
    spots = whole.withColumn("spots", F.array_sort(F.flatten("spots")))
    scored = spots.select("query_id", "doc_id", F.round(_density(F.col("spots"), F.col("n")), 6).alias("score"))
    return rows_per_key(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], 5 * limit)

"""Lexical, vector and cited search of a stated set of queries over all rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cosine
from ..functions.text import normalise, safe_quote, token_set
from ..functions.text import tokens as token_list
from .latest import rows_per_key

#: Queries of one block on average; the blocks are as many as the queries need.
BLOCK = 1_000
#: Characters of the texts of one shard on average, and those that a text counts for beside its own.
SHARD_CHARS, ROW_CHARS = 8_000_000, 200
#: Scores of one matrix: texts by queries.
CELLS = 500_000


def query_blocks(queries: DataFrame) -> DataFrame:
    """One row a block, `q`: all queries, dealt by hash into blocks enough for their count."""
    n = queries.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK))).scalar()
    return queries.groupBy(F.pmod(F.xxhash64(*queries.columns), n).alias("__block")).agg(F.collect_list(F.struct(*queries.columns)).alias("q")).select("q")


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """As Spark's round: half up in the shortest decimal form. Only values near a half are looked at one by one."""
    scaled = x * 10.0**places
    out = np.floor(scaled + 0.5) / 10.0**places
    near = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5)
    values, back = np.unique(x.flat[near], return_inverse=True)
    unit = Decimal(1).scaleb(-places)
    out.flat[near] = np.array([float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP)) for v in values.tolist()])[back]
    return out


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all rows of a with all of b, summed in the order of the components, as functions.numbers.cosine does."""
    out, aa, bb = np.zeros((len(a), len(b))), np.zeros(len(a)), np.zeros(len(b))
    for x, y in zip(a.T, b.T):
        out += x[:, None] * y
        aa += x * x
        bb += y * y
    norms = np.sqrt(aa)[:, None] * np.sqrt(bb)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def _best_of_shard(k: int, blend: tuple[float, float] | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best texts of a shard for each query of a block: distinct tokens of a text are counted by the queries that have them,
    some texts at a time, and only the best rows are kept."""

    def run(docs: pa.Table, queries: pa.Table) -> pa.Table:
        docs = docs.take(pc.sort_indices(docs, sort_keys=[("doc_id", "ascending")], null_placement="at_start"))  # ties to the least id
        holders: dict[str, list[int]] = {}
        wanted = queries["tokens"].to_pylist()
        for i, tokens in enumerate(wanted):
            for token in tokens:
                holders.setdefault(token, []).append(i)
        holder = {token: np.array(at) for token, at in holders.items()}
        n, phrases, find = np.array([len(t) for t in wanted]), queries["phrase"].to_pylist(), re.compile("[a-z0-9]+").findall
        kept_rows, kept_queries, kept_scores = [np.zeros(0, np.int64)] * queries.num_rows, np.arange(queries.num_rows), [np.zeros(0)] * queries.num_rows
        step = max(1, CELLS // max(1, len(n)))
        for begin in range(0, docs.num_rows if len(n) else 0, step):
            part = docs.slice(begin, step)
            shared = np.zeros((part.num_rows, len(n)), np.int64)
            texts = part["text"].to_pylist()
            for row, text in enumerate(texts):
                at = [holder[t] for t in set(find(text)) if t in holder]
                if at:
                    shared[row] = np.bincount(np.concatenate(at), minlength=len(n))
            score = shared / np.maximum(n, 1)
            # a text that holds the phrase has all its tokens, but perhaps the first and the last
            rows, columns = np.nonzero((shared > 0) & (shared >= n - 2))
            held = np.array([phrases[q] in texts[r] for r, q in zip(rows.tolist(), columns.tolist())], bool)
            score[rows[held], columns[held]] += 0.25
            score = rounded(score, 6)
            if blend:
                vectors = [np.array(t["vector"].to_pylist(), float) for t in (part, queries)]
                score = rounded(blend[0] * score + blend[1] * np.maximum(0.0, _cosines(*vectors)), 4)
            score[shared == 0] = -np.inf
            for q in range(len(n)):
                mine = score[:, q]
                least = kept_scores[q][-1] if len(kept_scores[q]) == k else -np.inf
                better = np.flatnonzero(mine > least)  # an equal score of a later text is no better
                if len(better):
                    rows, scores = np.concatenate([kept_rows[q], better + begin]), np.concatenate([kept_scores[q], mine[better]])
                    best = np.lexsort((rows, -scores))[:k]
                    kept_rows[q], kept_scores[q] = rows[best], scores[best]
        owner = np.repeat(kept_queries, [len(r) for r in kept_rows])
        ids = docs["doc_id"].take(pa.array(np.concatenate([np.zeros(0, np.int64), *kept_rows])))
        return pa.table({"query_id": queries["query_id"].take(pa.array(owner)), "doc_id": ids, "score": np.concatenate([np.zeros(0), *kept_scores])})

    return run


def lexical_hits(queries: DataFrame, docs: DataFrame, k: int, blend: tuple[float, float] | None = None) -> DataFrame:
    """FTS-03, MTH-04, SET-01: query_id, doc_id, score and rank of the k best texts of each query that share a token with it, equal
    ones by id. The score is the shared tokens over the query's, and 0.25 where the phrase occurs; with `blend`, its first part of
    that and its second of the cosine of both rows' `vector`.

    Texts are dealt by id into shards of bounded size and queries into blocks; every shard meets every block, and sends k rows a
    query at most, so pairs of texts and queries are never shuffled or sorted."""
    vector = ["vector"] if blend else []
    queries, docs = queries.where("text IS NOT NULL"), docs.where("text IS NOT NULL")
    size = docs.agg(F.greatest(F.lit(1), F.ceil(F.sum(F.length("text") + ROW_CHARS) / SHARD_CHARS)).alias("n"))
    shards = size.scalar()
    blocks = queries.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK))).scalar()
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    asked = queries.select("query_id", normalise(F.col("text")).alias("phrase"), token_set(F.col("text")).alias("tokens"), *vector, F.pmod(F.xxhash64("query_id"), blocks).alias("block"))
    asked = asked.withColumn("shard", upto(shards))
    held = docs.select("doc_id", normalise(F.col("text")).alias("text"), *vector, F.pmod(F.xxhash64("doc_id"), shards).alias("shard"))
    held = held.withColumn("block", upto(blocks))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"query_id {kind(queries, 'query_id')}, doc_id {kind(docs, 'doc_id')}, score double"
    best = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_best_of_shard(k, blend), schema)
    return top_hits(best, k)


def quote_hits(quotes: DataFrame, docs: DataFrame, key: str = "item_id") -> DataFrame:
    """JN-13: (key, doc_id) of the texts that hold each quote word for word.

    A quote of three tokens or more meets the texts on its rarest inner token, which such a text must hold whole; shorter ones
    are looked for in every text, block by block."""
    asked = quotes.select(key, F.col("text").alias("q"), token_list(F.col("text")).alias("t"))
    inner = asked.where(F.size("t") >= 3).select(key, "q", F.explode(F.array_distinct(F.slice("t", F.lit(2), F.size("t") - 2))).alias("token"))
    held = docs.select("doc_id", F.explode(token_set(F.col("text"))).alias("token"))
    counts = held.join(inner.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rare = inner.join(counts, "token").groupBy(key, "q").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    found = held.join(rare, "token").join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("q"))).select(key, "doc_id")
    short = asked.where(F.size("t") < 3).select(key, F.col("q").alias("text"))
    beside = docs.select("doc_id", "text").crossJoin(query_blocks(short)).select("doc_id", "text", F.explode("q").alias("q"))
    return found.unionByName(beside.where(F.contains("text", F.col("q.text"))).select(F.col("q")[key].alias(key), "doc_id"))


def top_hits(scores: DataFrame, k: int) -> DataFrame:
    return rows_per_key(scores, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def relevance_floor(hits: DataFrame, least: float = 0.15, share: float = 0.35) -> DataFrame:
    """FLT-15: hits at or above the greater of `least` and a share of the query's best score."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("__top", top).where(F.col("score") >= F.greatest(F.lit(least), F.col("__top") * share)).drop("__top")


def vector_scores(queries: DataFrame, vectors: DataFrame, score: Column | None = None) -> DataFrame:
    """VEC-01: cosine of every vector with each query, block by block."""
    rows = vectors.crossJoin(query_blocks(queries.select("query_id", "vector"))).select("doc_id", "embedding", F.explode("q").alias("q"))
    return rows.select(F.col("q.query_id").alias("query_id"), "doc_id", F.round(cosine(F.col("embedding"), F.col("q.vector")), 4).alias("score"))


def cite_or_refuse(queries: DataFrame, hits: DataFrame, docs: DataFrame, excerpts: int = 4) -> DataFrame:
    """DOM-22, MTH-05: an answer of quoted hits with their ids, or a refusal with confidence 0."""
    best = hits.where(F.col("rank") <= excerpts).join(docs.select("doc_id", safe_quote(F.col("text"), 180).alias("quote")), "doc_id")
    parts = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "quote"))).alias("p"), F.round(F.least(F.lit(0.95), 0.5 + F.avg("score") / 2), 4).alias("confidence"))
    out = queries.select("query_id").join(parts, "query_id", "left")
    return out.select(
        "query_id",
        F.when(F.col("p").isNull(), "unsupported").otherwise("answered").alias("status"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce(F.array_join(F.transform("p", lambda x: x["doc_id"].cast("string")), ","), F.lit("")).alias("citations"),
        F.coalesce(F.array_join(F.transform("p", lambda x: x["quote"]), " "), F.lit("")).alias("answer"),
    )


def evidence_blocks(facts: DataFrame, blocks: DataFrame) -> DataFrame:
    """DOM-28: fact_id, block_number and bbox of every fact (fact_id, doc_id, page, source_text): the first block (doc_id, page,
    block_number, text, bbox) of its page that holds its text, both in normal form; null where there is none, where the text is
    blank, or where the first such block has no place. Facts meet the blocks of their own page only."""
    asked = facts.select("fact_id", "doc_id", "page", normalise(F.coalesce("source_text", F.lit(""))).alias("need"))
    held = blocks.select("doc_id", "page", "block_number", normalise(F.coalesce("text", F.lit(""))).alias("has"), "bbox")
    met = asked.where("need <> ''").join(held, ["doc_id", "page"]).where(F.contains("has", F.col("need")))
    first = met.groupBy("fact_id").agg(F.min_by(F.struct("block_number", "bbox"), "block_number").alias("b"))
    out = facts.select("fact_id").join(first, "fact_id", "left")
    return out.select("fact_id", F.when(F.col("b.bbox").isNotNull(), F.col("b.block_number")).alias("block_number"), F.col("b.bbox").alias("bbox"))

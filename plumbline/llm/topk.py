"""Exact top-k search by inner product: a ball tree per shard, searched by branch and bound.

Vectors become integers, floor(256 * x), so scores are exact. A shard's tree is built once and written, a row for each node.
A block of queries first searches one shard; its k-th scores are shared with the searches of all other shards, which visit
nodes by their upper bound q.c + |q| r and stop below the k-th score. Blocks and shards have bounded sizes.

Defined cases: vectors that are null or empty, or hold null or non-finite components, take no part, nor does a null vec_id;
components beyond 2 ** 62 after scaling, and scores beyond 64 bits, are cut to the bound; rows that repeat a vec_id take part
each, as queries and as candidates, and equal ones are searched once and counted; vectors are compared within their dimension;
ties go to the smaller vec_id; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARD_ROWS, QUERY_ROWS, LEAF = 20_000, 1_024, 256
_NODE = "dim int, shard int, node int, left int, right int, center binary, radius double, ids binary, copies binary, vectors binary"


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v and n: distinct integer vectors of each id, and how many rows have them."""
    bound = float(1 << 62)
    scaled = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * 256.0, F.lit(bound)), F.lit(-bound))))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & usable)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled.alias("v")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"))


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products, cut to 64 bits; in numbers of any size only where the terms could leave 63 bits."""
    if float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * len(q) < 2.0**62:
        return x @ q
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([min(high, max(low, sum(map(int.__mul__, row, q.tolist())))) for row in x.tolist()], np.int64)


def _build(key, rows: pd.DataFrame) -> pd.DataFrame:
    dim, shard = int(key[0]), int(key[1])
    rows = rows.sort_values("vec_id")
    ids, copies, x = rows["vec_id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), np.stack(rows["v"].to_numpy()).astype(np.int64)
    f, out = x.astype(float), []

    def add(index: np.ndarray) -> int:
        node = len(out)
        center = f[index].mean(axis=0)
        far = np.sqrt(((f[index] - center) ** 2).sum(axis=1))
        out.append([dim, shard, node, -1, -1, center.tobytes(), float(far.max()) * (1 + 1e-9) + 1e-6, None, None, None])
        a = index[far.argmax()]
        b = index[((f[index] - f[a]) ** 2).sum(axis=1).argmax()]
        side = f[index] @ (f[b] - f[a])
        half = np.argsort(side, kind="stable")
        if len(index) <= LEAF or side.max() == side.min():
            out[node][7], out[node][8], out[node][9] = ids[index].tobytes(), copies[index].tobytes(), x[index].tobytes()
        else:
            left, right = np.sort(index[half[: len(half) // 2]]), np.sort(index[half[len(half) // 2 :]])
            out[node][3] = add(left)
            out[node][4] = add(right)
        return node

    add(np.arange(len(ids)))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _NODE.split(", ")])


def _search(k: int):
    def run(nodes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(nodes) and len(queries):
            nodes = nodes.sort_values("node")
            centers = np.stack([np.frombuffer(b) for b in nodes["center"]])
            radius, left, right = (nodes[c].to_numpy() for c in ("radius", "left", "right"))
            leaf = zip(nodes["node"], nodes["ids"], nodes["copies"], nodes["vectors"])
            leaves = {n: (np.frombuffer(i, np.int64), np.frombuffer(c, np.int64), np.frombuffer(v, np.int64).reshape(-1, centers.shape[1])) for n, i, c, v in leaf if i is not None}
            for qid, key, v, floor in zip(queries["query_id"], queries["key"], queries["q"], queries["floor"]):
                q = np.asarray(v, np.int64)
                qf = q.astype(float)
                bound = centers @ qf + np.sqrt(qf @ qf) * radius
                bound = bound + 1e-9 * np.abs(bound) + 1e-3
                best: list[tuple[int, int, int]] = []  # (score, -vec_id, -rows), the worst first
                limit = -math.inf if floor is None or floor != floor else float(floor)
                heap = [(-bound[0], 0)]
                while heap:
                    top, n = heapq.heappop(heap)
                    if -top < limit:
                        break
                    if n in leaves:
                        ids, copies, x = leaves[n]
                        scores = _products(x, q)
                        rows = copies - ((ids == qid) & (x == q).all(axis=1))  # all but the query's own row
                        near = np.flatnonzero((scores >= limit) & (rows > 0))
                        if len(near) > k:
                            near = near[np.lexsort((ids[near], -scores[near]))[:k]]
                        for s, i, c in zip(scores[near].tolist(), ids[near].tolist(), rows[near].tolist()):
                            if len(best) < k:
                                heapq.heappush(best, (s, -i, -c))
                            elif (s, -i, -c) > best[0]:
                                heapq.heapreplace(best, (s, -i, -c))
                        if len(best) == k:
                            limit = max(limit, best[0][0])
                    else:
                        for c in (left[n], right[n]):
                            heapq.heappush(heap, (-bound[c], c))
                found += [(qid, key, -i, s, -c) for s, i, c in best]
        return pd.DataFrame(found, columns=["query_id", "key", "vec_id", "score", "n"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best other vectors for every query."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.write(integer_vectors(vectors).withColumn("dim", F.size("v")), "vectors")
    n, n_queries = rows.count(), rows.where(is_query).count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    index = scratch.write(dealt.groupBy("dim", "shard").applyInPandas(_build, _NODE), "index")
    key = F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256).alias("key")
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), key, F.col("v").alias("q"), "n", "dim", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    home = F.pmod(F.col("block"), F.lit(shards))
    schema = "query_id bigint, key string, vec_id bigint, score bigint, n bigint"

    def search(asked: DataFrame) -> DataFrame:
        """asked: queries with their shard and the score below which nothing is wanted."""
        copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        keys = ("dim", "shard", "block")
        asked = asked.drop("n")
        return copies.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_search(k), schema)

    none = F.lit(None).cast("bigint")
    first = scratch.write(search(queries.withColumn("shard", home).withColumn("floor", none)), "first")
    result = first
    if shards > 1:
        floors = first.groupBy("query_id", "key").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != home))
        asked = queries.join(floors, ["query_id", "key"], "left").withColumn("shard", others)
        result = first.unionByName(search(asked))
    each = result.withColumn("__c", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    best = each.drop("n").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    rows_of = queries.select("query_id", "key", F.col("n").alias("__q"))
    best = best.join(rows_of, ["query_id", "key"]).withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__q").cast("int"))))
    return best.select("query_id", "rank", "vec_id", "score")

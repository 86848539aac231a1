"""Mixing sources to target weights by Poisson replication, in DataFrame expressions only.

Each document is repeated k times, k being the inverse of a Poisson distribution, whose mean is its source's target
repetition rate, at a uniform number hashed from the seed and the document id. Copies are then shuffled globally.

Defined cases: null sources form one source of their own; a null id hashes as the word null; repeated rows draw the same
count; a text of any length is only carried along; an empty table gives an empty result; sources without a weight (when weights are given) are left out; columns of the
input that are named as ones of the result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rate above this is split into equal parts, whose counts are drawn apart and added: sums of Poissons are Poisson.
MAX_PART = 8.0
#: Beyond this count the upper tail of a Poisson with mean MAX_PART is below 2 ** -53.
MAX_COUNT = 48


def uniform(seed: int, *keys: Column) -> Column:
    """52 bits of an MD5 digest as a number in [0, 1)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_inverse(u: Column, rate: Column) -> Column:
    """Smallest k with u <= P(X <= k): one pass of a fold over possible counts."""
    state = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * rate / i
        return F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), (acc["k"] + (acc["cdf"] < u).cast("int")).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_COUNT)), state, step, lambda acc: acc["k"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, source: str = "source") -> DataFrame:
    """Per source: documents and the mean repetition rate that brings it to its share of `total` documents.

    Without weights every source has the same share; without a total the size of the input is kept."""
    counts = docs.groupBy(F.col(source).alias("__source")).agg(F.count(F.lit(1)).alias("__n"))
    if weights is None:
        counts = counts.withColumn("__w", F.lit(1.0))
    else:
        rows = [(str(k), float(v)) for k, v in weights.items() if v > 0]
        table = docs.sparkSession.createDataFrame(rows, "__key string, __w double")
        counts = counts.join(table, F.col("__source") == F.col("__key")).drop("__key")
    sum_w, sum_n = (counts.agg(F.sum(c).cast("double").alias(c)).scalar() for c in ("__w", "__n"))
    target = F.lit(float(total)) if total is not None else sum_n
    return counts.select("__source", "__n", (F.col("__w") / sum_w * target / F.col("__n")).alias("__rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = 17, source: str = "source", key: str = "doc_id") -> DataFrame:
    """The documents, each repeated by its count, with mix_rate, mix_copy (from 1) and mix_key, in globally shuffled order.

    Per-source counts are aggregated before they are shuffled; the rates join is left to the optimizer, which broadcasts
    them only below its size threshold. The shuffle deals copies by their hash, so no source meets in one task."""
    docs = docs.drop("mix_rate", "mix_copy", "mix_key")
    rated = docs.join(rates(docs, weights, total, source), F.col(source).eqNullSafe(F.col("__source")))
    parts = F.greatest(F.lit(1), F.ceil(F.col("__rate") / MAX_PART).cast("int"))
    counted = rated.withColumn("__parts", parts).withColumn("__part_rate", F.col("__rate") / F.col("__parts"))
    one = poisson_inverse(uniform(seed, F.col(key), F.lit(0)), F.col("__part_rate"))
    more = F.aggregate(
        F.sequence(F.lit(0), F.col("__parts") - 1), F.lit(0), lambda acc, j: acc + poisson_inverse(uniform(seed, F.col(key), j), F.col("__part_rate"))
    )
    counted = counted.withColumn("__k", F.when(F.col("__parts") == 1, one).otherwise(more)).where("__k > 0")
    copies = counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("__k"))))
    order = F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("mix_copy").cast("string")))
    return (
        copies.withColumn("mix_key", order)
        .withColumnRenamed("__rate", "mix_rate")
        .select(*docs.columns, "mix_rate", "mix_copy", "mix_key")
        .repartition("mix_key")
        .sortWithinPartitions("mix_key")
    )

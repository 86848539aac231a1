"""N-gram Jaccard join by MinHash banding: documents whose sets of five-word shingles have a similarity of at least 0.8.

Texts with equal sets form a class and are compared once. Signatures are cut into bands; equal band hashes meet in a
shuffle, and a bucket is a star of edges to its smallest member, never all its pairs. Each connected set of candidates is
then verified on the full shingle sets, in pairs of blocks of bounded size, which return counts and a spanning forest of
the true links, so no link is lost and no group is listed pair by pair.

Defined cases: a text of one to four words is one shingle; a null, empty or blank text has no shingles, is a class and group
of its own and has no links; repeated rows are copies; documents with a null id take part, and have a null class id only if
all copies do; an empty table gives an empty result; other columns, whatever their names, only tell rows apart; a very long
text is held whole by one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9995
#: Most rows of a band that keep false candidates rare; the bands follow from the recall wanted at the similarity.
ROWS = 4
BLOCK = 384
_M = np.uint64(0x9E3779B97F4A7C15)
_SPACE = "\t\n\x0b\x0c\r"


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Fewest bands with 1 - (1 - s ** rows) ** bands >= recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, memo: dict[str, int], n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of n lower-cased words."""
    words = text.lower().translate(_TABLE).split(" ")
    words = [w for w in words if w]
    if not words:
        return np.zeros(0, np.uint64)
    if len(memo) > 150_000:
        memo.clear()
    out = []
    for w in words:
        h = memo.get(w)
        if h is None:
            h = memo[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        out.append(h)
    h = np.array(out, np.uint64)
    k = min(n, len(h))
    acc = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        acc = _mix(acc * _M + h[i : len(h) - k + 1 + i])
    return np.unique(acc)


_TABLE = {ord(c): " " for c in _SPACE}


def _signer(bands: int, rows: int):
    salts = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * _M)

    def sign(sets: np.ndarray) -> list[int]:
        least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(sets), 2048):
            part = sets[at : at + 2048]
            for j, salt in enumerate(salts):
                x = (part ^ salt) * _M
                least[j] = min(least[j], (x ^ (x >> np.uint64(32))).min())
        acc = np.arange(bands, dtype=np.uint64)
        for r in range(rows):
            acc = _mix(acc * _M + least[r::rows][:bands])
        return acc.view(np.int64).tolist()

    return sign


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, h (hash of the whole row), sid (digest of the shingle set, null without shingles) and band hashes of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        sign = _signer(bands, rows)
        for batch in batches:
            sids, sigs = [], []
            for text in batch.column("__text").to_pylist():
                s = shingles(text, memo)
                sids.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None)
                sigs.append(sign(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(sids, pa.string()), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "h", "sid", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64(*docs.columns).alias("h"), text_of("text").alias("__text")).mapInArrow(run, f"doc_id {kind}, h bigint, sid string, bands array<bigint>")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): the smallest node of each connected component, by minimum labels with pointer jumping. Each round is a
    written table, so a lost executor repeats no earlier round."""
    both = scratch.write(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), f"{name}-0")
    n = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        n += 1
        after = scratch.write(low.join(up, "low").select("node", F.least("low", "up").alias("label"), (F.least("low", "up") < F.col("was")).alias("moved")), f"{name}-{n}")
        moved = after.where("moved").limit(1).count()
        scratch.drop(f"{name}-{n - 1}")
        labels = after.select("node", "label")
        if not moved:
            return labels


def _verify(similarity: float):
    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(key[1]), int(key[2])
        sets = [np.frombuffer(b, np.uint64) for b in group["shingles"]]
        size = np.array([len(s) for s in sets])
        weight = group["n_copies"].to_numpy(np.int64)
        owner = np.repeat(np.arange(len(sets)), size)
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        df = np.bincount(column)
        keep = df[column] > 1
        owner, column = owner[keep], np.cumsum(df > 1)[column[keep]] - 1
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        width = 4096
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [lo, lo + width])
            part = np.zeros((len(sets), width), np.float32)
            part[owner[a:b], column[a:b] - lo] = 1
            common += part @ part.T
        link = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-6
        np.fill_diagonal(link, False)
        block = group["block"].to_numpy()
        if i != j:
            link &= block[:, None] != block[None, :]
        label = np.arange(len(sets))
        while True:
            low = np.minimum(label, np.where(link, label[None, :], len(sets)).min(axis=1))
            low = low[low]
            if (low == label).all():
                break
            label = low
        n_links = link @ weight
        hit = n_links > 0
        sid = group["sid"].to_numpy()
        return pd.DataFrame({"sid": sid[hit], "root": sid[label[hit]], "n_links": n_links[hit]})

    return run


def _joined(docs: DataFrame, similarity: float, recall: float, rows: int) -> DataFrame:
    """The columns of jaccard_join for every row, its h and sid, and lead: id and row hash of the one row its group keeps."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    signed = scratch.write(signatures(docs, bands_for(similarity, recall, rows), rows), "signatures")
    classes = signed.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("lead"), F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands"))
    classes = scratch.write(classes, "classes")
    banded = classes.select("sid", F.posexplode("bands").alias("band", "h")).select("sid", F.xxhash64("band", "h").alias("bucket"))
    leaders = banded.groupBy("bucket").agg(F.min("sid").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "leader")
    edges = banded.join(leaders, "bucket").where("sid <> leader").select(F.col("sid").alias("a"), F.col("leader").alias("b")).distinct()
    candidates = components(edges, scratch, "candidates")
    sizes = candidates.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = candidates.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.join(classes.select(F.col("sid").alias("node"), F.col("lead.h").alias("lead_h"), "n_copies"), "node")
    texts = docs.select(F.xxhash64(*docs.columns).alias("__h"), text_of("text").alias("__text")).join(members, F.col("__h") == F.col("lead_h"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            sets = [shingles(t, memo).tobytes() for t in batch.column("__text").to_pylist()]
            right = [hashlib.blake2b(s, digest_size=16).hexdigest() == sid for s, sid in zip(sets, batch.column("node").to_pylist())]
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "node", "blocks", "block", "n_copies")), pa.array(sets, pa.binary())], ["label", "sid", "blocks", "block", "n_copies", "shingles"])
            yield out.filter(pa.array(right, pa.bool_()))

    sets = texts.mapInArrow(sets_of, "label string, sid string, blocks int, block int, n_copies bigint, shingles binary").dropDuplicates(["sid"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.withColumn("o", other).withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o"))
    links = dealt.groupBy("label", "i", "j").applyInPandas(_verify(similarity), "sid string, root string, n_links bigint")
    links = scratch.write(links, "links")
    groups = components(links.select(F.col("sid").alias("a"), F.col("root").alias("b")), scratch, "links")
    totals = links.groupBy("sid").agg(F.sum("n_links").alias("n_links"))
    named = classes.select("sid", "class_id", "lead", "n_copies").join(groups.withColumnRenamed("node", "sid"), "sid", "left").join(totals, "sid", "left")
    named = named.withColumn("label", F.coalesce("label", "sid"))
    lowest = named.groupBy("label").agg(F.min("lead").alias("lead"))
    named = named.drop("lead").join(lowest, "label").select(F.col("sid").alias("__sid"), "class_id", "lead", "n_copies", (F.coalesce("n_links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    out = signed.select("doc_id", "h", "sid").join(named, F.col("sid") == F.col("__sid"), "left")
    return out.select(
        "doc_id",
        "h",
        "sid",
        "lead",
        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("lead.doc_id")).alias("group_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id with the same shingle set), group_id (smallest id in its connected
    group of links), n_copies and n_links (other documents, copies included, that it is linked with)."""
    return _joined(docs, similarity, recall, rows).drop("h", "sid", "lead")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """The documents that remain when one of each group, that with the smallest id, stays; of its repeated rows one stays.

    Rows are told apart by id and row hash: null ids come last, one id may have several texts, and each group keeps one."""
    found = _joined(docs, similarity, recall, rows)
    lead = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("h") == F.col("lead.h"))
    gone = found.where(F.col("sid").isNotNull() & ~lead).select(F.col("doc_id").alias("__gone"), F.col("h").alias("__gone_h")).distinct()
    kept = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__gone")) & (F.xxhash64(*[docs[c] for c in docs.columns]) == F.col("__gone_h")), "left_anti")
    return kept.dropDuplicates(docs.columns)

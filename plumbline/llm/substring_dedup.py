"""Exact substring deduplication: bytes covered by a 50-byte string that also starts in a document with a smaller id.

Not the method dealt, which refines q-gram buckets in rounds by the bucket identifiers at later offsets: on all suffixes its
rounds would shuffle many times the input, beyond the disk allowed. Here buckets are refined once, over sampled suffixes, and
identifiers of later offsets come from running sums in place of rounds. Equal identifiers are taken for equal bytes: windows
carry 64 and 15 hash bits, and texts of one id are told apart by 16 bits. Each 50-byte window holds at least one anchor (the smallest hash among its
26-byte grams), so only anchors are sorted into initial q-gram buckets, and buckets within one document are dropped.
Windows start out in the bucket of their smallest gram. Buckets are then refined by the bucket identifiers at other offsets:
the chain of anchors inside a run of windows and one more on either side, which covers these windows entirely. Chain
identifiers are combined from running sums that all longer chains reuse. Windows whose chain recurs are settled by it; where a
bucket splits into several chains at the same offset, the windows themselves are compared.

Defined cases: an empty table gives an empty result; other columns, whatever their names, are left out; a very long text is
held whole by one task; a null text counts as empty; texts below 50 bytes lose nothing; documents with a null id neither lose bytes
nor take any from others; rows that repeat an id are not smaller than each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_of

LENGTH, GRAM = 50, 26
SPAN = LENGTH - GRAM + 1
#: Bits of a position in `loc`, above them 16 bits that tell rows with one id apart, above those bits of a window's second hash.
_POS, _CHECK = 32, 48
_U = np.uint64


def _odd(n: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    return _mix(x) | _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _odd(256)
_BASE = _odd(4)[3]
_STEP = {n: _U(pow(int(_BASE), n, 1 << 64)) for n in (1, 2, 4, 8, 16)}
_WINDOW = _odd(2 * LENGTH + 300)[300:].reshape(2, LENGTH)


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over every run of `width` elements, by doubling."""
    have = 1
    while have < width:
        more = min(have, width - have)
        x = best(x[: len(x) - more], x[more:])
        have += more
    return x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors of one text of at least LENGTH bytes."""
    h = {1: _BYTE[data]}
    for n in (1, 2, 4, 8):
        h[2 * n] = h[n][:-n] * _STEP[n] + h[n][n:]
    n = len(data) - GRAM + 1
    grams = _mix((h[16][:n] * _STEP[8] + h[8][16 : 16 + n]) * _STEP[2] + h[2][24 : 24 + n])
    least = _slide(grams, SPAN, np.minimum)
    pad = np.zeros(SPAN - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), SPAN, np.maximum) == grams)
    return at, grams[at]


_INVERSE = pow(int(_BASE), -1, 1 << 64)
#: Powers of a base by exponent, kept by each worker up to _TABLE of them.
_TABLE = 1 << 22
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, at: np.ndarray) -> np.ndarray:
    """base ** at modulo 2 ** 64: from a table that grows by doubling, beyond it by binary digits."""
    top = int(at.max()) if len(at) else 0
    if top < _TABLE:
        table = _POWERS.get(base)
        if table is None or len(table) <= top:
            size = max(1 << 12, 1 << top.bit_length())
            table = _POWERS[base] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64))])
        return table[at]
    out, step, left = np.ones(len(at), np.uint64), base, at.astype(np.uint64)
    while left.any():
        out = np.where(left & _U(1), out * _U(step), out)
        left, step = left >> _U(1), step * step & 0xFFFFFFFFFFFFFFFF
    return out


def chains(at: np.ndarray, h: np.ndarray, own: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts that hold the same anchors: smallest gram, its least offset in the windows, identifier of the
    covering chain, first start and length. `own` makes identifiers of runs without a complete chain differ from all others."""
    edges = np.unique(np.concatenate([at + 1, np.maximum(at - SPAN + 1, 0), [0]]))
    first, stop = edges[:-1], edges[1:]
    i, k = np.searchsorted(at, first), np.searchsorted(at, first + SPAN - 1, side="right") - 1
    held = i <= k
    first, stop, i, k = first[held], stop[held], i[held], k[held]
    power = _powers(int(_BASE), at - at[0])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(h) * power, dtype=np.uint64)])
    inverse = _powers(_INVERSE, at - at[0])
    chain = lambda a, b: _mix((sums[b + 1] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
    least, where = h[i].copy(), at[i].copy()
    for d in range(1, int((k - i).max()) + 1 if len(i) else 0):
        j = np.minimum(i + d, k)
        less = h[j] < least
        least, where = np.where(less, h[j], least), np.where(less, at[j], where)
    gap = np.diff(at) <= GRAM
    whole = (i > 0) & (k + 1 < len(at))
    whole[whole] = gap[i[whole] - 1] & gap[k[whole]]
    outer = _mix(first.astype(np.uint64) * _U(0xD1B54A32D192ED03) + _U(own & 0xFFFFFFFFFFFFFFFF))
    outer[whole] = chain(i[whole] - 1, k[whole] + 1)
    return least.view(np.int64), where - stop + 1, outer.view(np.int64), first, stop - first


def _tagged(docs: DataFrame) -> DataFrame:
    """doc_id, bytes and a tag that tells rows with the same id apart."""
    text = text_of("text")
    return docs.select("doc_id", F.encode(text, "UTF-8").alias("__b"), F.shiftleft(F.xxhash64(text).bitwiseAND(F.lit(0xFFFF)), _POS).alias("__tag"))


def _by_document(rows: DataFrame, run, schema: str) -> DataFrame:
    """`run(doc_id, tag, columns)` on all rows of each document, which come in order of position."""
    tag = F.shiftright("loc", _POS)
    sorted_rows = rows.withColumn("__t", tag).repartition("doc_id", "__t").sortWithinPartitions("doc_id", "loc").drop("__t")
    names = sorted_rows.columns

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            key = np.stack([held[names.index("doc_id")], held[names.index("loc")] >> _POS])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if len(cut):
                parts = np.split(np.arange(cut[-1]), cut[:-1])
                yield from run([[x[p] for x in held] for p in parts])
                held = [x[cut[-1] :] for x in held]
        if held is not None and len(held[0]):
            yield from run([held])

    return sorted_rows.mapInArrow(stream, schema)


def _least(name: str, *keys: str) -> Column:
    return F.min(name).over(Window.partitionBy(*keys))


def _anchor_rows(tagged: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs, locs = [], [], []
            for doc_id, data, tag in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "__b", "__tag"))):
                if len(data) >= LENGTH:
                    at, h = anchors(np.frombuffer(data, np.uint8))
                    ids.append(np.full(len(at), doc_id, np.int64))
                    hs.append(h.view(np.int64))
                    locs.append(at + tag)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, ids, locs)], ["h", "doc_id", "loc"])

    return tagged.where("doc_id IS NOT NULL").mapInArrow(run, "h bigint, doc_id bigint, loc bigint")


def _chain_rows(docs: list) -> Iterator[pa.RecordBatch]:
    out: list[list[np.ndarray]] = [[], [], [], [], [], []]
    for h, doc_id, loc in docs:
        tag = int(loc[0]) >> _POS << _POS
        gram, offset, outer, first, length = chains(loc - tag, h.view(np.uint64), int(doc_id[0]) * 0x9E3779B97F4A7C15 + tag)
        for to, x in zip(out, (gram, offset, outer, np.full(len(first), doc_id[0], np.int64), first + tag, length)):
            to.append(x)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["gram", "o", "outer", "doc_id", "loc", "n"])


def _collected(ranges: DataFrame) -> DataFrame:
    """One row per document: ranges of window starts, as first + tag and length."""
    rows = ranges.select("doc_id", "loc", "n").withColumn("__t", F.shiftleft(F.shiftright("loc", _POS), _POS))
    return rows.groupBy(F.col("doc_id").alias("__id"), F.col("__t")).agg(F.collect_list("loc").alias("locs"), F.collect_list("n").alias("ns"))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, data, tag, locs, ns in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "__b", "__tag", "locs", "ns"))):
            begin, n = np.array(locs, np.int64) - tag, np.array(ns, np.int64)
            s = np.unique(np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum()))
            s = s[s <= len(data) - LENGTH]
            windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), LENGTH)
            for at in range(0, len(s), 1 << 15):
                part = s[at : at + (1 << 15)]
                x = windows[part].astype(np.uint64) + _U(1)
                w = [_mix((x * weights).sum(axis=1, dtype=np.uint64)) for weights in _WINDOW]
                loc = part + tag + ((w[1] >> _U(49)) << _U(_CHECK)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(w[0].view(np.int64)), pa.array(np.full(len(part), doc_id, np.int64)), pa.array(loc)], ["w", "doc_id", "loc"])


def removed_ranges(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, loc and n: runs of window starts whose 50 bytes also start in a document with a smaller id."""
    tagged = _tagged(docs)
    rows = _anchor_rows(tagged, "bigint")
    shared = rows.withColumn("lo", _least("doc_id", "h")).withColumn("hi", F.max("doc_id").over(Window.partitionBy("h"))).where("lo < hi").select("h", "doc_id", "loc")
    shared = scratch.write(shared, "anchors")
    runs = _by_document(shared, _chain_rows, "gram bigint, o bigint, outer bigint, doc_id bigint, loc bigint, n bigint")
    gram, offset = Window.partitionBy("gram"), Window.partitionBy("gram", "o")
    runs = runs.withColumn("lo", F.min("doc_id").over(gram)).withColumn("hi", F.max("doc_id").over(gram)).where("lo < hi")
    below = F.max(F.col("o") + F.col("n")).over(gram.orderBy("o").rangeBetween(Window.unboundedPreceding, -1))
    above = F.min("o").over(gram.orderBy(F.desc("o")).rangeBetween(Window.unboundedPreceding, -1))
    apart = (F.coalesce(below, F.col("o")) <= F.col("o")) & (F.coalesce(above, F.col("o") + F.col("n")) >= F.col("o") + F.col("n"))
    runs = runs.withColumn("splits", ~apart | (F.min("outer").over(offset) != F.max("outer").over(offset)))
    runs = runs.withColumn("first", _least("doc_id", "gram", "o", "outer")).where("doc_id > first OR splits")
    runs = scratch.write(runs.select("doc_id", "loc", "n", (F.col("doc_id") > F.col("first")).alias("settled")), "runs")
    scratch.drop("anchors")
    asked = _collected(runs.where("NOT settled"))
    texts = tagged.join(asked, (F.col("doc_id") == F.col("__id")) & (F.col("__tag") == F.col("__t"))).select("doc_id", "__b", "__tag", "locs", "ns")
    windows = texts.mapInArrow(_window_rows, "w bigint, doc_id bigint, loc bigint").repartition("w")
    windows = windows.withColumn("check", F.shiftright("loc", _CHECK)).withColumn("lo", _least("doc_id", "w", "check")).where("doc_id > lo")
    found = windows.select("doc_id", F.col("loc").bitwiseAND(F.lit((1 << _CHECK) - 1)).alias("loc"), F.lit(1).cast("bigint").alias("n"))
    return runs.where("settled").select("doc_id", "loc", "n").unionByName(scratch.write(found, "windows"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256 of every document."""
    scratch = Scratch(docs.sparkSession, "substrings")
    ranges = _collected(removed_ranges(docs, scratch))
    joined = _tagged(docs).join(ranges, (F.col("doc_id") == F.col("__id")) & (F.col("__tag") == F.col("__t")), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, tag, locs, ns in zip(*(batch.column(c).to_pylist() for c in ("__b", "__tag", "locs", "ns"))):
                if not locs:
                    rows.append((len(data), 0, 0, data))
                    continue
                begin, n = np.array(locs, np.int64) - tag, np.array(ns, np.int64)
                depth = np.zeros(len(data) + 1, np.int64)
                np.add.at(depth, begin, 1)
                np.add.at(depth, begin + n + LENGTH - 1, -1)
                gone = np.cumsum(depth)[:-1] > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            counts = [pa.array(c, pa.int64()) for c in columns[:3]]
            digests = pa.array([hashlib.sha256(x).hexdigest() for x in columns[3]], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(columns[3], pa.binary()), digests], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return joined.select("doc_id", "__b", "__tag", "locs", "ns").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")

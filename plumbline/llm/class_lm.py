"""Language-model scoring with Brown classes: exchange clustering assigns words to classes; smoothed class transitions and
word emissions give each text's log10 probability, next to an add-one unigram score.

Word counts cover every training document, and every word that occurs twice or more is clustered. Words with at least
1 / CLUSTER_SHARE of all training tokens (so at most that many) move in rounds of exchange on the bigram counts of the whole
corpus, in which all others stand by their shape. Then each of the others moves to the class that raises the bigram likelihood
most: the classes beside its places are gathered by word, a byte a neighbour, and words move in batches against the class
counts. The classes are a table; only words with at least 1 / HEAD_SHARE of the tokens travel with the tasks. Words that occur
once or never are told apart by their shape. Documents become sequences of classes, for which their rarer words meet counts
and classes in a join; transitions are counted on the training sequences, and the same sequences are scored.

Defined cases: a null or empty text has the end token only; documents with a null id are training documents; repeated rows
are scored each on its own; without training documents all counts are zero; work is linear in a text's length; of classes that
raise the likelihood equally the first is taken; an empty table gives an empty result; other columns, whatever their names,
are left out.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of

CLASSES, ROUNDS = 48, 4
CLUSTER_SHARE, HEAD_SHARE = 20_000, 300_000
#: Longest word, in bytes, that is kept with the tasks.
HEAD_BYTES = 64
END = b"\n"
TRANSITION_ADD, EMISSION_ADD = 0.5, 0.5
SHAPES = 16
_FLUSH = 150_000


def tokens(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between white space, then the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def shape(word: bytes) -> int:
    """Class number of a word that is not clustered: its length, a mark at its end, and whether it is letters only."""
    size = min(3, (len(word) - 1) // 4)
    return size * 4 + 2 * (word[-1:] in (b".", b",", b";", b":", b"!", b"?")) + (not word.strip(b".,;:!?").isalpha())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(0)) % 7 == 2


def _prepared(docs: DataFrame) -> DataFrame:
    text = text_of("text")
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text.alias("__text"))


def word_counts(prepared: DataFrame) -> DataFrame:
    """word (binary) and c over the training documents; summed within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("__text").to_pylist():
                seen.update(tokens(text))
                if len(seen) > _FLUSH:
                    yield flush()
        if seen:
            yield flush()

    return prepared.where("NOT held_out").select("__text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class _Shaped(dict):
    """Numbers of words; a word that has none gets that of its shape."""

    def __init__(self, index: dict[bytes, int]):
        super().__init__(index)
        self.index, self.base = index, len(index)

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.base + 150_000:
            self.clear()
            self.update(self.index)
        n = self[word] = self.base + shape(word)
        return n


def _bigrams(prepared: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """Counts of neighbouring word numbers; words that are not clustered count under the number of their shape."""
    base = len(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Shaped(index).__getitem__
        wide = np.int64(base + SHAPES)
        for batch in batches:
            held, n = [], 0
            for text in batch.column("__text").to_pylist():
                ids = np.array(list(map(number, tokens(text))), np.int64)
                before = np.empty_like(ids)
                before[0], before[1:] = index[END], ids[:-1]
                held.append(before * wide + ids)
                n += len(ids)
                if n > 2_000_000:
                    yield _pair_batch(held, wide)
                    held, n = [], 0
            if held:
                yield _pair_batch(held, wide)

    pairs = prepared.where("NOT held_out").select("__text").mapInArrow(run, "i int, j int, n bigint")
    return pairs.groupBy("i", "j").agg(F.sum("n").alias("n"))


def _pair_batch(held: list[np.ndarray], wide: np.int64) -> pa.RecordBatch:
    pair, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array((pair // wide).astype(np.int32)), pa.array((pair % wide).astype(np.int32)), pa.array(n)], ["i", "j", "n"])


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))  # of counts


def likelihood(n: np.ndarray) -> float:
    """The part of the bigram log-likelihood that depends on the classes."""
    return float(_f(n).sum() - _f(n.sum(axis=1)).sum() - _f(n.sum(axis=0)).sum())


def best_class(n: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, twice: float, n_free: int) -> int:
    """The class (below n_free) that gives the bigram likelihood its largest value if one word moves to it.

    n: class bigram counts; after, before: the word's counts with classes after and before it; twice: with itself."""
    s, p = after.astype(float).copy(), before.astype(float).copy()
    s[own] -= twice
    p[own] -= twice
    m = n.astype(float).copy()
    m[own, :] -= s
    m[:, own] -= p
    m[own, own] -= twice
    rows, columns = m.sum(axis=1) + p, m.sum(axis=0) + s
    gain = (_f(m + s[None, :]) - _f(m)).sum(axis=1) + (_f(m + p[:, None]) - _f(m)).sum(axis=0)
    d = np.diag(m)
    gain += _f(d + s + p + twice) - _f(d + s) - _f(d + p) + _f(d)
    gain -= _f(rows + s.sum() + twice) - _f(rows) + _f(columns + p.sum() + twice) - _f(columns)
    gain = gain[:n_free]
    return own if gain[own] >= gain.max() - 1e-9 else int(gain.argmax())


def cluster(bigrams: DataFrame, n_words: int, end: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of every word number. Words start in classes by rank; each round moves half of them by exchange, in parallel,
    against the class counts of the round before; a round that does not raise the likelihood is taken back and ends them. The
    end and the shapes keep classes of their own."""
    spark = bigrams.sparkSession
    total = classes + 1 + SHAPES
    cls = np.array([i % classes for i in range(n_words)] + [classes + 1 + k for k in range(SHAPES)])
    cls[end] = classes
    for t in range(rounds):
        table = spark.createDataFrame([(i, int(c)) for i, c in enumerate(cls)], "w int, c int")  # at most CLUSTER_SHARE rows
        left, right = (F.broadcast(table.select(F.col("w").alias(w), F.col("c").alias(c))) for w, c in (("i", "ci"), ("j", "cj")))
        both = bigrams.join(left, "i").join(right, "j")
        n = np.zeros((total, total))
        for a, b, x in both.groupBy("ci", "cj").agg(F.sum("n")).collect():
            n[a, b] = x
        now_likely = likelihood(n)
        if t and now_likely <= likely:
            return before_moves
        likely, before_moves = now_likely, cls.copy()
        after = both.select(F.col("i").alias("w"), F.col("cj").alias("c"), "n", F.lit(0).alias("side"), (F.col("i") == F.col("j")).alias("same"))
        before = both.select(F.col("j").alias("w"), F.col("ci").alias("c"), "n", F.lit(1).alias("side"), (F.col("i") == F.col("j")).alias("same"))
        moving = (F.col("w") < n_words) & (F.col("w") != end) & (F.pmod(F.xxhash64("w"), F.lit(2)) == t % 2)
        sides = after.unionByName(before).where(moving).groupBy("w", "c", "side").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("twice"))
        words = sides.groupBy("w").agg(F.collect_list(F.struct("c", "side", "n", "twice")).alias("v"))
        now = cls.copy()

        def move(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                got = []
                for w, v in zip(frame["w"], frame["v"]):
                    vec, twice = np.zeros((2, total)), 0.0
                    for x in v:
                        vec[x["side"], x["c"]] += x["n"]
                        twice += x["twice"] if x["side"] == 0 else 0
                    got.append(best_class(n, int(now[w]), vec[0], vec[1], twice, classes))
                yield pd.DataFrame({"w": frame["w"], "c": got})

        for w, c in words.mapInPandas(move, "w int, c int").collect():
            cls[w] = c
    return cls


class _Numbers(dict):
    """Numbers of words; a new one gets the next."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _contexts(prepared: DataFrame, index: dict[bytes, int], cls: np.ndarray, classes: int) -> DataFrame:
    """word and blob of the words that are not in `index`: the classes beside its places, a byte each, those behind it from 128 on.
    A task sends a word's bytes together, for over a million places at a time; rows come in the order of words."""
    base = len(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, n = _Numbers(index), [], 0

        def flush() -> pa.RecordBatch:
            words = list(memo)[base:]
            k = np.array([*cls[:base], *(classes + 1 + shape(w) for w in words)], np.uint8)
            ids = np.concatenate(held)
            at = np.flatnonzero(ids >= base)
            word = ids[at] - base
            around = np.concatenate([[k[index[END]]], k[ids], [0]])
            order = np.argsort(word, kind="stable")
            codes = np.stack([around[at], around[at + 2] + 128], axis=1).astype(np.uint8)[order]
            found, starts = np.unique(word[order], return_index=True)
            ends = np.append(starts, len(order)).astype(np.int32) * 2
            blobs = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(codes))])
            out = pa.RecordBatch.from_arrays([pa.array([words[i] for i in found], pa.binary()), blobs], ["word", "blob"])
            memo.clear()
            memo.update(index)
            held.clear()
            return out

        for batch in batches:
            for text in batch.column("__text").to_pylist():
                held.append(np.array(list(map(memo.__getitem__, tokens(text))), np.int32))
                n += len(held[-1])
                if n > 1_200_000:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    rows = prepared.where("NOT held_out").select("__text").mapInArrow(run, "word binary, blob binary")
    return rows.repartition("word").sortWithinPartitions("word")


def best_classes(n: np.ndarray, codes: np.ndarray, sizes: np.ndarray, n_free: int) -> np.ndarray:
    """The class (below n_free) of each word that raises the bigram likelihood most when it is added there. n: class bigram counts;
    codes: the classes beside the words' places (behind: from 128 on), word after word; sizes: codes of each word."""
    word = np.repeat(np.arange(len(sizes)), sizes)
    pair, count = np.unique(word * 256 + codes, return_counts=True)
    word, code = pair // 256, pair % 256
    behind, k = code >= 128, code % 128
    beside = np.concatenate([n[:, :n_free], n.T[:, :n_free]])  # by the class before, and from there on by the class behind
    at = k + len(n) * behind
    gain = _f(beside[at] + count[:, None]) - _f(beside)[at]
    gain = np.add.reduceat(gain, np.searchsorted(word, np.arange(len(sizes))), axis=0)
    side = np.zeros((2, len(sizes), n_free))
    free = k < n_free
    side[behind[free].astype(int), word[free], k[free]] = count[free]
    p, s, d = side[0], side[1], np.diag(n)[:n_free]
    gain += _f(d + s + p) - _f(d + s) - _f(d + p) + _f(d)
    c = (sizes / 2)[:, None]
    for total in (n.sum(axis=1)[:n_free], n.sum(axis=0)[:n_free]):
        gain -= _f(total + c) - _f(total)
    return gain.argmax(axis=1)


def _rare_classes(contexts: DataFrame, n: np.ndarray, classes: int) -> DataFrame:
    """word, c and k of every word of `contexts` that occurs twice or more; neighbouring rows of a word are put together."""

    def done(words: list[bytes], blobs: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(b) for b in blobs], np.int64)
        k = best_classes(n, np.frombuffer(b"".join(blobs), np.uint8).astype(np.int64), sizes, classes) if blobs else []
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(sizes // 2), pa.array(k, pa.int32())], ["word", "c", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, words, blobs = None, [], [], []

        def close() -> None:
            blob = b"".join(parts)
            if len(blob) >= 4:  # two places
                words.append(now)
                blobs.append(blob)

        for batch in batches:
            for word, blob in zip(batch.column("word").to_pylist(), batch.column("blob").to_pylist()):
                if word == now:
                    parts.append(blob)
                else:
                    close()
                    now, parts = word, [blob]
                    if len(words) >= 2_048:
                        yield done(words, blobs)
                        words, blobs = [], []
        close()
        yield done(words, blobs)

    return contexts.mapInArrow(run, "word binary, c bigint, k int")


def _class_counts(bigrams: DataFrame, cls: np.ndarray, total: int) -> np.ndarray:
    spark = bigrams.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, int(c)) for i, c in enumerate(cls)], "w int, c int"))  # at most CLUSTER_SHARE rows
    sums = bigrams.join(table.select(F.col("w").alias("i"), F.col("c").alias("ci")), "i").join(table.select(F.col("w").alias("j"), F.col("c").alias("cj")), "j")
    n = np.zeros((total, total))
    for a, b, x in sums.groupBy("ci", "cj").agg(F.sum("n")).collect():
        n[a, b] = x
    return n


def word_classes(prepared: DataFrame, counts: DataFrame, n: int, scratch: Scratch, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[dict[bytes, tuple[int, int]], DataFrame]:
    """Class and count of the frequent words, and the table (word, c, k) of all others that occur twice or more."""
    kept = counts.where(F.col("c") * CLUSTER_SHARE >= n).collect()  # at most CLUSTER_SHARE rows
    index = {bytes(r["word"]): i for i, r in enumerate(sorted((r for r in kept if r["word"] != END), key=lambda r: (-r["c"], r["word"])))}
    index[END] = len(index)
    bigrams = scratch.write(_bigrams(prepared, index), "bigrams")
    total = classes + 1 + SHAPES
    cls = cluster(bigrams, len(index), index[END], classes, rounds) if n else np.array([classes] + [classes + 1 + k for k in range(SHAPES)])
    rare = _rare_classes(_contexts(prepared, index, cls, classes), _class_counts(bigrams, cls, total), classes)
    rare = scratch.write(rare, "classes")
    scratch.drop("bigrams")
    size = {bytes(r["word"]): r["c"] for r in kept}
    return {w: (int(cls[i]), size.get(w, 0)) for w, i in index.items()}, rare


def _sequences(prepared: DataFrame, counts: DataFrame, known: dict[bytes, tuple[int, int]], rare: DataFrame, spread: np.ndarray, base_log: float, classes: int, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, n_tokens, known, b (unigram score), e (emission score) and seq (a class a byte) of every document."""
    kinds = {"n_tokens": pa.int64(), "known": pa.int64(), "b": pa.float64(), "e": pa.float64(), "seq": pa.binary(), "which": pa.binary(), "rare": pa.list_(pa.binary()), "times": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(known)}
        k_of = np.array([k for k, _ in known.values()], np.int64)
        c_of = np.array([c for _, c in known.values()], float)
        e_of, b_of = np.log10(c_of + EMISSION_ADD) - spread[k_of], np.log10(c_of + 1) - base_log
        get = number.get
        for batch in (b.slice(at, 2_000) for b in batches for at in range(0, b.num_rows, 2_000)):
            rows = []
            for text in batch.column("__text").to_pylist():
                words, own = tokens(text), _Numbers()
                seq = np.array(list(map(get, words, itertools.repeat(-1))), np.int64)
                there = seq >= 0
                ids = seq[there]
                which = np.array([own[words[i]] for i in np.flatnonzero(~there).tolist()], np.int64)
                kseq = np.full(len(seq), 255, np.uint8)
                kseq[there] = k_of[ids]
                times = np.bincount(which, minlength=len(own)).astype(np.int32)
                packed = which.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32)
                rows.append((len(seq), int((c_of[ids] > 0).sum()), float(b_of[ids].sum()), float(e_of[ids].sum()), kseq.tobytes(), packed.tobytes(), list(own), times))
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "held_out")] + [pa.array(c, t) for c, t in zip(columns, kinds.values())], ["doc_id", "held_out", *kinds])

    kind = prepared.schema["doc_id"].dataType.simpleString()
    rows = prepared.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, b double, e double, seq binary, which binary, rare array<binary>, times array<int>")
    rows = scratch.write(rows.withColumn("key", F.monotonically_increasing_id()), "documents")  # written once, so the numbers stay
    words = rows.select("key", F.posexplode(F.arrays_zip("rare", "times")).alias("i", "r")).select("key", "i", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    letters = F.regexp_replace(F.col("word").cast("string"), r"^[.,;:!?]+|[.,;:!?]+\z", "")
    met = words.join(counts, "word", "left").join(rare.select("word", "k"), "word", "left")
    met = met.withColumn("k", F.coalesce("k", F.lit(classes + 1) + _shape_column(F.col("word"), letters)))
    spread_of = F.get(F.array(*[F.lit(float(x)) for x in spread]), F.col("k"))
    found = met.groupBy("key").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known2"),
        F.sum(F.col("times") * (F.log10(c + 1.0) - F.lit(base_log))).alias("b2"),
        F.sum(F.col("times") * (F.log10(c + EMISSION_ADD) - spread_of)).alias("e2"),
        F.transform(F.sort_array(F.collect_list(F.struct("i", F.col("k").cast("tinyint").alias("k")))), lambda x: x["k"]).alias("ks"),
    )
    both = rows.drop("rare", "times").join(found, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).alias("known"), (F.col("b") + F.coalesce("b2", F.lit(0.0))).alias("b"),
        (F.col("e") + F.coalesce("e2", F.lit(0.0))).alias("e"), "seq", "which", "ks",
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for seq, which, ks in zip(*(batch.column(c).to_pylist() for c in ("seq", "which", "ks"))):
                if ks:
                    wide = np.uint16 if len(ks) <= 1 << 16 else np.uint32
                    full = np.frombuffer(seq, np.uint8).copy()
                    full[full == 255] = np.array(ks, np.uint8)[np.frombuffer(which, wide)]
                    seq = full.tobytes()
                done.append(seq)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:6]), pa.array(done, pa.binary())], [*batch.schema.names[:6], "seq"])

    filled = scratch.write(both.mapInArrow(fill, f"doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, b double, e double, seq binary"), "sequences")
    scratch.drop("documents")
    return filled


def _moves(seqs: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes before and at each place of sequences that each end in the end token, whose class also stands before the first."""
    k = np.frombuffer(b"".join(seqs), np.uint8).astype(np.int64)
    return np.concatenate([[end], k[:-1]]), k


def _transitions(sequences: DataFrame, total: int, end: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(total * total, np.int64)
        for batch in batches:
            if batch.num_rows:
                before, at = _moves(batch.column("seq").to_pylist(), end)
                n += np.bincount(before * total + at, minlength=total * total)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["pair", "n"])

    out = np.zeros(total * total)
    for pair, n in sequences.where("NOT held_out").select("seq").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n")).collect():
        out[pair] = n
    return out.reshape(total, total)


def score(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity (per token) of every document."""
    scratch = Scratch(docs.sparkSession, "class-lm")
    prepared = _prepared(docs)
    counts = scratch.write(word_counts(prepared), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    known, rare = word_classes(prepared, counts, n, scratch, classes, rounds)
    total = classes + 1 + SHAPES
    size, types = np.zeros(total), np.zeros(total)
    for k, c in known.values():
        size[k] += c
        types[k] += c > 0
    frequent = set(known)

    def shapes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = [total if w in frequent else classes + 1 + shape(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), batch.column("c")], ["k", "c"])

    once = counts.where("c = 1").mapInArrow(shapes_of, "k int, c bigint")
    for k, c, m in once.unionByName(rare.select("k", "c")).groupBy("k").agg(F.sum("c"), F.count(F.lit(1))).collect():
        if k < total:
            size[k], types[k] = size[k] + c, types[k] + m
    spread = np.log10(np.maximum(size + EMISSION_ADD * (types + 1), 1e-300))
    for r in rare.where((F.col("c") * HEAD_SHARE >= n) & (F.octet_length("word") <= HEAD_BYTES)).collect():  # at most HEAD_SHARE rows
        known[bytes(r["word"])] = (r["k"], r["c"])
    sequences = _sequences(prepared, counts, known, rare, spread, math.log10(n + v + 1), classes, scratch)
    trans = _transitions(sequences, total, classes)
    log_trans = np.log10((trans + TRANSITION_ADD) / (trans.sum(axis=1, keepdims=True) + TRANSITION_ADD * total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                seqs = batch.column("seq").to_pylist()
                starts = np.concatenate([[0], np.cumsum([len(s) for s in seqs])[:-1]])
                moves = np.add.reduceat(log_trans[_moves(seqs, classes)], starts)
                scores = batch.column("e").to_numpy() + moves
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:5]), pa.array(scores)], [*batch.schema.names[:5], "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = sequences.select("doc_id", "held_out", "n_tokens", "known", "b", "e", "seq").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, b double, score double")
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        F.col("b").alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def _shape_column(word: Column, letters: Column) -> Column:
    """`shape` as an expression."""
    n = F.octet_length(word)
    size = F.least(F.lit(3), F.floor((n - 1) / 4)).cast("int")
    mark = word.cast("string").rlike(r"[.,;:!?]\z").cast("int")
    plain = letters.rlike(r"^[a-z]+\z").cast("int")
    return size * 4 + 2 * mark + 1 - plain

"""Byte-level BPE encoding and decoding from a given vocabulary file of ranks, in Spark's higher-order functions.

Documents are dealt by hash into batches of bounded size. Spark's regular expression splits a batch's texts into words (the
matches of the vocabulary's pattern); equal words are brought together by sorting packed hashes, and each distinct word is
folded once: its bytes become pieces, and the neighbours with the lowest rank, leftmost first, are joined until no pair is in
the rank map. The map is a literal of one row, from a pair of pieces to the piece they make: an array of small maps, found by
the CRC of the pair. The plan gets it as a scalar subquery, so that the driver does not spell it out in each plan's text. The ids then go back to the words' places inside the batch, so words are never joined over a shuffle
and no word is a hot key. Decoding concatenates the binary pieces of the ids, another such literal.

A piece is one character, U+0100 and its rank, so that a word is a short string and the piece that a pair makes is also the
pair's rank. Words of more than LONG_WORD bytes take rounds that merge all places of the lowest pair at once; ids are the
same, as a pair that makes a piece always has a higher rank than the pairs within it.

Defined cases: a null or empty text has no ids and decodes to no bytes; null ids decode to no bytes, and ids out of the
vocabulary to none either; repeated rows are encoded each on its own; a column of the input that is named as the result is
replaced, others may have any name; an empty table gives an empty result. A text is held whole by one task.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, text_of

#: Small maps of the rank literal, a power of two; characters of text in a batch on average; bytes of a word that is folded
#: pair by pair; merges of the lowest ranks that are made in all distinct words of a batch at once; characters that a row
#: counts for beside its text, so that a batch has some thousands of rows at most.
BUCKETS, BATCH_CHARS, LONG_WORD, FIRST_MERGES, ROW_CHARS = 16_384, 8_000_000, 128, 64, 1_000
_POS_BITS = 28
_POS = (1 << _POS_BITS) - 1
#: Stands for the rank of a pair that makes no piece; it sorts after all pieces.
_NONE = "\U0010fffd"
#: Stands at both ends of a word.
_EDGE = "\x01"
_BASE, _SURROGATES, _GAP = 0x100, 0xD800, 0x800


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def piece_char(rank: int) -> str:
    """The character of a piece; characters that are no scalar values are left out."""
    return chr(rank + _BASE if rank + _BASE < _SURROGATES else rank + _BASE + _GAP)


def pairs_of(ranks: dict[bytes, int]) -> dict[bytes, tuple[bytes, bytes]]:
    """The two pieces that each longer piece is made of when its own bytes are merged by lower ranks."""
    out = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            lower = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank]
            if not lower:
                raise ValueError(f"piece {token!r} of rank {rank} can't be built from pieces of lower ranks")
            i = min(lower)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out[token] = (parts[0], parts[1])
    return out


class ByteBPE:
    """Encoder and decoder of one vocabulary. `pattern` splits text into words, as in the vocabulary's own library. Every
    byte must be a piece, and every longer piece be built from pieces of lower ranks, as trained vocabularies are."""

    def __init__(self, spark: SparkSession, rank_path: str, pattern: str):
        self.pattern, self.ranks = "(?U)" + pattern, load_ranks(rank_path)
        char = {token: piece_char(rank) for token, rank in self.ranks.items()}
        maps: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
        made = pairs_of(self.ranks)
        for token, (a, b) in made.items():
            pair = char[a] + char[b]
            maps[zlib.crc32(pair.encode()) % BUCKETS][pair] = char[token]
        lowest = sorted(made, key=self.ranks.get)[:FIRST_MERGES]
        first = [{"pair": "".join(char[x] for x in made[token]), "piece": char[token]} for token in lowest]
        pieces = [""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            pieces[rank] = token.decode("latin-1")
        self.byte_chars = "".join(char[bytes([b])] for b in range(256))
        self._first = json.dumps({"v": first})
        rows = pa.array([[list(m.items()) for m in maps]], pa.list_(pa.map_(pa.string(), pa.string())))
        self._maps = spark.createDataFrame(pa.table({"v": rows}))
        self._pieces = spark.createDataFrame(pa.table({"v": pa.array([pieces], pa.list_(pa.string()))}))

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def ids_of_words(self, words: Column, maps: Column) -> Column:
        """An array of ids for each of some distinct words."""
        by_byte = F.transform(words, lambda w: F.translate(F.decode(w.cast("binary"), "ISO-8859-1"), "".join(map(chr, range(256))), self.byte_chars))
        first = F.from_json(F.lit(self._first), "v array<struct<pair:string,piece:string>>")["v"]
        begun = F.aggregate(first, F.array_join(by_byte, _EDGE), lambda acc, m: F.replace(acc, m["pair"], m["piece"]))
        found = lambda pair: F.try_element_at(F.get(maps, F.crc32(pair.cast("binary")).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), pair)
        made = lambda pair: F.coalesce(found(pair), F.lit(_NONE))
        fold = lambda p: F.when(F.length(p) < 4, p).when(F.length(p) <= LONG_WORD, _merge_pairs(p, made)).otherwise(_merge_rounds(p, made))
        merged = lambda w: F.btrim(let(F.concat(F.lit(_EDGE), w, F.lit(_EDGE)), fold), F.lit(_EDGE))
        rank = lambda c: F.when(c < _SURROGATES, c - _BASE).otherwise(c - _BASE - _GAP)
        return F.transform(F.split(begun, _EDGE), lambda w: F.transform(F.split(merged(w), ""), lambda c: rank(F.ascii(c))))

    def encode(self, docs: DataFrame, text: str = "text", out: str = "token_ids", batch_chars: int = BATCH_CHARS) -> DataFrame:
        """`docs` with an array of ids, in place of any column of that name. Smaller batches take less memory and more time."""
        docs = docs.drop(out)
        row = F.struct(*docs.columns)
        n = F.ceil(docs.agg(F.sum(F.coalesce(F.length(text), F.lit(0)) + ROW_CHARS)).scalar() / batch_chars)
        number = F.xxhash64(F.monotonically_increasing_id())  # not of the text: copies would meet in one batch
        batches = docs.select(row.alias("d"), F.pmod(number, F.greatest(F.lit(1), n)).alias("b"))
        batches = batches.repartition("b").groupBy("b").agg(F.collect_list("d").alias("d"))
        split = batches.select(F.col("d").alias("rows"), F.transform("d", lambda d: self.words(text_of(d[text]))).alias("words"))
        flat = split.select("rows", F.transform("words", F.size).alias("n"), F.flatten("words").alias("w"))
        runs = flat.withColumn("s", _packed("w")).withColumn("f", _first_of_runs("w", "s"))
        distinct = F.transform("f", lambda j: _word_at(F.col("w"), F.get("s", j)))
        runs = runs.withColumn("maps", self._maps.scalar())
        placed = runs.select("rows", "n", _places("s", "f").alias("at"), let(F.col("maps"), lambda m: self.ids_of_words(distinct, m)).alias("ids"))
        ends = F.aggregate("n", F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        in_place = lambda i, n, e, ids: F.flatten(F.transform(F.slice("at", F.get(e, i) + 1, n), lambda k: F.get(ids, k)))
        cut = let(ends, lambda e: let(F.col("ids"), lambda ids: F.transform("n", lambda n, i: in_place(i, n, e, ids))))
        each = placed.select(F.explode(F.arrays_zip(F.col("rows").alias("r"), cut.alias("i"))).alias("z"))
        return each.select(*[F.col("z.r")[c].alias(c) for c in docs.columns], F.col("z.i").alias(out))

    def decode(self, rows: DataFrame, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
        """`rows` with the bytes of an array of ids: its binary pieces, joined."""
        pieces = "_" * (1 + max(map(len, [*rows.columns, out])))  # a name of its own
        joined = let(F.col(pieces), lambda p: F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(p, i), F.lit(""))), ""))
        decoded = F.coalesce(F.encode(joined, "ISO-8859-1"), F.lit(b""))
        return rows.withColumn(pieces, self._pieces.scalar()).withColumn(out, decoded).drop(pieces)


def _word_at(words: Column, packed: Column) -> Column:
    return F.get(words, packed.bitwiseAND(F.lit(_POS)).cast("int"))


def _packed(words: str) -> Column:
    """Hash bits of each word above its place, sorted: equal words are neighbours, unless others share their bits."""
    return F.sort_array(F.transform(words, lambda w, i: F.xxhash64(w).bitwiseAND(F.lit(~_POS)).bitwiseOR(i.cast("bigint"))))


def _first_of_runs(words: str, packed: str) -> Column:
    """Numbers in `packed` where a run of equal words begins."""
    word = lambda j: _word_at(F.col(words), F.get(packed, j))
    numbers = F.sequence(F.lit(0), F.size(packed) - 1)
    return F.when(F.size(packed) == 0, F.array().cast("array<int>")).otherwise(F.filter(numbers, lambda j: (j == 0) | (word(j) != word(j - 1))))


def _places(packed: str, first: str) -> Column:
    """The run of the word at each place."""
    stop = lambda k: F.coalesce(F.get(first, k + 1), F.size(packed)) - 1
    place = lambda j, k: F.shiftleft(F.get(packed, j).bitwiseAND(F.lit(_POS)), _POS_BITS).bitwiseOR(k.cast("bigint"))
    owners = F.flatten(F.transform(first, lambda j, k: F.transform(F.sequence(j, stop(k)), lambda x: place(x, k))))
    return F.transform(F.sort_array(owners), lambda o: o.bitwiseAND(F.lit(_POS)).cast("int"))


def _pairs(pieces: Column, made: Callable[[Column], Column]) -> Column:
    """What the neighbours of a string of pieces make, as a string."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(pieces) - 1), lambda i: made(F.substr(pieces, i, F.lit(2)))), "")


def _lowest(acc: Column) -> Column:
    """Place of the leftmost pair of the lowest rank; 1, where an edge stands, if no pair makes a piece."""
    return F.instr(acc["r"], F.array_min(F.split(acc["r"], "")))


def _merge_pairs(word: Column, made: Callable[[Column], Column]) -> Column:
    """The pieces of a word between edges: a fold whose steps each join the leftmost pair of the lowest rank."""

    def step(acc: Column, _: Column) -> Column:
        def join(i: Column) -> Column:
            p, r = acc["p"], acc["r"]
            piece = F.substr(r, i, F.lit(1))
            around = F.concat(made(F.concat(F.substr(p, i - 1, F.lit(1)), piece)), made(F.concat(piece, F.substr(p, i + 2, F.lit(1)))))
            joined = F.struct(F.overlay(p, piece, i, F.lit(2)).alias("p"), F.overlay(r, around, i - 1, F.lit(3)).alias("r"))
            return F.when(i == 1, acc).otherwise(joined)

        return let(_lowest(acc), join)

    start = F.struct(word.alias("p"), _pairs(word, made).alias("r"))
    return F.aggregate(F.sequence(F.lit(4), F.length(word)), start, step, lambda acc: acc["p"])


def _merge_rounds(word: Column, made: Callable[[Column], Column]) -> Column:
    """The pieces of a long word between edges: a fold whose rounds each join all places of the pair of the lowest rank."""

    def step(acc: Column, _: Column) -> Column:
        def join(i: Column) -> Column:
            joined = F.replace(acc["p"], F.substr(acc["p"], i, F.lit(2)), F.substr(acc["r"], i, F.lit(1)))
            return let(joined, lambda p: F.struct(p.alias("p"), _pairs(p, made).alias("r"), F.lit(False).alias("done")))

        at = lambda i: F.when(i == 1, F.struct(acc["p"], acc["r"], F.lit(True).alias("done"))).otherwise(join(i))
        return F.when(acc["done"], acc).otherwise(let(_lowest(acc), at))

    start = F.struct(word.alias("p"), _pairs(word, made).alias("r"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(4), F.length(word)), start, step, lambda acc: acc["p"])

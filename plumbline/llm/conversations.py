"""Conversation structure repair: signatures of role and fault sequences, each distinct one solved once.

Rows are written once in the order of their conversations, over ranges of (conversation, turn, role, text), so that a large
conversation spans many tasks. A row becomes one character: its role's initial, a capital if the text is truncated, x if it
must go. Blocks of BLOCK rows become strings and these the signature of the conversation, one byte a row, as its audit is.
Each distinct signature is solved once, by a recursion over its halves that remembers what it knows of short pieces; audits
are joined back, and edits are replayed over the rows of each conversation in order, a row at a time.

The cost of a piece is a table of the least cost between any two states (nothing yet, after the system row, after a user row,
after a pair), and tables of neighbours combine, so the work is linear in the length. From a state each edit leads to one
other state; hence the least letter among edits that stay cheapest gives the ASCII-least audit.

Defined cases: null roles and texts are one space, whose initial is none of the three; null ids form one conversation; null
turns come first; rows of one turn are ordered by role and text; equal rows are counted before they are ordered, the first
one may stay and the rest are duplicates; a digest is sequential, so a conversation's texts pass one task, a row at a time;
an empty table gives an empty result; gaps beyond 64 bits are null; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch

#: Rows whose codes one group joins, as a power of two; longest piece of a signature that is remembered.
BLOCK_BITS, REMEMBER = 12, 256
KEYS = ("conv_id", "turn", "role", "text")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

# The states are 0 (nothing yet), 1 (after the system row), 2 (after a user row) and 3 (after a pair).
_FAR = 1 << 60
#: Cost and edits that end a conversation from each state.
_END = ((0, ""), (4, "II"), (2, "I"), (0, ""))


def _options(state: int, code: str) -> list[tuple[int, str, int]]:
    """Cost, edits and next state of every way to pass one row, after up to two inserted ones."""
    out, cut = [], int(code.isupper())
    for n in range(3):
        paid, edits, turn = 2 * n, "I" * n, 3 if state == 2 else 2
        out.append((paid + 3, edits + "D", state))
        if code != "x":
            out.append((paid + 2 + cut, edits + "R", turn))
            if code in "sS" and state == 0:
                out.append((paid + cut, edits + "K", 1))
            elif code in "uU" and turn == 2 or code in "aA" and turn == 3:
                out.append((paid + cut, edits + "K", turn))
        state = turn
    return out


def _halves(sig: str) -> tuple[str, str]:
    """The left part is as long as a power of two, so that pieces of long signatures recur."""
    at = 1 << ((len(sig) - 1).bit_length() - 1)
    return sig[:at], sig[at:]


def _costs(sig: str) -> tuple[tuple[int, ...], ...]:
    return _short_costs(sig) if len(sig) <= REMEMBER else _find_costs(sig)


def _find_costs(sig: str) -> tuple[tuple[int, ...], ...]:
    """Least cost from each state to each state over the rows of a signature."""
    if len(sig) == 1:
        return tuple(tuple(min([c for c, _, to in _options(a, sig) if to == b], default=_FAR) for b in range(4)) for a in range(4))
    left, right = map(_costs, _halves(sig))
    return tuple(tuple(min(left[a][m] + right[m][b] for m in range(4)) for b in range(4)) for a in range(4))


def _edits(sig: str, state: int, ends: tuple[int, ...]) -> tuple[str, int]:
    """The cheapest edits from a state, ASCII-least, and the state after them; ends: what it costs to go on from each state."""
    low = min(ends)
    ends = tuple(e - low for e in ends)
    return _short_edits(sig, state, ends) if len(sig) <= REMEMBER else _find_edits(sig, state, ends)


def _find_edits(sig: str, state: int, ends: tuple[int, ...]) -> tuple[str, int]:
    if len(sig) == 1:
        _, edits, to = min((c + ends[to], e, to) for c, e, to in _options(state, sig))
        return edits, to
    left, right = _halves(sig)
    first, state = _edits(left, state, tuple(min(c + e for c, e in zip(row, ends)) for row in _costs(right)))
    second, state = _edits(right, state, ends)
    return first + second, state


@lru_cache(100_000)
def _short_costs(sig: str) -> tuple[tuple[int, ...], ...]:
    return _find_costs(sig)


@lru_cache(100_000)
def _short_edits(sig: str, state: int, ends: tuple[int, ...]) -> tuple[str, int]:
    return _find_edits(sig, state, ends)


def solve(sig: str) -> tuple[int, str]:
    """Cost and audit of a signature."""
    if not sig:
        return 0, ""
    ends = tuple(c for c, _ in _END)
    edits, state = _edits(sig, 0, ends)
    return min(c + e for c, e in zip(_costs(sig)[0], ends)), edits + _END[state][1]


def damage(rows: DataFrame) -> DataFrame:
    """Rows by crc32 of `conv_id:turn` modulo 20: 0 is dropped, 1 loses its text, 2 its marks `.!?`, 3 comes twice, 4 is a user's."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fate") == 3, 2).otherwise(1)
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"))
    return rows.drop("copy")


def _ordered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct rows with their number m, their place in the global order, and what their codes need."""
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in KEYS[2:]])
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    return scratch.write(
        rows.groupBy(*KEYS)
        .agg(F.count(F.lit(1)).alias("m"))
        .repartitionByRange(*KEYS)
        .sortWithinPartitions(*KEYS)
        .select(
            *KEYS,
            "m",
            F.monotonically_increasing_id().alias("place"),
            F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
            (bare == "").alias("blank"),
            (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
            F.sha2("text", 256).alias("digest"),
        ),
        "rows",
    )


def _signatures(rows: DataFrame) -> DataFrame:
    """Of each conversation: signature, gaps and counts of faults."""
    firsts = rows.where(~F.col("blank")).groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    told = rows.drop("role", "text", "digest").join(firsts, "place", "left").withColumn("kept", F.col("first").isNotNull())
    code = F.when(~F.col("kept"), "x").when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))
    more = (F.col("m") - 1).cast("int")
    one = F.struct("place", F.concat(code, F.repeat(F.lit("x"), more)).alias("code"), F.repeat(F.col("initial"), more + 1).alias("initials"))
    faults = {
        "blank": F.when(F.col("blank"), F.col("m")).otherwise(0),
        "duplicate": F.when(F.col("blank"), 0).otherwise(F.col("m") - F.col("kept").cast("int")),
        "truncated": (F.col("kept") & F.col("cut")).cast("bigint"),
    }
    joined = lambda c, field: F.array_join(F.transform(c, lambda x: x[field]), "")
    blocks = (
        told.groupBy("conv_id", F.shiftright("place", BLOCK_BITS).alias("block"))
        .agg(
            F.sort_array(F.collect_list(one)).alias("list"),
            F.min("turn").alias("low"),
            F.max("turn").alias("high"),
            F.size(F.collect_set("turn")).alias("turns"),
            *[F.sum(v).alias(k) for k, v in faults.items()],
        )
        .withColumns({"code": joined("list", "code"), "initials": joined("list", "initials")})
        .drop("list")
    )
    whole = blocks.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("block", "code", "initials", "low", "high", "turns"))).alias("list"), *[F.sum(k).alias(k) for k in faults]
    )
    shared = F.size(F.filter("list", lambda x, i: (i > 0) & (x["low"] == F.get("list", i - 1)["high"])))
    turns = F.aggregate("list", F.lit(0).cast("bigint"), lambda n, x: n + x["turns"]) - shared
    wide = lambda c: c.cast("decimal(20,0)")
    gaps = wide(F.array_max(F.transform("list", lambda x: x["high"]))) - wide(F.array_min(F.transform("list", lambda x: x["low"]))) + 1 - turns
    initials = joined("list", "initials")
    return whole.select(
        "conv_id",
        joined("list", "code").alias("sig"),
        F.when(turns == 0, F.lit(0).cast("bigint")).otherwise(gaps.try_cast("bigint")).alias("gaps"),
        *faults,
        (F.length(initials) - 1 - F.regexp_count(initials, F.lit("(?=su|ua|au)"))).cast("bigint").alias("illegal"),
    )


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([(s, *solve(s)) for s in batch["sig"]], columns=["sig", "cost", "audit"])


class _Replay:
    """The edits of one conversation over its rows, into a digest."""

    def __init__(self, head: tuple, audit: str):
        self.head, self.audit, self.at, self.n, self.any = head, audit, 0, 0, False
        self.sha = hashlib.sha256()

    def say(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) * self.any}{role}:{text}".encode())
        self.any = True

    def turn(self, text: str) -> None:
        self.say("assistant" if self.n % 2 else "user", text)
        self.n += 1

    def insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.turn("")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.turn(text)
        elif edit == "K":
            self.say(role, text)
            self.n += role[:1] != "s"

    def result(self) -> tuple:
        self.insert()
        return (*self.head, self.audit, self.sha.hexdigest())


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Of each conv_id among rows or `ids`: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "conversations")
    ordered = _ordered(rows, scratch)
    told = scratch.write(_signatures(ordered), "signatures")
    solved = told.select("sig").distinct().mapInPandas(_solved, "sig string, cost bigint, audit string")
    heads = told.join(solved, "sig").select("conv_id", *COUNTS, "audit")
    if ids is not None:
        every = ids.select(F.col("conv_id").alias("__id")).distinct()
        zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in COUNTS if c != "gaps"]
        found = F.col("audit").isNotNull()
        gaps = F.when(found, F.col("gaps")).otherwise(0).alias("gaps")
        heads = every.join(heads, F.col("__id").eqNullSafe(F.col("conv_id")), "left").select(F.col("__id").alias("conv_id"), gaps, *zero, F.coalesce("audit", F.lit("")).alias("audit"))
    none = lambda t: F.lit(None).cast(t)
    heads = heads.select("conv_id", F.lit(-1).cast("bigint").alias("place"), none("bigint").alias("m"), none("string").alias("role"), none("string").alias("text"), *COUNTS, "audit")
    lines = ordered.select("conv_id", "place", "m", "role", "text", *[none("bigint").alias(c) for c in COUNTS], none("string").alias("audit"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    out = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, schema = None, None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("conv_id").with_nullable(True), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            done, columns = [], {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for i, place in enumerate(columns["place"]):
                if place < 0:
                    done += [now.result()] if now else []
                    now = _Replay(tuple(columns[c][i] for c in ("conv_id", *COUNTS)), columns["audit"][i])
                else:
                    for _ in range(columns["m"][i]):
                        now.row(columns["role"][i], columns["text"][i])
            yield pa.RecordBatch.from_pylist([dict(zip(out, r)) for r in done], schema=schema)
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(out, now.result()))], schema=schema)

    together = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return together.mapInArrow(replay, f"conv_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string")

"""Whitening of embeddings: Welford moments in partition iterators, merged by the parallel formula, then symmetric QR.

Vectors become integers, floor(256 * c). The fit list holds each distinct integer vector once. Tasks add its rows one after
another to a count, a mean and a sum of products, by Welford's rank-one updates; those of an Arrow batch telescope into one
matrix product. States of tasks, one row for each dimension length, are merged in rounds of FAN, so no task or driver gathers
them all; the last merge solves for eigenvectors. Only the model, (k + 2) d numbers, goes to the driver and back to the tasks.

Means and products are relative to an integer row of the partition, so that a large common offset costs no precision; sums
are exact integers.

Defined cases: vectors that are null or hold null or non-finite entries are dropped, as are empty ones; a null id is kept as
it is; repeated rows come out each, and equal vectors count once in the fit; vectors of different lengths are fitted apart;
components beyond 2 ** 61 after scaling are cut to the bound; where an eigenvalue is zero (equal vectors, or fewer vectors
than components) `whitened` is null, and where all are zero `explained` and `identity_error` are null too; a deviation beyond
64 bits is null; equal eigenvalues share their plane, whose basis is one of many, the same for all rows; an empty table gives
an empty result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: States that one merge reads at most; rows that one matrix product adds at most.
FAN, BLOCK = 64, 1_024
BOUND = 1 << 61
#: Eigenvalues below this share of the trace count as zero.
ZERO = 1e-13
_STATE = "dim int, part bigint, n bigint, shift binary, mean binary, m2 binary, high binary, low binary"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]


class Moments:
    """Count, mean and centred products of rows, about an integer row `shift`; exact sums in two halves."""

    def __init__(self, dim: int):
        self.n, self.shift = 0, np.zeros(dim, np.int64)
        self.mean, self.m2 = np.zeros(dim), np.zeros((dim, dim))
        self.high, self.low = np.zeros(dim, np.int64), np.zeros(dim, np.int64)

    def add(self, x: np.ndarray) -> None:
        """Welford's updates for the rows of x: with the means before and after each row, the rank-one products of a block
        are one product of two matrices."""
        whole = x.dtype == np.int64
        if whole:
            if not self.n:
                self.shift = x[0].copy()
            self.high += (x >> 32).sum(axis=0)
            self.low += (x & 0xFFFFFFFF).sum(axis=0)
        for at in range(0, len(x), BLOCK):
            rows = x[at : at + BLOCK]
            apart = (rows - self.shift).astype(float) - self.mean if whole else rows - self.mean
            after = np.cumsum(apart, axis=0) / (self.n + np.arange(1.0, len(rows) + 1))[:, None]
            before = np.vstack([np.zeros(after.shape[1]), after[:-1]])
            self.m2 += (apart - before).T @ (apart - after)
            self.mean += after[-1]
            self.n += len(rows)

    def merge(self, other: Moments) -> None:
        if not other.n:
            return
        if not self.n:
            self.__dict__ |= {k: v.copy() if isinstance(v, np.ndarray) else v for k, v in other.__dict__.items()}
            return
        n = self.n + other.n
        apart = (other.shift - self.shift).astype(float) + (other.mean - self.mean)
        self.m2 += other.m2 + np.outer(apart, apart) * (self.n / n * other.n)
        self.mean += apart * (other.n / n)
        self.high, self.low, self.n = self.high + other.high, self.low + other.low, n

    def covariance(self) -> np.ndarray:
        return (self.m2 + self.m2.T) / (2 * self.n)

    def sums(self) -> list[int]:
        return [(int(h) << 32) + int(x) for h, x in zip(self.high, self.low)]

    def row(self, part: int) -> tuple:
        return (len(self.mean), part, self.n, *(getattr(self, c).tobytes() for c in _NAMES[3:]))

    @classmethod
    def of(cls, row) -> Moments:
        out = cls(row.dim)
        out.n = int(row.n)
        for c in _NAMES[3:]:
            kind = np.float64 if c in ("mean", "m2") else np.int64
            setattr(out, c, np.frombuffer(getattr(row, c), kind).reshape((row.dim, row.dim) if c == "m2" else row.dim).copy())
        return out


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, the largest entry of each positive: Householder reflections to
    tridiagonal form, then implicit QR steps with Wilkinson's shift on its unreduced blocks."""
    n = len(a)
    a, q = np.array(a, float), np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0 or not np.any(v[1:]):
            continue
        v[0] += math.copysign(size, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -math.copysign(size, v[0])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    d, e, q = np.diag(a).copy(), np.diag(a, -1).copy(), q.T.copy()
    last, steps = n - 1, 0
    while last > 0:
        small = np.abs(e[:last]) <= np.finfo(float).eps * (np.abs(d[:last]) + np.abs(d[1 : last + 1])) + np.finfo(float).tiny
        e[:last][small] = 0
        if e[last - 1] == 0:
            last, steps = last - 1, 0
            continue
        first = int(np.flatnonzero(e[:last] == 0)[-1]) + 1 if (e[:last] == 0).any() else 0
        steps += 1
        if steps > 100 * n:
            raise ArithmeticError("QR steps do not converge")
        half = (d[last - 1] - d[last]) / 2
        far = half + math.copysign(math.hypot(half, e[last - 1]), half)
        x, z = d[first] - (d[last] - e[last - 1] * (e[last - 1] / far)), e[first]
        for k in range(first, last):
            r = math.hypot(x, z)
            c, s = (x / r, -z / r) if r else (1.0, 0.0)
            if k > first:
                e[k - 1] = r
            p, m, o = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * p - 2 * c * s * o + s * s * m, s * s * p + 2 * c * s * o + c * c * m
            e[k] = c * s * (p - m) + (c * c - s * s) * o
            if k < last - 1:
                x, z = e[k], -s * e[k + 1]
                e[k + 1] *= c
            q[[k, k + 1]] = np.array([[c, -s], [s, c]]) @ q[[k, k + 1]]
    order = np.argsort(-d, kind="stable")
    v = q[order].T
    return d[order], v * np.where(v[np.abs(v).argmax(axis=0), np.arange(n)] < 0, -1.0, 1.0)


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The key and x, floor(256 * c) of each entry c, of every usable vector."""
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    scaled = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * 256.0, F.lit(float(BOUND))), F.lit(-float(BOUND)))))
    return vectors.where((F.size(vector) > 0) & usable).select(key, scaled.alias("x"))


def _by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and their matrix, for each length among the lists."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def _moments(value):
    """Task function: one state of `value(x)` for each dimension length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, Moments] = {}
        for batch in batches:
            for _, x in _by_length(batch.column("x")):
                y = value(x)
                if y is not None:
                    states.setdefault(x.shape[1], Moments(y.shape[1])).add(y)
        part = TaskContext.get().partitionId()
        rows = [(d, *s.row(part)[1:], s.row(part)[0]) for d, s in states.items()]
        yield pa.RecordBatch.from_pylist([dict(zip([*_NAMES, "width"], r)) for r in rows], schema=_ARROW)

    return run


_ARROW = pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in _NAMES[3:]), ("width", pa.int32())])
_STATES = f"{_STATE}, width int"


def _merged(rows: pd.DataFrame) -> Moments:
    total = None
    for r in rows.sort_values("part").rename(columns={"dim": "key", "width": "dim"}).itertuples():
        one = Moments.of(r)
        if total is None:
            total = one
        else:
            total.merge(one)
    return total


def _merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = _merged(rows)
    width, part, *rest = total.row(int(key[1]))
    return pd.DataFrame([(int(key[0]), part, *rest, width)], columns=[*_NAMES, "width"])


def _gather(scratch: Scratch, states: DataFrame, name: str) -> DataFrame:
    """States merged in rounds, those of FAN neighbouring tasks at a time, until each dimension length has FAN at most."""
    states, level = scratch.write(states, f"{name}0"), 0
    while (states.groupBy("dim").count().agg(F.max("count")).first()[0] or 0) > FAN:
        level += 1
        merged = states.groupBy("dim", F.expr(f"part div {FAN}").alias("group")).applyInPandas(_merge, _STATES)
        states = scratch.write(merged, f"{name}{level}")
        scratch.drop(f"{name}{level - 1}")
    return states


def fit(distinct: DataFrame, scratch: Scratch, k: int = 4) -> dict[int, dict]:
    """Model of each dimension length: n, sums, components (columns), values and the trace; distinct has x once each."""

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = _merged(rows)
        v = total.covariance()
        values, vectors = symmetric_qr(v)
        top = vectors[:, :k]
        return pd.DataFrame([(int(key[0]), total.n, [str(s) for s in total.sums()], top.tobytes(), values[:k].tolist(), float(np.trace(v)))], columns=["dim", "n", "sums", "components", "values", "trace"])

    states = _gather(scratch, distinct.mapInArrow(_moments(lambda x: x), _STATES), "states")
    solved = states.groupBy("dim").applyInPandas(solve, "dim int, n bigint, sums array<string>, components binary, values array<double>, trace double")
    models = {}
    for r in solved.collect():
        values = np.array(r["values"])
        models[r["dim"]] = {
            "n": r["n"], "sums": [int(s) for s in r["sums"]], "components": np.frombuffer(r["components"]).reshape(r["dim"], -1),
            "values": np.where(values > ZERO * r["trace"], values, 0.0), "trace": r["trace"],
        }
    return models


def _whitened(x: np.ndarray, model: dict) -> np.ndarray:
    """(x - S/n) on the components with an eigenvalue above zero, to unit variance."""
    floor = np.array([s // model["n"] for s in model["sums"]], np.int64)
    rest = np.array([(s % model["n"]) / model["n"] for s in model["sums"]])
    live = model["values"] > 0
    return (((x - floor).astype(float) - rest) @ model["components"][:, live]) / np.sqrt(model["values"][live])


def _deviations(x: np.ndarray, model: dict) -> list[int | None]:
    """Sum of (n x - S) ** 2 over the dimensions, exact; None beyond 64 bits."""
    n, sums = model["n"], model["sums"]
    floor, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    apart = x - floor
    if x.shape[1] * (float(np.abs(apart).max()) * n + n) ** 2 < 2.0**62:
        return ((apart * n - rest) ** 2).sum(axis=1).tolist()
    exact = (sum((a * n - r) ** 2 for a, r in zip(row, rest.tolist())) for row in apart.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, k: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each usable row and each component up to k: n, deviation, whitened, explained and identity_error."""
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = integer_vectors(vectors, key, vector)
    distinct = scratch.write(rows.select("x").distinct(), "distinct")
    models = fit(distinct, scratch, k)

    def live(x: np.ndarray) -> np.ndarray | None:
        model = models[x.shape[1]]
        return _whitened(x, model) if (model["values"] > 0).any() else None

    def error(key: tuple, states: pd.DataFrame) -> pd.DataFrame:
        c = _merged(states).covariance()
        return pd.DataFrame([(int(key[0]), float(np.abs(c - np.eye(len(c))).max()))], columns=["dim", "error"])

    unit = _gather(scratch, distinct.mapInArrow(_moments(live), _STATES), "unit")
    errors = {r["dim"]: r["error"] for r in unit.groupBy("dim").applyInPandas(error, "dim int, error double").collect()}
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_length(batch.column("x")):
                model = models[x.shape[1]]
                shown, alive = len(model["values"]), int((model["values"] > 0).sum())
                white = np.full((len(x), shown), np.nan)
                white[:, :alive] = _whitened(x, model)
                each = lambda values, t: pa.array(np.tile(values, len(x)), t, from_pandas=True)
                share = model["values"] / model["trace"] if alive else np.full(shown, np.nan)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key).take(pa.array(np.repeat(at, shown))), each(np.arange(1, shown + 1), pa.int32()), each([model["n"]] * shown, pa.int64()),
                        pa.array(_deviations(x, model), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), shown))),
                        pa.array(white.ravel(), pa.float64(), from_pandas=True), each(share, pa.float64()), each([errors.get(x.shape[1], math.nan)] * shown, pa.float64()),
                    ],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(apply, schema)

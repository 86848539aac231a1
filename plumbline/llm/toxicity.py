"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector shared by all ordered thresholds. Features are words and
word prefixes; Spark selects them on all sampled labelled documents, the model is fitted on that bounded sample, and every
whole text is scored in Arrow batches.

Defined cases: a null or empty text has no features; labels with a null id or grade are ignored and, of repeated labels,
the highest grade counts; without labels, or with one grade only, every document has severity 0; repeated rows are scored
each on its own; an empty table gives an empty result; other columns may have any name; a very long text is held whole by
one task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_per_key, sample_gate, text_of

#: Largest expected number of labelled documents in the fit, and the number of features kept.
FIT_ROWS = 12_000
N_FEATURES = 4_000
#: Least log-likelihood ratio of a feature between the two sides of grade 0, and the penalty on squared weights.
MIN_GAIN, L2 = 12.0, 0.3
PREFIXES = (4, 5, 6)
#: Mentions of one sure feature from which a document labelled toxic has grade 2 and 3. They are not divided by the text's
#: length: that was tried (1 and 3 mentions per 100 words) and found 53 instead of over 70 of 100 held-out toxic documents.
MENTIONS = (3, 6)
WORD = re.compile(r"\w+")
_MEMO = 100_000


@dataclass
class OrdinalModel:
    """Weights by feature and ordered thresholds; grades run from 0 to len(thresholds)."""

    weights: dict[str, float]
    thresholds: list[float]


def features_of(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n))


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, counts = [], []
        for text in batch.column("__text").to_pylist():
            c: Counter = Counter()
            for word, n in Counter(WORD.findall(text.lower())).items():
                for f in features_of(word):
                    c[f] += n
            names.append(list(c))
            counts.append(list(c.values()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("grade"), pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "grade", "names", "counts"]
        )


def _fit_ordinal(rows: list[tuple[int, list[int], list[int]]], n_features: int, n_grades: int, l2: float = L2, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Penalised maximum likelihood by Adam over the sparse rows; thresholds stay ordered as a base plus positive gaps."""
    y = np.array([r[0] for r in rows])
    index = np.concatenate([np.array(r[1], dtype=np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    x = np.log1p(np.concatenate([np.array(r[2], dtype=float) for r in rows])) if rows else np.zeros(0)
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    share = np.cumsum(np.bincount(y, minlength=n_grades))[:-1] / len(y)
    first = np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    params = np.concatenate([np.zeros(n_features), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    for t in range(1, steps + 1):
        w, base, gaps = params[:n_features], params[n_features], np.exp(params[n_features + 1 :])
        theta = np.concatenate([[base], base + np.cumsum(gaps)])
        eta = np.bincount(owner, weights=w[index] * x, minlength=len(rows))
        bounds = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = sigmoid(bounds[y + 1] - eta), sigmoid(bounds[y] - eta)
        hi, lo = np.where(y + 1 == n_grades, 1.0, hi), np.where(y == 0, 0.0, lo)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_eta = d_hi - d_lo
        g_theta = -np.bincount(np.minimum(y, n_grades - 2), weights=np.where(y < n_grades - 1, d_hi, 0), minlength=n_grades - 1)
        g_theta += np.bincount(np.maximum(y - 1, 0), weights=np.where(y > 0, d_lo, 0), minlength=n_grades - 1)
        g = np.concatenate([np.bincount(index, weights=g_eta[owner] * x, minlength=n_features) + l2 * w, [g_theta.sum()], [g_theta[k:].sum() * gaps[k - 1] for k in range(1, n_grades - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    base, gaps = params[n_features], np.exp(params[n_features + 1 :])
    return params[:n_features], np.concatenate([[base], base + np.cumsum(gaps)])


def fit(docs: DataFrame, labels: DataFrame, grade: str = "toxic", fit_rows: int = FIT_ROWS, n_features: int = N_FEATURES, mentions: tuple[int, ...] = MENTIONS) -> OrdinalModel:
    """Fit on about `fit_rows` labelled documents at most, chosen by a hash of their id; of an id with several texts the least
    text counts, so repeated rows don't weigh. Grades below 0 count as 0, and gaps between grades are closed up.

    A column of 0 and 1 is refined by `mentions`: the grade of a document labelled 1 rises by one for each of these numbers
    that the mentions of its most frequent sure feature reach; such a feature hardly occurs in documents labelled 0. With no
    numbers the two grades are fitted as they are."""
    known = one_per_key(labels.where(F.col(grade).isNotNull()), "doc_id", F.max(F.col(grade).cast("int")).alias("grade"))
    n = known.count()
    if not n:
        return OrdinalModel({}, [0.0])
    gate = sample_gate("doc_id", min(1.0, fit_rows / n))
    texts = docs.where(gate).select("doc_id", text_of("text").alias("__text"))
    rows = texts.join(known.where(gate), "doc_id").groupBy("doc_id", F.greatest("grade", F.lit(0)).alias("grade")).agg(F.min("__text").alias("__text"))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, grade int, names array<string>, counts array<int>"
    sampled = rows.mapInArrow(_sample_features, kind).persist()
    by_grade = {r["grade"]: r["count"] for r in sampled.groupBy("grade").count().collect()}
    n_pos = sum(c for g, c in by_grade.items() if g > 0)
    n_neg = by_grade.get(0, 0)
    if not n_pos or not n_neg:
        sampled.unpersist()
        return OrdinalModel({}, [0.0])
    seen = sampled.select((F.col("grade") > 0).cast("int").alias("pos"), F.explode("names").alias("f")).groupBy("f").agg(F.sum("pos").alias("a"), F.count(F.lit(1)).alias("n"))
    a, b = F.col("a"), F.col("n") - F.col("a")
    rate_a, rate_b = (a + 0.5) / (n_pos + 1.0), (b + 0.5) / (n_neg + 1.0)
    gain = a * F.log(rate_a / rate_b) + b * F.log(rate_b / rate_a)
    top = seen.where("n >= 3").select("f", "a", b.alias("b"), gain.alias("gain")).where(F.col("gain") >= MIN_GAIN).orderBy(F.desc("gain"), "f").limit(n_features).collect()
    index = {r["f"]: i for i, r in enumerate(top)}
    sure = {r["f"] for r in top if r["a"] >= 3 and (r["b"] + 0.5) / (n_neg + 1) < 0.02 * r["a"] / n_pos}
    table = docs.sparkSession.createDataFrame([(f, i, f in sure) for f, i in index.items()], "f string, i int, sure boolean")
    pairs = sampled.select("doc_id", "grade", F.explode(F.arrays_zip("names", "counts")).alias("p")).select("doc_id", "grade", "p.*")
    kept = pairs.join(F.broadcast(table), pairs["names"] == table["f"])  # at most n_features rows
    sparse = kept.groupBy("doc_id", "grade").agg(F.collect_list("i").alias("i"), F.collect_list("counts").alias("c"), F.coalesce(F.max(F.when(F.col("sure"), F.col("counts"))), F.lit(0)).alias("m")).collect()
    two = set(by_grade) <= {0, 1}
    graded = [(1 + sum(r["m"] >= m for m in mentions) if two and r["grade"] else r["grade"], r["i"], r["c"]) for r in sparse]
    empty = {g: c - sum(r["grade"] == g for r in sparse) for g, c in by_grade.items()}
    graded += [(g, [], []) for g, c in empty.items() for _ in range(c)]
    place = {g: n for n, g in enumerate(sorted({g for g, _, _ in graded}))}
    graded = [(place[g], i, c) for g, i, c in graded]
    sampled.unpersist()
    weights, thresholds = _fit_ordinal(graded, len(index), max(g for g, _, _ in graded) + 1)
    return OrdinalModel({f: float(weights[i]) for f, i in index.items() if abs(weights[i]) > 1e-6}, [float(x) for x in thresholds])


def _scorer(model: OrdinalModel):
    """texts -> P(grade >= k) for k = 1.., a row for each text."""
    weights, theta = model.weights, np.array(model.thresholds)
    memo: dict[str, tuple[str, ...]] = {}

    def run(texts: list[str | None]) -> np.ndarray:
        eta = []
        for text in texts:
            hits: Counter = Counter()
            for word in WORD.findall((text or "").lower()):
                found = memo.get(word)
                if found is None:
                    if len(memo) >= _MEMO:
                        memo.clear()
                    found = memo[word] = tuple(f for f in features_of(word) if f in weights)
                if found:
                    hits.update(found)
            eta.append(sum(weights[f] * float(np.log1p(n)) for f, n in hits.items()))
        at_least = 1 / (1 + np.exp(np.clip(theta[None, :] - np.array(eta, dtype=float).reshape(-1, 1), -35, 35)))
        return at_least if weights else np.zeros_like(at_least)

    return run


def score(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, expected_severity, p_toxic (P(grade >= 1)), grade (the most probable) and toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            at_least = scorer(batch.column("text").to_pylist())
            one = np.ones((len(at_least), 1))
            edges = np.hstack([one, at_least, 0 * one])
            grade = (edges[:, :-1] - edges[:, 1:]).argmax(axis=1).astype("int32")
            columns = [pa.array(at_least.sum(axis=1)), pa.array(at_least[:, 0]), pa.array(grade), pa.array(at_least[:, 0] >= threshold)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "expected_severity", "p_toxic", "grade", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_severity double, p_toxic double, grade int, toxic boolean")


def keep_clean(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose P(grade >= 1) is below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column("text").to_pylist())[:, 0] < threshold))

    return docs.mapInArrow(run, docs.schema)

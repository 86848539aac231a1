"""Every query of the engine's own operators: equal to its SQL, and runs."""

import hashlib
import re
import uuid
from collections import defaultdict

import pytest

from plumbline.operators import corpus, search
from plumbline.plans.registry import QUERIES, SQL
from tests.compare import assert_matches


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tiny, name):
    assert_matches(QUERIES[name](spark, tiny), tiny, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0


@pytest.mark.parametrize("name", ["vector_topk", "quote_anchor"])
def test_more_queries_than_a_block(spark, tiny, monkeypatch, name):
    monkeypatch.setattr(search, "BLOCK", 3)
    assert_matches(QUERIES[name](spark, tiny), tiny, SQL[name])


def test_hybrid_search_keeps_every_query(spark, tiny, monkeypatch):
    want = sorted(map(tuple, QUERIES["hybrid_search"](spark, tiny).collect()))
    monkeypatch.setattr(search, "BLOCK", 3)
    assert sorted(map(tuple, QUERIES["hybrid_search"](spark, tiny).collect())) == want


def test_hybrid_search_equals_brute_force(spark, tiny):
    def plain(text):
        low = re.sub(r"\s+", " ", text.lower()).strip()
        digest = hashlib.sha256(text.encode()).digest()
        return low, set(re.findall("[a-z0-9]+", text.lower())), [round(b / 255 * 2 - 1, 6) for b in digest[:16]]

    def cosine(a, b):
        dot = lambda x, y: sum(i * j for i, j in zip(x, y))
        return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5

    docs = [(r["doc_id"], *plain(r["text"])) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    want, beyond = {}, 0
    for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect():
        phrase, words, qv = plain(r["text"])
        found = [(-round(len(words & has) / len(words) + 0.25 * (phrase in low), 6), d, dv) for d, low, has, dv in docs if words & has]
        found = sorted(found, key=lambda x: x[:2])[:25]
        best = sorted((-round(0.4 * s / found[0][0] + 0.6 * max(0.0, cosine(dv, qv)), 6), d) for s, d, dv in found)[:5]
        beyond += len({d for _, d in best} - {d for _, d, _ in found[:5]})
        want[r["item_id"]] = [(d, pytest.approx(-s, abs=2e-6)) for s, d in best]
    got = defaultdict(list)
    for r in sorted(QUERIES["hybrid_search"](spark, tiny).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    assert got == {q: v for q, v in want.items() if v} and beyond > 0


def test_paragraph_chunks_equal_plain(spark, tiny):
    def pack(text, limit=1_200):
        out = []
        for p in filter(None, map(str.strip, re.split(r"\n\s*\n", text or ""))):
            if out and len(out[-1]) + len(p) + 2 <= limit:
                out[-1] += "\n\n" + p
            else:
                out.append(p)
        return list(enumerate(out))

    odd = [None, "", " \n\n ", "a\nb\n \t\nc  ", "\u00a0x\u00a0\n\u2003\ny", ("p" * 700 + "\n\n") * 3 + "q" * 1_500 + "\n\nr", "s" * 598 + "\n\n" + "t" * 600, "s" * 599 + "\n\n" + "t" * 600]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()] + [(-1 - i, t) for i, t in enumerate(odd)]
    got = corpus.pack_paragraphs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted((d, n, c) for d, t in rows for n, c in pack(t))


def test_name_uuids_equal_the_library(spark, tiny):
    names = {r["n_nationkey"]: r["n_name"] for r in spark.read.parquet(f"{tiny}/nation.parquet").collect()}
    got = {r["n_nationkey"]: r["id"] for r in QUERIES["name_uuids"](spark, tiny).collect()}
    assert got == {k: str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for k, n in names.items()}


def test_document_chunks_equal_plain(spark, tiny):
    def split(text, limit):
        if len(text) <= limit:
            return [text]
        out, now = [], ""
        for word in text.split():
            if len(word) > limit:
                out += [now] * bool(now) + [word[i : i + limit] for i in range(0, len(word), limit)]
                now = ""
            elif now and len(now) + len(word) + 1 > limit:
                out.append(now)
                now = word
            else:
                now = f"{now} {word}".strip()
        return out + [now] * bool(now)

    def pack(text, limit):
        out = []
        for part in (x for p in re.split(r"\n\s*\n", text or "") if p.strip() for x in split(p.strip(), limit)):
            if out and len(out[-1]) + len(part) + 2 <= limit:
                out[-1] += "\n\n" + part
            else:
                out.append(part)
        return list(enumerate(out))

    odd = [None, "", " \n\n ", "a b\n\nc", "x" * 1_000, "w " * 300 + "\n\n" + "y" * 401 + " z", "p" * 199 + "\n \n" + "q" * 199]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()] + [(-1 - i, t) for i, t in enumerate(odd)]
    got = corpus.pack_document(spark.createDataFrame(rows, "doc_id bigint, text string"), limit=400).collect()
    assert sorted(tuple(r) for r in got) == sorted((d, n, c) for d, t in rows for n, c in pack(t, 400))

"""Whitening, conversation repair and license scans against plain versions, on generated tables and small edge cases."""

import hashlib
import heapq
import itertools
import math
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import conversations, licenses, queries, whitening
from plumbline.llm.oracles import ORACLES
from tests.compare import assert_matches

from .conftest import EDGE

# op11


def plain_whitening(rows, k=4):
    """Rows of (vec_id, component, n, deviation, |whitened|, explained, error) by exact sums and the library's solver."""
    usable = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for d in {len(x) for _, x in usable}:
        own = [(i, x) for i, x in usable if len(x) == d]
        fit = sorted({x for _, x in own})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        trace = (centred**2).sum() / n
        for i, x in own:
            deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
            w = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)]) @ vectors
            for j in range(len(values)):
                live = values[j] > 1e-12 * trace
                out.append((i, j + 1, n, deviation if deviation < 2**63 else None, abs(w[j]) / values[j] ** 0.5 if live else None, values[j] / trace if trace else None))
    return out


def close(a, b):
    return a is None and b is None or a is not None and b is not None and abs(a - b) < 1e-8 * max(1, abs(b))


def same_whitening(got, want):
    got = sorted(got, key=lambda r: (str(r[0]), r[1], r[2], r[3] or 0, abs(r[4] or 0)))
    want = sorted(want, key=lambda r: (str(r[0]), r[1], r[2], r[3] or 0, r[4] or 0))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want):
        assert close(None if g[4] is None else abs(g[4]), w[4]) and close(g[5], w[5]), (g, w)
        assert g[6] is None or g[6] < 1e-8


def test_whitening_equals_plain(spark, small, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 7)
    rows = spark.read.parquet(f"{small}/embeddings.parquet").repartition(7)
    got = [tuple(r) for r in whitening.whiten(rows).collect()]
    same_whitening(got, plain_whitening([(r["vec_id"], r["embedding"]) for r in rows.collect()]))
    signs = defaultdict(set)
    for r in queries.op11_whitening(spark, small).collect():
        signs[r["vec_id"]].add(r["component"])
    assert all(s == {1, 2, 3, 4} for s in signs.values())


def test_whitening_edge_cases(spark):
    rng = np.random.default_rng(5)
    far = [(100 + i, (1e9 + rng.normal(size=3)).tolist()) for i in range(50)]
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 0.0]), (6, [1.0, -0.0]), (6, [1.0, -0.0]), (None, [2.0, 0.5]), (7, [0.0, 1.0])]
    rows += [(8, [3.0] * 5), (9, [3.0] * 5), (10, [2.5]), (11, [-2.5]), (11, [0.25]), (12, [1e300, 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + far], "vec_id bigint, embedding array<double>, n int, component string")
    got = [tuple(r) for r in whitening.whiten(df).collect()]
    cut = [(i, [min(max(c, -(2.0**53)), 2.0**53) if c is not None and math.isfinite(c) else c for c in v] if v else v) for i, v in rows + far]
    same_whitening(got, plain_whitening(cut))
    assert whitening.whiten(df.limit(0)).collect() == []
    flat = whitening.whiten(df.where("vec_id in (8, 9)")).collect()
    assert len(flat) == 8 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in flat)


def test_symmetric_qr_equals_the_library():
    rng = np.random.default_rng(3)
    for n, scale in itertools.product((1, 2, 3, 17, 40), (0.0, 1.0, 1e9)):
        a = rng.normal(size=(n, n)) * scale
        a = a + a.T
        values, vectors = whitening.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * (1 + scale) * n)
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12) and np.allclose(a @ vectors, vectors * values, atol=1e-11 * (1 + scale) * n)


# op12


def plain_audit(codes):
    """Cheapest edits, ASCII-least among them, by Dijkstra's search over (rows used, roles so far); codes: (initial, must go, truncated)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if at == len(codes) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit
        if (at, roles) in seen or not re.fullmatch(r"s?(ua)*u?", roles) or len(roles) > 2 * len(codes) + 3:
            continue
        seen.add((at, roles))
        for role in "ua":
            heapq.heappush(heap, (cost + 2, audit + "I", at, roles + role))
        if at < len(codes):
            initial, gone, cut = codes[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, roles))
            if not gone:
                heapq.heappush(heap, (cost + cut, audit + "K", at + 1, roles + (initial or "?")))
                for role in "ua":
                    heapq.heappush(heap, (cost + 2 + cut, audit + "R", at + 1, roles + role))


def plain_repair(rows):
    """Result rows of op12 by conversation."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv] += []
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        role, text = shown[2:]
        fate = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            held[conv] += [(turn, "user" if fate == 4 else role, text)] * (1 + (fate == 3))
    out = {}
    for conv, own in held.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, codes, n = set(), [], {"b": 0, "d": 0, "t": 0}
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            n[fault] = n.get(fault, 0) + 1
            seen.add((role, text))
            codes.append((role[:1], fault in ("b", "d"), fault == "t"))
        cost, audit = plain_audit(codes)
        lines, at, turns = [], 0, 0
        for edit in audit:
            _, role, text = own[at] if edit != "I" else (None, None, "")
            if edit != "D":
                said = role if edit == "K" else ("user", "assistant")[turns % 2]
                lines.append(f"{said}:{text}")
                turns += said[:1] != "s"
            at += edit != "I"
        known = {t for t, _, _ in own if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        out[conv] = (gaps, n["b"], n["d"], n["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, rows):
    got = conversations.repair(conversations.damage(rows), rows).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r[0]: tuple(r)[1:] for r in got}


def test_repair_equals_plain(spark, small, monkeypatch):
    rows = spark.read.parquet(f"{small}/conversations.parquet")
    want = plain_repair([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
    got = {r[0]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, small).collect()}
    assert got == want
    monkeypatch.setattr(conversations, "BLOCK_BITS", 1)
    assert repaired(spark, rows.repartition(5)) == want


def test_repair_edge_cases(spark):
    roles, texts = ["system", "user", "assistant", "tool", None, "", "usher"], ["Yes.", "No", "", None, " \t", "What? \n", "Well!", "naïve 東京。"]
    rng = np.random.default_rng(11)
    rows = [(int(c), int(t) if t < 12 else None, roles[r], texts[x]) for c, t, r, x in zip(*(rng.integers(0, m, 900) for m in (150, 14, 7, 8)))]
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (999, None, "user", "A."), (999, None, "assistant", "B."), (998, -5, "user", "x"), (998, 5, "user", "x")]
    rows += [(997, i, ("user", "assistant")[i % 2], f"{i} " + "long " * 2_000 + ".") for i in range(40)] + [(996, 3, "user", "Same.")] * 30
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, place int, sig string, m int")
    assert repaired(spark, df) == plain_repair(rows)
    assert repaired(spark, df.limit(0)) == {}


def test_long_signatures_equal_short_ones():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5, 9):
        for _ in range(60):
            sig = "".join(rng.choice(list("suaoSUAOx"), n))
            codes = [("" if c == "x" else c.lower(), c == "x", c.isupper()) for c in sig]
            assert conversations.solve(sig) == plain_audit(codes), sig
    sig = "".join(rng.choice(list("suaoSUAOx"), 3_000))
    before = conversations.solve(sig)
    assert before[1].count("I") + len(sig) == len(before[1])
    conversations._short_costs.cache_clear()
    conversations._short_edits.cache_clear()
    assert conversations.solve(sig) == before


# op13


def plain_scan(text):
    words = lambda s: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", s.translate(str.maketrans(licenses.UPPER, licenses.LOWER))) if w]
    w = words(text)
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels, shares = {label for _, label in at}, [0.0]
    for s in re.split(r"(?<=[.!?])[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n", text):
        have, held = set(words(s)), []
        for label, t in licenses.TEMPLATES:
            need = set(words(t))
            if len(have & need) >= math.ceil(round(0.9 * len(need), 9)):
                held.append((-len(have & need), -len(have & need) / len(need), label))
        labels |= {min(held)[2]} if held else set()
        shares += [-s for _, s, _ in held]
    starts = [i for i, _ in at]
    return (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})), ",".join(sorted(labels)), max(shares))


def test_license_join_equals_sql(spark, tiny):
    assert_matches(queries.op13_license_join(spark, tiny), tiny, ORACLES["op13_license_join"])


def test_license_edge_cases(spark, edge, empty):
    mit = licenses.TEMPLATES[2][1]
    texts = [
        "mit license", "The MIT\n\nLicense! MIT License mit license", "Apache-License general PUBLIC license", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0",
        mit, mit.replace("free of charge", "").replace(" ", "\n "), " ".join(mit.split()[:30]), "summit license mit licenses", "MİT LİCENSE", "ALL RIGHTS RESERVED. word " * 3_000,
        "all rights\n\nreserved", "all rights\nreserved", None, "", "all. rights. reserved", "Released under the Apache License.",
    ]
    rows = [(d, t) for d, t in EDGE] + [(100 + i, t) for i, t in enumerate(texts)] + [(100, "mit license")]
    extra = {c: F.lit(7) for c in ("row", "words", "labels", "score", "n_base", "base", "__key")}
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(extra)).collect()
    assert sorted((str(r[0]), *map(str, r[1:])) for r in got) == sorted((str(d), *map(str, plain_scan(t or ""))) for d, t in rows)
    assert licenses.scan(edge).count() == len(EDGE) and licenses.scan(empty).collect() == []


@pytest.mark.parametrize("threshold", [0.5, 0.75, 1.0])
def test_containment_join_equals_all_pairs(spark, threshold):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    templates = [(f"t{i}", sorted(rng.choice(words, rng.integers(1, 9), replace=False).tolist())) for i in range(12)]
    known = {w for _, ws in templates for w in ws}
    blocks = [(i, i % 3, [w for w in rng.choice(words, rng.integers(0, 20), replace=False).tolist() if w in known]) for i in range(300)]
    counts = {w: sum(w in b for *_, b in blocks) for w in known}
    got = licenses.containment_join(spark.createDataFrame(blocks, "row int, block int, words array<string>"), templates, counts, threshold)
    want = [(r, b, label, len(set(ws) & set(ts))) for r, b, ws in blocks for label, ts in templates if len(set(ws) & set(ts)) >= math.ceil(threshold * len(ts))]
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want) and want

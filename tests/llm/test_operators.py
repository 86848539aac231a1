"""Each operator against its plain version, on generated tables and on small edge cases."""

import base64
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from plumbline.llm import byte_bpe, class_lm, jaccard_join, mixing, pii, quality_rules, queries, substring_dedup, topk, toxicity, training_order
from plumbline.llm.oracles import ORACLES
from tests.compare import assert_matches

from . import plain
from .conftest import EDGE


def texts_of(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def by_id(df, *columns):
    out = {r["doc_id"]: tuple(r[c] for c in columns) for r in df.select("doc_id", *columns).collect()}
    return out


# op1


def brute_top(vectors, k=5, step=50):
    vecs = {i: np.floor(np.asarray(v, float) * 256).astype(np.int64) for i, v in vectors}
    out = []
    for q in sorted(i for i in vecs if i % step == 0):
        best = sorted((-int(vecs[q] @ v), i) for i, v in vecs.items() if i != q and len(v) == len(vecs[q]))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("shard,block,leaf", [(20_000, 1_024, 256), (70, 3, 8)])
def test_topk_equals_brute_force(spark, small, monkeypatch, shard, block, leaf):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "QUERY_ROWS", block)
    monkeypatch.setattr(topk, "LEAF", leaf)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op1_ball_tree_topk(spark, small).collect()) == brute_top(rows)


def test_topk_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [math.nan, 1.0]), (5, [math.inf, 0.0]), (6, [None, 1.0]), (50, [-0.5, 0.25]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0]), (None, [1.0, 1.0])]
    rows += [(9, [600000.0, 1.0]), (0, [2.0, 3.0]), (50, [-0.5, 0.25]), (50, [6e6, -5e6]), (11, [6e6, 5e6])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, rank int")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and i not in (3, 4, 5, 6)]
    want = []
    for n, (q, v) in enumerate(usable):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(usable) if m != n and len(w) == len(v))[:5]
            want += [(q, r, i, min(2**63 - 1, max(-(2**63), -s))) for r, (s, i) in enumerate(scores, 1)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).collect() == []


# op2


def test_mixing_oracle(spark, tiny):
    assert_matches(queries.op2_source_mixing(spark, tiny), tiny, ORACLES["op2_source_mixing"])


def test_mixing_targets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source")
    mixed = mixing.mix_sources(docs, {"src1": 3.0, "src2": 1.0}, total=20_000)
    n = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(n) == {"src1", "src2"} and abs(n["src1"] - 15_000) < 1_000 and abs(n["src2"] - 5_000) < 600


def test_mixing_edge_cases(edge, empty):
    mixed = mixing.mix_sources(edge)
    assert mixed.columns == [*edge.columns, "mix_rate", "mix_copy", "mix_key"]
    repeated = Counter((r["doc_id"], r["mix_copy"]) for r in mixed.where("doc_id = 12").collect())
    assert set(repeated.values()) <= {2}
    assert mixing.mix_sources(empty).collect() == []
    again = mixing.mix_sources(mixed)
    assert again.columns == mixed.columns


# op3


def test_toxicity_held_out(spark, small):
    folder = small.replace("sf0.01", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    assert model.thresholds == sorted(model.thresholds)
    held = labels.where("doc_id % 2 = 1")
    said = toxicity.score(docs.where("doc_id % 2 = 1"), model).withColumnRenamed("toxic", "said")
    n = Counter((r["toxic"], r["said"]) for r in said.join(held, "doc_id").collect())
    assert n[1, True] > 0.7 * (n[1, True] + n[1, False]) and n[0, True] < 0.005 * (n[0, True] + n[0, False])


def test_toxicity_edge_cases(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    zero = toxicity.fit(edge, none)
    assert all(r["expected_severity"] == 0 and not r["toxic"] for r in toxicity.score(edge, zero).collect())
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (5, 0), (5, 1), (6, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(edge, labels)
    assert toxicity.score(edge, model).count() == len(EDGE) and toxicity.keep_clean(edge, model).columns == edge.columns
    assert toxicity.score(empty, model).collect() == [] == toxicity.keep_clean(empty, zero).collect()
    assert toxicity.fit(empty, labels).weights == {}


def test_toxicity_repeated_rows_do_not_weigh(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    toxic = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    more = docs
    for _ in range(3):
        more = more.unionByName(toxic)
    assert toxicity.fit(docs, labels) == toxicity.fit(more, labels)


def test_toxicity_takes_given_grades(spark):
    word = {0: "calm", 1: "rude", 3: "vile", 7: "foul"}
    rows = [(n, f"{' '.join(f'w{n % 13}x{i}' for i in range(9))} {word[g]} {word[g]}ly", g) for n, g in enumerate([0, 1, 3, 7] * 60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2] if r[2] else -1) for r in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert len(model.thresholds) == 3 and model.thresholds == sorted(model.thresholds)
    mean = {g: [] for g in word}
    for r in toxicity.score(docs, model).collect():
        mean[rows[r["doc_id"]][2]].append(r["expected_severity"])
    means = [sum(v) / len(v) for v in mean.values()]
    assert means == sorted(means) and means[0] < 0.5


def test_toxicity_score_equals_plain(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    texts = dict(texts_of(spark, small))
    for r in toxicity.score(docs, model).where("doc_id % 7 = 0").collect():
        n = Counter(f for w in toxicity.WORD.findall((texts[r["doc_id"]] or "").lower()) for f in toxicity.features_of(w) if f in model.weights)
        eta = sum(model.weights[f] * math.log1p(c) for f, c in n.items())
        at_least = [1 / (1 + math.exp(t - eta)) for t in model.thresholds]
        assert r["expected_severity"] == pytest.approx(sum(at_least)) and r["p_toxic"] == pytest.approx(at_least[0])


# op4


def base_columns(text):
    found = plain.personal(text)
    kinds = list(plain.PATTERNS)
    return (*[sum(k == n for _, k, _ in found) for n in range(4)], plain.sha(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in found)))


def test_pii_base_equals_plain(spark, small):
    got = by_id(queries.op4_pii_bootstrap(spark, small), "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = {d: base_columns(t) for d, t in texts_of(spark, small)}
    assert got == want and sum(w[0] for w in want.values()) > 0


def test_pii_edge_cases(edge, empty):
    found = pii.find(edge)
    got = {(r["doc_id"], tuple((x["s"], x["k"], x["e"]) for x in r["base"])) for r in found.collect()}
    assert got == {(d, tuple(plain.personal(t))) for d, t in EDGE}
    assert found.count() == len(EDGE)
    masked = pii.redact(edge)
    assert masked.columns == edge.columns and masked.count() == len(EDGE)
    text = masked.where("doc_id = 5").first()["text"]
    assert text == "Mail [email] or [phone], ip [ip] and 999.1.1.1; card [card]."
    assert pii.find(empty).collect() == [] == pii.redact(empty).collect()


def test_pii_bootstrap_finds_unseen_identifiers(spark):
    cards = ["4111111111111111", "4012888888881881", "5555555555554444", "5105105105105100", "4222222222222220", "378282246310005"]
    texts = [f"please charge card: {c} today" for c in cards] + ["please charge card: 98X7-6543-21AB today", "an order: 12345678 was sent", "an order: 87654321 was sent"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: [(x["k"], x["m"]) for x in r["all"]] for r in pii.find(df).collect()}
    assert got[6] == [(4, "98X7-6543-21AB")] and got[7] == [] == got[8]


@pytest.mark.parametrize(
    "seeds,left,right,unseen",
    [
        ([f"+1 (555) 010-99{n}" for n in range(10, 16)], "Téléphoné : ", " heute", "(555) 010-9916"),
        ([f"{n}@mail.example.org" for n in "abcdef"], "écrire à <", "> svp", "gérard@intranet"),
        ([f"10.0.0.{n}" for n in range(6)], "host [", "] up", "999.10.20.300"),
        (["4111 1111 1111 1111", "4012 8888 8888 1881", "5555 5555 5555 4444", "5105 1051 0510 5100"], "carte nº ", "", "4111 1111 1111 1112"),
        ([f"+44 20 7946 0{n}" for n in range(100, 106)], "", " is my number", "020 7946 0107"),
    ],
)
def test_pii_bootstrap_finds_each_kind_in_context(spark, seeds, left, right, unseen):
    texts = [left + s + right for s in (*seeds, unseen)]
    common = [f"the {s} of" for s in seeds] + ["the 12345678 of"] + ["the word of the thing of"] * 100
    df = spark.createDataFrame(list(enumerate(texts + common)), "doc_id bigint, text string")
    got = {r["doc_id"]: [(x["s"], x["k"], x["e"], x["m"]) for x in r["all"]] for r in pii.find(df).collect()}
    assert got[len(seeds)] == [(len(left), 4, len(left) + len(unseen), unseen)]
    assert got[len(texts) + len(seeds)] == []


# op5


def test_substring_equals_plain(spark, tiny):
    got = by_id(queries.op5_substring_dedup(spark, tiny), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = plain.repeats(texts_of(spark, tiny))
    assert got == want and sum(w[1] for w in want.values()) > 1_000


def test_substring_edge_cases(spark, edge, empty):
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in substring_dedup.remove_repeats(edge).where("doc_id is not null").collect()))
    known = [(d, t) for d, t in EDGE if d is not None]
    want = plain.repeats(known)
    assert got == sorted((d, *want[d][:3]) for d, _ in known)
    assert substring_dedup.remove_repeats(edge).where("doc_id is null").first()["n_removed"] == 0
    assert substring_dedup.remove_repeats(empty).collect() == []


def test_substring_overlaps_and_periods(spark):
    a, b = "abcdefghij" * 12, "".join(chr(97 + i * 7 % 26) for i in range(90))
    docs = [(1, a + b), (2, a[:70] + "Q" + b), (3, b[:49] + "x" + b[1:60]), (4, "z" * 200), (5, "z" * 120 + b[20:80] + "z" * 60), (6, a[3:] + a), (7, b[:50]), (8, "y" + b[:50] + b[40:])]
    got = by_id(substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain.repeats(docs)


# op6


def test_class_lm_base_equals_plain(spark, tiny):
    rows = queries.op6_class_lm(spark, tiny).collect()
    want = plain.unigrams(texts_of(spark, tiny))
    assert len(rows) == len(want)
    for r in rows:
        held, n, known, train, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]))


def test_class_lm_beats_unigrams_on_held_out(spark, small):
    got = queries.op6_class_lm(spark, small).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_exchange_move_is_the_best_one():
    rng = np.random.default_rng(3)
    words, classes = 12, 3
    big = rng.integers(0, 6, (words, words)).astype(float)
    cls = rng.integers(0, classes, words)

    def likelihood(c):
        n = np.zeros((classes, classes))
        for i in range(words):
            for j in range(words):
                n[c[i], c[j]] += big[i, j]
        f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0).sum()
        return f(n) - f(n.sum(1)) - f(n.sum(0))

    n = np.zeros((classes, classes))
    for i in range(words):
        for j in range(words):
            n[cls[i], cls[j]] += big[i, j]
    for w in range(words):
        after = np.bincount(cls, big[w], classes)
        before = np.bincount(cls, big[:, w], classes)
        got = class_lm.best_class(n, int(cls[w]), after, before, big[w, w], classes)
        options = [likelihood(np.where(np.arange(words) == w, k, cls)) for k in range(classes)]
        assert options[got] == pytest.approx(max(options), abs=1e-6)


def test_rare_words_move_to_the_best_class():
    rng = np.random.default_rng(4)
    free, total = 3, 6
    n = rng.integers(0, 40, (total, total)).astype(float)
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0).sum()
    likely = lambda m: f(m) - f(m.sum(1)) - f(m.sum(0))
    codes, sizes, want = [], [], []
    for _ in range(40):
        places = [(int(a), int(b)) for a, b in rng.integers(0, total, (rng.integers(2, 9), 2))]
        options = []
        for k in range(free):
            m = n.copy()
            for before, after in places:
                m[before, k] += 1
                m[k, after] += 1
            options.append(likely(m))
        codes += [c for before, after in places for c in (before, after + 128)]
        sizes.append(2 * len(places))
        want.append(options)
    got = class_lm.best_classes(n, np.array(codes), np.array(sizes), free)
    assert all(options[k] == pytest.approx(max(options), abs=1e-6) for k, options in zip(got, want))


def test_class_lm_score_equals_plain(spark, tiny, tmp_path, monkeypatch):
    """Every word that occurs twice has a class, and scores follow from the classes alone."""
    monkeypatch.setattr(class_lm, "CLUSTER_SHARE", 400)
    monkeypatch.setattr(class_lm, "HEAD_SHARE", 3_000)
    kept = {}
    monkeypatch.setattr(class_lm, "word_classes", lambda *a, f=class_lm.word_classes: kept.setdefault("classes", f(*a)))
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = {r["doc_id"]: r for r in class_lm.score(docs, classes=8, rounds=2).collect()}
    frequent, rare = kept["classes"]
    k_of = {w: k for w, (k, _) in frequent.items()} | {bytes(r["word"]): r["k"] for r in rare.collect()}
    texts = {d: class_lm.tokens(t or "") for d, t in texts_of(spark, tiny)}
    counts = Counter(w for d, ws in texts.items() if not rows[d]["held_out"] for w in ws)
    assert {w for w, c in counts.items() if c > 1} <= set(k_of) and all(k <= 8 for k in k_of.values())
    kind = lambda w: k_of.get(w, 9 + class_lm.shape(w))
    moves, size, types = Counter(), Counter(), Counter()
    for w, c in counts.items():
        size[kind(w)] += c
        types[kind(w)] += 1
    for d, ws in texts.items():
        if not rows[d]["held_out"]:
            ks = [8, *map(kind, ws)]
            moves.update(zip(ks, ks[1:]))
    out = Counter()
    for (a, _), n in moves.items():
        out[a] += n
    total = 9 + class_lm.SHAPES
    for d, ws in texts.items():
        ks = [8, *map(kind, ws)]
        want = sum(math.log10((moves[p] + 0.5) / (out[p[0]] + 0.5 * total)) for p in zip(ks, ks[1:]))
        want += sum(math.log10((counts[w] + 0.5) / (size[kind(w)] + 0.5 * (types[kind(w)] + 1))) for w in ws)
        assert rows[d]["score"] == pytest.approx(want, rel=1e-9), d


def test_class_lm_edge_cases(edge, empty):
    got = class_lm.score(edge, classes=4, rounds=2)
    rows = got.collect()
    assert len(rows) == len(EDGE) and all(math.isfinite(r["score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert class_lm.score(empty).collect() == []


# op7


def test_jaccard_equals_plain(spark, small):
    got = by_id(queries.op7_jaccard_join(spark, small), "class_id", "group_id", "n_links")
    assert got == plain.jaccard_groups(texts_of(spark, small))


def test_jaccard_blocks_equal_plain(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    base = [f"w{i}" for i in range(60)]
    docs = [(n, " ".join(base[:n % 7] + ["x"] + base[n % 7 + 1 :])) for n in range(30)] + [(100 + n, " ".join(base)) for n in range(3)]
    got = by_id(jaccard_join.jaccard_join(spark.createDataFrame(docs, "doc_id bigint, text string")), "class_id", "group_id", "n_links")
    assert got == plain.jaccard_groups(docs)


def test_jaccard_edge_cases(edge, empty):
    rows = jaccard_join.jaccard_join(edge).collect()
    assert len(rows) == len(EDGE)
    known = {d: t for d, t in EDGE if d is not None and d != 12}
    want = plain.jaccard_groups(list(known.items()))
    assert {r["doc_id"]: (r["class_id"], r["group_id"], r["n_links"]) for r in rows if r["doc_id"] in known} == want
    kept = jaccard_join.keep_one(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 12").count() == 1 and kept.where("doc_id is null").count() == 1
    assert jaccard_join.jaccard_join(empty).collect() == [] == jaccard_join.keep_one(empty).collect()


def test_jaccard_keeps_one_of_each_group_with_null_and_repeated_ids(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    near = texts["d"] + " more"
    docs = [(1, texts["a"], "x"), (None, texts["a"], "x"), (None, texts["b"], "x"), (7, texts["a"].upper(), "x"), (7, texts["c"], "x"), (None, texts["d"], "x"), (None, near, "x"), (1, texts["a"], "x"), (None, "", "x"), (None, " ", "x")]
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect())
    assert sum(kept[None, t] for t in (texts["d"], near)) == 1
    assert {x for x in kept if x[1] not in (texts["d"], near)} == {(1, texts["a"]), (None, texts["b"]), (7, texts["c"]), (None, ""), (None, " ")}
    assert set(kept.values()) == {1}


# op8


@pytest.fixture(scope="module")
def reference_bpe():
    path = public_tokenizers.path(queries.BPE_FILE)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, tiny, reference_bpe):
    got = by_id(queries.op8_byte_bpe(spark, tiny), "n_tokens", "ids_sha256", "decoded_sha256")
    want = {}
    for d, t in texts_of(spark, tiny):
        ids = reference_bpe.encode_ordinary(t or "")
        want[d] = (len(ids), plain.sha(" ".join(map(str, ids))), plain.sha(t or ""))
    assert got == want


def test_bpe_edge_cases(spark, edge, empty, reference_bpe):
    bpe = byte_bpe.ByteBPE(spark, public_tokenizers.path(queries.BPE_FILE), public_tokenizers.PATTERN)
    out = bpe.encode(edge)
    assert out.columns == [*edge.columns, "token_ids"]
    odd = ["it's  I'LL we'RE\r\n\r\n x y", "\u0085  a", "٣٤ ⅷ ²", "<|endoftext|>", "é \U0001f468‍\U0001f469", " " * 70 + "x", "a b\x1c\x1d c"]
    for df, texts in ((out, [t for _, t in EDGE]), (bpe.encode(spark.createDataFrame([(t,) for t in odd], "text string")), odd)):
        for r in bpe.decode(df).select("text", "token_ids", "decoded").collect():
            assert r["token_ids"] == reference_bpe.encode_ordinary(r["text"] or ""), r["text"][:50]
            assert bytes(r["decoded"]).decode() == (r["text"] or "")
    assert bpe.encode(empty).collect() == []
    again = bpe.encode(out)
    assert again.columns == out.columns


def test_bpe_batches_of_any_size_give_the_same_ids(spark, edge, reference_bpe):
    bpe = byte_bpe.ByteBPE(spark, public_tokenizers.path(queries.BPE_FILE), public_tokenizers.PATTERN)
    ids = lambda df: sorted((r["text"] or "", r["token_ids"]) for r in df.select("text", "token_ids").collect())
    assert ids(bpe.encode(edge, batch_chars=2_000)) == ids(bpe.encode(edge))


def test_bpe_shuffles_a_text_once(spark, reference_bpe):
    bpe = byte_bpe.ByteBPE(spark, public_tokenizers.path(queries.BPE_FILE), public_tokenizers.PATTERN)
    plan = bpe.encode(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    dealt = next(plan[i + 1] for i, line in enumerate(plan) if "RepartitionByExpression" in line)
    assert dealt.count("text#") == 1, dealt


def test_bpe_keeps_its_maps_out_of_the_plans_text(spark, reference_bpe):
    bpe = byte_bpe.ByteBPE(spark, public_tokenizers.path(queries.BPE_FILE), public_tokenizers.PATTERN)
    plan = bpe.decode(bpe.encode(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")))._jdf.queryExecution().toString()
    assert len(plan) < 200_000, len(plan)


# op9


def test_quality_statistics_equal_plain(spark, small):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = queries.op9_quality_rules(spark, small).collect()
    want = {d: plain.statistics(t) for d, t in texts_of(spark, small)}
    for r in rows:
        s = want[r["doc_id"]]
        assert tuple(r[c] for c in columns) == s
        assert r["base_failed"] == (s[0] < 50 or 100 * s[4] > 50 * s[0])
        assert not (r["base_failed"] and r["kept"])
    good = {r["doc_id"] for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").collect()}
    passed = [r["kept"] for r in rows if r["doc_id"] in good and not r["base_failed"]]
    assert sum(passed) > 0.97 * len(passed)


def test_quality_learns_a_rule(spark):
    clean = ["alpha beta gamma delta " * 2 + " ".join(f"word{i}x{n}" for i in range(80)) for n in range(60)]
    junk = [t.replace("word", "#$|") for t in clean[:30]]
    docs = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(90)], "doc_id bigint, quality int")
    kept = by_id(quality_rules.quality_rules(docs, labels), "kept")
    assert all(kept[i][0] == (i < 60) for i in range(90))


def test_quality_repeats_with_clashing_hashes(spark, monkeypatch):
    texts = ["a b c d a b c", "x y z " * 9, "one two three", "p q r s t u v p q r w q r s"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for bits in (3, 5, 60, 63):  # few position bits need the way by words; few hash bits clash
        monkeypatch.setattr(quality_rules, "_POS_BITS", bits)
        monkeypatch.setattr(quality_rules, "_POS_MASK", (1 << bits) - 1)
        got = by_id(quality_rules.statistics(df), "n_repeat_words")
        assert got == {n: (plain.statistics(t)[4],) for n, t in enumerate(texts)}


def test_quality_edge_cases(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = quality_rules.quality_rules(edge, none).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert got == Counter((d, *plain.statistics(t)) for d, t in EDGE)
    assert quality_rules.quality_rules(empty, none).collect() == []


# op10


def sequences(docs, length=1_024):
    out = Counter()
    for d, t in docs:
        data = [*(t or "").encode(), 256]
        for i in range(0, len(data), length):
            ids = data[i : i + length]
            out[(d, i // length, len(ids), np.array(ids + [257] * (length - len(ids)), "<u2").tobytes())] += 1
    return out


def test_training_order_places_every_sequence_once(spark, tiny):
    rows = queries.op10_training_order(spark, tiny).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert Counter((r["doc_id"], r["chunk"], r["n_tokens"], bytes(r["record"])) for r in rows) == sequences(texts_of(spark, tiny))
    assert all(r["shard"] == r["slot"] // training_order.SHARD_SEQUENCES for r in rows)


def test_training_order_takes_token_ids(spark):
    ids = {1: list(range(0, 50_000, 311)), 2: None, 3: [], 4: [50_255] * 64, 5: [7] * 130}
    df = spark.createDataFrame(list(ids.items()), "doc_id bigint, token_ids array<int>")
    rows = training_order.training_order(df, sequence=64, tokens="token_ids", end=50_256, pad=50_257).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["chunk"])):
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(bytes(r["record"]), "<u2")[: r["n_tokens"]].tolist())
    assert got == {d: [*(x or []), 50_256] for d, x in ids.items()}


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 7, 64, 1_000, 4_097):
        a, b = (training_order.permute(np.arange(n), n, key) for key in (1, 2))
        assert sorted(a) == list(range(n)) == sorted(b)
        assert n < 64 or (a != b).any()


def test_training_order_files_resume(spark, edge, empty, tmp_path):
    ordered = training_order.training_order(edge, sequence=64, shard_sequences=100)
    assert Counter((r["doc_id"], r["chunk"], r["n_tokens"], bytes(r["record"])) for r in ordered.collect()) == sequences(EDGE, 64)
    where = ordered.select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(where) == len({r["shard"] for r in where}) == len({r["p"] for r in where}) > 3  # a task a shard
    training_order.write_shards(ordered, str(tmp_path / "shards"))
    assert all(len(list(d.glob("part-*"))) == 1 for d in (tmp_path / "shards").glob("shard=*"))
    want = {r["slot"]: bytes(r["record"]) for r in ordered.collect()}
    for start in (0, 150):
        got = {r["slot"]: bytes(r["record"]) for r in training_order.read_shards(spark, str(tmp_path / "shards"), start, 64, 100).collect()}
        assert got == {k: v for k, v in want.items() if k >= start}
    assert training_order.training_order(empty).collect() == []

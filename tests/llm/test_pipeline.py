"""The stages, each against a plain version on what the stage before it kept."""

import base64
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from plumbline.llm import pii, toxicity

from . import plain


def test_stages_equal_plain_versions(spark, tiny, tmp_path):
    docs, kept = spark.read.parquet(f"{tiny}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, tiny).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs)
        assert name == "byte_bpe" or docs.columns == columns
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    before, after = kept["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{tiny}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score(before, model).where("toxic").collect()}
    assert sorted(pairs(after)) == sorted(x for x in pairs(before) if x[0] not in toxic)
    before, after = kept["jaccard_join"]
    groups = plain.jaccard_groups(pairs(before))
    assert sorted(pairs(after)) == sorted(x for x in pairs(before) if groups[x[0]][1] == x[0])
    before, after = kept["pii"]
    masked, names = dict(pairs(after)), [f"[{k}]" for k in pii.KINDS]
    spans = {r["doc_id"]: [(x["s"], x["k"], x["e"]) for x in r["all"]] for r in pii.find(before).collect()}
    for d, t in pairs(before):
        at, out = 0, ""
        for s, k, e in spans[d]:
            out += t[at : max(s, at)] + (names[k] if s >= at else "")
            at = max(at, e)
        assert masked[d] == out + t[at:]
    before, after = kept["mixing"]
    copies = Counter(d for d, _ in pairs(after))
    assert set(copies) <= {d for d, _ in pairs(before)} and abs(sum(copies.values()) - before.count()) < 5 * before.count() ** 0.5
    before, after = kept["byte_bpe"]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((d, tuple(enc.encode_ordinary(t))) for d, t in pairs(before))
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in after.collect()) == want
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in after.collect())
    assert Counter((r["doc_id"], r["n_bytes"]) for r in after.collect()) == Counter((d, len(t.encode())) for d, t in pairs(before))
    whole = corpus_pipeline.run(spark, tiny)
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in whole.collect()) == want


def test_stages_take_edge_cases(spark, edge, empty, tiny, tmp_path):
    for start, name in ((edge, "edge"), (empty, "empty")):
        docs = start
        for step, stage in corpus_pipeline.STAGES:
            stage(spark, docs, tiny).write.parquet(str(tmp_path / name / step))
            docs = spark.read.parquet(str(tmp_path / name / step))
        assert name == "edge" or docs.count() == 0

import base64
import hashlib
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from gridcells.llm import secret_scan
from gridcells.llm.common import scratch_path
from tests.llm import test_decontaminate, test_quality_rules, test_secret_scan, test_simhash

SMALL = "/root/testdata/sf0.01"


def without_passages(text, items):
    lowered = text.translate(test_decontaminate.LOWER)
    places = [m.span() for m in test_decontaminate.WORD.finditer(lowered)]
    _, hit, _ = test_decontaminate.brute(text, items)
    out, at = [], 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out.append(text[at:places[i][0]])
        at = places[i][1]
    return "".join([*out, text[at:]])


def without_secrets(text, ratios):
    spans = [(a, b) for _, a, b in test_secret_scan.base(text)]
    for m in re.finditer(secret_scan.CANDIDATE % 20, text):
        w = m[0].rstrip("=")
        steps = [ratios[ord(x) * 128 + ord(y)] for x, y in zip(w, w[1:], strict=False)]
        if re.search("[A-Za-z]", m[0]) and not re.fullmatch(f"{secret_scan.ACCESS}|{secret_scan.HEX}", m[0]) and sum(steps) / len(steps) >= 0.25:
            spans.append(m.span())
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    plain = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, SMALL).write.parquet(path)
        out = spark.read.parquet(path)
        if name == "quality rules":
            plain = {i: v[2] for i, t in plain.items() if (v := test_quality_rules.verdict(t))[1]}
        elif name == "simhash near-dedup":
            fps = {i: test_simhash.plain_fingerprint(t) for i, t in plain.items()}
            root, least = test_simhash.roots(list(fps.values()), 2), {}
            for i in sorted(fps, reverse=True):
                least[root[fps[i]]] = i
            plain = {i: plain[i] for i in least.values()}
        elif name == "benchmark decontamination":
            plain = {i: without_passages(t, bench) for i, t in plain.items()}
        elif name == "secret scans":
            ratios = secret_scan.ratio_table(secret_scan.texts(docs))
            plain = {i: without_secrets(t, ratios) for i, t in plain.items()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert {r.doc_id: r.text for r in out.collect()} == plain, name
            assert out.where("n_chars <> length(text)").count() == 0
        docs = out
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.ids, r.n_tokens, r.decoded_sha256) for r in docs.collect()}
    assert got == {i: (e := encoding.encode_ordinary(t), len(e), hashlib.sha256(t.encode()).hexdigest()) for i, t in plain.items()}


def test_odd_rows_go_through_every_stage(spark, odd_documents):
    for docs in (odd_documents, odd_documents.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            n = out.count()
            assert n <= docs.count()
            if name in ("benchmark decontamination", "secret scans", "byte-level bpe"):
                assert n == docs.count()
            if name != "byte-level bpe":
                assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_only_the_last_stage_leaves_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "scratch_path", lambda _, name: str(tmp_path / name))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [p.name for p in tmp_path.iterdir()] == ["pipeline-byte-level-bpe"]
    assert out.count() > 0

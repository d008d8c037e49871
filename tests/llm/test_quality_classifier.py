import zlib

import numpy as np
import pytest

from gridcells.llm import quality_classifier as q


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def auc(pairs):
    order = np.argsort([s for s, _ in pairs], kind="stable")
    y = np.array([y for _, y in pairs])[order]
    rank = np.arange(1, len(y) + 1)
    pos = y.sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_sum_of_squares_is_the_sum_over_pairs():
    machine = q.Machine(20, 3)
    machine.w[:] = np.random.default_rng(0).normal(size=21)
    feature, value = np.array([1, 4, 7, 19]), np.array([0.5, 2.0, -1.0, 0.3])
    want = machine.w[-1] + (machine.w[feature] * value).sum() + sum(
        machine.v[a] @ machine.v[b] * x * y for i, (a, x) in enumerate(zip(feature, value, strict=True))
        for b, y in list(zip(feature, value, strict=True))[:i])
    assert np.isclose(machine.raw(1, np.zeros(4, int), feature, value)[0][0], want)


def test_held_out_accuracy(spark, documents, labels):
    out = {r.doc_id: r for r in q.score_quality(documents, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(out) == documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in out.items())
    pairs = [(out[d].score, y) for d, y in truth.items() if d in out and out[d].held_out]
    assert auc(pairs) > 0.95 and np.mean([(s >= 0.5) == y for s, y in pairs]) > 0.93


def test_only_text_and_length_count(spark, documents, labels):
    a = {r.doc_id: r.score for r in q.score_quality(documents, labels).collect()}
    changed = documents.selectExpr("doc_id", "text", "'xx' lang", "cast(rand() as string) source", "n_chars", "1 score", "true held_out")
    hidden = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) quality")
    b = {r.doc_id: r.score for r in q.score_quality(changed, hidden).collect()}
    assert a == b


def test_odd_rows(spark, odd_documents, labels):
    out = q.score_quality(odd_documents, labels).collect()
    assert len(out) == odd_documents.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in q.score_quality(odd_documents, labels.limit(0)).collect()} == {0.5}
    assert q.score_quality(odd_documents.limit(0), labels).count() == 0


def test_repeated_ids_make_the_sample_no_larger(spark, documents, labels):
    docs = documents.where("length(text) < 2000").select("doc_id", "text", "n_chars").checkpoint()
    texts = docs.select("text", "n_chars").limit(200)
    hot = texts.selectExpr(f"{labels.where(~q.held_out(labels.doc_id)).first().doc_id} doc_id", "text", "n_chars")
    a = q.score_quality(docs.union(hot), labels)
    assert a.count() == docs.count() + hot.count()
    copies = {(r.doc_id, r.score) for r in q.score_quality(docs.union(docs), labels).collect()}
    assert copies == {(r.doc_id, r.score) for r in q.score_quality(docs, labels).collect()}

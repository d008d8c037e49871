import re

import numpy as np
import pytest

from gridcells.llm.substring_dedup import COVERS, cover_for, remove_repeated_passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=20):
    """(n_words, n_removed, kept) of documents in the order of (id, nulls last)."""
    docs = [WORD.findall(t or "") for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), {}
    for i in order:
        words, gone = docs[i], set()
        for k in range(len(words) - width + 1):
            w = tuple(words[k:k + width])
            if w in seen:
                gone.update(range(k, k + width))
            seen.add(w)
        out[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return [out[i] for i in range(len(rows))]


def result(df, **kw):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeated_passages(df, **kw).collect()}


@pytest.mark.parametrize("modulus,members", COVERS)
def test_covers_align_any_two_positions(modulus, members):
    for i in range(modulus):
        for j in range(modulus):
            assert any((i + d) % modulus in members and (j + d) % modulus in members for d in range(modulus))


def test_cover_leaves_room_for_an_anchor():
    assert cover_for(20) == (13, (0, 1, 3, 9))
    for width in range(1, 80):
        assert 1 <= width - cover_for(width)[0] + 1


def test_equals_brute_force_on_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    want = {rows[i][0]: x for i, x in enumerate(brute(rows))}
    assert result(documents, block_bytes=200_000) == want
    assert sum(x[1] for x in want.values()) > 0


def test_random_overlaps(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        words = [str(x) for x in rng.integers(0, 50, 120)]
        if i % 3:
            other, at, n = rows[rng.integers(0, len(rows))][1].split(), rng.integers(0, 60), rng.integers(15, 45)
            words[at:at] = other[at:at + n]
        rows.append((int(i), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for width in (5, 20):
        want = {rows[i][0]: x for i, x in enumerate(brute(rows, width))}
        assert result(df, width=width, block_bytes=3000) == want


def test_odd_rows(spark, odd_documents):
    out = remove_repeated_passages(odd_documents).collect()
    assert len(out) == odd_documents.count()
    got = {(r.doc_id, r.n_words) for r in out}
    assert {(1, 0), (2, 0), (3, 0), (4, 5), (6, 1), (5, 8000), (None, 0), (None, 120)} <= got
    long = next(r for r in out if r.doc_id == 5 and r.n_words == 8000)
    assert long.kept_text == "alpha beta" and long.n_removed == 7998  # the window at word 2 repeats that at 0
    assert remove_repeated_passages(odd_documents.limit(0)).count() == 0


def test_one_block_a_task(spark, documents):
    out = remove_repeated_passages(documents, block_bytes=100_000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "shufflepartitionidpassthrough" in plan and "hashpartitioning(block" not in plan and "hashpartitioning(bucket" not in plan
    n = -(-documents.selectExpr("sum(octet_length(text)) as b").first().b // 100_000)
    assert out.rdd.getNumPartitions() == n

import hashlib
import random
import time
import zlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridcells.llm import periodic_runs
from gridcells.llm.common import texts


def plain(words, min_length=12):
    """All runs by comparing every word with those before it."""
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        k = q
        while k < n:
            a = k
            while k < n and words[k] == words[k - q]:
                k += 1
            start, length = a - q, k - a + q
            if length >= max(min_length, 2 * q) and not any(
                    all(words[x] == words[x - p] for x in range(start + p, start + length)) for p in range(1, q)):
                out.append((start, length, q))
            k += k == a
    return sorted(out, key=lambda r: (r[0], r[2]))


def through_stretches(words, min_length):
    _, a, b = periodic_runs.stretches(pa.array([" ".join(words)]), min_length)
    return [(x + s, n, q) for x, y in zip(a.tolist(), b.tolist(), strict=True) for s, n, q in periodic_runs.runs_of(words[x:y], min_length)]


@given(st.lists(st.sampled_from("ab"), max_size=50) | st.lists(st.sampled_from("abcd"), max_size=50), st.integers(1, 9), st.integers(0, 60))
@settings(max_examples=400, deadline=None)
def test_runs(words, period, start):
    words = words + [words[min(len(words) - 1, i % period)] for i in range(start)] if words else words
    for m in (1, 2, 5, 12):
        assert periodic_runs.runs_of(words, m) == plain(words, m) == through_stretches(words, m)


def test_last_ends_are_those_of_a_plain_search():
    rng = random.Random(1)
    for _ in range(60):
        words = [rng.randrange(rng.choice((2, 3))) for _ in range(40)]
        ends = periodic_runs.LastEnds()
        for i, w in enumerate(words):
            ends.append(w)
            seen = list(ends.recolour())
            for size in range(1, i + 2):
                suffix = words[i + 1 - size:i + 1]
                before = max((j for j in range(i) if j + 1 >= size and words[j + 1 - size:j + 1] == suffix), default=None)
                assert [j for j, lo, hi in seen if lo < size <= hi] == ([] if before is None else [before])


def planted(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = plain(words) if len(words) < 400 else through_stretches([w.decode() for w in words], 12)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def run(df):
    return sorted(map(tuple, periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_planted_periods(texts(df)))).collect()), key=str)


def test_documents(spark, documents, odd_documents):
    for df in (documents.where("n_chars < 2500").limit(400), odd_documents.where("length(text) < 20000 or text is null")):
        rows = df.select("doc_id", "text").collect()
        assert run(df) == sorted((expected(*r) for r in rows), key=str)
    assert run(odd_documents.limit(0)) == []


def test_a_long_periodic_text_takes_little_time(spark):
    text = " ".join(["alpha beta gamma"] * 40_000) + " " + " ".join(f"w{i % 977}" for i in range(40_000))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    began = time.time()
    row = periodic_runs.find_runs(df).first()
    assert [tuple(r) for r in row.runs] == [(0, 120_000, 3), (120_000, 40_000, 977)] and row.n_words == 160_000
    assert row.collapsed == " ".join(["alpha beta gamma", *(f"w{i}" for i in range(977))]) and time.time() - began < 60


def test_clashing_names_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b " * 6), (1, "a b " * 6), (2, "a b " * 5)], "id int, body string").withColumns(
        {"runs": F.lit(1), "text": F.lit("x"), "doc_id": F.lit("y"), "collapsed": F.lit(2)})
    got = sorted(map(tuple, periodic_runs.find_runs(df, "id", "body").selectExpr("doc_id", "n_words", "size(runs)", "collapsed").collect()))
    assert got == [(1, 12, 1, "a b"), (1, 12, 1, "a b"), (2, 10, 0, "a b a b a b a b a b")]

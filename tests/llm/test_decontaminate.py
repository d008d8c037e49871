import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridcells.llm.decontaminate import find_passages
from gridcells.llm.fm_index import FMIndex, Wavelet, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, width=10):
    """n_words, hit word numbers and ids of items with occurring windows."""
    own, hit, found = words(text), set(), set()
    at = {}
    for i, w in enumerate(own):
        at.setdefault(w, []).append(i)
    for item_id, body in items:
        w = words(body)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            window = w[k:k + width]
            for i in at.get(window[0], ()):
                if own[i:i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add("" if item_id is None else str(item_id))
    return len(own), hit, sorted(found)


def flat(r):
    return r.n_words, {k for h in r.hits for k in range(h.start, h.end)}, r["items"]


@given(st.lists(st.integers(1, 4), max_size=60), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=4), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_index_finds_all_occurrences(text, patterns):
    text, width = np.array(text, np.int64), max(map(len, patterns))
    index = FMIndex(text, 5, sample=3)
    rows = np.zeros((len(patterns), width), np.int64)
    for i, p in enumerate(patterns):
        rows[i, width - len(p):] = p
    lo, hi = index.search(rows, np.array([len(p) for p in patterns]))
    for i, p in enumerate(patterns):
        want = [k for k in range(len(text) - len(p) + 1) if list(text[k:k + len(p)]) == p]
        assert sorted(index.locate(np.arange(lo[i], hi[i]))) == want


@given(st.lists(st.integers(0, 9), min_size=1, max_size=300))
@settings(max_examples=40, deadline=None)
def test_wavelet_rank_and_access(symbols):
    symbols = np.array(symbols, np.int64)
    tree, at = Wavelet(symbols, 10), np.arange(len(symbols))
    assert (tree.access(at) == symbols).all()
    for s in range(10):
        assert (tree.rank(np.full(len(at), s), at) == [int((symbols[:i] == s).sum()) for i in at]).all()
    text = np.append(symbols + 1, 0)
    assert list(suffix_array(text)) == sorted(range(len(text)), key=lambda i: list(text[i:]))


def test_equals_brute_force(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    items += [(10_001, "the of"), (None, "Ea"), (10_002, ""), (10_003, None), (10_001, "THE to")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents.where("doc_id % 3 = 0")
    got = {r.doc_id: flat(r) for r in find_passages(docs, bench, shard_bytes=300_000).collect()}
    assert got == {r.doc_id: brute(r.text, items) for r in docs.collect()}
    assert sum(1 for x in got.values() if len(x[1]) >= 10) > 3


def test_item_blocks_and_clean_text(spark):
    items = [(1, "a b c d e f g h i j k l"), (2, "one two"), (3, "c d e f g h i j k l m n")]
    docs = [(1, "x, A-b c; d e f g h i J k z"), (2, "one\ntwo one two"), (3, None), (4, ""), (5, "nothing"), (5, "nothing"),
            (6, "é one. TWO! é " * 3000)]
    bench, df = spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string")
    for size in (16 << 20, 10):
        out = find_passages(df, bench, item_block_bytes=size, clean=True).collect()
        assert len(out) == len(docs)
        for r in out:
            assert flat(r) == brute(r.text, items)
        clean = {r.doc_id: r.clean for r in out}
        assert clean[1] == "x,  z" and clean[2] == "" and clean[3] is None and clean[6] == "é ! é " * 3000


def test_odd_rows(spark, odd_documents):
    bench = spark.createDataFrame([("b", "alpha beta alpha", 1), (None, None, 2)], "item_id string, text string, hits int")
    out = find_passages(odd_documents, bench).collect()
    assert len(out) == odd_documents.count()
    assert {(r.doc_id, len(r.hits)) for r in out if r.hits} == {(5, 1)}
    assert find_passages(odd_documents, bench.limit(0)).where("size(hits) > 0").count() == 0
    assert find_passages(odd_documents.limit(0), bench).count() == 0


def test_many_item_blocks_write_hits_and_no_texts(spark, documents, monkeypatch):
    from gridcells.llm import decontaminate

    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents.where("doc_id % 4 = 0").select("*", documents.text.alias("key"), documents.n_chars.alias("hits"))
    docs = docs.union(docs.limit(20))
    written = []
    monkeypatch.setattr(decontaminate, "cut", lambda df: written.append(df.columns) or df)
    size = sum(len(t) for _, t in items) // 3
    got = sorted((r.doc_id, flat(r)) for r in find_passages(docs, bench, item_block_bytes=size).collect())
    assert got == sorted((r.doc_id, flat(r)) for r in find_passages(docs, bench).collect())
    assert len(written) >= 3 and all(c == ["key", "hits", "items"] for c in written)
    one, many = (decontaminate.remove_passages(docs, bench, item_block_bytes=n) for n in (16 << 20, size))
    assert one.columns == many.columns == docs.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))

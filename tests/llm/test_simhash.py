import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from gridcells.llm import simhash
from gridcells.llm.graph import components


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, bits):
    """Least member of each fingerprint's component, by comparing all pairs."""
    fps, up = sorted(set(fps)), {}
    for x in fps:
        up[x] = x
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= bits:
                a, b = find(x), find(y)
                up[max(a, b)] = min(a, b)
    return {x: find(x) for x in fps}


@given(st.text(alphabet="aB é\n\t\x0b", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def clustered(seed, n):
    rng = np.random.default_rng(seed)
    base = [int(x) for x in rng.integers(0, 2**63, n // 6)]
    out = list(base)
    while len(out) < n:
        x = out[rng.integers(0, len(out))]
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            x ^= 1 << int(b)
        out.append(x)
    return sorted(set(out))


def test_tree_loses_no_pair():
    for seed in range(4):
        fps = clustered(seed, 900)
        want, arr = roots(fps, 2), np.array(fps, np.uint64)
        tree = simhash.Tree(arr[::7], 6)
        assert tree.shards > 2
        pairs = set()
        homes = 0
        for _, f, h in tree.deal(arr, 2):
            homes += h.sum()
            order = np.argsort(f)
            label = simhash.link_within(f[order], h[order], 2)
            pairs |= {(int(f[order][i]), int(f[order][x])) for i, x in enumerate(label)}
        assert homes == len(fps)
        up = {x: x for x in fps}
        def find(x):
            while up[x] != x:
                x = up[x]
            return x
        for a, b in pairs:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        assert {x: find(x) for x in fps} == want


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1080)]
    up = {}
    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in up}


def test_equals_brute_force(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    root = roots(list(fps.values()), 2)
    least = {}
    for d, f in fps.items():
        least[root[f]] = min(d, least.get(root[f], d))
    want = {d: (f, least[root[f]]) for d, f in fps.items()}
    for fan in (1024, 3):
        out = simhash.near_duplicates(documents, shard_size=100, sample_per_shard=20, fan=fan).collect()
        assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in out} == want
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_trees_grown_in_shards_lose_no_pair(spark):
    """Shards of shards: fingerprints in clusters, some shards without a sampled fingerprint, against all pairs."""
    for seed, per_shard in ((1, 20), (2, 4), (3, 1)):
        fps = clustered(seed, 1500)
        table = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp bigint").repartition(3)
        found = simhash.links(table, 2, shard_size=40, sample_per_shard=per_shard, fan=3)
        up = {x: x for x in fps}
        def find(x):
            while up[x] != x:
                x = up[x]
            return x
        for r in found.collect():
            a, b = find(r.a % 2**64), find(r.b % 2**64)
            up[max(a, b)] = min(a, b)
        assert {x: find(x) for x in fps} == roots(fps, 2)


def test_odd_rows(spark, odd_documents):
    out = simhash.near_duplicates(odd_documents).collect()
    assert len(out) == odd_documents.count()
    by = {(r.doc_id, r.fp): r.component_id for r in out}
    assert by[1, 0] == by[2, 0] == by[3, 0] == by[None, 0] == 1
    kept = simhash.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    got = [(r.doc_id, r.fingerprint) for r in kept.collect()]
    assert len([x for x in got if x[0] == 4]) == 1 and (1, "a") in got and (2, None) not in got and (None, "d") in got
    assert simhash.keep_one(odd_documents.limit(0)).count() == 0


def test_working_names_are_left_alone(spark):
    rows = [(1, "a b c d", "x", 2), (1, "a b c d", "y", 1), (2, "a b c d", "z", 0), (3, "e f g h i", None, 4)]
    df = spark.createDataFrame(rows, "doc_id int, text string, id string, tie int").withColumns({"__id": F.lit(1), "__tie": F.lit("t"), "n": F.lit(9), "row": F.lit(0)})
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(map(tuple, kept.collect()))
    assert len(got) == 2 and got[0][:3] in ((1, "a b c d", "x"), (1, "a b c d", "y")) and got[1] == (3, "e f g h i", None, 4, 1, "t", 9, 0)
    assert got == sorted(map(tuple, simhash.keep_one(df.repartition(4)).collect()))

"""Near-duplicates by SimHash: a vantage-point tree finds all fingerprint pairs within a distance.

Fingerprint.  A-Z become a-z; words are ``[^\\x20\\x09-\\x0D]+``; shingles of ``shingle`` words,
repeats included, are joined by a space (a text of fewer words is one shingle) and hashed by XXH64
with seed 42; a bit is set if it is set in over half the hashes.  A text without words
(null, empty) has fingerprint zero, which is linked like any other.

Search.  Equal fingerprints are grouped first, so copies cost one row.  The upper levels of a
vantage-point tree, built from a sample (about ``sample_per_shard`` fingerprints for each
shard; the sample chooses vantage points and radii and nothing else), split all fingerprints by Hamming distance into
shards.  The driver grows a tree of at most ``fan`` shards, from about ``fan * sample_per_shard`` fingerprints whatever the
input; where more are needed, each of these shards grows a tree of its own in a task, from its own part of the sample, and so on.  By the triangle bound a partner of x across a radius r from vantage v has a distance
from v within ``max_bits`` of x's; so a fingerprint inside the radius by less than that
also visits the outer side, and a visitor goes on to every side its bounds cannot rule out.
Each pair meets exactly where one of the two is at home.  Within a shard the tree goes on to
small leaves, where distances are counted.  A shard sends on at most one edge for
each of its fingerprints, towards the least one it is connected to there.

Cases.  Rows that share a doc_id each get their result; a null doc_id is linked by its text but
is never the smallest id; ``component_id`` is null if all ids of a component are.  A very long text costs its own
task only; an empty table gives no rows; columns other than id and text are left behind, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcells.llm.common import cut, text_key, texts
from gridcells.llm.graph import components

LEAF = 512
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed=42)
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    pairs = zip((ends - sizes).tolist(), ends[shingle - 1:].tolist(), strict=False)
    n = len(words) - shingle + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed=42) for a, b in pairs), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        ones += np.unpackbits(hashes[k:k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, tie, fp``: the fingerprint as a signed number, and a hash of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "tie": b.column("tie"), "fp": fps.view(np.int64)})
    return texts(df, id_col, text_col).withColumn("tie", text_key()).mapInArrow(run, "doc_id bigint, tie bigint, fp bigint")


def distance(fps: np.ndarray, other: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ other).astype(np.int64)


def split_rule(fps: np.ndarray) -> tuple[np.uint64, int] | None:
    """Vantage point and radius: of a few candidates the one whose distances spread most."""
    if len(fps) < 2:
        return None
    seen = fps[:: max(1, len(fps) // 256)]
    vantage = max(fps[:: max(1, len(fps) // 8)], key=lambda v: (distance(seen, v).std(), int(v)))
    far = distance(fps, vantage)
    radius = int(np.median(far))
    if radius >= far.max():
        radius = int(far[far < far.max()].max(initial=-1))
    return (vantage, radius) if far.min() <= radius < far.max() else None


def sides(fps: np.ndarray, home: np.ndarray, rule: tuple[np.uint64, int], bits: int):
    """(fingerprints, at home) of the inner and the outer side."""
    far = distance(fps, rule[0])
    inside = far <= rule[1]
    inner = np.where(home, inside, far <= rule[1] + bits)
    outer = (home & ~inside) | (far > rule[1] - bits)
    return (fps[inner], home[inner]), (fps[outer], (home & ~inside)[outer])


class Tree:
    """Upper levels: rules of inner nodes; children are node numbers or, negative, shards."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.rules, self.children, self.shards = [], [], 0
        self.root = self._grow(np.unique(sample), shards)

    def _grow(self, sample: np.ndarray, shards: int) -> int:
        rule = split_rule(sample) if shards > 1 else None
        if rule is None:
            self.shards += 1
            return -self.shards
        node = len(self.rules)
        self.rules.append(rule)
        self.children.append(None)
        inside = distance(sample, rule[0]) <= rule[1]
        part = min(shards - 1, max(1, round(shards * inside.mean())))
        self.children[node] = (self._grow(sample[inside], part), self._grow(sample[~inside], shards - part))
        return node

    def deal(self, fps: np.ndarray, bits: int, home: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        stack = [(self.root, fps, np.ones(len(fps), bool) if home is None else home)]
        while stack:
            node, fps, home = stack.pop()
            if not len(fps):
                continue
            if node < 0:
                yield -node, fps, home
            else:
                for child, (f, h) in zip(self.children[node], sides(fps, home, self.rules[node], bits), strict=True):
                    stack.append((child, f, h))


class Labels:
    """Connected components of pairs that come in parts; a label is the least member's number."""

    def __init__(self, n: int):
        self.of, self.parts, self.waiting = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.parts.append((a, b))
        self.waiting += len(a)
        if self.waiting > 500_000:
            self.merge()

    def merge(self) -> np.ndarray:
        if self.parts:
            a, b = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            while len(a):
                la, lb = self.of[a], self.of[b]
                differ = la != lb
                if not differ.any():
                    break
                a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
                np.minimum.at(self.of, np.maximum(la, lb), np.minimum(la, lb))
                while (self.of != (up := self.of[self.of])).any():
                    self.of = up
            self.parts, self.waiting = [], 0
        return self.of


def link_within(fps: np.ndarray, home: np.ndarray, bits: int) -> np.ndarray:
    """Labels of sorted distinct fingerprints: pairs within ``bits`` of which one is at home."""
    labels = Labels(len(fps))
    stack = [(fps, home)]
    while stack:
        part, own = stack.pop()
        homes = part[own]
        if not len(homes):
            continue
        rule = split_rule(homes) if len(homes) > LEAF else None
        if rule is not None:
            stack += sides(part, own, rule, bits)
            continue
        for k in range(0, len(homes), LEAF):
            block = homes[k:k + LEAF]
            for j in range(0, len(part), 4096):
                near = np.bitwise_count(part[j:j + 4096, None] ^ block[None, :]) <= bits
                x, y = np.nonzero(near)
                a, b = part[j + x], block[y]
                a, b = a[a != b], b[a != b]
                if len(a):
                    labels.add(np.searchsorted(fps, a), np.searchsorted(fps, b))
    return labels.merge()


DEALT = "shard bigint, fps binary, home binary"


def dealt(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> dict[str, pa.Array]:
    return {"shard": pa.array([s for s, _, _ in parts], pa.int64()),
            "fps": pa.array([f.tobytes() for _, f, _ in parts], pa.binary()),
            "home": pa.array([h.tobytes() for _, _, h in parts], pa.binary())}


def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a shard and whether they are at home there."""
    return (np.frombuffer(b"".join(table["fps"].to_pylist()), np.uint64),
            np.frombuffer(b"".join(table["home"].to_pylist()), bool))


def deal_from_top(fps: DataFrame, tree: Tree, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict(dealt(list(tree.deal(b.column("fp").to_numpy().view(np.uint64), bits))))
    return fps.select("fp").mapInArrow(run, DEALT)


def grow_trees(sample: DataFrame, rate: int, shard_size: int, sample_per_shard: int, fan: int) -> DataFrame:
    """``shard, tree`` for the shards that the sample, one fingerprint in ``rate``, shows to be too large."""
    def run(table: pa.Table) -> pa.Table:
        fps = np.unique(gathered(table)[0])
        shards = min(fan, -(-len(fps) * rate // shard_size))
        grown = [pickle.dumps(Tree(fps[::max(1, len(fps) // (sample_per_shard * fan))], shards))] if shards > 1 else []
        return pa.table({"shard": table["shard"][:len(grown)], "tree": pa.array(grown, pa.binary())})
    return sample.groupBy("shard").applyInArrow(run, "shard bigint, tree binary")


def deal_further(rows: DataFrame, trees: DataFrame, parts: int, bits: int, fan: int) -> DataFrame:
    """Every shard dealt by its own tree, in ``parts`` tasks a shard; a shard without a tree stays as it is."""
    def run(found: pa.Table, trees: pa.Table) -> pa.Table:
        if not found.num_rows:
            return pa.table(dealt([]))
        base, (fps, home) = found["shard"][0].as_py() * (fan + 1), gathered(found)
        if not trees.num_rows:
            return pa.table(dealt([(base, fps, home)]))
        tree = pickle.loads(trees["tree"][0].as_py())
        return pa.table(dealt([(base + s, f, h) for s, f, h in tree.deal(fps, bits, home)]))

    rows = rows.withColumn("part", F.pmod(F.xxhash64("fps"), F.lit(parts)).cast("int"))
    trees = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.groupBy("shard", "part").cogroup(trees.groupBy("shard", "part")).applyInArrow(run, DEALT)


def links(fps: DataFrame, max_bits: int, shard_size: int, sample_per_shard: int, fan: int) -> DataFrame:
    """``a, b``: a few edges that connect what pairs within ``max_bits`` connect."""
    shards = max(1, -(-fps.count() // shard_size))
    left = -(-shards // fan)                 # shards to be made of each shard of the top
    rate = max(1, shard_size // sample_per_shard)
    chosen = F.xxhash64("fp", F.lit("sample"))
    top = np.zeros(0, np.int64)
    if shards > 1:
        top = fps.where(F.pmod(chosen, F.lit(rate * left)) == 0).select("fp").toArrow()["fp"].to_numpy()
    tree = Tree(top.view(np.uint64), min(shards, fan))
    rows = deal_from_top(fps, tree, max_bits)
    sample = deal_from_top(fps.where(F.pmod(chosen, F.lit(rate)) == 0), tree, 0) if left > 1 else None
    while left > 1:
        trees = cut(grow_trees(sample, rate, shard_size, sample_per_shard, fan))
        rows, sample = (deal_further(x, trees, left, bits, fan) for x, bits in ((rows, max_bits), (sample, 0)))
        left = -(-left // fan)

    def search(table: pa.Table) -> pa.Table:
        fps, home = gathered(table)
        order = np.argsort(fps)
        fps, home = fps[order], home[order]
        label = link_within(fps, home, max_bits)
        out = np.flatnonzero(label != np.arange(len(fps)))
        return pa.table({"a": fps[out].view(np.int64), "b": fps[label[out]].view(np.int64)})

    return rows.groupBy("shard").applyInArrow(search, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2,
                    shard_size: int = 1 << 15, sample_per_shard: int = 64, fan: int = 1024) -> DataFrame:
    """``doc_id, tie, fp, root, component_id`` for every row; ``root`` names the component."""
    docs = cut(fingerprints(df, id_col, text_col, shingle))
    groups = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(groups, max_bits, shard_size, sample_per_shard, fan))
    groups = groups.join(found, groups.fp == found.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    return docs.join(groups.join(least, "root").select("fp", "root", "component_id"), "fp")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row with the smallest
    doc_id (null last; then by a hash of the text) stays, once (of rows that share both, the one with the smallest hash of all columns).

    Rows without words, null texts among them, are one component; an empty table gives no rows; other columns are left alone,
    whatever their names."""
    none = -(1 << 63)
    best = (near_duplicates(df, id_col, text_col, **how)
            .groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tie")).alias("one"))
            .select(F.coalesce("one.doc_id", F.lit(none)).alias("id"), F.col("one.tie").alias("tie")).distinct())
    columns = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(none)).alias("id"),
                     F.coalesce(F.xxhash64(F.col(f"`{text_col}`").cast("string")), F.lit(0)).alias("tie"),
                     F.xxhash64(*columns).alias("all"), F.struct(*columns).alias("row"))
    # one exchange of the rows, by id and tie, serves the join and the choice
    order = Window.partitionBy("id", "tie").orderBy("all")
    first = rows.join(best, ["id", "tie"], "left_semi").withColumn("n", F.row_number().over(order)).where("n = 1")
    return first.select(*(F.col(f"row.`{c}`") for c in df.columns))

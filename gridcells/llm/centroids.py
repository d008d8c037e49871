"""Centroid clustering of integer vectors with a pivot table (LAESA).

Vectors of exactly ``width`` finite components become integers, floor(scale * x).  The distances of every vector to a few fixed
pivots are computed once and stored beside it.  In each round the distances of the centroids to the pivots
are computed, and the largest difference of two such distances is a lower bound of a vector's distance to a
centroid.  A vector first measures the centroid with the least bound, then only those whose bound does not
exceed that distance; these get exact integer distances, and of equal ones the smaller number wins.  Centroids move to the
componentwise floor of the mean; an empty one stays.

Jobs.  Vectors are packed into blocks of ``block`` rows, which are written once (they are never shuffled); a round is one pass over the
blocks, which sends one row of sums for each cluster and task, added up by Spark to ``k`` rows for the
driver.  Start vectors are the first ``k`` by a hash of their id: a sort that keeps ``k`` rows a task.

Exactness.  Bounds are floating point and are lowered by more than their rounding; distances and sums are integers.
Components beyond 2**24 are measured with Python's integers; a distance or sum beyond 64 bits is null.

Cases.  A null vector, one of another length, and one with a null or non-finite component are left out; rows with the same id are
vectors of their own (equal hashes go by components); a null id sorts last as a start vector; with fewer than ``k``
vectors there are so many centroids; an empty table gives no rows; columns other than id and vector are left behind,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcells.llm.common import cut, share_code

SMALL = 1 << 24
LONG = 1 << 63


@dataclass(frozen=True)
class Centroids:
    """Integer vectors (rows of Python integers), and the pivots, the first ones."""

    at: list[list[int]]
    pivots: list[list[int]]

    def is_small(self) -> bool:
        return all(-SMALL <= x <= SMALL for row in self.at for x in row)

    def matrix(self, exact: bool) -> np.ndarray:
        return np.array(self.at, dtype=object if exact else np.int64).reshape(len(self.at), -1)


def usable(df: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    """``vec_id, v`` of the vectors that are kept, as doubles."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.when((F.size(x) == width) & ~bad, x).alias("v")).where("v is not null")


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers or, if any is large, as Python's."""
    out = np.floor(values * float(scale))
    if out.size and np.abs(out).max() > SMALL:
        exact = np.empty(out.shape, object)
        exact.flat = [int(x) if np.isfinite(x) else int(v) * scale for x, v in zip(out.flat, values.flat, strict=True)]
        return exact
    return out.astype(np.int64)


def square_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def root(square: int) -> float:
    if square < 1 << 1000:
        return math.sqrt(square)
    whole = math.isqrt(square)
    return float(whole) if whole < 1 << 1000 else math.inf


def roots(squares: np.ndarray) -> np.ndarray:
    if squares.dtype == object:
        return np.array([root(int(x)) for x in squares], np.float64)
    return np.sqrt(squares.astype(np.float64))


def pivot_distances(vectors: np.ndarray, pivots: list[list[int]]) -> np.ndarray:
    """Distances to every pivot, a column each."""
    exact = vectors.dtype == object or any(abs(x) > SMALL for p in pivots for x in p)
    table = vectors.astype(object) if exact else vectors
    return np.stack([roots(square_distance(table, np.array(p, dtype=table.dtype))) for p in pivots], axis=1) if len(vectors) else np.zeros((0, len(pivots)))


def lower_bounds(far: np.ndarray, to_pivots: np.ndarray) -> np.ndarray:
    """Bounds of the distances of vectors (rows) to centroids (columns), lowered by more than the rounding."""
    out = np.zeros((len(far), len(to_pivots)))
    for j in range(far.shape[1]):
        a, b = far[:, j, None], to_pivots[None, :, j]
        known = np.isfinite(a) & np.isfinite(b)
        with np.errstate(invalid="ignore"):
            bound = np.abs(a - b) - 1e-12 * (a + b)
        np.maximum(out, np.where(known, bound, 0.0), out=out)
    return out


def assign(vectors: np.ndarray, far: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each vector, and how many distances were measured."""
    exact = vectors.dtype == object or not centroids.is_small()
    table = vectors.astype(object) if exact else vectors
    at = centroids.matrix(exact)
    bound = lower_bounds(far, pivot_distances(at, centroids.pivots))
    rows = np.arange(len(table))
    cluster = bound.argmin(axis=1)
    best = square_distance(table, at[cluster])
    first, measured = cluster.copy(), len(table)
    for c in range(len(at)):
        near = rows[(first != c) & (bound[:, c] <= roots(best) * (1 + 1e-12))]
        d = square_distance(table[near], at[c])
        better = (d < best[near]) | ((d == best[near]) & (c < cluster[near]))
        best[near[better]], cluster[near[better]] = d[better], c
        measured += len(near)
    return cluster, best, measured


def pack(vec_id: pa.Array, v: pa.Array, scale: int, width: int, pivots: list[list[int]]) -> dict:
    """One block: ids, integer components (as 32 or 64 bits, or text) and pivot distances."""
    vectors = scaled(v.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale)
    far = pivot_distances(vectors, pivots)
    raw = " ".join(map(str, vectors.flat)).encode() if vectors.dtype == object else vectors.astype(np.int32).tobytes()
    return {"vec_id": vec_id, "large": vectors.dtype == object, "v": raw, "far": far.tobytes()}


def unpack(row: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    if row["large"]:
        flat = row["v"].split()
        vectors = np.empty(len(flat), object)
        vectors[:] = [int(x) for x in flat]
    else:
        vectors = np.frombuffer(row["v"], np.int32).astype(np.int64)
    vectors = vectors.reshape(-1, width)
    return vectors, np.frombuffer(row["far"]).reshape(len(vectors), -1)


BLOCK = pa.schema([("vec_id", pa.list_(pa.int64())), ("large", pa.bool_()), ("v", pa.binary()), ("far", pa.binary())])


def blocks(kept: DataFrame, scale: int, width: int, pivots: list[list[int]], block: int) -> DataFrame:
    """The vectors and their pivot distances, ``block`` to a row, written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, block):
                part = batch.slice(k, block)
                row = pack(part.column("vec_id"), part.column("v"), scale, width, pivots)
                yield pa.RecordBatch.from_pylist([row | {"vec_id": row["vec_id"].to_pylist()}], schema=BLOCK)
    return cut(kept.mapInArrow(run, "vec_id array<bigint>, large boolean, v binary, far binary"))


def decimals(x) -> str:
    return ",".join(map(str, x))


def sums(packed: DataFrame, centroids: Centroids, width: int, large: bool) -> dict[int, tuple[int, list[int], int]]:
    """Count, componentwise sum and summed distance of each cluster, ``k`` rows in all.  Sums travel as low 32 bits and the rest,
    so that none overflows; of a table with ``large`` components, those beyond that as text, a row for each cluster and task."""
    def split(x: int) -> list[int]:
        return [x & 0xFFFFFFFF, x >> 32]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                vectors, far = unpack(row, width)
                cluster, d, _ = assign(vectors, far, centroids)
                for c in np.unique(cluster).tolist():
                    mine = cluster == c
                    new = [int(mine.sum()), sum(d[mine].tolist()), *map(int, vectors[mine].sum(axis=0))]
                    total[c] = [a + b for a, b in zip(total[c], new, strict=True)] if c in total else new
        if total:
            many = [[part for x in total[c] for part in split(x)] for c in total]
            far_out = [any(abs(x) >= LONG for x in row) for row in many]
            yield pa.RecordBatch.from_pydict({"c": pa.array(list(total), pa.int32()), "s": pa.array(many if not any(far_out) else [
                None if bad else row for row, bad in zip(many, far_out, strict=True)], pa.list_(pa.int64())),
                "text": pa.array([decimals(total[c]) if bad else None for c, bad in zip(total, far_out, strict=True)], pa.string())})
    parts = packed.mapInArrow(run, "c int, s array<bigint>, text string")
    added = parts.select("c", F.posexplode("s").alias("i", "x")).groupBy("c", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    halves = {(row.c, row.i): int(row.x) for row in added.collect()}        # one row a cluster and half of a sum
    total = {c: [halves[c, i] + (halves[c, i + 1] << 32) for i in range(0, 2 * (width + 2), 2)] for c, i in halves if not i}
    for row in parts.where("text is not null").collect() if large else ():  # sums of vectors beyond 64 bits
        new = list(map(int, row.text.split(",")))
        total[row.c] = [a + b for a, b in zip(total[row.c], new, strict=True)] if row.c in total else new
    return {c: (x[0], x[2:], x[1]) for c, x in total.items()}


def start_vectors(kept: DataFrame, k: int, salt: str, scale: int) -> list[list[int]]:
    """The first ``k`` vectors by the SHA-256 of salt and id."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = kept.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return [[int(x) for x in scaled(np.array([row.v], np.float64), scale)[0]] for row in rows]


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 64, scale: int = 1024, k: int = 8,
                    rounds: int = 10, salt: str = "3:", block: int = 4096) -> DataFrame:
    """``vec_id, cluster, distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid`` (its components) of every kept vector."""
    spark = df.sparkSession
    share_code(spark)
    kept = usable(df, id_col, vector_col, width)
    start = start_vectors(kept, k, salt, scale)
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
    if not start:
        return spark.createDataFrame([], schema)
    now = Centroids(start, start)                            # the start vectors serve as pivots
    packed = blocks(kept, scale, width, start, block)
    large = packed.where("large").limit(1).count() > 0
    for _ in range(rounds):
        found = sums(packed, now, width, large)
        at = [[x // found[c][0] for x in found[c][1]] if c in found else now.at[c] for c in range(len(now.at))]
        if at == now.at:
            break                                            # every further round would give the same
        now = Centroids(at, start)
    inertia = {c: d for c, (_, _, d) in sums(packed, now, width, large).items()}
    whole, last = sum(inertia.values()), now

    def fits(x: int) -> int | None:
        return x if -LONG <= x < LONG else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cluster, d, _ = assign(*unpack(row, width), last)
                of = cluster.tolist()
                yield pa.RecordBatch.from_pydict({
                    "vec_id": pa.array(row["vec_id"], pa.int64()), "cluster": pa.array(of, pa.int32()),
                    "distance": pa.array([fits(int(x)) for x in d], pa.int64()),
                    "cluster_inertia": pa.array([fits(inertia[c]) for c in of], pa.int64()),
                    "inertia": pa.array([fits(whole)] * len(of), pa.int64())})
    out = packed.mapInArrow(run, schema.rsplit(",", 1)[0])
    centroid = F.get(F.array(*(F.array(*(F.lit(fits(x)).cast("bigint") for x in row)) for row in last.at)), F.col("cluster"))
    return out.withColumn("centroid", centroid)


def digests(found: DataFrame) -> DataFrame:
    """The centroid as a digest of its components."""
    return found.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")

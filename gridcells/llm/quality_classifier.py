"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise
interactions in time linear in the words of a text.

Features.  Lower-cased (A-Z) words are hashed to ``2**bits`` places, with log(1 + count) scaled to
length one.  Structure: size, word length, shares of symbols, separators, digits, capitals, other
scripts and repeated words, windows and lines.  Metadata: the log of the ``n_chars`` column, and whether it is missing.
Neither ids nor labels, language or source enter a score.

Training uses a bounded sample: of the labelled rows that are not held out, those a hash of the id
picks so that about ``train_rows`` are left.  Rows are featurised where they are; one task fits the
sample (its size does not depend on the corpus).  All rows are scored in place, without a shuffle.

Cases.  Rows that share an id are all scored; of a sampled id one text is trained on, so repeated ids make the sample no
larger.  A very long text costs its own task only; an empty table gives no rows; columns other than these are left
behind, whatever their names.  Held out are ids with crc32 of their text modulo 3 equal to 1 (a null id is not, and has
no label).  Null and empty texts have no words and are scored by the rest.  Null labels do not
count; of several labels of an id the largest counts.  Without any label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcells.llm.common import share_code
from gridcells.llm.tokens import U64, slices, window_hashes, words_of

STATISTICS = 14
SHARD = 4 << 20
RESULT = "doc_id bigint, score double"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def repeats(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each text how many of its keys are there more than once."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o[same[1:] | same[:-1]], minlength=n)


def features(batch: pa.RecordBatch, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of a batch ``text, n_chars``; statistics come after the words."""
    n = batch.num_rows
    raw, low = words_of(batch.column("text")), words_of(batch.column("text"), lower=True)
    owner, counts = raw.text_of(), np.maximum(raw.counts, 1)
    hashes = low.hashes()
    key, times = np.unique(owner.astype(np.int64) << bits | (hashes >> U64(64 - bits)).astype(np.int64), return_counts=True)
    row, value = key >> bits, np.log1p(times)
    value /= np.sqrt(np.bincount(row, value * value, n))[row]

    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[raw.offsets])
    size = np.maximum(np.diff(raw.offsets), 1)
    kind = np.zeros(256, np.uint8)
    kind[[ord(c) for c in "#*$%&<>"]], kind[ord("|")], kind[48:58], kind[65:91], kind[128:] = 1, 2, 3, 4, 5
    kinds = kind[raw.data]
    lines = np.flatnonzero(raw.data == 10)
    line_of = np.searchsorted(lines, raw.start)                  # words of a line share its number
    line_keys = np.zeros(int(line_of.max(initial=-1)) + 1, U64)
    np.add.at(line_keys, line_of, hashes * (raw.start - np.concatenate([[0], lines + 1])[line_of] + 1).astype(U64))
    line_owner = np.zeros(len(line_keys), np.int64)
    line_owner[line_of] = owner
    used = np.unique(line_of)
    windows = window_hashes(hashes, 3)
    inside = np.flatnonzero(owner[:len(windows)] == owner[2:][:len(windows)])
    n_chars = batch.column("n_chars")
    missing = n_chars.is_null().to_numpy(zero_copy_only=False)
    known = n_chars.fill_null(0).to_numpy(zero_copy_only=False).astype(float)
    stats = np.stack([
        np.log1p(raw.counts) / 10, np.bincount(owner, raw.end - raw.start, n) / counts / 10,
        sums(kinds == 1) / counts, sums(kinds == 2) / counts, sums(kinds == 3) / size, sums(kinds == 4) / size, sums(kinds == 5) / size,
        np.bincount(row, times > 1, n) / counts, repeats(windows[inside], owner[inside], n) / counts,
        repeats(line_keys[used], line_owner[used], n) / np.maximum(np.bincount(line_owner[used], minlength=n), 1),
        np.bincount(line_owner[used], minlength=n) / counts, (raw.counts == 0).astype(float),
        np.where(missing, 0, np.log1p(np.maximum(known, 0)) / 10), missing.astype(float)], axis=1)
    r, c = np.nonzero(stats)
    return (np.concatenate([row, r]), np.concatenate([key & ((1 << bits) - 1), c + (1 << bits)]),
            np.concatenate([value, np.minimum(stats[r, c], 2)]))


class Machine:
    """Weights: bias, linear and factors; ``raw`` gives log-odds of n rows."""

    def __init__(self, size: int, factors: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.w = np.zeros(size + 1)
        self.v = rng.normal(0, 0.05, (size, factors))

    def raw(self, n: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, sums = self.w[-1] + np.bincount(row, self.w[feature] * value, n), []
        for f in range(self.v.shape[1]):
            part = self.v[feature, f] * value
            sums.append(np.bincount(row, part, n))
            out += 0.5 * (sums[-1] ** 2 - np.bincount(row, part * part, n))
        return out, np.stack(sums, axis=1)

    def fit(self, labels: np.ndarray, row, feature, value, epochs: int = 30, size: int = 256, rate: float = 0.02, decay: float = 1e-5):
        """Adam on the log loss, in batches of rows."""
        order = np.argsort(row, kind="stable")
        row, feature, value = row[order], feature[order], value[order]
        first = np.searchsorted(row, np.arange(len(labels) + 1))
        rng, step = np.random.default_rng(1), 0
        state = [np.zeros_like(x) for x in (self.w, self.w, self.v, self.v)]
        for _ in range(epochs):
            for rows in np.split(shuffled := rng.permutation(len(labels)), range(size, len(shuffled), size)):
                sizes = first[rows + 1] - first[rows]
                at = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                r, x, f = np.repeat(np.arange(len(rows)), sizes), value[at], feature[at]
                z, sums = self.raw(len(rows), r, f, x)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows)
                gw = np.append(np.bincount(f, error[r] * x, len(self.v)), error.sum()) + decay * self.w
                gv = np.stack([np.bincount(f, error[r] * x * (sums[r, k] - self.v[f, k] * x), len(self.v))
                               for k in range(self.v.shape[1])], axis=1) + decay * self.v
                step += 1
                for p, g, m, s in ((self.w, gw, *state[:2]), (self.v, gv, *state[2:])):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)

    def scores(self, batch: pa.RecordBatch, bits: int) -> np.ndarray:
        z, _ = self.raw(batch.num_rows, *features(batch, bits))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def inputs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    chars = F.col("n_chars").cast("bigint") if "n_chars" in df.columns else F.lit(None).cast("bigint")
    share_code(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                     F.col(f"`{text_col}`").cast("string").alias("text"), chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, label_col: str, bits: int, factors: int, train_rows: int) -> Machine:
    """``docs`` as of ``inputs``; ``labels`` has doc_id and the label."""
    usable = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
              .where("label is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label")))
    every = max(1, -(-usable.count() // train_rows))
    some = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, SHARD)):
            row, feature, value = features(b, bits)
            order = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[order], np.arange(1, b.num_rows))
            yield pa.RecordBatch.from_pydict({
                "one": pa.array(np.ones(b.num_rows, np.int32)), "doc_id": b.column("doc_id"), "label": b.column("label"),
                "feature": pa.array([x.tobytes() for x in np.split(feature[order], cuts)], pa.binary()),
                "value": pa.array([x.tobytes() for x in np.split(value[order], cuts)], pa.binary())})

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("feature", "ascending"), ("value", "ascending")])
        feature = [np.frombuffer(x, np.int64) for x in table["feature"].to_pylist()]
        value = [np.frombuffer(x, np.float64) for x in table["value"].to_pylist()]
        machine = Machine((1 << bits) + STATISTICS, factors)
        machine.fit(table["label"].to_numpy(zero_copy_only=False).astype(float), np.repeat(np.arange(len(value)), list(map(len, value))),
                    np.concatenate(feature), np.concatenate(value))
        return pa.table({"w": pa.array([machine.w.tobytes()], pa.binary()), "v": pa.array([machine.v.tobytes()], pa.binary())})

    # of rows that share an id, the text with the smallest hash: the fitting task meets one row a sampled label
    met = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(
        F.min_by(F.struct("text", "n_chars"), F.struct(F.xxhash64("text"), F.xxhash64("n_chars"))).alias("d"))
    sample = met.select("doc_id", "d.text", "d.n_chars", "label")
    model = (sample.mapInArrow(featurise, "one int, doc_id bigint, label int, feature binary, value binary")
             .groupBy("one").applyInArrow(fit, "w binary, v binary").collect())
    machine = Machine((1 << bits) + STATISTICS, factors)
    machine.v[:] = 0
    for m in model:
        machine.w, machine.v = np.frombuffer(m.w), np.frombuffer(m.v).reshape(-1, factors)
    return machine


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  bits: int = 15, factors: int = 8, train_rows: int = 4096) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    docs = inputs(df, id_col, text_col)
    machine = train(docs, labels, label_col, bits, factors, train_rows)
    machine.w, machine.v = machine.w.astype(np.float32), machine.v.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, SHARD)):
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array(machine.scores(b, bits))})

    return docs.mapInArrow(run, RESULT).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                               (F.col("score") >= 0.5).cast("int").alias("predicted"))

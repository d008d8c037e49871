"""Removal of repeated passages by difference-cover anchors.

A passage is a window of ``width`` words.  A word goes if a window that covers it has the same
words as a window that starts earlier (smaller doc_id; in the same document, an earlier start).

Method.  With a difference cover D modulo v, any two positions i, j have a shift d < v that
brings both into D, so two equal windows of ``width`` words share an aligned anchor: an equal run
of ``width - v + 1`` words that starts at a cover position in both.  Only those anchors are
hashed and compared over the corpus; a repeated anchor is then extended to the windows
around it, and only these windows are compared, by 128-bit hashes.

Jobs.  Documents are dealt into blocks of bounded bytes by a hash of their key, one block a task; this one exchange
of texts serves all three rounds.
1. Each block sends its distinct anchors to buckets by hash; a bucket answers with one bit for
   each anchor: whether another block has it too.
2. Each block extends its repeated anchors, drops repeats within itself and sends the first place
   of each distinct window to buckets; a bucket finds the earliest place over the corpus and
   answers the other blocks with the word ranges that go.
3. Each block removes its ranges.
A passage in a third of all documents costs each block one record for each of its windows.

Cases.  A null text has no words; words of an empty table give no rows.  Rows that share doc_id
and text count as one document and each get its result; different texts under one doc_id are
ordered by a hash of the text; a null doc_id comes after all others.  A very long text is a block of its own or part of one;
columns other than id and text are left behind, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcells.llm.common import block_count, spread, text_bytes, text_key, texts
from gridcells.llm.tokens import BASE, U64, mix, window_hashes, words_of

#: Perfect difference sets (modulus, members).
COVERS = ((1, (0,)), (3, (0, 1)), (7, (0, 1, 3)), (13, (0, 1, 3, 9)), (21, (0, 1, 4, 14, 16)),
          (31, (0, 1, 3, 8, 12, 18)))
SECOND = U64(0xD1342543DE82EF95)
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"


def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover that leaves anchors of at least two fifths of the window."""
    return max(c for c in COVERS if width - c[0] + 1 >= max(1, 0.4 * width))


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


class Block:
    """The documents of a block in the order of their keys, their words and their anchors."""

    def __init__(self, table: pa.Table, width: int):
        ids = table["doc_id"].to_numpy(zero_copy_only=False) if not table["doc_id"].null_count else None
        if ids is None:
            known = table["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            ids = table["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
            rank = np.where(known, ids.astype(np.int64).view(U64) ^ U64(1 << 63), U64(2**64 - 1))
        else:
            rank = ids.astype(np.int64).view(U64) ^ U64(1 << 63)
        tie = table["tie"].to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((tie, rank))
        rank, tie = rank[order], tie[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (rank[1:] != rank[:-1]) | (tie[1:] != tie[:-1])
        self.rows, self.doc_of_row = table.take(pa.array(order)), np.cumsum(fresh) - 1
        self.rank, self.tie = rank[fresh], tie[fresh]
        self.texts = self.rows["text"].filter(pa.array(fresh))
        self.words = words_of(self.texts)
        self.width, (self.period, cover) = width, cover_for(width)
        self.hashes = self.words.hashes()
        counts, text_of = self.words.counts, self.words.text_of()
        self.left = self.words.first[1:][text_of] - np.arange(len(text_of))  # words from here to the text's end
        at = np.arange(len(text_of)) - self.words.first[:-1][text_of]
        size = width - self.period + 1
        runs = window_hashes(self.hashes, size)
        ok = np.isin(at % self.period, cover) & (self.left >= size) & (counts[text_of] >= width)
        self.anchor_at = np.flatnonzero(ok[:len(runs)])
        self.anchors, self.which, times = np.unique(runs[self.anchor_at], return_inverse=True, return_counts=True)
        self.repeated = times > 1

    def by_bucket(self, buckets: int):
        """(bucket, places in ``anchors``); the order is the same each time."""
        home = (self.anchors % U64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(np.diff(home[order])) + 1
        return [(int(home[part[0]]), part) for part in np.split(order, cuts) if len(part)]

    def candidates(self) -> np.ndarray:
        """Starts of windows that hold a repeated anchor at one of the shifts."""
        n = len(self.hashes)
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, self.anchor_at[self.repeated[self.which]] + 1, 1)
        seen = np.cumsum(marks)
        starts = np.flatnonzero(self.left >= self.width)
        return starts[seen[np.minimum(starts + self.period, n)] > seen[starts]]


def ranges(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges covered by windows at ``starts``."""
    starts = np.unique(starts)
    if not len(starts):
        return starts.astype(np.int64), starts.astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = np.diff(starts) > width
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new].astype(np.int64), starts[last].astype(np.int64) + width


def send_anchors(width: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block = Block(table, width)
        parts = block.by_bucket(buckets)
        return pa.table({"bucket": pa.array([b for b, _ in parts], pa.int32()),
                         "block": pa.array([table["block"][0].as_py()] * len(parts), pa.int32()),
                         "blob": pa.array([pack(block.anchors[p]) for _, p in parts], pa.binary())})
    return run


def shared_anchors(table: pa.Table) -> pa.Table:
    parts = [unpack(b, "u8")[0] for b in table["blob"].to_pylist()]
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    near = every[order][1:] == every[order][:-1]
    shared = np.zeros(len(every), bool)
    shared[order[1:][near]] = True
    shared[order[:-1][near]] = True
    flags = np.split(shared, np.cumsum([len(p) for p in parts])[:-1])
    keep = [i for i, f in enumerate(flags) if f.any()]
    return pa.table({"block": table["block"].take(pa.array(keep, pa.int64())),
                     "bucket": table["bucket"].take(pa.array(keep, pa.int64())),
                     "blob": pa.array([pack(np.packbits(flags[i])) for i in keep], pa.binary())})


def send_windows(width: int, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(docs, width)
        said = dict(zip(answers["bucket"].to_pylist(), answers["blob"].to_pylist(), strict=True))
        for bucket, places in block.by_bucket(buckets):
            if bucket in said:
                bits = np.unpackbits(unpack(said[bucket], "u1")[0], count=len(places)).astype(bool)
                block.repeated[places[bits]] = True
        starts = block.candidates()
        one = window_hashes(block.hashes, width)[starts]
        two = window_hashes(mix(block.hashes ^ SECOND), width, SECOND)[starts]
        order = np.lexsort((two, one))           # stable: equal windows stay in document order
        one, two, starts = one[order], two[order], starts[order]
        new = np.ones(len(starts), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        gone = ranges(starts[~new], width)
        one, two, starts = one[new], two[new], starts[new]
        text_of = np.searchsorted(block.words.first, starts, side="right") - 1
        home = (one % U64(buckets)).astype(np.int64)
        order = np.lexsort((starts, home))
        parts = [p for p in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(p)]
        blobs = [pack(one[p], two[p], block.rank[text_of[p]], block.tie[text_of[p]], starts[p]) for p in parts]
        me, n = (docs["block"][0].as_py() if docs.num_rows else 0), len(parts)
        return pa.table({"bucket": pa.array([int(home[p[0]]) for p in parts] + [me % buckets], pa.int32()),
                         "block": pa.array([me] * (n + 1), pa.int32()),
                         "kind": pa.array(["windows"] * n + ["ranges"]),
                         "blob": pa.array([*blobs, pack(*gone)], pa.binary())})
    return run


def later_windows(width: int):
    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(table["kind"].to_pylist(), table["block"].to_pylist(), table["blob"].to_pylist(), strict=True))
        # what blocks found within themselves goes on as it is
        blocks, blobs = [b for k, b, _ in rows if k == "ranges"], [x for k, _, x in rows if k == "ranges"]
        sent = [(b, x) for k, b, x in rows if k == "windows"]
        if sent:
            parts = [unpack(x, "u8", "u8", "u8", "i8", "i8") for _, x in sent]
            owner = np.repeat([b for b, _ in sent], [len(p[0]) for p in parts])
            one, two, rank, tie, start = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((tie, rank, two, one))
            later = np.zeros(len(order), bool)
            later[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
            gone = order[later]
            for b in np.unique(owner[gone]):
                blocks.append(int(b))
                blobs.append(pack(*ranges(start[gone[owner[gone] == b]], width)))
        return pa.table({"block": pa.array(blocks, pa.int32()), "blob": pa.array(blobs, pa.binary())})
    return run


def remove_ranges(width: int):
    def run(docs: pa.Table, gone: pa.Table) -> pa.Table:
        block = Block(docs, width)
        delta = np.zeros(len(block.hashes) + 1, np.int64)
        for blob in gone["blob"].to_pylist():
            start, end = unpack(blob, "i8", "i8")
            np.add.at(delta, start, 1)
            np.add.at(delta, end, -1)
        kept = np.cumsum(delta)[:-1] == 0
        first = block.words.first
        removed = np.add.reduceat(np.append(~kept, False), first[:-1]) * (block.words.counts > 0) \
            if len(first) > 1 else np.zeros(0, np.int64)
        out = []
        for i, text in enumerate(block.texts.to_pylist()):
            words = (text or "").encode().split()
            if removed[i]:
                words = [words[k] for k in np.flatnonzero(kept[first[i]:first[i + 1]])]
            out.append(b" ".join(words).decode())
        row = pa.array(block.doc_of_row)
        return pa.table({"doc_id": block.rows["doc_id"], "n_words": pa.array(block.words.counts, pa.int64()).take(row),
                         "n_removed": pa.array(removed, pa.int64()).take(row),
                         "kept_text": pa.array(out, pa.string()).take(row)})
    return run


def remove_repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20,
                             block_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` (kept words joined by one space) for every row."""
    docs = texts(df, id_col, text_col)
    n = block_count(df.sparkSession, text_bytes(docs), block_bytes)
    docs = docs.withColumn("tie", text_key())
    docs = spread(docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(n)).cast("int")), "block", n)
    anchors = docs.groupBy("block").applyInArrow(send_anchors(width, n), "bucket int, block int, blob binary")
    shared = spread(anchors, "bucket", n).groupBy("bucket").applyInArrow(shared_anchors, "block int, bucket int, blob binary")
    windows = docs.groupBy("block").cogroup(spread(shared, "block", n).groupBy("block")).applyInArrow(
        send_windows(width, n), "bucket int, block int, kind string, blob binary")
    gone = spread(windows, "bucket", n).groupBy("bucket").applyInArrow(later_windows(width), "block int, blob binary")
    return docs.groupBy("block").cogroup(spread(gone, "block", n).groupBy("block")).applyInArrow(remove_ranges(width), RESULT)

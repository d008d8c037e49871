"""Benchmark decontamination: an FM-index per shard of training documents.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z.  A window is ``width``
consecutive words of an item (an item of fewer words, but not none, is one window); a document
word inside any occurrence of a window is hit.

Each shard holds the documents of at most ``shard_bytes`` bytes of a partition (one longer text is a shard of its own),
so no text is shuffled and a passage in a third of all rows costs no more than its occurrences.
Words outside the vocabulary of the items end a run, since no window spans one; the
runs left, words as numbers, are indexed.  The windows are found by backward search through the ranks of a
wavelet tree, occurrences by sampled suffix positions, and overlapping occurrences are merged to removal spans.

The items are the stated query set.  They are read in blocks of at most about ``item_block_bytes``
bytes; only a block's windows are in the driver and in a task at a time.  Where there are several, each makes one pass over the shards
and writes hits only; a join by the text's digest, whose hot side Spark may split, brings them together.

Cases.  Null texts and texts without words have no hits; items without words have no windows; a
null item_id is written as the empty string; items with equal ids count once; a repeated row gets its result each time.
Without documents there are no rows; without items nothing is hit.  Very long texts are searched whole.  ``find_passages`` reads the id and
text alone, and ``remove_passages`` carries the other columns in one struct, so no column clashes with a working name.
Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridcells.llm.common import cut, share_code, text_bytes, texts
from gridcells.llm.fm_index import FMIndex
from gridcells.llm.tokens import ALNUM, Words, slices, words_of

GAP = 1                                  # stands between runs; words of items are numbered from 2


class Windows:
    """Distinct windows of items: rows of word numbers aligned to the right, and their items."""

    def __init__(self, item_ids: list[str], texts: pa.Array, width: int):
        words = words_of(texts, ALNUM, lower=True)
        hashes = words.hashes()
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        rows: dict[bytes, list[int]] = {}
        self.items = sorted(set(item_ids))
        place = {x: i for i, x in enumerate(self.items)}
        for i, item in enumerate(item_ids):
            own = (numbers[words.first[i]:words.first[i + 1]] + 2).astype(np.int64)
            for k in range(max(1, len(own) - width + 1) if len(own) else 0):
                rows.setdefault(own[k:k + width].tobytes(), []).append(place[item])
        self.lengths = np.array([len(x) // 8 for x in rows], np.int64)
        self.rows = np.zeros((len(rows), width), np.int64)
        for i, x in enumerate(rows):
            self.rows[i, width - len(x) // 8:] = np.frombuffer(x, np.int64)
        owners = [sorted(set(x)) for x in rows.values()]
        self.owner = np.array([o for x in owners for o in x], np.int64)
        self.owner_from = np.concatenate([[0], np.cumsum([len(x) for x in owners])]).astype(np.int64)
        self.shortest = int(self.lengths.min()) if len(rows) else 0


def search_shard(column: pa.Array, windows: Windows) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the shard, which of them are hit, and (text, item) of the windows that occur."""
    words = words_of(column, ALNUM, lower=True)
    n = len(words.start)
    hit, none = np.zeros(n, bool), np.zeros(0, np.int64)
    if not windows.shortest or not n:
        return words, hit, none, none
    hashes = words.hashes()
    at = np.minimum(np.searchsorted(windows.vocabulary, hashes), len(windows.vocabulary) - 1)
    known = windows.vocabulary[at] == hashes
    opens = known.copy()
    opens[1:] &= ~known[:-1]
    first = words.first[1:-1]
    opens[first[first < n]] = known[first[first < n]]
    run = np.cumsum(opens) - 1
    inside = np.flatnonzero(known)
    long = np.bincount(run[inside], minlength=1)[run[inside]] >= windows.shortest
    inside = inside[long]                # words of runs that can hold a window
    if not len(inside):
        return words, hit, none, none
    starts = np.concatenate([[False], run[inside][1:] != run[inside][:-1]])
    place = np.arange(len(inside)) + np.cumsum(starts)
    symbols = np.full(place[-1] + 1, GAP, np.int64)
    symbols[place] = at[inside] + 2
    word_at = np.full(len(symbols), -1, np.int64)
    word_at[place] = inside
    index = FMIndex(symbols, len(windows.vocabulary) + 2)
    lo, hi = index.search(windows.rows, windows.lengths)
    found = np.flatnonzero(hi > lo)
    times = (hi - lo)[found]
    rows = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    which = np.repeat(found, times)
    begin = word_at[index.locate(rows)]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + windows.lengths[which], -1)
    hit = np.cumsum(change)[:-1] > 0
    text = np.searchsorted(words.first, begin, side="right") - 1
    pairs = np.unique(np.stack([text, which], axis=1), axis=0)
    owners = (windows.owner_from[1:] - windows.owner_from[:-1])[pairs[:, 1]]
    item = windows.owner[np.repeat(windows.owner_from[pairs[:, 1]] - np.concatenate([[0], np.cumsum(owners)[:-1]]),
                                   owners) + np.arange(owners.sum())]
    return words, hit, np.repeat(pairs[:, 0], owners), item


def spans(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of set marks as [start, end)."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def searcher(windows: Windows, shard_bytes: int, names: list[str], clean: bool):
    """One pass: the columns so far, with this block's hits added to those of earlier blocks."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, hit, text, item = search_shard(batch.column("text"), windows)
        first = words.first
        items = [set(x) for x in batch.column("items").to_pylist()]
        for t, i in zip(text.tolist(), item.tolist(), strict=True):
            items[t].add(windows.items[i])
        for i, earlier in enumerate(batch.column("hits").to_pylist()):
            for h in earlier:
                hit[first[i] + h["start"]:first[i] + h["end"]] = True
        anything = np.add.reduceat(np.append(hit, False), first[:-1]) * (words.counts > 0)
        hits, texts = [], batch.column("text").to_pylist() if clean else None
        for i in range(batch.num_rows):
            start, end = spans(hit[first[i]:first[i + 1]]) if anything[i] else ((), ())
            hits.append([{"start": int(s), "end": int(e)} for s, e in zip(start, end, strict=True)])
            if clean and hits[-1]:
                texts[i] = without(texts[i], words, first[i], words.offsets[i], hits[-1])
        out = {"n_words": pa.array(words.counts, pa.int64()),
               "hits": pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
               "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
        if clean:
            out["clean"] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_pydict({n: out[n] if n in out else batch.column(n) for n in names})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in slices(batch, shard_bytes):
                yield one(shard)
    return run


def without(text: str, words: Words, first: int, offset: int, hits: list[dict]) -> str:
    """The text without the hit words and what stands between them."""
    raw = text.encode()
    out, at = [], 0
    for h in hits:
        out.append(raw[at:words.start[first + h["start"]] - offset])
        at = words.end[first + h["end"] - 1] - offset
    return b"".join([*out, raw[at:]]).decode()


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, width: int, block_bytes: int) -> Iterator[Windows]:
    items = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
                             F.col(f"`{text_col}`").cast("string").alias("text"))
    n = max(1, -(-text_bytes(items) // block_bytes))
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).toArrow()
        yield Windows(block["id"].to_pylist(), block["text"], width)


NONE = {"n_words": "cast(0 as bigint)", "hits": "cast(array() as array<struct<start:int,end:int>>)",
        "items": "cast(array() as array<string>)"}


def one_pass(rows: DataFrame, windows: Windows, shard_bytes: int, clean: bool, drop_text: bool) -> DataFrame:
    schema = StructType([f for f in rows.schema if not (drop_text and f.name == "text")])
    if clean:
        schema = schema.add("clean", "string")
    return rows.mapInArrow(searcher(windows, shard_bytes, schema.names, clean), schema)


def search(rows: DataFrame, blocks: Iterator[Windows], width: int, shard_bytes: int, clean: bool) -> DataFrame:
    """``rows`` (with ``text``; other columns are carried along) with their words, hits and items.  One block makes one pass; of several,
    each writes the hits of the texts that it hits, by a digest of the text, and a last pass takes the hits of all."""
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return one_pass(rows.selectExpr("*", *(f"{x} as {c}" for c, x in NONE.items())), block, shard_bytes, clean, not clean)
    key, parts = F.sha2("text", 256).alias("key"), []
    while block is not None:
        found = one_pass(rows.select(key, "text").selectExpr("*", *(f"{x} as {c}" for c, x in NONE.items())), block, shard_bytes, False, True)
        parts.append(cut(found.where("size(hits) > 0").groupBy("key").agg(F.first("hits").alias("hits"), F.first("items").alias("items"))))
        block, following = following, next(blocks, None)
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    found = found.groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("hits"),
                                     F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    joined = rows.select("*", key).join(found, "key", "left").select(
        *rows.columns, F.expr(NONE["n_words"]).alias("n_words"),
        *(F.coalesce(c, F.expr(NONE[c])).alias(c) for c in ("hits", "items")))
    return one_pass(joined, Windows([], pa.array([], pa.string()), width), shard_bytes, clean, not clean)


def find_passages(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", width: int = 10,
                  shard_bytes: int = 4 << 20, item_block_bytes: int = 16 << 20, clean: bool = False) -> DataFrame:
    """``doc_id, n_words, hits`` (merged word ranges), ``items`` (sorted ids), and with ``clean``
    the text and its ``clean`` form without the hit spans."""
    blocks = item_blocks(benchmark, item_id_col, item_text_col, width, item_block_bytes)
    return search(texts(df, id_col, text_col), blocks, width, shard_bytes, clean)


def remove_passages(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                    item_text_col: str = "text", width: int = 10, shard_bytes: int = 4 << 20,
                    item_block_bytes: int = 16 << 20) -> DataFrame:
    """``df`` with the hit spans cut out of its texts; ``n_chars`` follows if there is one."""
    share_code(df.sparkSession)
    others = [c for c in df.columns if c != text_col]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks = item_blocks(benchmark, item_id_col, item_text_col, width, item_block_bytes)
    out = search(rows, blocks, width, shard_bytes, True).select("row.*", F.col("clean").alias(text_col))
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length(f"`{text_col}`").cast(df.schema["n_chars"].dataType))
    return out.select(*(f"`{c}`" for c in df.columns))

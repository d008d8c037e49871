"""Periodic runs of words: a suffix automaton whose link tree answers "where did this suffix end last".

A run is a stretch of words that repeats with smallest period q, at least twice, and that no neighbouring word extends.

Method.  Words are appended to a suffix automaton one by one.  Its suffix links form a tree; the states on the way from the
new prefix to the root are the suffixes that end here, and each state remembers where it ended last.  The
tree is kept as a link-cut tree whose paths have one such end each, so an access of the new state meets one path
segment for every distinct earlier end, and recolours all of them with the new end.  A segment holds suffixes of
more than ``lo`` and up to ``hi`` words which ended ``d`` words earlier: with ``lo < d <= hi`` the last
``2 d`` words are a square.  As that was the latest end, its half is primitive, so ``d`` is the smallest period; and
every run shows its first square where it has 2 q words.  A square within a known run of its period is skipped, any other one is
extended to its run.

Only stretches that can hold a reported run go through the automaton: in a run of at least ``min_length`` words every word lies
in a window of ``min_length / 2`` words that the text holds twice, and a word in no such window parts the text.

Jobs.  One pass over the texts and no shuffle; windows are compared within their text, by 64-bit hashes of array
operations (an equal hash of different windows costs time only).  Memory is that of one text's stretch.

Cases.  A null or empty text has no words and no runs, and an empty collapsed text; a very long text costs its own task
only, in time n log n; every row is read on its own, so repeated rows and ids need no rule; ties of length go to the smallest start, then period;
an empty table gives no rows; columns other than id and text are left behind, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcells.llm.common import let, texts
from gridcells.llm.tokens import BASE, U64, mix, slices, window_hashes, words_of

SPACE = r"[\x20\x09-\x0D]+"


class LastEnds:
    """Suffix automaton of the words appended so far, with its link tree as a link-cut tree.

    Node 0 is none, node 1 the root.  ``up`` is a node's parent in its splay tree or, at a splay tree's root, the node
    above its path; every splay tree is a path of nodes with the same last end, kept at its root in ``end``."""

    def __init__(self):
        self.moves, self.link, self.size = [{}, {}], [0, 0], [0, 0]
        self.near, self.deep, self.up, self.end = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.last, self.n = 1, 0

    def _node(self, size: int, moves: dict, link: int) -> int:
        self.moves.append(moves)
        self.size.append(size)
        self.link.append(link)
        for column, value in ((self.near, 0), (self.deep, 0), (self.up, 0), (self.end, -1)):
            column.append(value)
        return len(self.size) - 1

    def _splay(self, x: int) -> None:
        """Make x the root of its splay tree; the last end moves there with it."""
        near, deep, up, end = self.near, self.deep, self.up, self.end
        while True:
            p = up[x]
            if near[p] == x:
                on_near = True
            elif deep[p] == x and p:
                on_near = False
            else:
                return
            if not p:
                return
            g = up[p]
            p_near, p_deep = g and near[g] == p, g and deep[g] == p
            if not (p_near or p_deep):                       # p is the root: one rotation
                end[x] = end[p]
                if on_near:
                    near[p] = c = deep[x]
                    deep[x] = p
                else:
                    deep[p] = c = near[x]
                    near[x] = p
                if c:
                    up[c] = p
                up[p], up[x] = x, g
                return
            above = up[g]
            if p_near == on_near:                            # both on one side: p over g, then x over p
                if on_near:
                    near[g] = c = deep[p]
                    near[p] = b = deep[x]
                    deep[p], deep[x] = g, p
                else:
                    deep[g] = c = near[p]
                    deep[p] = b = near[x]
                    near[p], near[x] = g, p
                if c:
                    up[c] = g
                if b:
                    up[b] = p
                up[g], up[p] = p, x
            else:                                            # x between them: both become its children
                if on_near:
                    deep[g] = c = near[x]
                    near[p] = b = deep[x]
                    near[x], deep[x] = g, p
                else:
                    near[g] = c = deep[x]
                    deep[p] = b = near[x]
                    near[x], deep[x] = p, g
                if c:
                    up[c] = g
                if b:
                    up[b] = p
                up[g] = up[p] = x
            up[x] = above
            if above and near[above] == g:
                near[above] = x
            elif above and deep[above] == g:
                deep[above] = x
            else:
                end[x] = end[g]
                return

    def append(self, word) -> None:
        moves, link, size = self.moves, self.link, self.size
        new, p = self._node(self.n + 1, {}, 0), self.last
        while p and word not in moves[p]:
            moves[p][word] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = moves[p][word]
            if size[q] > size[p] + 1:                        # the shorter suffixes of q part from it
                copy = self._node(size[p] + 1, dict(moves[q]), link[q])
                while p and moves[p].get(word) == q:
                    moves[p][word] = copy
                    p = link[p]
                self._splay(q)                               # and lie just above it on its path
                above = self.near[q]
                self.near[copy], self.up[copy], self.near[q] = above, q, copy
                if above:
                    self.up[above] = copy
                link[q] = q = copy
            link[new] = q
        self.up[new] = link[new]
        self.last, self.n = new, self.n + 1

    def recolour(self) -> Iterator[tuple[int, int, int]]:
        """Access the newest prefix: (earlier end, lo, hi) of each path segment up to the root, which then all end here."""
        deep, up, end, size = self.deep, self.up, self.end, self.size
        below, x = 0, self.last
        while x:
            self._splay(x)
            cut = deep[x]
            if cut:
                end[cut] = end[x]                            # the deeper part keeps its end
            above = up[x]
            if end[x] >= 0:
                yield end[x], size[above], size[x]
            deep[x] = below
            below, x = x, above
        end[below] = self.n - 1


def runs_of(words: list, min_length: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``min_length`` words, by start, then period."""
    out, reach, ends, n = [], {}, LastEnds(), len(words)
    for i, word in enumerate(words):
        ends.append(word)
        for before, lo, hi in ends.recolour():
            d = i - before
            if lo < d <= hi and reach.get(d, 0) <= i:
                start, stop = i - 2 * d + 1, i + 1
                while start and words[start - 1] == words[start - 1 + d]:
                    start -= 1
                while stop < n and words[stop] == words[stop - d]:
                    stop += 1
                reach[d] = stop
                if stop - start >= min_length:
                    out.append((start, stop - start, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(column: pa.Array, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end of the stretches that can hold a run."""
    table, width = words_of(column), max(1, -(-min_length // 2))
    text = table.text_of()
    n = len(text) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none
    keys = mix(window_hashes(table.hashes(), width) + text[:n].astype(U64) * BASE)
    whole = text[:n] == text[width - 1:]
    order = np.sort(keys[whole])
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return none, none, none
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    found = np.flatnonzero(whole & (twice[at] == keys))
    change = np.bincount(found, minlength=len(text) + 1) - np.bincount(found + width, minlength=len(text) + 1)
    covered = np.cumsum(change)[:-1] > 0
    border = np.empty(len(text) + 1, bool)
    border[0] = border[-1] = True
    border[1:-1] = (covered[1:] != covered[:-1]) | (text[1:] != text[:-1])
    place = np.flatnonzero(border)
    start, stop = place[:-1], place[1:]
    good = covered[start] & (stop - start >= min_length)
    start, stop = start[good], stop[good]
    return text[start], start - table.first[text[start]], stop - table.first[text[start]]


RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 12, n_bytes: int = 1 << 22) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: all runs by start, then period, and the words that are in no run after its first
    period, joined by one space.  ``n_bytes`` bounds the text that is compared at a time (a longer text alone)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, n_bytes):
                parted: dict[int, list] = {}
                for text, a, b in zip(*(x.tolist() for x in stretches(part.column("text"), min_length)), strict=True):
                    parted.setdefault(text, []).append((a, b))
                counts, runs, collapsed = [], [], []
                for k, text in enumerate(part.column("text")):
                    words = (text.as_py() or "").encode().split()
                    found = [(a + s, length, q) for a, b in parted.get(k, ()) for s, length, q in runs_of(words[a:b], min_length)]
                    counts.append(len(words))
                    runs.append([{"start": s, "length": length, "period": q} for s, length, q in found])
                    if found:
                        again = np.zeros(len(words) + 1, np.int64)
                        for s, length, q in found:
                            again[s + q] += 1
                            again[s + length] -= 1
                        words = [words[i] for i in np.flatnonzero(np.cumsum(again)[:-1] == 0).tolist()]
                    collapsed.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_words": pa.array(counts, pa.int64()),
                                                  "runs": pa.array(runs, RUN), "collapsed": pa.array(collapsed, pa.string())})
    schema = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return texts(df, id_col, text_col).mapInArrow(run, schema)


def with_planted_periods(df: DataFrame) -> DataFrame:
    """``doc_id, text`` in which a tenth of the documents, chosen by the crc32 of their id, become periodic from some word on.
    A null id is chosen by none."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return let(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")), lambda s: F.transform(
            words, lambda x, i: F.when(i < s["a"], x).otherwise(F.get(words, s["a"] + F.pmod(i - s["a"], s["p"])))))

    words = F.array_remove(F.split("text", SPACE, -1), "")
    return df.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, F.array_join(let(words, periodic), " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the longest run with its exponent in thousandths, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))
    return (found.withColumn("best", F.array_min(order)).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.shorter")).alias("length"),
        F.col("best.period").alias("period"), F.floor(-1000 * F.col("best.shorter") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))

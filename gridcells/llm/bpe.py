"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string the encoding ends in exactly one token: the one token that ends
there and forms a valid pair with the last token of the prefix before it (a pair is
valid if merging its joined bytes gives the pair again).  The table of these last tokens is the encoding
of all prefixes at once: appending bytes only adds entries, and after an edit entries are computed anew
until the longest token's length of them agrees with the old ones.

Text is cut by the split pattern first and every match is encoded separately.  A match that is
itself an entry of the rank file is that entry, as its users expect, even where merges alone would
not reach it.  Special tokens are ordinary text.

Cases.  Null and empty texts have no tokens; very long matches take time in proportion to their
length; every row is encoded on its own, so repeated rows and ids need no rule; an empty table gives no rows; columns other
than id and text are left behind, whatever their names.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcells.llm.common import texts
from gridcells.llm.tokens import slices

@dataclass(frozen=True)
class Memory:
    """What a worker remembers: matches and pairs (beyond that most are forgotten), the bytes of text it
    encodes at a time, and whether it forgets all of them when a task ends."""

    matches: int = 350_000
    pairs: int = 200_000
    texts: int = 1 << 21
    release: bool = False


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self.reached, self.left, self.right = {}, {}, {}
        self.ordered = True                  # whether every token ranks above the two it is merged from
        for token, rank in sorted(ranks.items(), key=lambda x: len(x[0])):
            parts = self.merge(token, down_to=2)
            if len(token) > 1 and len(parts) != 2:
                continue                     # merges alone do not reach it
            self.reached[token] = rank
            self.ordered &= len(token) == 1 or max(parts) < rank
            # the tokens at the token's right and left edge while it grows, from a byte to itself
            self.right[rank] = [*(self.right.get(parts[-1], [parts[-1]]) if len(token) > 1 else ()), rank]
            self.left[rank] = [*(self.left.get(parts[0], [parts[0]]) if len(token) > 1 else ()), rank]
        self.sizes = [len(t) for t in self.tokens]
        self._automaton()
        self.pairs: dict[int, bool] = {}
        self.matches: dict[str, bytes] = {}
        self.memory = Memory()

    def merge(self, data: bytes, down_to: int = 1) -> list[int]:
        """Plain merging of the lowest-ranked neighbours, for short byte strings."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _automaton(self) -> None:
        """States for all prefixes of tokens.  After reading a string the state is its longest suffix that
        begins a token; ``ending`` has the (size, id) of all tokens that end there, the longest first."""
        prefixes = sorted({t[:i] for t in self.reached for i in range(1, len(t) + 1)}, key=lambda p: (len(p), p))
        state = {b"": 0} | {p: i for i, p in enumerate(prefixes, 1)}
        self.moves = {state[p[:-1]] << 8 | p[-1]: i for p, i in state.items() if p}
        self.shorter, self.ending = [0] * len(state), [()] * len(state)
        for p, i in state.items():               # shorter prefixes come first
            if len(p) > 1:
                self.shorter[i] = self.move(self.shorter[state[p[:-1]]], p[-1])
            token = self.reached.get(p)
            self.ending[i] = self.ending[self.shorter[i]] if token is None else ((len(p), token), *self.ending[self.shorter[i]])

    def move(self, state: int, byte: int) -> int:
        """The state after one more byte."""
        while (to := self.moves.get(state << 8 | byte)) is None and state:
            state = self.shorter[state]
        return to or 0

    def valid(self, left: int, right: int) -> bool:
        known = self.pairs.get(left << 32 | right)
        if known is None:
            known = self.stays_apart(left, right) if self.ordered \
                else self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
            if len(self.pairs) >= self.memory.pairs:
                self.pairs.clear()
            self.pairs[left << 32 | right] = known
        return known

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border while both sides grow.  At each moment the edge tokens
        merge across if that ranks before the next merge of the left edge and not after
        that of the right edge (of equal ranks the leftmost place is merged first)."""
        grown, growing, never = self.right[left], self.left[right], len(self.tokens)
        i = j = 0
        while True:
            across = self.ranks.get(self.tokens[grown[i]] + self.tokens[growing[j]], never)
            on_left = grown[i + 1] if i + 1 < len(grown) else never
            on_right = growing[j + 1] if j + 1 < len(growing) else never
            if across < on_left and across <= on_right and across != never:
                return False
            if on_left == on_right == never:
                return True
            if on_left <= on_right:
                i += 1
            else:
                j += 1

    def learn(self, matches: set[str]) -> dict[str, bytes]:
        """Ids, as 32-bit numbers, of matches that are not known yet.  In sorted order each shares a
        prefix with the one before, whose entries are kept."""
        out, table = {}, Prefixes(self)
        for data in sorted(m.encode() for m in matches):
            whole = self.ranks.get(data)
            if whole is None:
                table.become(data)
            out[data.decode()] = array("i", (whole,) if whole is not None else table.ids()).tobytes()
        return out

    def forget(self) -> None:
        self.matches, self.pairs = {}, {}

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [self.split.findall(t) for t in texts]
        seen = set().union(*cut)
        known = {m: self.matches[m] for m in seen & self.matches.keys()}
        new = self.learn(seen - known.keys())
        known.update(new)
        if len(self.matches) + len(new) > self.memory.matches:
            new, self.matches = known, {}        # of the old ones, those of these texts stay
        self.matches.update((m, ids) for m, ids in new.items() if len(m) <= 64)
        return [np.frombuffer(b"".join(map(known.__getitem__, x)), np.int32) for x in cut]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """The last token, and the automaton's state, of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last, self.states = vocabulary, b"", [-1], [0]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        for _ in self.grow():
            pass

    def grow(self) -> Iterator[None]:
        """Compute the missing entries; yields after each."""
        words, last, states, data = self.vocabulary, self.last, self.states, self.data
        moves, ending, pairs, valid = words.moves, words.ending, words.pairs, words.valid
        state = states[-1]
        for end in range(len(last), len(data) + 1):
            byte = data[end - 1]
            to = moves.get(state << 8 | byte)
            state = words.move(state, byte) if to is None else to
            states.append(state)
            for size, token in ending[state]:
                if size == end:
                    break
                before = last[end - size]
                known = pairs.get(before << 32 | token)
                if known or known is None and valid(before, token):
                    break
            else:
                raise ValueError("the rank file lacks a byte")
            last.append(token)
            yield

    def become(self, data: bytes) -> None:
        """Another string; the entries of the common prefix stay."""
        same, old = 0, self.data
        for a, b in zip(old, data, strict=False):
            if a != b:
                break
            same += 1
        del self.last[same + 1:], self.states[same + 1:]
        self.data = old[:same]
        self.append(data[same:])

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of ``[start, end)``; returns how many entries were computed."""
        old, states, shift = self.last, self.states, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, self.states = old[:start + 1], states[:start + 1]
        same = computed = 0
        for _ in self.grow():
            at = len(self.last) - 1
            computed += 1
            same = same + 1 if at > start + len(new) and old[at - shift] == self.last[at] else 0
            if same >= self.vocabulary.longest:
                self.last += old[at + 1 - shift:]
                self.states += states[at + 1 - shift:]
                break
        return computed

    def ids(self, end: int | None = None) -> list[int]:
        """Encoding of the whole string or of its first ``end`` bytes."""
        at, out, last, sizes = len(self.data) if end is None else end, [], self.last, self.vocabulary.sizes
        while at:
            out.append(last[at])
            at -= sizes[last[at]]
        return out[::-1]


@functools.lru_cache(4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        if line:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return Vocabulary(ranks, pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           and_decode: bool = False, memory: Memory = Memory()) -> DataFrame:
    """``doc_id, ids``; with ``and_decode`` also ``decoded``, the bytes that the ids stand for (in the
    same pass, so that one worker a task holds the vocabulary).  ``path`` is a rank file that every executor has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        words.memory = memory
        for batch in batches:
            for part in slices(batch, memory.texts):
                ids = words.encode_all([t or "" for t in part.column("text").to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                out = {"doc_id": part.column("doc_id"), "ids": pa.ListArray.from_arrays(offsets, np.concatenate(ids))}
                if and_decode:
                    out["decoded"] = pa.array([words.decode(x.tolist()) for x in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(out)
        if memory.release:
            words.forget()                   # an idle worker holds the vocabulary only
    return texts(df, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>" + ", decoded binary" * and_decode)


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded`` (bytes) of a table ``doc_id, ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                column = part.column("ids")
                sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                ids, at = column.flatten().to_numpy(zero_copy_only=False).tolist(), np.concatenate([[0], np.cumsum(sizes)]).tolist()
                raw = [words.decode(ids[a:b]) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "ids": column,
                                                  "decoded": pa.array(raw, pa.binary())})
    return df.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")


def digests(df: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of a decoded table."""
    return df.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                     F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                     F.sha2("decoded", 256).alias("decoded_sha256"))

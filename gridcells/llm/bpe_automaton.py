"""Byte-level BPE encoding and decoding by a tokenization automaton.

Automaton.  Its alphabet is the vocabulary: it reads a string of tokens and accepts exactly those that the merges
give.  It is compiled merge by merge.  At first one state loops on every byte.  The merge gadget of ``u + v -> w`` lays an
arc ``w`` beside every path ``u, v``, from the state before ``u`` to the state after ``v``, and takes the arc ``v``
out of the state after ``u``; if arcs of other labels enter that state too, ``u`` gets its own copy
of it first.  All arcs of one label enter the same state, so a state is known by the arcs it lacks.  An arc is
missing with all arcs that were later made from it as the left part; numbered in the order of such a
tree (parts after the tokens made from them, oldest first) the missing ones are intervals, and the automaton is two short tables.

Encoding.  Each match of the split pattern is encoded alone.  After every prefix of its bytes exactly one state is
reached; from there the arcs whose labels come next are found in a table of byte transitions.  Many
matches advance together, one array operation for all.  The path is read back from the end.  Decoding
joins the labels of the arcs.

Special tokens of the file are found in the text first, as its library does, and their own text is their label.

Cases.  A null or empty text has no tokens; a long match takes time in proportion to its length; every row is
encoded on its own, so repeated rows and ids need no rule; an empty table gives no rows; columns other than id and
text are left behind, whatever their names.  A file with a normalizer, dropout, word-end marks or merges
whose parts are made later is refused.
"""

from __future__ import annotations

import bisect
import functools
import json
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridcells.llm.common import texts
from gridcells.llm.tokens import slices

#: The split of byte-level BPE; a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes; longer matches are encoded one by one.
LONG = 64
TOGETHER = 20_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: itself if it is printable in Latin-1, else
    the next letter from U+0100 on."""
    out, more = {}, 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD:
            out[chr(b)] = b
        else:
            out[chr(more)] = b
            more += 1
    return out


class Automaton:
    """States, arcs and labels; ``merges`` are (left, right, whole) token numbers in order."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], special: dict[bytes, int] | None = None):
        self.labels, self.special = labels, special or {}
        self.sizes = np.array([len(x) for x in labels], np.int32)
        self.target = np.zeros(len(labels), np.int32)
        self._compile(merges)
        self._byte_transitions()
        self.label_bytes = np.frombuffer(b"".join(labels), np.uint8)
        self.label_start = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        self.split = regex.compile(SPLIT)
        self.marks = regex.compile("(" + "|".join(regex.escape(m.decode()) for m in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.matches: dict[str, bytes] = {}

    # -- construction ------------------------------------------------------
    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        made = {w for _, _, w in merges}
        if len(made) < len(merges):
            raise ValueError("two merges make the same token")
        self.live = np.array([i not in made and len(x) == 1 for i, x in enumerate(self.labels)])
        target, cuts, entered = self.target.tolist(), [{}], [257]      # the first state is never given up
        left, born, children = {}, {}, {}

        def has_arc(state: int, token: int) -> bool:
            child = None
            while True:
                cut = cuts[state].get(token)
                if cut is not None and (child is None or born[child] >= cut):
                    return False
                if token not in left:
                    return True
                child, token = token, left[token]

        for time, (u, v, w) in enumerate(merges):
            if any(x in made and x not in born for x in (u, v)):
                raise ValueError("a merge comes before those that make its parts")
            left[w], born[w] = u, time
            children.setdefault(u, []).append(w)
            after = target[u]
            if not (self.live[u] and self.live[v] and has_arc(after, v)):
                continue                                               # u and v never meet, so w has no arc
            self.live[w], target[w] = True, target[v]
            entered[target[v]] += 1
            if entered[after] > 1:                                     # other labels enter this state: a copy for u
                entered[after] -= 1
                target[u] = len(cuts)
                cuts.append(dict(cuts[after]))
                entered.append(1)
            cuts[target[u]][v] = time
        self.target = np.array(target, np.int32)
        self._intervals(cuts, left, born, children)

    def _intervals(self, cuts, left, born, children) -> None:
        """Missing arcs of each state as intervals of ``place``; keys are ``state << 32 | first place``."""
        first, place, count = {}, np.zeros(len(self.labels), np.int64), 0
        for root in (i for i in range(len(self.labels)) if i not in left):
            stack = [(root, False)]
            while stack:
                token, done = stack.pop()
                if done:
                    place[token] = count
                    count += 1
                else:
                    first[token] = count
                    stack.append((token, True))
                    stack += [(c, False) for c in reversed(children.get(token, ()))]
        starts, ends = array("q"), array("q")
        for state, cut in enumerate(cuts):
            spans = []
            for token, time in cut.items():
                made = children.get(token, ())
                k = bisect.bisect_left(made, time, key=born.__getitem__)
                spans.append((first[made[k]] if k < len(made) else int(place[token]), int(place[token])))
            last = -2
            for a, b in sorted(spans):
                if a <= last + 1:
                    last = max(last, b)
                    ends[-1] = last
                else:
                    starts.append(state << 32 | a)
                    ends.append(b)
                    last = b
        self.place, self.n_states = place, len(cuts)
        self.cut_start = np.concatenate([[-1], np.frombuffer(starts, np.int64)]) if starts else np.array([-1])
        self.cut_end = np.concatenate([[-1], np.frombuffer(ends, np.int64)]) if ends else np.array([-1])
        self.cut_state = self.cut_start >> 32

    def _byte_transitions(self) -> None:
        """``step[node << 8 | byte]`` and the token that a node spells; nodes that lead on come first."""
        trie, ends = [{}], {0: -1}
        for token in np.flatnonzero(self.live).tolist():
            node = 0
            for b in self.labels[token]:
                node = trie[node].setdefault(b, len(trie))
                if node == len(trie):
                    trie.append({})
            ends[node] = token
        order = sorted(range(len(trie)), key=lambda i: not trie[i])
        number = {old: new for new, old in enumerate(order)}
        self.n_inner = sum(map(bool, trie))
        self.step = np.zeros(max(self.n_inner, 1) << 8, np.int32)
        for old in order[:self.n_inner]:
            for b, child in trie[old].items():
                self.step[number[old] << 8 | b] = number[child]
        self.spells = np.full(len(trie), -1, np.int32)
        for old, token in ends.items():
            self.spells[number[old]] = token

    # -- running -----------------------------------------------------------
    def arcs(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each state has an arc of the token."""
        place = self.place[tokens]
        at = np.searchsorted(self.cut_start, (states.astype(np.int64) << 32) | place, side="right") - 1
        return (self.cut_state[at] != states) | (self.cut_end[at] < place)

    def accepts(self, tokens: list[int]) -> bool:
        state = 0
        for t in tokens:
            if not self.live[t] or not self.arcs(np.array([state]), np.array([t]))[0]:
                return False
            state = int(self.target[t])
        return True

    def run_together(self, words: list[bytes]) -> list[bytes]:
        """Token numbers, as 32-bit numbers, of byte strings that are not long."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        sizes = np.array([len(words[i]) for i in order])
        data = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
        start = np.cumsum(sizes) - sizes
        base = start + np.arange(len(words))                           # a word of n bytes has n + 1 prefixes
        state, came = np.zeros(len(data) + len(words), np.int32), np.zeros(len(data) + len(words), np.int32)
        longer = len(words) - np.searchsorted(sizes[::-1], np.arange(sizes[0] if len(sizes) else 0), side="right")
        for i, n in enumerate(longer.tolist()):
            at, byte, room, node, k = base[:n] + i, start[:n] + i, sizes[:n] - i, np.zeros(n, np.int32), 0
            before = state[at]
            while len(at):
                node = self.step[node << 8 | data[byte + k]]
                k += 1
                token = self.spells[node]
                may = np.flatnonzero(token >= 0)
                may = may[self.arcs(before[may], token[may])]
                came[at[may] + k], state[at[may] + k] = token[may], self.target[token[may]]
                on = np.flatnonzero((node > 0) & (node < self.n_inner) & (room > k))
                at, byte, room, node, before = at[on], byte[on], room[on], node[on], before[on]
        rest, rounds, which = sizes.copy(), [], np.flatnonzero(sizes)
        counts = np.zeros(len(words), np.int64)
        while len(which):
            token = came[base[which] + rest[which]]
            rounds.append((which, token))
            counts[which] += 1
            rest[which] -= self.sizes[token]
            which = which[rest[which] > 0]
        ends, ids = np.cumsum(counts), np.zeros(counts.sum(), np.int32)
        for r, (which, token) in enumerate(rounds):
            ids[ends[which] - 1 - r] = token
        raw, cut = ids.tobytes(), [0, *(ends * 4).tolist()]
        out = [b""] * len(words)
        for k, i in enumerate(order):
            out[i] = raw[cut[k]:cut[k + 1]]
        return out

    def run_alone(self, word: bytes) -> bytes:
        """The same for one byte string of any length."""
        step, spells, place, target, inner = self.step, self.spells, self.place, self.target, self.n_inner
        state, came, missing = [0] * (len(word) + 1), [0] * (len(word) + 1), {}
        for i in range(len(word)):
            now = state[i]
            if now not in missing:
                a, b = np.searchsorted(self.cut_state, [now, now + 1])
                missing[now] = ((self.cut_start[a:b] & 0xFFFFFFFF).tolist(), self.cut_end[a:b].tolist())
            starts, ends = missing[now]
            node = 0
            for j in range(i, len(word)):
                node = int(step[node << 8 | word[j]])
                token = spells[node] if node else -1
                if token >= 0:
                    p = place[token]
                    k = bisect.bisect_right(starts, p) - 1
                    if k < 0 or ends[k] < p:
                        came[j + 1], state[j + 1] = int(token), int(target[token])
                if not 0 < node < inner:
                    break
        out, at = array("i"), len(word)
        while at:
            out.append(came[at])
            at -= len(self.labels[came[at]])
        return out[::-1].tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        raw = [w.encode() for w in words]
        out = {words[i]: self.run_alone(x) for i, x in enumerate(raw) if len(x) > LONG}
        short = [i for i, x in enumerate(raw) if len(x) <= LONG]
        for k in range(0, len(short), TOGETHER):
            part = short[k:k + TOGETHER]
            out.update(zip([words[i] for i in part], self.run_together([raw[i] for i in part]), strict=True))
        return out

    def pieces(self, text: str) -> list[str]:
        """Matches of the split pattern, and special tokens as they are."""
        if self.marks is None or not self.marks.search(text):
            return self.split.findall(text)
        out = []
        for i, part in enumerate(self.marks.split(text)):
            out += [part] if i % 2 else self.split.findall(part)
        return out

    def encode_all(self, many: list[str], remember: int) -> list[bytes]:
        """Token numbers of each text, as 32-bit numbers; ``remember`` bounds the matches kept for later texts."""
        cut = [self.pieces(t) for t in many]
        seen = set().union(*cut)
        known = {m: self.matches[m] for m in seen & self.matches.keys()}
        known.update((m.decode(), np.int32(i).tobytes()) for m, i in self.special.items())
        new = self.learn(sorted(seen - known.keys()))
        known.update(new)
        if len(self.matches) + len(new) > remember:
            new, self.matches = known, {}
        self.matches.update((m, ids) for m, ids in new.items() if len(m) <= LONG)
        return [b"".join(map(known.__getitem__, x)) for x in cut]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text], 0)[0], np.int32).tolist()

    def emit(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs, joined."""
        size = self.sizes[ids].astype(np.int64)
        ends = np.cumsum(size)
        shift = np.repeat(self.label_start[ids] - (ends - size), size)
        return self.label_bytes[shift + np.arange(len(shift))].tobytes()

    def decode(self, ids) -> str:
        return self.emit(np.asarray(ids, np.int64)).decode(errors="replace")


def _refuse(found, what: str) -> None:
    if found:
        raise ValueError(f"the file's {what} is not that of plain byte-level BPE")


@functools.lru_cache(2)
def automaton(path: str) -> Automaton:
    """The automaton of a byte-level BPE file (JSON).  One is held by a worker and serves all its tasks."""
    spec = json.loads(Path(path).read_bytes())
    model, cutter = spec["model"], spec["pre_tokenizer"]
    _refuse(spec["normalizer"], "normalizer")
    _refuse(cutter["type"] != "ByteLevel" or cutter["add_prefix_space"] or not cutter.get("use_regex", True), "split")
    _refuse(model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                                                "byte_fallback", "ignore_merges")), "model")
    added = spec["added_tokens"]
    _refuse(any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added), "list of added tokens")
    letters, vocabulary = byte_letters(), model["vocab"]
    special = {t["content"].encode(): t["id"] for t in added}
    labels = [b""] * (1 + max([*vocabulary.values(), *special.values()]))
    for token, i in vocabulary.items():
        labels[i] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
    for content, i in special.items():
        labels[i] = content
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Automaton(labels, [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges], special)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", and_decode: bool = False, packed: bool = False,
           remember: int = 350_000, n_bytes: int = 1 << 21) -> DataFrame:
    """``doc_id, ids`` of every text; with ``and_decode`` also ``decoded``, the text that the ids stand for (in the same
    pass, so that one worker a task holds the automaton).  ``ids`` is an array, or with ``packed`` a binary of little-endian
    32-bit numbers.  ``path`` is a file that every executor has; ``remember`` bounds the matches that a worker
    keeps, ``n_bytes`` the text that it encodes at a time (a longer text alone)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for batch in batches:
            for part in slices(batch, n_bytes):
                ids = machine.encode_all([t or "" for t in part.column("text").to_pylist()], remember)
                out = {"doc_id": part.column("doc_id")}
                if packed:
                    out["ids"] = pa.array(ids, pa.binary())
                else:
                    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                    out["ids"] = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(ids), np.int32))
                if and_decode:
                    out["decoded"] = pa.array([machine.decode(np.frombuffer(x, np.int32)) for x in ids], pa.string())
                yield pa.RecordBatch.from_pydict(out)
    kind = "binary" if packed else "array<int>"
    return texts(df, id_col, text_col).mapInArrow(run, f"doc_id bigint, ids {kind}" + ", decoded string" * and_decode)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded`` of a table of id arrays; a null array is an empty text.  Bytes that are no UTF-8 become U+FFFD."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for batch in batches:
            decoded = [machine.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in batch.column("ids")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "decoded": pa.array(decoded, pa.string())})
    from pyspark.sql import functions as F

    from gridcells.llm.common import share_code

    share_code(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id bigint, decoded string")

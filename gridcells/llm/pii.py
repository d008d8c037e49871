"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Base spans, leftmost and non-overlapping for each kind: email, ip, card, phone.  They are written so
that a text of any kind takes time in proportion to its length.

Bootstrap.  The base spans are the seeds.  Every occurrence of a seed, and of a word of any length that holds a
digit or an @, gives edges between its text (the instance) and the lexical
patterns around it: the two words before, and the word on each side, in full however long they are.  Words end at
white space, at base spans, and at each character of a script without spaces (``UNSPACED``).  Over all
documents Spark scores the graph of distinct edges: a pattern is as sure as the mean of its instances
(with ``prior`` unsure ones added, and nothing below ``min_seeds`` distinct seeds); an instance that is no
seed is as sure as a noisy-or of its patterns.  After ``rounds`` rounds the instances of at least ``min_score`` in the
places of patterns of at least ``min_score`` are ``context`` spans.  Any other word (without a digit or @) in the place of
such a pattern is one too if the pattern is that sure with all distinct words in its place counted, the other words as unsure.

Jobs.  One pass over the texts writes base spans and occurrences, with 64-bit hashes for instances and patterns (texts are never
shuffled).  How many distinct other words a sure pattern can have before it is no longer sure follows from its score, so a second
pass counts them by hash: a task that has met more drops the pattern, which settles it, and sends no more than that number for any other.
Only for patterns that stay, a third pass writes positions.  Both passes hold the patterns in memory, at most
``BLOCK`` of such numbers at a time; more patterns take further passes.  The rounds join and group distinct edges, combined before each shuffle.  A
score table is broadcast if its counted rows are at most ``SMALL``; beyond that the other side is salted, so a hot pattern or
instance is spread.

Cases.  A null or empty text has no spans; repeated rows get the same spans each; edges are distinct, so
copies of a document do not raise a score; very long texts cost their own task only; an empty table gives no rows; columns other
than id and text are left behind, whatever their names.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcells.llm.common import cut, text_key, texts

KINDS = ("email", "ip", "card", "phone", "context")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A failing run of digits fails at each of its digits, so only its first is tried.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
#: Thai, Lao, Burmese, Khmer, Chinese and Japanese characters, and full-width forms: each is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"
WORD = re.compile(rf"(?<![^\s{UNSPACED}])[^\s0-9@{UNSPACED}]*[0-9@][^\s{UNSPACED}]*")
TOKEN = re.compile(rf"[^\s{UNSPACED}]+|(?!\s)[{UNSPACED}]")
#: Rows of a broadcast score table, the salt beyond that, and the numbers of words that a pass holds.
SMALL, SALT, BLOCK = 1 << 20, 32, 1 << 21
LETTER = re.compile(r"\w")
EDGES = ".,;:!?()[]{}<>\"'"


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 9 <= len(DIGITS.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def words(text: str, base: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the words."""
    starts, ends = [], []
    borders, k = sorted({p for a, _, b in base for p in (a, b)}), 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while k < len(borders) and borders[k] < b:
            if borders[k] > a:
                starts.append(a)
                ends.append(borders[k])
                a = borders[k]
            k += 1
        starts.append(a)
        ends.append(b)
    return starts, ends


def contexts(text: str, starts: list[int], ends: list[int], start: int, end: int) -> list[str]:
    """Patterns around a place: the two words before it, and the word on each side.  Digits count as 0."""
    i, j = bisect.bisect_left(starts, start), bisect.bisect_right(ends, end)
    before = [DIGITS.sub("0", text[starts[k]:min(ends[k], start)]).lower() for k in range(max(0, i - 2), i)]
    out = [" ".join(before) + " _"] if len(before) == 2 else []
    if before and j < len(ends):
        out.append(f"{before[-1]} _ " + DIGITS.sub("0", text[max(starts[j], end):ends[j]]).lower())
    return out


def stripped(text: str, start: int, end: int) -> tuple[int, int]:
    """The place without the punctuation at its edges."""
    word = text[start:end].lstrip(EDGES)
    start = end - len(word)
    return start, start + len(word.rstrip(EDGES))


def key_of(what: str) -> int:
    """64 bits that stand for an instance or a pattern."""
    x = xxhash.xxh64_intdigest(what.encode(), seed=8)
    return x - (1 << 64) if x >> 63 else x


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Places of the words that the rounds score."""
    starts, longest = [a for a, _, _ in base], []
    for _, _, b in base:
        longest.append(max(b, longest[-1]) if longest else b)
    for m in WORD.finditer(text):
        a, b = stripped(text, *m.span())
        before = bisect.bisect_left(starts, b)       # seeds that begin before the word ends
        if a < b and not (before and longest[before - 1] > a):
            yield a, b


def occurrences(text: str, base: list[tuple[int, int, int]]) -> tuple[list[dict], dict[str, int]]:
    """Seeds and candidate words with their patterns; and the patterns of seeds by text."""
    places = [(a, b, True) for a, _, b in base] + [(a, b, False) for a, b in candidates(text, base)]
    at, out, named = words(text, base) if places else ([], []), [], {}
    for a, b, seed in places:
        patterns = contexts(text, *at, a, b)
        keys = list(map(key_of, patterns))
        if seed:
            named.update(zip(patterns, keys, strict=True))
        out.append({"start": a, "end": b, "instance": key_of(text[a:b]), "seed": seed, "patterns": keys})
    return out, named


class Patterns:
    """Patterns to be found beside other words: by their texts, and by the pairs of words that show them."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.key = {text: key for key, text in rows}
        self.before, self.around = set(), set()
        for text in self.key:
            one, two, three = text.split(" ")
            if three == "_":
                self.before.add((one, two))
            if two == "_":
                self.around.add((one, three))

    def drop(self, text: str) -> None:
        one, two, three = text.split(" ")
        del self.key[text]
        if three == "_":
            self.before.discard((one, two))
        if two == "_" and not (three == "_" and one + " _ _" in self.key):
            self.around.discard((one, three))

    def near(self, low: list[str]) -> list[int]:
        """Numbers of the words (lower case, digits as 0) that may have one of the patterns; no other word has."""
        before, around = self.before, self.around
        out = {i + 2 for i, pair in enumerate(zip(low, low[1:], strict=False)) if pair in before}
        out.update(i + 1 for i, pair in enumerate(zip(low, low[2:], strict=False)) if pair in around)
        for i, w in enumerate(low):                  # the punctuation at a word's edges is its neighbour
            if w[0] in EDGES or w[-1] in EDGES:
                core = w.strip(EDGES)
                if core:
                    lead, _, trail = w.partition(core)
                    last = lead or (low[i - 1] if i else "")
                    after = trail or (low[i + 1] if i + 1 < len(low) else "")
                    if (last, after) in around or lead and i and (low[i - 1], lead) in before:
                        out.add(i)
        return sorted(i for i in out if i < len(low))


def other_words(text: str, base: list[tuple[int, int, int]], wanted: Patterns) -> Iterator[tuple[int, int, list[str]]]:
    """The words that are neither seeds nor candidates, with those of their patterns that are wanted."""
    if not wanted.key:
        return
    if base:
        starts, ends = words(text, base)
        low = [DIGITS.sub("0", text[a:b]).lower() for a, b in zip(starts, ends, strict=True)]
    else:
        low = TOKEN.findall(DIGITS.sub("0", text).lower())
    near = wanted.near(low)
    if not near:
        return
    starts, ends = words(text, base)
    taken, k, reach = sorted([(a, b) for a, _, b in base] + list(candidates(text, base))), 0, 0
    for i in near:
        a, b = stripped(text, starts[i], ends[i])
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if a < b and reach <= a and LETTER.search(text, a, b):
            patterns = [x for x in contexts(text, starts, ends, a, b) if x in wanted.key]
            if patterns:
                yield a, b, patterns


SCANNED = ("doc_id bigint, key bigint, tie bigint, base array<struct<start:int,rank:int,end:int>>, "
           "found array<struct<start:int,end:int,instance:bigint,seed:boolean,patterns:array<bigint>>>, "
           "named array<struct<pattern:bigint,text:string>>")
SPAN = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("seed", pa.bool_()),
                            ("patterns", pa.list_(pa.int64()))]))
NAMED = pa.list_(pa.struct([("pattern", pa.int64()), ("text", pa.string())]))


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found, named = [], [], []
            for t in batch.column("text"):
                text = t.as_py() or ""
                spans = base_spans(text)
                base.append([{"start": a, "rank": k, "end": b} for a, k, b in spans])
                places, seeds = occurrences(text, spans)
                found.append(places)
                named.append([{"pattern": k, "text": x} for x, k in seeds.items()])
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("doc_id", "key", "tie")}, "base": pa.array(base, SPAN),
                                              "found": pa.array(found, FOUND), "named": pa.array(named, NAMED)})
    return keyed(df, id_col, text_col).mapInArrow(run, SCANNED)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts(df, id_col, text_col).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("tie", text_key())


def meet(rows: DataFrame, table: DataFrame, on: str, salt: list[str], how: str = "inner", small: int = SMALL) -> DataFrame:
    """``rows`` joined with a table of one row a key: broadcast if its counted rows are few, else with the rows of a hot key
    dealt by a hash of ``salt``."""
    if table.count() <= small:
        return rows.join(F.broadcast(table), on, how)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).withColumn("salt", F.col("salt").cast("bigint"))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*salt), F.lit(SALT))).join(salted, [on, "salt"], how).drop("salt")


def scores(edges: DataFrame, rounds: int, min_seeds: int, prior: float, small: int) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns, with the numbers of their instances, and of instances that are no seeds."""
    sure = edges.groupBy("pattern").agg(F.sum(F.col("seed").cast("int")).alias("seeds")).where(F.col("seeds") >= min_seeds)
    edges = cut(meet(edges, cut(sure.select("pattern")), "pattern", ["instance"], "left_semi", small))   # only these patterns can score
    instances = None
    for _ in range(rounds):
        if instances is None:
            scored = edges.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(0.0))
        else:
            scored = meet(edges, instances, "instance", ["pattern"], "left", small).withColumn(
                "score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        patterns = cut(scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + prior)).alias("score"), F.count("*").alias("n")))
        doubt = F.sum(F.log(F.lit(1.0) - F.least("score", F.lit(0.999999))))
        instances = cut(meet(edges.where(~F.col("seed")), patterns.drop("n"), "pattern", ["instance"], small=small)
                        .groupBy("instance").agg((1 - F.exp(doubt)).alias("score")))
    return patterns, instances


def blocks(patterns: DataFrame, weight: Column, block: int) -> Iterator[list]:
    """The patterns in parts whose weights add up to about ``block``, each a list of rows ``pattern, text, room``."""
    total = patterns.agg(F.sum(weight)).first()[0] or 0
    parts = -(-int(total) // block)
    for i in range(parts):
        yield patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == i).select("pattern", "text", "room").collect()


def few_other_words(rows: DataFrame, good: DataFrame, block: int) -> DataFrame | None:
    """Of ``pattern, text, room`` those whose places hold at most ``room`` distinct other words; None if there are no patterns."""
    out = None
    for part in blocks(good, F.col("room") + 1, block):
        limits = {r.text: (r.pattern, r.room) for r in part}

        def run(batches: Iterator[pa.RecordBatch], limits=limits) -> Iterator[pa.RecordBatch]:
            wanted = Patterns([(k, text) for text, (k, _) in limits.items()])
            seen: dict[str, set[int]] = {}
            for batch in batches:
                for t in batch.column("text"):
                    text = t.as_py() or ""
                    for a, b, patterns in other_words(text, base_spans(text), wanted):
                        for x in patterns:
                            mine = seen.setdefault(x, set())
                            mine.add(key_of(text[a:b]))
                            if len(mine) > limits[x][1] and x in wanted.key:
                                wanted.drop(x)
            if seen:
                yield pa.RecordBatch.from_pydict({"pattern": pa.array([limits[x][0] for x in seen], pa.int64()),
                                                  "words": pa.array(map(list, seen.values()), pa.list_(pa.int64()))})
        met = rows.select("text").mapInArrow(run, "pattern bigint, words array<bigint>")
        out = met if out is None else out.union(met)
    if out is None:
        return None
    more = out.select("pattern", F.explode("words").alias("word")).distinct().groupBy("pattern").agg(F.count("*").alias("more"))
    return cut(good.join(more, "pattern", "left").where(F.coalesce("more", F.lit(0)) <= F.col("room")).select("pattern", "text", "room"))


def places_of_other_words(rows: DataFrame, sure: DataFrame, block: int) -> DataFrame | None:
    """``key, tie, start, end`` of the other words in the places of these patterns."""
    out = None
    for part in blocks(sure, F.lit(1), block):
        listed = [(r.pattern, r.text) for r in part]

        def run(batches: Iterator[pa.RecordBatch], listed=listed) -> Iterator[pa.RecordBatch]:
            wanted = Patterns(listed)
            for batch in batches:
                spans = [(k, a, b) for k, text in enumerate(t.as_py() or "" for t in batch.column("text"))
                         for a, b, _ in other_words(text, base_spans(text), wanted)]
                if spans:
                    at, a, b = zip(*spans, strict=True)
                    yield pa.RecordBatch.from_pydict({"key": batch.column("key").take(pa.array(at)), "tie": batch.column("tie").take(pa.array(at)),
                                                      "start": pa.array(a, pa.int32()), "end": pa.array(b, pa.int32())})
        met = rows.select("key", "tie", "text").mapInArrow(run, "key bigint, tie bigint, start int, end int")
        out = met if out is None else out.union(met)
    return out


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, min_seeds: int = 5,
                       prior: float = 1.0, min_score: float = 0.6, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """``doc_id, spans``: array of ``kind, start, end`` by start, then kind."""
    scanned = cut(scan(df, id_col, text_col))
    places = scanned.select("key", "tie", F.explode("found").alias("f")).select("key", "tie", "f.*")
    places = places.select("key", "tie", "start", "end", "instance", "seed", F.explode("patterns").alias("pattern"))
    edges = places.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    patterns, instances = scores(edges, rounds, min_seeds, prior, small)
    good = patterns.where(F.col("score") >= min_score)
    sure = instances.where(F.col("score") >= min_score).select("instance")
    near = meet(places.where(~F.col("seed")), good.select("pattern"), "pattern", ["key", "tie", "start"], "left_semi", small)
    accepted = meet(near, sure, "instance", ["key", "tie", "start"], "left_semi", small).select("key", "tie", "start", "end")
    # score * (n + prior) / (n + prior + other words) stays at min_score or above for so many other words
    room = F.floor(F.col("score") * (F.col("n") + prior) / min_score - F.col("n") - prior + 1e-9).alias("room")
    texts_of = scanned.select(F.explode("named").alias("p")).select("p.*").groupBy("pattern").agg(F.min("text").alias("text"))
    good = cut(meet(texts_of, good.select("pattern", room), "pattern", ["text"], small=small))
    rows = keyed(df, id_col, text_col)
    stay = few_other_words(rows, good, block)
    rest = places_of_other_words(rows, stay, block) if stay is not None else None
    if rest is not None:
        accepted = accepted.union(rest)
    extra = accepted.groupBy("key", "tie").agg(F.collect_set(F.struct(
        "start", F.lit(len(KINDS) - 1).alias("rank"), "end")).alias("extra"))
    kinds = F.array(*map(F.lit, KINDS))
    every = F.array_sort(F.concat("base", F.coalesce("extra", F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)"))))
    named = F.transform(every, lambda s: F.struct(F.get(kinds, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scanned.join(extra, ["key", "tie"], "left").select("doc_id", named.alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

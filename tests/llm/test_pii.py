import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from gridcells.llm import pii


def plain(text):
    """The base patterns as they are stated."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in re.findall("[0-9]", m[0])][::-1]
        if 12 <= len(d) <= 19 and sum(d[::2]) % 10 == (-sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


PARTS = ["a", "b.c", "@", ".", "-", " ", "1", "255", "256", "4111 1111 1111 1111", "4111111111111111", "+", "(", ")", "é", "\n", "%", "00", "x@y.z"]


@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
@settings(max_examples=600, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("x" * 300_000, "1" * 300_000, "a@" * 100_000, "1.1." * 80_000, "+1(" * 90_000, "1-" * 100_000, "a@b." * 80_000):
        pii.occurrences(text, pii.base_spans(text))


def spans(df, **kw):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_personal_data(df, **kw).collect()}


def test_documents(spark, documents):
    got = spans(documents)
    for r in documents.collect():
        assert [x for x in got[r.doc_id] if x[0] != "context"] == [(pii.KINDS[k], a, b) for a, k, b in plain(r.text)]


def test_contexts_find_unseen_identifiers(spark):
    rng, rows = random.Random(2), []
    for i in range(40):
        rows.append((i, f"Filler {rng.random()} words. You can write me at person{i}@mail.example.org any time."))
    rows += [(100, "Hello. You can write me at nick_77[at]host any time."), (101, "Batch no A-1234 was shipped."),
             (102, "Also write me at zed#4411 please."), (102, "Also write me at zed#4411 please."), (103, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = spans(df)
    assert got[100] == [("context", 27, 42)] and got[101] == [] and got[103] == []
    assert [x[0] for x in got[102]] == ["context"] and all(len(got[i]) >= 1 for i in range(40))
    assert not any(x[0] == "context" for i in range(40) for x in got[i])
    assert not any(x[0] == "context" for v in spans(df, min_seeds=1000).values() for x in v)


def test_odd_rows(spark, odd_documents):
    out = pii.find_personal_data(odd_documents)
    assert out.count() == odd_documents.count()
    assert pii.find_personal_data(odd_documents.limit(0)).count() == 0


def test_any_word_in_the_place_of_a_sure_pattern(spark):
    long = "x" * 70 + "y"
    rows = [(i, f"Number {i * 7919}. You can write me at person{i}@mail.example.org any time. Or so to {i}@mail.example.org now.") for i in range(40)]
    rows += [(100 + i, f"Say it. You can write me at {name} any time.") for i, name in enumerate(("jane", "al", "q7", "u" * 90, "jane."))]
    rows += [(200 + i, f"It is or so to {chr(97 + i % 26)}{'abcd'[i // 26]}word now.") for i in range(90)]           # not sure: mostly plain words
    rows += [(300 + i, f"{long} {long}z {'k' * i}person{i}@mail.example.org {long}{long}") for i in range(9)]
    rows += [(400, f"{long} {long}z zed#4411 {long}{long}"), (401, f"{long} {long}w zed#4412 {long}{'y' * 70}")]
    got = spans(spark.createDataFrame(rows, "doc_id int, text string"))
    assert [got[100 + i] for i in range(5)] == [[("context", 28, 28 + n)] for n in (4, 2, 2, 90, 4)]
    assert not any(got[200 + i] for i in range(90))
    assert got[400] == [("context", 145, 153)] and got[401] == []


def test_texts_without_spaces(spark):
    rows = [(i, f"{'天地人'[i % 3]}{chr(0x4e00 + i)}联系邮箱person{i}@mail.example.org谢谢") for i in range(30)]
    rows += [(100, "你好联系邮箱zed_4411谢谢"), (101, "你好联系邮箱zed谢谢"), (102, "你好zed_4411谢谢")]
    got = spans(spark.createDataFrame(rows, "doc_id int, text string"))
    assert got[100] == [("context", 6, 14)] and got[101] == [("context", 6, 9)] and got[102] == []


def test_other_words_take_linear_time():
    wanted = pii.Patterns([(1, "x x _"), (2, "a _ a"), (3, ", _ ,"), (4, "你 你 _")])
    for text in ("x " * 150_000, "1" * 300_000, "a@" * 100_000, "a@b.c," * 50_000, "你" * 200_000, "1-" * 100_000, ",a," * 90_000, "a, " * 90_000):
        list(pii.other_words(text, pii.base_spans(text), wanted))


def whole(rows, rounds=3, min_seeds=5, prior=1.0, min_score=0.6):
    """The bootstrap as it is stated, over all texts at once: context spans of each."""
    edges, at, others = {}, [], []
    for k, text in enumerate(rows):
        base = pii.base_spans(text)
        starts, ends = pii.words(text, base)
        taken = [(a, b, True) for a, _, b in base] + [(a, b, False) for a, b in pii.candidates(text, base)]
        for a, b, seed in taken:
            for p in pii.contexts(text, starts, ends, a, b):
                edges[p, text[a:b]] = edges.get((p, text[a:b]), False) or seed
                at.append((k, a, b, seed, p))
        for s, e in zip(starts, ends):
            a, b = pii.stripped(text, s, e)
            if a < b and re.search(r"\w", text[a:b]) and not any(x < b and y > a for x, y, _ in taken):
                others += [(k, a, b, p) for p in pii.contexts(text, starts, ends, a, b)]
    patterns = {}
    for (p, i), seed in edges.items():
        patterns.setdefault(p, {})[i] = seed
    patterns = {p: x for p, x in patterns.items() if sum(x.values()) >= min_seeds}
    score = {}
    for _ in range(rounds):
        sure = {p: sum(1.0 if seed else score.get(i, 0.0) for i, seed in x.items()) / (len(x) + prior) for p, x in patterns.items()}
        doubt = {}
        for p, x in patterns.items():
            for i, seed in x.items():
                if not seed:
                    doubt[i] = doubt.get(i, 1.0) * (1 - min(sure[p], 0.999999))
        score = {i: 1 - d for i, d in doubt.items()}
    good = {p for p in patterns if sure[p] >= min_score}
    out = {(k, a, b) for k, a, b, seed, p in at if not seed and p in good and score.get(rows[k][a:b], 0) >= min_score}
    words = {}
    for k, a, b, p in others:
        words.setdefault(p, set()).add(rows[k][a:b])
    out |= {(k, a, b) for k, a, b, p in others if p in good
            and sure[p] * (len(patterns[p]) + prior) / (len(patterns[p]) + len(words[p]) + prior) >= min_score - 1e-12}
    return [sorted((a, b) for j, a, b in out if j == k) for k in range(len(rows))]


def random_rows(seed):
    rng = random.Random(seed)
    words = ["mail", "to", "me", "(at)", "call,", "see", "|", "Id:", "x", "the", "ΑΣ", "你好"]
    def one():
        r = rng.random()
        return (f"u{rng.randrange(40)}@h{rng.randrange(3)}.org" if r < .12 else f"10.0.{rng.randrange(9)}.{rng.randrange(9)}" if r < .16
                else f"nick{rng.randrange(12)}" if r < .24 else f"({rng.randrange(5)})," if r < .27 else rng.choice(words))
    rows = []
    for _ in range(60):
        rows.append(" ".join(one() for _ in range(rng.randrange(1, 25))))
        if rng.random() < .6:
            rows[-1] += f" mail me | {rng.choice([one(), f'p{rng.randrange(99)}@q.net', f'p{rng.randrange(99)}@q.net', 'jane.', 'bob'])} | to"
    return rows


def test_contexts_as_stated(spark):
    any_word = any_context = 0
    for seed in range(4):
        rows = random_rows(seed)
        df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "doc_id int, text string").repartition(3)
        want = whole(rows, min_seeds=3, min_score=0.5)
        for how in ({}, {"small": 0, "block": 7}):           # salted joins, and several passes
            got = spans(df, min_seeds=3, min_score=0.5, **how)
            assert [sorted((a, b) for k, a, b in got[i] if k == "context") for i in range(len(rows))] == want
        any_context += sum(map(len, want))
        any_word += sum(not re.search("[0-9@]", rows[i][a:b]) for i, x in enumerate(want) for a, b in x)
    assert any_context > 20 and any_word > 5


def test_a_common_pattern_with_many_words_is_dropped(spark):
    rows = [(i, f"cell | person{i}@mail.example.org | {i}") for i in range(12)]
    rows += [(100 + i, "row " + " ".join(f"| {a}{b}w{'xyz'[i % 3]} |" for a in "abcdefgh" for b in "abcdefgh")) for i in range(200)]
    got = spans(spark.createDataFrame(rows, "doc_id int, text string").repartition(5))
    assert not any(got[100 + i] for i in range(200)) and all([x[0] for x in got[i]] == ["email"] for i in range(12))


def test_length_does_not_matter(spark):
    rows = [(i, f"No {i * 7919}x. You can write me at person{i}@mail.example.org any time.") for i in range(40)]
    rows += [(100 + n, f"Say it. You can write me at {'z' * (n - 1)}7 any time.") for n in (1, 3, 4, 64, 65, 300)]
    got = spans(spark.createDataFrame(rows, "doc_id int, text string"))
    assert all(got[100 + n] == [("context", 28, 28 + n)] for n in (1, 3, 4, 64, 65, 300))

import re
import time
from collections import Counter

from gridcells.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def fails(line):
    n = len(WORD.findall(line))
    lower = "".join(c.lower() if c in q.UPPER else c for c in line)
    return (sum(line.count(c) for c in q.SYMBOLS) * 5 > n or sum(line.count(c) for c in q.SEPARATORS) * 5 > n
            or (n < 12 and not re.search(q.MARKS, line)) or (n < 40 and any(p in lower for p in q.PHRASES)))


def verdict(text):
    n, *_, repeated = base(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    bad = [x for x in lines if fails(x)]
    failed = n < 50 or 100 * repeated > 50 * n
    clean = "\n".join(x for x in (text or "").split("\n") if not (WORD.search(x) and fails(x)))
    return failed, not failed and 100 * sum(map(len, bad)) <= 50 * sum(map(len, lines)), clean


def test_equals_plain_python(spark, documents):
    docs = documents.where("length(text) < 4000")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in q.quality_rules(docs).collect():
        t = texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t)
        assert (r.base_failed, r.kept, r.clean) == verdict(t)


def test_lines(spark):
    prose = "This is a sentence, and it goes on long enough to count for something here. " * 5
    rows = [(1, prose + "\nHome | News | Sports | Contact\n\nAll rights reserved, 2024.\n" + prose),
            (2, "\n".join(["Home | News | Contact us"] * 30)), (3, prose + "\n### *** $$$ %%% &&&\n" + prose + "\nMenu item"),
            (4, "a b c d e f " * 100), (5, "a b a b a")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    out = {r.doc_id: r for r in q.quality_rules(df).collect()}
    for i, t in rows:
        assert (out[i].base_failed, out[i].kept, out[i].clean) == verdict(t)
    assert out[1].n_lines_removed == 2 and out[3].n_lines_removed == 2 and not out[2].kept
    assert out[4].n_repeat_words == 600 and out[5].n_repeat_words == 5
    assert not [x for x in ("MapInArrow", "Python", "Exchange") if x in q.quality_rules(df)._jdf.queryExecution().executedPlan().toString()]


def test_only_unlike_documents_go(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = q.quality_rules(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in out}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) == 0 and n[0, False] > 5


def test_odd_rows(spark, odd_documents):
    out = q.quality_rules(odd_documents).collect()
    assert len(out) == odd_documents.count()
    assert {r.n_words for r in out if r.doc_id in (1, 2, 3)} == {0} and not any(r.kept for r in out if r.doc_id in (1, 2, 3, 4))
    kept = q.keep_good(odd_documents)
    assert kept.columns == odd_documents.columns and {r.doc_id for r in kept.collect()} <= {7, 8, None}
    assert q.quality_rules(odd_documents.limit(0)).count() == 0


def test_working_names_are_left_alone(spark):
    prose = " ".join(f"w{i}" for i in range(60)) + "."
    df = spark.createDataFrame([(1, prose, "a", "b", "c", 7)], "doc_id int, text string, q string, row string, __q string, `n chars.x` int")
    assert [tuple(r) for r in q.keep_good(df).collect()] == [(1, prose, "a", "b", "c", 7)] and q.keep_good(df).columns == df.columns


def test_many_failing_lines_take_linear_time(spark):
    took = []
    for n in (20_000, 80_000):
        df = spark.createDataFrame([(1, "\n".join(f"| {i} |" for i in range(n)))], "doc_id int, text string")
        q.quality_rules(df).first()
        began = time.time()
        assert q.quality_rules(df).first().n_lines_removed == n
        took.append(time.time() - began)
    assert took[1] < 7 * took[0] + 2

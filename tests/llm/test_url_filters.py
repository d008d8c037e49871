import datetime as dt
import re

from gridcells.llm import url_filters as u

D = lambda s: dt.date.fromisoformat(s)


def test_as_of_verdicts(spark):
    events = [("spam", True, "example.com", D("2021-03-01"), True), ("spam", True, "example.com", D("2021-05-01"), False),
              ("spam", True, "example.com", D("2021-08-01"), True), ("ok", False, "Good.example.com", D("2021-04-01"), True),
              ("spam", True, "good.example.com/bad/x", D("2021-01-01"), True), ("spam", True, None, D("2021-01-01"), True),
              ("spam", True, "late.org", None, True), ("ok", False, "same.org", D("2021-01-01"), True), ("spam", True, "same.org", D("2021-01-01"), True),
              ("spam", True, "day.org", D("2021-01-01"), True), ("spam", True, "day.org", D("2021-01-01"), False)]
    ev = spark.createDataFrame(events, "list_name string, blocks boolean, pattern string, day date, adds boolean")
    cases = [("http://example.com/", "2021-02-28", "none"), ("http://example.com/", "2021-03-01", "block"),
             ("https://u:p@WWW.Example.COM.:8080/a?b#c", "2021-04-30", "block"), ("http://example.com/", "2021-05-01", "none"),
             ("http://example.com", "2030-01-01", "block"), ("http://good.example.com/x", "2021-03-05", "block"),
             ("http://good.example.com/x", "2021-04-05", "allow"), ("http://good.example.com/bad/x/y", "2021-04-05", "block"),
             ("http://good.example.com/bad/xy", "2021-04-05", "allow"), ("http://notexample.com/", "2021-04-05", "none"),
             ("http://late.org/", "2021-04-05", "none"), ("http://same.org/", "2021-04-05", "block"), ("http://day.org/", "2021-04-05", "none"),
             (None, "2021-04-05", "none"), ("", "2021-04-05", "none"), ("no url", "2021-04-05", "none"), ("http://example.com/", None, "none"),
             ("http://example.com/" + "a/" * 50_000, "2021-04-05", "block"), ("http://" + "a." * 50_000 + "example.com/", "2021-04-05", "block"),
             ("http://localhost/x", "2021-04-05", "none")]
    rows = [(i, url, None if day is None else D(day), "x") for i, (url, day, _) in enumerate(cases)]
    rows += rows[1:3] + [(None, "http://example.com/", D("2021-04-01"), "y")]
    cap = spark.createDataFrame(rows, "page_id int, url string, fetched_on date, pattern string")
    out = u.judge_captures(cap, ev).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.verdict == ("block" if r.id is None else cases[r.id][2]), (r.id, r)
        assert (r.n_active > 0) == (r.verdict != "none") == (r.pattern is not None)
    assert u.judge_captures(cap.limit(0), ev).count() == 0
    assert {r.verdict for r in u.judge_captures(cap, ev.limit(0)).collect()} == {"none"}


def test_intervals(spark):
    events = [("l", True, "a", D(f"2021-0{m}-01"), m % 3 == 1) for m in range(1, 9)]
    ev = spark.createDataFrame(events, "list_name string, blocks boolean, pattern string, day date, adds boolean")
    got = sorted((r.valid_from, r.valid_to) for r in u.validity(ev).collect())
    assert got == [(D("2021-01-01"), D("2021-02-01")), (D("2021-04-01"), D("2021-05-01")), (D("2021-07-01"), D("2021-08-01"))]


def test_no_python_in_the_plan(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = u.judge_captures(u.page_captures(pages), u.page_list_events(pages))
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", out._jdf.queryExecution().executedPlan().toString())
    assert out.groupBy("verdict").count().count() == 3


def test_hosts_of_many_labels_meet_long_and_short_entries(spark):
    names = ["com", "b.com", "a.b.com", "x.y.z.a.b.com", "host", "other.host"]
    events = [("l", True, n, D("2021-01-01"), True) for n in names] + [("l", False, "q.a.b.com/p/q", D("2021-01-01"), True)]
    ev = spark.createDataFrame(events, "list_name string, blocks boolean, pattern string, day date, adds boolean")
    cases = {"http://b.com": ("b.com", 1), "http://v.a.b.com": ("a.b.com", 2), "http://w.x.y.z.a.b.com/": ("x.y.z.a.b.com", 3), "http://com/": ("com", 1),
             "http://host": ("host", 1), "http://deep.other.host": ("other.host", 1), "http://c.com": (None, 0), "http://q.a.b.com/p/q/r": ("q.a.b.com/p/q", 3),
             "http://" + "k." * 100_000 + "b.com": ("b.com", 1)}
    cap = spark.createDataFrame([(i, u_, D("2021-02-01")) for i, u_ in enumerate(cases)], "page_id int, url string, fetched_on date")
    got = {r.url: (r.pattern, r.n_active) for r in u.judge_captures(cap, ev).collect()}
    assert got == cases

"""URL filters by a temporal list join, in DataFrame expressions only.

Lists change over time: dated events add entries to a list or remove them.  The events of an entry become
validity intervals ``[valid_from, valid_to)``, and each capture is judged by the entries that were
active when it was fetched.

An entry's pattern is a domain (it and its subdomains match) or a host with a path (whole path segments
match).  A capture is exploded to the patterns that could match it, its host's domains and its path's leading
segments (neither deeper than the deepest entry), so the as-of join is an equality join on the pattern with
a condition on the time; the intervals of an entry do not overlap, so a capture meets each entry at most once.
The most specific (longest) active pattern decides; of equally long ones a blocking list
goes before an allowing one.

Equal captures are counted first and judged once; one pattern that a third of all captures share is
a join key whose captures Spark may split, and its events are reduced to one a day before their order matters.

Cases.  Captures without a time, or whose url has no host, match nothing; events without a date or pattern are ignored;
of several events of an entry on one day a removal wins; repeated captures each get their result.  Without captures
there are no rows; without events every verdict is none.  A host of any number of labels and a path of any length are taken whole, but
make no more patterns than the deepest entry has labels or segments.  Only the id, url and time of a capture are read,
so other columns cannot clash with working names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without port, user and a last dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit(""))), r"\.$", "")


def segments_of(url: Column) -> Column:
    return F.array_remove(F.split(F.regexp_extract(url, PATH, 1), "/"), "")


def pattern_keys(host: Column, segments: Column, depth: Column, labels: Column) -> Column:
    """The patterns that may match: the host's domains of two or more, but at most ``labels`` labels (or the host, if it has
    one), and host/path of at most ``depth`` segments."""
    most = F.least(labels, F.size(F.split(host, r"\.")))
    domains = F.transform(F.sequence(F.lit(2), F.greatest(most, F.lit(2))),
                          lambda k: F.call_function("substring_index", host, F.lit("."), -k))
    n = F.least(F.size(segments), depth)
    paths = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                        lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.concat(domains, F.when(n > 0, paths).otherwise(F.array().cast("array<string>"))))


def validity(events: DataFrame) -> DataFrame:
    """``list_name, blocks, pattern, valid_from, valid_to`` of events ``list_name, blocks, pattern,
    day, adds``; an entry that is not removed again has no end."""
    days = (events.where("day is not null and pattern is not null").groupBy("list_name", "blocks", "pattern", "day")
            .agg(F.min("adds").alias("adds")))
    order = Window.partitionBy("list_name", "blocks", "pattern").orderBy("day")
    return (days.withColumn("valid_to", F.lead("day").over(order)).where("adds")
            .select("list_name", "blocks", F.lower("pattern").alias("pattern"), F.col("day").alias("valid_from"), "valid_to"))


def judge_captures(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url",
                   time_col: str = "fetched_on") -> DataFrame:
    """``id, url, fetched_on, host, verdict`` (block, allow or none), the deciding ``pattern``, its list
    and since when it was listed, and ``n_active`` (entries active at that time)."""
    entries = validity(events)
    slashes = F.length("pattern") - F.length(F.translate("pattern", "/", ""))
    deepest = entries.agg(F.coalesce(F.max(slashes), F.lit(0)).alias("depth"),
                          F.coalesce(F.max(F.when(slashes == 0, F.size(F.split("pattern", r"\.")))), F.lit(1)).alias("labels")).first()
    seen = (captures.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                            F.col(f"`{time_col}`").cast("date").alias("fetched_on"))
            .groupBy("id", "url", "fetched_on").agg(F.count("*").alias("times")))
    seen = seen.withColumn("host", host_of(F.col("url")))
    keyed = seen.select("*", F.explode_outer(pattern_keys(F.col("host"), segments_of(F.col("url")), F.lit(deepest.depth),
                                                           F.lit(deepest.labels))).alias("pattern"))
    active = ((F.col("fetched_on") >= F.col("valid_from"))
              & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to"))))
    met = keyed.join(entries, (keyed.pattern == entries.pattern) & active, "left").drop(keyed.pattern)
    best = F.max(F.when(F.col("pattern").isNotNull(), F.struct(
        F.length("pattern").alias("size"), "blocks", "list_name", "pattern", "valid_from")))
    out = met.groupBy("id", "url", "fetched_on", "host", "times").agg(best.alias("best"), F.count("pattern").alias("n_active"))
    verdict = F.when(F.col("best.blocks"), "block").when(F.col("best").isNotNull(), "allow").otherwise("none")
    return out.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).select(
        "id", "url", "fetched_on", "host", verdict.alias("verdict"), F.col("best.pattern").alias("pattern"),
        F.col("best.list_name").alias("list_name"), F.col("best.valid_from").alias("listed_since"), "n_active")


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages with a day of fetching worked out from their number (the table has none)."""
    return pages.select("page_id", "url", F.expr("date_add(date'2021-01-01', cast(pmod(page_id * 7919, 1100) as int))").alias("fetched_on"))


def page_list_events(pages: DataFrame) -> DataFrame:
    """Dated events for hosts, domains and first path segments of the pages, by their hashes: of
    two lists, four events each (add, remove, add, remove) on days in the same years."""
    host = host_of(F.col("url"))
    names = pages.where("url is not null").select(host.alias("host"), F.get(segments_of(F.col("url")), F.lit(0)).alias("first")).where("host <> ''")
    keys = names.select(F.explode(F.array(F.col("host"), F.substring_index("host", ".", -2),
                                          F.concat_ws("/", "host", "first"))).alias("pattern")).distinct()
    lists = keys.select("pattern", F.explode(F.array(
        F.struct(F.lit("spam").alias("list_name"), F.lit(True).alias("blocks")),
        F.struct(F.lit("trusted").alias("list_name"), F.lit(False).alias("blocks")))).alias("l")).select("pattern", "l.*")
    number = "cast(conv(substr(md5(concat(pattern, list_name, {})), 1, 7), 16, 10) as bigint)"
    listed = lists.where(F.expr(number.format("'x'") + " % 3 = 0"))
    return listed.select("list_name", "blocks", "pattern", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select(
        "list_name", "blocks", "pattern", (F.col("k") % 2 == 0).alias("adds"),
        F.expr(f"date_add(date'2021-01-01', cast({number.format('k')} % 250 + 250 * k as int))").alias("day"))

"""Secrets in texts: three base patterns and a pair of character Markov models, in DataFrame expressions only.

Base spans, leftmost and non-overlapping for each kind: ``assign`` (a name such as password or
token, then a value of 6+ characters), ``access`` (AKIA..., 20+), ``hex`` (24+ hexadecimal digits).

Models.  Two first-order Markov chains over characters: one of random strings, one of ordinary
words and identifiers.  Both learn from a labelled sample of about ``train_rows`` distinct texts, chosen by a hash
of the text, so copies change nothing: as random are labelled the values that the base patterns match there and the base64
forms of ``train_rows`` SHA-256 digests; as ordinary a fixed list of words (``COMMON``, for tables with few texts), and those of the other words that are found after ``min_texts``
different words in as many texts, since a word of one text, or of copies of it, may be a secret that no base
pattern knows.  Distinct strings count once.  A string of ``min_length`` or more characters of the alphabet, with a letter, is a ``model`` span if its log-likelihood ratio is at least
``min_ratio`` a step.  Strings that are an access or hex match as a whole are not reported twice.  The table of ratios has one
entry for each pair of characters, so its size is fixed.

Positions are code points, end exclusive.  Scanning is one projection of a row without a
shuffle; a pattern is matched in full only where a first test finds it.

Cases.  A null or empty text has no spans; an empty table gives no rows; with few texts the fixed samples carry the models;
very long texts cost their own task only; repeated rows and ids are scanned row by row.  Only the texts of
the sample are shuffled; columns other than id and text are left behind by the scan, and kept as they are by ``redact``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcells.llm.common import let, texts
from gridcells.llm.common import scan as running

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"            # as AKIA[A-Z0-9]+ and then 20 or more characters
HEX = r"[0-9a-f]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}={0,2}"
#: Ordinary in four languages and in code, for tables with few texts.
COMMON = """the and that have with this from they will would there their what about which when make like time just know take
people into year your good some could them other than then look only come over think also back after work first well even
want because these give most information number system program question government during without however another between
international development management available university community different important according application
configuration environment administration communication documentation user name account password session server client
request response message error warning index value string object array function class method return import export default
public private static config settings service database table column query update delete insert select create file path
directory image content header footer button window height width color background style version release license test build
https http www com org html json data code text page home search login profile order product price address email phone
der die und das nicht eine sich auch werden durch haben wird sein ihre nach über keine können schon zwischen jahr gesellschaft
entwicklung wissenschaft möglichkeit verwaltung regierung verschiedene les des une pour dans est que qui avec sur pas plus
sont cette leur être tout comme nous vous deux aussi même années gouvernement développement université organisation
los las una por con para como más pero sus este entre cuando muy sin sobre también hasta desde donde todo durante siempre
desarrollo gobierno universidad información administración"""
KINDS = ("assign", "access", "hex", "model")
SPAN = "array<struct<start:int,rank:int,end:int>>"
CHUNK = 4096


def located(text: Column, pattern: str, rank: int, keep=None, group: int = 0) -> Column:
    """Spans of the matches of ``pattern`` that pass ``keep(match, its group)``: the matches and
    the texts between them, laid end to end, give the positions (running sums of their lengths)."""
    def place(between, matches, groups):
        sizes = F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(between, i)))

        def spans(before):
            def span(m, i):
                start = F.get(before, i) + F.length(F.get(between, i))
                kept = F.lit(True) if keep is None else keep(m, F.get(groups, i))
                return F.when(kept, F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(m)).alias("end")))
            return F.filter(F.transform(matches, span), lambda x: x.isNotNull())
        return let(let(sizes, lambda z: running(z, F.lit(0), lambda x, y: x + y)), spans)

    whole = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else m,
        lambda g: let(F.split(text, pattern, -1), lambda b: place(b, m, g))))
    return F.when(text.rlike(pattern), whole).otherwise(F.expr(f"cast(array() as {SPAN})"))


def base_spans(text: Column) -> Column:
    return F.concat(located(text, ASSIGN, 0, lambda m, value: F.length(value) >= 6, group=1),
                    located(text, ACCESS, 1), located(text, HEX, 2))


def ratio_per_step(word: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of the steps of a word; ``table`` is indexed by both characters."""
    def mean(letters):
        steps = F.transform(F.sequence(F.lit(1), F.size(letters) - 1), lambda i: F.coalesce(
            F.get(table, F.ascii(F.get(letters, i - 1)) * 128 + F.ascii(F.get(letters, i))), F.lit(0.0)))
        return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.size(steps)
    return let(F.split(word, ""), mean)


def ordinary_forms() -> list[str]:
    """Words that are ordinary in any table, also joined in pairs as names and paths are."""
    words = COMMON.split()
    return [form for i, (a, b) in enumerate(zip(words, words[1:] + words[:1])) for form in (
        a, a.title(), a.upper(), f"{a}_{b}", f"{a}-{b}", f"{a}{b.title()}", f"{a.upper()}_{b.upper()}", f"/{a}/{b}",
        f"{a}{37 * i % 9973}", f"{1900 + i % 150}-{1 + i % 12:02}-{1 + i % 28:02}")]


def picked(docs: DataFrame, train_rows: int) -> DataFrame:
    """About ``train_rows`` distinct texts, chosen by their hash, or all if there are no more; each
    once, as copies are combined before the shuffle."""
    some = docs.where("text is not null").select("text")
    n = some.agg(F.approx_count_distinct("text", 0.02)).first()[0]
    if n > train_rows:
        some = some.where(F.pmod(F.xxhash64("text"), F.lit(1 << 32)) < (train_rows << 32) // n)
    return some.distinct()


def samples(docs: DataFrame, train_rows: int, min_texts: int = 3) -> DataFrame:
    """``word, random`` of the labelled sample, distinct."""
    some = picked(docs, train_rows)
    values = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
                      F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    rest = F.regexp_replace("text", "|".join((ASSIGN, ACCESS, HEX)), " ")
    words = F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_-]{4,}"), F.lit(0))

    def labelled(word, random, before):
        return F.struct(word.alias("word"), F.lit(random).alias("random"), before.alias("before"))
    every_word = F.concat(F.transform(values, lambda x: labelled(x, 1, F.lit(""))), let(words, lambda w: F.transform(
        w, lambda x, i: labelled(x, 0, F.coalesce(F.get(w, i - 1), F.lit(""))))))
    found = some.select(F.xxhash64("text").alias("text"), F.explode(every_word).alias("s")).select("text", "s.*")
    places = found.groupBy("word", "random", "before").agg(F.min("text").alias("text"))       # the first text of each place
    known = places.groupBy("word", "random").agg(F.count_distinct("text").alias("n"))
    known = known.where((F.col("random") == 1) | (F.col("n") >= min_texts)).select("word", "random")
    spark = docs.sparkSession
    digests = spark.range(train_rows).select(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))).alias("word"), F.lit(1).alias("random"))
    common = spark.range(1).select(F.explode(F.split(F.lit(" ".join(ordinary_forms())), " ")).alias("word"), F.lit(0).alias("random"))
    return known.union(digests).union(common).distinct()


def ratio_table(docs: DataFrame, train_rows: int = 4000, smoothing: float = 1.0) -> list[float]:
    """log P(random step) - log P(ordinary step) for every pair of ASCII characters; 0 outside the
    alphabet."""
    steps = samples(docs, train_rows).where(F.length("word") > 1).select("random", F.explode(let(
        F.split("word", ""), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1),
                                                   lambda i: F.concat(F.get(w, i - 1), F.get(w, i))))).alias("step"))
    seen = steps.groupBy("step").agg(F.sum("random").alias("r"), F.sum(1 - F.col("random")).alias("o"))
    pairs = (docs.sparkSession.range(len(ALPHABET) ** 2)
             .select(F.substring(F.lit(ALPHABET), (F.floor(F.col("id") / len(ALPHABET)) + 1).cast("int"), F.lit(1)).alias("a"),
                     F.substring(F.lit(ALPHABET), (F.col("id") % len(ALPHABET) + 1).cast("int"), F.lit(1)).alias("b")))
    counts = pairs.join(F.broadcast(seen), F.concat("a", "b") == F.col("step"), "left").select(
        "a", "b", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("o", F.lit(0)).alias("o"))
    totals = counts.groupBy("a").agg(F.sum("r").alias("tr"), F.sum("o").alias("to"))
    n = len(ALPHABET)
    ratio = (F.log((F.col("r") + smoothing) / (F.col("tr") + smoothing * n))
             - F.log((F.col("o") + smoothing) / (F.col("to") + smoothing * n)))
    out = [0.0] * (128 * 128)
    for row in counts.join(totals, "a").select("a", "b", ratio.alias("x")).collect():     # one row a pair of characters
        out[ord(row.a) * 128 + ord(row.b)] = row.x
    return out


def model_spans(text: Column, table: Column, min_length: int, min_ratio: float) -> Column:
    def secret(match, _):
        whole = match.rlike(f"^({ACCESS}|{HEX})$")
        return match.rlike("[A-Za-z]") & ~whole & (ratio_per_step(F.rtrim(match, F.lit("=")), table) >= min_ratio)
    return located(text, CANDIDATE % min_length, 3, secret)


def scan(text: Column, ratios: list[float], min_length: int, min_ratio: float) -> Column:
    """All spans by start, then kind."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    return let(F.coalesce(text.cast("string"), F.lit("")), lambda t: F.array_sort(
        F.concat(base_spans(t), model_spans(t, table, min_length, min_ratio))))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 4000,
                 min_length: int = 20, min_ratio: float = 0.25) -> DataFrame:
    """``doc_id, spans``: array of ``kind, start, end``."""
    docs = texts(df, id_col, text_col)
    found = scan(F.col("text"), ratio_table(docs, train_rows), min_length, min_ratio)
    return docs.select("doc_id", named(found).alias("spans"))


def named(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.transform(spans, lambda s: F.struct(F.get(kinds, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", train_rows: int = 4000, min_length: int = 20,
           min_ratio: float = 0.25, id_col: str = "doc_id") -> DataFrame:
    """``df`` with every span (overlapping ones as one) replaced by ``mark`` in the text, and
    ``n_chars`` following if there is one.  A null or empty text stays as it is, repeated rows are changed alike, an empty table gives no
    rows, a very long text takes time in proportion to its length, and other columns are left alone, whatever their names."""
    ratios = ratio_table(texts(df, id_col, text_col), train_rows)

    def without(text, spans):
        """The text in chunks of ``CHUNK`` characters, so that a part of it is cut from the chunks it lies in; and the end
        that all spans before a span reach, from which the text goes on."""
        chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

        def cut(parts, a, b):
            first, last = F.floor(a / CHUNK).cast("int"), F.floor(F.greatest(b - 1, a) / CHUNK).cast("int")
            within = F.transform(F.slice(parts, first + 1, last - first + 1), lambda c, i: F.substring(
                c, F.when(i == 0, a - first * CHUNK).otherwise(0) + 1,
                F.least(b, (first + i + 1) * CHUNK) - F.when(i == 0, a).otherwise((first + i) * CHUNK)))
            return F.when(b > a, F.array_join(within, "")).otherwise("")

        def joined_up(parts, reach):
            pieces = F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(reach, i), F.concat(
                cut(parts, F.get(reach, i), s["start"]), F.lit(mark))))
            end = F.array_max(F.transform(spans, lambda s: s["end"]))
            return F.concat(F.array_join(F.filter(pieces, lambda x: x.isNotNull()), ""), cut(parts, end, F.length(text)))
        return let(chunks, lambda parts: let(running(F.transform(spans, lambda s: s["end"]), F.lit(0), F.greatest),
                                             lambda reach: joined_up(parts, reach)))

    text = F.col(f"`{text_col}`")
    new = let(scan(text, ratios, min_length, min_ratio), lambda s: F.when(F.size(s) == 0, text).otherwise(without(text, s)))
    out = df.withColumn(text_col, new)
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(df.schema["n_chars"].dataType))
    return out

"""Secret scans: patterns of known kinds, and character Markov models for the rest; DataFrame operations only.

Base spans are the matches of three patterns.  Spark has no function for the places of all matches, but the text between
matches (``split``) and the matches themselves (``regexp_extract_all``) come from the same search, so places are sums of
lengths.  The method adds spans: long tokens whose log-likelihood under a first-order Markov model of random strings exceeds
that under a model of ordinary identifiers.  The models are trained from labelled samples: random strings made from digests of a
counter, and words of a bounded, hashed sample of documents.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm import common

#: (kind, pattern, group whose length counts, least length); kinds in the order in which they are listed.
#: For access and hex the least length is in the pattern: their matches are whole runs, so a shorter one hides none.
KINDS = [
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: What a text must hold for a kind to be looked for.
HINTS = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{24}"}
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
CHUNK = 128


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,nth:int,end:int,kind:string>>")


def _placed(df: DataFrame, text: str, name: str, pattern: str, hint: str, nth: int, group: int = 0, least: int = 0) -> DataFrame:
    """``df`` with the array column ``name`` of (start, nth, end, kind) of the pattern's matches in code points.

    Starts are sums of lengths before a match: of whole chunks of matches, of chunks of chunks, and of those in its own
    chunk, so that each match takes at most some CHUNK steps, and a chunk of chunks one for every CHUNK^2 matches before it.
    """
    has = F.col(text).rlike(hint)
    df = df.withColumn("_has", has)
    own = F.when(F.col("_has"), F.col(text)).otherwise("")
    df = df.withColumns({
        "_gaps": F.transform(F.split(own, pattern, -1), F.length),
        "_hits": F.transform(F.regexp_extract_all(own, F.lit(pattern), F.lit(0)), F.length),
        "_sizes": F.transform(F.regexp_extract_all(own, F.lit(pattern), F.lit(group)), F.length),
    })
    df = df.withColumn("_units", F.zip_with(F.slice("_gaps", 1, F.size("_hits")), "_hits", lambda g, h: g + h))
    chunks = lambda a: F.sequence(F.lit(0), F.floor(F.size(a) / CHUNK).cast("int"))
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    df = df.withColumn("_totals", F.transform(chunks("_units"), lambda c: add(F.slice("_units", c * CHUNK + 1, CHUNK))))
    df = df.withColumn("_wholes", F.transform(chunks("_totals"), lambda c: add(F.slice("_totals", c * CHUNK + 1, CHUNK))))
    df = df.withColumn("_firsts", F.transform(chunks("_totals"), lambda c: add(F.slice("_wholes", 1, c))))

    def before(c):
        d = F.floor(c / CHUNK).cast("int")
        return F.element_at("_firsts", d + 1) + add(F.slice("_totals", d * CHUNK + 1, c - d * CHUNK))

    df = df.withColumn("_before", F.transform(chunks("_units"), before))

    def span(hit, k):
        c = F.floor(k / CHUNK).cast("int")
        start = F.element_at("_before", c + 1) + add(F.slice("_units", c * CHUNK + 1, k - c * CHUNK)) + F.element_at("_gaps", k + 1)
        return F.struct(start.alias("start"), F.lit(nth).alias("nth"), (start + hit).alias("end"), F.lit(name).alias("kind"))

    spans = F.filter(F.transform("_hits", span), lambda s, k: F.element_at("_sizes", k + 1) >= least)
    df = df.withColumn(name, F.when(F.size("_hits") > 0, spans).otherwise(_no_spans()))
    return df.drop("_has", "_gaps", "_hits", "_sizes", "_units", "_totals", "_wholes", "_firsts", "_before")


def _pairs(strings: DataFrame) -> DataFrame:
    """Counts of neighbouring characters (as first x 128 + second) of the ASCII strings in column s."""
    codes = F.transform(F.split(F.col("s"), ""), lambda c: F.ascii(c))
    two = F.zip_with(F.slice(codes, 1, F.greatest(F.length("s") - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.length("s") - 1, F.lit(0))), lambda a, b: a * 128 + b)
    return strings.where(F.length("s") >= 2).select(F.explode(two).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def train(docs: DataFrame, max_docs: int = 1000, samples: int = 3000) -> Column:
    """Literal array of 128 x 128 log-likelihood ratios (random over ordinary) of neighbouring characters.

    ``samples`` random strings of each of three alphabets against the words of at most ``max_docs`` documents (those with
    the smallest hashes of doc_id) and their capitalised, upper-case and joined forms.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("terrane"), F.col("id")), 512)
    base64 = F.translate(F.regexp_replace(F.base64(F.unhex(digest)), r"[=\s]", ""), "+/", "-_")
    random = spark.range(samples).select(F.explode(F.array(digest, base64, F.regexp_replace(F.upper(base64), "[-_]", ""))).alias("s"))
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("w"))
    forms = F.array(F.col("w"), F.initcap("w"), F.upper("w"), F.concat_ws("_", F.lower("w"), F.lit("id")), F.concat_ws("-", F.lit("get"), F.lower("w")), F.concat_ws("/", F.lit("data"), F.lower("w")))
    tables = [{r["pair"]: r["n"] for r in _pairs(s).collect()} for s in (random, words.select(F.explode(forms).alias("s")))]
    rows = [[sum(t.get(a * 128 + b, 0) for b in range(128)) for a in range(128)] for t in tables]
    alphabet = 66

    def ratio(a, b):
        p = [(t.get(a * 128 + b, 0) + 0.2) / (r[a] + 0.2 * alphabet) for t, r in zip(tables, rows)]
        return f"{math.log(p[0] / p[1]):.4f}"

    return F.split(F.lit(",".join(ratio(a, b) for a in range(128) for b in range(128))), ",").cast("array<double>")


def _random(token: Column, ratios: Column, margin: float) -> Column:
    """Whether the token's log-likelihood ratio is over ``margin`` per pair of characters."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    both = F.zip_with(F.slice(codes, 1, F.length(token) - 1), F.slice(codes, 2, F.length(token) - 1), lambda a, b: F.element_at(ratios, a * 128 + b + 1))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x) > margin * (F.length(token) - 1)


def _touches(spans: str, s: Column) -> Column:
    """Whether a span meets one of ``spans``, which ascend and do not overlap each other: the last that starts before its end
    is found by halving."""

    def halve(at, _):
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        below = F.element_at(spans, mid + 1)["start"] < s["end"]
        return F.when(at["lo"] < at["hi"], F.struct(F.when(below, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(below, at["hi"]).otherwise(mid).alias("hi"))).otherwise(at)

    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(spans).cast("long"))))
    before = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve, lambda at: at["lo"])
    return F.when(F.size(spans) == 0, False).otherwise(F.coalesce(F.get(F.col(spans), before - 1)["end"] > s["start"], F.lit(False)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, margin: float = 0.6, max_docs: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_random.

    A null text counts as empty; a text without spans has an empty list, and the digest of an empty text.  Places are code
    points, the end exclusive.  The method's spans (kind random) never touch a base span.  Null doc_ids stay null; other
    columns are not read; an empty table gives an empty one.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ratios = train(docs, max_docs)
    df = docs
    for nth, (kind, pattern, group, least) in enumerate(KINDS):
        df = _placed(df, "text", kind, pattern, HINTS[kind], nth, group, least)
    df = df.withColumn("base", F.array_sort(F.concat(*(k for k, *_ in KINDS))))
    df = _placed(df, "text", "random", TOKEN, TOKEN, len(KINDS))
    df = df.withColumn("_tokens", F.when(F.size("random") > 0, F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))))
    apart = lambda s: ~reduce(lambda a, b: a | b, [_touches(k, s) for k, *_ in KINDS])
    told = F.filter("random", lambda s, k: apart(s) & _random(F.element_at("_tokens", k + 1), ratios, margin))
    df = df.withColumn("random", F.when(F.size("random") > 0, told).otherwise(F.col("random")))
    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    spans = F.when(F.size("random") > 0, _joined(F.array_sort(F.concat("base", "random")))).otherwise(_joined(F.col("base")))
    return df.select("doc_id", *(count(k) for k, *_ in KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"), count("random"))


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(common.read(spark, sf_dir, "documents"))

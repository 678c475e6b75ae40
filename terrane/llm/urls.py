"""URL filters by a cascade of Bloom filters; DataFrame operations only.

A rule is a host and the beginning of a path; it fits its host and every subdomain.  Every url has a fixed number of candidate
keys (its host's last labels, as many as some rule has, joined to the beginnings of its path, as long as some rule's), and
the longest candidate that is a listed key is its rule.  Whether a key is listed is told by the cascade: level 0 encodes the listed
keys, level 1 the false positives of level 0 among all candidate keys of the corpus, level 2 the listed keys that level 1
takes for such, and so on until no error is left.  Over this complete universe the answer is exact, and a page is
judged by looking at bits, without a join.

Level 0 is sized by the universe, its error rate being listed / (sqrt 2 x universe), so that all further levels together
stay proportional to the number of listed keys, however large the corpus.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import common

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A filter of up to so many 64-bit words is a literal of the plan; a larger one is the result of a subquery, up to MOST words.
LITERAL, MOST = 4096, 1 << 24


class Level:
    """One Bloom filter: an array of 64-bit words that every task holds, of a size that is checked."""

    def __init__(self, salt: int, bits: int, hashes: int, words: DataFrame):
        self.salt, self.bits, self.hashes = salt, bits, hashes
        n = bits // 64
        if n <= LITERAL:
            found = {r["word"]: r["bits"] for r in words.collect()}
            self.words = F.split(F.lit(",".join(str(found.get(k, 0)) for k in range(n))), ",").cast("array<bigint>")
        else:
            every = words.sparkSession.range(n).join(words, F.col("id") == F.col("word"), "left")
            every = common.cut(every.select("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")), "bloom-words")
            rows = every.agg(F.array_sort(F.collect_list(F.struct("id", "bits"))).alias("w"))
            self.words = rows.select(F.transform("w", lambda s: s["bits"])).scalar()

    @staticmethod
    def places(key: Column, salt: int, bits: int, hashes: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(salt * 64 + j)), F.lit(bits)) for j in range(hashes)]

    @classmethod
    def build(cls, keys: DataFrame, n: int, rate: float, salt: int) -> Level:
        """From ``n`` distinct keys, which bound the filter's size: one of over MOST words is refused."""
        bits = 64 * max(1, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
        if bits > 64 * MOST:
            raise ValueError(f"{n} listed keys need a filter of {bits // 8} bytes; tasks hold at most {8 * MOST}")
        hashes = max(1, round(-math.log2(rate)))
        place = keys.select(F.explode(F.array(*cls.places(F.col("key"), salt, bits, hashes))).alias("at"))
        one = F.expr("shiftleft(1L, cast(at % 64 as int))")
        words = place.groupBy(F.expr("cast(at div 64 as int)").alias("word")).agg(F.bit_or(one).alias("bits"))
        return cls(salt, bits, hashes, words)

    def passes(self, key: Column) -> Column:
        def bit(at):
            word = F.element_at(self.words, (F.floor(at / 64) + 1).cast("int"))
            return F.getbit(word, (at % 64).cast("int")) == 1

        return reduce(lambda a, b: a & b, [bit(p) for p in self.places(key, self.salt, self.bits, self.hashes)])


class Cascade:
    """Exact membership of listed keys among a universe of keys."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """Both have one column, key; null keys are ignored, and repeated ones count once.  An empty list has no level."""
        listed = common.cut(listed.where("key is not null").distinct(), "bloom-listed")
        n = listed.count()
        if not n:
            return cls([])
        universe = universe.where("key is not null")
        size = universe.agg(F.approx_count_distinct("key", 0.02)).first()[0]
        first = Level.build(listed, n, min(0.5, n / (math.sqrt(2) * max(1, size))), 0)
        false = universe.where(first.passes(F.col("key"))).distinct().join(listed, "key", "left_anti")
        levels, sides = [first], [common.cut(false, "bloom-false"), listed]
        while n := sides[0].count():
            levels.append(Level.build(sides[0], n, 0.5, len(levels)))
            sides = [common.cut(sides[1].where(levels[-1].passes(F.col("key"))), "bloom-side"), sides[0]]
        return cls(levels)

    def holds(self, key: Column) -> Column:
        """A key that fails first at an odd level is listed; one that fails none is what the last level encodes."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            out = F.when(self.levels[k].passes(key), out).otherwise(F.lit(k % 2 == 1))
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ://, up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end."""
    parts = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), _UPPER, _LOWER), F.regexp_extract(url, parts, 2)


def _table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    one = [F.struct(*(F.lit(x).alias(n) for n, x in zip(("verdict", "host", "path"), r))) for r in rules]
    empty = F.array().cast("array<struct<verdict:string,host:string,path:string>>")
    return spark.range(1).select(F.inline(F.array(*one) if one else empty))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (null where none fits) and verdict.

    ``rules``: (verdict, host, path) as a list or a table; rows with a null in it are left out, and of rules with one host and
    path block wins.  Only their shapes (numbers of labels and lengths of paths) come to the driver.  The longest rule that
    fits wins.  A null url, or one without ://, has an empty host and path and the default verdict; so has an empty path
    where a rule asks for /.  Repeated rows come out repeated; other columns are not read; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        table = rules.where("verdict is not null and host is not null and path is not null")
        shapes = table.select(F.size(F.split("host", "[.]")).alias("labels"), F.length("path").alias("length")).distinct()
        shapes = sorted((r["labels"], r["length"]) for r in shapes.collect())
    else:
        table, shapes = _table(spark, rules), sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})

    def key(labels: int, length: int) -> Column:
        own = F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, length))
        return F.when(F.length("path") >= length, own)

    keys = [key(*s) for s in shapes]
    if not keys:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    universe = rows.select("host", "path").distinct().select(F.explode(F.array(*keys)).alias("key"))
    name = F.concat("host", "path").alias("key")
    listed = Cascade.build(table.select(name), universe)
    blocks = Cascade.build(table.where("verdict = 'block'").select(name), table.select(name))
    fits = [F.when(listed.holds(k), F.struct(F.length(k).alias("n"), k.alias("rule"))) for k in keys]
    rows = rows.withColumn("rule", F.array_max(F.array(*fits))["rule"])
    verdict = F.when(F.col("rule").isNull(), default).when(blocks.holds(F.col("rule")), "block").otherwise("allow")
    return rows.withColumn("verdict", verdict)


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(common.read(spark, sf_dir, "pages"))


OP7_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                  ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
j AS (
  SELECT p.*, (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM r
               WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS rule
  FROM p)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(r.verdict, 'allow') AS verdict
FROM j LEFT JOIN r ON j.rule = r.host || r.path
"""

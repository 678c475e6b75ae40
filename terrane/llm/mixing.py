"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key whose rate is its quality weight; in the order of their keys the documents of a
source are a weighted sample without replacement.  A source takes as many complete epochs as its target holds, and then
documents in key order until their summed words reach what is left of the target; the document at that border is cut.

No task sees a whole source: the border key is found by summing words over 1,024 ranges of keys, then over 1,024 ranges
of the border range, then over the few documents of the border range's border range.  What comes out is one small row a source,
with which every document decides by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm import common

RANGES = 1024


def quality(text: Column) -> Column:
    """Weight in [0.1, 1]: the share of letters among the characters that are not white space."""
    solid = F.length(F.regexp_replace(text, common.SPACE, ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.when(solid > 0, F.lit(0.1) + F.lit(0.9) * letters / solid).otherwise(F.lit(0.1))


def _drawn(docs: DataFrame, seed: int, weight: Column | None) -> DataFrame:
    """``docs`` with _size, _source, _key and _h; (_key, _h) orders a source and ties only for repeated rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = F.xxhash64("doc_id", "source", text, F.lit(seed))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return docs.withColumns({
        "_source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")),
        "_size": F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long"),
        "_w": quality(text) if weight is None else F.greatest(weight.cast("double"), F.lit(1e-6)),
        "_h": h,
    }).withColumn("_key", -F.log(u) / F.col("_w"))


def _ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with _rank, the place of its source by code point, null last, from 0; no task sees all sources.

    Sources are dealt by range and sorted there; a source's place is that in its range, after the counts of those before.
    """
    order = F.col("source").asc_nulls_last()
    dealt = sizes.repartitionByRange(order).sortWithinPartitions(order).withColumn("_range", F.spark_partition_id())
    dealt = common.cut(dealt, "mix-sources")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counts = counts.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("_range").orderBy(order)))
    ranked = ranked.join(counts, F.col("_range") == F.col("_r"))
    return ranked.withColumn("_rank", F.col("_before") + F.col("_nth") - 1).drop("_range", "_r", "_before", "_nth")


def targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """(_source, source, source_size) → with target: sources by code point, null last, weigh 1, 2, 3 in turn and share all
    words; no target exceeds ``max_epochs`` times its source, and what is above goes to the others by weight.

    This is water-filling: the level (words for a weight of one) rises, as sources whose cap is under it are capped and leave
    the others more, until it stands still.  Each step is one sum over the sources.  One row a source.
    """
    s = _ranked(sizes).withColumns({"_weight": F.col("_rank") % 3 + 1, "_cap": F.lit(max_epochs) * F.col("source_size")}).drop("_rank")
    s = common.cut(s, "mix-weights")
    level = 0.0
    while True:
        under = F.col("_cap") <= F.lit(level) * F.col("_weight")
        sums = s.agg(F.sum("source_size").alias("all"), F.sum(F.when(under, F.col("_cap"))).alias("capped"), F.sum(F.when(~under, F.col("_weight"))).alias("open")).first()
        if not sums["open"]:
            break
        higher = ((sums["all"] or 0) - (sums["capped"] or 0)) / sums["open"]
        if higher <= level:
            break
        level = higher
    return s.withColumn("target", F.least(F.col("_cap").cast("double"), F.lit(float(level)) * F.col("_weight"))).drop("_weight", "_cap")


def _border(sums: DataFrame, order: list[str]) -> DataFrame:
    """(_source, *order, words) and _left → the first range of each source at which the words reach _left; _left goes down by
    the words before it.  Sources of which nothing is left to take have no row."""
    w = Window.partitionBy("_source").orderBy(*order)
    s = sums.withColumn("_sum", F.sum("words").over(w)).where("_sum >= _left and _left > 0 and words > 0")
    s = s.withColumn("_nth", F.row_number().over(w)).where("_nth = 1")
    return s.withColumn("_left", F.col("_left") - (F.col("_sum") - F.col("words"))).drop("_sum", "_nth")


def plan(digest: DataFrame, max_epochs: int = 3) -> DataFrame:
    """One row a source: source_size, target, _epochs, and the border: _bkey, _bh, _bwords (words of the border document).

    ``digest`` is a stored table of :func:`_drawn` without the texts.
    """
    sizes = digest.groupBy("_source").agg(F.min("source").alias("source"), F.sum("_size").alias("source_size"), F.avg("_w").alias("_rate"))
    per = targets(sizes, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(F.lit(0)).cast("long")
    per = per.withColumn("_epochs", epochs)
    left = F.greatest(F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs) - F.col("_epochs") * F.col("source_size"), F.lit(0))
    per = common.cut(per.withColumn("_left", left), "mix-targets")
    place = (1 - F.exp(-F.col("_key") * F.col("_rate"))) * RANGES
    placed = digest.select("_source", "_size", "_key", "_h").join(per.select("_source", "_rate", "_left"), "_source").where("_left > 0")
    placed = placed.withColumn("_r1", F.least(F.floor(place), F.lit(RANGES - 1)).cast("int"))
    placed = placed.withColumn("_r2", F.least(F.floor((place - F.col("_r1")) * RANGES), F.lit(RANGES - 1)).cast("int")).drop("_rate")
    one = placed.groupBy("_source", "_r1").agg(F.sum("_size").alias("words"), F.first("_left").alias("_left"))
    one = common.cut(_border(one, ["_r1"]).drop("words"), "mix-border")
    inner = placed.drop("_left").join(one, ["_source", "_r1"])
    two = inner.groupBy("_source", "_r1", "_r2").agg(F.sum("_size").alias("words"), F.first("_left").alias("_left"))
    two = common.cut(_border(two, ["_r2"]).drop("words"), "mix-border")
    last = placed.drop("_left").join(two, ["_source", "_r1", "_r2"])
    last = last.groupBy("_source", "_key", "_h").agg(F.sum("_size").alias("words"), F.count("*").alias("_same"), F.first("_left").alias("_left"))
    last = _border(last, ["_key", "_h"])
    border = last.select("_source", F.col("_key").alias("_bkey"), F.col("_h").alias("_bh"), F.floor(F.col("_left") / F.col("_same")).alias("_bwords"))
    return common.cut(per.select("_source", "source_size", "target", "_epochs").join(border, "_source", "left"), "mix-plan")


_DIGEST = ["_source", "source", "_size", "_w", "_key", "_h"]


def _taken(drawn: DataFrame, p: DataFrame) -> DataFrame:
    """Rows of :func:`_drawn` with what the plan takes of them."""
    before = (F.col("_key") < F.col("_bkey")) | ((F.col("_key") == F.col("_bkey")) & (F.col("_h") < F.col("_bh")))
    at = (F.col("_key") == F.col("_bkey")) & (F.col("_h") == F.col("_bh"))
    part = F.when(before, F.col("_size")).when(at, F.least("_size", "_bwords")).otherwise(F.lit(0))
    taken = F.col("_epochs") * F.col("_size") + part
    out = drawn.drop("size", "source_size", "target", "taken").join(p, "_source")
    return out.withColumns({"size": F.col("_size"), "taken": taken.cast("long")}).drop("_source", "_size", "_w", "_h", "_key", "_epochs", "_bkey", "_bh", "_bwords")


def mix(docs: DataFrame, max_epochs: int = 3, seed: int = 20, weight: Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words that the mix takes of the row, repeats counted).

    Null texts and texts without words have size 0 and are never taken; null sources are one source, after all others; rows
    with a null doc_id draw keys from their text.  Repeated rows draw the same key and share what is left at a border.  Columns
    named size, source_size, target or taken are replaced.  Keys depend on the row and ``seed`` alone, so reruns agree.
    """
    drawn = _drawn(docs, seed, weight)
    return _taken(drawn, plan(common.cut(drawn.select(_DIGEST), "mix-keys"), max_epochs))


def shares(docs: DataFrame, max_epochs: int = 3, seed: int = 20, weight: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken, one row per row of ``docs``, as :func:`mix` has them; reads texts once."""
    digest = common.cut(_drawn(docs, seed, weight).select("doc_id", *_DIGEST), "mix-keys")
    return _taken(digest, plan(digest, max_epochs)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, max_epochs: int = 3, seed: int = 20, weight: Column | None = None) -> DataFrame:
    """The rows of the mix: each document as often as the mix takes it whole, then its first words where a border cuts it.

    All columns come back as they were, whatever their names; only a cut document's text is shorter.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    rest = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("_rest")] if others else []
    rows = docs.select("doc_id", "text", "source", *rest, *([] if weight is None else [weight.alias("_weight")]))
    m = mix(rows, max_epochs, seed, None if weight is None else F.col("_weight"))
    whole, part = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    none = F.array().cast("array<bigint>")
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(none))
    m = m.withColumn("_part", F.explode(F.when(F.col("size") > 0, copies).otherwise(none)))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(common.WORD), F.lit(0)), 1, F.col("_part").cast("int")), " ")
    text = F.when(F.col("_part") < 0, F.col("text")).otherwise(head)
    return m.select(*((text if c == "text" else F.col(f"_rest.`{c}`") if c in others else F.col(c)).alias(c) for c in docs.columns))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    return shares(common.read(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)

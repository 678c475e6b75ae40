"""SimHash near-duplicates by pivot distance tables.

Every distinct fingerprint gets its Hamming distances to fixed reference fingerprints (pivots).  By the triangle
inequality two fingerprints at most ``radius`` bits apart differ by at most ``radius`` in every coordinate, so pairs whose
largest coordinate difference is more are discarded unseen; the survivors are verified by their bits.

Pairs are looked for inside blocks only: with ``b`` blocks of bits, fingerprints at most ``radius`` bits apart agree on
some ``b - radius`` whole blocks, so equal blocks are an equi-join key that loses no link.  The number of blocks follows the
number of distinct fingerprints, so that a block's bucket stays near a constant size; every choice is exact.  A larger bucket
is dealt in pairs of parts over many tasks.  Rows come in the order of their first pivot distance, and a row meets only those
within ``radius`` of its own; of those, the other pivots discard what differs by more in some coordinate, and the rest is
verified.  A task holds two parts at most, and rows that already hang together are not compared again.

Few bits of a short fingerprint tell only nearly equal texts apart.  For copies of a given similarity (``near_copies``) texts
get 1,024 bits over their sets of shingles, whose share of differing bits follows the angle between the sets.  There, pairs
come from blocks of bits that such copies share with known probability, enough of them to find a pair at the
threshold with ``recall``; the pivot table and the verification are the same, over more bits.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import common
from terrane.llm.passages import word_hashes

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64


def pivots(n: int) -> np.ndarray:
    """``n`` reference fingerprints: the SplitMix64 sequence."""
    with np.errstate(over="ignore"):
        x = np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text: a bit is set if it is in over half of the shingles' XXH64."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    ends, starts = ends[shingle - 1 :].tolist(), [0, *(ends[:-1] + 1).tolist()]
    if not ends:
        ends, starts = [len(joined)], [0]
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(ends)
    for k in range(0, n, 65536):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : k + 65536], ends[k : k + 65536])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((counts * 2 > n).astype(_U) << np.arange(64, dtype=_U)).sum(dtype=_U))


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): a null text counts as empty, whose fingerprint is zero."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t or b"", shingle) for t in b.column(1).to_pylist()], _U).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def blocks(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """Block keys for n fingerprints: each is a list of (shift, width) whose bits must be equal; together they miss no pair."""
    for b in range(radius + 1, 65):
        edges = [64 * i // b for i in range(b + 1)]
        parts = [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]
        if n >> sum(sorted(w for _, w in parts)[: b - radius]) <= 2048 or b == 2 * radius:
            return [list(c) for c in combinations(parts, b - radius)]
    raise AssertionError


def _keys(fp: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    key = np.zeros(len(fp), _U)
    for shift, width in parts:
        key = (key << _U(width)) | ((fp >> _U(shift)) & _U((1 << width) - 1))
    return key.view(np.int64)


def window_links(fp: np.ndarray, group: np.ndarray, at: np.ndarray, ref: np.ndarray, radius: int, old: int, own: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Labels that join rows of the same group at most ``radius`` bits apart.

    Rows come sorted by (group, at), ``at`` being the distance to the first pivot; pairs of the first ``old`` rows are known.
    In a ``mixed`` group, of two parts, only rows that differ in ``own`` are compared.
    """
    n = len(fp)
    table = [np.bitwise_count(fp ^ p).astype(np.int8) for p in ref]
    sets = common.Sets(n)
    labels, i, k = sets.labels(), np.arange(n), 0
    while True:
        k += 1
        i = i[: np.searchsorted(i, n - k)]
        j = i + k
        near = (group[i] == group[j]) & (at[j] - at[i] <= radius)
        i = i[near]
        if not len(i):
            return sets.labels()
        a = i[(i + k >= old) & (labels[i] != labels[i + k])]
        a = a[~mixed[a] | (own[a] != own[a + k])]
        for row in table:
            if not len(a):
                break
            a = a[np.abs(row[a] - row[a + k]) <= radius]
        a = a[np.bitwise_count(fp[a] ^ fp[a + k]) <= radius]
        if len(a):
            sets.join(a, a + k)
            labels = sets.labels()


def _in_parts(dealt: DataFrame, part: int) -> DataFrame:
    """Rows of buckets (block, key) → with low, high and own: a bucket of more than ``part`` rows is dealt into parts by
    its reps, and every two of them meet, so each pair of the bucket is compared once, and no task holds the bucket."""
    large = common.cut(dealt.groupBy("block", "key").agg(F.count("*").alias("n")).where(F.col("n") > part), "simhash-large")
    dealt = dealt.join(large, ["block", "key"], "left")
    parts = F.when(F.col("n").isNull(), 1).otherwise(F.ceil(F.col("n") / part)).cast("int")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep", "block"), parts).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.withColumns({"low": F.least("own", "_other"), "high": F.greatest("own", "_other")}).drop("n", "_other")


def links(reps: DataFrame, radius: int = 4, n_pivots: int = 16, batch: int = 200_000, part: int = 16_384) -> DataFrame:
    """(fp, rep) with distinct fp → (u, v) links between reps that hang together at most ``radius`` bits apart.

    A spanning forest of every bucket comes out, not its pairs.  Buckets of more than ``part`` rows are dealt in pairs of parts.
    """
    ref, parts = pivots(n_pivots), blocks(reps.count(), radius)

    def spread(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(_U)
            at = np.bitwise_count(fp ^ ref[0]).astype(np.int32)
            for k, p in enumerate(parts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fp), k, np.int32)), pa.array(_keys(fp, p)), pa.array(at), b.column(0), b.column(1)],
                    ["block", "key", "at", "fp", "rep"],
                )

    def compare(batches):
        held, n = [], 0
        carry = None

        def work(held, carry, last):
            t = common.table(held)
            cols = [] if t is None else [t.column(c).to_numpy() for c in names]
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols)] if cols else carry
            block, key, low, high, own, at, fp, rep = cols
            group = np.cumsum(np.r_[False, (block[1:] != block[:-1]) | (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            label = window_links(fp.view(_U), group, at, ref[1:], radius, 0 if carry is None else len(carry[0]), own, low != high)
            linked = label != np.arange(len(fp))
            out = pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[label[linked]])], ["u", "v"])
            keep = (group == group[-1]) & (at >= at[-1] - radius)
            return out, None if last else [c[keep] for c in cols]

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= batch:
                out, carry = work(held, carry, False)
                held, n = [], 0
                yield out
        if n:
            yield work(held, carry, True)[0]

    names, keys = ["block", "key", "low", "high", "own", "at", "fp", "rep"], ["block", "key", "low", "high"]
    dealt = _in_parts(reps.select("fp", "rep").mapInArrow(spread, "block int, key long, at int, fp long, rep long"), part).select(names)
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "at", "fp").mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, n_pivots: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp long, component_id (smallest doc_id reachable over links, itself included).

    Null texts count as empty; all texts without words share fingerprint zero and so hang together.  Rows with a null
    doc_id get their fingerprint's component and never name one; repeated rows come out repeated.  Columns of ``docs`` beside
    id and text are not read.  An empty table gives an empty one.
    """
    fps = common.cut(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    reps = common.cut(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-rep")
    component = common.connected_components(links(reps, radius, n_pivots), "simhash-cc")
    named = reps.join(component, reps.rep == component.node, "left")
    named = named.select(F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "component_id")


def _majority(rows: np.ndarray) -> np.ndarray:
    """(n, words) → words: a bit is set if it is in over half of the rows.

    Counts every bit at once: carry-save adders turn rows of one weight into sums and carries, until a row of each
    weight is left.
    """
    planes, level, n = [], rows, len(rows)
    while len(level):
        carries = []
        while len(level) > 2:
            k = len(level) // 3
            a, b, c = level[:k], level[k : 2 * k], level[2 * k : 3 * k]
            either = a ^ b
            carries.append((a & b) | (c & either))
            level = np.concatenate([either ^ c, level[3 * k :]])
        if len(level) == 2:
            carries.append(level[:1] & level[1:])
            level = level[:1] ^ level[1:]
        planes.append(level[0])
        level = np.concatenate(carries) if carries else level[:0]
    least = n // 2 + 1
    more, same = np.zeros(rows.shape[1], _U), np.full(rows.shape[1], ~_U(0))
    for weight in reversed(range(max(len(planes), least.bit_length()))):
        plane = planes[weight] if weight < len(planes) else np.zeros(rows.shape[1], _U)
        if least >> weight & 1:
            same = same & plane
        else:
            more, same = more | (same & plane), same & ~plane
    return more | same


def wide_fingerprint(text: bytes, shingle: int = 5, words: int = 16) -> bytes:
    """Fingerprint of ``words`` x 64 bits over a text's set of shingles (a text of fewer words is one shingle)."""
    w = word_hashes(text)
    if not len(w):
        return bytes(8 * words)
    k = min(shingle, len(w))
    with np.errstate(over="ignore"):
        h = np.zeros(len(w) - k + 1, _U)
        for j in range(k):
            h = h * _U(0x100000001B3) + w[j : j + len(h)]
        h = np.unique(h)
        x = h[:, None] + np.arange(1, words + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return _majority(x).tobytes()


def near_links(reps: DataFrame, similarity: float, n_pivots: int = 8, recall: float = 0.97, part: int = 2048, batch: int = 50_000) -> DataFrame:
    """(fp binary, rep) with distinct fp → (u, v) links between reps of texts that are ``similarity`` alike.

    Sets of Jaccard similarity s and equal size have a cosine of 2s / (1 + s), and differ in the share of bits that their
    angle has of a half turn; two per cent are added for the spread of such a count.  Blocks of bits are as wide as keeps
    buckets near 64 rows, and as many as find a pair at the threshold with ``recall``.  Every pair of a bucket is compared;
    one of more than ``part`` rows is dealt in pairs of parts.
    """
    n, wide = reps.count(), reps.select(F.max(F.length("fp"))).first()[0] or 8
    bits = 8 * wide
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    most = int(bits * (apart + 0.02))
    width = max(12, math.ceil(math.log2(max(n, 1) / 64)))
    bands = math.ceil(math.log(1 - recall) / math.log(1 - (1 - apart) ** width))
    ref = np.tile(pivots(n_pivots)[:, None], (1, bits // 64)) ^ pivots(n_pivots + bits // 64)[n_pivots:]

    def spread(batches):
        for b in batches:
            rows = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, wide)
            ones = np.unpackbits(rows, axis=1, bitorder="little").astype(np.int64)
            place = np.int64(1) << np.arange(width, dtype=np.int64)
            for k in range(bands):
                key = ones[:, (np.arange(width) + k * width) % bits] @ place
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), pa.array(key), b.column(0), b.column(1)], ["block", "key", "fp", "rep"])

    def compare(batches):
        held, rows = [], 0

        def work(tables):
            t = pa.concat_tables(tables).combine_chunks()
            fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), "<u8").reshape(-1, bits // 64)
            rep = t.column("rep").to_numpy()
            group = np.repeat(np.arange(len(tables)), [len(x) for x in tables])
            own, alone = t.column("own").to_numpy(), (t.column("low").to_numpy() == t.column("high").to_numpy())
            table = np.stack([np.bitwise_count(fp ^ r).sum(axis=1, dtype=np.int32) for r in ref], axis=1)
            sets = common.Sets(len(fp))
            label, i, k = sets.labels(), np.arange(len(fp)), 0
            while True:
                k += 1
                i = i[: np.searchsorted(i, len(fp) - k)]
                i = i[group[i] == group[i + k]]
                if not len(i):
                    break
                a = i[label[i] != label[i + k]]
                a = a[alone[a] | (own[a] != own[a + k])]  # pairs of one part meet where it is alone
                a = a[(np.abs(table[a] - table[a + k]) <= most).all(axis=1)]
                a = a[np.bitwise_count(fp[a] ^ fp[a + k]).sum(axis=1, dtype=np.int32) <= most]
                if len(a):
                    sets.join(a, a + k)
                    label = sets.labels()
            linked = label != np.arange(len(fp))
            return pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[label[linked]])], ["u", "v"])

        for t in common.runs(batches, 4):
            if t.num_rows > 1:
                held.append(t)
                rows += t.num_rows
            if rows >= batch:
                yield work(held)
                held, rows = [], 0
        if held:
            yield work(held)

    dealt = reps.select("fp", "rep").mapInArrow(spread, "block int, key long, fp binary, rep long")
    dealt = _in_parts(dealt, part).select("block", "key", "low", "high", "own", "fp", "rep")
    keys = ["block", "key", "low", "high"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "u long, v long")


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, words: int = 16, recall: float = 0.97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id (smallest doc_id reachable over links, itself included).

    Texts link when their sets of ``shingle``-word shingles are ``similarity`` alike (Jaccard), as far as the fingerprints
    tell.  Null and empty texts and repeated rows are treated as in :func:`near_duplicates`.
    """
    common.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([wide_fingerprint(t or b"", shingle, words) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    fps = common.cut(rows.mapInArrow(run, "doc_id long, fp binary"), "simhash-wide")
    reps = common.cut(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-rep")
    component = common.connected_components(near_links(reps, similarity, recall=recall), "simhash-cc")
    named = reps.join(component, reps.rep == component.node, "left")
    named = named.select(F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, F.col("fp") == F.col("_fp"), "left").select("doc_id", "component_id")


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays: the one with the smallest
    doc_id.  Rows without a doc_id stay."""
    keep = near_copies(docs).where("doc_id is null or doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, docs.doc_id.eqNullSafe(keep.doc_id), "left_semi").select(docs.columns)

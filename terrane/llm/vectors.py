"""Near-duplicate vectors by a forest of random-projection trees.

Vectors are compared within their label, so every label has trees of its own.  A tree splits its vectors again and again at
the median of a random projection; vectors near a split go to both sides (spill), as near as twice what linked vectors
differ there typically, so that few linked pairs are parted, and a dense group, which would go to both sides whole, is not
split but compared whole.  Where the trees of a cell would compare no fewer pairs than it has, it is one leaf.  Labels of more than ``part`` vectors are first split into cells that the shuffle deals over tasks, each
vector travelling to the few cells that it spills into; splits of cells are fitted on bounded samples, again within those that
are still large.  Inside a task many trees are grown over the cell's own vectors; within their leaves all pairs are compared in
double precision, block by block, and what comes out is not pairs but, for each vector, how many partners it has there
and the smallest vector it hangs together with.  A pair is counted once, in the first cell that it shares.

Equal vectors are one class from the start.  A cell that cannot be split below ``part`` classes is dealt in pairs of parts.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import common

_MASK = (1 << 63) - 1


@lru_cache(4096)
def _direction(dim: int, *key: int) -> np.ndarray:
    d = np.random.default_rng([abs(k) for k in key]).standard_normal(dim)
    return d / np.sqrt(d @ d)


def grow(x: np.ndarray, n: int, leaf: int, margin: float, key: tuple[int, ...], enough: int = 32, tries: int = 3, progress: float = 0.9) -> tuple[dict[int, tuple[int, float]], list[tuple[int, np.ndarray]]]:
    """A tree over unit vectors, of which there are ``n`` in truth: node → (which direction, where it splits), and the leaves
    as (node, rows).  Nodes are numbered as in a heap, from 1.

    A node is split until it stands for at most ``leaf`` vectors, has fewer than ``enough`` rows, or no direction leaves
    each side at most ``progress`` of it.
    """
    nodes, leaves, todo = {}, [], [(1, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) * n > leaf * len(x) and len(rows) >= enough and node < 1 << 40:
            for k in range(tries):
                p = x[rows] @ _direction(x.shape[1], *key, node, k)
                at = float(np.median(p))
                left, right = rows[p <= at + margin], rows[p > at - margin]
                if max(len(left), len(right)) <= progress * len(rows):
                    nodes[node] = (k, at)
                    todo += [(2 * node, left), (2 * node + 1, right)]
                    break
            if node in nodes:
                continue
        leaves.append((node, rows))
    return nodes, leaves


def route(x: np.ndarray, rows: np.ndarray, nodes: dict[int, tuple[int, float]], margin: float, key: tuple[int, ...]) -> list[tuple[int, np.ndarray]]:
    """The leaves of a grown tree as (node, those of ``rows`` that it holds)."""
    out, todo = [], [(1, rows)]
    while todo:
        node, rows = todo.pop()
        if node not in nodes:
            out.append((node, rows))
        elif len(rows):
            k, at = nodes[node]
            p = x[rows] @ _direction(x.shape[1], *key, node, k)
            todo += [(2 * node, rows[p <= at + margin]), (2 * node + 1, rows[p > at - margin])]
    return out


def _below(cell: int, node: int) -> int:
    """Number of a cell's leaf; 0 is a whole label."""
    x = (cell * 0x9E3779B97F4A7C15 + node) & ((1 << 64) - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
    return (x ^ (x >> 31)) & _MASK


def cells(x: np.ndarray, trees: dict[int, dict], margin: float, seed: int) -> list[tuple[int, np.ndarray]]:
    """(cell, rows) of one label's vectors; ``trees``: cell → its nodes, where it is split."""
    out, todo = [], [(0, np.arange(len(x)))]
    while todo:
        cell, rows = todo.pop()
        if cell in trees:
            todo += [(_below(cell, node), r) for node, r in route(x, rows, trees[cell], margin, (seed, cell)) if len(r)]
        else:
            out.append((cell, rows))
    return out


def units(values: np.ndarray) -> np.ndarray:
    values = values.astype(float)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _valid(v) -> F.Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _first(lists: np.ndarray, p: np.ndarray, q: np.ndarray, this: int) -> np.ndarray:
    """Whether ``this`` is the smallest number that rows p and q both have."""
    if lists.shape[1] == 1:
        return np.ones(len(p), bool)
    mine = lists[p]
    both = (mine[:, :, None] == lists[q][:, None, :]).any(axis=2) & (mine >= 0)
    return np.where(both, mine, np.iinfo(np.int64).max).min(axis=1) == this


def compare(x: np.ndarray, many: np.ndarray, own: np.ndarray, mixed: bool, codes: np.ndarray, code: int, threshold: float, leaf: int, trees: int, margin: float, seed: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(partners counted here, index of the smallest row that each hangs together with) of the unit vectors of one cell,
    which is at most two parts, so that a bit for each pair is held.

    ``codes`` has the cells of each row, ``code`` this one; in a ``mixed`` cell, of two parts, only rows that differ in
    ``own`` meet.
    """
    n = len(x)
    groups = [r for t in range(trees) for _, r in grow(x, n, leaf, margin, (seed, t + 1))[1]]
    if sum(len(r) ** 2 for r in groups) >= n * n:  # trees that save nothing: the cell is one leaf
        groups = [np.arange(n)]
    linked = np.zeros((n, n), bool)
    for rows in groups:
        rows = np.sort(rows)
        for a in range(0, len(rows), block):
            one = rows[a : a + block]
            for b in range(a, len(rows), block):
                two = rows[b : b + block]
                i, j = np.nonzero(x[one] @ x[two].T >= threshold)
                linked[one[i], two[j]] = True
    partners, sets = np.zeros(n, np.int64), common.Sets(n)
    root = sets.labels()
    for a in range(0, n, block):
        i, j = np.nonzero(linked[a : a + block])
        i += a
        keep = i < j
        if mixed:
            keep &= own[i] != own[j]
        i, j = i[keep], j[keep]
        for k in range(0, len(i), 100_000):
            p, q = i[k : k + 100_000], j[k : k + 100_000]
            once = _first(codes, p, q, code)
            np.add.at(partners, p[once], many[q[once]])
            np.add.at(partners, q[once], many[p[once]])
            apart = root[p] != root[q]
            if apart.any():
                pair = np.unique(np.stack([root[p[apart]], root[q[apart]]]), axis=1)
                sets.join(pair[0], pair[1])
                root = sets.labels()
    return partners, root


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, trees: int = 6, leaf: int = 256, part: int = 4096, sample: int = 16_384, seed: int = 11,
                    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors link when their labels and lengths are equal, no label is null, and their cosine is at least ``threshold``.  Null
    or zero vectors, those with a null or non-finite component, and rows with a null label or id link with nothing
    (component_id is the vec_id, n_links 0, kept).  Repeated rows are vectors of their own, linked with each other.  Other
    columns are not read; an empty table gives an empty one.

    ``sample`` bounds the vectors that the split of one cell is fitted on (a cell of more than ``part`` classes gets at most
    sample / 64 below it, which are split again while they are large); every vector is indexed.  What all tasks hold of the
    trees is some 100 bytes for every ``part`` vectors.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    v = F.col(vec_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    usable = _valid(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    keys = [F.when(usable, F.xxhash64("v", F.lit(k))).alias(f"k{k}") for k in (1, 2)]
    rows = rows.select("id", "label", *keys, F.when(usable, F.col("v")).alias("v"), F.size("v").alias("dim"))
    same = ["label", "dim", "k1", "k2"]
    # classes are known by hashes of their vectors; the vectors come from the input again, by the id of a class's first row
    classes = common.cut(rows.where("k1 is not null").groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("many")), "rp-classes")
    of = [F.col(c).alias(f"_{c}") for c in same]
    on = (F.col("id") == F.col("rep")) & F.expr(" and ".join(f"{c} = _{c}" for c in same))
    firsts = rows.where("k1 is not null").join(classes.select(*of, "rep", "many"), on).select("label", "dim", "rep", "many", "v")
    kind, margin = rows.schema["v"].dataType.simpleString(), math.sqrt(max(0.0, 2 - 2 * threshold))
    forests: dict[tuple[str, int], dict[int, dict]] = {}

    def routed(batches):
        for b in common.gathered(batches):
            for (label, dim), own in pd.DataFrame({"label": b.column(0).to_pylist(), "dim": b.column(1).to_pylist()}).groupby(["label", "dim"]).indices.items():
                picked = b.take(pa.array(own))
                x = units(_matrix(picked.column(4)))
                found = cells(x, shared.value.get((label, dim), {}), margin / math.sqrt(dim), seed)
                row, code = np.concatenate([r for _, r in found]), np.repeat(np.array([c for c, _ in found], np.int64), [len(r) for _, r in found])
                order = np.lexsort((code, row))
                row, code = row[order], code[order]
                per = np.bincount(row, minlength=len(x))
                every = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), pa.array(code))
                index = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(picked.column(k).take(index) for k in (0, 1)), pa.array(code), *(picked.column(k).take(index) for k in (2, 3, 4)), every.take(index)],
                                                 ["label", "dim", "code", "rep", "many", "v", "codes"])

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        label, dim, cell, n = (frame[c].iloc[0] for c in ("label", "dim", "code", "n"))
        x = units(np.stack(frame.sort_values("rep")["v"].to_list()))
        nodes, _ = grow(x, int(n), part, margin / math.sqrt(int(dim)), (seed, int(cell)), enough=64)
        order = sorted(nodes)
        return pd.DataFrame({"label": [label], "dim": [dim], "cell": [cell], "node": [order], "k": [[nodes[i][0] for i in order]], "at": [[nodes[i][1] for i in order]]})

    shared, tried = spark.sparkContext.broadcast(forests), set()
    counted = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("code", F.lit(0).cast("long")).where(F.col("n") > part)
    while True:
        # Only cells over ``part``, each split once: one row for at least so many classes.
        large = common.cut(counted, "rp-cells")
        if not large.select(F.lit(1)).take(1):
            break
        dealt = firsts.mapInArrow(routed, f"label string, dim int, code long, rep long, many long, v {kind}, codes array<long>")
        some = dealt.select("label", "dim", "code", "rep", "v").join(large, ["label", "dim", "code"])
        some = some.where(F.pmod(F.xxhash64("rep", F.lit(7)), F.ceil(F.col("n") / sample)) == 0)
        found = some.groupBy("label", "dim", "code").applyInPandas(fit, "label string, dim int, cell long, node array<long>, k array<int>, at array<double>").collect()
        for r in found:
            if r["node"]:
                forests.setdefault((r["label"], r["dim"]), {})[r["cell"]] = dict(zip(r["node"], zip(r["k"], r["at"])))
            tried.add((r["label"], r["dim"], r["cell"]))
        shared = spark.sparkContext.broadcast(forests)
        done = spark.createDataFrame(sorted(tried), "label string, dim int, code long")
        counted = firsts.mapInArrow(routed, f"label string, dim int, code long, rep long, many long, v {kind}, codes array<long>")
        counted = counted.groupBy("label", "dim", "code").agg(F.count("*").alias("n")).where(F.col("n") > part).join(done, ["label", "dim", "code"], "left_anti")

    dealt = firsts.mapInArrow(routed, f"label string, dim int, code long, rep long, many long, v {kind}, codes array<long>")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("code", F.lit(0).cast("long"))
    if forests:
        sizes = dealt.groupBy("label", "dim", "code").agg(F.count("*").alias("n"))
    large = common.cut(sizes.where(F.col("n") > part), "rp-large")
    dealt = dealt.join(large, ["label", "dim", "code"], "left")
    parts = F.when(F.col("n").isNull(), 1).otherwise(F.ceil(F.col("n") / part)).cast("int")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(5)), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("label", "dim", "code", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "rep", "own", "many", "v", "codes")

    def within(batches):
        held = [[], [], []]
        for t in common.runs(batches, 5):
            rep, first = np.unique(t.column("rep").to_numpy(), return_index=True)  # rows that repeat an id and a vector
            if len(rep) < 2:
                continue
            t = t.take(pa.array(first))
            own, many = (t.column(c).to_numpy() for c in ("own", "many"))
            code, dim, low, high = (t.column(c)[0].as_py() for c in ("code", "dim", "low", "high"))
            listed = t.column("codes").combine_chunks()
            listed = listed.chunk(0) if isinstance(listed, pa.ChunkedArray) else listed
            sizes = np.diff(listed.offsets.to_numpy())
            codes = np.full((len(rep), sizes.max()), -1, np.int64)
            codes[np.arange(codes.shape[1]) < sizes[:, None]] = listed.flatten().to_numpy()
            partners, root = compare(units(_matrix(t.column("v"))), many, own, low != high, codes, code, threshold, leaf, trees, margin / math.sqrt(dim), seed)
            linked = (partners > 0) | (root != np.arange(len(rep)))
            for column, values in zip(held, (rep[linked], partners[linked], rep[root[linked]])):
                column.append(values)
            if sum(map(len, held[0])) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in held], ["rep", "partners", "root"])
                held = [[], [], []]
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in held], ["rep", "partners", "root"])

    spread = ["label", "dim", "code", "low", "high"]
    found = dealt.repartition(*spread).sortWithinPartitions(*spread).mapInArrow(within, "rep long, partners long, root long")
    found = common.cut(found, "rp-found")
    component = common.connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), "rp-cc")
    links = found.groupBy("rep").agg(F.sum("partners").alias("partners"))
    told = classes.select(*same, "rep", "many").join(links, "rep", "left").join(component, F.col("rep") == F.col("node"), "left")
    told = told.select(*(F.col(c).alias(f"_{c}") for c in same), (F.coalesce("partners", F.lit(0)) + F.col("many") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    told = common.cut(told, "rp-told")
    out = rows.drop("v").join(told, [F.col(c) == F.col(f"_{c}") for c in same], "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.col("id").eqNullSafe(F.coalesce("component", "id")).alias("kept"))


def op5_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "embeddings"))

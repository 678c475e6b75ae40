"""What the corpus operators share: shared scratch tables, connected components, Arrow streaming helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: White space as the corpus contracts define it.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all tasks
    run in the driver's process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = getattr(spark, "_terrane_dir", None) or tempfile.mkdtemp(prefix="terrane-")
        spark._terrane_dir = at
    return at.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._terrane_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`cut` wrote and that no open plan reads any more."""
    path = getattr(df, "_terrane_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _scratch[:] = [x for x in _scratch if x[1] != path]


def clear() -> None:
    """Delete every table that :func:`cut` wrote in this process."""
    for spark, path in list(_scratch):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; its folder goes with the cluster
            _scratch[:] = [x for x in _scratch if x[1] != path]


atexit.register(clear)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows: a text may be megabytes long, and a batch must fit a Python worker.

    All operators set the same sizes, as frames are run later than they are made.  Workers find this package where the driver
    has it; a cluster without that folder gets it by ``--py-files``.
    """
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (path, ROOT)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def gathered(batches, rows: int = 4096):
    """Batches joined until they have so many rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(u, v) long links → (node, component) for every linked node; component is the smallest node reachable.

    Alternating large-star and small-star steps over DataFrames.  Minima are combined before the shuffle, and hubs meet
    their minimum in a plain equi-join, which adaptive execution splits when one node holds much of the links.
    Rows with a null end and loops are ignored; an empty table gives an empty one.
    """
    e = cut(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        name,
    )
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct(), name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct(), name)
        drop(e)
        drop(large)
        e, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def _mark(e: DataFrame) -> tuple:
    """Order-free fingerprint of a table of links, to see when it no longer changes."""
    return tuple(
        e.agg(
            F.count("*"),
            F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)),
            F.coalesce(F.bit_xor(F.hash("v", "u").cast("long")), F.lit(0)),
        ).first()
    )


class Sets:
    """Disjoint sets of 0..n-1, for one batch at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            a, b = self.find(a), self.find(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def labels(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up


def runs(batches, keys: int):
    """Sorted batches → for each run of equal values in the first ``keys`` columns, its columns as arrays of Arrow.

    Only the rows of one key are held beyond a batch.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for c in b.columns[:keys]:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        first = tuple(c[0].as_py() for c in b.columns[:keys])
        change[0] = last is not None and first != last
        last = tuple(c[b.num_rows - 1].as_py() for c in b.columns[:keys])
        starts = np.flatnonzero(change).tolist()
        begin = 0
        for s in starts:
            if s > begin:
                held.append(b.slice(begin, s - begin))
            yield pa.Table.from_batches(held).combine_chunks()
            held, begin = [], s
        held.append(b.slice(begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def whole_runs(batches, keys: int, rows: int = 4096):
    """Sorted batches → tables of about ``rows`` rows or more that hold whole runs of equal values in the first ``keys``
    columns, and where their runs begin, with the end."""
    held: list[pa.Table] = []
    for b in gathered(batches, rows):
        t = pa.Table.from_batches([b])
        if held:
            ahead = all(held[-1].column(c)[-1].as_py() == t.column(c)[0].as_py() for c in range(keys))
            if ahead and all(t.column(c)[0].as_py() == t.column(c)[-1].as_py() for c in range(keys)):
                held.append(t)
                continue
        held.append(t)
        t = pa.concat_tables(held).combine_chunks()
        bounds = _bounds(t, keys)
        held = [t.slice(bounds[-2])]
        if len(bounds) > 2:
            yield t.slice(0, bounds[-2]).combine_chunks(), bounds[:-1]
    if held:
        t = pa.concat_tables(held).combine_chunks()
        yield t, _bounds(t, keys)


def _bounds(t: pa.Table, keys: int) -> np.ndarray:
    change = np.zeros(t.num_rows, bool)
    change[0] = True
    for c in t.columns[:keys]:
        v = c.to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.r_[np.flatnonzero(change), t.num_rows]


def fixed(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The values of binaries of one chunk or more, in a row."""
    out = []
    for x in column.chunks:
        ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
        out.append(np.frombuffer(x.buffers()[2], np.uint8)[ends[0] : ends[-1]])
    return (out[0] if len(out) == 1 else np.concatenate(out)).view(kind)


def table(batches) -> pa.Table | None:
    batches = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(batches).combine_chunks() if batches else None

"""Exact duplicates by Patricia tries.

Texts are equal when they agree after every run of white space is replaced by one space.  Each input partition inserts its
texts' full bytes into a compressed radix trie; a terminal node holds the smallest identifier and the number of rows, so a text
copied a million times leaves a partition as one row.  When a trie holds more bytes than its budget, its largest subtrees are
spilled into the shuffle as rows of their terminals, to be merged like any others.  The shuffle deals by length and content
hash.  There rows arrive in that order, and texts of one length and the same beginning of their hashes share a trie,
in which their full bytes decide what is equal; as the copies of a text arrive together, the subtrees of a trie that has
grown over its budget are finished and leave it.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from terrane.llm import common

_RUN = re.compile(rb"[\x20\x09-\x0d]+")


def normal(text: bytes | None) -> bytes:
    return _RUN.sub(b" ", text or b"")


class Node:
    __slots__ = ("edge", "children", "terminal")

    def __init__(self, edge: bytes, terminal: list | None = None):
        self.edge, self.children, self.terminal = edge, {}, terminal


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the longest common prefix of ``a`` and ``b[at:]``, by halving."""
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _first(a: list, b: list) -> bool:
    """Whether owner a comes before b: by identifier, null last, then by the text as it was."""
    return (a[0] is None, a[0] or 0, a[2] or b"") < (b[0] is None, b[0] or 0, b[2] or b"")


class Trie:
    """Compressed radix trie from byte strings to owners [identifier, number of rows, text as it was, other columns]."""

    def __init__(self):
        self.root, self.size = Node(b""), {}

    def insert(self, key: bytes, owner: list) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], owner)
                self._grow(key, len(key) - at)
                return
            if key.startswith(child.edge, at):
                node, at = child, at + len(child.edge)
                continue
            n = _shared(child.edge, key, at)
            middle = Node(child.edge[:n])
            child.edge = child.edge[n:]
            middle.children[child.edge[0]] = child
            node.children[key[at]] = node = middle
            at += n
        if node.terminal is None:
            node.terminal = owner
            return
        mine = node.terminal
        n = mine[1] + owner[1]
        if _first(owner, mine):
            mine[:] = owner
        mine[1] = n

    def _grow(self, key: bytes, n: int) -> None:
        self.size[key[0]] = self.size.get(key[0], 0) + n + 200

    def held(self) -> int:
        return sum(self.size.values())

    def spill(self, budget: int):
        """Take the largest subtrees off until what stays is within the budget (below 0: all): yields (key, owner) of
        their terminals."""
        if budget < 0 and self.root.terminal is not None:
            yield b"", self.root.terminal
            self.root.terminal = None
        for first in sorted(self.size, key=self.size.get, reverse=True):
            if self.held() <= budget:
                return
            del self.size[first]
            yield from _walk(self.root.children.pop(first), b"")


def _walk(node: Node, prefix: bytes):
    todo = [(node, prefix)]
    while todo:
        node, prefix = todo.pop()
        key = prefix + node.edge
        if node.terminal is not None:
            yield key, node.terminal
        todo += [(c, key) for c in node.children.values()]


def _row_schema(rest: T.StructType) -> T.StructType:
    s = T.StructType([T.StructField("len", T.LongType()), T.StructField("sha", T.BinaryType()), T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("text", T.BinaryType())])
    return s.add("rest", rest) if rest.fields else s


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_rows: bool = False, budget: int = 64 << 20) -> DataFrame:
    """One row for each distinct text: len, sha (SHA-256 of the normalised text), id (smallest), n (rows), and, if
    ``with_rows``, text and rest: the owner's text as it was and its other columns.

    A null text counts as empty.  A null identifier comes after all others.  Of rows that repeat an identifier and a text
    one is the owner.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    others = [c for c in docs.columns if with_rows and c not in (id_col, text_col)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest")] if others else []))
    rest = rows.schema["rest"].dataType if others else T.StructType()
    schema = _row_schema(rest)
    arrow = to_arrow_schema(schema)

    def batches_of(found):
        held, size = [], 0
        for sha, length, o in found:
            held.append((length, sha, o[0], o[1], o[2], *o[3:]))
            size += len(o[2] or b"") + 100
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    def parts(key, owner):
        return hashlib.sha256(key).digest(), len(key), owner

    def combine(batches):
        trie = Trie()

        def found():
            for b in batches:
                extra = b.column(2).to_pylist() if others else None
                for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                    trie.insert(normal(t), [i, 1, t, extra[k]] if others else [i, 1, t])
                if trie.held() > budget:
                    yield from (parts(*x) for x in trie.spill(budget // 2))
            yield from (parts(*x) for x in trie.spill(-1))

        yield from batches_of(found())

    def merge(batches):
        def found():
            now, trie = None, Trie()
            for b in batches:
                cols = [c.to_pylist() for c in b.columns]
                for length, sha, i, n, t, *extra in zip(*cols):
                    if now != (length, sha):  # all copies of what the trie holds have come
                        if now is None or now[0] != length or now[1][:1] != sha[:1]:
                            yield from (parts(*x) for x in trie.spill(-1))
                        elif trie.held() > budget:
                            yield from (parts(*x) for x in trie.spill(budget // 2))
                        now = (length, sha)
                    trie.insert(normal(t), [i, n, t, *extra])
            yield from (parts(*x) for x in trie.spill(-1))

        if with_rows:
            yield from batches_of(found())
        else:
            yield from batches_of((s, k, [*o[:2], None]) for s, k, o in found())

    once = rows.mapInArrow(combine, schema).repartition("len", "sha").sortWithinPartitions("len", "sha")
    out = once.mapInArrow(merge, schema)
    return out if with_rows else out.drop("text")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty.  A row with a null doc_id is kept only where its whole group has none (keep_id is null
    then).  Rows that repeat the kept doc_id are all marked kept; :func:`distinct_documents` leaves one of them.  Other
    columns are not read, whatever their names.  An empty table gives an empty one.
    """
    copied = owners(docs, id_col, text_col).where("n > 1").select(F.col("len").alias("_len"), F.lower(F.hex("sha")).alias("_sha"), F.col("id").alias("_id"), "n")
    text = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), common.SPACE, " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    rows = rows.select("doc_id", F.sha2("_text", 256).alias("text_sha256"), F.octet_length("_text").cast("long").alias("_size"))
    out = rows.join(copied, (F.col("text_sha256") == F.col("_sha")) & (F.col("_size") == F.col("_len")), "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each distinct text: the one with the smallest doc_id, with its text as it was."""
    o = owners(docs, id_col, text_col, with_rows=True)
    column = lambda c: F.col("id").cast(docs.schema[c].dataType) if c == id_col else F.col("text").cast("string") if c == text_col else F.col(f"rest.`{c}`")
    return o.select(*(column(c).alias(c) for c in docs.columns))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(common.read(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return distinct_documents(docs)

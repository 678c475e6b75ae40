"""Best-fit packing through the configuration linear program.

Documents are cut into pieces of at most ``capacity`` tokens.  Only the histogram of piece lengths (at most ``capacity``
numbers, whatever the corpus) comes to the driver.  There the configuration LP — how many sequences of each multiset of
lengths cover the histogram — is solved by multiplicative weights: a dynamic program over the knapsack prices lengths and
gives the configurations of nearly the best value, which are bought a little at a time while the weights of covered lengths
fall, until every length is covered.  Full configurations are then rounded to whole sequences, and the LP is solved again for
the pieces that are left, until rounding places few of them; those end in configurations that are not full, or best-fit.

The result is a table of runs (the pieces of length L with ranks r..r+n go to sequences s, s+1, ..), whose size follows
the number of lengths and not of pieces.  Pieces get their rank among those of the same length from counts of hashed buckets,
so that a length which a third of all pieces share is dealt over many tasks.
"""

from __future__ import annotations

import math
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm import common

TOKENIZER = "word_bpe_49k.json"


class Encoder:
    """Texts → bytes of little-endian unsigned 32-bit ids, for tokenizers that drop white space and mark word ends.

    Such a tokenizer never joins text across white space, nor letters with what is no letter; so a text's ids are those of its
    words, most of which come again and are remembered.  New words of small Latin letters, which neither the normalizer nor
    the splitting changes, go to the model at once; other words of letters are encoded many at a time and told apart by their
    last tokens, which carry the mark; anything else goes to the tokenizer on its own.
    """

    PUNCTUATION = frozenset(".,;:!?")
    MARK = "</w>"

    def __init__(self, path: str, room: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.room = Tokenizer.from_file(path), {}, room
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(self.MARK)]] = True
        small = [c for c in map(chr, range(256)) if c.isalpha() and c == c.lower() and self.tokenizer.normalizer.normalize_str(c) == c]
        self.letters = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in small}

    def direct(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Remember the ids of words of letters."""
        letters, tokenize, rest = self.letters, self.tokenizer.model.tokenize, []
        for w in words:
            try:
                self.known[w] = array("I", [t.id for t in tokenize("".join([letters[c] for c in w]))]).tobytes()
            except KeyError:
                rest.append(w)
        words = rest
        for k in range(0, len(words), 256):
            part = words[k : k + 256]
            ids = np.asarray(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):  # a letter whose lower case is more than letters
                self.known.update((w, self.direct(w)) for w in part)
                continue
            raw, starts = ids.tobytes(), [0, *stops[:-1].tolist()]
            self.known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(part, starts, stops.tolist()))

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each of these words, which are all different."""
        if len(self.known) > self.room:  # the first words that came are mostly the frequent ones
            self.known = dict(list(self.known.items())[: self.room // 3])
        known = self.known
        out = list(map(known.get, words))
        new = [w for w, v in zip(words, out) if v is None]
        stems = {w: w[:-1] for w in new if w[-1:] in self.PUNCTUATION and w[:-1].isalpha()}
        letters = {w for w in new if w.isalpha()}
        letters.update(w for w in stems.values() if w not in known)
        self.learn([w for w in letters if len(w) <= 64])
        marks = {p: self.direct(p) for p in {w[-1] for w in stems}}
        found = {w: (known.get(s) or self.direct(s)) + marks[w[-1]] for w, s in stems.items()}
        for w in new:
            if w not in found and w not in known:
                found[w] = self.direct(w)
                if len(w) <= 64:
                    known[w] = found[w]
        return [v if v is not None else found[w] if w in found else known[w] for w, v in zip(words, out)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Arrow splits and numbers the words of all texts; each different word is looked up once, and numpy lays the ids out."""
        direct, plain = {}, []
        for i, text in enumerate(texts):
            # splitting takes these four for white space, which they are not to the tokenizer
            if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
                direct[i] = self.direct(text)
                text = ""
            else:
                try:
                    text.encode("latin-1")
                    text = text.lower()  # here Python's lower case is the tokenizer's, so fewer words differ
                except UnicodeEncodeError:
                    pass
            plain.append(text)
        split = pc.utf8_split_whitespace(pa.array(plain, pa.string()))
        coded = split.flatten().dictionary_encode()
        each = self.ids(coded.dictionary.to_pylist())
        code = coded.indices.to_numpy()
        flat = np.frombuffer(b"".join(each), "<u4")
        length = np.fromiter(map(len, each), np.int64, len(each)) // 4
        first = np.cumsum(length) - length
        n = length[code]
        stop = np.cumsum(n)
        ids = flat[np.repeat(first[code] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)].tobytes()
        bounds = np.r_[0, stop][split.offsets.to_numpy()].tolist()
        return [direct[i] if i in direct else ids[4 * a : 4 * b] for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and ``end``, cut into pieces only where they are longer.

    A null text counts as empty and gives one piece that holds ``end`` alone.  ``tokenizer`` is a path, or a name that
    public_tokenizers resolves on the executor.
    """
    common.small_batches(docs.sparkSession)

    def run(batches):
        import public_tokenizers

        encoder = _encoder(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))
        tail = int(end).to_bytes(4, "little")
        for b in batches:
            rows = [[], [], [], [], []]
            for i, ids in zip(b.column(0).to_pylist(), encoder.encode([t or "" for t in b.column(1).to_pylist()])):
                ids += tail
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    for column, v in zip(rows, (i, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for every capacity, and the length to take first there, or -1; ``lengths`` ascend, of equal values the longest."""
    least, most = int(lengths[0]), int(lengths[-1])
    dense = np.full(capacity + 1, -1.0)
    dense[lengths] = price
    best, first = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(least, capacity + 1):
        n = min(c, most)
        value = best[c - n : c - least + 1] + dense[least : n + 1][::-1]  # from the longest
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], first[c] = value[k], n - k
        else:
            best[c] = best[c - 1]
    return best, first


def solve(histogram: dict[int, int], capacity: int, rate: float = 2.0, slack: float = 0.002, power: float = 1.1) -> tuple[dict[tuple, float], float]:
    """Configurations (lengths, longest first) → how often the LP takes each, by multiplicative weights, until every length
    is covered; and a lower bound on the number of sequences.

    Lengths start at the price of their size to the ``power``, since long ones are harder to place.  Each round prices them by
    the knapsack and buys every configuration within ``slack`` of the best, a quarter of what is left of its scarcest
    length; a length's price falls by exp(-rate x share of it that is covered).  A round that covers little widens the slack.
    The bound is the best value of a dual solution (prices over the price of the dearest configuration) among the rounds.
    """
    lengths = np.array(sorted(k for k in histogram if 0 < k < capacity), np.int64)
    if not len(lengths):
        return {}, 0.0
    need = np.array([histogram[k] for k in lengths.tolist()], float)
    place = np.full(capacity + 1, -1)
    place[lengths] = np.arange(len(lengths))
    covered, taken, bound = np.zeros(len(lengths)), {}, float(need @ lengths) / capacity
    while len(index := np.flatnonzero(covered < need - 1e-9)):
        short = lengths[index]
        price = (short / capacity) ** power * np.exp(-rate * covered[index] / need[index])
        best, first = knapsack(short, price, capacity)
        bound = max(bound, float(need[index] @ price) / best[capacity])
        value, before = price + best[capacity - short], covered.sum()
        for k in np.argsort(-value, kind="stable").tolist():
            if value[k] < (1 - slack) * best[capacity]:
                break
            config, left = [int(short[k])], capacity - int(short[k])
            while left > 0:
                if first[left] < 0:
                    left -= 1
                    continue
                config.append(int(first[left]))
                left -= int(first[left])
            own, times = np.unique(place[config], return_counts=True)
            step = float(((need[own] - covered[own]) / times).min())
            if step <= 0:
                continue
            step = max(min(step, 1.0), step / 4)
            covered[own] += step * times
            key = tuple(sorted(config, reverse=True))
            taken[key] = taken.get(key, 0.0) + step
        if covered.sum() - before < 0.04 * (need.sum() - before):
            slack = min(1.0, 1.5 * slack)
    return taken, bound


class Plan:
    """Whole sequences that hold every piece of a histogram exactly once.

    ``sequences``: (lengths, how many).  ``bound``: no packing has fewer sequences.  ``by_lp``: how many of the sequences are
    rounded configurations of the LP (with those of one whole piece); the rest completes what rounding left.
    """

    def __init__(self, histogram: dict[int, int], capacity: int, least: float = 0.15):
        self.sequences: list[tuple[tuple, int]] = []
        left = {k: n for k, n in histogram.items() if n}
        whole = left.pop(capacity, 0)
        if whole:
            self.sequences.append(((capacity,), whole))
        bound = None
        while left:
            taken, low = solve(left, capacity)
            bound = low if bound is None else bound
            done, before = self._take(left, taken, capacity, full=True), sum(left.values())
            if done > least * (done + before):
                continue  # what is left is a problem of its own
            # Completion: the LP's configurations that are not full, or none of them, and then best fit decreasing.
            ways = []
            for partly in (True, False):
                mine, rest = [], dict(left)
                if partly:
                    self._take(rest, taken, capacity, full=False, into=mine)
                ways.append((mine, best_fit(rest, capacity)))
            mine, rest = min(ways, key=lambda w: sum(n for part in w for _, n in part))
            self.sequences += mine
            self.by_lp = sum(n for _, n in self.sequences)
            self.sequences += rest
            left = {}
        if not hasattr(self, "by_lp"):
            self.by_lp = sum(n for _, n in self.sequences)
        self.count = sum(n for _, n in self.sequences)
        self.bound = whole + math.ceil((bound or 0.0) - 1e-6)

    def _take(self, left: dict[int, int], taken: dict[tuple, float], capacity: int, full: bool, into: list | None = None) -> int:
        """Round configurations to whole sequences as far as there are pieces for them: full ones up, others down."""
        into, done = self.sequences if into is None else into, 0
        for config, x in sorted(taken.items(), key=lambda c: (-sum(c[0]), -c[1], c[0])):
            if (sum(config) == capacity) != full:
                continue
            times = {k: config.count(k) for k in set(config)}
            n = min(math.ceil(x) if full else math.floor(x), *(left.get(k, 0) // t for k, t in times.items()))
            if n > 0:
                into.append((config, n))
                done += n * len(config)
                for k, t in times.items():
                    left[k] -= n * t
                    if not left[k]:
                        del left[k]
        return done


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Best-fit decreasing over runs of equal pieces and of equal bins."""
    bins: dict[int, list[list]] = {}  # room left → [lengths, how many]
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        for room in sorted(k for k in bins if k >= length):
            while n and bins.get(room):
                config, many = bins[room].pop()
                each = min(room // length, n)
                use = min(many, n // each)
                if many > use:
                    bins[room].append([config, many - use])
                bins.setdefault(room - each * length, []).append([config + (length,) * each, use])
                n -= use * each
        while n:
            each = min(capacity // length, n)
            use = n // each
            bins.setdefault(capacity - each * length, []).append([(length,) * each, use])
            n -= use * each
    return [(config, many) for runs in bins.values() for config, many in runs]


def runs(sequences: list[tuple[tuple, int]]) -> dict[int, np.ndarray]:
    """length → rows (first rank, first sequence, pieces in a sequence, first offset), by rank."""
    out, seen, first = {}, {}, 0
    for config, many in sequences:
        offset = 0
        for length in sorted(set(config), reverse=True):
            times = config.count(length)
            out.setdefault(length, []).append((seen.get(length, 0), first, times, offset))
            seen[length] = seen.get(length, 0) + times * many
            offset += times * length
        first += many
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pieces with sequence_id and offset.  ``cut`` must be a stored table: it is read three times.

    Pieces that tie (repeated rows too) are all packed, in any order among themselves; no piece gives no sequence.
    """
    spark = cut.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not histogram:
        return cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    place = spark.sparkContext.broadcast(runs(Plan(histogram, capacity).sequences))
    buckets = min(4096, -(-max(histogram.values()) // 200))
    dealt = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    order = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_nth", F.row_number().over(order)).join(counts, ["length", "_b"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_from") + F.col("_nth") - 1).alias("_rank"))

    def assign(batches):
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length).tolist():
                own = np.flatnonzero(length == k)
                table = place.value[k]
                row = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
                nth = rank[own] - row[:, 0]
                sequence[own] = row[:, 1] + nth // row[:, 2]
                offset[own] = row[:, 3] + nth % row[:, 2] * k
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = 2048) -> DataFrame:
    """One row per piece of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null doc_ids stay null; other columns of ``docs`` are not read.  An empty table gives an empty one.
    """
    return pack(common.cut(pieces(docs, tokenizer, capacity), "pieces"), capacity)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(common.read(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; the last stage, so it returns no documents."""
    return packed(docs)

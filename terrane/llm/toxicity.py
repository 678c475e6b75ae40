"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over the characters of words, one of toxic and one of ordinary documents, share their
lower orders: below the highest order both back off to continuation counts over all documents, labelled or not, so an
expression that was too rare to tell the classes apart has the same probability in both.  A word's log-likelihood ratio is remembered; a
document is judged by the difference of the two log-likelihoods per word, over the whole text and over its most telling
words (a few words in a long text would be lost in the mean), and a logistic calibration turns that into a score.

The highest order and the calibration are fitted on a bounded sample of labelled rows (``max_docs`` of each class, those of the
smallest hashes); the shared lower orders grow with the corpus: every different n-gram of every whole text counts, and what
follows a context of the sample comes to the driver.  Scoring reads every whole text.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import common

WORDS = re.compile(r"\w+")
ORDER = 6
STRONG = 3.0
TOP = 3
LONGEST = 40  # longer words are scored like any other, but not remembered


def grams(word: str, order: int = ORDER):
    """The n-grams of the highest order of a word between its bounds."""
    padded = "^" * (order - 1) + word + "$"
    return [padded[i : i + order] for i in range(len(word) + 1)]


def continuations(types) -> dict[str, int]:
    """n-grams of one order → for every shorter one: how many different characters stand before it."""
    out, level = {}, set(types)
    while level and len(next(iter(level))) > 1:
        out.update(Counter(g[1:] for g in level))
        level = {g[1:] for g in level}
    return out


def fit(counts: dict[str, tuple[int, int]], shared_counts: dict[str, int] | None = None, discount: float = 0.75) -> tuple[dict[str, float], dict[str, float]]:
    """n-gram → (times in ordinary, times in toxic texts) → log-likelihood ratios of n-grams, and of contexts whose next
    character neither class has seen there.

    ``shared_counts``: :func:`continuations` of the corpus, at least of what follows the contexts of these n-grams (without
    it, of these n-grams alone).  With P_c(x | h) = max(n_c(hx) - D, 0) / n_c(h) + b_c(h) P(x | shorter h), what both share
    cancels wherever neither has seen hx, and only the ratio of the backoff weights b stays.
    """
    order = len(next(iter(counts))) if counts else ORDER
    total, kinds = [Counter(), Counter()], [Counter(), Counter()]
    for g, n in counts.items():
        for c in (0, 1):
            if n[c]:
                total[c][g[:-1]] += n[c]
                kinds[c][g[:-1]] += 1
    low_counts = continuations(counts) if shared_counts is None else shared_counts
    levels: list[dict[str, int]] = [{} for _ in range(order)]
    for g, n in low_counts.items():
        levels[len(g)][g] = n
    letters = max(1, len(levels[1])) if order > 1 else 1
    shared: list[dict[str, float]] = [{}]
    for continuation in levels[1:]:
        sums, seen = defaultdict(int), defaultdict(int)
        for g, n in continuation.items():
            sums[g[:-1]] += n
            seen[g[:-1]] += 1
        lower, here = shared[-1], {}
        for g, n in continuation.items():
            h = g[:-1]
            here[g] = max(n - discount, 0) / sums[h] + discount * seen[h] / sums[h] * lower.get(g[1:], 1 / letters)
        shared.append(here)
    backoff = [{h: discount * kinds[c][h] / n for h, n in total[c].items()} for c in (0, 1)]
    ratio = {}
    for g, n in counts.items():
        h, low = g[:-1], shared[-1][g[1:]]
        p = [(max(n[c] - discount, 0) / total[c][h] if n[c] else 0) + backoff[c].get(h, 1.0) * low for c in (0, 1)]
        ratio[g] = math.log(p[1] / p[0])
    rest = {h: math.log(backoff[1].get(h, 1.0) / backoff[0].get(h, 1.0)) for h in backoff[0].keys() | backoff[1].keys()}
    return ratio, rest


class Scorer:
    """Log-likelihood ratios of words and the features of a text."""

    def __init__(self, ratio: dict[str, float], rest: dict[str, float], weights=None, room: int = 200_000):
        self.ratio, self.rest, self.weights, self.room, self.known = ratio, rest, weights, room, {}

    def __reduce__(self):
        return Scorer, (self.ratio, self.rest, self.weights, self.room)

    def word(self, w: str) -> float:
        value = self.known.get(w)
        if value is None:
            ratio, rest, order = self.ratio, self.rest, ORDER
            value = 0.0
            for g in grams(w, order):
                r = ratio.get(g)
                value += rest.get(g[:-1], 0.0) if r is None else r
            if len(w) <= LONGEST:
                if len(self.known) >= self.room:
                    self.known.clear()
                self.known[w] = value
        return value

    def features(self, text: str) -> tuple[float, ...]:
        """Mean ratio a word, mean of the highest TOP, share and (log) number of words whose ratio is over STRONG."""
        values = list(map(self.word, WORDS.findall(text.lower())))
        if not values:
            return 0.0, 0.0, 0.0, 0.0
        top = heapq.nlargest(TOP, values)
        strong = sum(1 for v in values if v > STRONG)
        return sum(values) / len(values), sum(top) / TOP, strong / len(values), math.log1p(strong)

    def score(self, text: str) -> float:
        z = self.weights[0] + float(np.dot(self.weights[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> list[float]:
    """Logistic regression by Newton's method, both classes weighing the same; intercept first."""
    if not len(x):
        return [-3.0] + [0.0] * 4
    x = np.c_[np.ones(len(x)), x]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w, penalty = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _corpus_counts(docs: DataFrame, sample: DataFrame, order: int = ORDER, room: int = 100_000) -> dict[str, int]:
    """:func:`continuations` of all texts of ``docs``, of what follows the contexts of the n-grams in column g of ``sample``.

    Tasks forget the n-grams that they have told of when there are more than ``room``; Spark tells them apart in the end.
    """

    def told(batches):
        seen: set[str] = set()
        known: set[str] = set()
        for b in batches:
            words = set()
            for t in b.column(0).to_pylist():
                words.update(WORDS.findall(t.lower()))
            words -= known
            known.update(w for w in words if len(w) <= LONGEST)
            new = {g for w in words for g in grams(w, order)} - seen
            seen |= new
            if len(seen) > room or len(known) > room:
                seen, known = set(), set()
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.string())], ["g"])

    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    types = texts.mapInArrow(told, "g string").distinct()
    tails = types.select(F.explode(F.array(*(F.expr(f"right(g, {k})") for k in range(2, order + 1)))).alias("g")).distinct()
    counts = tails.groupBy(F.expr("substring(g, 2)").alias("s")).agg(F.count("*").alias("n"))
    context = F.expr("substring(g, 1, length(g) - 1)")
    needed = sample.select(F.explode(F.array(*(F.expr(f"right(g, {k})") for k in range(1, order)))).alias("g")).select(context.alias("h")).distinct()
    found = counts.join(needed, F.expr("substring(s, 1, length(s) - 1)") == F.col("h"), "left_semi").toArrow().to_pydict()
    return dict(zip(found["s"], found["n"]))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 2500, near: float = 0.02) -> Scorer:
    """Fit on at most ``max_docs`` labelled rows of each class outside the held-out third (a documented bound), and on the
    n-grams of all documents below the highest order.

    Three quarters of the rows give the counts, one quarter the calibration.  Repeated labels of a document count once, the
    higher one; rows with a null doc_id or label are left out.  Without toxic or without ordinary rows every score is low.
    Log-likelihood ratios within ``near`` of none are taken for none, which keeps them out of every task's memory.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = known.where(~_held_out(F.col("doc_id"))).withColumn("_h", F.xxhash64("doc_id", F.lit(3)))
    sample = None
    for c in (0, 1):
        one = known.where(F.col("y") == c).orderBy("_h", "doc_id").limit(max_docs)
        sample = one if sample is None else sample.union(one)
    sample = common.cut(sample.select("doc_id", "y", (F.pmod("_h", F.lit(4)) == 0).alias("late")), "tox-sample")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = common.cut(docs.select("doc_id", text).join(F.broadcast(sample), "doc_id").select("doc_id", "y", "late", "text"), "tox-train")

    def count(batches):
        found = [Counter(), Counter()]
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found[y].update(WORDS.findall(t.lower()))
        sums: dict[str, list[int]] = {}
        for c in (0, 1):
            for w, n in found[c].items():
                for g in grams(w):
                    sums.setdefault(g, [0, 0])[c] += n
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())], ["g", "ordinary", "toxic"])

    grammed = rows.where("not late").select("y", "text").mapInArrow(count, "g string, ordinary long, toxic long")
    grammed = common.cut(grammed.groupBy("g").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "tox-grams")
    found = grammed.toArrow().to_pydict()
    ratio, rest = fit(dict(zip(found["g"], zip(found["ordinary"], found["toxic"]))), _corpus_counts(docs, grammed))
    common.drop(grammed)
    scorer = Scorer({g: r for g, r in ratio.items() if abs(r) > near or abs(rest.get(g[:-1], 0)) > near}, {h: r for h, r in rest.items() if abs(r) > near})
    shared = spark.sparkContext.broadcast(scorer)

    def describe(batches):
        for b in batches:
            x = [shared.value.features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([v[k] for v in x], pa.float64()) for k in range(4))], ["y", "a", "b", "c", "d"])

    late = rows.where("late").select("y", "text").mapInArrow(describe, "y int, a double, b double, c double, d double").orderBy("a", "b", "c", "d", "y").toArrow()
    data = np.array([late.column(k).to_pylist() for k in range(5)], float).reshape(5, -1)
    enough = len(set(data[0].tolist())) == 2
    scorer.weights = calibrate(data[1:].T, data[0]) if enough else [-3.0] + [0.0] * 4
    common.drop(sample)
    common.drop(rows)
    return scorer


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.7) -> DataFrame:
    """``docs`` with score and predicted.  A null or empty text has the score of no words at all."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for b in batches:
            s = [shared.value.score(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = 2500, threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Only doc_id and text of ``docs`` are read.  Null texts count as empty; a null doc_id is never held out and never trains.
    Repeated rows come out repeated; an empty table gives an empty one.
    """
    out = score(docs, train(docs, labels, max_docs), threshold)
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; all rows of the others stay, with all their columns."""
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(train(docs, common.read(spark, sf_dir, "labels")))
    at = docs.columns.index("text")

    def keep(batches):
        for b in batches:
            clean = [shared.value.score(t or "") < 0.7 for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

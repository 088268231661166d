"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with a block-max inverted index.

Features are words and word beginnings that labelled toxic texts have far more often than others, with confidence,
chosen on the training rows. All other words of a text are one dimension together, as long as their own TF vector
is, so that a text's likeness to an example depends on how much of it the features are. Examples with equal vectors
are one example with their share of label 1. The index keeps postings by feature in blocks of examples with each
block's greatest weight: blocks are scored in order of their bound until no bound reaches the k-th best, so the
neighbours are exact. Their votes are weighed by distance and calibrated by a logistic curve fitted leave-one-out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import crc_mod, keep_only, texts, tune

#: The classifier is fitted on so many labelled training rows at most (drawn by id hash).
MAX_LABELLED = 20_000
MAX_FEATURES, NEIGHBOURS, BLOCK = 4000, 12, 256
STARTS = (3, 4, 5, 6, 7, 8)
MARKS = ".,;:!?\"'()[]{}#*$%&|<>-_`~=+/\\"
THRESHOLD = 0.7
#: A feature is taken if toxic rows have it so many times as often, with confidence.
LEAST_LIFT = 3.0
#: In two toxic rows at least.
LEAST_ROWS = 2
#: The weight of a word that is no feature. The square of their vector's length is rounded to powers of the root of 2.
OTHER = 0.5
#: More votes never lower a score.
LEAST_SLOPE = 0.05


def features_of(word: str) -> list[str]:
    bare = word.strip(MARKS)
    return [bare, *(f"^{bare[:n]}" for n in STARTS if len(bare) >= n)] if bare else []


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, pos, neg): documents of a task's batch with the feature, by label."""
    schema = pa.schema([("feature", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])
    for b in it:
        pos: Counter = Counter()
        neg: Counter = Counter()
        for raw, label in zip(texts(b), b.column(b.schema.get_field_index("toxic")).to_pylist(), strict=True):
            (pos if label else neg).update({f for w in set(raw.decode().lower().split()) for f in features_of(w)})
        keys = list(pos.keys() | neg.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], schema=schema)


class Vectors:
    """Texts as sparse vectors over the chosen features."""

    def __init__(self, chosen: list[tuple[str, float]]) -> None:
        self.index = {f: i for i, (f, _) in enumerate(chosen)}
        self.idf = [w for _, w in chosen]
        self.other = len(chosen)
        self.known: dict[str, tuple[int, ...]] = {}

    def counts(self, raw: bytes) -> tuple[tuple[int, int], ...]:
        """(feature, times) in order; last the other words, as the rounded logarithm of their vector's length."""
        got: Counter = Counter()
        known, others = self.known, 0.0
        for word, n in Counter(raw.decode().lower().split()).items():
            hit = known.get(word)
            if hit is None:
                if len(known) > 60_000:
                    known.clear()
                hit = known[word] = tuple(self.index[f] for f in features_of(word) if f in self.index)
            for f in hit:
                got[f] += n
            if not hit:
                others += (1 + math.log(n)) ** 2 if n > 1 else 1.0
        return (*sorted(got.items()), (self.other, round(2 * math.log2(others + 1))))

    def vector(self, counts: tuple[tuple[int, int], ...]) -> list[tuple[int, float]]:
        v = [(f, (1 + math.log(n)) * self.idf[f]) for f, n in counts[:-1]] + [(self.other, OTHER * 2 ** (counts[-1][1] / 4))]
        norm = math.sqrt(sum(w * w for _, w in v))
        return [(f, w / norm) for f, w in v]


class BlockMax:
    """Examples (counts, share of label 1, number, an id) as an inverted index."""

    def __init__(self, vectors: Vectors, examples: list[tuple[tuple, int, int, int]]) -> None:
        self.vectors = vectors
        self.pos = np.array([e[1] for e in examples], float)
        self.n = np.array([e[2] for e in examples], float)
        self.ids = [e[3] for e in examples]
        self.blocks = -(-len(examples) // BLOCK)
        lists: dict[int, tuple[list[int], list[float]]] = {}
        for i, e in enumerate(examples):
            for f, w in vectors.vector(e[0]):
                at = lists.setdefault(f, ([], []))
                at[0].append(i)
                at[1].append(w)
        self.post, self.most = {}, {}
        for f, (at, w) in lists.items():
            ids, weights = np.array(at), np.array(w)
            cut = np.searchsorted(ids, np.arange(self.blocks + 1) * BLOCK)
            top = np.zeros(self.blocks)
            np.maximum.at(top, ids // BLOCK, weights)
            self.post[f], self.most[f] = (ids, weights, cut), top

    def nearest(self, counts: tuple[tuple[int, int], ...], k: int = NEIGHBOURS, without: int = -1) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest, ties by example; `without` is left out."""
        q = [(f, w) for f, w in self.vectors.vector(counts) if f in self.post]
        bound = sum((w * self.most[f] for f, w in q), np.zeros(self.blocks))
        best, ids_of = np.empty(0), np.empty(0, np.int64)
        for b in np.argsort(-bound, kind="stable").tolist():
            full = len(best) == k
            if full and bound[b] < best[-1] - 1e-12:
                break
            low, score = b * BLOCK, np.zeros(BLOCK)
            for f, w in q:
                ids, weights, cut = self.post[f]
                x, y = cut[b], cut[b + 1]
                if y > x:
                    score[ids[x:y] - low] += w * weights[x:y]
            score = score.round(12)
            if low <= without < low + BLOCK:
                score[without - low] = 0.0
            at = np.flatnonzero(score >= best[-1] if full else score > 0)
            if len(at):
                s, i = np.concatenate([best, score[at]]), np.concatenate([ids_of, low + at])
                first = np.lexsort((i, -s))[:k]
                best, ids_of = s[first], i[first]
        return list(zip(best.tolist(), ids_of.tolist(), strict=True))

    def votes(self, near: list[tuple[float, int]], own: tuple[int, int] | None = None) -> float:
        """Share of label 1 among the neighbours, weighed by distance. own: an example and its label, of which one vote is left out."""
        total = up = 0.0
        for cos, i in near:
            pos, n = self.pos[i], self.n[i]
            if own and own[0] == i:
                pos, n = pos - own[1], n - 1
            w = 1.0 / (max(0.0, 1.0 - cos) + 0.05) ** 2
            up += w * (pos + 0.02) / (n + 0.04)
            total += w
        return up / total if total else 0.0


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a little shrinkage."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + 0.01 * (a - 1), (weight * (p - y)).sum() + 0.01 * b])
        s = weight * p * (1 - p)
        h = np.array([[(s * x * x).sum() + 0.01, (s * x).sum()], [(s * x).sum(), s.sum() + 0.01]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    if a < LEAST_SLOPE:
        # Votes that tell nothing: what remains is the share of label 1.
        a, b = LEAST_SLOPE, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            b -= ((weight * (p - y)).sum() + 0.01 * b) / ((weight * p * (1 - p)).sum() + 0.01)
    return float(a), float(b)


def logit(v: np.ndarray | float) -> np.ndarray | float:
    v = np.clip(v, 1e-4, 1 - 1e-4)
    return np.log(v / (1 - v))


class Model:
    def __init__(self, index: BlockMax | None, slope: float, offset: float) -> None:
        self.index, self.slope, self.offset = index, slope, offset
        self.known: dict[tuple, tuple[float, list[int]]] = {}

    def score(self, raw: bytes) -> tuple[float, list[int]]:
        """Calibrated score and the ids of the examples that it rests on."""
        if self.index is None:
            return 0.0, []
        counts = self.index.vectors.counts(raw)
        if counts not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            near = self.index.nearest(counts)
            v = self.slope * logit(self.index.votes(near)) + self.offset
            self.known[counts] = float(1 / (1 + math.exp(-max(-30.0, min(30.0, v))))), [self.index.ids[i] for _, i in near]
        return self.known[counts]


def fitted(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from labelled rows outside the held-out fold. Without label 1 or without label 0 every score is 0."""
    spark = docs.sparkSession
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1)).groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = own.count()
    if n > max_labelled:
        # A little less than the bound, as hashes spread by chance.
        own = own.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int((1 << 30) * 0.95 * max_labelled / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "toxic")
    totals = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return Model(None, 1.0, 0.0)
    counted = rows.mapInArrow(_count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rate = lambda c, n: (F.col(c) + 0.5) / (n + 1.0)
    lift = F.log(rate("pos", pos)) - F.log(rate("neg", neg))
    # The lift less two standard errors: rare features that favour one label by chance stay out.
    sure = lift - 2 * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    strong = counted.where((F.col("pos") >= LEAST_ROWS) & (sure >= math.log(LEAST_LIFT)))
    top = strong.withColumn("worth", lift * F.sqrt("pos")).orderBy(F.desc("worth"), "feature").limit(MAX_FEATURES).collect()
    vectors = Vectors([(r.feature, math.log((pos + neg + 1) / (r.pos + r.neg + 1)) + 1) for r in top])
    sent = spark.sparkContext.broadcast(vectors)

    def vectorised(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [sent.value.counts(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([[x for x, _ in c] for c in got], pa.list_(pa.int32())), pa.array([[n for _, n in c] for c in got], pa.list_(pa.int32()))], names=["doc_id", "toxic", "f", "n"])

    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic").mapInArrow(vectorised, "doc_id long, toxic int, f array<int>, n array<int>")
    # As many rows as max_labelled at most, of a few features each.
    equal = rows.groupBy("f", "n").agg(F.sum("toxic").alias("pos"), F.count("*").alias("rows"), F.min("doc_id").alias("doc_id")).orderBy("doc_id", "f").collect()
    examples = [(tuple(zip(r.f, r.n, strict=True)), r.pos, r.rows, r.doc_id) for r in equal]
    # Examples of which features are as large a part are neighbours: so blocks differ in what they reach at most.
    examples.sort(key=lambda e: -vectors.vector(e[0])[-1][1])
    index = BlockMax(vectors, examples)
    x, y, weight = [], [], []
    for i, (counts, up, n, _) in enumerate(examples):
        for label, times in ((1, up), (0, n - up)):
            if times:
                near = index.nearest(counts, without=i if n == 1 else -1)
                x.append(float(logit(index.votes(near, (i, label)))))
                y.append(label)
                weight.append(times)
    return Model(index, *logistic(np.array(x), np.array(y, float), np.array(weight, float)))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids of the examples nearest) of each row.

    Only the text is an input of a score: equal texts have equal scores. Null texts are empty, and score as texts
    without any feature do. Repeated rows have a result each; null ids stay null and aren't held out by id text
    but by the empty one; an empty table gives no rows; other columns are not read.
    """
    tune(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, max_labelled))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("toxicity", int)
        for b in it:
            got = [model.value.score(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= threshold) for s, _ in got], pa.int32()), pa.array([e for _, e in got], pa.list_(pa.int64()))], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs less the rows whose score reaches the threshold; columns unchanged."""
    tune(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("toxicity", int)
        for b in it:
            yield b.filter(pa.array([model.value.score(t)[0] < threshold for t in texts(b)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)

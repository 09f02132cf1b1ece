"""Toxic passages by maximum-scoring segments over token log-odds.

Training: documents' token presence is counted by class over labelled rows (of equal texts, one); a token's score is its
log-odds, shrunk by an informative Dirichlet prior with the corpus' own frequencies (a `prior` share of the rows). Tokens
that stand out are the model: as many of the least likely (by the binomial tail's bound, were the classes alike) as keep
the expected share of chance finds under `false_share` (Benjamini-Hochberg), so the evidence decides at every number of rows;
`vocabulary` of them at most. Tokens are words and, of longer words, the first `PIECE` bytes, as compounds of one stem are
each rare. Scan: a listed word, or else a word whose beginning is listed, scores its log-odds, any other a small negative
drift; the Ruzzo-Tompa scan finds all maximal-scoring segments in linear time. Extreme-value statistics (Karlin-Altschul:
lambda solved from the clean class' token frequencies, K fitted to the greatest segments of its documents) turn each
segment's score into an expected number of such segments in clean text of that length; segments under `significance` are
toxic passages, and their surprise is calibrated to a probability on the training rows.

The classifier is fitted on `max_rows` labelled rows, about, chosen by hash (all, if fewer). Scoring reads whole texts.

Defined results: null and empty texts have no passage and get the probability of no evidence; rows whose doc_id is null
are in the training fold by the text '' but have no label; a doc_id labelled twice counts as toxic if any label says so;
unlabelled rows are scored only; with no labels of either class every score is the share of toxic labels (0 without any).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thornwick.llm.common import materialize, mix, run_hash, text_chunks, words_of

BREAKS = np.ones(256, bool)
BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
PIECE = 7


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's words: hashes, hashes of their beginnings (a word of PIECE bytes or fewer has its own), and the index of
    each row's first word (one more at the end)."""
    hashes, starts, ends, first = words_of(data, offsets, BREAKS, LOWER)
    pieces = hashes.copy()
    long = np.flatnonzero(ends - starts > PIECE)
    if len(long):
        pieces[long] = mix(run_hash(LOWER[data].astype(np.uint64) + np.uint64(1), starts[long], starts[long] + PIECE) ^ np.uint64(PIECE))
    return hashes, pieces, first


def fold(doc_id: F.Column) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3))


@dataclass
class Model:
    tokens: np.ndarray  # sorted hashes
    scores: np.ndarray
    drift: float
    rate: float  # Karlin-Altschul lambda
    significance: float
    size: float = 0.1  # Karlin-Altschul K
    intercept: float = 0.0
    slope: float = 0.0

    def segments(self, positions: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """All maximal-scoring segments (first token, last token, score) of a document by its listed tokens."""
        done: list[tuple[int, int, float]] = []
        found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum with, the nearest earlier one of less sum before
        total, before = 0.0, -1
        for p, s in zip(positions.tolist(), scores.tolist(), strict=True):
            total -= self.drift * (p - before - 1)
            before = p
            left, total = total, total + s
            if s <= 0:
                continue
            first, j = p, len(found) - 1
            while True:
                while j >= 0 and found[j][2] >= left:
                    j = found[j][4]
                if j < 0:  # nothing later can join those before it
                    done += [(a, b, d - c) for a, b, c, d, _ in found]
                    found = [(first, p, left, total, -1)]
                    break
                if found[j][3] >= total:
                    found.append((first, p, left, total, j))
                    break
                first, _, left, _, back = found[j]
                del found[j:]
                j = back
        return done + [(a, b, d - c) for a, b, c, d, _ in found]

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, list[tuple[int, int, float]]]:
        """Surprise (minus the log of expected count, in tens) of the significant segments together, and those segments."""
        sure, total = [], 0.0
        for a, b, s in segments:
            surprise = self.rate * s - math.log(max(n, 1)) - math.log(self.size)
            if surprise > -math.log(self.significance):
                sure.append((a, b, s))
                total += surprise / math.log(10)
        return total, sure

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * min(evidence, 10.0)))))

    def scan(self, column: pa.Array) -> Iterator[tuple[float, list[tuple[int, int, float]]]]:
        for segments, n in self.read(column):
            yield self.evidence(segments, n)

    def read(self, column: pa.Array) -> Iterator[tuple[list[tuple[int, int, float]], int]]:
        """Each text's segments and number of words."""
        for i, j, data, offsets in text_chunks(column):
            hashes, pieces, first = tokens_of(data, offsets)
            at, hit = np.zeros(len(hashes), np.int64), np.zeros(0, np.int64)
            if len(self.tokens):
                whole, begun = (np.minimum(np.searchsorted(self.tokens, x), len(self.tokens) - 1) for x in (hashes, pieces))
                at = np.where(self.tokens[whole] == hashes, whole, begun)
                hit = np.flatnonzero((self.tokens[at] == hashes) | (self.tokens[at] == pieces))
            bounds = np.searchsorted(hit, first)
            for k in range(j - i):
                rows = hit[bounds[k] : bounds[k + 1]]
                yield self.segments(rows - first[k], self.scores[at[rows]]) if len(rows) else [], int(first[k + 1] - first[k])


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by class that hold a token, and how often clean ones do, summed over about four million bytes of text; the
    null token counts clean documents' words."""
    for batch in batches:
        labels = batch.column("label").to_numpy()
        for i, j, data, offsets in text_chunks(batch.column("text"), 4 << 20):
            hashes, pieces, first = tokens_of(data, offsets)
            doc = np.repeat(np.arange(j - i), np.diff(first))
            begun = pieces != hashes
            hashes, doc = np.concatenate((hashes, pieces[begun])), np.concatenate((doc, doc[begun]))
            order = np.lexsort((hashes, doc))
            h, d = hashes[order], doc[order]
            new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, np.int64)
            times, toxic = np.diff(np.r_[new, len(h)]), labels[i:j][d[new]]
            token, inverse = np.unique(h[new], return_inverse=True)
            sums = [np.bincount(inverse, w, len(token)).astype(np.int64) for w in (1 - toxic, toxic, times * (1 - toxic))]
            words = int(np.diff(first)[labels[i:j] == 0].sum())
            yield pa.RecordBatch.from_arrays([pa.array([*token.view(np.int64).tolist(), None], pa.int64()), *(pa.array(np.r_[x, w]) for x, w in zip(sums, (0, 0, words), strict=True))], ["token", "clean", "toxic", "times"])


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, vocabulary: int = 10_000, prior: float = 0.1, false_share: float = 0.05, reach: int = 50, significance: float = 0.05
) -> Model:
    """Fits on the labelled rows of the training fold."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    # max_rows pairs of numbers, about: a bounded broadcast
    sample = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").select("label", "text")
    sample = materialize(sample.dropDuplicates(["label", "text"]), "labelled")
    per_class = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = per_class.get(0, 0), per_class.get(1, 0)
    share = min(max(n1 / max(n0 + n1, 1), 1e-6), 1 - 1e-6) if n0 + n1 else 0.0
    flat = Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, 1.0, significance, intercept=math.log(share / (1 - share)) if share else -30.0)
    if not n0 or not n1:
        return flat
    counts = sample.mapInArrow(_presence, "token long, clean long, toxic long, times long").groupBy("token").agg(F.sum("clean").alias("y0"), F.sum("toxic").alias("y1"), F.sum("times").alias("t0"))
    counts = materialize(counts, "tokens")
    both, y1 = F.col("y0") + F.col("y1"), F.col("y1")
    part = lambda y, q: F.when(y > 0, y * F.log(y / (both * F.lit(q)))).otherwise(0.0)
    told = counts.filter("token is not null").withColumn("surprise", part(y1, share) + part(F.col("y0"), 1 - share))
    least = -math.log(false_share)
    most = F.greatest(-both * math.log(share), -both * math.log(1 - share))  # what a token of so many documents can reach
    told = told.filter(most >= least)
    tried, rows = told.count(), told.filter(F.col("surprise") >= least).orderBy(F.desc("surprise"), "token").limit(vocabulary).collect()
    chance = np.exp(-np.asarray([r["surprise"] for r in rows]))
    rows = rows[: int(np.flatnonzero(np.r_[True, chance <= false_share * np.arange(1, len(rows) + 1) / max(tried, 1)])[-1])]
    tokens = np.asarray([r["token"] for r in rows], np.int64).view(np.uint64)
    y0, y1, t0 = (np.asarray([r[c] for r in rows], float) for c in ("y0", "y1", "t0"))
    prior *= n0 + n1
    a = prior * (y0 + y1) / (n0 + n1)  # of a token's prior documents in each class
    scores = np.log((y1 + a) / (n1 + prior - y1 - a + 1e-9)) - np.log((y0 + a) / (n0 + prior - y0 - a + 1e-9))
    if not (scores > 0).any():
        return flat
    drift = float(scores[scores > 0].mean()) / reach
    words = max(counts.filter("token is null").agg(F.sum("t0")).first()[0] or 0, 1)
    p = (t0 + a * words / (words + prior)) / (words + prior)  # frequency a word, with the prior's share of unseen ones
    p *= min(1.0, 0.5 / max(p.sum(), 1e-300))
    rest = 1 - p.sum()
    low, high = 1e-6, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        over = float((p * np.exp(np.minimum(mid * scores, 700))).sum() + rest * math.exp(-mid * drift)) > 1
        low, high = (low, mid) if over else (mid, high)
    order = np.argsort(tokens)
    model = Model(tokens[order], scores[order], drift, low, significance)
    floor = float(scores[scores > 0].min())

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the likelihood of the greatest segment's score x of n words: its share of K n exp(-lambda x), or of less than floor
        for batch in batches:
            found = [(max((s for _, _, s in x), default=0.0), n) for x, n in model.read(batch.column("text"))]
            seen = [int(x > 0) for x, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array([sum(seen)], pa.int64()), pa.array([sum(n * math.exp(-low * (x or floor)) for x, n in found)], pa.float64())], ["seen", "mass"])

    row = sample.filter("label = 0").select("text").mapInArrow(extremes, "seen long, mass double").agg(F.sum("seen"), F.sum("mass")).first()
    model.size = max(((row[0] or 0) + 0.5) / ((row[1] or 0.0) + 1e-9), 1e-6)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([min(e, 10.0) for e, _ in model.scan(batch.column("text"))], pa.float64())], ["label", "evidence"])

    seen = sample.mapInArrow(judge, "label int, evidence double").groupBy("label", F.round("evidence", 1).alias("evidence")).count().collect()  # 200 rows at most
    x, y, w = (np.asarray([float(r[k]) for r in seen]) for k in ("evidence", "label", "count"))
    model.intercept, model.slope = _logistic(x, y, w)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    a, b = 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.asarray([(w * (y - p)).sum(), (w * x * (y - p)).sum() - ridge * b])
        v = w * p * (1 - p) + 1e-9
        h = np.asarray([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + ridge]])
        step = np.linalg.solve(h, g)
        size = min(1.0, 2.0 / max(abs(step).max(), 1e-9))
        a, b = a + size * step[0], b + size * step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), max(float(b), 0.0)


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("score", T.DoubleType())]))


FOUND = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("passages", SPANS)])


def scored(text: F.Column, model: Model) -> F.Column:
    """score (0 to 1) and the toxic passages (token positions) of a text; only the text goes to Python."""

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spans = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
        for texts in batches:
            found = list(model.scan(texts))
            yield pa.StructArray.from_arrays([pa.array([model.probability(e) for e, _ in found], pa.float64()), pa.array([[{"first": a, "last": b, "score": s} for a, b, s in x] for _, x in found], spans)], ["score", "passages"])

    return run(F.coalesce(text.cast("string"), F.lit("")))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **training: float) -> DataFrame:
    """doc_id, held_out, score, predicted, passages of every row of docs."""
    found = docs.select("doc_id", scored(F.col("text"), train(docs, labels, **training)).alias("found")).select("doc_id", "found.*")
    return found.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **training: float) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns."""
    return docs.filter(scored(F.col("text"), train(docs, labels, **training))["score"] < threshold)

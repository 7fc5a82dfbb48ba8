"""Toxic passages by maximum-scoring segments.

Tokens are words, and word beginnings, so that inflected forms share what is
known of their stems. Each gets its log-odds between toxic and other documents
under a Dirichlet prior that follows the background frequencies. A linear scan
finds every maximal scoring segment of a text; an extreme-value distribution,
fitted to documents that aren't toxic, says how surprising the best segment is
for a text of that length, and which segments are significant.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import cut
from .labelled import fold_is, labelled_sample
from .text import _BYTE, batches, mix64, powers, texts, word_bounds

_U64 = np.uint64
# Lengths in bytes of the word beginnings that are tokens beside the word itself.
STEMS = (5, 7)
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes): the words of a text, and for each the hashes of the word and of its beginnings, in lower case and without marks around."""
    body = data.tobytes()
    lower = body.decode().lower().encode()
    if len(lower) != len(body):  # rare characters change their length: places then refer to the lower-cased text
        data = np.frombuffer(lower, np.uint8)
    begin, end = word_bounds(data)
    low = np.frombuffer(lower, np.uint8)
    first, last = begin.copy(), end.copy()
    if len(begin):
        # For each place the last letter up to it and the first from it on; a word without one stays as it is.
        place = np.arange(len(low))
        letter = _LETTER[low]
        before = np.maximum.accumulate(np.where(letter, place, -1))
        after = np.minimum.accumulate(np.where(letter, place, len(low))[::-1])[::-1]
        some = after[begin] < end
        first, last = np.where(some, after[begin], begin), np.where(some, before[end - 1] + 1, end)
    up, down = powers(len(low) + 1)
    sums = np.concatenate((np.zeros(1, _U64), np.cumsum(_BYTE[low] * up[:-1])))
    out = np.empty((1 + len(STEMS), len(first)), _U64)
    for k, size in enumerate((0, *STEMS)):
        upto = np.minimum(first + size, last) if size else last
        out[k] = mix64((sums[upto] - sums[first]) * down[first] + _U64(k))
    return begin, end, out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, end, sum) of every maximal scoring segment, in one linear pass.

    Neighbouring scores of one sign are first added up; a segment is extended
    to the left over the latest one whose sum before it is smaller, as long as
    this makes it larger.
    """
    if not len(scores) or not (scores > 0).any():
        return []
    sign = scores > 0
    bounds = np.concatenate(([0], np.flatnonzero(sign[1:] != sign[:-1]) + 1))
    sums = np.add.reduceat(scores, bounds)
    ends = np.append(bounds[1:], len(scores))
    total, found = 0.0, []  # of each segment: first, end, sum before it, sum with it
    for k in range(len(bounds)):
        value = float(sums[k])
        if value > 0:
            new = [int(bounds[k]), int(ends[k]), total, total + value]
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][2] >= new[2]:
                    j = found[j][4]
                if j < 0 or found[j][3] >= new[3]:
                    break
                new[0], new[2] = found[j][0], found[j][2]
                del found[j:]
            found.append([*new, j])
        total += value
    return [(a, b, right - left) for a, b, left, right, _ in found]


@dataclass
class ToxicityModel:
    """Token scores and the calibration. ``keys`` are sorted; ``scale`` is the decay of the segment scores, ``place`` and ``spread`` are of the extreme-value distribution, ``weights`` of the final logistic."""

    keys: np.ndarray
    odds: np.ndarray
    drift: float
    scale: float = 1.0
    place: float = 0.0
    spread: float = 1.0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def __post_init__(self):
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.keys >> _U64(44)).astype(np.int64)] = True

    def token_scores(self, hashes: np.ndarray) -> np.ndarray:
        """Of a word and its beginnings the largest log-odds if any is above 0, else the least; less the drift."""
        top, low = (np.zeros(hashes.shape[1]) for _ in range(2))
        for row in hashes:
            maybe = np.flatnonzero(self.near[(row >> _U64(44)).astype(np.int64)])
            if len(maybe) and len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, row[maybe]), len(self.keys) - 1)
                odds = np.where(self.keys[at] == row[maybe], self.odds[at], 0.0)
                top[maybe] = np.maximum(top[maybe], odds)
                low[maybe] = np.minimum(low[maybe], odds)
        return np.where(top > 0, top, low) - self.drift

    def surprise(self, value: float, n: int) -> float:
        """-ln of the probability that a text of n words that isn't toxic has a segment of that score."""
        z = (self.scale * value - math.log(max(n, 1)) - self.place) / self.spread
        return z if z > 20 else -math.log(max(-math.expm1(-math.exp(min(-z, 50.0))), 1e-300))

    def features(self, data: np.ndarray) -> tuple[float, float, list[tuple[int, int, float]], np.ndarray]:
        """(surprise of the best segment, summed surprise of the significant ones, those segments in words, token scores)."""
        begin, _, hashes = tokens(data)
        scores = self.token_scores(hashes)
        parts = [(a, b, self.surprise(s, len(begin))) for a, b, s in maximal_segments(scores)]
        parts = [p for p in parts if p[2] >= 3.0]  # p below 0.05
        best = max((p[2] for p in parts), default=0.0)
        return min(best, 40.0), min(sum(p[2] for p in parts), 200.0), parts, scores

    def probability(self, best: float, every: float) -> float:
        z = self.weights[0] + self.weights[1] * best + self.weights[2] * math.log1p(every)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return beta


def fit_toxicity(sample: DataFrame, *, prior: float = 1.0, confidence: float = 2.58, drift: float = 0.05) -> ToxicityModel:
    """Learn from (doc_id, text, label), a bounded sample.

    Seven tenths of it give the token scores: the log-odds, taken toward 0 by
    ``confidence`` standard deviations, of every token that is further from 0
    than that; so how much is kept depends on the evidence alone, and its
    number is bounded by the words of the sample. The prior weighs as much as
    ``prior`` times the toxic documents. The rest gives the calibration. With
    one class only, or none, every score is the share of toxic rows (0 without rows).
    """
    sample = cut(sample)  # read several times; the documents are scanned once
    batches(sample.sparkSession)
    fit = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(10)) < 7
    sizes = {r["label"]: r["n"] for r in sample.where(fit).groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    empty = ToxicityModel(np.zeros(0, _U64), np.zeros(0), drift)
    if not bad or not good:
        share = bad / (bad + good) if bad else 0.0
        empty.weights = (math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0)
        return empty

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            marks = part.column(1).to_numpy(zero_copy_only=False)
            seen = {0: [np.zeros(0, _U64)], 1: [np.zeros(0, _U64)]}
            for data, mark in zip(texts(part.column(0)), marks, strict=True):
                seen[int(mark)].append(np.unique(tokens(data)[2]))
            for mark, lists in seen.items():
                keys, n = np.unique(np.concatenate(lists), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array((n if mark else 0 * n).astype(np.int64)), pa.array((0 * n if mark else n).astype(np.int64))], ["key", "bad", "good"])

    counts = sample.where(fit).select("text", "label").mapInArrow(count, "key long, bad long, good long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    weight = prior * bad
    alpha = (F.col("bad") + F.col("good")) * (weight / (bad + good))
    of = lambda n, total: (F.col(n) + alpha) / (F.lit(float(total) + weight) - F.col(n) - alpha)
    scored = counts.where(F.lit(float(min(bad, good)) + weight) > F.greatest("bad", "good") + alpha).select("key", (F.log(of("bad", bad)) - F.log(of("good", good))).alias("odds"), F.sqrt(1 / (F.col("bad") + alpha) + 1 / (F.col("good") + alpha)).alias("sd"))
    sure = F.signum("odds") * (F.abs("odds") - confidence * F.col("sd"))
    kept = scored.where(F.abs("odds") > confidence * F.col("sd")).select("key", sure.alias("odds")).collect()  # at most the words of the sample
    keys = np.array([r["key"] for r in kept], np.int64).view(_U64)
    order = np.argsort(keys)
    model = ToxicityModel(keys[order], np.clip(np.array([r["odds"] for r in kept], float)[order], -0.5, 6.0), drift)

    edges = np.linspace(-1.0, 7.0, 161)

    def calibrate(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for data in texts(part.column(0)):
                scores = model.token_scores(tokens(data)[2])
                segments = [s for _, _, s in maximal_segments(scores)]
                rows.append((len(scores), max(segments, default=0.0), segments, np.histogram(scores, edges)[0].tolist()))
            yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()))))], ["label", "n", "best", "segments", "hist"])

    schema = "label int, n long, best double, segments array<double>, hist array<long>"
    rows = sample.where(~fit).select("text", "label").mapInArrow(calibrate, schema).collect()  # small rows, as many as the sample's bound
    if not rows or len({r["label"] for r in rows}) < 2:
        share = bad / (bad + good)
        empty.weights = (math.log(share / (1 - share)), 0.0, 0.0)
        return empty
    clean = [r for r in rows if r["label"] == 0]
    mids, hist = (edges[1:] + edges[:-1]) / 2, np.sum([r["hist"] for r in clean], axis=0).astype(float) + 1e-9
    hist /= hist.sum()
    low, high = 1e-6, 20.0
    for _ in range(80):  # the positive root of sum p * exp(scale * score) = 1
        mid = (low + high) / 2
        low, high = (mid, high) if float(hist @ np.exp(np.minimum(mid * mids, 500))) < 1 else (low, mid)
    model.scale = low
    x = np.array([model.scale * r["best"] - math.log(max(r["n"], 1)) for r in clean])
    # By moments, on the inner part: a few mislabelled documents mustn't stretch the distribution.
    inner = x[x <= np.quantile(x, 0.99)]
    model.spread = max(float(inner.std()) * math.sqrt(6) / math.pi, 0.1)
    model.place = float(inner.mean()) - 0.5772156649 * model.spread
    data = []
    for r in rows:
        each = [p for p in (model.surprise(s, r["n"]) for s in r["segments"]) if p >= 3.0]
        data.append((1.0, min(max(each, default=0.0), 40.0), math.log1p(min(sum(each), 200.0))))
    model.weights = tuple(float(v) for v in _logistic(np.array(data), np.array([float(r["label"]) for r in rows])))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, with_passages: bool = False) -> DataFrame:
    """(doc_id, score[, passages]) for each row of docs; ``passages``: (first word, end, surprise) of every significant segment.

    Null and empty texts have no segment and get the base score. Repeated rows
    are scored each; other columns are not carried. No shuffle; the model's
    size is bounded by its vocabulary.
    """
    spark = docs.sparkSession
    batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in parts:
            scores, passages = [], []
            for data in texts(part.column(1)):
                best, every, found, _ = known.features(data)
                scores.append(known.probability(best, every))
                passages.append([{"first": a, "end": b, "surprise": float(s)} for a, b, s in found] if with_passages else None)
            columns = [part.column(0).cast(pa.int64()), pa.array(scores, pa.float64())]
            if with_passages:
                columns.append(pa.array(passages, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("surprise", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "passages"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double" + ", passages array<struct<first:long,end:long,surprise:double>>" * with_passages)


def toxicity(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 10_000) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages), learnt from at most ``sample_rows`` labelled rows that aren't held out.

    held_out: crc32 of the doc_id as text is divisible by 5; such labels are
    never read for learning. A row for each row of docs, repeated ones too;
    a null doc_id is not held out; null and empty texts get the base score;
    other columns are not carried, so none can clash; no rows give no rows.
    """
    held = fold_is(F.col("doc_id"), 5, 0)
    model = fit_toxicity(labelled_sample(docs, labels, "toxic", held, sample_rows))
    scored = score_toxicity(docs, model, with_passages=True)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs, with all their columns, without the documents that :func:`toxicity` predicts to be toxic; rows without a doc_id stay if their text isn't."""
    spark = docs.sparkSession
    batches(spark)
    held = fold_is(F.col("doc_id"), 5, 0)
    shared = spark.sparkContext.broadcast(fit_toxicity(labelled_sample(docs, labels, "toxic", held, options.pop("sample_rows", 10_000)), **options))
    where = docs.columns.index("text")

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in parts:
            good = [known.probability(*known.features(data)[:2]) < 0.5 for data in texts(part.column(where))]
            yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)

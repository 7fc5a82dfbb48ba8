"""A byte-level convolutional quality classifier in numpy.

A text is covered by overlapping chunks. In each, learned filters slide over
the bytes and are max-pooled; the pooled values of all chunks are combined,
by their largest and mean value, into one probability for the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold_is, labelled_sample
from .text import batches, texts

# Bytes a filter sees, its step, pooled positions of a block, blocks of a chunk and the step between chunks (in blocks).
WIDTH, STRIDE, BLOCK, CHUNK_BLOCKS, CHUNK_STEP = 8, 2, 64, 4, 3


@dataclass
class QualityModel:
    embedding: np.ndarray  # (256, E)
    filters: np.ndarray  # (WIDTH, E, F)
    bias: np.ndarray  # (F,)
    head: np.ndarray  # (2 F + 1,)

    def tables(self) -> np.ndarray:
        """For each place in a filter, what each byte adds to each filter: (WIDTH, 256, F)."""
        return np.einsum("be,kef->kbf", self.embedding, self.filters).astype(np.float32)


def _windows(data: np.ndarray) -> np.ndarray:
    """Bytes under each position of the filters, (n, WIDTH); short texts are padded with zero bytes."""
    if len(data) < WIDTH or (len(data) - WIDTH) % STRIDE:
        data = np.concatenate((data, np.zeros(max(WIDTH - len(data), (len(data) - WIDTH) % STRIDE), np.uint8)))
    return np.lib.stride_tricks.sliding_window_view(data, WIDTH)[::STRIDE]


def _chunk_starts(blocks: int) -> np.ndarray:
    """First blocks of the chunks; together they cover every block."""
    return np.arange(0, max(1, blocks - CHUNK_BLOCKS + CHUNK_STEP), CHUNK_STEP)


def pooled(data: np.ndarray, tables: np.ndarray, bias: np.ndarray, piece: int = 1 << 16) -> np.ndarray:
    """Max-pooled filters of every chunk, (chunks, F), for a text of any length in bounded memory."""
    tops = []
    whole = piece * STRIDE
    for at in range(0, max(len(data), 1), whole):
        windows = _windows(data[at : at + whole + WIDTH - STRIDE])
        total = tables[0][windows[:, 0]]
        for k in range(1, WIDTH):
            total += tables[k][windows[:, k]]
        tops.append(np.maximum.reduceat(total, np.arange(0, len(total), BLOCK), axis=0))
    blocks = np.concatenate(tops) if len(tops) > 1 else tops[0]
    starts = _chunk_starts(len(blocks))
    out = blocks[starts]
    for k in range(1, CHUNK_BLOCKS):
        out = np.maximum(out, blocks[np.minimum(starts + k, len(blocks) - 1)])
    return np.maximum(out + bias, 0)


def _document(chunks: np.ndarray) -> np.ndarray:
    return np.concatenate((chunks.max(axis=0), chunks.mean(axis=0), [1.0]))


def probability(data: np.ndarray, model: QualityModel, tables: np.ndarray) -> float:
    z = float(_document(pooled(data, tables, model.bias)) @ model.head)
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(bodies: list[bytes], labels: np.ndarray, *, filters: int = 16, width: int = 8, epochs: int = 6, batch: int = 32, rate: float = 0.01, chunks_at_once: int = 1024, seed: int = 7) -> QualityModel:
    """Train by Adam on the logistic loss, on all chunks of every document.

    The largest and mean values of a document are found first, ``chunks_at_once``
    at a time, and the gradient then flows back through the same chunks, so
    memory doesn't grow with the length of a text.
    """
    rng = np.random.default_rng(seed)
    model = QualityModel(rng.normal(0, 0.5, (256, width)), rng.normal(0, (WIDTH * width) ** -0.5, (WIDTH, width, filters)), np.zeros(filters), np.zeros(2 * filters + 1))
    if not len(bodies):
        return model
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    model.head[-1] = np.log(share / (1 - share))
    if labels.min() == labels.max():
        return model
    model.head[: 2 * filters] = rng.normal(0, 0.05, 2 * filters)
    params = [model.embedding, model.filters, model.bias, model.head]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    arrays = [np.frombuffer(b, np.uint8) for b in bodies]
    span = (CHUNK_BLOCKS * BLOCK - 1) * STRIDE + WIDTH
    hop = CHUNK_STEP * BLOCK * STRIDE
    for epoch in range(epochs):
        order = rng.permutation(len(arrays))
        for k in range(0, len(order), batch):
            docs = order[k : k + batch]
            places = [(j, s) for j, d in enumerate(docs) for s in range(0, max(1, len(arrays[d]) - span + hop), hop)]
            owner = np.array([j for j, _ in places])
            tables = model.tables()
            under, tops = [], []
            for at in range(0, len(places), chunks_at_once):
                chunks = np.zeros((len(places[at : at + chunks_at_once]), span), np.uint8)
                for row, (j, s) in zip(chunks, places[at : at + chunks_at_once], strict=True):
                    part = arrays[docs[j]][s : s + span]
                    row[: len(part)] = part
                seen = np.lib.stride_tricks.sliding_window_view(chunks, WIDTH, axis=1)[:, ::STRIDE]  # chunks, positions, WIDTH
                acts = tables[0][seen[:, :, 0]]
                for w in range(1, WIDTH):
                    acts += tables[w][seen[:, :, w]]
                best = acts.argmax(axis=1)  # chunks, F
                tops.append(np.take_along_axis(acts, best[:, None, :], axis=1)[:, 0] + model.bias)
                under.append(np.take_along_axis(seen, best[:, :, None], axis=1))  # chunks, F, WIDTH bytes
            top, picked = np.concatenate(tops), np.concatenate(under)
            relu = np.maximum(top, 0)
            n = np.bincount(owner, minlength=len(docs))[:, None]
            cuts = np.concatenate(([0], np.cumsum(n[:-1, 0])))
            largest, mean = np.maximum.reduceat(relu, cuts, axis=0), np.add.reduceat(relu, cuts, axis=0) / n
            feats = np.hstack((largest, mean, np.ones((len(docs), 1))))
            p = 1 / (1 + np.exp(-np.clip(feats @ model.head, -30, 30)))
            err = (p - labels[docs]) / len(docs)
            g_head = feats.T @ err
            g_feats = err[:, None] * model.head[None, :]
            leads = relu >= largest[owner]  # ties share
            ties = np.add.reduceat(leads.astype(float), cuts, axis=0)
            g = (g_feats[owner, :filters] * leads / ties[owner] + g_feats[owner, filters : 2 * filters] / n[owner]) * (top > 0)
            # What each byte at each place of each filter gets; filters and embedding share it.
            weight = np.zeros((256, WIDTH, filters))
            np.add.at(weight, (picked, np.arange(WIDTH)[None, None, :], np.arange(filters)[None, :, None]), g[:, :, None])
            g_filters = np.einsum("bkf,be->kef", weight, model.embedding)
            g_embedding = np.einsum("bkf,kef->be", weight, model.filters)
            step += 1
            pace = rate * (0.1 if epoch == epochs - 1 else 1.0)
            for q, grad, m, v in zip(params, (g_embedding, g_filters, g.sum(axis=0), g_head), first, second, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                q -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def fit_quality(sample: DataFrame, **options) -> QualityModel:
    """Train on (doc_id, text, label), a bounded sample, which comes to the driver; the order of rows doesn't matter."""
    rows = sample.orderBy("doc_id", "text").collect()
    return fit([(r["text"] or "").encode() for r in rows], np.array([float(r["label"]) for r in rows]), **options)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for each row of docs, repeated ones too, from every byte of its text; null counts as empty. No rows give no rows. No shuffle."""
    spark = docs.sparkSession
    batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        tables = known.tables()
        bias = known.bias.astype(np.float32)
        plain = QualityModel(known.embedding, known.filters, bias, known.head)
        for part in parts:
            scores = [probability(data, plain, tables) for data in texts(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 3000, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted), learnt from at most ``sample_rows`` labelled rows that aren't held out.

    held_out: crc32 of the doc_id as text leaves 1 when divided by 3; such
    labels are never read for learning. A row for each row of docs; without
    labels, or with one class only, every score is the share of label 1 (one
    half without labels). Other columns are not carried.
    """
    held = fold_is(F.col("doc_id"), 3, 1)
    model = fit_quality(labelled_sample(docs, labels, "quality", held, sample_rows), **options)
    return score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Substring dedup by sliding spans of sentences.

Every run of several consecutive sentences is hashed and joined with all others; sentences that a repeated run covers are removed wherever the run is
not its first occurrence (by doc_id, then by place).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.graph import cut
from .text import batches, code_points, mix64, powers, span_hashes, texts, unused, word_bounds

_U64 = np.uint64
# Bytes that end a sentence, and bytes that may follow such a mark within the word.
ENDS, AFTER = b".!?", b"\"')]"
_END = np.zeros(256, bool)
_END[list(ENDS)] = True
_AFTER = np.zeros(256, bool)
_AFTER[list(AFTER)] = True


def sentences(data: np.ndarray, long: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds in bytes and first words of the sentences, with the hashes of all words: (starts, firsts, word hashes).

    A sentence ends after a word that ends in one of .!? (closing quotes or
    brackets may follow) or before a line break. Only a very long one, of more
    than ``long`` words, is cut further, after words whose hash falls in a
    fixed quarter, so that text without marks has places to compare, too, and
    the cuts of a passage don't depend on what stands around it. ``starts`` has
    one more entry, the end of the text.
    """
    begin, end = word_bounds(data)
    n = len(begin)
    if n == 0:
        return np.array([0, len(data)]), np.zeros(0, np.int64), np.zeros(0, _U64)
    words = span_hashes(data, begin, end)
    mark = end - 1
    for _ in range(2):
        mark = np.where(_AFTER[data[mark]] & (mark > begin), mark - 1, mark)
    breaks = np.flatnonzero(data == 10)
    newline = np.searchsorted(breaks, np.append(begin[1:], len(data))) > np.searchsorted(breaks, end)
    last = _END[data[mark]] | newline
    last[-1] = True
    sizes = np.diff(np.concatenate(([-1], np.flatnonzero(last))))
    if sizes.max() > long:
        inside = np.repeat(sizes > long, sizes)
        last |= inside & (words >> _U64(62) == 0)
    firsts = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
    starts = np.append(begin[firsts], len(data))
    starts[0] = 0
    return starts, firsts, words


def run_hashes(firsts: np.ndarray, words: np.ndarray, run: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, end, hash) of the run that begins at each sentence: of ``run`` sentences, and on until it has ``min_words`` words."""
    m = len(firsts)
    if m < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U64)
    bounds = np.append(firsts, len(words))
    place = mix64(np.arange(len(words), dtype=_U64) - np.repeat(firsts, np.diff(bounds)).astype(_U64))  # of a word in its sentence
    each = mix64(np.add.reduceat(mix64(words ^ place), firsts))
    begin = np.arange(m)
    end = np.maximum(begin + run, np.searchsorted(bounds, bounds[:-1] + min_words))
    begin = begin[end <= m]
    end = end[: len(begin)] if len(begin) else end[:0]
    up, down = powers(m + 1)
    sums = np.concatenate((np.zeros(1, _U64), np.cumsum(each * up[:m])))
    return begin, end, mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(_U64))


def _runs(docs: DataFrame, run: int, min_words: int) -> DataFrame:
    """doc_id, hash: the distinct runs of sentences of every text."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, hashes = part.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False), []
            for data in texts(part.column(1)):
                _, firsts, words = sentences(data)
                hashes.append(np.unique(run_hashes(firsts, words, run, min_words)[2]))
            if counts := [len(x) for x in hashes]:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, counts)), pa.array(np.concatenate(hashes).view(np.int64))], ["doc_id", "hash"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(work, "doc_id long, hash long")


def repeated_runs(docs: DataFrame, *, run: int = 2, min_words: int = 25) -> DataFrame:
    """(doc_id, hash): each run of sentences that a document with a smaller doc_id has too. Texts are hashed once."""
    runs = cut(_runs(docs, run, min_words))
    # Extremes are combined before the shuffle, so a passage that very many documents share costs a row per task.
    firsts = runs.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("hash", "first")
    return runs.join(firsts, "hash").where("doc_id > first").select("doc_id", "hash")


def _without_repeats(docs: DataFrame, run: int, min_words: int, counts: tuple[str, str, str]) -> DataFrame:
    """docs with repeated passages taken out of ``text``, and three counts under the given names."""
    batches(docs.sparkSession)
    kept, held = docs.columns, unused("runs", docs.columns)
    # One document's runs; their number is bounded by its length.
    flagged = repeated_runs(docs, run=run, min_words=min_words).groupBy("doc_id").agg(F.collect_set("hash").alias(held))
    joined = docs.join(flagged, "doc_id", "left").select(*kept, held)
    where = kept.index("text")

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            bodies, found, gone, chars = part.column(where).to_pylist(), [], [], []
            for k, (data, elsewhere) in enumerate(zip(texts(part.column(where)), part.column(len(kept)), strict=True)):
                starts, firsts, words = sentences(data)
                at, upto, hashes = run_hashes(firsts, words, run, min_words)
                again = np.ones(len(hashes), bool)
                again[np.unique(hashes, return_index=True)[1]] = False
                if elsewhere.is_valid:
                    again |= np.isin(hashes, np.asarray(elsewhere.values, np.int64).view(_U64))
                steps = np.zeros(len(firsts) + 1, np.int64)
                np.add.at(steps, at[again], 1)
                np.add.at(steps, upto[again], -1)
                drop = np.cumsum(steps)[:-1] > 0
                found.append(len(firsts)), gone.append(int(drop.sum()))
                if drop.any():
                    stay = np.repeat(~drop, np.diff(starts))
                    bodies[k] = data[stay].tobytes().decode()
                    chars.append(code_points(data) - len(bodies[k]))
                else:
                    chars.append(0)
            columns = [part.column(i) for i in range(len(kept))]
            columns[where] = pa.array(bodies, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (found, gone, chars))], [*kept, *counts])

    schema = StructType([*docs.schema.fields, *(StructField(name, LongType()) for name in counts)])
    return joined.mapInArrow(work, schema)


def dedup_substrings(docs: DataFrame, *, run: int = 2, min_words: int = 25) -> DataFrame:
    """docs with repeated passages taken out of ``text``, plus n_sentences, n_removed (sentences) and removed_chars.

    A sentence goes if any run of ``run`` consecutive sentences that covers it
    (or more, until they have ``min_words`` words) stands earlier, in a document
    with a smaller doc_id or before in the same text. Words are compared as
    they stand; white space only matters where a line break ends a sentence.
    The first occurrence always stays whole.

    Null and empty texts stay as they are. Rows without a doc_id take no part
    and stay. Rows that repeat a doc_id count as one document: equal texts are
    treated alike and their runs never count against each other. A column of docs named
    like an added one is replaced; no rows give no rows. A text of which
    nothing is left becomes empty, and its row stays.
    """
    added = ("n_sentences", "n_removed", "removed_chars")
    return _without_repeats(docs.drop(*added), run, min_words, added)


def drop_repeated_passages(docs: DataFrame, *, run: int = 2, min_words: int = 25) -> DataFrame:
    """docs, with their own columns, without the passages that :func:`dedup_substrings` takes out, and without the rows of which nothing is left by that.

    n_chars, if docs has it, follows the text. Rows whose text was null or
    without words before stay. All else as in :func:`dedup_substrings`.
    """
    counts = tuple(unused(name, docs.columns) for name in ("found", "gone", "chars"))
    cleaned = _without_repeats(docs, run, min_words, counts).where((F.col(counts[1]) == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(counts[1]) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)

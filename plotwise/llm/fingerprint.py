"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a chunk wherever it meets the
block size; each chunk gives one character, so an edit changes only the
characters of the chunks that it touches. A fingerprint holds the signatures
at a block size and at twice that size, ``size:signature:signature``; two
fingerprints are compared, by edit distance, wherever they share a block size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import _BYTE, batches, span_hashes

# The digits of a signature, the bytes that the rolling hash sees, the smallest block size.
DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW = 7
SMALLEST = 3

_DIGIT = np.frombuffer(DIGITS, np.uint8)
_SHIFTED = [np.array([(int(x) * pow(31, 2 * k + 1, 1 << 32)) & 0xFFFFFFFF for x in (_BYTE >> np.uint64(32))], np.uint32) for k in range(WINDOW)]


def rolling(data: np.ndarray) -> np.ndarray:
    """For each byte a hash of it and the six before it."""
    out = _SHIFTED[0][data]
    for k in range(1, min(WINDOW, len(data))):
        out[k:] += _SHIFTED[k][data[:-k]]
    return out ^ (out >> np.uint32(15))


def fingerprint(data: bytes | np.ndarray, most: int = 64) -> str:
    """The fingerprint of a text; its block size is the least at which it has at most ``most`` chunks. Empty texts give ``3::``."""
    if isinstance(data, bytes):
        data = np.frombuffer(data, np.uint8)
    size, n = SMALLEST, len(data)
    if n == 0:
        return f"{size}::"
    roll = rolling(data)
    ends = np.flatnonzero(roll % np.uint32(size) == size - 1) + 1
    while len(ends) - (len(ends) > 0 and ends[-1] == n) >= most:
        # A number that is size - 1 modulo twice the size is so modulo the size: only these places can remain.
        size *= 2
        ends = ends[roll[ends - 1] % np.uint32(size) == size - 1]
    twice = ends[roll[ends - 1] % np.uint32(2 * size) == 2 * size - 1]
    signs = []
    for at in (ends, twice):
        if not len(at) or at[-1] != n:
            at = np.append(at, n)
        starts = np.concatenate(([0], at[:-1]))
        signs.append(_DIGIT[(span_hashes(data, starts, at) >> np.uint64(58)).astype(np.intp)].tobytes().decode())
    return f"{size}:{signs[0]}:{signs[1]}"


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements from a to b, by bit-parallel columns."""
    if not a or not b:
        return len(a) + len(b)
    top, every = 1 << (len(a) - 1), (1 << len(a)) - 1
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    plus, minus, score = every, 0, len(a)
    for c in b:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & every)
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & every
        plus = ((mh << 1) & every) | (~(xv | ph) & every)
        minus = ph & xv
    return score


def _likeness(a: str, b: str, run: int) -> float:
    if a == b:
        return 1.0
    need = min(run, len(a), len(b))
    if need < 1 or not {a[i : i + need] for i in range(len(a) - need + 1)} & {b[i : i + need] for i in range(len(b) - need + 1)}:
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def likeness(a: str, b: str, run: int = 4) -> float:
    """0 to 1: the best of 1 - distance / length over the block sizes that both fingerprints have.

    Signatures without ``run`` characters in a row in common (all, if one is
    shorter) count as 0, as do fingerprints without a common block size. Equal
    fingerprints give 1.
    """
    if a == b:
        return 1.0
    size_a, *signs_a = a.split(":")
    size_b, *signs_b = b.split(":")
    of_a = {int(size_a): signs_a[0], 2 * int(size_a): signs_a[1]}
    of_b = {int(size_b): signs_b[0], 2 * int(size_b): signs_b[1]}
    return max((_likeness(of_a[k], of_b[k], run) for k in of_a.keys() & of_b.keys()), default=0.0)


def add_fingerprints(docs: DataFrame, *, text: str = "text", column: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each whole text; null counts as empty. A column of that name is replaced."""
    batches(docs.sparkSession)

    @F.pandas_udf("string")
    def of(values):
        return values.fillna("").map(lambda x: fingerprint(x.encode()))

    return docs.withColumn(column, of(F.col(text)))


def with_successor(docs: DataFrame, *, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """(key, text, next_text): each row with the text of the row that follows by key, the last with the first's.

    The keys are cut at existing keys into ranges of about equal count; the
    row at the head of a range is also sent, as a guest, to the range before.
    So texts are shuffled once and each range is read in order, a row at a
    time. Rows with equal keys follow by text; null keys come last.
    """
    spark = docs.sparkSession
    n = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # One number per range comes to the driver: quantiles, which may be rounded, and then the least key at or above each.
    cuts = docs.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 10 * n)).first()[0] or [] if n > 1 else []
    above = F.size(F.filter(F.array(*[F.lit(int(x)) for x in sorted(set(cuts))]), lambda h: h <= F.col(key))) if cuts else F.lit(0)
    heads = sorted(r[0] for r in docs.where(F.col(key).isNotNull()).groupBy(above.alias("part")).agg(F.min(key).alias("head")).select("head").collect())
    last = max(0, len(heads) - 1)
    if heads:
        bounds = F.array(*[F.lit(h) for h in heads])
        own = F.when(F.col(key).isNull(), F.lit(last)).otherwise(F.size(F.filter(bounds, lambda h: h <= F.col(key))) - 1)
        before = F.when(F.array_contains(bounds, F.col("key")), F.pmod(F.col("__range") + F.lit(last), F.lit(last + 1)))
    else:
        own, before = F.lit(0), F.lit(0)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), own.cast("int").alias("__range"))
    places = F.array(F.struct(F.col("__range").alias("at"), F.lit(False).alias("guest")), F.struct(before.cast("int").alias("at"), F.lit(True).alias("guest")))
    rows = rows.withColumn("place", F.explode(F.filter(places, lambda p: p["at"].isNotNull())))
    rows = rows.select("key", "text", F.col("place.at").alias("range"), F.col("place.guest").alias("guest"))
    # Dealt by the ranges' order, so that no two of them meet in a task by chance.
    rows = rows.repartitionByRange(n, "range").sortWithinPartitions("range", "guest", F.col("key").asc_nulls_last(), "text")

    def follow(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # the row before, its range, whether it still waits for its successor
        for part in parts:
            keys, bodies, following = [], [], []
            for k, body, at, guest in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if held and held[2] == at:
                    keys.append(held[0]), bodies.append(held[1]), following.append(body)
                held = [] if guest else [k, body, at]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bodies, pa.string()), pa.array(following, pa.string())], ["key", "text", "next_text"])

    return rows.mapInArrow(follow, "key long, text string, next_text string").select(F.col("key").alias(key), F.col("text").alias(text), "next_text")


def fingerprint_edits(docs: DataFrame, *, share: int = 4) -> DataFrame:
    """Each document's fingerprint beside that of an edited text and of the next document.

    In the edited text, the last ``n_chars // share`` characters give way to
    the first as many (or all) of the next document by doc_id. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, a row for each row of docs.

    Null texts count as empty; equal doc_ids follow by text, null ones come
    last; a single row follows itself. Other columns are not carried.
    """
    batches(docs.sparkSession)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: tuple[str, str] = ("", fingerprint(b""))
        for part in parts:
            keys, chars, shas, marks, edits, near, follow = [], [], [], [], [], [], []
            for k, body, after in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                cut = len(body) // share
                edited = (body[: len(body) - cut] + after[:cut]).encode()
                own = memo[1] if memo[0] == body else fingerprint(body.encode())  # rows come in order: mostly the last one's successor
                following = fingerprint(after.encode())
                memo = (after, following)
                changed = fingerprint(edited)
                keys.append(k), chars.append(len(body)), shas.append(hashlib.sha256(edited).hexdigest())
                marks.append(own), edits.append(changed), near.append(likeness(own, changed)), follow.append(likeness(own, following))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(keys, pa.int64()), "n_chars": pa.array(chars, pa.int64()), "edited_sha256": pa.array(shas, pa.string()), "fingerprint": pa.array(marks, pa.string()),
                "edited_fingerprint": pa.array(edits, pa.string()), "near_edited": pa.array(near, pa.float64()), "near_next": pa.array(follow, pa.float64()),
            })

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successor(docs.select("doc_id", "text")).mapInArrow(work, schema)


__all__ = ["add_fingerprints", "edit_distance", "fingerprint", "fingerprint_edits", "likeness", "rolling", "with_successor"]

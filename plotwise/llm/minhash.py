"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of distinct word shingles, a MinHash signature
   and ``bands`` band keys. Texts with equal sets form one class.
2. Band keys that several classes share make candidates. A member of a band
   bucket is first compared with the bucket's centre only.
3. Signatures are compared a batch at a time. With m of n rows equal, the
   posterior of the similarity under a flat prior is Beta(m + 1, n - m + 1); a
   pair is dropped once P(similarity >= threshold) falls below ``miss``.
4. What survives is checked exactly, on the full shingle sets.
5. Where members of one bucket still lie in different components, they are
   dealt over blocks, and every two blocks that can hold such a pair meet in
   one task with their signatures and sets. Steps 3 and 4 are done there, and
   only links that join two components leave it: pairs are never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components, cut
from .text import LOWER, batches, mix64, shingles, span_hashes, texts, word_bounds

_U64 = np.uint64


def shingle_set(data: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased."""
    data = LOWER[data]
    return shingles(span_hashes(data, *word_bounds(data)), width)


def permutations(rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and masks of ``rows`` hash functions, the same everywhere."""
    seeds = mix64(np.arange(1, 2 * rows + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15))
    return (seeds[:rows] >> _U64(32)).astype(np.uint32) | np.uint32(1), (seeds[rows:] >> _U64(32)).astype(np.uint32)


def signature(items: np.ndarray, scale: np.ndarray, mask: np.ndarray, block: int = 2048) -> np.ndarray:
    """MinHash values of a set, block by block so that memory is bounded for any set."""
    small = (items >> _U64(32)).astype(np.uint32)
    out = np.full(len(scale), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(small), block):
        part = small[k : k + block]
        np.minimum(out, ((part[None, :] ^ mask[:, None]) * scale[:, None]).min(axis=1), out=out)
    return out


@lru_cache(4096)
def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest of n equal rows with which P(similarity >= threshold) is at least ``miss``."""

    def tail(m: int) -> float:  # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        return sum(math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))

    return next(m for m in range(n + 1) if tail(m) >= miss)


def _class(items: np.ndarray) -> str:
    """Two independent 64-bit sums that stand for a set."""
    return f"{int(items.sum(dtype=_U64)):016x}{int(mix64(items + _U64(0x5851F42D4C957F2D)).sum(dtype=_U64)):016x}"


def band_keys(marks: np.ndarray, rows: int) -> np.ndarray:
    """(n, bands): a key for each band of n signatures; texts meet in a bucket where all marks of a band are equal."""
    n, width = marks.shape
    turn = mix64(np.arange(101, 101 + rows, dtype=_U64)) | _U64(1)
    salt = mix64(np.arange(1, width // rows + 1, dtype=_U64))
    return mix64((marks.reshape(n, width // rows, rows).astype(_U64) * turn).sum(axis=2, dtype=_U64) ^ salt).view(np.int64)


def _sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, class (hash of the set), marks (the signature: a byte of each MinHash value)."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, mask = permutations(bands * rows)
        for part in parts:
            found = [shingle_set(data, width) for data in texts(part.column(1))]
            marks = [(signature(x, scale, mask) & np.uint32(255)).astype(np.uint8).tobytes() if len(x) else None for x in found]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([_class(x) if len(x) else None for x in found], pa.string()), pa.array(marks, pa.binary())], ["doc_id", "n_shingles", "class", "marks"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_shingles long, class string, marks binary")


def _entries(classes: DataFrame, rows: int) -> DataFrame:
    """(rep, key) for every band of every class."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                keys = band_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1), rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1])), pa.array(keys.reshape(-1))], ["rep", "key"])

    return classes.select("rep", "marks").mapInArrow(work, "rep long, key long")


def _plausible(pairs: DataFrame, classes: DataFrame, threshold: float, miss: float, step: int) -> DataFrame:
    """pairs (a, b) that batches of their signatures don't rule out, with the number of equal rows."""
    one = classes.select(F.col("rep").alias("a"), F.col("marks").alias("marks_a"), F.col("n_shingles").alias("n_a"))
    two = classes.select(F.col("rep").alias("b"), F.col("marks").alias("marks_b"), F.col("n_shingles").alias("n_b"))
    both = pairs.join(one, "a").join(two, "b")
    # Sets whose sizes differ too much can't reach the threshold.
    both = both.where(F.least("n_a", "n_b") >= F.lit(threshold - 1e-9) * F.greatest("n_a", "n_b"))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = part.num_rows
            left, right = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint8).reshape(n, -1) if n else np.empty((0, step), np.uint8) for i in (2, 3))
            alive, equal = np.arange(n), np.zeros(n, np.int64)
            for k in range(0, left.shape[1], step):
                upto = min(k + step, left.shape[1])
                equal[alive] += (left[alive, k:upto] == right[alive, k:upto]).sum(axis=1)
                alive = alive[equal[alive] >= least_matches(upto, threshold, miss)]
            picked = pa.array(alive)
            yield pa.RecordBatch.from_arrays([part.column(0).take(picked), part.column(1).take(picked), pa.array(equal[alive], pa.int64())], ["a", "b", "equal"])

    return both.select("a", "b", "marks_a", "marks_b").mapInArrow(work, "a long, b long, equal long")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, class, items): the shingle sets of the wanted documents (rep). The only step in which texts are shuffled."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [shingle_set(data, width) for data in texts(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([_class(x) for x in found], pa.string()), pa.array([x.tobytes() for x in found], pa.binary())], ["id", "class", "items"])

    rows = docs.select("doc_id", "text").join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    # Rows that repeat a document are read once; they already stand together.
    once = rows.groupBy("doc_id", F.xxhash64("text").alias("same")).agg(F.first("text").alias("text"))
    return once.select("doc_id", "text").mapInArrow(work, "id long, class string, items binary")


def _verified(pairs: DataFrame, sets: DataFrame, threshold_percent: int) -> DataFrame:
    """pairs (a, b) whose full shingle sets reach the threshold."""

    def check(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            good = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                one, two = np.frombuffer(x, _U64), np.frombuffer(y, _U64)
                common = len(one) + len(two) - len(np.union1d(one, two))
                good.append(100 * common >= threshold_percent * (len(one) + len(two) - common))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


class _Block:
    """Members of a bucket that one task compares: components, marks, band keys and shingle sets."""

    def __init__(self, key: int, members: list[tuple[int, bytes, bytes]], rows: int):
        marks = np.frombuffer(b"".join(m[1] for m in members), np.uint8).reshape(len(members), -1)
        keys = band_keys(marks, rows)
        here = np.flatnonzero((keys == key).any(axis=1))  # where a doc_id repeats, not all its texts are in each of its buckets
        self.component = np.array([m[0] for m in members], np.int64)[here]
        self.marks, self.keys = marks[here], keys[here]
        self.items = [np.frombuffer(members[k][2], _U64) for k in here]
        self.size = np.array([len(x) for x in self.items], np.int64)


def joining_links(key: int, left: _Block, right: _Block, threshold_percent: int, miss: float, step: int, cells: int = 1 << 18) -> list[tuple[int, int]]:
    """Pairs of components that links between the two blocks (or within one, if both are the same) join, as a forest.

    A pair of texts belongs to the first bucket that it shares. Of what batches
    of signatures don't rule out, the likeliest is checked first, and pairs
    whose components have been joined meanwhile are left out.
    """
    threshold, parent, out = threshold_percent / 100, {}, []

    def root(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    def common(i: int, js: np.ndarray) -> np.ndarray:
        """How many shingles text i of the left block shares with each of texts js of the right one."""
        body = np.concatenate([right.items[j] for j in js])
        own = left.items[i]
        hit = own[np.minimum(np.searchsorted(own, body), len(own) - 1)] == body
        return np.add.reduceat(hit, np.concatenate(([0], np.cumsum(right.size[js])[:-1])), dtype=np.int64)

    if not len(left.size) or not len(right.size):
        return out
    band = int(np.argmax(left.keys[0] == key))
    rows = max(1, cells // len(right.size))
    for at in range(0, len(left.size), rows):
        part = slice(at, at + rows)
        far = left.component[part, None] != right.component[None]
        small, large = np.minimum(left.size[part, None], right.size[None]), np.maximum(left.size[part, None], right.size[None])
        far &= 100 * small >= threshold_percent * large
        if left is right:
            far &= np.arange(at, min(at + rows, len(left.size)))[:, None] < np.arange(len(right.size))[None]
        for k in range(band):
            if not far.any():
                break
            far &= left.keys[part, k, None] != right.keys[None, :, k]
        i, j = np.nonzero(far)
        i += at
        equal = np.zeros(len(i), np.int64)
        for k in range(0, left.marks.shape[1], step):
            if not len(i):
                break
            upto = min(k + step, left.marks.shape[1])
            equal += (left.marks[i, k:upto] == right.marks[j, k:upto]).sum(axis=1)
            good = equal >= least_matches(upto, threshold, miss)
            i, j, equal = i[good], j[good], equal[good]
        for mine in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else ():
            own, js = i[mine[0]], j[mine][np.argsort(-equal[mine], kind="stable")]
            for take in (1, 8, len(js)):
                todo, js = js[:take], js[take:]
                todo = np.array([x for x in todo if root(int(right.component[x])) != root(int(left.component[own]))], np.int64)
                if len(todo):
                    n = common(own, todo)
                    for x in todo[100 * n >= threshold_percent * (left.size[own] + right.size[todo] - n)]:
                        a, b = root(int(left.component[own])), root(int(right.component[x]))
                        if a != b:
                            parent[max(a, b)] = min(a, b)
                            out.append((max(a, b), min(a, b)))
    return out


def _across(apart: DataFrame, classes: DataFrame, sets: DataFrame, threshold_percent: int, miss: float, step: int, rows: int, block: int = 1024, block_bytes: int = 8 << 20) -> DataFrame:
    """(a, b): components that a link between two members of one bucket joins.

    ``apart``: key, rep, component. A bucket's members are dealt over blocks
    of about ``block`` texts or ``block_bytes``; those of its largest component
    go to blocks of their own, which never meet each other. Every two other
    blocks meet in one task, so a large bucket is spread over many, and a task
    holds two blocks.
    """
    sized = apart.join(classes.select("rep", "class", "n_shingles"), "rep")
    weight = F.greatest(F.lit(1.0 / block), (F.col("n_shingles") * 8 + 1000) / F.lit(float(block_bytes)))
    parts = sized.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum(weight).alias("blocks"))
    best = F.struct("n", F.negative("component").alias("order"), "component", "blocks")
    shape = parts.groupBy("key").agg(F.max(best).alias("best"), F.sum("blocks").alias("all"))
    shape = shape.select("key", F.col("best.component").alias("top"), F.ceil("best.blocks").cast("int").alias("inner"), F.greatest(F.lit(1), F.ceil(F.col("all") - F.col("best.blocks"))).cast("int").alias("outer"), (F.col("all") <= 1.0).alias("whole"))
    placed = sized.join(shape, "key").withColumn("own", F.pmod(F.xxhash64("class"), F.when(F.col("component") == F.col("top"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    # Meetings (x, y) of outer blocks, x <= y, and of an outer block x with the inner block y, counted from outer on. A small bucket meets as a whole.
    inside = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda x: F.struct(x.alias("x"), (F.col("outer") + F.col("own")).alias("y"), F.lit(False).alias("left")))
    ahead = F.transform(F.sequence(F.lit(0), F.col("own")), lambda x: F.struct(x.alias("x"), F.col("own").alias("y"), (x == F.col("own")).alias("left")))
    behind = F.transform(F.sequence(F.col("own") + 1, F.col("outer") + F.col("inner") - 1), lambda y: F.struct(F.col("own").alias("x"), y.alias("y"), F.lit(True).alias("left")))
    alone = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(True).alias("left")))
    meetings = F.when(F.col("whole"), alone).when(F.col("component") == F.col("top"), inside).otherwise(F.concat(ahead, behind))
    meet = placed.select("class", "key", "component", F.explode(meetings).alias("m")).select("class", "key", "component", "m.x", "m.y", "m.left")
    full = meet.join(classes.select("class", "marks"), "class").join(sets.select("class", "items"), "class")
    full = full.select("key", "x", "y", "left", "component", "marks", "items").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sides = None, ([], [])

        def done() -> list[tuple[int, int]]:
            if held is None or not sides[0]:
                return []
            left = _Block(held[0], sides[0], rows)
            if held[1] == held[2]:
                return joining_links(held[0], left, left, threshold_percent, miss, step)
            return joining_links(held[0], left, _Block(held[0], sides[1], rows), threshold_percent, miss, step) if sides[1] else []

        for part in parts:
            out: list[tuple[int, int]] = []
            for key, x, y, first, *member in zip(*(part.column(k).to_pylist() for k in range(7)), strict=True):
                if (key, x, y) != held:
                    out.extend(done())
                    held, sides = (key, x, y), ([], [])
                sides[0 if first else 1].append(tuple(member))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done()], pa.int64()) for k in (0, 1)], ["a", "b"])

    return full.mapInArrow(work, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, width: int = 5, threshold_percent: int = 80, bands: int = 48, rows: int = 7, miss: float = 1e-6, step: int = 32) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the component of near-duplicates of each document.

    Documents are linked when their shingle sets have a Jaccard similarity of
    ``threshold_percent`` or more; component_id is the smallest doc_id that
    links reach, and kept is true for that document. With 48 bands of 7 rows a
    pair at exactly 0.8 meets in no bucket with probability 1e-5, one at 0.85
    with 2e-8.

    Texts without words, and null ones, have no shingles and are linked with
    nothing. Rows that repeat a doc_id are one document: the links of each hold
    for all. Rows without a doc_id are linked with nothing, have no component
    and are kept. Other columns are not carried; no rows give no rows.
    """
    threshold = threshold_percent / 100
    batches(docs.sparkSession)
    sketches = cut(_sketches(docs, width, bands, rows))
    known = sketches.where("class is not null and doc_id is not null")
    classes = cut(known.groupBy("class", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("marks").alias("marks")))
    # One class may hold a third of all rows; the join has one row for it on its right, so that adaptive execution can split it.
    placed = cut(sketches.select("doc_id", "n_shingles", "class").join(classes.select("class", "rep"), "class", "left").select("doc_id", "n_shingles", "rep"))

    # Buckets that several classes share. Each bucket is centred on its member with the most company over all buckets: in a group of
    # copies that is the text that most of them are close to.
    entries = _entries(classes, rows)
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(entries.join(shared, "key"))
    company = members.groupBy("rep").agg(F.sum("n").alias("company"))
    sets = cut(_sets(docs, company, width))
    ranked = members.select("key", "rep").join(company, "rep")
    centres = ranked.groupBy("key").agg(F.max(F.struct("company", "rep")).alias("centre"))
    # Each member is first compared with the centre of most company among its buckets; what that leaves apart is compared below.
    pairs = members.join(centres, "key").groupBy(F.col("rep").alias("a")).agg(F.max(F.when(F.col("rep") != F.col("centre.rep"), F.col("centre"))).alias("centre"))
    first = cut(_plausible(pairs.where("centre is not null").select("a", F.col("centre.rep").alias("b")), classes, threshold, miss, step))
    several = placed.where("rep is not null and doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("top"), F.collect_set("rep").alias("reps"))
    split = several.where("b < top").select(F.explode("reps").alias("a"), "b").where("a <> b")
    components = cut(connected_components(_verified(first, sets, threshold_percent).union(split), src="a", dst="b"))

    divided = members.join(components, members.rep == components.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = divided.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    apart = cut(divided.join(mixed, "key").distinct())
    joined = cut(_across(apart, classes, sets, threshold_percent, miss, step, rows))
    moved = connected_components(joined, src="a", dst="b").select(F.col("node").alias("component"), F.col("component").alias("least"))  # few: components that have been joined

    found = placed.join(components, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).join(moved, "component", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("least", "component", "doc_id"), F.col("doc_id")))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that :func:`near_duplicates` does not keep: one document of each group stays, with all its columns."""
    gone = near_duplicates(docs, **options).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

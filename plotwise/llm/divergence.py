"""How the sources of a language differ in their use of words.

Each group, a source within a language, gives every kept term of the language
the probability ``p = 1 + floor(10**9 * (count + 2) / (N + 2 V))``; the
divergence of two groups is the sum of ``floor((p - q)**2 / (p + q))`` over all
kept terms. All arithmetic is on whole numbers.

That sum needs no look at single terms: a term's share depends on nothing but
its two counts. So for every group and count there is a bitmap of the terms
that have this count there, and for two groups the terms that have count c here
and d there are the bits that two bitmaps share. Terms that a group hasn't got
are what the bitmaps leave over.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import ensure_checkpoint_dir
from .text import batches, texts

# The scale of a probability, what is added to each count.
SCALE, ADDED = 1_000_000_000, 2

#: Bytes as they stand in terms: A-Z lower-cased, what isn't part of a term made a space.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order: runs of letters A-Z, lower-cased, and of characters beyond ASCII."""
    return text.translate(_TERM).split()


def count_terms(docs: DataFrame, *, held: int = 400_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and rows of docs that have it.

    Null texts, langs and sources are read as ''. Repeated rows count each.
    Counts are combined in each task, for up to ``held`` terms at once, before
    they are shuffled.
    """
    batches(docs.sparkSession)

    def drain(counts: dict, seen: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            rows = seen[lang, source]
            columns = [pa.array([lang] * len(found), pa.string()), pa.array([source] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.int64()), pa.array([rows[t] for t in found], pa.int64())], ["lang", "source", "term", "n", "docs"])
        counts.clear(), seen.clear()

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = defaultdict(Counter)
        seen: dict = defaultdict(Counter)
        for part in parts:
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts(part.column(2)), strict=True):
                words = terms_of(text.tobytes())
                counts[lang, source].update(words)
                seen[lang, source].update(set(words))
            if sum(map(len, counts.values())) > held:
                yield from drain(counts, seen)
        yield from drain(counts, seen)

    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text"))
    partial = read.mapInArrow(work, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counted: DataFrame, *, min_docs: int = 10) -> DataFrame:
    """(lang, source, term, n, n_lang, first) of the terms that ``min_docs`` rows of a language have at least; first marks one row for each term of a language."""
    of_term = Window.partitionBy("lang", "term")
    both = counted.withColumns({"__d": F.sum("docs").over(of_term), "n_lang": F.sum("n").over(of_term), "first": F.min("source").over(of_term) == F.col("source")})
    return both.where(F.col("__d") >= min_docs).select("lang", "source", "term", "n", "n_lang", "first")


def probability(n: Column, total: Column) -> Column:
    """1 + floor(10**9 * (n + 2) / total) by long division to base 1,000, so that no product leaves 64 bits up to totals of 9 * 10**15; total is n + 2 at least."""
    rest, out = n + ADDED, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, total)
        rest = rest * 1000 % total
    return out + 1


def _levels(rows: pd.DataFrame) -> list[tuple]:
    """For each group of a block: name, batch, p of each count (that of 0 first), bitmaps as sorted (count index, word, bits), number of terms with each count."""
    out = []
    for r in rows.itertuples(index=False):
        count, word, bits = (np.asarray(x, np.int64) for x in (r.counts, r.words, r.bits)) if r.counts is not None else (np.empty(0, np.int64),) * 3
        levels, at = np.unique(count, return_inverse=True)
        order = np.lexsort((word, at))
        at, word, bits = at[order], word[order], bits[order].view(np.uint64)
        total = int(r.n_group) + 2 * int(r.n_terms)
        p = np.array([1 + SCALE * (c + ADDED) // total if total else 0 for c in (0, *levels.tolist())], np.int64)
        sizes = np.bincount(at, np.bitwise_count(bits), len(levels)).astype(np.int64)
        out.append((r.source, r.batch, p, at, word, bits, sizes))
    return out


def _joint(a: tuple, b: tuple, dense: np.ndarray, width: int) -> int:
    """The share of one block in the divergence of two groups; ``dense`` has the bitmaps of b as rows."""
    p, at, word, bits, sizes = a[2:]
    q, other = b[2], b[6]
    cells = np.zeros((len(p), len(q)), np.int64)
    if len(bits) and len(other):
        shared = np.bitwise_count(dense[:, word] & bits).astype(np.int64)  # rows: counts of b; columns: words of the bitmaps of a
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        cells[1:, 1:] = np.add.reduceat(shared, starts, axis=1).T
    cells[1:, 0] = sizes - cells[1:, 1:].sum(axis=1)
    cells[0, 1:] = other - cells[1:, 1:].sum(axis=0)
    cells[0, 0] = width - cells.sum()
    gap = p[:, None] - q[None, :]
    return int((cells * (gap * gap // np.maximum(p[:, None] + q[None, :], 1))).sum())


def _block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """What one block of terms adds to the divergence of each pair of two batches of groups, in both directions."""
    lang, _, low, high = key
    width = int(rows.width.iloc[0])
    groups = _levels(rows)
    out = []
    for k, b in enumerate(groups):
        dense = np.zeros((len(b[6]), (width + 63) // 64), np.uint64)
        dense[b[3], b[4]] = b[5]
        for a in groups[:k]:
            if low == high or a[1] != b[1]:
                value = _joint(a, b, dense, width)
                out += [(lang, a[0], b[0], value), (lang, b[0], a[0], value)]
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def audit(docs: DataFrame, *, min_docs: int = 10, top: int = 10, width: int = 8192, batch: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its divergence from every other source of its language, and its ``top`` terms.

    Part ``pair`` has a row for each other source, part ``term`` the terms that
    the group uses more than its language, by what they add to the divergence
    from it; ranks go by value, then by item. Null texts, langs and sources are
    read as ''. A group without terms has zero counts; without kept terms all
    divergences are 0; a lone source has no pairs. Empty tables give no rows.
    Repeated rows count each; other columns don't matter.

    Terms are dealt over blocks of about ``width`` and groups over batches of
    about ``batch``, so a task holds the bitmaps of two batches for one block,
    however many terms and sources there are.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/divergence-{uuid.uuid4().hex}"
    kept_terms(count_terms(docs), min_docs=min_docs).write.parquet(folder)
    kept = spark.read.parquet(folder)
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    of_lang = kept.groupBy("lang").agg(F.count_if("first").alias("n_terms"), F.sum("n").alias("n_lang_all"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = named.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["n_group", "n_terms", "n_lang_all"])
    sizes = groups.groupBy("lang").agg(F.count("*").alias("s"), F.max("n_terms").alias("v")).agg(F.max("s").alias("s"), F.max("v").alias("v")).first()
    n_blocks, n_batches = -(-(sizes.v or 1) // width), -(-(sizes.s or 1) // batch)

    # Bitmaps: a term's place in its block, 64 places a word, one word for each count.
    placed = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(n_blocks)).cast("int")).repartition("lang", "block")
    placed = placed.withColumn("place", F.dense_rank().over(Window.partitionBy("lang", "block").orderBy("term")) - 1)
    placed = placed.withColumns({"word": F.floor(F.col("place") / 64).cast("int"), "bit": F.expr("shiftleft(1L, cast(place % 64 as int))")})
    maps = placed.groupBy("lang", "block", "source", "n", "word").agg(F.bit_or("bit").alias("bits"))
    maps = maps.groupBy("lang", "block", "source").agg(F.collect_list(F.struct("n", "word", "bits")).alias("m")).select("lang", "block", "source", F.col("m.n").alias("counts"), F.col("m.word").alias("words"), F.col("m.bits").alias("bits"))
    blocks = kept.where("first").groupBy("lang", F.pmod(F.xxhash64("term"), F.lit(n_blocks)).cast("int").alias("block")).agg(F.count("*").alias("width"))
    # Groups without a term of a block take part in it with zeros only.
    every = groups.join(blocks, "lang", "left").fillna(0, ["width"]).fillna(0, ["block"]).join(maps, ["lang", "block", "source"], "left")
    own = F.pmod(F.xxhash64("source"), F.lit(n_batches)).cast("int")
    dealt = every.withColumn("batch", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1)))).withColumns({"low": F.least("batch", "other"), "high": F.greatest("batch", "other")})
    shares = dealt.select("lang", "block", "low", "high", "source", "batch", "n_group", "n_terms", "width", "counts", "words", "bits").groupBy("lang", "block", "low", "high").applyInPandas(_block, "lang string, source string, item string, value long")
    pairs = shares.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    used = kept.join(groups, ["lang", "source"])
    used = used.withColumns({"p": probability(F.col("n"), F.col("n_group") + 2 * F.col("n_terms")), "q": probability(F.col("n_lang"), F.col("n_lang_all") + 2 * F.col("n_terms"))}).where("p > q")
    used = used.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"), F.lit("term").alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    both = pairs.withColumn("rank", rank).unionByName(used.withColumn("rank", rank).where(F.col("rank") <= top))
    return both.select("lang", "source", "part", "item", "value", "rank")

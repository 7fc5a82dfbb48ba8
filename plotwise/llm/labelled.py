"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_is(doc_id: Column, divisor: int, remainder: int) -> Column:
    """Whether crc32 of the doc_id as text leaves that remainder; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor)) == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, rows: int) -> DataFrame:
    """(doc_id, text, label): at most ``rows`` labelled documents outside ``held_out``, picked by a hash of doc_id.

    Only this many ids are ever broadcast, so the texts aren't shuffled. Null
    labels and doc_ids don't count; of several labels of a document the larger
    holds, and of several rows of a document the one with the least text, null
    first, so that the bound holds for rows however often a doc_id repeats.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min(F.struct("text")).alias("m")).select("doc_id", "m.text", "label")

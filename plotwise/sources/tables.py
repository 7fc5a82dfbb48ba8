"""Reading, writing and shaping source tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clean import SECTORS
from ..operators.relate import with_places


def read_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header, every column as text, to be cast afterwards; no pass over the data to guess types."""
    return spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)


def drop_placeholders(df: DataFrame, column: str, placeholders: Iterable[str], index: str = "Unnamed: 0") -> DataFrame:
    """df without an unnamed index column and without rows that hold a placeholder."""
    return df.drop(index).where(~F.col(column).isin(*placeholders))


def write(df: DataFrame, path: str, *, form: str = "parquet", partition_by: list[str] = ()) -> None:
    """Replace what is at path, as parquet or as CSV with a header."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def write_layers(layers: dict[str, DataFrame], folder: str) -> None:
    """One parquet dataset for each layer, replacing what is there."""
    for name, df in layers.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def replace_table(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def box_prefix_scan(df: DataFrame, box: dict[str, tuple[float, float]], code: str | None = None, prefixes: Iterable[str] = ()) -> DataFrame:
    """Rows inside the bounds whose code begins with one of the prefixes, as comparisons that reach the scan."""
    for column, (low, high) in box.items():
        df = df.where(F.col(column).between(low, high))
    if code is not None:
        test = F.lit(False)
        for p in prefixes:
            test = test | F.col(code).startswith(p)
        df = df.where(test)
    return df


def by_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(keys.select(key), key, "left_semi")


def upper_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def request_batches(df: DataFrame, column: str, size: int = 100) -> DataFrame:
    """(batch, items): distinct values in ascending order, in lists of ``size``.

    Values are placed by ranges, so no task sorts all of them.
    """
    placed = with_places(df.select(F.col(column).alias("v")).where("v is not null").distinct(), [F.col("v").asc()], "at")
    batches = placed.select(F.floor(F.col("at") / size).alias("batch"), F.struct("at", "v").alias("item")).groupBy("batch").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return batches.select("batch", F.col("items.v").alias("items"))


def profile(df: DataFrame, *, key: str, date: str, column: str) -> DataFrame:
    """One row: rows, columns, distinct keys, first and last date, share of nulls in a column."""
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.count_distinct(key).alias("n_keys"), F.min(date).cast("date").alias("first_date"), F.max(date).cast("date").alias("last_date"), (1 - F.count(column) / F.count("*")).alias("null_share"))


def read_json_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each item of the batchItems lists of all response files."""
    return spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("batchItems").alias("item"))


def flatten_responses(items: DataFrame) -> DataFrame:
    """Results of items without an error, of type POI: the fields of address and poi, and the position, as columns."""
    fields = {f.name for f in items.schema["item"].dataType.fields}
    good = items.where(F.col("item.error").isNull()) if "error" in fields else items
    results = good.select(F.explode("item.response.results").alias("r")).where("r.type = 'POI'")
    return results.select("r.address.*", "r.poi.*", F.col("r.position.lon").alias("x"), F.col("r.position.lat").alias("y"))


def parsed(df: DataFrame, column: str, schema: str) -> DataFrame:
    return df.withColumn(column, F.from_json(column, schema))


def canonical(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """df with variants replaced; ``mapping``: variant, canonical, a short list of rules with unique variants."""
    return df.join(mapping.withColumnsRenamed({"variant": "__v", "canonical": "__c"}), F.col(column) == F.col("__v"), "left").withColumn(column, F.coalesce("__c", column)).drop("__v", "__c")


def fill_where_null(df: DataFrame, values: DataFrame, key: str, *, test: str, columns: list[str]) -> DataFrame:
    """df where rows without ``test`` take all ``columns`` from ``values`` (unique by key)."""
    renamed = values.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = df.join(renamed, key, "left")
    empty = F.col(test).isNull()
    filled = {c: F.when(empty, F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(filled).drop(*[f"__{c}" for c in columns])


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the first in an order that the caller states."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def with_sector(df: DataFrame, code: str) -> DataFrame:
    """df with the sector of each code and its column prefix, all sectors in one pass; codes of no sector go."""
    rows = [(p, name, prefix) for name, prefix, codes in SECTORS for p in codes]
    dim = df.sparkSession.createDataFrame(rows, "__p string, sector string, sector_prefix string")
    return df.join(F.broadcast(dim), F.substring(code, 1, 2) == F.col("__p")).drop("__p")


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """df without the columns whose name matches from its start."""
    return df.drop(*[c for c in df.columns if re.match(pattern, c)])


def impute_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with nulls of the columns replaced by their mean, from one pass for all."""
    means = df.agg(*[F.avg(c).alias(f"__{c}") for c in columns])
    return df.crossJoin(means).withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def with_membership(df: DataFrame, key: str, members: DataFrame, flag: str) -> DataFrame:
    """df with whether its key is among the members' keys."""
    known = members.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(known, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))

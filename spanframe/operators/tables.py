"""Small operators on whole tables: what is left to do, first and newest rows, numbers and offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.sources.shared import once


def unfinished(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not done."""
    return rows.join(done.select(key), key, "left_anti")


def incomplete(files: DataFrame, outputs: DataFrame, key: str, kind: str, n_kinds: int) -> DataFrame:
    """The files that lack an output of some kind: only those with all of them are left out."""
    whole = outputs.groupBy(key).agg(F.count_distinct(kind).alias("__n")).where(F.col("__n") == n_kinds)
    return files.join(whole.select(key), key, "left_anti")


def first_of_equal(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """For each distinct value of `by`, its first place in the order."""
    return rows.groupBy(*by).agg(F.min(order).alias(order))


def newest(rows: DataFrame, by: list[str], time: list[str], n: int) -> DataFrame:
    """The n latest rows of each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*map(F.desc, time)))
    return rows.withColumn("__n", place).where(F.col("__n") <= n).drop("__n")


def ordinals(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their number from 0 within each group."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("bigint"))


def offsets(rows: DataFrame, by: list[str], order: list[str], length: str, name: str) -> DataFrame:
    """rows with where each begins if they follow one another: the sum of all lengths before it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(length).over(w) - F.col(length))


def replaced(rows: DataFrame, parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """rows without the parents, and with the children in their place."""
    return rows.join(parents.select(key), key, "left_anti").unionByName(children)


def speaker_counts(turns: DataFrame, by: list[str]) -> DataFrame:
    """Per group: distinct speakers and turns."""
    return turns.groupBy(*by).agg(F.count_distinct("speaker").alias("speakers"), F.count(F.lit(1)).alias("turns"))


def ranked(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with their number from 0 in the order of a key, over the whole table: ranges of the key are numbered each for itself, behind those before them."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    parted = once(rows.repartitionByRange(n, key).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = parted.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # a row for each range
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1
    return parted.join(starts, "__p").withColumn(name, (F.col("__before") + place).cast("bigint")).drop("__p", "__before")

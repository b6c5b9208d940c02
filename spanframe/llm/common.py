"""Pieces shared by the corpus operators: word splitting, let-binding, tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls 0x09 to 0x0D.
BLANKS = r"[\x20\x09-\x0D]+"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_own_dirs: dict[str, str] = {}
_tables: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, a folder of our own in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="spanframe-")
        base = _own_dirs[app]
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def bounded_batches(spark: SparkSession, size: str = "1MB") -> Iterator[None]:
    """Bounds Arrow batches by bytes while an action runs, as the default counts rows and texts may be long."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, readable after executors are lost.

    Arrow batches are bounded meanwhile. release() deletes the table.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    with bounded_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of whatever file system Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def mark() -> int:
    """For release(): the tables written from now on."""
    return len(_tables)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables written since mark() gave `since`, but for the last `keep`, once nothing lazy reads them."""
    upto = len(_tables) - keep
    for path in _tables[since:upto]:
        remove(spark, path)
    del _tables[since:upto]


def forget(spark: SparkSession) -> None:
    """Deletes the table written before the last one, from which that was made and which nothing else reads."""
    remove(spark, _tables.pop(-2))


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row (a lambda variable can't be inlined twice)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def unit_hash(seed: int, *cols: Column) -> Column:
    """A double in (0, 1) from a seeded hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / float(1 << 53)

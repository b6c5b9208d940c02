"""The folder that the driver and all executors share, and tables kept there while they are used several times."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds Arrow batches by bytes, as the default counts rows and texts may be long.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_own: dict[str, str] = {}


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path not used yet below spark.checkpoint.dir; where that is unset, a folder of this machine in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spanframe-")
        base = _own[app]
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def once(df: DataFrame, tag: str = "kept") -> DataFrame:
    """df computed once, as a table in the shared folder: what reads it several times computes nothing again, and lost executors lose nothing."""
    path = new_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)  # two thirds of what texts take by default
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def short_plans(spark: SparkSession, most: str = "20000") -> Iterator[None]:
    """Bounds what the driver tells its listeners of a plan, as it tells all of it again after each stage."""
    key = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shares(spark: SparkSession) -> int:
    """In how many parts rows are dealt that lie by a key from then on."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def once_by(df: DataFrame, key: str, tag: str = "kept") -> DataFrame:
    """df computed once, as once() does, in buckets of a key: windows, groups and joins by it then send no rows.

    Rows that lie by the key in shares() parts make a file a bucket; others make some more of them.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag)
    name = posixpath.basename(path).replace("-", "_")
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(shares(spark), key).saveAsTable(name)
    kept = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files are no table's own, so they stay
    return kept.select(*[F.col(c).alias(c) for c in kept.columns])  # columns that bear the table's name lose their buckets in a union

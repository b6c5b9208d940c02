"""Resumable batches: what a stream brings is kept once, by key, and a restart goes on where it ended.

The log is a table: a folder of Parquet files. Every batch of a query has names of its own in it and,
once all its files are in their places, a mark; files without one don't count yet. A batch that is
run again after a crash replaces its own files, so nothing comes twice; what another query, or this
one before its checkpoint was lost, has kept is looked up by key. A last table, `_final`, closes the
log: from then on it is all that is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


class Folder:
    """A folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.at = lambda *names: spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((path.rstrip("/"), *names)))
        self.fs = self.at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, pattern: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.globStatus(self.at(pattern)) or [])

    def remove(self, pattern: str) -> None:
        for name in self.names(pattern):
            self.fs.delete(self.at(name), True)


def kept(spark: SparkSession, path: str, schema: StructType, but: str | None = None) -> DataFrame:
    """The rows of all whole batches, but for those of one."""
    folder = Folder(spark, path)
    done = {n.removeprefix("_done-") for n in folder.names("_done-*")} - {but}
    files = [f"{path.rstrip('/')}/{n}" for n in folder.names("*.parquet") if n.rpartition("-")[0] in done]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def keep_new(batch: DataFrame, epoch: int, path: str, key: list[str]) -> None:
    """Keeps the rows of a batch whose key no other batch has; of rows with equal keys one. A null is a key like any other."""
    spark, folder = batch.sparkSession, Folder(batch.sparkSession, path)
    own = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId') or 'alone'}-{epoch}"
    known = kept(spark, path, batch.schema, own).select(*[F.col(k).alias(f"__{k}") for k in key])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    staged = f"_stage-{own}"
    batch.dropDuplicates(key).join(known, same, "left_anti").write.mode("overwrite").parquet(f"{path}/{staged}")
    folder.remove(f"_done-{own}")
    folder.remove(f"{own}-*.parquet")
    for i, name in enumerate(folder.names(f"{staged}/*.parquet")):
        folder.fs.rename(folder.at(staged, name), folder.at(f"{own}-{i}.parquet"))
    folder.fs.create(folder.at(f"_done-{own}")).close()
    folder.remove(staged)


def resume(stream: DataFrame, path: str, key: str | list[str], checkpoint: str) -> StreamingQuery:
    """Runs over all that has come since the last run, then ends. The log is read by restored()."""
    keys = [key] if isinstance(key, str) else key
    return stream.writeStream.foreachBatch(lambda batch, epoch: keep_new(batch, epoch, path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def close(results: DataFrame, path: str) -> None:
    """Writes what the log has come to."""
    results.write.mode("overwrite").parquet(f"{path}/_final")


def restored(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, bool]:
    """What the log has come to and True, if it is closed; else the rows kept so far and False."""
    if Folder(spark, path).names("_final/_SUCCESS"):
        return spark.read.parquet(f"{path}/_final"), True
    return kept(spark, path, schema), False

"""The data source `whole_files`: each row of a table is written as a file of its own, all of them or none.

Tasks write below a folder of the job's own; the commit moves files to their places, an abort
deletes the folder. So what failed or speculative tasks have written is never seen.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from spanframe.sources.audio import store


#: How often a folder that is still written to is tried to be deleted.
TRIES = 25


#: The list that a task keeps of its files, beside them: names in the order of their numbers, and those of files that are to go.
LIST, LISTED = "names", pa.schema([("name", pa.string()), ("gone", pa.bool_())])
#: Files are read in batches of about so many bytes.
BATCH = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    """Where a task has put its files and the list of them, which the driver only reads a batch at a time."""

    folder: str


def checked(name: str | None) -> str:
    """A name below the folder, else an error."""
    plain = posixpath.normpath(name or "")
    if not name or plain.startswith(("/", "..")) or plain == ".":
        raise ValueError(f"not a name of a file below the folder: {name!r}")
    return plain


def listed(path: str) -> Iterator[tuple[str, bool]]:
    """The names of a list, and whether they are of files that are to go."""
    fs, inner = store(path)
    with fs.open_input_stream(inner) as source, pa.ipc.open_stream(source) as batches:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def twice(names: Callable[[], Iterator[str]]) -> str | None:
    """A name that comes twice. Eight bytes are held for each, and whole only those whose hashes are alike."""
    hashes = np.sort(np.fromiter((hash(n) for n in names()), np.int64))
    alike = set(hashes[1:][hashes[1:] == hashes[:-1]].tolist())
    seen: set[str] = set()
    for n in names() if alike else ():
        if hash(n) in alike:
            if n in seen:
                return n
            seen.add(n)
    return None


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, lists: str | None = None):
        """On the driver, before any task. Tasks write below the job's folder but don't make it, so that one that outlives an abort can't bring it back."""
        self.folder, self.lists, self.staged = folder.rstrip("/"), lists, f"{folder.rstrip('/')}/_job-{uuid.uuid4().hex}"
        fs, staged = store(self.staged)
        fs.create_dir(staged, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, staged = store(self.staged)
        own, at = uuid.uuid4().hex, 0
        fs.create_dir(f"{staged}/{own}", recursive=False)
        with fs.open_output_stream(f"{staged}/{own}/{LIST}") as sink, pa.ipc.new_stream(sink, LISTED) as lists:
            for batch in batches:
                names, gone = [checked(n) for n in batch.column(0).to_pylist()], [not content.is_valid for content in batch.column(1)]
                for content in batch.column(1):
                    if content.is_valid:
                        with fs.open_output_stream(f"{staged}/{own}/{at}") as out:
                            out.write(content.as_buffer())
                        at += 1
                lists.write_batch(pa.record_batch([names, gone], schema=LISTED))
        return Written(f"{self.staged}/{own}")

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = store(self.folder)
        done = [m.folder for m in messages if m is not None]
        if (name := twice(lambda: (n for own in done for n, _ in listed(f"{own}/{LIST}")))) is not None:
            raise ValueError(f"several rows name one file, as {name!r}")
        fs.create_dir(folder, recursive=True)
        made = folder
        for own in done:
            i, inner = 0, store(own)[1]
            for name, gone in listed(f"{own}/{LIST}"):
                if not gone:
                    if (there := posixpath.dirname(f"{folder}/{name}")) != made:
                        fs.create_dir(there, recursive=True)
                        made = there
                    fs.move(f"{inner}/{i}", f"{folder}/{name}")
                    i += 1
                elif fs.get_file_info(f"{folder}/{name}").type != stores.FileType.NotFound:
                    fs.delete_file(f"{folder}/{name}")
            if i and self.lists:
                there = store(self.lists)[1]
                fs.create_dir(there, recursive=True)
                fs.move(f"{inner}/{LIST}", f"{there}/{posixpath.basename(own)}")
        self.clear()

    def abort(self, messages) -> None:
        self.clear()

    def clear(self) -> None:
        """Deletes the job's folder; tasks that are being ended may still write to it, so this is tried again."""
        fs, staged = store(self.staged)
        for left in range(TRIES, -1, -1):
            if fs.get_file_info(staged).type == stores.FileType.NotFound:
                return
            try:
                fs.delete_dir(staged)
            except OSError:
                if not left:
                    raise
                time.sleep(0.2)


@dataclass
class Some(InputPartition):
    """The files of one list."""

    path: str


class FilesReader(DataSourceReader):
    def __init__(self, folder: str, lists: str):
        self.folder, self.lists = folder.rstrip("/"), lists.rstrip("/")

    def partitions(self) -> list[Some]:
        fs, lists = store(self.lists)
        return [Some(f"{self.lists}/{f.base_name}") for f in fs.get_file_info(stores.FileSelector(lists, allow_not_found=True))]

    def read(self, some: Some | None) -> Iterator[pa.RecordBatch]:
        fs, folder = store(self.folder)
        names, contents, size = [], [], 0
        batch = lambda: pa.record_batch([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["name", "content"])
        for name, gone in listed(some.path) if some else ():  # none where no file was written
            if gone:
                continue
            with fs.open_input_stream(f"{folder}/{name}") as source:
                contents.append(source.read())
            names.append(name)
            size += len(contents[-1])
            if size >= BATCH:
                yield batch()
                names, contents, size = [], [], 0
        yield batch()


class WholeFiles(DataSource):
    """Options: folder (a path or URI that the driver and all executors share); lists (another, for what was written, by which it can be read again). Columns: name, content (text or bytes; null: the file is to go)."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, content binary"

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options["folder"], self.options["lists"])

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["folder"], self.options.get("lists"))


def write_files(df: DataFrame, folder: str, name: Column | str = "name", content: Column | str = "content", lists: str | None = None) -> None:
    """Writes each row's content as folder/name; a file already there is replaced, or goes if the content is null.

    Two rows of one name end the job, as does a name that leads out of the folder; then nothing is changed.
    A new folder `lists` in the same store gets the lists of what was written, for read_files().
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    df.sparkSession.dataSource.register(WholeFiles)
    out = df.select(col(name).cast("string").alias("name"), col(content).alias("content")).write.format("whole_files").mode("append").option("folder", folder)
    (out.option("lists", lists) if lists else out).save()


def read_files(spark: SparkSession, folder: str, lists: str) -> DataFrame:
    """name, content (bytes) of the files that write_files() has listed. Tasks go by the lists, so the driver never holds all names."""
    spark.dataSource.register(WholeFiles)
    return spark.read.format("whole_files").option("folder", folder).option("lists", lists).load()

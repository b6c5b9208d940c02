"""Removal of word windows that repeat, with a log-structured fingerprint index.

Fingerprints: of the 10-word runs in each 35-word window the one with the least hash stands
for the window (equal windows choose alike), so about one word in thirteen gives a fingerprint.
Texts are dealt into blocks, written once, bucketed by block, so that no later pass shuffles them;
each block's fingerprints are cut by hash into buckets and packed sorted.

WindowIndex holds sorted immutable runs of such fingerprints, one a batch, with a mark for those
met before. add() merge-joins a batch with the runs so far, bucket by bucket, and writes its run;
beyond `fanout` runs, compact() merges them; a manifest in the index's folder names the runs
and the batches' texts, so that an index is opened again later and further batches are checked
against all history. repeated() merge-joins fingerprints with the runs and answers with one bit for each.

Windows whose fingerprint repeats are then verified: a hash of all 35 words of 128 bits, two halves
made of two hashes of each word, must itself start at two places (by chance, two of 10^13 windows
agree in it once in 10^12 corpora). What is sent for that is again packed by block and bucket, and
answered by bits. A block holds about 4 MB of text, a bucket's share is some MB whatever the size of
the corpus, and a block sends each hash once, so a passage that many documents share puts no more than
its blocks together. A document's block follows from its place in the table, not its text, so
that equal texts lie in as many blocks as any others.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm import tokens
from spanframe.llm.common import bounded_batches, remove, shared_path, written

LENGTH, GRAM = 35, 10
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 32 << 20
#: Bytes of text in a file of dealt blocks, and such files at most.
FILE_BYTES, MOST_FILES = 16 << 20, 100_000
PACKED = "bucket int, blk long, prints binary, twice binary"
WIDE = np.dtype("S16")  # a hash of 128 bits, ordered by its bytes


def sliding(a: np.ndarray, n: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) of the n values from each place on."""
    out, width = a, 1
    while width * 2 <= n:
        out = f(out[:-width], out[width:])
        width *= 2
    return f(out[: len(out) - (n - width)], out[n - width :]) if n > width else out


class Block:
    """The hashes of a block of texts."""

    def __init__(self, texts):
        self.texts, self.words = texts, tokens.Words(texts)
        self.hashes, self.counts = self.words.hashes(), self.words.counts
        n = len(self.hashes)
        ends = np.repeat(np.cumsum(self.counts), self.counts)
        self.starts = np.flatnonzero(np.arange(n) + LENGTH <= ends)  # of windows
        self.least = self.chosen = np.zeros(0, np.uint64)
        if len(self.starts):
            grams = tokens.runs(self.hashes, GRAM)
            span = LENGTH - GRAM + 1
            least = sliding(grams, span, np.minimum)
            self.least = least[self.starts]
            valid = np.zeros(len(least), np.uint64)
            valid[self.starts] = self.least
            # A run is chosen if it is the least of any window that holds it.
            top = sliding(np.concatenate([np.zeros(span - 1, np.uint64), valid, np.zeros(span - 1, np.uint64)]), span, np.maximum)
            self.chosen = grams[grams == top[: len(grams)]]

    def wholes(self, which: np.ndarray) -> np.ndarray:
        """Hashes of all words of the windows at self.starts[which], of 128 bits."""
        out = np.empty((int(which.sum()) if which.dtype == bool else len(which), 2), ">u8")
        if len(out):
            out[:, 0] = tokens.runs(tokens.splitmix(self.hashes), LENGTH)[self.starts[which]]
            out[:, 1] = tokens.runs(self.second_hashes(self.starts[which]), LENGTH)[self.starts[which]]
        return out.view(WIDE).ravel()

    def second_hashes(self, starts: np.ndarray) -> np.ndarray:
        """Hashes by another seed of the words that the windows cover; others have 0."""
        covered = in_windows(starts, len(self.hashes))
        out = np.zeros(len(self.hashes), np.uint64)
        out[covered] = self.words.hashes(1, covered)
        return out


def in_windows(starts: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n words lies in a window that begins at one of the places."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, from its high 32 bits: in the order of the hashes."""
    high = values >> np.uint64(32) if values.dtype == np.uint64 else np.frombuffer(values.tobytes(), ">u4")[::4].astype(np.uint64)
    return (high * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packed(blk: int, hashes: np.ndarray, buckets: int) -> pd.DataFrame:
    """One row for each bucket with some of the hashes: sorted, once each, marked if met twice."""
    values, n = np.unique(hashes, return_counts=True)
    bucket = bucket_of(values, buckets)
    cuts = _stretches(bucket)
    return pd.DataFrame({"bucket": np.array([bucket[a] for a, _ in cuts], np.int32), "blk": np.int64(blk), "prints": [values[a:b].tobytes() for a, b in cuts], "twice": [(n[a:b] > 1).tobytes() for a, b in cuts]}, columns=["bucket", "blk", "prints", "twice"])


def _stretches(x: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(x)) + 1
    return list(zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(x)]]).tolist())) if len(x) else []


def merged(rows: pd.DataFrame, kind=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all rows, sorted and once each, with the mark of those met twice."""
    values = np.concatenate([np.frombuffer(x, kind) for x in rows["prints"]]) if len(rows) else np.zeros(0, kind)
    marks = np.concatenate([np.frombuffer(x, bool) for x in rows["twice"]]) if len(rows) else np.zeros(0, bool)
    out, where, n = np.unique(values, return_inverse=True, return_counts=True)
    return out, (n > 1) | (np.bincount(where, weights=marks, minlength=len(out)) > 0)


def among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each of x is one of the sorted values."""
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def answer(rows: pd.DataFrame, values: np.ndarray) -> pd.DataFrame:
    """A bit for each hash of each row: whether it is one of the values; rows without such go."""
    blk, bucket, bits = [], [], []
    for i, b, x in zip(rows["blk"], rows["bucket"], rows["prints"]):
        yes = among(np.frombuffer(x, values.dtype), values)
        if yes.any():
            blk.append(i)
            bucket.append(b)
            bits.append(np.packbits(yes).tobytes())
    return pd.DataFrame({"blk": np.array(blk, np.int64), "bucket": np.array(bucket, np.int32), "bits": bits})


def marked(hashes: np.ndarray, replies: pd.DataFrame, buckets: int) -> np.ndarray:
    """Those of a block's hashes, sorted, that the replies to packed() mark."""
    values = np.unique(hashes)
    bucket = bucket_of(values, buckets)
    keep = np.zeros(len(values), bool)
    by = dict(zip(replies["bucket"], replies["bits"]))
    for a, b in _stretches(bucket):
        if (bits := by.get(int(bucket[a]))) is not None:
            keep[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return values[keep]


class Dealt:
    """A batch's texts in a table (key, text, blk) of the shared folder, bucketed by block: read by block without a shuffle."""

    def __init__(self, spark: SparkSession, path: str, files: int, kind: str):
        self.path, self.files, self.kind = path, files, kind
        name = f"dealt_{uuid.uuid4().hex}"
        # The catalog only learns of files that are there already.
        spark.sql(f"CREATE TABLE {name} (key {kind}, text STRING, blk BIGINT) USING parquet CLUSTERED BY (blk) INTO {files} BUCKETS LOCATION '{path}'")
        self.table = spark.table(name)
        spark.sql(f"DROP TABLE {name}")  # the plan knows the files and their buckets; they stay

    @classmethod
    def of(cls, docs: DataFrame, key: str, text: str) -> Dealt:
        spark = docs.sparkSession
        total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        n, files = max(16, math.ceil(total / BLOCK_BYTES)), min(MOST_FILES, max(8, math.ceil(total / FILE_BYTES)))
        blk = F.pmod(F.xxhash64(F.lit(3), F.monotonically_increasing_id()), F.lit(n)).cast("long")
        rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), blk.alias("blk"))
        path, name = shared_path(spark, "dealt"), f"written_{uuid.uuid4().hex}"
        rows.repartition(files, "blk").write.bucketBy(files, "blk").option("path", path).saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")
        return cls(spark, path, files, rows.schema["key"].dataType.simpleString())


class WindowIndex:
    """Sorted immutable runs of fingerprints, one table each, and manifests, in one folder that all executors share.

    Buckets are ranges of hashes. As texts come in their number is doubled, so that a bucket's share stays some
    MB; runs and batches written before are cut at the new borders when they are read, and anew when runs are compacted.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 8, fanout: int = 2):
        self.spark, self.path, self.buckets, self.fanout = spark, path or shared_path(spark, "index"), buckets, fanout
        #: Of each run its path and buckets.
        self.runs: list[list] = []
        #: Of each batch: its texts (path, files, type of the key), its fingerprints by block (path) and their buckets.
        self.batches: list[dict] = []
        self.bytes, self.saved = 0, 0

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _manifests(self) -> list[str]:
        fs, at = self._fs()
        found = fs.globStatus(at(f"{self.path}/manifest-*.json"))
        return sorted(x.getPath().toString() for x in found or [])

    def save(self) -> None:
        """Writes the next manifest beside its place and renames it; the one before goes after that, so there is always a whole one."""
        fs, at = self._fs()
        old = self._manifests()
        self.saved += 1
        text = json.dumps({"buckets": self.buckets, "fanout": self.fanout, "bytes": self.bytes, "saved": self.saved, "runs": self.runs, "batches": self.batches})
        part = f"{self.path}/part-{uuid.uuid4().hex}"
        out = fs.create(at(part))
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(at(part), at(f"{self.path}/manifest-{self.saved:012d}.json")):
            raise RuntimeError(f"another writer has saved the index {self.path}")
        for path in old:
            fs.delete(at(path), False)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> WindowIndex:
        """The index as its newest manifest has it."""
        index = cls(spark, path)
        d = json.loads("\n".join(r[0] for r in spark.read.text(index._manifests()[-1]).collect()))  # the names of some runs
        index.buckets, index.fanout, index.bytes, index.saved, index.runs, index.batches = (d[k] for k in ("buckets", "fanout", "bytes", "saved", "runs", "batches"))
        return index

    def grow(self, more: int) -> None:
        """Makes room for so many bytes of text."""
        self.bytes += more
        while self.buckets * BUCKET_BYTES < self.bytes:
            self.buckets *= 2

    def _read(self, path: str, buckets: int | None = None) -> DataFrame:
        """A table of packed rows, cut at the borders of the buckets that there are now."""
        rows = self.spark.read.schema(PACKED).parquet(path)
        if buckets is None or buckets == self.buckets:
            return rows
        now = self.buckets

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples():
                    values = np.frombuffer(r.prints, np.uint64)
                    bucket = bucket_of(values, now)
                    cuts = _stretches(bucket)
                    yield pd.DataFrame({"bucket": np.array([bucket[a] for a, _ in cuts], np.int32), "blk": np.int64(r.blk), "prints": [values[a:b].tobytes() for a, b in cuts], "twice": [r.twice[a:b] for a, b in cuts]}, columns=["bucket", "blk", "prints", "twice"])

        return rows.mapInPandas(cut, PACKED)

    def _write(self, df: DataFrame, tag: str) -> str:
        path = f"{self.path}/{tag}-{uuid.uuid4().hex}"
        with bounded_batches(self.spark):
            df.write.parquet(path)
        return path

    def history(self) -> DataFrame:
        """All runs' rows: a row for each run and bucket."""
        out = self.spark.createDataFrame([], PACKED)
        for r in self.runs:
            out = out.unionByName(self._read(*r))
        return out

    def add(self, prints: DataFrame, dealt: Dealt | None = None, name: str | None = None) -> None:
        """Merge-joins a batch's fingerprints with the runs, bucket by bucket, and writes its run: those met before, or twice, are marked."""
        where = self._write(prints, "prints")

        def merge(batch: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(batch):
                return pd.DataFrame({"bucket": [], "blk": [], "prints": [], "twice": []})
            values, twice = merged(batch)
            twice = twice | among(values, merged(held)[0])
            return pd.DataFrame({"bucket": batch["bucket"].iloc[:1].to_numpy(), "blk": np.int64(-1), "prints": [values.tobytes()], "twice": [twice.tobytes()]})

        both = self._read(where).groupBy("bucket").cogroup(self.history().groupBy("bucket"))
        self.runs.append([self._write(both.applyInPandas(merge, PACKED).sortWithinPartitions("bucket"), "run"), self.buckets])
        self.batches.append({"prints": where, "buckets": self.buckets} | ({"texts": [dealt.path, dealt.files, dealt.kind]} if dealt else {}) | ({"name": name} if name else {}))
        if len(self.runs) > self.fanout:
            self.compact()
        self.save()

    def compact(self) -> None:
        """Merges all runs into one; the old ones go once the manifest names the new one."""
        if len(self.runs) < 2:
            return

        def merge(rows: pd.DataFrame) -> pd.DataFrame:
            values, marks = merged(rows)
            return pd.DataFrame({"bucket": rows["bucket"].iloc[:1].to_numpy(), "blk": np.int64(-1), "prints": [values.tobytes()], "twice": [marks.tobytes()]})

        old, self.runs = self.runs, [[self._write(self.history().groupBy("bucket").applyInPandas(merge, PACKED).sortWithinPartitions("bucket"), "run"), self.buckets]]
        self.save()
        for path, _ in old:
            remove(self.spark, path)

    def repeated(self, prints: DataFrame) -> DataFrame:
        """For each packed row of prints, bits for those fingerprints that the runs hold twice or more; rows without such go."""

        def look_up(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            values, marks = merged(held)
            return answer(asked, values[marks])

        return prints.groupBy("bucket").cogroup(self.history().groupBy("bucket")).applyInPandas(look_up, "blk long, bucket int, bits binary")

    def drop(self) -> None:
        remove(self.spark, self.path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def buckets_for(docs: DataFrame, text: str = "text") -> int:
    return max(8, math.ceil(text_bytes(docs, text) / BUCKET_BYTES))


def fingerprints(dealt: DataFrame, buckets: int) -> DataFrame:
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return packed(int(rows["blk"].iloc[0]), Block(rows["text"]).chosen, buckets)

    return dealt.groupBy("blk").applyInPandas(pack, PACKED)


def candidates(dealt: DataFrame, replies: DataFrame, buckets: int) -> DataFrame:
    """The packed whole hashes of the windows whose fingerprints the replies mark; blocks without such are not read."""

    def verify(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(told):
            return pd.DataFrame({"bucket": [], "blk": [], "prints": [], "twice": []})
        block = Block(rows["text"])
        which = among(block.least, marked(block.chosen, told, buckets))
        return packed(int(rows["blk"].iloc[0]), block.wholes(which), buckets)

    return dealt.groupBy("blk").cogroup(replies.groupBy("blk")).applyInPandas(verify, PACKED)


def remove_windows(dealt: DataFrame, replies: DataFrame, buckets: int, kind: str, history: DataFrame | None = None) -> DataFrame:
    """key, n_words, n_removed and kept (the words left, one space between) of each dealt document.

    history: packed whole hashes of earlier batches' windows, which count as places too.
    """

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        values, marks = merged(rows, WIDE)
        return answer(rows[rows["blk"] >= 0], values[marks])

    def cut(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"key": [], "n_words": [], "n_removed": [], "kept": []})
        block = Block(rows["text"])
        which = among(block.least, marked(block.chosen, told[told["step"] == 1], buckets))
        wholes = block.wholes(which)
        starts = block.starts[which][among(wholes, marked(wholes, told[told["step"] == 2], buckets))]
        gone = in_windows(starts, len(block.hashes))
        kept, lost, at = [], [], 0
        for words in tokens.word_lists(block.texts):
            own = gone[at : at + len(words)]
            at += len(words)
            n = int(own.sum())
            lost.append(n)
            kept.append(b" ".join(words if not n else [w for w, g in zip(words, own.tolist()) if not g]).decode("utf-8", "replace"))
        return pd.DataFrame({"key": rows["key"].to_numpy(), "n_words": block.counts, "n_removed": lost, "kept": kept})

    sent = candidates(dealt, replies, buckets)
    sent = sent if history is None else sent.unionByName(history)
    proved = sent.groupBy("bucket").applyInPandas(judge, "blk long, bucket int, bits binary")
    told = replies.withColumn("step", F.lit(1)).unionByName(proved.withColumn("step", F.lit(2)))
    return dealt.groupBy("blk").cogroup(told.groupBy("blk")).applyInPandas(cut, f"key {kind}, n_words long, n_removed long, kept string")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = 3, index: WindowIndex | None = None, name: str | None = None) -> DataFrame:
    """One row for each document: its key, n_words, n_removed and kept.

    Without an index, docs are all there is: one is built from `batches` batches of blocks, each
    merge-joined with the runs before it, and all are judged against all. With an index, docs are a new batch:
    it is merge-joined with the runs of earlier batches, its windows that start elsewhere in it or
    in their texts go from it, and it is added; what earlier batches returned stays as it was. A batch with a
    name that the index knows is not added again, so that one whose result was lost can be run again.

    A null or empty text has no words and is kept as the empty text; texts are read whole; equal
    rows cover each other; an empty table gives no rows; other columns are not carried.
    """
    spark = docs.sparkSession
    own = index is None
    index = index or WindowIndex(spark, buckets=buckets_for(docs, text))
    names = [b.get("name") for b in index.batches]
    again = name is not None and name in names
    if not own and not again:
        index.grow(text_bytes(docs, text))
    dealt = Dealt.of(docs, key, text)
    prints = written(fingerprints(dealt.table, index.buckets), "prints")
    old = index.batches[: names.index(name)] if again else list(index.batches)
    if again:
        pass  # its run is there
    elif own:
        for b in range(batches):
            index.add(prints.where(F.pmod(F.col("blk"), F.lit(batches)) == b))
    else:
        index.add(prints, dealt, name)
    replies = written(index.repeated(prints), "replies")
    history = None if own else earlier(index, old, prints)
    if own:
        index.drop()
    return remove_windows(dealt.table, replies, index.buckets, dealt.kind, history)


def earlier(index: WindowIndex, batches: list[dict], prints: DataFrame) -> DataFrame:
    """The packed whole hashes (blk -1) of windows of earlier batches whose fingerprints are among the new ones; only blocks that hold such are read."""

    def shared(asked: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        return answer(asked, merged(new)[0])

    out = index.spark.createDataFrame([], PACKED)
    for b in batches:
        texts = Dealt(index.spark, *b["texts"]).table
        asked = index._read(b["prints"], b["buckets"]).groupBy("bucket").cogroup(prints.groupBy("bucket"))
        replies = written(asked.applyInPandas(shared, "blk long, bucket int, bits binary"), "earlier")
        out = out.unionByName(candidates(texts, replies, index.buckets).withColumn("blk", F.lit(-1).cast("long")))
    return out

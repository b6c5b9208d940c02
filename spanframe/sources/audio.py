"""Sound files: which there are, their headers and samples, and how loud each frame is.

WAV files are read by the data source `wav`: its partitions are ranges of a file's bytes, so that a
long file is read by many tasks and none holds more of it than a chunk. Files are opened by
pyarrow.fs, which knows local paths and the stores that it has drivers for. Samples come as 16-bit
numbers of one channel at the rate asked for.
"""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spanframe.operators.clips import HOP

#: Extensions that count in a folder.
EXTENSIONS = ("wav", "mp3", "m4a", "aac", "flac", "ogg", "oga", "opus", "wma", "aiff", "aif", "amr", "3gp", "webm", "mp4", "m4v", "mov", "mkv", "avi", "wmv", "mts", "ts")
#: Frames of levels in a chunk (at the rate of the chunk), bytes of a partition, zero crossings of the resampling kernel at each side, its cut-off as a share of the lower rate's half, and the shape of its window.
CHUNK_FRAMES, PARTITION_BYTES, CROSSINGS, CUTOFF, BETA = 500, 16 << 20, 24, 0.95, 9.0
CHUNKS = pa.schema([("file_id", pa.string()), ("chunk_no", pa.int64()), ("t0", pa.float64()), ("rate", pa.int32()), ("samples", pa.list_(pa.int16())), ("error", pa.string())])
HEADERS = pa.schema([("file_id", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), ("channels", pa.int32()), ("rate", pa.int32()), ("bits", pa.int32()), ("total_ms", pa.int64()), ("error", pa.string())])


def resolve_inputs(spark: SparkSession, spec: str, recursive: bool = False, extensions: tuple[str, ...] = EXTENSIONS) -> list[str]:
    """The files that lines of a text name, each once, in order.

    A line with commas that is no path names several. Of a folder all files with one of the extensions
    count, by name; of a pattern all files; a file is itself; anything else is an error.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs = lambda p: at(p).getFileSystem(conf)
    plain = lambda status: re.sub(r"^file:/+(?=[^/])", "/", status.getPath().toString())
    bare = lambda x: x.strip().strip('"').strip("'")

    def listed(folder: str) -> list[str]:
        out = []
        for s in fs(folder).listStatus(at(folder)):
            out += ([plain(s)] if s.isFile() else listed(plain(s)) if recursive else [])
        return out

    parts: list[str] = []
    for line in filter(None, map(bare, (spec or "").splitlines())):
        parts += [line] if "," not in line or fs(line).exists(at(line)) else [bare(x) for x in line.split(",") if x.strip()]
    out: list[str] = []
    for p in parts:
        if not any(c in p for c in "*?[") and fs(p).exists(at(p)):
            status = fs(p).getFileStatus(at(p))
            out += [plain(status)] if status.isFile() else [x for x in sorted(listed(p)) if x.lower().rsplit(".", 1)[-1] in extensions]
        elif any(c in p for c in "*?["):
            out += sorted(plain(s) for s in fs(p).globStatus(at(p)) or [] if s.isFile())
        else:
            raise FileNotFoundError(p)
    return list(dict.fromkeys(out))


def store(path: str) -> tuple[stores.FileSystem, str]:
    """The file system that a path or URI lies in, and where it lies there."""
    return stores.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (stores.LocalFileSystem(), path)


def sized(path: str) -> list[tuple[str, int]]:
    """A file and its bytes (none: 0), or all files right in a folder."""
    fs, inner = store(path)
    info = fs.get_file_info(inner)
    if info.type != stores.FileType.Directory:
        return [(path, max(0, info.size or 0))]
    inside = sorted(fs.get_file_info(stores.FileSelector(inner)), key=lambda f: f.path)
    return [(f"{path.rstrip('/')}/{f.base_name}", f.size) for f in inside if f.is_file and not f.base_name.startswith((".", "_"))]


@dataclass(frozen=True)
class Form:
    """Where a WAV file's samples are and how they are written."""

    offset: int
    size: int
    channels: int
    rate: int
    bits: int
    floats: bool = False

    @property
    def block(self) -> int:
        """Bytes of one moment: a sample of each channel."""
        return self.channels * self.bits // 8

    @property
    def n(self) -> int:
        return self.size // self.block


def header(f, total: int) -> Form:
    """The form of an open WAV file of so many bytes; other chunks are passed over.

    A length of 0, of all ones, or beyond the end of the file means the rest of it.
    """
    f.seek(0)
    if not re.fullmatch(rb"RIFF....WAVE", f.read(12), re.S):
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= total:
        f.seek(at)
        name, size = struct.unpack("<4sI", f.read(8))
        at += 8
        if name == b"fmt ":
            data = f.read(min(size, 40))
            if len(data) < 16:
                raise ValueError("fmt chunk too short")
            form = list(struct.unpack_from("<HHIIHH", data))
            if form[0] == 0xFFFE and len(data) >= 26:
                form[0] = struct.unpack_from("<H", data, 24)[0]
        elif name == b"data":
            if form is None:
                raise ValueError("no fmt chunk")
            tag, channels, rate, _, _, bits = form
            if not channels or not rate or (tag, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)}:
                raise ValueError(f"unknown form: tag {tag}, {channels} channels, {rate} Hz, {bits} bits")
            size = total - at if size in (0, 0xFFFFFFFF) or at + size > total else size
            return Form(at, size, channels, rate, bits, tag == 3)
        at += size + size % 2
    raise ValueError("no data chunk")


def numbers(data: bytes, form: Form) -> np.ndarray:
    """Samples from -1 to 1, a row for each moment."""
    if form.floats:
        x = np.frombuffer(data, f"<f{form.bits // 8}").astype(np.float64)
    elif form.bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif form.bits == 24:
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        x = wide.view("<i4").ravel() / float(1 << 31)
    else:
        x = np.frombuffer(data, f"<i{form.bits // 8}") / float(1 << form.bits - 1)
    return x.reshape(-1, form.channels)


def one_channel(x: np.ndarray, channel: str) -> np.ndarray:
    """The mean of all channels, or the left or right one of several."""
    if channel == "mix" or x.shape[1] == 1:
        return x.mean(axis=1)
    return x[:, ("left", "right").index(channel)]


def kernel(t: np.ndarray, rate: int, to: int) -> np.ndarray:
    """The windowed sinc by which a moment t input samples away counts, before its sum is made 1."""
    low = CUTOFF * min(1.0, to / rate)
    reach = CROSSINGS / low
    return np.sinc(low * t) * np.i0(BETA * np.sqrt(np.maximum(0, 1 - (t / reach) ** 2))) * (np.abs(t) < reach)


@lru_cache(maxsize=8)
def phases(rate: int, to: int) -> tuple[int, int, int, np.ndarray]:
    """up, down, reach (input samples at each side) and, for each phase an output sample can have, how much the input samples around it count."""
    up, down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    reach = math.ceil(CROSSINGS / (CUTOFF * min(1.0, to / rate)))
    k = kernel(np.arange(up)[:, None] / up - np.arange(-reach, reach + 1)[None, :], rate, to)
    return up, down, reach, k / k.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Wanted:
    """What is read of a file: a channel, a rate (0: its own), a stretch in seconds (no length: up to the end)."""

    channel: str = "mix"
    rate: int = 16_000
    start: float = 0.0
    length: float = 0.0


class Sound:
    """An open WAV file as the samples that are wanted; any stretch of them is read on its own."""

    def __init__(self, f, total: int, wanted: Wanted):
        self.f, self.form, self.wanted = f, header(f, total), wanted
        self.rate = wanted.rate or self.form.rate
        self.first = min(self.form.n, round(wanted.start * self.form.rate))
        self.n_in = self.form.n - self.first
        if wanted.length:
            self.n_in = min(self.n_in, round(wanted.length * self.form.rate))
        self.n = -(-self.n_in * self.rate // self.form.rate)

    def byte_of(self, sample: int) -> int:
        """Where the file holds what a sample is made of."""
        return self.form.offset + (self.first + sample * self.form.rate // self.rate) * self.form.block

    def inputs(self, a: int, b: int) -> np.ndarray:
        """Input samples a to b of one channel, zeros beyond the ends."""
        low, high = max(0, a), max(0, a, min(b, self.n_in))
        self.f.seek(self.form.offset + (self.first + low) * self.form.block)
        data = self.f.read((high - low) * self.form.block)
        x = one_channel(numbers(data[: len(data) // self.form.block * self.form.block], self.form), self.wanted.channel)
        return np.concatenate([np.zeros(low - a), x, np.zeros(max(0, b - low - len(x)))])

    def samples(self, a: int, b: int) -> np.ndarray:
        """Samples a to b as 16-bit numbers."""
        b = min(b, self.n)
        if b <= a:
            return np.zeros(0, np.int16)
        if self.rate == self.form.rate:
            x = self.inputs(a, b)
        else:
            up, down, reach, weights = phases(self.form.rate, self.rate)
            places = np.arange(a, b) * down
            base = places // up
            around = np.lib.stride_tricks.sliding_window_view(self.inputs(int(base[0]) - reach, int(base[-1]) + reach + 1), 2 * reach + 1)
            x = np.concatenate([np.einsum("ij,ij->i", around[base[i : i + 8192] - base[0]], weights[places[i : i + 8192] % up]) for i in range(0, b - a, 8192)])
        return np.clip(np.rint(x * 32768), -32768, 32767).astype(np.int16)


class Ranges(InputPartition):
    """Ranges (file, from, to) of bytes that one task reads; None: to the end."""

    def __init__(self, ranges: list[tuple[str, int, int | None]]):
        super().__init__(None)
        self.ranges = ranges


class _Reader(DataSourceReader):
    """Deals files over partitions by their lengths, which is all that is looked at before tasks run."""

    def __init__(self, options, cut: bool):
        self.paths = json.loads(options["paths"])
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))
        self.cut = cut

    def partitions(self) -> list[Ranges]:
        dealt: list[list] = []
        held = self.size
        for path, total in (f for p in self.paths for f in sized(p)):
            ends = [*range(self.size, total, self.size)] if self.cut else []
            for a, b in zip([0, *ends], [*ends, None]):
                length = (total if b is None else b) - a
                if held + length > self.size or not dealt:
                    dealt.append([])
                    held = 0
                dealt[-1].append((path, a, b))
                held += length
        return [Ranges(x) for x in dealt]

    def opened(self, partition: Ranges, each) -> Iterator[pa.RecordBatch]:
        """each(path, file, size, a, b) for every range; a file that can't be read gives one row with its error."""
        for path, a, b in partition.ranges:
            try:
                fs, inner = store(path)
                with fs.open_input_file(inner) as f:
                    yield from each(path, f, f.size(), a, b)
            except (ValueError, OSError, struct.error) as e:
                if a == 0:
                    yield pa.RecordBatch.from_pylist([{"file_id": path, "error": str(e) or type(e).__name__}], schema=self.schema)


class ChunkReader(_Reader):
    schema = CHUNKS

    def __init__(self, options):
        super().__init__(options, True)
        self.wanted = Wanted(options.get("channel", "mix"), int(options.get("rate", 16_000)), float(options.get("start", 0)), float(options.get("length", 0)))
        if self.wanted.channel not in ("mix", "left", "right"):
            raise ValueError(f"channel must be mix, left or right, not {self.wanted.channel}")

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        def each(path, f, total, a, b):
            sound = Sound(f, total, self.wanted)
            per = CHUNK_FRAMES * frame_samples(sound.rate)
            n = -(-sound.n // per)
            # A chunk belongs to the range that holds its first sample, one before all ranges or behind them to the first or last.
            low = 0 if a == 0 else first_at(n, lambda k: sound.byte_of(k * per) >= a)
            high = n if b is None else first_at(n, lambda k: sound.byte_of(k * per) >= b)
            for k in range(low, high):
                x = sound.samples(k * per, (k + 1) * per)
                yield pa.record_batch([pa.array([path]), pa.array([k]), pa.array([k * per / sound.rate]), pa.array([sound.rate], pa.int32()), pa.array([x], pa.list_(pa.int16())), pa.array([None], pa.string())], schema=CHUNKS)

        return self.opened(partition, each)


class HeaderReader(_Reader):
    schema = HEADERS

    def __init__(self, options):
        super().__init__(options, False)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        def each(path, f, total, a, b):
            h = header(f, total)
            yield pa.RecordBatch.from_pylist([{"file_id": path, "offset": h.offset, "bytes": h.size, "channels": h.channels, "rate": h.rate, "bits": h.bits, "total_ms": h.n * 1000 // h.rate, "error": None}], schema=HEADERS)

        return self.opened(partition, each)


class WavSource(DataSource):
    """`wav`: file_id, chunk_no, t0 (seconds), rate, samples, error of the files, or of all in the folders, that the option `paths` names (a JSON list).

    Options: channel (mix, left, right), rate (16000; 0: the file's own), start and length in seconds, partitionBytes.
    """

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "file_id string, chunk_no long, t0 double, rate int, samples array<short>, error string"

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options)


class WavHeaderSource(DataSource):
    """`wav_headers`: what the headers of the files say, without reading further."""

    @classmethod
    def name(cls) -> str:
        return "wav_headers"

    def schema(self) -> str:
        return "file_id string, offset long, bytes long, channels int, rate int, bits int, total_ms long, error string"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)


def first_at(n: int, reached) -> int:
    """The first of 0 to n - 1 for which reached() holds, as it then does for all that follow; else n."""
    low, high = 0, n
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if reached(mid) else (mid + 1, high)
    return low


def chunks(spark: SparkSession, paths: list[str], channel: str = "mix", rate: int = 16_000, start: float = 0.0, length: float = 0.0, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """file_id, chunk_no, t0, rate, samples of WAV files, in chunks of whole frames; a file that can't be read is one row with its error and no samples."""
    spark.dataSource.register(WavSource)
    options = {"paths": json.dumps(paths), "channel": channel, "rate": rate, "start": start, "length": length, "partitionBytes": partition_bytes}
    return spark.read.format("wav").options(**options).load()


def probe(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_id, offset, bytes, channels, rate, bits, total_ms of WAV files, or the error of one that is none."""
    spark.dataSource.register(WavHeaderSource)
    return spark.read.format("wav_headers").options(paths=json.dumps(paths)).load()


def wav_bytes(x: np.ndarray, rate: int = 16_000) -> bytes:
    """Samples from -1 to 1 as a 16-bit WAV file."""
    body = (np.clip(np.asarray(x, np.float32), -1, 1) * 32767.0).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def frame_samples(rate: int) -> int:
    """Samples of a frame of HOP ms."""
    return max(1, round(HOP * rate / 1000))


def levels(samples: np.ndarray, rate: int) -> np.ndarray:
    """The mean square of each frame in dB; what is left at the end is no frame."""
    per = frame_samples(rate)
    frames = samples[: len(samples) // per * per].reshape(-1, per).astype(np.float64)
    return (10 * np.log10((frames * frames).mean(axis=1) + 1e-3)).astype(np.float32)


def frame_levels(chunked: DataFrame) -> DataFrame:
    """file_id, frame, db of chunks; a file that can't be read has no frames."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, k, rate, x in zip(*(batch.column(c) for c in ("file_id", "chunk_no", "rate", "samples"))):
                db = levels(x.values.to_numpy(), rate.as_py())
                first = k.as_py() * CHUNK_FRAMES
                yield pa.record_batch([pa.array([file_id.as_py()] * len(db), pa.string()), pa.array(np.arange(first, first + len(db))), pa.array(db)], ["file_id", "frame", "db"])

    return chunked.where("samples IS NOT NULL").select("file_id", "chunk_no", "rate", "samples").mapInArrow(each, "file_id string, frame long, db float")


def stretches(chunked: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """wanted (file_id, start_ms, end_ms and a key that is unique) with x, the samples of the stretch from -1 to 1; none beyond the file.

    Stretches and chunks meet by number, so that a stretch gets its own chunks only.
    """
    per = F.greatest(F.lit(1), F.rint(F.col("rate") * HOP / 1000)) * CHUNK_FRAMES
    have = chunked.where("samples IS NOT NULL").select("file_id", "chunk_no", "rate", (F.col("chunk_no") * per).cast("long").alias("base"), per.cast("long").alias("per"), "samples")
    rates = have.where("chunk_no = 0").select("file_id", F.col("rate").alias("__rate"), F.col("per").alias("__per"))
    at = lambda c: F.rint(F.col(c) * F.col("__rate") / 1000).cast("long")
    asked = wanted.join(rates, "file_id").select("file_id", *[c for c in key if c != "file_id"], F.greatest(at("start_ms"), F.lit(0)).alias("a"), at("end_ms").alias("b"), "__per")
    asked = asked.where("b > a").withColumn("chunk_no", F.explode(F.sequence(F.floor(F.col("a") / F.col("__per")), F.floor((F.col("b") - 1) / F.col("__per")))))
    low, high = F.greatest(F.col("a") - F.col("base"), F.lit(0)), F.least(F.col("b") - F.col("base"), F.size("samples"))
    part = F.when(high > low, F.slice("samples", (low + 1).cast("int"), (high - low).cast("int"))).otherwise(F.array().cast("array<smallint>"))
    met = asked.join(have, ["file_id", "chunk_no"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("chunk_no", part.alias("x")))).alias("x"))
    whole = met.select(*key, F.transform(F.flatten("x.x"), lambda s: (s / 32768).cast("float")).alias("x"))
    return wanted.join(whole, key, "left").withColumn("x", F.coalesce("x", F.array().cast("array<float>")))


def padded(x: Column, least: int) -> Column:
    """An array of samples with zeros behind it up to so many."""
    return F.concat(x, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(least) - F.size(x), F.lit(0))))

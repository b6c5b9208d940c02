"""Sound files: inputs, headers, chunks cut over tasks, forms, resampling, stretches and levels."""

import io
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.operators.intervals import energy_vad
from spanframe.sources import audio


def wav(body: bytes, rate=16000, channels=1, bits=16, tag=1, size=None, before=b"", extensible=False):
    block = channels * bits // 8
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else tag, channels, rate, rate * block, block, bits)
    if extensible:
        fmt += struct.pack("<HHIH14s", 22, bits, 0, tag, b"\0" * 14)
    return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + before + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(body) if size is None else size) + body


def save(folder, **files):
    for name, data in files.items():
        (folder / f"{name}.wav").write_bytes(data)
    return [str(folder / f"{name}.wav") for name in files]


def whole(spark, path, **options):
    """A file's chunks in order, as one array."""
    rows = audio.chunks(spark, [path], **options).orderBy("chunk_no").collect()
    per = audio.CHUNK_FRAMES * audio.frame_samples(rows[0].rate) if rows else 1
    assert [r.chunk_no for r in rows] == list(range(len(rows))) and all(len(r.samples) == per for r in rows[:-1]) and all(r.t0 == r.chunk_no * per / r.rate for r in rows)
    return np.array([x for r in rows for x in r.samples], np.int64)


def test_inputs_are_found(spark, tmp_path):
    (tmp_path / "a").mkdir()
    names = [f"x.{e}" for e in audio.EXTENSIONS]
    for name in [*names, "b.wav", "A.WAV", "d.txt", "none", "a/e.Opus"]:
        (tmp_path / name).write_bytes(b"")
    assert len(audio.EXTENSIONS) == 22
    found = [p.rsplit("/", 1)[1] for p in audio.resolve_inputs(spark, f'"{tmp_path}"\n{tmp_path}/b.wav, {tmp_path}/d.txt\n\n{tmp_path}/*.txt')]
    assert found == [*sorted([*names, "b.wav", "A.WAV"]), "d.txt"]
    assert len(audio.resolve_inputs(spark, str(tmp_path), True)) == 25
    with pytest.raises(FileNotFoundError):
        audio.resolve_inputs(spark, f"{tmp_path}/z.wav")


def test_a_file_cut_over_partitions_is_the_file(spark, tmp_path):
    x = np.random.default_rng(1).integers(-32768, 32768, 500_123).astype("<i2")
    (path,) = save(tmp_path, a=wav(x.tobytes(), before=b"LIST" + struct.pack("<I", 3) + b"abc\0"))
    for size in (1 << 20, 70_001, 30_000):
        df = audio.chunks(spark, [path], partition_bytes=size)
        assert df.rdd.getNumPartitions() == -(-len((tmp_path / "a.wav").read_bytes()) // size)
        assert (whole(spark, path, partition_bytes=size) == x).all()
    assert (whole(spark, f"file://{path}", rate=0) == x).all()
    assert (whole(spark, path, start=1.5, length=12.25) == x[24_000 : 24_000 + 196_000]).all()
    assert (whole(spark, path, start=30, partition_bytes=99_999) == x[480_000:]).all() and len(whole(spark, path, start=99)) == 0


def test_headers_of_odd_files(spark, tmp_path):
    x = np.arange(1000, dtype="<i2")
    odd = b"junk" + struct.pack("<I", 5) + b"12345\0"
    paths = save(
        tmp_path, zero=wav(x.tobytes(), size=0), ones=wav(x.tobytes(), size=0xFFFFFFFF, before=odd), cut=wav(x.tobytes(), size=9999), torn=wav(x.tobytes()[:-1], size=2000), more=wav(x.tobytes()) + b"LIST\4\0\0\0abcd",
        empty=wav(b""), none=b"none", short=b"RIFF\0\0\0\0WAVEfmt ", nofmt=b"RIFF\0\0\0\0WAVEdata\4\0\0\0abcd", nodata=wav(b"")[:36], law=wav(b"12", bits=8, tag=6), silent=wav(b"", channels=0),
    )
    heads = {r.file_id.rsplit("/", 1)[1][:-4]: r for r in audio.probe(spark, [*paths, str(tmp_path / "missing.wav")]).collect()}
    assert {k: (r.bytes, r.total_ms) for k, r in heads.items() if r.error is None} == {"zero": (2000, 62), "ones": (2000, 62), "cut": (2000, 62), "torn": (1999, 62), "more": (2000, 62), "empty": (0, 0)}
    assert heads["ones"].offset == 44 + len(odd) and (heads["zero"].rate, heads["zero"].channels, heads["zero"].bits) == (16000, 1, 16)
    got = audio.chunks(spark, [*paths, str(tmp_path / "missing.wav")], partition_bytes=500).collect()
    bad = {r.file_id.rsplit("/", 1)[1][:-4] for r in got if r.error}
    assert bad == {"none", "short", "nofmt", "nodata", "law", "silent", "missing"} and sum(r.error is not None for r in got) == len(bad)
    assert {r.file_id.rsplit("/", 1)[1][:-4]: r.samples for r in got if not r.error} == {k: (x[:999] if k == "torn" else x).tolist() for k in ("zero", "ones", "cut", "torn", "more")}
    with pytest.raises(Exception, match="channel must be"):
        audio.chunks(spark, paths, channel="middle").collect()


def test_forms_and_channels(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (3000, 2))
    as_int = lambda bits: np.round(x * (2 ** (bits - 1) - 1)).astype(np.int64)
    three = b"".join(int(v).to_bytes(3, "little", signed=True) for v in as_int(24).ravel())
    forms = {
        "i8": (wav((as_int(8) + 128).astype(np.uint8).tobytes(), channels=2, bits=8), as_int(8) / 128), "i16": (wav(as_int(16).astype("<i2").tobytes(), channels=2), as_int(16) / 32768),
        "i24": (wav(three, channels=2, bits=24, extensible=True), as_int(24) / 2**23), "i32": (wav(as_int(32).astype("<i4").tobytes(), channels=2, bits=32), as_int(32) / 2**31),
        "f32": (wav(x.astype("<f4").tobytes(), channels=2, bits=32, tag=3, extensible=True), x.astype(np.float32)), "f64": (wav(x.astype("<f8").tobytes(), channels=2, bits=64, tag=3), x),
    }
    for (path,), plain in ((save(tmp_path, **{k: data}), plain) for k, (data, plain) in forms.items()):
        for channel, want in (("left", plain[:, 0]), ("right", plain[:, 1]), ("mix", plain.astype(np.float64).mean(axis=1))):
            assert (whole(spark, path, channel=channel, partition_bytes=5000) == np.clip(np.rint(want * 32768), -32768, 32767)).all()
    (path,) = save(tmp_path, mono=wav(as_int(16)[:, 0].astype("<i2").tobytes()))
    assert (whole(spark, path, channel="right") == as_int(16)[:, 0]).all()


def direct(x, rate, to, a, b):
    """Samples a to b by summing the kernel over all of the input."""
    t = np.arange(a, b)[:, None] * rate / to - np.arange(-4000, len(x) + 4000)[None, :]
    k = audio.kernel(t, rate, to)
    return (k[:, 4000 : 4000 + len(x)] * x).sum(axis=1) / k.sum(axis=1)


def test_rates_are_changed_as_by_a_direct_sum(spark, tmp_path):
    rng = np.random.default_rng(3)
    for rate, to in ((44100, 16000), (8000, 16000), (48000, 16000), (11025, 16000), (22050, 8000)):
        both = rng.integers(-9000, 9000, (rate * 2 + 77, 2))
        (path,) = save(tmp_path, x=wav(both.astype("<i2").tobytes(), rate=rate, channels=2))
        got = whole(spark, path, rate=to, partition_bytes=40_000)
        assert len(got) == math.ceil(len(both) * to / rate) and (got == whole(spark, path, rate=to)).all()
        x = both.mean(axis=1)
        for a, b in ((0, 200), (len(got) - 150, len(got)), (9990, 10_050)):
            assert np.abs(got[a:b] - direct(x, rate, to, a, b)).max() <= 0.5001  # half a step of 16 bits
    t = np.arange(44100 * 3) / 44100
    (path,) = save(tmp_path, tone=wav(np.round(20000 * np.sin(2 * np.pi * 997 * t)).astype("<i2").tobytes(), rate=44100))
    got = whole(spark, path)
    assert np.abs(got - 20000 * np.sin(2 * np.pi * 997 * np.arange(len(got)) / 16000))[200:-200].max() < 3
    (path,) = save(tmp_path, high=wav(np.round(20000 * np.sin(2 * np.pi * 9500 * t)).astype("<i2").tobytes(), rate=44100))
    assert np.abs(whole(spark, path))[200:-200].max() < 20  # above half the new rate: gone
    (path,) = save(tmp_path, late=wav(np.round(8000 * np.sin(t * 50)).astype("<i2").tobytes(), rate=44100))
    assert np.abs(whole(spark, path, start=1, length=1)[200:-200] - whole(spark, path)[16200:31800]).max() <= 1


def test_stretches_and_levels(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = (rng.integers(-20000, 20000, 16000 * 25 + 11) * (np.arange(16000 * 25 + 11) // 40000 % 2)).astype("<i2")
    y = rng.integers(-300, 300, 8000 * 3).astype("<i2")
    a, b, c = save(tmp_path, a=wav(x.tobytes()), b=wav(y.tobytes(), rate=8000), c=b"none")
    chunked = audio.chunks(spark, [a, b, c], rate=0, partition_bytes=50_000)
    asked = [(i, str(f), s, s + n) for i, (f, s, n) in enumerate([(a, 0, 100), (a, 9_990, 15_010), (a, 24_900, 9_000), (a, 26_000, 10), (b, 0, 99_999), (b, -500, 1_000), (b, 7, 0), (c, 0, 10), (a, 19_999, 1)])]
    got = {r.k: r.x for r in audio.stretches(chunked, spark.createDataFrame(asked, "k long, file_id string, start_ms long, end_ms long"), ["k"]).collect()}
    for k, f, s, e in asked:
        data, rate = {a: (x, 16000), b: (y, 8000), c: (x[:0], 1)}[f]
        want = data[max(0, round(s * rate / 1000)) : max(0, round(e * rate / 1000))] / np.float32(32768)
        assert np.array_equal(np.array(got[k], np.float32), want.astype(np.float32)), k
    frames = audio.frame_levels(chunked)
    for path, data, per in ((a, x, 320), (b, y, 160)):
        rows = frames.where(F.col("file_id") == path).orderBy("frame").collect()
        want = [10 * math.log10(float(np.mean(data[i * per : (i + 1) * per].astype(float) ** 2)) + 1e-3) for i in range(len(data) // per)]
        assert [r.frame for r in rows] == list(range(len(want))) and np.allclose([r.db for r in rows], want, atol=1e-4)
    heard = energy_vad(frames.where(F.col("file_id") == a), ["file_id"], ["frame"], "db", 30, 13, 20).orderBy("first").collect()
    assert [(r.first, r.last) for r in heard] == [(125, 249), (375, 499), (625, 749), (875, 999), (1125, 1249)]
    assert len(audio.wav_bytes(np.zeros(5))) == 54 and audio.header(io.BytesIO(audio.wav_bytes(np.zeros(5), 8000)), 54) == audio.Form(44, 10, 1, 8000, 16)
    assert spark.createDataFrame([([1.0],)], "x array<float>").select(audio.padded(F.col("x"), 3).alias("y")).first().y == [1, 0, 0]

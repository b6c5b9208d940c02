"""From the samples of sound to levels, speech and clips cut where it is quiet: every step against loops over plain lists."""

import math

import numpy as np

from spanframe.operators import clips as C
from spanframe.plans import speech as queries

DATA = "/root/testdata/sf0.001"


def samples(spark):
    """file -> samples, from the vectors."""
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    out = {}
    for r in rows:
        n = r.vec_id % 250
        gain = np.float32(0.001 if n >= 110 and n // 10 % 5 == 0 else 1)
        x = np.clip(np.array(r.embedding, np.float32) * gain, -1, 1) * np.float32(32767)
        out.setdefault(r.vec_id // 250, []).extend(int(v) for v in x)
    return out


def levels_of(x, per=32):
    return [10 * math.log10(sum(v * v for v in x[i : i + per]) / per + 1e-3) for i in range(0, len(x) - per + 1, per)]


def speech_of(db, top=45, least=13, gap=20):
    limit = float(np.percentile(np.array(db, np.float32), 99.5)) - top
    runs = []
    for i, v in enumerate(db):
        if np.float32(v) > limit:
            if runs and i - runs[-1][1] < gap + (runs[-1][1] == i):
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1])
    return [(a * 20, b * 20) for a, b in runs if b - a >= least]


def quiet(db, low, high):
    """By trying every frame: the mean of the five around it, zeros outside the range."""
    if high <= low:
        return low
    a, b = max(0, int(low // 20)), min(len(db), math.ceil(high / 20))
    if b - a < 3:
        return (low + high) / 2
    wide = min(5, b - a)
    sums = [sum(db[j] for j in range(i - wide // 2, i - wide // 2 + wide) if a <= j < b) for i in range(a, b)]
    return (a + min(range(len(sums)), key=lambda i: (round(sums[i], 3), i)) + 0.5) * 20


def clips_of(segs, total, db, longest, gap, pad, overlap):
    pad, overlap = min(pad, longest * 0.1), min(overlap, longest * 0.15)
    body = longest - 2 * max(pad, overlap)
    groups = []
    for s, e in segs:
        if groups and e - groups[-1][0] <= body and s - groups[-1][1] <= gap:
            groups[-1][1] = e
        else:
            groups.append([s, e])
    pieces = []
    for s, e in groups:
        left = False
        while e - s > body:
            share = (e - s) / math.ceil((e - s) / body)
            cut = quiet(db, s + max(share * 0.6, min(5000, body * 0.5)), s + min(body, share * 1.25))
            cut = round(min(max(cut, s + 1000), s + body))
            pieces.append((s, cut, left, True))
            s, left = cut, True
        pieces.append((s, e, left, False))
    out = []
    for i, (s, e, left, right) in enumerate(pieces):
        own = (None if i == 0 else s if left else (pieces[i - 1][1] + s) / 2, None if i + 1 == len(pieces) else e if right else (e + pieces[i + 1][0]) / 2)
        a, b = max(0, int(s - (overlap if left else pad))), min(total, int(e + (overlap if right else pad)))
        out.append((i, a, b, *own, right, sum(max(0, min(b, y) - max(a, x)) for x, y in segs)))
    return out


def chain(spark, longest, gap, pad, overlap):
    out = {}
    for f, x in samples(spark).items():
        db = [float(np.float32(v)) for v in levels_of(x)]
        out[str(f)] = db, clips_of(speech_of(db), len(db) * 20, db, longest, gap, pad, overlap)
    return out


def row(r):
    return (r.clip_id, r.start_ms, r.end_ms, r.own_start, r.own_end, r.cut, r.speech_ms)


def test_clips_of_sound_equal_loops(spark):
    want = chain(spark, 2000, 300, 100, 200)
    got = queries.f5_clips_of_sound(spark, DATA).collect()
    for f, (_, clips) in want.items():
        assert sorted(row(r) for r in got if r.file_id == f) == clips
    assert len(got) == sum(len(c) for _, c in want.values()) and sum(r.cut for r in got) >= 4
    cuts = chain(spark, 2000, 300, 0, 0)
    assert sorted((r.file_id, r.cut_ms) for r in queries.f4_quiet_cuts(spark, DATA).collect()) == sorted((f, float(c[4])) for f, (_, clips) in cuts.items() for c in clips if c[5])


def test_halves_of_sound_equal_loops(spark):
    want = set()
    for f, (db, clips) in chain(spark, 4000, 300, 100, 200).items():
        for k, a, b, own_a, own_b, cut, heard in clips:
            at = round(quiet(db, a + (b - a) * 0.3, a + (b - a) * 0.7))
            left, right = (a, min(b, at + 500)), (max(a, at - 500), b)
            share = lambda x, heard=heard, a=a, b=b: round(heard * (x[1] - x[0]) / (b - a))
            want |= {(f, k, 0, *left, own_a, min(at, own_b) if own_b is not None else at, True, share(left)), (f, k, 1, *right, max(at, own_a) if own_a is not None else at, own_b, cut, share(right))}
    got = {(r.file_id, r.clip_id, r.part, r.start_ms, r.end_ms, r.own_start, r.own_end, r.cut, r.speech_ms) for r in queries.f6_halves_of_sound(spark, DATA).collect()}
    assert got == want


def test_quiet_moments_equal_loops():
    rng = np.random.default_rng(5)
    for _ in range(400):
        db = [float(v) for v in rng.integers(20, 30, rng.integers(1, 60)).astype(np.float32)]
        low = float(rng.uniform(-100, 20 * len(db)))
        high = low + float(rng.uniform(-50, 900))
        first = int(rng.integers(0, max(1, int(max(0, low) // 20) + 1)))
        assert C.quietest(np.array(db[first:], np.float32), first, low, high, len(db)) == quiet(db, low, high)
    assert C.quietest(None, 0, 0, 2000, 0) == 1000


def test_resampled_sound_is_that_of_the_files(spark):
    from spanframe.sources import audio

    got = {}
    for r in sorted(queries.a3_resampled(spark, DATA).collect(), key=lambda r: (r.file_id, r.chunk_no, r.i)):
        got.setdefault(r.file_id, []).append(r.s)
    for f, x in samples(spark).items():
        t = np.arange(300, 600)[:, None] * 1.6 - np.arange(len(x))[None, :]
        k = audio.kernel(t, 1600, 1000)
        assert len(got[f]) == len(x) * 10 // 16 and np.abs(np.array(got[f][300:600]) - (k * np.array(x)).sum(axis=1) / k.sum(axis=1)).max() <= 0.5001

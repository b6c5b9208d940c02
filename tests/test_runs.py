"""Batches, failures of some files, logs that go on, caches, and speech with a fallback."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.operators import batches as G
from spanframe.operators import detect as V
from spanframe.operators import metrics as M
from spanframe.operators import retry as E
from spanframe.operators import sweep as P
from spanframe.plans import runs as queries
from spanframe.sources.cache import read_cache
from spanframe.streaming.resume import close, keep_new, restored, resume

DATA = "/root/testdata/sf0.001"
CLIP = "file_id string, clip_id long, start_ms long, end_ms long, own_start double, own_end double, speech_ms long, cut boolean, parent long"


def some_clips(spark, n, files=3, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(f"f{i % files}", i, i * 100_000, i * 100_000 + rng.choice([500, 9000, rng.randint(1, 30_000)]), None, None, 100, False, None) for i in range(n)], CLIP)


def test_batches_hold_clips_of_like_length(spark):
    rows = some_clips(spark, 700)
    for most, padded, parts in ((16, None, 3), (16, 60_000, 5), (1, None, 2), (50, 1, 4)):
        got = G.in_batches(rows, most, padded, partitions=parts).withColumn("d", F.col("end_ms") - F.col("start_ms")).collect()
        assert sorted(r.clip_id for r in got) == list(range(700))
        by = {}
        for r in got:
            by.setdefault(r.batch, []).append(r)
        for b in by.values():
            b.sort(key=lambda r: r.place)
            assert [r.place for r in b] == list(range(len(b))) and len(b) <= most and [r.d for r in b] == sorted((r.d for r in b), reverse=True)
            assert padded is None or len(b) == 1 or len(b) * b[0].d <= padded
        ranges = sorted((max(r.d for r in b), min(r.d for r in b)) for b in by.values())
        assert all(low >= high_ for (high_, _), (_, low) in zip(ranges, ranges[1:])) or padded is not None
        full = [b for b in by.values() if len(b) == most]
        assert padded is not None or len(by) - len(full) <= parts
    sums = G.padding(G.in_batches(rows, 16, partitions=2)).agg(F.sum("clips").alias("n"), F.sum("used_ms").alias("u"), F.sum("padded_ms").alias("p")).first()
    assert sums.n == 700 and sums.u <= sums.p <= 1.25 * sums.u
    assert G.in_batches(rows.limit(0), 4).count() == 0
    got = queries.g8_batches(spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert len(got) == docs == len({r.clip_id for r in got})


def test_work_that_fails_is_tried_in_halves():
    rng = random.Random(2)
    for _ in range(300):
        items, most, bad = list(range(rng.randint(0, 60))), rng.randint(1, 9), {rng.randint(0, 60) for _ in range(rng.randint(0, 4))}
        sizes = []

        def work(some):
            sizes.append(len(some))
            if len(some) > most:
                raise MemoryError
            if bad & set(some):
                raise KeyError("bad")
            return [x * 2 for x in some]

        got = list(G.bisected(work, items, 16))
        assert [(i, a, e is not None) for i, a, e in got] == [(i, None if i in bad else 2 * i, i in bad) for i in items]
        over = [s for s in sizes if s > most]
        assert over == sorted(over, reverse=True) and len(over) <= 5
    assert [e for _, _, e in G.bisected(lambda x: x[1:], [1, 2], 8)] == ["ValueError: 0 answers to 1 items"] * 2
    with pytest.raises(KeyboardInterrupt):
        list(G.bisected(lambda x: (_ for _ in ()).throw(KeyboardInterrupt()), [1], 1))


def test_a_clip_that_fails_sets_its_file_apart(spark):
    def work(some):
        if len(some) > 3:
            raise MemoryError
        for i in some:
            if i["clip_id"] == 7 or (i["clip_id"] == 4 and i["context"] == ""):
                raise RuntimeError(f"clip {i['clip_id']} {i['context']}")
        return [{"text": "" if i["clip_id"] in (4, 5) else "fine.", "words": [{"tok": "x", "s": 0.0, "e": 1.0}]} for i in some]

    rows = spark.createDataFrame([(f"f{i}", i, i * 100_000, i * 100_000 + 9_000, None, None, 9_000, False, None) for i in range(10)], CLIP)
    done = E.recognised(rows, G.recogniser(work, 8), context="terms", policy=E.Policy(split=False))
    good, bad = E.isolated(done)
    assert {r.file_id: r.error for r in bad.collect()} == {"f7": "RuntimeError: clip 7 terms", "f4": "RuntimeError: clip 4 "}
    told = {r.file_id: r for r in good.collect()}
    assert set(told) == {f"f{i}" for i in range(10)} - {"f4", "f7"} and told["f5"].flags == ["empty"] and told["f1"].text == "fine." and told["f1"].words[0].tok == "x"
    # An empty clip is read again in halves, numbers 6 and 7, the second of which fails.
    done = E.recognised(rows.where("clip_id = 5"), G.recogniser(work, 8), policy=E.Policy())
    assert {r.file_id: r.error for r in E.isolated(done)[1].collect()} == {"f5": "RuntimeError: clip 7 "}
    silent = E.recognised(rows, lambda asked: G.recogniser(work, 8)(asked).where("clip_id <> 2"), policy=E.Policy(enabled=False))
    assert {r.file_id: r.error for r in E.isolated(silent)[1].collect()}["f2"] == E.NO_ANSWER
    again = E.recognised(rows.where("clip_id < 2"), G.recogniser(work, 8), done=good.where("clip_id = 1"))
    assert again.where("error IS NULL").count() == 2


def test_speech_falls_back_to_energy(spark):
    levels = {"a": [60.0] * 100 + [0.0] * 100, "b": [0.0] * 100 + [60.0] * 100, "c": [60.0] * 1 + [0.0] * 399, "d": [60.0] * 5}
    rows = [(f, i, float(v)) for f, db in levels.items() for i, v in enumerate(db)]
    frames = spark.createDataFrame(rows, "file_id string, frame long, db float")
    files = spark.createDataFrame([(f, len(db) * 20) for f, db in levels.items()], "file_id string, total_ms long")

    def detect(db):
        if db[0] == 0:
            raise ValueError("starts silent")
        return [] if len(db) == 400 else [(0.0, 0.06), (0.08, 0.1)]

    found = V.detected(frames, detect)
    assert {r.file_id for r in found.where("error = 'ValueError: starts silent'").collect()} == {"b"}
    assert sorted(tuple(r) for r in V.speech(found, frames, files).collect()) == [("a", 0, 60), ("a", 80, 100), ("b", 2000, 4000), ("c", 0, 8000), ("d", 0, 60), ("d", 80, 100)]
    got = sorted((r.file_id, r.start_ms, r.end_ms) for r in queries.j6_speech_with_fallback(spark, DATA).collect())
    assert [x for x in got if "r" not in x[0]] == [("0", 0, 5000), ("1", 0, 5000)]
    heard = sorted((r.file_id, r.start_ms, r.end_ms) for r in V.by_energy(queries._heard(spark, DATA)[0], least_speech=12).collect())
    assert [x for x in got if "r" in x[0]] == sorted((f + "r", 10_000 - b, 10_000 - a) for f, a, b in heard)


def test_a_log_goes_on_after_crashes(spark, tmp_path):
    schema = "k long, v string"
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    table = lambda: sorted(((r.k, r.v) for r in restored(spark, log, spark.createDataFrame([], schema).schema)[0].collect()), key=str)
    put([(1, "a"), (1, "a"), (None, "n"), (2, "b")])
    resume(stream(), log, "k", str(tmp_path / "marks")).awaitTermination()
    put([(2, "again"), (None, "again"), (3, "c")])

    def crash(batch, epoch):
        keep_new(batch, epoch, log, ["k"])
        raise RuntimeError("killed between the write and its commit")

    with pytest.raises(Exception, match="killed between"):
        stream().writeStream.foreachBatch(crash).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    assert table() == [(1, "a"), (2, "b"), (3, "c"), (None, "n")]
    # The same batch comes again; had it not been whole, it would not have counted.
    (mark,) = (tmp_path / "log").glob("_done-*-1")
    mark.unlink()
    assert table() == [(1, "a"), (2, "b"), (None, "n")]
    resume(stream(), log, "k", str(tmp_path / "marks")).awaitTermination()
    assert table() == [(1, "a"), (2, "b"), (3, "c"), (None, "n")]
    put([(4, "d"), (1, "late")])
    resume(stream(), log, "k", str(tmp_path / "other-marks")).awaitTermination()  # the checkpoint is lost: all comes again
    assert table() == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (None, "n")]
    assert sorted(tuple(r) for r in spark.read.parquet(log).where("k IS NOT NULL").collect()) == table()[:4]  # the folder is the table
    rows, closed = restored(spark, log, spark.createDataFrame([], schema).schema)
    assert not closed
    close(rows.where("k > 1"), log)
    rows, closed = restored(spark, log, rows.schema)
    assert closed and sorted(r.k for r in rows.collect()) == [2, 3, 4]
    assert restored(spark, str(tmp_path / "nothing"), rows.schema)[0].count() == 0


def test_caches_are_whole_or_discarded(spark, tmp_path):
    entry = lambda i, t="x", **more: {"clip": {"id": i, "start": i * 1.0, "end": i + 1.0, "own_start": None, "own_end": None, "speech": 1, "parent": None, "cut": False}, "text": t, "language": "ja", "flags": ["empty"], "attempts": [{"ctx": True, "text": "y"}], "words": [["a", 0.0, 1.0]], **more}
    line = lambda *a, **k: json.dumps(entry(*a, **k), ensure_ascii=False)
    last = json.dumps({"final": True, "results": [entry(5), entry(4)]})
    files = {
        "partial": line(1) + "\n" + line(2, "日本") + "\n" + line(1, "later") + "\n", "open": line(1), "torn": line(1) + "\n" + line(2)[:-9], "final": line(1) + "\n" + last + "\nrubbish", "only": last,
        "blank": line(1) + "\n\n" + line(2) + "\n", "noclip": '{"text":"x"}\n', "badfinal": line(1) + "\n" + '{"final":true}\n', "early": "rubbish\n" + last, "newline": "\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.jsonl").write_text(text, encoding="utf-8")
    got = {r.path.rsplit("/", 1)[1][:-6]: (r.state, [(e.clip.id, e.text) for e in r.results]) for r in read_cache(spark, str(tmp_path)).collect()}
    assert got == {"partial": ("partial", [(1, "later"), (2, "日本")]), "open": ("partial", [(1, "x")]), "final": ("final", [(5, "x"), (4, "x")]), "only": ("final", [(5, "x"), (4, "x")])} | {n: ("none", []) for n in ("torn", "blank", "noclip", "badfinal", "early", "newline")}
    e = read_cache(spark, f"{tmp_path}/open.jsonl").first().results[0]
    assert json.loads(e.attempts) == [{"ctx": True, "text": "y"}] and json.loads(e.words) == [["a", 0.0, 1.0]] and e.flags == ["empty"] and e.clip.cut is False and e.clip.speech == 1.0


def test_presets_and_variants():
    some = [P.Preset("a", "A model", env="x", options={"beam": 5, "keep": True}), P.Preset("b", "a", env="y", native_times=True), P.Preset("c", "C")]
    assert P.find(some, " a ") is some[0] and P.find(some, "C") is some[2] and P.find(some, "A model") is some[0] and P.find(some, "nix") is None and P.find(some, None) is None
    assert P.installed(some, ["y"]) == some[1:] and P.installed(some, []) == some[2:]
    assert P.environments(some[0]) == ["x"] and P.environments(some[0], "x", "d") == ["x", "d"] and P.environments(some[2], "al", "d") == ["al", "d"]
    got = P.variants(" a | 15 |1.5| beam=0 , size=8,name= big ;\n\nb;c||2\n a|||x=none|ignored")
    assert got == [P.Variant("a", "15", "1.5", {"beam": None, "size": 8, "name": "big"}), P.Variant("b"), P.Variant("c", "auto", "2"), P.Variant("a", options={"x": None})]
    with pytest.raises(ValueError):
        P.variants("a|||beam")
    new = P.varied(some[0], got[0])
    assert new.options == {"keep": True, "size": 8, "name": "big"} and new.key == "a@15/1.5,beam=None,size=8,name=big" and new.label.startswith("A model [15/1.5") and new.env == "x"
    assert P.varied(some[0], got[1]) is some[0]


def test_batch_sizes_and_prompts(spark):
    sizes = [(None,), (0.0,), (4.0,), (6.25,), (15.0,), (24.0,), (40.0,), (80.0,), (1000.0,)]
    rows = spark.createDataFrame(sizes, "m double")

    def plainly(m, model, each, cap):
        if not m:
            return 1
        n = int(max(1.0, m * 0.8 - model) / each)
        return next((min(p, cap) for p in (128, 64, 32, 16, 8, 4, 2, 1) if n >= p), 1)

    for model, each, cap in ((4.0, 0.5, 128), (4.0, 3.0, 128), (0.0, 0.1, 16)):
        assert [r.b for r in rows.select(P.batch_size(F.col("m"), model, each, cap).alias("b")).collect()] == [plainly(m, model, each, cap) for (m,) in sizes]
    made = spark.createDataFrame([("x",), (" \u3000\n",), (None,)], "t string").select(P.minutes_prompt(F.col("t"), "S", "I").alias("p"))
    assert [r.p for r in made.collect()] == ["S\n\nI\n\n<transcript>\nx\n</transcript>\n", None, None]
    shown = spark.createDataFrame([("a\nb\nc\n",), ("abcdef\nb",), ("",)], "t string").select(P.preview(F.col("t"), 2, 3).alias("p"))
    assert [r.p for r in shown.collect()] == ["a\nb\n… (全 3 行)", "abc\nb", ""]


def test_every_preset_meets_every_file(spark):
    runs, reference = queries._sweep(spark, DATA)
    rows = runs.collect()
    files = {r.file_id for r in reference.collect()}
    assert sorted((r.file_id, r.preset, r.place) for r in rows) == sorted((f, p.key, i) for f in files for i, p in enumerate(queries.PRESETS))
    by = {(r.file_id, r.preset): r for r in rows}
    texts = {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        if r.text.split():
            texts.setdefault(r.conv_id, {})[r.turn] = r.text
    for f in files:
        said = texts[f]
        bad = min((t for t in said if (f * 31 + t) % 7 == 0), default=None)
        assert (by[f, "picky"].error, by[f, "picky"].text) == ((f"ValueError: clip {bad}", None) if bad is not None else (None, " ".join(f"clip {t}." for t in sorted(said)).replace(". ", ".")))
        assert by[f, "missing"].error == "no recogniser" and by[f, "missing"].text is None
        glued = ""
        for t in (said[k].strip() for k in sorted(said)):
            glued += (" " if glued[-1:].isascii() and glued[-1:].isalnum() and t[0].isascii() and t[0].isalnum() else "") + t
        assert by[f, "plain"].text == glued and by[f, "plain"].error is None
    got = {(r.file_id, r.preset): r for r in M.compare(runs, reference).collect()}
    assert len(got) == len(rows) and all(got[f, "plain"].cer == 0 and got[f, "plain"].x_realtime is None for f in files) and any(got[f, "short"].cer > 0 for f in files)
    with pytest.raises(ValueError):
        P.as_rows(spark.range(1), [P.Preset(str(i), "") for i in range(P.MOST_PRESETS + 1)])
    assert P.as_rows(spark.range(3), []).count() == 0 and P.sweep(some_clips(spark, 3), spark.createDataFrame([("f0", 5)], "file_id string, total_ms long"), queries.PRESETS, {}).where("error = 'no recogniser'").count() == 4

import random
import re
import unicodedata
import zlib

from pyspark.sql import functions as F

from spanframe.functions import text as T
from spanframe.operators import intervals as I
from spanframe.operators import sequences as S
from spanframe.sources import adapters as A
from spanframe.sources import sinks
from spanframe.streaming.resume import resume

WORDS = "file_id string, pos long, speaker string, word string, start_ms long, end_ms long"


def absorbed(rows):
    """Run by run from the left, with each change seen by the next run."""
    out, i = [list(r) for r in rows], 0
    while i < len(out):
        j = i
        while j < len(out) and out[j][2] == out[i][2]:
            j += 1
        if i and j < len(out) and j - i <= 2 and out[i - 1][2] == out[j][2] and out[j - 1][5] - out[i][4] < 800:
            for k in range(i, j):
                out[k][2] = out[i - 1][2]
        i = j
    return [(r[1], r[2]) for r in out]


def test_absorbed_runs_equal_a_pass_from_the_left(spark):
    rng = random.Random(4)
    for _ in range(4):
        rows = [("f", i, rng.choice(["a", "a", "b", None]), "w", 300 * i, 300 * i + rng.choice([200, 700])) for i in range(120)]
        got = S.absorb_interruptions(spark.createDataFrame(rows, WORDS)).orderBy("pos").collect()
        assert [(r.pos, r.speaker) for r in got] == absorbed(rows)
    assert S.absorb_interruptions(spark.createDataFrame([], WORDS)).count() == 0


def test_smoothing_gives_a_sentence_to_its_main_speaker(spark):
    rows = [("f", i, "b" if i == 2 else "a", "word ", 300 * i, 300 * i + 200) for i in range(6)]
    got = S.smooth_speakers(spark.createDataFrame(rows, WORDS)).orderBy("pos").collect()
    assert [r.speaker for r in got] == ["a"] * 6 and [r.changed for r in got] == [i == 2 for i in range(6)]


def test_clips_without_speech_are_their_own_pieces(spark):
    clips = spark.createDataFrame([("f", 1, 0, 100), ("f", 2, 100, 200)], "file_id string, clip_id long, start_ms long, end_ms long")
    segs = spark.createDataFrame([("f", 50, 90), ("f", 95, 100)], "file_id string, b_start long, b_end long")
    assert sorted(tuple(r) for r in I.inner_pieces(clips, segs).collect()) == [("f", 1, 50, 90), ("f", 1, 95, 100), ("f", 2, 100, 200)]


def test_points_go_to_the_turn_that_holds_them_or_the_nearer_edge(spark):
    turns = spark.createDataFrame([("f", 1, "a", 100, 200), ("f", 2, "b", 300, 400)], "file_id string, pos long, speaker string, start_ms long, end_ms long")
    points = spark.createDataFrame([("f", 50), ("f", 150), ("f", 240), ("f", 250), ("f", 260), ("f", 900), ("g", 1)], "file_id string, at_ms long")
    got = {(r.file_id, r.at_ms): r.speaker for r in I.nearest_of_two(points, turns).collect()}
    assert got == {("f", 50): "a", ("f", 150): "a", ("f", 240): "a", ("f", 250): "a", ("f", 260): "b", ("f", 900): "b", ("g", 1): None}


def test_tokens_skip_silence(spark):
    df = spark.createDataFrame([(1, "ab cd", 0, 1000, [(0, 200), (800, 1000)]), (2, "x", 10, 20, []), (3, None, 0, 1, [])], "clip_id long, text string, start_ms long, end_ms long, spans array<struct<s: long, e: long>>")
    got = [tuple(r) for r in S.approx_tokens(df).orderBy("clip_id", "i").collect()]
    assert got == [(1, 0, "ab ", 0, 200), (1, 1, "cd", 200, 1000), (2, 0, "x", 10, 20)]


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    source, table, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    for rows in ([(1, "a"), (1, "a"), (2, "b")], [(2, "again"), (3, "c")]):
        spark.createDataFrame(rows, "k long, v string").coalesce(1).write.mode("append").parquet(source)
        resume(spark.readStream.schema("k long, v string").parquet(source), table, "k", marks).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(table).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_pairs_take_every_item(spark, tmp_path):
    spark.createDataFrame([(3 * i, f"item {i}") for i in range(60)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, f"doc {i}") for i in range(130)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, A.pairs(spark, str(tmp_path)).collect()))
    assert got == [(i, f"item {i % 60}", f"doc {i}") for i in range(130)]


def core(t):
    return sum(c == "'" or unicodedata.category(c)[0] in "LN" for c in t)


def flags(text, dur, speech, terms, label, lang):
    t = (text or "").strip()
    if not t:
        return ["empty"] if speech >= 2 else []
    rest, hits = t, 0
    for w in sorted(terms, key=len, reverse=True):
        hits += rest.count(w)
        rest = rest.replace(w, "")
    foreign = {"Japanese": "[가-힣а-я]", "English": "[ぁ-ヿ가-힣一-鿿]"}.get(lang)
    said = {
        "context_label": label in t,
        "context_echo": hits >= 2 and core(rest) <= max(3, int(core(t) * 0.1)),
        "too_dense": dur > 0 and core(t) / max(dur, 1) > 18,
        "repetition": re.search(r"(?s)(.{1,20}?)\1{5,}", t) or (len(t) >= 80 and len(t.encode()) / len(zlib.compress(t.encode())) > 3.2),
        "no_punct": core(t) > 150 and len(re.findall("[、。，．,.!?！？]", t)) < 3,
        "foreign_script": foreign and re.search(foreign, t),
    }
    return [k for k, v in said.items() if v]


def test_all_flags_equal_brute_force(spark):
    rng = random.Random(7)
    made = [(None, 0, 3000), (" \n\u3000", 900, 1000), ("go " * 6, 9000, 1), ("Terms: alpha, alphabet.", 9000, 1), ("日本 語 한글", 0, 0)]
    long_ = " ".join(f"{rng.randint(0, 9)} a rather long line that comes again and again" for _ in range(20))
    made += [(long_, 90000, 1)] + [("".join(rng.choice(["alpha ", "alphabet ", "beta", ", ", ". ", "x", "語", "ж", "한", "é'", "\n"]) for _ in range(rng.choice([3, 12, 200]))), rng.choice([0, 500, 5000, 90000]), 1) for _ in range(300)]
    rows = [(i, *r, ["alpha", "alphabet", "beta"], rng.choice(["Japanese", "English", "French"])) for i, r in enumerate(made)]
    df = spark.createDataFrame(rows, "i long, text string, d long, s long, terms array<string>, lang string")
    got = df.select("i", T.quality_flags(F.col("text"), F.col("d"), F.col("s"), F.col("terms"), "Terms", lang=F.col("lang")).alias("f")).collect()
    want = {i: flags(t, d / 1000, s / 1000, w, "Terms", lang) for i, t, d, s, w, lang in rows}
    assert {r.i: r.f for r in got} == want
    assert len({f for x in want.values() for f in x}) == 7


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_error_rate_counts_the_letters_of_all_scripts(spark):
    rng = random.Random(8)
    kept = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t or "").lower() if unicodedata.category(c)[0] in "LN")
    made = [("日本語", "英語だ"), ("Привет", "пока"), ("ＡＢ１２", "ab12"), ("...", ""), ("é", "e"), (None, None), ("don't", "dont")]
    made += [tuple("".join(rng.choice(["a", "É", "ß", "語", "ｶﾞ", "㍍", "Ж", "한", "١", " ", "'", "-", "😀"]) for _ in range(rng.randint(1, 40))) for _ in range(2)) for _ in range(150)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(made)], "i long, r string, h string")
    got = {x.i: x.c for x in df.select("i", T.cer(T.normal(F.col("r")), T.normal(F.col("h"))).alias("c")).collect()}
    for i, (r, h) in enumerate(map(kept, x) for x in made):
        assert got[i] == distance(r, h) / len(r) if r else (got[i] == 0) if not h else got[i] != got[i], made[i]
    assert got[0] > 0 and got[1] > 0 and got[2] == 0


def test_ranks_count_through_all_ranges(spark):
    from spanframe.operators.tables import ranked

    rows = spark.range(0, 1000, 7).repartition(5).selectExpr("id AS k", "concat('x', id) AS v")
    assert sorted((r.k, r.v, r.n) for r in ranked(rows, "k", "n").collect()) == [(k, f"x{k}", i) for i, k in enumerate(range(0, 1000, 7))]
    assert ranked(rows.limit(0), "k", "n").count() == 0

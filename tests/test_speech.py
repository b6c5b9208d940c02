"""Operators on clips, words, cues and recognisers: literal cases, and brute force."""

import difflib
import json
import math
import random
import re
import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.functions import rewrite as R
from spanframe.functions import text as T
from spanframe.functions.distance import block_opcodes, edit_distance, edits, matching_blocks, opcodes, partial_likeness
from spanframe.operators import clips as C
from spanframe.operators import cues as Q
from spanframe.operators import metrics as M
from spanframe.operators import retry as E
from spanframe.operators import sequences as S
from spanframe.operators import words as W
from spanframe.sources import sinks

WORDS = "file_id string, pos long, speaker string, word string, start_ms long, end_ms long"
SEGS, FILES = "file_id string, start_ms long, end_ms long", "file_id string, total_ms long"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def texts(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, t string")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_times(spark):
    got = spark.createDataFrame([(x,) for x in (0.0, 59.9996, 3661.2345, 1.5, 3599.9, 0.0005, 0.0015, -3.0)], "t double").select(T.clock(T.whole_ms(F.col("t"))).alias("c"), T.clock(T.whole_ms(F.col("t")), ".").alias("v"), T.hms(F.floor(F.col("t") * 1000)).alias("h"), T.duration(F.col("t")).alias("d")).collect()
    assert [r.c for r in got] == ["00:00:00,000", "00:01:00,000", "01:01:01,234", "00:00:01,500", "00:59:59,900", "00:00:00,000", "00:00:00,002", "00:00:00,000"]
    assert got[3].v == "00:00:01.500" and got[4].h == "00:59:59" and [got[i].d for i in (2, 3, 4)] == ["1:01:01", "1.5秒", "1:00:00"]


def restored(text, tokens):
    return [w for w, *_ in W.restored(text, [(t, float(i), i + 1.0) for i, t in enumerate(tokens)])]


def test_punctuation_comes_back_to_tokens():
    text = "今日は、晴れです。明日も「たぶん」晴れ！"
    out = restored(text, ["今日", "は", "晴れ", "です", "明日", "も", "たぶん", "晴れ"])
    assert "".join(out) == text and [out[i] for i in (1, 3, 5, 6, 7)] == ["は、", "です。", "も", "「たぶん」", "晴れ！"]
    text = "C++とAI-drivenで50%削減、OK?"
    out = restored(text, ["C", "と", "AIdriven", "で", "50", "削減", "OK"])
    assert "".join(out) == text and [out[i] for i in (0, 2, 4)] == ["C++", "AI-driven", "50%"]
    assert restored("Hello, world. It's fine.", ["Hello", "world", "It's", "fine"])[0] == "Hello, "
    assert "".join(restored("あいうえお", ["あい", "ZZZ", "えお"])) == "あいうえお"
    assert restored("abc", ["x", " "]) == ["x"] and restored("abc", []) == []
    rng = random.Random(1)
    for _ in range(300):
        words = ["".join(rng.choice("abcé日1'") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))]
        text = "".join(rng.choice(["", "「", "-"]) + (rng.choice("-.").join(w) if rng.random() < 0.2 else w) + rng.choice([" ", ", ", "。", ""]) for w in words)
        out = restored(text, words)
        assert "".join(out) == text


def clips(spark, segs, total, levels=None, **kw):
    files = spark.createDataFrame([("f", total)], FILES)
    frames = None if levels is None else spark.createDataFrame([("f", i, float(x)) for i, x in enumerate(levels)], "file_id string, frame long, db float")
    return C.build_clips(spark.createDataFrame([("f", *s) for s in segs], SEGS), files, frames, **kw).orderBy("clip_id").collect()


def packed(segs, body, gap):
    out = []
    for s, e in segs:
        if out and e - out[-1][0] <= body and s - out[-1][1] <= gap:
            out[-1][1] = e
        else:
            out.append([s, e])
    return out


def test_clips_are_packed_cut_and_owned(spark):
    a, b = clips(spark, [(500, 3000), (3500, 10000), (11000, 20000), (40000, 45000)], 60000, pad_ms=200)
    assert (a.start_ms, a.end_ms, a.own_start, a.own_end) == (300, 20200, None, 30000.0) and (b.start_ms, b.own_start, b.own_end) == (39800, 30000.0, None)
    assert a.speech_ms == 18000 and not a.cut
    some = clips(spark, [(0, 14000), (14300, 27000), (27300, 40000)], 40000)
    assert len(some) >= 2 and all(x.end_ms > y.start_ms and x.own_end == y.own_start for x, y in zip(some, some[1:])) and all(c.end_ms - c.start_ms <= 30000 for c in some)
    levels = np.full(5000, 60.0)
    levels[2350:2360] = 0
    a, b = clips(spark, [(0, 100000)], 100000, levels, max_clip_ms=60000)
    assert 46900 <= a.own_end == b.own_start <= 47300 and a.end_ms == a.own_end + 1000 and b.start_ms == b.own_start - 1000 and a.cut and not b.cut
    a, b = clips(spark, [(0, 100000)], 100000, max_clip_ms=60000)
    assert a.own_end == round((max(30000, 5000) + min(58000, 62500)) / 2)
    rng = random.Random(2)
    segs, at = [], 0
    for _ in range(200):
        at += rng.randint(100, 9000)
        segs.append((at, at + rng.randint(60, 12000)))
        at = segs[-1][1]
    got = clips(spark, segs, at + 10000, pad_ms=0, overlap_ms=0)
    assert [[c.start_ms, c.end_ms] for c in got] == packed(segs, 30000, 6000)


def test_no_clip_is_too_long(spark):
    levels = np.random.default_rng(0).uniform(30, 70, 60000)
    for longest in (15000, 60000):
        got = clips(spark, [(0, 200000), (205000, 210000), (210500, 900000), (901000, 1200000)], 1200000, levels, max_clip_ms=longest)
        assert max(c.end_ms - c.start_ms for c in got) <= longest and all(x.own_end == y.own_start for x, y in zip(got, got[1:]))


def test_quietest_moment_and_halves(spark):
    flat = np.full(100, 60.0, np.float32)
    assert C.quietest(flat, 0, 0, 2000, 100) == 10.0 and C.quietest(None, 0, 0, 2000, 0) == 1000 and C.quietest(flat, 0, 5, 5, 100) == 5 and C.quietest(flat, 0, 0, 30, 100) == 15
    clip = spark.createDataFrame([("f", 3, 0, 10000, None, 9000.0, 8000, False, None)], "file_id string, clip_id long, start_ms long, end_ms long, own_start double, own_end double, speech_ms long, cut boolean, parent long")
    l, r = C.split_clips(clip).orderBy("part").collect()
    assert (l.start_ms, l.end_ms, l.own_end, l.cut, l.parent) == (0, 5500, 5000.0, True, 3) and (r.start_ms, r.end_ms, r.own_start, r.own_end, r.cut) == (4500, 10000, 5000.0, 9000.0, False)
    assert l.speech_ms == r.speech_ms == 4400


CLIP = "file_id string, clip_id long, start_ms long, end_ms long, own_start double, own_end double, speech_ms long, cut boolean, parent long"


def clip_rows(spark, rows):
    return spark.createDataFrame([("f", i, a, b, None, None, s, False, None) for i, a, b, s in rows], CLIP)


def test_flagged_clips_are_read_again_and_halved(spark):
    def recognise(asked):
        long_ = F.col("end_ms") - F.col("start_ms") > 15000
        said = F.when(long_ & (F.col("context") != ""), "固有名詞: Claude、Gemini。").when(long_, "はい。" * 10).otherwise("これは普通の発話です。")
        return asked.select("file_id", "clip_id", said.alias("text"), F.lit(None).cast("string").alias("language"), F.lit(None).cast(E.WORDS).alias("words"))

    rows = clip_rows(spark, [(0, 0, 10000, 9000), (1, 10000, 30000, 18000), (2, 30000, 35000, 4500)])
    got = E.recognised(rows, recognise, context="固有名詞: Claude、Gemini。", terms=("Claude", "Gemini"), label="固有名詞").orderBy("start_ms", "clip_id").collect()
    assert [r.parent for r in got].count(1) == 2 and all("Claude" not in r.text and not r.flags for r in got)
    left, right = (r for r in got if r.parent == 1)
    assert left.own_end == right.own_start and (left.clip_id, right.clip_id) == (3, 4)
    assert [a.kind for a in left.attempts] == ["text", "text", "split_from", "text"] and left.attempts[0].ctx and not left.attempts[1].ctx
    assert [r.clip_id for r in E.review_items(E.recognised(rows, recognise, context="固有名詞: Claude、Gemini。", label="固有名詞")).orderBy("clip_id").collect()] == [3, 4]
    done = E.recognised(rows.where("clip_id = 0"), recognise).withColumn("text", F.lit("もう済んだ。"))
    again = {r.clip_id: r.text for r in E.recognised(rows, recognise, policy=E.Policy(enabled=False), done=done).collect()}
    assert again[0] == "もう済んだ。" and len(again) == 3


def test_loops_are_shortened_and_silence_is_an_error(spark):
    loop = lambda asked: asked.select("file_id", "clip_id", F.lit("そうですね" * 9).alias("text"), F.lit("").alias("language"), F.lit(None).cast(E.WORDS).alias("words"))
    r = E.recognised(clip_rows(spark, [(0, 0, 6000, 5000)]), loop).first()
    assert r.flags == ["repetition"] and r.text == "そうですね" * 2 and r.attempts[-1].kind == "collapsed"
    with pytest.raises(Exception, match="no answer"):
        E.recognised(clip_rows(spark, [(0, 0, 6000, 5000)]), lambda a: loop(a).limit(0)).collect()


def test_a_second_opinion_is_taken_if_better_and_not_too_short(spark):
    said = lambda text: lambda asked: asked.select("file_id", "clip_id", F.element_at(F.split(F.lit(text), "@"), (F.floor(F.col("start_ms") / 100000) + 1).cast("int")).alias("text"), F.lit("").alias("language"), F.lit(None).cast(E.WORDS).alias("words"))
    rows = clip_rows(spark, [(0, 0, 20000, 15000), (1, 100000, 120000, 15000), (2, 200000, 220000, 15000)])
    long_ = "".join(chr(0x4E00 + i) for i in range(160))
    first = E.recognised(rows, said(f"{'はい。' * 10}@{long_}@普通です。"), policy=E.Policy(enabled=False))
    speech = spark.createDataFrame([("f", a, b) for a, b in ((0, 4000), (9000, 20000), (100000, 120000))], SEGS)
    got = E.second_opinion(first, said("短い文。@少ない。@x"), "other", speech, max_clip_ms=12000, max_gap_ms=1000).orderBy("clip_id").collect()
    assert got[0].text == "短い文。" * 2 and got[0].flags == [] and got[0].attempts[-1].adopted == "other" and got[0].attempts[-2].pieces == 2
    assert got[1].text == long_ and got[1].flags == ["no_punct"] and got[1].attempts[-1].rejected
    assert got[2].text == "普通です。" and len(got[2].attempts) == 1


def test_words_of_overlapping_clips_are_taken_once(spark):
    none = F.lit(None).cast(E.WORDS)
    res = spark.createDataFrame([("f", 0, 0, 31000, None, 30000.0, "前半です。境界"), ("f", 1, 29000, 60000, 30000.0, None, "境界の後半です。"), ("f", 2, 60000, 70000, None, None, "今日は晴れ。明日は雨です。"), ("f", 3, 0, 1, None, None, "")], "file_id string, clip_id long, start_ms long, end_ms long, own_start double, own_end double, text string").withColumns({"flags": F.array().cast("array<string>"), "words": none})
    tok = lambda *xs: [{"tok": t, "s": float(s), "e": float(e)} for t, s, e in xs]
    aligned = spark.createDataFrame([("f", 0, tok(("前半", 1000, 2000), ("です", 2000, 3000), ("境界", 29600, 30600))), ("f", 1, tok(("境界", 600, 1600), ("の", 1600, 1800), ("後半", 2000, 3000), ("です", 3000, 4000)))], f"file_id string, clip_id long, tokens {E.WORDS}")
    speech = spark.createDataFrame([("f", 61000, 63000), ("f", 65000, 68000)], SEGS)
    words, told = W.compose_words(res, aligned, speech)
    rows = words.orderBy("pos").collect()
    assert "".join(r.word for r in rows) == "前半です。境界の後半です。今日は晴れ。明日は雨です。"
    assert [r.start_ms for r in rows if r.clip_id == 2][0] == 61000 and max(r.end_ms for r in rows) == 68000
    stats = W.word_stats(told).first()
    assert (stats.aligner, stats.approx, stats.rescued, stats.trimmed_much) == (2, 1, 0, 0) and stats.coverage < 1
    short = W.compose_words(res.where("clip_id = 2").withColumn("own_start", F.lit(69000.0)), aligned, speech)[1].first()
    assert short.flags == ["trimmed"]


def test_running_sums(spark):
    for n in (0, 1, 31, 32, 33, 100):
        got = one(spark, S.running(F.array(*[F.lit(i * i).cast("bigint") for i in range(n)]) if n else F.array().cast("array<bigint>")))
        assert got == np.cumsum([i * i for i in range(n)]).tolist()


def word_rows(rng, n):
    rows, at, speaker = [], 0, "a"
    for i in range(n):
        at += rng.choice([0, 0, 50, 900, 4000]) if rng.random() < 0.3 else 0
        speaker = rng.choice("ab") if rng.random() < 0.05 else speaker
        word = "".join(rng.choice("abcdeé語") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", " ", ", ", "、", ".", ". ", "。", "!", "…」 "])
        end = at + rng.randint(20, 900)
        rows.append(("f", i, speaker, word, at, end))
        at = end
    return rows


def ends(words, i):
    w = words[i][3]
    last = i + 1 == len(words)
    return bool(re.search(r"[。！？!?…‥]+[」』）)\]】〕”’\"']*\s*$", w) or re.search(r"[.．][」』）)\]】〕”’\"']*\s+$", w) or (last and re.search(r"[.．][」』）)\]】〕”’\"']*$", w.rstrip())))


def split(words, pause, most, on_speaker):
    out, size = [], 0
    for i, w in enumerate(words):
        if not out or size is None or w[4] - words[i - 1][5] > pause or (on_speaker and w[2] != words[i - 1][2]):
            out.append([])
            size = 0
        out[-1].append(w)
        size += len(w[3])
        if ends(words, i) or size >= most:
            size = None
    return out


def test_sentences_paragraphs_equal_brute_force(spark):
    rng = random.Random(3)
    for most in (150, 40):
        rows = word_rows(rng, 600)
        want = split(rows, 1500, most, True)
        ids = S.sentence_ids(spark.createDataFrame(rows, WORDS), most_chars=most)
        got = [r.sent_id for r in ids.orderBy("pos").collect()]
        assert got == [i + 1 for i, s in enumerate(want) for _ in s]
        sents = [(s[0][4], s[-1][5], s[0][2], "".join(w[3] for w in s).strip()) for s in want]
        paras = []
        for s, e, who, text in sents:
            p = paras[-1] if paras else None
            if p and p[2] == who and s - p[1] <= 3000 and len(p[3]) + len(text) <= 120:
                tight = p[3][-1] in "。！？!?」』" or not p[3][-1].isascii()
                paras[-1] = [p[0], e, who, p[3] + ("" if tight else " ") + text]
            else:
                paras.append([s, e, who, text])
        mine = S.paragraphs(S.sentences(ids), most_chars=120).orderBy("par_id").collect()
        assert [[r.start_ms, r.end_ms, r.speaker, r.text] for r in mine] == paras
    text = spark.createDataFrame([("f", i, 0, 0, "a", t) for i, t in enumerate(["Yes!", "No", "(a)", "b"])], "file_id string, sent_id long, start_ms long, end_ms long, speaker string, text string")
    assert S.paragraphs(text).first().text == "Yes!No (a) b"


def cues(words, rules):
    """The stream word by word."""
    n, rest, acc = len(words), [0] * len(words), 0
    for i in reversed(range(n)):
        if i + 1 == n or ends(words, i) or words[i + 1][4] - words[i][5] >= rules.gap_ms:
            acc = 0
        rest[i], acc = acc, acc + len(words[i][3])
    clause = lambda w: re.search(r"[、，,;；:：][」』）)\]】〕”’\"']*\s*$", w[3])
    size = lambda ws: len("".join(w[3] for w in ws).strip())
    full = lambda cur, w: w[5] - cur[0][4] > rules.most_ms or size(cur) + len(w[3].strip()) > rules.most_chars
    out, cur = [], []
    for i, w in enumerate(words):
        if cur and (w[4] - cur[-1][5] >= rules.gap_ms or w[2] != cur[0][2]):
            out.append(cur)
            cur = []
        if cur and full(cur, w):
            k = next((j for j in range(len(cur) - 1, len(cur) // 3 - 1, -1) if clause(cur[j]) or ends(cur, j)), len(cur) - 1)
            out.append(cur[: k + 1])
            cur = cur[k + 1 :]
            if cur and full(cur, w):
                out.append(cur)
                cur = []
        cur = [*cur, w]
        length = size(cur)
        if (ends(words, i) and length >= rules.least_sentence) or (clause(w) and length + rest[i] > rules.most_chars and length >= max(4, int(rules.most_chars * 0.35))):
            out.append(cur)
            cur = []
    return [c for c in [*out, cur] if c and "".join(w[3] for w in c).strip()]


def test_cues_equal_brute_force(spark):
    rng = random.Random(5)
    rules = Q.CueRules(most_chars=24, most_ms=4000)
    rows = word_rows(rng, 1500)
    want = cues(rows, rules)
    got = Q.make_cues(spark.createDataFrame(rows, WORDS), rules=rules).orderBy("cue").collect()
    assert [r.text for r in got] == ["".join(w[3] for w in c).strip() for c in want]
    assert [r.start_ms for r in got] == [c[0][4] for c in want]
    tokens = [("今日", 0, 300), ("は", 300, 400), ("会議", 400, 800), ("です", 800, 1000), ("まず", 1500, 1800), ("予算", 1800, 2200), ("について", 2200, 2600), ("説明", 2700, 3000), ("し", 3000, 3100), ("ます", 3100, 3300), ("次に", 5000, 5300), ("日程", 5300, 5700), ("です", 5700, 6000)]
    rows = [("f", i, None, w, int(s), int(e)) for i, (w, _, s, e) in enumerate(W.restored("今日は会議です。まず予算について、説明します。次に日程です。", tokens))]
    made = Q.make_cues(spark.createDataFrame(rows, WORDS), R.Clean(), Q.CueRules(most_chars=16, least_sentence=5))
    assert [r.text for r in made.orderBy("cue").collect()] == ["今日は会議です。", "まず予算について、説明します。", "次に日程です。"]
    assert sinks.srt(made).first().srt.startswith("1\n00:00:00,000 --> 00:00:01,200\n今日は会議です。\n")


def test_texts_are_cleaned(spark):
    rules = R.parse_rules("クロード => Claude\nre:ジェミ[ニ二] → Gemini\n# comment\nＡＩ\tAI\nre:( => x\n => y\na \t b")
    assert rules == [R.Rule("クロード", "Claude"), R.Rule("ジェミ[ニ二]", "Gemini", True), R.Rule("ＡＩ", "AI"), R.Rule("a", "b")]
    clean = R.Clean(tuple(rules[:3]), tuple(R.FILLERS))
    assert texts(spark, clean, ["えー、今日は クロード と ジェミ二の話です。", "あのー、ＡＩについて、えーと、話します。", "Hello world です", "　x "]) == ["今日はClaudeとGeminiの話です。", "AIについて、話します。", "Hello world です", "x"]
    own = R.parse_rules("re:(?P<a>um)(x)? => <\\g<a>$\\2>\nre:a(?#c) => \\3\nre:b => \\q\nre:(?i)OK\\b => ok\nre:(?P<w>z)(?P=w) => \\g<nix>\nx => y\nre:(z)\\1 => Z")
    assert [r.source for r in own] == ["(?P<a>um)(x)?", "(?i)OK\\b", "x", "(z)\\1"]
    assert texts(spark, lambda t: R.apply_rules(t, own), ["um zz Ok oKx", "umx"]) == ["<um$> Z ok oKy", "<um$y>"]
    rng = random.Random(6)
    made = ["".join(rng.choice([*R.FILLERS[:5], "ー", "、", "。", " ", "話", "え", "x", "「", "」", "，"]) for _ in range(rng.randint(1, 14))) for _ in range(800)]
    rx = re.compile(R.BEFORE + "(?:" + "|".join(re.escape(w) + "ー*" for w in sorted(R.FILLERS, key=len, reverse=True)) + ")" + R.AFTER)

    def brute(s):
        before = None
        while before != s:
            before, s = s, rx.sub("", s)
        return re.sub(r"[、，,]\s*([。．.!?！？])", r"\1", re.sub(r"^[、，,\s]+", "", s))

    assert texts(spark, lambda t: R.remove_fillers(t, R.FILLERS), made) == [brute(s) for s in made]
    assert texts(spark, lambda t: R.remove_fillers(t, ["um", "you know"]), ["you you you you um know know know know, ok", "Um, um"]) == ["ok", "Um, "]
    for _ in range(25):
        fillers = list({" ".join(rng.choice(["a", "b", "um", "aー"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 4))})
        rx = re.compile(R.BEFORE + "(?:" + "|".join(re.escape(w) + "ー*" for w in sorted(fillers, key=len, reverse=True)) + ")" + R.AFTER)
        made = ["".join(rng.choice(["a", "b", "um", " ", " ", ", ", ".", "aー", "x", "\n"]) for _ in range(rng.randint(1, 40))) for _ in range(60)]
        assert texts(spark, lambda t: R.remove_fillers(t, fillers), made) == [brute(s) for s in made]


def test_documents_are_cleaned_as_by_hand(spark):
    from spanframe.plans.speech import RULES, i13_clean_text

    space, wide = re.compile(r"(?<=[぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ、。！？])[ \t　]+(?=[぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ、。！？])"), str.maketrans({chr(ord(c) + 0xFEE0): c for c in string.digits + string.ascii_letters})
    rx = re.compile(R.BEFORE + "(?:theー*|ofー*)" + R.AFTER)

    def by_hand(t):
        t = space.sub("", t).translate(wide)
        for r in RULES:
            t = re.sub(r.source, r.target, t) if r.pattern else t.replace(r.source, r.target)
        while (u := rx.sub("", t)) != t:
            t = u
        return re.sub(r"[、，,]\s*([。．.!?！？])", r"\1", re.sub(r"^[、，,\s]+", "", t)).strip()

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id: r.text for r in i13_clean_text(spark, "/root/testdata/sf0.001").collect()} == {k: by_hand(t) for k, t in docs.items()}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_distances_and_edits(monkeypatch):
    from spanframe.functions import distance as D

    rng = random.Random(7)
    for n in range(400):
        monkeypatch.setattr(D, "MOST_BITS", rng.choice([1 << 27, 40]))
        a, b = ("".join(rng.choice("abc日") for _ in range(rng.randint(0, 40))) for _ in range(2))
        if n % 4 == 0:
            b = a[: len(a) // 2] + "x" + a[len(a) // 2 + 3 :]
        all_ = edits(a, b)
        assert edit_distance(a, b) == distance(a, b) == len(all_) - all_.count("=")
        out = "".join(b[k:l] if tag != "delete" else "" for tag, _, _, k, l in opcodes(a, b))
        assert out == b and all(a[i:j] == b[k:l] for tag, i, j, k, l in opcodes(a, b) if tag == "equal")
    assert edit_distance("x" * 3000, "y" * 2000) == 3000


def test_measures(spark):
    ref = "山田さんは3月5日に1,200円払いました。田中さんは三回来ました。"
    hyp = "山田さんは3月6日に1,200円払いました。中田さんは三回来ました。"
    three = "今日は良い天気ですね。明日は雨が降るでしょう。午後から会議です。"
    pairs = [(ref, hyp), (three, three), (three, "今日は良い天気ですね。午後から会議です。"), (three, "今日はいい天気ですね。明日は雨がふるでしょう。午後から会議です。"), ("わたしはきのう図書館で本を借りました。あなたは何をしていましたか。", "わたしはきのう図書館で本を借りました。は。"), ("今日は行かない。雨は降りません。", "今日は行く。雨は降りません。"), ("明日は行く。", "明日は行かない。"), ("あいうえお", "あいうえか"), ("ＡＢＣ", "abc"), ("", "x"), (None, None)]
    rows = M.measured(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, ref string, hyp string"), terms=["山田", "田中"]).orderBy("i").collect()
    assert tuple(rows[0].terms) == (1, 2) and tuple(rows[0].numbers) == (3, 4)
    assert tuple(rows[1].drops) == (0, 0) and tuple(rows[2].drops) == (1, len("明日は雨が降るでしょう")) and tuple(rows[3].drops) == (0, 0) and rows[4].drops.runs == 1 and rows[4].drops.chars >= 12
    assert tuple(rows[5].negations) == (1, 2, 0) and tuple(rows[6].negations) == (0, 0, 1)
    assert rows[7].cer == 0.2 and rows[8].cer == 0 and math.isnan(rows[9].cer) and rows[10].cer == 0
    runs = spark.createDataFrame([("f", 0, "m", "M", "abcd", 2.0, 9.0, 1.0, 60.0, 0, None), ("f", 1, "n", "N", "abxd", None, 3.0, 1.0, 60.0, 1, None), ("f", 2, "o", "O", None, None, None, None, None, None, "gone")], "file_id string, place int, preset string, label string, text string, asr_sec double, wall_sec double, load_sec double, duration double, flags int, error string")
    got = {r.preset: r for r in M.compare(runs, terms=["ab"]).collect()}
    assert (got["m"].x_realtime, got["n"].x_realtime, got["n"].diff_vs_first, got["m"].diff_vs_first, got["m"].terms_found) == (30.0, 20.0, 0.25, None, 1) and got["o"].error == "gone"
    assert M.diff_html("a<b", "a<c") == "a&lt;<del style='background:#fdd;text-decoration:line-through'>b</del><ins style='background:#dfd;text-decoration:none'>c</ins>"
    timings = F.create_map(*[F.lit(x) for kv in {"audio": 2.0, "vad": 0.01, "asr": 37.1, "total": 69.0}.items() for x in kv])
    assert one(spark, M.timing_breakdown(timings, F.lit(34.0))) == "音声の変換 2.0秒・モデルの読み込み待ち 34.0秒・文字起こし 3.1秒・書き出しなど 29.9秒"


def test_texts_of_contexts_and_joins(spark):
    assert one(spark, T.context(F.lit("固有名詞・専門用語"), F.array(F.lit("Claude"), F.lit("Gemini")))) == "固有名詞・専門用語: Claude、Gemini。"
    assert one(spark, T.context(F.lit(""), F.array().cast("array<string>"))) == ""
    assert one(spark, T.joined_texts(F.array(*map(F.lit, ["今日は", " 晴れ。", "", "Claude", "Code を使う"])))) == "今日は晴れ。Claude Code を使う"
    assert texts(spark, T.close_cjk_blanks, ["今 日", "a 日", "ｱ ｲ", "（ 日"]) == ["今日", "a 日", "ｱ ｲ", "（日"]


def test_names(spark):
    words = spark.createDataFrame([("f", 0, "S0"), ("f", 1, None), ("f", 2, "S1")], "file_id string, pos long, speaker string")
    names = lambda *a: {r.speaker: r["name"] for r in S.speaker_names(words, *a).collect()}
    assert names() == {"S0": "話者A", "S1": "話者B"} and names("話者A", "話者A=田中, S1=佐藤") == {"S0": "田中", "S1": "佐藤"}
    assert names("SPEAKER_00", "山田、鈴木") == {"S0": "山田", "S1": "鈴木"} and names("S1") == {"S0": "S1", "S1": "S2"}


def test_outputs(spark):
    words = spark.createDataFrame([("会議 1", 0, "S0", "こんにちは。", 0, 1000), ("会議 1", 1, "S1", "はい。", 1500, 2000)], WORDS)
    names = S.speaker_names(words)
    row = ("会議 1", 0, 0, 2500, None, None, 2000, False, None, "こんにちは。はい。", "", ["repetition"], [("text", False, "はい", ["repetition"], None, None, None, None, None, None, None)], None)
    res = spark.createDataFrame([row], f"{CLIP}, text string, language string, flags array<string>, attempts {E.ATTEMPTS}, words {E.WORDS}")
    turns = words.select("file_id", "pos", "start_ms", "end_ms", "speaker")
    got = {r["name"]: r.content for r in sinks.outputs(words, res, turns, names, ("txt", "plain", "srt", "vtt", "csv", "md", "json", "rttm"), meta={"version": "test"}).collect()}
    doc = json.loads(got["会議 1.json"])
    assert doc["segments"][1]["speaker"] == "話者B" and doc["segments"][0]["words"][0]["word"] == "こんにちは。" and "own_start" not in doc["clips"][0] and doc["version"] == "test" and doc["clips"][0]["attempts"]
    assert got["会議 1.rttm"].splitlines()[0] == "SPEAKER 会議_1 1 0.000 1.000 <NA> <NA> 話者A <NA> <NA>"
    assert got["会議 1.txt"] == "[00:00:00] 話者A: こんにちは。\n[00:00:01] 話者B: はい。\n" and got["会議 1_plain.txt"].startswith("話者A: ")
    assert got["会議 1.csv"].startswith("\ufeffstart,end") and not any(t.startswith("\ufeff") for n, t in got.items() if n != "会議 1.csv")
    md = got["会議 1_review.md"]
    assert "同じ言葉のループ" in md and "context なし): はい" in md and "- **採用した結果**: こんにちは。はい。" in md
    assert sinks.output_base("/a/b.wav", "") == "/a/b" and sinks.output_base("/a/b.wav", "out/") == "out/b" and sinks.output_base("/a/b.wav", "o/x.txt") == "o/x" and sinks.output_base("/a/b.wav", "o/x.txt", True) == "o/x.txt/b"


def test_dummies(spark):
    clips_ = spark.createDataFrame([("f", 0, 0, 10000, "", "あ、い'x"), ("f", 1, 0, 100, "ECHO", "")], "file_id string, clip_id long, start_ms long, end_ms long, context string, text string")
    assert [r.text for r in E.dummy_recogniser(clips_).orderBy("clip_id").collect()] == ["これは1番目の文です。これは2番目の文です。これは3番目の文です。", "ECHO"]
    tokens = E.dummy_aligner(clips_).orderBy("clip_id").first().tokens
    assert [(t.tok, t.s, t.e) for t in tokens] == [("あ", 0, 2500), ("い", 2500, 5000), ("'", 5000, 7500), ("x", 7500, 10000)]
    turns = E.dummy_turns(spark.createDataFrame([("f", 25000), ("g", 0)], FILES)).orderBy("pos").collect()
    assert [(r.start_ms, r.end_ms, r.speaker) for r in turns] == [(0, 10000, "SPEAKER_00"), (10000, 20000, "SPEAKER_01"), (20000, 25000, "SPEAKER_00")]


def test_speech_of_nearly_silent_files_is_the_whole(spark):
    segs = spark.createDataFrame([("a", 0, 100), ("b", 0, 5000)], SEGS)
    files = spark.createDataFrame([("a", 10000), ("b", 10000), ("c", 10000), ("d", 4000)], FILES)
    assert sorted(tuple(r) for r in C.or_whole_file(segs, files).collect()) == [("a", 0, 10000), ("b", 0, 5000), ("c", 0, 10000)]


def test_long_words_are_assigned_and_ties_go_to_the_earliest(spark):
    from spanframe.operators.intervals import assign_speakers

    turns = spark.createDataFrame([("f", 0, "A", 0, 10000), ("f", 1, "B", 1000, 2000), ("f", 2, "C", 900000, 1500000)], "file_id string, pos long, speaker string, start_ms long, end_ms long")
    words = spark.createDataFrame([("f", 0, "x", 4900, 5100), ("f", 1, "x", 1200, 1900), ("f", 2, "x", 20000, 1000000), ("f", 3, "x", 10500, 10600)], "file_id string, pos long, word string, start_ms long, end_ms long")
    assert {r.pos: r.speaker for r in assign_speakers(words, turns).collect()} == {0: "A", 1: "A", 2: "C", 3: "A"}


def test_diff_of_equal_texts_is_no_diff():
    assert opcodes("abc", "abc") == [("equal", 0, 3, 0, 3)] == [tuple(x) for x in difflib.SequenceMatcher(None, "abc", "abc").get_opcodes()]


def test_blocks_are_those_of_a_quadratic_search():
    rng = random.Random(11)
    for _ in range(600):
        a, b = ("".join(rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 40))) for _ in range(2))
        if rng.random() < 0.3:
            b = a[: rng.randint(0, 20)] + b + a[rng.randint(0, 20) :]
        plain = difflib.SequenceMatcher(None, a, b, autojunk=False)
        assert matching_blocks(a, b) == [tuple(x) for x in plain.get_matching_blocks() if x.size] and block_opcodes(a, b) == [tuple(x) for x in plain.get_opcodes()]
    long_ = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    assert matching_blocks(long_, long_[:9000] + "X" + long_[9000:]) == [(0, 0, 9000), (9000, 9001, 11_000)]


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[-1]))
    return row[-1]


def likest(a, b):
    """By trying all windows."""
    if not a or not b:
        return float(a == b)
    ways = [(a, b), (b, a)] if len(a) == len(b) else [sorted((a, b), key=len)]
    best = 0.0
    for s, t in ways:
        for i in range(1 - len(s), len(t)):
            w = t[max(0, i) : i + len(s)]
            best = max(best, 2 * subsequence(s, w) / (len(s) + len(w)))
    return best


def test_windows_are_compared_as_by_trying_all(monkeypatch):
    rng = random.Random(12)
    for k in range(250):
        size = rng.choice([1, 3, 9, 64, 65, 130]) if k % 10 == 0 else rng.randint(1, 12)
        a = "".join(rng.choice("abcdeé") for _ in range(size))
        b = "".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 30)))
        if rng.random() < 0.4:
            b = b + a[1:] + b
        assert partial_likeness(a, b) == pytest.approx(likest(a, b)) == partial_likeness(b, a)
    from spanframe.functions import distance

    whole = distance.window_likeness("abcde" * 40, "xabced" * 500)
    monkeypatch.setattr(distance, "MOST_WINDOWS", 64)
    assert distance.window_likeness("abcde" * 40, "xabced" * 500) == whole
    assert partial_likeness("", "") == 1 and partial_likeness("", "a") == partial_likeness("a", "") == 0


def test_dropped_utterances_equal_trying(spark):
    from spanframe.plans.speech import i31_dropped_utterances
    from spanframe.sources import adapters

    rng = random.Random(13)
    said, whole, want = [], [], {}
    for f in range(12):
        us = ["".join(rng.choice("abcdefg ,") for _ in range(rng.randint(0, 14))) for _ in range(rng.choice([3, 200]))]
        text = None if f == 3 else "".join(rng.choice(["", u, u[1:], u[::-1]]) for u in us[:20])
        said += [(f, i, u) for i, u in enumerate(us)] + [(f, None, None)]
        whole += [(f, text)] if f != 4 else []
        bare = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
        kept = [bare(u) for u in us if len(bare(u)) >= 4]
        want[f] = len(kept), sum(likest(u, bare(text) if f != 4 else "") < 0.6 for u in kept)
    got = M.dropped_utterances(spark.createDataFrame(said, "file_id long, utt_id long, text string"), spark.createDataFrame(whole, "file_id long, text string"))
    assert {r.file_id: (r.utterances, r.dropped) for r in got.collect()} == {f: n for f, n in want.items() if n[0]}
    assert sum(n[1] for n in want.values()) > 20
    docs = {r.doc_id: r for r in i31_dropped_utterances(spark, "/root/testdata/sf0.001").selectExpr("file_id AS doc_id", "utterances", "dropped").collect()}
    some = sorted(adapters.pairs(spark, "/root/testdata/sf0.001").collect(), key=lambda r: len(r.hyp) * len(r.ref))[:12]
    for r in some:
        bare = lambda t: "".join(c for c in t.lower() if c.isalnum())
        us = [bare(u) for u in r.ref.split(".") if len(bare(u)) >= 4]
        assert (docs[r.doc_id].utterances, docs[r.doc_id].dropped) == (len(us), sum(u not in bare(r.hyp) and likest(u, bare(r.hyp)) < 0.6 for u in us))


def test_differences_equal_the_library(spark):
    import html

    from spanframe.plans.speech import b13_differences, i13_clean_text  # noqa: F401

    rng = random.Random(14)
    for _ in range(100):
        a, b = ("".join(rng.choice("ab<&c") for _ in range(rng.randint(0, 30))) for _ in range(2))
        want = ""
        for tag, i, j, k, l in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            want += html.escape(a[i:j]) if tag == "equal" else (f"<del style='background:#fdd;text-decoration:line-through'>{html.escape(a[i:j])}</del>" if j > i else "") + (f"<ins style='background:#dfd;text-decoration:none'>{html.escape(b[k:l])}</ins>" if l > k else "")
        assert M.diff_html(a, b) == want
    rows = b13_differences(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    back = lambda x: html.unescape(re.sub("<ins[^>]*>.*?</ins>|<del[^>]*>|</del>", "", x, flags=re.S))
    assert {r.doc_id: back(r.html) for r in rows} == {k: t[:20_000] for k, t in docs.items()} and any("<del" in r.html for r in rows)


def test_written_outputs_are_those_of_each_format(spark):
    from spanframe.operators.sequences import labelled, paragraphs, sentence_ids, sentences
    from spanframe.plans import speech

    d = "/root/testdata/sf0.001"
    got = {r["name"]: r.content for r in speech.b9_outputs(spark, d).collect()}
    words, results = speech._conversed(spark, d)
    names, plain = S.speaker_names(words), words.select("file_id", "pos", "speaker", "word", "start_ms", "end_ms")
    ids = sentence_ids(plain)
    sents = sentences(ids)
    known = labelled(sents, names)
    paras, cues = paragraphs(known), labelled(Q.make_cues(plain), names)
    one = {
        ".txt": (sinks.transcript(paras, "par_id"), "txt"), "_plain.txt": (sinks.transcript(paras, "par_id", False), "txt"), ".md": (sinks.markdown(paras, "par_id", "", {"version": "1"}), "md"),
        ".srt": (sinks.srt(cues), "srt"), ".vtt": (sinks.vtt(cues), "vtt"), ".csv": (sinks.csv_table(known, "sent_id"), "csv"), ".json": (sinks.json_documents(sents, ids, results, names, {"version": "1"}), "json"),
        ".rttm": (sinks.rttm(labelled(plain.drop("word"), names)), "rttm"), "_review.md": (sinks.review(E.review_items(results)), "review"),
    }
    want = {f"{r.file_id}{ext}": ("\ufeff" if ext == ".csv" else "") + r[name] for ext, (df, name) in one.items() for r in df.collect()}
    assert got == want and len(got) > 8 * 20
    turns = {}
    for r in spark.read.parquet(f"{d}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.text))
    for r in speech.b5_json(spark, d).collect():
        doc = json.loads(r.json)
        said = [(t, x) for t, x in sorted(turns[r.file_id]) if x.split()]
        assert [(c["id"], c["text"]) for c in doc["clips"]] == [(t, x.strip()) for t, x in said]
        assert all(c["flags"] and c["attempts"] if "flags" in c and c["flags"] else True for c in doc["clips"])
        spoken = [w["word"] for g in doc["segments"] for w in g["words"]]
        assert "".join(spoken) == "".join(re.sub(r"^\s+", "", x) for _, x in said) and all(g["text"] == "".join(w["word"] for w in g["words"]).strip() for g in doc["segments"])
        assert [c["start"] for c in doc["clips"]] == sorted(c["start"] for c in doc["clips"])


def test_outputs_send_no_words_again(spark):
    from spanframe.plans import speech
    from spanframe.sources.shared import once

    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where there are many names
    try:
        words, results = speech._conversed(spark, "/root/testdata/sf0.001")
        plain, results = words.select("file_id", "pos", "speaker", "word", "start_ms", "end_ms"), once(results)
        made = [sinks.outputs(plain, results, plain.drop("word"), S.speaker_names(words), f, with_review=False) for f in (("txt", "plain", "md", "csv", "rttm"), ("json",), ("srt", "vtt"))]
        sent = [m._jdf.queryExecution().executedPlan().toString().count("Exchange ") for m in made]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    # The ids of files each time; results; words of long files by stretch and cues by file.
    assert sent == [1, 2, 3]


def test_cues_of_short_files_are_cut_where_their_words_lie(spark, monkeypatch):
    from spanframe.plans.queries import QUERIES

    f = QUERIES["f17_cues"]
    few = f(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(Q, "TOGETHER", 200)
    some = f(spark, "/root/testdata/sf0.001")
    got, want = some.collect(), few.collect()
    assert sorted(got) == sorted(want) and len(want) > 1000
    # Both ways occur: the words of files of more than 200 words are sent, others never.
    n = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").selectExpr("conv_id", "size(regexp_extract_all(text, '\\\\S+', 0)) AS n").groupBy("conv_id").sum("n").collect()
    assert min(r[1] for r in n) <= 200 < max(r[1] for r in n)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "MapInPandas" in plan.replace("FlatMapGroupsInPandas", "")


def test_comparisons_are_shown_and_kept(spark):
    schema = "file_id string, place int, preset string, label string, text string, asr_sec double, wall_sec double, load_sec double, duration double, flags int, error string"
    rows = [("f", 0, "m", "M&", "明日は行かない。1つ<b>", 2.0, 9.0, 1.4, 61.0, 2, None), ("f", 1, "n", "N", "明日は行く。", None, 3.0, None, 60.0, None, None), ("f", 2, "o", "O<", None, None, None, None, None, None, "gone" * 100)]
    runs = spark.createDataFrame(rows, schema)
    ref = spark.createDataFrame([("f", "明日は行かない。1つ2つ")], "file_id string, ref string")
    with_ref, without = M.compare(runs, ref, ["行か"]), M.compare(runs, terms=["明日"])
    html = sinks.comparison_table(with_ref).first().html
    assert "<td>M&amp;</td><td>2.0秒</td><td>x30</td><td>1秒</td><td>-</td><td><b>" in html and "<td>1/1</td><td>1/2</td><td>1/1</td><td>なし</td><td>2</td><td style='max-width:520px'>明日は行かない。1つ&lt;b&gt;…</td>" in html
    assert "<td>N</td><td>0.0秒</td><td>x20</td><td>-</td>" in html and "<td>0/1</td>" in html and f"<tr><td>O&lt;</td><td colspan=11 style='color:#c00'>{'gone' * 50}</td></tr></table>" in html
    assert html.count("<tr>") == 4 and html.count("<th>") == 12 and html.count("<div") == 2
    html = sinks.comparison_table(without).first().html
    assert "<th>1行目との差</th><th>用語の出現</th><th>要確認</th>" in html and "<b>-</b></td><td>1</td>" in html
    made = sinks.comparison_json(with_ref).first()
    doc = json.loads(made.content)
    assert made["name"] == "f.compare.json" and [r["preset"] for r in doc] == ["m", "n", "o"] and doc[2] == {"preset": "o", "label": "O<", "error": ("gone" * 100)[:300]}
    assert doc[0]["terms"] == [1, 1] and doc[0]["numbers"] == [1, 2] and doc[0]["negations"] == [1, 1, 0] and doc[0]["drops"] == [0, 0] and doc[0]["text"].startswith("明日")
    doc = json.loads(sinks.comparison_json(without).first().content)
    assert doc[1]["diff_vs_first"] > 0 and "diff_vs_first" not in doc[0] and doc[1]["terms_found"] == 1


def test_drops_of_long_texts(spark):
    rng = random.Random(21)

    def plainly(status, least=8, bridge=2):
        runs, n, gap = [], 0, 0
        for c in status:
            if c == "d":
                n, gap = n + 1, 0
            else:
                gap += 1
                if gap > bridge:
                    runs.append(n)
                    n = 0
        return [x for x in [*runs, n] if x >= least]

    made = ["".join(rng.choice("dd=s") * rng.randint(1, 5) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["d" * 200_000, "d=" * 100_000, "", "=" * 9]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(made)], "i long, s string").select("i", M.drop_runs(F.col("s")).alias("x")).orderBy("i").collect()
    assert [(r.x.runs, r.x.chars) for r in got] == [(len(p), sum(p)) for p in map(plainly, made)]


def long_document(spark, tmp_path, n):
    """A folder with one document of n words."""
    rows = [(6, " ".join(f"word{i}," for i in range(n)), "en", "s", 10 * n), (7, "Two words.", "en", "s", 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_word_stats_of_a_long_text_take_time_by_its_length(spark, tmp_path):
    from spanframe.plans.queries import QUERIES

    folder, began = long_document(spark, tmp_path, 80_000), time.time()
    row = QUERIES["e4_word_stats"](spark, folder).first()
    assert (row.aligner, row.approx, row.coverage) == (1, 1, 1.0)
    assert time.time() - began < 30  # by the square of the length it takes minutes


def test_composed_words_of_a_long_text_take_time_by_its_length(spark, tmp_path):
    from spanframe.plans.queries import QUERIES

    folder, began = long_document(spark, tmp_path, 80_000), time.time()
    rows = QUERIES["f7_compose_words"](spark, folder).selectExpr("clip_id", "core").collect()
    assert [r.core for r in rows if r.clip_id == 6] == [f"word{i}" for i in range(80_000)] and len(rows) == 80_002
    assert time.time() - began < 30


def test_blocks_of_long_texts_need_few_automata(monkeypatch):
    from spanframe.functions import distance as D

    rng, built = random.Random(31), []
    plain = D.Substrings

    class Counted(plain):
        def __init__(self, text):
            built.append(len(text))
            super().__init__(text)

    monkeypatch.setattr(D, "Substrings", Counted)
    for letters in ("abcdefghij klmnop", "ab"):
        a = "".join(rng.choice(letters) for _ in range(3000))
        cut = sorted(rng.sample(range(3000), 60))
        b = "".join(a[i + 1 : j] for i, j in zip([-1, *cut], [*cut, 3000]))
        fast, n = D.matching_blocks(a, b), sum(built)
        monkeypatch.setattr(D, "shared_runs", lambda *_: None)
        assert fast == D.matching_blocks(a, b)
        assert letters == "ab" or n < 300 < 10_000 < sum(built)
        monkeypatch.undo()
        monkeypatch.setattr(D, "Substrings", Counted)
        built.clear()


def test_speakers_of_words_equal_trying_all_turns(spark):
    from spanframe.operators.intervals import assign_speakers

    rng, words, turns = random.Random(4), [], []
    for f in range(60):
        span = rng.choice([30, 300, 3000])
        turns += [(f"f{f}", p, rng.choice("ABCDE"), a := rng.randint(0, span), a + rng.choice([0, 1, 2, 5, 20, 100, span // 3])) for p in range(rng.randint(0, 20))]
        words += [(f"f{f}", p, "", a := rng.randint(0, span), a + rng.choice([-1, 0, 1, 2, 7, 30, span // 4])) for p in range(rng.randint(1, 20))]
    frame = lambda rows: spark.createDataFrame(rows, "file_id string, pos long, speaker string, start_ms long, end_ms long")
    for most, bin_ms in ((3, 7), (1000, 120_000)):
        got, own = {(r.file_id, r.pos): r.speaker for r in assign_speakers(frame(words), frame(turns), most, bin_ms).collect()}, 0
        for f, p, _, a, b in words:
            near = [t for t in turns if t[0] == f and t[4] > t[3]]
            over = [(max(s, a) - min(e, b), s, q, x) for _, q, x, s, e in near if min(e, b) > max(s, a)]
            far = [(o, s, q, x) for _, q, x, s, e in near if (o := max(2 * s - a - b, a + b - 2 * e, 0)) <= 2 * most]
            if over or far:
                own += 1
                assert got[f, p] == min(over or far)[3]
        assert own > 200 and len(got) == len(words)


def test_speakers_where_many_turns_are_open_at_once(spark):
    """Every word meets every turn here: as pairs that would be 400 million."""
    from spanframe.operators.intervals import assign_speakers

    began, n = time.time(), F.col("id")
    turns = spark.range(20_000).select(F.lit("f").alias("file_id"), n.alias("pos"), F.concat(F.lit("s"), n).alias("speaker"), n.alias("start_ms"), (n + 100_000).alias("end_ms"))
    words = spark.range(20_000).select(F.lit("f").alias("file_id"), n.alias("pos"), (n + 50_000).alias("start_ms"), (n + 50_001).alias("end_ms"))
    assert {r.speaker for r in assign_speakers(words, turns).collect()} == {"s0"}
    assert time.time() - began < 25


def test_kept_tables_take_less_than_by_default(spark, tmp_path):
    from spanframe.sources.shared import once

    def size(folder):
        return sum(f.stat().st_size for f in folder.rglob("*.parquet"))

    rows = spark.range(2000).select(F.concat_ws(" ", *[F.sha1((F.col("id") + k).cast("string")) for k in range(20)]).alias("text")).coalesce(1)
    rows.write.parquet(f"{tmp_path}/plain")
    kept = once(rows)
    assert kept.count() == 2000
    assert sum(len(spark.read.format("binaryFile").load(f).first().content) for f in kept.inputFiles()) < 0.8 * size(tmp_path)


def test_composed_words_equal_sorting_all_and_stay_packed(spark):
    from spanframe.operators import words as W
    from spanframe.operators import retry as E

    rng, rows, aligned, expected = random.Random(7), [], [], []
    for f in ("f", "g"):
        for k in range(12):
            start, own = 10_000 * k + rng.choice([0, 0, -6000]), rng.choice([(None, None), (10_000.0 * k, 10_000.0 * k + 9000)])
            ws = [rng.choice(["ab", "é", "語", "Don't"]) + rng.choice(["", ",", "."]) for _ in range(rng.randint(0, 9))]
            times = [(t := rng.randint(-500, 9500), t + rng.randint(0, 5000)) for _ in ws]
            bare = [w.rstrip(",.") for w in ws]
            rows.append((f, k, start, start + 9000, *own, " ".join(ws), [], None))
            aligned.append((f, k, [{"tok": b, "s": float(s), "e": float(e)} for b, (s, e) in zip(bare, times)]))
            for i, (w, b, (s, e)) in enumerate(zip(ws, bare, times)):
                s = min(max(s, 0), 9000) + start
                e = min(max(e + start, s), start + 9000)
                if own[0] is None or own[0] <= (s + e) / 2 < own[1]:
                    expected.append((f, s, e, k, i, w + " " * (i + 1 < len(ws)), b))
    res = spark.createDataFrame(rows, f"file_id string, clip_id long, start_ms long, end_ms long, own_start double, own_end double, text string, flags array<string>, words {E.WORDS}")
    tokens = spark.createDataFrame(aligned, f"file_id string, clip_id long, tokens {E.WORDS}")
    words, _ = W.compose_words(res, tokens, res.select("file_id", "start_ms", "end_ms"))
    got = [(r.file_id, r.start_ms, r.end_ms, r.clip_id, r.word, r.core) for r in words.orderBy("file_id", "pos").collect()]
    assert got == [(*x[:4], *x[5:]) for x in sorted(expected)]
    assert all([r.pos for r in words.where(F.col("file_id") == f).orderBy("pos").collect()] == list(range(1, 1 + sum(x[0] == f for x in expected))) for f in "fg")
    # What waits to be numbered takes a few bytes a word.
    n = 20_000
    whole = W.packed([f"word{i % 900} " for i in range(n)], [f"word{i % 900}" for i in range(n)], np.arange(n) * 80, np.arange(n) * 80 + 70)
    assert len(whole) < 12 * n and W.unpacked(W.packed(["a ", "語"], ["a", "語"], np.array([5, 5]), np.array([6, 9])))[:2] == (["a ", "語"], ["a", "語"])


def test_loops_are_where_the_pattern_finds_them(monkeypatch):
    from spanframe.functions import text as T  # before, a pattern was tried at every place of every text

    rng, texts = random.Random(3), ["", "a" * 6, "aaaaa", "a"]
    for _ in range(1500):
        unit = "".join(rng.choice("abcd\U0001F600あ\n") for _ in range(rng.randint(1, 22)))
        texts.append("".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) + unit * rng.choice([1, 4, 5, 6, 7]) + "x" * rng.randint(0, 2))
    want = [bool(re.search(T._LOOP, t)) for t in texts]
    assert T.looping(texts).tolist() == want and any(want) and not all(want) and len(T.looping([])) == 0
    monkeypatch.setattr(T, "LOOKED_AT", 50)
    assert T.looping(texts).tolist() == want


def test_alike_is_partial_likeness_without_most_windows(monkeypatch):
    from spanframe.functions import distance

    rng = random.Random(4)
    pairs = [("", ""), ("", "a"), ("abc", "abc"), ("abd", "acb")]
    for _ in range(250):
        a, b = ("".join(rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(0, n))) for n in (150, 300))
        pairs.append((a, b[:20] + a[: rng.randint(0, 150)] + b[20:] if rng.random() < 0.3 else b))
    for least in (0.3, 0.6, 0.75, 1.0):
        assert distance.alike(pairs, least).tolist() == [partial_likeness(*p) >= least for p in pairs]
    looked = []
    count = distance._common
    monkeypatch.setattr(distance, "_common", lambda codes, start, *rest: looked.append(len(start)) or count(codes, start, *rest))
    assert not distance.alike([("abcdefgh" * 5, "zyxw" * 1000)], 0.6).any() and sum(looked) < 1000  # of 4039 windows


def test_words_cut_by_kinds_of_characters_are_those_of_the_pattern(spark):
    from spanframe.operators import sequences as S  # before, two patterns were matched for each word

    rng = random.Random(5)
    texts = ["", " ", ".", "a", " .a", "a ,b", "a. . b\u3000", "\u00a0x", "\0a b"]
    texts += ["".join(rng.choice("abé1' .,、。\u3000\n\U0001F600あ-") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    want = [re.findall(r"[^、。！？!?,.，．\u3000 \t\n\v\f\r]+[、。！？!?,.，．]*[\u3000 \t\n\v\f\r]*", t) for t in texts]
    words, weights, counts = S._cut(texts)
    assert words == sum(want, []) and counts.tolist() == [len(w) for w in want]
    assert weights.tolist() == [max(1, sum(c.isalnum() or c == "'" for c in w)) for w in words]
    rows = spark.createDataFrame([(i, t, 0, 1000, []) for i, t in enumerate([*texts, None])], "clip_id string, text string, start_ms long, end_ms long, spans array<struct<s:double,e:double>>")
    got = {}
    for r in sorted(S.approx_tokens(rows).collect(), key=lambda r: (int(r.clip_id), r.i)):
        got.setdefault(int(r.clip_id), []).append((r.word, r.start_ms, r.end_ms))
    assert [[w for w, _, _ in got.get(i, [])] for i in range(len(texts) + 1)] == [*want, []]
    assert all(x[0][1] == 0 and x[-1][2] == 1000 and all(a[2] == b[1] for a, b in zip(x, x[1:])) for x in got.values())


def test_what_several_models_say_alike_is_aligned_once(monkeypatch):
    import pandas as pd

    from spanframe.operators import metrics

    told, asked = metrics.told, []
    monkeypatch.setattr(metrics, "told", lambda *p: asked.append(p) or told(*p))
    got = metrics._alignments(pd.Series(["abc", "abc", None, "abc"]), pd.Series(["abd", "abd", "x", "abc"]))
    assert asked == [("abc", "abd"), ("", "x"), ("abc", "abc")] and got.status.tolist() == ["==s", "==s", "", "==="]


def test_a_text_that_an_attempt_has_too_is_kept_once(spark, monkeypatch):
    from spanframe.operators import retry

    kept = []
    once = retry.once
    monkeypatch.setattr(retry, "once", lambda df, tag: kept.append(once(df, tag)) or kept[-1])
    blank = dict.fromkeys(f.split(":")[0] for f in ("kind", "ctx", "text", "flags", "split_from", "split_texts", "split_flags", "model", "pieces", "rejected", "adopted"))
    rows = [(1, "a", [blank | {"kind": "text", "text": x} for x in ("a", "b", None)]), (2, None, [blank | {"text": None}, blank | {"text": "c"}]), (3, "d", None), (4, "e", [])]
    df = spark.createDataFrame(rows, f"k int, text string, attempts {retry.ATTEMPTS}")
    got = retry.answers_once(df)
    assert got.columns == df.columns and sorted(got.collect(), key=lambda r: r.k) == df.collect()
    assert [a.text for a in kept[0].where("k = 1").first().attempts] == [None, "b", None]  # before, all were written again


def test_differences_are_of_whole_texts(spark, tmp_path):
    import html

    from spanframe.plans.queries import QUERIES

    rng = random.Random(41)
    long_ = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(12_000)) + " the end of going"
    spark.createDataFrame([(1, long_), (2, "sing the song"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.html for r in QUERIES["b13_differences"](spark, str(tmp_path)).collect()}
    gone, new = (lambda x: html.unescape(re.sub("<ins[^>]*>.*?</ins>|<del[^>]*>|</del>", "", x, flags=re.S))), (lambda x: html.unescape(re.sub("<del[^>]*>.*?</del>|<ins[^>]*>|</ins>", "", x, flags=re.S)))
    assert len(long_) > 60_000 and gone(got[1]) == long_ and new(got[1]) == long_.replace(" the end of going", " THE end goin'") and "<ins" in got[1][-200:]
    assert gone(got[2]) == "sing the song" and got[3] == ""


def test_blocks_of_long_parts_and_of_loops_need_no_automaton(monkeypatch):
    from spanframe.functions import distance as D

    rng = random.Random(43)
    monkeypatch.setattr(D, "Substrings", None)
    monkeypatch.setattr(D, "LONG_PART", 0)
    for t in range(300):
        a, b = ("".join(rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 60))) for _ in range(2))
        if t % 2:
            a, b = a * rng.randint(1, 4), b + a[rng.randint(0, 20) :]
        monkeypatch.setattr(D, "MOST_MEETINGS", t % 3)
        assert D.matching_blocks(a, b) == [tuple(x) for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x.size]
    monkeypatch.undo()
    plain = D.Substrings

    class Short(plain):
        def __init__(self, text):
            assert len(text) <= D.LONG_PART
            super().__init__(text)

    monkeypatch.setattr(D, "Substrings", Short)
    began, line = time.time(), "the people of a land sing again\n"
    a, b = line * 2000, line.replace("sing", "sin'") * 2000
    blocks = D.matching_blocks(a, b)
    assert all(a[x : x + n] == b[y : y + n] for x, y, n in blocks) and sum(n for _, _, n in blocks) > 1999 * (len(line) - 1) and time.time() - began < 30


def test_long_texts_that_meet_often_take_little_memory(monkeypatch):
    import tracemalloc

    from spanframe.functions import distance as D

    rng = random.Random(47)
    a = "".join(rng.choice("abcdefghij ") for _ in range(6000)) * 10
    b = a.replace("ab", "")
    tracemalloc.start()
    runs = D.shared_runs(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(runs[0]) > 1000 and most < 18 << 20
    monkeypatch.setattr(D, "MET_AT_ONCE", 1000)
    assert all((u == v).all() for u, v in zip(runs, D.shared_runs(a, b)))
    for short in ("abcabcabcabc", ""):
        assert sorted(zip(*[x.tolist() for x in D.shared_runs(short, short)])) == [(i, j, 12 - max(i, j)) for i in range(5) for j in range(5) if not (i and j) and (i - j) % 3 == 0 and short]


def test_rules_with_patterns_go_to_python_once(spark):
    def plan(rules, fillers=()):
        x = spark.range(1).select(R.Clean(tuple(R.parse_rules(rules)), tuple(fillers))(F.col("id").cast("string")))
        return x._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")

    assert plan("a => b\nre:c => d\ne => \\f\nre:g => h", ["x"]) == 1 and plan("a => b\ne => f") == 0
    rows = [("the a.b c\\1",), ("",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(R.apply_rules(F.col("t"), R.parse_rules("a.b => \\1x\nre:(t)he => \\1\nc\\1 => $1"))).collect()
    assert [r[0] for r in got] == ["t \\1x $1", "", None]

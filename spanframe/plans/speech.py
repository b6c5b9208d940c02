"""Queries of the operators on clips, words, cues, recognisers and measures, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.functions import rewrite as R
from spanframe.functions import text as T
from spanframe.operators import clips as C
from spanframe.operators import cues as Q
from spanframe.operators import intervals as I
from spanframe.operators import metrics as M
from spanframe.operators import retry as E
from spanframe.operators import sequences as S
from spanframe.operators import words as W
from spanframe.plans.queries import CLIPS, PAIRS, WORDS, query
from spanframe.sources import adapters as A
from spanframe.sources import audio, sinks
from spanframe.sources.files import read_files, write_files
from spanframe.sources.shared import BATCH_BYTES, new_folder, once, once_by, short_plans

SPEECH = "speech AS (SELECT event_type AS file_id, (epoch_us(ts) // 1000000) % 2592000 AS start_ms, (epoch_us(ts) // 1000000) % 2592000 + CAST(round(value * 6) AS BIGINT) AS end_ms FROM events)"
#: The samples of the sound made of vectors (adapters.sound_files), numbered within their file; and the levels of its frames of 32 samples.
SOUND = """vectors AS (SELECT vec_id // 250 AS file_id, vec_id % 250 AS n, embedding, CAST(CASE WHEN vec_id % 250 >= 110 AND (vec_id % 250) // 10 % 5 = 0 THEN 0.001 ELSE 1.0 END AS FLOAT) AS gain FROM embeddings),
numbered AS (SELECT file_id, gain, unnest(embedding) AS x, n * 64 + generate_subscripts(embedding, 1) - 1 AS i FROM vectors),
samples AS (SELECT file_id, i, CAST(trunc(greatest(CAST(-1 AS FLOAT), least(CAST(1 AS FLOAT), x * gain)) * CAST(32767 AS FLOAT)) AS BIGINT) AS s FROM numbered),
levels AS (SELECT file_id, i // 32 AS frame, CAST(10 * log10(sum(s * s) / 32.0 + 1e-3) AS FLOAT) AS db FROM samples GROUP BY file_id, i // 32 HAVING count(*) = 32)"""
RULES = R.parse_rules("the => THE\nre:([a-z])ing\\b => \\1in'\n# a comment\nand → &")


def _files(spark, d):
    return A.speech(spark, d).select("file_id", F.lit(2_600_000).cast("bigint").alias("total_ms")).distinct()


def _clips(spark, d):
    return C.build_clips(A.speech(spark, d), _files(spark, d), max_clip_ms=15_000, max_gap_ms=1000, pad_ms=200)


@query()
def f5_build_clips(spark, d):
    return _clips(spark, d)


@query()
def f6_split_clips(spark, d):
    return C.split_clips(_clips(spark, d))


@query(f"WITH {SOUND} SELECT file_id, i // 16000 AS chunk_no, count(*) AS n, CAST(sum(s) AS BIGINT) AS total, CAST(sum(s * s) AS BIGINT) AS squares, min(s) AS least, max(s) AS most FROM samples GROUP BY file_id, i // 16000")
def a4_wav_chunks(spark, d):
    """Sound written as WAV files, read again by ranges of bytes."""
    x = A.sound(spark, d).select("file_id", "chunk_no", F.explode("samples").alias("s"))
    return x.groupBy("file_id", "chunk_no").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("total"), F.sum(F.col("s").cast("long") * F.col("s")).alias("squares"), F.min(F.col("s").cast("long")).alias("least"), F.max(F.col("s").cast("long")).alias("most"))


@query(f"WITH {SOUND} SELECT file_id, 44 AS first_byte, 2 * count(*) AS n_bytes, 1 AS channels, 1600 AS rate, 16 AS bits, count(*) * 1000 // 1600 AS total_ms FROM samples GROUP BY file_id")
def a2_wav_headers(spark, d):
    h = audio.probe(spark, [A.sound_files(spark, d)])
    return h.select(F.regexp_extract("file_id", r"s(\d+)\.wav$", 1).cast("long").alias("file_id"), F.col("offset").alias("first_byte"), F.col("bytes").alias("n_bytes"), "channels", "rate", "bits", "total_ms")


@query()
def a3_resampled(spark, d):
    """The sound at 1000 Hz instead of 1600."""
    return A.sound(spark, d, 1000).select("file_id", "chunk_no", F.posexplode("samples").alias("i", "s"))


@query(f"WITH {SOUND}, w AS (SELECT vec_id AS k, vec_id // 250 AS file_id, greatest(vec_id % 250 * 40 - 15, 0) AS a, vec_id % 250 * 40 + 85 AS b FROM embeddings WHERE vec_id % 3 = 0) SELECT k, count(s) AS n, coalesce(sum(s), 0) / 32768.0 AS total FROM w LEFT JOIN samples ON samples.file_id = w.file_id AND i >= round_even(a * 1.6, 0) AND i < round_even(b * 1.6, 0) GROUP BY k")
def a5_stretches(spark, d):
    """What is heard from 15 ms before every third vector to 45 ms behind it."""
    n = F.col("vec_id") % A.SOUND_VECTORS
    asked = A.table(spark, d, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("k"), F.floor(F.col("vec_id") / A.SOUND_VECTORS).alias("file_id"), (n * 40 - 15).alias("start_ms"), (n * 40 + 85).alias("end_ms"))
    heard = audio.stretches(A.sound(spark, d), asked, ["k"])
    return heard.select("k", F.size("x").cast("long").alias("n"), F.aggregate("x", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"WITH {SOUND} SELECT * FROM levels")
def e2_frame_levels(spark, d):
    return audio.frame_levels(A.sound(spark, d).withColumn("file_id", F.col("file_id").cast("string"))).withColumn("file_id", F.col("file_id").cast("long"))


def _heard(spark, d):
    """Levels of the sound, its speech by energy, and how long each file is."""
    chunked = A.sound(spark, d)
    levels = once(audio.frame_levels(chunked.withColumn("file_id", F.col("file_id").cast("string"))), "levels")
    runs = I.energy_vad(levels, ["file_id"], ["frame"], "db", 45, 13, 20)
    speech = runs.select("file_id", (F.col("first") * C.HOP).alias("start_ms"), ((F.col("last") + 1) * C.HOP).alias("end_ms"))
    files = levels.groupBy("file_id").agg(((F.max("frame") + 1) * C.HOP).alias("total_ms"))
    return levels, speech, files


@query()
def f5_clips_of_sound(spark, d):
    """From samples to clips: levels, speech by energy, clips of two seconds cut where it is quietest."""
    levels, speech, files = _heard(spark, d)
    return C.build_clips(speech, files, levels, max_clip_ms=2000, max_gap_ms=300, pad_ms=100, overlap_ms=200)


@query()
def f6_halves_of_sound(spark, d):
    levels, speech, files = _heard(spark, d)
    return C.split_clips(C.build_clips(speech, files, levels, max_clip_ms=4000, max_gap_ms=300, pad_ms=100, overlap_ms=200), levels)


@query()
def f4_quiet_cuts(spark, d):
    """Where stretches of `embeddings`' sound longer than a second would be cut."""
    levels, speech, files = _heard(spark, d)
    clips = C.build_clips(speech, files, levels, max_clip_ms=2000, max_gap_ms=300, pad_ms=0, overlap_ms=0)
    return clips.where("cut").select("file_id", F.col("own_end").alias("cut_ms"))


@query(f"WITH {SPEECH} SELECT * FROM speech WHERE start_ms + end_ms >= 1200000 AND start_ms + end_ms < 2400000")
def c6_excerpt(spark, d):
    return C.excerpt(A.speech(spark, d), 600_000, 600_000)


@query("SELECT c_custkey, CAST(coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 3 = 1 THEN 20 END, 0), CASE WHEN c_nationkey % 2 = 0 THEN 15 END, 30) AS DOUBLE) AS max_clip, CAST(coalesce(CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 3 = 1 THEN 2 END, CASE WHEN c_nationkey % 2 = 0 THEN 1 END, 6) AS DOUBLE) AS max_gap FROM customer")
def c8_clip_settings(spark, d):
    c = A.table(spark, d, "customer")
    third, even = F.col("c_custkey") % 3, F.col("c_nationkey") % 2 == 0
    user_clip, user_gap = F.when(third == 0, 0.0).when(third == 1, 20.0), F.when(third == 0, 0.0).when(third == 1, 2.0)
    clip, gap = C.clip_settings(user_clip, user_gap, F.when(even, 15.0), F.when(even, 1.0))
    return c.select("c_custkey", clip.alias("max_clip"), gap.alias("max_gap"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Names: ' || n_name || ', ' || r_name || '.' ELSE '名: ' || n_name || '、' || r_name || '。' END || chr(10) || 'more' AS context FROM nation JOIN region ON n_regionkey = r_regionkey")
def c9_context(spark, d):
    both = A.table(spark, d, "nation").join(A.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    label = F.when(F.col("n_nationkey") % 2 == 0, "Names").otherwise("名")
    return both.select("n_nationkey", T.context(label, F.array("n_name", "r_name"), F.lit(" more ")).alias("context"))


@query(f"WITH {SPEECH}, f AS (SELECT file_id, CASE WHEN file_id < 'd' THEN 2600000 ELSE 90000000 END AS total_ms FROM speech GROUP BY file_id), s AS (SELECT file_id, sum(end_ms - start_ms) AS n FROM speech GROUP BY file_id), p AS (SELECT f.file_id, total_ms FROM f JOIN s USING (file_id) WHERE n < total_ms * 0.02) SELECT file_id, start_ms, end_ms FROM speech WHERE file_id NOT IN (SELECT file_id FROM p) UNION ALL SELECT file_id, 0, total_ms FROM p")
def j6_whole_files(spark, d):
    s = A.speech(spark, d)
    files = s.select("file_id").distinct().withColumn("total_ms", F.when(F.col("file_id") < "d", 2_600_000).otherwise(90_000_000).cast("bigint"))
    return C.or_whole_file(s, files)


@query("SELECT event_id, CAST(round_even(greatest(value, 0) * 1000, 0) AS BIGINT) AS ms FROM events")
def i1_whole_ms(spark, d):
    return A.table(spark, d, "events").select("event_id", T.whole_ms(F.col("value")).alias("ms"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html FROM documents")
def i27_escaped(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.escaped(F.col("text")).alias("html"))


@query("SELECT doc_id, replace(replace(text, 'the', 'THE'), 'and', '&') AS text FROM documents")
def i10_replacements(spark, d):
    return A.table(spark, d, "documents").select("doc_id", R.apply_rules(F.col("text"), R.parse_rules("the => THE\nand\t&")).alias("text"))


@query()
def i13_clean_text(spark, d):
    clean = R.Clean(tuple(RULES), ("the", "of"))
    return A.table(spark, d, "documents").select("doc_id", clean(F.col("text")).alias("text"))


@query(f"WITH {PAIRS}, l AS (SELECT doc_id, regexp_extract_all(ref, '[0-9]+(?:[.,][0-9]+)?') AS r, regexp_extract_all(hyp, '[0-9]+(?:[.,][0-9]+)?') AS h FROM pairs) SELECT doc_id, CAST(coalesce(list_sum(list_transform(list_distinct(r), lambda x: least(len(list_filter(r, lambda y: y = x)), len(list_filter(h, lambda y: y = x))))), 0) AS BIGINT) AS hit, CAST(len(r) AS BIGINT) AS total FROM l")
def i19_number_recall(spark, d):
    p = A.pairs(spark, d).select("doc_id", T.nfkc(F.col("ref")).alias("r"), T.nfkc(F.col("hyp")).alias("h"))
    return p.select("doc_id", T.multiset_recall(T.numerals(F.col("r")), T.numerals(F.col("h"))).alias("x")).select("doc_id", "x.hit", "x.total")


@query("SELECT conv_id, string_agg(CASE WHEN p IS NOT NULL AND regexp_matches(p, '[0-9A-Za-z]$') AND regexp_matches(t, '^[0-9A-Za-z]') THEN ' ' ELSE '' END || t, '' ORDER BY turn) AS text FROM (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM conversations) WHERE t <> '') GROUP BY conv_id")
def e12_joined_texts(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("turn", "text")))
    each = A.table(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("x"))
    return each.select("conv_id", T.joined_texts(F.transform("x", lambda r: r["text"])).alias("text"))


@query()
def f17_cues(spark, d):
    return Q.make_cues(A.words(spark, d))


@query()
def f7_compose_words(spark, d):
    """Documents as clips, their words without punctuation as aligned tokens, half of them without any."""
    words, _ = W.compose_words(*_results(spark, d))
    return words


@query()
def e4_word_stats(spark, d):
    return W.word_stats(W.compose_words(*_results(spark, d))[1])


@query("""WITH c AS (SELECT *, length(regexp_replace(text, '[^\\p{L}\\p{N}'']', '', 'g')) AS n FROM documents)
SELECT coalesce(lang, '?') AS file_id, count(*) FILTER (doc_id % 3 = 0) AS aligner, count(*) FILTER (doc_id % 3 = 1) AS engine, count(*) FILTER (doc_id % 3 = 2) AS approx, count(*) FILTER (doc_id % 5 = 0) AS rescued, CAST(sum(doc_id % 4) AS BIGINT) AS long_words,
count(*) FILTER (doc_id % 7 = 0) AS trimmed_much, count(*) FILTER (doc_id % 3 > 0) AS flagged, count(*) FILTER (doc_id % 2 = 1) AS retried, CASE WHEN sum(n) > 0 THEN CAST(sum(n // 2) AS BIGINT) / CAST(sum(n) AS BIGINT) ELSE 1.0 END AS coverage FROM c GROUP BY lang""")
def e8_clip_counts(spark, d):
    """Documents as clips of which all that word_stats() counts is known."""
    n = F.col("doc_id")
    rows = A.table(spark, d, "documents").select(
        F.coalesce("lang", F.lit("?")).alias("file_id"), "text", F.element_at(F.array(*map(F.lit, ("aligner", "engine", "approx"))), (n % 3 + 1).cast("int")).alias("source"), (n % 5 == 0).alias("rescued"), (n % 4).alias("long_words"),
        (n % 7 == 0).alias("trimmed"), F.array_repeat(F.lit("flag"), (n % 3).cast("int")).alias("flags"), F.array_repeat(F.lit("attempt"), (n % 2 + 1).cast("int")).alias("attempts"), F.floor(T.core_len(F.col("text")) / 2).alias("kept"),
    )
    return W.word_stats(rows)


def _results(spark, d):
    results = A.spoken(spark, d, "text").where("file_id IS NOT NULL AND clip_id IS NOT NULL").withColumns({"flags": F.array().cast("array<string>"), "words": F.lit(None).cast(E.WORDS), "attempts": F.array().cast(E.ATTEMPTS)})
    # Restoring texts takes far longer than sending them. Dealt by clip, they meet their tokens, which are larger, in place.
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    results = results.repartition(parts, "file_id", "clip_id")
    bare = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}']+"), F.lit(0))
    dur = (F.col("end_ms") - F.col("start_ms")).cast("double")
    # Bound once: within the function of each word, the whole text would be searched again for it.
    tokens = S.let(bare, lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("tok"), (dur * i / F.size(ws)).alias("s"), (dur * (i + 1) / F.size(ws)).alias("e"))))
    aligned = results.where(F.col("clip_id") % 2 == 0).select("file_id", "clip_id", tokens.alias("tokens"))
    return results, aligned, results.select("file_id", "start_ms", "end_ms")


def _recognised(spark, d):
    policy = E.Policy(language="English")
    return E.recognised(A.spoken(spark, d), A.reader(spark, d), context="Terms: alpha, beta.", terms=("alpha", "beta"), label="Terms", policy=policy)


@query()
def j1_recognised(spark, d):
    r = _recognised(spark, d)
    return r.select("file_id", "clip_id", "parent", "text", F.array_join("flags", "|").alias("flags"), F.size("attempts").alias("attempts"))


@query()
def j3_second_opinion(spark, d):
    policy = E.Policy(enabled=False, language="English")
    first = E.recognised(A.spoken(spark, d), A.reader(spark, d), policy=policy)
    speech = A.spoken(spark, d).select("file_id", "start_ms", "end_ms")
    r = E.second_opinion(first, A.reader(spark, d, False), "other", speech, policy=policy, max_clip_ms=15_000, max_gap_ms=1000)
    return r.select("file_id", "clip_id", "text", F.array_join("flags", "|").alias("flags"), F.size("attempts").alias("attempts"))


@query()
def b8_review(spark, d):
    return sinks.review(E.review_items(_recognised(spark, d)))


def _conversed(spark, d):
    """Turns of conversations as clips, what is said in them as a recogniser's answers."""
    words = once_by(A.words(spark, d), "file_id", "spoken")
    turns = words.groupBy("file_id", F.col("turn").cast("bigint").alias("clip_id")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    none = F.lit(None).cast("double")
    clips = turns.select("*", none.alias("own_start"), none.alias("own_end"), (F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), F.lit(False).alias("cut"), F.lit(None).cast("bigint").alias("parent"))
    said = A.table(spark, d, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").cast("bigint").alias("clip_id"), "text", F.lit("English").alias("language"), F.lit(None).cast(E.WORDS).alias("words"))
    policy = E.Policy(split=False, language="English", most_cps=200)
    return words, E.recognised(clips, lambda asked: asked.select("file_id", "clip_id").join(said, ["file_id", "clip_id"]), context="Terms: alpha.", policy=policy)


@query()
def b5_json(spark, d):
    words, results = _conversed(spark, d)
    ids = S.sentence_ids(words)
    return sinks.json_documents(S.sentences(ids), ids, results, S.speaker_names(words), {"version": "1"})


@query()
def b9_outputs(spark, d):
    """All formats of all conversations, written as files, all or none, and read again."""
    with short_plans(spark):
        words, results = _conversed(spark, d)
        plain = words.select("file_id", "pos", "speaker", "word", "start_ms", "end_ms")
        made = sinks.outputs(plain, results, plain.drop("word"), S.speaker_names(words), ("txt", "plain", "srt", "vtt", "csv", "md", "json", "rttm"), meta={"version": "1"})
        folder, lists = new_folder(spark, "outputs"), new_folder(spark, "lists")
        write_files(made, folder, lists=lists)
    return read_files(spark, folder, lists).select("name", F.decode("content", "UTF-8").alias("content"))


def _compared(spark, d):
    """Documents beside items of benchmark, and themselves without loops, as two models; a third that failed for every tenth."""
    p = A.pairs(spark, d).select(F.col("doc_id").alias("file_id"), "ref", "hyp").repartition(4 * spark.sparkContext.defaultParallelism)
    one = lambda place, name, text, error: p.select("file_id", F.lit(place).alias("place"), F.lit(name).alias("preset"), F.lit(name).alias("label"), text.alias("text"), F.lit(2.0).alias("asr_sec"), F.lit(3.0).alias("wall_sec"), F.lit(1.0).alias("load_sec"), F.lit(60.0).alias("duration"), F.lit(0).alias("flags"), error.cast("string").alias("error"))
    runs = one(0, "whole", F.col("hyp"), F.lit(None)).unionByName(one(1, "<short>", T.collapse_repeats(F.col("hyp")), F.lit(None)))
    return runs.unionByName(one(2, "gone", F.lit(None).cast("string"), F.lit("out of memory")).where("file_id % 10 = 0"))


@query()
def b14_comparison_table(spark, d):
    """Without a reference: models beside the first."""
    return sinks.comparison_table(M.compare(_compared(spark, d), terms=["the", "and"]))


@query()
def b10_comparison_json(spark, d):
    return sinks.comparison_json(M.compare(_compared(spark, d), terms=["the", "and"])).select("name", "content")


@query(f"WITH {CLIPS} SELECT clip_id, (SELECT string_agg('これは' || i || '番目の文です。', '' ORDER BY i) FROM range(1, greatest(1, dur_ms // 3000) + 1) r(i)) AS text FROM clips")
def k11_dummy_recogniser(spark, d):
    c = A.clips(spark, d).select(F.lit("f").alias("file_id"), "clip_id", F.lit(0).cast("bigint").alias("start_ms"), F.col("dur_ms").alias("end_ms"), F.lit("").alias("context"))
    return E.dummy_recogniser(c).select("clip_id", "text")


@query("SELECT doc_id, count(*) AS turns, max(end_ms) AS last_ms, max(speaker) AS speaker FROM (SELECT doc_id, least(n_chars * 60, (k + 1) * 10000) AS end_ms, 'SPEAKER_0' || k % 2 AS speaker FROM (SELECT doc_id, n_chars, unnest(range(0, CAST(ceil(n_chars * 60 / 10000.0) AS BIGINT))) AS k FROM documents)) GROUP BY doc_id")
def k13_dummy_turns(spark, d):
    files = A.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), (F.col("n_chars") * 60).alias("total_ms"))
    return E.dummy_turns(files).groupBy(F.col("file_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("turns"), F.max("end_ms").alias("last_ms"), F.max("speaker").alias("speaker"))


@query()
def m_compare(spark, d):
    """Documents beside items of benchmark, and themselves without loops, as two models."""
    p = A.pairs(spark, d).select(F.col("doc_id").alias("file_id"), "ref", "hyp").repartition(4 * spark.sparkContext.defaultParallelism)
    one = lambda place, name, text: p.select("file_id", F.lit(place).alias("place"), F.lit(name).alias("preset"), F.lit(name).alias("label"), text.alias("text"), F.lit(2.0).alias("asr_sec"), F.lit(3.0).alias("wall_sec"), F.lit(1.0).alias("load_sec"), F.lit(60.0).alias("duration"), F.lit(0).alias("flags"), F.lit(None).cast("string").alias("error"))
    runs = one(0, "whole", F.col("hyp")).unionByName(one(1, "without loops", T.collapse_repeats(F.col("hyp"))))
    return M.compare(runs, p.select("file_id", "ref"), ["the", "and"]).drop("text")


@query(f"WITH {WORDS}, f AS (SELECT file_id, speaker, min(pos) AS p FROM words GROUP BY file_id, speaker), n AS (SELECT file_id, speaker, row_number() OVER (PARTITION BY file_id ORDER BY p) AS n FROM f) SELECT file_id, speaker, CASE WHEN speaker = 'user' THEN 'asker' WHEN n = 1 THEN 'first' ELSE 'S' || n END AS name FROM n")
def f12_names_with_mapping(spark, d):
    return S.speaker_names(A.words(spark, d), "S1", "user=asker, S1＝first")


@query()
def i31_dropped_utterances(spark, d):
    """Sentences of benchmark's items that the document beside each of them lacks."""
    p = A.pairs(spark, d)
    said = p.select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("ref", r"\.")).alias("utt_id", "text"))
    return M.dropped_utterances(said, p.select(F.col("doc_id").alias("file_id"), F.col("hyp").alias("text")))


@query()
def b13_differences(spark, d):
    """Documents beside themselves cleaned: what rules and fillers have changed. The session's Arrow batches are bounded by bytes from then on."""
    spark.conf.set(BATCH_BYTES, "1MB")
    clean = R.Clean(tuple(RULES), ("the", "of", "and"))
    # Comparing texts takes far longer than sending them.
    docs = A.table(spark, d, "documents").select("doc_id", "text").repartition(4 * spark.sparkContext.defaultParallelism)
    return docs.select("doc_id", M.differences(F.col("text"), clean(F.col("text"))).alias("html"))

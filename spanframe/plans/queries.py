"""Queries of the span and token operators over the test tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanframe.functions import text as T
from spanframe.operators import intervals as I
from spanframe.operators import clips as C
from spanframe.operators import sequences as S
from spanframe.operators import tables as B
from spanframe.sources import adapters as A
from spanframe.sources import sinks

TURNS = "turns AS (SELECT strftime(ts, '%Y-%m-%d') AS file_id, event_id AS pos, event_type AS speaker, user_id, (epoch_us(ts) // 1000) AS start_ms, (epoch_us(ts) // 1000) + CAST(round(value * 100) AS BIGINT) * 60 AS end_ms FROM events)"
WORDS = r"""w0 AS (SELECT conv_id AS file_id, turn, role AS speaker, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (SELECT *, regexp_extract_all(text, '\S+\s*') AS l FROM conversations)),
w1 AS (SELECT *, row_number() OVER o AS pos, coalesce(sum(length(word)) OVER (PARTITION BY file_id ORDER BY turn, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM w0 WINDOW o AS (PARTITION BY file_id ORDER BY turn, i)),
words AS (SELECT file_id, pos, turn, speaker, word, CAST(b * 10 + turn * 1000 AS BIGINT) AS start_ms, CAST(b * 10 + turn * 1000 + length(regexp_replace(word, '\s+$', '')) * 10 AS BIGINT) AS end_ms FROM w1)"""
CLIPS = "clips AS (SELECT doc_id AS clip_id, text, lang, d AS dur_ms, d * 4 // 5 AS speech_ms FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN n_chars * 40 ELSE CAST(floor(n_chars * 1000 / 15) AS BIGINT) END AS d FROM documents))"
PAIRS = "pairs AS (SELECT doc_id, b.text AS ref, d.text AS hyp FROM documents d JOIN benchmark b ON item_id = doc_id % (SELECT count(*) FROM benchmark))"
MERGED = "m0 AS (SELECT *, max(end_ms) OVER (PARTITION BY file_id, speaker ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM turns WHERE end_ms - start_ms >= 50), m1 AS (SELECT *, sum(CASE WHEN u IS NULL OR start_ms > u THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, speaker ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS g FROM m0), merged AS (SELECT file_id, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM m1 GROUP BY file_id, speaker, g)"
SENTS = r"""s0 AS (SELECT *, regexp_matches(word, '[。！？!?…‥]+[」』）)\]】〕”’"'']*\s*$') OR regexp_matches(word, '[.．][」』）)\]】〕”’"'']*\s+$') OR (lead(word) OVER o IS NULL AND regexp_matches(word, '[.．][」』）)\]】〕”’"'']*\s*$')) AS e, lag(speaker) OVER o AS ps, lag(end_ms) OVER o AS pe FROM words WINDOW o AS (PARTITION BY file_id ORDER BY pos)),
s1 AS (SELECT *, lag(e) OVER (PARTITION BY file_id ORDER BY pos) AS le FROM s0),
s2 AS (SELECT *, sum(CASE WHEN le IS NULL OR le OR start_ms - pe > 1500 OR speaker IS DISTINCT FROM ps THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sent_id FROM s1),
sents AS (SELECT file_id, sent_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, arg_min(speaker, pos) AS speaker, count(*) AS n_words, trim(string_agg(word, '' ORDER BY pos), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM s2 GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY file_id, sent_id")
#: Words whose speaker flickers: every word of a length divisible by five is someone else's.
FLICKER = "flicker AS (SELECT * REPLACE (CASE WHEN length(word) % 5 = 0 THEN 'x' ELSE speaker END AS speaker) FROM words)"
ABSORB = """r0 AS (SELECT *, CASE WHEN lag(pos) OVER o IS NULL OR lag(speaker) OVER o IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS b FROM {0} WINDOW o AS (PARTITION BY file_id ORDER BY pos)),
r1 AS (SELECT *, sum(b) OVER (PARTITION BY file_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM r0),
r2 AS (SELECT file_id, run, arg_min(speaker, pos) AS own, count(*) AS n, arg_max(end_ms, pos) - arg_min(start_ms, pos) AS d FROM r1 GROUP BY file_id, run),
r3 AS (SELECT *, lag(own) OVER o AS l, n <= 2 AND d < 800 AND coalesce(lag(own) OVER o = lead(own) OVER o, false) AS may FROM r2 WINDOW o AS (PARTITION BY file_id ORDER BY run)),
r4 AS (SELECT *, sum(CASE WHEN may THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY run ROWS UNBOUNDED PRECEDING) AS st FROM r3),
r5 AS (SELECT *, may AND row_number() OVER (PARTITION BY file_id, st ORDER BY run) % 2 = 0 AS taken FROM r4),
absorbed AS (SELECT r1.* REPLACE (CASE WHEN taken THEN l ELSE speaker END AS speaker) FROM r1 JOIN r5 USING (file_id, run))"""
#: Sentences of 150 characters at most and paragraphs, each told row by row from what came before.
CAPPED = f"""{SENTS.replace("s1 AS (", "s1 AS MATERIALIZED (")},
fold AS (SELECT file_id, pos, 1 AS sid, length(word) AS n FROM s1 WHERE pos = 1
UNION ALL SELECT s.file_id, s.pos, CASE WHEN b THEN sid + 1 ELSE sid END, CASE WHEN b THEN 0 ELSE n END + length(word) FROM (SELECT s1.*, sid, n, le OR start_ms - pe > 1500 OR speaker IS DISTINCT FROM ps OR n >= 150 AS b FROM fold f JOIN s1 ON s1.file_id = f.file_id AND s1.pos = f.pos + 1) s),
capped AS (SELECT file_id, sid AS sent_id, arg_min(start_ms, pos) AS start_ms, arg_max(end_ms, pos) AS end_ms, arg_min(speaker, pos) AS speaker, count(*) AS n_words, trim(string_agg(word, '' ORDER BY pos), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM fold JOIN s1 USING (file_id, pos) GROUP BY file_id, sid)"""
PARS = f"""{SENTS}, p0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY sent_id) AS k FROM sents WHERE text <> ''),
fold AS (SELECT file_id, k, 0 AS par_id, start_ms, end_ms, speaker, text FROM p0 WHERE k = 1
UNION ALL SELECT file_id, k, CASE WHEN j THEN par_id ELSE par_id + 1 END, CASE WHEN j THEN fs ELSE start_ms END, end_ms, speaker, CASE WHEN NOT j THEN text WHEN regexp_matches(ft, '([。！？!?」』]|[^\\x00-\\x7F])$') THEN ft || text ELSE ft || ' ' || text END FROM (SELECT p0.*, f.par_id, f.start_ms AS fs, f.text AS ft, p0.speaker IS NOT DISTINCT FROM f.speaker AND p0.start_ms - f.end_ms <= 3000 AND length(f.text) + length(p0.text) <= 400 AS j FROM fold f JOIN p0 ON p0.file_id = f.file_id AND p0.k = f.k + 1) x)"""
HMS = "printf('%02d:%02d:%02d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60)"

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _spread(spark, pairs):
    """Pairs dealt evenly, as comparing them takes far longer than sending them."""
    return pairs.repartition(4 * spark.sparkContext.defaultParallelism)


def _sentences(spark, d):
    return S.sentences(S.sentence_ids(A.words(spark, d), most_chars=None))


@query(f"WITH {TURNS}, {MERGED} SELECT * FROM merged")
def f3_normalize_segments(spark, d):
    return I.normalize(A.turns(spark, d), ["file_id", "speaker"])


@query(f"WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), m AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM n WHERE value > 20) SELECT user_id, min(i) AS first, max(i) AS last FROM m GROUP BY user_id, g")
def f1_runs(spark, d):
    return I.runs(A.table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 20)


@query("WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, quantile_cont(value, 0.995) OVER (PARTITION BY user_id) - 200 AS lim FROM events), m AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM n WHERE value > lim), r AS (SELECT user_id, min(i) AS first, max(i) AS last FROM m GROUP BY user_id, g), s AS (SELECT *, first - lag(last) OVER (PARTITION BY user_id ORDER BY first) - 1 AS gap FROM r), t AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY first ROWS UNBOUNDED PRECEDING) AS k FROM s), u AS (SELECT user_id, min(first) AS first, max(last) AS last FROM t GROUP BY user_id, k) SELECT * FROM u WHERE last - first + 1 >= 3")
def f2_energy_vad(spark, d):
    return I.energy_vad(A.table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 200, 3, 2)


@query("SELECT user_id, round(quantile_cont(value, 0.995), 6) AS p995 FROM events GROUP BY user_id")
def e3_percentile(spark, d):
    return A.table(spark, d, "events").groupBy("user_id").agg(F.round(F.percentile("value", 0.995), 6).alias("p995"))


@query(f"WITH {TURNS}, e AS (SELECT file_id, speaker, start_ms AS t, 1 AS d FROM turns UNION ALL SELECT file_id, speaker, end_ms, -1 FROM turns), n AS (SELECT *, sum(d) OVER (PARTITION BY file_id, speaker ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS c FROM e), x AS (SELECT file_id, t, d FROM n WHERE (d = 1 AND c = 1) OR (d = -1 AND c = 0)), y AS (SELECT *, sum(d) OVER (PARTITION BY file_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS c FROM x), z AS (SELECT *, lead(t) OVER (PARTITION BY file_id ORDER BY t, d) AS end_ms FROM y WHERE (d = 1 AND c = 2) OR (d = -1 AND c = 1)) SELECT file_id, t AS start_ms, end_ms FROM z WHERE d = 1 AND end_ms - t >= 200")
def f8_overlap_regions(spark, d):
    return I.overlap_regions(A.turns(spark, d))


@query(f"WITH {TURNS}, w AS (SELECT file_id, pos, start_ms + 5000 AS start_ms, start_ms + 5400 AS end_ms FROM turns), t AS (SELECT * FROM turns WHERE end_ms > start_ms), j AS (SELECT w.file_id, w.pos, w.start_ms, w.end_ms, t.speaker, t.start_ms AS ts, t.pos AS tp, least(t.end_ms, w.end_ms) - greatest(t.start_ms, w.start_ms) AS o, greatest(2 * t.start_ms - w.start_ms - w.end_ms, w.start_ms + w.end_ms - 2 * t.end_ms, 0) AS far FROM w LEFT JOIN t USING (file_id)), g AS (SELECT file_id, pos, start_ms, end_ms, coalesce(arg_min(speaker, (-o, ts, tp)) FILTER (o > 0), arg_min(speaker, (far, ts, tp)) FILTER (far <= 2000)) AS s FROM j GROUP BY file_id, pos, start_ms, end_ms), f AS (SELECT *, coalesce(s, last_value(s IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY start_ms, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS s1 FROM g) SELECT file_id, pos, start_ms, end_ms, coalesce(s1, first_value(s1 IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY start_ms, pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS speaker FROM f")
def d1_assign_speakers(spark, d):
    t = A.turns(spark, d)
    spoken = t.select("file_id", "pos", "speaker", (F.col("start_ms") + 5000).alias("start_ms"), (F.col("start_ms") + 5400).alias("end_ms"))
    return I.assign_speakers(spoken, t)


@query(f"WITH {TURNS}, {MERGED}, h AS (SELECT DISTINCT file_id, start_ms // 3600000 AS hour FROM turns) SELECT h.file_id, hour, CAST(coalesce(sum(least(end_ms, (hour + 1) * 3600000) - greatest(start_ms, hour * 3600000)), 0) AS BIGINT) AS speech_ms FROM h LEFT JOIN merged m ON h.file_id = m.file_id AND m.start_ms < (hour + 1) * 3600000 AND m.end_ms > hour * 3600000 GROUP BY h.file_id, hour")
def d5_speech_in(spark, d):
    t = A.turns(spark, d)
    hours = t.select("file_id", F.expr("start_ms div 3600000").alias("hour")).distinct().select("file_id", "hour", (F.col("hour") * 3600000).alias("start_ms"), ((F.col("hour") + 1) * 3600000).alias("end_ms"))
    segs = I.normalize(t, ["file_id", "speaker"]).select("file_id", F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    found = I.overlap_join(hours, segs).groupBy("file_id", "hour").agg(F.sum("overlap_ms").alias("n"))
    return hours.join(found, ["file_id", "hour"], "left").select("file_id", "hour", F.coalesce("n", F.lit(0)).alias("speech_ms"))


@query(f"WITH {WORDS}, c AS (SELECT *, unnest([start_ms // 5000 - 1, start_ms // 5000, start_ms // 5000 + 1]) AS clip FROM words) SELECT file_id, pos, clip, greatest(start_ms, clip * 5000 - 500) AS start_ms, least(greatest(end_ms, greatest(start_ms, clip * 5000 - 500)), clip * 5000 + 5500) AS end_ms FROM c WHERE start_ms + end_ms >= clip * 10000 AND start_ms + end_ms < clip * 10000 + 10000")
def c1_c2_ownership(spark, d):
    near = F.expr("start_ms div 5000")
    c = A.words(spark, d).withColumn("clip", F.explode(F.array(near - 1, near, near + 1)))
    c = c.where(C.owns(F.col("start_ms"), F.col("end_ms"), F.col("clip") * 5000, F.col("clip") * 5000 + 5000))
    start, end = C.clamp(F.col("start_ms"), F.col("end_ms"), F.col("clip") * 5000 - 500, F.col("clip") * 5000 + 5500)
    return c.select("file_id", "pos", "clip", start.alias("start_ms"), end.alias("end_ms"))


@query("SELECT doc_id, quality IS NULL AS fresh FROM documents LEFT JOIN labels USING (doc_id)")
def d3_resume(spark, d):
    docs, done = A.table(spark, d, "documents").select("doc_id"), A.table(spark, d, "labels").select("doc_id")
    fresh = B.unfinished(docs, done, "doc_id").withColumn("fresh", F.lit(True))
    return fresh.unionByName(docs.join(done, "doc_id", "left_semi").withColumn("fresh", F.lit(False)))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 3)")
def d4_skip_complete(spark, d):
    outputs = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return B.incomplete(A.table(spark, d, "orders").select("o_orderkey"), outputs, "o_orderkey", "l_returnflag", 3)


@query("WITH v AS (SELECT l_orderkey, l_returnflag, sum(greatest(0.02, l_quantity)) AS w, min(l_linenumber) AS f FROM lineitem GROUP BY l_orderkey, l_returnflag), t AS (SELECT l_orderkey, arg_max(l_returnflag, (w, -f)) AS r, max(w) AS weight, sum(w) AS total FROM v GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN weight >= 0.6 * total THEN r END AS l_returnflag, weight, total FROM t")
def e1_majority_vote(spark, d):
    return S.majority(A.table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", F.greatest(F.lit(0.02), F.col("l_quantity")), "l_linenumber")


@query(f"WITH {WORDS}, {SENTS} SELECT file_id, CAST(sent_id AS BIGINT) AS sent_id, start_ms, end_ms, speaker, n_words, text FROM sents WHERE text <> ''")
def f11_f15_sentences(spark, d):
    return _sentences(spark, d)


@query(f"WITH RECURSIVE {WORDS}, {CAPPED} SELECT file_id, CAST(sent_id AS BIGINT) AS sent_id, start_ms, end_ms, speaker, n_words, text FROM capped WHERE text <> ''")
def f11_sentences_capped(spark, d):
    return S.sentences(S.sentence_ids(A.words(spark, d)))


@query(f"WITH RECURSIVE {WORDS}, {PARS} SELECT file_id, CAST(par_id AS BIGINT) AS par_id, arg_min(start_ms, k) AS start_ms, arg_max(end_ms, k) AS end_ms, arg_min(speaker, k) AS speaker, arg_max(text, k) AS text FROM fold GROUP BY file_id, par_id")
def f16_paragraphs(spark, d):
    return S.paragraphs(_sentences(spark, d))


@query(f"WITH {WORDS}, {SENTS}, c AS (SELECT file_id, sent_id, start_ms, greatest(end_ms + 200, start_ms + 600) AS e, lead(start_ms) OVER (PARTITION BY file_id ORDER BY sent_id) AS nx FROM sents WHERE text <> '') SELECT file_id, CAST(sent_id AS BIGINT) AS sent_id, start_ms, greatest(least(e, coalesce(nx - 1, e)), start_ms + 50) AS end_ms FROM c")
def f18_cue_times(spark, d):
    return S.cue_times(_sentences(spark, d)).select("file_id", "sent_id", "start_ms", "end_ms")


@query(f"WITH {WORDS}, f AS (SELECT file_id, speaker, min(pos) AS p FROM words GROUP BY file_id, speaker) SELECT file_id, speaker, '話者' || chr(CAST(64 + row_number() OVER (PARTITION BY file_id ORDER BY p) AS INTEGER)) AS name FROM f")
def f12_speaker_names(spark, d):
    return S.speaker_names(A.words(spark, d))


@query("SELECT event_id, last_value(CASE WHEN value > 50 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM events")
def f20_forward_fill(spark, d):
    e = A.table(spark, d, "events").withColumn("filled", F.when(F.col("value") > 50, F.col("event_type")))
    return S.fill(e, ["user_id"], ["ts", "event_id"], "filled", back=False).select("event_id", "filled")


@query("SELECT conv_id, turn, CAST(sum(length(text) * 10 + 500) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - length(text) * 10 - 500 AS BIGINT) AS offset_ms FROM conversations")
def f24_utterance_offsets(spark, d):
    c = A.table(spark, d, "conversations").withColumn("n", F.length("text") * 10 + 500)
    return B.offsets(c, ["conv_id"], ["turn"], "n", "offset_ms").select("conv_id", "turn", "offset_ms")


@query(f"WITH {WORDS}, {SENTS} SELECT file_id, string_agg(n || chr(10) || {HMS.format('start_ms')} || ',' || lpad(CAST(start_ms % 1000 AS VARCHAR), 3, '0') || ' --> ' || {HMS.format('end_ms')} || ',' || lpad(CAST(end_ms % 1000 AS VARCHAR), 3, '0') || chr(10) || speaker || ': ' || text || chr(10), chr(10) ORDER BY n) AS srt FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY sent_id) AS n FROM sents WHERE text <> '') GROUP BY file_id")
def b2_srt(spark, d):
    return sinks.srt(_sentences(spark, d), "sent_id")


@query(f"WITH {WORDS}, {SENTS} SELECT file_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({HMS.format('start_ms')} || '.' || lpad(CAST(start_ms % 1000 AS VARCHAR), 3, '0') || ' --> ' || {HMS.format('end_ms')} || '.' || lpad(CAST(end_ms % 1000 AS VARCHAR), 3, '0') || chr(10) || '<v ' || speaker || '>' || text || chr(10), chr(10) ORDER BY sent_id) AS vtt FROM sents WHERE text <> '' GROUP BY file_id")
def b3_vtt(spark, d):
    return sinks.vtt(_sentences(spark, d), "sent_id")


@query(f"WITH {TURNS} SELECT pos, printf('SPEAKER %s 1 %d.%03d %d.%03d <NA> <NA> %s <NA> <NA>', file_id, start_ms // 1000, start_ms % 1000, (end_ms - start_ms) // 1000, (end_ms - start_ms) % 1000, regexp_replace(speaker, '\\s+', '_', 'g')) AS line FROM turns")
def b7_rttm(spark, d):
    return sinks.rttm_lines(A.turns(spark, d)).select("pos", "line")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def h1_first_of_equal(spark, d):
    return B.first_of_equal(A.table(spark, d, "documents"), ["text"], "doc_id").select("doc_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 6")
def g5_newest(spark, d):
    return B.newest(A.table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 6).select("event_id")


@query(r"SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS terms FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[\s、，,・･/／;；]+'), lambda x: x <> '') AS l FROM conversations)")
def a10_parse_terms(spark, d):
    return A.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.terms(F.col("text")), "|").alias("terms"))


@query(f"SELECT event_id, {HMS.format('((epoch_us(ts) // 1000) % 86400000)')} AS hms, {HMS.format('((epoch_us(ts) // 1000) % 86400000)')} || ',' || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') AS srt FROM events")
def i2_i3_times(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp")) % 86400000
    return A.table(spark, d, "events").select("event_id", T.hms(ms).alias("hms"), T.clock(ms).alias("srt"))


@query(r"SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{N}'']', '', 'g')) AS core FROM documents")
def i5_core_len(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.core_len(F.col("text")).cast("bigint").alias("core"))


@query()
def i9_collapse_repeats(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.collapse_repeats(F.col("text")).alias("text"))


@query(f"WITH {PAIRS}, n AS (SELECT doc_id, regexp_replace(lower(ref), '[^a-z0-9]', '', 'g') AS r, regexp_replace(lower(hyp), '[^a-z0-9]', '', 'g') AS h FROM pairs) SELECT doc_id, CASE WHEN r = '' THEN CASE WHEN h = '' THEN 0.0 ELSE 'nan'::DOUBLE END ELSE levenshtein(r, h) / length(r) END AS cer FROM n")
def i15_i16_cer(spark, d):
    p = _spread(spark, A.pairs(spark, d)).select("doc_id", T.normal_ascii(F.col("ref")).alias("r"), T.normal_ascii(F.col("hyp")).alias("h"))
    return p.select("doc_id", T.cer(F.col("r"), F.col("h")).alias("cer"))


@query()
def i14_i16_cer_whole(spark, d):
    """The error rate over the letters and digits of all scripts."""
    p = _spread(spark, A.pairs(spark, d)).select("doc_id", T.normal(F.col("ref")).alias("r"), T.normal(F.col("hyp")).alias("h"))
    return p.select("doc_id", T.cer(F.col("r"), F.col("h")).alias("cer"))


@query(f"WITH {PAIRS}, t AS (SELECT doc_id, ref, hyp, unnest(['the', 'and', 'tion', 'er']) AS term FROM pairs) SELECT doc_id, CAST(sum(least((length(ref) - length(replace(ref, term, ''))) // length(term), (length(hyp) - length(replace(hyp, term, ''))) // length(term))) AS BIGINT) AS hit, CAST(sum((length(ref) - length(replace(ref, term, ''))) // length(term)) AS BIGINT) AS total FROM t GROUP BY doc_id")
def i18_term_recall(spark, d):
    t = A.pairs(spark, d).withColumn("term", F.explode(F.array(*map(F.lit, ("the", "and", "tion", "er")))))
    a, b = T.occurrences(F.col("ref"), F.col("term")).cast("bigint"), T.occurrences(F.col("hyp"), F.col("term")).cast("bigint")
    return t.groupBy("doc_id").agg(F.sum(F.least(a, b)).alias("hit"), F.sum(a).alias("total"))


@query(f"WITH {PAIRS}, r AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(ref, '[a-z]+')) AS w FROM pairs) GROUP BY doc_id, w), h AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(hyp, '[a-z]+')) AS w FROM pairs) GROUP BY doc_id, w) SELECT doc_id, CAST(sum(least(r.n, h.n)) AS BIGINT) AS common FROM r JOIN h USING (doc_id, w) GROUP BY doc_id")
def e11_multiset_common(spark, d):
    p = A.pairs(spark, d)
    count = lambda c, n: p.select("doc_id", F.explode(F.expr(f"regexp_extract_all({c}, '[a-z]+', 0)")).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias(n))
    return count("ref", "a").join(count("hyp", "b"), ["doc_id", "w"]).groupBy("doc_id").agg(F.sum(F.least("a", "b")).alias("common"))


@query(f"WITH {CLIPS}, c AS (SELECT *, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}'']', '', 'g')) AS core, length(text) - length(translate(text, '。、，．！？,.!?', '')) AS stops FROM clips) SELECT clip_id, CASE WHEN trim(text) = '' THEN CASE WHEN speech_ms >= 2000 THEN 'empty' ELSE '' END ELSE array_to_string(list_filter([CASE WHEN dur_ms > 0 AND core * 1000 > greatest(dur_ms, 1000) * 18 THEN 'too_dense' END, CASE WHEN core > 150 AND stops < 3 THEN 'no_punct' END], lambda x: x IS NOT NULL), '|') END AS flags FROM c")
def i25_quality_flags(spark, d):
    return A.clips(spark, d).select("clip_id", F.array_join(T.plain_flags(F.col("text"), F.col("dur_ms"), F.col("speech_ms")), "|").alias("flags"))


@query()
def i25_quality_flags_whole(spark, d):
    """All flags; the first six words of a text stand for the terms of its context."""
    c = A.clips(spark, d).withColumn("terms", F.slice(T.terms(F.substring("text", 1, 60)), 1, 6))
    return c.select("clip_id", F.array_join(T.quality_flags(F.col("text"), F.col("dur_ms"), F.col("speech_ms"), F.col("terms"), "Terms", lang=T.language_name(F.col("lang"))), "|").alias("flags"))


@query(f"WITH {CLIPS} SELECT lang, count(*) AS clips, CAST(sum(speech_ms) AS BIGINT) AS speech_ms, max(dur_ms) AS longest_ms, count(*) FILTER (dur_ms > 30000) AS hard_cuts FROM clips GROUP BY lang")
def e7_clip_totals(spark, d):
    return C.clip_totals(A.clips(spark, d), ["lang"])


@query(f"WITH {CLIPS} SELECT clip_id FROM clips WHERE trim(text) <> '' AND lang IN ('en', 'de', 'fr', 'es') AND dur_ms <= 179000")
def c5_aligner_eligible(spark, d):
    return C.alignable(A.clips(spark, d).withColumnRenamed("lang", "language"), ("en", "de", "fr", "es")).select("clip_id")


@query("SELECT user_id, count(DISTINCT event_type) AS speakers, count(*) AS turns FROM events GROUP BY user_id")
def e9_speakers(spark, d):
    return B.speaker_counts(A.turns(spark, d), ["user_id"])


@query(f"WITH {CLIPS} SELECT clip_id, row_number() OVER (PARTITION BY lang ORDER BY dur_ms DESC, clip_id) AS place FROM clips")
def g1_longest_first(spark, d):
    return C.longest_first(A.clips(spark, d), ["lang"]).select("clip_id", "place")


@query("SELECT conv_id, g AS grp, min(turn) AS first, max(turn) AS last FROM (SELECT conv_id, turn, sum(CASE WHEN p IS DISTINCT FROM k THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT conv_id, turn, length(text) % 2 AS k, lag(length(text) % 2) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)) GROUP BY conv_id, g")
def f23_adjacent_groups(spark, d):
    c = A.table(spark, d, "conversations").withColumn("k", F.length("text") % 2)
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("p", F.lag("k").over(w))
    c = I.islands(c, ["conv_id"], ["turn"], ~F.col("p").eqNullSafe(F.col("k")), "grp")
    return c.groupBy("conv_id", "grp").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))


@query("SELECT n_nationkey, coalesce(r_name, 'none') AS label FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def d9_label_lookup(spark, d):
    names = A.table(spark, d, "region").where("r_regionkey < 3")
    return A.table(spark, d, "nation").join(names, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", F.coalesce("r_name", F.lit("none")).alias("label"))


def _flicker(spark, d):
    return A.words(spark, d).withColumn("speaker", F.when(F.length("word") % 5 == 0, "x").otherwise(F.col("speaker")))


@query(f"WITH {WORDS}, {FLICKER}, {ABSORB.format('flicker')} SELECT file_id, pos, speaker FROM absorbed")
def f9_absorb_interruptions(spark, d):
    return S.absorb_interruptions(_flicker(spark, d)).select("file_id", "pos", "speaker")


@query(f"WITH {WORDS}, {FLICKER}, {SENTS.split('s1 AS')[0].replace('FROM words', 'FROM flicker')} s1 AS (SELECT *, lag(e) OVER (PARTITION BY file_id ORDER BY pos) AS le FROM s0), s2 AS (SELECT *, sum(CASE WHEN le IS NULL OR le OR start_ms - pe > 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sent_id FROM s1), v0 AS (SELECT file_id, sent_id, speaker, sum(greatest(20, end_ms - start_ms)) AS w, min(pos) AS f FROM s2 GROUP BY file_id, sent_id, speaker), v1 AS (SELECT file_id, sent_id, CASE WHEN max(w) >= 0.6 * sum(w) THEN arg_max(speaker, (w, -f)) END AS vote FROM v0 GROUP BY file_id, sent_id), voted AS (SELECT file_id, pos, start_ms, end_ms, speaker AS old, coalesce(vote, speaker) AS speaker FROM s2 JOIN v1 USING (file_id, sent_id)), {ABSORB.format('voted')} SELECT file_id, pos, speaker, speaker IS DISTINCT FROM old AS changed FROM absorbed")
def f10_smooth_speakers(spark, d):
    return S.smooth_speakers(_flicker(spark, d), most_chars=None).select("file_id", "pos", "speaker", "changed")


@query(f"WITH {WORDS}, {SENTS.split('s1 AS')[0]} r AS (SELECT *, sum(CASE WHEN e OR nx IS NULL OR nx - end_ms >= 800 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lead(start_ms) OVER (PARTITION BY file_id ORDER BY pos) AS nx FROM s0)) SELECT file_id, pos, CAST(coalesce(sum(length(word)) OVER (PARTITION BY file_id, g ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest FROM r")
def f19_rest_lengths(spark, d):
    return S.rest_lengths(A.words(spark, d)).select("file_id", "pos", "rest")


@query(r"WITH t0 AS (SELECT doc_id AS clip_id, n_chars * 60 AS d, regexp_extract_all(text, '[^、。！？!?,.，．\s\x{3000}]+[、。！？!?,.，．]*[\s\x{3000}]*') AS l FROM documents), t1 AS (SELECT clip_id, d, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS i FROM t0), t2 AS (SELECT *, greatest(1, length(regexp_replace(word, '[^\p{L}\p{N}'']', '', 'g'))) AS w FROM t1), t3 AS (SELECT *, sum(w) OVER (PARTITION BY clip_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS b, sum(w) OVER (PARTITION BY clip_id) AS n, CAST(d // 3 AS DOUBLE) AS l1, CAST(d - d // 2 AS DOUBLE) AS l2 FROM t2), t4 AS (SELECT *, CAST(b - w AS DOUBLE) / n * (l1 + l2) AS x, CAST(b AS DOUBLE) / n * (l1 + l2) AS y FROM t3) SELECT clip_id, i, word, CAST(floor(CASE WHEN x <= l1 THEN x WHEN x - l1 <= l2 THEN d // 2 + (x - l1) ELSE d END + 0.5) AS BIGINT) AS start_ms, CAST(floor(CASE WHEN y <= l1 THEN y WHEN y - l1 <= l2 THEN d // 2 + (y - l1) ELSE d END + 0.5) AS BIGINT) AS end_ms FROM t4")
def f14_approx_tokens(spark, d):
    span = lambda s, e: F.struct(F.expr(s).alias("s"), F.expr(e).alias("e"))
    clips = A.table(spark, d, "documents").select(F.col("doc_id").alias("clip_id"), "text", F.lit(0).alias("start_ms"), (F.col("n_chars") * 60).alias("end_ms"))
    return S.approx_tokens(clips.withColumn("spans", F.array(span("cast(0 as bigint)", "end_ms div 3"), span("end_ms div 2", "end_ms"))))


@query(f"WITH regions AS ({ORACLES['f8_overlap_regions']}), {TURNS} SELECT r.file_id, r.start_ms, r.end_ms, string_agg(DISTINCT speaker, '|' ORDER BY speaker) AS speakers FROM regions r JOIN turns t ON t.file_id = r.file_id AND t.start_ms < r.end_ms AND t.end_ms > r.start_ms GROUP BY r.file_id, r.start_ms, r.end_ms")
def d8_region_speakers(spark, d):
    return I.region_speakers(A.turns(spark, d)).withColumn("speakers", F.array_join("speakers", "|"))


@query(f"WITH {TURNS}, {MERGED}, h AS (SELECT DISTINCT file_id, start_ms // 900000 AS clip_id FROM turns), c AS (SELECT file_id, clip_id, clip_id * 900000 AS s, (clip_id + 1) * 900000 AS e FROM h) SELECT c.file_id, clip_id, CASE WHEN m.file_id IS NULL THEN s ELSE greatest(s, m.start_ms) END AS start_ms, CASE WHEN m.file_id IS NULL THEN e ELSE least(e, m.end_ms) END AS end_ms FROM c LEFT JOIN merged m ON c.file_id = m.file_id AND m.start_ms < e AND m.end_ms > s")
def d7_inner_pieces(spark, d):
    t = A.turns(spark, d)
    clips = t.select("file_id", F.expr("start_ms div 900000").alias("clip_id")).distinct().withColumns({"start_ms": F.col("clip_id") * 900000, "end_ms": (F.col("clip_id") + 1) * 900000})
    segs = I.normalize(t, ["file_id", "speaker"]).select("file_id", F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    return I.inner_pieces(clips, segs)


@query(f"WITH {TURNS}, p AS (SELECT file_id, pos, start_ms + 90000 AS at_ms FROM turns), u AS (SELECT file_id, start_ms AS t, 0 AS k, end_ms AS e, pos, {{'s': start_ms, 'e': end_ms, 'w': speaker}} AS x, NULL AS p FROM turns UNION ALL SELECT file_id, at_ms, 1, 0, 0, NULL, pos FROM p), n AS (SELECT file_id, p, t, last_value(x IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY t, k, e, pos ROWS UNBOUNDED PRECEDING) AS a, last_value(x IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY t DESC, k DESC, e DESC, pos DESC ROWS UNBOUNDED PRECEDING) AS b FROM u) SELECT file_id, p AS pos, t AS at_ms, CASE WHEN b IS NULL OR (a IS NOT NULL AND (a.e >= t OR least(abs(t - a.s), abs(t - a.e)) <= least(abs(t - b.s), abs(t - b.e)))) THEN a.w ELSE b.w END AS speaker FROM n WHERE p IS NOT NULL")
def d11_nearest_of_two(spark, d):
    t = A.turns(spark, d)
    return I.nearest_of_two(t.select("file_id", "pos", (F.col("start_ms") + 90000).alias("at_ms")), t)


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id HAVING count(text) = max(turn) - min(turn) + 1")
def d6_whole_groups(spark, d):
    c = A.table(spark, d, "conversations")
    return I.whole_groups(c.join(c.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1).alias("n_parts")), "conv_id"), "conv_id", "n_parts", "turn", "text")


@query("WITH m AS (SELECT * FROM (VALUES ('en', 'English'), ('de', 'German'), ('fr', 'French'), ('es', 'Spanish'), ('ja', 'Japanese'), ('zh', 'Chinese'), ('it', 'Italian'), ('pt', 'Portuguese'), ('ru', 'Russian'), ('ko', 'Korean')) m(code, name)) SELECT doc_id, CASE WHEN coalesce(lang, '') = '' THEN '' ELSE coalesce(name, upper(left(lang, 1)) || lower(substr(lang, 2))) END AS name, CASE WHEN coalesce(lang, '') <> '' THEN coalesce(code, CASE WHEN length(lang) <= 3 THEN upper(left(lang, 1)) || lower(substr(lang, 2)) END) END AS code FROM documents LEFT JOIN m ON code = lower(lang)")
def d12_language_names(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.language_name(F.col("lang")).alias("name"), T.language_code(T.language_name(F.col("lang"))).alias("code"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS clip FROM conversations")
def f22_ordinals(spark, d):
    return B.ordinals(A.table(spark, d, "conversations"), ["conv_id"], ["turn"], "clip").select("conv_id", "turn", "clip")


@query(f"WITH {WORDS}, {SENTS} SELECT file_id, string_agg('[' || {HMS.format('start_ms')} || '] ' || speaker || ': ' || text, chr(10) ORDER BY sent_id) || chr(10) AS txt FROM sents WHERE text <> '' GROUP BY file_id")
def b1_txt(spark, d):
    return sinks.transcript(_sentences(spark, d), "sent_id")


@query(f"""WITH {WORDS}, {SENTS} SELECT file_id, 'start,end,start_hms,speaker,text' || chr(10) || string_agg(printf('%d.%03d,%d.%03d,', start_ms // 1000, start_ms % 1000, end_ms // 1000, end_ms % 1000) || {HMS.format('start_ms')} || ',' || speaker || ',' || CASE WHEN regexp_matches(text, '[",\r\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END, chr(10) ORDER BY sent_id) || chr(10) AS csv FROM sents WHERE text <> '' GROUP BY file_id""")
def b4_csv(spark, d):
    return sinks.csv_table(_sentences(spark, d), "sent_id")


@query(f"WITH {WORDS}, {SENTS} SELECT file_id, '# Talk' || chr(10) || chr(10) || '- model: none' || chr(10) || chr(10) || '## 文字起こし' || chr(10) || chr(10) || string_agg('**[' || {HMS.format('start_ms')} || ']** **' || speaker || '**  ' || chr(10) || text || chr(10), chr(10) ORDER BY sent_id) AS md FROM sents WHERE text <> '' GROUP BY file_id")
def b6_markdown(spark, d):
    return sinks.markdown(_sentences(spark, d), "sent_id", "Talk", {"model": "none"})


from spanframe.plans import runs as _runs, speech as _speech  # noqa: E402, F401  (they add their queries to QUERIES and ORACLES)

"""Queries of what runs some clips at a time, may fail in part, and goes on later."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spanframe.operators import batches as G
from spanframe.operators import detect as V
from spanframe.operators import metrics as M
from spanframe.operators import retry as E
from spanframe.operators import sequences as S
from spanframe.operators import sweep as P
from spanframe.plans.queries import query
from spanframe.plans.speech import _conversed, _heard
from spanframe.sources import adapters as A
from spanframe.sources.cache import read_cache
from spanframe.sources.files import write_files
from spanframe.sources.shared import new_folder, once
from spanframe.streaming.resume import close, restored, resume


@query("SELECT event_type, user_id, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type, user_id")
def j4_resumed(spark, d):
    """Events kept by a stream that is run twice over them, the second time without its checkpoint, then closed."""
    events = A.table(spark, d, "events").select("event_id", "event_type", "user_id")
    source, log = new_folder(spark, "arrived"), new_folder(spark, "log")
    events.repartition(6).write.parquet(source)
    for k in range(2):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
        resume(stream, log, "event_id", f"{log}/marks-{k}").awaitTermination()
    rows, closed = restored(spark, log, events.schema)
    if not closed:
        close(rows, log)
    return restored(spark, log, events.schema)[0].groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("ids"))


@query("""WITH t AS (SELECT conv_id, turn, text, conv_id % 3 AS m FROM conversations)
SELECT conv_id, CASE m WHEN 0 THEN 'final' WHEN 1 THEN 'partial' ELSE 'none' END AS state, CAST(CASE WHEN m = 2 THEN 0 ELSE count(DISTINCT turn) END AS BIGINT) AS clips, CAST(CASE WHEN m = 2 THEN 0 ELSE sum(length(text)) END AS BIGINT) AS chars FROM t GROUP BY conv_id, m""")
def a8_caches(spark, d):
    """Turns as lines of a cache file for each conversation: closed, still open, or torn."""
    none = F.lit(None).cast("string")
    clip = F.struct(F.col("turn").cast("long").alias("id"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"))
    entry = F.struct(clip.alias("clip"), "text", none.alias("language"), F.array().cast("array<string>").alias("flags"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))), lambda x: x["e"])
    files = A.table(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("es"))
    lines = F.array_join(F.transform("es", lambda e: F.to_json(e)), "\n")
    last = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("\n"), F.to_json(F.struct(F.lit(True).alias("final"), F.col("es").alias("results"))), F.lit("\nnot looked at"))).when(F.col("conv_id") % 3 == 1, "\n").otherwise('\n{"clip": {"id": 7, "st')
    folder = new_folder(spark, "caches")
    write_files(files, folder, F.concat("conv_id", F.lit(".jsonl")), F.concat(lines, last))
    read = read_cache(spark, folder)
    chars = F.aggregate("results", F.lit(0).cast("long"), lambda n, e: n + F.length(e["text"]))
    return read.select(F.regexp_extract("path", r"(\d+)\.jsonl$", 1).cast("long").alias("conv_id"), "state", F.size("results").cast("long").alias("clips"), chars.alias("chars"))


def _picky(items: list[dict]) -> list[dict]:
    """Answers up to four clips; some it can't read."""
    if len(items) > 4:
        raise MemoryError
    for i in items:
        if (i["file_id"] * 31 + i["clip_id"]) % 7 == 0:
            raise ValueError(f"clip {i['clip_id']}")
    return [{"text": f"clip {i['clip_id']}.", "language": "English"} for i in items]


@query("""WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE regexp_matches(text, '\\S')), b AS (SELECT conv_id, min(turn) FILTER ((conv_id * 31 + turn) % 7 = 0) AS bad, count(*) AS n, string_agg('clip ' || turn || '.', ' ' ORDER BY turn) AS x FROM t GROUP BY conv_id)
SELECT conv_id AS file_id, CASE WHEN bad IS NULL THEN n END AS clips, CASE WHEN bad IS NULL THEN x END AS text, 'ValueError: clip ' || bad AS error FROM b""")
def j8_isolated_files(spark, d):
    """Turns read by a recogniser that runs out of memory and fails for some: their conversations have an error, the others their texts."""
    words, _ = _conversed(spark, d)
    turns = words.groupBy("file_id", F.col("turn").cast("bigint").alias("clip_id")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    none = F.lit(None).cast("double")
    clips = turns.select("*", none.alias("own_start"), none.alias("own_end"), (F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), F.lit(False).alias("cut"), F.lit(None).cast("bigint").alias("parent"))
    good, bad = E.isolated(E.recognised(clips, G.recogniser(_picky, 16), policy=E.Policy(enabled=False)))
    said = F.array_sort(F.collect_list(F.struct("clip_id", "text")))
    told = good.groupBy("file_id").agg(F.count(F.lit(1)).alias("clips"), F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("text"))
    return told.withColumn("error", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


def _first_half(db: np.ndarray) -> list[tuple[float, float]]:
    """A detector that hears the first half, and fails where the end is louder than the start."""
    if db[-100:].mean() > db[:100].mean():
        raise RuntimeError("too loud an end")
    return [(0.0, len(db) * 0.02 / 2)]


@query()
def j6_speech_with_fallback(spark, d):
    """Speech of the sound made of vectors, and of the same sound backwards."""
    levels, _, files = _heard(spark, d)
    n = levels.groupBy("file_id").agg(F.max("frame").alias("top"))
    back = levels.join(n, "file_id").select(F.concat("file_id", F.lit("r")).alias("file_id"), (F.col("top") - F.col("frame")).alias("frame"), "db")
    both = levels.unionByName(back)
    all_files = files.unionByName(files.withColumn("file_id", F.concat("file_id", F.lit("r"))))
    return V.speech(V.detected(both, _first_half), both, all_files)


@query()
def g8_batches(spark, d):
    """Documents as clips in batches of sixteen at most, ten minutes with their padding."""
    return G.in_batches(A.spoken(spark, d), 16, 600_000, partitions=8).select("clip_id", (F.col("end_ms") - F.col("start_ms")).alias("dur_ms"), "batch", "place")


#: Presets over conversations, one whose recogniser fails for some clips and one that has none.
PRESETS = [P.Preset("plain", "Plain"), P.Preset("short", "Short", context=False), P.Preset("picky", "Picky"), P.Preset("missing", "Missing", env="none")]


def _sweep(spark, d):
    words, _ = _conversed(spark, d)
    turns = words.groupBy("file_id", F.col("turn").cast("bigint").alias("clip_id")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    none = F.lit(None).cast("double")
    clips = turns.select("*", none.alias("own_start"), none.alias("own_end"), (F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), F.lit(False).alias("cut"), F.lit(None).cast("bigint").alias("parent"))
    clips = once(clips, "clips")  # every preset reads them, some several times
    told = A.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("file_id"), F.col("turn").cast("bigint").alias("clip_id")).agg(F.max("text").alias("said"))
    # Halves of clips have numbers of their own, for which nothing is said.
    answers = lambda said: lambda asked: asked.select("file_id", "clip_id").join(told, ["file_id", "clip_id"], "left").select("file_id", "clip_id", F.coalesce(said, F.lit("")).alias("text"), F.lit("English").alias("language"), F.lit(None).cast(E.WORDS).alias("words"))
    files = clips.groupBy("file_id").agg(F.max("end_ms").alias("total_ms"))
    recognisers = {"plain": answers(F.col("said")), "short": answers(F.substring("said", 1, 60)), "picky": G.recogniser(_picky, 16)}
    reference = S.sentences(S.sentence_ids(words)).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_id", "text"))), lambda x: x["text"]), " ").alias("ref"))
    return P.sweep(clips, files, PRESETS, recognisers, context="Terms."), reference


@query()
def d10_presets_by_files(spark, d):
    """Every preset with every conversation, and how its text compares with what was said."""
    runs, reference = _sweep(spark, d)
    return M.compare(runs, reference).select("file_id", "place", "preset", "chars", "cer", F.col("drops.runs").alias("dropped"), "flags", "error")


@query("""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)
SELECT conv_id, turn, string_agg(line[1:40], chr(10) ORDER BY i) FILTER (i <= 2) || CASE WHEN count(*) > 2 THEN chr(10) || '… (全 ' || count(*) || ' 行)' ELSE '' END AS shown FROM l WHERE (conv_id, turn) IN (SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 3) GROUP BY conv_id, turn""")
def g6_previews(spark, d):
    """The first three turns of each conversation, of each two lines."""
    rows = P.first_rows(A.table(spark, d, "conversations"), ["conv_id"], ["turn"], 3)
    return rows.select("conv_id", "turn", P.preview(F.col("text"), 2, 40).alias("shown"))


@query("SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 1 ELSE least(32, CAST(pow(2, floor(log2(least(128, greatest(1, floor(greatest(1.0, p_size * 2 * 0.8 - 4.0) / 0.5))) + 0.01))) AS INTEGER)) END AS batch FROM part")
def l8_batch_sizes(spark, d):
    memory = F.when(F.col("p_size") % 10 != 0, F.col("p_size") * 2.0)
    return A.table(spark, d, "part").select("p_partkey", P.batch_size(memory, cap=32).alias("batch"))


@query("""SELECT doc_id, 'You write minutes.' || chr(10) || chr(10) || 'Sum up.' || chr(10) || chr(10) || '参考: この会議で出てくる固有名詞・専門用語の候補: alpha、beta' || chr(10) || chr(10) || '<transcript>' || chr(10) || text || chr(10) || '</transcript>' || chr(10) AS prompt FROM documents""")
def k16_minutes_prompts(spark, d):
    return A.table(spark, d, "documents").select("doc_id", P.minutes_prompt(F.col("text"), "You write minutes.", "Sum up.", ["alpha", "", "beta"]).alias("prompt"))

"""Span and token tables made from the test tables: explicit file ids, positions and whole milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.functions import text as T
from spanframe.operators.tables import ranked
from spanframe.sources import audio
from spanframe.sources.files import write_files
from spanframe.sources.shared import new_folder, shares


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, pos, speaker, start_ms, end_ms from events; a day is a file."""
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("file_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("speaker"), "user_id", t.alias("start_ms"), (t + F.round(F.col("value") * 100).cast("bigint") * 60).alias("end_ms"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, pos, turn, speaker, word (with its trailing blanks), start_ms, end_ms from conversations."""
    # Texts are a sixth of what their words would be on the way.
    texts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), "turn", F.col("role").alias("speaker"), "text").repartition(shares(spark), "file_id")
    each = texts.select("file_id", "turn", "speaker", F.posexplode(F.expr(r"regexp_extract_all(text, '\\S+\\s*', 0)")).alias("i", "word"))
    order = Window.partitionBy("file_id").orderBy("turn", "i")
    before = F.coalesce(F.sum(F.length("word")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = before * 10 + F.col("turn") * 1000
    return each.select("file_id", F.row_number().over(order).cast("bigint").alias("pos"), "turn", "speaker", "word", start.alias("start_ms"), (start + F.length(F.regexp_replace("word", r"\s+$", "")) * 10).alias("end_ms"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, text, lang, dur_ms, speech_ms from documents."""
    dur = F.when(F.col("doc_id") % 4 == 0, F.col("n_chars") * 40).otherwise(F.floor(F.col("n_chars") * 1000 / 15).cast("bigint"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"), "text", "lang", dur.alias("dur_ms")).withColumn("speech_ms", F.expr("dur_ms * 4 div 5"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ref, hyp: whole texts of benchmark and documents side by side; documents take the items in turn, all of them."""
    b = ranked(table(spark, sf_dir, "benchmark"), "item_id", "rank").select("rank", F.col("text").alias("ref"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("hyp"), F.pmod("doc_id", F.lit(max(1, b.count()))).alias("rank"))
    return d.join(b, "rank").select("doc_id", "ref", "hyp")


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, start_ms, end_ms from events: a type is a file, and a second counts as a millisecond, so that gaps and lengths are those of talk."""
    t = F.expr("unix_millis(cast(ts as timestamp)) div 1000 % 2592000")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("file_id"), t.alias("start_ms"), (t + F.round(F.col("value") * 6).cast("bigint")).alias("end_ms"))


#: Milliseconds between the clips of two documents.
APART = 1_000_000_000


#: Documents in a file of clips.
SPOKEN_TOGETHER = 50


def spoken(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Clips (as operators.clips gives them) of documents, with more columns of clips(): some neighbours of one language are a file, so that files stay small."""
    part = F.floor(F.col("clip_id") / (4 * SPOKEN_TOGETHER)).cast("string")
    c = clips(spark, sf_dir).withColumns({"file_id": F.concat(F.coalesce("lang", F.lit("?")), F.lit("-"), part), "start_ms": F.col("clip_id") * APART})
    none = F.lit(None).cast("double")
    return c.select("file_id", "clip_id", "start_ms", (F.col("start_ms") + F.col("dur_ms")).alias("end_ms"), none.alias("own_start"), none.alias("own_end"), "speech_ms", F.lit(False).alias("cut"), F.lit(None).cast("bigint").alias("parent"), *more)


def reader(spark: SparkSession, sf_dir: str, loops: bool = True):
    """A recogniser that reads the documents: of a stretch its share of the text, without a context (or loops) without the loops in it."""
    docs = clips(spark, sf_dir).select(F.col("clip_id").alias("__doc"), F.col("text").alias("__text"), "dur_ms")

    def recognise(asked: DataFrame) -> DataFrame:
        both = asked.join(docs, F.expr(f"start_ms div {APART}") == F.col("__doc"), "left")
        at = lambda c: F.floor((F.col(c) % APART) * F.length("__text") / F.greatest("dur_ms", F.lit(1)))
        part = F.substr(F.col("__text"), (at("start_ms") + 1).cast("int"), F.greatest(at("end_ms") - at("start_ms"), F.lit(0)).cast("int"))
        said = F.when((F.col("context") != "") & F.lit(loops), part).otherwise(T.collapse_repeats(part))
        return both.select("file_id", "clip_id", said.alias("text"), F.lit("English").alias("language"), F.lit(None).cast("array<struct<tok:string,s:double,e:double>>").alias("words"))

    return recognise


#: Of the sound made of vectors: samples a second, vectors in a file.
SOUND_RATE, SOUND_VECTORS = 1600, 250


def sound_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of WAV files made of `embeddings`: neighbouring vectors are the samples of a file, one after the other.

    The first 110 vectors of a file are loud; of the others every fifth ten are all but silent.
    """
    n = F.col("vec_id") % SOUND_VECTORS
    quiet = (n >= 110) & (F.floor(n / 10) % 5 == 0)
    gain = F.when(quiet, 0.001).otherwise(1.0).cast("float")
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / SOUND_VECTORS).alias("f"), "vec_id", F.transform("embedding", lambda x: x * gain).alias("x"))
    whole = rows.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("x")).select("f", F.flatten("x.x").alias("x"))  # a bounded number of vectors
    coded = F.pandas_udf(lambda xs: xs.map(lambda x: audio.wav_bytes(x, SOUND_RATE)), "binary")
    folder = new_folder(spark, "sound")
    write_files(whole, folder, F.concat(F.lit("s"), F.col("f"), F.lit(".wav")), coded("x"))
    return folder


def sound(spark: SparkSession, sf_dir: str, rate: int = 0) -> DataFrame:
    """Chunks of those files; a file's number is its file_id."""
    return audio.chunks(spark, [sound_files(spark, sf_dir)], rate=rate, partition_bytes=20_000).withColumn("file_id", F.regexp_extract("file_id", r"s(\d+)\.wav$", 1).cast("long"))

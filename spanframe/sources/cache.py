"""Caches of results: one file of JSON lines for each recording, a line for each clip, perhaps a last one with all results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLIP = "struct<id:bigint,start:double,end:double,own_start:double,own_end:double,speech:double,parent:bigint,cut:boolean>"
#: What of an entry is read; attempts and words stay JSON, as their fields vary.
ENTRY = f"struct<clip:{CLIP},text:string,language:string,flags:array<string>,attempts:string,words:string>"
LINE = f"clip {CLIP}, text string, language string, flags array<string>, attempts string, words string, final boolean, results array<{ENTRY}>, __bad string"


def parsed(line: Column) -> Column:
    return F.from_json(line, LINE, {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"})


def is_entry(e: Column) -> Column:
    return e["clip"]["id"].isNotNull() & e["clip"]["start"].isNotNull() & e["clip"]["end"].isNotNull()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """path, state, results (array of entries, by clip id unless final) of each cache file of a folder or pattern.

    state `final`: a last line with all results was reached, and its results are those, in its order. `partial`:
    the clips that lines tell of, of equal ids the last line's. `none`: a line before a final one, or that
    one, is no entry (a torn write, say), which discards the whole file. What follows a final line is not looked at.
    A file is a row, as it tells of one recording; a file without any bytes is none.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.coalesce("value", F.lit("")).alias("value"))
    lines = F.filter(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n"), lambda x: F.col("value") != "")
    each = files.withColumn("lines", F.transform(lines, parsed)).drop("value")
    ends = F.transform("lines", lambda x: x["__bad"].isNull() & F.coalesce(x["final"], F.lit(False)))
    each = each.withColumn("last", F.array_position(ends, True).cast("int"))
    before = F.when(F.col("last") > 0, F.slice("lines", 1, F.greatest(F.col("last") - 1, F.lit(0)))).otherwise(F.col("lines"))
    whole = F.forall(before, lambda x: x["__bad"].isNull() & is_entry(x))
    final = F.coalesce(F.when(F.col("last") > 0, F.get("lines", F.col("last") - 1)["results"]), F.array().cast(f"array<{ENTRY}>"))
    closed = (F.col("last") > 0) & F.get("lines", F.col("last") - 1)["results"].isNotNull() & F.forall(final, is_entry)
    state = F.when(whole & closed, "final").when(whole & (F.col("last") == 0) & (F.size("lines") > 0), "partial").otherwise("none")
    entry = lambda x: F.struct(*[x[n].alias(n) for n in ("clip", "text", "language", "flags", "attempts", "words")])
    # Of equal ids the last line counts: sorted by id and place, it stands before another id.
    told = F.transform("lines", lambda x, i: F.struct(x["clip"]["id"].alias("id"), i.alias("i"), entry(x).alias("e")))
    places = F.array_sort(told)
    newest = F.filter(places, lambda x, i: F.coalesce(F.get(places, i + 1)["id"] != x["id"], F.lit(True)))
    out = each.withColumn("state", state)
    some = F.when(F.col("state") == "final", final).when(F.col("state") == "partial", F.transform(newest, lambda x: x["e"])).otherwise(F.array().cast(f"array<{ENTRY}>"))
    return out.select("path", "state", some.alias("results"))

"""How near a text is to a reference, and models side by side."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import text as T
from spanframe.functions.distance import alike as alike_texts
from spanframe.functions.distance import edits, matching_blocks

#: Fixed value: what negates.
NEGATIONS = re.compile("ない|なかっ|なく|ません|ずに")


def told(ref: str, hyp: str) -> tuple[str, int, int, int, int, int, int]:
    """Status of each character of ref (= kept, s replaced, d deleted), negations kept, in ref, and in hyp only, and counts of edits (s, d, i)."""
    all_ = edits(ref, hyp)
    here, there = all_.replace("i", ""), all_.replace("d", "")
    spans = [m.span() for m in NEGATIONS.finditer(ref)]
    whole = lambda status, a, b: set(status[a:b]) == {"="}
    extra = sum(not whole(there, *m.span()) for m in NEGATIONS.finditer(hyp))
    return here, sum(whole(here, a, b) for a, b in spans), len(spans), extra, all_.count("s"), all_.count("d"), all_.count("i")


def _alignments(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    # Models often say the same of a file, whose rows stand beside each other once they have met their reference.
    pairs = [(r or "", h or "") for r, h in zip(ref, hyp)]
    each = {p: told(*p) for p in dict.fromkeys(pairs)}
    return pd.DataFrame([each[p] for p in pairs], columns=["status", "kept", "negations", "extra", "replaced", "deleted", "inserted"])


def alignment(ref: Column, hyp: Column) -> Column:
    """A struct of status, kept, negations, extra, replaced, deleted, inserted (see told()) of two texts, best in T.normal() form."""
    return F.pandas_udf(_alignments, "status string, kept bigint, negations bigint, extra bigint, replaced bigint, deleted bigint, inserted bigint")(ref, hyp)


def drop_runs(status: Column, least: int = 8, bridge: int = 2) -> Column:
    """runs, chars: stretches of the reference that were dropped, `least` characters and more, with up to `bridge` others between."""
    # Cut where more stands between: a pattern of repeated groups would need a stack as deep as a run is long.
    runs = F.transform(F.split(status, f"[^d]{{{bridge + 1},}}"), lambda r: F.length(F.regexp_replace(r, "[^d]", "")))
    long_ = F.filter(runs, lambda n: n >= least)
    return F.struct(F.size(long_).cast("bigint").alias("runs"), F.aggregate(long_, F.lit(0), lambda a, n: a + n).cast("bigint").alias("chars"))


def measured(rows: DataFrame, ref: str = "ref", hyp: str = "hyp", terms: list[str] | None = None) -> DataFrame:
    """rows with cer, terms (hit, total; null without terms), numbers (hit, total), negations (kept, total, extra) and drops (runs, chars)."""
    r, h = T.normal(F.col(ref)), T.normal(F.col(hyp))
    out = rows.withColumns({"__r": r, "__h": h, "__pr": T.nfkc(F.col(ref)), "__ph": T.nfkc(F.col(hyp))}).withColumn("__a", alignment(F.col("__r"), F.col("__h")))
    some = F.array(*[F.lit(t) for t in terms]) if terms else None
    empty = "struct<hit:bigint,total:bigint>"
    return out.withColumns({
        "cer": F.when(F.col("__r") == "", F.when(F.col("__h") == "", 0.0).otherwise(float("nan"))).otherwise((F.col("__a.replaced") + F.col("__a.deleted") + F.col("__a.inserted")) / F.length("__r")),
        "terms": T.term_recall(F.col("__pr"), F.col("__ph"), some) if terms else F.lit(None).cast(empty),
        "numbers": T.multiset_recall(T.numerals(F.col("__pr")), T.numerals(F.col("__ph"))),
        "negations": F.struct(F.col("__a.kept").alias("kept"), F.col("__a.negations").alias("total"), F.col("__a.extra").alias("extra")),
        "drops": drop_runs(F.col("__a.status")),
    }).drop("__r", "__h", "__pr", "__ph", "__a")


def compare(runs: DataFrame, reference: DataFrame | None = None, terms: list[str] | None = None) -> DataFrame:
    """Models side by side: runs (file_id, place, preset, label, text, asr_sec, wall_sec, load_sec, duration, flags, error).

    With a reference (file_id, ref) its measures are added; without one diff_vs_first, the error rate
    against the first model that didn't fail, and terms_found. A run that failed keeps its error and has no measures.
    """
    took = F.coalesce(F.nullif("asr_sec", F.lit(0.0)), "wall_sec")
    ok = runs.where("error IS NULL").withColumns({"chars": T.core_len(F.col("text")).cast("bigint"), "x_realtime": F.col("duration") / F.when(took.isNotNull(), F.greatest(took, F.lit(1e-6)))})
    if reference is not None:
        out = measured(ok.join(reference, "file_id", "left").withColumn("ref", F.coalesce("ref", F.lit(""))), "ref", "text", terms).drop("ref")
    else:
        first = F.first("text").over(Window.partitionBy("file_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
        place = F.row_number().over(Window.partitionBy("file_id").orderBy("place"))
        many = ok.withColumns({"__first": first, "__place": place})
        rate = T.cer(T.normal(F.col("__first")), T.normal(F.col("text")))
        found = F.aggregate(F.array(*map(F.lit, terms)), F.lit(0).cast("bigint"), lambda n, t: n + T.occurrences(F.col("text"), t).cast("bigint")) if terms else F.lit(None).cast("bigint")
        out = many.withColumns({"diff_vs_first": F.when(F.col("__place") > 1, rate), "terms_found": found}).drop("__first", "__place")
    return out.unionByName(runs.where("error IS NOT NULL"), allowMissingColumns=True)


def load_seconds(reused: Column, cached: Column, waited: Column, loaded: Column) -> Column:
    """What loading a model took: nothing if it was there, else the time waited for it, else that of loading."""
    return F.when(F.coalesce(reused, F.lit(False)) | F.coalesce(cached, F.lit(False)), 0.0).otherwise(F.coalesce(waited, loaded, F.lit(0.0)).cast("double"))


#: Stages of a run, as they are named.
STAGES = (("audio", "音声の変換"), ("vad", "区間検出"), ("load", "モデルの読み込み待ち"), ("asr", "文字起こし"), ("second_opinion", "セカンドオピニオン"), ("align", "タイムスタンプ"), ("diar_wait", "話者分離の待ち"))


def timing_breakdown(timings: Column, load: Column) -> Column:
    """A map of stages' seconds as a line that adds up to the total; what takes under 0.05 s is left out."""
    of = lambda k: F.coalesce(F.try_element_at(timings, F.lit(k)), F.lit(0.0))
    waited = F.least(load, of("asr"))
    seconds = {k: of(k) for k, _ in STAGES} | {"load": waited, "asr": F.greatest(F.lit(0.0), of("asr") - waited)}
    known = sum((seconds[k] for k, _ in STAGES), F.lit(0.0))
    rest = F.when(of("total") > 0, F.greatest(F.lit(0.0), of("total") - known)).otherwise(0.0)
    parts = [*((name, seconds[k]) for k, name in STAGES), ("書き出しなど", rest)]
    return F.array_join(F.array_compact(F.array(*[F.when(s >= 0.05, F.concat(F.lit(f"{name} "), T.duration(s))) for name, s in parts])), "・")


#: How a difference shows what both texts have, what is gone, and what is new.
BOTH, GONE, NEW = ("", ""), ("<del style='background:#fdd;text-decoration:line-through'>", "</del>"), ("<ins style='background:#dfd;text-decoration:none'>", "</ins>")


def pieces(a: str, b: str) -> Iterator[tuple[tuple[str, str], str]]:
    """Both texts as one: between the blocks that they share, what only a has, then what only b has."""
    done = 0, 0
    for x, y, n in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        yield GONE, a[done[0] : x]
        yield NEW, b[done[1] : y]
        yield BOTH, a[x : x + n]
        done = x + n, y + n


def diff_html(a: str, b: str) -> str:
    """Two texts as one: what is gone in del, what is new in ins, escaped."""
    return "".join(f"{mark[0]}{html.escape(text)}{mark[1]}" for mark, text in pieces(a, b) if text)


def differences(a: Column, b: Column) -> Column:
    """diff_html of two columns."""

    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([diff_html(s or "", t or "") for s, t in zip(x, y)], dtype=object)

    return F.pandas_udf(each, "string")(a, b)


#: Utterances that are looked for in a text at a time.
TOGETHER = 64


def dropped_utterances(utterances: DataFrame, texts: DataFrame, least: int = 4, alike: float = 0.6) -> DataFrame:
    """file_id, utterances, dropped: of each file's utterances (file_id, utt_id, text) of `least` characters and more, how many its text (file_id, text) all but lacks.

    One is dropped if no window of the text is alike enough (functions.distance.partial_likeness),
    both in T.normal() form. A file without a text has dropped all; a null utterance is no utterance.
    A file's utterances are compared some at a time, so that they spread over tasks.
    """
    said = utterances.select("file_id", "utt_id", T.normal(F.col("text")).alias("u")).where(F.length("u") >= least)
    dealt = said.withColumn("__deal", F.pmod(F.xxhash64("utt_id"), F.lit(1 << 10)))
    place = F.row_number().over(Window.partitionBy("file_id", "__deal").orderBy("utt_id"))
    some = dealt.withColumn("__part", F.floor((place - 1) / TOGETHER)).groupBy("file_id", "__deal", "__part").agg(F.collect_list("u").alias("us"))
    both = some.join(texts.select("file_id", T.normal(F.coalesce("text", F.lit(""))).alias("__text")), "file_id", "left").withColumn("__text", F.coalesce("__text", F.lit("")))

    def lacking(us: pd.Series, whole: pd.Series) -> pd.Series:
        pairs = [(k, (u, t)) for k, (many, t) in enumerate(zip(us, whole)) for u in many if u not in t]
        missing = ~alike_texts([p for _, p in pairs], alike)
        return pd.Series(np.bincount(np.array([k for k, _ in pairs], np.int64)[missing], minlength=len(us)), dtype="int64")

    counted = both.withColumn("__n", F.pandas_udf(lacking, "bigint")("us", "__text"))
    return counted.groupBy("file_id").agg(F.sum(F.size("us")).alias("utterances"), F.sum("__n").alias("dropped"))

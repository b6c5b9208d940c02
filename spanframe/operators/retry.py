"""Clips through a recogniser in three passes, a second opinion, and what is worth a look afterwards.

A recogniser is a function DataFrame -> DataFrame: of file_id, clip_id, start_ms, end_ms and
context it makes file_id, clip_id, text, language and words (array of tok, s, e in ms from the clip's
start, or null), and may make error, one row for each row. Each pass works on the clips that are still
flagged, and what a recogniser has said in it is written once, into the shared folder. A clip that failed
has its error, no text and no flags, and isn't read again; isolated() then sets its file apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import text as T
from spanframe.operators.clips import build_clips, split_clips, with_speech
from spanframe.operators.intervals import inner_pieces
from spanframe.operators.sequences import let
from spanframe.sources.shared import once

Recogniser = Callable[[DataFrame], DataFrame]
WORDS = "array<struct<tok:string,s:double,e:double>>"
#: What is remembered of each attempt: kind is text, split_from, split, collapsed or adopted.
ATTEMPT = "struct<kind:string,ctx:boolean,text:string,flags:array<string>,split_from:bigint,split_texts:array<string>,split_flags:array<array<string>>,model:string,pieces:int,rejected:string,adopted:string>"
ATTEMPTS = f"array<{ATTEMPT}>"
CLIP = ["file_id", "clip_id", "start_ms", "end_ms", "own_start", "own_end", "speech_ms", "cut", "parent"]
RESULT = [*CLIP, "text", "language", "flags", "attempts", "words", "error"]
NO_ANSWER = "no answer"
ECHO, INFLATING = ("context_label", "context_echo"), ("repetition", "too_dense", "context_echo", "context_label")


@dataclass(frozen=True)
class Policy:
    enabled: bool = True
    without_context: bool = True
    split: bool = True
    split_from_ms: int = 8000
    punctuates: bool = True
    most_cps: int = 18
    language: str = ""


def attempt(kind: str, **values: Column) -> Column:
    """A struct of ATTEMPT; what is not given is null."""
    fields = [f.split(":", 1) for f in ("kind:string", "ctx:boolean", "text:string", "flags:array<string>", "split_from:bigint", "split_texts:array<string>", "split_flags:array<array<string>>", "model:string", "pieces:int", "rejected:string", "adopted:string")]
    return F.struct(*[(F.lit(kind) if n == "kind" else values.get(n, F.lit(None))).cast(t).alias(n) for n, t in fields])


def flagged(rows: DataFrame, policy: Policy, terms: list[str], label: str) -> DataFrame:
    """rows with flags of their text."""
    some = F.array(*map(F.lit, terms)) if terms else None
    dur = F.col("end_ms") - F.col("start_ms")
    return rows.withColumn("flags", T.quality_flags(F.col("text"), dur, F.col("speech_ms"), some, label, policy.punctuates, policy.most_cps, F.lit(policy.language) if policy.language else None))


def with_error(rows: DataFrame) -> DataFrame:
    return rows if "error" in rows.columns else rows.withColumn("error", F.lit(None).cast("string"))


def answered(clips: DataFrame, recognise: Recogniser, policy: Policy, terms: list[str], label: str) -> DataFrame:
    """clips (with context) with text, language, words, flags and error.

    A clip without an answer has an error, if the recogniser tells of errors; of one that doesn't it ends the job.
    """
    said = recognise(clips.select("file_id", "clip_id", "start_ms", "end_ms", "context"))
    none = F.lit(NO_ANSWER) if "error" in said.columns else F.raise_error(F.lit("the recogniser gave no answer for a clip"))
    said = with_error(said).select("file_id", "clip_id", T.strip(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("language", F.lit("")).alias("language"), F.col("words").cast(WORDS).alias("words"), "error", F.lit(True).alias("__got"))
    out = clips.join(said, ["file_id", "clip_id"], "left").withColumn("error", F.when(F.col("__got").isNull(), none).otherwise(F.col("error"))).drop("__got")
    told = lambda c, none: F.when(F.col("error").isNull(), F.col(c)).otherwise(none).alias(c)
    out = out.withColumns({"text": told("text", F.lit("")), "language": told("language", F.lit("")), "words": told("words", F.lit(None))})
    return flagged(out, policy, terms, label).withColumn("flags", F.when(F.col("error").isNull(), F.col("flags")).otherwise(F.array().cast("array<string>")))


def isolated(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The results of the files in which no clip failed; and file_id, error of the others, that of their first clip that did."""
    bad = results.where("error IS NOT NULL").groupBy("file_id").agg(F.min_by("error", F.struct("start_ms", "clip_id")).alias("error"))
    return results.join(bad.select("file_id"), "file_id", "left_anti").drop("error"), bad


def tried(context: Column, text: str = "text", flags: str = "flags") -> Column:
    return attempt("text", ctx=context != "", text=F.col(text), flags=F.col(flags))


def answers_once(results: DataFrame) -> DataFrame:
    """results computed once, as once() does; a text that an attempt and the result have in common is kept once."""
    said = lambda a: a["text"].eqNullSafe(F.col("text"))
    bare = F.transform("attempts", lambda a: F.when(said(a), a.withField("text", F.lit(None).cast("string"))).otherwise(a))
    kept = once(results.withColumns({"__same": F.transform("attempts", said), "attempts": bare}), "answers")
    whole = F.zip_with("attempts", "__same", lambda a, same: F.when(same, a.withField("text", F.col("text"))).otherwise(a))
    return kept.withColumn("attempts", whole).drop("__same")


def recognised(clips: DataFrame, recognise: Recogniser, *, context: str = "", terms: tuple[str, ...] = (), label: str = "", policy: Policy = Policy(), levels: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """Results of clips (CLIP columns): text, language, flags, attempts, words.

    First all clips, but for those done already, whose flags are judged anew; then those with flags without
    context, taken if that leaves fewer flags; then those with flags of split_from_ms and more in halves, which
    take the clip's place if they have fewer flags together. Loops that are left are shortened.
    In the halves the context is used only if the first attempt had it and no flag, which a result judged anew may be.
    """
    terms_, ctx = list(terms), F.lit(context)
    todo = clips if done is None else clips.join(done.select("file_id", "clip_id"), ["file_id", "clip_id"], "left_anti")
    one = answered(todo.withColumn("context", ctx), recognise, policy, terms_, label).withColumn("attempts", F.array(tried(F.col("context")))).select(*RESULT)
    if done is not None:
        kept = clips.join(done.select("file_id", "clip_id", "text", "language", "attempts", "words"), ["file_id", "clip_id"])
        one = with_error(flagged(kept, policy, terms_, label)).select(*RESULT).unionByName(one)
    one = answers_once(one)  # what a recogniser has said is read several times below
    if not policy.enabled:
        return one
    if context and policy.without_context:
        again = once(answered(one.where(F.size("flags") > 0).select(*CLIP).withColumn("context", F.lit("")), recognise, policy, terms_, label), "answers")
        again = again.select("file_id", "clip_id", *[F.col(c).alias(f"__{c}") for c in ("text", "language", "flags", "words", "error")])
        both = one.join(again, ["file_id", "clip_id"], "left")
        tried_, better = F.col("__text").isNotNull() & F.col("__error").isNull(), F.size("__flags") < F.size("flags")
        attempts = F.when(tried_, F.concat("attempts", F.array(tried(F.lit(""), "__text", "__flags")))).otherwise(F.col("attempts"))
        take = lambda c, new: F.when(tried_ & better, new).otherwise(F.col(c)).alias(c)
        one = both.select(*CLIP, take("text", F.col("__text")), take("language", F.when(F.col("__language") != "", F.col("__language")).otherwise(F.col("language"))), take("flags", F.col("__flags")), attempts.alias("attempts"), take("words", F.col("__words")), F.coalesce("error", "__error").alias("error"))
    if policy.split:
        one = in_halves(one, recognise, context, policy, terms_, label, levels)
    looped = F.array_contains("flags", "repetition") & (T.collapse_repeats(F.col("text")) != F.col("text"))
    short = F.when(looped, T.collapse_repeats(F.col("text"))).otherwise(F.col("text"))
    attempts = F.when(looped, F.concat("attempts", F.array(attempt("collapsed")))).otherwise(F.col("attempts"))
    return one.withColumns({"attempts": attempts, "words": F.when(~looped, F.col("words")), "text": short}).select(*RESULT)


def in_halves(results: DataFrame, recognise: Recogniser, context: str, policy: Policy, terms: list[str], label: str, levels: DataFrame | None) -> DataFrame:
    """results in which flagged clips that are long enough give way to their halves where those have fewer flags."""
    dur = F.col("end_ms") - F.col("start_ms")
    bad = results.where((F.size("flags") > 0) & (dur >= policy.split_from_ms))
    top = results.groupBy("file_id").agg(F.max("clip_id").alias("__top"))
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc(F.col("end_ms") - F.col("start_ms")), "clip_id")) - 1
    first = F.element_at("attempts", 1)
    numbered = bad.join(top, "file_id").withColumns({"__place": place, "context": F.when(first["ctx"] & (F.size(first["flags"]) == 0), context).otherwise("")})
    halves = split_clips(numbered.select(*CLIP, "context", "__top", "__place"), levels)
    halves = halves.withColumn("clip_id", F.col("__top") + 1 + 2 * F.col("__place") + F.col("part"))
    said = once(answered(halves, recognise, policy, terms, label), "answers")
    pair = F.array_sort(F.collect_list(F.struct("part", "text", "flags")))
    judged = said.groupBy(F.col("file_id").alias("__file"), F.col("parent").alias("__parent")).agg(pair.alias("__pair"), F.min("error").alias("__bad"))
    both = results.join(judged, (F.col("file_id") == F.col("__file")) & (F.col("clip_id") == F.col("__parent")), "left")
    wins = F.col("__pair").isNotNull() & F.col("__bad").isNull() & (F.aggregate("__pair", F.lit(0), lambda n, x: n + F.size(x["flags"])) < F.size("flags"))
    split = attempt("split", split_texts=F.transform("__pair", lambda x: x["text"]), split_flags=F.transform("__pair", lambda x: x["flags"]))
    stay = both.where(~wins).withColumn("error", F.coalesce("error", "__bad")).withColumn("attempts", F.when(F.col("__pair").isNotNull(), F.concat("attempts", F.array(split))).otherwise(F.col("attempts"))).select(*RESULT)
    won = both.where(wins).select(F.col("file_id").alias("__f"), F.col("clip_id").alias("__c"), F.col("attempts").alias("__before"))
    new = said.join(won, (F.col("file_id") == F.col("__f")) & (F.col("parent") == F.col("__c")))
    mark = attempt("split_from", split_from=F.col("__c"))
    return stay.unionByName(new.withColumn("attempts", F.concat("__before", F.array(mark, tried(F.col("context"))))).select(*RESULT))


def second_opinion(results: DataFrame, recognise: Recogniser, model: str, speech: DataFrame, *, context: str = "", terms: tuple[str, ...] = (), label: str = "", policy: Policy = Policy(), takes_context: bool = True, max_clip_ms: int | None = None, max_gap_ms: int = 6000, levels: DataFrame | None = None) -> DataFrame:
    """results in which flagged clips have the text of another model where that leaves fewer flags.

    Clips that seem to echo the context are read without it. Clips longer than max_clip_ms and half a
    second are cut anew at the ends of speech, and their texts joined; all pieces must be there. A text much
    shorter than the former is refused, unless the former seemed inflated. The former texts stay among the attempts.
    """
    bad = results.where(F.size("flags") > 0)
    echo = F.arrays_overlap("flags", F.array(*map(F.lit, ECHO)))
    own = F.when(echo, "").otherwise(context if takes_context else "")
    limit = max_clip_ms + 500 if max_clip_ms else None
    long_ = F.col("end_ms") - F.col("start_ms") > limit if limit else F.lit(False)
    parts = bad.where(~long_).select("file_id", F.col("clip_id").alias("of"), "start_ms", "end_ms", own.alias("context"), F.lit(0).cast("bigint").alias("piece"))
    if max_clip_ms:
        far = bad.where(long_)
        segs = speech.select("file_id", F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
        # Each clip is a file of its own while it is cut.
        inner = inner_pieces(far.select("file_id", "clip_id", "start_ms", "end_ms"), segs).withColumn("file_id", F.struct("file_id", "clip_id"))
        ends = far.select(F.struct("file_id", "clip_id").alias("file_id"), F.col("end_ms").alias("total_ms"))
        own_levels = None if levels is None else levels.join(far.select("file_id", "clip_id"), "file_id").select(F.struct("file_id", "clip_id").alias("file_id"), "frame", "db")
        cut = build_clips(inner.select("file_id", "start_ms", "end_ms"), ends, own_levels, max_clip_ms=max_clip_ms, max_gap_ms=max_gap_ms, pad_ms=200, overlap_ms=0)
        cut = cut.select(F.col("file_id.file_id").alias("file_id"), F.col("file_id.clip_id").alias("of"), F.col("clip_id").alias("piece"), "start_ms", "end_ms")
        known = far.select(F.col("file_id").alias("__f"), F.col("clip_id").alias("__c"), F.col("start_ms").alias("__s"), own.alias("context"))
        cut = cut.join(known, (F.col("file_id") == F.col("__f")) & (F.col("of") == F.col("__c"))).withColumn("start_ms", F.greatest("start_ms", "__s"))
        parts = parts.unionByName(cut.select(*parts.columns))
    # The recogniser sees pieces as clips of their own numbers.
    parts = parts.withColumn("clip_id", F.row_number().over(Window.partitionBy("file_id").orderBy("of", "piece")).cast("bigint"))
    parts = once(parts, "pieces")
    said = parts.join(recognise(parts.select("file_id", "clip_id", "start_ms", "end_ms", "context")).select("file_id", "clip_id", "text", "words"), ["file_id", "clip_id"], "left")
    rows = F.array_sort(F.collect_list(F.struct("piece", "text")))
    whole = said.groupBy("file_id", "of").agg(rows.alias("rows"), F.count(F.lit(1)).cast("int").alias("__n"), F.count("text").alias("n_said"), F.first("words").cast(WORDS).alias("__words")).where(F.col("__n") == F.col("n_said"))
    whole = whole.select(F.col("file_id").alias("__f"), F.col("of").alias("__c"), "__n", F.when(F.col("__n") == 1, T.strip(F.element_at("rows", 1)["text"])).otherwise(T.joined_texts(F.transform("rows", lambda x: x["text"]))).alias("__text"), F.when(F.col("__n") == 1, F.col("__words")).alias("__words"))
    both = results.join(whole, (F.col("file_id") == F.col("__f")) & (F.col("clip_id") == F.col("__c")), "left")
    again = flagged(both.withColumns({"__old": F.col("flags"), "__said": F.col("text")}).withColumn("text", F.coalesce("__text", "text")), policy, list(terms), label)
    again = again.withColumnsRenamed({"flags": "__new", "__old": "flags"}).withColumn("text", F.col("__said"))
    asked = F.col("__text").isNotNull()
    fewer = asked & (F.size("__new") < F.size("flags"))
    short = (T.core_len(F.col("__text")) < 0.6 * T.core_len(F.col("text"))) & ~F.arrays_overlap("flags", F.array(*map(F.lit, INFLATING)))
    adopt = fewer & ~short
    refused = F.when(fewer & short, F.lit("元より大きく短い(読み飛ばしの疑い)"))
    note = attempt("text", model=F.lit(model), text=F.col("__text"), flags=F.col("__new"), pieces=F.when(F.col("__n") > 1, F.col("__n")), rejected=refused)
    attempts = F.when(adopt, F.concat("attempts", F.array(note, attempt("adopted", adopted=F.lit(model))))).when(asked, F.concat("attempts", F.array(note))).otherwise(F.col("attempts"))
    take = lambda c, new: F.when(adopt, F.col(new)).otherwise(F.col(c)).alias(c)
    return with_error(again).select(*CLIP, take("text", "__text"), "language", take("flags", "__new"), attempts.alias("attempts"), take("words", "__words"), "error")


def review_items(results: DataFrame) -> DataFrame:
    """The results worth a look: with flags, or changed on the way (halved, replaced, or another text than at first)."""
    texts = F.filter("attempts", lambda a: a["kind"] == "text")
    changed = F.exists("attempts", lambda a: a["kind"].isin("split_from", "adopted")) | ((F.size(texts) > 1) & ~F.element_at("attempts", 1)["text"].eqNullSafe(F.col("text")))
    return results.where((F.size("flags") > 0) | changed)


def dummy_recogniser(clips: DataFrame) -> DataFrame:
    """A sentence for every three seconds, or the context if it says ECHO."""
    n = F.greatest(F.lit(1), F.floor((F.col("end_ms") - F.col("start_ms")) / 3000)).cast("int")
    plain = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("これは"), i.cast("string"), F.lit("番目の文です。"))), "")
    return clips.select("file_id", "clip_id", F.when(F.contains("context", F.lit("ECHO")), F.col("context")).otherwise(plain).alias("text"), F.lit("Japanese").alias("language"), F.lit(None).cast(WORDS).alias("words"))


def dummy_aligner(clips: DataFrame) -> DataFrame:
    """file_id, clip_id, tokens: every letter, digit and apostrophe of the text with an equal share of the clip."""
    kept = F.split(F.regexp_replace("text", r"[^\p{L}\p{N}']", ""), "")
    kept = F.filter(kept, lambda c: c != "")
    dur = (F.col("end_ms") - F.col("start_ms")).cast("double")
    shared = lambda cs: F.transform(cs, lambda c, i: F.struct(c.alias("tok"), (dur * i / F.size(cs)).alias("s"), (dur * (i + 1) / F.size(cs)).alias("e")))
    return clips.select("file_id", "clip_id", let(kept, shared).alias("tokens"))


def dummy_turns(files: DataFrame, turn_ms: int = 10_000) -> DataFrame:
    """file_id, pos, start_ms, end_ms, speaker: two speakers in turn, ten seconds each."""
    n = F.ceil(F.col("total_ms") / turn_ms).cast("int")
    each = files.where("total_ms > 0").select("file_id", "total_ms", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return each.select("file_id", F.col("k").cast("bigint").alias("pos"), (F.col("k") * turn_ms).cast("bigint").alias("start_ms"), F.least("total_ms", (F.col("k") + 1) * turn_ms).cast("bigint").alias("end_ms"), F.concat(F.lit("SPEAKER_"), F.lpad((F.col("k") % 2).cast("string"), 2, "0")).alias("speaker"))


__all__ = ["Policy", "Recogniser", "answered", "dummy_aligner", "dummy_recogniser", "dummy_turns", "isolated", "recognised", "review_items", "second_opinion", "with_speech"]

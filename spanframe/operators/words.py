"""Words from clips: the tokens of a text get its punctuation back, and all clips' words become one stream."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.text import core_len
from spanframe.operators.intervals import overlap_join
from spanframe.operators.sequences import approx_array

TOKENS = "array<struct<word:string,core:string,s:double,e:double>>"
ALIGNED = "array<struct<tok:string,s:double,e:double>>"
#: Opening brackets, which belong to the next word.
OPENERS = "「『（(［[｛{〈《【〔“‘«"
#: Characters that may lie between a token and the place from which it is looked for, besides four for each of its own.
SKIP = 400


def kept(c: str) -> bool:
    """Whether an aligner keeps the character: letters, digits, apostrophes."""
    return c == "'" or unicodedata.category(c)[0] in "LN"


def located(text: str, core: str, at: int) -> tuple[int, int] | None:
    """Where a token stands in a text from `at` on; characters that no aligner keeps may lie between its own."""
    limit = min(len(text), at + SKIP + 4 * len(core))
    start = text.find(core[0], at, limit)
    while start >= 0:
        if text.startswith(core, start):
            return start, start + len(core)
        end = start
        for c in core:
            while end < len(text) and text[end] != c and not kept(text[end]):
                end += 1
            if end == len(text) or text[end] != c:
                break
            end += 1
        else:
            return start, end
        start = text.find(core[0], start + 1, limit)
    return None


def restored(text: str, tokens: list[tuple[str, float, float]]) -> list[tuple[str, str, float, float]]:
    """(word, core, start, end) of each token found in the text, in order; the words together are the text.

    What lies between two tokens goes to the former up to an opening bracket, from there to the
    latter. Tokens not found vanish; if none is found they stand as they are.
    """
    return [(w, c, tokens[i][1], max(tokens[i][1:])) for i, w, c in zip(*in_text(text, [t for t, *_ in tokens]))]


def in_text(text: str, tokens: list[str]) -> tuple[list[int], list[str], list[str]]:
    """Which tokens restored() keeps, by number, with their words and themselves."""
    which, starts, ends, end = [], [], [], 0
    for i, token in enumerate(tokens):
        core = token if token.isalnum() else "".join(token.split())
        if not core:
            continue
        # Most stand where the one before ends, or behind a blank.
        if text.startswith(core, end):
            place = end, end + len(core)
        elif text.startswith(" " + core, end) and core[0] != " ":
            place = end + 1, end + 1 + len(core)
        else:
            place = located(text, core, end)
        if place is not None:
            which.append(i)
            starts.append(place[0])
            ends.append(end := place[1])
    if not which:
        which = [i for i, t in enumerate(tokens) if t.strip()]
        whole = [tokens[i] for i in which]
        return which, whole, whole
    # Where each word begins: the text's start, or an opening bracket before the token, or the token.
    begins = [0]
    for end, start in zip(ends, starts[1:]):
        if start - end > 1 or text[end:start] in OPENERS:
            start = next((i for i in range(end, start) if text[i] in OPENERS), start)
        begins.append(start)
    return which, [text[b:to] for b, to in zip(begins, [*begins[1:], len(text)])], [tokens[i] for i in which]


#: Of a clip: whether its words came from the spare tokens, how many last over 4 s, and of the words that it answers for, in order of their times, the number, the text and all of them, packed().
SHOWN = "rescued boolean, long_words bigint, n bigint, said string, packed binary"
CODEC = "zstd"


def packed(words: list[str], cores: list[str], s: np.ndarray, e: np.ndarray) -> bytes:
    """The words of a clip in about a quarter of the room that arrays of them take in a shuffle: the size in bytes, then lengths, times as differences, and texts, compressed."""
    texts = [("".join(x)).encode() for x in (words, cores)]
    numbers = [len(words), *map(len, words), *map(len, cores)]
    raw = np.concatenate([np.array(numbers, np.int64), np.diff(s, prepend=0), e - s]).astype("<i8").tobytes() + b"".join(texts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, CODEC, asbytes=True)


def unpacked(data: bytes) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), CODEC, asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    numbers = np.frombuffer(raw, "<i8", 4 * n, 8).reshape(4, n)
    cuts, text = np.concatenate([[0], np.cumsum(numbers[:2])]).tolist(), raw[8 + 32 * n :].decode()
    pieces = [text[a:b] for a, b in zip(cuts, cuts[1:])]
    s = np.cumsum(numbers[2])
    return pieces[:n], pieces[n:], s, s + numbers[3]


def _unpacked(data: pa.Array) -> pa.Array:
    size, columns = [0], ([], [], [], [])
    for x in data.to_pylist():
        words, cores, s, e = unpacked(x)
        columns[0].extend(words)
        columns[1].extend(cores)
        columns[2].append(s)
        columns[3].append(e)
        size.append(size[-1] + len(words))
    arrays = [*(pa.array(c, pa.string()) for c in columns[:2]), *(pa.array(np.concatenate(c) if c else [], pa.int64()) for c in columns[2:])]
    return pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.StructArray.from_arrays(arrays, ["word", "core", "s", "e"]))


def _shown(text: pa.Array, tokens: pa.Array, spare: pa.Array, low: pa.Array, high: pa.Array, own_start: pa.Array, own_end: pa.Array) -> pa.Array:
    """SHOWN of each clip: restored() words, drawn into [low, high], of which those are kept whose middle is not before own_start and before own_end."""

    def columns(lists: pa.Array):
        flat = [lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(3)]
        cuts = lists.offsets.to_numpy()
        return lambda i: [c[cuts[i] : cuts[i + 1]] for c in flat]

    given, others = columns(tokens), columns(spare)
    bounds = zip(*(c.to_numpy(zero_copy_only=False).astype(float) for c in (low, high, own_start, own_end)))
    rescued, long_words, n, said, whole = [], [], [], [], []
    for i, (t, (lo, hi, first, last)) in enumerate(zip(text.to_pylist(), bounds)):
        toks, s, e = given(i)
        which, ws, cs = in_text(t or "", [x or "" for x in toks.tolist()])
        rescued.append(not which)
        if not which:
            toks, s, e = others(i)
            which, ws, cs = in_text(t or "", [x or "" for x in toks.tolist()])
        s, e = s[which].astype(float), e[which].astype(float)
        e = np.maximum(s, e)
        s = np.fmin(np.fmax(s, lo), hi)
        s, e = np.rint(s).astype(np.int64), np.rint(np.fmin(np.maximum(e, s), hi)).astype(np.int64)
        long_words.append(int((e - s > 4000).sum()))
        middle = (s + e) / 2
        own = np.flatnonzero(~(middle < first) & ~(middle >= last))
        own = own[np.lexsort((e[own], s[own]))]
        if len(own) < len(ws) or (np.diff(own) < 0).any():
            ws, cs = [ws[k] for k in own], [cs[k] for k in own]
        n.append(len(own))
        said.append("".join(ws))
        whole.append(packed(ws, cs, s[own], e[own]))
    columns = [pa.array(rescued, pa.bool_()), pa.array(long_words, pa.int64()), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(whole, pa.binary())]
    return pa.StructArray.from_arrays(columns, [f.split()[0] for f in SHOWN.split(", ")])


def _display(text: pd.Series, tokens: pd.Series) -> pd.Series:
    rows = (restored(t or "", [(x["tok"] or "", x["s"], x["e"]) for x in given]) for t, given in zip(text, tokens))
    return pd.Series([[{"word": w, "core": c, "s": s, "e": e} for w, c, s, e in row] for row in rows], dtype=object)


def restore_display(text: Column, tokens: Column) -> Column:
    """An array of words (word, core, s, e) for the tokens (array of tok, s, e) of a text; see restored()."""
    return F.pandas_udf(_display, TOKENS)(text, F.coalesce(tokens, F.array().cast(ALIGNED)))


def compose_words(results: DataFrame, aligned: DataFrame, speech: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One stream of words from all clips, and the clips with what became of their texts.

    results: file_id, clip_id, start_ms, end_ms, own_start, own_end, text, flags, words (tokens of the
    engine: array of tok, s, e in ms from the clip's start, or null); aligned: file_id, clip_id, tokens (alike); speech:
    file_id, start_ms, end_ms. Aligned tokens come first, then the engine's, then times by share of characters.

    Words: file_id, pos, clip_id, word, core, start_ms, end_ms: those whose middle the clip answers
    for, drawn into it, ordered by times. Clips: results with source (aligner, engine, approx), rescued,
    long_words (over 4 s), kept (letters and digits in words) and trimmed; flags gain `trimmed` where
    less than half of ten or more was kept.

    A clip's words stay together, packed, until they are numbered; only those of clips that overlap in a file
    are put in order together. Results dealt by file_id and clip_id aren't shuffled to meet their tokens.
    """
    clips = results.where(F.coalesce("text", F.lit("")) != "")
    segs = speech.select("file_id", F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    near = overlap_join(clips.select("file_id", "clip_id", "start_ms", "end_ms"), segs).groupBy("file_id", "clip_id").agg(F.array_sort(F.collect_list(F.struct(F.col("b_start").alias("s"), F.col("b_end").alias("e")))).alias("__spans"))
    both = clips.join(aligned.select("file_id", "clip_id", F.col("tokens").alias("__tokens")), ["file_id", "clip_id"], "left").join(near, ["file_id", "clip_id"], "left")
    shown = shown_words(both)
    told = shown.select("file_id", "clip_id", "source", "rescued", "long_words", core_len(F.col("said")).cast("bigint").alias("kept"))
    words = numbered(shown.select("file_id", "clip_id", "start_ms", "end_ms", "n", "packed"))
    n = core_len(F.col("text"))
    trimmed = F.col("source").isNotNull() & (n >= 10) & (F.col("kept") < n * 0.5)
    out = results.join(told, ["file_id", "clip_id"], "left").withColumn("trimmed", F.coalesce(trimmed, F.lit(False)))
    return words, out.withColumn("flags", F.when(F.col("trimmed"), F.array_union("flags", F.array(F.lit("trimmed")))).otherwise(F.col("flags")))


def shown_words(both: DataFrame) -> DataFrame:
    """file_id, clip_id, start_ms, end_ms, source, and SHOWN of each clip with its __tokens and __spans."""
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    shifted = lambda c: F.transform(c, lambda x: F.struct(x["tok"].alias("tok"), (x["s"] + F.col("start_ms")).cast("double").alias("s"), (x["e"] + F.col("start_ms")).cast("double").alias("e")))
    none = F.array().cast(ALIGNED)
    given = F.when(has("__tokens"), shifted("__tokens")).when(has("words"), shifted("words")).otherwise(none)
    source = F.when(has("__tokens"), "aligner").when(has("words"), "engine").otherwise("approx")
    both = both.withColumns({"__given": given, "source": source})
    # Where a token has a letter or digit there will be words, so that no times by share are needed.
    sure = F.exists("__given", lambda x: F.coalesce(x["tok"].rlike(r"[\p{L}\p{N}]"), F.lit(False)))
    spans = F.coalesce("__spans", F.array().cast("array<struct<s:bigint,e:bigint>>"))
    approx = approx_array(F.when(~sure, F.col("text")), F.col("start_ms"), F.col("end_ms"), spans)
    both = both.withColumn("__approx", F.transform(approx, lambda x: F.struct(x["word"].alias("tok"), x["start_ms"].cast("double").alias("s"), x["end_ms"].cast("double").alias("e"))))
    by_share = F.col("source") == "approx"
    shown = F.arrow_udf(_shown, SHOWN)(F.col("text"), F.when(by_share, F.col("__approx")).otherwise(F.col("__given")), F.when(by_share, none).otherwise(F.col("__approx")), *[F.col(c).cast("double") for c in ("start_ms", "end_ms", "own_start", "own_end")])
    return both.select("file_id", "clip_id", "start_ms", "end_ms", "source", shown.alias("__d")).select("file_id", "clip_id", "start_ms", "end_ms", "source", "__d.*")


def numbered(shown: DataFrame) -> DataFrame:
    """file_id, pos, clip_id, word, core, start_ms, end_ms: the words of shown_words() as rows, numbered by times, clip and place in it."""
    edge = lambda at: F.struct(at("start_ms", "end_ms").alias("at"), F.col("clip_id"))
    file, group = Window.partitionBy("file_id"), Window.partitionBy("file_id", "__group")
    order = file.orderBy(edge(F.least))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(edge(F.least) > F.max(edge(F.greatest)).over(before), F.lit(True))
    placed = shown.withColumns({"__new": new.cast("int"), "__before": F.coalesce(F.sum("n").over(before), F.lit(0))})
    placed = placed.withColumn("__group", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumns({"__first": F.min("__before").over(group), "__clips": F.count(F.lit(1)).over(group)})
    each = placed.select("file_id", "clip_id", "__first", "__clips", F.posexplode(F.arrow_udf(_unpacked, "array<struct<word:string,core:string,s:bigint,e:bigint>>")("packed")).alias("__i", "w"))
    each = each.select("file_id", "clip_id", "__first", "__clips", "__i", "w.word", "w.core", F.col("w.s").alias("start_ms"), F.col("w.e").alias("end_ms"))
    # A clip's words are in order; those of clips that overlap are mixed.
    mixed = each.where("__clips > 1").withColumn("__i", F.row_number().over(Window.partitionBy("file_id", "__first").orderBy("start_ms", "end_ms", "clip_id", "__i")) - 1)
    return each.where("__clips = 1").unionByName(mixed).select("file_id", (F.col("__first") + F.col("__i") + 1).cast("bigint").alias("pos"), "clip_id", "word", "core", "start_ms", "end_ms")


def word_stats(clips: DataFrame) -> DataFrame:
    """Per file: how many clips each source of times gave, rescued, long_words, trimmed_much, flagged, retried (with several attempts) and coverage (letters and digits kept over those of the texts; 1 without any)."""
    n = F.sum(core_len(F.coalesce("text", F.lit(""))))
    retried = F.count_if(F.size("attempts") > 1) if "attempts" in clips.columns else F.lit(0).cast("bigint")
    return clips.groupBy("file_id").agg(
        *[F.count_if(F.col("source") == s).alias(s) for s in ("aligner", "engine", "approx")], F.count_if("rescued").alias("rescued"), F.coalesce(F.sum("long_words"), F.lit(0)).alias("long_words"),
        F.count_if("trimmed").alias("trimmed_much"), F.count_if(F.size("flags") > 0).alias("flagged"), retried.alias("retried"),
        F.when(n > 0, F.coalesce(F.sum("kept"), F.lit(0)) / n).otherwise(1.0).alias("coverage"),
    )

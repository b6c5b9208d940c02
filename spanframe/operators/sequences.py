"""Operators on ordered token streams: votes, sentences, paragraphs, cues, names."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanframe.functions.rewrite import PLAIN, Clean
from spanframe.operators.intervals import islands

#: What ends a sentence (a period needs a blank after it, or the end), and what ends a clause.
ENDS_JA = r"(?U)[。！？!?…‥]+[」』）)\]】〕”’\"']*\s*$"
ENDS_LATIN, ENDS_LAST = r"(?U)[.．][」』）)\]】〕”’\"']*\s+$", r"(?U)[.．][」』）)\]】〕”’\"']*\s*$"
ENDS_CLAUSE = r"(?U)[、，,;；:：][」』）)\]】〕”’\"']*\s*$"
#: Fixed value: a word with the punctuation and blanks after it.
TOKEN = r"[^、。！？!?,.，．\s\x{3000}]+[、。！？!?,.，．]*[\s\x{3000}]*"


def ends_sentence(word: Column, last: Column) -> Column:
    return word.rlike(ENDS_JA) | word.rlike(ENDS_LATIN) | (last & word.rlike(ENDS_LAST))


def majority(df: DataFrame, by: list[str], label: str, weight, pos, least_share: float = 0.6) -> DataFrame:
    """The label with the largest weight in each group (ties: first seen), null if its share is too small."""
    each = df.groupBy(*by, label).agg(F.sum(weight).alias("w"), F.min(pos).alias("first"))
    top = each.groupBy(*by).agg(F.max_by(F.struct(label, "w"), F.struct("w", -F.col("first"))).alias("t"), F.sum("w").alias("all"))
    return top.select(*by, F.when(F.col("t.w") >= least_share * F.col("all"), F.col(f"t.{label}")).alias(label), F.col("t.w").alias("weight"), F.col("all").alias("total"))


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows (file_id, pos) with a running number of their groups, which lie one after the other in pos."""
    w = Window.partitionBy("file_id").orderBy("pos")
    same = F.lit(True)
    for c in by:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    return islands(rows.withColumn("__b", F.lag("pos").over(w).isNull() | ~same), ["file_id"], ["pos"], F.col("__b"), name).drop("__b")


def pieces(rows: Column, size, most: int, after: bool, glue=None) -> Column:
    """The piece (from 0) of each element of an array, filled greedily up to `most`.

    after: a piece ends with the element that fills it; else it ends before the one that would
    overfill it, and each element but a piece's first adds its glue to the piece's size.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("piece"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        n = size(x).cast("bigint")
        if after:
            full = s["n"] + n >= most
            return F.struct(F.when(full, F.lit(0).cast("bigint")).otherwise(s["n"] + n).alias("n"), (s["piece"] + full.cast("int")).alias("piece"), F.concat(s["out"], F.array(s["piece"])).alias("out"))
        fits = s["n"] + n <= most
        piece = s["piece"] + (~fits).cast("int")
        return F.struct(F.when(fits, s["n"] + glue(x).cast("bigint") + n).otherwise(n).alias("n"), piece.alias("piece"), F.concat(s["out"], F.array(piece)).alias("out"))

    return F.aggregate(rows, start, step, lambda s: s["out"])


def cut_groups(rows: DataFrame, group: str, total: Column, most: int, piece) -> DataFrame:
    """Rows (file_id, pos, group, ...) with __piece: that of piece(array of their structs in order) where a group's total reaches `most`, else 0."""
    w = Window.partitionBy("file_id", group)
    marked = rows.withColumn("__total", F.sum(total).over(w))
    short = marked.where(F.col("__total") < most).drop("__total").withColumn("__piece", F.lit(0))
    long_ = marked.where(F.col("__total") >= most).groupBy("file_id", group).agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in rows.columns if c not in ("file_id", "pos", group)]))).alias("rows"))
    long_ = long_.select("file_id", group, F.explode(F.arrays_zip("rows", piece(F.col("rows")).alias("piece"))).alias("z"))
    names = [F.col(c) if c in ("file_id", group) else F.col(f"z.rows.{c}").alias(c) for c in rows.columns]
    return short.unionByName(long_.select(*names, F.col("z.piece").alias("__piece")))


def sentence_ids(words: DataFrame, pause_ms: int = 1500, most_chars: int | None = 150, on_speaker: bool = True) -> DataFrame:
    """words with sent_id: breaks before a pause or change of speaker, after a sentence's end or most_chars characters.

    Pauses, speakers and ends cut a file without regard to what came before; only sentences that reach
    most_chars are folded, each for itself.
    """
    w = Window.partitionBy("file_id").orderBy("pos")
    last = F.lead("pos").over(w).isNull()
    marked = words.withColumn("__end", ends_sentence(F.col("word"), last)).withColumn("__prev", F.lag("__end").over(w))
    new = F.col("__prev").isNull() | F.col("__prev") | (F.col("start_ms") - F.lag("end_ms").over(w) > pause_ms)
    if on_speaker:
        new = new | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))
    marked = islands(marked.withColumn("__b", new), ["file_id"], ["pos"], F.col("__b"), "sent_id").drop("__b", "__end", "__prev")
    if most_chars is None:
        return marked
    cut = cut_groups(marked, "sent_id", F.length("word"), most_chars, lambda rows: pieces(rows, lambda x: F.length(x["word"]), most_chars, True))
    return numbered(cut.withColumnRenamed("sent_id", "__sent"), ["__sent", "__piece"], "sent_id").drop("__sent", "__piece")


def sentences(with_ids: DataFrame, clean: Clean = PLAIN) -> DataFrame:
    """file_id, sent_id, start_ms, end_ms, speaker (of the first word), n_words, text (cleaned); empty texts go."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "word")))
    out = with_ids.groupBy("file_id", "sent_id").agg(F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"), F.min_by("speaker", "pos").alias("speaker"), F.count(F.lit(1)).alias("n_words"), F.array_join(F.transform(rows, lambda x: x["word"]), "").alias("text"))
    return out.withColumn("text", clean(F.col("text"))).where("text <> ''")


def paragraphs(sents: DataFrame, gap_ms: int = 3000, most_chars: int = 400) -> DataFrame:
    """Sentences of one speaker joined while the gap and the length allow; a space between, but not after 。！？!?」』 or beyond ASCII.

    The length is that of both texts without the space.
    """
    rows = sents.withColumnRenamed("sent_id", "pos").select("file_id", "pos", "start_ms", "end_ms", "speaker", "text")
    w = Window.partitionBy("file_id").orderBy("pos")
    before = F.lag(F.struct("end_ms", "speaker", "text")).over(w)
    rows = rows.withColumn("__before", before)
    new = F.col("__before").isNull() | ~F.col("__before.speaker").eqNullSafe(F.col("speaker")) | (F.col("start_ms") - F.col("__before.end_ms") > gap_ms)
    tight = F.col("__before.text").rlike(r"(?:[。！？!?」』]|[^\x00-\x7F])$")
    rows = rows.withColumns({"glue": F.when(new | tight, "").otherwise(" "), "__b": new}).drop("__before")
    rows = islands(rows, ["file_id"], ["pos"], F.col("__b"), "__run").drop("__b")
    # A run may reach the limit by its spaces too.
    cut = cut_groups(rows, "__run", F.length("text") + 1, most_chars, lambda xs: pieces(xs, lambda x: F.length(x["text"]), most_chars, False, lambda x: F.length(x["glue"])))
    cut = numbered(cut, ["__run", "__piece"], "par_id")
    texts = F.array_sort(F.collect_list(F.struct("pos", "glue", "text")))
    each = cut.groupBy("file_id", "par_id").agg(F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"), F.min_by("speaker", "pos").alias("speaker"), texts.alias("rows"))
    text = F.array_join(F.transform("rows", lambda x, i: F.concat(F.when(i == 0, "").otherwise(x["glue"]), x["text"])), "")
    return each.select("file_id", (F.col("par_id") - 1).cast("bigint").alias("par_id"), "start_ms", "end_ms", "speaker", text.alias("text"))


def cue_times(cues: DataFrame, order: str = "sent_id", pad_ms: int = 200, least_ms: int = 600) -> DataFrame:
    """Ends padded to a least length, but before the next start, and 50 ms at least."""
    w = Window.partitionBy("file_id").orderBy(order)
    end = F.greatest(F.col("end_ms") + pad_ms, F.col("start_ms") + least_ms)
    end = F.least(end, F.coalesce(F.lead("start_ms").over(w) - 1, end))
    return cues.withColumn("end_ms", F.greatest(end, F.col("start_ms") + 50))


def speaker_names(words: DataFrame, style: str = "話者A", mapping: str = "") -> DataFrame:
    """file_id, speaker, name by first appearance.

    style 話者A: letters, numbers after 26; S1: numbers; SPEAKER_00: the speaker itself. mapping renames:
    a=b, c=d where a is a speaker or a name so far, one after the other, or names in the order of appearance.
    """
    first = words.where("speaker IS NOT NULL").groupBy("file_id", "speaker").agg(F.min("pos").alias("first"))
    n = F.row_number().over(Window.partitionBy("file_id").orderBy("first"))
    plain = {
        "話者A": F.concat(F.lit("話者"), F.when(F.col("n") <= 26, F.expr("chr(64 + n)")).otherwise(F.col("n").cast("string"))),
        "S1": F.concat(F.lit("S"), F.col("n").cast("string")), "SPEAKER_00": F.col("speaker"),
    }
    named = first.withColumn("n", n).withColumn("name", plain[style])
    items = [x.strip() for x in re.split(r"[,、，\n]+", mapping) if x.strip()]
    if items and all("=" in x or "＝" in x for x in items):
        for x in items:
            old, new = (y.strip() for y in re.split("[=＝]", x, maxsplit=1))
            named = named.withColumn("name", F.when((F.col("speaker") == old) | (F.col("name") == old), new).otherwise(F.col("name")))
    elif items:
        named = named.withColumn("name", F.coalesce(F.get(F.array(*map(F.lit, items)), F.col("n") - 1), F.col("name")))
    return named.select("file_id", "speaker", "name")


def labelled(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with the speaker's name for the speaker; without a name it stays, null becomes empty.

    The names of a file are met by the file alone, so that rows which lie by file stay where they are.
    """
    known = names_by_file(names).select(F.col("file_id").alias("__f"), F.col("speakers").alias("__names"))
    out = rows.join(known, F.col("file_id") == F.col("__f"), "left")
    return out.withColumn("speaker", F.coalesce(F.try_element_at("__names", F.col("speaker")), "speaker", F.lit(""))).select(*rows.columns)


def names_by_file(names: DataFrame) -> DataFrame:
    """file_id, speakers: the names of a file's speakers as a map, speakers in order."""
    return names.groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", "name")))).alias("speakers"))


def fill(rows: DataFrame, by: list[str], order: list[str], column: str, back: bool = True) -> DataFrame:
    """Nulls of a column take the last value before them, then (back) the next one after them."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn(column, F.coalesce(column, F.last(column, True).over(w)))
    if back:
        # As a running frame of the reversed order: a frame up to the end is computed anew for each row.
        w = Window.partitionBy(*by).orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(column, F.coalesce(column, F.last(column, True).over(w)))
    return out


def absorb_interruptions(words: DataFrame, most_words: int = 2, under_ms: int = 800) -> DataFrame:
    """words in which a short run between two runs of one other speaker takes that speaker.

    An absorbed run ends the chance of the next one, whose neighbours then differ; so in a stretch of
    candidates the first, third and so on are absorbed, and no row-by-row pass is needed.
    """
    w = Window.partitionBy("file_id").orderBy("pos")
    before = F.lag(F.struct("speaker")).over(w)
    marked = words.withColumn("__b", before.isNull() | ~before["speaker"].eqNullSafe(F.col("speaker")))
    marked = islands(marked, ["file_id"], ["pos"], F.col("__b"), "__run").drop("__b")
    runs = marked.groupBy("file_id", "__run").agg(F.count(F.lit(1)).alias("n"), F.min_by("start_ms", "pos").alias("s"), F.max_by("end_ms", "pos").alias("e"), F.min_by(F.struct("speaker"), "pos").alias("own"))
    o = Window.partitionBy("file_id").orderBy("__run")
    runs = runs.withColumns({"left": F.lag("own").over(o), "right": F.lead("own").over(o)})
    short = (F.col("n") <= most_words) & (F.col("e") - F.col("s") < under_ms)
    runs = runs.withColumn("may", F.coalesce(short & F.col("left").isNotNull() & F.col("right").isNotNull() & F.col("left.speaker").eqNullSafe(F.col("right.speaker")), F.lit(False)))
    runs = islands(runs, ["file_id"], ["__run"], ~F.col("may"), "stretch")
    place = F.row_number().over(Window.partitionBy("file_id", "stretch").orderBy("__run"))
    # The first of a stretch is the run before its candidates.
    taken = runs.withColumn("place", place).where(F.col("may") & (F.col("place") % 2 == 0)).select("file_id", "__run", F.col("left").alias("__new"))
    out = marked.join(taken, ["file_id", "__run"], "left")
    return out.withColumn("speaker", F.when(F.col("__new").isNotNull(), F.col("__new.speaker")).otherwise(F.col("speaker"))).select(*words.columns)


def smooth_speakers(words: DataFrame, least_share: float = 0.6, pause_ms: int = 1000, most_chars: int | None = 150) -> DataFrame:
    """words with the speaker most of their sentence is spoken by, short interruptions absorbed, and whether it changed."""
    ids = sentence_ids(words.withColumn("__old", F.col("speaker")), pause_ms, most_chars, on_speaker=False)
    vote = majority(ids, ["file_id", "sent_id"], "speaker", F.greatest(F.lit(20), F.col("end_ms") - F.col("start_ms")), "pos", least_share)
    voted = ids.join(vote.select("file_id", "sent_id", F.col("speaker").alias("__vote")), ["file_id", "sent_id"]).withColumn("speaker", F.coalesce("__vote", "speaker")).drop("__vote", "sent_id")
    return absorb_interruptions(voted).select(*words.columns, (~F.col("speaker").eqNullSafe(F.col("__old"))).alias("changed"))


def rest_lengths(words: DataFrame, gap_ms: int = 800) -> DataFrame:
    """words with rest: the characters that follow up to the end of the sentence or the next gap."""
    w = Window.partitionBy("file_id").orderBy("pos")
    following = F.lead("start_ms").over(w)
    last = F.lead("pos").over(w).isNull()
    ended = words.withColumn("__end", last | ends_sentence(F.col("word"), last) | (following - F.col("end_ms") >= gap_ms))
    back = Window.partitionBy("file_id").orderBy(F.desc("pos"))
    ended = ended.withColumn("__s", F.sum(F.col("__end").cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("file_id", "__s").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    return ended.withColumn("rest", F.coalesce(F.sum(F.length("word")).over(own), F.lit(0)).cast("bigint")).drop("__end", "__s")


#: Elements whose sums are added one by one; sums of so many are kept.
_STEP = 32


def running(weights: Column) -> Column:
    """The running sums of an array, without an array being built element by element."""

    def made(ws):
        total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)
        blocks = F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / _STEP).cast("int"))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("out"))
        firsts = F.aggregate(blocks, start, lambda a, k: F.struct((a["n"] + total(F.slice(ws, k * _STEP + 1, _STEP))).alias("n"), F.concat(a["out"], F.array(a["n"])).alias("out")), lambda a: a["out"])
        each = lambda heads: F.transform(ws, lambda x, i: F.get(heads, F.floor(i / _STEP).cast("int")) + total(F.slice(ws, F.floor(i / _STEP).cast("int") * _STEP + 1, i % _STEP + 1)))
        return F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).otherwise(let(firsts, each))

    return let(weights, made)


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _times(weights: pa.Array, start: pa.Array, end: pa.Array, spans: pa.Array) -> pa.Array:
    """For each clip the times at which its words begin, and the end of the last one: an array one longer than the weights."""
    out, offsets = [], [0]
    of = weights.values.to_numpy(zero_copy_only=False)
    ends = weights.offsets.to_numpy()
    lows, highs = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    cuts = spans.offsets.to_numpy()
    present = ~np.asarray(spans.is_null()) if spans.null_count else np.ones(len(spans), bool)
    for i, (s, e) in enumerate(zip(start.to_numpy(zero_copy_only=False), end.to_numpy(zero_copy_only=False))):
        w = of[ends[i] : ends[i + 1]]
        if len(w):
            inside = [(max(a, s), min(b, e)) for a, b in zip(lows[cuts[i] : cuts[i + 1]], highs[cuts[i] : cuts[i + 1]]) if min(b, e) > max(a, s)] if present[i] else []
            inside = inside or [(s, e)]
            left = np.concatenate([[0], np.cumsum(w)]) / w.sum() * sum(b - a for a, b in inside)
            at = np.full(len(left), inside[-1][1])
            todo = np.ones(len(left), bool)
            for a, b in inside:
                here = todo & (left <= b - a)
                at[here] = a + left[here]
                todo &= ~here
                left = left - (b - a)
            out.append(np.floor(at + 0.5).astype(np.int64))
        offsets.append(offsets[-1] + (len(w) + 1 if len(w) else 0))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(out) if out else [], pa.int64()))


#: Code points that are cut into words at a time.
CUT_AT_ONCE = 1 << 20


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: what it is to TOKEN (0 of a word, 1 punctuation, 2 blank), and whether it weighs (letters, digits, apostrophe)."""
    kind = np.zeros(0x110000, np.uint8)
    kind[[ord(c) for c in "、。！？!?,.，．"]] = 1
    kind[[ord(c) for c in " \t\n\v\f\r\u3000"]] = 2
    weighs = np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)])
    weighs[ord("'")] = True
    return kind, weighs


def _cut(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of texts (as TOKEN finds them) in a row, what each weighs, and the number of words of each text: a word's letters are followed by its punctuation, then by its blanks, if there are any."""
    kind, weighs = _kinds()
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    whole = "\0".join([*texts, ""])
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = kind[codes]
    kinds[np.cumsum(sizes) - 1] = 3  # between texts
    runs = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]])) if len(kinds) else np.zeros(0, np.int64)
    of = np.concatenate([kinds[runs], [3, 3, 3]])
    upto = np.concatenate([runs[1:], [len(kinds)] * 3])
    word = np.flatnonzero(of == 0)
    last = word + (of[word + 1] == 1)
    last += of[last + 1] == 2
    starts, ends = runs[word], upto[last]
    heavy = np.concatenate([[0], np.cumsum(weighs[codes])])
    weights = np.maximum(1, heavy[ends] - heavy[starts])
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
    return [whole[x:y] for x, y in zip(starts.tolist(), ends.tolist())], weights, counts


def _approx(text: pa.Array, start: pa.Array, end: pa.Array, spans: pa.Array) -> Iterator[pa.Array]:
    """For some clips after the other, a list of structs word, start_ms, end_ms of each."""
    texts = [(t or b"").decode("utf-8", "replace") for t in text.cast(pa.binary()).to_pylist()]
    part = np.cumsum([len(t) for t in texts]) // CUT_AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:]):
        words, weights, counts = _cut(texts[a:b])
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        times = _times(pa.ListArray.from_arrays(offsets, pa.array(weights, pa.int64())), start[a:b], end[a:b], spans[a:b])
        at, stands = times.values.to_numpy(), times.offsets.to_numpy()
        some = np.diff(stands) > 0
        begins, finishes = (np.delete(at, x) for x in (stands[1:][some] - 1, stands[:-1][some]))
        fields = [pa.array(words, pa.string()), pa.array(begins, pa.int64()), pa.array(finishes, pa.int64())]
        yield pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["word", "start_ms", "end_ms"]))


def _bounds(start_ms: Column, end_ms: Column, spans: Column) -> tuple[Column, Column, Column]:
    return start_ms.cast("double"), end_ms.cast("double"), F.transform(spans, lambda x: F.struct(x["s"].cast("double").alias("s"), x["e"].cast("double").alias("e")))


def approx_array(text: Column, start_ms: Column, end_ms: Column, spans: Column) -> Column:
    """Words of a text with times by their share of its characters, along the spans (array of struct s, e) within start and end; none: all of it.

    An array of structs word, start_ms, end_ms, in whole milliseconds.
    """

    def each(text: pa.Array, start: pa.Array, end: pa.Array, spans: pa.Array) -> pa.Array:
        made = list(_approx(text, start, end, spans))
        return pa.concat_arrays(made)

    return F.arrow_udf(each, "array<struct<word:string,start_ms:bigint,end_ms:bigint>>")(text, *_bounds(start_ms, end_ms, spans))


def approx_tokens(clips: DataFrame, key: str = "clip_id") -> DataFrame:
    """Words of each clip's text (start_ms, end_ms, spans) as rows: key, i, word, start_ms, end_ms; see approx_array. Nothing is shuffled."""
    start, end, spans = _bounds(F.col("start_ms"), F.col("end_ms"), F.col("spans"))
    rows = clips.select(F.col(key), F.col("text").cast("string").alias("__text"), start.alias("__start"), end.alias("__end"), spans.alias("__spans"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for made in _approx(*(batch.column(k) for k in range(1, 5))):
                n, words = np.diff(made.offsets.to_numpy()), made.values
                keys = batch.column(0).slice(at, len(n)).take(pa.array(np.repeat(np.arange(len(n)), n)))
                i = np.arange(len(words)) - np.repeat(made.offsets.to_numpy()[:-1], n)
                yield pa.record_batch([keys, pa.array(i, pa.int64()), *(words.field(k) for k in range(3))], [key, "i", "word", "start_ms", "end_ms"])
                at += len(n)

    return rows.mapInArrow(each, StructType([rows.schema[0], *StructType.fromDDL("i long, word string, start_ms long, end_ms long").fields]))

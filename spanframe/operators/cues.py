"""Cues for subtitles: short runs of words, broken where a reader would pause."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.rewrite import PLAIN, Clean
from spanframe.operators.intervals import islands
from spanframe.operators.sequences import ENDS_CLAUSE, ENDS_LAST, cue_times, ends_sentence, rest_lengths


#: Words of a file that one task takes at once.
TOGETHER = 20_000
#: What a cue is sent as when it is full.
CUE = ["file_id", "pos", "start_ms", "end_ms", "speaker", "text"]


@dataclass(frozen=True)
class CueRules:
    most_chars: int = 30
    most_ms: int = 6000
    gap_ms: int = 800
    least_ms: int = 600
    tail_ms: int = 200
    #: Characters a cue must have before the end of a sentence ends it.
    least_sentence: int = 12


class Cue:
    """The words of the cue being filled: text, start, end, and whether each could be its last."""

    def __init__(self, rules: CueRules):
        self.rules, self.words = rules, []

    def size(self) -> int:
        return len("".join(w[0] for w in self.words).strip())

    def overfull(self, word: str, end: int) -> bool:
        return bool(self.words) and (end - self.words[0][1] > self.rules.most_ms or self.size() + len(word.strip()) > self.rules.most_chars)

    def give(self) -> int:
        """How many words go out when the cue is full: up to its last good break in the latter two thirds, else all.

        The last word counts as followed by nothing, so a bare period there is a break too.
        """
        last = len(self.words) - 1
        for i in range(last, len(self.words) // 3 - 1, -1):
            _, _, ends, lone, clause = self.words[i]
            if ends or clause or (i == last and lone):
                return i + 1
        return last + 1


def cue_numbers(rows: pd.DataFrame, cue: Cue, at: int) -> tuple[list[int], int]:
    """The cue number of each word that is settled, following cue and at, and the next number."""
    out: list[int] = []
    rules = cue.rules

    def leave(n: int) -> None:
        nonlocal at
        out.extend([at] * n)
        at += 1
        del cue.words[:n]

    for word, start, end, ends, lone, clause, rest in zip(rows["word"], rows["start_ms"], rows["end_ms"], rows["ends"], rows["lone"], rows["clause"], rows["rest"]):
        if cue.overfull(word, end):
            leave(cue.give())
            if cue.overfull(word, end):
                leave(len(cue.words))
        cue.words.append((word, start, ends, lone, clause))
        n = cue.size()
        if (ends and n >= rules.least_sentence) or (clause and n + rest > rules.most_chars and n >= max(4, int(rules.most_chars * 0.35))):
            leave(len(cue.words))
    return out, at


def cue_rows(words: pd.DataFrame, numbers: list[int]) -> pd.DataFrame:
    """file_id, pos, start_ms, end_ms, speaker, text of whole cues, of which the first words have the numbers."""
    n = np.asarray(numbers)
    first = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
    upto = np.concatenate([first[1:], [len(n)]])
    said = words["word"].tolist()
    ends = words["end_ms"].iloc[upto - 1].array
    return words.iloc[first][["file_id", "pos", "start_ms", "speaker"]].assign(end_ms=ends, text=["".join(said[a:b]) for a, b in zip(first, upto)])[CUE]


def make_cues(words: DataFrame, clean: Clean = PLAIN, rules: CueRules = CueRules()) -> DataFrame:
    """file_id, cue (from 1), start_ms, end_ms, speaker, text of the cues of a stream of words (file_id, pos, speaker, word, start_ms, end_ms).

    A gap or another speaker always ends a cue, so the stretches between are dealt to tasks and each
    is streamed in order with no more state than the cue that is being filled. Files of TOGETHER words
    at most are cut where their words lie, so that these aren't sent. Empty texts go.
    """
    w = Window.partitionBy("file_id").orderBy("pos")
    last = F.lead("pos").over(w).isNull()
    marked = rest_lengths(words, rules.gap_ms).withColumns({"ends": ends_sentence(F.col("word"), last), "lone": F.col("word").rlike(ENDS_LAST), "clause": F.col("word").rlike(ENDS_CLAUSE)})
    hard = F.lag("pos").over(w).isNull() | (F.col("start_ms") - F.lag("end_ms").over(w) >= rules.gap_ms) | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))
    marked = islands(marked.withColumn("__b", hard), ["file_id"], ["pos"], F.col("__b"), "stretch")
    marked = marked.withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy("file_id")))
    part = lambda some: marked.where(some).select("file_id", "stretch", "pos", "speaker", "word", "start_ms", "end_ms", "ends", "lone", "clause", "rest")
    rows = part(F.col("__all") > TOGETHER).repartition("file_id", "stretch").sortWithinPartitions("file_id", "stretch", "pos")
    kind = words.schema["file_id"].dataType.simpleString()

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, cue, at, held = None, Cue(rules), 0, []
        for batch in batches:
            made = []
            for k, part in batch.groupby(["file_id", "stretch"], sort=False, dropna=False):
                if k != key and held:
                    made.append(cue_rows(pd.concat(held), [at] * sum(map(len, held))))
                    held = []
                if k != key:
                    key, cue, at = k, Cue(rules), 0
                all_ = pd.concat([*held, part]) if held else part
                done, at = cue_numbers(part, cue, at)
                if done:
                    made.append(cue_rows(all_, done))
                held = [all_.iloc[len(done) :]] if len(all_) > len(done) else []
            if made:
                yield pd.concat(made)
        if held:
            yield cue_rows(pd.concat(held), [at] * sum(map(len, held)))

    def whole(file: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(numbered(iter([file.sort_values("pos")])))

    made = f"file_id {kind}, pos long, start_ms long, end_ms long, speaker string, text string"
    each = rows.mapInPandas(numbered, made).unionByName(part(F.col("__all") <= TOGETHER).groupBy("file_id").applyInPandas(whole, made))
    each = each.withColumn("text", clean(F.col("text"))).where("text <> ''").withColumn("cue", F.row_number().over(w).cast("bigint"))
    return cue_times(each.select("file_id", "cue", "start_ms", "end_ms", "speaker", "text"), "cue", rules.tail_ms, rules.least_ms)

"""Work that is done some clips at a time: which clips go together, and what becomes of a batch that fails."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.operators.retry import WORDS, Recogniser

#: Batches of an aligner: a multiple of a recogniser's.
ALIGNED_TOGETHER = 4


def in_batches(clips: DataFrame, most: int, padded_ms: int | None = None, partitions: int | None = None, duration: Column | None = None) -> DataFrame:
    """clips with batch (a number) and place (from 0) in it: clips of like length go together, the longest first.

    A batch holds at most `most` clips, and at most padded_ms once all are as long as its longest (but one clip
    always). Clips are dealt over tasks by length, so that no task sees all of them and none sorts a whole file.
    """
    dur = duration if duration is not None else F.col("end_ms") - F.col("start_ms")
    ordered = clips.withColumn("__dur", dur.cast("long"))
    n = partitions or clips.sparkSession.sparkContext.defaultParallelism
    keys = [F.desc_nulls_last("__dur"), "file_id", "clip_id"]
    dealt = ordered.repartitionByRange(n, *keys).sortWithinPartitions(*keys)

    def numbered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, held, longest = TaskContext.get().partitionId() << 32, 0, 0
        for part in parts:
            batches, places = [], []
            for d in part["__dur"].fillna(0):
                if held and (held >= most or (padded_ms is not None and (held + 1) * longest > padded_ms)):
                    batch, held = batch + 1, 0
                if not held:
                    longest = d
                batches.append(batch)
                places.append(held)
                held += 1
            yield part.assign(batch=pd.array(batches, "int64"), place=pd.array(places, "int64")).drop(columns="__dur")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clips.schema)
    return dealt.mapInPandas(numbered, f"{schema}, batch long, place long")


def padding(batched: DataFrame) -> DataFrame:
    """batch, clips, used_ms, padded_ms: what a batch's clips last, and what they would if all were as long as the longest."""
    dur = F.col("end_ms") - F.col("start_ms")
    return batched.groupBy("batch").agg(F.count(F.lit(1)).alias("clips"), F.sum(dur).alias("used_ms"), (F.max(dur) * F.count(F.lit(1))).alias("padded_ms"))


def bisected(work: Callable[[list], list], items: list, size: int, out_of_memory: tuple[type[BaseException], ...] = (MemoryError,)) -> Iterator[tuple[Any, Any, str | None]]:
    """Each item with its answer, or with the error that it alone gives; work(list) answers some at a time, as many as it was given.

    Items go `size` at a time. Where memory runs out the batch is tried again in halves, and later ones are no
    larger; where work fails otherwise halves are tried until the item that it fails for stands alone.
    """
    waiting = [list(items)]
    while waiting:
        some = waiting.pop()
        if len(some) > size:
            waiting += [some[size:], some[:size]]
            continue
        if not some:
            continue
        try:
            answers = list(work(some))
            if len(answers) != len(some):
                raise ValueError(f"{len(answers)} answers to {len(some)} items")
        except Exception as e:  # whatever a model raises; an interrupt is no Exception
            if len(some) == 1:
                yield some[0], None, f"{type(e).__name__}: {e}"
                continue
            half = len(some) // 2
            if isinstance(e, out_of_memory):
                size = half
            waiting += [some[half:], some[:half]]
            continue
        yield from ((item, answer, None) for item, answer in zip(some, answers))


def recogniser(work: Callable[[list[dict]], list[dict]], size: int = 8, padded_ms: int | None = None, out_of_memory: tuple[type[BaseException], ...] = (MemoryError,)) -> Recogniser:
    """A recogniser of operators.retry made of a function of a list of clips (file_id, clip_id, start_ms, end_ms, context).

    It gives text, language and words (tok, s, e), null or missing where it has none. Clips come in batches of
    like length; one for which it fails gets its error, and the others their answers.
    """

    def recognise(clips: DataFrame) -> DataFrame:
        kind = clips.schema["file_id"].dataType.simpleString()

        def answered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for part in parts:
                held.append(part)
                rows = pd.concat(held) if len(held) > 1 else part
                done = rows["batch"] != rows["batch"].iloc[-1] if len(rows) else []
                yield from each(rows[done])
                held = [rows[~done]] if len(rows) else []
            for rest in held:
                yield from each(rest)

        def each(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for _, batch in rows.groupby("batch", sort=False):
                items = batch[["file_id", "clip_id", "start_ms", "end_ms", "context"]].to_dict("records")
                out = [{"file_id": i["file_id"], "clip_id": i["clip_id"], "text": (a or {}).get("text"), "language": (a or {}).get("language"), "words": (a or {}).get("words"), "error": e} for i, a, e in bisected(work, items, size, out_of_memory)]
                yield pd.DataFrame(out, columns=["file_id", "clip_id", "text", "language", "words", "error"])

        return in_batches(clips, size, padded_ms).mapInPandas(answered, f"file_id {kind}, clip_id long, text string, language string, words {WORDS}, error string")

    return recognise

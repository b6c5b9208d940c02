"""Speech by a detector of the user's, file by file, and by energy where that fails."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.operators.clips import HOP, or_whole_file
from spanframe.operators.intervals import energy_vad

#: Of the fallback: dB below the loudest, frames of the shortest speech and of the shortest silence (fixed values).
TOP_DB, LEAST_SPEECH, LEAST_SILENCE = 45, 12, 20


def by_energy(levels: DataFrame, top_db: float = TOP_DB, least_speech: int = LEAST_SPEECH, least_silence: int = LEAST_SILENCE) -> DataFrame:
    """file_id, start_ms, end_ms of speech by the levels of frames (file_id, frame, db)."""
    found = energy_vad(levels, ["file_id"], ["frame"], "db", top_db, least_speech, least_silence)
    return found.select("file_id", (F.col("first") * HOP).alias("start_ms"), ((F.col("last") + 1) * HOP).alias("end_ms"))


def detected(levels: DataFrame, detect: Callable[[np.ndarray], list[tuple[float, float]]]) -> DataFrame:
    """file_id, start_ms, end_ms, error: what detect() finds in a file's levels, seconds from and to; a file for which it fails has one row with the error.

    A file's levels, fifty a second, are together in one task.
    """
    kind = levels.schema["file_id"].dataType.simpleString()

    def each(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
        try:
            found = [(key[0], round(a * 1000), round(b * 1000), None) for a, b in detect(frames.sort_values("frame")["db"].to_numpy(np.float32))]
        except Exception as e:  # whatever a detector raises
            found = [(key[0], None, None, f"{type(e).__name__}: {e}")]
        return pd.DataFrame(found, columns=["file_id", "start_ms", "end_ms", "error"]).astype({"start_ms": "Int64", "end_ms": "Int64"})

    return levels.select("file_id", "frame", "db").groupBy("file_id").applyInPandas(each, f"file_id {kind}, start_ms long, end_ms long, error string")


def speech(found: DataFrame, levels: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, start_ms, end_ms: what a detector found (as detected() gives it); by energy in files for which it failed; whole files where next to nothing was found."""
    failed = found.where("error IS NOT NULL").select("file_id").distinct()
    good = found.where("error IS NULL").join(failed, "file_id", "left_anti").select("file_id", "start_ms", "end_ms")
    return or_whole_file(good.unionByName(by_energy(levels.join(failed, "file_id", "left_semi"))), files)

"""Language identification by a byte convolutional network.

A text is read as UTF-8 bytes in fixed windows of `WINDOW` bytes; bytes are embedded, filters
of widths 2, 3 and 4 run over them, the largest response of each filter in the window is kept,
and a softmax layer gives the languages. A text's prediction is the mean over all its windows.
The network is trained in numpy on the driver from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm import tokens
from spanframe.llm.common import unit_hash

WINDOW = 256
WIDTHS = (2, 3, 4)
#: Windows computed at once: bounds a worker's memory whatever the length of the texts.
BLOCK = 128
UNKNOWN = "und"


@dataclass
class ByteCnn:
    langs: list[str]
    embed: np.ndarray  # 257 x d; row 256 is padding
    filters: np.ndarray  # (4 * d) x f: filters of all widths, narrower ones zero below their width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def responses(self, codes: np.ndarray) -> np.ndarray:
        """n x positions x filters, before max pooling."""
        n, length = codes.shape
        wide = max(WIDTHS)
        x = self.embed[codes]
        x = np.concatenate([x[:, k : length - wide + 1 + k] for k in range(wide)], axis=2)
        return (x.reshape(-1, x.shape[2]) @ self.filters).reshape(n, length - wide + 1, -1)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.responses(codes).max(axis=1) + self.bias, 0)
        z = pooled @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows(data: bytes) -> np.ndarray:
    """All windows of a text's bytes, the last one padded."""
    n = max(1, -(-len(data) // WINDOW))
    codes = np.full(n * WINDOW, 256, np.int16)
    codes[: len(data)] = np.frombuffer(data, np.uint8)
    return codes.reshape(n, WINDOW)


def train(texts: list[str], langs: list[str], *, dim: int = 8, per_width: int = 16, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 5) -> ByteCnn:
    """Adam on cross-entropy; one window of each text an epoch, chosen at random."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    y_all = np.array([names.index(x) for x in langs])
    data = [windows(t.encode("utf-8", "replace")) for t in texts]
    wide, f = max(WIDTHS), per_width * len(WIDTHS)
    mask = np.zeros((wide * dim, f), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * dim, k * per_width : (k + 1) * per_width] = 1
    p = {
        "embed": rng.normal(0, 0.5, (257, dim)).astype(np.float32), "filters": (rng.normal(0, 0.25, mask.shape) * mask).astype(np.float32),
        "bias": np.zeros(f, np.float32), "out": rng.normal(0, 0.2, (f, len(names))).astype(np.float32), "out_bias": np.zeros(len(names), np.float32),
    }
    p["embed"][256] = 0
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            idx = order[at : at + batch]
            codes = np.stack([data[i][rng.integers(len(data[i]))] for i in idx])
            net = ByteCnn(names, p["embed"], p["filters"], p["bias"], p["out"], p["out_bias"])
            r = net.responses(codes)
            where = r.argmax(axis=1)
            top = np.take_along_axis(r, where[:, None, :], 1)[:, 0] + p["bias"]
            pooled = np.maximum(top, 0)
            z = pooled @ p["out"] + p["out_bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(idx)), y_all[idx]] -= 1
            z /= len(idx)
            back = (z @ p["out"].T) * (top > 0)
            seen = codes[np.arange(len(idx))[:, None, None], where[:, :, None] + np.arange(wide)]
            x = p["embed"][seen].reshape(len(idx), f, wide * dim)
            g = {"out": pooled.T @ z, "out_bias": z.sum(0), "bias": back.sum(0), "filters": np.einsum("nf,nfx->xf", back, x) * mask}
            dx = back[:, :, None] * p["filters"].T[None]
            g["embed"] = np.zeros_like(p["embed"])
            np.add.at(g["embed"], seen.reshape(-1), dx.reshape(-1, dim))
            g["embed"][256] = 0
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return ByteCnn(names, p["embed"], p["filters"], p["bias"], p["out"], p["out_bias"])


def fit(docs: DataFrame, learn: Column | None = None, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 800, most_rows: int = 20_000, chars: int = 2048, seed: int = 29) -> ByteCnn | None:
    """Trains on a sample bounded by per_lang rows for each language and by most_rows rows in all.

    Every language of the labels is learned; where there are many, each has fewer rows. Rows are
    drawn by a hash of the key and text, and `chars` characters from a random place of each are learned from.
    Null labels and null or blank texts aren't learned from; equal rows are drawn alike. None if
    no labelled text is there. More languages than most_rows are no languages: an error.
    """
    has = F.col(lang).isNotNull() & (F.length(F.trim(F.col(text))) > 0)
    rows = docs.where(has if learn is None else has & learn).select(F.col(lang).cast("string").alias("l"), F.col(key).alias("k"), F.col(text).alias("t"))
    by_lang = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    counts = by_lang.limit(most_rows + 1).collect()
    if not counts:
        return None
    if len(counts) > most_rows:
        raise ValueError(f"{lang} has more than {most_rows} values")
    each = max(1, min(per_lang, most_rows // len(counts)))
    u = unit_hash(seed, F.col("k"), F.xxhash64("t"))
    place = F.floor(unit_hash(seed + 1, F.col("k")) * F.greatest(F.length("t") - chars + 1, F.lit(1))).cast("int") + 1
    # Somewhat more than needed, by each language's share; one row at least.
    shares = F.broadcast(docs.sparkSession.createDataFrame([(r.l, min(1.0, (1.1 * each + 10) / r.n)) for r in counts], "l string, share double"))
    picked = rows.withColumn("u", u).join(shares, "l").where("u < share").select("l", "u", F.substring(F.col("t"), place, F.lit(chars)).alias("t"))
    sample = sorted((tuple(r) for r in picked.orderBy("u").limit(2 * (each + 10) * len(counts)).collect()), key=lambda r: (r[0], r[1]))
    taken: dict[str, int] = {}
    texts, langs = [], []
    for l, _, t in sample:
        taken[l] = taken.get(l, 0) + 1
        if taken[l] <= each:
            texts.append(t)
            langs.append(l)
    epochs = max(6, math.ceil(6000 / max(1, len(texts))))
    return train(texts, langs, epochs=min(60, epochs))


def predict(docs: DataFrame, model: ByteCnn | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1).

    A null text, or one without a letter, is `und` with score 0, as is everything if there was
    nothing to learn from. All windows of a text count, however long it is, some at a time. Equal
    texts get equal predictions, ties the first language by name; an empty table gives no rows. Input
    columns named like the added ones are replaced. Bound Arrow batches (common.bounded_batches)
    while it runs, as texts may be long.
    """
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})

    @F.pandas_udf("lang_pred string, score double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import regex

        letter = regex.compile(r"\p{L}")
        for batch in batches:
            total = np.zeros((len(batch), len(model.langs)))
            queue: list[tuple[int, np.ndarray]] = []
            queued = 0

            def flush():
                if queue:
                    codes, owner = np.concatenate([c for _, c in queue]), np.repeat([i for i, _ in queue], [len(c) for _, c in queue])
                    weight = (codes != 256).sum(axis=1)
                    np.add.at(total, owner, model.probabilities(codes) * weight[:, None])
                    queue.clear()

            for i, t in enumerate(batch):
                if t is None or not letter.search(t):
                    continue
                codes = windows(t.encode("utf-8", "replace"))
                for at in range(0, len(codes), BLOCK):
                    queue.append((i, codes[at : at + BLOCK]))
                    queued += len(queue[-1][1])
                    if queued >= BLOCK:
                        flush()
                        queued = 0
            flush()
            mass = total.sum(axis=1)
            best = total.argmax(axis=1)
            score = np.where(mass > 0, total.max(axis=1) / np.maximum(mass, 1e-12), 0.0)
            names = [model.langs[b] if s > 0 else UNKNOWN for b, s in zip(best, mass)]
            yield pd.DataFrame({"lang_pred": names, "score": np.clip(score, 0, 1)})
        tokens.rest()

    return docs.withColumn("__j", judged(F.col(text))).select(*docs.columns, "__j.lang_pred", "__j.score")


def accepted(predicted: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose language is known with a score of `least` or more, without the added columns."""
    return predicted.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).drop("lang_pred", "score")

"""Document quality by hierarchical empirical Bayes over sites and paths.

A logistic classifier on text measures gives each document evidence p. Sites get the posterior
mean of a beta prior whose mean is the corpus mean and whose strength comes from the variance
between sites (method of moments); paths get one around their site's mean likewise, so sparse
sites shrink to the corpus and sparse paths to their site. A document's score adds, on the
log-odds scale, its own evidence and how its path (its own share left out) departs from the mean.
All counts are grouped aggregates; the driver sees three sums of them and the training sample.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import let, unit_hash, words

FEATURES = ("log_words", "word_length", "distinct", "upper", "symbols", "digits", "stops", "top_line")


def measures(text: Column) -> Column:
    """A struct of FEATURES."""
    t = F.coalesce(text, F.lit(""))

    def made(ws):
        n, chars = F.greatest(F.size(ws), F.lit(1)).cast("double"), F.greatest(F.length(t), F.lit(1)).cast("double")
        share = lambda pattern: F.length(F.regexp_replace(t, pattern, "")) / chars
        return F.struct(
            F.log1p(F.size(ws)).alias("log_words"), (F.length(F.array_join(ws, "")) / n).alias("word_length"), (F.size(F.array_distinct(ws)) / n).alias("distinct"),
            share(r"[^\p{Lu}]+").alias("upper"), share(r"[\p{L}\p{N}\s.,]+").alias("symbols"), share(r"[^0-9]+").alias("digits"),
            share(r"[^.,]+").alias("stops"), (F.size(F.array_distinct(F.split(t, "\n"))) / F.size(F.split(t, "\n"))).alias("top_line"),
        )

    return let(words(t), made)


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 4000, seed: int = 37) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (bias first), means and scales, from `most` labelled rows at most, drawn by a hash of the key.

    Null keys and labels aren't learned from; of several rows with a key each counts; without both
    labels the weights are zero, so that all evidence is one half.
    """
    good = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.col(label).cast("double").alias("__y"))
    n = good.count()
    good = good.where(unit_hash(seed, F.col("__k")) < min(1.0, 1.05 * most / max(n, 1))).orderBy(F.xxhash64(F.lit(seed), "__k")).limit(most)
    rows = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(good), "__k").select("__y", measures(F.col("__t")).alias("m")).select("__y", "m.*").limit(2 * most).collect()
    if len({r[0] for r in rows}) < 2:
        return np.zeros(len(FEATURES) + 1), np.zeros(len(FEATURES)), np.ones(len(FEATURES))
    data = np.array(sorted(tuple(r) for r in rows), float)
    y, x = data[:, 0], data[:, 1:]
    mean, scale = x.mean(0), x.std(0) + 1e-9
    x = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton's steps, with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + w)
    return w, mean, scale


def classify(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """docs with p_doc, in (0, 1).

    A null text counts as empty; texts are measured whole; equal texts get equal evidence; an
    empty table gives no rows; an input column named p_doc is replaced.
    """
    w, mean, scale = model
    docs = docs.drop("p_doc")
    z = F.lit(float(w[0]))
    for k, name in enumerate(FEATURES):
        z = z + (F.col(f"__m.{name}") - float(mean[k])) * float(w[k + 1] / scale[k])
    z = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), z))
    return docs.withColumn("__m", measures(F.col(text))).withColumn("p_doc", 1 / (1 + F.exp(-z))).select(*docs.columns, "p_doc")


def strength(n: float, mean: float, between: float) -> float:
    """Of the beta prior with that mean whose draws vary so much; few groups: a middling one."""
    return float(np.clip(mean * (1 - mean) / max(between, 1e-9) - 1, 2, 1000)) if n > 1 and 0 < mean < 1 else 10.0


def site_and_path(url: Column) -> tuple[Column, Column]:
    """Host, in lower case, and path of a URL, for combine; both null where the URL has no host."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return host, F.when(host.isNotNull(), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))


def combine(classified: DataFrame, site: str, path: str) -> DataFrame:
    """classified with site_post, path_post and score.

    Null sites and paths are groups like any other; ties don't arise; equal rows get equal scores;
    an empty table gives no rows; input columns named like the added ones are replaced.
    """
    out = classified.drop("site_post", "path_post", "score")
    paths = classified.groupBy(F.col(site).alias("__s"), F.col(path).alias("__t")).agg(F.count(F.lit(1)).alias("__n"), F.sum("p_doc").alias("__p"))
    sites = paths.groupBy("__s").agg(F.sum("__n").alias("sn"), F.sum("__p").alias("sp"))
    top = sites.agg(F.sum("sn").alias("n"), F.sum("sp").alias("p"), F.count(F.lit(1)).alias("k"), F.var_pop(F.col("sp") / F.col("sn")).alias("v"), F.avg(1 / F.col("sn")).alias("thin")).first()
    if not top["n"]:
        return out.withColumns({"site_post": F.lit(0.5), "path_post": F.lit(0.5), "score": F.col("p_doc")})
    mean = min(max(top["p"] / top["n"], 1e-6), 1 - 1e-6)
    # What sampling alone would spread the means of so small groups by is no spread between them.
    k_site = strength(top["k"], mean, (top["v"] or 0.0) - mean * (1 - mean) * top["thin"])
    sites = sites.withColumn("__site_post", (F.col("sp") + k_site * mean) / (F.col("sn") + k_site))
    placed = paths.join(sites.select(F.col("__s").alias("s2"), "__site_post"), F.col("__s").eqNullSafe(F.col("s2"))).drop("s2")
    within = placed.agg(F.count(F.lit(1)), F.avg(F.pow(F.col("__p") / F.col("__n") - F.col("__site_post"), 2)), F.avg(1 / F.col("__n"))).first()
    k_path = strength(within[0], mean, (within[1] or 0.0) - mean * (1 - mean) * within[2])
    joined = out.join(placed, F.col(site).eqNullSafe(F.col("__s")) & F.col(path).eqNullSafe(F.col("__t")))
    logit = lambda x: F.log(x / (1 - x))
    others = (F.col("__p") - F.col("p_doc") + k_path * F.col("__site_post")) / (F.col("__n") - 1 + k_path)
    others = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), others))
    z = logit(F.col("p_doc")) + logit(others) - float(np.log(mean / (1 - mean)))
    path_post = (F.col("__p") + k_path * F.col("__site_post")) / (F.col("__n") + k_path)
    return joined.select(*out.columns, F.col("__site_post").alias("site_post"), path_post.alias("path_post"), (1 / (1 + F.exp(-z))).alias("score"))


def page_text(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments and tags; null for null."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"<[^<>]*+>", " ")

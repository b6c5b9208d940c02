"""Approximate nearest neighbours by adaptive dimension scan over probed lists.

Index: k-means centres from a bounded sample; every vector goes to its nearest centre's list,
and lists to blocks of some thousand vectors, one row a block, in a table in the shared folder.
Vectors lie there as they are and rotated by one random orthogonal matrix. Equal vectors are
held once, with their smallest ids, so a vector that is very common fills no list.

Search: a query probes the lists nearest to it, in two rounds. The first one goes through an
eighth of them; the distances found there bound what the second one has to look at. Within a
list the rotated vectors are read in column blocks: of all D dimensions, the partial distance over
the first d is, for a random rotation, the Beta(d/2, (D-d)/2) share of the whole, so if it exceeds the
bound's upper quantile, the hypothesis that the whole lies within the bound is rejected and the
candidate abandoned. The bound falls as a list is read, in parts that grow from 64 vectors.
Survivors are ranked by exact distances of the original vectors in double precision.

How many lists a query probes follows from the recall asked for, as measured on the sample: few
where vectors are clustered, most where they have no structure.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanframe.llm.common import unit_hash, written

#: Column blocks' ends as shares of the dimensions, and the chance that a test abandons a true neighbour.
STEPS, ERROR = (0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0), 0.002
#: Vectors (and numbers) in a block, queries in a task, pairs compared at once, vectors in the first part of a list.
VECTORS, NUMBERS, QUERIES, PAIRS, FIRST = 8192, 1 << 19, 512, 1 << 18, 64
#: Smallest ids kept of equal vectors; k is less.
TIES = 64


@dataclass
class Index:
    blocks: DataFrame  # block int, lists binary (int32), n_ids binary (int32), ids binary (int64), v and r binary (float64, float32)
    centres: np.ndarray
    counts: np.ndarray  # distinct vectors of each list
    first: np.ndarray  # first block of each list
    parts: np.ndarray  # blocks of each list
    rotation: np.ndarray
    reach: np.ndarray  # recall within the sample if so many lists less one are probed
    dim: int


def usable(df: DataFrame, key: str, vec: str) -> DataFrame:
    """id and v of the rows that can take part: no null id, no null or empty or zero vector, all parts finite."""
    d = F.col(vec).cast("array<double>")
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(key).cast("long").alias("id"), d.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of arrays of one length as rows."""
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])]
    return np.concatenate([np.zeros(0), *parts]).reshape(-1, dim)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x and c, but for what depends on x alone."""
    return (c * c).sum(1)[None] - 2 * x @ c.T


def nearest(x: np.ndarray, c: np.ndarray, k: int = 1) -> np.ndarray:
    """Indexes of the k nearest rows of c, nearest first; some rows of x at a time."""
    out, step = [np.zeros((0, k), np.int64)], max(1, PAIRS * 4 // len(c))
    for at in range(0, len(x), step):
        d = squares(x[at : at + step], c)
        out.append(np.argsort(d, axis=1, kind="stable")[:, :k] if k > 1 else d.argmin(axis=1)[:, None])
    return np.concatenate(out)


def centres_of(sample: np.ndarray, n: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    c = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(rounds):
        near = nearest(sample, c)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        n_in = np.bincount(near, minlength=len(c))
        c = np.where(n_in[:, None] > 0, total / np.maximum(n_in, 1)[:, None], c)
    return c


def reach_of(sample: np.ndarray, centres: np.ndarray, k: int = 10, queries: int = 256) -> np.ndarray:
    """For each number of lists less one: the share of the sample's k nearest that lie in so many nearest lists."""
    asked = sample[:queries]
    d = squares(asked, sample)
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    home, place = nearest(sample, centres)[:, 0], np.argsort(nearest(asked, centres, len(centres)), axis=1)
    found = np.bincount(np.take_along_axis(place, home[near], 1).ravel(), minlength=len(centres))
    return np.cumsum(found) / max(1, found.sum())


def build(df: DataFrame, key: str = "vec_id", vec: str = "embedding", *, n_lists: int | None = None, sample_numbers: int = 1_300_000, most_lists: int = 4096, seed: int = 31) -> Index | None:
    """Indexes every usable row of the commonest dimension (ties: the smallest); None if there is none.

    Rows whose vector is null, empty, zero, of another dimension, or holds null or non-finite
    numbers take no part, nor do null ids; of equal vectors the TIES smallest ids are held, as no more
    than those can be among the k nearest. Centres and the recall are fitted on a sample of sample_numbers numbers
    (20,000 rows of 64) at most, drawn by a hash of the id; n_lists defaults to the square root of
    the row count, most_lists at most. Extra columns are ignored.
    """
    good = usable(df, key, vec)
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return None
    dim, rows = sizes["d"], sizes["count"]
    good = good.where(F.size("v") == dim)
    sample_rows = max(64, sample_numbers // dim)
    u = unit_hash(seed, F.col("id"))
    sample = matrix(good.where(u < min(1.0, 1.1 * sample_rows / rows)).orderBy(u).limit(sample_rows).select("v").toArrow()["v"], dim)
    if not len(sample):
        sample = matrix(good.limit(1).select("v").toArrow()["v"], dim)
    centres = centres_of(sample, n_lists or min(most_lists, max(1, math.isqrt(rows))), seed)
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["v"], dim)
            ids = b["id"].to_numpy(zero_copy_only=False)
            # Equal vectors of a batch become one row here, so that none is sent very often.
            rows_, back = np.unique(x, axis=0, return_inverse=True)
            order = np.lexsort((ids, back.ravel()))
            at = np.searchsorted(back.ravel()[order], np.arange(len(rows_) + 1))
            kept = [ids[order[s : min(e, s + TIES)]] for s, e in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([
                pa.array(nearest(rows_, centres)[:, 0].astype(np.int32)), pa.array(kept, pa.list_(pa.int64())), pa.array([v.tobytes() for v in rows_], pa.binary()),
            ], ["list", "ids", "v"])

    listed = written(good.mapInArrow(assign, "list int, ids array<long>, v binary"), "listed")
    counts = np.zeros(len(centres), np.int64)
    for r in listed.groupBy("list").count().collect():  # one row a list
        counts[r.list] = r["count"]
    most = max(256, min(VECTORS, NUMBERS // dim, -(-int(counts.sum()) // 64)))
    parts = np.maximum(1, -(-counts // most))
    first, block, room = np.zeros(len(centres), np.int64), -1, 0
    for i in np.argsort(centres @ (centres - centres.mean(0))[np.argmax(((centres - centres.mean(0)) ** 2).sum(1))], kind="stable"):
        if parts[i] > 1 or counts[i] > room:
            block, room = block + 1, most
        first[i] = block
        block, room = block + int(parts[i]) - 1, 0 if parts[i] > 1 else room - int(counts[i])
    spots = F.broadcast(df.sparkSession.createDataFrame([(i, int(a), int(n)) for i, (a, n) in enumerate(zip(first, parts))], "list int, first int, parts int"))
    # Equal vectors meet in one block.
    placed = listed.join(spots, "list").select("list", "ids", "v", (F.col("first") + F.pmod(F.xxhash64("v"), F.col("parts"))).cast("int").alias("block"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["list", "v"], kind="stable")
        lists, raw, out = rows["list"].to_numpy(), rows["v"].to_list(), []
        starts = [i for i in range(len(raw)) if not i or raw[i] != raw[i - 1] or lists[i] != lists[i - 1]]
        for s, e in zip(starts, [*starts[1:], len(raw)]):
            out.append(np.unique(np.concatenate(rows["ids"].iloc[s:e].to_list()))[:TIES])
        v = np.frombuffer(b"".join(raw[s] for s in starts)).reshape(-1, dim)
        cell = [lists[starts].astype(np.int32), np.array([len(x) for x in out], np.int32), np.concatenate(out).astype(np.int64), v, (v @ rotation).astype(np.float32)]
        return pd.DataFrame({"block": rows["block"].iloc[:1].to_numpy(), **{n: [c.tobytes()] for n, c in zip(("lists", "n_ids", "ids", "v", "r"), cell)}})

    blocks = written(placed.groupBy("block").applyInPandas(pack, "block int, lists binary, n_ids binary, ids binary, v binary, r binary"), "blocks")
    return Index(blocks, centres, counts, first, parts, rotation, reach_of(sample, centres), dim)


def probes_for(index: Index, recall: float) -> int:
    """How many lists reach that recall on the sample."""
    return min(len(index.centres), int(np.searchsorted(index.reach, min(recall, index.reach[-1]) - 1e-12)) + 1)


def beta_bound(d: int, dim: int, error: float = ERROR) -> float:
    """The upper quantile of the share of a squared distance that d of dim random directions hold."""
    if d >= dim:
        return 1.0
    x = (np.arange(40_000) + 0.5) / 40_000
    log = (d / 2 - 1) * np.log(x) + ((dim - d) / 2 - 1) * np.log1p(-x)
    mass = np.cumsum(np.exp(log - log.max()))
    return float(x[np.searchsorted(mass, (1 - error) * mass[-1])])


def scan(block: dict[str, np.ndarray], queries: np.ndarray, probed: list[np.ndarray], limits: np.ndarray, rotation: np.ndarray, k: int, seen: Counter | None = None) -> list[tuple[int, int, float]]:
    """The k nearest ids of a block for each query within its limit, by adaptive dimension scan: (query's row, id, distance).

    block: lists, starts (of ids), ids, v, r; probed: the lists of each query; limits: distances. seen counts candidates and the abandoned.
    """
    dim = queries.shape[1]
    ends = sorted({max(1, round(s * dim)) for s in STEPS})
    bounds = [beta_bound(e, dim) for e in ends]
    v, r, ids, starts = block["v"], block["r"], block["ids"], block["starts"]
    least_id = ids[starts[:-1]]
    asked = (queries @ rotation).astype(np.float32)
    limit = limits.astype(float) ** 2
    slack = 1e-5 * ((asked * asked).sum(1) + float((r * r).sum(1).max(initial=0)))
    best_q, best_d, best_v = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    who_probes: dict[int, list[int]] = {}
    for q, ls in enumerate(probed):
        for l in ls.tolist():
            who_probes.setdefault(l, []).append(q)
    for l, who_ in sorted(who_probes.items()):
        lo, hi = np.searchsorted(block["lists"], [l, l + 1])
        at, size = int(lo), FIRST
        while at < hi:
            to = min(int(hi), at + size)
            for w in range(0, len(who_), step := max(1, PAIRS // (to - at))):
                who = np.array(who_[w : w + step])
                x, y = r[at:to, : ends[0]], asked[who, : ends[0]]
                part = (y * y).sum(1)[:, None] + squares(y, x)
                keep = part <= (limit[who] * bounds[0] + slack[who])[:, None]
                qi, xi = np.nonzero(keep)
                part, qi, xi = part[keep].astype(float), who[qi], xi + at
                for s in range(1, len(ends)):
                    diff = r[xi, ends[s - 1] : ends[s]] - asked[qi, ends[s - 1] : ends[s]]
                    part += np.einsum("nd,nd->n", diff, diff)
                    keep = part <= limit[qi] * bounds[s] + slack[qi]
                    part, qi, xi = part[keep], qi[keep], xi[keep]
                if seen is not None:
                    seen["candidates"] += len(who) * (to - at)
                    seen["abandoned"] += len(who) * (to - at) - len(qi)
                if not len(qi):
                    continue
                exact = np.empty(len(qi))
                for c in range(0, len(qi), chunk := max(1, NUMBERS * 2 // dim)):
                    exact[c : c + chunk] = np.sqrt(((v[xi[c : c + chunk]] - queries[qi[c : c + chunk]]) ** 2).sum(axis=1))
                best_q, best_d, best_v = np.concatenate([best_q, qi]), np.concatenate([best_d, exact]), np.concatenate([best_v, xi])
                order = np.lexsort((least_id[best_v], best_d, best_q))
                best_q, best_d, best_v = best_q[order], best_d[order], best_v[order]
                place = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
                full = place == k - 1
                limit[best_q[full]] = np.minimum(limit[best_q[full]], best_d[full] ** 2)
                best_q, best_d, best_v = best_q[place < k], best_d[place < k], best_v[place < k]
            at, size = to, size * 4
    out: list[tuple[int, int, float]] = []
    for q in np.unique(best_q).tolist():
        s, e = np.searchsorted(best_q, [q, q + 1])
        found = sorted((float(d), int(i)) for d, x in zip(best_d[s:e], best_v[s:e]) for i in ids[starts[x] : min(starts[x + 1], starts[x] + k)])
        out += [(q, i, d) for d, i in found[:k]]
    return out


def search(index: Index | None, queries: DataFrame, k: int = 10, recall: float = 0.95, probes: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query (id, v: see usable()), its own id aside.

    A query probes as many of its nearest lists as reach that recall on the sample (or `probes`),
    and as many more as it takes to see 2 * (k + 1) vectors. Distances that tie go by the smaller
    id. Queries of another dimension have no neighbours. Equal queries are answered once and share the answer; equal
    (id, v) rows give one answer. No queries, or no index: no rows.
    """
    spark = queries.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if k >= TIES:
        raise ValueError(f"k must be below {TIES}")
    n_lists, dim, centres, rotation = len(index.centres), index.dim, index.centres, index.rotation
    probes = min(n_lists, probes or probes_for(index, recall))
    counts, first, parts, early = index.counts, index.first, index.parts, max(1, probes // 8)
    asked = queries.where(F.size("v") == dim).select("id", F.transform("v", lambda x: x + 0.0).alias("v")).withColumns({"a": F.xxhash64("v"), "b": F.xxhash64(F.lit(7), "v")})
    ids = asked.select("a", "b", "id").distinct()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["v"], dim)
            order = nearest(x, centres, n_lists).reshape(len(x), -1)
            enough = (np.cumsum(counts[order], axis=1) < 2 * (k + 1)).sum(axis=1) + 1
            of, round_, block, lists = [], [], [], []
            for i, (o, n) in enumerate(zip(order, enough)):
                by: dict[tuple[int, int], list[int]] = {}
                for place, l in enumerate(o[: max(n, probes)].tolist()):
                    if counts[l]:
                        for p in range(int(parts[l])):
                            by.setdefault((int(place >= max(n, early)), int(first[l]) + p), []).append(l)
                for (r_, bl), ls in by.items():
                    of.append(i)
                    round_.append(r_)
                    block.append(bl)
                    lists.append(ls)
            yield pa.RecordBatch.from_arrays([
                b["a"].take(pa.array(of, pa.int64())), b["b"].take(pa.array(of, pa.int64())), pa.array([v.tobytes() for v in x], pa.binary()).take(pa.array(of, pa.int64())),
                pa.array(round_, pa.int32()), pa.array(block, pa.int32()), pa.array(lists, pa.list_(pa.int32())),
            ], ["a", "b", "q", "round", "block", "lists"])

    todo = written(asked.select("a", "b", "v").dropDuplicates(["a", "b"]).mapInArrow(probe, "a long, b long, q binary, round int, block int, lists array<int>"), "probes")

    def find(held: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(held) and len(q):
            row = held.iloc[0]
            n_ids = np.frombuffer(row["n_ids"], np.int32)
            block = {"lists": np.frombuffer(row["lists"], np.int32), "starts": np.concatenate([[0], np.cumsum(n_ids)]), "ids": np.frombuffer(row["ids"], np.int64),
                     "v": np.frombuffer(row["v"]).reshape(-1, dim), "r": np.frombuffer(row["r"], np.float32).reshape(-1, dim)}
            found = scan(block, np.frombuffer(b"".join(q["q"])).reshape(-1, dim), list(q["lists"]), q["limit"].to_numpy(float), rotation, k + 1)
        at = [f[0] for f in found]
        return pd.DataFrame({"a": q["a"].to_numpy()[at], "b": q["b"].to_numpy()[at], "vec_id": np.array([f[1] for f in found], np.int64), "score": np.array([f[2] for f in found], float)})

    def scanned(rows: DataFrame) -> DataFrame:
        tasks = written(rows.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("n")), "tasks")
        dealt = rows.join(tasks, "block").select("block", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("t"), "a", "b", "q", "lists", "limit")
        spread = tasks.select(F.col("block").alias("own"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
        held = index.blocks.join(spread, F.col("block") == F.col("own")).select(F.col("own").alias("block"), F.col("part").alias("t"), "lists", "n_ids", "ids", "v", "r")
        return written(held.groupBy("block", "t").cogroup(dealt.groupBy("block", "t")).applyInPandas(find, "a long, b long, vec_id long, score double"), "found")

    best = Window.partitionBy("a", "b").orderBy("score", "vec_id")
    near = scanned(todo.where("round = 0").withColumn("limit", F.lit(float("inf"))))
    limits = near.withColumn("place", F.row_number().over(best)).where(F.col("place") == k + 1).select("a", "b", F.col("score").alias("limit"))
    rest = todo.where("round = 1").join(limits, ["a", "b"], "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    top = near.unionByName(scanned(rest)).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")
    own = Window.partitionBy("query_id").orderBy("score", "vec_id")
    both = top.join(ids.withColumnRenamed("id", "query_id"), ["a", "b"]).where("vec_id <> query_id")
    return both.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

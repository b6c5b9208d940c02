"""Near-duplicate classes by ProbMinHash over five-word shingles.

A document is the set of its five-word shingles. Each shingle sends the arrivals of a Poisson
process of rate one; each arrival falls on one of 125 places, and a place keeps the shingle of
its first arrival. A document stops drawing once its horizon is past which all places are taken
(early termination). Places of two documents agree with probability equal to their probability
Jaccard similarity, which with equal weights is the Jaccard similarity of the sets: the one
that the exact check measures, however often a line repeats.

25 bands of 5 places send documents to buckets. In a bucket, agreement of the signatures gives
an estimate for every pair, and of those maximum spanning forests are verified first (on all
places and on two halves of them): as many candidate pairs as documents, not as pairs. As an
edge of a forest may fail although the link it stood for holds, every other pair of a bucket
that is not doubtful and whose ends are not yet in one class is verified then, from the sets of
shingles sent to the bucket, so that no row is made for a pair. Buckets of
more than TILE documents are cut into tiles and every two tiles are compared. Candidates are
verified exactly from the texts by the Jaccard similarity of their sets of shingles; links of
0.8 or more give the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm import tokens
from spanframe.llm.common import written
from spanframe.llm.components import components

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 25, 5
PLACES = BANDS * ROWS
#: Pairs estimated below this are not verified: six standard deviations under LEAST.
DOUBTFUL = 0.6
TILE = 2048
#: Documents named by candidates up to which their ids are sent to all executors (16 MB); beyond, they are joined.
MOST_SENT = 2_000_000
#: Parts of a class, where all its rows are told something of it.
SALTS = 256


def shingles(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, shingle (44 bits) and count of all shingles of the texts; fewer than five words are one shingle."""
    lists = tokens.word_lists(texts)
    h, n = tokens.word_hashes(lists)
    first = np.cumsum(n) - n
    docs, prints = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if len(h) >= SHINGLE:
        owner = np.repeat(np.arange(len(n)), n)
        starts = np.flatnonzero(np.arange(len(h)) + SHINGLE <= np.repeat(first + n, n))
        docs.append(owner[starts])
        prints.append(tokens.runs(h, SHINGLE)[starts])
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    docs.append(short)
    prints.append(np.array([tokens.runs(h[first[i] : first[i] + n[i]], int(n[i]))[0] for i in short], np.uint64))
    # Many texts at once: the document in the high bits, the shingle in the low ones.
    keys = np.concatenate(docs).astype(np.uint64) << np.uint64(44) | np.concatenate(prints) >> np.uint64(20)
    keys, count = np.unique(keys, return_counts=True)
    return (keys >> np.uint64(44)).astype(np.int64), keys & np.uint64((1 << 44) - 1), count


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """n_docs x PLACES: the element of each place's first arrival (0 for a document without any)."""
    out = np.zeros(n_docs * PLACES, np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    todo, stretch = total > 0, PLACES * (np.log(PLACES) + 1.5)
    while todo.any():
        horizon = np.where(todo, stretch / np.maximum(total, 1e-300), 0.0)
        alive = np.flatnonzero(todo[doc])
        e, w, d, t = element[alive], weight[alive].astype(float), doc[alive], np.zeros(len(alive))
        seed = tokens.splitmix(e)
        arrivals: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = 0
        while len(e):
            step += 1
            r = tokens.splitmix(seed + np.uint64(step * int(tokens.K2) & (1 << 64) - 1))
            t = t - np.log(((r >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / w
            on = t < horizon[d]
            e, w, d, t, seed, r = e[on], w[on], d[on], t[on], seed[on], r[on]
            arrivals.append((d * PLACES + (tokens.splitmix(r) % np.uint64(PLACES)).astype(np.int64), t, e))
        place, time, e = (np.concatenate(x) for x in zip(*arrivals))
        soonest = np.full(n_docs * PLACES, np.inf)
        np.minimum.at(soonest, place, time)
        won = time == soonest[place]
        out[place[won]] = e[won]
        todo = todo & np.isinf(soonest.reshape(n_docs, PLACES)).any(axis=1)
        stretch *= 2
    return out.reshape(n_docs, PLACES)


def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sigs, bands = [], []
        texts = list(batch)
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or (size < 1_500_000 and to - at < 1024)):
                size += len(texts[to] or "")
                to += 1
            doc, element, _ = shingles(texts[at:to])
            sig = signatures(doc, element, np.ones(len(doc)), to - at)
            has = sig.any(axis=1)
            keys = np.zeros((len(sig), BANDS), np.uint64)
            for b in range(BANDS):
                x = np.full(len(sig), b, np.uint64)
                for r in range(ROWS):
                    x = tokens.mixed(x, sig[:, b * ROWS + r])
                keys[:, b] = x
            low = (tokens.splitmix(sig) & np.uint64(255)).astype(np.uint8)
            sigs += [row.tobytes() for row in low]
            bands += [k if h else k[:0] for k, h in zip(keys.view(np.int64), has)]
            at = to
        yield pd.DataFrame({"sig": sigs, "bands": bands})
    tokens.rest()


def agreement(same: np.ndarray, places: int) -> np.ndarray:
    """The estimate of the similarity from agreeing bytes, less those that agree by chance."""
    return (same / places - 1 / 256) / (1 - 1 / 256)


def forest(sig: np.ndarray) -> set[tuple[int, int]]:
    """Pairs of rows of maximum spanning forests by estimated similarity: on all places and on either half."""
    n = len(sig)
    halves = np.zeros((2, n, n), np.uint8)
    for k in range(PLACES):
        halves[k % 2] += sig[:, k, None] == sig[None, :, k]
    out: set[tuple[int, int]] = set()
    for same, places in ((halves[0].astype(np.uint16) + halves[1], PLACES), (halves[0], (PLACES + 1) // 2), (halves[1], PLACES // 2)):
        least = (DOUBTFUL * (1 - 1 / 256) + 1 / 256) * places
        best, source, free = same[0].astype(np.int32), np.zeros(n, np.int64), np.ones(n, bool)
        free[0] = False
        for _ in range(n - 1):
            at = int(np.where(free, best, -1).argmax())
            if best[at] >= least:
                out.add((min(at, int(source[at])), max(at, int(source[at]))))
            free[at] = False
            better = free & (same[at] > best)
            best[better], source[better] = same[at][better], at
    return out


def whole_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted bucket rows (bucket, tile, ...) in frames that hold whole buckets."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        last = batch.iloc[-1]
        # The last bucket may go on in the next batch.
        if (batch["bucket"].iloc[0], batch["tile"].iloc[0]) == (last["bucket"], last["tile"]):
            continue
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else batch
        open_ = ((rows["bucket"] == last["bucket"]) & (rows["tile"] == last["tile"])).to_numpy()
        yield rows[~open_]
        held = [rows[open_]]
    if held:
        yield pd.concat(held, ignore_index=True)


def parts(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """tid and signatures of the rows, starts and ends of their buckets."""
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), PLACES)
    new = np.flatnonzero((np.diff(rows["bucket"].to_numpy()) != 0) | (np.diff(rows["tile"].to_numpy()) != 0)) + 1
    return rows["tid"].to_numpy(np.int64), sig, np.concatenate([[0], new]), np.concatenate([new, [len(rows)]])


def candidates_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidate pairs of sorted bucket rows (bucket, tile, tid, sig)."""
    done: set[bytes] = set()

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        tid, sig, starts, ends = parts(rows)
        two = starts[ends - starts == 2]
        near = agreement((sig[two] == sig[two + 1]).sum(axis=1), PLACES) >= DOUBTFUL
        a.append(tid[two][near])
        b.append(tid[two + 1][near])
        for s, e in zip(starts, ends):
            if e - s > 2:
                name = tid[s:e].tobytes()
                if name in done:
                    continue
                if len(done) < 50_000:
                    done.add(name)
                found = np.array(sorted(forest(sig[s:e])), np.int64).reshape(-1, 2)
                a.append(tid[s:e][found[:, 0]])
                b.append(tid[s:e][found[:, 1]])
        a, b = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    for rows in whole_buckets(batches):
        yield pairs(rows)
    tokens.rest()


def joining(sig: np.ndarray, root: np.ndarray, sets: list[bytes]) -> Iterator[tuple[int, int, float]]:
    """Rows i, j and similarity of links that join the roots of a bucket, as all its pairs that are not doubtful do."""
    n = len(sig)
    near, step = np.zeros((n, n), bool), max(1, 8_000_000 // (n * PLACES))
    for at in range(0, n, step):
        near[at : at + step] = agreement((sig[at : at + step, None] == sig[None]).sum(axis=2), PLACES) >= DOUBTFUL
    near &= root[:, None] != root[None]
    rows = np.flatnonzero(near.any(axis=1))
    if not len(rows):
        return
    each = [np.frombuffer(sets[i], np.uint64) for i in rows]
    size = np.array([len(x) for x in each])
    _, column = np.unique(np.concatenate(each), return_inverse=True)
    row, order = np.repeat(np.arange(len(rows)), size), np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both, width = np.zeros((len(rows), len(rows)), np.float32), 2048
    edges = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width)) if len(column) else []
    for k in range(len(edges) - 1):
        x = np.zeros((len(rows), width), np.float32)
        x[row[edges[k] : edges[k + 1]], column[edges[k] : edges[k + 1]] - k * width] = 1
        both += x @ x.T
    label = root[rows].copy()
    for i in range(len(rows)):
        alike = both[i].astype(float) / np.maximum(1, size[i] + size - both[i].astype(float))
        to = np.flatnonzero(near[rows[i], rows] & (alike >= LEAST) & (label != label[i]))
        if len(to):
            new, first = np.unique(label[to], return_index=True)
            for j in to[first]:
                yield int(rows[i]), int(rows[j]), float(alike[j])
            label[np.isin(label, new)] = label[i]


def joining_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between the roots of sorted bucket rows (bucket, tile, tid, root, sig, set)."""
    done: set[bytes] = set()
    for rows in whole_buckets(batches):
        tid, sig, starts, ends = parts(rows)
        root, sets, out = rows["root"].to_numpy(np.int64), list(rows["set"]), []
        for s, e in zip(starts, ends):
            name = tid[s:e].tobytes()
            if e - s < 2 or (root[s:e] == root[s]).all() or name in done:
                continue
            if len(done) < 50_000:
                done.add(name)
            out += [(*sorted((tid[s + i], tid[s + j])), x) for i, j, x in joining(sig[s:e], root[s:e], sets[s:e])]
        yield pd.DataFrame(out, columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})
    tokens.rest()


def shingle_sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles([t])[1].tobytes() for t in texts], dtype=object)


def similarity(a: str, b: str) -> float:
    """The Jaccard similarity of the sets of two texts' shingles, exactly."""
    doc, key, _ = shingles([a, b])
    n = [int((doc == 0).sum()), int((doc == 1).sum())]
    both = n[0] + n[1] - len(np.unique(key))
    return both / max(1, n[0] + n[1] - both)


def similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def named_texts(texts: DataFrame, named: DataFrame, most: int) -> DataFrame:
    """tid and text of the texts whose tid is named, at most so many; each once."""
    named = named.distinct()
    if most <= MOST_SENT:
        named = F.broadcast(named)
    return texts.join(named, "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text"))


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, similarity of the pairs (a, b) that are links."""
    alike = F.pandas_udf(similarities, "double")
    read = written(named_texts(texts, pairs.select(F.explode(F.array("a", "b")).alias("tid")), pairs.count() * 2), "read")
    both = pairs.join(read.select(F.col("tid").alias("a"), F.col("text").alias("ta")), "a").join(read.select(F.col("tid").alias("b"), F.col("text").alias("tb")), "b")
    return written(both.select("a", "b", alike("ta", "tb").alias("similarity")).where(F.col("similarity") >= LEAST), "verified")


def links(texts: DataFrame) -> DataFrame:
    """a, b, similarity of linked distinct texts (tid long, text); links within one class may be left out."""
    sketch = F.pandas_udf(sketched, "sig binary, bands array<long>")
    sketches = written(texts.withColumn("s", sketch("text")).groupBy("tid").agg(F.first("s").alias("s")).select("tid", "s.sig", "s.bands"), "sketches")
    rows = sketches.select("tid", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64(F.lit(9), "tid"), F.col("tiles")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: u != F.col("own"))
    pair = lambda u: F.least(u, F.col("own")) * F.col("tiles") + F.greatest(u, F.col("own"))

    def dealt(rows: DataFrame, buckets: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        tiled = buckets.select("bucket", F.when(F.col("n") > TILE, F.ceil(F.col("n") / (TILE // 2))).otherwise(1).cast("int").alias("tiles"))
        out = rows.join(tiled, "bucket").withColumn("own", own)
        out = out.select(*rows.columns, F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.transform(others, pair))).alias("tile"))
        out = out.join(sketches.select("tid", "sig"), "tid")
        return (out if sets is None else out.join(sets, "tid")).repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "tid")

    pairs = written(dealt(rows, shared).mapInPandas(candidates_of, "a long, b long").distinct(), "pairs")
    found = verified(texts, pairs)
    # Edges of the forests may have failed: in buckets of more than one class all other pairs are tried, in place.
    roots = components(found)
    rooted = rows.join(roots, F.col("tid") == F.col("node"), "left").select("tid", "bucket", F.coalesce("root", "tid").alias("root"))
    parted = rooted.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r"), F.max("root").alias("s"), F.bit_xor(F.xxhash64("tid")).alias("members")).where("n > 2 AND r < s")
    # Of buckets of the same texts one will do.
    parted = written(parted.groupBy("n", "r", "s", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "parted")
    most = parted.agg(F.sum("n")).first()[0]
    if not most:
        return found
    crossing = written(rooted.join(parted.select("bucket"), "bucket", "left_semi"), "crossing")
    sets = written(named_texts(texts, crossing.select("tid"), most).select("tid", F.pandas_udf(shingle_sets, "binary")("text").alias("set")), "sets")
    return found.unionByName(written(dealt(crossing, parted, sets).mapInPandas(joining_of, found.schema), "joining"))


def with_ids(docs: DataFrame, text: str) -> DataFrame:
    """docs with tid, a hash of the text (null for null); texts that share a hash, as some of very many do, take another one."""
    one, other = F.xxhash64(text), F.xxhash64(F.lit(43), text)
    both = docs.where(F.col(text).isNotNull()).select(one.alias("__one"), other.alias("__other"))
    shared = both.groupBy("__one").agg(F.min("__other").alias("low"), F.max("__other").alias("high")).where("low <> high")
    shared = written(shared.select("__one"), "clashes")
    if shared.isEmpty():
        return docs.withColumn("tid", F.when(F.col(text).isNotNull(), one))
    marked = docs.join(shared, F.col(text).isNotNull() & (one == F.col("__one")), "left")
    return marked.withColumn("tid", F.when(F.col("__one").isNotNull(), other).when(F.col(text).isNotNull(), one)).drop("__one")


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with tid (of equal texts) and root (of near-duplicate texts): both null where the text is null.

    Equal texts are one class whatever their length; texts under five words are one shingle, and
    texts without words are near nothing but their equals. A null text is in no class. Texts are
    read whole. Equal rows are equal texts. An empty table gives no rows. Input columns named tid or
    root are replaced.
    """
    docs = with_ids(docs.drop("tid", "root"), text)
    roots = components(links(docs.where("tid IS NOT NULL").select("tid", F.col(text).alias("text"))))
    joined = docs.join(roots.select(F.col("node").alias("__node"), F.col("root").alias("__root")), F.col("tid") == F.col("__node"), "left")
    return joined.select(*docs.columns, F.coalesce("__root", "tid").alias("root"))


def with_sizes(classed: DataFrame, key: str) -> DataFrame:
    """classed (key, root) with least (the least key of its class) and n (its rows): both null where the root is null.

    Rows of a class are dealt over SALTS parts by their keys, and what is found of the class is
    sent to those parts that hold rows of it, so a class of a third of all rows is no task of its own.
    Repeated rows are counted each; null keys are the least only of classes without others; an empty
    table gives no rows. Input columns named least or n are replaced.
    """
    salted = classed.drop("least", "n").withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    parts = salted.where("root IS NOT NULL").groupBy(F.col("root").alias("__root"), F.col("__salt").alias("__part")).agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy(F.col("__root").alias("__r")).agg(F.min("least").alias("least"), F.sum("n").alias("n"))
    sent = parts.select("__root", "__part").join(whole, F.col("__root") == F.col("__r")).drop("__r")
    return salted.join(sent, (F.col("root") == F.col("__root")) & (F.col("__salt") == F.col("__part")), "left").drop("__root", "__part", "__salt")


def survivors(classed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of each class, that of the least key (null last, ties by text id), and every row without a class; tid and root go.

    Of rows equal in both any one stays; an empty table gives no rows.
    """
    columns = [c for c in classed.columns if c not in ("tid", "root")]
    row = F.struct(*columns)
    # A minimum, not a window: combined before the shuffle, so large classes do no harm.
    kept = classed.where("root IS NOT NULL").groupBy("root").agg(F.min_by(row, F.struct(F.col(key).isNull(), key, F.col("tid"))).alias("__r")).select("__r.*")
    return kept.unionByName(classed.where("root IS NULL").select(*columns))

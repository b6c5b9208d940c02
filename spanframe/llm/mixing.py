"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. A document's expected copies are its source's ratio of
target to size; the whole part is allocated for certain, the rest is its inclusion
probability p. Documents are ranked by Q = odds(u) / odds(p), u a seeded uniform hash, and
the smallest Q are taken until the source's remaining words are used up, so the size of the
sample is fixed in words. p differs by source and, if a preference column is given, by document.

Texts are read once, for a narrow table of sources, hashes and sizes. The ranking is never
gathered: histograms of Q (as Q / (1 + Q)) per source, each 256 times as fine as the last, close
in on the cell in which the sample ends, and only that cell's rows are ordered. What comes out
is one threshold a source, so that the documents themselves are neither sorted nor shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.llm.common import BLANKS, unit_hash, written

#: Sources up to which their targets are found on the driver and sent to all executors (below 10 MB); beyond, they are joined.
MOST_SENT = 100_000
#: Cells of a histogram for each source, rows of the last cell that are ordered at once, and histograms at most.
CELLS, EDGE, LEVELS = 256, 10_000, 6


def fill_targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares the sum of all sizes by weight; no target over cap times its size, the excess reshared by weight."""
    targets = [float(cap * s) for s in sizes]
    left, weight = float(sum(sizes)), float(sum(weights))
    for i in sorted(range(len(sizes)), key=lambda i: cap * sizes[i] / weights[i]):
        targets[i] = min(targets[i], left * weights[i] / weight) if left > 0 else 0.0
        left, weight = left - targets[i], weight - weights[i]
    return targets


def n_words(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.size(F.array_remove(F.split(t, BLANKS), "")).cast("long")


def weighed(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """sources (s, ...) with w: the weights in turn by code points, null last, without gathering the sources."""
    placed = sources.withColumn("t", F.col("__s").cast("string")).repartitionByRange(F.col("t").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    placed = written(placed, "sources")
    before, starts = 0, {}
    for r in sorted(placed.groupBy("part").count().collect()):  # one row a partition
        starts[r.part], before = before, before + r["count"]
    first = F.element_at(F.create_map(*[F.lit(x) for p in starts.items() for x in p]), F.col("part")) if starts else F.lit(0)
    place = first + F.row_number().over(Window.partitionBy("part").orderBy(F.col("t").asc_nulls_last())) - 1
    return placed.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))).drop("t", "part")


def level(sources: DataFrame, cap: float, rounds: int = 200) -> float:
    """The words for each unit of weight at which the targets least(cap * n, level * w) add up to all sizes."""
    total = sources.agg(F.sum("n")).first()[0] or 0
    low, high = 0.0, 2.0
    filled = lambda x: sources.agg(F.sum(F.least(cap * F.col("n"), x * F.col("w")))).first()[0] or 0.0
    while filled(high) < total and high < 1e300:
        low, high = high, high * 16
    for _ in range(rounds):
        # Between two bounds that cap the same sources, what is left goes to the others by weight.
        capped = lambda x: F.col("n") * cap <= x * F.col("w")
        r = sources.agg(F.sum(F.when(capped(low), cap * F.col("n"))).alias("a"), F.sum(F.when(~capped(low), F.col("w"))).alias("w"), F.count_if(capped(high) & ~capped(low)).alias("between")).first()
        if not r.between or not r.w:
            return (total - (r.a or 0.0)) / r.w if r.w else high
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if filled(middle) < total else (low, middle)
    return high


def targets(narrow: DataFrame, weights: tuple[float, ...], cap: float) -> tuple[DataFrame, bool]:
    """One row a source: s, source_size, target, ratio (of target to size) and mean (of the preference); whether they are few."""
    sources = written(narrow.groupBy("__s").agg(F.sum("__size").alias("n"), F.sum(F.col("__liking") * F.col("__size")).alias("l")), "sizes")
    found = [tuple(r) for r in sources.limit(MOST_SENT + 1).collect()]
    few = len(found) <= MOST_SENT
    if few:
        found.sort(key=lambda r: (r[0] is None, "" if r[0] is None else str(r[0])))
        filled = fill_targets([n for _, n, _ in found], [weights[i % len(weights)] for i in range(len(found))], cap)
        kind = narrow.schema["__s"].dataType.simpleString()
        filled_ = narrow.sparkSession.createDataFrame([(*r, t) for r, t in zip(found, filled)], f"__s {kind}, n long, l double, target double")
    else:
        with_w = weighed(sources, weights)
        filled_ = with_w.withColumn("target", F.least(cap * F.col("n"), level(with_w, cap) * F.col("w")))
    ratio = F.when(F.col("n") > 0, F.col("target") / F.col("n")).otherwise(0.0)
    mean = F.when((F.col("n") > 0) & (F.col("l") != 0), F.col("l") / F.col("n")).otherwise(1.0)
    return filled_.select("__s", F.col("n").alias("source_size"), "target", ratio.alias("__ratio"), mean.alias("__mean")), few


def small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def with_rank(df: DataFrame, cap: float, seed: int) -> DataFrame:
    """df (id, liking, ratio, mean) with whole copies, the chance p of one more, and its rank in (0, 1)."""
    expected = F.least(F.lit(float(cap)), F.col("__ratio") * F.col("__liking") / F.col("__mean"))
    u, p = unit_hash(seed, F.col("__id")), F.col("__p")
    q = (u / (1 - u)) / (p / (1 - p))
    return df.withColumn("__whole", F.floor(expected)).withColumn("__p", expected - F.col("__whole")).withColumn("__rank", F.when(p > 0, q / (1 + q)).otherwise(2.0))


def thresholds(narrow: DataFrame, per_source: DataFrame, few: bool, cap: float, seed: int) -> DataFrame:
    """One row a source: s, cut and cut_id (rank and id of the last group of equal rows taken), and share (how much of that group is taken)."""
    ranked = with_rank(narrow.join(small(per_source, few), narrow["__s"].eqNullSafe(per_source["__s"])).drop(per_source["__s"]), cap, seed)
    words = lambda c: F.sum(F.when(c, F.col("__size")).otherwise(0))
    state = ranked.groupBy("__s").agg((F.first("target") - F.sum(F.col("__whole") * F.col("__size"))).alias("__rest"), words(F.col("__p") > 0).alias("all"))
    # Sources whose rest all rows or none fill have no edge.
    state = written(state.select("__s", "__rest", (F.col("all") <= F.col("__rest")).alias("__every"), F.lit(0).cast("long").alias("__cell"), F.lit(0).cast("long").alias("__before")), "state")
    rows = ranked.where("__p > 0").select("__s", "__id", "__size", "__rank")

    def inside(at: int) -> DataFrame:
        open_ = state.where("NOT __every").select(F.col("__s").alias("t"), "__rest", "__cell", "__before")
        return rows.join(small(open_, few), F.col("__s").eqNullSafe(F.col("t")) & (F.floor(F.col("__rank") * float(CELLS**at)) == F.col("__cell"))).drop("t")

    for at in range(1, LEVELS + 1):
        cells = inside(at - 1).groupBy("__s", "__rest", "__before", F.floor(F.col("__rank") * float(CELLS**at)).alias("c")).agg(F.sum("__size").alias("n"), F.count(F.lit(1)).alias("rows"))
        to = F.col("__before") + F.sum("n").over(Window.partitionBy("__s").orderBy("c"))
        found = cells.withColumn("to", to).where("to >= __rest").groupBy("__s", "__rest").agg(F.min_by(F.struct("c", (F.col("to") - F.col("n")).alias("__before"), "rows"), "c").alias("x"))
        whole = state.where("__every").withColumn("rows", F.lit(0).cast("long"))
        state = written(found.select("__s", "__rest", F.lit(False).alias("__every"), F.col("x.c").alias("__cell"), F.col("x.__before").alias("__before"), F.col("x.rows").alias("rows")).unionByName(whole), "state")
        if (state.agg(F.max("rows")).first()[0] or 0) <= EDGE:
            break
    # Equal rows have one rank and one id: a group, of which a share may be taken.
    groups = inside(at).groupBy("__s", "__rest", "__before", "__rank", "__id").agg(F.sum("__size").alias("n"), F.count(F.lit(1)).alias("rows"))
    groups = groups.withColumn("to", F.col("__before") + F.sum("n").over(Window.partitionBy("__s").orderBy("__rank", "__id").rowsBetween(Window.unboundedPreceding, 0)))
    fit = F.when(F.col("n") > 0, F.round((F.col("__rest") - F.col("to") + F.col("n")) * F.col("rows") / F.col("n"))).otherwise(0.0)
    last = groups.where("to >= __rest").groupBy("__s").agg(F.min_by(F.struct("__rank", "__id", fit.alias("k"), "rows"), F.struct("__rank", "__id")).alias("x"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("x.k") / F.col("x.rows")))
    cuts = last.select("__s", F.col("x.__rank").alias("__cut"), F.col("x.__id").alias("__cut_id"), share.alias("__share"))
    everything = state.where("__every").select("__s", F.lit(1.5).alias("__cut"), F.lit(0).cast("long").alias("__cut_id"), F.lit(1.0).alias("__share"))
    return written(cuts.unionByName(everything), "cuts")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, *, key: str = "doc_id", text: str = "text", source: str = "source", preference: str | None = None, size: Column | None = None, content: Column | None = None, seed: int = 23) -> DataFrame:
    """docs with size, source_size, target, copies and taken (= copies * size).

    size and content (a hash of the text) may be given where docs has them instead of the text.
    Null sources are one source, ranked last; null and empty texts have size 0 and so take
    nothing; very long texts are counted whole. Equal rows are drawn alike, and of those on which a
    sample ends the share that fits is drawn by a seeded random number a row. Ties in Q go by a
    hash. An empty table gives no rows; input columns named like the added ones are replaced.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    wide = docs.withColumns({
        "__s": F.col(source), "__size": n_words(F.col(text)) if size is None else size.cast("long"),
        "__id": F.xxhash64(F.lit(seed), key, F.xxhash64(text) if content is None else content),
        "__liking": F.coalesce(F.col(preference).cast("double"), F.lit(0.0)) if preference else F.lit(1.0),
    }).drop(*added)
    own = ["__s", "__id", "__size", "__liking"]
    narrow = written(wide.select(*own), "narrow")
    per_source, few = targets(narrow, weights, cap)
    cuts = thresholds(narrow, per_source, few, cap, seed)
    limits = per_source.join(small(cuts.withColumnRenamed("__s", "t"), few), F.col("__s").eqNullSafe(F.col("t")), "left").drop("t")
    kept = [c for c in docs.columns if c not in added]
    both = wide.select(*kept, *own).join(small(limits.withColumnRenamed("__s", "__t"), few), F.col("__s").eqNullSafe(F.col("__t")))
    both = with_rank(both, cap, seed)
    group = F.when(F.col("__share") >= 1, 1).when(F.col("__share") <= 0, 0).otherwise((F.rand(seed) < F.col("__share")).cast("int"))
    before = (F.col("__rank") < F.col("__cut")) | ((F.col("__rank") == F.col("__cut")) & (F.col("__id") < F.col("__cut_id")))
    at_cut = (F.col("__rank") == F.col("__cut")) & (F.col("__id") == F.col("__cut_id"))
    more = F.when((F.col("__p") <= 0) | F.col("__cut").isNull(), 0).when(before, 1).when(at_cut, group).otherwise(0)
    copies = (F.col("__whole") + more).cast("int")
    return both.withColumn("copies", copies).select(*kept, F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("__size")).alias("taken"))


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as many times as it was taken."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)

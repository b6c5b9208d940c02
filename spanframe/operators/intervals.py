"""Operators on time intervals in whole milliseconds: merging, overlap, range and nearest joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], order: list[str], breaks, name: str) -> DataFrame:
    """df with a running number of the stretches that begin where `breaks` holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__new", F.when(breaks, 1).otherwise(0)).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def normalize(df: DataFrame, by: list[str], total_ms: int | Column | None = None, least_ms: int = 50, gap_ms: int = 0) -> DataFrame:
    """Clips to [0, total] (a number or a column), drops what is shorter than least_ms, then merges what overlaps, touches or lies within gap_ms."""
    s, e = F.greatest(F.col("start_ms"), F.lit(0)), F.col("end_ms") if total_ms is None else F.least(F.col("end_ms"), total_ms if isinstance(total_ms, Column) else F.lit(total_ms))
    cut = df.select(*by, s.alias("start_ms"), e.alias("end_ms")).where(F.col("end_ms") - F.col("start_ms") >= least_ms)
    w = Window.partitionBy(*by).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("__until", F.max("end_ms").over(w))
    cut = islands(cut, by, ["start_ms", "end_ms"], F.col("__until").isNull() | (F.col("start_ms") > F.col("__until") + gap_ms), "__island")
    return cut.groupBy(*by, "__island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("__island")


def runs(df: DataFrame, by: list[str], order: list[str], mask) -> DataFrame:
    """Maximal runs of rows where mask holds, as [first, last] positions from 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    numbered = df.withColumn("__i", F.row_number().over(w) - 1).where(mask)
    return numbered.withColumn("__g", F.col("__i") - F.row_number().over(w)).groupBy(*by, "__g").agg(F.min("__i").alias("first"), F.max("__i").alias("last")).drop("__g")


def energy_vad(df: DataFrame, by: list[str], order: list[str], level: str, top_db: float, least_speech: int, least_silence: int) -> DataFrame:
    """Runs louder than the 99.5th percentile less top_db; gaps under least_silence frames close, then short runs go."""
    limit = df.groupBy(*by).agg((F.percentile(level, 0.995) - top_db).alias("__limit"))
    found = runs(df.join(limit, by), by, order, F.col(level) > F.col("__limit"))
    w = Window.partitionBy(*by).orderBy("first")
    found = islands(found.withColumn("__gap", F.col("first") - F.lag("last").over(w) - 1), by, ["first"], F.col("__gap").isNull() | (F.col("__gap") >= least_silence), "__run")
    return found.groupBy(*by, "__run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("__run").where(F.col("last") - F.col("first") + 1 >= least_speech)


def overlap_regions(turns: DataFrame, least_ms: int = 200) -> DataFrame:
    """Stretches in which two speakers or more are active, by a sweep; ends come before starts at the same time."""
    steps = turns.select("file_id", "speaker", F.explode(F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("d")))).alias("x")).select("file_id", "speaker", "x.*")
    own = Window.partitionBy("file_id", "speaker").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("n", F.sum("d").over(own)).where(((F.col("d") == 1) & (F.col("n") == 1)) | ((F.col("d") == -1) & (F.col("n") == 0)))
    file = Window.partitionBy("file_id").orderBy("t", "d")
    steps = steps.withColumn("n", F.sum("d").over(file.rowsBetween(Window.unboundedPreceding, 0))).where(((F.col("d") == 1) & (F.col("n") == 2)) | ((F.col("d") == -1) & (F.col("n") == 1)))
    return steps.withColumn("end_ms", F.lead("t").over(file)).where((F.col("d") == 1) & (F.col("end_ms") - F.col("t") >= least_ms)).select("file_id", F.col("t").alias("start_ms"), "end_ms")


def binned(df: DataFrame, start, end, bin_ms: int) -> DataFrame:
    """A row for each time bin that [start, end] touches: turns a range join into an equi-join."""
    return df.withColumn("bin", F.explode(F.sequence(F.floor(start / bin_ms), F.floor(end / bin_ms))))


def overlap_join(a: DataFrame, b: DataFrame, bin_ms: int = 600_000) -> DataFrame:
    """Pairs of intervals of one file (a: start_ms, end_ms; b: b_start, b_end) with a common stretch, once each, with overlap_ms."""
    left, right = binned(a, F.col("start_ms"), F.col("end_ms"), bin_ms), binned(b, F.col("b_start"), F.col("b_end"), bin_ms)
    both = left.join(right, ["file_id", "bin"]).where((F.col("b_start") < F.col("end_ms")) & (F.col("b_end") > F.col("start_ms")))
    # The bin where the later of the two begins is the one that reports the pair.
    both = both.where(F.col("bin") == F.floor(F.greatest("start_ms", "b_start") / bin_ms)).drop("bin")
    return both.withColumn("overlap_ms", F.least("end_ms", "b_end") - F.greatest("start_ms", "b_start"))


def assign_speakers(words: DataFrame, turns: DataFrame, most_ms: int = 1000, bin_ms: int = 120_000) -> DataFrame:
    """words with the speaker of the turn that overlaps most (ties: earliest), else of the nearest within most_ms of the midpoint, else filled forward, then backward.

    Of turns in order of their starts only those that end later than all before can be the best for
    what they were there before: so a word needs the last of them begun by its start (by its midpoint),
    and the first to reach its end (its midpoint), which running frames tell, besides turns that begin
    within the word. Only words that no turn covers meet those, in the time bins where they begin.
    """
    keys = words.drop("speaker").columns
    ts, te = F.col("start_ms"), F.col("end_ms")
    turn = F.struct(ts.alias("ts"), F.col("pos").alias("p"), F.col("speaker").alias("s"), te.alias("te"))
    t = turns.where("end_ms > start_ms").select("file_id", turn.alias("__turn"), F.lit(None).cast(words.select(F.struct(*keys)).schema[0].dataType).alias("__word"), (ts * 2).alias("__a"), (ts * 2).alias("__m"))
    w = words.select("file_id", F.lit(None).cast(t.schema["__turn"].dataType).alias("__turn"), F.struct(*keys).alias("__word"), (ts * 2).alias("__a"), (ts + te).alias("__m"))
    file, is_word = Window.partitionBy("file_id"), F.col("__word").isNotNull()
    before = lambda *order: file.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = t.unionByName(w)
    begun = file.orderBy("__a", is_word, "__turn.p")
    both = both.withColumn("__until", F.max("__turn.te").over(begun.rowsBetween(Window.unboundedPreceding, -1)))
    # A turn that ends later than all that began before it; no other is ever better than an earlier one.
    both = both.withColumn("__top", F.when(F.col("__until").isNull() | (F.col("__turn.te") > F.col("__until")), F.col("__turn"))).drop("__until")
    both = both.withColumn("__by_start", F.last("__top", True).over(before("__a", is_word, "__turn.p")))
    both = both.withColumn("__by_middle", F.last("__top", True).over(before("__m", is_word, "__turn.p")))
    both = both.withColumn("__next", F.last("__turn", True).over(before(F.desc("__m"), is_word.desc(), F.desc("__turn.p"))))
    # Backwards in time: of those whose ends are not yet passed, the earliest, which is the last seen.
    end = F.coalesce(F.col("__turn.te"), F.col("__word.end_ms")) * 2
    both = both.withColumn("__to_end", F.last("__top", True).over(before(end.desc(), is_word)))
    end = F.coalesce(F.col("__turn.te") * 2, F.col("__m"))
    both = both.where(is_word | F.col("__top").isNotNull()).withColumn("__to_middle", F.last("__top", True).over(before(end.desc(), is_word)))
    a, b, mid2 = F.col("__word.start_ms"), F.col("__word.end_ms"), F.col("__m")
    ranked = lambda x, *o: F.struct(*[c.alias(f"o{i}") for i, c in enumerate(o)], x["ts"].alias("ts"), x["p"].alias("p"), x["s"].alias("s"))

    def over(x):
        shared = F.least(x["te"], b) - F.greatest(x["ts"], a)
        return F.when(x["ts"].isNotNull() & (shared > 0), ranked(x, -shared))

    def near(x):
        off = F.greatest(x["ts"] * 2 - mid2, mid2 - x["te"] * 2, F.lit(0).cast("bigint"))
        return F.when(x["ts"].isNotNull() & (off <= 2 * most_ms), ranked(x, off))

    begun_by = lambda c, at: F.when(F.col(c)["ts"] * 2 <= at, F.col(c))
    first_to_end, first_to_middle = begun_by("__to_end", F.col("__a")), begun_by("__to_middle", mid2)
    best = both.where(is_word).select(
        "__word", F.coalesce(over(first_to_end), over(F.col("__by_start"))).alias("__over"), (first_to_end.isNotNull() & (b > a)).alias("__covered"),
        F.least(near(first_to_middle), near(F.col("__by_middle")), near(F.col("__next"))).alias("__near"),
    )
    # Turns that begin within a word share less of it than one that covers it.
    part = best.where(~F.coalesce("__covered", F.lit(False)))
    inner = turns.where("end_ms > start_ms").select("file_id", ts.alias("ts"), te.alias("te"), F.col("pos").alias("p"), F.col("speaker").alias("s"), F.floor(ts / bin_ms).alias("bin"))
    open_ = part.where("__word.end_ms > __word.start_ms").select(F.col("__word.file_id").alias("file_id"), "__word", F.explode(F.sequence(F.floor(a / bin_ms), F.floor(b / bin_ms))).alias("bin"))
    met = open_.join(inner, ["file_id", "bin"]).where((F.col("ts") > a) & (F.col("ts") < b))
    met = met.groupBy("__word").agg(F.min(F.struct((F.col("ts") - F.least("te", b)).alias("o0"), "ts", "p", "s")).alias("__inner"))
    part = part.join(met.withColumnRenamed("__word", "__w"), F.col("__word") == F.col("__w"), "left")
    told = lambda rows, *o: rows.select("__word.*", F.coalesce(F.least("__over", *o)["s"], F.col("__near.s")).alias("speaker")) if o else rows.select("__word.*", F.coalesce("__over.s", "__near.s").alias("speaker"))
    best = told(best.where("__covered")).unionByName(told(part, "__inner"))
    order = Window.partitionBy("file_id").orderBy("start_ms", "pos")
    filled = best.withColumn("speaker", F.coalesce("speaker", F.last("speaker", True).over(order.rowsBetween(Window.unboundedPreceding, -1))))
    # Backwards as a running frame of the reversed order: a frame up to the end is computed anew for each row.
    back = Window.partitionBy("file_id").orderBy(F.desc("start_ms"), F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    return filled.withColumn("speaker", F.coalesce("speaker", F.last("speaker", True).over(back))).select(*keys, "speaker")


def region_speakers(turns: DataFrame, least_ms: int = 200) -> DataFrame:
    """Overlap regions with the sorted names of all who speak in them."""
    spoken = turns.select("file_id", "speaker", F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    return overlap_join(overlap_regions(turns, least_ms), spoken).groupBy("file_id", "start_ms", "end_ms").agg(F.sort_array(F.collect_set("speaker")).alias("speakers"))


def inner_pieces(clips: DataFrame, segs: DataFrame) -> DataFrame:
    """The stretches of segs (b_start, b_end) inside each clip (clip_id), cut to it; a clip without any is its own piece."""
    keys = ["file_id", "clip_id"]
    cut = overlap_join(clips, segs).select(*keys, F.greatest("start_ms", "b_start").alias("start_ms"), F.least("end_ms", "b_end").alias("end_ms"))
    bare = clips.join(cut.select(*keys).distinct(), keys, "left_anti").select(cut.columns)
    return cut.unionByName(bare)


def nearest_of_two(points: DataFrame, turns: DataFrame, at: str = "at_ms") -> DataFrame:
    """points with the speaker of the last turn begun or of the next: the one that holds the point, else the one with the nearer edge (ties: the former); null in a file without turns."""
    held = F.struct("start_ms", "end_ms", "speaker")
    t = turns.select("file_id", F.col("start_ms").alias("__t"), F.lit(0).alias("__kind"), F.col("end_ms").alias("__end"), F.col("pos").alias("__pos"), held.alias("__turn"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("__p"))
    p = points.select("file_id", F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.lit(0).cast("long").alias("__end"), F.lit(0).cast("long").alias("__pos"), F.lit(None).cast(t.schema["__turn"].dataType).alias("__turn"), F.struct(*points.columns).alias("__p"))
    order = ["__t", "__kind", "__end", "__pos"]
    file = Window.partitionBy("file_id")
    both = t.unionByName(p)
    both = both.withColumn("__a", F.last("__turn", True).over(file.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("__b", F.last("__turn", True).over(file.orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, 0)))
    edge = lambda c: F.least(F.abs(F.col("__t") - F.col(f"{c}.start_ms")), F.abs(F.col("__t") - F.col(f"{c}.end_ms")))
    holds = F.col("__a.end_ms") >= F.col("__t")
    former = F.col("__b").isNull() | (F.col("__a").isNotNull() & (holds | (edge("__a") <= edge("__b"))))
    return both.where("__kind = 1").select("__p.*", F.when(former, F.col("__a.speaker")).otherwise(F.col("__b.speaker")).alias("speaker"))


def whole_groups(parts: DataFrame, by: str, n_parts: str, order: str, text: str) -> DataFrame:
    """The texts of all parts joined in order, for the groups of which every part is there with a text."""
    rows = F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("x"))))
    each = parts.groupBy(by).agg(F.count(text).alias("n"), F.max(n_parts).alias("all"), rows.alias("rows"))
    return each.where(F.col("n") == F.col("all")).select(by, F.array_join(F.transform("rows", lambda r: r["x"]), " ").alias("text"))

"""Quality rules whose thresholds come from mergeable quantile sketches, in DataFrame operations only.

Each document is measured (measure). The measures of the documents that pass the fixed base
rules are sketched per language and source: a sketch is a histogram over logarithmic cells of
relative width 1/128, so sketches merge by adding counts and any quantile is found within that
width. Thin groups use the merged sketch of their language, thin languages that of everything.

From the quartiles come an inner and an outer fence for each measure (one and a half and three
times the quartiles' distance beyond them), wider for documents shorter than the group's median,
as their averages vary more. A measure without spread has no scale, so it has an inner fence
only. A join with the documents applies the fences: beyond an outer fence, or beyond inner fences
of two families of measures, a document goes. No cutoff is fixed: all come from the sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.llm.common import let, words

#: Measures: (name, integer expression, family, has lower fences). Repeated lines repeat words, so the two are one family.
MEASURES = (
    ("word_length", "word_chars * 1000 div greatest(n_words, 1)", 0, True),
    ("symbols", "n_symbols * 1000000 div greatest(word_chars, 1)", 1, False),
    ("dup_lines", "n_dup_lines * 1000 div greatest(n_lines, 1)", 2, False),
    ("repeats", "n_repeat_words * 1000 div greatest(n_words, 1)", 2, False),
)
INNER, OUTER, FAMILIES = 1.5, 3.0, 2
#: Cells of the sketches for each doubling; smaller numbers are exact.
CELLS = 128


def repeat_words(ws: Column) -> Column:
    """How many words of the array lie in an 8-word window that is found twice or more in it."""

    def joined(a, k):
        n = F.size(a) - k
        return F.zip_with(F.slice(a, 1, n), F.slice(a, k + 1, n), lambda x, y: F.xxhash64(x, y))

    def covered(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def count(s):
            same = F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
            starts = F.sort_array(F.transform(same, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            return F.aggregate(starts, start, lambda a, p: F.struct((p + 8).alias("end"), (a["n"] + 8 - F.greatest(F.lit(0), a["end"] - p)).alias("n")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, count))

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    deep = let(hashes, lambda a: let(joined(a, 1), lambda b: let(joined(b, 2), lambda c: let(joined(c, 4), covered))))
    return F.when(F.size(ws) >= 8, deep).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) and base_failed.

    A null or empty text has no words and so fails the base rules; texts are measured whole,
    however long; equal rows get equal measures; an empty table gives no rows; input columns named
    like the added ones are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]
    docs = docs.drop(*added)
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    m = let(words(t), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), repeat_words(ws).alias("n_repeat_words")))
    line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long")
    n, r = F.col("n_words"), F.col("n_repeat_words")
    return docs.withColumns({"__m": m, "__l": line, "n_symbols": symbols}).select(*docs.columns, "__m.n_words", "__m.word_chars", "n_symbols", "__l.n_lines", "__l.n_dup_lines", "__m.n_repeat_words").withColumn("base_failed", (n < 20) | (100 * r > 30 * n))


def cell_of(v: str) -> Column:
    """The logarithmic cell of a whole number: exact below 2 * CELLS, then CELLS cells for each doubling."""
    bits = CELLS.bit_length()
    return F.expr(f"CASE WHEN {v} < {2 * CELLS} THEN {v} ELSE {CELLS} * (length(bin({v})) - {bits}) + shiftright({v}, length(bin({v})) - {bits}) END")


def _floor_of(c: str) -> str:
    return f"CASE WHEN {c} < {2 * CELLS} THEN {c} ELSE shiftleft({c} - {CELLS} * ({c} div {CELLS} - 1), CAST({c} div {CELLS} - 1 AS int)) END"


def sketches(measured: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One row for each group, measure and cell, with its count; sums of counts merge sketches. The last measure is n_words."""
    exprs = [e for _, e, *_ in MEASURES] + ["n_words"]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("m"), F.expr(e).alias("v")) for k, e in enumerate(exprs)]))
    return measured.where("NOT base_failed").select(*by, each.alias("__x")).select(*by, F.col("__x.m").alias("__m"), cell_of("__x.v").alias("__cell")).groupBy(*by, "__m", "__cell").agg(F.count(F.lit(1)).alias("__n"))


def quartiles(sketch: DataFrame, by: list[str], least: int) -> DataFrame:
    """For each group with at least that many documents: a struct __f of low and high quartile of each measure, and the median of n_words."""
    group = Window.partitionBy(*by, "__m")
    q = sketch.withColumns({"all": F.sum("__n").over(group), "to": F.sum("__n").over(group.orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0))})
    at = lambda c: F.min(F.when(F.col("to") * 100 >= F.col("all") * c, F.col("__cell")))
    q = q.groupBy(*by, "__m").agg(at(25).alias("c1"), at(50).alias("c2"), at(75).alias("c3"), F.max("all").alias("all")).where(F.col("all") >= least)
    one = [F.max(F.when(F.col("__m") == k, F.expr(_floor_of(c)))).alias(f"{name}_{end}") for k, (name, *_) in enumerate(MEASURES) for c, end in (("c1", "low"), ("c3", "high"))]
    one.append(F.max(F.when(F.col("__m") == len(MEASURES), F.expr(_floor_of("c2")))).alias("n_words"))
    names = [f"{name}_{end}" for name, *_ in MEASURES for end in ("low", "high")] + ["n_words"]
    return q.groupBy(*by).agg(*one).select(*by, F.struct(*names).alias("__f"))


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source", least: int = 100) -> DataFrame:
    """Quartiles for every (lang, source) that has a document passing the base rules; null is a group of its own.

    Groups of fewer than `least` documents have those of their language, languages of fewer those
    of all documents. Equal rows count each; an empty table gives no rows.
    """
    fine = sketches(measured.select(F.col(lang).alias("__lang"), F.col(source).alias("__source"), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"), ("__lang", "__source"))
    mid = fine.groupBy("__lang", "__m", "__cell").agg(F.sum("__n").alias("__n"))
    top = mid.groupBy("__m", "__cell").agg(F.sum("__n").alias("__n"))
    groups = fine.select("__lang", "__source").distinct()
    own = quartiles(fine, ["__lang", "__source"], least).withColumnsRenamed({"__lang": "l1", "__source": "s1", "__f": "f1"})
    its_lang = quartiles(mid, ["__lang"], least).withColumnsRenamed({"__lang": "l2", "__f": "f2"})
    all_ = quartiles(top.withColumn("__all", F.lit(1)), ["__all"], 1).withColumnRenamed("__f", "f3")
    out = groups.withColumn("__all", F.lit(1)).join(own, F.col("__lang").eqNullSafe(F.col("l1")) & F.col("__source").eqNullSafe(F.col("s1")), "left").join(its_lang, F.col("__lang").eqNullSafe(F.col("l2")), "left").join(all_, "__all", "left")
    return out.select("__lang", "__source", F.coalesce("f1", "f2", "f3").alias("__f"))


def apply_fences(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """measured with kept: passes the base rules, lies within every outer fence of its group, and beyond inner fences of one family at most.

    A value on a fence lies within it. An input column named kept is replaced.
    """
    columns = [c for c in measured.columns if c.lower() != "kept"]
    joined = measured.join(limits, F.col(lang).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source")), "left")
    wider = F.sqrt(F.greatest(F.lit(1.0), F.col("__f.n_words") / F.greatest("n_words", F.lit(1))))
    far, beyond = F.lit(False), {}
    for name, e, family, lower in MEASURES:
        v, low, high = F.expr(e), F.col(f"__f.{name}_low"), F.col(f"__f.{name}_high")
        reach = (high - low) * wider
        out = lambda k: (v > high + reach * k) | (F.lit(lower) & (v < low - reach * k))  # noqa: B023, E731
        far = far | ((high > low) & out(OUTER))
        beyond[family] = beyond.get(family, F.lit(False)) | out(INNER)
    broken = sum((x.cast("int") for x in beyond.values()), F.lit(0))
    inside = F.coalesce(~far & (broken < FAMILIES), F.lit(True))
    return joined.select(*columns, (~F.col("base_failed") & inside).alias("kept"))

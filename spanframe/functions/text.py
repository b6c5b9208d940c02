"""Scalar functions on time and text, as column expressions."""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanframe.functions.distance import edit_distance

#: Characters between which blanks are dropped, what separates terms, a loop, punctuation that a long text must have, numerals.
_CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3000}-\x{303F}\x{FF01}-\x{FF60}"
_SEPARATORS = r"[\s、，,・･/／;；]+"
_LOOP = r"(?s)(.{1,20}?)\1{5,}"
_PUNCT = "、。，．,.!?！？"
NUMERALS = r"[0-9０-９]+(?:[.,．，][0-9０-９]+)?|[〇一二三四五六七八九十百千万億兆]+"

#: Names and codes of languages.
LANGUAGES = {
    "Japanese": "ja", "English": "en", "Chinese": "zh", "Cantonese": "yue", "Korean": "ko", "French": "fr", "German": "de", "Spanish": "es", "Portuguese": "pt", "Italian": "it",
    "Russian": "ru", "Arabic": "ar", "Indonesian": "id", "Thai": "th", "Vietnamese": "vi", "Turkish": "tr", "Hindi": "hi", "Malay": "ms", "Dutch": "nl", "Swedish": "sv",
    "Danish": "da", "Finnish": "fi", "Polish": "pl", "Czech": "cs", "Filipino": "fil", "Persian": "fa", "Greek": "el", "Romanian": "ro", "Hungarian": "hu", "Macedonian": "mk",
}


def _lookup(pairs) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def language_code(name: Column) -> Column:
    """The code of a language's name; what has three letters or less stays, anything else is null."""
    return F.when(name != "", F.coalesce(F.try_element_at(_lookup(LANGUAGES.items()), name), F.when(F.length(name) <= 3, name)))


def language_name(label: Column) -> Column:
    """The name for a code or name, of the first one in a list; unknown ones are capitalised, null is empty."""
    first = F.trim(F.element_at(F.split(label, ","), 1))
    known = F.when(first.isin(*LANGUAGES), first).otherwise(F.try_element_at(_lookup((c, n) for n, c in LANGUAGES.items()), F.lower(first)))
    return F.coalesce(known, F.concat(F.upper(F.substring(first, 1, 1)), F.lower(F.substr(first, F.lit(2)))), F.lit(""))


def whole_ms(seconds: Column) -> Column:
    """Seconds, not below zero, as whole milliseconds; halves go to the even one."""
    return F.rint(F.greatest(seconds.cast("double"), F.lit(0.0)) * 1000).cast("bigint")


def duration(seconds: Column) -> Column:
    """12.3秒 below a minute, else minutes or hours with whole seconds."""
    s = F.rint(seconds.cast("double")).cast("bigint")
    long_ = F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))
    return F.when(seconds < 60, F.concat(F.format_string("%.1f", F.bround(seconds.cast("double"), 1)), F.lit("秒"))).otherwise(long_)


def hms(ms: Column) -> Column:
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def clock(ms: Column, mark: str = ",") -> Column:
    """HH:MM:SS and milliseconds."""
    return F.concat(hms(ms), F.lit(mark), F.lpad((F.greatest(ms, F.lit(0)) % 1000).cast("string"), 3, "0"))


def core_len(t: Column) -> Column:
    return F.length(F.regexp_replace(t, r"[^\p{L}\p{N}']", ""))


def halfwidth(t: Column) -> Column:
    wide = "".join(chr(c + 0xFEE0) for c in [*range(48, 58), *range(65, 91), *range(97, 123)])
    return F.translate(t, wide, "".join(chr(ord(c) - 0xFEE0) for c in wide))


def close_cjk_blanks(t: Column) -> Column:
    return F.regexp_replace(t, rf"(?<=[{_CJK}])[ \t\x{{3000}}]+(?=[{_CJK}])", "")


#: Characters in which loops are looked for at a time.
LOOKED_AT = 1 << 18


def looping(texts: list[str]) -> np.ndarray:
    """In which texts _LOOP matches: where each of 5 n neighbours is like the one n behind it, n from 1 to 20, by numpy on all texts in a row."""
    out = np.zeros(len(texts), bool)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    # No two ends of texts are alike, and no character is like one.
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[starts + sizes - 1] = 0x110000 + np.arange(len(texts))
    for at in range(0, len(codes), LOOKED_AT):
        x = codes[at : at + LOOKED_AT + 120]  # a loop of 120 that begins here is seen whole
        for n in range(1, 21):
            if len(x) < 6 * n:
                break
            run, size = x[n:] == x[:-n], 1
            while size < 5 * n and run.any():
                more = min(size, 5 * n - size)
                run, size = run[:-more] & run[more:], size + more
            if size == 5 * n:
                out[np.searchsorted(starts, at + np.flatnonzero(run), side="right") - 1] = True
    return out


def _looping(texts: pd.Series) -> pd.Series:
    return pd.Series(looping([t or "" for t in texts]), dtype=bool)


def has_loop(t: Column) -> Column:
    """Whether collapse_repeats() would change the text or match in it; null has none. A pattern takes many times as long, as it tries every length at every place."""
    return F.pandas_udf(_looping, "boolean")(t)


def collapse_repeats(t: Column, keep: int = 2) -> Column:
    """A run of six or more of the same 1 to 20 characters keeps `keep` of them."""
    return F.when(has_loop(t), F.regexp_replace(t, _LOOP, "$1" * keep)).otherwise(t)


def terms(t: Column) -> Column:
    parts = F.split(t, "(?U)" + _SEPARATORS)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def context(label: Column, ts: Column, extra: Column | None = None) -> Column:
    """The terms framed by a label, then whatever else is to be said on a line of its own."""
    plain = label.rlike(r"^[\x00-\x7F]*$")
    head = F.when(label == "", "").otherwise(F.concat(label, F.lit(": ")))
    framed = F.when(plain, F.concat(head, F.array_join(ts, ", "), F.lit("."))).otherwise(F.concat(head, F.array_join(ts, "、"), F.lit("。")))
    parts = [F.when(F.size(ts) > 0, framed)]
    if extra is not None:
        parts.append(F.nullif(strip(F.coalesce(extra, F.lit(""))), F.lit("")))
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def strip(t: Column) -> Column:
    """Without blanks of any script at either end."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def escaped(t: Column) -> Column:
    """Text for HTML."""
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(plain), F.lit(code))
    return t


def content_key(*cols: Column) -> Column:
    """Sixteen hex digits that stand for the values, nulls included."""
    return F.substring(F.sha1(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})), 1, 16)


def joined_texts(parts: Column) -> Column:
    """An array of texts as one: blanks at their ends go, empty ones too, and a space stands between ASCII letters or digits only."""
    start = F.lit("")
    add = lambda out, t: F.when(t == "", out).otherwise(F.concat(out, F.when(out.rlike("[0-9A-Za-z]$") & t.rlike("^[0-9A-Za-z]"), " ").otherwise(""), t))
    return F.aggregate(F.transform(parts, lambda t: strip(F.coalesce(t, F.lit("")))), start, add)


def cer(ref: Column, hyp: Column) -> Column:
    """Edit distance over the reference's length; an empty reference gives 0 for an empty hypothesis, else NaN."""
    return F.when(F.length(ref) == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(float("nan"))).otherwise(distance(ref, hyp) / F.length(ref))


def distance(a: Column, b: Column) -> Column:
    """The Levenshtein distance in code points; null for null. Bit-parallel, so that whole documents can be compared."""

    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else edit_distance(s, t) for s, t in zip(x, y)], dtype="Int64")

    return F.pandas_udf(each, "bigint")(a, b)


def _nfkc(texts: pd.Series) -> pd.Series:
    return pd.Series([unicodedata.normalize("NFKC", t or "") for t in texts], dtype=object)


def nfkc(t: Column) -> Column:
    """Compatibility forms of characters made plain; null is empty."""
    return F.pandas_udf(_nfkc, "string")(t)


def _normal(texts: pd.Series) -> pd.Series:
    out = []
    for t in texts:
        plain = unicodedata.normalize("NFKC", t or "").lower()
        # Each character is looked at once a text, not at every place.
        out.append(plain.translate({ord(c): None for c in set(plain) if unicodedata.category(c)[0] not in "LN"}))
    return pd.Series(out, dtype=object)


def normal(t: Column) -> Column:
    """The letters and digits of a text in any script, after NFKC and in lower case; null is empty."""
    return F.pandas_udf(_normal, "string")(t)


def normal_ascii(t: Column) -> Column:
    """normal as far as SQL can express it: of ASCII letters and digits only."""
    return F.regexp_replace(F.lower(t), "[^a-z0-9]", "")


def occurrences(t: Column, term: Column) -> Column:
    """How often the term is found in the text, without overlaps."""
    return F.when(term == "", 0).otherwise(((F.length(t) - F.length(F.replace(t, term, F.lit("")))) / F.length(term)).cast("bigint"))


def term_recall(ref: Column, hyp: Column, terms_: Column) -> Column:
    """hit, total: how many of the terms of the reference the hypothesis has too. Texts and terms should be nfkc() forms."""
    start = F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("total"))

    def add(s, t):
        n = occurrences(ref, t).cast("bigint")
        return F.struct((s["hit"] + F.least(n, occurrences(hyp, t).cast("bigint"))).alias("hit"), (s["total"] + n).alias("total"))

    return F.aggregate(terms_, start, add)


def multiset_recall(ref: Column, hyp: Column) -> Column:
    """hit, total: the common elements of two arrays, each as often as in both, and the elements of the first."""
    same = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    hit = F.aggregate(F.array_distinct(ref), F.lit(0), lambda n, x: n + F.least(same(ref, x), same(hyp, x)))
    return F.struct(hit.cast("bigint").alias("hit"), F.size(ref).cast("bigint").alias("total"))


def numerals(t: Column) -> Column:
    """Arabic and kanji numerals of an nfkc() text, as they stand."""
    return F.regexp_extract_all(t, F.lit(NUMERALS), F.lit(0))


def plain_flags(text: Column, dur_ms: Column, speech_ms: Column, most_cps: int = 18) -> Column:
    """Those flags of quality_flags that SQL can express: empty, too_dense, no_punct."""
    core = core_len(text)
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    stops = F.length(text) - F.length(F.translate(text, _PUNCT, ""))
    rest = F.array_compact(F.array(F.when((dur_ms > 0) & (core * 1000 > F.greatest(dur_ms, F.lit(1000)) * most_cps), F.lit("too_dense")), F.when((core > 150) & (stops < 3), F.lit("no_punct"))))
    return F.when(blank, F.when(speech_ms >= 2000, F.array(F.lit("empty"))).otherwise(F.array().cast("array<string>"))).otherwise(rest)


#: Scripts that don't belong in a transcript of a language.
_FOREIGN = {
    "Japanese": r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{0400}-\x{04FF}\x{0E00}-\x{0E7F}\x{0600}-\x{06FF}\x{0900}-\x{097F}]",
    "English": r"[\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{4E00}-\x{9FFF}]",
}


def _ratios(texts: pd.Series) -> pd.Series:
    coded = [(t or "").encode("utf-8") for t in texts]
    return pd.Series([len(b) / max(1, len(zlib.compress(b))) if b else 0.0 for b in coded], dtype="float64")


def compression_ratio(t: Column) -> Column:
    """The bytes of a text over those of its zlib form; 0 for an empty text."""
    return F.pandas_udf(_ratios, "double")(t)


def quality_flags(text: Column, dur_ms: Column, speech_ms: Column, ctx_terms: Column | None = None, ctx_label: str = "", punctuates: bool = True, most_cps: int = 18, lang: Column | None = None) -> Column:
    """Flags of a transcript, in a fixed order: empty, or context_label, context_echo, too_dense, repetition, no_punct, foreign_script.

    ctx_terms is an array of the terms given as context, lang the language's name.
    """
    t = strip(F.coalesce(text, F.lit("")))
    core, flag = core_len(t), lambda said, name: F.when(said, F.lit(name))
    flags = []
    if len(ctx_label) >= 2:
        flags.append(flag(F.contains(t, F.lit(ctx_label)), "context_label"))
    if ctx_terms is not None:
        by_length = F.array_sort(F.filter(ctx_terms, lambda w: w != ""), lambda a, b: F.length(b) - F.length(a))
        start = F.struct(t.alias("rest"), F.lit(0).cast("long").alias("hits"))
        # The longest terms are taken out first, so that none is counted within another.
        step = lambda s, w: F.struct(F.replace(s["rest"], w, F.lit("")).alias("rest"), (s["hits"] + ((F.length(s["rest"]) - F.length(F.replace(s["rest"], w, F.lit("")))) / F.length(w)).cast("long")).alias("hits"))
        echo = F.aggregate(by_length, start, step, lambda s: (s["hits"] >= 2) & (core_len(s["rest"]) <= F.greatest(F.lit(3), F.floor(core / 10))))
        flags.append(flag(echo, "context_echo"))
    flags.append(flag((dur_ms > 0) & (core * 1000 > F.greatest(dur_ms, F.lit(1000)) * most_cps), "too_dense"))
    flags.append(flag(has_loop(t) | ((F.length(t) >= 80) & (compression_ratio(t) > 3.2)), "repetition"))
    if punctuates:
        flags.append(flag((core > 150) & (F.length(t) - F.length(F.translate(t, _PUNCT, "")) < 3), "no_punct"))
    if lang is not None:
        foreign = F.lit(False)
        for name, script in _FOREIGN.items():
            foreign = foreign | ((lang == name) & t.rlike(script))
        flags.append(flag(foreign, "foreign_script"))
    return F.when(t == "", F.when(speech_ms >= 2000, F.array(F.lit("empty"))).otherwise(F.array().cast("array<string>"))).otherwise(F.array_compact(F.array(*flags)))

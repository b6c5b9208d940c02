"""Presets: rows of what a recogniser is to be run with. Each with every file, one failing without the others."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import text as T
from spanframe.operators.retry import Policy, Recogniser, isolated, recognised

#: Presets are written by people; a plan holds one branch or one row for each.
MOST_PRESETS = 1000


@dataclass(frozen=True)
class Preset:
    """env: what must be installed for it. max_clip, max_gap: seconds it works best with; 0 and null say nothing."""

    key: str
    label: str
    env: str = ""
    model: str = ""
    context: bool = True
    native_times: bool = False
    punctuates: bool = True
    max_clip: float = 0.0
    max_gap: float | None = None
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Variant:
    """A preset with other settings: clip and gap in seconds or `auto`, and options of which null takes one away."""

    key: str
    clip: str = "auto"
    gap: str = "auto"
    options: dict = field(default_factory=dict)


def find(presets: Iterable[Preset], name: str) -> Preset | None:
    """The first preset with that key or label."""
    return next((p for p in presets if (name or "").strip() in (p.key, p.label)), None)


def installed(presets: Iterable[Preset], envs: Iterable[str]) -> list[Preset]:
    """The presets whose environment is there; one that needs none always is."""
    there = {"", *envs}
    return [p for p in presets if p.env in there]


def environments(preset: Preset, aligner: str = "", diarizer: str = "") -> list[str]:
    """What a run needs: the preset's environment, an aligner's, a diarizer's; each once, and none that has no name."""
    return list(dict.fromkeys(e for e in (preset.env, aligner, diarizer) if e))


#: What separates a variant's fields, what an option looks like, and values that take one away.
FIELDS = re.compile(r"([^|]*)(?:\|([^|]*))?(?:\|([^|]*))?(?:\|([^|]*))?.*", re.S)
OPTION = re.compile(r"\s*([^=]*?)\s*=\s*(.*?)\s*", re.S)
NOTHING = {"0", "none", "None"}


def option(text: str) -> tuple[str, int | str | None]:
    """The name and value of `name=value`; digits are a number."""
    found = OPTION.fullmatch(text)
    if not found:
        raise ValueError(f"an option needs a value: {text!r}")
    name, value = found.groups()
    return name, None if value in NOTHING else int(value) if re.fullmatch(r"\d+", value) else value


def variants(spec: str) -> list[Variant]:
    """`preset|clip|gap|name=value,name=value`, several by ; or on lines of their own; what is left out is auto."""
    out = []
    for line in re.findall(r"[^;\n]*[^;\s][^;\n]*", spec):
        key, clip, gap, named = ((x or "").strip() for x in FIELDS.fullmatch(line).groups())
        out.append(Variant(key, clip or "auto", gap or "auto", dict(option(x) for x in re.findall(r"[^,]*[^,\s][^,]*", named))))
    return out


def varied(preset: Preset, variant: Variant) -> Preset:
    """The preset as a variant has it; a variant of options has a key and a label of its own."""
    if not variant.options:
        return preset
    tag = ",".join([f"{variant.clip}/{variant.gap}", *(f"{k}={v}" for k, v in variant.options.items())])
    merged = {k: v for k, v in (preset.options | variant.options).items() if v is not None}
    return Preset(**{**preset.__dict__, "key": f"{preset.key}@{tag}", "label": f"{preset.label} [{tag}]", "options": merged})


def batch_size(memory_gb: Column, model_gb: float = 4.0, per_item_gb: float = 0.5, cap: int = 128) -> Column:
    """Items that memory holds beside a model, as a power of two up to 128 and cap: of four fifths of it, 1 GB for items at least. Without memory 1."""
    items = F.floor(F.greatest(F.lit(1.0), memory_gb * 0.8 - model_gb) / per_item_gb)
    whole = F.least(F.greatest(items, F.lit(1)), F.lit(128)).cast("int")
    power = F.pow(F.lit(2), F.length(F.bin(whole)) - 1).cast("int")
    return F.when(memory_gb.isNull() | (memory_gb <= 0), 1).otherwise(F.least(power, F.lit(cap)))


def as_rows(files: DataFrame, presets: list[Preset]) -> DataFrame:
    """Every file with every preset: place, preset, label, context, punctuates, max_clip, max_gap. The presets, bounded in number, go into the plan."""
    if len(presets) > MOST_PRESETS:
        raise ValueError(f"more than {MOST_PRESETS} presets")
    kinds = {"place": "int", "preset": "string", "label": "string", "context": "boolean", "punctuates": "boolean", "max_clip": "double", "max_gap": "double"}
    rows = [F.struct(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in zip(kinds, (i, p.key, p.label, p.context, p.punctuates, p.max_clip, p.max_gap))]) for i, p in enumerate(presets)]
    none = F.array().cast("array<struct<" + ",".join(f"{k}:{t}" for k, t in kinds.items()) + ">>")
    return files.select("*", F.explode(F.array(*rows) if rows else none).alias("__p")).select(*files.columns, "__p.*")


def sweep(clips: DataFrame, files: DataFrame, presets: list[Preset], recognisers: dict[str, Recogniser], context: str = "", terms: tuple[str, ...] = (), label: str = "") -> DataFrame:
    """Runs for operators.metrics.compare(): every preset with every file (files: file_id, total_ms), a row each, with its text and flags, or the error it failed with.

    clips as operators.retry takes them. A preset without a recogniser fails for all files. A file without clips
    has an empty text. A text's parts stand in the order of their clips, by start and number.
    """
    said = None
    for p in presets:
        if p.key not in recognisers:
            continue
        done = recognised(clips, recognisers[p.key], context=context if p.context else "", terms=terms if p.context else (), label=label, policy=Policy(punctuates=p.punctuates))
        good, bad = isolated(done)
        parts = F.array_sort(F.collect_list(F.struct("start_ms", "clip_id", "text")))
        whole = good.groupBy("file_id").agg(T.joined_texts(F.transform(parts, lambda x: x["text"])).alias("text"), F.count_if(F.size("flags") > 0).cast("int").alias("flags"))
        one = whole.withColumn("error", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True).withColumn("preset", F.lit(p.key))
        said = one if said is None else said.unionByName(one)
    rows = as_rows(files, presets).select("file_id", "place", "preset", "label", (F.col("total_ms") / 1000).alias("duration"))
    if said is None:
        said = rows.limit(0).select("file_id", "preset", F.lit("").alias("text"), F.lit(0).alias("flags"), F.lit("").alias("error"))
    known = F.col("preset").isin(*recognisers) if recognisers else F.lit(False)
    both = rows.join(said, ["file_id", "preset"], "left").withColumn("error", F.when(~known, "no recogniser").otherwise(F.col("error")))
    told = lambda c, none: F.when(F.col("error").isNull(), F.coalesce(c, F.lit(none))).alias(c)
    none = F.lit(None).cast("double")
    return both.select("file_id", "place", "preset", "label", told("text", ""), none.alias("asr_sec"), none.alias("wall_sec"), none.alias("load_sec"), "duration", told("flags", 0), "error")


def first_rows(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group, in order: a preview."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__n", place).where(F.col("__n") <= n).drop("__n")


def preview(text: Column, lines: int, width: int = 200) -> Column:
    """The first lines of a text, each cut to a width; of a text with more lines how many there are."""
    all_ = F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")
    shown = F.array_join(F.transform(F.slice(all_, 1, lines), lambda x: F.substring(x, 1, width)), "\n")
    return F.when(F.size(all_) > lines, F.concat(shown, F.lit("\n… (全 "), F.size(all_).cast("string"), F.lit(" 行)"))).otherwise(shown)


def minutes_prompt(transcript: Column, system: str, instruction: str, glossary: Iterable[str] = ()) -> Column:
    """A prompt for minutes of a transcript: who is asked, what for, terms that may come up, and the transcript between marks. An empty one is null."""
    terms = [g for g in glossary if g]
    asked = instruction + ("\n\n参考: この会議で出てくる固有名詞・専門用語の候補: " + "、".join(terms) if terms else "")
    return F.when(T.strip(transcript) != "", F.concat(F.lit(f"{system}\n\n{asked}\n\n<transcript>\n"), transcript, F.lit("\n</transcript>\n")))

"""Rules that rewrite text: replacements from a list of lines, fillers, and all of it in order."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce
from operator import methodcaller

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from spanframe.functions.text import close_cjk_blanks, halfwidth, strip

#: A rule, fillers, and where a filler may stand.
RULE = r"(.*?)\s*(?:=>|→|⇒|\t)\s*(.*)"
FILLERS = ["えーっと", "えーと", "えっと", "えーー", "えー", "ええと", "あのー", "あのう", "あー", "うーん", "うーむ", "んー", "そのー", "まー", "えぇ"]
MORE_FILLERS = ["あの", "その", "まあ", "なんか", "ええ", "うん", "はい"]
BEFORE, AFTER = r"(?:(?<=^)|(?<=[、。，．,.!?！？\s「『]))", r"(?:[、，,]\s*|\s+|(?=[。．.!?！？」』]|$))"
#: What is cleaned up after fillers.
LEADING, BEFORE_STOP = r"^[、，,\s]+", r"[、，,]\s*([。．.!?！？])"


@dataclass(frozen=True)
class Rule:
    source: str
    target: str
    pattern: bool = False


def valid(source: str, target: str) -> bool:
    """Whether Python knows the pattern, and the groups that its replacement names."""
    try:
        re.compile(source)
        re.compile(source + "|").sub(target, "")
    except (re.error, IndexError):
        return False
    return True


def parse_rules(spec: str) -> list[Rule]:
    """One rule a line: wrong => right (also → ⇒ TAB); # comments; re: begins a pattern; bad patterns and empty sources are left out."""
    out = []
    for line in map(str.strip, (spec or "").splitlines()):
        m = None if line.startswith("#") else re.fullmatch(RULE, line)
        if not m or not m[1]:
            continue
        if not m[1].startswith("re:"):
            out.append(Rule(m[1], m[2]))
            continue
        if valid(m[1][3:], m[2]):
            out.append(Rule(m[1][3:], m[2], True))
    return out


def read_rules(spark: SparkSession, path: str, spec: str = "") -> list[Rule]:
    """The rules of a text (; for line ends) and of a file."""
    lines = spec.replace(";", "\n").split("\n") + [r[0] for r in spark.read.text(path).collect()]  # a list that people write
    return parse_rules("\n".join(lines))


def read_terms(spark: SparkSession, path: str, terms: list[str]) -> list[str]:
    """The terms, then those of a file that are not among them."""
    more = [w for r in spark.read.text(path).collect() for w in re.split(r"[\s、，,・･/／;；]+", r[0]) if w]  # a list that people write
    return list(dict.fromkeys([*terms, *more]))


def each_text(t: Column, work: Callable[[str], str]) -> Column:
    """work on every text, in Arrow batches; null stays null."""
    return F.pandas_udf(lambda texts: texts.map(work, na_action="ignore").astype(object), "string")(t)


def apply_rules(t: Column, rules: list[Rule]) -> Column:
    """The rules one after the other. If one is a pattern, all are applied by Python, whose syntax patterns are in: texts then go there only once."""
    if not any(r.pattern for r in rules):
        return reduce(lambda y, r: F.replace(y, F.lit(r.source), F.lit(r.target)), rules, t)
    each = [partial(re.compile(r.source).sub, r.target) if r.pattern else methodcaller("replace", r.source, r.target) for r in rules]
    return each_text(t, lambda x: reduce(lambda y, change: change(y), each, x))


def filler(words: list[str]) -> str:
    """A pattern of one filler where it may stand; of those that begin alike the longest is tried first."""
    by_length: dict[int, set[str]] = {}
    for w in words:
        by_length.setdefault(-len(w), set()).add(re.escape(w))
    lengths = ("(?:" + "|".join(sorted(by_length[n])) + ")ー*" for n in sorted(by_length))
    return BEFORE + "(?:" + "|".join(lengths) + ")" + AFTER


def remove_fillers(t: Column, words: list[str]) -> Column:
    """The text without fillers, until none is left, then without commas at its start or before a stop.

    Where one filler goes another may come about, as of several words one inside the other, so this
    is repeated until nothing changes.
    """
    named = [w for w in words if w]
    if not named:
        return t
    one, start, stop = re.compile(filler(named)), re.compile(LEADING), re.compile(BEFORE_STOP)

    def without(x: str) -> str:
        n = 1
        while n:
            x, n = one.subn("", x)
        return stop.sub(r"\1", start.sub("", x))

    return each_text(t, without)


@dataclass(frozen=True)
class Clean:
    """What is done to a text before it is shown: blanks, width, replacements, fillers, then the ends."""

    rules: tuple[Rule, ...] = ()
    fillers: tuple[str, ...] = ()
    blanks: bool = True
    width: bool = True

    def __call__(self, t: Column) -> Column:
        t = close_cjk_blanks(t) if self.blanks else t
        t = halfwidth(t) if self.width else t
        return strip(remove_fillers(apply_rules(t, list(self.rules)), list(self.fillers)))


PLAIN = Clean(blanks=False, width=False)

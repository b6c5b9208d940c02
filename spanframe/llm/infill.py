"""Fill-in-middle: a text is cut in three, and the middle put last, so that a model learns to fill gaps.

Where to cut is counted in code points. The Split pre-tokenizer of the tokenizers library, with a
pattern that matches any one code point and its matches isolated, gives each code point's offsets
without any training: their number is the text's length, and the offset at a rank is where to cut.
"""

from __future__ import annotations

import gc
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm import tokens

#: What stands before prefix, suffix and middle, unless told otherwise.
MARKS = ("<P>", "<S>", "<M>")
#: Any one code point, line ends included.
UNIT = r"[\s\S]"
#: Code points that are matched at a time (as the pattern matches one code point, texts may be cut anywhere), and of a text whose offsets are kept.
BLOCK, MOST_KEPT = 256, 16_384
CUT = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
ADDED = [f.name for f in CUT]


def splitter() -> Callable[[str], list[tuple]]:
    """A function from a text to its units, each with its offsets in the text's UTF-8 bytes."""
    from tokenizers import PreTokenizedString, Regex, pre_tokenizers

    isolated = pre_tokenizers.Split(Regex(UNIT), "isolated")

    def split(text: str) -> list[tuple]:
        whole = PreTokenizedString(text)
        isolated.pre_tokenize(whole)
        return whole.get_splits("original", "byte")

    return split


class Units:
    """How many units a text has, and where each begins. A long text's offsets are not kept, but found again for the blocks that are asked for."""

    def __init__(self, text: str, split):
        self.text, self.split = text, split
        self.upto, self.bytes = [0], [0]  # units and bytes before each block
        self.kept = [] if len(text) <= MOST_KEPT else None
        for at in range(0, len(text), BLOCK):
            offsets = split(text[at : at + BLOCK])
            self.upto.append(self.upto[-1] + len(offsets))
            self.bytes.append(self.bytes[-1] + offsets[-1][1][1])
            if self.kept is not None:
                self.kept.append(offsets)
        self.n = self.upto[-1]

    def begin(self, rank: int) -> int:
        """The byte at which the unit of that rank begins, from 0; of the rank n, where the text ends."""
        if rank == self.n:
            return self.bytes[-1]
        k = bisect_right(self.upto, rank) - 1
        offsets = self.kept[k] if self.kept is not None else self.split(self.text[k * BLOCK : (k + 1) * BLOCK])
        return self.bytes[k] + offsets[rank - self.upto[k]][1][0]


def moved(text: str, h: tuple[int, int, int, int], split, marks: tuple[str, str, str], plain_from: int, spm_below: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, length of prefix and middle, output of a text under four hashes."""
    units = Units(text, split)
    n = units.n
    if not n or h[2] % 100 >= plain_from or any(m in text for m in marks):
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    data, a, b = text.encode(), units.begin(low), units.begin(high)
    prefix, middle, suffix = data[:a].decode(), data[a:b].decode(), data[b:].decode()
    p, s, m = marks
    if h[3] % 100 < spm_below:
        return n, "spm", low, high - low, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", low, high - low, f"{p}{prefix}{s}{suffix}{m}{middle}"


def hashes(key: Column, seed: int) -> list[Column]:
    """The first four groups of eight digits of the hex SHA-256 of `seed:key`, as numbers; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def as_arrow(rows: list[tuple]) -> pa.Array:
    columns = zip(*rows) if rows else [[]] * len(ADDED)
    return pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, CUT)], fields=list(CUT))


def rearrange(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, marks: tuple[str, str, str] = MARKS, percent_moved: int = 90, percent_spm: int = 20) -> DataFrame:
    """docs with n (code points), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output (the new text).

    A null or empty text is plain and its output empty; so is, unchanged, a text that holds one of
    the marks. Cuts follow from key and seed only, so that equal rows get equal outputs and reruns
    agree; a null key counts as an empty one. Texts are taken whole, whatever their length, in
    blocks; an empty table gives no rows. Input columns named like the added ones are replaced.
    """
    if len({*marks}) != 3 or any(len(m) < 2 or m[0] in m[1:] for m in marks):
        raise ValueError("three different marks, whose first characters don't come again in them, are needed")
    if any(m[0] in other[1:] or (m != other and other.startswith(m)) for m in marks for other in marks):
        raise ValueError("no mark may begin within another one")
    docs = docs.drop(*ADDED)

    @F.arrow_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def cut(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        split = splitter()
        for texts, *hs in batches:
            # A block makes thousands of small tuples, none of them in a cycle: looking for cycles among them costs a third of the time.
            gc.disable()
            parts = [pa.array([], CUT)]
            numbers = [h.to_numpy(zero_copy_only=False) for h in hs]
            size, run = 0, []
            for i in range(len(texts)):
                run.append(moved(texts[i].as_py() or "", tuple(int(h[i]) for h in numbers), split, marks, percent_moved, percent_spm))
                size += run[-1][0]
                if size > 1_000_000:  # Arrow holds them in less than Python
                    parts.append(as_arrow(run))
                    size, run = 0, []
            parts.append(as_arrow(run))
            gc.enable()
            yield pa.concat_arrays(parts)
        tokens.rest()

    return docs.withColumn("__cut", cut(F.col(text), *hashes(F.col(key), seed))).select(*docs.columns, *[f"__cut.{c}" for c in ADDED])


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of rearrange() was made from.

    A text with a mark is plain, and no mark begins within another, so each mark stands once in what was moved.
    """
    p, s, m = marks
    body = lambda first: F.substring(output, len(first) + 1, 2147483647)
    before, after = lambda x, mark: F.substring_index(x, mark, 1), lambda x, mark: F.substring_index(x, mark, -1)
    psm = F.concat(before(body(p), s), after(output, m), before(after(body(p), s), m))
    spm = F.concat(before(after(body(s), p), m), after(output, m), before(body(s), p))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)

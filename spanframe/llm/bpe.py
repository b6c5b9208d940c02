"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words (pre-tokens) of a run of texts make a trie over their bytes, held as their
sorted list, and a depth-first walk of it gives each node the last token of the encoding of
its prefix. By the prefix property of BPE that token is the only one, ending there, that may
follow the last token of the prefix before it; so each shared prefix is computed once for all words below it, and a
word's encoding is read back along its last tokens. Two tokens may stand side by side if no
merge across their border would have come before one of their own merges.

The file of the tokenizer is a parameter; it is read on the driver and sent to the workers.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm import tokens

#: Fixed value: the pattern that splits text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of encoded words (about, with what Python adds to each) and number of token borders that a worker keeps; beyond, it starts anew. Of the trie only the walk's path is held.
MOST_BYTES, WORD_BYTES, MOST_PAIRS = 64 << 20, 240, 100_000
#: Characters that are encoded at a time.
RUN = 500_000
FAR = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    def __init__(self, spec: str):
        import regex

        d = json.loads(spec)
        letters = byte_letters()
        self.specials = {t["content"]: t["id"] for t in d["added_tokens"]}
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {as_bytes(t): i for t, i in d["model"]["vocab"].items() if t not in self.specials}
        self.token = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.specials.items()}
        self.ranks: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}  # of the merge that makes a token
        self.made: dict[int, int] = {}  # rank of that merge; single bytes: -1
        for rank, pair in enumerate(d["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = as_bytes(a), as_bytes(b)
            key = self.ids[x], self.ids[y]
            self.ranks[key] = rank
            self.parts.setdefault(self.ids[x + y], key)
            self.made.setdefault(self.ids[x + y], rank)
        self.longest = max(map(len, self.ids))
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.beside: dict[tuple[int, int], bool] = {}
        self.start_anew()

    def start_anew(self) -> None:
        self.known = {s: np.array([i], "<u4").tobytes() for s, i in self.specials.items()}
        self.held = 0

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between the two tokens standing."""
        found = self.beside.get((left, right))
        if found is not None:
            return found
        made, parts, ranks = self.made, self.parts, self.ranks
        x, y, x_gone, y_gone = left, right, FAR, FAR  # pieces at the border, and the ranks at which they are merged away
        ok = True
        while True:
            r = ranks.get((x, y))
            # Of equal ranks the leftmost merge comes first.
            if r is not None and r < x_gone and r <= y_gone:
                ok = False
                break
            x_made, y_made = made.get(x, -1), made.get(y, -1)
            if x_made < 0 and y_made < 0:
                break
            if x_made > y_made:
                x, x_gone = parts[x][1], x_made
            else:
                y, y_gone = parts[y][0], y_made
        if len(self.beside) > MOST_PAIRS:
            self.beside.clear()
        self.beside[left, right] = ok
        return ok

    def learn(self, fresh: set[str]) -> None:
        """Walks the trie of the words depth-first and keeps their encodings.

        Sorted, the distinct words are their trie's nodes with the branches in depth-first order: a
        word's shared prefix is the path that the walk stands on, cut back to where the two part.
        So only one path is held, and each prefix shared by these words is computed once.
        """
        ids, token, longest, may_follow, beside, known = self.ids, self.token, self.longest, self.may_follow, self.beside, self.known
        path, last = b"", [-1]  # last[d]: the last token of the path's first d bytes
        for word in sorted(fresh):
            data = word.encode("utf-8", "replace")
            common = 0
            for x, y in zip(path, data):
                if x != y:
                    break
                common += 1
            del last[common + 1 :]
            for depth in range(common + 1, len(data) + 1):
                state = -1
                # Only one token can stand here, so the order is free: short ones are found with fewest look-ups.
                for start in range(depth - 1, max(0, depth - longest) - 1, -1):
                    t = ids.get(data[start:depth])
                    if t is None:
                        continue
                    if start == 0:
                        state = t
                        break
                    before = last[start]
                    if before >= 0:
                        ok = beside.get((before, t))
                        if may_follow(before, t) if ok is None else ok:
                            state = t
                            break
                last.append(state)
            path = data
            out, at = [], len(data)
            while at > 0:
                out.append(last[at])
                at -= len(token[last[at]])
            out.reverse()
            known[word] = pack(f"<{len(out)}I", *out)
            self.held += WORD_BYTES + 2 * len(data) + 4 * len(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts: list[list[str]] = []
        for t in texts:
            if self.special is not None and any(s in t for s in self.specials):
                words: list[str] = []
                for k, piece in enumerate(self.special.split(t)):
                    words += [piece] if k % 2 else self.split(piece)
                parts.append(words)
            else:
                parts.append(self.split(t))
        here = set().union(*parts)
        fresh = {w for w in here if w not in self.known}
        if self.held + sum(WORD_BYTES + 3 * len(w) for w in fresh) > MOST_BYTES:
            self.start_anew()
            fresh = here - self.specials.keys()
        self.learn(fresh)
        known = self.known
        return [b"".join(map(known.__getitem__, words)) for words in parts]

    def encode_long(self, text: str) -> bytes:
        """The ids of a text of any length, some of it at a time."""
        pieces_ = [text] if any(" " in s for s in self.specials) else cut(text)
        return b"".join(self.encode([piece])[0] for piece in pieces_)

    def decode(self, ids: bytes) -> str:
        out, decoder, n = [], codecs.getincrementaldecoder("utf-8")("replace"), 4 * RUN
        for at in range(0, len(ids), n):
            out.append(decoder.decode(b"".join(map(self.token.__getitem__, np.frombuffer(ids[at : at + n], "<u4").tolist()))))
        out.append(decoder.decode(b"", True))
        return "".join(out)


def cut(text: str, size: int = RUN) -> Iterator[str]:
    """The text in pieces of about that size, cut where a pre-token must begin: before a single space between two other characters."""
    at = 0
    while len(text) - at > size:
        to = at + size
        while 0 < (to := text.find(" ", to)) and (to + 1 >= len(text) or text[to - 1].isspace() or text[to + 1].isspace()):
            to += 1
        if to <= 0:
            break
        yield text[at:to]
        at = to
    yield text[at:]


_loaded: dict[str, TrieBpe] = {}


def loaded(spec: str) -> TrieBpe:
    """The encoder of this worker process, made once."""
    name = hashlib.sha1(spec.encode()).hexdigest()
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = TrieBpe(spec)
    return _loaded[name]


def pieces(texts: pa.Array, rows: int = 1024, chars: int = RUN) -> Iterator[list[str]]:
    """The texts in runs of at most so many rows and, but for a single text, about so many characters."""
    run: list[str] = []
    size = 0
    for at in range(0, len(texts), rows):
        for t in texts.slice(at, rows).to_pylist():
            run.append(t or "")
            size += len(run[-1])
            if len(run) >= rows or size >= chars:
                yield run
                run, size = [], 0
    if run:
        yield run


def encode(docs: DataFrame, tokenizer: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """docs with ids (binary: little-endian unsigned 32-bit integers), n_tokens and, if asked for, decoded.

    A null text counts as empty and has no ids; so does an empty one. Texts are taken whole,
    whatever their length, and encoded some of it at a time; a single word is held whole. Equal rows
    get equal ids; an empty table gives no rows. Input columns named like the added ones are
    replaced. Bound Arrow batches (common.bounded_batches) while it runs, as a batch is held as
    texts, ids and decoded texts at once.
    """
    docs = docs.drop("ids", "n_tokens", "decoded")
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["ids", "n_tokens", *["decoded"] * decoded]

    @F.arrow_udf("ids binary, n_tokens long" + ", decoded string" * decoded)
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(spec.value)
        for batch in batches:
            # Arrow arrays of each run, so that objects of one run only are alive.
            ids, back = [pa.array([], pa.binary())], [pa.array([], pa.string())]
            for run in pieces(batch):
                ids.append(pa.array([bpe.encode_long(run[0])] if len(run) == 1 else bpe.encode(run), pa.binary()))
                if decoded:
                    back.append(pa.array([bpe.decode(x.as_py()) for x in ids[-1]], pa.string()))
            coded_ids = pa.concat_arrays(ids)
            n_tokens = pc.divide(pc.binary_length(coded_ids), 4).cast(pa.int64())
            yield pa.StructArray.from_arrays([coded_ids, n_tokens, *[pa.concat_arrays(back)] * decoded], names)
        bpe.start_anew()
        bpe.beside.clear()
        tokens.rest()

    return docs.withColumn("__c", coded(F.col(text))).select(*docs.columns, *[f"__c.{n}" for n in names])

"""Scores of texts under a hierarchical Pitman-Yor language model.

Each context of a word is a restaurant; its customers are the words seen there, each table serves
one word, and a table is a customer of the restaurant of the shorter context. There are three
floors: the word before (WORD_BITS and ENDING_BITS of a hash number its restaurant), under it the
last two letters of the word before (ENDING_BITS), under that one restaurant for all, under which
all known words and one unknown are equally likely. A sweep of Gibbs sampling takes all customers
of every word from their tables, floor by floor, and seats them again: those of up to DRAWN_AT_ONCE
together, by drawing how many tables they take from its exact law, more of them one by one by the
Chinese restaurant's rule. Probabilities are averaged over the sweeps that are kept.

Texts are worked on in blocks, and what they hold dealt over buckets by word: a bucket has all
restaurants' customers of its words, on all floors. What a restaurant needs of other buckets is
how many customers and tables it has in all. These totals (RESTAURANTS numbers, whatever the
corpus) are summed after each sweep, broadcast, and held while the next one runs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm import tokens
from spanframe.llm.common import forget, written

#: Restaurants: 2 ** ENDING_BITS for endings, each with 2 ** WORD_BITS for words.
ENDING_BITS, WORD_BITS = 9, 8
BITS = ENDING_BITS + WORD_BITS
RESTAURANTS = 1 << BITS
#: Tokens and documents of a block (a document is never parted), characters split at a time, bytes of text for each bucket, least buckets.
BLOCK_TOKENS, BLOCK_DOCS, RUN, BUCKET_BYTES, LEAST_BUCKETS = 1_500_000, 60_000, 1 << 20, 8 << 20, 32
#: Counts that are merged at a time, bytes of a bucket's cells that one task scores, buckets in parts that are broadcast.
FAN_IN, PART_BYTES, MOST_SENT = 1024, 64 << 20, 100_000
#: Customers of a word in a restaurant up to which all are seated in one draw, and numbers drawn from at a time.
DRAWN_AT_ONCE, DRAW_NUMBERS = 2048, 1 << 18
DISCOUNTS, STRENGTHS = (0.5, 0.8, 0.8), (1.0, 1.0, 1.0)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: of each the lowest bytes of all numbers first, as small numbers share their high ones."""
    out = [np.array([len(a) for a in arrays], "<i8").tobytes()]
    out += [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, "<i8", len(kinds)).tolist(), kinds):
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n).T).view(kind).ravel() if n else np.zeros(0, kind))
        at += n * wide
    return out


def context(word: bytes, hash_: int) -> int:
    """The number of the restaurant of what follows a word: its ending's, then one of that for the word."""
    ending = word.decode("utf-8", "surrogatepass")[-2:].encode("utf-8", "surrogatepass")
    return (crc32(ending) & (1 << ENDING_BITS) - 1) << WORD_BITS | hash_ & (1 << WORD_BITS) - 1


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash: a range of hashes, so that sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def stretches(x: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some of it at a time."""
    at = 0
    while at < len(data):
        to = at + RUN
        while to < len(data) and data[to] not in b" \t\n\v\f\r":
            to += 1
        yield data[at:to].split()
        at = to


class Block:
    """Documents whose words are counted together. The empty word stands for a text's end, and before its start."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}
        self.hashes: list[int] = []
        self.contexts: list[int] = []
        self.ids: list[np.ndarray] = []
        self.keys: list = []
        self.train: list[bool] = []
        self.sizes: list[int] = []
        self.n = 0
        self.learn([b""])

    def learn(self, words) -> None:
        for w in words:
            self.index[w] = len(self.hashes)
            h = xxhash.xxh3_64_intdigest(w)
            self.hashes.append(h)
            self.contexts.append(context(w, h))

    def add(self, key, train: bool, text: str) -> None:
        ids = []
        for words in pieces(text.encode("utf-8", "surrogatepass").lower()):  # of bytes, only A to Z have a lower case
            self.learn(set(words).difference(self.index))
            ids.append(np.fromiter(map(self.index.__getitem__, words), np.int32, len(words)))
        self.ids += [*ids, np.zeros(1, np.int32)]
        self.keys.append(key)
        self.train.append(train)
        self.sizes.append(1 + sum(map(len, ids)))
        self.n += self.sizes[-1]

    def full(self) -> bool:
        return len(self.sizes) >= BLOCK_DOCS or self.n >= BLOCK_TOKENS

    def cells(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """For each bucket: hashes of its words, entries of each, and of each entry context, document and times; then which documents are learned from."""
        ids, sizes = np.concatenate(self.ids), np.array(self.sizes)
        before = np.concatenate([[0], ids[:-1]])
        before[np.cumsum(sizes)[:-1]] = 0
        hashes = np.array(self.hashes, np.uint64)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        hashes = hashes[order]
        key = rank[ids] << np.uint64(BITS + 16) | np.array(self.contexts, np.uint64)[before] << np.uint64(16) | np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
        del ids, before
        key.sort()
        first = stretches(key)
        times = np.diff(np.append(first, len(key))).astype(np.uint32)
        key = key[first]
        word = (key >> np.uint64(BITS + 16)).astype(np.int64)
        where, doc = (key >> np.uint64(16) & np.uint64(RESTAURANTS - 1)).astype(np.uint32), (key & np.uint64(0xFFFF)).astype(np.uint16)
        train = np.packbits(self.train)
        bucket = bucket_of(hashes, buckets)
        starts = stretches(bucket)
        for a, b in zip(starts, np.append(starts[1:], len(hashes))):
            i, j = np.searchsorted(word, [a, b])
            yield int(bucket[a]), pack(np.diff(hashes[a:b], prepend=np.uint64(0)), np.bincount(word[i:j] - a, minlength=b - a).astype(np.uint32), where[i:j], doc[i:j], times[i:j], train)


CELL = (np.uint64, np.uint32, np.uint32, np.uint16, np.uint32, np.uint8)
COUNTS = (np.uint64, np.uint32, np.uint32, np.int64)


def counted(cell: bytes) -> bytes:
    """How often a cell's words follow each context in the documents to learn from: hashes, pairs of each, and of each pair context and count."""
    hashes, per, where, doc, times, train = unpack(cell, *CELL)
    word = np.repeat(np.arange(len(hashes)), per)
    pair = word << BITS | where
    first = stretches(pair)
    n = np.add.reduceat(times * np.unpackbits(train)[doc].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    first, n = first[n > 0], n[n > 0]
    kept, per = np.unique(word[first], return_counts=True)
    return pack(np.diff(np.cumsum(hashes, dtype=np.uint64)[kept], prepend=np.uint64(0)), per.astype(np.uint32), where[first], n)


def merged(parts: list[bytes]) -> bytes:
    """Counts of the same bucket as one."""
    rows = [unpack(x, *COUNTS) for x in parts]
    hashes = np.concatenate([np.repeat(np.cumsum(h, dtype=np.uint64), per) for h, per, _, _ in rows])
    values, word = np.unique(hashes, return_inverse=True)
    del hashes
    key = word.astype(np.int64) << BITS | np.concatenate([r[2] for r in rows])
    order = np.argsort(key, kind="stable")
    key, n = key[order], np.concatenate([r[3] for r in rows])[order]
    first = stretches(key)
    n = np.add.reduceat(n, first) if len(first) else n
    key = key[first]
    return pack(np.diff(values, prepend=np.uint64(0)), np.bincount(key >> BITS, minlength=len(values)).astype(np.uint32), (key & RESTAURANTS - 1).astype(np.uint32), n)


@lru_cache(maxsize=8)
def ways(discount: float, most: int) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: [n, t] of all ways to seat n customers at t tables, each as likely as the product of what the customers who joined were drawn by."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for n in range(most):
        with np.errstate(divide="ignore"):
            joined = out[n, 1:] + np.log(np.maximum(n - discount * np.arange(1, most + 1), 0))
        out[n + 1, 1:] = np.logaddexp(out[n, :-1], joined)
    return out


def tables_of(n: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """How many tables n customers take (up to DRAWN_AT_ONCE), drawn from the law that moving each of them without end leads to."""
    out = n.astype(np.int64)
    order = np.argsort(n, kind="stable")
    starts = stretches(n[order])
    logs = ways(discount, DRAWN_AT_ONCE)
    for a, b in zip(starts, np.append(starts[1:], len(n))):
        m = int(n[order[a]])
        if m < 2:
            continue
        step = max(1, DRAW_NUMBERS // m)
        for i in range(a, b, step):
            who = order[i : min(i + step, b)]
            mass = logs[m, 1 : m + 1] + np.log(np.maximum(pull[who], 1e-300))[:, None] * np.arange(m)
            mass -= mass.max(axis=1, keepdims=True)
            upto = np.cumsum(np.exp(mass), axis=1)
            out[who] = np.minimum(m, 1 + (upto <= rng.random(len(who))[:, None] * upto[:, -1:]).sum(axis=1))
    return out


def seated(sizes: np.ndarray, n: int, pull: float, discount: float, times: int, rng: np.random.Generator) -> np.ndarray:
    """The tables of one word, of these sizes: customers leave or come until there are n, then so many times each of them leaves and is seated again."""
    size, seat = sizes.tolist(), np.repeat(np.arange(len(sizes)), sizes).tolist()
    empty: list[int] = []
    draw = chain.from_iterable(rng.random(1 << 14).tolist() for _ in repeat(None)).__next__
    tables = len(size)
    # Until there are n, one at random leaves, or there is one more to seat; then each in turn leaves and is to be seated.
    over, short = max(0, len(seat) - n), max(0, n - len(seat))
    turns = chain(repeat(-1, over), repeat(-2, short), chain.from_iterable(repeat(range(n), times if n > 1 else 0)))
    for at in turns:
        left = len(seat)
        if at != -2:
            at_random = at == -1
            if at_random:
                at = int(draw() * left)
            left -= 1
            k = seat[at]
            # The one in turn stands at the end of the row from now on, whose last one has the place.
            seat[at] = seat[left]
            size[k] -= 1
            if not size[k]:
                tables -= 1
                empty.append(k)
            if at_random:
                seat.pop()
                continue
        else:
            seat.append(0)
        old = left - discount * tables
        if draw() * (old + pull) >= old:
            tables += 1
            if empty:
                k = empty.pop()
            else:
                k = len(size)
                size.append(0)
        else:
            k = seat[int(draw() * left)]
            while draw() * size[k] >= size[k] - discount:  # a table draws as its customers less the discount
                k = seat[int(draw() * left)]
        size[k] += 1
        if at < 0:
            seat[left] = k
        else:
            seat[left], seat[at] = seat[at], k
    return np.array([x for x in size if x], np.int64)


class Floor:
    """The customers (n) and tables (t) of each word in each restaurant of a floor. Tables are held of the entries that can have more than one customer."""

    def __init__(self, n: np.ndarray, most: np.ndarray, discount: float):
        """most: how many customers an entry can come to have. Begins with about as many tables as the rule gives in the long run, all but the first with one customer: any seating may be a sampler's first."""
        self.n, self.discount = n.astype(np.int64), discount
        self.live = np.flatnonzero(most > 1)
        self.many = np.flatnonzero(most > DRAWN_AT_ONCE)
        self.few = np.flatnonzero((most > 1) & (most <= DRAWN_AT_ONCE))
        self.t = np.ones(len(n), np.int64)
        own = self.n[self.live]
        tables = np.minimum(np.maximum(own**discount, 1).astype(np.int64), own)
        self.t[self.live] = tables
        self.lay([])

    def lay(self, sizes: list[np.ndarray]) -> None:
        """Tables as t counts them: those of the entries with many customers of these sizes; of others, or without sizes, all but the first have one."""
        self.owner = np.repeat(self.live, self.t[self.live])
        self.size = np.ones(len(self.owner), np.int64)
        first = stretches(self.owner)
        self.size[first] = (self.n - self.t + 1)[self.owner[first]]
        for a, x in zip(np.searchsorted(self.owner, self.many), sizes):
            self.size[a : a + len(x)] = x

    def settle(self, owner: np.ndarray) -> None:
        """Empty tables go, and new ones with one customer come, in order."""
        keep = self.size > 0
        at = np.searchsorted(self.owner[keep], owner, side="right")
        self.owner, self.size = np.insert(self.owner[keep], at, owner), np.insert(self.size[keep], at, 1)

    def line(self, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All customers in a row, by their tables: up to which each table's stand, and behind which those of `who` begin."""
        upto = np.cumsum(self.size)
        first = np.searchsorted(self.owner, who)
        return upto, upto[first] - self.size[first]

    def leave(self, who: np.ndarray, rng: np.random.Generator) -> None:
        """A customer of each of the words (each once) leaves; a table may be left empty until one comes."""
        upto, before = self.line(who)
        table = np.searchsorted(upto, before + (rng.random(len(who)) * self.n[who]).astype(np.int64), side="right")
        self.size[table] -= 1
        self.n[who] -= 1
        self.t[who] -= self.size[table] == 0

    def come(self, who: np.ndarray, pull: np.ndarray, rng: np.random.Generator) -> None:
        """A customer of each of the words (each once) is seated; pull: how much a new table draws, for each of them."""
        old = self.n[who] - self.discount * self.t[who]
        new = rng.random(len(who)) * (old + pull) >= old
        joins = who[~new]
        upto, before = self.line(joins)
        left = np.arange(len(joins))
        sit = []
        while len(left):  # a table draws as its customers less the discount
            table = np.searchsorted(upto, before[left] + (rng.random(len(left)) * self.n[joins[left]]).astype(np.int64), side="right")
            size = self.size[table]
            ok = rng.random(len(left)) * size < size - self.discount
            sit.append(table[ok])
            left = left[~ok]
        for table in sit:
            self.size[table] += 1
        self.n[who] += 1
        self.t[who[new]] += 1
        self.settle(who[new])

    def reseat(self, n: np.ndarray, pull: np.ndarray, times: int, rng: np.random.Generator) -> None:
        """All customers of every word, n from now on, are seated anew: so many times one by one, or where they are few in one draw, after which further ones would change nothing."""
        lo, hi = np.searchsorted(self.owner, self.many), np.searchsorted(self.owner, self.many, side="right")
        anew = [seated(self.size[a:b], int(n[i]), float(pull[i]), self.discount, times, rng) for i, a, b in zip(self.many, lo, hi)]
        self.n = n.astype(np.int64)
        self.t[self.many] = [len(x) for x in anew]
        self.t[self.few] = tables_of(self.n[self.few], pull[self.few], self.discount, rng)
        # Of few customers only the number of tables counts.
        self.lay(anew)

    def sizes(self) -> np.ndarray:
        """Those of the tables of the entries with many customers, one after the other."""
        return self.size[np.isin(self.owner, self.many)]

    def restore(self, n: np.ndarray, t: np.ndarray, sizes: np.ndarray) -> None:
        """The seats that had n customers at t tables, and these sizes()."""
        self.n, self.t = n.astype(np.int64), t.astype(np.int64)
        self.lay(np.split(sizes, np.cumsum(self.t[self.many])[:-1]) if len(self.many) else [])

    def move(self, pull: np.ndarray, times: int, rng: np.random.Generator) -> None:
        """So many times, a customer of every word that has more than one leaves and is seated again."""
        who = self.live[self.n[self.live] > 1]
        pull = pull[who]
        for _ in range(times if len(who) else 0):
            self.leave(who, rng)
            self.come(who, pull, rng)


@dataclass(frozen=True)
class Totals:
    """Of the floors from the lowest: tables of each restaurant. Customers of a floor are the tables above; those of the highest are counted."""

    tables: tuple[np.ndarray, np.ndarray, np.ndarray]
    customers: np.ndarray
    words: int

    @property
    def all_customers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.tables[1].sum(keepdims=True), self.tables[2].reshape(-1, 1 << WORD_BITS).sum(axis=1), self.customers


@dataclass
class Bucket:
    """The restaurants' customers that are words of one bucket, floor by floor."""

    hashes: np.ndarray
    words: tuple[np.ndarray, ...]  # of each entry of a floor, the place of its parent's entry
    where: tuple[np.ndarray, ...]  # and its restaurant
    floors: list[Floor] = field(default_factory=list)

    @staticmethod
    def of(model: bytes, discounts) -> Bucket:
        hashes, per, where, n = unpack(model, *COUNTS)
        pair = np.repeat(np.arange(len(hashes)), per) << ENDING_BITS | where >> WORD_BITS
        first = stretches(pair)
        endings, parent = pair[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pair))))
        words = endings >> ENDING_BITS
        out = Bucket(np.cumsum(hashes, dtype=np.uint64), (np.zeros(len(hashes), np.int64), words, parent), (np.zeros(len(hashes), np.int64), endings & (1 << ENDING_BITS) - 1, where.astype(np.int64)))
        most = np.bincount(parent, n, len(endings))
        top = Floor(n, n, discounts[2])
        middle = Floor(np.bincount(parent, top.t, len(endings)), most, discounts[1])
        out.floors = [Floor(np.bincount(words, middle.t, len(hashes)), np.bincount(words, most, len(hashes)), discounts[0]), middle, top]
        return out

    def tables(self) -> np.ndarray:
        """The tables of all restaurants of all floors, the highest first."""
        return np.concatenate([np.bincount(self.where[k], self.floors[k].t, n).astype(np.int64) for k, n in ((2, RESTAURANTS), (1, 1 << ENDING_BITS), (0, 1))])

    def likely(self, k: int, totals: Totals, under: np.ndarray, strengths) -> np.ndarray:
        """The probability of each entry's word in its restaurant on floor k, given that of its parent's entry."""
        f, at = self.floors[k], self.where[k]
        return (f.n - f.discount * f.t + (strengths[k] + f.discount * totals.tables[k][at]) * under) / (strengths[k] + totals.all_customers[k][at])

    def sweep(self, totals: Totals, moves: int, strengths, rng: np.random.Generator) -> None:
        even = np.full(len(self.hashes), 1 / (totals.words + 1))
        under = [even]
        for k in (0, 1):
            under.append(self.likely(k, totals, under[k], strengths)[self.words[k + 1]])
        for k in (2, 1, 0):
            f = self.floors[k]
            pull = (strengths[k] + f.discount * totals.tables[k][self.where[k]]) * under[k]
            n = np.bincount(self.words[k + 1], self.floors[k + 1].t, len(f.n)).astype(np.int64) if k < 2 else f.n
            f.reseat(n, pull, moves, rng)

    def seats(self) -> bytes:
        """What restored() needs beside the counts: small, as most entries have one table."""
        return pack(*(x for f in self.floors for x in (f.t.astype(np.uint32), f.sizes())))

    @staticmethod
    def restored(model: bytes, seats: bytes, discounts) -> Bucket:
        out = Bucket.of(model, discounts)
        kept = unpack(seats, *(np.uint32, np.int64) * 3)
        for k in (2, 1, 0):
            f = out.floors[k]
            n = np.bincount(out.words[k + 1], out.floors[k + 1].t, len(f.n)) if k < 2 else f.n
            f.restore(n, kept[2 * k], kept[2 * k + 1])
        return out

    def found(self, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys (word's place and restaurant) have an entry on floor k, and where."""
        own = (self.words[1][self.words[2]] << BITS | self.where[2]) if k == 2 else self.words[1] << ENDING_BITS | self.where[1]
        at = np.minimum(np.searchsorted(own, keys), max(0, len(own) - 1))
        return (own[at] == keys if len(own) else np.zeros(len(keys), bool)), at

    def probability(self, known: np.ndarray, word: np.ndarray, where: np.ndarray, totals: Totals, strengths, at) -> np.ndarray:
        """Of words (places, if known) after contexts: down the floors, then back."""
        ending = where >> WORD_BITS
        p = np.full(len(word), 1 / (totals.words + 1))
        for k, place, (ok, i) in zip(range(3), (np.zeros_like(ending), ending, where), at):
            f = self.floors[k]
            seen = np.where(ok, f.n[i] - f.discount * f.t[i], 0) if len(f.n) else 0.0
            p = (seen + (strengths[k] + f.discount * totals.tables[k][place]) * p) / (strengths[k] + totals.all_customers[k][place])
        return p


@dataclass(frozen=True)
class Model:
    """buckets: a row for each bucket with its counts, and its seats after each of the last `keep` sweeps. totals[s]: those that sweep s begins with; the last are those after the last sweep."""

    buckets: DataFrame
    n_buckets: int
    cells: DataFrame
    train_tokens: int
    totals: list[Totals]
    moves: int
    keep: int
    seed: int
    discounts: tuple[float, float, float]
    strengths: tuple[float, float, float]


def replayed(model: bytes, bucket: int, totals: list[Totals], sweeps: int, moves: int, seed: int, discounts, strengths) -> Iterator[Bucket]:
    """A bucket before the first sweep and after each, which follows from the counts, the totals and the seed. fit() and scores() take kept seats instead, which are the same and cost less."""
    out = Bucket.of(model, discounts)
    yield out
    for s in range(sweeps):
        out.sweep(totals[s], moves, strengths, np.random.default_rng([seed, bucket, s]))
        yield out


def packed(docs: DataFrame, key: str, text: str, train: Column, buckets: int) -> DataFrame:
    """blk, bucket, data: cells of blocks, and with bucket -1 the block's documents (an Arrow stream of key, train and n_tokens)."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, kind = TaskContext.get().partitionId(), 0, None

        def closed(block: Block) -> pa.RecordBatch:
            listed = pa.record_batch([pa.array(block.keys, kind), pa.array(block.train, pa.bool_()), pa.array(block.sizes, pa.int64())], ["key", "train", "n_tokens"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, listed.schema) as out:
                out.write_batch(listed)
            cells = [(-1, sink.getvalue().to_pybytes()), *block.cells(buckets)]
            return pa.record_batch([pa.array([part << 32 | k] * len(cells), pa.int64()), pa.array([b for b, _ in cells], pa.int64()), pa.array([x for _, x in cells], pa.binary())], ["blk", "bucket", "data"])

        block = Block()
        for batch in batches:
            kind = batch.schema.field("key").type
            for name, learned, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                block.add(name, learned, t.as_py() or "")
                if block.full():
                    yield closed(block)
                    block, k = Block(), k + 1
        if block.keys:
            yield closed(block)
        tokens.rest()

    return rows.mapInArrow(each, "blk long, bucket long, data binary")


def summed(rows: DataFrame, salts: int) -> np.ndarray:
    """The sum of the arrays in rows (salt, sums): by salt in tasks, then here; RESTAURANTS numbers each."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            for x in batch.column("sums"):
                part = unpack(x.as_py(), np.int64)[0]
                sums = part if sums is None else sums + part
        if sums is not None:
            yield pa.record_batch([pa.array([pack(sums)], pa.binary())], ["sums"])

    parts = [unpack(r.sums, np.int64)[0] for r in rows.repartition(salts, "salt").mapInArrow(total, "sums binary").collect()]
    return sum(parts[1:], parts[0]) if parts else np.zeros(0, np.int64)


def fit(docs: DataFrame, key: str, text: str, train: Column, sweeps: int = 2, keep: int = 2, moves: int = 2, seed: int = 1, discounts=DISCOUNTS, strengths=STRENGTHS) -> Model:
    """Learns from the documents for which train is true, all of them and whole; the rest is only laid out to be scored.

    Words are compared by 64 bits of a hash. Nulls are as in scores(). moves: how often a sweep seats all customers of a word anew.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(size / BUCKET_BYTES))
    cells = written(packed(docs, key, text, train, buckets), "cells")

    def to_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.record_batch([batch.column("bucket").slice(i, 1), batch.column("blk").slice(i, 1), pa.array([counted(batch.column("data")[i].as_py())], pa.binary())], ["bucket", "grp", "data"])

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "grp": table.column("grp").slice(0, 1), "data": pa.array([merged([x.as_py() for x in table.column("data")])], pa.binary())})

    rows = cells.where("bucket >= 0").mapInArrow(to_counts, "bucket long, grp long, data binary")
    blocks = cells.where("bucket < 0").count()
    while blocks > FAN_IN:  # a frequent word has an entry in every block
        blocks = -(-blocks // FAN_IN)
        rows = rows.withColumn("grp", F.pmod(F.xxhash64("grp", F.lit(blocks)), F.lit(blocks))).groupBy("bucket", "grp").applyInArrow(merge, "bucket long, grp long, data binary")
    rows = rows.groupBy("bucket").applyInArrow(merge, "bucket long, grp long, data binary")
    model = written(rows.select("bucket", "data"), "model")
    salts = max(1, min(64, buckets // 64))

    def sums_of(rows: DataFrame) -> np.ndarray:
        return summed(rows.select(F.pmod("salt", F.lit(salts)).alias("salt"), "sums"), salts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in batches:
            for data in batch.column("data"):
                x = Bucket.of(data.as_py(), discounts)
                sums = np.concatenate([x.tables(), np.bincount(x.where[2], x.floors[2].n, RESTAURANTS).astype(np.int64), [len(x.hashes)]])
                part = sums if part is None else part + sums
        if part is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pack(part)], pa.binary())], ["salt", "sums"])
        tokens.rest()

    def swept(rows: DataFrame, s: int, totals: Broadcast) -> DataFrame:
        """After sweep s: the buckets with their seats; and in rows without a bucket, each task's sums of tables."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, task = None, TaskContext.get().partitionId()
            row = lambda bucket, data, seats, sums: pa.record_batch([pa.array([bucket], pa.int64()), pa.array([data], pa.binary()), pa.array([seats], pa.list_(pa.binary())), pa.array([task], pa.int64()), pa.array([sums], pa.binary())], ["bucket", "data", "seats", "salt", "sums"])
            for batch in batches:
                for bucket, data, seats in zip(*(batch.column(c) for c in ("bucket", "data", "seats"))):
                    bucket, data, seats = bucket.as_py(), data.as_py(), seats.as_py()
                    x = Bucket.restored(data, seats[-1], discounts) if seats else Bucket.of(data, discounts)
                    x.sweep(totals.value, moves, strengths, np.random.default_rng([seed, bucket, s]))
                    part = x.tables() if part is None else part + x.tables()
                    yield row(bucket, data, [*seats, x.seats()][-max(1, keep) :], None)
            if part is not None:
                yield row(None, None, None, pack(part))
            tokens.rest()

        return rows.mapInArrow(each, "bucket long, data binary, seats array<binary>, salt long, sums binary")

    def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = RESTAURANTS, RESTAURANTS + (1 << ENDING_BITS)
        return x[b : b + 1], x[a:b], x[:a]

    x = sums_of(model.mapInArrow(first, "salt long, sums binary"))
    if not len(x):
        x = np.zeros(2 * RESTAURANTS + (1 << ENDING_BITS) + 2, np.int64)
    customers, words = x[-1 - RESTAURANTS : -1], int(x[-1])
    totals = [Totals(split(x), customers, words)]
    model = model.withColumn("seats", F.array().cast("array<binary>"))
    for s in range(sweeps):
        held = spark.sparkContext.broadcast(totals[-1])
        rows = written(swept(model, s, held), "seats")
        forget(spark)  # the table that the sweep has read
        model, x = rows.where("bucket IS NOT NULL").select("bucket", "data", "seats"), sums_of(rows.where("bucket IS NULL"))
        totals = [*totals, Totals(split(x) if len(x) else totals[0].tables, customers, words)]
        held.destroy()
    return Model(model, buckets, cells, int(customers.sum()), totals, moves, keep, seed, discounts, strengths)


def scores(model: Model, kind: str = "long") -> DataFrame:
    """key, train, n_tokens, n_known, base_score, score of every document that fit() has seen.

    Tokens are the words with A to Z lower-cased and one end; known ones were learned. base_score: the
    text's log10 probability by counts and one more; score: by the model. A null or empty text has
    only its end; a null `train` is not learned from; null and repeated keys are rows like others.
    Without anything to learn from, only the unknown is likely and scores are 0. Texts are taken
    whole; an empty table gives no rows. kind: Spark's type of key.
    """
    spark = model.cells.sparkSession
    totals, keep = spark.sparkContext.broadcast(model.totals[-model.keep :]), model.keep
    n, v = model.train_tokens, model.totals[0].words
    discounts, strengths = model.discounts, model.strengths

    def score(cells: pa.Table, models: pa.Table) -> pa.Table:
        """Per block of the cells: documents, their sums of log10 probabilities by the model and by counts, and their known tokens."""
        data = models.column("data")[0].as_py() if models.num_rows else pack(*(np.zeros(0, k) for k in COUNTS))
        seats = models.column("seats")[0].as_py() if models.num_rows else []
        asked, states = [unpack(x.as_py(), *CELL) for x in cells.column("data")] if cells.num_rows else [], None
        entries = []
        for s in range(len(totals.value)):
            k = s - len(totals.value) + len(seats)  # where fewer sweeps were made than are kept, the first state counts too
            state = Bucket.restored(data, seats[k], discounts) if k >= 0 and seats else Bucket.of(data, discounts)
            if states is None:
                states = np.bincount(state.words[1][state.words[2]], state.floors[2].n, len(state.hashes)) if len(state.hashes) else np.zeros(0)
                for hashes, per, where, doc, times, _ in asked:
                    hashes = np.cumsum(hashes, dtype=np.uint64)
                    at = np.minimum(np.searchsorted(state.hashes, hashes), max(0, len(state.hashes) - 1))
                    known = state.hashes[at] == hashes if len(state.hashes) else np.zeros(len(hashes), bool)
                    word, known = np.repeat(at, per), np.repeat(known, per)
                    where = where.astype(np.int64)
                    found = [(known, word)]
                    for k, place, bits in ((1, where >> WORD_BITS, ENDING_BITS), (2, where, BITS)):
                        ok, i = state.found(word << bits | place, k)
                        found.append((ok & known, i))
                    count = np.where(known, states[word], 0) if len(states) else np.zeros(len(word))
                    entries.append([known, word, where, doc, times, found, count, np.zeros(len(word))])
            for e in entries:
                e[-1] += state.probability(e[0], e[1], e[2], totals.value[s], strengths, e[5])
        out = []
        for known, _, _, doc, times, _, count, p in entries:
            docs = np.unique(doc)
            tally = lambda x: np.bincount(doc, x, int(docs[-1]) + 1)[docs]  # noqa: B023, E731
            out.append(pack(docs, tally(np.log10(p / keep) * times), tally(np.log10((count + 1) / (n + v + 1)) * times), tally(known * times).astype(np.int64)))
        return pa.table({"blk": cells.column("blk"), "bucket": cells.column("bucket"), "data": pa.array(out, pa.binary())}) if out else pa.table({"blk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})

    # A bucket with a word that is everywhere has many cells: it is scored in parts, each beside the bucket's counts.
    cells, beside = model.cells.where("bucket >= 0"), model.buckets
    sizes = cells.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("data")) / PART_BYTES).alias("parts"))
    hot = sizes.where("parts > 1").collect()  # at most one for every PART_BYTES of cells; most often none
    if hot:
        parts = spark.createDataFrame(hot, "bucket long, parts long")
        parts = F.broadcast(parts) if len(hot) <= MOST_SENT else parts
        one = F.coalesce("parts", F.lit(1).cast("long"))
        cells = cells.join(parts, "bucket", "left").withColumn("part", F.pmod(F.xxhash64("blk"), one)).drop("parts")
        beside = beside.join(parts, "bucket", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("parts")
    else:
        cells, beside = (x.withColumn("part", F.lit(0).cast("long")) for x in (cells, beside))
    sums = cells.groupBy("bucket", "part").cogroup(beside.groupBy("bucket", "part")).applyInArrow(score, "blk long, bucket long, data binary")

    def total(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("bucket").to_pylist(), table.column("data").to_pylist()))
        docs = pa.ipc.open_stream(rows[0][1]).read_all()
        known, base, score_ = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows), np.zeros(docs.num_rows)
        for _, data in rows[1:]:
            at, s, b, k = unpack(data, np.uint16, np.float64, np.float64, np.int64)
            score_[at] += s
            base[at] += b
            known[at] += k
        return docs.append_column("n_known", pa.array(known)).append_column("base_score", pa.array(base)).append_column("score", pa.array(score_))

    every = model.cells.where("bucket < 0").unionByName(sums)
    return every.groupBy("blk").applyInArrow(total, f"key {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")

"""Spelling variants: words one inserted, deleted or replaced letter apart, and the form that each belongs to.

The words of a corpus, sorted, are cut into shards, each of them a compact trie: a branch that
leads to one word only is a leaf, and nodes are ranges of one sorted list of edges. Shards are
broadcast, some at a time within a bound of bytes, and the automaton that accepts what is one edit
from a word is walked through every shard depth-first: along the word's own path, and at each of
its nodes along each edit to its end. The words of a batch take their steps together, in numpy.

Letters are code points up to U+00FF, so that one is one byte of Latin-1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm import tokens
from spanframe.llm.common import written

LETTERS, OTHER = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]")
#: Characters that are searched for words at a time, and distinct words counted before their counts are given on.
RUN, MOST_COUNTED = 1_000_000, 200_000
#: Words and letters of a shard, bytes of the shards that are broadcast at a time, words whose automata are walked together.
SHARD_WORDS, SHARD_LETTERS, ROUND_BYTES, BATCH = 50_000, 2_000_000, 32 << 20, 4096


def runs(text: str) -> Iterator[list[str]]:
    """The maximal runs of letters of a text with A to Z lower-cased, some of it at a time."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes, only A to Z have a lower case
    at = 0
    while at < len(low):
        end = OTHER.search(low, at + RUN) if len(low) - at > RUN else None
        to = end.start() if end else len(low)
        yield LETTERS.findall(low, at, to)
        at = to


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 5, least_n: int = 3, drop_every: int | None = None) -> DataFrame:
    """word, n: the words of whole texts of at least so many letters that occur at least so often in all of them.

    A null text has no words, a null key counts as an empty one, a repeated row counts again. With
    drop_every, a word whose CRC-32 of `key:word` that number divides loses the letter at that
    hash modulo its length: misspellings that are known.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                seed = crc32(f"{'' if name is None else name}:".encode())
                for words in runs(t.as_py() or ""):
                    for w, k in Counter(words).items():
                        if drop_every:
                            h = crc32(w.encode(), seed)
                            if h % drop_every == 0:
                                i = h % len(w)
                                w = w[:i] + w[i + 1 :]
                        if len(w) >= least_letters:
                            found[w] += k
                    if len(found) > MOST_COUNTED:
                        yield pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
                        found = Counter()
        yield pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
        tokens.rest()

    parts = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(partial, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def common(a: bytes, b: bytes) -> int:
    """How many letters two words begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # alike up to low, not up to high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


class Trie:
    """A shard: sorted words and their counts, edges sorted by node and letter, and of each node which word ends in it, and from what depth on a leaf holds the rest of its word."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts
        self.letters, self.ends, self.n = parts["letters"], parts["ends"], parts["n"]
        self.edges, self.child, self.word, self.depth = parts["edges"], parts["child"], parts["word"], parts["depth"]
        self.first = np.searchsorted(self.edges, np.arange(len(self.word) + 1, dtype=np.int64) << 8)
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.length = self.ends - self.begins
        self.text = self.letters.tobytes()

    @staticmethod
    def of(words: list[bytes], n: list[int]) -> Trie:
        edges: list[int] = []
        word, depth, path, before = [-1], [0], [0], 0  # path[d]: the node of the word's first d letters

        def grow(parent: int, letter: int) -> int:
            edges.append(parent << 8 | letter)
            word.append(-1)
            depth.append(0)
            return len(edges)

        for k, w in enumerate(words):
            after = common(w, words[k + 1]) if k + 1 < len(words) else 0
            shared = max(before, after)
            del path[before + 1 :]
            for d in range(before, shared):
                path.append(grow(path[-1], w[d]))
            node = path[-1]
            if len(w) > shared:
                node = grow(node, w[shared])
                depth[node] = shared + 1
            word[node] = k
            before = after
        order = np.argsort(np.array(edges, np.int64), kind="stable")
        return Trie({
            "letters": np.frombuffer(b"".join(words), np.uint8), "ends": np.cumsum([len(w) for w in words], dtype=np.int64), "n": np.array(n, np.int64),
            "edges": np.array(edges, np.int64)[order], "child": (order + 1).astype(np.int32), "word": np.array(word, np.int32), "depth": np.array(depth, np.int32),
        })

    def dump(self) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([(k, pa.large_binary()) for k in self.parts])) as out:
            out.write_batch(pa.record_batch([pa.array([v.tobytes()], pa.large_binary()) for v in self.parts.values()], list(self.parts)))
        return sink.getvalue().to_pybytes()

    @staticmethod
    def load(data: bytes) -> Trie:
        kinds = {"letters": np.uint8, "ends": np.int64, "n": np.int64, "edges": np.int64, "child": np.int32, "word": np.int32, "depth": np.int32}
        row = pa.ipc.open_stream(data).read_next_batch()
        return Trie({k: np.frombuffer(row.column(k)[0].as_buffer(), kind) for k, kind in kinds.items()})

    def near(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places: in words, and in the shard's words, exactly one edit apart, each pair once."""
        length = np.array([len(w) for w in words], np.int64)
        begins = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def step(who: np.ndarray, node: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Which of the states have an edge for their word's letter, and where it leads."""
            keys = node.astype(np.int64) << 8 | flat[begins[who] + at]
            k = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
            ok = self.edges[k] == keys
            return ok, self.child[k[ok]]

        def follow(who: np.ndarray, node: np.ndarray, at: np.ndarray) -> None:
            """States after their one edit: what is left of the word must be there as it is."""
            while len(who):
                leaf = self.depth[node] > 0
                if leaf.any():
                    w, k, i = who[leaf], self.word[node[leaf]], at[leaf]
                    rest = length[w] - i
                    same = rest == self.length[k] - self.depth[node[leaf]]
                    same &= (rest == 0) | (flat[begins[w] + length[w] - 1] == self.letters[self.ends[k] - 1])
                    w, k, i = w[same], k[same], i[same]
                    same = np.array([words[a][c:] == self.text[b - len(words[a]) + c : b] for a, b, c in zip(w.tolist(), self.ends[k].tolist(), i.tolist())], bool)
                    found.append((w[same], k[same]))
                    who, node, at = who[~leaf], node[~leaf], at[~leaf]
                over = at == length[who]
                done = over & (self.word[node] >= 0)
                found.append((who[done], self.word[node[done]]))
                who, node, at = who[~over], node[~over], at[~over]
                ok, node = step(who, node, at)
                who, at = who[ok], at[ok] + 1

        who, node, i = np.arange(len(words)), np.zeros(len(words), np.int32), 0
        while len(who):
            more = i < length[who]
            letter = flat[begins[who] + np.where(more, i, 0)]
            # An edit that gives what another one gives is left out: of equal letters in a row only the first is deleted, and a letter is inserted behind its equals.
            gone = more if i == 0 else more & (letter != flat[begins[who] + i - 1])
            kids = self.first[node + 1] - self.first[node]
            each = np.repeat(np.arange(len(who)), kids)
            edge = self.first[node][each] + np.arange(len(each)) - (np.cumsum(kids) - kids)[each]
            other = ~more[each] | ((self.edges[edge] & 255) != letter[each])
            each, to = each[other], self.child[edge[other]]
            put = more[each]
            follow(
                np.concatenate([who[gone], who[each[put]], who[each]]),
                np.concatenate([node[gone], to[put], to]),
                np.concatenate([np.full(int(gone.sum() + put.sum()), i + 1), np.full(len(each), i)]),
            )
            who, node = who[more], node[more]
            ok, node = step(who, node, np.full(len(who), i))
            who, i = who[ok], i + 1
            leaf = self.depth[node] > 0
            own = [(w, k) for w, k in zip(who[leaf].tolist(), self.word[node[leaf]].tolist()) if one_apart(words[w], self.text[self.begins[k] : self.ends[k]])]
            if own:
                found.append(tuple(np.array(x) for x in zip(*own)))
            who, node = who[~leaf], node[~leaf]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # A leaf that a word's own path ends in may have been met along an edit before it too.
        pairs = np.unique(np.concatenate([x for x, _ in found]).astype(np.int64) * len(self.n) + np.concatenate([x for _, x in found]))
        return pairs // len(self.n), pairs % len(self.n)


def one_apart(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced letter makes one word of the other."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = common(a, b)
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def shards(words: DataFrame, n_words: int) -> DataFrame:
    """shard (rising with the words), size, trie: the words, sorted and cut into tries of a bounded number of words and letters."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        n: list[int] = []
        letters = 0

        def cut() -> pa.RecordBatch:
            data = Trie.of(held, n).dump()
            return pa.record_batch([pa.array([part << 32 | k], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], ["shard", "size", "trie"])

        for batch in batches:
            for w, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (len(held) >= SHARD_WORDS or letters + len(w) > SHARD_LETTERS):
                    yield cut()
                    held, n, letters, k = [], [], 0, k + 1
                held.append(w.encode("latin-1"))
                n.append(count)
                letters += len(w)
        if held:
            yield cut()
        tokens.rest()

    return words.repartitionByRange(max(1, -(-n_words // SHARD_WORDS)), "word").sortWithinPartitions("word").mapInArrow(build, "shard long, size long, trie binary")


def rounds(sizes: list[tuple[int, int]], most: int = ROUND_BYTES) -> Iterator[tuple[int, int]]:
    """First and last of the shards (number, bytes; in order) that are broadcast together: one, or as many as fit."""
    first, last, held = None, None, 0
    for shard, size in sizes:
        if first is not None and held + size > most:
            yield first, last
            first, held = None, 0
        first, last, held = shard if first is None else first, shard, held + size
    if first is not None:
        yield first, last


def neighbours(words: DataFrame) -> DataFrame:
    """words (word, n; distinct) with n_near (words one edit from it), near (that of largest n, ties: the smallest in code-point order) and near_n.

    Every word meets every shard. Of the shards only numbers and sizes are gathered, and the tries
    of a round within ROUND_BYTES (a shard is at most some MB but for a single longer word).
    """
    spark = words.sparkSession
    n_words = words.count()
    tries = written(shards(words, n_words), "tries")
    sizes = sorted(tuple(r) for r in tries.select("shard", "size").collect())
    dealt = words.repartition(max(1, -(-n_words // (4 * BATCH))), "word")
    found = []
    for first, last in rounds(sizes):
        data = spark.sparkContext.broadcast([bytes(r.trie) for r in tries.where(F.col("shard").between(first, last)).orderBy("shard").collect()])

        def meet(batches: Iterator[pa.RecordBatch], data=data) -> Iterator[pa.RecordBatch]:
            loaded = [Trie.load(x) for x in data.value]
            for whole in batches:
                for at in range(0, whole.num_rows, BATCH):
                    batch = whole.slice(at, BATCH)
                    words_ = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
                    pairs = [(w, np.full(len(w), s), k, t.n[k]) for s, t in enumerate(loaded) for w, k in [t.near(words_)]]
                    w, s, k, n = (np.concatenate(x) for x in zip(*pairs))
                    order = np.lexsort((k, s, -n, w))
                    w, s, k, n = w[order], s[order], k[order], n[order]
                    who, best, near = np.unique(w, return_index=True, return_counts=True)
                    text = [loaded[a].text[loaded[a].begins[b] : loaded[a].ends[b]].decode("latin-1") for a, b in zip(s[best].tolist(), k[best].tolist())]
                    yield pa.record_batch([batch.column(0).take(pa.array(who)), pa.array(near, pa.int64()), pa.array(text, pa.string()), pa.array(n[best], pa.int64())], ["word", "n_near", "near", "near_n"])
            del loaded
            tokens.rest()

        found.append(written(dealt.mapInArrow(meet, "word string, n_near long, near string, near_n long"), "near"))
        data.destroy()
    if not found:
        return words.withColumns({"n_near": F.lit(0).cast("long"), "near": F.lit(None).cast("string"), "near_n": F.lit(None).cast("long")})
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w")))
    reduced = reduce(DataFrame.union, found).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    joined = words.join(reduced, "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.w").alias("near"), (-F.col("best.n")).alias("near_n"))


def with_roots(words: DataFrame) -> DataFrame:
    """words (word, form) with root: from a word, forms are followed to the last; the word itself if it has none.

    Each round doubles how far a word looks, so rounds grow with the logarithm of the longest chain.
    """
    ahead = written(words.where("form IS NOT NULL").select("word", F.col("form").alias("to")), "forms")
    while True:
        on = ahead.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        jumped = written(ahead.join(on, "to", "left").select("word", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "forms")
        if jumped.where("moved").isEmpty():
            break
        ahead = jumped.drop("moved")
    return words.join(jumped.select("word", F.col("to").alias("root")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def group(words: DataFrame, times: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root of words (word, n): a word's form is its near word of largest n, if that is at least so many times its own.

    An empty table gives no rows. Other columns of words are not carried; it's computed once and written.
    """
    words = written(words.select("word", "n"), "words")
    near = neighbours(words)
    clear = F.col("near_n") >= times * F.col("n")
    formed = written(near.select("word", "n", "n_near", F.when(clear, F.col("near")).alias("form"), F.when(clear, F.col("near_n")).alias("form_n")), "formed")
    return with_roots(formed)

"""Spelling variants against all pairs of words and plain counts, and odd rows."""

import random
import re
import zlib
from collections import Counter

from spanframe.llm import queries, spellings
from spanframe.llm.spellings import Trie, one_apart

DATA = "/root/testdata/sf0.001"


def apart(a, b):
    """Exactly one edit, by trying."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return len(long_) - len(short) == 1 and any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def plainly(n, times=2):
    """word -> form, root, n, n_near, form_n; words are found by what they give when a letter is left out or blanked."""
    keys = {}
    for w in n:
        for i in range(len(w)):
            keys.setdefault((len(w), w[:i] + "\0" + w[i + 1 :]), set()).add(w)
            keys.setdefault((len(w) - 1, w[:i] + w[i + 1 :]), set()).add(w)
    near = {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            near[w] |= keys[len(w), w[:i] + "\0" + w[i + 1 :]]
            near[w] |= {w[:i] + w[i + 1 :]} & n.keys()
        near[w] |= keys.get((len(w), w), set())
        near[w].discard(w)
    form = {}
    for w, k in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * k else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def words_of(rows, drop_every=97):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % drop_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 5
    return {w: k for w, k in n.items() if k >= 3}


def test_query_equals_all_pairs(spark, docs):
    want = plainly(words_of([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op11_spelling_variants(spark, DATA).collect()}
    assert got == want and sum(v[0] is not None for v in want.values()) > 100


def test_tries_find_each_pair_once():
    rng = random.Random(3)
    for _ in range(80):
        letters = "abé"[: rng.randint(1, 3)]
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, rng.choice([3, 6, 9])))) for _ in range(rng.randint(1, 150))})
        coded = [w.encode("latin-1") for w in words]
        asked = [*coded, b"zzz", b"a"]
        w, k = Trie.load(Trie.of(coded, [1] * len(coded)).dump()).near(asked)
        assert sorted(zip(w.tolist(), k.tolist())) == [(i, j) for i, a in enumerate(asked) for j, b in enumerate(coded) if apart(a, b)]
        assert all(one_apart(a, b) == apart(a, b) for a in asked for b in coded)


def test_many_small_shards_and_rounds_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    n = {"".join(rng.choice("abcÿ×") for _ in range(rng.randint(5, 7))): rng.randint(3, 40) for _ in range(900)}
    long_ = "a" * 3000
    n |= {long_: 9, long_ + "a": 4, long_[1:]: 30, "b" + long_[1:]: 3}
    rows = spark.createDataFrame(list(n.items()), "word string, n long")
    want = plainly(n)
    monkeypatch.setattr(spellings, "SHARD_WORDS", 100)
    monkeypatch.setattr(spellings, "SHARD_LETTERS", 2500)
    monkeypatch.setattr(spellings, "BATCH", 64)
    monkeypatch.setattr(spellings, "rounds", lambda sizes: ((s, s) for s, _ in sizes))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spellings.group(rows).collect()}
    assert got == want
    assert list(spellings.group(rows.limit(0)).collect()) == []


def test_rounds_hold_what_fits():
    assert list(spellings.rounds([(1, 5), (2, 5), (4, 5), (9, 30), (11, 2)], 12)) == [(1, 2), (4, 4), (9, 9), (11, 11)]
    assert list(spellings.rounds([])) == []


def test_words_of_odd_texts(spark, odd, monkeypatch):
    monkeypatch.setattr(spellings, "RUN", 50)
    monkeypatch.setattr(spellings, "MOST_COUNTED", 10)
    texts = [None, "", "ÀÉÎÕÜ àéîõü ×××××÷", "Hello hello HELLO" * 3, "x" * 400, "x" * 400, "x" * 400, "1a2b" * 99, "naïveté naïveté naïveté Ǆabcdeǆ abcde abcde", " ".join(["wordy"] * 500)]
    rows = [(k if k else None, t) for k, t in enumerate(texts * 3)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for every in (97, 3):
        assert {r.word: r.n for r in spellings.counts(made, drop_every=every).collect()} == words_of(rows, every)
    assert {r.word: r.n for r in spellings.counts(odd, drop_every=97).collect()} == words_of([(r.doc_id, r.text) for r in odd.collect()])
    assert spellings.counts(odd.limit(0)).count() == 0

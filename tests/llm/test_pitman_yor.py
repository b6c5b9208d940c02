"""The language model against plain counts, the restaurants' laws, and odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.llm import pitman_yor as P
from spanframe.llm import queries

DATA = "/root/testdata/sf0.001"


def words_of(text):
    return (text or "").encode("utf-8", "surrogatepass").lower().split() + [b""]


def plainly(rows, learned):
    """n_tokens, n_known, base score of each text, and all learned tokens."""
    n = Counter(w for (_, t), ok in zip(rows, learned) if ok for w in words_of(t))
    total, v = sum(n.values()), len(n)
    return [(len(ws := words_of(t)), sum(w in n for w in ws), sum(math.log10((n[w] + 1) / (total + v + 1)) for w in ws)) for _, t in rows], total


def test_query_has_the_plain_counts_and_a_better_score(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    want, total = plainly(rows, [not held[k] for k, _ in rows])
    got = {r.doc_id: r for r in queries.op13_lm_scoring(spark, DATA).collect()}
    again = {r.doc_id: r.score for r in queries.op13_lm_scoring(spark, DATA).collect()}
    assert len(got) == len(rows)
    for (key, _), (n, known, base) in zip(rows, want):
        r = got[key]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held[key])
        assert r.base_score == pytest.approx(base, rel=1e-9) and again[key] == pytest.approx(r.score, rel=1e-12)
    for side in (True, False):
        part = [r for r in got.values() if r.held_out is side]
        assert sum(r.score for r in part) > sum(r.base_score for r in part) and all(r.score < 0 for r in part)


def test_probabilities_after_a_context_add_up_to_one(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAST_BUCKETS", 5)
    texts = ["a b c a b d", "a b c", "x y z a b", "b a b a the theme", None, ""] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = P.fit(docs, "doc_id", "text", F.col("doc_id") >= 0, sweeps=4)
    rows = model.buckets.collect()
    words = sorted({w for t in texts for w in words_of(t)})
    for before in [*words, b"never"]:
        where = P.context(before, P.xxhash.xxh3_64_intdigest(before))
        for s in (0, 3, 4):
            total = 0.0
            for r in rows:
                *_, state = P.replayed(r.data, r.bucket, model.totals, s, model.moves, model.seed, model.discounts, model.strengths)
                word, at = np.arange(len(state.hashes)), np.full(len(state.hashes), where)
                found = [(np.ones(len(word), bool), word), *(state.found(word << b | p, k) for k, p, b in ((1, at >> P.WORD_BITS, P.ENDING_BITS), (2, at, P.BITS)))]
                total += state.probability(found[0][0], word, at, model.totals[s], model.strengths, found).sum()
            none = P.Bucket.of(P.pack(*(np.zeros(0, k) for k in P.COUNTS)), model.discounts)
            unknown = [(np.zeros(1, bool), np.zeros(1, int))] * 3
            total += none.probability(np.zeros(1, bool), np.zeros(1, int), np.array([where]), model.totals[s], model.strengths, unknown)[0]
            assert total == pytest.approx(1, abs=1e-9)


def test_seats_are_consistent_after_every_sweep():
    rng = np.random.default_rng(1)
    n_words = 40
    per = rng.integers(1, 9, n_words).astype(np.uint32)
    where = np.concatenate([np.sort(rng.choice(P.RESTAURANTS, k, replace=False)) for k in per]).astype(np.uint32)
    n = np.maximum(1, rng.zipf(1.5, len(where)) % 5000).astype(np.int64)
    data = P.pack(np.arange(1, n_words + 1, dtype=np.uint64), per, where, n)
    state = P.Bucket.of(data, P.DISCOUNTS)
    for s in range(5):
        x = state.tables()
        totals = P.Totals((x[-1:], x[P.RESTAURANTS : -1], x[: P.RESTAURANTS]), np.bincount(where, n, P.RESTAURANTS).astype(np.int64), n_words)
        assert (state.floors[2].n == n).all()
        for k, f in enumerate(state.floors):
            live = np.isin(np.arange(len(f.n)), f.live)
            assert (np.bincount(f.owner, f.size, len(f.n)) == f.n)[live].all() and (np.bincount(f.owner, minlength=len(f.n)) == f.t)[live].all() and (f.size > 0).all()
            assert (f.n[~live] == 1).all() and (f.t[~live] == 1).all()
            assert (f.t >= 1).all() and (np.diff(f.owner) >= 0).all()
            if k < 2:
                above = state.floors[k + 1]
                assert (np.bincount(state.words[k + 1], above.t, len(f.n)) == f.n).all()
        state.sweep(totals, 2, P.STRENGTHS, np.random.default_rng([7, s]))


def test_gibbs_moves_leave_the_seating_law_as_it_is():
    """Many copies of one word's five customers: how many tables they take must follow the law, found by going through all ways to seat them."""
    d, pull, customers = 0.6, 0.9, 5

    def law(sizes, left):
        if not left:
            return {len(sizes): 1.0} if sizes else {}
        out = Counter()
        options = [(s - d, (*sizes[:i], s + 1, *sizes[i + 1 :])) for i, s in enumerate(sizes)] + [(pull, (*sizes, 1))]
        for weight, seated in options:
            for t, p in law(seated, left - 1).items():
                out[t] += weight * p
        return out

    # With the totals held, a seating's weight is the product of what each customer was drawn by.
    want = law((), customers)
    mass = sum(want.values())
    floor, rng = P.Floor(np.full(20_000, customers), np.full(20_000, customers), d), np.random.default_rng(3)
    floor.move(np.full(20_000, pull), 60, rng)
    got = np.bincount(floor.t, minlength=customers + 1) / 20_000
    for t in range(1, customers + 1):
        assert got[t] == pytest.approx(want[t] / mass, abs=0.015)


def test_blocks_parts_and_merges_change_nothing(spark, docs, monkeypatch):
    some = docs.select("doc_id", "text").unionByName(docs.select("doc_id", F.lit("the the the of").alias("text")))
    train = F.col("doc_id") % 3 != 0

    def run():
        return sorted((r.key, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in P.scores(P.fit(some, "doc_id", "text", train, sweeps=1, keep=1)).collect())

    whole = run()
    for name, value in (("BLOCK_TOKENS", 900), ("RUN", 64), ("FAN_IN", 4), ("PART_BYTES", 3000)):
        monkeypatch.setattr(P, name, value)
    assert run() == whole


def test_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want, total = plainly(rows, [k is not None for k, _ in rows])
    model = P.fit(odd, "doc_id", "text", F.col("doc_id").isNotNull())
    got = sorted((str(r.key), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in P.scores(model).collect())
    assert got == sorted((str(k), n, known, round(base, 6)) for (k, _), (n, known, base) in zip(rows, want)) and model.train_tokens == total
    assert P.scores(P.fit(odd.limit(0), "doc_id", "text", F.lit(True))).count() == 0
    nothing = P.scores(P.fit(odd, "doc_id", "text", F.lit(None).cast("boolean"))).collect()
    assert len(nothing) == len(rows) and all(r.score == r.base_score == 0 and r.n_known == 0 for r in nothing)


@pytest.mark.parametrize("at_once", [2, 1024])
def test_a_sweep_seats_all_customers_anew(monkeypatch, at_once):
    """From two opposite first seatings, at as few tables as can be and at as many, one draw, or some rounds one by one, lead to the same number of tables: that of the law."""
    monkeypatch.setattr(P, "DRAWN_AT_ONCE", at_once)
    d, pull, customers, copies = 0.5, 3.0, 200, 300 if at_once > 2 else 60
    logs = P.ways(d, 1024)[customers, 1 : customers + 1] + np.arange(1, customers + 1) * math.log(pull)
    law = np.exp(logs - logs.max())
    want = (law * np.arange(1, customers + 1)).sum() / law.sum()
    for tables in (1, customers):
        n = np.full(copies, customers)
        floor, rng = P.Floor(n, n, d), np.random.default_rng(5)
        floor.t[:], floor.owner = tables, np.repeat(np.arange(copies), tables)
        floor.size = np.ones(len(floor.owner), np.int64)
        floor.size[P.stretches(floor.owner)] = customers - tables + 1
        floor.reseat(n, np.full(copies, pull), 2 if at_once > 2 else 60, rng)
        assert (np.bincount(floor.owner, floor.size, copies) == customers).all() and (np.bincount(floor.owner, minlength=copies) == floor.t).all()
        assert floor.t.mean() == pytest.approx(want, rel=0.03 if at_once > 2 else 0.25)


def test_tables_drawn_at_once_follow_the_law():
    """Ways to seat five customers, by going through all of them."""
    d, pull = 0.6, 0.9

    def law(sizes, left):
        if not left:
            return Counter({len(sizes): 1.0})
        out = Counter()
        for weight, more in [(s - d, (*sizes[:i], s + 1, *sizes[i + 1 :])) for i, s in enumerate(sizes)] + [(pull, (*sizes, 1))]:
            for t, p in law(more, left - 1).items():
                out[t] += weight * p
        return out

    want = law((), 5)
    got = np.bincount(P.tables_of(np.full(50_000, 5), np.full(50_000, pull), d, np.random.default_rng(2)), minlength=6) / 50_000
    one = np.bincount([len(P.seated(np.array([1, 4]), 5, pull, d, 12, np.random.default_rng([3, i]))) for i in range(4000)], minlength=6) / 4000
    for t in range(1, 6):
        assert got[t] == pytest.approx(want[t] / sum(want.values()), abs=0.01)
        assert one[t] == pytest.approx(want[t] / sum(want.values()), abs=0.03)


def test_kept_seats_are_those_of_a_replay(spark):
    texts = ["a b c a b d", "a b c", "x y z a b", "b a b a the theme", "a b " * 3000]  # of a and b there are more than are drawn at once
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = P.fit(docs, "doc_id", "text", F.col("doc_id") >= 0, sweeps=3, keep=2)
    assert "seats" in model.buckets.columns  # before, every sweep and the scores replayed all sweeps before them
    for r in model.buckets.collect():
        want = [*P.replayed(r.data, r.bucket, model.totals, 3, model.moves, model.seed, model.discounts, model.strengths)][-1]
        assert len(r.seats) == 2
        got = P.Bucket.restored(r.data, r.seats[-1], model.discounts)
        for f, g in zip(want.floors, got.floors):
            assert all((x == y).all() for x, y in ((f.n, g.n), (f.t, g.t), (f.owner, g.owner), (f.size, g.size)))

"""Operators on tables (shards, mixes, rules, vectors, sites) against brute force and odd rows."""

import glob
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.llm import ann, mixing, quality_prior, quality_rules, queries, sharding
from spanframe.llm.common import mark, release, shared_path, written

DATA = "/root/testdata/sf0.001"


def check_shards(rows, n):
    by = defaultdict(list)
    for r in rows:
        assert r.grown_shard in (r.shard, n)
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows})


def test_shards_follow_the_key_law_and_slots_are_gapless(spark, odd, texts):
    rows = queries.op1_sharding(spark, DATA).collect()
    check_shards(rows, 16)
    want = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts.items()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == want
    got = sharding.shard(odd, 16)
    assert got.columns == [c for c in odd.columns if c not in ("shard", "slot")] + ["shard", "slot", "grown_shard"]
    check_shards(got.collect(), 16)
    assert got.count() == odd.count() and sharding.shard(odd.limit(0), 4).count() == 0


def test_shards_are_written_in_the_order_of_slots_and_rows_are_shuffled(spark):
    rows = [(i, f"text {i}") for i in range(2000)] + [(None, "same")] * 1500
    made = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4, bucket_bytes=8000)
    path = shared_path(spark, "shards")
    back = sharding.write_shards(made, path).collect()
    check_shards(back, 4)
    assert Counter((r.doc_id, r.text) for r in back) == Counter(rows)
    import pyarrow.parquet as pq

    files = glob.glob(f"{path}/shard=*/*.parquet")
    assert files and all(s == sorted(s) for s in (pq.read_table(f, partitioning=None)["slot"].to_pylist() for f in files))
    # No order of the input is left, and equal rows lie in many buckets.
    ids = [r.doc_id for r in sorted(back, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    up = sum(a < b for a, b in zip(ids, ids[1:])) / len(ids)
    assert 0.4 < up < 0.6
    same = [r.slot for r in back if r.doc_id is None]
    assert max(same) - min(same) > 1500


def test_mix_comes_near_its_targets(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    mixed = lambda: queries.op5_mixing(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    rows = mixed()
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        assert r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert abs(sum(target.values()) - sum(r["size"] for r in rows)) < 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixed()))
    got = mixing.mix(odd)
    added = ["size", "source_size", "target", "copies", "taken"]
    assert got.columns == [c for c in odd.columns if c not in added] + added
    assert got.count() == odd.count() and mixing.mix(odd.limit(0)).count() == 0


def test_targets_are_capped_and_reshared():
    assert mixing.fill_targets([10, 100, 100], [5, 2, 1], 3) == [30.0, 120.0, 60.0] and mixing.fill_targets([], [], 3) == []


def sources(n, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 20, 300]))), rng.choice([None, *(f"s{k}" for k in range(n))]), rng.random() + 0.1) for i in range(1500)]


def test_samples_are_those_of_the_smallest_ranks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELLS", 4)
    monkeypatch.setattr(mixing, "EDGE", 3)
    made = spark.createDataFrame(sources(4), "doc_id long, text string, source string, liking double")
    for preference in (None, "liking"):
        got = mixing.mix(made, preference=preference)
        u = mixing.unit_hash(23, F.xxhash64(F.lit(23), "doc_id", F.xxhash64("text")))
        rows = got.withColumn("u", u).collect()
        by = defaultdict(list)
        for r in rows:
            by[r.source].append(r)
        order = sorted(by, key=lambda s: (s is None, s or ""))
        sizes = [sum(r["size"] for r in by[s]) for s in order]
        targets = mixing.fill_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], 3)
        for s, n, target in zip(order, sizes, targets):
            mean = sum(r.liking * r["size"] for r in by[s]) / n
            ranked, whole = [], 0
            for r in by[s]:
                expected = min(3.0, target / n * (r.liking / mean if preference else 1.0))
                assert r["size"] == len(r.text.split()) and r.source_size == n and math.isclose(r.target, target)
                p = expected - math.floor(expected)
                whole += math.floor(expected) * r["size"]
                if p > 0:
                    q = r.u / (1 - r.u) / (p / (1 - p))
                    ranked.append((q / (1 + q), math.floor(expected), r))
                else:
                    assert r.copies == math.floor(expected)
            at = 0
            for _, base, r in sorted(ranked, key=lambda x: x[0]):
                at += r["size"]
                if r["size"]:
                    assert r.copies == base + (at - r["size"] / 2 <= target - whole), (s, r.doc_id)


def test_many_sources_have_the_targets_of_few(spark, monkeypatch):
    made = spark.createDataFrame(sources(40), "doc_id long, text string, source string, liking double")
    few = {r.doc_id: (r.target, r.copies) for r in mixing.mix(made).collect()}
    monkeypatch.setattr(mixing, "MOST_SENT", 0)
    many = {r.doc_id: (r.target, r.copies) for r in mixing.mix(made).collect()}
    assert few.keys() == many.keys() and all(math.isclose(few[i][0], many[i][0], rel_tol=1e-9) for i in few)
    assert sum(few[i][1] != many[i][1] for i in few) <= 3
    assert mixing.mix(made.limit(0)).count() == 0


def test_a_source_of_equal_rows_comes_near_its_target(spark):
    rows = [(1, "one two three", "a")] * 900 + [(i, "one two three", "b") for i in range(2, 902)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 3)).collect()
    assert abs(sum(r.taken for r in got if r.source == "a") - 1350) < 300
    assert abs(sum(r.taken for r in got if r.source == "b") - 4050) <= 3


def test_mix_of_a_source_at_its_cap_takes_whole_copies(spark):
    rows = [(i, "one two three", "a") for i in range(4)] + [(i, "one two three", "b") for i in range(4, 400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 400 and all(r.copies == 3 and r.target == 36.0 for r in got if r.source == "a")
    assert abs(sum(r.taken for r in got) - 1200) <= 3


def measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines), len(lines) - len(set(lines)), len(covered)


def cell(v):
    """The least value of the cell that holds v."""
    shift = max(0, v.bit_length() - 8)
    return v >> shift << shift


def verdicts(rows, least):
    """kept by brute force: rows of (lang, source, n, chars, symbols, lines, dup, rep)."""
    rate = lambda r: (r[3] * 1000 // max(r[2], 1), r[4] * 1000000 // max(r[3], 1), r[6] * 1000 // max(r[5], 1), r[7] * 1000 // max(r[2], 1), r[2])
    good = [r for r in rows if not (r[2] < 20 or 100 * r[7] > 30 * r[2])]

    def quartiles(group):
        out = []
        for k in range(5):
            v = sorted(rate(r)[k] for r in group)
            out.append([cell(v[-(-len(v) * c // 100) - 1]) for c in (25, 50, 75)])
        return out

    made = {}
    for r in rows:
        if r not in good:
            made[r] = False
            continue
        own, lang = [x for x in good if x[:2] == r[:2]], [x for x in good if x[0] == r[0]]
        q = quartiles(own if len(own) >= least else lang if len(lang) >= least else good)
        wide, far, broken = math.sqrt(max(1.0, q[4][1] / r[2])), False, set()
        for k, family in enumerate((0, 1, 2, 2)):
            v, (low, _, high) = rate(r)[k], q[k]
            out = lambda x: v > high + (high - low) * wide * x or (k == 0 and v < low - (high - low) * wide * x)  # noqa: B023, E731
            far |= high > low and out(3.0)
            if out(1.5):
                broken.add(family)
        made[r] = not far and len(broken) < 2
    return made


def test_quality_rules_equal_brute_force(spark, texts, docs):
    info = {r.doc_id: (r.lang, r.source) for r in docs.select("doc_id", "lang", "source").collect()}
    want = verdicts([(*info[i], *measures(t), i) for i, t in texts.items()], 100)
    want = {r[8]: (r[2:8], v) for r, v in want.items()}
    got = queries.op6_quality_rules(spark, DATA).collect()
    for r in got:
        m, kept = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (*m[:3], *m[4:])
        assert r.base_failed == (m[0] < 20 or 100 * m[5] > 30 * m[0]) and r.kept == kept, r
    assert len(got) == len(want)


def test_odd_rows_have_measures_and_verdicts(spark, odd):
    m = quality_rules.measure(odd)
    kept = quality_rules.apply_fences(m, quality_rules.thresholds(m))
    assert kept.count() == odd.count() and "kept" in kept.columns and not kept.where("n_words < 20 AND kept").count()
    empty = quality_rules.measure(odd.limit(0))
    assert quality_rules.apply_fences(empty, quality_rules.thresholds(empty)).count() == 0


def test_thresholds_follow_their_group(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(max(1, round(rng.gauss(n, 2)))))
    rows = []
    for lang, mean in (("short", 4), ("long", 9)):
        for i in range(300):
            rows.append((len(rows), " ".join(word(mean) for _ in range(80)), lang, "web"))
    rows += [(1000, " ".join(word(9) for _ in range(80)), "short", "web"), (1001, " ".join(word(4) for _ in range(80)), "long", "web"), (1002, " ".join(word(9) for _ in range(80)), "long", "thin")]
    rows += [(2000 + i, " ".join(word(4) + ("#" if i else "") for _ in range(80)), "short", "web") for i in range(2)]
    m = quality_rules.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    kept = {r.doc_id: r.kept for r in quality_rules.apply_fences(m, quality_rules.thresholds(m)).collect()}
    assert not kept[1000] and not kept[1001] and kept[1002]
    assert np.mean([kept[i] for i in range(600)]) > 0.97
    # One sketch for all knows no groups, and lets both pass.
    all_ = {r.doc_id: r.kept for r in quality_rules.apply_fences(m, quality_rules.thresholds(m, least=10**6)).collect()}
    assert all_[1000] and all_[1001]


def brute(ids, x, q, k=10):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    d[ids == q] = np.inf
    return ids[np.lexsort((ids, d))[:k]], d


def test_nearest_neighbours_reach_the_recall_with_some_lists_and_abandoned_candidates(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    v = e.toPandas()
    ids, x = v.vec_id.to_numpy(), np.stack(v.embedding).astype(float)
    index = ann.build(e)
    probes = ann.probes_for(index, 0.95)
    assert probes < len(index.centres)
    got = ann.search(index, ann.usable(e.where("vec_id % 100 = 0"), "vec_id", "embedding"), 10).toPandas()
    assert set(got.query_id) == {int(i) for i in ids if i % 100 == 0}
    hit = 0
    for q, g in got.groupby("query_id"):
        want, d = brute(ids, x, q)
        assert sorted(g["rank"]) == list(range(1, 11)) and list(g.sort_values("rank")["score"]) == sorted(g["score"])
        assert np.allclose(g.score, [d[ids == i][0] for i in g.vec_id], rtol=0, atol=1e-12)
        hit += len(set(want) & set(g.vec_id))
    assert hit / (10 * got.query_id.nunique()) >= 0.9
    # The scan itself: next to nothing is lost, and most candidates are abandoned early.
    seen = Counter()
    lists = np.sort(ann.nearest(x, index.centres)[:, 0])
    order = np.argsort(ann.nearest(x, index.centres)[:, 0], kind="stable")
    block = {"lists": lists, "starts": np.arange(len(x) + 1), "ids": ids[order], "v": x[order], "r": (x[order] @ index.rotation).astype(np.float32)}
    asked = x[:40]
    found = ann.scan(block, asked, [np.arange(len(index.centres))] * 40, np.full(40, np.inf), index.rotation, 11, seen)
    assert seen["abandoned"] > 0.5 * seen["candidates"] == 0.5 * 40 * len(x)
    hit = sum(len({i for q, i, _ in found if q == n} & {*brute(ids, x, ids[n])[0], ids[n]}) for n in range(40))
    assert hit / 440 > 0.97
    # With the test switched off nothing is lost.
    calm, ann.beta_bound = ann.beta_bound, lambda *a: 1.0
    try:
        found = ann.scan(block, asked, [np.arange(len(index.centres))] * 40, np.full(40, np.inf), index.rotation, 11)
    finally:
        ann.beta_bound = calm
    assert all({i for q, i, _ in found if q == n} == {*brute(ids, x, ids[n])[0], ids[n]} for n in range(40))


def test_clustered_vectors_need_few_lists(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(40, 1, 16)) * 5 + rng.normal(size=(40, 50, 16))).reshape(-1, 16)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    index = ann.build(df)
    assert ann.probes_for(index, 0.95) <= len(index.centres) // 4
    ids = np.arange(len(x))
    got = ann.search(index, ann.usable(df.where("vec_id % 100 = 0"), "vec_id", "embedding"), 10).toPandas()
    assert np.mean([len(set(brute(ids, x, q)[0]) & set(g.vec_id)) / 10 for q, g in got.groupby("query_id")]) >= 0.9


def test_a_very_common_vector_is_held_once(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(1000)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    index = ann.build(df)
    assert 501 <= index.counts.sum() < 510
    got = ann.search(index, ann.usable(df.where("vec_id IN (3, 900, 1100)"), "vec_id", "embedding"), 10, probes=999).toPandas()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for q, g in got.groupby("query_id"):
        assert list(g.sort_values("rank").vec_id) == list(brute(ids, x, q)[0])


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 2.0, 3.0]), (7, [1.0, 0.1]), (None, [1.0, 1.0]), (8, []), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"list": F.lit(1), "block": F.lit("x")})
    got = ann.search(ann.build(df), ann.usable(df.where("vec_id IN (0, 2, 3, 6)"), "vec_id", "embedding"), 10).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 7)]
    assert ann.search(ann.build(df.limit(0)), ann.usable(df, "vec_id", "embedding")).count() == 0
    assert ann.search(ann.build(df), ann.usable(df.limit(0), "vec_id", "embedding")).count() == 0
    with pytest.raises(ValueError):
        ann.search(ann.build(df), ann.usable(df, "vec_id", "embedding"), 64)


def test_quality_classifier(spark, odd):
    rows = queries.op10_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) > 0.95
    model = quality_prior.fit(odd, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality_prior.combine(quality_prior.classify(odd, model), "source", "lang")
    assert got.count() == odd.count() and {"n", "s", "t", "p"} <= set(got.columns)
    assert quality_prior.combine(quality_prior.classify(odd.limit(0), model), "source", "lang").count() == 0


def combined(rows):
    """site_post, path_post and score by brute force: rows of (site, path, p)."""
    site, path = defaultdict(list), defaultdict(list)
    for s, t, p in rows:
        site[s].append(p)
        path[s, t].append(p)
    mean = sum(r[2] for r in rows) / len(rows)
    sure = lambda between, thin, n: min(1000.0, max(2.0, mean * (1 - mean) / max(between - mean * (1 - mean) * thin, 1e-9) - 1)) if n > 1 else 10.0
    means = [np.mean(v) for v in site.values()]
    k = sure(np.var(means), np.mean([1 / len(v) for v in site.values()]), len(site))
    site_post = {s: (sum(v) + k * mean) / (len(v) + k) for s, v in site.items()}
    k2 = sure(np.mean([(np.mean(v) - site_post[s]) ** 2 for (s, _), v in path.items()]), np.mean([1 / len(v) for v in path.values()]), len(path))
    logit = lambda x: math.log(x / (1 - x))
    out = []
    for s, t, p in rows:
        v = path[s, t]
        others = (sum(v) - p + k2 * site_post[s]) / (len(v) - 1 + k2)
        out.append((site_post[s], (sum(v) + k2 * site_post[s]) / (len(v) + k2), 1 / (1 + math.exp(-(logit(p) + logit(others) - logit(mean))))))
    return out


def test_posteriors_equal_brute_force_and_sparse_sites_shrink(spark):
    rng = random.Random(11)
    rows = []
    for k, (n, quality) in enumerate([(400, 0.9), (300, 0.15), (200, 0.6), (2, 0.05), (1, 0.95), (3, 0.9)]):
        for i in range(n):
            level = quality if (i % 3) else min(0.95, quality + 0.04)
            rows.append((f"h{k}" if k else None, f"p{i % 3}" if i % 5 else None, min(0.98, max(0.02, rng.gauss(level, 0.12)))))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, site string, path string, p_doc double")
    got = sorted(quality_prior.combine(df, "site", "path").collect(), key=lambda r: r.i)
    want = combined(rows)
    assert np.allclose([(r.site_post, r.path_post, r.score) for r in got], want, atol=1e-9)
    mean = np.mean([r[2] for r in rows])
    post = {r.site: r.site_post for r in got}
    # A site of two bad documents is drawn to the mean, one of three hundred hardly.
    assert abs(post["h3"] - 0.05) > 4 * abs(post["h1"] - 0.15) and 0.05 < post["h3"] < mean
    # The posteriors decide: on a bad site middling evidence is refused, on a good one taken.
    changed = [(r.site, r.p_doc, r.score) for r in got if (r.p_doc >= 0.5) != (r.score >= 0.5)]
    assert len(changed) >= 10 and all(score < 0.5 for s, _, score in changed if s == "h1")


def test_pages_are_scored_by_host_and_path(spark):
    rows = queries.quality_of_pages(spark, DATA).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    assert {r.page_id for r in rows} == set(pages)
    assert all(r.host in pages[r.page_id].url and f"/{r.path}/" in pages[r.page_id].url and 0 < r.score < 1 for r in rows)
    texts = spark.createDataFrame([("<p>a<script>x < 1</script>b<!-- <b> -->c</p>",), (None,), ("",), ("a < b",)], "h string").select(quality_prior.page_text(F.col("h")).alias("t")).collect()
    assert [r.t and re.sub(" +", " ", r.t).strip() for r in texts] == ["a b c", None, "", "a < b"]


def test_tables_of_a_run_are_deleted(spark):
    since = mark()
    one, two = (written(spark.range(3), x) for x in ("one", "two"))
    release(spark, since, keep=1)
    assert two.count() == 3 and not glob.glob(one.inputFiles()[0].removeprefix("file:"))
    release(spark, since)


def test_urls_of_pages_are_split_into_host_and_path(spark):
    from urllib.parse import urlsplit

    urls = [r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").select("url").collect()] + ["http://A.b:80/c/d?e=f#g", "https://a.b", "no url", "http://a b/c", None]
    df = spark.createDataFrame(list(enumerate(urls)), "i long, url string")
    got = {r.i: (r.host, r.path) for r in df.select("i", *[c.alias(n) for c, n in zip(quality_prior.site_and_path(F.col("url")), ("host", "path"))]).collect()}
    split = lambda u: (None, None) if not u or " " in u or not urlsplit(u).hostname else (urlsplit(u).hostname, urlsplit(u).path)
    assert got == {i: split(u) for i, u in enumerate(urls)}

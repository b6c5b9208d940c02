"""Operators on texts (languages, personal data, repeats, copies, tokens) against brute force, the library, and odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from spanframe.llm import bpe, langid, neardup, pii, queries, substrings

DATA = "/root/testdata/sf0.001"


def test_language_is_found_on_held_out_rows(spark, docs, odd):
    all_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(all_, "doc_id").where("held_out").select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    rows = langid.predict(odd, langid.fit(docs))
    out = {r.doc_id: r for r in rows.collect()}
    assert out[4].lang_pred == out[5].lang_pred == "und" and out[6].lang_pred != "und" and out[None].score == 0
    assert rows.columns == [c for c in odd.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    assert langid.predict(odd, langid.fit(odd.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(odd.limit(0), langid.fit(docs)).count() == 0


def test_every_label_is_learned_however_many(spark):
    rows = [(i, f"word{i % 30} " * 20, f"l{i % 30}") for i in range(300)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.fit(made, most_rows=60).langs) == 30
    with pytest.raises(ValueError):
        langid.fit(made, most_rows=20)


def test_a_null_id_is_not_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "der die das", "de"), (1, "the and of", "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.held_out for r in queries.op2_language_id(spark, str(tmp_path)).collect()}[None] is False


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data_base_spans(spark, texts):
    for r in queries.op4_pii(spark, DATA).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_personal_data_on_odd_texts(spark, odd):
    rng = random.Random(4)
    made = ["".join(rng.choice(["a@b.c", "_d@e.f", "1.2.3.4", ".5", "@", "+4 (55) 1234567", "4111 1111 1111 1111", "é", " ", "-", "x", " at ", " dot ", "(at)", "555-123-4567", "[.]"]) for _ in range(12)) for _ in range(200)]
    made += ["9" * 20000, "a" * 20000, "1." * 5000, " at a" * 5000, "mail bob (at) site (dot) com or call 555-123-4567", ""]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    weights = pii.fit(df)
    for r in pii.spans(df, weights).select("doc_id", pii.joined(F.filter("pii", lambda x: x["base"])).alias("b")).collect():
        assert r.b == base_spans(made[r.doc_id]), made[r.doc_id]
    clean = pii.redact(pii.spans(df, weights)).where("doc_id = 0").first().text
    assert "a@b.c" not in clean
    found = pii.spans(odd, pii.fit(odd))
    assert found.count() == len(odd.collect()) and found.columns == [c for c in odd.columns if c != "pii"] + ["pii"]
    assert pii.spans(odd.limit(0), pii.fit(odd.limit(0))).count() == 0


def test_reliabilities_of_labelers_are_estimated():
    rng = random.Random(5)
    right = {True: (0.95, 0.9, 0.8, 0.7, 0.5), False: (0.9, 0.75, 0.85, 0.7, 0.5)}  # how often each labeler says what is true
    made, n = Counter(), Counter()
    for _ in range(20000):
        y = rng.random() < 0.4
        v = tuple(0 if rng.random() < 0.2 else (1 if y else -1) * (1 if rng.random() < q else -1) for q in right[y])
        made[v, y] += 1
        n[v] += 1
    counts = sorted(n.items())
    post, table, share = pii.estimate(counts)
    assert abs(share - 0.4) < 0.03
    for j, (t, f) in enumerate(table):
        assert abs(t - right[True][j]) < 0.04 and abs(f - (1 - right[False][j])) < 0.04
    hits = lambda said: sum(made[v, said(v, p)] for (v, _), p in zip(counts, post))
    assert hits(lambda v, p: p > 0.5) > hits(lambda v, p: sum(v) > 0) + 300


def test_looser_spans_are_found_by_the_classifier_beside_base_ones(spark):
    rng = random.Random(6)
    made, want = [], []
    for i in range(400):
        user, host = "".join(rng.choice("abcdefgh") for _ in range(6)), "".join(rng.choice("klmnop") for _ in range(5))
        phone = f"{rng.choice([212, 312, 415, 617])}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        t, spans = f"Please mail {user}@{host}.com or call +1 ({rng.randint(200, 899)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)} now.", []
        if i % 4 == 0:
            s = len(t) + len(" Or write to ")
            t += f" Or write to {user}.x (at) {host} (dot) org"
            spans.append(("email", s, len(t)))
        if i % 4 == 1:
            s = len(t) + len(" My phone: ")
            t += f" My phone: {phone}."
            spans.append(("phone", s, s + len(phone)))
        if i % 4 == 2:
            t += f" Order 123-{rng.randint(0, 199):03d}-{rng.randint(1000, 9999)}/7 is due; invoice 000 111 {rng.randint(1000, 9999)}."
        made.append(t)
        want.append(spans)
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    weights = pii.fit(df)
    rows = {r.doc_id: [(pii.KINDS[x.kind], x.s, x.e) for x in r.pii if not x.base] for r in pii.spans(df, weights).collect()}
    assert [rows[i] for i in range(400)] == want
    # Without what was learned nothing but base matches is left.
    none = {k: [-1.0] + [0.0] * len(pii.LABELERS) for k in range(4)}
    assert pii.spans(df, none).where(F.exists("pii", lambda x: ~x["base"])).count() == 0


def cut(texts):
    w = {i: (t or "").encode().split() for i, t in texts.items()}
    n = Counter(tuple(x[k : k + 35]) for x in w.values() for k in range(len(x) - 34))
    out = {}
    for i, x in w.items():
        gone = {j for k in range(len(x) - 34) if n[tuple(x[k : k + 35])] > 1 for j in range(k, k + 35)}
        out[i] = len(x), len(gone), hashlib.sha256(b" ".join(y for j, y in enumerate(x) if j not in gone)).hexdigest()
    return out


def test_repeated_windows_go(spark, texts):
    want = cut(texts)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op7_substrings(spark, DATA).collect()} == want
    rng = random.Random(2)
    part = [f"p{rng.randint(0, 9)}" for _ in range(40)]
    made = {1: " ".join(part), 2: " ".join(["x", *part, "y"]), 3: "a " * 80, 4: " ".join(part[:34]), 5: "", 6: None, 7: " ".join(map(str, range(200)))}
    got = substrings.dedup(spark.createDataFrame(list(made.items()), "doc_id long, text string")).collect()
    assert {r.key: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got} == cut(made)


def digest(rows):
    return {r.key: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in rows}


def test_odd_rows_lose_what_repeats(spark, odd):
    got = substrings.dedup(odd).collect()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    want = cut(dict(enumerate(t for _, t in texts)))
    assert Counter((k, *want[i]) for i, (k, _) in enumerate(texts)) == Counter((r.key, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got)
    assert substrings.dedup(odd.limit(0)).count() == 0


def test_batches_are_checked_against_a_kept_index(spark):
    rng = random.Random(7)
    word = lambda: f"v{rng.randint(0, 10**6)}"
    shared = [" ".join(word() for _ in range(50)) for _ in range(6)]
    batches, texts = [], {}
    for b in range(5):
        batch = {}
        for i in range(30):
            own = [" ".join(word() for _ in range(60)) for _ in range(2)]
            batch[100 * b + i] = f"{own[0]} {shared[rng.randint(0, 5)]} {own[1]}" if i % 3 == 0 else " ".join(own)
        batches.append(batch)
    index = substrings.WindowIndex(spark, buckets=8, fanout=2)
    for batch in batches:
        # As in another session: what the manifest tells is all there is.
        index = substrings.WindowIndex.open(spark, index.path) if index.batches else index
        df = spark.createDataFrame(list(batch.items()), "doc_id long, text string")
        texts |= batch
        want = cut(texts)
        assert digest(substrings.dedup(df, index=index).collect()) == {k: want[k] for k in batch}
        assert len(index.runs) <= 2
    assert len(substrings.WindowIndex.open(spark, index.path).batches) == 5
    # All at once, through runs that are compacted, or not.
    both = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert digest(substrings.dedup(both, batches=1).collect()) == digest(substrings.dedup(both, batches=4).collect()) == cut(texts)


def test_runs_mark_what_was_met_before(spark):
    prints = lambda hashes: spark.createDataFrame(substrings.packed(0, np.array(hashes, np.uint64) << np.uint64(40), 4), substrings.PACKED)
    index = substrings.WindowIndex(spark, buckets=4, fanout=2)
    marks = lambda hashes: [x for r in sorted(index.repeated(prints(hashes)).collect(), key=lambda r: r.bucket) for x in np.unpackbits(np.frombuffer(r.bits, np.uint8))[: len(hashes)].tolist()]
    index.add(prints([1, 2, 3, 3]))
    assert marks([1, 2, 3]) == [0, 0, 1]
    index.add(prints([2, 4]))
    assert marks([1, 2, 3, 4]) == [0, 1, 1, 0] and len(index.runs) == 2
    index.add(prints([4, 5]))
    assert marks([1, 2, 3, 4, 5]) == [0, 1, 1, 1, 0] and len(index.runs) == 1


def test_an_index_grows_with_its_texts_and_survives_crashes(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 3000)
    rng = random.Random(8)
    word = lambda: f"v{rng.randint(0, 10**6)}"
    shared = [" ".join(word() for _ in range(45)) for _ in range(4)]
    index, texts, most = substrings.WindowIndex(spark, buckets=1, fanout=2), {}, []
    for b, n in enumerate((2, 4, 30, 200)):
        batch = {1000 * b + i: " ".join([word() for _ in range(40)] + shared[i % 4].split() * (i % 3 == 0) + [word() for _ in range(20)]) for i in range(n)}
        df = spark.createDataFrame(list(batch.items()), "doc_id long, text string")
        texts |= batch
        want = {k: cut(texts)[k] for k in batch}
        before = index.path and (index.buckets, list(index.batches))
        if b == 2:  # the manifest can't be put in its place: the index is as it was
            save = substrings.WindowIndex.save

            def torn(self):
                raise OSError("lost")

            monkeypatch.setattr(substrings.WindowIndex, "save", torn)
            with pytest.raises(OSError):
                substrings.dedup(df, index=index, name=f"b{b}")
            monkeypatch.setattr(substrings.WindowIndex, "save", save)
            index = substrings.WindowIndex.open(spark, index.path)
            assert (index.buckets, index.batches) == before
        assert digest(substrings.dedup(df, index=index, name=f"b{b}").collect()) == want
        # The result was lost: once more, from what the manifest tells.
        index = substrings.WindowIndex.open(spark, index.path)
        assert digest(substrings.dedup(df, index=index, name=f"b{b}").collect()) == want and len(index.batches) == b + 1
        most.append(max(len(r.prints) for r in index.history().collect()))
    assert index.buckets * 3000 >= index.bytes == sum(len(t) for t in texts.values()) and index.buckets >= 32
    assert most[-1] < 4 * max(most[0], 8 * 60) and len(index._manifests()) == 1
    # Of two manifests, as a crash between a rename and a deletion leaves them, the newer one counts.
    fs, at = index._fs()
    fs.rename(at(index._manifests()[0]), at(f"{index.path}/manifest-000000000001.json"))
    index.save()
    out = fs.create(at(f"{index.path}/manifest-000000000002.json"))
    out.close()
    assert substrings.WindowIndex.open(spark, index.path).runs == index.runs
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("dealt_")]


def test_dealt_texts_are_not_shuffled_again(spark, docs):
    dealt = substrings.Dealt.of(docs, "doc_id", "text")
    plan = substrings.fingerprints(dealt.table, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FlatMapGroups" in plan


def test_near_duplicates_match_brute_force(spark, texts, odd):
    sh = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in texts.items()}
    got = {r.doc_id: r.class_id for r in queries.op8_near_duplicates(spark, DATA).collect()}
    root = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b]):
                ra, rb = root[a], root[b]
                root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
    assert got == root
    classed = neardup.classes(odd)
    assert len({r.root for r in classed.where("doc_id IN (1, 2, 3)").collect()}) == 1
    kept = neardup.survivors(classed, "doc_id").collect()
    assert Counter(r.doc_id for r in kept) == Counter([1, 4, None, 5, 6, 7])


def test_odd_names_and_texts_that_share_a_hash(spark, odd, monkeypatch):
    classed = neardup.classes(odd)
    kept = neardup.survivors(classed)
    assert kept.columns == [c for c in odd.columns if c not in ("tid", "root")] and kept.count() == 6
    assert neardup.classes(odd.limit(0)).count() == 0
    # Only the length for a hash: texts of one length are told apart all the same.
    real = F.xxhash64
    monkeypatch.setattr(neardup.F, "xxhash64", lambda *c: F.length(c[0]).cast("long") if len(c) == 1 and c[0] == "text" else real(*c))
    rows = neardup.with_ids(odd.select("doc_id", "text"), "text").collect()
    assert len({r.tid for r in rows if r.text is not None}) == len({r.text for r in rows if r.text is not None})
    assert len({r.tid for r in rows if r.doc_id in (1, 2)}) == 1 and [r.tid for r in rows if r.text is None] == [None]


def test_encoding_equals_the_library(spark, texts, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for r in queries.op9_bpe(spark, DATA).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    rng = random.Random(3)
    made = ["".join(rng.choice(["a", "th", "ing", " ", "  ", "\n", "\t", "é", "日本", "😀", "1", "'s", "...", "<|endoftext|>", "aaaa", "\x00", "\x1c"]) for _ in range(30)) for _ in range(500)]
    mine = bpe.loaded(open(path, encoding="utf-8").read()).encode(made)
    assert [np.frombuffer(x, "<u4").tolist() for x in mine] == [lib.encode(t, add_special_tokens=False).ids for t in made]
    out = {r.doc_id: r.n_tokens for r in bpe.encode(odd, path).collect()}
    assert out[4] == 0 and out[None] == 0


def test_long_texts_are_encoded_in_pieces(spark, odd, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, mine = Tokenizer.from_file(path), bpe.TrieBpe(open(path, encoding="utf-8").read())
    rng = random.Random(8)
    monkeypatch.setattr(bpe, "RUN", 40)
    for _ in range(60):
        t = "".join(rng.choice(["a", "thing", " ", "  ", "\n ", " x", "é ", "日本", "1", "'s", "... ", "\u3000", "\x1c", "<|endoftext|>", "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16")]) for _ in range(200))
        assert "".join(bpe.cut(t, 40)) == t
        ids = np.frombuffer(b"".join(mine.encode([p])[0] for p in bpe.cut(t, 40)), "<u4").tolist()
        assert ids == lib.encode(t, add_special_tokens=False).ids
        assert mine.decode(np.array(ids, "<u4").tobytes()) == lib.decode(ids, skip_special_tokens=False)
    rows = bpe.encode(odd, path, decoded=False)
    assert rows.columns == [c for c in odd.columns if c not in ("ids", "n_tokens", "decoded")] + ["ids", "n_tokens"]
    assert bpe.encode(odd.limit(0), path).count() == 0
    long_ = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(120_000)) + "x" * 50_000
    got = bpe.encode(spark.createDataFrame([(1, long_)], "doc_id long, text string"), path).first()
    assert np.frombuffer(got.ids, "<u4").tolist() == lib.encode(long_, add_special_tokens=False).ids and got.decoded == long_


def test_caches_are_bounded_by_bytes(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    mine = bpe.TrieBpe(open(path, encoding="utf-8").read())
    monkeypatch.setattr(bpe, "MOST_BYTES", 20_000)
    whole = bpe.TrieBpe(open(path, encoding="utf-8").read())
    for k in range(20):
        texts = [f"word{k}x{i} again" for i in range(40)]
        assert mine.encode(texts) == [whole.encode([t])[0] for t in texts]
        assert len(mine.known) < 200


def brute_classes(made):
    sh = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t in made]
    root = list(range(len(made)))
    for b in range(len(made)):
        for a in range(b):
            if root[a] != root[b] and len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def found_classes(spark, made):
    rows = neardup.classes(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).select("doc_id", "root").collect()
    least = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        least.setdefault(r.root, r.doc_id)
    return [least[r.root] for r in sorted(rows, key=lambda r: r.doc_id)]


def test_sizes_of_classes(spark):
    rows = [(i, 7, "x", i) for i in range(3000)] + [(-4, 9, "y", 0), (-4, 9, "y", 0), (None, 9, None, 1), (None, 8, None, None), (5000, None, None, None), (None, None, "z", 2)]
    classed = spark.createDataFrame(rows, "doc_id long, root long, least string, n long").repartition(5)
    found = sorted(map(tuple, neardup.with_sizes(classed, "doc_id").collect()), key=str)
    want = [(i, 7, 0, 3000) for i in range(3000)] + [(-4, 9, -4, 3)] * 2 + [(None, 9, -4, 3), (None, 8, None, 1), (5000, None, None, None), (None, None, None, None)]
    assert found == sorted(want, key=str)
    assert neardup.with_sizes(classed.limit(0), "doc_id").count() == 0


def test_copies_with_a_much_repeated_line_are_near(spark):
    rng = random.Random(5)
    made = []
    for _ in range(10):
        words, line = ([f"q{rng.randint(0, 10**9)}" for _ in range(n)] for n in (300, 12))
        made += [" ".join(words), " ".join(words + 40 * line)]
    assert found_classes(spark, made) == brute_classes(made) == [i - i % 2 for i in range(20)]


def test_links_in_a_family_just_under_the_least_similarity_are_found(spark):
    rng = random.Random(6)
    base = [f"t{i}" for i in range(600)]
    changes = [{p: f"n{i}-{p}" for p in rng.sample(range(5, 595, 5), 9)} for i in range(400)]
    for i in range(0, 400, 10):
        same = dict(list(changes[i].items())[:3])
        changes[i + 1] = same | dict([x for x in changes[i + 1].items() if x[0] not in same][:6])
    made = [" ".join(c.get(k, w) for k, w in enumerate(base)) for c in changes]
    want = brute_classes(made)
    assert 340 < len(set(want)) <= 360
    assert found_classes(spark, made) == want


def test_words_are_hashed_together():
    import random

    import numpy as np

    from spanframe.llm import substrings, tokens

    rng = random.Random(3)
    some = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefgh\x00", "é語", "x" * 511, "x" * 513, "y" * 3000, "a\x00", "\xa0", "\x1f"]
    texts = [None, "", " \t\n\x0b\x0c\r ", *("".join(rng.choice([*some, " ", "\n", "  "]) + rng.choice(["", " "]) for _ in range(40)) for _ in range(60)), "end"]
    lists, words = tokens.word_lists(texts), tokens.Words(texts)
    assert words.counts.tolist() == [len(x) for x in lists]
    flat = [w for x in lists for w in x]
    for seed in (0, 1):
        of = dict(zip(flat, words.hashes(seed).tolist()))
        assert [of[w] for w in flat] == words.hashes(seed).tolist() and len(set(of.values())) == len(of) == len(set(flat))
    half = np.arange(len(flat)) % 2 == 0
    assert (words.hashes(1, half) == words.hashes(1)[half]).all() and not (words.hashes(1) == words.hashes()).any()
    # One pass over bytes, not a look-up for each word.
    tokens._known.clear()
    assert len(substrings.Block(texts).hashes) == len(flat) and not tokens._known

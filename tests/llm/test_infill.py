"""Fill-in-middle against SQL, plain slices and odd rows."""

import hashlib

import pytest
from oracle import compare
from pyspark.sql import functions as F

from spanframe.llm import infill, queries

DATA = "/root/testdata/sf0.001"


def plainly(key, text, seed=1):
    """Form, prefix, middle and output by Python's own slices."""
    t, digest = text or "", hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or any(m in t for m in infill.MARKS) or h[2] % 100 >= 90:
        return "plain", None, None, t
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    return ("spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_query_equals_its_sql(spark):
    assert compare(spark, queries.op12_fill_in_middle, queries.ORACLES["op12_fill_in_middle"], DATA) > 0


def test_odd_texts_are_moved_and_restored(spark, odd):
    texts = ["a<P>b", "<M>", None, "", "\r\n", "x\n\U0001d11e\0é\r\n" * 200, "<" * 700, "<P" * 300, ">" * 9, "é" * 400, "word " * 60_000, "last"]
    rows = [(k if k % 7 else None, texts[k % len(texts)]) for k in range(240)]
    made = infill.rearrange(spark.createDataFrame(rows, "doc_id long, text string"))
    back = infill.restored(F.col("output"), F.col("form"))
    got = made.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", back.alias("back")).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "spm", "psm"}
    for r in got:
        assert (r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(r.doc_id, r.text)
        assert r.n == len(r.text or "") and r.back == (r.text or "")
    out = infill.rearrange(odd.withColumn("form", F.lit(3)), seed=5)
    assert out.columns == [c for c in odd.columns if c not in infill.ADDED] + infill.ADDED
    assert {(r.doc_id, r.output) for r in out.collect()} == {(r.doc_id, plainly(r.doc_id, r.text, 5)[3]) for r in odd.collect()}
    assert infill.rearrange(odd.limit(0)).count() == 0


def test_marks_that_could_be_confused_are_refused(odd):
    for marks in (("<P>", "<P>", "<M>"), ("<<P>", "<S>", "<M>"), ("<P>", "<P>>", "<M>"), ("<P>", "x<", "<M>"), ("P", "S", "M")):
        with pytest.raises(ValueError):
            infill.rearrange(odd, marks=marks)

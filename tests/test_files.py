"""Tables written as files: all or none."""

import os
import pickle

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanframe.sources.files import FilesReader, FilesWriter, checked, read_files, twice, write_files
from spanframe.sources.shared import short_plans


def tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(folder) for f in names}


def test_files_are_written_replaced_and_removed(spark, tmp_path):
    rows = [(f"a/{i}.txt", f"text {i}\né") for i in range(40)] + [("old.md", None), ("never.md", None), ("empty", "")]
    folder = tmp_path / "out"
    folder.mkdir()
    (folder / "old.md").write_text("stale")
    (folder / "stays").write_text("x")
    (folder / "empty").write_text("was here")
    df = spark.createDataFrame(rows, "name string, content string").repartition(7)
    for _ in range(2):
        write_files(df, str(folder))
        assert tree(folder) == {n: t.encode() for n, t in rows if t is not None} | {"stays": b"x"}
        assert sorted(os.listdir(folder)) == ["a", "empty", "stays"]
    write_files(spark.createDataFrame([("b", b"\0\xff")], "n string, c binary"), f"file://{folder}", "n", "c")
    assert tree(folder)["b"] == b"\0\xff"
    write_files(df.limit(0), str(tmp_path / "none"))
    assert tree(tmp_path / "none") == {}


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    rows = spark.range(100).repartition(8)
    torn = rows.select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 77, F.raise_error(F.lit("torn"))).otherwise(F.lit("x")).alias("content"))
    same = rows.select(F.concat(F.lit("f"), F.col("id") % 50).alias("name"), F.lit("x").alias("content"))
    out = rows.select(F.when(F.col("id") == 5, F.lit("../x")).otherwise(F.concat(F.lit("f"), "id")).alias("name"), F.lit("x").alias("content"))
    nameless = rows.select(F.lit(None).cast("string").alias("name"), F.lit("x").alias("content"))
    for i, (df, said) in enumerate([(torn, "torn"), (same, "several rows name one file"), (out, "not a name"), (nameless, "not a name")]):
        folder = tmp_path / str(i)
        folder.mkdir()
        (folder / "f3").write_text("before")
        with pytest.raises(Exception, match=said):
            write_files(df, str(folder))
        assert tree(folder) == {"f3": b"before"} and os.listdir(folder) == ["f3"] and not (tmp_path / "x").exists()


def test_names_stay_below_the_folder():
    assert checked("a/./b/../c") == "a/c"
    for name in ("", None, ".", "..", "../a", "/a", "a/../.."):
        with pytest.raises(ValueError):
            checked(name)


def test_written_files_are_read_by_lists(spark, tmp_path):
    rows = [(f"a/{i}\n.txt", "é" * 400_000 if i % 9 == 0 else f"text {i}") for i in range(40)] + [("gone", None), ("empty", "")]
    folder, lists = f"file://{tmp_path}/out", f"file://{tmp_path}/lists"
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "other").write_text("not of this job")
    write_files(spark.createDataFrame(rows, "name string, content string").repartition(7), folder, lists=lists)
    assert {r.name: bytes(r.content).decode() for r in read_files(spark, folder, lists).collect()} == {n: t for n, t in rows if t is not None}
    assert sorted(os.listdir(tmp_path / "out")) == ["a", "empty", "other"] and 0 < len(os.listdir(tmp_path / "lists")) <= 7
    write_files(spark.createDataFrame(rows[:0], "name string, content string"), folder, lists=f"file://{tmp_path}/none")
    assert read_files(spark, folder, f"file://{tmp_path}/none").collect() == []


def test_the_driver_holds_no_list_of_files(spark, tmp_path):
    """Names are in lists that tasks write, and reading is planned by them, not by files."""
    writer, n = FilesWriter(str(tmp_path / "out"), str(tmp_path / "lists")), 3000
    said = [writer.write(iter([pa.record_batch([[f"{t}-{i}.txt" for i in range(n)], ["x"] * n], ["name", "content"])])) for t in range(2)]
    assert all(len(pickle.dumps(m)) < 500 for m in said)
    writer.commit([*said, None])
    parts = FilesReader(str(tmp_path / "out"), str(tmp_path / "lists")).partitions()
    assert len(parts) == 2 and len(pickle.dumps(parts)) < 1000 and len(os.listdir(tmp_path / "out")) == 2 * n


def test_names_that_come_twice_are_found():
    assert twice(lambda: iter(["a", "b", "a"])) == "a" and twice(lambda: iter([])) is None and twice(lambda: iter("abc")) is None
    assert twice(lambda: (str(i) for i in range(1000))) is None


def test_descriptions_of_plans_are_bounded_for_a_while(spark):
    key = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(key)
    with pytest.raises(KeyError), short_plans(spark, "500"):
        assert spark.conf.get(key) == "500"
        raise KeyError
    assert spark.conf.get(key) == before

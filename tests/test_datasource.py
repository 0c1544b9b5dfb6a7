"""Packages as a data source: partitions, single uploads, streams of arrivals, and writes that fail."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from foliary.sources import datasource, packages, writers
from foliary.streaming import jobs


def made(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path, content in entries:
            z.writestr(path, content)
    return out.getvalue()


@pytest.fixture()
def folder(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.zip").write_bytes(made([("x.txt", b"1" * 100), ("d/", b""), ("d/y.txt", b"2" * 100), ("z.txt", b"3" * 100)]))
    (tmp_path / "in" / "sub" / "b.zip").write_bytes(made([("x.txt", b"4")]))
    (tmp_path / "in" / "c.docx").write_bytes(b"no package")
    return str(tmp_path / "in")


def rows(df):
    return sorted((os.path.basename(r.file), r.ord, r.path, r.size, bytes(r.content)) for r in df.collect())


WANT = [("a.zip", 0, "x.txt", 100, b"1" * 100), ("a.zip", 2, "d/y.txt", 100, b"2" * 100), ("a.zip", 3, "z.txt", 100, b"3" * 100), ("b.zip", 0, "x.txt", 1, b"4"), ("c.docx", 0, "c.docx", 10, b"no package")]


def test_entries_of_files(spark, folder):
    assert rows(spark.read.format("packages").load(folder)) == WANT
    small = spark.read.format("packages").option("maxBytes", "150").load(folder)
    assert rows(small) == WANT and small.rdd.getNumPartitions() >= 3  # a package is read by several tasks
    assert rows(spark.read.format("packages").option("glob", "*.zip").load(folder)) == WANT[:4]
    assert spark.read.format("packages").load(folder + "/none").count() == 0
    entries = packages.zip_entries(packages.files(spark, folder, "a.zip").select(F.lit(1).cast("long").alias("doc_id"), "content"))
    assert sorted((r.ord, r.path, r.size, bytes(r.content)) for r in entries.collect()) == [x[1:] for x in WANT[:3]]


def test_arrivals_are_taken_once(spark, folder, tmp_path):
    stream = lambda: spark.readStream.format("packages").option("glob", "*.zip").load(folder)
    assert rows(jobs.appended(stream(), str(tmp_path / "out"))) == WANT[:4]
    with open(f"{folder}/new.zip", "wb") as f:
        f.write(made([("n.txt", b"5")]))
    assert rows(jobs.appended(stream(), str(tmp_path / "out"))) == [*WANT[:4], ("new.zip", 0, "n.txt", 1, b"5")]
    assert rows(jobs.appended(stream(), str(tmp_path / "out"))) == [*WANT[:4], ("new.zip", 0, "n.txt", 1, b"5")]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    out, df = str(tmp_path / "out"), spark.range(40).select(F.col("id").alias("doc_id"), F.col("id").cast("string").cast("binary").alias("content")).repartition(4)
    writers.save(df.where("doc_id < 3"), out, "zip")

    def breaks(parts):
        for part in parts:
            for k in range(len(part)):
                if part["doc_id"].iloc[k] == 31:
                    raise ValueError("a task fails after some of its rows")
                yield part.iloc[k : k + 1]

    with pytest.raises(Exception, match="a task fails"):
        writers.save(df.mapInPandas(breaks, df.schema), out, "zip")
    assert sorted(x.path.rpartition("/")[2] for x in datasource.listed(out, "*")) == ["0.zip", "1.zip", "2.zip"]  # a task that is killed late may leave files aside
    saved = writers.save(df, out, "zip").collect()
    assert sorted(r.doc_id for r in saved) == list(range(40)) and {os.path.getsize(f"{out}/{i}.zip") for i in (5, 31)} == {1, 2}


def test_only_attempts_that_count_show(spark, tmp_path):
    w = datasource.Writer({"path": str(tmp_path / "w"), "suffix": "zip"}, False)
    first, again, other = w.write(iter([{"doc_id": 1, "content": b"late"}])), w.write(iter([{"doc_id": 1, "content": b"own"}])), w.write(iter([{"doc_id": 2, "content": b"b"}]))
    assert datasource.listed(str(tmp_path / "w"), "*") == [] and first != again
    w.commit([again, other, None])
    assert {p.name: p.read_bytes() for p in (tmp_path / "w").glob("*.zip")} == {"1.zip": b"own", "2.zip": b"b"}
    assert not list((tmp_path / "w").glob("_attempts/*"))

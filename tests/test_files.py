"""Files as data sources: names, errors, balance, and writes that are whole or not there."""

import os

import pytest
from pyspark.sql import functions as F

from foliant.plans import ingest
from foliant.sources import files


def tree(root):
    for name in ("a.txt", "_b.txt", ".c.txt", "d/e.txt", "d/_f/g.txt", "d/.h/i.txt", "d/j/k/l.txt", ".named/m.txt", "empty/.keep"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode() * 3)


@pytest.mark.parametrize("tasks", [1, 3, 64])
def test_listing(spark, tmp_path, tasks):
    tree(tmp_path)
    paths = [str(tmp_path), str(tmp_path / ".c.txt"), str(tmp_path / ".named"), str(tmp_path / "gone.txt"), str(tmp_path / "a.txt")]
    files.listed(spark, paths)
    import json

    found = spark.read.format("library_listing").option("paths", json.dumps(paths)).option("tasks", tasks).load().dropDuplicates(["path"]).collect()
    got = {os.path.relpath(r.path, tmp_path): (r.length, r.error) for r in found}
    assert got == {**{n: (3 * len(n), None) for n in ("a.txt", "_b.txt", "d/e.txt", "d/_f/g.txt", "d/j/k/l.txt", ".c.txt", ".named/m.txt")}, "gone.txt": (None, "no such file")}


def test_reading(spark, tmp_path):
    tree(tmp_path)
    (tmp_path / "big").write_bytes(b"x" * 5000)
    read = files.read(files.listed(spark, [str(tmp_path), str(tmp_path / "gone.txt")]), task_bytes=20)
    got = {os.path.relpath(r.path, tmp_path): (None if r.content is None else bytes(r.content), r.error) for r in read.collect()}
    assert got["d/e.txt"] == (b"d/e.txt" * 3, None) and got["big"][0] == b"x" * 5000 and got["gone.txt"] == (None, "no such file") and len(got) == 7
    assert read.rdd.getNumPartitions() >= 4
    assert files.read(files.listed(spark, [str(tmp_path / "empty")])).count() == 0
    # the import reads through it
    scanned = {os.path.basename(r.path) for r in ingest.scan(spark, str(tmp_path)).collect()}
    assert scanned == {"a.txt", "_b.txt", "e.txt", "g.txt", "l.txt", "big"}


def test_a_tree_is_written_whole_or_not_at_all(spark, tmp_path):
    rows = spark.range(40).select(F.format_string("w%d/_%d.txt", F.col("id") % 4, F.col("id")).alias("rel_path"), F.encode(F.repeat(F.lit("é"), F.col("id").cast("int")), "utf-8").alias("content")).repartition(5)
    target = tmp_path / "library"
    files.write_tree(rows, str(target))
    assert sorted(p.relative_to(target).as_posix() for p in target.rglob("*.txt")) == sorted(f"w{k % 4}/_{k}.txt" for k in range(40))
    assert (target / "w1/_5.txt").read_text() == "é" * 5
    with pytest.raises(Exception, match="already"):
        files.write_tree(rows, str(target))
    for bad in (rows.withColumn("rel_path", F.when(F.col("rel_path") == "w3/_39.txt", "../../out.txt").otherwise(F.col("rel_path"))), rows.withColumn("content", F.when(F.length("content") < 70, F.col("content")))):
        for place, overwrite in ((tmp_path / "new", False), (target, True)):
            with pytest.raises(Exception, match="outside|without content"):
                files.write_tree(bad, str(place), overwrite=overwrite)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["library"]
    assert len(list(target.rglob("*.txt"))) == 40
    files.write_tree(rows.limit(3), str(target), overwrite=True)
    assert len(list(target.rglob("*.txt"))) == 3 and sorted(p.name for p in tmp_path.iterdir()) == ["library"]


def test_json_lines_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nb", ["x", None], None), (2, None, [], 1.5), (3, "粽子  ", None, -0.0)], "id long, title string, tags array<string>, n double").repartition(2)
    files.write_json(rows, str(tmp_path / "export"))
    back = spark.read.schema(rows.schema).json(str(tmp_path / "export"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    files.write_json(rows.limit(0), str(tmp_path / "none"))
    assert spark.read.schema(rows.schema).json(str(tmp_path / "none")).count() == 0

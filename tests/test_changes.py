"""Changes between states, counts kept up by them, and deletes that prune."""

import random

import pytest

from foliant.sources import catalog, changes
from foliant.operators import view


def test_feed_and_updated_at(spark):
    schema = "id long, title string, tags array<string>"
    first = spark.createDataFrame([(1, "a", ["x"]), (2, None, None), (3, "c", []), (4, "d", None)], schema)
    second = spark.createDataFrame([(1, "a", ["x"]), (2, None, []), (3, "C", []), (5, "e", None)], schema)
    third = second.filter("id <> 1").withColumnRenamed("title", "name")
    one, two = changes.feed(first, second, "id", 2), changes.feed(second, third.withColumnRenamed("name", "title"), "id", 3)
    assert sorted(map(tuple, one.collect())) == [(2, "changed", 2), (3, "changed", 2), (4, "removed", 2), (5, "added", 2)]
    assert sorted(map(tuple, two.collect())) == [(1, "removed", 3)]
    assert changes.feed(first, first, "id", 9).count() == 0
    assert changes.feed(first, first.limit(0), "id", 9).count() == 4
    assert {r.kind for r in changes.feed(second, third, "id", 3).collect()} == {"removed", "changed"}
    got = {r.id: r.updated_at for r in changes.updated(second, one.unionByName(two), "id", 1).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 5: 2}
    files = spark.createDataFrame([(3, "pdf"), (3, "html")], "work_id long, format_detail string")
    latest = view.merge_candidates(changes.updated(second, one, "id", 1), files, limit=3)
    assert sorted((r.id, r.formats) for r in latest.collect()) == [(2, ""), (3, "html,pdf"), (5, "")]


def test_counts_are_kept_up(spark):
    rng = random.Random(7)
    links = {(rng.randrange(30), rng.choice("abcdefg")) for _ in range(80)}
    frame = lambda rows: spark.createDataFrame(sorted(rows), "work_id long, name string")
    counts = changes.counted(frame(links), ["name"])
    for step in range(3):
        touched = {rng.randrange(30) for _ in range(10)}
        after = {x for x in links if x[0] not in touched} | {(w, rng.choice("defgh")) for w in touched if rng.random() < 0.7}
        edits = spark.createDataFrame([(w,) for w in touched], "work_id long")
        counts = changes.kept_up(counts, changes.delta(frame(links), frame(after), edits, "work_id", ["name"]), ["name"])
        links = after
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, changes.counted(frame(links), ["name"]).collect())), step
    gone = changes.delta(frame(links), frame(links).limit(0), frame(links), "work_id", ["name"])
    assert changes.kept_up(counts, gone, ["name"]).count() == 0
    with pytest.raises(Exception, match="do not belong"):
        changes.kept_up(counts, gone.unionByName(gone), ["name"]).collect()


def test_deletes_prune_and_remove_folders(spark, tmp_path):
    works = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, title string")
    tags = spark.createDataFrame([(1, "only"), (1, "both"), (2, "both")], "work_id long, name string")
    series = spark.createDataFrame([(2, 8), (1, 9)], "work_id long, series_id long")
    tables = {"works": works, "work_tags": tags, "works_series": series, "tags": spark.createDataFrame([("only",), ("both",), ("unused",)], "name string"), "series": spark.createDataFrame([(8, "x"), (9, "y")], "series_id long, name string")}
    gone = spark.createDataFrame([(1,), (1,), (77,)], "id long")
    left, report = catalog.delete_works(tables, gone)
    assert report.first().asDict() == {"works_removed": 1, "tags_pruned": 2, "series_pruned": 1}
    assert [r.name for r in left["tags"].collect()] == ["both"] and [r.series_id for r in left["series"].collect()] == [8]
    for i in (1, 2):
        (tmp_path / f"library/{i:06d}/deep").mkdir(parents=True)
        (tmp_path / f"library/{i:06d}/deep/work.txt").write_text("x")
    got = {r.id: (r.removed, r.error) for r in catalog.remove_folders(str(tmp_path), gone).collect()}
    assert got == {1: (True, None), 77: (False, None)}
    assert [p.name for p in (tmp_path / "library").iterdir()] == ["000002"]

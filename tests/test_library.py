import pytest
from pyspark.sql import functions as F

from foliant.sources import files as files_of
from foliant.operators import group, query, view
from foliant.plans import ingest
from foliant.sources import catalog, demo


def test_read_model_of_the_demo(spark):
    t = demo.tables(spark)
    rows = {r.id: r for r in view.work_view(t["works"], t["files"], t["work_tags"], t["works_series"], t["relations"]).collect()}
    assert [(f.format_detail, f.version, f.role) for f in rows[1].files] == [("html", 2, "current"), ("pdf", 1, "current"), ("epub", 1, "current"), ("html", 1, "archived")]
    assert rows[1].tags == ["slow", "Winter"] and rows[6].tags == [] and rows[6].files is None
    assert (rows[2].published_display, rows[3].published_display, rows[4].published_display) == ("~2020", "2019-06", None)
    assert [rows[k].word_count_display for k in (1, 3, 4, 5)] == ["41,200", "~12,000", "\u2014", "8,000"]
    assert (rows[1].related, rows[2].related) == ([2], [1])
    assert "again in winter" in rows[1].search_text and "snow" in rows[1].search_text and "山中信" in rows[5].search_text.replace(" ", "")
    counts = view.counts(t["works"], t["files"], t["relations"], t["pending"]).first().asDict()
    assert counts == {"works_total": 6, "record_only": 1, "with_file": 5, "files_total": 8, "works_related": 2, "pending_total": 2}


def test_scopes_and_orders_of_the_demo(spark):
    t = demo.tables(spark)
    works = view.work_view(t["works"], t["files"], t["work_tags"], t["works_series"], t["relations"])
    ids = lambda **o: [r.id for r in query.ranked(works, query.Options(**o)).orderBy("row_no").collect()]
    assert ids(search="tag:winter", sort="words") == [2, 1]
    assert ids(search="comment:winter") == [1] and ids(search="summary:storm") == [3] and ids(search="lang:deutsch") == [2] and ids(search="tag:书") == [5]
    # Han by pinyin stands before Latin, no matter how bytes compare
    assert ids(sort="title", descending=False, include_record_only=True) == [5, 2, 3, 4, 6, 1]
    notes = view.pending_with_context(t["pending"], t["works"])
    assert [(r.external_id, r.from_title) for r in notes.orderBy("place").collect()] == [("7001", "The Salt Road"), ("7002", "山中信")]
    ranked = query.ranked(works, query.Options(sort="words")).select("id", F.col("row_no").alias("rank"), "translation_role")
    assert {r.id: r.anchor for r in group.by_translation(ranked, t["relations"]).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    # the first series by name is Coast, which holds work 3 alone
    assert {r.id: r.anchor for r in group.by_series(ranked, t["works_series"], t["series"]).collect()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 5}
    assert [r.title for r in view.lookup(t["works"], external_id="5105").collect()] == ["山中信"]
    assert view.lookup(t["series"], name="COAST").count() == 1
    stored = view.ordered_files(t["files"], store_order=True).filter("work_id = 1").first().files
    assert [(f.format_detail, f.version) for f in stored] == [("html", 2), ("epub", 1), ("pdf", 1), ("html", 1)]


def test_vocabularies_of_the_demo(spark):
    t = demo.tables(spark)
    edits = spark.createDataFrame([(2, ["Winter ", "new"]), (5, [])], "work_id long, tags array<string>")
    links, names = catalog.replace_tags(t["work_tags"], edits)
    assert sorted(map(tuple, links.collect())) == [(1, "Winter"), (1, "slow"), (2, "Winter"), (2, "new")]
    assert sorted(r.name for r in names.collect()) == ["Winter", "new", "slow"]
    merged = catalog.copy_source_tags(t["works"], t["work_tags"], spark.createDataFrame([(1,), (5,)], "work_id long"))
    assert {r.work_id: r.tags for r in merged.collect()} == {1: ["Winter", "slow", "Travel", "Snow"], 5: ["letters", "书信"]}
    series = spark.createDataFrame([(3, [("COAST", 2), ("Islands", None)])], "work_id long, memberships array<struct<name:string,position:int>>")
    links, names = catalog.replace_series(t["works_series"], t["series"], series)
    assert sorted(map(tuple, names.select("series_id", "name").collect())) == [(1, "harbour books"), (2, "Coast"), (3, "Islands")]
    assert sorted((r.series_id, r.position) for r in links.filter("work_id = 3").collect()) == [(2, 2), (3, None)]
    catalog.require_works(t["works"], t["works"])
    with pytest.raises(ValueError, match="99"):
        catalog.require_works(t["works"], spark.createDataFrame([(99,)], "id long"))


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "_a.txt").write_text("x")
    (tmp_path / ".b.txt").write_text("y")
    listing = files_of.listed(spark, [str(tmp_path), str(tmp_path / ".b.txt"), str(tmp_path / "none.txt")])
    assert sorted(r.path.rsplit("/", 1)[1] for r in listing.collect()) == [".b.txt", "_a.txt", "none.txt"]
    files = ingest.read_paths(listing)
    assert {r.path.rsplit("/", 1)[1]: (r.content and bytes(r.content)) for r in files.collect()} == {".b.txt": b"y", "_a.txt": b"x", "none.txt": None}
    with pytest.raises(OSError, match="none.txt"):
        ingest.require_readable(files)
    assert ingest.require_readable(files.filter("error is null")).count() == 2

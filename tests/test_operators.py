import random

import pytest

import __spark_entry__
from foliant.operators import group, query
from foliant.plans import ingest
from foliant.sources import catalog


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_entry_and_registry(spark):
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("seed", [1, 2])
def test_claims_follow_the_walk(spark, seed):
    rng = random.Random(seed)
    n = 30
    order = rng.sample(range(n), n)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(40)]
    near = {(a, b) for a, b in pairs if a != b} | {(b, a) for a, b in pairs if a != b}
    want = {}
    for w in order:
        if w not in want:
            want[w] = w
            for a, b in near:
                if a == w and b not in want:
                    want[b] = w
    ranks = spark.createDataFrame([(w, k) for k, w in enumerate(order)], "id long, rank long")
    near = sorted(near)
    claimers = spark.createDataFrame([(a, a) for a, _ in near], "claimer long, via long")
    got = group.claim(ranks, claimers, spark.createDataFrame(near, "via long, member long"))
    assert {r.id: r.anchor for r in got.collect()} == want


def test_series_of_several_works(spark):
    """Works in more series than one, without position, and the first series by name."""
    rng = random.Random(4)
    n, names = 40, {k: name for k, name in enumerate(("delta", "Alpha", "charlie", "Bravo", "echo", "alpine"))}
    links = sorted({(rng.randrange(n), rng.randrange(6)) for _ in range(70)})
    place = {link: rng.choice((None, 1, 2, 3)) for link in links}
    first = {w: min((names[s].lower(), s) for x, s in links if x == w)[1] for w, _ in links}
    want, anchors = {}, {}
    for w in range(n):
        if w not in anchors:
            anchors[w] = w
            for x, s in links:
                if s == first.get(w) and x not in anchors:
                    anchors[x] = w
    for a in set(anchors.values()):
        mine = [w for w in range(n) if anchors[w] == a]
        mine.sort(key=lambda w: ((p := place.get((w, first.get(a)))) is None, p or 0, w))
        want |= {w: (a, k + 1) for k, w in enumerate(mine)}
    ranked = spark.createDataFrame([(w, w) for w in range(n)], "id long, rank long")
    table = spark.createDataFrame([(w, s, place[w, s]) for w, s in links], "work_id long, series_id long, position int")
    got = group.by_series(ranked, table, spark.createDataFrame(list(names.items()), "series_id long, name string"))
    assert {r.id: (r.anchor, r.place) for r in got.collect()} == want


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ranks_of_many_splits(spark, tmp_path, adaptive):
    """Whole rows from 16 files keep their number, whatever is coalesced."""
    path = str(tmp_path / "works")
    spark.range(100_000).selectExpr("id", "concat('t', id) AS title", "cast(id * 7919 % 1000 AS long) AS word_count", "'has_file' AS status", "repeat('x', 50) AS filler").repartition(16).write.parquet(path)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = query.ranked(spark.read.parquet(path), query.Options(sort="words"))
        assert got.columns[-1] == "row_no" and "filler" in got.columns
        rows_ = sorted((r.row_no, r.word_count, r.id) for r in got.select("row_no", "word_count", "id").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    want = sorted(((i * 7919 % 1000, i) for i in range(100_000)), key=lambda x: (-x[0], x[1]))
    assert rows_ == [(k + 1, *x) for k, x in enumerate(want)]


def test_search_and_tags(spark):
    works = spark.createDataFrame([(1, "Rain, rain", "Ann", ["Fluff"], "has_file", "en", None), (2, "Sun", "Rain Smith", ["fluff", "Tea"], "has_file", None, "2019-01-01"), (3, "Rain", "Bo", [], "record_only", "en", "2020-01-01")], "id long, title string, author string, tags array<string>, status string, language string, published_at string").withColumnRenamed("x", "x")
    ids = lambda **o: [r.id for r in query.ranked(works.withColumn("word_count", works.id), query.Options(**o)).orderBy("row_no").collect()]
    assert ids(search="rain") == [1, 2]
    assert ids(search="rain", include_record_only=True) == [3, 1, 2]
    assert ids(search="author:rain") == [2]
    assert ids(search="!!!") == []
    assert ids(tags=["FLUFF", "tea"]) == [2]
    assert ids(languages=[""]) == [2]
    assert ids() == [1, 2]
    assert ids(undated="last") == [2, 1]


def test_catalog_round_trip(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path / "lib"))
    works = spark.createDataFrame([(1, "a", "x1"), (2, "b", None)], "id long, title string, external_id string")
    store.commit({"works": works})
    store.commit({"works": catalog.insert(store.table("works"), spark.createDataFrame([("c", "x9"), ("a", "x1")], "title string, external_id string"))})
    assert rows(store.table("works").select("id", "title")) == [(1, "a"), (2, "b"), (3, "c")]
    left = catalog.delete({"works": works, "relations": spark.createDataFrame([(1, 2)], "work_a long, work_b long")}, spark.createDataFrame([(2,)], "id long"))
    assert rows(left["works"].select("id")) == [(1,)] and rows(left["relations"]) == []


def test_catalog_states(spark, tmp_path):
    store, late = catalog.Catalog(spark, str(tmp_path / "lib")), catalog.Catalog(spark, str(tmp_path / "lib"))
    works = spark.createDataFrame([(1, "a")], "id long, title string")
    store.commit({"works": works})
    seen = late._state()
    store.commit({"works": works.withColumn("title", works.title)})
    late._state = lambda: seen
    with pytest.raises(RuntimeError):
        late.commit({"works": works})
    assert store.version() == catalog.SCHEMA_VERSION
    old = catalog.migrated(spark.createDataFrame([("5", 1)], "external_id string, from_work_id long"), "pending", 1)
    assert rows(old) == [("5", 1, False)]
    store.write_json(str(tmp_path / "json"), works)
    assert [r.value for r in spark.read.text(str(tmp_path / "json")).collect()] == ['{"id":1,"title":"a"}']


def test_insert_takes_an_external_id_once(spark):
    works = spark.createDataFrame([(4, "a", "x1")], "id long, title string, external_id string")
    new = spark.createDataFrame([("n", "x2"), ("m", "x2"), ("k", None), ("l", None), ("o", "x1")], "title string, external_id string")
    assert rows(catalog.insert(works, new).select("id", "title")) == [(4, "a"), (5, "k"), (6, "l"), (7, "m")]
    assert rows(catalog.insert(works.limit(0), new.limit(0))) == []
    with pytest.raises(Exception, match="must not be empty"):
        catalog.insert_record_only(works, spark.createDataFrame([(" ", "b")], "title string, author string")).collect()


def test_edits_that_fail(spark):
    works = spark.createDataFrame([(1, "has_file", "2019-01-01", "year")], "id long, status string, published_at string, published_prec string")
    edit = lambda **c: catalog.edit_works(works, spark.createDataFrame([(1, *c.values())], "id long, " + ", ".join(f"{k} string" for k in c))).collect()
    assert tuple(edit(published="2020.5")[0]) == (1, "has_file", "2020-05-01", "month")
    assert tuple(edit(published="")[0]) == (1, "has_file", None, None)
    for wrong in ({"published": "soon"}, {"status": "lost"}):
        with pytest.raises(Exception, match="no date|unknown status"):
            edit(**wrong)


def test_versions(spark):
    files = spark.createDataFrame([(1, 1, "html", 1, "h1", 1, "current", "p"), (2, 2, "pdf", 1, "h9", 1, "archived", "q"), (3, 2, "pdf", 2, "h8", 2, "current", "r")], "id long, work_id long, format_detail string, version int, file_hash string, seq int, role string, rel_path string")
    new = spark.createDataFrame([(1, "html", "h2", 1), (1, "html", "h2", 2), (1, "html", "h1", 3), (1, "pdf", "h3", 4)], "work_id long, format_detail string, file_hash string, seq int")
    got = catalog.store_files(files, new)
    assert rows(got.select("id", "work_id", "format_detail", "version", "role", "file_hash")) == [(1, 1, "html", 1, "archived", "h1"), (2, 2, "pdf", 1, "archived", "h9"), (3, 2, "pdf", 2, "current", "h8"), (4, 1, "html", 2, "current", "h2"), (5, 1, "pdf", 1, "current", "h3")]
    assert {r.id: r.rel_path for r in got.collect()}[4] == "library/000001/work.v2.html"
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    # a version chosen by hand stays chosen when others are stored
    chosen = catalog.set_current(got, one(2))
    assert rows(chosen.filter("work_id = 2").select("id", "role")) == [(2, "current"), (3, "archived")]
    assert rows(catalog.store_files(chosen, new.limit(0)).filter("work_id = 2").select("id", "role")) == [(2, "current"), (3, "archived")]
    assert rows(catalog.delete_versions(chosen, one(3)).select("id")) == [(1,), (2,), (4,), (5,)]
    with pytest.raises(ValueError):
        catalog.delete_versions(chosen, one(2))
    # replacing files share a path: the last one stays
    replacing = spark.createDataFrame([(1, "html", "h5", 1, "replace"), (1, "html", "h6", 2, "replace")], "work_id long, format_detail string, file_hash string, seq int, policy string")
    left = catalog.store_files(got, replacing).filter("work_id = 1 and format_detail = 'html'")
    assert rows(left.select("version", "role", "file_hash")) == [(1, "current", "h6"), (2, "archived", "h2")]


def test_paths_stay_inside(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    assert catalog.inside("/lib", "library/000001/work.txt") == "/lib/library/000001/work.txt"
    with pytest.raises(ValueError):
        catalog.inside("/lib", "../etc/x")
    rows_ = [(f"file:{tmp_path}/a.txt", "library/000001/work.txt"), (f"{tmp_path}/none", "library/000002/work.txt"), (f"{tmp_path}/a.txt", "../out.txt")]
    done = {r.rel_path: r.error for r in catalog.copy_files(spark, str(tmp_path / "lib"), spark.createDataFrame(rows_, "source_path string, rel_path string")).collect()}
    assert (tmp_path / "lib/library/000001/work.txt").read_text() == "hello"
    assert done["library/000001/work.txt"] is None and done["library/000002/work.txt"] and done["../out.txt"]


def test_plan(spark, tmp_path):
    folder = tmp_path / ".home" / "in"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("hello world")
    (folder / "b.txt").write_text("hello world")
    (folder / ".hidden.txt").write_text("no")
    (folder / "known.txt").write_text("stored before")
    files = ingest.group_key(ingest.inspect(ingest.scan(spark, str(folder))))
    hashes = {r.name: r.file_hash for r in files.select("name", "file_hash").collect()}
    assert set(hashes) == {"a.txt", "b.txt", "known.txt"}
    works = spark.createDataFrame([(7, "A", None), (9, "Other", None)], "id long, title string, external_id string")
    stored = spark.createDataFrame([(9, "txt", hashes["known.txt"], 1)], "work_id long, format_detail string, file_hash string, version int")
    plan = ingest.plan_files(files, works, stored)
    got = {r.name: (r.group_key, r.action, r.existing_work_id, r.batch_repeat) for r in plan.collect()}
    # the same bytes stay with their first file, stored ones with the work that holds them
    assert got == {"a.txt": ("stem:a", "attach", 7, False), "b.txt": ("stem:a", "replace", 7, True), "known.txt": ("work:9", "skipped_duplicate", 9, False)}
    assert rows(ingest.summary(plan)) == [(0, 2, 3, 2, 1)]
    manual = spark.createDataFrame([("stem:a", 9)], "group_key string, work_id long")
    assert {r.existing_work_id for r in ingest.plan_files(files, works, stored, manual).collect()} == {9}
    left = ingest.withdraw(manual, manual)
    assert {r.existing_work_id for r in ingest.plan_files(files, works, stored, left).collect()} == {7, 9}


DOWNLOAD = """<div class=meta><h1>{title}</h1></div><p class=message><a href="http://example.test/works/{id}">x</a></p>
<dl class=tags><dt>Language:</dt><dd>Deutsch</dd><dt>Additional Tags:</dt><dd><a>Tea</a></dd><dt>Stats:</dt><dd>Published: 2019-05-01 Words: 1,234</dd></dl><ul><li>{relation} <a href="/works/{other}">Other</a></li></ul>"""


def test_execute(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.html").write_text(DOWNLOAD.format(title="One", id=31, relation="Translation into Deutsch available:", other=42))
    (folder / "two.html").write_text(DOWNLOAD.format(title="Two", id=42, relation="A translation of", other=31))
    (folder / "three.html").write_text(DOWNLOAD.format(title="Three", id=53, relation="Translation into Deutsch available:", other=999))
    (folder / "old.txt").write_text("some more words of an old work")
    works = spark.createDataFrame([(7, "Old", None, 0, None, "has_file")], "id long, title string, external_id string, word_count long, language string, status string")
    files = spark.createDataFrame([], "id long, work_id long, format_class string, format_detail string, file_hash string, version int, role string, rel_path string")
    tables = {"works": works, "files": files, "relations": spark.createDataFrame([], "work_a long, work_b long"), "pending": spark.createDataFrame([], "external_id string, from_work_id long, title string, dismissed boolean")}
    found = ingest.group_key(ingest.inspect(ingest.scan(spark, str(folder))))
    out, report = ingest.execute(tables, ingest.plan_files(found, works, files))
    assert report.first().asDict() == {"works_created": 3, "works_matched": 1, "files_stored": 4, "files_skipped": 0, "relations_stored": 1, "relations_pending": 1}
    assert rows(out["works"].select("id", "title", "external_id", "word_count", "language")) == [(10, "Two", "42", 1234, "de"), (7, "Old", None, 7, None), (8, "One", "31", 1234, "de"), (9, "Three", "53", 1234, "de")]
    assert rows(out["files"].select("work_id", "rel_path", "role")) == [(n, f"library/{n:06d}/work.{e}", "current") for n, e in ((10, "html"), (7, "txt"), (8, "html"), (9, "html"))]
    assert rows(out["relations"]) == [(8, 10)] and rows(out["pending"]) == [("999", 9, "Other", False)]
    # the same batch again changes nothing
    again, report = ingest.execute(out, ingest.plan_files(found, out["works"], out["files"]))
    assert report.first().asDict() == {"works_created": 0, "works_matched": 4, "files_stored": 0, "files_skipped": 4, "relations_stored": 0, "relations_pending": 1}
    assert rows(again["files"].select("id", "role")) == rows(out["files"].select("id", "role"))


def test_relations(spark):
    parsed = spark.createDataFrame([("20011", [("translation_of", "9307", "o")]), ("9307", [("translation_into", "20011", "t"), ("translation_into", "5", "later"), ("inspired_by", "6", "no")])], "work_id string, related array<struct<kind:string,work_id:string,title:string>>")
    resolved, pending = ingest.plan_relations(parsed, spark.createDataFrame([("20011",), ("9307",)], "external_id string"))
    assert rows(resolved) == [("9307", "20011")]
    assert rows(pending) == [("5", "9307", "later")]


def test_a_rising_chain_is_walked_in_few_jobs(spark):
    """Each work is claimed by the next one: a round per work, were it decided in rounds."""
    n = 5000
    rng = random.Random(8)
    names = rng.sample(range(10**6), n)
    ranks = spark.createDataFrame([(w, k) for k, w in enumerate(names)], "id long, rank long")
    pairs = [(a, b) for a, b in zip(names, names[1:], strict=False)]
    both = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "claimer long, member long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    got = group.claim(ranks, both.selectExpr("claimer", "claimer as via"), both.selectExpr("claimer as via", "member"))
    found = {r.id: r.anchor for r in got.collect()}
    n_jobs = len(tracker.getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("", "")
    assert found == {w: names[k - k % 2] for k, w in enumerate(names)}
    assert n_jobs < 20


@pytest.mark.parametrize("limit", [400, 60, 8])
def test_walks_and_rounds_agree(spark, monkeypatch, limit):
    """Components found first, some walked and some, or all, in rounds."""
    rng = random.Random(limit)
    n = 60
    pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(30)} | {(k, k + 1) for k in range(40, 55)})
    pairs = [(a, b) for a, b in pairs if a != b]
    order = rng.sample(range(n), n)
    want = {}
    for w in order:
        if w not in want:
            want[w] = w
            for a, b in pairs:
                if w in (a, b):
                    want.setdefault(a + b - w, w)
    both = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "claimer long, member long")
    ranks = spark.createDataFrame([(w, k) for k, w in enumerate(order)], "id long, rank long")
    monkeypatch.setattr(group, "WALK_LINKS", limit)
    got = group.claim(ranks, both.selectExpr("claimer", "claimer as via"), both.selectExpr("claimer as via", "member"))
    assert {r.id: r.anchor for r in got.collect()} == want


def test_a_page_without_a_title_is_plain_text(spark, tmp_path):
    page = '<html><body><div id="preface"><p class="message">Posted at <a href="http://example.test/works/123">here</a></p>{}</div><p>Some words here</p></body></html>'
    (tmp_path / "a.html").write_text(page.format(""))
    (tmp_path / "b.html").write_text(page.format("<h1>Named</h1>"))
    files = {r.name: r for r in ingest.inspect(ingest.scan(spark, str(tmp_path))).collect()}
    assert files["a.html"].word_count and files["a.html"].parsed is None
    assert files["b.html"].parsed.title == "Named"
    none = spark.createDataFrame([], "id long, title string, external_id string")
    stored = spark.createDataFrame([], "work_id long, format_detail string, file_hash string")
    plan = ingest.plan_files(ingest.group_key(ingest.inspect(ingest.scan(spark, str(tmp_path)))), none, stored)
    assert {r.name: r.title for r in plan.collect()}["a.html"] == "a"


def test_line_items_are_dealt_before_they_are_grouped(spark):
    from foliant.sources import adapter

    plan = lambda name: adapter.view(spark, "/root/testdata/sf0.001", name)._jdf.queryExecution().executedPlan().toString()
    files = plan("files")
    assert files.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in files
    assert "REPARTITION_BY_NUM" in plan("work_tags")


def test_components_of_claims_have_works_alone_as_nodes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(group, "WALK_LINKS", 4)
    monkeypatch.setattr(group, "components", lambda edges, f=group.components: seen.append(sorted(map(tuple, edges.collect()))) or f(edges))
    pairs = [(1, 2), (2, 3), (7, 8)]
    both = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "claimer long, member long")
    ranks = spark.createDataFrame([(w, w) for w in (1, 2, 3, 7, 8, 9)], "id long, rank long")
    got = group.claim(ranks, both.selectExpr("claimer", "claimer as via").union(spark.createDataFrame([(9, 9)], "a long, b long")), both.selectExpr("claimer as via", "member"))
    assert {r.id: r.anchor for r in got.collect()} == {1: 1, 2: 1, 3: 3, 7: 7, 8: 7, 9: 9}
    assert seen == [[(1, 2), (1, 3), (2, 3), (7, 8)]]

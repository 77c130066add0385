"""The trigram index gives what a scan gives, and reads only what may match."""

import random

from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators import query, trigrams

WORDS = ["粽子", "驴 abc", "One-Two", "tale", "Ångström", "ﬁn", "ＡＢＣ", "x", "77", "straße", "ΣΟΦΟΣ", "two tales", "の", "!!!", "𐐀𐐁𐐂𐐃"]


def library(spark, n=300, seed=3):
    rng = random.Random(seed)
    some = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(k))) or None
    rows = [(i, some(4), some(3), some(6), some(3), rng.choice(["en", "zh", None]), "has_file" if i % 7 else "record_only", None, [some(2) or "t", "shared"]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, title string, author string, summary string, my_comment string, language string, status string, published_at string, tags array<string>")


def test_search_through_the_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "ROWS", 100)
    works = library(spark)
    index = trigrams.index_works(works, str(tmp_path / "index"))
    for search in ("title:tale two shared", "驴", "nothing-like-it", "title:x 77", "!!!", "comment:abc summary:fin", "shared 𐐁𐐂𐐃"):
        options = query.Options(search=search)
        got = trigrams.search(index, options)
        want = query.ranked(works, options)
        assert set(got.columns) == set(want.columns)
        columns = sorted(want.columns)
        assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect())), search
    assert trigrams.search(index, query.Options(search="tale")).count() > 50


def test_texts_through_the_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "ROWS", 10)
    rng = random.Random(5)
    texts = [(k, None if k % 11 == 0 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(30)))) for k in range(100)] + [(200, "a" * 50_000 + " needle " + "ö" * 50_000), (None, "tale"), (7, "tale")]
    df = spark.createDataFrame(texts, "id long, body string")
    index = trigrams.index_texts(df, "body", ["id"], str(tmp_path / "i"))
    for search in ("needle", "öööö", "one two 粽子", "zz", ""):
        want = df.filter(text.matches_terms(text.fold(F.col("body")), query.fold_literal(search).split()))
        if not search:
            want = df.filter("body is not null")
        assert sorted(map(repr, trigrams.containing(index, "body", search).select("id").collect())) == sorted(map(repr, want.select("id").collect())), search
    empty = trigrams.index_texts(df.limit(0), "body", ["id"], str(tmp_path / "none"))
    assert trigrams.containing(empty, "body", "tale").count() == 0


def test_only_parts_with_candidates_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "ROWS", 10)
    df = spark.createDataFrame([(k, "needle" if k == 55 else f"straw {k}") for k in range(200)], "id long, body string")
    index = trigrams.index_texts(df, "body", ["id"], str(tmp_path / "i"))
    found = index.matching([(("body",), "needle")])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {f.rpartition("part=")[2].split("/")[0] for f in index.rows().filter("part = 5").inputFiles()} >= {"5"}
    assert [r.id for r in found.collect()] == [55]
    # no candidates: nothing is read
    assert index.matching([(("body",), "hayfork")]).count() == 0


def test_a_search_folds_each_text_once(spark):
    works = library(spark, 20)
    plan = query.select(works, query.Options(search="tale two title:x"))._jdf.queryExecution().optimizedPlan().toString()
    one = works.select(query.scope_text(works, "title"))._jdf.queryExecution().optimizedPlan().toString()
    many = query.with_folded(works)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == many.count("regexp_replace") and one.count("regexp_replace") > 0


def test_postings_hold_every_trigram_of_every_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "ROWS", 10)
    rng = random.Random(8)
    df = spark.createDataFrame([(k, " ".join(rng.choice(WORDS) for _ in range(12)) if k % 9 else "ab" if k else None) for k in range(60)], "id long, body string")
    index = trigrams.index_texts(df, "body", ["id"], str(tmp_path / "i"))
    rows = index.rows().collect()
    want = {("body", g, r.part, r.slot) for r in rows for g in trigrams.grams_of(r._fold_body or "")}
    posts = index.postings().collect()
    assert {(p.field, p.gram, p.part, s) for p in posts for s in p.slots} == want and all(p.n == len(p.slots) == len(set(p.slots)) for p in posts)
    # no row of a trigram and a slot is made, and nothing that is folded or listed is sorted by ranges, for which it would be made twice
    plan = index.posted(index.rows())._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "rangepartitioning" not in plan and "MapInArrow" in plan


def test_trigrams_of_long_texts_and_many_characters(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(trigrams, "RUN_CHARS", 7)
    many = "".join(chr(0x20000 + k) for k in range(1 << 15)) + "xyz"
    texts = ["abcdefghijklmnop", "", None, "ab", "abcabc", "𐐀𐐁𐐂𐐃" * 5, "é" * 30]

    def found(texts, parts):
        batch = pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32()), "slot": pa.array(range(len(texts)), pa.int32()), "t": pa.array(texts, pa.string())})
        out = set()
        for part, of, slots in trigrams.text_runs(batch, "t"):
            letters = np.frombuffer("".join(of).encode("utf-32-le"), "<u4")
            for grams, first, slot in trigrams.listed(letters, np.repeat(np.array(slots, np.int64), [len(t) for t in of])):
                for g, own in zip(grams, np.split(slot, first[1:]), strict=True):
                    out |= {(part, g, s) for s in own.tolist()}
        return out

    parts = [0, 0, 0, 1, 1, 2, 2]
    assert found(texts, parts) == {(p, g, k) for k, (p, t) in enumerate(zip(parts, texts, strict=True)) for g in trigrams.grams_of(t or "")}
    monkeypatch.setattr(trigrams, "RUN_CHARS", 1 << 20)
    assert found([many, "xyz"], [0, 0]) == {(0, g, k) for k, t in enumerate([many, "xyz"]) for g in trigrams.grams_of(t)}

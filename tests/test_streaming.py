"""A stream of files keeps what importing them batch by batch keeps."""

import os
import random

import pytest
from pyspark.sql import functions as F

from foliant.plans import ingest
from foliant.streaming import ingest as stream

WORKS = "id long, title string, external_id string, word_count long, language string, status string"
FILES = "id long, work_id long, format_class string, format_detail string, file_hash string, version int, role string, rel_path string"


def arriving(folder, seed, contents):
    """Names, contents and what is alike among them; modified in the order of their paths."""
    rng = random.Random(seed)
    names = sorted(f"f{k:02d}/{rng.choice(['tale', 'Saga', 'ode', 'song'])}.{rng.choice(['txt', 'html', 'pdf'])}" for k in range(24))
    out = []
    for k, name in enumerate(names):
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        text = f"text {rng.randrange(contents)}"
        path.write_bytes({"pdf": b"%PDF-1 ", "html": b"<!doctype html><p>", "txt": b""}[name[-3:] if name[-3:] != "tml" else "html"] + text.encode())
        os.utime(path, (1_700_000_000 + 60 * k, 1_700_000_000 + 60 * k))
        out.append(path)
    return out


def by_execute(spark, paths, size, keep_both):
    """Titles of works and their files after as many imports."""
    none = lambda schema: spark.createDataFrame([], schema)
    tables = {"works": none(WORKS), "files": none(FILES), "relations": none("work_a long, work_b long"), "pending": none("external_id string, from_work_id long, title string, dismissed boolean")}
    from foliant import storage

    for at in range(0, len(paths), size):
        some = spark.createDataFrame([(str(p), bytearray(p.read_bytes())) for p in paths[at : at + size]], "path string, content binary")
        plan = ingest.plan_files(ingest.group_key(ingest.inspect(some)), tables["works"], tables["files"], keep_both=keep_both)
        tables = ingest.execute(tables, plan)[0]
        tables = {k: storage.store(v, k) for k, v in tables.items()}
    named = tables["files"].join(tables["works"].select(F.col("id").alias("work_id"), "title"), "work_id")
    return sorted(map(tuple, named.select(F.lower("title"), "format_detail", "version", "file_hash", "role").collect()))


@pytest.mark.parametrize(("size", "keep_both"), [(8, True), (8, False)])
def test_a_stream_equals_imports(spark, tmp_path, size, keep_both):
    # bytes that were replaced and come again would be new to an import, see watch()
    paths = arriving(tmp_path / "in", 5, 14 if keep_both else 10**6)
    run = lambda: stream.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), keep_both, size).awaitTermination()
    run()
    table = lambda: spark.read.parquet(str(tmp_path / "out"))
    got = sorted(map(tuple, stream.versions(table()).select(F.lower("title"), "format_detail", "version", "file_hash", "role").collect()))
    assert got == by_execute(spark, paths, size, keep_both)
    assert table().count() == len(paths) and (table().filter("action = 'skipped_duplicate'").count() > 3) == keep_both
    # a restart from the checkpoint repeats nothing, and goes on with what is new
    run()
    assert table().count() == len(paths)
    (tmp_path / "in/zz").mkdir()
    (tmp_path / "in/zz/tale.txt").write_bytes(paths[-1].read_bytes())
    (tmp_path / "in/zz/ode.txt").write_bytes(b"new words")
    run()
    assert {r.action for r in table().filter("path like '%/zz/%'").collect()} == {"skipped_duplicate", "keep_both" if keep_both else "replace"}

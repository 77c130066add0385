"""Whitening, collocations and language identification against brute force, exact sums and held-out texts."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import collocations, common, hashcounts, langid, whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1.5, "x") for i, v in rows], "vec_id long, embedding array<float>, whitened double, key string")


@pytest.mark.parametrize(("tile", "rows"), [(64, 256), (3, 7)])
def test_whitening(spark, tile, rows):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 20)) @ rng.normal(size=(20, 20)) * 0.3
    base[50:] *= 900  # wider integers
    listed = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    listed += [(None, listed[3][1]), (3, listed[3][1]), *[(100 + k, listed[7][1]) for k in range(40)]]
    bad = [(200, None), (201, [float("nan")] + [0.0] * 19), (202, [None] + [0.0] * 19), (203, [float("inf")] + [0.0] * 19), (204, [1.0] * 5), (205, [])]
    df = vectors(spark, listed + bad)
    model = whitening.fit(df, tile=tile, rows=rows)
    got = whitening.apply(df, model).collect()
    x = np.array([[int(np.floor(64 * float(c))) + 1000000 for c in v] for _, v in listed])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    v = centred.T @ centred / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    assert len(got) == 16 * len(listed)
    by = defaultdict(list)
    for r in got:
        by[r.vec_id, r.component].append(r)
    for (i, vec), xi in zip(listed, x, strict=True):
        want = int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(xi, s, strict=True)))
        for c in range(16):
            rows_ = by[i, c + 1]
            y = (xi - s / n) @ w[:, c] / np.sqrt(e[c])
            r = next(r for r in rows_ if abs(abs(r.whitened) - abs(y)) < 1e-7 * max(1, abs(y)))
            assert r.n == n and r.deviation == want and r.deviation_text == str(want)
            assert abs(r.explained - e[c] / e.sum()) < 1e-10 and r.identity_error < 1e-9
    for c in range(16):
        y = np.array([by[i, c + 1][0].whitened for i, _ in listed[:60]])
        z = (x[:60] - s / n) @ w[:, c] / np.sqrt(e[c])
        assert np.allclose(y, z) or np.allclose(y, -z)


def test_whitening_of_few_and_none(spark):
    one = vectors(spark, [(1, [0.5, -0.5, 0.25]), (2, [0.5, -0.5, 0.25]), (3, None)])
    got = whitening.apply(one, whitening.fit(one)).collect()
    assert sorted((r.vec_id, r.component) for r in got) == [(i, c) for i in (1, 2) for c in (1, 2, 3)]
    assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 1 for r in got)
    two = vectors(spark, [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])])
    got = whitening.apply(two, whitening.fit(two)).collect()
    assert [r.whitened is None for r in sorted(got, key=lambda r: (r.component, r.vec_id))] == [False, False, True, True, True, True]
    assert abs(next(r.explained for r in got if r.component == 1) - 1) < 1e-12
    for empty in (one.limit(0), vectors(spark, [(1, []), (2, None)])):
        none = whitening.apply(empty, whitening.fit(empty))
        assert none.columns[:3] == ["vec_id", "component", "n"] and none.count() == 0


def test_whitening_sums_beyond_a_long():
    x = np.full((3, 2), 2**62 - 1)
    assert whitening.exact_sums(x) == [3 * (2**62 - 1)] * 2
    model = whitening.Whitening(3, [9 * 2**51, 0], np.zeros((2, 1)), np.zeros(1, bool), [None])
    far = np.array([[2**51, 5], [-(2**51), 7]])
    assert model.deviations(far) == [(3 * int(a) - 9 * 2**51) ** 2 + (3 * int(b)) ** 2 for a, b in far]
    for width in (100, 30_000, 2**30, 2**50):
        rows = np.array([[width, -width], [width - 1, 0]])
        assert (whitening.unpack(whitening.pack(rows), 2) == rows).all()


def brute_collocations(rows, max_n=4, least=3, share=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for size in range(1, max_n + 1):
                f[lang or "und"].update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            cuts = [((2_000_000 * a) // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(len(q) > len(p) and 100 * b >= share * a and any(q[j : j + len(p)] == p for j in range(len(q) - len(p) + 1)) for q, b in cand.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l_, r, n[lang], -score) for rank, (score, a, p, l_, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_collocations(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [*"abcdefgh", "New", "YORK", "é", "É", "a b", "zz"]
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", "", ".", ",", "\n", "\t x", " "]) for _ in range(rng.randrange(0, 60)))) for _ in range(80)]
    rows += [("en", None), (None, ""), ("fr", " . , \n"), ("de", "one two three four five " * 6), ("de", "one two three four five " * 6), ("en", "x y " * 900)]
    df = spark.createDataFrame([(k, lang, text, "n", 3) for k, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int")
    got = sorted(map(tuple, collocations.mine(df, least=3).collect()))
    assert got == brute_collocations(rows) and len(got) > 100
    # long pieces in parts, texts in parts, small runs, a table of bits in which nearly all collide, and few ranks
    for name, value in (("PIECE_WORDS", 50), ("TEXT_BYTES", 64), ("RUN_WORDS", 100)):
        monkeypatch.setattr(collocations, name, value)
    parts = [c for words, starts in collocations.piece_runs(b"x y " * 900, 4) for c in words[:starts]]
    assert parts == [b"x", b"y"] * 900
    monkeypatch.setattr(collocations, "TOP", 5)
    assert sorted(map(tuple, collocations.mine(df, least=3, top=5).collect())) == brute_collocations(rows, top=5)
    assert collocations.phrase_counts(df, 4, 3, 8).count() == collocations.phrase_counts(df, 4, 3).count()
    assert collocations.mine(df.limit(0)).count() == 0


def test_phrases_of_a_run_are_exact_and_shards_apart(spark, monkeypatch):
    words = ["a", "b", "c", "long" * 40, "é", "aaaaaaaa", "aaaaaaaab"]
    rng = random.Random(9)
    pieces = [[rng.choice(words) for _ in range(rng.randrange(6))] for _ in range(300)]
    want = Counter(("de" if i % 2 else "en", " ".join(p[k : k + n]).encode()) for i, p in enumerate(pieces) for n in range(1, 5) for k in range(len(p) - n + 1))
    want.update(("de" if i % 2 else "en", None) for i, p in enumerate(pieces) for _ in p)
    run = collocations.Run()
    for i, p in enumerate(pieces):
        run.add("de" if i % 2 else "en", "  ".join(p).encode() + b" ")
    run.cut()
    assert len(set(collocations.word_hashes(run.vocabulary).tolist())) == len(words)
    # keys that are all the same leave no count to chance
    monkeypatch.setattr(collocations, "word_hashes", lambda words: np.zeros(len(words), np.uint64))
    got = Counter()
    for batch in run.counts(4, lambda keys: np.ones(len(keys), bool)):
        for row in batch.to_pylist():
            got[row["lang"], row["phrase"]] += row["n"]
    assert got == want
    # the words a long piece's part reaches over start nothing
    over = collocations.Run()
    over.add("en", b"a b c", 2)
    over.add("en", b"")
    assert [at.tolist() for _, at, _ in over.cut().keys(4)] == [[0], [0], [0], []]

    rows = spark.range(4000).select("id")
    counted = hashcounts.counted(rows, lambda batches: (np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2) for _ in batches), 1, 5)
    shards = counted.select("shard", F.spark_partition_id().alias("p")).collect()
    assert len({r.shard for r in shards}) == 32 == len({r.p for r in shards})


def test_shards_need_the_same_memory_for_any_split(spark, monkeypatch, tmp_path):
    path = f"{tmp_path}/rows.parquet"
    spark.range(20_000).selectExpr("uuid() AS text").coalesce(1).write.parquet(path)
    size = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet") if f.is_file())
    monkeypatch.setattr(hashcounts, "SHARD_BYTES", size // 500, raising=False)
    one = spark.read.parquet(path).filter("text is not null")
    assert one.rdd.getNumPartitions() == 1 and 1 << hashcounts.shard_bits(one) == 512
    assert hashcounts.shard_bits(spark.range(10)) <= hashcounts.shard_bits(one)
    # parts are sorted again only as the sum doubles, even if that is more than a chunk
    sorted_ = []
    added = hashcounts.added
    monkeypatch.setattr(hashcounts, "CHUNK", 100)
    monkeypatch.setattr(hashcounts, "added", lambda parts: sorted_.append(sum(len(h) for h, _ in parts)) or added(parts))
    rng = np.random.default_rng(3)
    parts = [np.unique(rng.integers(0, 50_000, 50).astype(np.uint64)) for _ in range(400)]
    h, n = hashcounts.summed((x, np.ones(len(x), np.uint64)) for x in parts)
    want = Counter(np.concatenate(parts).tolist())
    assert dict(zip(h.tolist(), n.tolist(), strict=True)) == want and sum(sorted_) < 6 * len(np.concatenate(parts))
    # neither planes of zeros nor the number of the shard travel with each hash
    for x in (np.zeros(0, np.uint64), np.array([7], np.uint64), np.unique(rng.integers(0, 2**48, 5000).astype(np.uint64)) + np.uint64(2**63)):
        assert hashcounts.unpack(hashcounts.pack(x)).tolist() == x.tolist() and len(hashcounts.pack(x)) <= 6 * len(x) + 9


def test_several_bits_leave_less_to_chance(spark):
    rng = np.random.default_rng(5)
    keys, others = (rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2) + np.uint64(k) for k in (0, 1))
    table = hashcounts.counted(spark.range(1).select("id"), lambda batches: (keys for _ in batches), 1, 5)
    chance = {}
    for probes in (1, 3):
        bits = hashcounts.bits_of(table, 15, 5, probes)
        assert bits.has(keys).all() and len(bits.table) == 1 << 12
        chance[probes] = bits.has(others).mean()
    assert chance[3] < 0.06 < 0.1 < chance[1]


def test_scores_beyond_64_bits(spark):
    big = 2**62
    known = spark.createDataFrame([("en", "a", big), ("en", "b", big + 1), ("en", "a b", big - 5)], "lang string, phrase string, f long")
    got = collocations.scored(known.filter("phrase = 'a b'").withColumnRenamed("f", "a"), known).first()
    assert got.score == Fraction(2_000_000 * (big - 5), 2 * big + 1).__floor__()


WORDS = {"xx": "kal oru mibe tano felu", "yy": "strum gronk blasch knarf zwelt", "zz": "aieo uiao eaou oiea ueia"}


def invented(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", "la" if lang == "xx" else "sch" if lang == "yy" else "ei"]) for _ in range(n))


def test_languages(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        lang = rng.choice(["xx", "xx", "xx", "yy", "zz"])
        rows.append((i, lang, invented(rng, lang, rng.randrange(3, 80))))
    mixed = [(1000, None, invented(rng, "xx", 60) + " " + invented(rng, "yy", 30)), (1001, None, invented(rng, "zz", 10) + " " + invented(rng, "yy", 90)), (1002, None, " ".join(invented(rng, k, 50) for k in WORDS))]
    odd = [(2000, "xx", None), (2001, "yy", ""), (2002, None, "123 -- 456 _ ²"), (None, "yy", invented(rng, "yy", 20)), (2003, None, invented(rng, "zz", 4000)), (2004, None, "q" * 5000), (2003, None, invented(rng, "xx", 5))]
    df = spark.createDataFrame([(i, lang, t, 0.5, "s") for i, lang, t in rows + mixed + odd], "doc_id long, lang string, text string, score double, languages string")
    model = langid.fit(df)
    assert model.languages == ["xx", "yy", "zz"]
    got = langid.identify(df, model).collect()
    assert len(got) == len(rows) + len(mixed) + len(odd)
    by = {r.doc_id: r for r in got}
    held = [(i, lang) for i, lang, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 60 and all(by[i].lang_pred == lang and 0.5 < by[i].score <= 1 for i, lang in held)
    assert [sorted(p.split(":")[0] for p in by[i].languages.split(",")) for i in (1000, 1001, 1002)] == [["xx", "yy"], ["yy", "zz"], ["xx", "yy", "zz"]]
    assert abs(float(by[1000].languages.split(":")[1].split(",")[0]) - 2 / 3) < 0.05 and by[1001].lang_pred == "yy"
    assert [(by[i].lang_pred, by[i].score) for i in (2000, 2001, 2002)] == [("und", 0.0)] * 3
    assert by[None].lang_pred == "yy" and by[2004].n_words == -(-5000 // langid.WORD_LETTERS)
    assert sorted(r.lang_pred for r in got if r.doc_id == 2003) == ["xx", "zz"]
    # nothing to learn from, no rows
    blind = langid.fit(df.filter("lang is null"))
    assert {(r.lang_pred, r.score) for r in langid.identify(df, blind).collect()} == {("und", 0.0)}
    assert langid.identify(df.limit(0), model).count() == 0
    # one language only
    alone = langid.fit(df.filter("lang = 'yy'"))
    assert {r.lang_pred for r in langid.identify(df.filter("doc_id < 400"), alone).collect()} == {"yy"}


def test_proportions_reach_the_likelihood_maximum():
    rng = np.random.default_rng(1)
    like, n = np.log(rng.random((40, 2))), rng.integers(1, 5, 40).astype(float)
    pi, reached = langid.proportions(like, n)
    grid = np.linspace(0, 1, 2001)
    best = max(float(n @ np.log(np.exp(like) @ np.array([p, 1 - p]))) for p in grid)
    assert abs(reached - best) < 1e-2 and abs(pi.sum() - 1) < 1e-9


def test_remembered_words_give_the_same(monkeypatch, spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, k, invented(rng, k, 20)) for i, k in enumerate(list(WORDS) * 8)], "doc_id long, lang string, text string")
    model = langid.fit(docs)
    words = [f"{a}{b}" for a in WORDS["xx"].split() for b in "abcdefgh"]
    want = model.fresh(words)
    monkeypatch.setattr(langid, "REMEMBERED", 10)
    for at in (0, 5, 17):
        assert np.allclose(model.likelihoods(words[at : at + 8]), want[at : at + 8])
    assert np.allclose(model.likelihoods(words), want)


def test_folds(spark):
    rows = spark.range(50).select("id", common.fold4("id").alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)

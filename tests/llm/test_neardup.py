"""Near duplicates against brute force over all pairs."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import neardup


def brute_classes(texts: dict[int, str], similarity: float = neardup.SIMILARITY) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Smallest id of each text's class, and the pairs of different texts that reach the similarity."""
    bags = {}
    for i, t in texts.items():
        w = tuple((t or "").encode().lower().split())
        size = min(5, len(w))
        bags[i] = (w, Counter(w[k : k + size] for k in range(len(w) - size + 1)) if w else Counter())
    df = Counter(x for _, bag in bags.values() for x in bag)
    n = max(1, sum(bool(w) for w, _ in bags.values()))
    idf = {x: 1 + math.log((n + 1) / c) / math.log(n + 1) for x, c in df.items()}
    own = {}
    for i, (w, bag) in bags.items():
        if w:
            own.setdefault(w, (i, {x: c * idf[x] for x, c in bag.items()}))
    nodes = list(own.values())
    names = {x: k for k, x in enumerate(idf)}
    matrix = np.zeros((len(nodes), len(names)))
    for k, (_, bag) in enumerate(nodes):
        for x, v in bag.items():
            matrix[k, names[x]] = v
    root = {i: i for i in texts}

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    links = []
    for k in range(len(nodes)):
        low = np.minimum(matrix[k], matrix).sum(1)
        for m in np.flatnonzero(low / (matrix[k].sum() + matrix.sum(1) - low) >= similarity):
            if m > k:
                links.append((nodes[k][0], nodes[m][0]))
    for a, b in [*links, *[(own[w][0], i) for i, (w, _) in bags.items() if w]]:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in texts}, links


def edited(words: list[str], rng: random.Random, edits: int) -> str:
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10**9)}"
    return " ".join(out)


def table(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts, base, other = {}, prose(150), prose(90)
    for i in range(300):
        texts[i] = edited(base, rng, rng.choice((0, 1, 1, 2, 2, 3, 4, 6, 9)))
    # chains: each a copy of the one before, so that the ends are unlike
    at = other
    for i in range(300, 360):
        at = edited(at, rng, 1).split()
        texts[i] = " ".join(at)
    for i in range(360, 600):
        texts[i] = " ".join(prose(rng.randrange(1, 120)))
    order = list(texts)
    rng.shuffle(order)
    texts = {new: texts[old] for new, old in enumerate(order)}
    want, links = brute_classes(texts)
    got = {r.doc_id: r.class_id for r in neardup.classes(table(spark, texts)).collect()}
    # a link may lack a bucket, with a probability that the bands make small
    caught = sum(got[a] == got[b] for a, b in links)
    assert len(links) > 250 and caught >= 0.99 * len(links)
    assert all(want[i] == want[c] for i, c in got.items())


def test_small_corpus_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want, _ = brute_classes(texts)
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == want


def test_document_frequencies(spark, monkeypatch):
    """Weights are those of plain counts, whether a shingle is hot or looked up, in one batch or many."""
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for i in range(300)}
    df = Counter(x for t in texts.values() for x in set(neardup.shingles(t.encode())[1].tolist()))
    n = sum(bool(t) for t in texts.values())
    for hot, batch in ((neardup.HOT, neardup.BATCH), (20, 100), (1, 1000)):
        monkeypatch.setattr(neardup, "HOT", hot)
        monkeypatch.setattr(neardup, "BATCH", batch)
        ids, vecs = neardup.vectors(table(spark, texts), 0.0)
        assert ids.count() == len(texts)
        seen = {}
        for r in vecs.collect():
            h, w = np.frombuffer(r.hashes, np.uint64), np.frombuffer(r.weights, np.float32)
            seen[bytes(r.key)] = dict(zip(h.tolist(), w.tolist(), strict=True))
        assert len(seen) == len({t for t in texts.values() if t})
        for t in texts.values():
            if t:
                key, h = neardup.shingles(t.encode())
                want = {x: c * (1 + math.log((n + 1) / df[x]) / math.log(n + 1)) for x, c in Counter(h.tolist()).items()}
                got = seen[key]
                assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-5 * want[x] for x in want)


def test_null_and_repeated_ids_join_by_words(spark):
    """Near copies without ids of their own: rows of joins stay in proportion to the texts."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    texts = [edited(base, rng, 1) for _ in range(400)]
    for ids in ([None] * 400, [7] * 400, list(range(400))):
        df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        found, vecs = neardup.vectors(df, neardup.SIMILARITY)
        assert found.count() == 400 and 300 < vecs.count() <= 400
        got = neardup.classes(df).collect()
        assert len(got) == 400 and len({r.class_id for r in got}) == 1
        assert neardup.keep_one(df).count() == 1


def test_one_row_of_each_class_stays(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, a, 0), (1, a, 1), (1, b, 2), (2, a, 3), (None, a, 4), (None, b, 5), (None, "only this one here stands alone", 6), (None, None, 7), (None, "", 8), (3, b, 9), (4, "", 10), (3, " ", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(r.class_id for r in kept.collect())
    assert got in ([0, 2, 6, 7, 8, 10, 11], [1, 2, 6, 7, 8, 10, 11])
    assert neardup.keep_one(df.limit(0)).count() == 0
    assert df.filter(F.col("doc_id").isNull()).count() == neardup.classes(df).filter(F.col("doc_id").isNull()).count()

"""Operator 9: exact top-k by inner product, with a ball tree per shard.

Components become floor(256 * x). Candidates are cut into shards, and each shard's ball tree is built once and stored.
A block of queries goes through all trees by branch and bound: nodes are visited by descending upper bound
q.c + |q| r and a query leaves a node whose bound is under the k-th score it has so far. That score starts from a pass
over a bounded sample of candidates and is carried along through all trees of a task, so later ones prune more. Per tree at
most k rows of a query remain, and a ranked window reduces them before the shuffle.

Queries are processed in blocks of BLOCK_QUERIES, each a bounded broadcast; a block reads the stored trees alone.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of different
lengths are not compared; ties go to the smaller vec_id; repeated rows are queries and candidates each on its own, and a
query leaves out its own row alone, whatever others share its vec_id; a null vec_id is no query and sorts last among
candidates of equal score; other columns are not read.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm import common

K = 5
SCALE = 256
EVERY = 50
LEAF = 64
SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
SEED_ROWS = 2048
LAST = np.iinfo(np.int64).max
LOW = np.iinfo(np.int64).min


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the integer components of each vector that takes part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(sound).select("vec_id", F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integers: in floating point as long as every sum stays under 2^53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class BallTree:
    """Nodes in preorder; a leaf holds order[first:last]."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, v: np.ndarray, leaf: int = LEAF) -> None:
        self.ids, self.rows, self.v, self.order = ids, rows, v, np.arange(len(v))
        x = v.astype(np.float64)
        centers, radii, spans, children = [], [], [], []
        stack = [(0, len(v), -1, 0)]
        while stack:
            first, last, parent, side = stack.pop()
            own = self.order[first:last]
            center = x[own].mean(0)
            far = np.sqrt(((x[own] - center) ** 2).sum(1))
            node = len(centers)
            centers.append(center)
            radii.append(far.max())
            spans.append((first, last))
            children.append([-1, -1])
            if parent >= 0:
                children[parent][side] = node
            if last - first > leaf and far.max() > 0:
                a = x[own[far.argmax()]]
                b = x[own[((x[own] - a) ** 2).sum(1).argmax()]]
                along = x[own] @ (b - a)
                half = (last - first) // 2
                self.order[first:last] = own[np.argpartition(along, half)]
                stack += [(first, first + half, node, 0), (first + half, last, node, 1)]
        self.centers, self.radii, self.spans, self.children = np.array(centers), np.array(radii), np.array(spans), np.array(children)

    FIELDS = ("ids", "rows", "v", "order", "centers", "radii", "spans", "children")

    def to_bytes(self) -> bytes:
        """The arrays, the vectors in the narrowest integers that hold them."""
        out = io.BytesIO()
        most = int(np.abs(self.v).max(initial=0))
        narrow = next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), np.int64)
        np.savez(out, **{f: self.v.astype(narrow) if f == "v" else getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def of_bytes(cls, raw: bytes) -> BallTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as arrays:
            for f in cls.FIELDS:
                setattr(tree, f, arrays[f].astype(np.int64) if f == "v" else arrays[f])
        return tree

    def search(self, own_row: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of each query in this tree, of those not under floor; floor rises in place."""
        x = q.astype(np.float64)
        norm = np.sqrt((x**2).sum(1))
        bound = x @ self.centers.T + norm[:, None] * self.radii
        bound += 0.5 + 1e-9 * np.abs(bound)
        scores = np.full((len(q), k), LOW)
        ids = np.full((len(q), k), LAST)
        # Best first over the whole block: a node is taken with the queries that still need it.
        import heapq

        heap = [(-bound[:, 0].max(initial=-np.inf), 0, np.arange(len(q)))]
        while heap:
            _, node, active = heapq.heappop(heap)
            active = active[bound[active, node] >= floor[active]]
            if not len(active):
                continue
            if self.children[node][0] >= 0:
                for child in self.children[node]:
                    own = active[bound[active, child] >= floor[active]]
                    if len(own):
                        heapq.heappush(heap, (-bound[own, child].max(), child, own))
                continue
            rows = self.order[self.spans[node][0] : self.spans[node][1]]
            got = product(q[active], self.v[rows])
            names = np.broadcast_to(self.ids[rows], got.shape)
            got = np.where((self.rows[rows] == own_row[active][:, None]) | (got < floor[active][:, None]), LOW, got)
            both = np.concatenate([scores[active], got], 1)
            who = np.concatenate([ids[active], np.where(got == LOW, LAST, names)], 1)
            best = np.lexsort((who, -both.astype(np.float64) if np.abs(both[both > LOW]).max(initial=0) < 2**53 else ~both), axis=1)[:, :k]
            scores[active] = np.take_along_axis(both, best, 1)
            ids[active] = np.take_along_axis(who, best, 1)
            floor[active] = np.maximum(floor[active], scores[active][:, -1])
        return scores, ids


def by_length(found: list[tuple[int | None, int, list[int]]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, row numbers and vectors, length by length. A null id becomes the largest one."""
    by: dict[int, list] = {}
    for i, row, v in found:
        by.setdefault(len(v), []).append((LAST if i is None else i, row, v))
    for n in sorted(by):
        yield np.array([i for i, _, _ in by[n]], np.int64), np.array([r for _, r, _ in by[n]], np.int64), np.array([v for _, _, v in by[n]], np.int64).reshape(len(by[n]), n)


def first_floors(own_row: np.ndarray, q: np.ndarray, sample: list, k: int) -> np.ndarray:
    """A lower bound of each query's k-th score: its k-th score among sample candidates."""
    floor = np.full(len(q), LOW)
    for _, rows, v in by_length(sample):
        if v.shape[1] == q.shape[1] and len(rows) > k:
            got = np.where(rows == own_row[:, None], LOW, product(q, v))
            floor = np.partition(got, -k, axis=1)[:, -k]
    return floor


def trees(base: DataFrame, shard_rows: int) -> DataFrame:
    """A row per shard and length of vectors: length and the stored ball tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def built(rows: list) -> Iterator[pa.RecordBatch]:
            for ids, numbers, v in by_length(rows):
                yield pa.RecordBatch.from_pydict({"length": pa.array([v.shape[1]], pa.int32()), "tree": [BallTree(ids, numbers, v).to_bytes()]})

        rows: list = []
        for batch in batches:
            rows += zip(batch["vec_id"].to_pylist(), batch["row"].to_pylist(), batch["v"].to_pylist(), strict=True)
            while len(rows) >= shard_rows:
                yield from built(rows[:shard_rows])
                rows = rows[shard_rows:]
        yield from built(rows)

    return base.mapInArrow(run, "length int, tree binary")


def topk(vectors: DataFrame, wanted: Column, k: int = K, scale: int = SCALE, block_queries: int = BLOCK_QUERIES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of vectors for each row that wanted holds for."""
    spark = vectors.sparkSession
    base = common.store(scaled(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = base.filter(wanted & F.col("vec_id").isNotNull())
    n_blocks = max(1, -(-asked.count() // block_queries))
    sample = [(r["vec_id"], r["row"], r["v"]) for r in base.limit(SEED_ROWS).collect()]
    built = common.store(trees(base, shard_rows), "ball-trees")
    found = []
    for block in range(n_blocks):
        own = asked if n_blocks == 1 else asked.filter(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == block)
        sent = [(ids, rows, q, first_floors(rows, q, sample, k)) for ids, rows, q in by_length([(r["vec_id"], r["row"], r["v"]) for r in own.collect()])]
        sent = spark.sparkContext.broadcast(sent)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            blocks = [(ids, rows, q, floor.copy()) for ids, rows, q, floor in sent.value]
            for batch in batches:
                for at in range(batch.num_rows):
                    same = [x for x in blocks if x[2].shape[1] == batch["length"][at].as_py()]
                    tree = BallTree.of_bytes(batch["tree"][at].as_py()) if same else None
                    for ids, rows, q, floor in same:
                        scores, names = tree.search(rows, q, k, floor)
                        hit = scores > LOW
                        yield pa.RecordBatch.from_pydict({"query_row": np.repeat(rows, k).reshape(-1, k)[hit], "query_id": np.repeat(ids, k).reshape(-1, k)[hit], "vec_id": pa.array(names[hit], mask=names[hit] == LAST), "score": scores[hit]})

        rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
        part = built.mapInArrow(run, "query_row bigint, query_id bigint, vec_id bigint, score bigint").withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if n_blocks > 1:
            # one block at a time: its queries leave driver and executors before the next is collected
            part = common.store(part, "answers")
            sent.unpersist()
        found.append(part)
    return functools.reduce(DataFrame.unionByName, found)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP9_SQL = """
WITH base AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM base q JOIN base c ON q.vec_id % 50 = 0 AND c.r <> q.r AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scores)
SELECT * FROM ranked WHERE rank <= 5
"""
QUERIES = {"op9_topk": op9_topk}
SQL = {"op9_topk": OP9_SQL}

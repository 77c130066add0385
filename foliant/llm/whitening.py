"""Operator 11: whitening of embeddings by a tiled covariance.

Each entry c becomes the integer x = floor(64 c) + 1000000. The constant cancels in all results, so that vectors travel
without it, packed into the narrowest integers that hold them; equal vectors have equal bytes.

1. Fit list: the distinct vectors, written once, with their number n and the exact sum of each dimension.
2. Pairs of dimensions are cut into tiles of TILE x TILE. The rows of the fit list are cut into row blocks, and a row
   block's columns into column blocks. A column block goes to every tile that it is a side of, keyed by tile and row
   block; there both sides meet, are centred and multiplied, products of one tile add up as they stream by, and
   what is left of each task is summed per tile.
3. The tiles, as many numbers as there are pairs of dimensions and however many rows, are assembled and decomposed on
   the driver. Every row is then projected on the first COMPONENTS eigenvectors.

Defined results: rows whose vector is null, or holds null, non-finite or (as no long holds them) entries of 2 ** 46
or more, give no rows; neither do vectors of another length than the most frequent one (the longer, if two are as
frequent). Repeated rows and rows without an id each get their own result and count once in the fit list. Of a
component with eigenvalue zero, as with fewer distinct vectors than components, whitened is null and identity_error
leaves it out; explained is null where all eigenvalues are zero. A deviation that no long holds is null; deviation_text
has its digits always. An eigenvector's sign makes its largest entry positive. No rows give an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import common

SCALE = 64
COMPONENTS = 16
#: Dimensions a side of a tile, and rows a block; a block is one row of the shuffle, 16 KB of single bytes.
TILE, BLOCK_ROWS = 64, 256
#: Entries from this size on count as not finite.
TOO_LARGE = 2.0**46
LONG = 2**63 - 1


def sound(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has nothing but finite entries."""
    fits = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < TOO_LARGE))
    return vectors.filter(F.col(column).isNotNull() & F.coalesce(fits, F.lit(False)))


def common_length(vectors: DataFrame, column: str) -> int:
    """The most frequent length; 0 without rows."""
    top = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).limit(1).collect()
    return top[0]["d"] if top else 0


def pack(x: np.ndarray) -> list[bytes]:
    """Rows of integers as little-endian bytes of the narrowest width that holds the row."""
    out = np.empty(len(x), object)
    most = np.maximum(x.max(1), -1 - x.min(1))
    done = np.zeros(len(x), bool)
    for width in (1, 2, 4, 8):
        at = np.flatnonzero(~done & (most < 2 ** (8 * width - 1))) if width < 8 else np.flatnonzero(~done)
        raw, step = x[at].astype(f"<i{width}").tobytes(), width * x.shape[1]
        for k, row in enumerate(at):
            out[row] = raw[k * step : (k + 1) * step]
        done[at] = True
    return list(out)


def unpack(rows: list[bytes], d: int) -> np.ndarray:
    out = np.empty((len(rows), d), np.int64)
    widths = np.array([len(r) // d for r in rows])
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        out[at] = np.frombuffer(b"".join(rows[k] for k in at), f"<i{width}").reshape(-1, d)
    return out


def packed(vectors: DataFrame, column: str, key: str, d: int) -> DataFrame:
    """key and x, the packed integers of each sound vector of d entries."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows:
            c = batch["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            yield pa.RecordBatch.from_pydict({"key": batch["key"], "x": pa.array(pack(np.floor(SCALE * c).astype(np.int64)), pa.binary())})

    of = sound(vectors.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("vector")), "vector").filter(F.size("vector") == d)
    return common.map_slices(of, "key bigint, x binary", run)


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns, as wide as they get."""
    wide = np.abs(x).max(initial=0) >= 2**62 // max(1, len(x))
    return [int(s) for s in (x.astype(object) if wide else x).sum(0)]


def row_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of every dimension; a task sends one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            if batch.num_rows:
                n += batch.num_rows
                total = [a + b for a, b in zip(total, exact_sums(unpack(batch["x"].to_pylist(), d)), strict=True)]
        yield pa.RecordBatch.from_pydict({"sums": [[str(s) for s in (n, *total)]]}, pa.schema([("sums", pa.list_(pa.string()))]))

    found = fit.select("x").mapInArrow(run, "sums array<string>").select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = {r["at"]: int(r["s"]) for r in found.collect()}
    return sums.get(0, 0), [sums.get(k + 1, 0) for k in range(d)]


def column_blocks(fit: DataFrame, d: int, tile: int, rows: int) -> DataFrame:
    """One row per row block, tile and side of it: the packed columns of that side."""
    edges = [(a, min(a + tile, d)) for a in range(0, d, tile)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                x = unpack(batch["x"].slice(at, rows).to_pylist(), d)
                k += 1
                out = []
                for c, (a, b) in enumerate(edges):
                    raw = pack(x[:, a:b].reshape(1, -1))[0]
                    out += [(min(c, o), max(c, o), k, c, len(x), raw) for o in range(len(edges))]
                yield pa.RecordBatch.from_pydict(dict(zip(("ti", "tj", "block", "side", "n", "x"), map(list, zip(*out, strict=True)), strict=True)), pa.schema([("ti", pa.int32()), ("tj", pa.int32()), ("block", pa.int64()), ("side", pa.int32()), ("n", pa.int32()), ("x", pa.binary())]))

    return fit.select("x").mapInArrow(run, "ti int, tj int, block long, side int, n int, x binary")


def covariance(fit: DataFrame, n: int, mean: np.ndarray, tile: int = TILE, rows: int = BLOCK_ROWS) -> np.ndarray:
    """Centred products of all pairs of dimensions over the rows of fit, divided by n."""
    d = len(mean)

    def centred(raw: bytes, count: int, c: int) -> np.ndarray:
        a, b = c * tile, min(c * tile + tile, d)
        return np.frombuffer(raw, f"<i{len(raw) // (count * (b - a))}").reshape(count, b - a) - mean[a:b]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, left = None, None, None
        done = lambda: pa.RecordBatch.from_pydict({"ti": [at[0]], "tj": [at[1]], "sums": [total.ravel()]}, pa.schema([("ti", pa.int32()), ("tj", pa.int32()), ("sums", pa.list_(pa.float64()))]))
        for batch in batches:
            for ti, tj, block, side, count, raw in zip(*(batch[k].to_pylist() for k in ("ti", "tj", "block", "side", "n", "x")), strict=True):
                if (ti, tj) != at:
                    if at is not None:
                        yield done()
                    at, total = (ti, tj), 0.0
                y = centred(raw, count, side)
                if side == ti:
                    left = (block, y)
                if side == tj:
                    if left is None or left[0] != block:
                        raise ValueError("the two sides of a tile did not meet")
                    total = total + left[1].T @ y
        if at is not None:
            yield done()

    dealt = column_blocks(fit, d, tile, rows).repartition("ti", "tj", "block").sortWithinPartitions("ti", "tj", "block", "side")
    sums = dealt.mapInArrow(multiply, "ti int, tj int, sums array<double>").select("ti", "tj", F.posexplode("sums").alias("at", "s"))
    tiles = sums.groupBy("ti", "tj", "at").agg(F.sum("s").alias("s")).groupBy("ti", "tj").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("sums"))
    out = np.zeros((d, d))
    # a row per tile: d * d numbers together
    for r in tiles.collect():
        i, j = slice(r["ti"] * tile, min(r["ti"] * tile + tile, d)), slice(r["tj"] * tile, min(r["tj"] * tile + tile, d))
        part = np.array([s["s"] for s in r["sums"]]).reshape(i.stop - i.start, j.stop - j.start) / n
        out[i, j] = part
        out[j, i] = part.T
    return out


@dataclass
class Whitening:
    """What projects a vector: n and the exact sums of the fit list, directions by column (zero where there is no
    eigenvalue) and what each explains."""

    n: int
    sums: list[int]
    directions: np.ndarray
    alive: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array([s / self.n for s in self.sums])) @ self.directions

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sum over dimensions of (n x - S) ** 2."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most * most * max(1, x.shape[1]) <= LONG else object
        t = self.n * x.astype(kind) - np.array(self.sums, kind)
        return [int(v) for v in (t * t).sum(1)]


def decompose(v: np.ndarray, n: int, sums: list[int], components: int) -> Whitening:
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1][:components], vectors[:, ::-1][:, :components]
    lead = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
    alive = e > 8 * len(v) * np.finfo(float).eps * e.max(initial=0)
    directions = np.where(alive, vectors * np.where(lead < 0, -1, 1) / np.sqrt(np.where(alive, e, 1)), 0)
    trace = float(np.trace(v))
    return Whitening(n, sums, directions, alive, [float(max(x, 0) / trace) if trace > 0 else None for x in e])


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened fit list's covariance minus the identity, over components with an eigenvalue."""
    d, c = model.directions.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(c + c * c)
        for batch in batches:
            if batch.num_rows:
                y = model.whiten(unpack(batch["x"].to_pylist(), d))
                total += np.r_[y.sum(0), (y.T @ y).ravel()]
        yield pa.RecordBatch.from_pydict({"s": [total]}, pa.schema([("s", pa.list_(pa.float64()))]))

    got = {r["at"]: r["s"] for r in fit.select("x").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).collect()}
    flat = np.array([got[k] for k in range(len(got))]) / model.n
    cov = (flat[c:].reshape(c, c) - np.outer(flat[:c], flat[:c]))[np.ix_(model.alive, model.alive)]
    return float(np.abs(cov - np.eye(len(cov))).max()) if len(cov) else None


def fit(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS, tile: int = TILE, rows: int = BLOCK_ROWS) -> Whitening | None:
    """The whitening of all distinct vectors; None if there are none."""
    d = common_length(sound(vectors, column), column)
    if not d:
        return None
    distinct = common.store(packed(vectors, column, key, d).select("x").distinct(), "whitening-fit")
    n, sums = row_sums(distinct, d)
    model = decompose(covariance(distinct, n, np.array([s / n for s in sums]), tile, rows), n, sums, components)
    model.identity_error = identity_error(distinct, model)
    common.discard(distinct)
    return model


SCHEMA = "key bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_text string"


def apply(vectors: DataFrame, model: Whitening | None, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """A row for each sound vector and component."""
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA).withColumnRenamed("key", key)
    d, c = model.directions.shape

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows:
            x, r = unpack(batch["x"].to_pylist(), d), batch.num_rows
            deviations = model.deviations(x)
            each = lambda values, kind: pa.array([v for v in values for _ in range(c)], kind)
            yield pa.RecordBatch.from_pydict({
                "key": each(batch["key"].to_pylist(), pa.int64()), "component": np.tile(np.arange(1, c + 1, dtype=np.int32), r), "n": np.full(r * c, model.n), "deviation": each([v if v <= LONG else None for v in deviations], pa.int64()),
                "whitened": pa.array(model.whiten(x).ravel(), mask=np.tile(~model.alive, r)), "explained": pa.array(model.explained * r, pa.float64()), "identity_error": pa.array([model.identity_error] * (r * c), pa.float64()), "deviation_text": each(map(str, deviations), pa.string()),
            })

    return common.map_slices(packed(vectors, column, key, d), SCHEMA, run).withColumnRenamed("key", key)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return apply(vectors, fit(vectors))


QUERIES = {"op11_whitening": op11_whitening}
SQL: dict[str, str] = {}

"""Operator 5: quality, by ordinal cumulative-link regression on graded ratings.

A text is a unit vector of hashed tokens (words and runs of signs, log counts). One weight vector is shared by all
grades; ordered thresholds cut its score: P(grade <= k) = sigmoid(threshold_k - w.x). From that come the expected
grade and the tail probability P(grade >= KEEP), by which documents are selected.

Grades come from labels: 0 for quality 0, 1 for quality 1 that is toxic, 2 for quality 1 that is not. The model is
fitted on a bounded sample of labelled rows outside the held-out fold (TRAIN_ROWS). labels, lang, source and doc_id
are no inputs of a score.

Defined results: null and empty texts are the zero vector and get what the thresholds alone give; without labelled
rows all grades are equally likely; repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import common, sampling

DIMENSIONS = 1 << 12
GRADES = 3
#: Selection: the tail probability of this grade or better.
KEEP, LEAST_TAIL = 1, 0.5
TRAIN_ROWS = 6_000
TOKEN = re.compile(r"\w+|[^\w\s]+")


class Hasher:
    """Tokens to places and signs; remembers frequent ones."""

    def __init__(self) -> None:
        self.cache: dict[str, int] = {}

    def place(self, token: str) -> int:
        got = self.cache.get(token)
        if got is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            got = self.cache[token] = zlib.crc32(token.encode("utf-8", "replace")) & (2 * DIMENSIONS - 1)
        return got

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the unit vector; the lowest bit of a hash is its sign."""
        counts = Counter(map(self.place, TOKEN.findall(text.lower())))
        at = np.fromiter(counts.keys(), np.int64, len(counts))
        values = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        norm = np.sqrt((values**2).sum()) or 1.0
        return at >> 1, np.where(at & 1, values, -values) / norm

    def __reduce__(self):
        return Hasher, ()


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def at_most(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k), a column per threshold."""
        return 1 / (1 + np.exp(np.clip(scores[:, None] - self.thresholds, -40, 40)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, epochs: int = 200, rate: float = 0.2, shrink: float = 3e-4) -> Model:
    """Maximum likelihood with Adam over all rows; thresholds stay ordered as a first one and positive gaps."""
    n = len(rows)
    if not n:
        return Model(np.zeros(DIMENSIONS), np.log(np.arange(1, GRADES) / (GRADES - np.arange(1, GRADES))))
    owner = np.repeat(np.arange(n), [len(a) for a, _ in rows])
    at, value = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
    share = np.clip(np.array([(grades <= k).mean() for k in range(GRADES - 1)]), 0.5 / n, 1 - 0.5 / n)
    cuts = np.log(share / (1 - share))
    first, gaps = cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))
    w = np.zeros(DIMENSIONS)
    values = [w, first, gaps]
    m, v = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]
    top, bottom = grades < GRADES - 1, grades > 0
    for epoch in range(1, epochs + 1):
        theta = np.r_[values[1], values[1] + np.cumsum(np.exp(values[2]))]
        s = np.bincount(owner, values[0][at] * value, n)
        upper = np.where(top, 1 / (1 + np.exp(np.clip(s - theta[np.minimum(grades, GRADES - 2)], -40, 40))), 1.0)
        lower = np.where(bottom, 1 / (1 + np.exp(np.clip(s - theta[np.maximum(grades - 1, 0)], -40, 40))), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        d_theta = np.zeros(GRADES - 1)
        np.add.at(d_theta, np.minimum(grades, GRADES - 2)[top], (-upper * (1 - upper) / p)[top] / n)
        np.add.at(d_theta, (grades - 1)[bottom], (lower * (1 - lower) / p)[bottom] / n)
        tail = np.cumsum(d_theta[::-1])[::-1]
        grads = [np.bincount(at, (1 - upper - lower)[owner] * value, DIMENSIONS) / n + shrink * values[0], tail[:1], tail[1:] * np.exp(values[2])]
        for k, g in enumerate(grads):
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            values[k] = values[k] - rate * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.99**epoch)) + 1e-8)
    return Model(values[0], np.r_[values[1], values[1] + np.cumsum(np.exp(values[2]))])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    sample = sampling.labelled(docs, labels, ["quality", "toxic"], rows)
    hasher = Hasher()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [hasher(t or "") for t in batch["text"].to_pylist()]
        grade = [0 if q == 0 else 1 if t else 2 for q, t in zip(batch["quality"].to_pylist(), batch["toxic"].to_pylist(), strict=True)]
        schema = pa.schema([("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float32())), ("grade", pa.int32())])
        yield pa.RecordBatch.from_pydict({"at": [a for a, _ in found], "value": [v.astype(np.float32) for _, v in found], "grade": grade}, schema)

    got = common.map_slices(sample, "at array<int>, value array<float>, grade int", run).toArrow()
    rows_in = [(np.array(a.values, np.int64), np.array(v.values, np.float64)) for a, v in zip(got["at"], got["value"], strict=True)]
    grades = got["grade"].to_numpy().astype(np.int64)
    order = sorted(range(len(rows_in)), key=lambda k: (grades[k], len(rows_in[k][0]), rows_in[k][0].tobytes()))
    common.discard(sample)
    return fit_ordinal([rows_in[k] for k in order], grades[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade and tail_probability of every document."""
    hasher = Hasher()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = np.zeros(batch.num_rows)
        for k, text in enumerate(batch["text"].to_pylist()):
            at, value = hasher(text or "")
            s[k] = model.weights[at] @ value
        under = model.at_most(s)
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "expected_grade": (1 - under).sum(1), "tail_probability": 1 - under[:, KEEP - 1]})

    return common.map_slices(docs.select("doc_id", "text"), "doc_id bigint, expected_grade double, tail_probability double", run)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(common.fold4("doc_id") == sampling.HELD_OUT, F.lit(False)).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= LEAST_TAIL).alias("selected"))


QUERIES = {"op5_quality": op5_quality}
SQL: dict[str, str] = {}

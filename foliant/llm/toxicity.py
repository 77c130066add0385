"""Operator 3: toxicity, by gradient-boosted trees over dense features with isotonic calibration.

Features: densities of learned words and learned word beginnings, second-person words near them, capitals,
punctuation and obfuscation (letters replaced by signs or digits). The lexicon, the trees and the calibration are
learned here from a bounded sample of labelled rows outside the held-out fold (sampling.TRAIN_ROWS). To keep the
trees from trusting words that were picked for being in their own rows, a row's features come from a lexicon
learned without its fold; calibration uses scores from trees that did not see the row.

labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts get the score of a text without words; without any labelled row, or with
labels of one kind only, every score is that kind's smoothed rate; repeated rows score alike; other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import common, sampling

THRESHOLD = 0.3
FOLDS = (0, 1, 3)
LEXICON_SIZE = 400
#: Word beginnings that are learned beside whole words.
STEMS = (4, 5, 6, 7)
#: Least evidence for an entry: likelihood-ratio statistic and log odds.
LEAST_G2, LEAST_ODDS = 18.0, 1.5
WORD = re.compile(r"\w+")
# Second-person words of the corpus languages.
SECOND = frozenset(("you", "your", "yours", "youre", "u", "ur", "du", "dich", "dir", "dein", "ihr", "tu", "te", "toi", "vous", "usted", "ti", "tus"))
# Signs and digits that stand for letters.
DISGUISE = str.maketrans("013457@$!", "oieastasi")
MASKED = re.compile(r"[^\W\d_]+[0-9@$!*]+[^\W\d_]+")
NEAR = 3
NAMES = ("words", "lexicon", "stems", "either", "distinct", "near_second", "second", "capitals", "exclaims", "punctuation", "masked", "masked_lexicon", "hits", "long_runs")
RUNS = re.compile(r"(\w)\1{3,}")


class Lexicon:
    """Learned words and beginnings; known() is 1 for a word, 2 for a beginning, 3 for both."""

    def __init__(self, entries: list[str]) -> None:
        self.words = frozenset(e[1:] for e in entries if e[0] == "=")
        self.stems = frozenset(e[1:] for e in entries if e[0] == "^")
        self.cache: dict[str, int] = {}

    def known(self, word: str) -> int:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            got = self.cache[word] = (word in self.words) + 2 * any(word[:n] in self.stems for n in STEMS if len(word) >= n)
        return got

    def __reduce__(self):
        return Lexicon, (sorted(f"={w}" for w in self.words) + sorted(f"^{w}" for w in self.stems),)


def tokens_of(words: set[str]) -> set[str]:
    """What may become entries of the lexicon."""
    return {f"={w}" for w in words} | {f"^{w[:n]}" for w in words for n in STEMS if len(w) >= n}


def features(text: str, lexicon: Lexicon) -> list[float]:
    low = text.lower()
    words = WORD.findall(low)
    n = max(1, len(words))
    kinds = list(map(lexicon.known, words))
    hits = [k for k, kind in enumerate(kinds) if kind]
    second = [k for k, w in enumerate(words) if w in SECOND]
    places = set(second)
    near = sum(any(k + d in places for d in range(-NEAR, NEAR + 1) if d) for k in hits)
    masked = MASKED.findall(low) if any(c in low for c in "0123456789@$!*") else []
    chars = max(1, len(text))
    return [
        float(np.log1p(len(words))), sum(kinds[k] & 1 for k in hits) / n, sum(kinds[k] >> 1 for k in hits) / n, len(hits) / n, float(len({words[k] for k in hits})), near / n, len(second) / n,
        sum(map(str.isupper, text)) / chars if text else 0.0, text.count("!") / chars, sum(map(text.count, ".,;:?!#$%&*|")) / chars, len(masked) / n, sum(lexicon.known(m.replace("*", "").translate(DISGUISE)) & 1 for m in masked) / n,
        float(len(hits)), float(len(RUNS.findall(low))),
    ]


def token_counts(sample: DataFrame, label: str) -> DataFrame:
    """token and, for each fold and label, in how many texts it stands."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"token": [], "at": []}
        for text, fold, y in zip(batch["text"].to_pylist(), batch["fold"].to_pylist(), batch[label].to_pylist(), strict=True):
            own = sorted(tokens_of(set(WORD.findall((text or "").lower()))))
            out["token"] += own
            out["at"] += [FOLDS.index(fold) * 2 + y] * len(own)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("token", pa.string()), ("at", pa.int32())]))

    flat = common.map_slices(sample, "token string, at int", run)
    cells = [F.count_if(F.col("at") == k).alias(f"c{k}") for k in range(2 * len(FOLDS))]
    return flat.groupBy("token").agg(*cells)


def strength(k1: np.ndarray, n1: float, k0: np.ndarray, n0: float) -> tuple[np.ndarray, np.ndarray]:
    """Likelihood-ratio statistic and log odds of standing in texts of kind 1."""
    p1, p0, p = (k1 + 1e-9) / max(n1, 1), (k0 + 1e-9) / max(n0, 1), (k1 + k0 + 1e-9) / max(n1 + n0, 1)
    g2 = 2 * (k1 * np.log(p1 / p) + k0 * np.log(p0 / p) + (n1 - k1) * np.log(np.maximum(1 - p1, 1e-12) / np.maximum(1 - p, 1e-12)) + (n0 - k0) * np.log(np.maximum(1 - p0, 1e-12) / np.maximum(1 - p, 1e-12)))
    odds = np.log((k1 + 0.5) / (n1 - k1 + 0.5)) - np.log((k0 + 0.5) / (n0 - k0 + 0.5))
    return g2, odds


def choose(tokens: list[str], counts: np.ndarray, sizes: np.ndarray, without: int | None) -> Lexicon:
    """The strongest entries by counts of all folds but one. counts and sizes: by fold and label."""
    folds = [f for f in range(len(FOLDS)) if f != without]
    k0, k1 = counts[:, [2 * f for f in folds]].sum(1), counts[:, [2 * f + 1 for f in folds]].sum(1)
    n0, n1 = sizes[[2 * f for f in folds]].sum(), sizes[[2 * f + 1 for f in folds]].sum()
    g2, odds = strength(k1, n1, k0, n0)
    good = np.flatnonzero((g2 >= LEAST_G2) & (odds >= LEAST_ODDS))
    order = sorted(good.tolist(), key=lambda k: (-g2[k], tokens[k]))[:LEXICON_SIZE]
    return Lexicon([tokens[k] for k in order])


class Trees:
    """Boosted regression trees of fixed depth for the logistic loss, on quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, shrink: float = 2.0, least: int = 8) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.shrink, self.least = rounds, depth, rate, bins, shrink, least
        self.base, self.feature, self.cut, self.leaf = 0.0, [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        mean = (y.sum() + 0.5) / (n + 1)
        self.base = float(np.log(mean / (1 - mean)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
        f = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, k = 2**level - 1, 2**level
                best = np.full(k, 1e-9)
                bin_at = np.zeros(k, np.int64)
                for j in range(width):
                    m = len(edges[j]) + 1
                    if m < 2:
                        continue
                    key = node * m + binned[j]
                    G, H, N = (np.bincount(key, w, k * m).reshape(k, m).cumsum(1) for w in (g, h, np.ones(n)))
                    gt, ht, nt = G[:, -1:], H[:, -1:], N[:, -1:]
                    gain = G**2 / (H + self.shrink) + (gt - G) ** 2 / (ht - H + self.shrink) - gt**2 / (ht + self.shrink)
                    gain = np.where((N >= self.least) & (nt - N >= self.least), gain, 0)[:, :-1]
                    at = gain.argmax(1)
                    top = gain[np.arange(k), at]
                    better = top > best
                    best[better] = top[better]
                    feature[first : first + k][better] = j
                    bin_at[better] = at[better]
                    cut[first : first + k][better] = edges[j][at[better]]
                node = 2 * node + (x[np.arange(n), feature[first + node]] > cut[first + node])
            G, H = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
            leaf = self.rate * G / (H + self.shrink)
            f += leaf[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            f += leaf[node]
        return f


def isotonic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places and rising values, smoothed by half a case of either kind per pool."""
    order = np.argsort(s, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(s[order], y[order], strict=True):
        pools.append([b, 1.0, a, a])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
            total, n, first, last = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + n, pools[-1][2], last]
    mean = y.mean() if len(y) else 0.5
    values = np.maximum.accumulate([(t + mean) / (n + 1) for t, n, _, _ in pools]) if pools else np.array([mean])
    at, out = [], []
    for (_, _, first, last), v in zip(pools, values, strict=False):
        at += [first, last]
        out += [v, v]
    return np.array(at or [0.0]), np.array(out or [mean])


class Model:
    def __init__(self, lexicon: Lexicon, trees: Trees | None, at: np.ndarray, values: np.ndarray) -> None:
        self.lexicon, self.trees, self.at, self.values = lexicon, trees, at, values

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(x) if self.trees and len(x) else np.zeros(len(x))
        calibrated = np.interp(raw, self.at, self.values)
        # the trees' own order breaks the ties that pooling makes
        return np.clip(calibrated * 0.98 + 0.02 / (1 + np.exp(-raw)), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = sampling.TRAIN_ROWS) -> Model:
    sample = sampling.labelled(docs, labels, [label], rows)
    sizes = np.zeros(2 * len(FOLDS))
    for r in sample.groupBy("fold", label).count().collect():
        sizes[FOLDS.index(r["fold"]) * 2 + r[label]] = r["count"]
    n0, n1 = float(sizes[0::2].sum()), float(sizes[1::2].sum())
    if not n0 or not n1:
        common.discard(sample)
        rate = (n1 + 0.5) / (n0 + n1 + 1) if n0 + n1 else 0.0
        return Model(Lexicon([]), None, np.array([0.0]), np.array([rate]))
    counted = token_counts(sample, label)
    ones, zeros = (sum(F.col(f"c{2 * f + y}") for f in range(len(FOLDS))) for y in (1, 0))
    # at most 10 entries for each place in the lexicon come to the driver
    top = counted.filter((ones >= 3) & (ones / F.lit(n1) > zeros / F.lit(n0))).orderBy((ones / F.lit(n1) - zeros / F.lit(n0)).desc(), "token").limit(10 * LEXICON_SIZE).collect()
    tokens = [r["token"] for r in top]
    counts = np.array([[r[f"c{k}"] for k in range(2 * len(FOLDS))] for r in top], float).reshape(-1, 2 * len(FOLDS))
    own = {fold: choose(tokens, counts, sizes, k) for k, fold in enumerate(FOLDS)}

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = [features(t or "", own[f]) for t, f in zip(batch["text"].to_pylist(), batch["fold"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"x": x, "fold": batch["fold"], "y": batch[label]}, pa.schema([("x", pa.list_(pa.float64())), ("fold", pa.int64()), ("y", pa.int32())]))

    got = common.map_slices(sample, "x array<double>, fold bigint, y int", run).toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(NAMES))
    y, fold = got["y"].to_numpy().astype(float), got["fold"].to_numpy()
    order = np.lexsort((*x.T, y, fold))
    x, y, fold = x[order], y[order], fold[order]
    common.discard(sample)
    raw = np.zeros(len(y))
    for f in FOLDS:
        if (fold == f).any() and (fold != f).any():
            raw[fold == f] = Trees().fit(x[fold != f], y[fold != f]).raw(x[fold == f])
    return Model(choose(tokens, counts, sizes, None), Trees().fit(x, y), *isotonic(raw, y))


def score(docs: DataFrame, model: Model, keep: list[str] = ()) -> DataFrame:
    """doc_id and score of every document."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = np.array([features(t or "", model.lexicon) for t in batch["text"].to_pylist()], float).reshape(-1, len(NAMES))
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": model.scores(x)})

    return common.map_slices(docs.select("doc_id", "text"), "doc_id bigint, score double", run)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score under threshold, with all their columns."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = np.array([features(t or "", model.lexicon) for t in batch["text"].to_pylist()], float).reshape(-1, len(NAMES))
        yield batch.filter(pa.array(model.scores(x) < threshold))

    return common.map_slices(docs, docs.schema, run)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(common.fold4("doc_id") == sampling.HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
SQL: dict[str, str] = {}

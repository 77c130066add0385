"""Operator 13: languages of a text, by multilingual mixture inference.

Per language a character trigram model (interpolated with bigrams and single characters, counts in hashed tables of
fixed size) gives each word of letters its likelihood. A text's words are taken as draws from a mixture of the
languages: expectation-maximisation finds the proportions. The language set is then chosen by penalised likelihood:
languages join in the order of their proportions while twice the gain in log likelihood is above PENALTY * ln(1 + words)
for each. The prediction is the language with the largest proportion in the set; its score is that proportion drawn to
equal shares by one word's weight, so that short texts score lower.

Models learn from text and lang alone, of rows with a lang outside the held-out fold, of each language a hash-drawn
sample of about TRAIN_ROWS rows; of more than LANGUAGES languages those with most rows are learned.

Defined results: a null text and one without a letter are und, score 0, no languages; without anything learned every text
is und; ties go to the language that sorts first; rows without an id are neither learned from nor held out; repeated rows
are predicted alike; texts are read whole, runs of letters in parts of WORD_LETTERS; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import common, sampling

#: Rows learned from per language, about; languages learned at most.
TRAIN_ROWS, LANGUAGES = 4_000, 256
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
WORD_LETTERS = 24
#: Buckets of trigrams, bigrams and single characters.
BUCKETS = (1 << 17, 1 << 14, 1 << 11)
#: Weight of the shorter context in a longer one's estimate.
BACK = (8.0, 8.0, 1.0)
PENALTY = 3.0
ROUNDS, CLOSE = 60, 1e-4
#: Words whose likelihoods a worker remembers.
REMEMBERED = 100_000
#: Multipliers of the hash of a character and the two before it.
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)


def words_of(text: str) -> Counter:
    """Words in lower case with their numbers."""
    found = Counter(WORD.findall(text.lower()))
    for w in [w for w in found if len(w) > WORD_LETTERS]:
        n = found.pop(w)
        found.update({p: n * c for p, c in Counter(w[k : k + WORD_LETTERS] for k in range(0, len(w), WORD_LETTERS)).items()})
    return found


def places(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of the trigram, bigram and single character that end at each character of the words and at their ends, and of the
    trigram's and bigram's contexts; and where each word begins in those arrays."""
    codes = np.frombuffer("".join(f"\x02\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 3 for w in words])
    starts = np.cumsum(lengths) - lengths
    ends = np.ones(len(codes), bool)
    ends[starts] = ends[starts + 1] = False
    at = np.flatnonzero(ends)
    c, b, a = codes[at], codes[at - 1], codes[at - 2]
    bucket = lambda h, k: ((h ^ (h >> np.uint64(15))) % np.uint64(BUCKETS[k])).astype(np.int64)
    two, one = b * MIX[1] + a * MIX[2], b * MIX[1]
    return [bucket(c * MIX[0] + two, 0), bucket(c * MIX[0] + one, 1), bucket(c * MIX[0], 2), bucket(two, 1), bucket(one, 2)], starts - 2 * np.arange(len(words))


class Model:
    """Counts by language of trigrams, bigrams, characters, and of the contexts of the first two."""

    def __init__(self, languages: list[str], tables: list[np.ndarray]) -> None:
        self.languages, self.tables = languages, tables
        self.total = tables[2].sum(1, keepdims=True) if languages else None
        self.seen: dict[str, int] = {}
        self.rows: np.ndarray = np.zeros((0, len(languages)))

    def __reduce__(self):
        return Model, (self.languages, self.tables)

    def fresh(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word (rows) under each language."""
        at, starts = places(words)
        tri, bi, one, of_tri, of_bi = (t[:, p] for t, p in zip(self.tables, at, strict=True))
        p = (one + BACK[2] / BUCKETS[2]) / (self.total + BACK[2])
        p = (bi + BACK[1] * p) / (of_bi + BACK[1])
        p = (tri + BACK[0] * p) / (of_tri + BACK[0])
        return np.add.reduceat(np.log(p), starts, axis=1).T

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """The same, of words that were met before from memory."""
        new = [w for w in words if w not in self.seen]
        if new:
            if len(self.seen) + len(new) > REMEMBERED:
                self.seen, self.rows, new = {}, self.rows[:0], words
            rows = np.concatenate([self.fresh(new[k : k + 20_000]) for k in range(0, len(new), 20_000)])
            if len(new) > REMEMBERED:
                return rows
            for k, w in enumerate(new, len(self.seen)):
                self.seen[w] = k
            if len(self.seen) > len(self.rows):
                grown = np.zeros((min(REMEMBERED, max(2 * len(self.seen), 4096)), len(self.languages)))
                grown[: len(self.rows)] = self.rows
                self.rows = grown
            self.rows[len(self.seen) - len(new) : len(self.seen)] = rows
        return self.rows[[self.seen[w] for w in words]]


def proportions(like: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture weights by expectation-maximisation and the log likelihood. like: words by languages; n: their numbers."""
    top = like.max(1, keepdims=True)
    b, total = np.exp(like - top), n.sum()
    if b.shape[1] == 1:
        return np.ones(1), float(n @ top[:, 0])
    pi = np.full(b.shape[1], 1 / b.shape[1])
    for _ in range(ROUNDS):
        mixed = b @ pi
        step = pi * ((n / mixed) @ b) / total
        moved = np.abs(step - pi).max()
        pi = step
        if moved < CLOSE:
            break
    return pi, float(n @ (np.log(b @ pi) + top[:, 0]))


def language_set(like: np.ndarray, n: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray]:
    """The chosen languages, largest proportion first, and their proportions."""
    pi, _ = proportions(like, n)
    order = sorted(range(len(pi)), key=lambda k: (-pi[k], k))
    # the best single language is the start, also where the mixture spreads over several like it
    single = (n @ like).argmax()
    order.remove(single)
    chosen, share, best = [int(single)], np.ones(1), float(n @ like[:, single])
    price = penalty * np.log1p(n.sum()) / 2
    for k in order:
        # no mixture with k gains more than each word's best language among those gives
        most = float(n @ np.maximum(like[:, chosen].max(1), like[:, k]))
        if most - best <= price:
            continue
        got, reached = proportions(like[:, [*chosen, k]], n)
        if reached - best <= price:
            break
        chosen, share, best = [*chosen, int(k)], got, reached
    by = sorted(range(len(chosen)), key=lambda k: (-share[k], chosen[k]))
    return [chosen[k] for k in by], share[by]


def learned_rows(docs: DataFrame, rows: int, languages: int) -> DataFrame:
    """lang and text of the sample."""
    fold = common.fold4("doc_id")
    known = docs.select("doc_id", "lang", "text").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold != sampling.HELD_OUT))
    # one row per language, languages of them at most
    sizes = known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(languages)
    draw = F.pmod(F.xxhash64(F.concat(F.lit("langid-1:"), F.col("doc_id").cast("string"))), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return known.join(F.broadcast(sizes), "lang").filter(draw < F.lit(float(rows)) / F.col("count")).select("lang", "text")


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, languages: int = LANGUAGES) -> Model:
    """Counts by language; a task adds up its own before they are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = words_of(text)
                if words:
                    tables = totals.setdefault(lang, [np.zeros(BUCKETS[k]) for k in (0, 1, 2, 1, 2)])
                    listed = list(words)
                    weight = np.repeat(list(words.values()), [len(w) + 1 for w in listed]).astype(float)
                    for table, at in zip(tables, places(listed)[0], strict=True):
                        table += np.bincount(at, weight, len(table))
        schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("at", pa.int32()), ("n", pa.float64())])
        for lang, tables in totals.items():
            for kind, table in enumerate(tables):
                at = np.flatnonzero(table)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "kind": [kind] * len(at), "at": at, "n": table[at]}, schema)

    got = learned_rows(docs, rows, languages).mapInArrow(run, "lang string, kind int, at int, n double").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got["lang"].to_pylist()))
    tables = [np.zeros((len(names), BUCKETS[k]), np.float32) for k in (0, 1, 2, 1, 2)]
    number = {name: k for k, name in enumerate(names)}
    row = np.array([number[x] for x in got["lang"].to_pylist()], np.int64)
    kind, at, n = (got[c].to_numpy() for c in ("kind", "at", "n"))
    for k, table in enumerate(tables):
        of = kind == k
        table[row[of], at[of]] = n[of]
    return Model(names, tables)


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, languages (the set with its proportions, largest first) and n_words."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for text in batch["text"].to_pylist():
            words = words_of(text or "")
            if not words or not model.languages:
                out.append(("und", 0.0, "", sum(words.values())))
                continue
            n = np.fromiter(words.values(), float, len(words))
            chosen, share = language_set(model.likelihoods(list(words)), n, penalty)
            total = n.sum()
            score = (share[0] * total + 1 / len(model.languages)) / (total + 1)
            out.append((model.languages[chosen[0]], min(1.0, float(score)), ",".join(f"{model.languages[k]}:{p:.3f}" for k, p in zip(chosen, share, strict=True)), int(total)))
        columns = list(map(list, zip(*out, strict=True))) or [[]] * 4
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].cast(pa.int64()), "lang_pred": pa.array(columns[0], pa.string()), "score": pa.array(columns[1], pa.float64()), "languages": pa.array(columns[2], pa.string()), "n_words": pa.array(columns[3], pa.int64())})

    return common.map_slices(docs.select("doc_id", "text"), "doc_id bigint, lang_pred string, score double, languages string, n_words bigint", run)


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = F.coalesce(common.fold4("doc_id") == sampling.HELD_OUT, F.lit(False)).alias("held_out")
    return identify(docs, fit(docs)).select("doc_id", held_out, "lang_pred", "score", "languages", "n_words")


QUERIES = {"op13_langid": op13_langid}
SQL: dict[str, str] = {}

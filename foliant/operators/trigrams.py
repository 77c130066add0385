"""A stored index of the trigrams of folded text, for substring search that reads only rows that may match.

Rows are numbered in parts of ROWS. A posting is a list of slots of one part that have a trigram in a field, so
that the list of a trigram that all rows have is cut into lists of bounded length; a part has a list for each run of texts
that a task works on at once, so that no row of a trigram and a slot is ever shuffled. A query reads the postings of its rarest
trigrams, intersects them part by part, and compares the stored folded text of what is left exactly. Terms of fewer
than three characters do not narrow; a query of such terms alone reads all folded text.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import storage
from foliant.functions import text
from foliant.operators import query

GRAM = 3
#: Rows of a part.
ROWS = 1 << 14
#: Trigrams of a term that are read at most, the rarest; the comparison of the text is exact in any case.
RAREST = 4
#: Characters whose trigrams are listed at once.
RUN_CHARS = 1 << 20
POSTED = pa.schema([("field", pa.string()), ("gram", pa.string()), ("part", pa.int32()), ("slots", pa.list_(pa.int32())), ("n", pa.int32())])
Terms = list[tuple[tuple[str, ...], str]]


def grams_of(term: str) -> set[str]:
    return {term[k : k + GRAM] for k in range(len(term) - GRAM + 1)}


def key(field: str, gram: str) -> str:
    return f"{field}\u0000{gram}"


def listed(letters: np.ndarray, slots: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Distinct trigrams, where the slots of each begin, and the distinct slots that have it, for characters of texts one after
    another and the slot of each."""
    if len(letters) < GRAM:
        return
    there = np.zeros(int(letters.max()) + 1, bool)
    there[letters] = True
    alphabet = np.flatnonzero(there)
    if len(alphabet) > 1 << 15:
        # so many would not fit 64 bits with the slot: half the texts have fewer in the end
        half = len(letters) // 2
        yield from listed(letters[: half + GRAM - 1], slots[: half + GRAM - 1])
        yield from listed(letters[half:], slots[half:])
        return
    at, size = (np.cumsum(there) - 1)[letters], len(alphabet)
    low = int(slots.min())
    width = int(slots.max()) - low + 1
    whole = slots[: -GRAM + 1] == slots[GRAM - 1 :]
    codes = ((at[:-2] * size + at[1:-1]) * size + at[2:])[whole] * width + (slots[: -GRAM + 1][whole] - low)
    codes.sort()
    codes = codes[np.r_[True, codes[1:] != codes[:-1]][: len(codes)]]
    gram = codes // width
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: len(gram)])
    gram, slot = gram[first], codes - gram * width + low
    spelled = alphabet[np.stack([gram // (size * size), gram // size % size, gram % size], 1)].astype("<u4").tobytes().decode("utf-32-le")
    yield [spelled[k : k + GRAM] for k in range(0, len(spelled), GRAM)], first, slot


def text_runs(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str], list[int]]]:
    """Texts of a column in runs of one part and about RUN_CHARS characters, with their slots; longer texts in pieces that
    share a trigram's reach."""
    part, texts, slots, size = None, [], [], 0
    for of, slot, text in zip(batch["part"].to_pylist(), batch["slot"].to_pylist(), batch[column], strict=True):
        text = text.as_py() or ""
        for k in range(0, max(1, len(text) - GRAM + 1), RUN_CHARS):
            if texts and (of != part or size >= RUN_CHARS):
                yield part, texts, slots
                texts, slots, size = [], [], 0
            part = of
            texts.append(text[k : k + RUN_CHARS + GRAM - 1])
            slots.append(slot)
            size += len(texts[-1])
    if texts:
        yield part, texts, slots


class TrigramIndex:
    """Two tables under root: rows, with folded text, partitioned by part; and postings, sorted by field and trigram."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, rows: DataFrame, order: list[str], fold: Callable[[DataFrame], DataFrame]) -> TrigramIndex:
        """Store rows numbered by order, with what fold adds, the columns _fold_<field>, and their postings. Rows are folded
        after they are numbered, since Spark reads what it sorts twice."""
        with storage.scratch():
            placed = storage.numbered(rows, [F.col(c) for c in order], "_n")
            at = F.col("_n") - 1
            placed = fold(placed).select("*", (at % ROWS).cast("int").alias("slot"), F.floor(at / ROWS).cast("int").alias("part")).drop("_n")
            placed.limit(0).write.mode("overwrite").parquet(f"{self.root}/columns")
            placed.write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/rows")
        self.posted(self.rows()).write.mode("overwrite").parquet(f"{self.root}/postings")
        return self

    def posted(self, rows: DataFrame) -> DataFrame:
        fields = [c.removeprefix("_fold_") for c in rows.columns if c.startswith("_fold_")]

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for field in fields:
                    for part, texts, slots in text_runs(batch, f"_fold_{field}"):
                        letters = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
                        for grams, first, found in listed(letters, np.repeat(np.array(slots, np.int64), [len(t) for t in texts])):
                            lists = pa.ListArray.from_arrays(np.append(first, len(found)).astype(np.int32), found.astype(np.int32))
                            yield pa.RecordBatch.from_arrays([pa.array([field] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(np.full(len(grams), part, np.int32)), lists, lists.value_lengths()], schema=POSTED)

        posts = rows.select("part", "slot", *[f"_fold_{f}" for f in fields]).mapInArrow(post, "field string, gram string, part int, slots array<int>, n int")
        # not by ranges, for which Spark would make the postings twice
        return posts.repartition("field", "gram").sortWithinPartitions("field", "gram", "part")

    def rows(self) -> DataFrame:
        columns = self.spark.read.parquet(f"{self.root}/columns").schema
        return self.spark.read.schema(columns).parquet(f"{self.root}/rows")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/postings")

    def _of(self, wanted: set[tuple[str, str]]) -> DataFrame:
        by_field: dict[str, list[str]] = {}
        for field, gram in sorted(wanted):
            by_field.setdefault(field, []).append(gram)
        return self.postings().filter(functools.reduce(operator.or_, [(F.col("field") == f) & F.col("gram").isin(*g) for f, g in by_field.items()]))

    def candidates(self, terms: Terms) -> DataFrame | None:
        """part and slot of the rows that have the rarest trigrams of every term in one of its fields; None if no term
        is long enough to narrow."""
        asked = [(fields, term) for fields, term in terms if len(term) >= GRAM]
        if not asked:
            return None
        posts = self._of({(f, g) for fields, term in asked for f in fields for g in grams_of(term)})
        # a number for each trigram of the query
        sizes = {(r["field"], r["gram"]): r["n"] for r in posts.groupBy("field", "gram").agg(F.sum("n").alias("n")).collect()}
        chosen: list[list[list[tuple[str, str]]]] = []
        for fields, term in asked:
            possible = [[(f, g) for g in grams_of(term)] for f in fields]
            possible = [sorted(of, key=lambda x: (sizes[x], x))[:RAREST] for of in possible if all(x in sizes for x in of)]
            if not possible:
                return self.spark.createDataFrame([], "part int, slot int")
            chosen.append(possible)
        entry = F.struct(F.concat_ws("\u0000", "field", "gram"), "slots")
        whole = self._of({x for term in chosen for of in term for x in of}).groupBy("field", "gram", "part").agg(F.flatten(F.collect_list("slots")).alias("slots"))
        per_part = whole.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
        slots = lambda x: F.coalesce(F.col("m")[key(*x)], F.array().cast("array<int>"))
        every = [functools.reduce(F.array_union, [functools.reduce(F.array_intersect, map(slots, of)) for of in term]) for term in chosen]
        return per_part.select("part", F.explode(functools.reduce(F.array_intersect, every)).alias("slot"))

    def matching(self, terms: Terms) -> DataFrame:
        """Stored rows that may match: all if no term narrows, else the candidates, read from their parts alone."""
        found = self.candidates(terms)
        if found is None:
            return self.rows().drop("part", "slot")
        found = storage.store(found, "candidates")
        # a number for every ROWS rows of the index at most
        parts = [r["part"] for r in found.select("part").distinct().collect()]
        return self.rows().filter(F.col("part").isin(*parts) if parts else F.lit(False)).join(found, ["part", "slot"]).drop("part", "slot")


def index_works(works: DataFrame, root: str) -> TrigramIndex:
    """The index of a read model, with the folded text of every scope and all columns of works."""
    return TrigramIndex(works.sparkSession, root).build(works, ["id"], query.with_folded)


def search(index: TrigramIndex, options: query.Options) -> DataFrame:
    """The rows of query.ranked() over the indexed works."""
    terms = query.searched(options.search)
    rows = index.rows().limit(0).drop("part", "slot") if any(not term for _, term in terms) else index.matching(terms)
    return query.ranked(rows, options)


def index_texts(rows: DataFrame, column: str, order: list[str], root: str) -> TrigramIndex:
    """The index of one text column; the other columns are kept, the text itself only folded."""
    return TrigramIndex(rows.sparkSession, root).build(rows, order, lambda df: df.withColumn(f"_fold_{column}", text.fold(F.col(column))).drop(column))


def containing(index: TrigramIndex, column: str, search_for: str) -> DataFrame:
    """Rows whose folded text has every term of the query; a query without terms has all that have a text."""
    terms = query.fold_literal(search_for).split()
    folded = F.col(f"_fold_{column}")
    return index.matching([((column,), t) for t in terms]).filter(text.matches_terms(folded, terms)).drop(f"_fold_{column}")

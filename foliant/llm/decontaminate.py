"""Operator 8: benchmark decontamination with a distributed positional inverted index.

Documents are cut into shards. Each shard stores its own positional index as one row: for every benchmark term the
ascending positions of its tokens. A phrase is found by intersecting the offset-adjusted posting lists of its
terms, from the rarest of the shard on; a proximity match asks for a share of a window's terms near their place.
Terms no benchmark item holds cannot be part of a match and get no postings. Shards are independent, so neither a
frequent term nor a frequent passage meets in one task.

op8_decontaminate returns the exact matches, row for row what its SQL gives; op8_proximity has the proximity matches as
well, and keep_clean() decides on both.

The benchmark is read in blocks of at most BLOCK_CHARS characters, each block with an index of its terms; only
one block at a time is sent to the executors.

Defined results: null or empty texts have no words and no hits; null item ids are written as an empty string;
repeated items count once; repeated documents are matched each on its own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import common

WINDOW = 10
#: A proximity match: at least SHARE of a window's terms within SLOP of their place, so that words changed, dropped or
#: inserted don't hide a passage. SLOP is for WINDOW terms; the window of a shorter item gets its part of it, rounded down.
SLOP = 2
SHARE = 0.8
#: Candidates of proximity matches that are scored at a time, unless one window alone has more.
CANDIDATES = 1_000_000
#: Tokens of a shard, unless one document alone has more.
SHARD_TOKENS = 1_000_000
#: Empty places between the documents of a shard: no phrase crosses them, nor any match with a smaller slop.
GAP = 64
#: Bound of what is broadcast: characters of one block of benchmark items (a longer item is a block of its own).
BLOCK_CHARS = 4_000_000
#: Maps bytes outside the word class to spaces and A-Z to a-z; all bytes of non-ASCII characters are word bytes.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
INDEX = "doc_ids array<bigint>, row_keys array<bigint>, starts array<bigint>, n_words array<bigint>, terms array<int>, counts array<int>, postings binary"
FOUND = "doc_id bigint, row_key bigint, n_words bigint, hits array<struct<start:bigint,stop:bigint>>, near array<struct<start:bigint,stop:bigint>>, items array<string>"


def tokens(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Queries:
    """The windows of one block of benchmark items over that block's vocabulary."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], list[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(t, len(self.vocabulary)) for t in tokens(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                holders = self.windows.setdefault(tuple(ids[at : at + window]), [])
                if not holders or holders[-1] != item:
                    holders.append(item)


def index_shards(docs: DataFrame, vocabulary: dict[bytes, int], shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per shard: its documents and, term after term, positions as differences. docs: doc_id, row_key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, sizes, found, total = [], [], [], [], 0

        def shard() -> pa.RecordBatch:
            n = np.array(sizes, np.int64)
            starts = np.cumsum(n + GAP) - n
            tok = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int32)
            pos = np.concatenate([x + starts[k] for k, (x, _) in enumerate(found)]) if found else np.zeros(0, np.int64)
            order = np.argsort(tok, kind="stable")
            terms, first, counts = np.unique(tok[order], return_index=True, return_counts=True)
            gaps = np.diff(pos[order], prepend=0)
            gaps[first] = pos[order][first]
            return pa.RecordBatch.from_pylist(
                [{"doc_ids": ids, "row_keys": keys, "starts": starts.tolist(), "n_words": sizes, "terms": terms.tolist(), "counts": counts.tolist(), "postings": gaps.astype(np.int32).tobytes()}],
                pa.schema([("doc_ids", pa.list_(pa.int64())), ("row_keys", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("postings", pa.binary())]),
            )

        for batch in batches:
            for at in range(0, batch.num_rows, common.SLICE_ROWS):
                part = batch.slice(at, common.SLICE_ROWS)
                for doc, key, text in zip(part["doc_id"].to_pylist(), part["row_key"].to_pylist(), common.text_bytes(part["text"]), strict=True):
                    words = tokens(text)
                    if sizes and total + len(words) > shard_tokens:
                        yield shard()
                        ids, keys, sizes, found, total = [], [], [], [], 0
                    tok = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words))
                    pos = np.flatnonzero(tok >= 0)
                    ids.append(doc)
                    keys.append(key)
                    sizes.append(len(words))
                    found.append((pos, tok[pos]))
                    total += len(words) + 1
        if sizes:
            yield shard()

    return docs.select("doc_id", "row_key", "text").mapInArrow(run, INDEX)


def phrase(lists: list[np.ndarray]) -> np.ndarray:
    """Starts at which all terms of a window stand in order: lists[k] has the positions of its k-th term."""
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    starts = lists[order[0]] - order[0]
    for k in order[1:]:
        if not len(starts):
            break
        at = np.searchsorted(lists[k], starts + k)
        starts = starts[lists[k][np.minimum(at, len(lists[k]) - 1)] == starts + k]
    return starts


def proximity(lists: list[np.ndarray], slop: int, share: float) -> np.ndarray:
    """Starts at which at least share of the window's terms stand within slop of their place. Starts come from the
    rarest terms: a match misses at most len - need terms, so one of any len - need + 1 lists holds it."""
    n = len(lists)
    need = max(1, int(np.ceil(share * n)))
    order = sorted(range(n), key=lambda k: len(lists[k]))
    starts = np.unique(np.concatenate([lists[k] - k for k in order[: n - need + 1]]))
    score = np.zeros(len(starts), np.int64)
    for k in range(n):
        if len(lists[k]):
            at = np.searchsorted(lists[k], starts + k - slop)
            score += lists[k][np.minimum(at, len(lists[k]) - 1)] - (starts + k) <= slop
            score -= (at == len(lists[k])) & (lists[k][-1] - (starts + k) <= slop)
    return starts[score >= need]


def near_starts(post: dict[int, np.ndarray], windows: np.ndarray, slop: int, share: float, candidates: int = CANDIDATES) -> np.ndarray:
    """Starts of the proximity() of many windows of one length, a row each. All candidates are scored together, from a
    window's rarest term on, and go once they have missed more terms than a match may."""
    n = windows.shape[1]
    misses = n - max(1, int(np.ceil(share * n)))
    if not post or not len(windows):
        return np.zeros(0, np.int64)
    pad = n + slop
    first, flat = np.zeros(max(int(windows.max()), max(post)) + 2, np.int64), np.concatenate([post[t] for t in sorted(post)])
    for t, found in post.items():
        first[t + 1] = len(found)
    counts = first[1:].copy()
    first = np.cumsum(first)
    by_place = np.full(int(flat.max()) + 1 + 2 * pad, -1, np.int32)
    by_place[flat + pad] = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(counts[windows], axis=1, kind="stable")
    terms = np.take_along_axis(windows, order, 1)
    present = (counts[terms] == 0).sum(1) <= misses
    order, terms = order[present], terms[present]
    total = np.cumsum(counts[terms[:, : misses + 1]].sum(1))
    out, at = [np.zeros(0, np.int64)], 0
    while at < len(terms):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + candidates, "right")))
        rare = terms[at:end, : misses + 1].ravel()
        sizes = counts[rare]
        row = np.repeat(np.repeat(np.arange(at, end), misses + 1), sizes)
        start = flat[np.arange(sizes.sum()) + np.repeat(first[rare] - np.cumsum(sizes) + sizes, sizes)] - np.repeat(order[at:end, : misses + 1].ravel(), sizes)
        missed = np.zeros(len(row), np.int64)
        for j in range(n):
            place, term = start + order[row, j] + pad, terms[row, j]
            hit = by_place[place] == term
            for d in range(1, slop + 1):
                hit |= (by_place[place - d] == term) | (by_place[place + d] == term)
            missed += ~hit
            if j >= misses:
                kept = missed <= misses
                row, start, missed = row[kept], start[kept], missed[kept]
        out.append(np.unique(start))
        at = end
    return np.unique(np.concatenate(out))


def merged(starts: list[np.ndarray], lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals that cover all [start, start + length)."""
    if not sum(map(len, starts)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.concatenate(starts)
    b = np.concatenate([s + n for s, n in zip(starts, lengths, strict=True)])
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.r_[True, a[1:] > b[:-1]]
    return a[new], b[np.r_[np.flatnonzero(new)[1:] - 1, len(b) - 1]]


def search_shards(index: DataFrame, queries: Queries, slop: int | None = None, share: float = 0.8) -> DataFrame:
    """Matches of a block's windows in every stored shard, a row per document."""
    by_length: dict[int, list[tuple[int, ...]]] = {}
    for terms in queries.windows:
        by_length.setdefault(len(terms), []).append(terms)
    n_terms = len(queries.vocabulary)
    tables = {n: np.array(rows, np.int64) for n, rows in by_length.items()}
    # a match may begin before its document: by slop, and by the terms it misses
    lead = (slop or 0) + max((n - max(1, int(np.ceil(share * n))) for n in tables), default=0)

    def spans(starts: np.ndarray, sizes: list[int], a: np.ndarray, b: np.ndarray, lead: int = 0) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in sizes]
        for d, x, y in zip((np.searchsorted(starts, a + lead, "right") - 1).tolist(), a.tolist(), b.tolist(), strict=True):
            first, last = max(0, x - int(starts[d])), min(sizes[d], y - int(starts[d]))
            if first < last:
                out[d].append({"start": first, "stop": last})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_words", pa.int64()), ("hits", span), ("near", span), ("items", pa.list_(pa.string()))])
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                starts, n = np.array(one["starts"], np.int64), len(one["doc_ids"])
                bounds = np.r_[0, np.cumsum(one["counts"], dtype=np.int64)]
                gaps = np.frombuffer(one["postings"], np.int32)
                post = {t: np.cumsum(gaps[bounds[k] : bounds[k + 1]], dtype=np.int64) for k, t in enumerate(one["terms"])}
                at, lengths, close, close_lengths = [], [], [], []
                items: list[set[str]] = [set() for _ in range(n)]
                there = np.zeros(n_terms, bool)
                there[one["terms"]] = True
                for size, table in tables.items():
                    # only windows of which the shard has every term
                    for k in np.flatnonzero(there[table].all(1)).tolist():
                        terms = by_length[size][k]
                        hit = phrase([post[t] for t in terms])
                        if len(hit):
                            at.append(hit)
                            lengths.append(size)
                            for d in np.unique(np.searchsorted(starts, hit, "right") - 1).tolist():
                                items[d].update(queries.windows[terms])
                for size, table in tables.items() if slop is not None else ():
                    close.append(near_starts(post, table, min(slop, slop * size // WINDOW), share))
                    close_lengths.append(size)
                hits = spans(starts, one["n_words"], *merged(at, lengths))
                near = spans(starts, one["n_words"], *merged(close, close_lengths), lead)
                yield pa.RecordBatch.from_pydict({"doc_id": one["doc_ids"], "row_key": one["row_keys"], "n_words": one["n_words"], "hits": hits, "near": near, "items": [sorted(x) for x in items]}, schema)

    return index.mapInArrow(run, FOUND)


def blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks of about block_chars characters; one block is in the driver's memory at a time."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").filter("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r["item"], r["text"].encode()) for r in part.distinct().collect()]


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None, share: float = 0.8, block_chars: int = BLOCK_CHARS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Per document n_words, hits (disjoint word intervals of exact matches), near (of proximity matches, if slop is given) and items."""
    rows = docs.select("doc_id", "text").withColumn("row_key", F.xxhash64("doc_id", "text"))
    found = None
    n = 0
    for k, block in enumerate(blocks(items, block_chars)):
        queries = Queries(sorted(block), window)
        index = common.store(index_shards(rows, queries.vocabulary, shard_tokens), "postings")
        part = search_shards(index, queries, slop, share)
        part = part if k == 0 else part.withColumn("block", F.lit(k))
        found = part.withColumn("block", F.lit(0)) if k == 0 else found.unionByName(part)
        n = k + 1
    if n == 1:
        return found.drop("block", "row_key")
    whole = found.groupBy("doc_id", "row_key", "n_words").agg(F.collect_set(F.struct("block", "hits", "near", "items")).alias("parts"), (F.count("*") / n).cast("int").alias("copies"))

    def union(name: str) -> F.Column:
        covered = F.array_sort(F.flatten(F.transform("parts", lambda p: p[name])))
        # an interval stays if it reaches beyond all before it, and begins a new one unless it touches them
        reach = lambda k: F.array_max(F.transform(F.slice(covered, 1, k), lambda p: p["stop"]))
        begins = F.filter(F.transform(covered, lambda s, k: F.named_struct(F.lit("start"), s["start"], F.lit("new"), F.when(k == 0, True).otherwise(s["start"] > reach(k)))), lambda s: s["new"])
        stops = F.transform(begins, lambda b: F.array_max(F.transform(F.filter(covered, lambda s: (s["start"] >= b["start"]) & (F.coalesce(F.array_min(F.transform(F.filter(begins, lambda c: c["start"] > b["start"]), lambda c: c["start"])), F.lit(2**62)) > s["start"])), lambda s: s["stop"])))
        return F.arrays_zip(F.transform(begins, lambda b: b["start"]), stops).cast("array<struct<start:bigint,stop:bigint>>").alias(name)

    merged_rows = whole.select("doc_id", "n_words", union("hits"), union("near"), F.array_sort(F.array_distinct(F.flatten(F.transform("parts", lambda p: p["items"])))).alias("items"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return merged_rows.drop("_copy")


def digest(found: DataFrame, *more: F.Column) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), *more)


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of an item, exact or in proximity, with all their columns. Rows that repeat
    a doc_id go together."""
    gone = find(docs, items, slop=SLOP, share=SHARE).filter((F.size("hits") > 0) | (F.size("near") > 0)).select(F.col("doc_id").alias("_gone")).distinct()
    gone = common.store(gone, "contaminated")
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")))


def op8_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_decontaminate with n_near (words in proximity matches) and leaked (any match at all)."""
    found = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), slop=SLOP, share=SHARE)
    n_near = F.aggregate("near", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return digest(found, n_near.alias("n_near"), ((F.size("hits") > 0) | (F.size("near") > 0)).alias("leaked"))


WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
HITS_SQL = """
dw AS (SELECT doc_id, coalesce({words}, []) AS w FROM {table}),
iw AS (SELECT DISTINCT item_id, {words} AS w FROM benchmark),
win AS (SELECT item_id, w[p : p + 9] AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM iw WHERE len(w) > 0)),
long AS (SELECT DISTINCT item_id, s FROM win),
lens AS (SELECT DISTINCT len(s) AS n FROM long),
dwin AS (SELECT doc_id, n, p, w[p : p + n - 1] AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, lens)),
hit AS (SELECT d.doc_id, d.p, d.n, l.item_id FROM dwin d JOIN long l ON d.s = l.s),
cover AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hit),
nh AS (SELECT doc_id, count(*) AS n_hit FROM cover GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
"""
OP8_SQL = (
    "WITH "
    + HITS_SQL.format(words=WORDS_SQL, table="documents")
    + """SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN nh ON dw.doc_id = nh.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id"""
)
QUERIES = {"op8_decontaminate": op8_decontaminate, "op8_proximity": op8_proximity}
SQL = {"op8_decontaminate": OP8_SQL}

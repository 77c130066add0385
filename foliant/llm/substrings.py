"""Operator 10: substring deduplication with a compressed FM-index per shard.

A word goes if a window of WINDOW words over it also starts in a document with a smaller doc_id.

1. Anchors. Each window has an anchor, the run of GRAM words in it with the smallest hash, so equal windows have
   equal anchors. Per anchor hash the smallest document (its source), and whether there is another, are summed up.
2. Shards. A document's windows with a repeated anchor go, as joined segments of SEGMENT windows at most, to the shard
   of the anchor's source; the source's own segments, of a window that it repeats the first only, are what that shard
   indexes. A source that many windows read is dealt to several shards, with its segments in each, by how many those
   are: no shard grows with a passage's popularity, nor with a document that repeats a passage in itself.
3. Each shard builds an FM-index (wavelet matrix over the Burrows-Wheeler transform) of its source segments and
   streams the others through it: backward search gives their matching statistics and so the windows found in an
   earlier document; of all that hold a window the least, a range minimum over the suffixes, decides.
4. Windows that share an anchor with the source but are not found there may still repeat between other documents;
   128-bit hashes of their words are summed up in the same way as the anchors. Their words are not compared again:
   carrying them took the shuffle past the disk that a cluster of the check tool has.

Steps 1, 2 and 4 only choose and bring together; none drops a window.

Defined results: a null text has no words; a document with a null doc_id neither loses words nor counts as smaller;
rows that repeat a doc_id are documents of equal number, so none of them is smaller than the other; texts are taken
whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import common
from foliant.llm.fmindex import FMIndex, matched_windows

WINDOW = 13
GRAM = 5
#: Windows that one shard is meant to read.
SHARD_WINDOWS = 250_000
#: Windows of a segment at most; a document's segments reach WINDOW - 1 words into each other.
SEGMENT = 4096
#: Windows of one lane of the search.
LANE = 256
HASH = xxhash.xxh3_64_intdigest
MULTIPLIERS = np.random.default_rng(13).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for every run of size words."""
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += h[k : k + n] * MULTIPLIERS[k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def anchors(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and for each window where its anchor stands (the first of the smallest)."""
    h = np.fromiter(map(HASH, words), np.uint64, len(words))
    g = mixed(h, gram)
    width, n = window - gram + 1, len(words) - window + 1
    low, place, span = g.copy(), np.arange(len(g)), 1
    while span < width:
        shift = min(span, width - span)
        a, b = low[:-shift], low[shift:]
        later = b < a
        place = np.where(later, place[shift:], place[:-shift])
        low = np.where(later, b, a)
        span += shift
    return g, place[:n]


def anchor_rows(docs: DataFrame) -> DataFrame:
    """anchor, doc_id and n, how many windows of the document have the anchor."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found, ids, counts = [], [], []
        for doc, text in zip(batch["doc_id"].to_pylist(), common.text_bytes(batch["text"]), strict=True):
            words = text.split()
            if len(words) >= WINDOW:
                g, place = anchors(words)
                first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                own, which = np.unique(g[place[first]], return_inverse=True)
                found.append(own)
                ids.append(np.full(len(own), doc))
                counts.append(np.bincount(which, np.diff(np.r_[first, len(place)])).astype(np.int64))
        if found:
            yield pa.RecordBatch.from_pydict({"anchor": np.concatenate(found).view(np.int64), "doc_id": np.concatenate(ids), "n": np.concatenate(counts)})

    return common.map_slices(docs.select("doc_id", "text"), "anchor bigint, doc_id bigint, n bigint", run)


def window_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window, from two mixtures of its words' hashes."""
    h = np.fromiter(map(HASH, words), np.uint64, len(words))
    return mixed(h, WINDOW), mixed(h[::-1], WINDOW)[::-1]


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """[first, last) of equal neighbours."""
    if len(values):
        cuts = np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)].tolist()
        yield from zip(cuts[:-1], cuts[1:], strict=True)


def segments(docs: DataFrame, flags: DataFrame, n_shards: int) -> DataFrame:
    """Rows for the shards: is_source, doc_id, row_key, first (word) and the words of a segment.

    flags: doc_id and marks, the document's repeated anchors with source and in how many parts the source is dealt.
    """
    rows = docs.select("doc_id", "text").join(flags.select(F.col("doc_id").alias("_id"), "marks").hint("shuffle_hash"), F.col("doc_id") == F.col("_id")).select("doc_id", F.xxhash64("text").alias("row_key"), "text", "marks")

    def shard(source: int, part: int) -> int:
        return xxhash.xxh64_intdigest(f"{source}:{part}".encode()) % n_shards

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in ("shard", "is_source", "doc_id", "row_key", "first", "words")}

        def emit(where: int, is_source: bool, doc: int, key: int, first: int, words: list[bytes]) -> None:
            for name, value in zip(out, (where, is_source, doc, key, first, b" ".join(words)), strict=True):
                out[name].append(value)

        marks = batch["marks"]
        flat = marks.flatten()
        bounds = marks.offsets.to_numpy() - marks.offsets[0].as_py()
        all_anchors, all_sources, all_parts = (flat.field(k).to_numpy() for k in ("anchor", "source", "parts"))
        for k, (doc, key, text) in enumerate(zip(batch["doc_id"].to_pylist(), batch["row_key"].to_pylist(), common.text_bytes(batch["text"]), strict=True)):
            words = text.split()
            if len(words) < WINDOW:
                continue
            own = slice(bounds[k], bounds[k + 1])
            order = np.argsort(all_anchors[own])
            known, sources, parts = all_anchors[own][order], all_sources[own][order], all_parts[own][order]
            g, place = anchors(words)
            here = g[place].view(np.int64)
            at = np.minimum(np.searchsorted(known, here), len(known) - 1)
            # place in known, or -1: neighbours with one source make a segment
            repeated = known[at] == here
            groups, kind = np.unique(sources, return_inverse=True)
            source_of = np.where(repeated, kind[at], -1)
            own_source = np.flatnonzero(groups == doc)
            if len(own_source):
                # what the document repeats in itself is indexed once
                mine = np.flatnonzero(source_of == own_source[0])
                x, y = (h[mine] for h in window_hashes(words))
                order = np.lexsort((y, x))
                x, y = x[order], y[order]
                source_of[mine[order[1:][(x[1:] == x[:-1]) & (y[1:] == y[:-1])]]] = -1
            for low, high in runs(source_of):
                if source_of[low] < 0:
                    continue
                source, n_parts = int(groups[source_of[low]]), int(parts[at[low]])
                for a in range(low, high, SEGMENT):
                    piece = words[a : min(a + SEGMENT, high) + WINDOW - 1]
                    if source == doc:
                        for where in sorted({shard(source, p) for p in range(n_parts)}):
                            emit(where, True, doc, key, a, piece)
                    else:
                        emit(shard(source, xxhash.xxh64_intdigest(f"{doc}:{a}".encode()) % n_parts), False, doc, key, a, piece)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("shard", pa.int32()), ("is_source", pa.bool_()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("first", pa.int32()), ("words", pa.binary())]))

    return common.map_slices(rows, "shard int, is_source boolean, doc_id bigint, row_key bigint, first int, words binary", run)


JUDGED = "doc_id bigint, row_key bigint, firsts array<int>, lasts array<int>, open_at array<int>, open_hash array<binary>"


def judge(table: pa.Table) -> pa.Table:
    """One shard: index its source segments, stream the others. Gives word intervals that go and windows still open."""
    is_source = table["is_source"].to_numpy()
    docs, keys, firsts, texts = (table[k].to_pylist() for k in ("doc_id", "row_key", "first", "words"))
    vocabulary: dict[bytes, int] = {}
    parts, owners = [], []
    for k in np.flatnonzero(is_source).tolist():
        words = texts[k].split()
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
        parts += [ids, [0]]
        owners += [docs[k]] * (len(ids) + 1)
    index = FMIndex(np.fromiter((x for p in parts for x in p), np.int64), len(vocabulary) + 1)
    by_order = np.array(owners, np.int64)[index.order] if owners else np.zeros(0, np.int64)
    reading = np.flatnonzero(~is_source).tolist()
    out: dict[str, list] = {k: [] for k in ("doc_id", "row_key", "firsts", "lasts", "open_at", "open_hash")}
    for group in range(0, len(reading), 20_000):
        part = reading[group : group + 20_000]
        streams, lanes, readers, starts, at = [], [], [], [], 0
        for k in part:
            words = texts[k].split()
            streams.append(np.fromiter(map(vocabulary.get, words, repeat(0)), np.int64, len(words)))
            starts.append(at)
            last = at + len(words) - WINDOW + 1
            for a in range(at, last, LANE):
                lanes.append((a, min(a + LANE, last)))
                readers.append(docs[k])
            at += len(words)
        found = matched_windows(index, by_order, np.concatenate(streams), lanes, np.array(readers, np.int64), WINDOW) if part else np.zeros(0, bool)
        for k, start, stream in zip(part, starts, streams, strict=True):
            marks = found[start : start + len(stream) - WINDOW + 1]
            gone = [(firsts[k] + a, firsts[k] + b + WINDOW - 1) for a, b in runs(marks) if marks[a]]
            still = np.flatnonzero(~marks)
            words = texts[k].split() if len(still) else []
            hashes = [xxhash.xxh3_128_digest(b" ".join(words[p : p + WINDOW])) for p in still.tolist()]
            values = (docs[k], keys[k], [a for a, _ in gone], [b for _, b in gone], (still + firsts[k]).tolist(), hashes)
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
    return pa.Table.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("firsts", pa.list_(pa.int32())), ("lasts", pa.list_(pa.int32())), ("open_at", pa.list_(pa.int32())), ("open_hash", pa.list_(pa.binary()))]))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (hash of the text) and gone: word intervals of the document that go, in no order."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").filter("doc_id is not null")
    found = common.store(anchor_rows(rows), "anchors")
    repeated = found.groupBy("anchor").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("_last"), F.sum("n").alias("n")).filter("source < _last").select("anchor", "source", "n")
    repeated = common.store(repeated, "repeated")
    load = repeated.groupBy("source").agg(F.ceil(F.sum("n") / F.lit(SHARD_WINDOWS)).cast("int").alias("parts"))
    marked = found.select("anchor", "doc_id").join(repeated.join(load, "source").select("anchor", "source", "parts"), "anchor")
    flags = common.store(marked.groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "source", "parts")).alias("marks")), "flags")
    common.discard(found)
    n = repeated.agg(F.sum("n")).first()[0] or 0
    common.release(spark)
    cut = segments(rows, flags, max(1, -(-n // SHARD_WINDOWS)))
    judged = common.store(cut.groupBy("shard").applyInArrow(judge, JUDGED), "judged")
    common.discard(flags)
    common.discard(repeated)
    common.release(spark)
    gone = judged.select("doc_id", "row_key", F.explode(F.arrays_zip("firsts", "lasts")).alias("_z")).select("doc_id", "row_key", F.col("_z.firsts").alias("first"), F.col("_z.lasts").alias("last"))
    still = judged.select("doc_id", "row_key", F.explode(F.arrays_zip("open_at", "open_hash")).alias("_z")).select("doc_id", "row_key", F.col("_z.open_at").alias("first"), F.col("_z.open_hash").alias("hash"))
    again = still.groupBy("hash").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("_last")).filter("source < _last").select("hash", "source")
    late = still.join(again, "hash").filter("doc_id > source").select("doc_id", "row_key", "first", (F.col("first") + WINDOW).alias("last"))
    return gone.unionByName(late).groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("first", "last")).alias("gone"))


def without_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words as text."""
    gone = common.store(repeats(docs), "gone")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("row_key")).join(gone.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "gone").hint("shuffle_hash"), (F.col("doc_id") == F.col("_id")) & (F.col("row_key") == F.col("_key")), "left").select("doc_id", "text", "gone")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", text string" * keep_text

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": []} | ({"text": []} if keep_text else {})
        for text, spans in zip(common.text_bytes(batch["text"]), batch["gone"].to_pylist(), strict=True):
            words = text.split()
            n = len(words)
            if spans:
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, [s["first"] for s in spans], 1)
                np.add.at(edge, [s["last"] for s in spans], -1)
                words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            kept = b" ".join(words)
            out["n_words"].append(n)
            out["n_removed"].append(n - len(words))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if keep_text:
                out["text"].append(kept.decode())
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], **out})

    return common.map_slices(rows, schema, run)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(common.table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, p, sha256(array_to_string(w[p : p + 12], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM dw)),
least_doc AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM win JOIN least_doc USING (s) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM dw),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY q) AS t FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.q = gone.q GROUP BY words.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM dw LEFT JOIN counts ON dw.doc_id = counts.doc_id LEFT JOIN kept ON dw.doc_id = kept.doc_id
"""
QUERIES = {"op10_substrings": op10_substrings}
SQL = {"op10_substrings": OP10_SQL}

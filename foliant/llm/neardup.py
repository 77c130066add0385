"""Operator 7: near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text's words are its ASCII-lower-cased white-space tokens; its shingles are runs of five words (all words, if
fewer), weighted by term frequency times inverse document frequency. Document frequencies df are exact, over all texts.
The inverse one is taken relative to that of a shingle of one text only, 1 + ln((N + 1) / df) / ln(N + 1), which lies
between 1 and 2 in a corpus of any size: with an unbounded one a changed word would outweigh all that the copies of
a text share as soon as much of the corpus holds them.

0. Shingles of two texts or more are counted (hashcounts) and set bits in a table of fixed size. A text's other
   shingles are its own; where they weigh so much that no text can reach the similarity, the text is alike to nothing
   but exact copies. The others form batches. The HOT most frequent shingles are known to every task; all others of a
   batch whose bit is set are looked up in the counted table, by a shuffle of packed arrays, and come back in order.
1. Texts of the same words become one node (128-bit key).
2. BANDS x ROWS samples: each draws the shingle with the smallest a = c / (y e^r) of Ioffe's scheme, so that two
   texts agree in a sample with probability equal to their weighted Jaccard similarity. Bands of ROWS samples give
   buckets.
3. The most central node of a bucket, the one whose buckets hold most, is its hub; a hub's buckets make a star, and
   all nodes of a star are compared with the hub, never all with all.
4. Two nodes n, m of a star share at most min(o_n, o_m) + min(S_n, S_m) of weight, o being what a node shares with
   the hub and S the weight outside the hub that nodes of other classes have as well. A similarity of s needs a share
   of s / (1 + s) of both weights, which closes most nodes. What remains open is compared with further hubs of its
   star, those first that are outside the star's largest class, only where the bound allows it and the classes
   differ; a hub leaves its star when that is done. There are more hubs each round, until no star has open nodes of two
   classes. So no pair of a bucket that reaches the threshold stays unconnected.
5. Every compared pair is verified by its exact weighted Jaccard similarity; links make classes.

Result per row of docs: doc_id, class_id (smallest doc_id of the class), n_copies (rows with the same words).

Defined results: texts without words (null, empty, blank) are alike to nothing: a class each; rows that repeat a
doc_id share it as their class's candidate; a null doc_id is never a class_id unless all of the class are null;
long texts are taken whole; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from foliant.llm import common, graph, hashcounts

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: The most frequent shingles, which every task knows; the others are looked up. All are exact.
HOT = 1 << 14
#: Two to this power are the bits of the table of shingles that two texts or more have (16 MB).
FILTER_BITS = 27
#: Shingles of a batch of texts, about; a longer text is a batch of its own.
BATCH = 1 << 18
#: Keys that a task remembers, so that it sends the vector of exact copies once.
REMEMBERED = 100_000
#: In the place of a shingle, counts texts with words.
TEXTS = np.uint64(0)
SEED = 20240229
#: Shingles sketched at once: keeps the arrays of a step in the processor's cache.
STEP = 1024
#: Quantiles that stand for the gamma draws.
TABLE = 4096
#: Further hubs of a star in the first round after its own.
HUBS = 256
#: What rounding may take from a bound, relative to the weights.
SLACK = 1e-5
HASH = xxhash.xxh3_64_intdigest


def shingles(text: bytes, size: int = SHINGLE) -> tuple[bytes | None, np.ndarray]:
    """128-bit key of the words and the hashes of all shingles, in text order."""
    words = text.lower().split()
    if not words:
        return None, np.zeros(0, np.uint64)
    h = np.fromiter(map(HASH, words), np.uint64, len(words))
    key = xxhash.xxh3_128_digest(h.tobytes())
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return key, out


def frequencies(docs: DataFrame, bits: int) -> DataFrame:
    """Counted table of the document frequencies of all shingles of two texts or more, and under TEXTS of the texts."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for at in range(0, batch.num_rows, common.SLICE_ROWS):
                n = 0
                for text in common.text_bytes(batch["text"].slice(at, common.SLICE_ROWS)):
                    h = shingles(text)[1]
                    if len(h):
                        n += 1
                        yield np.unique(h)
                yield np.full(n, TEXTS)

    return hashcounts.counted(docs.select("text"), distinct, 2, bits)


@dataclass
class Frequencies:
    """The number of texts, the bits of repeated shingles, and the most frequent of those with their frequencies."""

    n: int
    repeated: hashcounts.Bits
    hot: np.ndarray
    hot_df: np.ndarray

    def idf(self, df: np.ndarray) -> np.ndarray:
        whole = np.log(self.n + 1)
        return 1 + (whole - np.log(df)) / whole

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Document frequencies of the hot shingles, 0 for all others."""
        if not len(self.hot):
            return np.zeros(len(hashes), np.int64)
        place = np.searchsorted(self.hot, hashes).clip(max=len(self.hot) - 1)
        return np.where(self.hot[place] == hashes, self.hot_df[place], 0)

    def may_pair(self, repeated: np.ndarray, tf: np.ndarray, similarity: float) -> bool:
        """Whether a text with these frequencies can be similar to a different one: both share repeated shingles only,
        none of which weighs more than one of two texts."""
        shared = float(tf[repeated].sum()) * float(self.idf(np.array(2.0)))
        return shared >= (similarity - SLACK) * (shared + 2.0 * float(tf[~repeated].sum()))


def summary(table: DataFrame, bits: int) -> Frequencies:
    hot, df = hashcounts.most_frequent(table, HOT + 1)
    n = int(df[hot == TEXTS].sum())
    return Frequencies(max(n, 1), hashcounts.bits_of(table, FILTER_BITS, bits), hot[hot != TEXTS], df[hot != TEXTS])


DRAWN = "doc_id bigint, key binary, batch bigint, keys array<binary>, sizes array<int>, hashes binary, tf binary, ask binary"


def drawn(docs: DataFrame, known: Broadcast, similarity: float) -> DataFrame:
    """Two kinds of rows: doc_id and key of every row of docs, and batches of the texts that may be similar to others:
    their keys, numbers of distinct shingles, those and their frequencies in the text, and the shingles to look up."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("batch", pa.int64()), ("keys", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("hashes", pa.binary()), ("tf", pa.binary()), ("ask", pa.binary())])

    def batch_row(number: int, held: list[tuple[bytes, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        every = np.concatenate([own for _, own, _ in held])
        ask = np.unique(every[known.value.repeated.has(every) & (known.value.known(every) == 0)])
        row = {"doc_id": [None], "key": [None], "batch": [number], "keys": [[k for k, _, _ in held]], "sizes": [[len(own) for _, own, _ in held]], "hashes": [every.tobytes()], "tf": [np.concatenate([tf for _, _, tf in held]).astype(np.int32).tobytes()], "ask": [hashcounts.pack(ask)]}
        return pa.RecordBatch.from_pydict(row, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, seen = TaskContext.get().partitionId() << 32, [], 0, set()
        for batch in batches:
            for at in range(0, batch.num_rows, common.SLICE_ROWS):
                part, keys = batch.slice(at, common.SLICE_ROWS), []
                for text in common.text_bytes(part["text"]):
                    key, h = shingles(text)
                    keys.append(key)
                    if not key or key in seen:
                        continue
                    own, tf = np.unique(h, return_counts=True)
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    if known.value.may_pair(known.value.repeated.has(own), tf, similarity):
                        held.append((key, own, tf))
                        size += len(own)
                    if size >= BATCH:
                        yield batch_row(number, held)
                        number, held, size = number + 1, [], 0
                none = [None] * len(keys)
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"].cast(pa.int64()), "key": keys, **{c: none for c in schema.names[2:]}}, schema)
        if held:
            yield batch_row(number, held)

    return docs.select("doc_id", "text").mapInArrow(run, DRAWN)


def weighted(batches_: DataFrame, answers: DataFrame, known: Broadcast, similarity: float) -> DataFrame:
    """key, distinct shingles, their weights and the bands of every text of the batches that may be similar to another,
    by the exact weight of its repeated shingles. answers: batch, shard, n, as hashcounts.looked_up() gives them."""
    sampler = Sampler()
    payload = ("keys", "sizes", "hashes", "tf", "ask")
    asked = batches_.select("batch", F.lit(-1).alias("shard"), F.lit(None).cast("binary").alias("n"), *payload)
    answered = answers.select("batch", "shard", "n", *[F.lit(None).cast(batches_.schema[c].dataType).alias(c) for c in payload])
    out_schema = pa.schema([("key", pa.binary()), ("hashes", pa.binary()), ("weights", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def whole(row: dict, n: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every, tf, ask = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["tf"], np.int32), hashcounts.unpack(row["ask"])
        df = np.maximum(known.value.known(every), 1)
        if len(ask):
            counts = np.concatenate(n).astype(np.int64)
            place = np.searchsorted(ask, every).clip(max=len(ask) - 1)
            df = np.where(ask[place] == every, np.maximum(counts[place], 1), df)
        w = (tf * known.value.idf(df)).astype(np.float32)
        parts, chosen = [], []
        at = 0
        for key, size in zip(row["keys"], row["sizes"], strict=True):
            own, weight, often = every[at : at + size], w[at : at + size], df[at : at + size] > 1
            at += size
            if float(weight[often].sum(dtype=np.float64)) >= (similarity - SLACK) * float(weight.sum(dtype=np.float64)):
                parts.append((own, weight))
                chosen.append(key)
        for k in range(0, len(parts), common.SLICE_ROWS):
            some = parts[k : k + common.SLICE_ROWS]
            bands = band_hashes(sampler.sketch([(h, np.log(x)) for h, x in some]))
            yield pa.RecordBatch.from_pydict({"key": chosen[k : k + common.SLICE_ROWS], "hashes": [h.tobytes() for h, _ in some], "weights": [x.tobytes() for _, x in some], "bands": bands.tolist()}, out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, n = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] >= 0:
                    n.append(hashcounts.of_planes(r["n"]))
                    continue
                if row:
                    yield from whole(row, n)
                row, n = r, []
        if row:
            yield from whole(row, n)

    return asked.unionByName(answered).repartition("batch").sortWithinPartitions("batch", "shard").mapInArrow(run, "key binary, hashes binary, weights binary, bands array<bigint>")


class Sampler:
    """Ioffe's improved consistent weighted sampling with draws hashed from the shingle and the sample's number."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.multipliers = rng.integers(0, 2**63, samples, np.uint64) * np.uint64(2) + np.uint64(1)
        # Gamma(2, 1) has the distribution function 1 - (1 + x) e^-x
        x = np.linspace(0, 40, 400_001)
        quantiles = np.interp((np.arange(TABLE) + 0.5) / TABLE, 1 - (1 + x) * np.exp(-x), x)
        self.r, self.log_c = quantiles.astype(np.float32), np.log(quantiles).astype(np.float32)

    def draw(self, hashes: np.ndarray, log_w: np.ndarray) -> np.ndarray:
        """For every shingle and sample, ln a in the upper half of an integer and the sample's name in the lower."""
        x = hashes[:, None] * self.multipliers
        r = self.r[x >> np.uint64(52)]
        log_c = self.log_c[(x >> np.uint64(40)) & np.uint64(TABLE - 1)]
        beta = ((x >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
        t = np.floor(log_w[:, None] / r + beta)
        log_a = log_c - r * (t - beta + np.float32(1))
        bits = log_a.view(np.int32)
        bits = bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))
        name = ((hashes >> np.uint64(32)).astype(np.uint32)[:, None] + t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)).astype(np.int64)
        return (bits.astype(np.int64) << 32) | name

    def sketch(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Names of the drawn samples, a row per text; parts has each text's distinct shingles and log weights."""
        out = np.full((len(parts), len(self.multipliers)), np.iinfo(np.int64).max)
        sizes = np.array([len(h) for h, _ in parts])
        hashes, weights = np.concatenate([h for h, _ in parts]), np.concatenate([w for _, w in parts])
        owner = np.repeat(np.arange(len(parts)), sizes)
        for at in range(0, len(hashes), STEP):
            who = owner[at : at + STEP]
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            low = np.minimum.reduceat(self.draw(hashes[at : at + STEP], weights[at : at + STEP]), first, axis=0)
            out[who[first]] = np.minimum(out[who[first]], low)
        return (out & 0xFFFFFFFF).astype(np.uint64)


def band_hashes(names: np.ndarray) -> np.ndarray:
    """A bucket per band, the band's number mixed in."""
    n = names.reshape(len(names), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407), n.shape[:2]).copy()
    for k in range(ROWS):
        out = (out ^ n[:, :, k]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def shared_weight(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> np.ndarray:
    """For each shingle of x the weight that y has as well; x and y ascend."""
    place = np.searchsorted(y, x).clip(max=len(y) - 1)
    return np.where(y[place] == x, np.minimum(wx, wy[place]), np.float32(0))


def weighted_jaccard(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """Sum of minima over sum of maxima."""
    low = float(shared_weight(x, wx, y, wy).sum(dtype=np.float64))
    return low / float(wx.sum(dtype=np.float64) + wy.sum(dtype=np.float64) - low)


def sides(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    """pairs (a, b) with the vectors of both. A hub's vector meets its pairs in the join, not before."""
    named = lambda k: vecs.select(F.col("key").alias(k), F.col("hashes").alias(f"h{k}"), F.col("weights").alias(f"w{k}"))
    return pairs.join(named("a"), "a").join(named("b"), "b")


def both_vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for ha, wa, hb, wb in zip(*(batch[c].to_pylist() for c in ("ha", "wa", "hb", "wb")), strict=True):
        yield np.frombuffer(ha, np.uint64), np.frombuffer(wa, np.float32), np.frombuffer(hb, np.uint64), np.frombuffer(wb, np.float32)


def similarities(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    """a, b and their weighted Jaccard similarity."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sims = [weighted_jaccard(*four) for four in both_vectors(batch)]
        yield pa.RecordBatch.from_pydict({"a": batch["a"], "b": batch["b"], "sim": pa.array(sims, pa.float64())})

    return common.map_slices(sides(pairs, vecs), "a binary, b binary, sim double", run)


def against_hub(stars: DataFrame, vecs: DataFrame) -> DataFrame:
    """For (key, hub): their similarity, the node's weight, what of it the hub shares, and the shingles with the
    weight that it does not."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sims, whole, common_, sizes, tokens, extra = [], [], [], [], [], []
        for x, wx, y, wy in both_vectors(batch):
            low = shared_weight(x, wx, y, wy)
            w, o = float(wx.sum(dtype=np.float64)), float(low.sum(dtype=np.float64))
            sims.append(o / (w + float(wy.sum(dtype=np.float64)) - o))
            whole.append(w)
            common_.append(o)
            over = np.flatnonzero(wx > low)
            sizes.append(len(over))
            tokens.append(x[over])
            extra.append((wx - low)[over])
        at = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts))) for parts in ([t.view(np.int64) for t in tokens], extra)]
        yield pa.RecordBatch.from_pydict({"key": batch["a"], "hub": batch["b"], "sim": pa.array(sims, pa.float64()), "w": pa.array(whole, pa.float64()), "o": pa.array(common_, pa.float64()), "tokens": lists[0], "extra": lists[1]})

    return common.map_slices(sides(stars.select(F.col("key").alias("a"), F.col("hub").alias("b")), vecs), "key binary, hub binary, sim double, w double, o double, tokens array<bigint>, extra array<float>", run)


def rooted(frame: DataFrame, roots: DataFrame) -> DataFrame:
    """frame with the root of its key's class."""
    return frame.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def mixed(rows: DataFrame) -> DataFrame:
    """rows (star, key, root, ...) of the stars that have two classes or more, and whether a row is outside the largest."""
    sizes = rows.groupBy("star", "root").agg(F.count("*").alias("_n"))
    per_star = sizes.groupBy("star").agg(F.max(F.struct("_n", "root"))["root"].alias("_most"), F.count("*").alias("_classes")).filter("_classes > 1")
    return rows.join(per_star.select("star", "_most"), "star").withColumn("outside", F.col("root") != F.col("_most")).drop("_most")


def open_nodes(judged: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(star, key, root, w, room): nodes of a star that may reach the similarity with one of another class. room is
    the largest weight that such a node can have."""
    rows = mixed(rooted(judged.withColumnRenamed("hub", "star").drop("sim"), roots))
    extras = rows.select("star", "key", "root", F.explode(F.arrays_zip("tokens", "extra")).alias("_t")).select("star", "key", "root", F.col("_t.tokens").alias("token"), F.col("_t.extra").alias("extra"))
    met = extras.groupBy("star", "token").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b").select("star", "token")
    more = extras.join(met, ["star", "token"]).groupBy("star", "key").agg(F.sum(F.col("extra").cast("double")).alias("more"))
    # similarity s needs a shared weight of s / (1 + s) of the sum of both weights
    room = (F.col("o") + F.coalesce("more", F.lit(0.0))) * ((1 + similarity) / similarity) - F.col("w")
    nodes = rows.join(more, ["star", "key"], "left").select("star", "key", "root", "w", (room + SLACK * F.col("w")).alias("room"))
    nodes = common.store(nodes, "bounds")
    ends = nodes.groupBy("star").agg(F.min("w").alias("_light"), F.max("room").alias("_room"))
    live = common.store(nodes.join(ends, "star").filter("room >= _light and w <= _room").drop("_light", "_room"), "open")
    common.discard(nodes)
    return live


def linked(stars: DataFrame, vecs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """node and root (smallest key of the class) of all nodes that share a bucket with one whose similarity reaches
    the threshold, or are connected to it by such links. stars: (key, hub)."""
    judged = common.store(against_hub(stars, vecs), "judged")
    roots = graph.components(judged.filter(F.col("sim") >= similarity).select(F.col("key").alias("a"), F.col("hub").alias("b")))
    live = open_nodes(judged, roots, similarity)
    common.discard(judged)
    # what is found here joins the classes at the end: a link's hub leaves its star, so it is not looked for again
    found: list[DataFrame] = []
    n_hubs, turn = HUBS, 0
    while True:
        turn += 1
        left = common.store(mixed(live), "mixed")
        if left.isEmpty():
            common.discard(left)
            break
        # a hub for each of n_hubs slices of a star; maxima combine before the shuffle
        slot = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(n_hubs)).alias("slot")
        hubs = left.groupBy("star", slot).agg(F.max(F.struct("outside", "room", "key", "w", "root")).alias("h")).select("star", "h.*")
        hubs = common.store(hubs.select("star", F.col("key").alias("hub"), F.col("root").alias("hub_root"), F.col("w").alias("hub_w"), F.col("room").alias("hub_room")), "hubs")
        pairs = left.join(hubs, "star").filter("root <> hub_root and w <= hub_room and hub_w <= room").select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()
        found.append(common.store(similarities(pairs, vecs).filter(F.col("sim") >= similarity), "similar"))
        rest = left.join(hubs.select("star", F.col("hub").alias("key")), ["star", "key"], "left_anti")
        live = rest.select("star", "key", "root", "w", "room")
        n_hubs *= 64
    if found:
        roots = graph.merged(roots, functools.reduce(DataFrame.unionByName, found).select("a", "b"))
    for links in found:
        common.discard(links)
    return roots


def vectors(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """doc_id and key of every row of docs (key null without words); and key, hashes, weights and bands of the texts
    that may be similar to others. A text can be there several times. Both are stored."""
    bits = hashcounts.shard_bits(docs)
    table = common.store(frequencies(docs, bits), "frequencies")
    known = docs.sparkSession.sparkContext.broadcast(summary(table, bits))
    both = common.store(drawn(docs, known, similarity), "drawn")
    batches = both.filter("batch is not null")
    vecs = common.store(weighted(batches, hashcounts.looked_up(batches.select("batch", F.col("ask").alias("hashes")), table, bits), known, similarity), "weighted")
    ids = common.store(both.filter("batch is null").select("doc_id", "key"), "ids")
    for old in (table, both):
        common.discard(old)
    return ids, vecs


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, key, class_id and n_copies for every row of docs; reads stored tables."""
    ids, every = vectors(docs, similarity)
    nodes = common.store(ids.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies")), "nodes")
    member = every.select("key", F.explode("bands").alias("bucket")).distinct()
    shared = member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    # a node's buckets are BANDS at most
    per_key = member.join(shared, "bucket").groupBy("key").agg(F.sum("n").alias("central"), F.collect_list("bucket").alias("buckets"))
    per_key = common.store(per_key, "buckets")
    buckets = per_key.select("key", "central", F.explode("buckets").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.max(F.struct("central", "key"))["key"].alias("hub"))
    stars = common.store(buckets.join(hubs, "bucket").filter("key <> hub").select("key", "hub").distinct(), "stars")
    vecs = common.store(every.select("key", "hashes", "weights").join(per_key.select("key"), "key", "left_semi").dropDuplicates(["key"]), "vectors")
    common.discard(every)
    common.discard(per_key)
    roots = linked(stars, vecs, similarity)
    for old in (stars, vecs):
        common.discard(old)
    in_class = nodes.select("key", "doc_id", "n_copies").join(roots.withColumnRenamed("node", "key"), "key")
    named = in_class.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    grouped = in_class.join(named, "root").select("key", "class_id", "root")
    per_node = nodes.select("key", "doc_id", "n_copies").join(grouped, "key", "left").select(F.col("key").alias("_key"), F.coalesce("root", "key").alias("root"), F.coalesce("class_id", "doc_id").alias("class_id"), "n_copies")
    per_node = common.store(per_node, "classes")
    for old in (nodes, roots):
        common.discard(old)
    return ids.join(per_node, F.col("key") == F.col("_key"), "left").select("doc_id", "key", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id and n_copies for every row of docs."""
    return _classes(docs, similarity).select("doc_id", "class_id", "n_copies")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs of each class, with all its columns: the one with the smallest doc_id, nulls last; of rows that
    share that id the one with the smallest key, and any of those with the same words."""
    found = common.store(_classes(docs, similarity), "found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "key")).alias("_first")
    kept = found.filter("root is not null").groupBy("root").agg(first).select("root", F.col("_first.doc_id").alias("_id"), F.col("_first.key").alias("_key"))
    other = ~F.col("doc_id").eqNullSafe(F.col("_id")) | (F.col("key") != F.col("_key"))
    # a row without words is of no class and stays
    lost = found.join(kept, "root", "left").withColumn("_lost", F.when(F.col("root").isNull(), False).otherwise(other))
    per_id = lost.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("_lost").alias("n_lost"))
    gone = common.store(per_id.filter("n_lost = n and doc_id is not null").select(F.col("doc_id").alias("_gone")), "gone")
    out = docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col("_gone"), "left_anti")
    # ids that stand for several rows, of which some may go
    shared = common.store(per_id.filter("(n > 1 or doc_id is null) and n_lost < n or doc_id is null").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_shared")), "shared-ids")
    if shared.isEmpty():
        return out
    keys = common.store(lost.filter(~F.col("_lost") & F.col("key").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "kept-keys")
    marked = out.join(shared, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    names = docs.columns
    whole = with_key(marked.filter("_shared").select(*names))
    some = whole.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")), "left_semi")
    one = some.groupBy("_own").agg(F.first(F.struct(*names)).alias("_row")).select("_row.*")
    return marked.filter("_shared is null").select(*names).unionByName(one).unionByName(whole.filter("_own is null").select(*names))


def with_key(docs: DataFrame) -> DataFrame:
    """docs with the key of their words as _own."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = [shingles(text)[0] for text in common.text_bytes(batch["text"])]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "_own"])

    return common.map_slices(docs, StructType([*docs.schema.fields, StructField("_own", BinaryType())]), run)


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"))


QUERIES = {"op7_neardup": op7_neardup}
SQL: dict[str, str] = {}

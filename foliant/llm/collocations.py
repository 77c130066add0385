"""Operator 12: collocations, phrases of two to four words that hold together.

Texts are lower-cased (A-Z only), cut into pieces at sentence signs and line ends, and pieces into words.

1. All n-grams of one to MAX_N words inside pieces become 64-bit keys of language and words, which are hash-aggregated,
   packed many to a row (hashcounts). Two n-grams of one key only add up, so a key under MIN_COUNT has no n-gram that
   reaches it. The keys that reach it set bits in a table of fixed size, 2 ** FILTER_BITS.
2. n-grams whose bit is set are counted exactly: in runs by numbers of their words, then as rows of language and phrase. Others can't reach
   MIN_COUNT and are not needed further: every part of a phrase is at least as frequent as the phrase.
3. A candidate's cuts are joined with the counts of their prefix and suffix and scored in decimals; the lowest counts.
4. Candidates that a one-word extension mostly explains go by an anti-join: counts of longer phrases never exceed those
   of the phrases between, so some longer candidate reaches the share only if a one-word extension does.
5. Ranks are taken in two steps, first inside slices of a language, so that no task sorts all phrases of one.

Defined results: a null text has no words, a null lang is und and joins those that are named so; repeated rows count
each; texts and pieces of any length are read in runs of words, none of which is held with the others; languages without
candidates give no rows, an empty table an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm import common, hashcounts

MAX_N, MIN_COUNT, TOP = 4, 30, 2000
#: A longer phrase explains a shorter one from this percentage of its count on.
EXPLAINED = 80
FACTOR = 2_000_000
#: Two to this power are the bits of the table of keys that reach MIN_COUNT (8 MB), of which a key has PROBES. With more
#: keys than that, more rarer phrases are counted as well, and are left out by their count.
FILTER_BITS, PROBES = 26, 3
#: Words that are worked on at once, words of a long piece, and bytes of a text.
RUN_WORDS, PIECE_WORDS, TEXT_BYTES = 500_000, 50_000, 1 << 20
#: Bytes of a word that xxhash hashes.
LONG = 64
#: Bytes that count as a word in a run's size, if its words are longer.
WORD_BYTES = 16
#: Parts of a language that are ranked apart before the whole.
SLICES = 64
#: Sentence signs and line ends become line feeds, tabs blanks; what is left of white space is blanks.
CUT = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
WORD = re.compile(rb"[^ ]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def pieces(text: bytes) -> Iterator[bytes]:
    """Pieces of a text that is not held as a list of all of them. bytes.lower() lowers A-Z alone."""
    text = text.lower().translate(CUT)
    at = 0
    while at < len(text):
        end = text.find(b"\n", at + TEXT_BYTES)
        end = len(text) if end < 0 else end
        yield from text[at:end].split(b"\n")
        at = end + 1


def piece_runs(piece: bytes, max_n: int) -> Iterator[tuple[list[bytes], int]]:
    """The words of a piece and at how many of them n-grams start; a long piece in parts that reach max_n - 1 words over."""
    if len(piece) < 2 * PIECE_WORDS:
        words = piece.split()
        if words:
            yield words, len(words)
        return
    words = []
    for m in WORD.finditer(piece):
        words.append(m[0])
        if len(words) == PIECE_WORDS + max_n - 1:
            yield words, PIECE_WORDS
            words = words[PIECE_WORDS:]
    if words:
        yield words, len(words)


def word_hashes(words: pa.BinaryArray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time; of long ones by xxhash."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1).astype(np.int64) if len(words) else np.zeros(1, np.int64)
    sizes = np.diff(offsets)
    raw = np.concatenate([np.frombuffer(words.buffers()[2], np.uint8, offsets[-1]) if offsets[-1] else np.zeros(0, np.uint8), np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(raw, 8)
    out = sizes.astype(np.uint64) * MULTIPLIER
    for k in range(0, min(int(sizes.max(initial=0)), LONG), 8):
        own = np.flatnonzero(sizes > k)
        block = eight[offsets[own] + k].copy().view(np.uint64).ravel()
        past = (8 - np.minimum(sizes[own] - k, 8)).astype(np.uint64) * np.uint64(8)
        mixed = (out[own] ^ (block << past)) * MULTIPLIER
        out[own] = mixed ^ (mixed >> np.uint64(29))
    for k in np.flatnonzero(sizes > LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(words[k].as_py())
    return out


class Run:
    """Lower-cased bytes of texts, or of parts of long ones, with their languages and how many of the last words of each
    start no n-gram."""

    def __init__(self) -> None:
        self.texts: list[bytes] = []
        self.langs: list[str] = []
        self.over: list[int] = []
        self.size = 0

    def add(self, lang: str, text: bytes, over: int = 0) -> None:
        self.texts.append(text)
        self.langs.append(lang)
        self.over.append(over)
        # words at most, and bytes as well, as words may be long
        self.size += max(1 + text.count(b" ") + text.count(b"\n"), len(text) // WORD_BYTES)

    def cut(self) -> Run:
        """Numbers the words: equal words have equal numbers. vocabulary: the words by number."""
        raw = np.frombuffer(b"\n".join(self.texts), np.uint8)
        gap = np.r_[True, (raw == 10) | (raw == 32), True]
        edges = np.flatnonzero(gap[1:] != gap[:-1]).reshape(-1, 2)
        begins, sizes = edges[:, 0], edges[:, 1] - edges[:, 0]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        split = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~gap[1:-1]])]).dictionary_encode()
        self.vocabulary = split.dictionary
        self.words = split.indices.to_numpy().astype(np.int64)
        # the text of each word, and how many words of its piece are left with it
        lengths = np.array([len(t) + 1 for t in self.texts])
        self.text = np.searchsorted(np.cumsum(lengths), begins, "right")
        place = np.arange(len(begins))
        piece = np.searchsorted(np.flatnonzero(raw == 10), begins)
        self.left = np.searchsorted(piece, piece, "right") - place
        ends = np.searchsorted(self.text, np.arange(len(self.texts)), "right")
        self.starts = place < (ends - np.array(self.over))[self.text]
        return self

    def keys(self, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each n the places where n-grams start and the n-grams' keys, of language, length and words."""
        words = word_hashes(self.vocabulary)[self.words]
        known = {lang: xxhash.xxh64_intdigest(b"\n" + lang.encode("utf-8", "surrogatepass")) for lang in set(self.langs)}
        key = np.array([known[lang] for lang in self.langs], np.uint64)[self.text]
        for n in range(1, max_n + 1):
            key = (key[: max(0, len(words) - n + 1)] ^ words[n - 1 :]) * MULTIPLIER
            key ^= key >> np.uint64(29)
            at = np.flatnonzero(self.starts[: len(key)] & (self.left[: len(key)] >= n))
            yield n, at, key[at]

    def counts(self, max_n: int, wanted: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
        """lang, phrase and n, the count, of this run's distinct n-grams of wanted keys, and each language's words with phrase
        null. Equal n-grams are those of equal words: the first n - 1 words have a number by now, which is paired with the
        number of the last. An n-gram whose first words were not wanted is not either."""
        known = {lang: k for k, lang in enumerate(dict.fromkeys(self.langs))}
        langs = pa.array(known, pa.string())
        number = of = np.array([known[lang] for lang in self.langs])[self.text]
        yield pa.RecordBatch.from_pydict({"lang": langs, "phrase": pa.nulls(len(langs), pa.binary()), "n": np.bincount(of[self.starts], minlength=len(langs)).astype(np.int64)})
        for n, at, keys in self.keys(max_n):
            at = at[wanted(keys)]
            at = at[number[at] >= 0]
            pair = number[at] * len(self.vocabulary) + self.words[at + n - 1]
            order = np.argsort(pair)
            pair = pair[order]
            new = np.r_[True, pair[1:] != pair[:-1]][: len(pair)]
            number = np.full(len(of), -1)
            number[at[order]] = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            where = at[order[first]]
            spelled = pc.binary_join_element_wise(*[self.vocabulary.take(pa.array(self.words[where + k])) for k in range(n)], b" ")
            yield pa.RecordBatch.from_pydict({"lang": langs.take(pa.array(of[where])), "phrase": spelled, "n": np.diff(first, append=len(pair))})


def parts(text: bytes, max_n: int) -> Iterator[tuple[bytes, int]]:
    """A text as it is, or a long one's pieces, and how many words of each start no n-gram."""
    if len(text) < TEXT_BYTES:
        yield text.lower().translate(CUT), 0
        return
    for piece in pieces(text):
        for words, starts in piece_runs(piece, max_n):
            yield b" ".join(words), len(words) - starts


def runs(batches: Iterator[pa.RecordBatch], max_n: int) -> Iterator[Run]:
    run = Run()
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            for part, over in parts(text.as_py() or b"", max_n):
                run.add(lang, part, over)
                if run.size >= RUN_WORDS:
                    yield run.cut()
                    run = Run()
    if run.texts:
        yield run.cut()


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def frequent_keys(docs: DataFrame, max_n: int = MAX_N, least: int = MIN_COUNT, size: int = FILTER_BITS) -> hashcounts.Bits:
    """The bits of all keys of n-grams that occur least times or more, counted over all 1..max_n-grams of all texts."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for run in runs(batches, max_n):
            for _, _, keys in run.keys(max_n):
                yield keys

    bits = hashcounts.shard_bits(docs)
    table = common.store(hashcounts.counted(texts(docs), explode, least, bits), "ngram-keys")
    out = hashcounts.bits_of(table, size, bits, PROBES)
    common.discard(table)
    return out


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, least: int = MIN_COUNT, size: int = FILTER_BITS) -> DataFrame:
    """lang, phrase and f of every n-gram that occurs least times or more, and with phrase null the words of a language."""
    wanted = docs.sparkSession.sparkContext.broadcast(frequent_keys(docs, max_n, least, size))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, max_n):
            yield from run.counts(max_n, wanted.value.has)

    every = texts(docs).mapInArrow(explode, "lang string, phrase binary, n long").groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("f"))
    return every.filter((F.col("f") >= least) | F.col("phrase").isNull())


def wide(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def scored(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """candidates with l, r and score of the lowest cut, the first of equal ones."""
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k")).withColumn("first", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice(words, F.col("k") + 1, F.size(words) - F.col("k")), " "))
    part = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    joined = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr(f"cast(a as decimal(20,0)) * cast({FACTOR} as decimal(7,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = joined.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def unexplained(candidates: DataFrame, share: int = EXPLAINED) -> DataFrame:
    """candidates without those that a one-word extension holds in share percent of their occurrences."""
    words, m = F.split("phrase", " "), F.size(F.split("phrase", " "))
    inner = F.array(F.array_join(F.slice(words, F.lit(1), m - 1), " "), F.array_join(F.slice(words, F.lit(2), m - 1), " "))
    longer = candidates.filter(m > 2).select(F.col("lang").alias("_lang"), F.explode(inner).alias("_phrase"), F.col("a").alias("_a")).groupBy("_lang", "_phrase").agg(F.max("_a").alias("_a"))
    held = (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")) & (wide(F.col("_a")) * 100 >= wide(F.col("a")) * share)
    return candidates.join(longer, held, "left_anti")


def ranked(rows: DataFrame, top: int = TOP) -> DataFrame:
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    some = sliced.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).filter(F.col("_at") <= top).drop("_at", "_slice")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def mine(docs: DataFrame, max_n: int = MAX_N, least: int = MIN_COUNT, share: int = EXPLAINED, top: int = TOP) -> DataFrame:
    """The first top phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    known = common.store(phrase_counts(docs, max_n, least), "phrase-counts")
    n = known.filter("phrase is null").select("lang", F.col("f").alias("n"))
    candidates = known.filter(F.contains("phrase", F.lit(" "))).withColumnRenamed("f", "a")
    found = ranked(scored(unexplained(candidates, share), known.filter("phrase is not null")), top)
    return found.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(common.table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, n, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) t(n))),
f AS (SELECT lang, n, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE n = 1 GROUP BY lang),
cand AS (SELECT lang, n AS m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE n > 1 AND f >= 30),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 : m], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scores AS (SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f))::BIGINT AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, a, array_to_string(w[i : i + s - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM cand))),
longest AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL),
kept AS (SELECT l.* FROM lowest l LEFT JOIN longest x ON x.lang = l.lang AND x.phrase = l.phrase WHERE x.longer IS NULL OR 100 * x.longer::HUGEINT < 80 * l.a::HUGEINT),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranks JOIN totals USING (lang) WHERE rank <= 2000
"""
QUERIES = {"op12_collocations": op12_collocations}
SQL = {"op12_collocations": OP12_SQL}

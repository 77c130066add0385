"""Exact counts of the 64-bit hashes of a whole corpus, and their lookup, by shuffles of packed arrays.

A row of the shuffle holds many hashes of one shard, ascending, as the byte planes of their differences, so that a hash
costs about as many bytes as it adds. Shards are ranges of hashes; there is one for a few megabytes of the input, however
large its splits are, so that the task of a shard needs the same memory for any input, and hot hashes, counted before they
travel, weigh no more than others.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import common

#: Hashes that a task counts together before it sends them on.
CHUNK = 1 << 21
#: Bytes of the input's files to a shard.
SHARD_BYTES = 4 << 20
PACKED = pa.schema([("shard", pa.int32()), ("batch", pa.int64()), ("hashes", pa.binary()), ("n", pa.binary())])
SCHEMA = "shard int, batch long, hashes binary, n binary"
#: The batch that stands for the counted table itself; real ones are not negative.
TABLE = -1
#: Multipliers that give a hash its further bits.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def planes(values: np.ndarray) -> bytes:
    """How many low byte planes are not all zeros, and these planes of integers."""
    n = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([n]) + np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def of_planes(raw: bytes) -> np.ndarray:
    out = np.zeros(((len(raw) - 1) // raw[0], 8), np.uint8)
    out[:, : raw[0]] = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], len(out)).T
    return out.view(np.uint64).ravel()


def pack(ascending: np.ndarray) -> bytes:
    """The first of ascending hashes as it is, the others as differences, which need fewer planes."""
    return ascending[:1].tobytes() + planes(np.diff(ascending)) if len(ascending) else b""


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(raw[:8], np.uint64), of_planes(raw[8:])]), dtype=np.uint64) if raw else np.zeros(0, np.uint64)


def shard_bits(source: DataFrame) -> int:
    """Bits of a shard's number: four shards or more to a split, and one to SHARD_BYTES of the files where splits are larger."""
    return max(4, min(22, (max(4 * common.pieces_of(source), common.bytes_of(source) // SHARD_BYTES) - 1).bit_length()))


def by_shard(ascending: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The shards that ascending hashes fall into, and where."""
    if not len(ascending):
        return
    number = (ascending >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(number)], strict=True):
        yield int(number[a]), slice(a, b)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the sums of their counts."""
    hashes, n = np.concatenate([h for h, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    return hashes[first], np.add.reduceat(n[order], first)


def summed(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """added() of any number of parts. They are added when as much as the sum has come since, a CHUNK at least: at most
    twice the sum and a CHUNK are held, and a hash is sorted about as often as the sum doubles."""
    held, size, kept = [], 0, 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size - kept > max(CHUNK, kept):
            held = [added(held)]
            size = kept = len(held[0][0])
    return added(held)


def counted(source: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], least: int, bits: int) -> DataFrame:
    """A row per shard: the hashes that hashes() gives least times or more over all of source, and their counts."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for part in hashes(batches):
            held.append(part)
            size += len(part)
            if size >= CHUNK:
                yield dealt(held)
                held, size = [], 0
        if size:
            yield dealt(held)

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        own, n = np.unique(np.concatenate(held), return_counts=True)
        return rows((s, own[at], n[at]) for s, at in by_shard(own, bits))

    def rows(found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        listed = [(s, TABLE, pack(h), planes(n)) for s, h, n in found]
        return pa.RecordBatch.from_pydict(dict(zip(PACKED.names, map(list, zip(*listed, strict=True)), strict=True)), PACKED)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: set[int] = set()

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                of.update(batch["shard"].to_pylist())
                for k in range(batch.num_rows):
                    yield unpack(batch["hashes"][k].as_py()), of_planes(batch["n"][k].as_py())

        every = parts()
        first = next(every, None)
        if first:
            h, n = summed(itertools.chain([first], every))
            [shard] = of
            often = n >= least
            if often.any():
                yield rows(iter([(shard, h[often], n[often])]))

    # a task has one shard, neither several of one hash nor joined ones: its rows need no sort
    return source.mapInArrow(deal, SCHEMA).repartitionById(1 << bits, "shard").mapInArrow(add, SCHEMA)


def probed(hashes: np.ndarray, size: int, bits: int, k: int) -> np.ndarray:
    """The k-th bit of hashes among 2 ** size, in the part of their shard."""
    width = np.uint64(size - bits)
    mixed = hashes << np.uint64(bits) if k == 0 else hashes * ODD[k - 1]
    return (hashes >> np.uint64(64 - bits) << width) | (mixed >> (np.uint64(64) - width))


class Bits:
    """A table of 2 ** size bits with probes bits for every hash of a counted table; others may have theirs by chance."""

    def __init__(self, table: np.ndarray, size: int, bits: int, probes: int) -> None:
        self.table, self.size, self.bits, self.probes = table, size, bits, probes

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for k in range(self.probes):
            # the later bits only of those that have the first
            own = np.flatnonzero(out)
            at = probed(hashes[own], self.size, self.bits, k)
            out[own] = (self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def bits_of(table: DataFrame, size: int, bits: int, probes: int = 1) -> Bits:
    """The bits of a counted table. A shard's hashes fall into its own part of the bits, which it sends to the driver
    as bytes; together they are of the same size for any corpus. More probes than one leave less to chance, as long as
    there are several bits for a hash."""
    size = max(size, bits + 3)
    width = size - bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, h in zip(batch["shard"].to_pylist(), batch["hashes"].to_pylist(), strict=True):
                own, h = np.zeros(1 << width, bool), unpack(h)
                for k in range(probes):
                    own[(probed(h, size, bits, k) & np.uint64((1 << width) - 1)).astype(np.int64)] = True
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "own": [np.packbits(own, bitorder="little").tobytes()]})

    out = np.zeros(1 << (size - 3), np.uint8)
    got = table.select("shard", "hashes").mapInArrow(run, "shard int, own binary").toArrow()
    for shard, own in zip(got["shard"].to_pylist(), got["own"].to_pylist(), strict=True):
        out[shard << (width - 3) : (shard + 1) << (width - 3)] |= np.frombuffer(own, np.uint8)
    return Bits(out, size, bits, probes)


def most_frequent(table: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows hashes with the highest counts, ascending, and those counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, n in zip(batch["hashes"].to_pylist(), batch["n"].to_pylist(), strict=True):
                h, n = unpack(h), of_planes(n)
                top = np.argsort(n, kind="stable")[::-1][:rows]
                yield pa.RecordBatch.from_pydict({"hash": h[top].view(np.int64), "n": n[top].view(np.int64)})

    got = table.select("hashes", "n").mapInArrow(run, "hash long, n long").orderBy(F.col("n").desc(), "hash").limit(rows).toArrow()
    h, n = got["hash"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def looked_up(queries: DataFrame, table: DataFrame, bits: int) -> DataFrame:
    """queries: batch, hashes (packed, ascending). Gives batch, shard and n, the counts of the batch's hashes of that
    shard in their order; 0 for hashes that are not in the table."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw in zip(batch["batch"].to_pylist(), batch["hashes"].to_pylist(), strict=True):
                x = unpack(raw)
                listed = [(s, number, pack(x[at]), None) for s, at in by_shard(x, bits)]
                if listed:
                    yield pa.RecordBatch.from_pydict(dict(zip(PACKED.names, map(list, zip(*listed, strict=True)), strict=True)), PACKED)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, known, counts = None, None, None
        for batch in batches:
            for shard, number, raw, n in zip(*(batch[c].to_pylist() for c in PACKED.names), strict=True):
                if number == TABLE:
                    of, known, counts = shard, unpack(raw), of_planes(n)
                    continue
                x = unpack(raw)
                found = np.zeros(len(x), np.uint64)
                if of == shard:
                    place = np.searchsorted(known, x).clip(max=len(known) - 1)
                    found = np.where(known[place] == x, counts[place], np.uint64(0))
                yield pa.RecordBatch.from_pydict({"batch": pa.array([number], pa.int64()), "shard": pa.array([shard], pa.int32()), "n": [planes(found)]})

    both = table.select(*PACKED.names).unionByName(queries.select("batch", "hashes").mapInArrow(deal, SCHEMA))
    return both.repartitionById(1 << bits, "shard").sortWithinPartitions("shard", "batch").mapInArrow(answer, "batch long, shard int, n binary")

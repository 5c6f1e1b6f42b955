"""How rare a token is in the whole corpus, as bitmaps that tasks can hold.

Every token occurrence of the corpus is counted, exactly but for its 40-bit
key.  What the tasks get back is a stack of bitmaps, one for each threshold on
the count, each with sixteen slots for every token at or over the threshold and
2 ** MOST_BITS slots at most, so that they can be broadcast.  Tokens that share a
slot may look more frequent than they are, never less: an order by (level, hash)
is the same for all sets, which is all that a prefix filter needs for exact
results, and a token said to occur once does occur once.  Where a corpus has
more tokens at a threshold than a bitmap has slots, that level tells little; the
higher ones, which fewer tokens reach, still order the frequent tokens last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tidy

KEY_BITS = 40
FLUSH = 1 << 21
#: The largest bitmap: 16 MB.
MOST_BITS = 27
#: The key ranges that are counted by themselves: 2 ** RANGE_BITS at most.
RANGE_BITS = 20
_SHIFT = np.uint64(64 - KEY_BITS)

#: (tokens, whether they come from a copy of a record that is counted elsewhere).
Tokens = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, bool]]]


@dataclass(frozen=True)
class Levels:
    """Token counts at or over ``thresholds[i]`` set a bit of the bitmap ``i``.

    The first threshold is on all occurrences, the others leave out those in copies, so that a text doesn't look frequent for its copies.
    """

    thresholds: tuple[int, ...]


class Maps:
    """The bitmaps of some levels; bitmap ``i`` has ``2 ** bits[i]`` slots."""

    def __init__(self, bits: list[int]) -> None:
        self.bits = bits
        self.held = [np.zeros(1 << (b - 3), np.uint8) for b in bits]

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """The number of bitmaps that hold each token: 0 for those that occur once."""
        level, top = np.zeros(len(tokens), np.uint8), (tokens >> np.uint64(32)).astype(np.uint32)
        for bits, held in zip(self.bits, self.held, strict=True):
            slot = top >> np.uint32(32 - bits)
            level += (held[slot >> np.uint32(3)] >> (slot.astype(np.uint8) & np.uint8(7))) & np.uint8(1)
        return level


def bitmap_bits(n: int, least: int = 13, most: int = MOST_BITS) -> int:
    """Slots, as a power of two, for ``n`` keys: sixteen to thirty-two for each, within bounds."""
    return max(least, min(most, n.bit_length() + 4))


def _packed(sorted_keys: np.ndarray) -> bytes:
    """Ascending integers as differences, byte plane by byte plane."""
    steps = np.diff(sorted_keys, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _counted(tokens: Tokens, range_bits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(held: list[np.ndarray], copy: bool) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held) >> _SHIFT, return_counts=True)
        which = (keys >> np.uint64(KEY_BITS - range_bits)).astype(np.int64)
        at = np.flatnonzero(np.diff(which, prepend=-1))
        ends = np.append(at[1:], len(keys))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(which[at], pa.int32()),
                pa.array([_packed(keys[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary()),
                pa.array([zstandard.compress(counts[a:b].astype("<u4").tobytes(), 1) for a, b in zip(at, ends, strict=True)], pa.binary()),
                pa.array([copy] * len(at)),
            ],
            names=["range", "keys", "counts", "copy"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[np.ndarray]] = {False: [], True: []}
        n = {False: 0, True: 0}
        for batch in batches:
            for values, copy in tokens(batch):
                held[copy].append(values)
                n[copy] += len(values)
                if n[copy] >= FLUSH:
                    yield flush(held[copy], copy)
                    held[copy], n[copy] = [], 0
        for copy in (False, True):
            if n[copy]:
                yield flush(held[copy], copy)

    return run


def count_levels(df: DataFrame, tokens: Tokens, levels: Levels) -> Maps:
    """The bitmaps of ``levels`` over all tokens that ``tokens`` finds in ``df``.

    Tasks add up the counts of what they read and send sorted, difference-coded
    keys by key range, about three bytes a distinct token; a hot token is one
    entry per task.  Each range counts its keys; when the number of keys at each
    threshold is known, and so the size of each bitmap, it gives its piece of them.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    range_bits = min(RANGE_BITS, max(6, (2 * partitions - 1).bit_length()))
    thresholds = levels.thresholds

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([_unpacked(x) for x in group["keys"]])
        counts = np.concatenate([np.frombuffer(zstandard.decompress(x), "<u4") for x in group["counts"]])
        own = np.where(np.repeat(group["copy"].to_numpy(), [len(zstandard.decompress(x)) // 4 for x in group["counts"]]), 0, counts)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[0]))
        keys, counts, own = keys[first], np.add.reduceat(counts[order].astype(np.int64), first), np.add.reduceat(own[order].astype(np.int64), first)
        level = np.sum([(own if i else counts) >= least for i, least in enumerate(thresholds)], axis=0, dtype=np.uint8)
        keys, level = keys[level > 0], level[level > 0]
        return pd.DataFrame({"range": [key[0]], "keys": [_packed(keys)], "levels": [zstandard.compress(level.tobytes(), 1)], "at": [[int((level > i).sum()) for i in range(len(thresholds))]]})

    counted = df.mapInArrow(tidy(_counted(tokens, range_bits)), "range int, keys binary, counts binary, copy boolean")
    merged = table(counted.groupBy("range").applyInPandas(merge, "range int, keys binary, levels binary, at array<long>"))
    sizes = merged.select(F.posexplode("at").alias("i", "k")).groupBy("i").agg(F.sum("k").alias("k")).collect()
    reached = {r["i"]: r["k"] for r in sizes}
    maps = Maps([bitmap_bits(reached.get(i, 0), range_bits + 3) for i in range(len(thresholds))])
    bits_of = maps.bits

    def piece(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for which, keys, level in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys, level = _unpacked(keys), np.frombuffer(zstandard.decompress(level), np.uint8)
                parts = []
                for i, bits in enumerate(bits_of):
                    flags = np.zeros(1 << (bits - range_bits), bool)
                    flags[(keys[level > i] >> np.uint64(KEY_BITS - bits)).astype(np.int64) - (which << (bits - range_bits))] = True
                    parts.append(np.packbits(flags, bitorder="little").tobytes())
                out.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["range", "bits"])

    for row in merged.select("range", "keys", "levels").mapInArrow(piece, "range int, bits binary").collect():
        at = 0
        for m, bits in zip(maps.held, maps.bits, strict=True):
            size = 1 << (bits - range_bits - 3)
            m[row["range"] * size : (row["range"] + 1) * size] = np.frombuffer(row["bits"], np.uint8, size, at)
            at += size
    return maps

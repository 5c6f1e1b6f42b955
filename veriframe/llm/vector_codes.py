"""Operator 12: vector code compression by product codebooks over Hilbert-sorted flat blocks.

A task cuts its vectors into groups of some 2**21 components.  For each part position
of a group the parts are sorted along a Hilbert curve and cut into flat blocks of 32, each
with the least and greatest component (its box) and the sums of its parts.  The
groups are written once; all rounds read them, and no vector is shuffled.

In a round the box distances tell which codebook entries can be nearest to any
part of a block: those that come as near to the box as the entry that is nearest
at worst.  A block with one entry on its shortlist goes to it by its sums alone;
other blocks meet the entries of their shortlist in a small exact integer kernel.
Tasks add up sums and counts by entry, Spark adds up the tasks, and only the
codebooks, of a fixed size, reach the driver and the next round.

Defined results: rows whose vector is null or holds a null or a non-finite
component go; vectors shorter than the longest, or whose length isn't a multiple
of the parts, are filled up with zeros; a component beyond 2**18 counts as
2**18, which keeps all distances exact in 64 bits; a null vec_id keeps its
row and takes no part in the first codebooks, and of a repeated vec_id the least vector
does; with fewer vec_ids than entries the codebooks are shorter, and without any
one there is one entry of zeros; repeated rows come back as often as they
come; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK_ROWS = 32
#: Components of a group of vectors: 8 MB, and the more vectors, the smaller the boxes.
GROUP_COMPONENTS = 1 << 21
#: Scaled components beyond this are taken as this.
LARGEST = 1 << 26


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Where integer points lie along a Hilbert curve through the box that holds them; dimensions beyond 62 take no part."""
    points = points[:, :62]
    n, dims = points.shape
    bits = max(1, min(10, 62 // dims))
    low = points.min(axis=0)
    width = (points.max(axis=0) - low).astype(np.float64) + 1
    x = np.minimum((points - low) / width * (1 << bits), (1 << bits) - 1).astype(np.int64).T.copy()
    for b in range(bits - 1, 0, -1):
        low_bits = (1 << b) - 1
        for i in range(dims):
            turn = (x[i] >> b) & 1 == 1
            swap = np.where(turn, 0, (x[0] ^ x[i]) & low_bits)
            x[0] ^= np.where(turn, low_bits, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turned = np.zeros(n, np.int64)
    for b in range(bits - 1, 0, -1):
        turned ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turned
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@dataclass
class Blocks:
    """The parts at one position of a group, in Hilbert order, and the boxes and sums of their blocks."""

    order: np.ndarray
    points: np.ndarray
    starts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, parts: np.ndarray) -> Blocks:
        order = np.argsort(hilbert_keys(parts), kind="stable").astype(np.int32)
        points = parts[order]
        starts = np.arange(0, len(points), BLOCK_ROWS)
        return cls(order, points, starts, np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts), np.add.reduceat(points, starts, dtype=np.int64))

    def ends(self) -> np.ndarray:
        return np.append(self.starts[1:], len(self.points))


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(block, entry): whether the entry can be nearest to a point of the block's box, ties included."""
    under, over = low[:, None, :] - entries[None], entries[None] - high[:, None, :]
    least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(axis=2)
    most = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(axis=2)
    return least <= most.min(axis=1, keepdims=True)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest of ``entries``, the first of equal ones."""
    distance = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(points)), best]


def block_sums(blocks: Blocks, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the parts of each entry."""
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    ends = blocks.ends()
    able = shortlists(blocks.low, blocks.high, entries)
    alone = able.sum(axis=1) == 1
    one = able[alone].argmax(axis=1)
    np.add.at(sums, one, blocks.sums[alone])
    np.add.at(counts, one, (ends - blocks.starts)[alone])
    for k in np.flatnonzero(~alone).tolist():
        some = np.flatnonzero(able[k])
        points = blocks.points[blocks.starts[k] : ends[k]]
        best = some[nearest(points, entries[some])[0]]
        np.add.at(sums, best, points)
        counts += np.bincount(best, minlength=len(counts))
    return sums, counts


def block_codes(blocks: Blocks, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, squared distance) of each part, in the order of the group's rows."""
    code, error = np.zeros(len(blocks.points), np.uint8), np.zeros(len(blocks.points), np.int64)
    ends = blocks.ends()
    able = shortlists(blocks.low, blocks.high, entries)
    for k in range(len(ends)):
        some = np.flatnonzero(able[k])
        at = blocks.order[blocks.starts[k] : ends[k]]
        best, error[at] = nearest(blocks.points[blocks.starts[k] : ends[k]], entries[some])
        code[at] = some[best]
    return code, error


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of scaled, floored components, filled up to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    rows = np.repeat(np.arange(len(column)), size)
    with np.errstate(over="ignore"):
        out[rows, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).astype(np.int64)
    return out


def _groups(width: int, parts: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["ids", "labels", "orders", "points", "low", "high", "sums"]
    most = max(1024, GROUP_COMPONENTS // width)

    def group(rows: pa.Table) -> pa.RecordBatch:
        matrix = _matrix(rows.column(1), width)
        held = [Blocks.of(np.ascontiguousarray(x)) for x in np.split(matrix, parts, axis=1)]
        whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column(c).combine_chunks())
        flat = lambda name, kind: pa.array([np.stack([getattr(b, name) for b in held]).astype(kind).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([whole(0), whole(2), flat("order", "<i4"), flat("points", "<i4"), flat("low", "<i4"), flat("high", "<i4"), flat("sums", "<i8")], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= most:
                rows = pa.Table.from_batches(held)
                while len(rows) >= most:
                    yield group(rows.slice(0, most))
                    rows = rows.slice(most)
                held, n = rows.to_batches(), len(rows)
        if n:
            yield group(pa.Table.from_batches(held))

    return run


def _read(batch: pa.RecordBatch, i: int, parts: int) -> list[Blocks]:
    """The blocks of each position of the ``i``-th group of a batch."""
    n = len(batch.column(0)[i])
    starts = np.arange(0, n, BLOCK_ROWS)
    order, points, low, high, sums = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in ((2, "<i4"), (3, "<i4"), (4, "<i4"), (5, "<i4"), (6, "<i8")))
    at = lambda x, k: x.reshape(parts, k, -1).astype(np.int64)
    columns = zip(order.reshape(parts, n), at(points, n), at(low, len(starts)), at(high, len(starts)), at(sums, len(starts)), strict=True)
    return [Blocks(o, p, starts, a, b, s) for o, p, a, b, s in columns]


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def first_vectors(kept: DataFrame, n: int) -> list:
    """The vectors of the ``n`` smallest ids, ascending; of a repeated id the least vector."""
    found: dict[int, list] = {}
    while len(found) < n:
        more = kept.filter(F.col("id").isNotNull() if not found else F.col("id") > max(found)).orderBy("id", "vector").limit(n - len(found)).collect()
        if not more:
            break
        for row in more:
            found.setdefault(row["id"], row["vector"])
    return list(found.values())


def compressed(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): vec_id, label, code and error of every kept vector, written; codebooks has (part, entry, position).

    ``entries`` is 256 at most, since codes have a byte for each part.
    """
    spark = vectors.sparkSession
    ship(spark)
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    kept = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label")).filter(finite(F.col("vector")))
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 1
    width = -(-max(longest, 1) // parts) * parts
    kind = kept.schema["label"].dataType.simpleString()
    groups = table(kept.select("id", "vector", "label").mapInArrow(_groups(width, parts), f"ids array<long>, labels array<{kind}>, orders binary, points binary, low binary, high binary, sums binary"))
    first = first_vectors(kept, entries) or [[]]
    matrix = _matrix(pa.array(first, pa.list_(pa.float64())), width)
    codebooks = np.stack(np.split(matrix, parts, axis=1))
    for _ in range(rounds):
        codebooks = _moved(groups, codebooks)
    held = spark.sparkContext.broadcast(codebooks)

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                found = [block_codes(b, e) for b, e in zip(_read(batch, i, parts), held.value, strict=True)]
                text = np.stack([c for c, _ in found], axis=1).tobytes().hex()
                codes = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(codes, pa.string()), pa.array(np.sum([e for _, e in found], axis=0))], names=["vec_id", "label", "code", "error"])

    return table(groups.mapInArrow(coded, f"vec_id long, label {kind}, code string, error long")), codebooks


def _moved(groups: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry at the floored mean of its parts, or where it was without any."""
    parts, n, dims = codebooks.shape
    held = groups.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, n, dims), np.int64), np.zeros((parts, n), np.int64)
        for batch in batches:
            for i in range(len(batch)):
                for p, blocks in enumerate(_read(batch, i, parts)):
                    s, c = block_sums(blocks, held.value[p])
                    sums[p] += s
                    counts[p] += c
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), *(pa.array(sums[p, e, d]) for d in range(dims))],
            names=["part", "entry", "k", *(f"s{d}" for d in range(dims))],
        )

    schema = "part int, entry int, k long, " + ", ".join(f"s{d} long" for d in range(dims))
    added = groups.mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("k").alias("k"), *(F.sum(f"s{d}").alias(f"s{d}") for d in range(dims)))
    out = codebooks.copy()
    for row in added.collect():
        out[row["part"], row["entry"]] = [row[f"s{d}"] // row["k"] for d in range(dims)]
    return out


def codebooks_sha256(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the sum of the errors of the rows of equal labels, nulls together."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "its")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("its"))).drop("its")


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row of vec_id, embedding and label."""
    coded, codebooks = compressed(vectors)
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(codebooks)).alias("codebooks_sha256"))

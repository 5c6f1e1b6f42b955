"""Operator 3: benchmark decontamination by size-partitioned MinHash containment search.

Documents are partitioned by the size of their shingle set, in powers of two.
In the partition of sizes up to 2**c, one-permutation MinHash with 4 * 2**c bins
keeps the least hash of each bin, so a short item inside a long document still
has most of its own bin minima among the document's, however long that is.
An item's sketch is made once for each partition.  Documents that share a
minimum with an item are candidates; a bitmap over the items' shingles, of 32 MB
at most, leaves out all others before the shuffle.  Each candidate is verified
by exact containment of 5-word shingles.  Items with fewer than 16 shingles use
all their shingles as sketch, which makes their search exact; for longer ones
the chance to miss a contained item is below 1e-9.

Defined results: texts are compared by words, A-Z lowered; items or documents
without words match nothing; an item of fewer than five words matches only a
document of the same words; very long texts are taken whole; a null doc_id or
item_id keeps its rows; repeated rows give one row per (doc_id, text, item_id);
other columns, whatever their names, are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, setjoin
from .common import fresh, ship, table, tidy

CONTAINMENT = 0.8
SMALL_ITEM = 16
SIZE_CLASSES = 40
BINS_BITS = 2


def _first_in_bin(hashes: np.ndarray, rows: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the hashes, ascending in each row, is the least of its bin; the bin is the top ``bits`` of a hash."""
    bins = hashes >> (np.uint64(64) - bits)
    first = np.ones(len(hashes), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (rows[1:] != rows[:-1])
    return first


def _size_class(n: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def _items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, n_item, grams, and the sketches as size_class, key."""
    for batch in batches:
        for first, values, bounds in kernel.shingles(batch.column(1)):
            for i in range(len(bounds) - 1):
                own = values[bounds[i] : bounds[i + 1]]
                if not len(own):
                    continue
                classes, keys = [], []
                for c in range(SIZE_CLASSES):
                    small = len(own) < SMALL_ITEM
                    some = own if small else own[_first_in_bin(own, np.zeros(len(own)), np.full(len(own), c + BINS_BITS, np.uint64))]
                    classes.append(np.full(len(some), c, np.int32))
                    keys.append(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first + i, 1),
                        pa.array([len(own)], pa.int64()),
                        pa.array([own.view(np.int64).tolist()], pa.list_(pa.int64())),
                        pa.array([np.concatenate(classes).tolist()], pa.list_(pa.int32())),
                        pa.array([np.concatenate(keys).view(np.int64).tolist()], pa.list_(pa.int64())),
                    ],
                    names=["item_id", "n_item", "grams", "size_class", "key"],
                )


def contained_items(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, tid, item_id, n_item, n_common, containment of each item that a document contains."""
    spark = docs.sparkSession
    ship(spark)
    items = table(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().mapInArrow(tidy(_items), "item_id long, n_item long, grams array<long>, size_class array<int>, key array<long>"))
    items = items.withColumn("item", F.xxhash64("item_id", "grams"))
    small = items.filter(F.col("n_item") < SMALL_ITEM)
    held = spark.sparkContext.broadcast(setjoin.id_filter(items.select(F.explode("grams").alias("sid")).distinct(), "sid"))
    tiny = spark.sparkContext.broadcast(setjoin.id_filter(small.select(F.explode("grams").alias("sid")).distinct(), "sid"))

    def among(filter_: setjoin.IdFilter | None, values: np.ndarray) -> np.ndarray:
        return filter_.of(values) if filter_ is not None else np.ones(len(values), bool)  # more shingles than a filter tells apart

    def hits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, values, bounds in kernel.shingles(batch.column(2)):
                n = np.diff(bounds)
                found = np.flatnonzero(among(held.value, values))
                if not len(found):
                    continue
                rows = np.searchsorted(bounds, found, side="right") - 1
                size = _size_class(n)
                # the least hash of a bin is the one whose predecessor lies in another bin or another row
                before = values[np.maximum(found - 1, 0)]
                shift = np.uint64(64) - (size[rows] + BINS_BITS).astype(np.uint64)
                sketched = (found == bounds[rows]) | ((values[found] >> shift) != (before >> shift)) | among(tiny.value, values[found])
                docs_hit, start = np.unique(rows, return_index=True)
                at = pa.array(np.append(start, len(rows)), pa.int32())
                which = pa.array(docs_hit + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(which),
                        batch.column(1).take(which),
                        pa.array(size[docs_hit], pa.int32()),
                        pa.ListArray.from_arrays(at, pa.array(values[found].view(np.int64))),
                        pa.ListArray.from_arrays(at, pa.array(sketched)),
                    ],
                    names=["doc_id", "tid", "size_class", "grams", "sketched"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), F.col("text").cast("string").alias("text"))
    found = table(texts.mapInArrow(tidy(hits), "doc_id long, tid long, size_class int, grams array<long>, sketched array<boolean>"))
    sketch = found.select("doc_id", "tid", "size_class", F.explode(F.arrays_zip("grams", "sketched")).alias("e")).filter("e.sketched").select("doc_id", "tid", "size_class", F.col("e.grams").alias("key"))
    keys = items.select("item", F.explode(F.arrays_zip("size_class", "key")).alias("e")).select("item", "e.size_class", "e.key")
    candidates = sketch.join(keys, ["size_class", "key"]).select("doc_id", "tid", "item").distinct()

    c, f = candidates.alias("c"), found.dropDuplicates(["doc_id", "tid"]).alias("f")
    both = c.join(f, (F.col("c.tid") == F.col("f.tid")) & F.col("c.doc_id").eqNullSafe(F.col("f.doc_id"))).select("c.doc_id", "c.tid", "c.item", F.col("f.grams").alias("theirs"))
    both = both.join(items.select("item", "item_id", "n_item", "grams"), "item")
    common = both.withColumn("n_common", F.size(F.array_intersect("grams", "theirs")).cast("long"))
    return common.filter(100 * F.col("n_common") >= round(100 * containment) * F.col("n_item")).select("doc_id", "tid", "item_id", "n_item", "n_common", (F.col("n_common") / F.col("n_item")).alias("containment"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` without those that contain an item; all columns and all other rows stay."""
    bad = contained_items(docs, benchmark, containment).select("doc_id", "tid").distinct().alias("b")
    name = fresh(docs, "tid")
    d = docs.withColumn(name, F.xxhash64("text")).alias("d")
    on = (F.col(f"d.{name}") == F.col("b.tid")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("b.doc_id"))
    return d.join(bad, on, "left_anti").select(*docs.columns)

"""Operator 11: near-duplicate groups by banded MinHash with sequential Bayesian verification.

A text's set has 384 minima in 48 bands of 8; sets that share a band are
candidates.  Pairs are compared by the first 64 positions of their sketches, then
by the next, up to 256: after each batch a pair goes whose posterior chance to
reach the similarity asked for, given the matches so far and an even prior, is
less than the miss probability.  What survives is verified on the full sets.  At
a Jaccard of 0.85 a pair shares no band with a chance of 2.4e-7, and is pruned
with one of about 1e-8; above it both fall steeply.

A bucket of one band may hold a large group of near copies, whose pairs are never
listed.  Each set first meets the most popular set of its buckets, and the most
popular one of that set's buckets: its centre.  Sets that link with it carry its
label.  For sets that are near their centre at all, the changes against it decide
all pairs of the group exactly (``setjoin.answered_pairs``).  What remains are
pairs of different labels in one bucket of which one set at least isn't near the
centre that most of the bucket has.

Defined results: a null or empty text, or one without words, has an empty set,
links with nothing and is kept; fewer than three words are one shingle; very long texts are
taken whole, a text at a time; repeated rows come back as often as they come;
other columns, whatever their names, are ignored; an empty table gives no rows.
A null doc_id keeps its row; its component is the least id that is not null, or
null; it is kept only where no id of its component is known.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, setjoin
from .common import ship, table

SHINGLE_WORDS, PERCENT = 3, 85
BANDS, BAND_ROWS = 48, 8
#: Sketch positions, one byte of a minimum each, and how many are compared at a time.
SKETCH, BATCH = 256, 64
#: The chance at which the verification may prune a pair that reaches the similarity.
MISS = 1e-8
#: A set is near a centre if they differ by a third of both sizes at most: a Jaccard of one half.
NEAR_BY, NEAR = (1, 3), 0.5
#: Shingles hashed at a time: they stay in the cache over all minima.
STRETCH = 1 << 15

_KEYS = kernel.mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=kernel.U) * kernel.U(0xD1342543DE82EF95))
_ODD = kernel.mix(_KEYS) | kernel.U(1)


def minima(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(order, row): the least hash of each row's values under each of the 384 orders; empty rows have the greatest."""
    n_rows = len(bounds) - 1
    out = np.full((len(_KEYS), n_rows), np.iinfo(np.uint64).max, np.uint64)
    first = 0
    while first < n_rows:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + STRETCH, side="right")) - 1)
        rows = first + np.flatnonzero(np.diff(bounds[first : last + 1]))
        for at in range(bounds[first], bounds[last], STRETCH):  # a long text's values come in stretches
            piece = values[at : min(at + STRETCH, bounds[last])]
            starts = np.maximum(bounds[rows] - at, 0)
            for j, (key, odd) in enumerate(zip(_KEYS, _ODD, strict=True)):
                out[j, rows] = np.minimum(out[j, rows], np.minimum.reduceat((piece ^ key) * odd, starts))
        first = last
    return out


def band_hashes(least: np.ndarray) -> np.ndarray:
    """(row, band) of ``minima``, each hash with its band's number."""
    out = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], least.shape[1], axis=1)
    for i in range(BAND_ROWS):
        out = kernel.mix(out * kernel.U(0x9E3779B97F4A7C15) + least[i::BAND_ROWS])
    return np.ascontiguousarray(out.T).view(np.int64)


def _records(batch: pa.RecordBatch) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    for first, values, bounds in kernel.shingles(batch.column(1), SHINGLE_WORDS):
        yield [batch.column(0).slice(first, len(bounds) - 1)], values, bounds


def signed(texts: DataFrame) -> DataFrame:
    """(doc_id, n, sid, bands, sketch) of (doc_id, text); sets without shingles have no bands."""
    names = ["doc_id", "n", "sid", "bands", "sketch"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, values, bounds in _records(batch):
                n = np.diff(bounds)
                ids = kernel.set_ids(values, bounds)
                # equal sets of a run are hashed once
                _, first, back = np.unique(ids, return_index=True, return_inverse=True)
                picked = np.concatenate([np.zeros(0, np.uint64), *(values[bounds[i] : bounds[i + 1]] for i in first.tolist())])
                least = minima(picked, np.concatenate([[0], np.cumsum(n[first])]))[:, back]
                full = n > 0
                at = np.concatenate([[0], np.cumsum(full * BANDS)])
                sketch = np.ascontiguousarray((least[:SKETCH] >> np.uint64(24)).astype(np.uint8).T)
                yield pa.RecordBatch.from_arrays(
                    [*key, pa.array(n, pa.int32()), pa.array(ids), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(band_hashes(least[:, full]).ravel())), pa.array([x.tobytes() for x in sketch], pa.binary())],
                    names=names,
                )

    return texts.mapInArrow(run, "doc_id long, n int, sid long, bands array<long>, sketch binary")


@functools.cache
def least_matches(n: int, similarity: float, miss: float = MISS) -> int:
    """The fewest matches out of ``n`` positions at which a pair may still reach ``similarity``.

    With an even prior the similarity is beta-distributed after the matches, and the
    chance that it reaches the bound is that of so many hits at most in n + 1 throws.
    """
    chance = 0.0
    for m in range(n + 1):
        chance += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        if chance >= miss:
            return m
    return n


def survivors(left: np.ndarray, right: np.ndarray, similarity: float, miss: float = MISS) -> tuple[np.ndarray, list[int]]:
    """(rows, pairs compared in each batch): the rows of two sketch matrices that no batch of positions has pruned.

    A byte matches by chance now and then, which only keeps a pair longer.
    """
    alive, matches, compared = np.arange(len(left)), np.zeros(len(left), np.int64), []
    for at in range(0, SKETCH, BATCH):
        compared.append(len(alive))
        matches[alive] += np.count_nonzero(left[alive, at : at + BATCH] == right[alive, at : at + BATCH], axis=1)
        alive = alive[matches[alive] >= least_matches(at + BATCH, similarity, miss)]
    return alive, compared


def verified(pairs: DataFrame, sketches: DataFrame, similarity: float, miss: float = MISS) -> DataFrame:
    """The pairs (a, b) that the sequential verification lets through."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in (2, 3))
            yield batch.select([0, 1]).take(pa.array(survivors(left, right, similarity, miss)[0]))

    both = pairs.join(sketches.toDF("a", "sa"), "a").join(sketches.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(run, "a long, b long")


def centres(entries: DataFrame) -> DataFrame:
    """(sid, direct, centre): the most popular set of most of a set's buckets, and where the way from set to set ends after three such steps.

    A set is the more popular the more others share its buckets, so the text that a
    group's copies were made from leads; a step never leads to a less popular set.
    """
    size = entries.groupBy("bucket").agg(F.count("*").alias("m"))
    popular = entries.join(size, "bucket").groupBy("sid").agg(F.sum("m").alias("fame"))
    rank = F.struct("fame", "sid")
    lead = entries.join(popular, "sid").groupBy("bucket").agg(F.max(rank).alias("lead"))
    met = entries.join(lead, "bucket").groupBy("sid", F.col("lead.sid").alias("led"), F.col("lead.fame").alias("fame")).agg(F.count("*").alias("times"))
    step = table(met.groupBy("sid").agg(F.max_by("led", F.struct("times", "fame", "led")).alias("direct")))
    out = step.withColumn("centre", F.col("direct"))
    for _ in range(2):
        out = out.join(step.toDF("centre", "further"), "centre", "left").select("sid", "direct", F.coalesce("further", "centre").alias("centre"))
    return out


def odd_pairs(labelled: DataFrame) -> DataFrame:
    """Pairs (a, b) of one bucket with different labels and different centres, for a common centre answers them.

    Only entries that have another centre than most of their bucket are joined
    with the bucket, so a group's own pairs are never listed.
    """
    main = labelled.groupBy("bucket", "centre").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max_by("centre", F.struct("k", "centre")).alias("main"))
    marked = labelled.join(main, "bucket").withColumn("odd", F.col("centre") != F.col("main")).drop("main")
    x, y = marked.filter("odd").alias("x"), marked.alias("y")
    size = (100 * F.col("x.n") >= PERCENT * F.col("y.n")) & (100 * F.col("y.n") >= PERCENT * F.col("x.n"))
    on = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") != F.col("y.label")) & (F.col("x.centre") != F.col("y.centre")) & (~F.col("y.odd") | (F.col("x.sid") < F.col("y.sid"))) & size
    return x.join(y, on).select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct()


def near_duplicates(docs: DataFrame, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    records = table(signed(texts))
    sets = table(records.filter("n > 0").drop("doc_id").dropDuplicates(["sid"]))
    entries = sets.select("sid", "n", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1").select("bucket")
    entries = table(entries.join(shared, "bucket", "left_semi"))
    sketches = sets.select("sid", "sketch")

    centre = table(centres(entries))
    asked = centre.select("sid", F.explode(F.array_distinct(F.array("direct", "centre"))).alias("b")).filter("sid <> b").toDF("a", "b")
    alike = table(verified(asked, sketches, NEAR, miss))
    wanted = lambda pairs: table(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
    first = table(setjoin.compared(alike, setjoin.members(texts, _records, wanted(alike)), PERCENT, NEAR_BY))
    answers = first.filter("link").select("a", "b")
    label = setjoin.components(answers, rounds=6)

    # the further centre answers where the set is near it, else the direct one
    told = first.filter("near").select(F.col("a").alias("sid"), F.col("b"), F.col("na").alias("size"), "link", "change")
    met = centre.join(told, "sid", "left").groupBy("sid").agg(F.max_by(F.struct("b", "size", "link", "change"), F.when(F.col("b").isNotNull(), F.col("b") == F.col("centre"))).alias("met"))
    known = table(met.join(label, "sid", "left").select("sid", F.coalesce("label", "sid").alias("label"), F.coalesce("met.b", "sid").alias("centre"), F.col("met.size").alias("size"), "met.link", "met.change"))
    groups = known.filter("change is not null").select("sid", "centre", F.col("size").alias("n"), "label", "link", "change")
    labelled = entries.join(known.select("sid", "centre", "label"), "sid")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
    rest = table(odd_pairs(table(labelled.join(mixed, "bucket", "left_semi"))))
    left = table(verified(rest, sketches, PERCENT / 100, miss))
    links = answers.union(setjoin.linked(left, setjoin.members(texts, _records, wanted(left)), PERCENT)).union(setjoin.answered_pairs(groups, PERCENT))

    label = setjoin.components(links)
    whole = records.select("doc_id", "n", "sid").join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    least = whole.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    found = whole.join(least, "label", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

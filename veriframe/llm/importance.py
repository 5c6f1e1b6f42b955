"""Operator 13: target-distribution importance resampling.

Features are runs of 1 to ``grams`` consecutive words, each in the bucket of its
crc32.  Tasks count buckets as arrays, one for each run of texts, and Spark adds
them up for the corpus and for the target.  The gains of all buckets are one array
of a fixed length, by which tasks score whole texts; the score takes a key of the
doc_id as noise.  The scores are written once.  The cutoff comes from bisection:
each job counts exactly how many written scores are at or over 15 thresholds at a
time, which does the work of four halvings, until one score is left; the ties at
that score are cut by their doc_id in the same way.  Only the rows on this side
of the cutoff are range-partitioned, sorted and ranked.

Defined results: a null or empty text, or one without words, has no features,
weight 0 and is never drawn; very long texts are taken whole; a null doc_id has
the noise of an empty id and stands behind the others among ties; of rows with
equal scores and ids those read first are drawn first, so repeated rows get
different ranks; other columns, whatever their names, are ignored; an empty
target leaves every gain to the corpus' counts; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import fresh, ship, table

GRAMS, BUCKETS, SEED = 1, 10_000, 2024
LEAST_WORDS, PERCENT = 20, 10
#: Thresholds that a counting job looks at.
THRESHOLDS = 15
#: Ranked rows of a range partition, about.
RANKED_ROWS = 1 << 20
#: Spans of more bytes are hashed one by one.
SHORT = 64

#: ASCII letters in lower case, digits and the bytes beyond ASCII; all else is a space.
_FORM = np.full(256, 0x20, np.uint8)
_FORM[0x30:0x3A] = np.arange(0x30, 0x3A)
_FORM[0x61:0x7B] = _FORM[0x41:0x5B] = np.arange(0x61, 0x7B)
_FORM[0x80:] = np.arange(0x80, 0x100)

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def crc32_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of each byte span, all spans a byte at a time."""
    length = ends - starts
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(-length, kind="stable")
    size = length[order]
    n_long = int(np.count_nonzero(size > SHORT))
    for i in order[:n_long].tolist():
        out[i] = zlib.crc32(raw[starts[i] : ends[i]])
    order, size = order[n_long:], size[n_long:]
    at = starts[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
    for k, n in enumerate(live.tolist()):
        some = state[:n]
        state[:n] = _CRC[(some ^ raw[at[:n] + k]) & 0xFF] ^ (some >> 8)
    out[order] = ~state
    return out


def features(column: pa.Array, grams: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words of each row, bucket of each feature, its row) of runs of rows."""
    for first, raw, bounds in kernel.chunks(column):
        raw = _FORM[raw]
        starts, ends, rows = kernel.words(raw, bounds)
        n_words = np.bincount(rows, minlength=len(bounds) - 1)
        if grams > 1:  # words of a text with one space between them
            kept = raw != 0x20
            kept[ends[ends < len(raw)]] = True
            place = np.cumsum(kept) - 1
            starts, ends = place[starts], place[ends - 1] + 1
            raw = raw[kept]
        found, whose = [], []
        for k in range(min(grams, len(rows))):
            whole = rows[: len(rows) - k] == rows[k:]
            found.append(crc32_spans(raw, starts[: len(rows) - k][whole], ends[k:][whole]) % np.uint32(buckets))
            whose.append(rows[k:][whole])
        none = np.zeros(0, np.int64)
        yield first, n_words, np.concatenate([none, *found]).astype(np.int64), np.concatenate([none, *whose])


def bucket_counts(texts: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of the one column of ``texts`` in each bucket; a task sends one array, so what moves is bounded by tasks and buckets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found, _ in features(batch.column(0), grams, buckets):
                held += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at])], names=["bucket", "k"])

    out = np.zeros(buckets, np.int64)
    for row in texts.mapInArrow(run, "bucket long, k long").groupBy("bucket").agg(F.sum("k").alias("k")).collect():
        out[row["bucket"]] = row["k"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousands of nats by which the target prefers each bucket, floored, with one feature more for each bucket on both sides."""
    n = len(corpus)
    all_s, all_t = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A fixed Gumbel key of a doc_id, in thousandths."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document, written, with a number for each row."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = spark.sparkContext.broadcast(gains(bucket_counts(texts.select("text"), grams, buckets), bucket_counts(target.select(F.col("text").cast("string")), grams, buckets)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n_words, found, whose in features(batch.column(1), grams, buckets):
                n = len(n_words)
                k = np.bincount(whose, minlength=n)
                total = np.zeros(n, np.int64)
                np.add.at(total, whose, held.value[found])
                columns = [pa.array(x.astype(np.int64)) for x in (n_words, k, total // np.maximum(k, 1))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *columns], names=["doc_id", "n_words", "n_features", "weight"])

    weighed = texts.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    return table(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id()))


def least_bound(values: DataFrame, column: str, wanted: int) -> int | None:
    """The least x such that at least ``wanted`` of the values are x or less; None if there aren't as many.

    Each job counts the values up to 15 bounds at once and leaves a sixteenth of the range.
    """
    value = F.col(column)
    low, high, n = values.agg(F.min(value), F.max(value), F.count(value)).first()
    if n < wanted or not n:
        return None
    before = 0  # values under low
    while low < high:
        step = (high - low) // (THRESHOLDS + 1) + 1
        bounds = [x for x in (low + step * i - 1 for i in range(1, THRESHOLDS + 1)) if x < high]
        counts = values.filter(value.between(low, high)).agg(*(F.count_if(value <= x) for x in bounds)).first()
        for bound, count in zip(bounds, counts, strict=True):
            if before + count >= wanted:
                high = bound
                break
        under = [(bound, count) for bound, count in zip(bounds, counts, strict=True) if bound < high]
        if under:
            low, more = under[-1][0] + 1, under[-1][1]
            before += more
    return low


def drawn(scores: DataFrame, wanted: int, order: str = "score") -> Column:
    """Whether a row of ``scores`` is among the ``wanted`` highest; rows that equal the last of them in score and id may be too many."""
    if wanted < 1:
        return F.lit(False)
    down = scores.withColumn("down", -F.col(order))
    cut = least_bound(down, "down", wanted)
    over = scores.filter(F.col(order) > -cut).count()
    ties = scores.filter(F.col(order) == -cut)
    last = least_bound(ties, "doc_id", wanted - over)
    tied = F.col(order) == -cut
    return (F.col(order) > -cut) | (tied if last is None else tied & (F.col("doc_id") <= last))


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with their rank by score down, doc_id and row; only ranges of them meet in a task."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANKED_ROWS + 1)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    # the id of a row has its partition's number above 33 bits, in which the rows of the partition are counted
    placed = table(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    ends = placed.groupBy(part.alias("part")).agg(F.count("*").alias("k")).orderBy("part").collect()
    starts, at = [], 0
    for r in ends:
        starts.append((r["part"], at))
        at += r["k"]
    before = spark.createDataFrame(starts, "part long, before long")
    return placed.join(F.broadcast(before), part == F.col("part")).withColumn("rank", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).select(*rows.columns, "rank")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score of every document, and the rank of those that are drawn.

    Of the N documents with ``least_words`` or more, ``percent * N // 100`` are drawn.
    """
    scores = scored(docs, target, grams, buckets, seed)
    able = scores.filter(F.col("n_words") >= least_words)
    wanted = percent * able.count() // 100
    inside = (F.col("n_words") >= least_words) & drawn(able, wanted)
    some = ranked(scores.filter(inside), wanted).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scores.filter(~F.coalesce(inside, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return some.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def resampled_rows(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The drawn rows of ``docs`` with all columns, and their rank; doc_id must tell documents apart."""
    name = fresh(docs, "rank")
    chosen = resampled(docs, target, **options).filter("rank is not null").select(F.col("doc_id").alias("drawn_id"), F.col("rank").alias(name))
    return docs.join(chosen, docs["doc_id"].cast("long").eqNullSafe(F.col("drawn_id"))).select(docs["*"], name)

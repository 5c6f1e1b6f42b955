"""Operator 1: n-gram Jaccard join of documents, with set-relation skipping.

Index lists hold, for each prefix shingle, the sets with their sizes and the
shingle's position.  Each set first meets the one set that leads most of its
lists, its centre, and takes over that set's answers where the two link: they
then carry one label.  What is left are pairs of different labels.

Where both sets are near copies of one centre, their answer is derived from the
two answers that the centre has given: the changes against the centre tell how
far they are from each other, and an index of the changes finds the pairs
(``setjoin.answered_pairs``).  Other pairs come from the lists, whose blocks, by
size class, are passed over as length and position allow (``setjoin.block_pairs``),
and are verified on the sets.  No pair of different texts is left undecided, since
equally labelled sets are connected.

Defined results: a null or empty text, or one without words, has an empty set
and links with nothing; fewer than five words are one shingle; very long texts
are taken whole, a text at a time; repeated rows are given back as often as they
come; other columns, whatever their names, are ignored; an empty table gives no
rows.  A null doc_id keeps its row; its component is the least id that is not
null, or null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, setjoin
from .common import fresh, ship, table
from .rarity import Levels, count_levels

SHINGLE_WORDS = 5
LEVELS = Levels(thresholds=tuple(2**i for i in range(1, 17)))


def _records(batch: pa.RecordBatch) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    for first, values, bounds in kernel.shingles(batch.column(1), SHINGLE_WORDS):
        n = len(bounds) - 1
        yield [batch.column(0).slice(first, n), batch.column(2).slice(first, n)], values, bounds


def _copies(texts: DataFrame) -> DataFrame:
    """(sid): the keys of all but the first of equal texts."""
    keys = texts.select("doc_id", F.xxhash64("text").alias("tid"), F.col("key").alias("sid"))
    first = keys.groupBy("tid").agg(F.min(F.struct("doc_id", "sid")).alias("f"), F.count("*").alias("k")).filter("k > 1")
    return keys.join(first, "tid").filter(F.col("sid") != F.col("f.sid")).select("sid")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("key"))


def jaccard_components(docs: DataFrame, levels: Levels = LEVELS) -> DataFrame:
    """doc_id, key, n_shingles, set_id, component_id of every document; key is the xxhash64 of doc_id and text."""
    spark = docs.sparkSession
    ship(spark)
    texts = _keyed(docs)
    copies = spark.sparkContext.broadcast(setjoin.id_filter(table(_copies(texts)), "sid"))

    def tokens(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, bool]]:
        # beyond the bound of a filter copies are counted like other texts, which makes their shingles look more frequent
        copied = copies.value.of(batch.column(2).to_numpy()) if copies.value is not None else np.zeros(len(batch), bool)
        for first, values, bounds in kernel.shingles(batch.column(1), SHINGLE_WORDS):
            own = np.repeat(copied[first : first + len(bounds) - 1], np.diff(bounds))
            yield values[~own], False
            yield values[own], True

    maps = spark.sparkContext.broadcast(count_levels(texts, tokens, levels))
    records = table(setjoin.index(texts, _records, "doc_id long, key long", maps))

    sets = records.filter("size(tokens) > 0").dropDuplicates(["sid"]).drop("doc_id", "key").withColumn("k", F.size("tokens"))
    entries = table(setjoin.lists(sets))
    shared = entries.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1").select("token")
    entries = table(entries.join(shared, "token", "left_semi"))
    centre = table(setjoin.centres(entries))
    asked = centre.filter("sid <> centre").toDF("a", "b")
    sets_of = table(setjoin.members(texts, _records, table(asked.select(F.explode(F.array("a", "b")).alias("sid")).distinct())))
    first = table(setjoin.compared(asked, sets_of))
    answers = first.filter("link").select("a", "b")

    label = setjoin.components(answers, rounds=6)
    near = first.filter("near").select(F.col("a").alias("sid"), F.col("na").alias("size"), "link", "change")
    known = centre.join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid")).join(near, "sid", "left")
    known = table(known.withColumn("near", F.col("change").isNotNull() | (F.col("sid") == F.col("centre"))))
    groups = known.filter("change is not null").select("sid", "centre", F.col("size").alias("n"), "label", "link", "change")
    labelled = entries.join(known.select("sid", "centre", "label", "near"), "sid", "left").withColumns({"label": F.coalesce("label", "sid"), "centre": F.coalesce("centre", "sid"), "near": F.coalesce("near", F.lit(True))})
    mixed = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("token")
    labelled = table(labelled.join(mixed, "token", "left_semi"))
    answered = lambda x, y: (F.col(f"{x}.centre") == F.col(f"{y}.centre")) & F.col(f"{x}.near") & F.col(f"{y}.near")
    rest = table(setjoin.block_pairs(labelled, lambda x, y: (F.col(f"{x}.label") != F.col(f"{y}.label")) & ~answered(x, y)))
    wanted = table(rest.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
    links = answers.union(setjoin.linked(rest, table(setjoin.members(texts, _records, wanted)))).union(setjoin.answered_pairs(groups))

    label = setjoin.components(links)
    whole = records.select("doc_id", "key", "n", "sid").join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    least = whole.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    own = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return whole.join(least, "label", "left").select("doc_id", "key", F.col("n").cast("long").alias("n_shingles"), F.col("sid").alias("set_id"), own.alias("component_id"))


def distinct_documents(docs: DataFrame, levels: Levels = LEVELS) -> DataFrame:
    """The rows of ``docs``, with all columns, of one document of each component: that with the least (doc_id, key), a null doc_id last.

    Documents without words all stay; of repeated rows one stays.
    """
    found = jaccard_components(docs, levels)
    full = found.filter("n_shingles > 0").withColumn("component", F.coalesce("component_id", F.col("set_id")))
    first = full.groupBy("component", F.col("component_id").isNull().alias("unnamed")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("f")).select("f.key")
    name = fresh(docs, "key")
    kept = first.union(found.filter("n_shingles = 0").select("key")).distinct().toDF(name)
    keyed = docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return keyed.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)

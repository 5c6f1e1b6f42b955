"""Operator 10: a token store of separately compressed documents with one shared zstandard dictionary.

Layout below the store's folder, all Parquet, so that any store Spark writes to will do:

* ``dictionary``: one row (dict_sha256, content, width).  It is trained on the
  serialised ids of about ``sample_docs`` documents, those whose hash lies
  under a threshold that their number gives, and of each on SAMPLE_BYTES at
  most.  Where these are too few or too short to train on, their first
  DICTIONARY_BYTES serve as the dictionary as they are.
* ``data``: one row per block of documents in ascending doc_id order: shard,
  block, dict_sha256, first_id and last_id (the least and greatest doc_id that
  isn't null), doc_ids, n_tokens, offsets (one more than documents),
  shard_start (ids of the shard before the block) and frames.  Frame i is
  ``frames[offsets[i]:offsets[i + 1]]``, a zstandard frame of little-endian
  16-bit ids (32-bit where the vocabulary needs them) that decompresses alone,
  so a short document costs one block row and one frame: a row group holds a
  block or so, and its statistics of first_id and last_id let a reader pass over it
  (``read_documents``).

Defined results: a null or empty text has only the end id; equal rows are kept
each; rows with a null doc_id come first; ties are ordered by the hash of the text
and the text; very long texts are taken whole; special strings inside a text are
encoded as the library does by default; other columns, whatever their names, are
ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import functools
import hashlib
import json
import operator
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Accumulator, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pretoken
from .common import ship, tidy

SAMPLE_DOCS, SAMPLE_BYTES = 1000, 32 << 10
#: Bytes of text in a shard, about; of very large corpora more, so that there are MOST_SHARDS at most.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 1 << 17
DICTIONARY_BYTES = 64 << 10
BLOCK_DOCS, BLOCK_BYTES = 256, 1 << 20
CACHE_IDS = 8_000_000
WORDS_AT_ONCE = 4096
#: Ids that a reader asks for one by one.
MOST_PROBES = 64
_caches: dict[str, tuple] = {}


def _encoder(tokenizer_json: str) -> tuple:
    """(tokenizer, special strings, known words) of this worker; the words are kept from task to task."""
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _caches or _caches[key][2].n_flat > CACHE_IDS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the threads
        from tokenizers import Tokenizer

        _caches.clear()
        specials = [t["content"] for t in json.loads(tokenizer_json)["added_tokens"]]
        _caches[key] = Tokenizer.from_str(tokenizer_json), specials, pretoken.GrowingWords()
    return _caches[key]


def encoded(column: pa.Array, tokenizer_json: str, end_id: int) -> Iterator[np.ndarray]:
    """The ids of each text with ``end_id`` behind them; each distinct pre-token goes through the library once."""
    tokenizer, specials, words = _encoder(tokenizer_json)

    def encode(new: list[str]) -> list[list[int]]:
        return [x.ids for i in range(0, len(new), WORDS_AT_ONCE) for x in tokenizer.encode_batch_fast(new[i : i + WORDS_AT_ONCE], add_special_tokens=False)]

    end = np.array([end_id], np.int32)
    for first, ids, bounds in pretoken.encode_column(column, words, encode):
        some = column.slice(first, len(bounds) - 1)
        odd = {i for i, x in enumerate(some.to_pylist()) if x and any(s in x for s in specials)} if specials else set()
        for i in range(len(some)):
            own = np.array(tokenizer.encode(some[i].as_py(), add_special_tokens=False).ids, np.int32) if i in odd else ids[bounds[i] : bounds[i + 1]]
            yield np.concatenate([own, end])


def _train(spark: SparkSession, texts: DataFrame, n_docs: int, tokenizer_json: str, end_id: int, width: str, sample_docs: int) -> bytes:
    shared = spark.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(width).tobytes()[:SAMPLE_BYTES] for x in encoded(batch.column(0), shared.value, end_id)], pa.binary())], names=["ids"])

    share = min(1.0, sample_docs / max(n_docs, 1))
    # a doc_id that many rows share is told apart by the text, and of equal rows one is taken, however many there are
    key = F.xxhash64("doc_id", "text")
    sample = texts.filter(F.pmod(key, F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).groupBy(key).agg(F.first("text").alias("text")).select("text")
    rows = sorted(bytes(r["ids"]) for r in sample.mapInArrow(tidy(run), "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, rows).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short to train on
        return b"".join(rows)[:DICTIONARY_BYTES]


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if len(content) >= 8 else None


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, sample_docs: int = SAMPLE_DOCS, shards: int | None = None) -> None:
    """Encodes ``text`` of all documents into a new store at ``path``."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    model = json.loads(tokenizer_json)
    width = "<u2" if max([*model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])]) < 1 << 16 else "<u4"
    texts = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    size = texts.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    content = _train(spark, texts, size["docs"], tokenizer_json, end_id, width, sample_docs)
    digest = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(digest, content, width)], "dict_sha256 string, content binary, width string").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast((tokenizer_json, content))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer_json, content = shared.value
        held = _dictionary(content)
        compress = (zstandard.ZstdCompressor(level=3, dict_data=held) if held else zstandard.ZstdCompressor(level=3)).compress
        shard, block, before, since = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        frames: list[bytes] = []

        def out() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in frames])])
            known = [x for x in doc_ids if x is not None]
            row = {"shard": shard, "block": block, "dict_sha256": digest, "first_id": min(known, default=None), "last_id": max(known, default=None), "doc_ids": doc_ids, "n_tokens": sizes, "offsets": offsets.tolist(), "shard_start": before, "frames": b"".join(frames)}
            return pa.RecordBatch.from_pylist([row], schema=kinds)

        for batch in batches:
            for doc_id, ids in zip(batch.column(1).to_pylist(), encoded(batch.column(0), tokenizer_json, end_id), strict=True):
                doc_ids.append(doc_id)
                sizes.append(len(ids))
                frames.append(compress(ids.astype(width).tobytes()))
                since += len(frames[-1])
                if len(frames) >= BLOCK_DOCS or since >= BLOCK_BYTES:
                    yield out()
                    block, before, since = block + 1, before + sum(sizes), 0
                    doc_ids, sizes, frames = [], [], []
        if frames:
            yield out()

    ints = pa.list_(pa.int32())
    kinds = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("dict_sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", ints), ("offsets", ints), ("shard_start", pa.int64()), ("frames", pa.binary())])
    schema = "shard int, block int, dict_sha256 string, first_id long, last_id long, doc_ids array<long>, n_tokens array<int>, offsets array<int>, shard_start long, frames binary"
    n = shards or min(MOST_SHARDS, max(1, -(-size["bytes"] // SHARD_BYTES)))
    keyed = texts.withColumn("h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered.select("text", "doc_id").mapInArrow(tidy(run), schema).write.option("compression", "none").option("parquet.block.size", BLOCK_BYTES).parquet(f"{path}/data")


def read_documents(spark: SparkSession, path: str, doc_ids: Iterable[int], opened: Accumulator[int] | None = None) -> DataFrame:
    """doc_id, n_tokens and ids of the documents with these ids, all rows of each.

    Row groups whose ids lie elsewhere are passed over, by each id where at most
    MOST_PROBES are asked for, else by their range; in the blocks that are left only the
    frames asked for are decompressed, which ``opened`` counts.
    """
    ship(spark)
    wanted = sorted(set(doc_ids))
    spans = [(i, i) for i in wanted] if len(wanted) <= MOST_PROBES else [(wanted[0], wanted[-1])]
    inside = functools.reduce(operator.or_, ((F.col("first_id") <= b) & (F.col("last_id") >= a) for a, b in spans), F.lit(False))
    row = spark.read.parquet(f"{path}/dictionary").first()
    shared = spark.sparkContext.broadcast((row["dict_sha256"], bytes(row["content"]), row["width"], frozenset(wanted)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, content, width, ids = shared.value
        held = _dictionary(content)
        decompress = (zstandard.ZstdDecompressor(dict_data=held) if held else zstandard.ZstdDecompressor()).decompress
        for batch in batches:
            for k in range(len(batch)):
                if batch.column(0)[k].as_py() != digest:
                    raise ValueError("the block was written with another dictionary")
                here = batch.column(1)[k].as_py()
                at, frames = batch.column(2)[k].as_py(), memoryview(batch.column(3)[k].as_buffer())
                some = [(x, np.frombuffer(decompress(frames[at[i] : at[i + 1]]), width).astype(np.int32)) for i, x in enumerate(here) if x in ids]
                if opened is not None:
                    opened.add(len(some))
                sizes = [len(x) for _, x in some]
                flat = np.concatenate([np.zeros(0, np.int32), *(x for _, x in some)])
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))], names=["doc_id", "n_tokens", "ids"])

    blocks = spark.read.parquet(f"{path}/data").filter(inside).select("dict_sha256", "doc_ids", "offsets", "frames")
    return blocks.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids array<int>")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids of every document of the store."""
    ship(spark)
    data = spark.read.parquet(f"{path}/data")
    row = spark.read.parquet(f"{path}/dictionary").first()
    shared = spark.sparkContext.broadcast((row["dict_sha256"], bytes(row["content"]), row["width"]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, content, width = shared.value
        held = _dictionary(content)
        decompress = (zstandard.ZstdDecompressor(dict_data=held) if held else zstandard.ZstdDecompressor()).decompress
        for batch in batches:
            for block in batch.to_pylist():
                if block["dict_sha256"] != digest:
                    raise ValueError("the block was written with another dictionary")
                at, frames = block["offsets"], memoryview(block["frames"])
                ids = [np.frombuffer(decompress(frames[a:b]), width) for a, b in zip(at[:-1], at[1:], strict=True)]
                sizes = np.array([len(x) for x in ids], np.int64)
                upto = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block["shard"]] * len(ids), pa.int32()),
                        pa.array(block["doc_ids"], pa.int64()),
                        pa.array(block["shard_start"] + upto[:-1]),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))),
                    ],
                    names=["shard", "doc_id", "in_shard", "n_tokens", "ids"],
                )

    # one row per shard, MOST_SHARDS at most, so that one task may add them up and all may have them
    totals = data.select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = F.broadcast(totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_begins")))
    blocks = data.select("shard", "dict_sha256", "doc_ids", "offsets", "shard_start", "frames")
    found = blocks.mapInArrow(tidy(run), "shard int, doc_id long, in_shard long, n_tokens long, ids array<int>")
    return found.join(shards, "shard").select("doc_id", (F.col("shard_begins") + F.col("in_shard")).alias("start"), "n_tokens", "ids")


def with_crc32(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            lists = batch.column(3)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.select("doc_id", "start", "n_tokens", "ids").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")

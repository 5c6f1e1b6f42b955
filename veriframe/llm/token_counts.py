"""Operator 8: token counts from pre-token frequencies.

Each distinct pre-token of the corpus is tokenised once, for its number of
pieces.  A document's count is the sum over its pre-tokens of frequency times
pieces; no ids are made.  Frequent pre-tokens, at most ``head_words`` of them,
reach the tasks as sorted hash arrays; a document's other pre-tokens are joined
to the counts by Spark and summed.

The tokenizer is one whose pre-tokens are encoded one by one, with NFC, lower
case and the "bare" split (see ``pretoken``).

Defined results: a null or empty text has no bytes and no tokens; special
strings inside a text count as one token each; very long texts are taken whole;
all rows stay, and equal rows each have their count; other columns, whatever their
names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretoken, vocabulary
from .bpe_replay import word_table
from .common import ship, table

LIMIT = 2048


def _special_strings(tokenizer_json: str) -> tuple[str, ...]:
    return tuple(t["content"] for t in json.loads(tokenizer_json)["added_tokens"])


def piece_counts(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """(word, n, pieces): every distinct pre-token, its count and its number of tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the threads
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(shared.value)
        for batch in batches:
            pieces = [len(x) for x in tokenizer.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[x] for x in pieces], pa.list_(pa.int32()))], names=["word", "n", "pieces"])

    return vocabulary.distinct_words(docs, "bare", _special_strings(tokenizer_json)).mapInArrow(run, "word string, n long, pieces array<int>")


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, head_words: int = vocabulary.HEAD_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    specials = _special_strings(tokenizer_json)
    texts = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    pieces = table(piece_counts(texts, tokenizer_json))
    head = word_table(vocabulary.frequent(pieces, head_words).select("word", "pieces").toArrow(), "pieces")
    shared = spark.sparkContext.broadcast((head.keys, head.flat[head.starts]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, joined, cp, bounds, special in pretoken.lowered_texts(batch.column(0), specials):
                n = len(bounds) - 1
                starts, ends = pretoken.split(cp, bounds, "bare")
                rows = np.searchsorted(bounds, starts, side="right") - 1
                own = pretoken.hashes(cp, starts, ends)
                at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                known = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                tokens = special + np.bincount(rows[known], values[at[known]], minlength=n).astype(np.int64)
                s, e, r = starts[~known], ends[~known], rows[~known]
                order = np.lexsort((own[~known], r))
                s, e, r, h = s[order], e[order], r[order], own[~known][order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                where = np.flatnonzero(new)
                times = np.diff(np.append(where, len(h)))
                words = [joined[a:b] for a, b in zip(s[where].tolist(), e[where].tolist(), strict=True)]
                rare = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(times, pa.int64())], names=["word", "times"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(r[where], np.arange(n + 1)), pa.int32()), rare)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), batch.column(1).slice(first, n), batch.column(2).slice(first, n), pa.array(tokens), lists],
                    names=["row", "doc_id", "n_bytes", "tokens", "rare"],
                )
                row += n

    sized = texts.select("text", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = table(sized.mapInArrow(run, "row long, doc_id long, n_bytes long, tokens long, rare array<struct<word:string,times:bigint>>"))
    rare = counted.select("row", F.explode("rare").alias("e")).select("row", "e.word", "e.times")
    rest = rare.join(pieces.select("word", F.col("pieces")[0].alias("pieces")), "word").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    total = F.col("tokens") + F.coalesce("more", F.lit(0))
    return counted.select("row", "doc_id", "n_bytes", "tokens").join(rest, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))

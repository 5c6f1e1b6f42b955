"""Operator 6: byte-level BPE encoding and decoding by corpus-level merge replay.

Spark counts the distinct pre-tokens of the corpus and hashes them over the
tasks.  Each task replays the merges over its words together: an inverted index
leads from the rank of a token pair to the word positions where it stands, the
lowest rank is applied everywhere, and only the touched neighbours enter the
index again.  Words are independent, so the result is that of encoding each
alone.  Documents are then encoded by looking their words up in sorted hash
arrays of the frequent words, whose number is bounded; a task replays the merges
for the rarer words it meets.  Decoding joins the tokens' bytes.

Defined results: a null or empty text has no ids and decodes to no bytes; very
long texts and words are taken whole; text that looks like a special token is
ordinary text; all rows, equal ones each, and columns stay, except that a column
named as the new one is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pretoken, vocabulary
from .common import Batches, fresh, ship, table, tidy

#: The frequent words that tasks get at once, about 20 MB.
HEAD_WORDS = 1 << 19
BLOCK_WORDS = 5_000
KNOWN_PAIRS = 200_000
CACHE_IDS = 2_000_000


class Ranks:
    """The merge ranks of a rank file; a token's id is its rank."""

    def __init__(self, content: bytes) -> None:
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
        self.token: list[bytes] = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        self._pairs: dict[int, int] = {}

    def pair(self, a: int, b: int) -> int:
        """The rank of two tokens' merge, or -1."""
        key = a << 20 | b
        r = self._pairs.get(key)
        if r is None:
            if len(self._pairs) > KNOWN_PAIRS:
                self._pairs.clear()
            r = self._pairs[key] = self.rank.get(self.token[a] + self.token[b], -1)
        return r

    def replay(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        out: list[list[int]] = []
        for i in range(0, len(words), BLOCK_WORDS):
            out += self._replay([w.encode() for w in words[i : i + BLOCK_WORDS]])
        return out

    def _replay(self, words: list[bytes]) -> list[list[int]]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(sizes) - sizes
        ids = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(ids)
        owner = np.repeat(np.arange(len(words)), sizes)
        joint = np.flatnonzero(owner[1:] == owner[:-1])
        pair_keys, which = np.unique(ids[joint] << 20 | ids[joint + 1], return_inverse=True)
        ranks = np.array([self.pair(k >> 20, k & 0xFFFFF) for k in pair_keys.tolist()], np.int64)[which] if len(joint) else np.zeros(0, np.int64)
        order = np.argsort(ranks, kind="stable")
        some, cuts = np.unique(ranks[order], return_index=True)
        at: dict[int, list[int]] = {int(r): joint[part].tolist() for r, part in zip(some, np.split(order, cuts[1:]), strict=True) if r >= 0}
        sym, own = ids.tolist(), owner.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for b, size in zip(begins.tolist(), sizes.tolist(), strict=True):
            if size:
                before[b], after[b + size - 1] = -1, -1
        pair, queue = self.pair, list(at)
        heapify(queue)
        while queue:
            r = heappop(queue)
            later: list[int] = []
            lower: set[int] = set()  # words in which a lower rank has come up
            for i in sorted(at.pop(r)):
                j = after[i]
                if j < 0 or sym[i] < 0 or pair(sym[i], sym[j]) != r:
                    continue
                if own[i] in lower:
                    later.append(i)
                    continue
                k, h = after[j], before[i]
                sym[i], sym[j], after[i] = r, -1, k
                for left, right in ((h, i), (i, k)):
                    if left >= 0 and right >= 0:
                        if right == k:
                            before[k] = i
                        s = pair(sym[left], sym[right])
                        if s >= 0:
                            if s < r:
                                lower.add(own[i])
                            if s in at:
                                at[s].append(left)
                            else:
                                at[s] = [left]
                                heappush(queue, s)
            if later:
                at.setdefault(r, []).extend(later)
                heappush(queue, r)
        alive = np.array(sym, np.int64)
        kept = np.concatenate([[0], np.cumsum(alive >= 0)])
        flat = alive[alive >= 0].tolist()
        return [flat[a:b] for a, b in zip(kept[begins].tolist(), kept[begins + sizes].tolist(), strict=True)]


@lru_cache(maxsize=2)
def _ranks(content: bytes) -> Ranks:
    return Ranks(content)


def word_ids(docs: DataFrame, content: bytes) -> DataFrame:
    """(word, n, ids): every distinct pre-token of the corpus, its count and its ids."""
    ranks = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ranks(ranks.value).replay(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return vocabulary.distinct_words(docs, "spaced").mapInArrow(tidy(run), "word string, n long, ids array<int>")


def word_table(words: pa.Table, column: str) -> pretoken.WordTable:
    """Sorted hash arrays of the words and their lists."""
    lists = words[column].combine_chunks()
    joined = pa.chunked_array(words["word"]).combine_chunks()
    keys = np.zeros(len(words), np.uint64)
    for first, _, cp, bounds in pretoken.texts(joined):
        keys[first : first + len(bounds) - 1] = pretoken.hashes(cp, bounds[:-1], bounds[1:])
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    return pretoken.WordTable(keys, sizes, lists.flatten().to_numpy().astype(np.int32))


def _content(vocabulary_path: str) -> bytes:
    with open(vocabulary_path, "rb") as f:
        return f.read()


def _encoding(docs: DataFrame, content: bytes, column: str, head_words: int, width: int) -> Batches:
    """The ids of the column ``width``, a text, in its place; the columns before it stay."""
    words = table(word_ids(docs, content))
    head = word_table(vocabulary.frequent(words, head_words).select("word", "ids").toArrow(), "ids")
    shared = docs.sparkSession.sparkContext.broadcast((content, head.keys, head.sizes, head.starts, head.flat))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, keys, sizes, starts, flat = shared.value
        held = pretoken.WordTable(np.zeros(0, np.uint64), np.zeros(0, np.int64), flat)
        held.keys, held.sizes, held.starts = keys, sizes, starts
        start = len(flat)
        for batch in batches:
            for first, ids, bounds in pretoken.encode_column(batch.column(width), held, _ranks(content).replay):
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                rows = batch.slice(first, len(bounds) - 1)
                yield pa.RecordBatch.from_arrays([*rows.columns[:width], lists], names=[*rows.schema.names[:width], column])
            if len(held.flat) - start > CACHE_IDS:
                held.keys, held.sizes, held.starts, held.flat = keys, sizes, starts, flat

    return run


def _decoding(spark: SparkSession, content: bytes, place: int, to: str) -> Batches:
    """The bytes of the ids in the column ``place``, as a further column."""
    tokens = Ranks(content).token
    sizes = np.array([len(t) for t in tokens], np.int64)
    shared = spark.sparkContext.broadcast((np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts, sizes = shared.value
        for batch in batches:
            lists = batch.column(place)
            at = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
            raw, upto = pretoken.ragged(flat, starts[ids], sizes[ids])
            out = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(upto[at - at[0]].astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, to])

    return run


def encode(docs: DataFrame, vocabulary_path: str, column: str = "ids", head_words: int = HEAD_WORDS, keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with the token ids of ``text`` in the array column ``column``.

    With ``decoded`` the bytes of these ids stand in the binary column of that name, as by ``decode``; the worker that encodes a batch decodes it.
    """
    ship(docs.sparkSession)
    docs = docs.drop(column, *([decoded] if decoded else []))
    kept = docs.columns if keep is None else keep
    added = [F.lit(None).cast("array<int>").alias(column)] + ([F.lit(None).cast("binary").alias(decoded)] if decoded else [])
    schema = docs.select(*kept, *added).schema
    content = _content(vocabulary_path)
    run = encoding = _encoding(docs, content, column, head_words, len(kept))
    if decoded:
        decoding = _decoding(docs.sparkSession, content, len(kept), decoded)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from decoding(encoding(batches))

    return docs.select(*kept, F.col("text").alias(fresh(docs, "text"))).mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, vocabulary_path: str, column: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids in the binary column ``to``."""
    ship(encoded.sparkSession)
    encoded = encoded.drop(to)
    schema = encoded.select("*", F.lit(None).cast("binary").alias(to)).schema
    run = _decoding(encoded.sparkSession, _content(vocabulary_path), encoded.columns.index(column), to)
    return encoded.mapInArrow(tidy(run), schema)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded and decoded documents."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

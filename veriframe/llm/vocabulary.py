"""The distinct pre-tokens of a corpus with their counts, and the frequent ones as a table of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretoken
from .common import tidy

#: The frequent words that tasks get at once: at most so many, none longer than LONGEST bytes.
HEAD_WORDS = 1 << 18
LONGEST = 64
FLUSH = 150_000
_STEPS = 16  # parts of a doubling of the count, among which the head's limit is chosen


def distinct_words(docs: DataFrame, style: str, specials: tuple[str, ...] = ()) -> DataFrame:
    """(word, n): every distinct pre-token of the column ``text`` with its count over all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, words = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts)], names=["word", "n"])

        for batch in batches:
            for _, joined, cp, bounds, *_ in pretoken.texts(batch.column(0)) if style == "spaced" else pretoken.lowered_texts(batch.column(0), specials):
                starts, ends = pretoken.split(cp, bounds, style)
                fresh, first, n = np.unique(pretoken.hashes(cp, starts, ends), return_index=True, return_counts=True)
                at = np.minimum(np.searchsorted(keys, fresh), max(len(keys) - 1, 0))
                known = keys[at] == fresh if len(keys) else np.zeros(len(fresh), bool)
                counts[at[known]] += n[known]
                s, e = starts[first[~known]].tolist(), ends[first[~known]].tolist()
                new = np.empty(len(s), object)
                new[:] = [joined[a:b] for a, b in zip(s, e, strict=True)]
                keys = np.concatenate([keys, fresh[~known]])
                order = np.argsort(keys, kind="stable")
                keys, counts, words = keys[order], np.concatenate([counts, n[~known]])[order], np.concatenate([words, new])[order]
                if len(keys) > FLUSH:
                    yield out()
                    keys, counts, words = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
        if len(keys):
            yield out()

    return docs.select("text").mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(words: DataFrame, most: int = HEAD_WORDS) -> DataFrame:
    """The most frequent rows of ``words``, at most ``most`` by a limit on n that their counts give."""
    step = F.floor(F.log2("n") * _STEPS).cast("int")
    short = words.filter(F.octet_length("word") <= LONGEST)
    total, least = 0, None
    for row in sorted(short.groupBy(step.alias("step")).count().collect(), reverse=True):
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    return short.filter(step >= least) if least is not None else short.limit(0)

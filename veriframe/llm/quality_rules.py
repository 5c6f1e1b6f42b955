"""Operator 7: quality rules with an n-gram perplexity band for each language.

Spark counts the byte 5-grams of all documents of each language (bytes, A-Z
lowered, with line ends before the start), and from them the continuation counts
of all lower orders.  The interpolated modified Kneser-Ney model, with its three
discounts by order and language, is computed by group-bys and joins; every n-gram
counts.  A language has two models: a document belongs to one of two folds, by
the least hash of its runs of 20 bytes, so that copies share one, and is scored by the
counts of the other fold.  So no document's own bytes make it likely; a 5-gram
that the other fold doesn't have backs off through the lower orders, which joins
settle for all 5-grams that any document has.  Documents are scored against sorted arrays of at most ``range_ngrams``
5-grams, one hash range after another, so the arrays that go to the tasks are
bounded while their number follows the n-grams.  A document's score is the mean
negative log2 probability of a byte.  A language's band runs from Q1 - 3 IQR to
Q3 + 3 IQR of the scores of its distinct texts that pass the base rules, where a
group of near copies weighs about as much as one text.  The IQR is that of the
language, or, where that is less, of the distances from the median over all languages.

Defined results: a null or empty text has no words and fails the base rules; a
null language is a language of its own; very long texts are taken whole; all rows
stay, equal ones each; other columns, whatever their names, are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .common import fresh, ship, table, tidy

ORDER = 5
RANGE_NGRAMS = 1 << 21
FENCE = 3.0
LEAST_IQR = 0.02
MIN_WORDS = 50
#: Keys of texts that are broadcast at most: 32 MB.
MOST_BROADCAST = 1 << 21
FLUSH = 1 << 22
#: Bytes of text that are counted, and scored, at a time.
COUNT_BYTES, SCORE_BYTES = 1 << 19, 1 << 18
#: Fixed: parts of a bit in which the sums of hash ranges are added.
UNIT = 1 << 20
#: Texts are alike if the least hashes of their word 5-grams agree in all rows of a band.
SKETCH_BANDS, SKETCH_ROWS = 6, 3
#: Fixed: the weight of a text that no other is like.
WEIGHT = 1 << 24
#: Fixed: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_U = np.uint64
#: Of a gram, as a signed long: the language and the fold.
_LANG = -1 << 40
#: The bits of a language's code; the lowest one is left for the fold that the counts are for.
_CODES, _FOLD = 0xFFFFFE, 1 << 40


def _grams(raw: np.ndarray, bounds: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """For each byte its 5-gram: the language in the top 24 bits, then five bytes, the last lowest."""
    low = kernel.lowered(raw)
    sizes = np.diff(bounds)
    back = np.arange(len(low)) - np.repeat(bounds[:-1], sizes)
    key = np.repeat(langs.astype(_U), sizes) << _U(40)
    for j in range(ORDER):
        own = np.full(len(low), 10, _U)
        own[j:] = low[: len(low) - j] if j else low
        if j:
            own[back < j] = 10
        key |= own << _U(8 * j)
    return key


def _folds(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """0 or 1 for each text, by the least hash of its runs of 20 bytes: equal for copies, and for near ones mostly."""
    out = np.zeros(len(bounds) - 1, _U)
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    if len(full):
        own = grams & _U(_FOLD - 1)
        run = own.copy()
        for j in range(ORDER, 4 * ORDER, ORDER):
            run[j:] = run[j:] * _U(0x9E3779B97F4A7C15) + own[: max(len(own) - j, 0)]
        back = np.arange(len(own)) - np.repeat(bounds[:-1], sizes)
        cut = back < 3 * ORDER
        long = np.repeat(sizes > 3 * ORDER, sizes)
        # in a shorter text all its 5-grams count
        least = np.where(cut & long, ~_U(0), kernel.mix(np.where(long, run, own)))
        out[full] = kernel.mix(np.minimum.reduceat(least, bounds[full])) & _U(1)
    return out


def _own_fold(raw: np.ndarray, bounds: np.ndarray, langs: np.ndarray, other: int = 0) -> np.ndarray:
    """The 5-grams with the fold of their text, or with the ``other`` one, in the code."""
    grams = _grams(raw, bounds, langs)
    return grams | (np.repeat(_folds(grams, bounds) ^ _U(other), np.diff(bounds)) << _U(40))


def _count_for_others(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts each text's 5-grams for the model of the other fold."""
    return _count(batches, lambda raw, bounds, langs: _own_fold(raw, bounds, langs, 1))


def _count(batches: Iterable[pa.RecordBatch], grams_of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] = _grams) -> Iterator[pa.RecordBatch]:
    keys, counts = np.zeros(0, _U), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        k, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        return k[first], np.add.reduceat(c, first) if len(k) else c

    for batch in batches:
        langs = batch.column(1).to_numpy(zero_copy_only=False)
        for first, raw, bounds in kernel.chunks(batch.column(0), COUNT_BYTES):
            held.append(np.unique(grams_of(raw, bounds, langs[first : first + len(bounds) - 1]), return_counts=True))
            if sum(len(k) for k, _ in held) > FLUSH // 2:
                keys, counts = merged([(keys, counts), *held])
                held = []
                if len(keys) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["gram", "n"])
                    keys, counts = np.zeros(0, _U), np.zeros(0, np.int64)
    keys, counts = merged([(keys, counts), *held])
    if len(keys):
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["gram", "n"])


@dataclass
class Model:
    """For each order from 1: sorted hashes of n-grams with log2 probabilities, and of contexts with log2 back-off weights."""

    orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log2 P of the last byte of each gram, given those before it."""
        if order == 0:
            return np.full(len(grams), -8.0, np.float32)
        keys, logp, contexts, weights = self.orders[order - 1]
        own, found = _find(keys, _hash(grams, order))
        out = np.where(found, logp[own], np.float32(0)) if len(keys) else np.zeros(len(grams), np.float32)
        rest = np.flatnonzero(~found)
        if len(rest):
            at, known = _find(contexts, _hash(grams[rest] >> _U(8), order - 1, langs=grams[rest]))
            weight = np.where(known, weights[at], np.float32(0)) if len(contexts) else np.float32(0)
            out[rest] = weight + self.score(grams[rest], order - 1)
        return out


def _hash(grams: np.ndarray, order: int, langs: np.ndarray | None = None) -> np.ndarray:
    low = grams & _U((1 << 8 * order) - 1)
    return kernel.mix(((grams if langs is None else langs) & _U(0xFFFFFF0000000000)) | low)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Lookup:
    """Values by hash: the hashes in ascending order, and where each range of their top bits begins, so that one is found with a step or two."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        bits = max(8, len(keys).bit_length())
        self.shift = _U(64 - bits)
        self.starts = np.searchsorted(keys >> self.shift, np.arange(1 << bits, dtype=_U)).astype(np.int32)
        self.steps = int(np.diff(np.append(self.starts, len(keys))).max())

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """The value of each hash, 0 for those that aren't there."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.float32)
        last = len(self.keys) - 1
        at = np.minimum(self.starts[(wanted >> self.shift).astype(np.int64)], last)
        found = self.keys[at] == wanted
        rest = np.flatnonzero(~found)
        for _ in range(self.steps - 1):
            at[rest] = np.minimum(at[rest] + 1, last)
            here = self.keys[at[rest]]
            found[rest[here == wanted[rest]]] = True
            rest = rest[here < wanted[rest]]
        return np.where(found, self.values[at], np.float32(0))


def _shared(order: int) -> Column:
    """Of a gram: its language and the last ``order`` bytes."""
    return F.col("gram").bitwiseAND(_LANG | ((1 << 8 * order) - 1))


def _context(order: int) -> Column:
    """Of a gram of ``order`` bytes: its language and all bytes but the last."""
    return F.col("gram").bitwiseAND(_LANG).bitwiseOR(F.shiftright(F.col("gram").bitwiseAND((1 << 8 * order) - 1), 8))


def _discounted(grams: DataFrame) -> DataFrame:
    """gram, n and d, the discount of the gram's count by the counts of counts of its language."""
    lang = F.col("gram").bitwiseAND(_LANG)
    n = [F.col(f"n{i}") for i in (1, 2, 3, 4)]
    seen = grams.groupBy(lang.alias("lang")).agg(*(F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)))
    y = n[0] / (n[0] + 2 * n[1])
    full = F.least(*n) > 0
    own = [F.when(full, F.least(F.greatest(k - (k + 1) * y * n[k] / n[k - 1], F.lit(0.05)), F.lit(k - 0.05))).otherwise(flat).alias(f"d{k}") for k, flat in ((1, 0.5), (2, 0.75), (3, 0.9))]
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    return grams.withColumn("lang", lang).join(seen.select("lang", *own), "lang").select("gram", "n", d.alias("d"))


def estimates(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (gram, p) and (context, weight) of the interpolated model of counted 5-grams (gram, n).

    Counts are raw for the highest order and continuation counts below.
    """
    counted = [counts]
    for order in range(ORDER - 1, 0, -1):
        counted.append(table(counted[-1].groupBy(_shared(order).alias("gram")).agg(F.count("*").alias("n"))))
    found: list[tuple[DataFrame, DataFrame]] = []
    for order, grams in enumerate(reversed(counted), 1):
        own = _discounted(grams).withColumn("context", _context(order))
        sums = table(own.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("held")))
        placed = own.join(sums, "context")
        if found:
            placed = placed.withColumn("suffix", _shared(order - 1)).join(found[-1][0].toDF("suffix", "below"), "suffix")
        else:
            placed = placed.withColumn("below", F.lit(1 / 256))
        p = (F.col("n") - F.col("d") + F.col("held") * F.col("below")) / F.col("total")
        found.append((table(placed.select("gram", p.alias("p"))), sums.select("context", (F.col("held") / F.col("total")).alias("weight"))))
    return found


def _sorted_logs(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The rows (key, value) as ascending hashes with log2 values."""
    held = df.toArrow()
    keys = kernel.mix(held[0].to_numpy().view(_U))
    order = np.argsort(keys)
    return keys[order], np.log2(held[1].to_numpy()[order]).astype(np.float32)


def _texts(docs: DataFrame, *also: Column, codes: int = _CODES) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("lang").bitwiseAND(codes).alias("code"), *also)


def _counted(texts: DataFrame, count: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    ship(texts.sparkSession)
    return table(texts.mapInArrow(tidy(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))


def fit(docs: DataFrame) -> Model:
    """One model of all documents, without folds, with all orders in one place, for texts that aren't among them; for a corpus that a driver can hold."""
    return Model([(*_sorted_logs(p), *_sorted_logs(w)) for p, w in estimates(_counted(_texts(docs, codes=_CODES | 1), _count))])


def backed_off(needed: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, p) of each of the distinct grams ``needed``, of the order of ``model``'s last, whether it was counted or not.

    A gram that wasn't takes its context's back-off weight, 1 for an unknown
    context, times the probability of the gram without its first byte.
    """
    order = len(model)
    if not order:
        return needed.select("gram", F.lit(1 / 256).alias("p"))
    probabilities, weights = model[-1]
    own = table(needed.join(probabilities, "gram", "left"))
    missed = own.filter("p is null").select("gram", _context(order).alias("context"), _shared(order - 1).alias("suffix"))
    below = backed_off(missed.select(F.col("suffix").alias("gram")).distinct(), model[:-1]).toDF("suffix", "below")
    rest = missed.join(weights, "context", "left").join(below, "suffix").select("gram", (F.coalesce("weight", F.lit(1.0)) * F.col("below")).alias("p"))
    return own.filter("p is not null").unionByName(rest)


def ranges(docs: DataFrame, range_ngrams: int = RANGE_NGRAMS) -> list[DataFrame]:
    """(gram, p) of all 5-grams that documents have, by the counts of the other fold, in hash ranges of about ``range_ngrams`` at most."""
    counts = _counted(_texts(docs), _count_for_others)
    needed = counts.select(F.col("gram").bitwiseXOR(_FOLD).alias("gram"))
    grams = table(backed_off(needed, estimates(counts)))
    n = max(1, -(-grams.count() * 9 // (8 * range_ngrams)))
    return [grams.filter(F.pmod(F.xxhash64("gram"), F.lit(n)) == i) for i in range(n)]


def _base(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """(first row, bytes, bounds, base columns) of runs of rows."""
    for first, raw, bounds in kernel.chunks(text, SCORE_BYTES):
        n = len(bounds) - 1
        starts, ends, rows = kernel.words(raw, bounds)
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        signs = np.concatenate([[0], np.cumsum(_IS_SYMBOL[raw])])
        own = kernel.span_hash(raw, starts, ends)
        n_words = np.bincount(rows, minlength=n)

        repeated = np.zeros(len(own) + 3, np.int64)
        if len(own) >= 3:
            full = np.flatnonzero(rows[:-2] == rows[2:])
            value = kernel.mix((own[full] * _U(0x9E3779B97F4A7C15) + own[full + 1]) * _U(0x9E3779B97F4A7C15) + own[full + 2])
            at = np.searchsorted(rows[full], np.arange(n + 1))
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a > 1:
                    order = np.argsort(value[a:b])
                    s = value[a:b][order]
                    same = s[1:] == s[:-1]
                    if same.any():
                        twice = np.append(same, False) | np.append(False, same)
                        where = full[a:b][order[twice]]
                        repeated[where] += 1
                        repeated[where + 3] -= 1
        covered = np.cumsum(repeated)[: len(own)] > 0

        breaks = np.flatnonzero(raw == 10)
        cuts = np.union1d(breaks + 1, bounds)
        begin, end = cuts[:-1], cuts[1:].copy()
        end[np.isin(end - 1, breaks)] -= 1
        doc = np.searchsorted(bounds, begin, side="right") - 1
        # a line has a word if some word starts in it
        words_before = np.searchsorted(starts, np.stack([begin, end]))
        live = np.flatnonzero(words_before[1] > words_before[0])
        h = kernel.mix(kernel.span_hash(raw, begin[live], end[live]) ^ kernel.mix(doc[live].astype(_U)))
        _, first_at = np.unique(h, return_index=True)
        again = np.ones(len(live), bool)
        again[first_at] = False
        yield first, raw, bounds, {
            "n_words": n_words,
            "word_chars": np.bincount(rows, lead[ends] - lead[starts], minlength=n).astype(np.int64),
            "n_symbols": signs[bounds[1:]] - signs[bounds[:-1]],
            "n_dup_lines": np.bincount(doc[live][again], minlength=n),
            "n_repeat_words": np.bincount(rows[covered], minlength=n),
        }


def _failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > 50 * base["n_words"])


def _sketches(raw: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """For each text one key a band; near copies share one or more of them."""
    n = len(bounds) - 1
    low = kernel.lowered(raw)
    starts, ends, rows = kernel.words(low, bounds)
    value, whose = kernel.windows(kernel.span_hash(low, starts, ends), rows, n, 5)
    full, first = np.unique(whose, return_index=True)
    out = np.zeros((n, SKETCH_BANDS), _U)
    if len(full):
        odd = kernel.mix(np.arange(1, SKETCH_BANDS * SKETCH_ROWS + 1, dtype=_U)) | _U(1)
        for i, by in enumerate(odd):
            band = i // SKETCH_ROWS
            out[full, band] = kernel.mix(out[full, band] ^ np.minimum.reduceat(value * by, first))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * SKETCH_BANDS, pa.int32()), pa.array(out.ravel().view(np.int64)))


def _bits(logs: Lookup, raw: np.ndarray, bounds: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """The bits that the n-grams in ``logs`` add to each text, in units of 2**-20."""
    sums = np.concatenate([[0.0], np.cumsum(logs.of(kernel.mix(_own_fold(raw, bounds, langs))), dtype=np.float64)])
    return np.rint(-UNIT * (sums[bounds[1:]] - sums[bounds[:-1]])).astype(np.int64)


def scores(docs: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """doc_id, lang, code, tid, the base columns, base_failed, sketch and millibits (of a byte) of every document."""
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    texts = _texts(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("tid"))
    sc = docs.sparkSession.sparkContext

    def first_run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(1).to_numpy(zero_copy_only=False)
            for first, raw, bounds, base in _base(batch.column(0)):
                n = len(bounds) - 1
                rows = [batch.column(i).slice(first, n) for i in (2, 3, 1, 4)]
                values = [pa.array(base[c].astype(np.int64)) for c in columns]
                bits = _bits(shared.value, raw, bounds, codes[first : first + n])
                yield pa.RecordBatch.from_arrays([*rows, *values, pa.array(_failed(base)), pa.array(np.diff(bounds)), pa.array(bits), _sketches(raw, bounds)], names=["doc_id", "lang", "code", "tid", *columns, "base_failed", "size", "bits", "sketch"])

    def more_run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(1).to_numpy(zero_copy_only=False)
            for first, raw, bounds in kernel.chunks(batch.column(0), SCORE_BYTES):
                n = len(bounds) - 1
                bits = _bits(shared.value, raw, bounds, codes[first : first + n])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, n), batch.column(4).slice(first, n), pa.array(bits)], names=["code", "tid", "more"])

    shared = sc.broadcast(Lookup(*_sorted_logs(parts[0])))
    schema = "doc_id long, lang string, code long, tid long, " + ", ".join(f"{c} long" for c in columns) + ", base_failed boolean, size long, bits long, sketch array<long>"
    scored = table(texts.mapInArrow(tidy(first_run), schema))
    for part in parts[1:]:
        shared.unpersist()
        shared = sc.broadcast(Lookup(*_sorted_logs(part)))
        more = table(texts.mapInArrow(tidy(more_run), "code long, tid long, more long").dropDuplicates(["code", "tid"]))
        scored = table(scored.join(more, ["code", "tid"]).withColumn("bits", F.col("bits") + F.col("more")).drop("more"))
    shared.destroy()  # all that reads it is written
    millibits = F.rint(1000 * F.col("bits") / (UNIT * F.greatest("size", F.lit(1)))).cast("long")
    return scored.withColumn("millibits", millibits).drop("size", "bits")


def _quartiles(weighed: DataFrame, value: str, *by: str) -> DataFrame:
    """q1, q2, q3 of ``value``, by the column weight, for each of ``by``."""
    hist = weighed.groupBy(*by, value).agg(F.sum("weight").alias("n"))
    upto, whole = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
    ranked = hist.select(*by, value, F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("total"))
    return ranked.groupBy(*by).agg(*(F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col(value))).alias(f"q{q}") for q in (1, 2, 3)))


def weighed(scored: DataFrame) -> DataFrame:
    """(code, millibits, weight) of each distinct text that passes the base rules; k texts that are alike weigh 1/k each."""
    texts = scored.filter(~F.col("base_failed")).dropDuplicates(["code", "tid"])
    keys = texts.select("code", "tid", F.posexplode("sketch").alias("band", "key"))
    shared = keys.groupBy("code", "band", "key").agg(F.count("*").alias("k")).filter("k > 1")
    alike = keys.join(shared, ["code", "band", "key"]).groupBy("code", "tid").agg(F.max("k").alias("k"))
    weight = F.greatest(F.lit(1), F.floor(F.lit(WEIGHT) / F.coalesce("k", F.lit(1)))).cast("long")
    return texts.join(alike, ["code", "tid"], "left").select("code", "millibits", weight.alias("weight"))


def bands(scored: DataFrame, fence: float = FENCE, least_iqr: float = LEAST_IQR) -> DataFrame:
    """(code, low, high): the band of each language, in thousandths of a bit."""
    texts = table(weighed(scored))
    cut = table(_quartiles(texts, "millibits", "code"))
    # the values are a few thousand at most, so their ranks are one task's work
    normal = _quartiles(texts.join(cut, "code").withColumn("off", F.col("millibits") - F.col("q2")), "off").select((F.col("q3") - F.col("q1")).alias("normal"))
    width = F.greatest(F.col("q3") - F.col("q1"), F.col("normal"), F.lit(1000 * least_iqr)) * fence
    return cut.crossJoin(normal).select("code", (F.col("q1") - width).alias("low"), (F.col("q3") + width).alias("high"))


def _judged(scored: DataFrame) -> DataFrame:
    """``scored`` with kept: whether a document passes the base rules and its language's band."""
    inside = F.coalesce((F.col("millibits") >= F.col("low")) & (F.col("millibits") <= F.col("high")), F.lit(False))
    return scored.join(bands(scored), "code", "left").withColumn("kept", ~F.col("base_failed") & inside)


def quality(docs: DataFrame, range_ngrams: int = RANGE_NGRAMS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the score in bits a byte, of every document."""
    judged = _judged(scores(docs, ranges(docs, range_ngrams)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", (F.col("millibits") / 1000).alias("bits_per_byte"))


def keep_good(docs: DataFrame, range_ngrams: int = RANGE_NGRAMS) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and their language's band, with all columns.

    Texts are scored once; the keys, by text and language, of those that fail are
    broadcast where they are few enough, so that no text is shuffled, and else joined.
    """
    judged = _judged(scores(docs, ranges(docs, range_ngrams)))
    code, tid = fresh(docs, "code_"), fresh(docs, "tid_")
    bad = table(judged.filter(~F.col("kept")).select(F.col("code").alias(code), F.col("tid").alias(tid)).distinct())
    keyed = docs.withColumns({code: F.xxhash64("lang").bitwiseAND(_CODES), tid: F.xxhash64("text")})
    few = bad.count() <= MOST_BROADCAST
    return keyed.join(F.broadcast(bad) if few else bad, [code, tid], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))

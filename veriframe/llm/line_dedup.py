"""Operator 9: removal of lines that match an earlier line of the corpus.

A line's tokens are its distinct words, A-Z lowered.  Lines match when the
Jaccard similarity of their token sets is 0.8 or more; a line that matches any
earlier line, in the order (doc_id, text hash, line number), is removed.  Tokens
are ordered by rarity over all lines, and prefix, positional and length filters
leave few pairs to verify.

One earlier match is all that counts.  Copies need no pairs: equal token sets
are one set with a first occurrence.  In lists of SETTLED_LIST sets or more that
share a lead key, each set meets the earliest ones of each list and is compared
with the likest of them: that settles a large group of near copies by a few pairs
a set.  The full join then covers every pair whose later set isn't settled.

A line of fewer than LEAST_JOINED words links with no other set (four words may
match five), so it takes part in no join: equal sets of any size are decided by first occurrence.

Defined results: lines are split at \\n; lines with fewer than ``min_tokens``
distinct words, and null or empty texts, are never removed and never match; very
long texts and lines are taken whole; repeated rows (equal doc_id and text) are
one document, so they lose the same lines; a null doc_id sorts first; an empty
table gives no rows; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel, setjoin
from .common import fresh, ship, table, tidy
from .rarity import Levels, count_levels

#: Lines of fewer distinct words are left alone.
MIN_TOKENS = 1
#: Fixed: two different sets with a Jaccard similarity of 0.8 have four tokens at least.
LEAST_JOINED = 4
#: Lists of so many sets are settled by their earliest ones, and tokens of the level of that count make lead keys.
SETTLED_LIST, LEAD_LEVEL = 16, 4
#: The earliest sets of a large list that all others meet.
LEADERS = 4
#: The likest ones among them that a set is compared with.
COMPARED_LEADERS = 3
LEVELS = Levels(thresholds=tuple(2**i for i in range(1, 15)))


#: Spreads line numbers over 32 bits; with a line number below 2**31 the product stays within a long.
_SPREAD = 0x9E3779B1


def line_key(tid: Column, line_no: Column) -> Column:
    """A key of a line by its text and number, as ``_line_keys`` has it in tasks."""
    return tid.bitwiseXOR(F.shiftleft(line_no.cast("long") * _SPREAD, 32))


def _line_keys(tids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return tids.view(np.uint64) ^ (numbers.astype(np.uint64) * np.uint64(_SPREAD) << np.uint64(32))


def _chosen_lines(raw: np.ndarray, bounds: np.ndarray, tids: np.ndarray, held: setjoin.IdFilter) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of the lines whose keys ``held`` has."""
    breaks = np.flatnonzero(raw == 10) + 1
    cuts = np.union1d(breaks, bounds)
    begin = cuts[:-1]
    doc = np.searchsorted(bounds, begin, side="right") - 1
    number = np.searchsorted(breaks, begin, side="right") - np.searchsorted(breaks, bounds[doc], side="right")
    mine = held.of(_line_keys(tids[doc], number))
    n = np.diff(cuts)
    return raw[np.repeat(mine, n)], np.concatenate([[0], np.cumsum(n[mine])])


def chosen_sets(min_tokens: int) -> Callable[[pa.RecordBatch, setjoin.IdFilter | None], Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]]:
    """As ``line_sets``, of the lines whose keys the filter has, without their key columns."""
    all_sets = line_sets(min_tokens)

    def records(batch: pa.RecordBatch, held: setjoin.IdFilter | None) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
        if held is None:
            yield from all_sets(batch)
            return
        tids = batch.column(1).to_numpy()
        for first, raw, bounds in kernel.chunks(batch.column(2)):
            low, cuts = _chosen_lines(raw, bounds, tids[first : first + len(bounds) - 1], held)
            low = kernel.lowered(low)
            starts, ends, rows = kernel.words(low, cuts)
            yield [], *kernel.distinct_by_row(kernel.word_hash(low, starts, ends), rows, len(cuts) - 1)

    return records


def line_sets(min_tokens: int) -> Callable[[pa.RecordBatch], Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]]:
    def records(batch: pa.RecordBatch) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
        for first, raw, bounds in kernel.chunks(batch.column(2)):
            low = kernel.lowered(raw)
            breaks = np.flatnonzero(low == 10) + 1
            cuts = np.union1d(breaks, bounds)
            starts, ends, rows = kernel.words(low, cuts)
            values, at = kernel.distinct_by_row(kernel.word_hash(low, starts, ends), rows, len(cuts) - 1)
            n = np.diff(at)
            keep = n >= min_tokens
            values = values[np.repeat(keep, n)]
            begin = cuts[:-1][keep]
            doc = np.searchsorted(bounds, begin, side="right") - 1
            number = np.searchsorted(breaks, begin, side="right") - np.searchsorted(breaks, bounds[doc], side="right")
            which = pa.array(doc + first)
            yield [batch.column(0).take(which), batch.column(1).take(which), pa.array(number, pa.int32())], values, np.concatenate([[0], np.cumsum(n[keep])])

    return records


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), F.col("text").cast("string").alias("text"))


def repeated_lines(docs: DataFrame, min_tokens: int = MIN_TOKENS, levels: Levels = LEVELS) -> DataFrame:
    """(doc_id, tid, line_no): the lines, counted from 0, that match an earlier line; tid is the xxhash64 of the text."""
    return _later_lines(docs, min_tokens, levels).distinct()


def _later_lines(docs: DataFrame, min_tokens: int, levels: Levels) -> DataFrame:
    """As ``repeated_lines``, where repeated rows tell their lines again."""
    spark = docs.sparkSession
    ship(spark)
    texts, records = _keyed(docs), line_sets(min_tokens)

    def tokens(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, bool]]:
        for _, values, bounds in records(batch):
            yield values, False
            yield kernel.set_ids(values, bounds).view(np.uint64), False

    # tokens and sets are counted together
    maps = spark.sparkContext.broadcast(count_levels(texts, tokens, levels))
    lines = table(setjoin.index(texts, records, "doc_id long, tid long, line_no int", maps, narrow=True, lead_level=LEAD_LEVEL, repeats=True))
    where = F.struct("doc_id", "tid", "line_no")
    same = ("n", "sig", "sig2", "alone", "tokens", "leads")

    # a line without a listed token has a token of its own and matches nothing
    single = lines.filter("not again").select("sid", where.alias("f"), F.lit(1).cast("long").alias("k"), *same)
    copies = lines.filter("again").groupBy("sid").agg(F.min(F.struct(where.alias("f"), *same)).alias("x"), F.count("*").alias("k"))
    sets = single.union(table(copies.select("sid", "x.f", "k", *(f"x.{c}" for c in same)))).withColumn("id", F.col("sid"))
    firsts = sets.select("sid", "f")

    joined = sets.filter(F.col("n") >= LEAST_JOINED)
    leaders = table(_likest_leaders(table(_large_lists(joined))))
    settled = setjoin.linked(leaders, _members(leaders, firsts, texts, min_tokens))
    settled = settled.select("b").distinct()
    done = settled.select(F.col("b").alias("sid"), F.lit(True).alias("settled"))
    done = F.broadcast(done) if done.count() <= setjoin.MOST_BROADCAST else done

    known = joined.select("sid", "id", "f", "n", "sig", "sig2", "alone", "tokens").join(done, "sid", "left").withColumn("settled", F.col("settled").isNotNull())
    each = known.select("id", "sig", "sig2", "n", "alone", "settled", F.posexplode("tokens").alias("i", "token"))
    entries = each.select("token", "id", *setjoin.folded(F.col("n"), F.col("sig"), F.col("sig2")), setjoin.sized(F.col("n"), F.col("alone") + F.col("i"), F.col("settled")).alias("meta"))
    found = setjoin.pairs(entries, lambda x, y: ~(setjoin.flagged(x) & setjoin.flagged(y)))
    names = known.select("id", F.struct("f", "sid", "settled").alias("s"))
    both = found.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "distance")
    open_ = table(both.filter(~F.col("y.settled")).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), "distance"))

    # each line's likest partner first; the others only of lines that it doesn't settle
    best = table(open_.groupBy("b").agg(F.min(F.struct("distance", "a")).alias("x")).select("x.a", "b"))
    held = _members(open_, firsts, texts, min_tokens)
    links = setjoin.linked(best, held)
    rest = table(open_.join(links.select("b"), "b", "left_anti").join(best, ["a", "b"], "left_anti").select("a", "b"))
    if not rest.isEmpty():
        links = links.union(setjoin.linked(rest, held))

    later = settled.select("b").union(links.select("b")).distinct().select(F.col("b").alias("sid"), F.lit(True).alias("later"))
    decided = sets.select("sid", "f", "k").join(later, "sid", "left").filter("k > 1 or later").select("sid", "f", F.coalesce("later", F.lit(False)).alias("later"))
    return lines.select("doc_id", "tid", "line_no", "sid").join(decided, "sid").filter(F.col("later") | (where != F.col("f"))).select("doc_id", "tid", "line_no")


def _large_lists(sets: DataFrame) -> DataFrame:
    """(token, sid, n, sig, sig2, pos, f): entries of the lists, by lead key, that hold SETTLED_LIST sets or more; a key is a pair of lead tokens."""
    spark = sets.sparkSession

    def tokens(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, bool]]:
        yield _lead_keys(batch.column(0))[0], False

    large = spark.sparkContext.broadcast(count_levels(sets.select("leads"), tokens, Levels(thresholds=(SETTLED_LIST,))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows = _lead_keys(batch.column(0))
            some = np.flatnonzero(large.value.of(own))
            rest = batch.take(pa.array(rows[some]))
            yield pa.RecordBatch.from_arrays([pa.array(own[some].view(np.int64)), *rest.columns[1:]], names=["token", *names])

    names = ["sid", "n", "sig", "sig2", "doc_id", "tid", "line_no"]
    entries = sets.select("leads", "sid", "n", "sig", "sig2", "f.*").mapInArrow(tidy(run), "token long, sid long, n int, sig long, sig2 long, doc_id long, tid long, line_no int")
    return entries.select("token", "sid", "n", "sig", "sig2", F.lit(0).alias("pos"), F.struct("doc_id", "tid", "line_no").alias("f"))


def _lead_keys(leads: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows): a hash of each pair of a row's lead tokens."""
    at = leads.offsets.to_numpy()
    own = kernel.mix(leads.flatten().to_numpy().astype(np.int64).view(np.uint64))
    begin, n = at[:-1] - at[0], np.diff(at)
    keys, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for j in range(1, setjoin.LEAD_TOKENS):
        row = np.flatnonzero(n > j)
        for i in range(j):
            keys.append(kernel.mix(own[begin[row] + i] + kernel.mix(own[begin[row] + j])))
            rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _likest_leaders(entries: DataFrame) -> DataFrame:
    """Pairs (a, b), up to COMPARED_LEADERS for each set b: a is, of the earliest sets of each part of b's lists, among the likest by signature."""
    parted = entries.withColumn("part", F.pmod("sid", F.lit(LEADERS)))
    lead = parted.groupBy("token", "part").agg(F.min(F.struct("f", "sid", "n", "sig", "sig2", "pos")).alias("x")).select("token", "x.*")
    x, y = lead.alias("x"), entries.alias("y")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.f") < F.col("y.f")) & setjoin.may_link("x", "y")
    met = x.join(y, on).select(F.col("y.sid").alias("b"), F.struct(setjoin.signature_distance("x", "y").alias("apart"), F.col("x.f").alias("f"), F.col("x.sid").alias("a")).alias("best"))
    likest = F.slice(F.array_sort(F.collect_set("best")), 1, COMPARED_LEADERS)
    return met.groupBy("b").agg(likest.alias("best")).select(F.explode("best.a").alias("a"), "b")


def _members(pairs: DataFrame, firsts: DataFrame, texts: DataFrame, min_tokens: int) -> DataFrame:
    """The sets of the pairs, each read from its first line; other lines of the texts are passed over."""
    wanted = firsts.join(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sid", "left_semi").select("sid", "f.tid", line_key(F.col("f.tid"), F.col("f.line_no")).alias("line"))
    return table(setjoin.members(texts, chosen_sets(min_tokens), table(wanted), by="line"))


def removed_by_document(docs: DataFrame, min_tokens: int = MIN_TOKENS, levels: Levels = LEVELS) -> DataFrame:
    """(doc_id, tid, removed_lines): sorted line numbers, for documents that lose any."""
    return _later_lines(docs, min_tokens, levels).groupBy("doc_id", "tid").agg(F.sort_array(F.collect_set("line_no")).alias("removed_lines"))


def kept_text(text: Column, removed: Column) -> Column:
    """The text without the lines whose numbers are in ``removed``."""
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(removed, i)), "\n")
    return F.when(F.size(removed) > 0, kept).otherwise(text)


def dedup_lines(docs: DataFrame, min_tokens: int = MIN_TOKENS, levels: Levels = LEVELS) -> DataFrame:
    """``docs`` with the matching later lines taken out of ``text``; all other columns and all rows stay."""
    name = fresh(docs, "tid")
    d, r = docs.withColumn(name, F.xxhash64("text")).alias("d"), removed_by_document(docs, min_tokens, levels).alias("r")
    on = (F.col(f"d.{name}") == F.col("r.tid")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("r.doc_id"))
    text = kept_text(F.col("d.text"), F.coalesce("r.removed_lines", F.array().cast("array<int>")))
    return d.join(r, on, "left").select(*(text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns))

"""Exact set-similarity join at Jaccard >= 0.8, shared by two operators; a third one verifies its pairs here, at a bound of its own.

A set's tokens are ordered by (rarity level, hash), the same order for all
sets.  Two sets that link share a token among the first ``n - ceil(0.8 n) + 1``
of each, so an inverted list per prefix token finds every pair.  Tokens that
occur once in the corpus take a place in the order, but no list.  Lists are
joined under the length filter, the positional filter (what can still overlap
from this position on) and a parity signature of 128 bits, whose distance never
exceeds the sets' symmetric difference.  Sets and tokens are 64-bit hashes and
taken as equal by them: among 10**9 distinct values two fall together with a
chance of 3 %, and that only alters what holds one of the two.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .common import table, tidy
from .rarity import Maps, bitmap_bits

#: Ids beyond so many are matched by a join, up to it by a bitmap of 32 MB at most.
MOST_IDS = 1 << 26
#: Ids that are broadcast at most, 16 MB; more are joined.
MOST_BROADCAST = 1 << 21
#: Sizes of one class differ by less than this factor.
CLASS_RATIO = 1.25

#: (key columns, sorted distinct values, bounds) of runs of records.
Records = Callable[[pa.RecordBatch], Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]]


def ordered(values: np.ndarray, bounds: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, rows, levels) of the tokens that occur twice or more, each set's in the global order."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    some = level > 0
    v, r, lv = values[some], rows[some], level[some]
    # rows ascend and values ascend within them, so a stable sort by level is enough
    if len(v) < 1 << 24 and len(bounds) < 1 << 32:
        # places in the low bits make the plain sort of integers, which is faster, a stable one
        place = np.uint64((1 << 24) - 1)
        order = (np.sort((r * 256 + lv).astype(np.uint64) << np.uint64(24) | np.arange(len(v), dtype=np.uint64)) & place).astype(np.int64)
    else:
        order = np.argsort(r * 256 + lv, kind="stable")
    return v[order], r[order], lv[order]


def prefixes(v: np.ndarray, r: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, bounds, alone): the listed prefix tokens of each set, out of ``ordered`` ones, and the number of tokens before them, which no other set has."""
    n = np.diff(bounds)
    start = np.searchsorted(r, np.arange(len(n) + 1))
    alone = n - np.diff(start)
    pos = np.arange(len(v)) - start[r] + alone[r]
    keep = pos < (n + (-4 * n) // 5 + 1)[r]
    return v[keep].view(np.int64), np.concatenate([[0], np.cumsum(keep)])[start], alone


def signatures(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 parity bits of each set, in two halves: two sets' distance is at most their symmetric difference."""
    place = kernel.mix(values)
    bit = np.uint64(1) << (place >> np.uint64(58))
    high = (place & np.uint64(1)).astype(bool)
    full = np.flatnonzero(np.diff(bounds))
    halves = []
    for some in (~high, high):
        out = np.zeros(len(bounds) - 1, np.uint64)
        if len(full):
            out[full] = np.bitwise_xor.reduceat(np.where(some, bit, np.uint64(0)), bounds[full])
        halves.append(out.view(np.int64))
    return halves[0], halves[1]


def _place(r: np.ndarray, n_rows: int) -> np.ndarray:
    """Each entry's place among those of its row; ``r`` ascends."""
    return np.arange(len(r)) - np.searchsorted(r, np.arange(n_rows))[r]


#: Of a set's rarest LEAD_WINDOW tokens that are frequent enough, the LEAD_TOKENS of least hash lead it.
LEAD_WINDOW, LEAD_TOKENS = 12, 4


def lead_tokens(v: np.ndarray, r: np.ndarray, level: np.ndarray, n_rows: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds): of ``ordered`` tokens, some that most sets of a group of near copies share, in one order for all sets.

    They are of level ``least`` or more, as the tokens of a large group are, so
    words that only a copy or two have take no part.
    """
    v, r = v[level >= least], r[level >= least]
    near = _place(r, n_rows) < LEAD_WINDOW
    v, r = v[near], r[near]
    order = np.argsort(r.astype(np.uint64) << np.uint64(32) | kernel.mix(v) >> np.uint64(32))
    v, r = v[order], r[order]
    first = _place(r, n_rows) < LEAD_TOKENS
    v, r = v[first], r[first]
    return (v.view(np.int64) >> 32).astype(np.int32), np.searchsorted(r, np.arange(n_rows + 1))


def index(df: DataFrame, records: Records, keys: str, maps: Broadcast[Maps], narrow: bool = False, lead_level: int = 0, repeats: bool = False) -> DataFrame:
    """One row per record: its key columns, n, sid (equal sets have equal ids), sig, sig2, and alone (tokens that no other set has) and the listed prefix tokens that follow them.

    ``narrow`` lists the top 32 bits of tokens: lists of some tokens fall together, which only adds candidates.
    With ``lead_level`` there are also the lead tokens, of that level or more.
    With ``repeats``, where ``maps`` counts sids as well as tokens, a flag ``again`` tells of which sets there may be further records; it is null where no token is listed.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, values, bounds in records(batch):
                v, r, level = ordered(values, bounds, maps.value.of(values))
                tokens, at, alone = prefixes(v, r, bounds)
                unlisted = np.diff(at) == 0
                at = pa.array(at, pa.int32())
                leads = []
                if lead_level:
                    found, upto = lead_tokens(v, r, level, len(bounds) - 1, lead_level)
                    leads.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(found)))
                if narrow:
                    tokens = (tokens >> 32).astype(np.int32)
                sig, sig2 = signatures(values, bounds)
                ids = kernel.set_ids(values, bounds)
                again = [pa.array(maps.value.of(ids.view(np.uint64)) > 0, mask=unlisted)] * repeats
                yield pa.RecordBatch.from_arrays(
                    [
                        *key,
                        pa.array(np.diff(bounds), pa.int32()),
                        pa.array(ids),
                        pa.array(sig),
                        pa.array(sig2),
                        pa.array(alone, pa.int32()),
                        pa.ListArray.from_arrays(at, pa.array(tokens)),
                        *leads,
                        *again,
                    ],
                    names=names,
                )

    schema = f"{keys}, n int, sid long, sig long, sig2 long, alone int, tokens array<{'int' if narrow else 'long'}>" + ", leads array<int>" * bool(lead_level) + ", again boolean" * repeats
    names = [x.split()[0] for x in schema.split(", ")]
    return df.mapInArrow(tidy(run), schema)


def sized(n: Column, pos: Column, flag: Column) -> Column:
    """Size, position and a flag of a list entry in one long, as ``may_link`` and ``flagged`` read them."""
    return F.shiftleft(n.cast("long"), 32).bitwiseOR(F.shiftleft(pos.cast("long"), 1)).bitwiseOR(flag.cast("long"))


def shifted_pos(meta: str) -> Column:
    """The position in a ``sized`` column."""
    return F.shiftright(F.col(meta).bitwiseAND(0xFFFFFFFF), 1)


def flagged(entry: str) -> Column:
    return F.col(f"{entry}.meta").bitwiseAND(1) == 1


def signature_distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}.sig").bitwiseXOR(F.col(f"{b}.sig"))) + F.bit_count(F.col(f"{a}.sig2").bitwiseXOR(F.col(f"{b}.sig2")))


#: Sets of up to so many tokens have one half of a signature in packed entries: at a Jaccard similarity of 0.8 it tells them apart.
FOLDED = 96


def folded(n: Column, sig: Column, sig2: Column) -> tuple[Column, Column]:
    """(sig, sig2) of a packed entry: the parity bits of both halves in one, and the second half of large sets only."""
    return sig.bitwiseXOR(sig2).alias("sig"), F.when(n > FOLDED, sig2).alias("sig2")


def folded_distance(a: str, b: str) -> Column:
    """As ``signature_distance`` on folded signatures: of the whole ones where both entries have them."""
    one, two = F.col(f"{a}.sig").bitwiseXOR(F.col(f"{b}.sig")), F.col(f"{a}.sig2").bitwiseXOR(F.col(f"{b}.sig2"))
    return F.coalesce(F.bit_count(one.bitwiseXOR(two)) + F.bit_count(two), F.bit_count(one))


def may_link(a: str, b: str, packed: bool = False) -> Column:
    """Length, positional and signature filters on two list entries; packed ones have ``sized`` and ``folded`` columns."""
    distance = (folded_distance if packed else signature_distance)(a, b)
    if packed:
        an, bn = (F.shiftright(F.col(f"{e}.meta"), 32) for e in (a, b))
        ap, bp = (shifted_pos(f"{e}.meta") for e in (a, b))
    else:
        an, bn, ap, bp = (F.col(f"{e}.{c}") for c in ("n", "pos") for e in (a, b))
    return (5 * an >= 4 * bn) & (5 * bn >= 4 * an) & (9 * F.least(an - ap, bn - bp) >= 4 * (an + bn)) & (9 * distance <= an + bn)


def lists(sets: DataFrame) -> DataFrame:
    """Inverted-list entries (token, sid, n, sig, sig2, pos, ...) of the listed tokens."""
    rest = [c for c in sets.columns if c not in ("tokens", "alone")]
    return sets.select(*rest, "alone", F.posexplode("tokens").alias("i", "token")).select(*rest, "token", (F.col("alone") + F.col("i")).alias("pos"))


def _before(x: str, y: str, order: list[str]) -> Column:
    found = F.lit(False)
    for c in reversed(order):
        a, b = F.col(f"{x}.{c}"), F.col(f"{y}.{c}")
        found = (a < b) if c == order[-1] else (a < b) | ((a == b) & found)
    return found


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(CLASS_RATIO)).cast("int")


def blocks_probed(n: Column, pos: Column) -> Column:
    """The size classes of the sets, as large or larger, that a set of ``n`` tokens can link with from position ``pos`` of a list on.

    With the token at ``pos`` as the first that they share, ``n - pos`` more can
    overlap, so the other set has (5 n - 9 pos) / 4 tokens at most: the later a
    token stands, the fewer blocks of its list are looked at.
    """
    return F.sequence(size_class(n), F.greatest(size_class(n), size_class(F.greatest(F.lit(1), F.floor((5 * n - 9 * pos) / 4)))))


def pairs(entries: DataFrame, apart: Callable[[str, str], Column]) -> DataFrame:
    """All pairs (a, b) of the column id, a < b, of packed entries that pass the filters and for which ``apart`` holds, with the distance of their signatures.

    Where two sets link, the smaller one holds the first token that they share
    within the ninth part of its own size, by the positional filter.  So later
    entries meet only the early ones of smaller sets, and not each other.
    """
    early = 9 * shifted_pos("meta") <= F.shiftright("meta", 32)
    first, later = entries.filter(early), entries.filter(~early)
    x = first.alias("x")
    found = []
    for others, once in ((first, F.col("x.id") < F.col("y.id")), (later, F.col("x.id") != F.col("y.id"))):
        # most entries of a list are told apart by one half of their signatures
        near = 9 * F.bit_count(F.col("x.sig").bitwiseXOR(F.col("y.sig"))) <= F.shiftright("x.meta", 32) + F.shiftright("y.meta", 32)
        on = (F.col("x.token") == F.col("y.token")) & near & once & may_link("x", "y", packed=True) & apart("x", "y")
        found.append(x.join(others.alias("y"), on).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), folded_distance("x", "y").alias("distance")))
    return found[0].union(found[1]).distinct()


def block_pairs(entries: DataFrame, apart: Callable[[str, str], Column]) -> DataFrame:
    """As ``pairs`` in the order (n, sid), with each list cut into blocks by size class: an entry is joined with the blocks that it probes and passes over the others."""
    held = entries.withColumn("block", size_class(F.col("n")))
    probes = entries.withColumn("block", F.explode(blocks_probed(F.col("n"), F.col("pos"))))
    x, y = probes.alias("x"), held.alias("y")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.block") == F.col("y.block")) & _before("x", "y", ["n", "sid"]) & may_link("x", "y") & apart("x", "y")
    return x.join(y, on).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()


class IdFilter:
    """A bit for each hash among some ids: most others are told apart by it, sixteen slots standing for each id."""

    def __init__(self, bits: int) -> None:
        self.bits, self.held = bits, np.zeros(1 << (bits - 3), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        slot = ids.view(np.uint64) >> np.uint64(64 - self.bits)
        return ((self.held[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def id_filter(ids: DataFrame, column: str) -> IdFilter | None:
    """The filter of the values of ``column``, of 32 MB at most; None if there are more than MOST_IDS of them."""
    n = ids.count()
    if n > MOST_IDS:
        return None
    out = IdFilter(bitmap_bits(n, least=12, most=28))
    bits, part = out.bits, min(9, out.bits - 3)

    def piece(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << (bits - part), bool)
        flags[group["slot"].to_numpy()] = True
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    cut = ids.select(F.shiftright(slot, bits - part).alias("part"), slot.bitwiseAND((1 << (bits - part)) - 1).alias("slot")).distinct()
    size = 1 << (bits - part - 3)
    for row in cut.groupBy("part").applyInPandas(piece, "part long, bits binary").collect():
        out.held[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def _unpack(members: bytes) -> np.ndarray:
    return np.frombuffer(members, "<u8")


def members(df: DataFrame, records: Records | Callable[[pa.RecordBatch, IdFilter | None], Iterator], wanted: DataFrame, by: str = "sid") -> DataFrame:
    """(sid, members): the packed values of the sets whose ids are among ``wanted``, and of a few more.

    Where ``wanted`` has the column tid, only the texts of ``df`` with these keys are cut into sets, unless they are very many.
    With ``by`` another column than sid, ``records`` chooses by a filter of its values, which it gets, what it cuts into sets.
    """
    found = id_filter(wanted, by)
    held = df.sparkSession.sparkContext.broadcast(found)
    if "tid" in wanted.columns:
        keys = wanted.select("tid").distinct()
        if keys.count() <= MOST_BROADCAST:
            df = df.join(F.broadcast(keys), "tid", "left_semi").select(df.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, values, bounds in records(batch) if by == "sid" else records(batch, held.value):
                ids = kernel.set_ids(values, bounds)
                mine = np.diff(bounds) > 0
                if held.value is not None and by == "sid":
                    mine &= held.value.of(ids)
                rows = [i for i in np.flatnonzero(mine).tolist() if ids[i] not in seen]
                if not rows:
                    continue
                if len(seen) < 1_000_000:
                    seen.update(ids[rows].tolist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows]), pa.array([values[bounds[i] : bounds[i + 1]].astype("<u8").tobytes() for i in rows], pa.binary())],
                    names=["sid", "members"],
                )

    sets = df.mapInArrow(tidy(run), "sid long, members binary")
    if found is None:
        sets = sets.join(wanted.select("sid").distinct(), "sid", "left_semi")
    return sets.groupBy("sid").agg(F.first("members").alias("members"))


def _both(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    return candidates.join(sets.toDF("a", "ma"), "a").join(sets.toDF("b", "mb"), "b").select("a", "b", "ma", "mb")


def _shared(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values ``u`` stand among ``v``, and whether they do; both ascend."""
    at = np.minimum(np.searchsorted(v, u), len(v) - 1)
    return at, v[at] == u


def _links(nu: int, nv: int, common: int, percent: int = 80) -> bool:
    return 100 * common >= percent * (nu + nv - common)


def compared(candidates: DataFrame, sets: DataFrame, percent: int = 80, near_by: tuple[int, int] = (2, 9)) -> DataFrame:
    """(a, b, na, nb, link, near, change): the pairs of ``candidates`` by their exact sets, of the table ``sets``.

    ``near`` pairs differ by the part ``near_by`` of both sizes, twice what a link may, at most; ``change`` then has the tokens in one of the two sets only.
    """
    share, whole = near_by

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, link, near, change = [], [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = _unpack(x.as_py()), _unpack(y.as_py())
                at, shared = _shared(u, v)
                common = int(np.count_nonzero(shared))
                na.append(len(u))
                nb.append(len(v))
                link.append(_links(len(u), len(v), common, percent))
                near.append(whole * (len(u) + len(v) - 2 * common) <= share * (len(u) + len(v)))
                if near[-1]:
                    rest = np.ones(len(v), bool)
                    rest[at[shared]] = False
                    change.append(np.concatenate([u[~shared], v[rest]]).view(np.int64))
                else:
                    change.append(None)
            columns = [pa.array(na, pa.int32()), pa.array(nb, pa.int32()), pa.array(link, pa.bool_()), pa.array(near, pa.bool_()), pa.array(change, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["a", "b", "na", "nb", "link", "near", "change"])

    return _both(candidates, sets).mapInArrow(tidy(run), "a long, b long, na int, nb int, link boolean, near boolean, change array<long>")


def linked(candidates: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """The pairs of ``candidates`` whose sets, of the table ``sets``, link by their exact intersections."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs_ = ((_unpack(x.as_py()), _unpack(y.as_py())) for x, y in zip(batch.column(2), batch.column(3), strict=True))
            ok = [_links(len(u), len(v), int(np.count_nonzero(_shared(u, v)[1])), percent) for u, v in pairs_]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return table(_both(candidates, sets).mapInArrow(tidy(run), "a long, b long"))


def centres(entries: DataFrame) -> DataFrame:
    """(sid, centre): for each set, the one that leads most of its lists among sets of about its size.

    A block of a list is led by the set with the largest part of its prefix
    listed: in a group of near copies that is the text the others were made
    from, for their changes are listed nowhere.
    """
    share = F.col("k") / F.expr("n - ceil(n * 4 / 5D) + 1")
    size = F.log("n") / math.log(CLASS_RATIO)
    # two ways to cut sizes, so that sets on either side of one bound meet in the other
    bucket = F.explode(F.array(2 * F.floor(size), 2 * F.floor(size + 0.5) + 1))
    placed = entries.select("token", "sid", bucket.alias("bucket"), F.struct((-share).alias("share"), "n", "sid").alias("rank"))
    lead = placed.groupBy("token", "bucket").agg(F.min("rank").alias("lead"), F.count("*").alias("m")).filter("m > 1")
    met = placed.join(lead, ["token", "bucket"]).groupBy("sid", F.col("lead.sid").alias("centre")).agg(F.count("*").alias("times"), F.min("lead.share").alias("share"))
    return met.groupBy("sid").agg(F.max_by("centre", F.struct("times", -F.col("share"), "centre")).alias("centre"))


def answered_pairs(groups: DataFrame, percent: int = 80) -> DataFrame:
    """Links (a, b) between sets of one centre that have different labels, derived from what is known of each set and the centre.

    ``groups``: sid, centre, n, label, link (with the centre) and change.  Two
    sets x and y differ by the changes that only one of them has, so they link
    if and only if 9 |cx + cy - 2 (cx and cy)| <= nx + ny: their texts aren't
    looked at again.  Of two labels one set at least, y, doesn't link with the
    centre: 9 cy > nc + ny.  With nx <= nc + cx a link then shares more than 4/9
    of the changes of x; and where x does link with the centre, more than
    cy - ny / 4 of those of y, and at least one.  So a prefix of each set's
    changes, those that few of the group's sets have first, finds all its
    partners; changes that no other set has take a place but make no list.  At
    ``percent`` p instead of 80, p / (100 + p) stands for 4/9, (100 - p) / p for
    1/4 and (100 + p) / (100 - p) for 9.
    """
    k = F.size("change")
    differ, whole = 100 - percent, 100 + percent
    part = F.floor(k * percent / whole) + 1
    least = F.when(F.col("link"), part).otherwise(F.greatest(F.lit(1), F.least(part, k - F.floor(F.col("n") * differ / percent)))).cast("int")
    held = groups.filter(k > 0).select("sid", "centre", "n", "label", k.alias("k"), (k - least + 1).alias("prefix"), F.explode("change").alias("token"))
    shared = held.groupBy("centre", "token").agg(F.count("*").alias("m")).filter("m > 1")
    ranked = held.join(shared, ["centre", "token"], "left").withColumn("pos", F.row_number().over(Window.partitionBy("sid").orderBy(F.coalesce("m", F.lit(1)), "token")) - 1)
    entries = table(ranked.filter("pos < prefix and m > 1").drop("prefix", "m"))
    x, y = entries.alias("x"), entries.alias("y")
    need = whole * (F.col("x.k") + F.col("y.k")) - differ * (F.col("x.n") + F.col("y.n"))
    left = F.least(F.col("x.k") - F.col("x.pos"), F.col("y.k") - F.col("y.pos"))
    on = (F.col("x.centre") == F.col("y.centre")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.sid") < F.col("y.sid")) & (F.col("x.label") != F.col("y.label")) & (2 * whole * left >= need)
    maybe = x.join(y, on).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()
    own = groups.select("sid", "n", "change")
    both = maybe.join(own.toDF("a", "na", "ca"), "a").join(own.toDF("b", "nb", "cb"), "b")
    common = F.size(F.array_intersect("ca", "cb"))
    return table(both.filter(whole * (F.size("ca") + F.size("cb") - 2 * common) <= differ * (F.col("na") + F.col("nb"))).select("a", "b"))


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(sid, label): the least id that links reach from each set of ``edges``.

    Each round takes the least label of the neighbours and then the label of
    that label, until nothing changes, or for ``rounds`` rounds; then equal
    labels still mean connected sets.
    """
    both = table(edges.union(edges.select("b", "a")).toDF("sid", "other").distinct())
    labels = table(both.groupBy("sid").agg(F.least(F.col("sid"), F.min("other")).alias("label")))
    done = 1
    while rounds is None or done < rounds:
        near = both.join(labels.toDF("other", "theirs"), "other").groupBy("sid").agg(F.min("theirs").alias("theirs"))
        step = labels.join(near, "sid").select("sid", "label", F.least("label", "theirs").alias("least"))
        jump = labels.toDF("least", "further")
        fresh = table(step.join(jump, "least", "left").select("sid", F.least("least", F.coalesce("further", "least")).alias("fresh"), "label"))
        changed = fresh.filter("fresh <> label").limit(1).count()
        labels = fresh.select("sid", F.col("fresh").alias("label"))
        done += 1
        if not changed:
            break
    return labels

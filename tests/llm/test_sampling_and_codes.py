"""Operators 11 to 13 against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from samples import edited, sentence

from veriframe.llm import importance, kernel, minhash_dedup, vector_codes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- 11 ---------------------------------------------------------------------------


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def groups(rows):
    sets = [grams(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        least = min(ids, default=None) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), least, r[0] == least))
    return sorted(out, key=repr)


def found(frame):
    return sorted(map(tuple, minhash_dedup.near_duplicates(frame).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_near_duplicates(docs, rows):
    assert found(docs) == groups(rows)


def test_large_groups_and_their_outliers(spark):
    rng = random.Random(3)
    base = sentence(7, 150)
    rows = []
    for i in range(160):
        text = base
        for _ in range(rng.choice([0, 1, 2, 3, 6, 12])):
            text = edited(text, rng.randrange(150))
        rows.append((i, text))
    rows += [(1000 + i, sentence(1000 + i, 60) + " " + sentence(5, 40)) for i in range(60)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == groups(rows)


def test_no_pairs_within_a_group_are_listed(spark):
    rows = [(b, s, 100, 1 if s < 90 else s, 1 if s < 90 else s) for b in range(3) for s in range(100)]
    got = minhash_dedup.odd_pairs(spark.createDataFrame(rows, "bucket long, sid long, n int, label long, centre long")).collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for a in range(100) for b in range(max(a + 1, 90), 100)}


def test_very_long_text(spark):
    text = sentence(3, 260_000)
    assert len(text) > kernel.CHUNK_BYTES
    rows = [(1, text), (2, edited(text, 100_000)), (3, text[:-4000]), (4, "short one here")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == groups(rows)


def test_minima_are_least_hashes():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 90_000, dtype=np.uint64)
    bounds = np.array([0, 3, 3, 80_000, 80_050, 90_000])
    got = minhash_dedup.minima(values, bounds)
    for j in (0, 7, 383):
        hashed = (values ^ minhash_dedup._KEYS[j]) * minhash_dedup._ODD[j]
        assert got[j].tolist() == [int(hashed[a:b].min()) if b > a else 2**64 - 1 for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_bounds_of_the_verification():
    for n in (64, 128, 256):
        m = minhash_dedup.least_matches(n, 0.85)
        tail = lambda k, n=n: sum(math.comb(n + 1, i) * 0.85**i * 0.15 ** (n + 1 - i) for i in range(k + 1))
        assert tail(m) >= minhash_dedup.MISS > tail(m - 1)
    rng = np.random.default_rng(2)
    left = rng.integers(0, 256, (3000, minhash_dedup.SKETCH), dtype=np.uint8)
    right = left.copy()
    share = np.repeat([0.9, 0.85, 0.3], 1000)
    right[rng.random(right.shape) > share[:, None]] += 1
    alive, compared = minhash_dedup.survivors(left, right, 0.85)
    assert set(range(2000)) <= set(alive.tolist()) and not set(range(2000, 3000)) & set(alive.tolist())
    assert compared[0] == 3000 and compared[1] < 2100  # dissimilar pairs go after the first batch


def test_empty_documents(empty):
    assert found(empty) == []


# --- 12 ---------------------------------------------------------------------------


def compressed(rows, parts=16, k=64, rounds=2):
    """rows: (id, vector, label); plain loops over exact integers."""
    kept = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max([len(v) for _, v, _ in kept], default=1) // parts) * parts or parts
    kept = [(i, [max(-(1 << 26), min(1 << 26, x)) for x in v] + [0] * (width - len(v)), g) for i, v, g in kept]
    d = width // parts
    cut = [[v[p * d : p * d + d] for p in range(parts)] for _, v, _ in kept]
    first = {}
    for i, v, x in sorted([(i, v, x) for (i, v, _), x in zip(kept, cut, strict=True) if i is not None], key=lambda r: r[:2]):
        first.setdefault(i, x)
    books = [[x[p] for x in list(first.values())[:k]] or [[0] * d] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((far(x, e), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for x in cut:
                held.setdefault(near(p, x[p])[1], []).append(x[p])
            books[p] = [[sum(c) // len(held[j]) for c in zip(*held[j], strict=True)] if j in held else e for j, e in enumerate(books[p])]
    best = [[near(p, x[p]) for p in range(parts)] for x in cut]
    errors = [sum(e for e, _ in b) for b in best]
    by_label = {}
    for (_, _, g), e in zip(kept, errors, strict=True):
        by_label[g] = by_label.get(g, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{j:02x}" for _, j in b), e, by_label[g], digest) for (i, _, g), b, e in zip(kept, best, errors, strict=True)), key=repr)


def vectors(n, width, seed=1):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(9)]
    return [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centre)], rng.choice([None, 1, 2])) for i in range(n)]


def frame(spark, rows, kind="array<double>"):
    return spark.createDataFrame([(*r, "x", r[0]) for r in rows], f"vec_id long, embedding {kind}, label int, code string, error long").repartition(3)


def test_codes_are_those_of_plain_loops(spark):
    rows = vectors(500, 32)
    rows += [(600, None, 1), (601, [1.0] * 31 + [None], 1), (602, [float("nan")] * 32, 1), (603, [float("inf")] * 32, None), (None, [0.25] * 32, 2), (3, rows[3][1], 1), (3, rows[3][1], 1), (700, [0.5] * 20, None), (701, [1e30, -1e30] * 16, 1)]
    assert sorted(map(tuple, vector_codes.vector_codes(frame(spark, rows)).collect()), key=repr) == compressed(rows)


def test_one_vector_has_most_rows(spark):
    rows = vectors(80, 16) + [(1000 + i, [0.5] * 16, 7) for i in range(400)]
    assert sorted(map(tuple, vector_codes.vector_codes(frame(spark, rows)).collect()), key=repr) == compressed(rows)


def test_few_and_no_vectors(spark):
    rows = vectors(5, 16)
    assert sorted(map(tuple, vector_codes.vector_codes(frame(spark, rows)).collect()), key=repr) == compressed(rows)
    assert vector_codes.vector_codes(frame(spark, rows).limit(0)).count() == 0
    unnamed = [(None, v, g) for _, v, g in rows]
    assert sorted(map(tuple, vector_codes.vector_codes(frame(spark, unnamed)).collect()), key=repr) == compressed(unnamed)


def test_neighbours_on_the_curve():
    points = np.array(list(itertools.product(range(16), repeat=2)), np.int64)
    order = points[np.argsort(vector_codes.hilbert_keys(points))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_hold_all_that_is_nearest():
    rng = np.random.default_rng(5)
    parts = rng.integers(-300, 300, (20_000, 4))
    entries = rng.integers(-300, 300, (64, 4))
    blocks = vector_codes.Blocks.of(parts)
    able = vector_codes.shortlists(blocks.low, blocks.high, entries)
    code, error = vector_codes.block_codes(blocks, entries)
    distance = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (code == distance.argmin(axis=1)).all() and (error == distance.min(axis=1)).all()
    assert able.mean() < 0.5
    sums, counts = vector_codes.block_sums(blocks, entries)
    assert (counts == np.bincount(code, minlength=64)).all() and (sums == np.array([parts[code == j].sum(axis=0) for j in range(64)])).all()


# --- 13 ---------------------------------------------------------------------------


def drawn(rows, target, percent=10, least=20, n_grams=1, buckets=10_000, seed=2024):
    def feats(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [" ".join(w[i : i + k]) for k in range(1, n_grams + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for r in rows:
        for f in feats(r[1])[1]:
            s[bucket(f)] += 1
    for text in target:
        for f in feats(text)[1]:
            t[bucket(f)] += 1
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    out = []
    for doc_id, text, *_ in rows:
        words, fs = feats(text)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least))
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    ranks = {}
    for i, x in enumerate(able[: percent * len(able) // 100]):
        ranks.setdefault(x, []).append(i + 1)
    return sorted(((*x[:4], ranks[x].pop() if ranks.get(x) else None) for x in out), key=repr)


def test_draw(spark, docs, rows):
    target = ["stone lamp GREEN quiet river", "", None, "lamp-lamp é1"]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for percent, n_grams in ((10, 1), (60, 2), (100, 3)):
        got = importance.resampled(docs, texts, percent=percent, grams=n_grams).collect()
        assert sorted(map(tuple, got), key=repr) == drawn(rows, target, percent, n_grams=n_grams)


def test_rows_of_one_id_share_the_cutoff(spark):
    rows = [(7, sentence(1, 30))] * 50 + [(i, sentence(i, 25)) for i in range(20)]
    got = importance.resampled(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([("stone",)], "text string"), percent=50).collect()
    assert sorted(map(tuple, got), key=repr) == drawn(rows, ["stone"], 50)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 36))


def test_drawn_rows_keep_their_columns(spark, docs):
    rows = importance.resampled_rows(docs.filter("doc_id < 10"), docs.select("text"), percent=50)
    assert rows.columns == [*docs.columns, "rank"] and sorted(r["rank"] for r in rows.collect()) == [1, 2, 3]


def test_empty_draw(spark, empty):
    assert importance.resampled(empty, empty).count() == 0


def test_bounds_by_counting(spark):
    values = [random.Random(4).randrange(-(2**62), 2**62) for _ in range(300)] + [5] * 200
    held = spark.createDataFrame([(v,) for v in values], "v long")
    for wanted in (1, 100, 250, 499, 500):
        assert importance.least_bound(held, "v", wanted) == sorted(values)[wanted - 1]
    assert importance.least_bound(held, "v", 501) is None


def test_crc32_of_spans():
    words = ["", "a", "é", "abc" * 40, "x" * 64, "y" * 65, "stone"]
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    assert importance.crc32_spans(raw, ends - np.diff(ends, prepend=0), ends).tolist() == [zlib.crc32(w.encode()) for w in words]


def test_long_text_is_one_document(spark):
    text = sentence(1, 260_000)
    assert len(text) > kernel.CHUNK_BYTES
    got = list(importance.features(pa.array([text, "a b"]), 1, 10))
    assert [n for _, w, _, _ in got for n in w.tolist()] == [260_000, 2]
    assert importance.scored(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([("x",)], "text string")).select(F.sum("n_features")).first()[0] == 260_000

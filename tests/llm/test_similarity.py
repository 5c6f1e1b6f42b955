"""Operators 1, 3 and 9 against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from samples import edited, sentence

from veriframe.llm import decontaminate, jaccard_join, kernel, line_dedup, setjoin

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def grams(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def similar(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def components(rows):
    sets = [grams(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), (min(ids, default=None) if sets[i] else r[0])))
    return out


def test_components(docs, rows):
    got = jaccard_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(components(rows), key=repr)


def test_large_group_of_near_copies(spark):
    base = sentence(7, 120)
    rows = [(i, edited(edited(base, i % 120), (i * 7) % 120)) for i in range(150)] + [(1000 + i, sentence(1000 + i, 60) + " " + sentence(5, 30)) for i in range(60)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(components(rows))


def test_one_of_each_group_stays(docs, rows):
    got = jaccard_join.distinct_documents(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == len(set(kept))
    assert {d for d, _ in kept} == {0, 1, 2, 3, 4, 5, 20, 21, 22, 23, 30, 31, 40, None}


def test_empty_tables(spark, empty):
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert line_dedup.removed_by_document(empty).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(empty, items).count() == 0


def repeated(rows):
    lines = []
    for doc_id, text, *_ in rows:
        for i, line in enumerate((text or "").split("\n")):
            if len(s := set(words(line))) >= line_dedup.MIN_TOKENS:
                lines.append((doc_id is not None, doc_id or 0, i, s, doc_id))
    # repeated rows are one document
    lines = sorted({(x[0], x[1], x[2], frozenset(x[3]), x[4]) for x in lines}, key=lambda x: x[:3])
    return lines, [x for k, x in enumerate(lines) if any(similar(x[3], y[3]) for y in lines[:k])]


def test_later_lines_go(docs, rows):
    rows = [r for r in rows if r[0] is not None]  # the order of texts with equal doc_id is that of a hash
    _, gone = repeated(rows)
    got = line_dedup.repeated_lines(docs.filter("doc_id is not null")).select("doc_id", "line_no").collect()
    assert sorted(map(tuple, got)) == sorted((x[4], x[2]) for x in gone)


def test_lines_of_null_ids_come_first(spark):
    rows = [(1, sentence(1, 12)), (None, sentence(1, 12) + "\n" + sentence(2, 12)), (2, edited(sentence(2, 12), 3) + "\n" + sentence(3, 9))]
    got = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.line_no) for r in got) == [(1, 0), (2, 0)]


def test_texts_over_a_chunk(spark):
    """Texts of more than a chunk of bytes are one set, one text of lines, one document."""
    long = "\n".join(sentence(5000 + i, 40) for i in range(5000))
    assert len(long) > 1 << 20
    rows = [(1, long), (2, long + "\n" + sentence(1, 30)), (3, sentence(5007, 40)), (4, "unlike " + sentence(2, 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(df).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    gone = {(r.doc_id, r.line_no) for r in line_dedup.repeated_lines(df).collect()}
    assert {(2, i) for i in range(5000)} <= gone and (2, 5000) not in gone and (3, 0) in gone and (4, 0) not in gone
    items = spark.createDataFrame([(1, sentence(5007, 40))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contained_items(df, items).collect()} == {1, 2, 3}


def test_blocks_are_passed_over(spark):
    """Of a list's blocks by size only those are joined that length and position allow."""
    rows = [(7, 1000 + i, n, pos, 0, 0) for i, (n, pos) in enumerate([(20, 0), (20, 2), (25, 0), (40, 0), (40, 4), (100, 0), (400, 0)])]
    entries = spark.createDataFrame(rows, "token long, sid long, n int, pos int, sig long, sig2 long")
    probed = {(r.n, r.pos): r.b for r in entries.select("n", "pos", setjoin.blocks_probed(entries["n"], entries["pos"]).alias("b")).collect()}
    held = {r.c for r in entries.select(setjoin.size_class(entries["n"]).alias("c")).collect()}
    assert len(held) == 5 and all(len(held - set(b)) >= 3 for b in probed.values())
    assert len(probed[20, 0]) > len(probed[20, 2]) and len(probed[40, 0]) > len(probed[40, 4])
    every = {(a[1], b[1]) for a in rows for b in rows if (a[2], a[1]) < (b[2], b[1]) and 5 * a[2] >= 4 * b[2] and 9 * min(a[2] - a[3], b[2] - b[3]) >= 4 * (a[2] + b[2])}
    assert {(r.a, r.b) for r in setjoin.block_pairs(entries, lambda x, y: F.lit(True)).collect()} == every


def test_answers_come_from_the_centre(spark):
    """Sets near one centre are told apart by their changes alone, as by the sets themselves."""
    draw = random.Random(4)
    centre = set(range(200))
    sets = [centre]
    for i in range(120):
        own = set(sets[draw.randrange(len(sets))])  # copies of copies
        for _ in range(draw.randint(2, 12)):
            own.discard(draw.choice(sorted(own)))
            own.add(draw.choice([1000 + 100 * i + draw.randint(0, 99), 500 + draw.randint(0, 20)]))
        sets.append(own)
    links = lambda a, b: 9 * len(a ^ b) <= len(a) + len(b)
    rows = [(i, 0, len(s), 0 if links(s, centre) else i, links(s, centre), sorted(s ^ centre)) for i, s in enumerate(sets) if i and 9 * len(s ^ centre) <= 2 * (len(s) + len(centre))]
    got = {(r.a, r.b) for r in setjoin.answered_pairs(spark.createDataFrame(rows, "sid long, centre long, n int, label long, link boolean, change array<long>")).collect()}
    expected = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[3] != b[3] and links(sets[a[0]], sets[b[0]])}
    assert got == expected and len(expected) > 50


def test_recall_of_the_sketches(spark):
    """Items of 16 to 200 shingles, contained by 0.8 to 0.9, in documents of up to 6,000 words: measured recall is 1."""
    docs, items, expected = [], [], set()
    for i in range(150):
        n = 20 + (i * 37) % 180
        words_ = sentence(9000 + i, n).split(" ")
        changed = list(words_)
        step = max(28, n // (1 + i % 3))
        for at in range(n // 2, n, step):
            changed[at] = f"new{i}x{at}"
        docs.append((i, sentence(20_000 + i, 50 + (i * 97) % 6000) + " " + " ".join(changed) + " " + sentence(30_000 + i, 300)))
        items.append((i, " ".join(words_)))
        q = grams(items[-1][1])
        if 100 * len(q & grams(docs[-1][1])) >= 80 * len(q):
            expected.add((i, i))
    got = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert len(expected) > 80 and expected <= found and all(a == b for a, b in found)


def test_texts_without_later_lines(docs, rows):
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[20].text is None and by_id[21].text == "" and by_id[22].text == " \n\t " and by_id[10].text == ""
    assert by_id[31].text == "short" and by_id[31].ids == [0] and by_id[31].tid == "x"


def test_contained_items(spark, docs, rows):
    items = [(1, sentence(40, 30)), (2, " ".join(rows[1][1].split(" ")[10:40])), (3, edited(" ".join(rows[2][1].split(" ")[5:60]), 50)), (4, None), (5, ""), (6, "one two"), (7, "river"), (8, " ".join(sentence(99, 6000).split(" ")[3000:3012])), (None, rows[5][1]), (2, " ".join(rows[1][1].split(" ")[10:40]))]
    expected = set()
    for item_id, text in items:
        q = grams(text)
        expected |= {(r[0], item_id, len(q), len(q & grams(r[1]))) for r in rows if q and 100 * len(q & grams(r[1])) >= 80 * len(q)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contained_items(docs, bench).select("doc_id", "item_id", "n_item", "n_common").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    clean = decontaminate.clean_documents(docs, bench)
    bad = {x[0] for x in expected}
    assert clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((r[0] for r in rows if r[0] not in bad), key=repr)


def test_many_near_copies_of_a_line(spark):
    base = sentence(7, 40)
    rows = [(i, edited(base, i % 40) + "\n" + sentence(2000 + i, 12)) for i in range(60)] + [(100 + i, edited(edited(edited(base, i), i + 9), i + 20)) for i in range(15)]
    _, gone = repeated(rows)
    got = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "line_no").collect()
    assert sorted(map(tuple, got)) == sorted((x[4], x[2]) for x in gone)


def test_short_lines_in_the_pipeline(spark):
    import corpus_pipeline

    texts = ["read more\nHome About\n" + sentence(1, 12), "Read  more\na b c d\n-- Ann\n" + sentence(2, 12), "about home\na b c d e\n-- ann\n-- Ann Lee\nx", "x x x\na b d c\nread\n\nh i j k l\nh i j k"]
    rows = list(enumerate(texts))
    lines, seen = [], []
    for doc_id, text in rows:
        kept = []
        for line in text.split("\n"):
            own = set(words(line))
            if not any(similar(own, x) for x in seen):
                kept.append(line)
            seen.append(own)
        if words(text := "\n".join(kept)):
            lines.append((doc_id, text))
    got = corpus_pipeline.lines(spark, spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, n_chars long"), "")
    assert sorted((r.doc_id, r.text) for r in got.collect()) == lines
    assert lines[2][1] == "-- Ann Lee\nx"


def test_folded_signatures_never_exceed_the_difference(spark):
    draw = np.random.default_rng(8)
    base = draw.integers(0, 1 << 63, 260, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: n - k], draw.integers(0, 1 << 63, k, dtype=np.uint64)])) for n in (1, 5, 40, 95, 96, 97, 98, 120, 250) for k in (0, 1, n // 3)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    sig, sig2 = (x.tolist() for x in setjoin.signatures(np.concatenate(sets), bounds))
    rows = [(i, len(x), a, b) for i, (x, a, b) in enumerate(zip(sets, sig, sig2, strict=True))]
    whole = spark.createDataFrame(rows, "i int, n int, sig long, sig2 long")
    packed = whole.select("i", *setjoin.folded(F.col("n"), F.col("sig"), F.col("sig2")))
    assert all((r.sig2 is None) == (len(sets[r.i]) <= setjoin.FOLDED) for r in packed.collect())
    full = {(r.a, r.b): r.d for r in whole.alias("x").crossJoin(whole.alias("y")).select(F.col("x.i").alias("a"), F.col("y.i").alias("b"), setjoin.signature_distance("x", "y").alias("d")).collect()}
    for r in packed.alias("x").crossJoin(packed.alias("y")).select(F.col("x.i").alias("a"), F.col("y.i").alias("b"), setjoin.folded_distance("x", "y").alias("d")).collect():
        u, v = sets[r.a], sets[r.b]
        assert r.d <= full[r.a, r.b] <= len(np.setxor1d(u, v))
        assert r.d == full[r.a, r.b] or min(len(u), len(v)) <= setjoin.FOLDED


def test_only_chosen_lines_are_cut_into_sets():
    """The sets of candidates come from their own lines; the other lines of their texts are passed over."""
    texts = ["\n".join(sentence(50 * i + j, 9) for j in range(40)) for i in range(3)] + [None, "", "a\n\nb " + "w" * 200]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array([7 << 50, -5, 1 << 62, 4, 9, -(1 << 61)], pa.int64()), pa.array(texts)], names=["doc_id", "tid", "text"])
    every = {(key[1][i].as_py(), key[2][i].as_py()): set(values[at[i] : at[i + 1]].tolist()) for key, values, at in line_dedup.line_sets(1)(batch) for i in range(len(at) - 1)}
    wanted = [(7 << 50, 3), (7 << 50, 39), (1 << 62, 0), (-(1 << 61), 2)]
    held = setjoin.IdFilter(20)
    tids, numbers = (np.array(x) for x in zip(*wanted, strict=True))
    flags = np.zeros(1 << 20, bool)
    flags[(line_dedup._line_keys(tids, numbers) >> np.uint64(44)).astype(np.int64)] = True
    held.held[:] = np.packbits(flags, bitorder="little")
    got = [set(values[at[i] : at[i + 1]].tolist()) for _, values, at in line_dedup.chosen_sets(1)(batch, held) for i in range(len(at) - 1)]
    assert got == [every[x] for x in wanted]
    assert len(every) == 122


def test_line_keys_agree(spark):
    rows = [(t, n) for t in (0, 5, -5, (1 << 63) - 1, -(1 << 63)) for n in (0, 1, 77, (1 << 31) - 1)]
    got = [r.k for r in spark.createDataFrame(rows, "tid long, n int").select(line_dedup.line_key(F.col("tid"), F.col("n")).alias("k")).collect()]
    assert got == line_dedup._line_keys(*(np.array(x) for x in zip(*rows, strict=True))).view(np.int64).tolist()


def test_word_hashes():
    some = sorted({"x" * k for k in range(1, 140)} | {"x" * k + "y" for k in range(140)} | {"y" + "x" * k for k in range(140)} | {"x\0", "\0x", "\0"})
    first = None
    for text in (" ".join(some), "ab " + " ".join(reversed(some)) + " c"):
        raw = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _ = kernel.words(raw, np.array([0, len(raw)]))
        found = dict(zip((text[a:b] for a, b in zip(starts, ends, strict=True)), kernel.word_hash(raw, starts, ends).tolist(), strict=True))
        assert len(set(found.values())) == len(found)
        first = first or [found[k] for k in some]
        assert [found[k] for k in some] == first


def test_later_entries_do_not_meet(spark):
    """Every link is found though entries behind a ninth of their set are joined with early ones of smaller sets only."""
    draw = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = draw.choice(200, draw.integers(4, 60), replace=False)
        sets += [np.unique(np.concatenate([base[draw.random(len(base)) > share], draw.choice(200, 2)])) for share in (0, 0.05, 0.1, 0.2)]
    values = [np.sort(kernel.mix(np.asarray(x, np.uint64))) for x in sets]
    sig, sig2 = setjoin.signatures(np.concatenate(values), np.concatenate([[0], np.cumsum([len(x) for x in values])]))
    rows = [(int(t), i, len(x), int(sig[i]), int(sig2[i]), p) for i, x in enumerate(values) for p, t in enumerate(x.view(np.int64)) if p < len(x) + (-4 * len(x)) // 5 + 1]
    df = spark.createDataFrame(rows, "token long, id long, n int, sig long, sig2 long, pos int")
    entries = df.select("token", "id", *setjoin.folded(F.col("n"), F.col("sig"), F.col("sig2")), setjoin.sized(F.col("n"), F.col("pos"), F.lit(False)).alias("meta"))
    found = setjoin.pairs(entries, lambda x, y: F.lit(True))
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 10 * len(both := set(sets[i]) & set(sets[j])) >= 8 * (len(sets[i]) + len(sets[j]) - len(both))}
    assert len(links) > 60 and links <= {(r.a, r.b) for r in found.select("a", "b").collect()}

"""Operators 6, 8 and 10 against the tokenizer libraries."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from veriframe.llm import bpe_replay, pretoken, token_counts, token_store, vocabulary

PARTS = ["a", "b", "'s", "'t", "'re", "'ll", "'", "''", " ", "  ", "\n", "\t", "\xa0", "1", "23", "é", "É", "ΑΣ", "İ", "漢字", "🙂", "́", "!", "?!", "<|endoftext|>", "<|startoftext|>", "don't", "I'll", "THE", "\x1c", "\x85", "²", "-", "​", "\r\n", "ſ", "\U0010ffff", "\ufffe", "\ue000"]
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(400)] + [None, "", " ", "aaaaaaaaaaab" * 40, "x y " * 3000]


@pytest.fixture(scope="module")
def odd(spark, texts):
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "a null id", 1), (3, texts[3], 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)


def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_split_is_the_pattern(texts):
    pattern = regex.compile(public_tokenizers.PATTERN)
    for first, joined, cp, bounds in pretoken.texts(pa.array(texts)):
        starts, ends = pretoken.split(cp, bounds, "spaced")
        at = np.searchsorted(starts, bounds)
        for i in range(len(bounds) - 1):
            assert [joined[a:b] for a, b in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]], strict=True)] == pattern.findall(texts[first + i] or "")


@pytest.mark.parametrize("head", [0, 20, vocabulary.HEAD_WORDS])
def test_encode_and_decode(odd, texts, head):
    encoded = bpe_replay.encode(odd, RANKS, head_words=head)
    assert encoded.columns == odd.columns
    decoded = bpe_replay.decode(encoded, RANKS)
    own = library()
    expected = {(i, t): own.encode_ordinary(t or "") for i, t in [*enumerate(texts), (None, "a null id")]}
    got = decoded.collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert r.ids == expected[r.doc_id, r.text] and bytes(r.decoded) == (r.text or "").encode()
    for r in bpe_replay.digests(decoded).collect():
        ids = expected[r.doc_id, texts[r.doc_id] if r.doc_id is not None else "a null id"]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


@pytest.mark.parametrize("head", [0, 20, vocabulary.HEAD_WORDS])
def test_token_counts(odd, texts, head):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    got = token_counts.token_counts(odd, path, head_words=head).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = ("a null id" if r.doc_id is None else texts[r.doc_id]) or ""
        n = len(own.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 2048), t[:80]


def test_store(spark, odd, texts, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    where = f"file://{tmp_path}/store"
    token_store.write_store(odd, where, path)
    read = token_store.read_store(spark, where)
    rows = sorted([*enumerate(texts), (3, texts[3])], key=lambda x: x[0])
    rows = [(None, "a null id"), *rows]
    start, expected = 0, []
    for i, t in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids + [0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_store.with_crc32(read).collect()), key=lambda r: r[1]) == expected
    block = spark.read.parquet(f"{where}/data").filter("array_contains(doc_ids, 3)").first()
    assert block.dict_sha256 == hashlib.sha256(bytes(spark.read.parquet(f"{where}/dictionary").first().content)).hexdigest()
    assert len(block.offsets) == len(block.doc_ids) + 1


def test_one_document_costs_one_frame(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_DOCS", 10)
    path, where = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/store"
    own = Tokenizer.from_file(path)
    rows = [(i, f"text number {i} " + "word " * (i % 7)) for i in range(0, 600, 2)] + [(40, "another of this id"), (40, "another of this id")]
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), where, path, shards=3)
    opened = spark.sparkContext.accumulator(0)
    got = token_store.read_documents(spark, where, [40, 41, 598, 9999], opened)
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == sorted((i, own.encode(t, add_special_tokens=False).ids + [0]) for i, t in rows if i in (40, 598))
    assert opened.value == 4
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = token_store.read_documents(spark, where, [40])._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^]]*LessThanOrEqual\(first_id,40\)", plan) and re.search(r"GreaterThanOrEqual\(last_id,40\)", plan)
    assert token_store.read_documents(spark, where, []).count() == 0
    many = token_store.read_documents(spark, where, range(100, 300))
    assert sorted(r.doc_id for r in many.collect()) == list(range(100, 300, 2))


def test_repeated_rows_are_sampled_once(spark, tmp_path):
    path, where = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/store"
    one = spark.createDataFrame([(1, "all rows are this one")], "doc_id long, text string")
    token_store.write_store(one.join(spark.range(5000)).select("doc_id", "text"), where, path)
    assert len(bytes(spark.read.parquet(f"{where}/dictionary").first().content)) < 100
    assert token_store.read_store(spark, where).count() == 5000


def test_empty_tables(spark, odd, tmp_path):
    none = odd.limit(0)
    assert bpe_replay.decode(bpe_replay.encode(none, RANKS), RANKS).count() == 0
    assert token_counts.token_counts(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    token_store.write_store(none, f"file://{tmp_path}/none", public_tokenizers.path("byte_bpe_50k.json"))
    assert token_store.read_store(spark, f"file://{tmp_path}/none").count() == 0


def test_replay_takes_lower_ranks_first():
    with open(RANKS, "rb") as f:
        ranks = bpe_replay.Ranks(f.read())
    own, draw = library(), random.Random(9)
    words = ["".join(draw.choice("abehlnorst") for _ in range(draw.randint(1, 40))) for _ in range(3000)] + ["a" * n for n in range(1, 60)]
    assert ranks.replay(words) == [own.encode_ordinary(w) for w in words]


def test_tokens_stage_holds_one_python_worker_a_task(spark, odd, texts):
    docs = odd.drop("ids").withColumn("decoded", F.lit("their own"))
    staged = corpus_pipeline.tokens(spark, docs, "")
    assert len(re.findall(r"MapInArrow", staged._jdf.queryExecution().optimizedPlan().toString())) == 1
    own = library()
    got = staged.collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert r.ids == own.encode_ordinary(r.text or "") and r.decoded == "their own" and r.round_trip == (None if r.text is None else True)


def test_tasks_of_the_tokens_stage_give_back_memory(spark, odd, monkeypatch):
    tidied = []
    monkeypatch.setattr(bpe_replay, "tidy", lambda run: tidied.append(run) or run)
    monkeypatch.setattr(vocabulary, "tidy", lambda run: tidied.append(run) or run)
    bpe_replay.encode(odd, RANKS)
    assert len(tidied) == 3


def test_growing_words_keep_their_places():
    draw = np.random.default_rng(4)
    keys = np.unique(draw.integers(0, 1 << 63, 5000, dtype=np.uint64)) << np.uint64(1)
    keys = np.concatenate([keys, np.uint64(7) + np.arange(300, dtype=np.uint64), np.uint64((1 << 64) - 1) - np.arange(300, dtype=np.uint64) * np.uint64(2)])  # many of one slot, the last slot too
    draw.shuffle(keys)
    values = [list(range(i % 5)) for i in range(len(keys))]
    table = pretoken.GrowingWords(least_slots=4)
    places = []
    for a in range(0, len(keys), 700):
        assert not table.find(keys[a:])[1].any()
        table.add(keys[a : a + 700], values[a : a + 700])
        at, found = table.find(keys[: a + 700])
        assert found.all()
        places.append(at[:700].tolist())
    assert all(p == places[0] for p in places)
    flat, bounds = table.gather(table.find(keys)[0])
    assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == values
    assert pretoken.GrowingWords().find(keys)[1].sum() == 0

"""The pipeline against a chain of brute-force stages."""

import base64

import public_tokenizers
import pytest
import tiktoken
from samples import edited, sentence
from test_similarity import grams, similar, words

import corpus_pipeline
from veriframe.llm import quality_rules


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = [sentence(600 + i, 70) for i in range(30)]
    rows = [(i, t, "en", "a") for i, t in enumerate(base)]
    rows += [(100, base[0] + " tail", "en", "b"), (101, edited(base[1], 5), "en", "b"), (102, base[2], "en", "b"), (103, base[3] + "\n" + sentence(5, 60), "fr", "b")]
    rows += [(104, "read more\n" + sentence(40, 80) + "\nread  more\n" + sentence(41, 12), "en", "c"), (105, "Read more\n" + sentence(42, 80), "en", "c"), (106, sentence(43, 60) + " " + sentence(990, 30) + " " + sentence(44, 40), "en", None)]
    rows += [(200, None, "en", "a"), (201, "", None, "a"), (202, " \n ", "en", "a"), (203, "too short", "en", "a"), (204, "a b c " * 40, "en", "a"), (None, sentence(45, 70), "en", "a"), (5, base[5], "en", "a")]
    at = tmp_path_factory.mktemp("sf")
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], columns).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, sentence(990, 30)), (2, "absent words only here"), (3, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return f"file://{at}"


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder).collect()

    # the verdicts of the first stage have a brute-force test of their own
    kept = {(r.doc_id, r.n_words, r.word_chars) for r in quality_rules.quality(docs).collect() if r.kept}
    rows = [r for r in docs.collect() if (r.doc_id, len(words(r.text)), sum(len(w) for w in (r.text or "").split())) in kept]
    order = lambda r: (r.doc_id is not None, r.doc_id or 0)
    seen, second = [], []
    for r in sorted({(x.doc_id, x.text) for x in rows}, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = []
        for line in r[1].split("\n"):
            own = set(words(line))
            if not any(similar(own, x) for x in seen):
                lines.append(line)
            seen.append(own)
        if words("\n".join(lines)):
            second.append((r[0], "\n".join(lines)))
    third = []
    groups = list(range(len(second)))
    sets = [grams(t) for _, t in second]
    for i in range(len(second)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = groups[i], groups[j]
                groups = [b if g == a else g for g in groups]
    for g in dict.fromkeys(groups):
        third.append(min((r for r, own in zip(second, groups, strict=True) if own == g), key=lambda r: (r[0] is None, r[0] or 0)))
    items = [q for q in (grams(sentence(990, 30)), grams("absent words only here")) if q]
    fourth = [r for r in third if not any(100 * len(q & grams(r[1])) >= 80 * len(q) for q in items)]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {(i, t): own.encode_ordinary(t) for i, t in fourth}
    assert {(r.doc_id, r.text): r.ids for r in got} == expected and len(got) == len(expected)
    assert all(r.round_trip and r.n_tokens == len(r.ids) and r.n_chars == len(r.text) for r in got)
    assert 106 not in {r.doc_id for r in got} and {r.doc_id for r in got} >= {4, 6, 7, 8} and len({order(r) for r in got}) == len(got)


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS tid", "'x' AS key", "array(1L) AS tid_")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert stage and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0

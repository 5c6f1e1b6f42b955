"""The registered queries of this folder, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_replay, decontaminate, html_templates, importance, jaccard_join, line_dedup, minhash_dedup, quality_rules, secret_scan, token_counts, token_store, vector_codes, warc_revisit
from .common import documents, shared_folder


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _components_sql(k: int, percent: int, more: str = "") -> str:
    return rf"""
WITH RECURSIVE low AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT doc_id, {_WORDS} AS w FROM low),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+{k - 1}], ' ') FOR i IN range(1, len(w) - {k - 2})]) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c
  FROM items x JOIN items y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * x.n >= {percent} * y.n AND 100 * y.n >= {percent} * x.n GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * c >= {percent} * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CAST(m.c AS BIGINT) AS component_id{more}
FROM sets s JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY 1) m ON s.doc_id = m.doc_id
"""


OP1_SQL = _components_sql(5, 80)


def op2_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc_revisit.resolve_revisits(page_captures(documents(spark, sf_dir, "pages")))
    return resolved.select(
        F.col("record_id").alias("revisit_id"), "canonical_url", "outcome", "target_id", F.col("status").cast("long").alias("status"), "payload_digest",
        *(F.col("headers")[k].alias(k.replace("-", "_")) for k in ("etag", "content-length", "date")),
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """WARC records of a crawl of ``pages``: each page is answered in full, and asked again 41 ticks later with its own ETag."""
    digest = F.md5(F.coalesce("html", F.lit("")))
    etag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    full = pages.select(
        (2 * F.col("page_id")).alias("record_id"), "url", (2 * F.col("page_id")).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
        F.create_map(F.lit("etag"), etag, F.lit("content-length"), F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("date"), (2 * F.col("page_id")).cast("string")).alias("headers"),
        digest.alias("payload_digest"),
    )
    again = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), "url", (2 * F.col("page_id") + 41).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.create_map(F.lit("etag"), F.concat(F.lit("W/"), etag), F.lit("content-length"), F.lit("0"), F.lit("date"), (2 * F.col("page_id") + 41).cast("string")).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"),
    )
    return full.unionByName(again)


_BARE = "regexp_replace(trim(url), '#.*$', '')"
_SITE = rf"regexp_replace(lower(regexp_extract({_BARE}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)), '^(http://.*):80$|^(https://.*):443$', '\1\2')"
_REST = rf"regexp_replace({_BARE}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '')"
OP2_SQL = rf"""
WITH parts AS (
  SELECT page_id, html, {_SITE} AS site, regexp_extract({_REST}, '^([^?]*)', 1) AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract({_REST}, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') AS q FROM pages),
captures AS (
  SELECT page_id, site || CASE WHEN path = '' AND site <> '' THEN '/' ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical,
    md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS n FROM parts),
found AS (
  SELECT r.page_id, r.canonical, r.digest AS own, max(f.page_id) AS target
  FROM captures r LEFT JOIN captures f ON f.canonical = r.canonical AND (2 * f.page_id, 2 * f.page_id) < (2 * r.page_id + 41, 2 * r.page_id + 1) GROUP BY ALL),
checked AS (
  SELECT found.*, t.digest, t.n, CASE WHEN target IS NULL THEN 'no_earlier_response' WHEN left(own, 16) = left(t.digest, 16) THEN 'resolved' ELSE 'validator_mismatch' END AS outcome
  FROM found LEFT JOIN captures t ON t.page_id = target)
SELECT 2 * page_id + 1 AS revisit_id, canonical AS canonical_url, outcome,
  CASE WHEN outcome = 'resolved' THEN 2 * target END AS target_id, CASE WHEN outcome = 'resolved' THEN CAST(200 AS BIGINT) END AS status,
  CASE WHEN outcome = 'resolved' THEN digest END AS payload_digest, CASE WHEN outcome = 'resolved' THEN 'W/"' || left(own, 16) || '"' END AS etag,
  CASE WHEN outcome = 'resolved' THEN CAST(n AS VARCHAR) END AS content_length, CASE WHEN outcome = 'resolved' THEN CAST(2 * page_id + 41 AS VARCHAR) END AS date
FROM checked
"""


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_common")


def _gram_sets(table: str, key: str) -> str:
    return rf"""
  SELECT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END) AS g
  FROM (SELECT {key}, {_WORDS} AS w FROM (
    SELECT {key}, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM {table}))"""


OP3_SQL = f"""
WITH items AS ({_gram_sets("benchmark", "item_id")}), docs AS ({_gram_sets("documents", "doc_id")}),
sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY 1),
common AS (SELECT doc_id, item_id, count(*) AS n_common FROM docs JOIN items USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_common FROM common JOIN sizes USING (item_id) WHERE 100 * n_common >= 80 * n_item
"""


def op4_html_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_templates.extract_main_text(documents(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(secret_scan.secret_spans(documents(spark, sf_dir)))


def _span_sql() -> str:
    rows = []
    for number, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("'", "''")
        rows.append(f"""
  SELECT doc_id, {number} AS number, '{rule.kind}' AS kind, list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i-1]]), 0) AS s, length(m[i]) AS n
  FROM (SELECT doc_id, m, g, gaps, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS g, regexp_split_to_array(text, '{pattern}') AS gaps FROM texts))
  WHERE length(g[i]) >= {rule.least}""")
    return " UNION ALL ".join(rows)


OP5_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({_span_sql()}),
named AS (SELECT doc_id, number, CAST(s AS BIGINT) AS s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS x FROM spans)
SELECT t.doc_id, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
  sha256(coalesce(string_agg(x, ',' ORDER BY s, number) FILTER (number < {len(secret_scan.BASE)}), '')) AS base_sha256,
  coalesce(string_agg(x, ',' ORDER BY s, number), '') AS spans
FROM texts t LEFT JOIN named USING (doc_id) GROUP BY 1
"""


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_replay.digests(bpe_replay.encode(documents(spark, sf_dir), path, keep=["doc_id"], decoded="decoded"))


def op7_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def _line_count(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    slim = docs.select("doc_id", "text")
    removed = line_dedup.removed_by_document(docs)
    sizes = slim.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), _line_count(F.coalesce("text", F.lit(""))).alias("n_lines")).alias("d")
    r = removed.alias("r")
    on = (F.col("d.tid") == F.col("r.tid")) & F.col("d.doc_id").eqNullSafe(F.col("r.doc_id"))
    lost = F.coalesce("r.removed_lines", F.array().cast("array<int>"))
    return sizes.join(r, on, "left").select("d.doc_id", "d.n_lines", F.size(lost).cast("long").alias("n_removed"), F.array_join(lost.cast("array<string>"), ",").alias("removed_lines"))


OP9_SQL = rf"""
WITH cut AS (SELECT doc_id, string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS ls FROM documents),
each AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM cut)),
sets AS (SELECT doc_id, line_no, list_distinct({_WORDS}) AS w FROM each),
lines AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) AS id, doc_id, line_no, list_sort(w) AS w, len(w) AS n FROM sets WHERE len(w) >= {line_dedup.MIN_TOKENS}),
firsts AS (SELECT w, n, min(id) AS id FROM lines GROUP BY 1, 2),
tokens AS (SELECT id, n, unnest(w) AS t FROM firsts),
df AS (SELECT t, count(*) AS k FROM tokens GROUP BY 1),
ranked AS (SELECT id, n, t, row_number() OVER (PARTITION BY id ORDER BY k, t) AS p FROM tokens JOIN df USING (t)),
heads AS (SELECT * FROM ranked WHERE p <= n - CAST(ceil(n * 4 / 5.0) AS BIGINT) + 1),
maybe AS (SELECT DISTINCT x.id AS a, y.id AS b FROM heads x JOIN heads y ON x.t = y.t AND x.id < y.id AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n),
links AS (SELECT DISTINCT b FROM (
  SELECT b, x.n + y.n AS m, len(list_intersect(x.w, y.w)) AS c FROM maybe JOIN firsts x ON x.id = a JOIN firsts y ON y.id = b) WHERE 100 * c >= 80 * (m - c)),
gone AS (SELECT l.doc_id, l.line_no FROM lines l JOIN firsts f USING (w) WHERE l.id > f.id OR f.id IN (SELECT b FROM links)),
by_doc AS (SELECT doc_id, count(*) AS k, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS s FROM gone GROUP BY 1)
SELECT c.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(k, 0) AS n_removed, coalesce(s, '') AS removed_lines FROM cut c LEFT JOIN by_doc USING (doc_id)
"""


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-stores/{uuid.uuid4().hex}"
    token_store.write_store(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.with_crc32(token_store.read_store(spark, path))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir))


OP11_SQL = _components_sql(minhash_dedup.SHINGLE_WORDS, minhash_dedup.PERCENT, ", s.doc_id = m.c AS kept")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(documents(spark, sf_dir, "embeddings"))


def _assigned(codebook: str) -> str:
    """Each part with its nearest entry: the least (squared distance, index)."""
    return f"""SELECT vec_id, p, any_value(q.v) AS v, min((list_sum([(q.v[i] - c.v[i]) * (q.v[i] - c.v[i]) FOR i IN range(1, len(q.v) + 1)]), e)) AS best FROM parts q JOIN {codebook} c USING (p) GROUP BY 1, 2"""


def _moved(codebook: str, assigned: str) -> str:
    return f"""SELECT p, e, coalesce(any_value(m.v), any_value(c.v)) AS v FROM {codebook} c LEFT JOIN (
    SELECT p, best[2] AS e, list(y ORDER BY i) AS v FROM (
      SELECT p, best, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS y FROM (
        SELECT p, best[2] AS best2, [0, best[2]] AS best, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM {assigned}) GROUP BY 1, 2, 3) GROUP BY 1, 2) m USING (p, e) GROUP BY 1, 2"""


def _vector_sql() -> str:
    n, k = vector_codes.PARTS, vector_codes.ENTRIES
    rounds = "".join(f", a{r} AS ({_assigned(f'c{r}')}), c{r + 1} AS ({_moved(f'c{r}', f'a{r}')})" for r in range(vector_codes.ROUNDS))
    last = vector_codes.ROUNDS
    return f"""
WITH kept AS (
  SELECT vec_id, label, [CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, v[p * len(v) // {n} + 1 : (p + 1) * len(v) // {n}] AS v FROM kept, range({n}) t(p)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {k}),
c0 AS (SELECT p, e, v FROM parts JOIN firsts USING (vec_id)){rounds}, final AS ({_assigned(f"c{last}")}),
coded AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM final GROUP BY 1),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM c{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), books
"""


OP12_SQL = _vector_sql()


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def _feature_sql(table: str, key: str) -> str:
    return rf"""SELECT {key}, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM {table}"""


OP13_SQL = f"""
WITH table_ AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
d AS ({_feature_sql("documents", "doc_id")}), b AS ({_feature_sql("benchmark", "item_id")}),
forms AS (SELECT w, [CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT) FOR i IN range(octet_length(encode(w)))] AS bytes FROM (SELECT w FROM d UNION SELECT w FROM b)),
buckets AS (SELECT w, xor(list_reduce(bytes, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) % {importance.BUCKETS} AS k FROM forms, table_),
s AS (SELECT k, count(*) AS n FROM d JOIN buckets USING (w) GROUP BY 1), t AS (SELECT k, count(*) AS n FROM b JOIN buckets USING (w) GROUP BY 1),
totals AS (SELECT CAST((SELECT count(*) FROM d) AS DOUBLE) AS s, CAST((SELECT count(*) FROM b) AS DOUBLE) AS t),
gains AS (SELECT i AS k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * (totals.s + {importance.BUCKETS}) / ((coalesce(s.n, 0) + 1) * (totals.t + {importance.BUCKETS})))) AS BIGINT) AS gain
  FROM range({importance.BUCKETS}) r(i) LEFT JOIN s ON s.k = i LEFT JOIN t ON t.k = i, totals),
sums AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS g FROM d JOIN buckets USING (w) JOIN gains USING (k) GROUP BY 1),
weighed AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS weight FROM documents LEFT JOIN sums USING (doc_id)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{importance.SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weighed),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= {importance.LEAST_WORDS}
  QUALIFY rank <= {importance.PERCENT} * count(*) OVER () // 100)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, rank FROM scored LEFT JOIN ranks USING (doc_id)
"""


QUERIES = {
    q.__name__: q
    for q in (
        op1_ngram_jaccard_join, op2_warc_revisit, op3_benchmark_decontamination, op4_html_site_templates, op5_secret_scan,
        op6_byte_bpe, op7_quality_perplexity, op8_token_counts, op9_line_dedup, op10_token_store,
        op11_minhash_dedup, op12_vector_codes, op13_importance_resampling,
    )
}
ORACLE_SQL = {"op1_ngram_jaccard_join": OP1_SQL, "op2_warc_revisit": OP2_SQL, "op3_benchmark_decontamination": OP3_SQL, "op5_secret_scan": OP5_SQL, "op9_line_dedup": OP9_SQL, "op11_minhash_dedup": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_importance_resampling": OP13_SQL}

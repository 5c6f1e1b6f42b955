"""Listing, structure, content and ranked search over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grounding import words
from ..functions.normalize import let
from . import tree
from .probe import small
from .saved import saved

# How roles are shown.
ASSERTION = "assertion (the deck being checked)"
EVIDENCE = "evidence (a filing to check against)"
#: Fixed: the usual parameters of the ranking function.
BM25_K1, BM25_B = 1.2, 0.75
#: Postings, one for each query that asks for their word, that one task of a search adds up.
MET_IN_TASK = 5_000_000


def is_assertion(doc_id: Column, kind: Column, role: Column) -> Column:
    """Whether a document is the deck that is checked, by its role, its name or its type."""
    named = F.lower(F.coalesce(role, F.lit(""))).isin("assertion", "deck")
    return named | F.lower(doc_id).contains("deck") | F.lower(kind).contains("deck") | F.lower(kind).contains("ex-99")


def list_documents(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """doc_id, type, period and role of every document; the type defaults to "document"."""
    joined = documents.select("doc_id").distinct().join(manifest.select("doc_id", "role", "type", "period"), "doc_id", "left")
    kind = F.coalesce("type", F.lit("document"))
    return joined.select("doc_id", kind.alias("type"), "period", F.when(is_assertion(F.col("doc_id"), kind, F.col("role")), ASSERTION).otherwise(EVIDENCE).alias("role"))


def structure(nodes: DataFrame, doc_id: str) -> DataFrame:
    """The sections of one document, without text."""
    return nodes.filter(F.col("doc_id") == doc_id)


def find_node(nodes: DataFrame, doc_id: str, node_id: str) -> DataFrame:
    return nodes.filter((F.col("doc_id") == doc_id) & (F.col("node_id") == node_id))


def addressed(documents: DataFrame, min_lines: int = tree.LEAST_LINES) -> DataFrame:
    """The section table of documents, with addresses and paths, and the root of each as a row."""
    lines = tree.lines_of(documents)
    nodes = saved(tree.build_tree(lines, min_lines))
    full = tree.with_addresses(nodes, lines).join(tree.paths(nodes), ["doc_id", "node_id"])
    size = lines.groupBy("doc_id").agg(F.max("line_no").cast("int").alias("line_end"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    root = size.select("doc_id", F.lit("root").alias("node_id"), F.col("doc_id").cast("string").alias("title"), F.lit(1).alias("line_start"), "line_end", "page_start", "page_end", F.lit("").alias("path"))
    return full.unionByName(root, allowMissingColumns=True)


def content(requests: DataFrame, nodes: DataFrame, documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """The text of requested sections: rows of ``requests`` (request, doc_id, node_ids) in order, with pos.

    A request with a section that doesn't exist gives no rows at all.  Text is a
    slice of the document's lines, or of the lines of its pages where it has them.
    """
    asked = requests.select("request", "doc_id", F.size("node_ids").alias("wanted"), F.posexplode("node_ids").alias("pos", "node_id"))
    met = asked.join(nodes.select("doc_id", "node_id", "title", "path", "line_start", "line_end", "anchor", "page_start", "page_end"), ["doc_id", "node_id"])
    node = F.struct("pos", "doc_id", "node_id", "title", "path", "line_start", "line_end", "anchor", "page_start", "page_end")
    # a document's text meets a request once and is cut there; a request asks for sections of one document
    full = met.groupBy("request", "doc_id", "wanted").agg(F.sort_array(F.collect_list(node)).alias("n")).filter(F.size("n") == F.col("wanted"))
    with_text = full.join(documents.select("doc_id", "markdown", "pages"), "doc_id").join(manifest.select("doc_id", "url"), "doc_id", "left")

    def body(lines: Column, n: Column) -> Column:
        paged = F.filter(lines, lambda _, i: F.try_element_at("pages", i + 1).between(n["page_start"], n["page_end"]))
        own = F.slice(lines, n["line_start"], F.greatest(n["line_end"] - n["line_start"] + 1, F.lit(0)))
        return F.array_join(F.when(n["page_start"].isNull(), own).otherwise(paged), "\n")

    texts = let(F.split("markdown", "\n", -1), lambda lines: F.transform("n", lambda n: body(lines, n)))
    rows = with_text.select("request", "url", F.explode(F.arrays_zip("n", texts.alias("content"))).alias("e")).select("request", "url", "e.n.*", "e.content")
    url = F.coalesce("url", F.lit(""))
    cite = F.when(url == "", "").when(F.col("page_start").isNotNull(), F.concat(url, F.lit("#page="), F.col("page_start").cast("string"))).when(F.col("anchor").isNotNull(), F.concat(url, F.lit("#"), F.col("anchor"))).otherwise(url)
    return rows.select("request", "pos", "doc_id", "node_id", "title", "path", "content", cite.alias("cite"), F.struct("line_start", "line_end", "anchor", "page_start", "page_end").alias("loc"))


def postings(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, key, tf, length) of the wanted ``terms`` in texts (key, text), and for each key a row without term: its texts and their words.

    A text's words are found once, and their number goes along with each of them.
    """
    found = let(words(F.col("text")), lambda w: let(F.size(w), lambda n: F.concat(F.transform(w, lambda x: F.struct(x.alias("term"), n.alias("length"))), F.array(F.struct(F.lit(None).cast("string").alias("term"), n.alias("length"))))))
    each = texts.select("key", F.explode(found).alias("e")).select("key", "e.*")
    wanted = terms.select(F.col("term").alias("wanted")).distinct()
    if small(wanted):
        wanted = F.broadcast(wanted)
    kept = each.join(wanted, F.col("term") == F.col("wanted"), "left").filter("wanted is not null or term is null")
    return kept.groupBy("term", "key").agg(F.count("*").alias("tf"), F.sum("length").alias("total"), F.max("length").alias("length"))


def bm25(queries: DataFrame, texts: DataFrame, k: int, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """query_id, key, score and rank of the ``k`` best texts (key, text) for each query (query_id, text).

    One pass over the texts gives the postings of the words that queries ask for;
    they are written, and totals and document frequencies come from them.  Queries
    of the same words are answered once.  A text's postings meet in one task, so
    its score for a query is a sum within the task, and only the task's ``k`` best
    texts of a query go on: texts times queries are never written anywhere.
    """
    sets = saved(queries.select("query_id", F.array_sort(F.array_distinct(words(F.col("text")))).alias("terms")))
    askers = sets.groupBy("terms").agg(F.min("query_id").alias("asker"))
    asked = askers.select("asker", F.explode("terms").alias("term"))
    held = saved(postings(texts, asked))
    tf = held.filter("term is not null").select("term", "key", "tf", "length")
    totals = F.broadcast(held.filter("term is null").agg(F.sum("tf").alias("n_texts"), (F.sum("total") / F.sum("tf")).alias("avg_length")))  # one row
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_texts") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wanted = saved(asked.join(df, "term").crossJoin(totals).select("term", "asker", "df", idf.alias("idf")))
    n_met = wanted.agg(F.sum("df")).first()[0] or 0
    if small(wanted):
        wanted = F.broadcast(wanted)
    parts = max(held.sparkSession.sparkContext.defaultParallelism, -(-n_met // MET_IN_TASK))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    scored = tf.repartition(parts, "key").crossJoin(totals).join(wanted.drop("df"), "term").select("asker", "key", weight.alias("weight"))
    top = best(scored.groupBy("key", "asker").agg(F.sum("weight").alias("score")), "asker", k)
    return top.join(sets.join(askers, "terms").select("asker", "query_id"), "asker").select("query_id", "key", "score", "rank")


def rounded(score: Column, digits: int) -> Column:
    """A score to so many decimals as SQL engines round doubles: the nearest whole of the multiple.  Spark's round would take the decimals as printed, which differs on ties."""
    return F.round(score * 10.0**digits) / 10.0**digits


def best(scores: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` best rows (score, key) of each ``by`` with their rank; a task passes on its own best ones only (Spark sees to that up to a ``k`` of 1,000)."""
    order = Window.partitionBy(by).orderBy(-rounded(F.col("score"), 6), "key")
    return scores.select(by, "key", "score", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= k)


def route(operation: Column, has_figure: Column) -> Column:
    """The way a claim is looked up: figures by section navigation, names and the like by search."""
    return F.when(has_figure & operation.isin("absolute", "growth", "margin", "count"), "navigate").otherwise("search")


def evidence_only(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows of evidence documents; a deck can't prove itself."""
    return rows.join(listing.filter(F.col("role") == EVIDENCE).select("doc_id"), "doc_id", "left_semi")


def truncated(payload: Column, most: int) -> Column:
    """A tool's answer, cut to ``most`` characters."""
    return F.substring(payload, 1, most)

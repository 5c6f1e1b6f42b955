"""Selective descent of section trees: the most promising sections first, until a budget is spent.

The scores of sections are those of their subtrees, so a step can trust an inner
section by what lies below it.  A frontier table holds, for each request, the
sections that may be looked at next; each round takes the best of them and puts
their children in.  No row reaches the driver, which only asks whether a frontier is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grounding import claim_terms, words
from . import tree
from .saved import saved


def section_scores(requests: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(request, doc_id, node_id, n_terms, n_hits): how many telling words of a request (request, doc_id, text) stand in a section, subsections included, and how often.

    Words are counted line by line; each line adds to all sections that hold it.
    """
    asked = requests.select("request", "doc_id", claim_terms(F.col("text")).alias("terms")).filter(F.size("terms") > 0)
    held = lines.select("doc_id", "line_no", words(F.col("text")).alias("w")).join(asked, "doc_id")
    hits = held.select("request", "doc_id", "line_no", F.explode(F.filter("w", lambda x: F.array_contains("terms", x))).alias("term"))
    by_line = hits.groupBy("request", "doc_id", "line_no", "term").agg(F.count("*").alias("n"))
    placed = by_line.join(tree.line_sections(lines, nodes), ["doc_id", "line_no"])
    each = placed.select("request", "doc_id", "term", "n", F.explode("sections").alias("node_id")).groupBy("request", "doc_id", "node_id", "term").agg(F.sum("n").alias("n"))
    return each.groupBy("request", "doc_id", "node_id").agg(F.count("*").alias("n_terms"), F.sum("n").alias("n_hits"))


def descend(requests: DataFrame, nodes: DataFrame, scores: DataFrame, k: int, budget: int) -> DataFrame:
    """(request, doc_id, step, node_id, parent_id, n_terms, n_hits, is_leaf): the sections that a request goes to, in order.

    Each round takes the ``k`` best sections of a request's frontier, by words found,
    hits and place; a request goes to ``budget`` sections at most, and never below
    a section without a hit.  Requests for documents without sections give no rows.
    """
    slim = nodes.filter("node_id <> 'root'").select("doc_id", "node_id", "parent_id", "line_start")
    inner = slim.select("doc_id", F.col("parent_id").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    told = slim.join(inner, ["doc_id", "node_id"], "left").join(requests.select("request", "doc_id").distinct(), "doc_id").join(scores, ["request", "doc_id", "node_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    scored = saved(told.select("request", "doc_id", "node_id", "parent_id", "line_start", zero("n_terms"), zero("n_hits"), F.col("inner").isNull().alias("is_leaf")))
    frontier = scored.filter("parent_id = 'root'").withColumn("left", F.lit(budget))
    mine = Window.partitionBy("request", "doc_id")
    best = mine.orderBy(F.desc("n_terms"), F.desc("n_hits"), "line_start", "node_id")
    found, spent = None, 0
    while spent < budget:
        ranked = saved(frontier.withColumn("rank", F.row_number().over(best)).withColumn("takes", F.least(F.lit(k), F.col("left"), F.count("*").over(mine))))
        taken = ranked.filter("rank <= takes")
        if taken.limit(1).count() == 0:
            break
        now = taken.select("request", "doc_id", (F.lit(budget) - F.col("left") + F.col("rank")).alias("step"), "node_id", "parent_id", "n_terms", "n_hits", "is_leaf")
        found = now if found is None else found.unionByName(now)
        opened = taken.filter("n_hits > 0 and not is_leaf").select("request", "doc_id", F.col("node_id").alias("parent_id"))
        left = taken.select("request", "doc_id", (F.col("left") - F.col("takes")).alias("left")).distinct()
        rest = ranked.filter("rank > takes").select(*scored.columns).unionByName(scored.join(opened, ["request", "doc_id", "parent_id"], "left_semi").select(*scored.columns))
        frontier = rest.join(left, ["request", "doc_id"]).filter("left > 0")
        spent += 1  # each round goes to one section of a request at least
    if found is None:
        return scored.limit(0).select("request", "doc_id", F.lit(0).alias("step"), "node_id", "parent_id", "n_terms", "n_hits", "is_leaf")
    return found


def navigate(requests: DataFrame, documents: DataFrame, k: int = 2, budget: int = 6) -> DataFrame:
    """``descend`` for requests (request, doc_id, text) over the section trees of ``documents``."""
    lines = tree.lines_of(documents)
    nodes = saved(tree.build_tree(lines))
    return descend(requests, nodes, section_scores(requests, nodes, lines), k, budget)

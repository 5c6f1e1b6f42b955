"""Section trees of two snapshots of a corpus, compared by digests, so that only what changed is worked on again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tree


def digests(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, node_id, path, nth, own, digest) of every section.

    ``own`` is the SHA-256 of the lines that no subsection holds, ``digest`` that of
    the own digests of the section and all below it, in order: one changed line
    changes the digests from its section up, and no others.  Sections of one path
    are told apart by ``nth``, their place among them.
    """
    placed = lines.select("doc_id", "line_no", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).join(tree.line_sections(lines, nodes), ["doc_id", "line_no"]).filter(F.size("sections") > 0)
    node = F.element_at("sections", -1)
    own = placed.groupBy("doc_id", node.alias("node_id")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "h"))), lambda x: x["h"]), "\n"), 256).alias("own"), F.max("sections").alias("sections"))
    below = own.select("doc_id", F.explode("sections").alias("node_id"), F.col("node_id").alias("inner"), "own").join(nodes.select("doc_id", F.col("node_id").alias("inner"), "line_start"), ["doc_id", "inner"])
    rolled = below.groupBy("doc_id", "node_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "inner", "own"))), lambda x: x["own"]), "\n"), 256).alias("digest"))
    named = nodes.select("doc_id", "node_id", "line_start").join(tree.paths(nodes), ["doc_id", "node_id"])
    nth = F.row_number().over(Window.partitionBy("doc_id", "path").orderBy("line_start", "node_id"))
    full = named.withColumn("nth", nth).join(own.select("doc_id", "node_id", "own"), ["doc_id", "node_id"], "left").join(rolled, ["doc_id", "node_id"], "left")
    return full.select("doc_id", "node_id", "path", "nth", F.coalesce("own", F.lit("")).alias("own"), F.coalesce("digest", F.lit("")).alias("digest"))


def changed_documents(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of ``after`` (doc_id, sha256, ...) whose document is new or has other bytes; the others needn't be read."""
    return after.join(before.select("doc_id", "sha256"), ["doc_id", "sha256"], "left_anti")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, path, nth, node_id, change, own_changed) of the sections that differ between two tables of ``digests``.

    ``change`` is added, removed or changed; node_id is that of ``after``, or of
    ``before`` where it is removed; ``own_changed`` is false where only subsections differ.
    """
    key = ["doc_id", "path", "nth"]
    b = before.select(*key, F.col("node_id").alias("_node"), F.col("own").alias("_own"), F.col("digest").alias("_digest"))
    met = after.join(b, key, "full").filter(~F.col("digest").eqNullSafe(F.col("_digest")))
    kind = F.when(F.col("_digest").isNull(), "added").when(F.col("digest").isNull(), "removed").otherwise("changed")
    return met.select(*key, F.coalesce("node_id", "_node").alias("node_id"), kind.alias("change"), (~F.col("own").eqNullSafe(F.col("_own"))).alias("own_changed"))


def with_kept_summaries(after: DataFrame, known: DataFrame) -> DataFrame:
    """``after`` with the summary that a section of the same digest has in ``known`` (digest, summary), whichever document it stands in; null where one must be made."""
    first = known.groupBy("digest").agg(F.min("summary").alias("summary"))
    return after.join(first, "digest", "left").select(*after.columns, "summary")

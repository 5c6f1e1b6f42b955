"""Section trees of documents, as a table of nodes.

Input lines: doc_id, line_no (from 1), text, and where known anchor and page.
A document's headings are windowed over that document alone; text stays out of
the node table.  A document whose lines have pages keeps every section, however
short, and its sections aren't split: they are addressed by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .saved import saved

# Fixed values of the tree rules.
MOST_CHARS = 80_000
LEAST_LINES = 6
HEADING = r"(?U)^(#{1,6})\s+(.*)$"
ITEM = r"(?iU)^(PART|ITEM)\s"
PATH_SEPARATOR = " › "


def lines_of(documents: DataFrame) -> DataFrame:
    """doc_id, line_no, text, anchor and page of every line of ``markdown``."""
    each = documents.select("doc_id", "doc_type", "anchors", "pages", F.posexplode(F.split("markdown", "\n", -1)).alias("i", "text"))
    no = F.col("i") + 1
    return each.select("doc_id", "doc_type", no.alias("line_no"), "text", F.try_element_at("anchors", no).alias("anchor"), F.try_element_at("pages", no).alias("page"))


def headings(lines: DataFrame) -> DataFrame:
    """doc_id, ord, line_no, level and title of the heading lines."""
    found = lines.filter(F.col("text").rlike(HEADING)).select("doc_id", "line_no", F.length(F.regexp_extract("text", HEADING, 1)).alias("level"), F.trim(F.regexp_extract("text", HEADING, 2)).alias("title"))
    return found.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))


def place(heads: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds parent_ord (0 for the root), line_start and line_end to headings.

    The parent is the nearest heading before with a smaller level; a section
    ends before the next heading of its level or a smaller one.
    """
    order = Window.partitionBy("doc_id").orderBy("ord")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    level = F.col("level")
    parents = [F.when(level > k, F.last(F.when(level == k, F.col("ord")), ignorenulls=True).over(before)) for k in range(1, 6)]
    ends = [F.when(level >= k, F.first(F.when(level == k, F.col("line_no")), ignorenulls=True).over(after)) for k in range(1, 7)]
    placed = heads.select("*", F.coalesce(F.greatest(*parents), F.lit(0)).alias("parent_ord"), F.least(*ends).alias("_next"))
    return placed.join(sizes, "doc_id").select("doc_id", "ord", "parent_ord", "level", "title", F.col("line_no").alias("line_start"), F.coalesce(F.col("_next") - 1, F.col("n_lines")).cast("int").alias("line_end"), "paged", "doc_chars")


def prune(nodes: DataFrame, min_lines: int = LEAST_LINES) -> DataFrame:
    """Drops sections too short to go to, unless they or a section in them is a PART or ITEM, or the document has pages.

    A section in another is never longer, so this equals folding leaves away from below.
    """
    item = F.col("title").rlike(ITEM)
    inside = Window.partitionBy("doc_id").orderBy("line_start").rangeBetween(1, Window.unboundedFollowing)
    next_item = F.coalesce(item, F.lit(False)) | (F.min(F.when(item, F.col("line_start"))).over(inside) <= F.col("line_end"))
    long = (F.col("line_end") - F.col("line_start")) >= min_lines
    return nodes.withColumn("_keep", long | F.coalesce(next_item, F.lit(False))).filter("_keep or paged").drop("_keep")


def split_long(nodes: DataFrame, lines: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """Adds part nodes below leaves of more than ``most`` characters, on even line steps, in documents without pages."""
    leaf = nodes.filter("not paged").join(nodes.select("doc_id", F.col("parent_id").alias("node_id")).distinct(), ["doc_id", "node_id"], "left_anti")
    upto = Window.partitionBy("doc_id").orderBy("line_no")
    ends = lines.select("doc_id", "line_no", F.sum(F.length("text") + 1).over(upto).alias("upto"), F.length("text").alias("own"))
    first = ends.select("doc_id", F.col("line_no").alias("line_start"), (F.col("upto") - F.col("own") - 1).alias("before"))
    last = ends.select("doc_id", F.col("line_no").alias("line_end"), F.col("upto"))
    sized = leaf.join(first, ["doc_id", "line_start"]).join(last, ["doc_id", "line_end"]).withColumn("chars", F.col("upto") - F.col("before") - 1).filter(F.col("chars") > most)
    parts = F.ceil(F.col("chars") / most).cast("int")
    step = F.ceil((F.col("line_end") - F.col("line_start") + 1) / F.col("parts")).cast("int")
    cut = sized.withColumn("parts", parts).withColumn("step", step).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    start = F.col("line_start") + F.col("i") * F.col("step")
    named = {
        "node_id": F.concat("node_id", F.lit("p"), (F.col("i") + 1).cast("string")),
        "title": F.concat("title", F.lit(" (part "), (F.col("i") + 1).cast("string"), F.lit(")")),
        "parent_id": F.col("node_id"),
        "level": F.col("level") + 1,
        "line_start": start,
        "line_end": F.least(F.col("line_end"), start + F.col("step") - 1),
    }
    return nodes.unionByName(cut.select(*(named[c].cast(t).alias(c) if c in named else F.col(c) for c, t in nodes.dtypes)))


def build_tree(lines: DataFrame, min_lines: int = LEAST_LINES, most_chars: int = MOST_CHARS) -> DataFrame:
    """doc_id, node_id, parent_id, ord, level, title, line_start, line_end of every kept section.

    A document without headings is one section n1.  The root, which spans all
    lines, is not a row: it is the parent_id "root".  The sections are written
    before long ones are split, so that plans over them stay small.
    """
    paged = F.max(F.col("page").isNotNull()) if "page" in lines.columns else F.lit(False)
    sizes = lines.groupBy("doc_id").agg(F.max("line_no").alias("n_lines"), paged.alias("paged"), F.sum(F.length("text") + 1).alias("doc_chars"))
    heads = headings(lines)
    placed = place(heads, sizes)
    kept = prune(placed, min_lines)
    # a kept section's parent contains it, so it is kept too
    node = lambda ord_: F.concat(F.lit("n"), ord_.cast("string"))
    named = kept.select("doc_id", node(F.col("ord")).alias("node_id"), F.when(F.col("parent_ord") == 0, "root").otherwise(node(F.col("parent_ord"))).alias("parent_id"), "ord", "level", "title", "line_start", "line_end", "paged", "doc_chars")
    bare = sizes.join(heads.select("doc_id").distinct(), "doc_id", "left_anti")
    single = bare.select("doc_id", F.lit("n1").alias("node_id"), F.lit("root").alias("parent_id"), F.lit(1).alias("ord"), F.lit(1).alias("level"), F.col("doc_id").cast("string").alias("title"), F.lit(1).alias("line_start"), F.col("n_lines").cast("int").alias("line_end"), "paged", "doc_chars")
    whole = saved(named.unionByName(single))
    long = whole.filter(~F.col("paged") & (F.col("doc_chars") > most_chars)).select("doc_id").distinct()
    nodes = whole.drop("doc_chars")
    # a section is no longer than its document
    return (nodes if long.isEmpty() else split_long(nodes, lines.join(long, "doc_id", "left_semi"), most_chars)).drop("paged")


def with_addresses(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds the heading line's anchor, and the pages a section spans where lines have pages.

    Pages follow each other, so a section's first page is the first one that ends at
    or behind its first line, and its last page the last one that starts at or
    before its last line: a document's sections and pages are looked at in line order, not in pairs.
    """
    lines = saved(lines.filter("anchor is not null or page is not null").select("doc_id", "line_no", "anchor", "page"))
    anchors = lines.filter("anchor is not null").select("doc_id", F.col("line_no").alias("line_start"), "anchor")
    paged = lines.filter("page is not null").groupBy("doc_id", "page").agg(F.min("line_no").alias("a"), F.max("line_no").alias("b"))
    kind = "struct<page:int,a:int,b:int>"
    page, none = F.struct("page", "a", "b").cast(kind), F.lit(None).cast(kind)
    own = nodes.select("doc_id", "node_id", "line_start", "line_end")

    def beside(line: str, edge: str, node_first: bool) -> DataFrame:
        marks = paged.select("doc_id", F.lit(None).cast("string").alias("node_id"), F.col(edge).alias("at"), F.lit(1).alias("kind"), page.alias("p"))
        asked = own.select("doc_id", "node_id", F.col(line).alias("at"), F.lit(0 if node_first else 2).alias("kind"), none.alias("p"))
        return asked.unionByName(marks)

    order = Window.partitionBy("doc_id").orderBy("at", "kind")
    first = beside("line_start", "b", True).withColumn("p", F.first("p", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))).filter("node_id is not null").select("doc_id", "node_id", F.col("p").alias("f"))
    last = beside("line_end", "a", False).withColumn("p", F.last("p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("node_id is not null").select("doc_id", "node_id", F.col("p").alias("l"))
    spans = own.join(first, ["doc_id", "node_id"]).join(last, ["doc_id", "node_id"]).filter((F.col("f.a") <= F.col("line_end")) & (F.col("l.b") >= F.col("line_start")))
    return nodes.join(anchors, ["doc_id", "line_start"], "left").join(spans.select("doc_id", "node_id", F.col("f.page").alias("page_start"), F.col("l.page").alias("page_end")), ["doc_id", "node_id"], "left")


def _chains(nodes: DataFrame, *values: str) -> DataFrame:
    """doc_id, node_id and chain: ``values`` of a section's ancestors from the root down, and its own.

    In page order a section's ancestors are, for each smaller level, the last
    section before it, unless one of a still smaller level stands between.  Parts
    of a long section are a level below it.
    """
    order = Window.partitionBy("doc_id").orderBy("line_start", "level", "node_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = nodes.select("doc_id", "node_id", "line_start", "level", F.struct(*values).alias("own"), F.row_number().over(order).alias("at"))
    last = [F.last(F.when(F.col("level") == k, F.struct("at", "own")), ignorenulls=True).over(before).alias(f"l{k}") for k in range(1, 7)]
    seen = numbered.select("*", *last)
    steps, nearest = [], F.lit(0)
    for k in range(1, 7):
        above = F.col(f"l{k}")
        steps.append(F.when((F.col("level") > k) & (above["at"] > nearest), above["own"]))
        nearest = F.greatest(nearest, F.coalesce(above["at"], F.lit(0)))
    return seen.select("doc_id", "node_id", F.concat(F.array_compact(F.array(*steps)), F.array("own")).alias("chain"))


def paths(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id and the titles from the root down, joined."""
    return _chains(nodes, "title").select("doc_id", "node_id", F.array_join(F.transform("chain", lambda x: x["title"]), PATH_SEPARATOR).alias("path"))


def line_sections(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, line_no and sections: the ids of all sections that hold the line, from the root down.

    A line's sections are among those of the last section that starts at or before it, whose end decides.
    """
    chains = _chains(nodes, "node_id", "line_end")
    started = nodes.join(chains, ["doc_id", "node_id"]).select("doc_id", F.col("line_start").alias("line_no"), "level", "chain", F.lit(False).alias("asked"))
    all_ = started.unionByName(lines.select("doc_id", "line_no", F.lit(99).alias("level"), F.lit(None).cast(started.schema["chain"].dataType).alias("chain"), F.lit(True).alias("asked")))
    upto = Window.partitionBy("doc_id").orderBy("line_no", "level").rowsBetween(Window.unboundedPreceding, 0)
    held = all_.withColumn("chain", F.last("chain", ignorenulls=True).over(upto)).filter("asked")
    inside = F.filter("chain", lambda x: x["line_end"] >= F.col("line_no"))
    return held.select("doc_id", "line_no", F.coalesce(F.transform(inside, lambda x: x["node_id"]), F.array().cast("array<string>")).alias("sections"))


def depths(nodes: DataFrame) -> DataFrame:
    """``nodes`` with depth: 1 below the root."""
    path = paths(nodes).select("doc_id", "node_id", F.size(F.split("path", PATH_SEPARATOR)).alias("depth"))
    return nodes.join(path, ["doc_id", "node_id"])


def trimmed(nodes: DataFrame, depth: int) -> DataFrame:
    """doc_id, node_id, parent_id and title of the nodes down to ``depth``."""
    return depths(nodes).filter(F.col("depth") <= depth).select("doc_id", "node_id", "parent_id", "title", "depth")


def with_summaries(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """``nodes`` with the summary of a cache table (doc_id, node_id, summary), null where it has none."""
    return nodes.join(summaries.select("doc_id", "node_id", "summary"), ["doc_id", "node_id"], "left")


def note_references(content: Column) -> Column:
    """The note numbers that a text refers to."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(r"(?i)\bsee note (\d+)"), F.lit(1)))


def node_counts(nodes: DataFrame) -> DataFrame:
    """doc_id and the number of its sections, the root aside."""
    return nodes.filter("node_id <> 'root'").groupBy("doc_id").agg(F.count("*").alias("n_nodes"))


def notes(content: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, note, note_node): the notes that sections (doc_id, node_id, content) refer to, with the first section of that document titled so."""
    titled = nodes.select("doc_id", F.regexp_extract("title", r"(?i)^note\s+(\d+)\b", 1).alias("note"), "line_start", F.col("node_id").alias("note_node")).filter("note <> ''")
    first = titled.groupBy("doc_id", "note").agg(F.min_by("note_node", F.struct("line_start", "note_node")).alias("note_node"))
    asked = content.select("doc_id", "node_id", F.explode(note_references(F.col("content"))).alias("note"))
    return asked.join(first, ["doc_id", "note"], "left").select("doc_id", "node_id", "note", "note_node")


def note_reach(references: DataFrame, most_hops: int = 20) -> DataFrame:
    """(doc_id, node_id, note_node, hops): the notes that a section reaches by references (doc_id, node_id, note_node), over other notes, in the fewest hops.

    References may go round in circles: each round follows only what was reached for
    the first time in the last one, and ends when nothing new is reached, or after ``most_hops``.
    """
    direct = references.filter("note_node is not null").select("doc_id", "node_id", "note_node").distinct()
    step = saved(direct)
    found = fresh = saved(step.withColumn("hops", F.lit(1)))
    for hops in range(2, most_hops + 1):
        next_ = fresh.select("doc_id", "node_id", F.col("note_node").alias("by")).join(step.select("doc_id", F.col("node_id").alias("by"), "note_node"), ["doc_id", "by"]).select("doc_id", "node_id", "note_node").distinct()
        fresh = saved(next_.join(found, ["doc_id", "node_id", "note_node"], "left_anti").withColumn("hops", F.lit(hops)))
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
    return found


def unread(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """The leaf sections (doc_id, node_id) of documents that no step of a walk (doc_id, node_id) went to."""
    parents = nodes.select("doc_id", F.col("parent_id").alias("node_id")).distinct()
    return nodes.filter("node_id <> 'root'").join(parents, ["doc_id", "node_id"], "left_anti").join(seen.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti").select("doc_id", "node_id")

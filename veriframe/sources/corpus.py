"""Documents of every supported format as markdown with line anchors and pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import let
from ..types import MANIFEST
from .html_blocks import BLOCK_TYPE as BLOCK
from .html_blocks import block_rows

# Fixed values of the loader.
LISTED = ("htm", "html", "pdf", "md")
TEXT_FORMATS = ("md", "markdown", "txt")
SYMBOLS = ("$", "%", "(", ")", "—", "-")
NOISE = "table of contents"
PART_OR_ITEM = r"(?i)^(PART|ITEM)\s+[IVX0-9]"
SPACE_SEPARATORS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ext, content, sha256 and path of the files in a folder, of whatever format."""
    return file_rows(spark.read.format("binaryFile").load(folder))


def file_rows(raw: DataFrame) -> DataFrame:
    """doc_id, ext, content, sha256 and path of read files (path, content)."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return raw.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"), "content", F.sha2("content", 256).alias("sha256"), "path")


def listed(found: DataFrame) -> DataFrame:
    """The files that a corpus lists; of files with one stem the last by path."""
    last = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("path")))
    return found.filter(F.col("ext").isin(*LISTED)).withColumn("_n", last).filter("_n = 1").drop("_n")


def read_manifest(spark: SparkSession, path: str | None) -> DataFrame:
    """doc_id, role, type, period, url from a JSON object by doc_id; no file, no rows."""
    if path is None:
        return spark.createDataFrame([], MANIFEST)
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "map<string,struct<role:string,type:string,period:string,url:string>>")).alias("doc_id", "m"))
    return entries.select("doc_id", "m.role", "m.type", "m.period", "m.url")


def _cell(x: Column) -> Column:
    """``( 1 )`` as ``(1)`` and ``$ 12`` as ``$12``, with | escaped."""
    tidy = F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+\)", ")"), r"([$(])\s+", "$1"))
    return F.replace(tidy, F.lit("|"), F.lit("\\|"))


def _merges(a: Column, b: Column) -> Column:
    return (a == "") | (b == "") | (a == b) | a.isin(*SYMBOLS) | b.isin(*SYMBOLS)


def _joined(a: Column, b: Column) -> Column:
    return F.when((a == b) | (b == ""), a).when(a == "", b).when(a.isin(*SYMBOLS) | b.isin(*SYMBOLS), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


def expand(grid: Column) -> Column:
    """Rows of equal width; a cell stands in every column that it spans."""
    wide = F.transform(grid, lambda r: F.flatten(F.transform(r, lambda c: F.array_repeat(F.coalesce(c["text"], F.lit("")), c["colspan"]))))
    width = F.coalesce(F.array_max(F.transform(wide, lambda r: F.size(r))), F.lit(0))
    return F.transform(wide, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def collapse(rows: Column) -> Column:
    """Drops empty columns and merges neighbours that never conflict."""
    none = F.array().cast("array<array<string>>")
    width = F.coalesce(F.size(F.get(rows, F.lit(0))), F.lit(0))
    columns = F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.transform(rows, lambda r: F.get(r, i)))).otherwise(none)
    full = F.filter(columns, lambda c: F.exists(c, lambda x: x != ""))

    def fold(done: Column, c: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        fits = (F.size(done) > 0) & F.forall(F.arrays_zip(last.alias("a"), c.alias("b")), lambda p: _merges(p["a"], p["b"]))
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.zip_with(last, c, _joined)))).otherwise(F.concat(done, F.array(c)))

    kept = F.aggregate(full, none, fold)
    return F.when(F.size(kept) > 0, F.transform(F.sequence(F.lit(0), F.size(F.get(kept, F.lit(0))) - 1), lambda i: F.transform(kept, lambda c: F.get(c, i)))).otherwise(none)


def fold_header(rows: Column) -> Column:
    """Puts a first row of one repeated title onto the second row."""
    first, second = F.get(rows, F.lit(0)), F.get(rows, F.lit(1))
    titles = F.filter(first, lambda x: x != "")
    fold = (F.size(rows) >= 2) & (F.size(titles) > 1) & (F.size(F.array_distinct(titles)) == 1) & F.exists(second, lambda x: x != "")
    return F.when(fold, F.concat(F.array(F.zip_with(first, second, _joined)), F.slice(rows, F.lit(3), F.greatest(F.size(rows) - 2, F.lit(0))))).otherwise(rows)


def table_markdown(grid: Column) -> Column:
    """A table as markdown rows, the first as header; empty where nothing is left."""
    rows = fold_header(F.filter(collapse(expand(grid)), lambda r: F.exists(r, lambda x: x != "")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    shown = F.transform(rows, lambda r: line(F.transform(r, _cell)))
    rule = line(F.transform(F.get(rows, F.lit(0)), lambda _: F.lit("---")))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(shown, 1, 1), F.array(rule), F.slice(shown, F.lit(2), F.greatest(F.size(shown) - 1, F.lit(0)))), "\n")).otherwise("")


def is_heading(tag: Column, text: Column, bold: Column) -> Column:
    return (text != "") & (F.length(text) <= 200) & (F.lower(text) != NOISE) & (tag.rlike("^h[1-6]$") | text.rlike(PART_OR_ITEM) | bold)


def heading_level(tag: Column, text: Column) -> Column:
    return F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).try_cast("int")).when(text.rlike(r"(?i)^PART\s+[IVX]+"), 1).when(text.rlike(r"(?i)^ITEM\s+\d"), 2).otherwise(3)


def page_blocks(pages: DataFrame) -> DataFrame:
    """doc_id, seq, kind, tag, text, bold and grid of the leaf blocks of (doc_id, html)."""
    found = pages.select(F.col("doc_id").cast("string").alias("doc_id"), "html").mapInArrow(block_rows, f"doc_id string, blocks array<{BLOCK}>")
    return found.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*")


def written_heading(html: Column) -> Column:
    """What stands in a page's first plain <h1> that ends on its line, tags and references as written but for &amp;; empty if there is none.

    Lines are looked at one by one, so a page of unclosed headings takes time in proportion to its length.
    """
    behind = F.transform(F.split(html, "\n", -1), lambda x: F.substr(x, F.length(F.substring_index(x, "<h1>", 1)) + len("<h1>") + 1))
    first = F.substring_index(F.get(F.filter(behind, lambda x: x.contains("</h1>")), F.lit(0)), "</h1>", 1)
    title = F.btrim(F.regexp_replace(F.replace(first, F.lit("&amp;"), F.lit("&")), r"[\t\n\f\r ]+", " "), F.lit(SPACE_SEPARATORS))
    return F.when(html.isNotNull(), F.coalesce(title, F.lit("")))


def html_documents(pages: DataFrame) -> DataFrame:
    """Documents from (doc_id, html, sha256): a blank line before each block, and the last id seen as anchor of each heading line.

    A page's blocks stay one array from the parser to the markdown: nothing is shuffled.
    """
    found = pages.select(F.col("doc_id").cast("string").alias("doc_id"), "html", "sha256").mapInArrow(block_rows, f"doc_id string, blocks array<{BLOCK}>, sha256 string")

    def lines(b: Column) -> Column:
        text = F.coalesce(b["text"], F.lit(""))
        noise = (F.lower(text) == NOISE) | text.rlike(r"^\d{1,3}$")  # page numbers, bold ones too
        heading = (b["kind"] == "text") & ~noise & is_heading(b["tag"], text, F.coalesce(b["bold"], F.lit(False)))
        shown = F.when(b["kind"] == "table", table_markdown(b["grid"])).when(heading, F.concat(F.repeat(F.lit("#"), heading_level(b["tag"], text)), F.lit(" "), text)).when((b["kind"] == "text") & ~noise, text).otherwise("")
        line = lambda x, anchor: F.struct(x.alias("text"), anchor.cast("string").alias("anchor"))
        own = let(F.struct(shown.alias("shown"), F.when(heading, b["anchor"]).alias("anchor")), lambda s: F.when(s["shown"] != "", F.concat(F.array(line(F.lit(""), F.lit(None))), F.transform(F.split(s["shown"], "\n", -1), lambda x: line(x, s["anchor"])))))
        return F.coalesce(own, F.array().cast("array<struct<text:string,anchor:string>>"))

    placed = found.select("doc_id", "sha256", F.flatten(F.transform("blocks", lines)).alias("l"))
    noted = F.filter(F.transform("l", lambda x, i: F.struct((i + 1).alias("key"), x["anchor"].alias("value"))), lambda e: e["value"].isNotNull())
    return placed.select("doc_id", F.lit("html").alias("doc_type"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("markdown"), F.map_from_entries(noted).alias("anchors"), F.create_map().cast("map<int,int>").alias("pages"), "sha256")


def paged_documents(pages: DataFrame) -> DataFrame:
    """Documents from extracted pages (doc_id, page, text): a heading before each page, stripped lines, a blank line after it."""
    lines = F.concat(F.array(F.concat(F.lit("# Page "), F.col("page").cast("string"))), F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x)), F.array(F.lit("")))
    each = pages.select("doc_id", F.col("page").cast("int").alias("page"), lines.alias("lines"))
    whole = each.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "lines"))).alias("p"))
    numbers = F.flatten(F.transform("p", lambda x: F.transform(x["lines"], lambda _, i: F.when(i < F.size(x["lines"]) - 1, x["page"]))))
    entries = F.filter(F.transform(numbers, lambda n, i: F.struct((i + 1).alias("key"), n.alias("value"))), lambda e: e["value"].isNotNull())
    return whole.select("doc_id", F.lit("pdf").alias("doc_type"), F.array_join(F.flatten(F.transform("p", lambda x: x["lines"])), "\n").alias("markdown"), F.create_map().cast("map<int,string>").alias("anchors"), F.map_from_entries(entries).alias("pages"), F.lit(None).cast("string").alias("sha256"))


def without_text(pages: DataFrame) -> DataFrame:
    """Extracted pages (doc_id, page) that hold no text, as scanned ones do."""
    return pages.filter(~F.coalesce("text", F.lit("")).rlike(r"(?U)\S")).select("doc_id", "page")


def load(found: DataFrame, pdf_pages: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Documents from ``files`` rows.

    ``pdf_pages`` turns PDF rows into (doc_id, page, text); without it, and for
    formats that are not known, the row's doc_type is "unsupported" and its text empty.
    """
    text = F.make_valid_utf8(F.col("content").cast("string"))
    html = html_documents(found.filter(F.col("ext").isin("htm", "html")).select("doc_id", text.alias("html"), "sha256"))
    none = [F.create_map().cast("map<int,string>").alias("anchors"), F.create_map().cast("map<int,int>").alias("pages")]
    plain = found.filter(F.col("ext").isin(*TEXT_FORMATS)).select("doc_id", F.lit("md").alias("doc_type"), text.alias("markdown"), *none, "sha256")
    out = html.unionByName(plain)
    known = ("htm", "html", *TEXT_FORMATS)
    if pdf_pages:
        pdf = found.filter("ext = 'pdf'")
        out = out.unionByName(paged_documents(pdf_pages(pdf)).drop("sha256").join(pdf.select("doc_id", "sha256"), "doc_id"))
        known = (*known, "pdf")
    rest = found.filter(~F.col("ext").isin(*known)).select("doc_id", F.lit("unsupported").alias("doc_type"), F.lit("").alias("markdown"), *none, "sha256")
    return out.unionByName(rest)


def filings(response: DataFrame) -> DataFrame:
    """Rows of a filing index (content: JSON of parallel arrays), with their place in the feed."""
    fields = ("form", "filingDate", "reportDate", "accessionNumber", "primaryDocument")
    recent = F.from_json("content", "struct<filings:struct<recent:struct<" + ",".join(f"{f}:array<string>" for f in fields) + ">>>")["filings"]["recent"]
    return response.select(F.posexplode(F.arrays_zip(*(recent[f].alias(f) for f in fields))).alias("feed_pos", "f")).select("feed_pos", "f.*")


def filing_documents(index_pages: DataFrame) -> DataFrame:
    """(accession, doc_pos, name, kind) from the table rows of filing index pages (accession, html)."""
    rows = index_pages.select("accession", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<tr\b.*?</tr>"), F.lit(0))).alias("doc_pos", "row"))
    cells = F.regexp_extract_all("row", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1))
    href = F.regexp_extract("row", r'href="([^"]+)"', 1)
    return rows.filter((href != "") & (F.size(cells) >= 4)).select("accession", "doc_pos", F.substring_index(href, "/", -1).alias("name"), F.trim(F.get(cells, F.lit(3))).alias("kind"))


def first_filing(found: DataFrame, form: str, report_prefix: str = "") -> DataFrame:
    """The first filing of a form, in feed order, whose report date starts so."""
    return found.filter((F.col("form") == form) & F.col("reportDate").startswith(report_prefix)).orderBy("feed_pos").limit(1)


def find_deck(found: DataFrame, documents: DataFrame) -> DataFrame:
    """The exhibit 99.1 of the newest 8-K that has one; within it a PDF comes first."""
    decks = found.filter("form = '8-K'").join(documents.filter("kind = 'EX-99.1'"), found["accessionNumber"] == documents["accession"])
    pdf = F.lower("name").endswith(".pdf")
    return decks.orderBy("feed_pos", F.desc(pdf.cast("int")), "doc_pos").limit(1).select("accession", "name", pdf.alias("is_pdf"))


def to_fetch(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Wanted files (name, ...) that aren't there yet."""
    return wanted.join(present.select("name"), "name", "left_anti")


def accept_uploads(uploads: DataFrame, most_bytes: int = 40 << 20) -> DataFrame:
    """``files`` rows with status and reason: known formats within the size limit are accepted."""
    ok_type = F.col("ext").isin(*LISTED, "markdown", "txt")
    reason = F.when(~ok_type, F.concat(F.lit("unsupported format "), F.col("ext"))).when(F.length("content") > most_bytes, "too large").when(F.length("content") == 0, "empty").otherwise("")
    return uploads.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "", "accepted").otherwise("rejected"))

"""Files that are put into a folder, as they arrive: read, indexed and listed, each once for its bytes.

Every batch writes one folder of each table, named by the query and the batch, so a batch that is
done again after a failure replaces its own work, and a query that has lost its checkpoint doesn't touch what was there.  A batch's ``uploads`` folder is
written last and makes the batch valid: readers take only batches that have one.
Batches count on from those before them; a document is what its latest valid batch says, so a new upload of a name replaces the
document, its sections and its manifest entry at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import tree
from ..sources import corpus
from ..types import DOCUMENT, MANIFEST

NODES = "doc_id string, node_id string, parent_id string, ord int, level int, title string, line_start int, line_end int"
UPLOADS = "name string, doc_id string, sha256 string, status string, reason string, seq long"
TABLES = {"documents": DOCUMENT, "nodes": NODES, "manifest": MANIFEST, "uploads": UPLOADS}


def _all(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.schema(f"{TABLES[name]}, batch string").parquet(f"{out}/{name}")


def prepare(spark: SparkSession, out: str) -> None:
    """Empty tables, so that a first batch and early readers find them."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{out}/{name}/batch=none")


def latest(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, sha256, batch): of each document the last valid batch that accepted it."""
    taken = _all(spark, out, "uploads").filter("status = 'accepted'")
    return taken.groupBy("doc_id").agg(F.max_by(F.struct("batch", "sha256"), "seq").alias("l")).select("doc_id", "l.sha256", "l.batch")


def current(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The table ``name`` as it stands: rows of documents by their latest batch."""
    return _all(spark, out, name).join(latest(spark, out).select("doc_id", "batch"), ["doc_id", "batch"], "left_semi").drop("batch")


def ingest(rows: DataFrame, batch: str, out: str, url_prefix: str = "", most_bytes: int = 40 << 20) -> None:
    """One batch of ``files`` rows: what is told of each, and documents, sections and manifest entries of those accepted.

    Rejected are unknown formats, files that are empty or too large, a file whose
    bytes a document has already (told as unchanged), files of which nothing can be
    read, and of several files of one name in a batch all but the last by path.
    """
    spark = rows.sparkSession
    others = _all(spark, out, "uploads").filter(F.col("batch") != batch)  # not what a failed try of this batch has left
    seq = others.agg(F.coalesce(F.max("seq"), F.lit(-1)) + 1).first()[0]
    before = others.filter("status = 'accepted'").groupBy("doc_id").agg(F.max_by("sha256", "seq").alias("_sha"))
    judged = corpus.accept_uploads(rows, most_bytes).withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)).join(before, "doc_id", "left")
    last = judged.filter("status = 'accepted'").groupBy("doc_id").agg(F.max("path").alias("_last"))
    judged = judged.join(last, "doc_id", "left").withColumn(
        "reason", F.when(F.col("reason") != "", F.col("reason")).when(F.col("path") != F.col("_last"), "another file of this name").when(F.col("sha256") == F.col("_sha"), "unchanged").when(F.col("ext") == "pdf", "no reader for its pages").otherwise("")
    )
    judged = judged.withColumn("status", F.when(F.col("reason") == "", "accepted").when(F.col("reason") == "unchanged", "unchanged").otherwise("rejected"))
    good = judged.filter("status = 'accepted'")

    def put(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")

    put(corpus.load(good.select("doc_id", "ext", "content", "sha256", "path")).select("doc_id", "doc_type", "markdown", "anchors", "pages", "sha256"), "documents")
    docs = spark.read.schema(DOCUMENT).parquet(f"{out}/documents/batch={batch}")
    put(tree.build_tree(tree.lines_of(docs)).select("doc_id", "node_id", "parent_id", *(F.col(c).cast("int").alias(c) for c in ("ord", "level")), "title", *(F.col(c).cast("int").alias(c) for c in ("line_start", "line_end"))), "nodes")
    put(good.select("doc_id", F.lit(None).cast("string").alias("role"), F.col("ext").alias("type"), F.lit(None).cast("string").alias("period"), F.concat(F.lit(url_prefix), "name").alias("url")), "manifest")
    put(judged.select("name", "doc_id", "sha256", "status", "reason", F.lit(seq).cast("long").alias("seq")), "uploads")


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, url_prefix: str = "", most_bytes: int = 40 << 20) -> StreamingQuery:
    """Ingests the files of ``folder`` that no earlier run with this checkpoint has seen."""
    prepare(spark, out)
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def one(rows: DataFrame, batch: int) -> None:
        query = spark.read.text(f"{checkpoint}/metadata", wholetext=True).select(F.get_json_object("value", "$.id")).first()[0]
        ingest(corpus.file_rows(rows), f"{query}-{batch}", out, url_prefix, most_bytes)

    return raw.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Session helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch: texts may be long, and a batch stands in memory on both sides.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of every executor, once per context.

    Where the session leaves Arrow batches at Spark's default of 10,000 rows, they are made smaller.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if getattr(sc, "_llm_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="veriframe-"), "veriframe.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(target)
    sc._llm_shipped = True


Batches = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Gives back the memory that this process no longer uses, which the allocators else keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Batches) -> Batches:
    """``run`` for ``mapInArrow``, after which the worker gives back the memory that it no longer uses: Spark keeps workers for later tasks."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and all runs in one process, as in local tests, a temporary one is set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def table(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again.

    This cuts the lineage: what follows doesn't repeat the work, and a lost
    executor costs only a read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    release()  # what the driver has made for this job
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

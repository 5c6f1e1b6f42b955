"""Tables that a job writes once and reads several times."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below spark.checkpoint.dir and read again.

    What follows doesn't repeat the work, a lost executor costs a read, and nothing
    stays in memory.  Only where all runs in one process and the session names no
    folder, as in local tests, a temporary one is set.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/saved/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

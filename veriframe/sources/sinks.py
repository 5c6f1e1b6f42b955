"""Results out of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_run(df_text: DataFrame) -> DataFrame:
    """The claim rows of recorded runs (value: JSON with a list of claims)."""
    claim = "struct<text:string,figure:string,operation:string,period:string,expected:string,why:string,status:string,rejected:string>"
    run = F.from_json("value", f"struct<model:string,seconds:double,claims:array<{claim}>>")
    return df_text.select(run.alias("r")).select("r.model", "r.seconds", F.posexplode("r.claims").alias("pos", "c")).select("model", "seconds", "pos", "c.*")


def sse_frame(event: Column, payload: Column) -> Column:
    """A server-sent event."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))


def parse_sse(stream: Column) -> Column:
    """Array of (event, data) of the whole frames in a text; an unfinished last one is left out."""
    frames = F.filter(F.split(stream, "\n\n", -1), lambda x, i: (i < F.size(F.split(stream, "\n\n", -1)) - 1) & (x != ""))
    return F.transform(frames, lambda x: F.struct(F.regexp_extract(x, "(?m)^event: (.*)$", 1).alias("event"), F.regexp_extract(x, "(?m)^data: (.*)$", 1).alias("data")))


def without_document(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """``table`` without the deleted documents; deleting twice changes nothing."""
    return table.join(deleted.select("doc_id"), "doc_id", "left_anti")

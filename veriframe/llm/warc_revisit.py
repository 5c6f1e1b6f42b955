"""Operator 2: resolution of WARC not-modified revisits.

A revisit record stands for the latest earlier full response of its canonical
URL.  The as-of join works by URL and time bucket: the last full response of
each bucket is one row, these are carried forward over the buckets, and only
records of one bucket are ordered against each other, so a URL with a third of
all records is spread over the buckets.  Payloads take no part in it.

The revisit's validators are then checked against the response found: its ETag,
by weak comparison, else its Last-Modified date, else its payload digest; with
none of them, it is accepted.  The merged headers are the response's with those
of the revisit that a not-modified answer may update: all but the ones that
describe the body or the connection.

Defined results: records are ordered by (ts, record_id), and of responses that
share URL, time and id that with the least digest and headers counts; a record without url or
ts, or a full response without record_id, takes no part and a revisit without
them is "no_earlier_response"; repeated rows give a row each; columns other than
those named stay out of the result; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
#: Fixed: header fields that a not-modified answer must not change.
KEPT_FIELDS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]
#: Fixed: query parameters that don't name a resource.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, tracking parameters dropped, the others sorted, and a path."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    site = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)), "^(http://.*):80$|^(https://.*):443$", "$1$2")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path = F.regexp_extract(rest, "^([^?]*)", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&", -1), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.concat(site, F.when((path == "") & (site != ""), "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def parse_headers(block: Column) -> Column:
    """A map of lower-case field names to values, from a raw header block; the last of equal names stays."""
    lines = F.filter(F.split(block, "\r?\n", -1), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, "^([^:]*):", 1))).alias("key"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("value")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def latest_full(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(record_id, canonical, ts, target, target_ts): for each record that is not full, id and time of the latest earlier full response."""
    known = records.filter("canonical is not null and ts is not null")
    span = known.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    width = F.greatest(F.ceil((F.col("high") - F.col("low") + 1) / buckets), F.lit(1))
    placed = known.crossJoin(F.broadcast(span)).select("record_id", "canonical", "ts", "is_full", F.floor((F.col("ts") - F.col("low")) / width).alias("bucket"))  # span is one row
    own = F.struct("ts", "record_id")
    full = F.when(F.col("is_full") & F.col("record_id").isNotNull(), own)
    inside = Window.partitionBy("canonical", "bucket").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = placed.groupBy("canonical", "bucket").agg(F.max(full).alias("last")).withColumn("carried", F.max("last").over(across)).select("canonical", "bucket", "carried")
    near = placed.withColumn("near", F.max(full).over(inside)).filter(~F.col("is_full"))
    return near.join(last, ["canonical", "bucket"]).select("record_id", "canonical", "ts", F.coalesce("near", "carried").alias("latest")).select("record_id", "canonical", "ts", F.col("latest.record_id").alias("target"), F.col("latest.ts").alias("target_ts"))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A row for each revisit: record_id, canonical_url, outcome, target_id, status and merged headers.

    ``records``: record_id long, url, ts long, kind ("response" or "revisit"),
    status int, headers map of lower-case names, payload_digest.
    """
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    keyed = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "ts", "kind", "status", "headers", "payload_digest", full.alias("is_full"))
    revisits = keyed.filter("kind = 'revisit'")
    slim = keyed.filter("is_full or kind = 'revisit'").select("record_id", "canonical", "ts", "is_full")
    found = latest_full(slim.withColumn("is_full", F.coalesce("is_full", F.lit(False))), buckets).dropDuplicates(["record_id", "canonical", "ts"])
    response = F.min_by(F.struct("status", "headers", "payload_digest"), F.struct("payload_digest", F.to_json("headers")))
    responses = keyed.filter("is_full and record_id is not null").groupBy(F.col("record_id").alias("target"), F.col("ts").alias("t_ts"), F.col("canonical").alias("t_canonical")).agg(response.alias("t"))
    responses = responses.select("target", "t_ts", "t_canonical", F.col("t.status").alias("t_status"), F.col("t.headers").alias("t_headers"), F.col("t.payload_digest").alias("t_digest"))
    r, f = revisits.alias("r"), found.alias("f")
    on = F.col("r.record_id").eqNullSafe(F.col("f.record_id")) & (F.col("r.canonical") == F.col("f.canonical")) & (F.col("r.ts") == F.col("f.ts"))
    told = r.join(f, on, "left").select("r.*", "f.target", "f.target_ts").alias("a")
    same = (F.col("a.target") == F.col("b.target")) & (F.col("a.target_ts") == F.col("b.t_ts")) & (F.col("a.canonical") == F.col("b.t_canonical"))
    joined = told.join(responses.alias("b"), same, "left").select("a.*", "t_status", "t_headers", "t_digest")
    own, theirs = F.coalesce("headers", F.create_map().cast("map<string,string>")), F.coalesce("t_headers", F.create_map().cast("map<string,string>"))
    valid = (
        F.when(own["etag"].isNotNull(), F.coalesce(_weak(own["etag"]) == _weak(theirs["etag"]), F.lit(False)))
        .when(own["last-modified"].isNotNull(), F.coalesce(own["last-modified"] == theirs["last-modified"], F.lit(False)))
        .when(F.col("payload_digest").isNotNull(), F.coalesce(F.col("payload_digest") == F.col("t_digest"), F.lit(False)))
        .otherwise(True)
    )
    outcome = F.when(F.col("t_status").isNull(), "no_earlier_response").when(valid, "resolved").otherwise("validator_mismatch")
    fresh = F.map_filter(own, lambda k, v: ~k.isin(KEPT_FIELDS))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    good = outcome == "resolved"
    return joined.select(
        "record_id",
        F.col("canonical").alias("canonical_url"),
        outcome.alias("outcome"),
        F.when(good, F.col("target")).alias("target_id"),
        F.when(good, F.col("t_status")).alias("status"),
        F.when(good, merged).alias("headers"),
        F.when(good, F.col("t_digest")).alias("payload_digest"),
    )

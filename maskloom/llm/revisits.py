"""Not-modified revisits of web archives, resolved to the latest earlier full response of the same canonical URL.

Captures are records (record_id, url, ts, kind, etag, last_modified, headers, digest); kind is ``response`` (full) or
``revisit`` (a 304). A revisit refers to the response of its canonical URL with the greatest ts below its own (of equal ts
the greatest record_id). Its validators must agree: ETags by weak comparison if it has one, else Last-Modified if it has
that. The merged headers are the response's, with those of the 304 that may replace them: see ``PERMITTED``.

The as-of join sorts within (canonical URL, time bucket) only. The last response of each bucket is found by a partial
aggregate, carried to the URL's later buckets by a window over buckets, and put before each bucket's records; so a URL with
any number of captures is spread over its buckets. Payloads stay out of all this: the result names the response's record.

A null url, one without a host, or a null ts makes a record that nothing refers to and that refers to nothing
(``no_response``). Repeated revisits give repeated rows. Null headers are an empty map. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: the header fields that a 304 updates (RFC 9110, 15.4.5), in lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")

#: Fixed: query parameters that don't identify a page.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def canonical(url: Column) -> Column:
    """host/path?query: without scheme, www., default port, fragment, tracking parameters and a trailing slash; host in lower case, parameters sorted. Null without a host."""
    rest = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?s:(.*))$", 1), r"(?s)#.*", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"^[^?]*\?(?s:(.*))$", 1), "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(rf"^({TRACKING})(=|$)"))))
    whole = F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))
    return F.when(host != "", whole)


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def resolved(captures: DataFrame, *, bucket: int = 86_400) -> DataFrame:
    """One row per revisit: record_id, canonical_url, ts, status, refers_to, refers_ts, refers_digest, merged (map).

    status: resolved, unchecked (the 304 has no validator that the response has), mismatch (of validators; merged is null) or no_response.
    An unchecked 304 is merged too: it names no validator to disagree, and its status lets a caller leave it out. Header names
    are lower-cased; names that differ in case only are one field, its values joined by a comma in order of the spelling.
    """
    headers = F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    e = captures.where("kind in ('response', 'revisit')").select("record_id", canonical(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), "kind", "etag", "last_modified", headers.alias("headers"), "digest")
    e = e.withColumn("slot", F.floor(F.col("ts") / bucket))
    usable = e.where("canonical_url is not null and ts is not null")
    response = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", F.map_entries("headers").alias("headers"), "digest"))
    usable = usable.withColumn("response", response).withColumn("turn", F.when(F.col("kind") == "response", 2).otherwise(1))
    in_slot = usable.groupBy("canonical_url", "slot").agg(F.max_by("response", F.when(F.col("response").isNotNull(), F.struct("ts", "record_id"))).alias("response"))
    earlier = Window.partitionBy("canonical_url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = in_slot.withColumn("response", F.last("response", ignorenulls=True).over(earlier)).where("response is not null")
    rows = usable.select("canonical_url", "slot", "turn", "ts", "record_id", "etag", "last_modified", F.map_entries("headers").alias("headers"), "response")
    carried = carried.select("canonical_url", "slot", F.lit(0).alias("turn"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("ts", "record_id", "etag", "last_modified", "headers")), "response")
    # A carried response first, then by time; of equal times revisits first, as a response must be earlier.
    order = Window.partitionBy("canonical_url", "slot").orderBy(F.col("turn") > 0, "ts", "turn", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.unionByName(carried).withColumn("r", F.last("response", ignorenulls=True).over(order)).where("turn = 1")
    odd = e.where("kind = 'revisit' and (canonical_url is null or ts is null)").select("record_id", "canonical_url", "ts", "etag", "last_modified", F.map_entries("headers").alias("headers"), F.lit(None).cast(found.schema["r"].dataType).alias("r"))
    found = found.select("record_id", "canonical_url", "ts", "etag", "last_modified", "headers", "r").unionByName(odd)
    by_tag, by_time = F.col("etag").isNotNull() & F.col("r.etag").isNotNull(), F.col("last_modified").isNotNull() & F.col("r.last_modified").isNotNull()
    status = F.when(F.col("r").isNull(), "no_response").when(by_tag, F.when(_strong(F.col("etag")) == _strong(F.col("r.etag")), "resolved").otherwise("mismatch"))
    status = status.when(F.col("etag").isNull() & by_time, F.when(F.col("last_modified") == F.col("r.last_modified"), "resolved").otherwise("mismatch")).otherwise("unchecked")
    new = F.filter("headers", lambda h: F.lower(h["key"]).isin(*PERMITTED))
    names = F.transform(new, lambda h: F.lower(h["key"]))
    kept = F.filter("r.headers", lambda h: ~F.array_contains(names, F.lower(h["key"])))
    lowered = lambda a: F.transform(a, lambda h: F.struct(F.lower(h["key"]).alias("key"), h["key"].alias("as"), h["value"].alias("value")))
    fields = F.array_sort(F.concat(lowered(kept), lowered(new)))
    distinct = F.array_distinct(F.transform(fields, lambda h: h["key"]))
    # Fields that differ in case only are one field with several values.
    values = lambda k: F.filter(F.transform(F.filter(fields, lambda h: h["key"] == k), lambda h: h["value"]), lambda v: v.isNotNull())
    merged = F.map_from_arrays(distinct, F.transform(distinct, lambda k: F.when(F.size(values(k)) > 0, F.array_join(values(k), ", "))))
    out = found.withColumn("status", status)
    held = lambda c: F.when(~F.col("status").isin("no_response"), F.col(f"r.{c}"))
    return out.select("record_id", "canonical_url", "ts", "status", held("record_id").alias("refers_to"), held("ts").alias("refers_ts"), held("digest").alias("refers_digest"), F.when(F.col("status").isin("resolved", "unchecked"), merged).alias("merged"))

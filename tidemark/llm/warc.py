"""WARC: not-modified revisits resolved by an as-of join.

A revisit stands for a full response seen before.  It is joined, by canonical
url, to the latest full response that is earlier; the validators both have are
compared; the response's headers are updated by those that a 304 may carry.

The as-of join runs in slots of time: rows are sorted within (url, slot), and
the last response of each slot is carried to the slots after it, so a url that
holds a third of all records is spread over its slots.  Payloads never pass
through the windows: they are joined once, by record, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, q

#: Header fields of a 304 that update the stored response (lower case).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary"]
DEFAULT_PORTS = {"http": "80", "https": "443"}


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, default port and fragment dropped, an empty path as ``/``.

    Null stays null; what has no ``://`` only loses its fragment.
    """
    bare = F.regexp_replace(url, "(?s)#.*$", "")
    scheme = F.translate(F.regexp_extract(bare, "(?s)^([^:/?]*)://", 1), UPPER, LOWER)
    host = F.translate(F.regexp_extract(bare, "(?s)^[^:/?]*://([^/?]*)", 1), UPPER, LOWER)
    rest = F.regexp_extract(bare, "(?s)^[^:/?]*://[^/?]*(.*)$", 1)
    for s, port in DEFAULT_PORTS.items():
        host = F.when(scheme == s, F.regexp_replace(host, f":{port}$", "")).otherwise(host)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(F.regexp_like(bare, F.lit("(?s)^[^:/?]*://")), F.concat(scheme, F.lit("://"), host, path)).otherwise(bare)


def _lowered(headers: Column) -> Column:
    """Names in lower case; of names that then repeat, the last."""
    pairs = F.map_entries(F.coalesce(headers, F.expr("cast(map() as map<string,string>)")))
    names = F.transform(pairs, lambda e: F.lower(e["key"]))
    last = F.filter(
        F.transform(pairs, lambda e, i: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"), i.alias("i"))),
        lambda e: ~F.array_contains(F.slice(names, e["i"] + 2, F.size(names)), e["key"]),
    )
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, slot_width: int = 4096, payload_col: str | None = "payload") -> DataFrame:
    """One row per revisit: record_id, url, ts, refers_to, state, headers and, if asked for, payload.

    ``records`` has record_id, url, ts (long), kind (``response`` or
    ``revisit``), digest (of the payload, or null), headers (map) and the
    payload column.  ``state`` is ``resolved`` (the first of ETag,
    Last-Modified and digest that both have is equal), ``mismatch`` (it is
    not), ``unverified`` (none is shared) or ``missing`` (no earlier response);
    only resolved and unverified rows get headers and payload.

    Defined cases: a response at the revisit's own time is not earlier; of
    responses at one time the one with the largest record_id is the latest; a
    null url or time joins nothing; null headers are empty; other kinds and
    other columns are passed over; rows that repeat a response refer alike,
    and of their payloads the smallest counts; an empty table gives an empty result.
    """
    key = canonical_url(q("url"))
    rows = records.where(q("kind").isin("response", "revisit")).select(
        F.col("record_id"),
        F.col("url"),
        key.alias("key"),
        F.col("ts").cast("long").alias("ts"),
        (F.col("kind") == "response").alias("full"),
        _lowered(F.col("headers")).alias("headers"),
        F.col("digest"),
        F.floor(F.col("ts") / F.lit(slot_width)).cast("long").alias("slot"),
    )
    info = F.when(F.col("full"), F.struct("record_id", "headers", "digest"))
    live = rows.where("key is not null and ts is not null").withColumn("info", info)
    ends = live.groupBy("key", "slot").agg(
        F.max_by("info", F.when(F.col("full"), F.struct("ts", "record_id"))).alias("ending")
    )
    earlier = Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("key", "slot", F.last("ending", ignorenulls=True).over(earlier).alias("carried"))
    # revisits first among equal times: what stands before them is earlier
    order = Window.partitionBy("key", "slot").orderBy("ts", "full", "record_id")
    here = F.last("info", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    asof = (
        live.withColumn("here", here)
        .where("not full")
        .join(carried, ["key", "slot"])
        .select("record_id", "url", "ts", "headers", "digest", F.coalesce("here", "carried").alias("ref"))
    )
    dead = rows.where("not full and (key is null or ts is null)").select(
        "record_id", "url", "ts", "headers", "digest", F.lit(None).cast(asof.schema["ref"].dataType).alias("ref")
    )

    def held(side: str, name: str) -> Column:
        return F.try_element_at(F.col(f"{side}headers"), F.lit(name))

    checks = [
        (_strong(held("", "etag")), _strong(held("ref.", "etag"))),
        (held("", "last-modified"), held("ref.", "last-modified")),
        (F.col("digest"), F.col("ref.digest")),
    ]
    same = F.coalesce(*[a == b for a, b in checks])
    state = (
        F.when(F.col("ref").isNull(), "missing")
        .when(same.isNull(), "unverified")
        .when(same, "resolved")
        .otherwise("mismatch")
    )
    good = F.col("state").isin("resolved", "unverified")
    allowed = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    kept = F.map_filter("ref.headers", lambda k, _: ~F.map_contains_key(allowed, k))
    out = (
        asof.unionByName(dead)
        .withColumn("state", state)
        .select(
            "record_id",
            "url",
            "ts",
            F.col("ref.record_id").alias("refers_to"),
            "state",
            F.when(good, F.map_concat(kept, allowed)).alias("headers"),
        )
    )
    if payload_col is None:
        return out
    bodies = (
        records.where(q("kind") == "response")
        .groupBy(F.col("record_id").alias("body_of"))
        .agg(F.min(q(payload_col)).alias("payload"))
    )
    return out.join(bodies, good & (F.col("refers_to") == F.col("body_of")), "left").drop("body_of")


def pages_as_records(pages: DataFrame, revisit_after: int = 500) -> DataFrame:
    """Captures from a table of pages: a full response for each page and a not-modified revisit somewhat later.

    Time runs with page_id, two ticks a page; the revisit of a page comes
    ``revisit_after`` pages later and repeats the validators of that page, so it
    meets another response where a page in between has the same canonical url.
    """
    etag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    full = pages.select(
        (2 * F.col("page_id")).alias("record_id"),
        "url",
        (2 * F.col("page_id")).alias("ts"),
        F.lit("response").alias("kind"),
        F.sha1(F.col("html").cast("binary")).alias("digest"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html"),
            F.lit("Content-Length"), F.length("html").cast("string"),
            F.lit("ETag"), etag,
            F.lit("Cache-Control"), F.lit("max-age=60"),
        ).alias("headers"),
        F.col("html").alias("payload"),
    )
    again = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"),
        "url",
        (2 * (F.col("page_id") + revisit_after) + 1).alias("ts"),
        F.lit("revisit").alias("kind"),
        F.lit(None).cast("string").alias("digest"),
        F.create_map(
            F.lit("etag"), F.concat(F.lit("W/"), etag),
            F.lit("Cache-Control"), F.lit("max-age=3600"),
            F.lit("Content-Length"), F.lit("0"),
        ).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return full.unionByName(again)

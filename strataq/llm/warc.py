"""WARC records, and resolving not-modified revisits.

A revisit with the profile *server-not-modified* has no body: it stands for the latest earlier full response of the same
canonical URL.  `resolve` finds that response with an as-of join, checks the validators (ETag if both have one, else
Last-Modified) and merges the headers that a 304 may update (RFC 9111, section 3.2).

The as-of join is a scan over ranges: captures are sorted by URL and time into ranges of about equal numbers of rows, whatever
the URLs.  Within a range a window finds the last response before a revisit; the last response of each URL and range is
carried to the URL's next ranges by a window over that summary, which has one row per URL and range.  So a URL that holds a
third of all captures, even of one day, is as many tasks as its rows fill.  Headers travel with their row, so nothing is
joined by record id; bodies don't move: the result points at the response.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import Scratch, checkpoint, ranged

#: Headers that describe the body or the connection and stay as stored.
FIXED = ("content-length", "content-encoding", "content-type", "content-range", "content-md5", "transfer-encoding", "connection", "keep-alive", "proxy-connection", "te", "trailer", "upgrade", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization")
RECORD = "record_id string, type string, url string, date string, profile string, status int, headers map<string,string>, body binary"
TRACKING = "utm_source|utm_medium|utm_campaign|utm_term|utm_content|gclid|fbclid|ref"


def canonical_url(url: Column) -> Column:
    """Scheme dropped, host in lower case without `www.` and default port, no fragment, tracking parameters or final slash."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, "^([^/?]*)", 1))
    rest = F.regexp_replace(u, "^[^/?]*", "")
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    for _ in range(2):  # neighbouring parameters share a separator
        rest = F.regexp_replace(rest, rf"([?&])(?:{TRACKING})=[^&]*(&|$)", "$1")
    rest = F.regexp_replace(rest, "[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, r"/+(\?|$)", "$1"))


def _members(raw: bytes) -> bytes:
    """A file's bytes; each record of a .gz file is a gzip member of its own."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw:
        d = zlib.decompressobj(31)
        out.append(d.decompress(raw) + d.flush())
        raw = d.unused_data
    return b"".join(out)


def _head(raw: bytes) -> tuple[str, dict[str, str]]:
    """First line and headers, names in lower case; lines of one name are combined, as in RFC 9110, section 5.3."""
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    out: dict[str, str] = {}
    for k, _, v in (x.partition(":") for x in lines if ":" in x):
        k, v = k.strip().lower(), v.strip()
        out[k] = f"{out[k]}, {v}" if k in out else v
    return first, out


def records(raw: bytes) -> Iterator[Row]:
    """The records of a WARC file; one that is cut off or has no length ends the file."""
    raw, at = _members(raw), 0
    while (start := raw.find(b"WARC/", at)) >= 0:
        end = raw.find(b"\r\n\r\n", start)
        if end < 0:
            return
        _, h = _head(raw[start:end])
        if not h.get("content-length", "").isdigit():
            return
        n = int(h["content-length"])
        block = raw[end + 4 : end + 4 + n]
        at = end + 4 + n
        if len(block) < n:
            return
        status, http, body = None, {}, block
        if h.get("warc-type") in ("response", "revisit") and block[:5] == b"HTTP/":
            top, _, body = block.partition(b"\r\n\r\n")
            line, http = _head(top)
            code = line.split(" ")[1:2]
            status = int(code[0]) if code and code[0].isdigit() else None
        yield Row(record_id=h.get("warc-record-id"), type=h.get("warc-type"), url=h.get("warc-target-uri", "").strip("<>") or None, date=h.get("warc-date"), profile=h.get("warc-profile"), status=status, headers=http, body=body)


def read_warc(files: DataFrame) -> DataFrame:
    """Records of `files` (as of Spark's binaryFile source), one task per file; a file is held whole, its records are not."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for raw in pdf["content"]:
                own = records(bytes(raw))
                while rows := [r.asDict() for r in islice(own, 200)]:
                    yield pd.DataFrame(rows, columns=["record_id", "type", "url", "date", "profile", "status", "headers", "body"]).astype({"status": "Int32"})

    return files.select("content").mapInPandas(run, RECORD)


def write_record(r: dict, compress: bool = True) -> bytes:
    """One record as bytes, a gzip member with `compress`."""
    reason = {200: "OK", 304: "Not Modified"}.get(r["status"], "")
    http = f"HTTP/1.1 {r['status']} {reason}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in r["headers"].items()) + "\r\n"
    block = http.encode() + (r.get("body") or b"")
    head = f"WARC/1.1\r\nWARC-Type: {r['type']}\r\nWARC-Record-ID: {r['record_id']}\r\nWARC-Target-URI: {r['url']}\r\nWARC-Date: {r['date']}\r\n"
    if r.get("profile"):
        head += f"WARC-Profile: {r['profile']}\r\n"
    raw = head.encode() + f"Content-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0) if compress else raw


def is_not_modified(kind: Column, status: Column, profile: Column) -> Column:
    """By status or profile: a revisit stored without an HTTP block has no status."""
    return F.coalesce(kind == "revisit", F.lit(False)) & (F.coalesce(status == 304, F.lit(False)) | F.coalesce(profile.rlike("(^|/)server-not-modified/?$"), F.lit(False)))


def is_full(kind: Column, status: Column) -> Column:
    return (kind == "response") & (status == 200)


def lower_names(headers: Column) -> Column:
    """Headers as a sorted array of (key, value) with names in lower case; values of names that differ in case only are
    combined with `, ` in the map's order, as in RFC 9110, section 5.3.  Null headers are none."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    low = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(low, lambda e: e["key"]))
    of = lambda k: F.array_join(F.transform(F.filter(low, lambda e: e["key"] == k), lambda e: e["value"]), ", ")
    merged = F.transform(names, lambda k: F.struct(k.alias("key"), of(k).alias("value")))
    return F.array_sort(F.when(F.size(names) == F.size(low), low).otherwise(merged))


def resolve(captures: DataFrame, fixed: tuple[str, ...] = FIXED, parts: int | None = None) -> DataFrame:
    """One row per not-modified revisit of `captures` (record_id, type, url, ts, status, headers and, if it is
    there, profile; others are ignored).

    Returns record_id, canonical, ts, outcome, response_id, headers.  outcome: `resolved`; `no_response` without an earlier
    full response; `no_validator` where no validator is on both sides; `mismatch` where they differ.  Only a resolved row
    has headers.  Of captures at one time a response comes before a revisit, then record_id decides, then the headers.  Null
    URL or time: the revisit is `no_response`, the response is never found.  Rows that are equal in all these columns count
    once; rows that share a record_id, or have none, are rows of their own otherwise, and a response without one is found,
    with a null response_id.  Header names that differ in case only are one (`lower_names`).
    """
    spark = captures.sparkSession
    profile = F.col("profile") if "profile" in captures.columns else F.lit(None).cast("string")
    c = captures.select(F.col("record_id").cast("string").alias("record_id"), profile.alias("profile"), F.col("type").alias("type"), canonical_url(F.col("url")).alias("canonical"), F.col("ts").cast("long").alias("ts"), F.col("status").alias("status"), lower_names(F.col("headers")).alias("h"))
    placed = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    c = c.withColumn("full", F.coalesce(is_full(F.col("type"), F.col("status")), F.lit(False)))
    c = c.where(F.col("full") & placed | is_not_modified(F.col("type"), F.col("status"), F.col("profile"))).select("canonical", "ts", "full", "record_id", "h", "profile", "status").distinct()
    order = [F.col("ts"), F.col("full").desc(), F.col("record_id"), F.col("h"), F.col("profile"), F.col("status")]
    with Scratch(spark) as s:
        c = s.table(ranged(c, [F.col("canonical"), *order], "part", parts), "ranges")
        at = F.struct(F.col("record_id"), F.col("h"))
        near = F.last(F.when(F.col("full"), at), ignorenulls=True).over(Window.partitionBy("part", "canonical").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        last = F.max_by(at, F.struct("ts", "record_id", "h"))
        of_part = c.where("full").groupBy("part", "canonical").agg(last.alias("last"))
        # a URL needs its earlier ranges only where it has any: in the first rows of a range
        crossing = c.where(placed).select("part", "canonical").distinct().withColumn("n", F.count("*").over(Window.partitionBy("canonical"))).where("n > 1").select("part", "canonical")
        before = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        carried = crossing.join(of_part, ["part", "canonical"], "left").withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("carried is not null").select("part", "canonical", "carried")
        found = c.withColumn("near", near).where(~F.col("full")).join(carried, ["part", "canonical"], "left")
        hit = F.when(placed, F.coalesce("near", "carried"))
        out = found.select("record_id", "canonical", "ts", F.col("h").alias("new"), hit.alias("hit"))
        value = lambda h, k: F.element_at(F.filter(h, lambda e: e["key"] == k), 1)["value"]
        first = lambda h, k: F.when(F.exists(h, lambda e: e["key"] == k), value(h, k))
        old = F.col("hit.h")
        tag = lambda h: F.regexp_replace(first(h, "etag"), "^W/", "")
        same = F.coalesce(tag(F.col("new")) == tag(old), first(F.col("new"), "last-modified") == first(old, "last-modified"))
        outcome = F.when(F.col("hit").isNull(), "no_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("mismatch")
        keep = F.filter("new", lambda e: ~e["key"].isin(*fixed))
        names = F.transform(keep, lambda e: e["key"])
        merged = F.map_from_entries(F.concat(F.filter(old, lambda e: ~F.array_contains(names, e["key"])), keep))
        return checkpoint(out.select("record_id", "canonical", "ts", outcome.alias("outcome"), F.col("hit.record_id").alias("response_id"), F.when(outcome == "resolved", merged).alias("headers")))

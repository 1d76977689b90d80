"""Canonical records as column expressions, for logs and comments that are rows already."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCESS = r'^(\S+) \S+ (\S+) \[(.*?)\] "(\S+) (\S+) (\S+)" (\d+) (\d+)(?: "([^"]*)" "([^"]*)")?'


def access_log(line: Column) -> Column:
    """A log record (struct) of an access line; null for any other line.  The time's offset is ignored."""
    g = lambda i: F.regexp_extract(line, _ACCESS, i)
    status = g(7).cast("int")
    level = F.when(status >= 500, "ERROR").when(status >= 400, "WARN").otherwise("INFO")
    at = F.try_to_timestamp(F.substring(g(3), 1, 20), F.lit("dd/MMM/yyyy:HH:mm:ss"))
    data = F.struct(g(1).alias("remote_addr"), g(2).alias("remote_user"), g(8).cast("long").alias("body_bytes"), g(9).alias("referer"), g(10).alias("user_agent"), g(3).alias("raw_time"))
    out = F.struct(at.alias("timestamp"), level.alias("level"), F.concat_ws(" ", g(4), g(5), g(7)).alias("message"), F.lit("nginx").alias("source"), data.alias("data"))
    return F.when(F.regexp_like(line, F.lit(_ACCESS)), out)


_MARK = r"(//|#|--|/\*|^\s*\*)\s*(TODO|FIXME|OPTIMIZE|XXX):?\s*(.*)$"


def comment_tasks(text: Column) -> Column:
    """Tasks (array of structs) of the marked comments of a source text."""

    def task(line: Column) -> Column:
        g = lambda i: F.regexp_extract(line, _MARK, i)
        priority = F.when((g(2) == "FIXME") | F.regexp_like(g(3), F.lit("(?i)bug|leak|crash|urgent")), "high").when(g(2) == "OPTIMIZE", "low").otherwise("medium")
        return F.struct(F.regexp_replace(g(3), r"\s*\*/$", "").alias("title"), F.lit("open").alias("status"), priority.alias("priority"), F.array(F.lit("todo"), F.lower(g(2))).alias("tags"), g(1).alias("comment_style"))

    return F.transform(F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(_MARK))), task)


def git_status(status: Column) -> Column:
    return F.when(status == "M", "MODIFIED").when(status == "A", "ADDED").when(status == "D", "DELETED").when(status == "R", "RENAMED").otherwise("UNKNOWN")


def decode_html(text: Column) -> Column:
    """`&amp;` first, so a doubly encoded mark decodes twice."""
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#x60;", "`")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text

"""URL filters as a temporal list join: an as-of join of captures with dated list entries.

Entries say that a list took up or dropped a pattern at a time. Per list and pattern they become disjoint validity
intervals [from, to). A capture has a key for every pattern that could cover it (its host, each parent domain, each path
prefix), and it is evaluated against the intervals of its keys that hold its fetch time: an equi-join on the key and on a
slice of time, then the bounds. Intervals are cut at slices, so a pattern with a long history meets a capture with one
slice of it only.

Keys that a great part of all captures has (a large site) are split: there are at most HOT_SHARE of them, since each has
over 1 / HOT_SHARE of all keys, so their list may be broadcast; their captures are spread by a salt and their intervals
are repeated for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import has_columns

DAY = 86_400
SLICE_DAYS = 64
HOT_SHARE, HOT_ROWS = 1000, 200_000
#: Lists by what a match means; a match on an allowing list overrides blocking ones.
BLOCK, ALLOW = "block", "allow"


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port or a last dot; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\s]*@)?([^/?#:@\s]+)", 1))
    return F.nullif(F.regexp_replace(found, r"\.+$", ""), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*(/[^?#\s]*)", 1)


def keys(url: Column) -> Column:
    """Array of the patterns that cover a URL: 'host:h', 'domain:d' for the host and its parents of two labels or more, and
    'prefix:h/a/' for the directories of its path and 'prefix:h/a/b' for the whole of it."""
    h, parts = host(url), F.filter(F.split(path(url), "/"), lambda x: x != "")
    labels = F.split(h, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )
    dirs = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: i > 0),
        lambda i: F.concat(F.lit("prefix:"), h, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"), F.when(i < F.size(parts), "/").otherwise("")),
    )
    return F.when(h.isNotNull(), F.array_distinct(F.concat(F.array(F.concat(F.lit("host:"), h)), domains, dirs)))


def validity(entries: DataFrame) -> DataFrame:
    """(list, effect, pattern, from, to) from entries (list, effect, pattern, action, at): to is null while it still holds.

    Actions are 'add' and 'remove'. Of several at one time the removal counts. Adding what is there and removing what
    isn't change nothing. Entries with a null list, pattern or time are left out; a null effect blocks.
    """
    has_columns(entries, ("list", "effect", "pattern", "action", "at"))
    known = entries.filter(F.col("list").isNotNull() & F.col("pattern").isNotNull() & F.col("at").isNotNull())
    at = known.groupBy("list", F.coalesce("effect", F.lit(BLOCK)).alias("effect"), "pattern", "at").agg(F.bool_and(F.col("action") == "add").alias("on"))
    w = Window.partitionBy("list", "effect", "pattern").orderBy("at")  # one pattern's history
    changes = at.withColumn("was", F.lag("on", 1, False).over(w)).filter("on <> was")
    spans = changes.withColumn("to", F.lead("at").over(w)).filter("on")
    return spans.select("list", "effect", "pattern", F.col("at").alias("from"), "to")


def _slice(t: Column) -> Column:
    return F.floor(F.unix_seconds(t) / (SLICE_DAYS * DAY))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row per row of captures: <id_col>, host, n_blocking, lists (sorted, blocking lists that match), allowed, blocked.

    Times are timestamps. blocked: some blocking list matches at the fetch time and no allowing one does. A capture
    without a host or without a fetch time matches nothing. Captures that repeat id, URL and time are as many rows with
    one decision. Other columns are not read.
    """
    has_columns(captures, (id_col, url_col, time_col))
    src = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("at"))
    src = src.withColumn("row", F.struct(*(F.xxhash64(F.lit(k), "id", "url", "at").alias(k) for k in "ab")))
    times = src.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    spans = validity(entries)
    if times["lo"] is None:
        spans = spans.limit(0)
    lo, hi = F.lit(times["lo"]), F.lit(times["hi"])
    live = spans.filter((F.col("from") <= hi) & (F.col("to").isNull() | (F.col("to") > lo)))
    ends = F.least(F.coalesce("to", hi), hi)
    cut = live.withColumn("slice", F.explode(F.sequence(_slice(F.greatest("from", lo)), _slice(ends))))

    wide = src.filter("at is not null").select("row", "at", F.explode(keys(F.col("url"))).alias("pattern"))
    counts = wide.groupBy("pattern").count()
    total = F.lit(counts.agg(F.sum("count")).first()[0] or 0)
    limit = F.greatest(F.lit(HOT_ROWS), total / HOT_SHARE)
    hot = F.broadcast(counts.filter(F.col("count") > limit).select("pattern", F.ceil(F.col("count") / limit).cast("int").alias("salts")))
    salted = wide.join(hot, "pattern", "left").withColumn(
        "salt", F.coalesce(F.pmod("row.a", F.col("salts")), F.lit(0)).cast("int")
    ).withColumn("slice", _slice(F.col("at")))
    spread = cut.join(hot, "pattern", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    hit = salted.join(spread.select("pattern", "slice", "salt", "list", "effect", "from", "to"), ["pattern", "slice", "salt"])
    hit = hit.filter((F.col("at") >= F.col("from")) & (F.col("to").isNull() | (F.col("at") < F.col("to"))))
    decided = hit.groupBy("row").agg(
        F.collect_set(F.when(F.col("effect") != ALLOW, F.col("list"))).alias("lists"), F.bool_or(F.col("effect") == ALLOW).alias("allowed")
    )
    joined = src.join(decided, "row", "left")
    none = F.array().cast("array<string>")
    lists, allowed = F.array_sort(F.coalesce("lists", none)), F.coalesce("allowed", F.lit(False))
    return joined.select(
        F.col("id").alias(id_col), host(F.col("url")).alias("host"), F.size(lists).cast("long").alias("n_blocking"), lists.alias("lists"), allowed.alias("allowed"), ((F.size(lists) > 0) & ~allowed).alias("blocked")
    )

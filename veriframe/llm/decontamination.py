"""Benchmark decontamination as a prefix-filtered set join; DataFrame operations only.

A window (8 consecutive item words, or all words of a shorter item) occurs in a document only if all its words do, so
the necessary prefix of a window under any order is one word. Words are ordered by rarity over all documents; a window
is filed under its rarest word alone. Documents' words join that table; a match at word p of a window whose rarest word
is its o-th can only start at p - o, which must leave room for the window's length (positional and length bounds), and
then the words themselves are compared.

The side that is broadcast holds windows of the benchmark. It is counted first and cut into blocks of at most
`block_windows` windows; each block is one pass over the documents, so no block outgrows a task's memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import ascii_lower, has_columns

#: What stands between words; it is the same to cut there as to look for words, but three times as fast.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 8
#: Up to so many different words of the benchmark are sent to the executors, so that no others are counted.
BROADCAST_WORDS = 500_000
#: A word no text has: it stands for the document itself, so one pass gives matches and a row for every document.
_END = "\x00"


def words(text: Column) -> Column:
    """Array of words; empty for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BETWEEN), ""), F.array().cast("array<string>"))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item string, win array, win_key string), distinct; items without words have none."""
    w = items.select(F.col("item").cast("string").alias("item"), words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    wins = w.filter(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win"))
    return wins.withColumn("win_key", F.array_join("win", " ")).distinct()


def rarest_words(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """(win_key, win, token, at): every distinct window with the word of it that fewest documents hold, ties by position."""
    placed = wins.select("win_key", "win").distinct().select("win_key", "win", F.posexplode("win").alias("at", "token"))
    held = docs.select(F.explode(F.array_distinct("w")).alias("token"))
    wanted = placed.select("token").distinct()
    if wanted.count() <= BROADCAST_WORDS:  # else all words are counted; the result is the same
        held = held.join(F.broadcast(wanted), "token", "left_semi")
    counts = held.groupBy("token").count()  # combined map side, so common words don't move
    ranked = placed.join(counts, "token", "left").groupBy("win_key").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "at", "token")).alias("rare"), F.first("win").alias("win")
    )
    return ranked.select("win_key", "win", "rare.token", "rare.at")


def _occurrences(docs: DataFrame, block: DataFrame, with_end: bool) -> DataFrame:
    """Rows (id, h, n, start, m, win_key) of windows of the block that occur; with_end adds a row of m = 0 a document."""
    if with_end:
        end = block.sparkSession.range(1).select(
            F.lit(None).cast("string").alias("win_key"), F.array().cast("array<string>").alias("win"), F.lit(_END).alias("token"), F.lit(0).alias("at")
        )
        block = block.unionByName(end)
    spread = docs.select("id", "h", "w", F.posexplode(F.concat("w", F.array(F.lit(_END)))).alias("p", "token"))
    hit = spread.join(F.broadcast(block), "token")
    start = F.col("p") - F.col("at")
    fits = (start >= 0) & (start + F.size("win") <= F.size("w"))
    same = F.slice("w", start + 1, F.size("win")) == F.col("win")
    return hit.filter(F.col("win_key").isNull() | (fits & same)).select(
        "id", "h", F.size("w").alias("n"), start.alias("start"), F.size("win").alias("m"), "win_key"
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    min_items: int = 2,
    block_windows: int = 200_000,
) -> DataFrame:
    """One row per row of docs: <id_col>, n_words, n_hit, n_items, items_sha256, contaminated, items, spans,
    text_hash (xxhash64 of the text).

    items are the item ids with an occurring window, sorted as strings; spans the (start, length) of occurrences in
    words. Null or wordless texts have no words and no hits; null or wordless items have no windows, and without any
    window every document is clean. Items with a null id are left out. Rows of docs that repeat stay as many. Other
    columns are not read. A window that several items share counts for each.
    """
    has_columns(docs, (id_col, text_col))
    has_columns(benchmark, (item_col, item_text_col))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter(F.col("item").isNotNull())
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), words(F.col(text_col)).alias("w"))
    wins = materialize(item_windows(items, window), "windows")
    table = materialize(rarest_words(source, wins), "rarest")
    n_blocks = max(1, -(-table.count() // block_windows))
    parts = [
        _occurrences(source, table.filter(F.pmod(F.xxhash64("win_key"), F.lit(n_blocks)) == b) if n_blocks > 1 else table, b == 0)
        for b in range(n_blocks)
    ]
    all_ = reduce(DataFrame.unionByName, parts)
    # rows that only stand for documents have a key each, so that they are spread however the join is done
    keyed = all_.withColumn("win_key", F.coalesce("win_key", F.concat(F.lit(_END), F.col("h").cast("string"))))
    found = keyed.join(wins.select("win_key", "item"), "win_key", "left")
    ended = F.col("m") == 0
    per_doc = found.groupBy("id", "h").agg(
        F.max("n").alias("n_words"),
        F.count_if(ended).alias("copies"),
        F.collect_set(F.when(~ended, F.struct("start", "m"))).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["m"] - 1)))))
    out = per_doc.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
        "items",
        F.array_sort("spans").alias("spans"),
        F.col("h").alias("text_hash"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    )
    return out.drop("_copy")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, one_window: bool = False, **options
) -> DataFrame:
    """The rows of docs, all columns, that aren't contaminated. one_window: nor hold a window of `window` words, of whatever item.

    Shorter items, which can be a single common word, count towards min_items only.
    """
    found = decontaminate(docs, benchmark, id_col, text_col, window=window, **options)
    bad = F.col("contaminated")
    if one_window:
        bad = bad | F.exists("spans", lambda s: s["m"] >= window)
    found = found.filter(bad)
    gone = materialize(found.select(F.col(id_col).alias("_id"), "text_hash").distinct(), "contaminated")
    same = docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["text_hash"])
    return docs.join(gone, same, "left_anti")

"""Exact dedup over an extendible-hash index kept on shared files; DataFrame operations only.

1. One narrow scan gives rows and bytes by the 64-bit key of the text, combined map side. Its table tells the load of each
   range of keys and which keys are hot.
2. A directory is grown by doubling: a bucket with a load over `capacity` splits on its next key bit. It is made from the
   loads of 2**depth ranges, `depth` following the whole load, so the driver never holds keys.
3. Each text goes once, to the task that owns the range of buckets its key is in. The owner sorts by key and bytes, so
   equal bytes stand together, and different texts of one key form a chain there, whose links are numbered. It needs no
   other exchange. What it writes to the shared folder is the index: an entry a row, by bucket, and the result is read off it.
4. A key with over a HOT_SHARE-th of all rows or of all bytes (there are fewer than twice HOT_SHARE) doesn't go to one
   owner: its texts are aggregated map side first, as text and count, and its rows are marked where they lie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize, release
from .common import has_columns

#: Load of a bucket: rows, and a row more for each BLOCK bytes of a text.
CAPACITY, BLOCK = 1 << 12, 4096
#: Ranges whose loads the driver takes: 2**MAX_DEPTH at most.
MAX_DEPTH = 20
#: The least rows and the least load of a hot key.
HOT_SHARE, HOT_ROWS, HOT_LOAD = 1000, 10_000, 8192


def grow_directory(counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """(global depth, bucket number of each slot) for loads by max_depth-bit prefix.

    Starts as one bucket; an overfull one splits, and when its local depth is the global one the directory doubles.
    A bucket that is still overfull at max_depth stays so: its owner has more to sort. Buckets are numbered in prefix order.
    """
    sums = [0] * ((1 << max_depth) + 1)
    for p in range(1 << max_depth):
        sums[p + 1] = sums[p] + counts.get(p, 0)

    def load(prefix: int, depth: int) -> int:
        lo = prefix << (max_depth - depth)
        return sums[lo + (1 << (max_depth - depth))] - sums[lo]

    done, todo, depth = [], [(0, 0)], 0
    while todo:
        prefix, local = todo.pop()
        if local < max_depth and load(prefix, local) > capacity:
            todo += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]
            depth = max(depth, local + 1)
        else:
            done.append((prefix, local))
    slots = [0] * (1 << depth)
    for bucket, (prefix, local) in enumerate(sorted(done, key=lambda b: b[0] << (max_depth - b[1]))):
        for slot in range(prefix << (depth - local), (prefix + 1) << (depth - local)):
            slots[slot] = bucket
    return depth, slots


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth).cast("int") if depth else F.lit(0)


def _at(values: list[int], place: Column) -> Column:
    folded = F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")  # becomes one array literal
    return F.get(folded, place)


def plan(keys: DataFrame, capacity: int) -> tuple[int, list[int], list[int]]:
    """(depth, bucket of each slot, hot keys) for keys (h, n, load)."""
    total = keys.agg(F.sum("n"), F.sum("load")).first()
    n, load = (int(x or 0) for x in total)
    many = (F.col("n") > max(HOT_ROWS, n // HOT_SHARE)) | (F.col("load") > max(HOT_LOAD, load // HOT_SHARE))
    hot = [r["h"] for r in keys.filter(many & (F.col("n") > 1)).select("h").collect()]  # under 2 * HOT_SHARE rows
    ranges = min(MAX_DEPTH, max(load // capacity, 1).bit_length() + 2)  # 2**ranges is 4 to 8 times the buckets that are needed
    cold = keys.filter(~F.col("h").isin(hot)) if hot else keys
    cells = cold.groupBy(_prefix(F.col("h"), ranges).alias("p")).agg(F.sum("load").alias("load")).collect()
    return *grow_directory({r["p"]: int(r["load"]) for r in cells}, capacity, ranges), hot


def owned(src: DataFrame, depth: int, slots: list[int], owners: int) -> DataFrame:
    """Entries (id, h, bucket, link, keep_id, n, sha) of rows (id, t, h): texts go to the owners of their buckets, once.

    link is the place of the text in the chain of its key. An owner has as many neighbouring buckets as any other.
    """
    n = slots[-1] + 1
    bucket = _at(slots, _prefix(F.col("h"), depth)) if depth else F.lit(0)
    placed = src.withColumn("bucket", bucket).withColumn("owner", F.floor(F.col("bucket") * F.lit(owners) / F.lit(n)).cast("int"))
    there = placed.repartitionById(owners, "owner")
    same = Window.partitionBy("h", "owner", "t")  # the key first: the sort compares bytes only where keys are equal
    chain = Window.partitionBy("h", "owner").orderBy("t")
    counted = [F.max("id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("n"), F.dense_rank().over(chain).alias("link")]
    found = there.select("id", "h", "t", "bucket", *counted)
    return found.select("id", "h", "bucket", "link", "keep_id", "n", F.unhex(F.sha2("t", 256)).alias("sha"))


def _hot_entries(src: DataFrame) -> DataFrame:
    """The same entries (in no bucket) of rows of hot keys, which stay where they are."""
    texts = materialize(src.groupBy("h", "t").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "hot")
    chain = Window.partitionBy("h").orderBy("t")
    links = texts.select("h", "t", "keep_id", "n", F.dense_rank().over(chain).alias("link"))
    if links.filter("link > 1").isEmpty():  # a row a hot key, fewer than 2 * HOT_SHARE: small enough to be sent
        both = src.join(F.broadcast(links.drop("t")), "h")
    else:
        both = src.join(links, ["h", "t"])
    return both.select("id", "h", F.lit(None).cast("int").alias("bucket"), "link", "keep_id", "n", F.unhex(F.sha2("t", 256)).alias("sha"))


def build_index(docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The index of docs as a table in the shared folder: entries (id, h, bucket, link, keep_id, n, sha), one a row of docs."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    src = src.withColumn("h", key(F.col("t")).cast("long"))
    size = F.lit(1) + F.floor(F.octet_length("t") / BLOCK)
    keys = materialize(src.select("h", size.alias("size")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("load")), "keys")
    depth, slots, hot = plan(keys, capacity)
    release(docs.sparkSession, keys)
    owners = min(slots[-1] + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not hot:
        return materialize(owned(src, depth, slots, owners), "index")
    is_hot = F.col("h").isin(hot)
    return materialize(owned(src.filter(~is_hot), depth, slots, owners).unionByName(_hot_entries(src.filter(is_hot))), "index")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    key: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per row of docs: <id_col>, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest id stays.
    Other columns of docs, whatever their names, are not read. A null id is below all others (keep_id is null where
    a group has no other) and is kept only then. Rows that repeat both id and text each count in group_size and share
    one decision. An empty table gives an empty result. `key` is a parameter for tests of colliding keys.
    """
    has_columns(docs, (id_col, text_col))
    return build_index(docs, id_col, text_col, capacity, key).select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )

"""SimHash near-dedup by anchor-point covering.

Anchors are the codewords of perfect codes over groups of fingerprint bits: of the Golay code over 23 bits, over two such
groups where there are many fingerprints, and of the Hamming code over 15 more bits beyond that. A fingerprint's home is the
one anchor within the codes' covering radii (3, 3, 1). It is replicated to every anchor within radius plus threshold, so of
two fingerprints that differ in `threshold` bits or fewer, each reaches the other's home; they are compared there, an
equi-join on the anchor. Over several groups the excess over the radii is shared between them, as the differing bits are.
A further group multiplies replicas by 2.5 to 3 and divides the fingerprints that an anchor is home to by its number of
codewords, so comparisons stay in proportion to the fingerprints.

Equal fingerprints are one row before any of that, and links go through large-star/small-star components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import has_columns, in_arrow, unused
from ..operators.components import components
from .golay import GOLAY, HAMMING

BITS = 64
SHINGLE = 3
#: (first bit, code) of the groups, and the number of distinct fingerprints from which so many of them are used: 4,096
#: anchors, 2**24, 2**35. A comparison costs about a fiftieth of a replica, so each is the cheapest up to the next.
GROUPS = ((0, GOLAY), (23, GOLAY), (46, HAMMING))
GROUPS_FROM = (0, 400_000, 1_000_000_000)
SEED = 42
_ROW_TYPE = "struct<a:bigint,b:bigint>"


def shingle_hashes(text: str, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the text's word shingles, in pieces. Only A-Z are lower-cased; words end at ASCII white space."""
    data = text.encode("utf-8", "surrogatepass")
    h = xxhash.xxh64_intdigest
    words = data.lower().split()
    if not words:
        return
    size = min(size, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = len(words) - size + 1
    for i in range(0, n, 1 << 15):
        j = min(n, i + (1 << 15))
        spans = zip(starts[i:j].tolist(), ends[i + size - 1 : j + size - 1].tolist())
        yield np.fromiter((h(joined[a:b], SEED) for a, b in spans), np.uint64, j - i)


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint: a bit is 1 if set in over half the shingles' hashes; 0 without words."""
    total, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text or ""):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        part = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8)  # 255 ones still fit
        total += part.sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:  # a text is taken from the batch only when its turn comes
        texts = batch.column(2)
        fps = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps)], names=["id", "row", "fp"])


def anchor_rows(fp: np.ndarray, groups: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) over fingerprints: every anchor within radius plus threshold; home marks those within the radius."""
    row, anchor, excess = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64)
    for shift, code in GROUPS[:groups]:
        r, a, e = code.anchors(((fp.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << code.length) - 1)).astype(np.int64), threshold)
        start = np.searchsorted(r, np.arange(len(fp) + 1))
        n = (start[1:] - start[:-1])[row]
        left = np.repeat(np.arange(len(row)), n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[row], n)
        both = excess[left] + e[right]
        ok = both <= threshold
        left, right = left[ok], right[ok]
        row, anchor, excess = row[left], anchor[left] << code.length | a[right], both[ok]
    return row, anchor, excess == 0


def _replicas(groups: int, threshold: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fp = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(all_fp), 1024):
                fp = all_fp[i : i + 1024]
                row, anchor, home = anchor_rows(fp, groups, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row]), pa.array(home)], names=["anchor", "fp", "home"])

    return run


def near_links(fps: DataFrame, threshold: int = 2, groups: int | None = None) -> DataFrame:
    """(u, v), u < v as signed numbers, for all pairs of the distinct fingerprints fps(fp) that differ in 1..threshold bits."""
    if groups is None:
        n = fps.count()
        groups = sum(n >= least for least in GROUPS_FROM)
    reps = fps.select("fp").transform(in_arrow(_replicas(groups, threshold), "anchor long, fp long, home boolean"))
    at_home = reps.filter("home").select("anchor", F.col("fp").alias("u"))
    pairs = at_home.join(reps.select("anchor", F.col("fp").alias("v")), "anchor")
    return pairs.filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold)).select("u", "v")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, groups: int | None = None) -> DataFrame:
    """One row per row of docs: <id_col>, fingerprint (16 hex digits), component_id (smallest id reachable over links), row,
    kept. Ids are of any type that has an order.

    Null, empty and wordless texts have fingerprint zero and link like any other. Null ids take part, but a component's
    id is the smallest that isn't null (null if it has no other). kept marks the row of that id; of rows without any id,
    or of one id, that with the smallest `row`, 128 bits of hashes of id and text. Rows that repeat both are returned as often, with
    one decision. Other columns are not read. An empty table gives an empty result.
    """
    has_columns(docs, (id_col, text_col))
    src = docs.select(F.col(id_col).alias("id"), row_hash(docs, id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    marked = materialize(src.transform(in_arrow(_fingerprints, f"id {id_type}, row {_ROW_TYPE}, fp long")), "simhash")
    first = F.struct(F.isnull("id").alias("none"), "id", "row")
    distinct = materialize(marked.groupBy("fp").agg(F.min(first).alias("least")), "fingerprints")
    nodes = components(near_links(distinct, threshold, groups))
    linked = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp")
    leasts = linked.groupBy("root").agg(F.min("least").alias("of_all"))
    named = linked.join(leasts, "root").select("fp", "of_all")
    of_fp = distinct.join(named, "fp", "left").select("fp", F.coalesce("of_all", "least").alias("of_all"))
    found = marked.join(of_fp, "fp")
    return found.select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("of_all.id").alias("component_id"),
        "row",
        (F.col("row") == F.col("of_all.row")).alias("kept"),
    )


def row_hash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.struct(*(F.xxhash64(F.lit(f"row {k}"), docs[id_col], docs[text_col]).alias(k) for k in "ab"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2) -> DataFrame:
    """The rows of docs, all columns, that are kept: one of each component."""
    kept = simhash_dedup(docs, id_col, text_col, threshold).filter("kept").groupBy("row").count()
    kept = materialize(kept, "kept")
    name = unused(docs, "row")
    marked = docs.withColumn(name, row_hash(docs, id_col, text_col))
    left = marked.join(kept.select(F.col("row").alias(name)), name, "left_semi")
    if not kept.filter("count > 1").isEmpty():
        left = left.dropDuplicates([name])
    return left.select(*docs.columns)

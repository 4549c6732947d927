"""Line dedup, exact and within one edit, by a deletion-neighbourhood join.

Lines are ordered by (document id, hash of its text, line number). A line goes if an earlier line of the corpus is equal
to it or, the shorter of the two having at least `near_chars` characters, within one character edit of it: of five
characters on, one edit leaves four fifths of a line as they are, a similarity of 0.8. Whether that earlier line is itself
removed makes no difference, so the result doesn't depend on the order of work.

1. Lines become 128-bit keys; equal ones are aggregated to the earliest, map side first.
2. The deletion neighbourhood of a line has as many variants as the line has characters, so it is emitted only where it
   can meet another: one edit leaves one half of the shorter line as it is, hence lines without a partner on a half key
   have no near line at all. (Half keys are made for the lengths n and n - 1, so that insertions align.)
3. Of the others, variants that delete a character of the half that may differ are emitted as 128-bit keys, each from
   prefix sums of a polynomial hash, so a line of any length takes time in proportion. Equal variants of one position are
   one substitution apart, and all of a group are within one edit of its earliest line, so each member meets that one
   only: never all pairs. A group has as many rows as the script has characters, times the length of the line at most.
4. The edit distance of the line and the earliest one is verified on their characters.

Texts are cut to lines and put together again by DataFrame functions; only variants are made in Python, from batches of
bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize, release
from .common import has_columns, in_arrow

NEAR_CHARS = 5
_ROW = ("d1", "d2")
_SHORT, _LONG, _SAME = 0, 1, 2
#: Variants to a batch.
_BATCH = 1 << 16
_BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


def _row_keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits that name a row by id and text; rows that repeat both share them, and so share all decisions."""
    return [F.xxhash64(F.lit(k), F.col(id_col), F.col(text_col)).alias(d) for k, d in enumerate(_ROW)]


def _halves(line: Column, n: Column, b: Column) -> list[Column]:
    """Keys of the first and the last half of a line taken as one of base length b (b = n, or n - 1 as the longer of two)."""
    h = F.floor(b / 2).cast("int")
    return [F.xxhash64(F.lit(0), b, F.substring(line, F.lit(1), h)), F.xxhash64(F.lit(1), b, F.substring(line, n - (b - h) + 1, b - h))]


def _distinct_lines(src: DataFrame, near_chars: int) -> DataFrame:
    """(id, d1, d2, no, keys): every distinct line that isn't blank, where it first is, and its half keys if it is long enough."""
    line, n = F.col("line"), F.col("n")
    lines = src.select("id", *_ROW, F.posexplode("lines").alias("no", "line")).filter(F.trim("line") != "").withColumn("n", F.length("line"))
    as_longer = [F.when(n > near_chars, k) for k in _halves(line, n, n - 1)]  # its partner has near_chars at least
    keys = F.when(n >= near_chars, F.array(*_halves(line, n, n), *as_longer))
    hashes = [F.xxhash64(F.lit(x), "line").alias(h) for x, h in (("a", "h1"), ("b", "h2"))]
    keyed = lines.select(*hashes, F.struct("id", *_ROW, "no").alias("pos"), keys.alias("keys"))
    return keyed.groupBy("h1", "h2").agg(F.min("pos").alias("pos"), F.first("keys").alias("keys")).select("pos.*", "keys")


def _candidates(src: DataFrame, distinct: DataFrame) -> DataFrame:
    """(id, d1, d2, no, tags, line): distinct lines that share a half key with another; tags are the half keys' places in keys."""
    keyed = distinct.select(*_ROW, "no", F.posexplode("keys").alias("tag", "key")).filter("key is not null")
    shared = keyed.groupBy("key").count().filter("count > 1").select("key")
    tags = keyed.join(shared, "key", "left_semi").groupBy(*_ROW, "no").agg(F.collect_set("tag").alias("tags"))  # 4 at most
    wanted = tags.groupBy(*_ROW).agg(F.collect_list(F.struct("no", "tags")).alias("wanted"))
    held = src.join(wanted, [*_ROW])
    line = F.transform("wanted", lambda w: F.struct(w["no"].alias("no"), w["tags"].alias("tags"), F.get("lines", w["no"]).alias("line")))
    return held.select("id", *_ROW, F.explode(line).alias("at")).select("id", *_ROW, "at.*").dropDuplicates([*_ROW, "no"])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def variants(line: str, tags: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    """(roles, 128-bit keys as two columns) of the variants of a line whose half keys of those places are shared.

    A place is 2 * (the line is the longer of the two) + (its last half is the shared one). Of base length b, a line as
    the shorter one is itself a variant; as the longer one, or as one of equals, it loses a character of the other half.
    """
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n, tags = len(points), set(tags)
    seen, at = [], {}
    for longer in (0, 1):
        half = (n - longer) // 2
        places = np.zeros(n, bool)
        if 2 * longer in tags:  # the first half is shared: the edit is in the last
            places[half:] = True
        if 2 * longer + 1 in tags:
            places[: half + longer] = True
        at[longer] = np.flatnonzero(places)
        if not longer and len(at[0]):
            seen.append(np.array([_SHORT]))
        seen.append(np.full(len(at[longer]), _LONG if longer else _SAME))
    roles = np.concatenate(seen)
    keys = np.empty((2, len(roles)), np.uint64)
    with np.errstate(over="ignore"):
        for k, base in enumerate(_BASES):
            power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base)]))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(points + base) * power[:n])])
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            rest = {x: sums[p] + (sums[-1] - sums[p + 1]) * inverse for x, p in at.items()}  # without the character at p
            same = rest[0] ^ _mix(at[0].astype(np.uint64) * np.uint64(2) + np.uint64(1))  # so that places are told apart
            whole = sums[-1:] if len(at[0]) else sums[:0]
            lengths = np.where(roles == _LONG, n - 1, n).astype(np.uint64)
            keys[k] = _mix(np.concatenate([whole, same, rest[1]]) ^ _mix(lengths * np.uint64(4) + (roles == _SAME)))
    return roles, keys


def _variant_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, d1, d2, no, tags, line) the variants (id, d1, d2, no, role, k1, k2), in batches of bounded size."""
    for batch in batches:
        held, size = [], 0
        for i in range(batch.num_rows):
            roles, keys = variants(batch.column(5)[i].as_py(), batch.column(4)[i].as_py())
            for j in range(0, len(roles), _BATCH):
                held.append((i, roles[j : j + _BATCH], keys[:, j : j + _BATCH]))
                size += len(held[-1][1])
                if size >= _BATCH:
                    yield _of(batch, held)
                    held, size = [], 0
        if held:
            yield _of(batch, held)


def _of(batch: pa.RecordBatch, held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    at = pa.array(np.repeat(np.array([i for i, *_ in held], np.int32), [len(r) for _, r, _ in held]))
    role = pa.array(np.concatenate([r for _, r, _ in held]).astype(np.int32))
    keys = [pa.array(np.concatenate([k[c] for *_, k in held]).view(np.int64)) for c in (0, 1)]
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(4)), role, *keys], names=["id", *_ROW, "no", "role", "k1", "k2"])


def _near(candidates: DataFrame) -> DataFrame:
    """(d1, d2, no) of the candidates that an earlier line is within one edit of, verified."""
    id_type = candidates.schema["id"].dataType.simpleString()
    emitted = candidates.transform(in_arrow(_variant_rows, f"id {id_type}, d1 long, d2 long, no int, role int, k1 long, k2 long"))
    rows = emitted.select("k1", "k2", "role", F.struct("id", *_ROW, "no").alias("pos"))
    group = Window.partitionBy("k1", "k2")  # bounded, see above; one sorted pass, no table of variants
    least = lambda role: F.min(F.when(F.col("role") == role, F.col("pos"))).over(group)
    partner = F.when(F.col("role") == _SHORT, least(_LONG)).when(F.col("role") == _LONG, least(_SHORT)).otherwise(least(_SAME))
    pairs = rows.select("pos", partner.alias("other")).filter("other < pos")
    pairs = pairs.select("pos.d1", "pos.d2", "pos.no", *(F.col(f"other.{c}").alias(f"o_{c}") for c in (*_ROW, "no"))).distinct()
    lines = candidates.select(*_ROW, "no", "line")
    others = lines.select(*(F.col(c).alias(f"o_{c}") for c in (*_ROW, "no")), F.col("line").alias("o_line"))
    both = pairs.join(lines, [*_ROW, "no"]).join(others, [f"o_{c}" for c in (*_ROW, "no")])
    return both.filter(F.levenshtein("line", "o_line", 1).between(0, 1)).select(*_ROW, "no").distinct()


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_chars: int = NEAR_CHARS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of docs: <id_col>, <text_col> without the lines that go, n_lines, n_dropped, n_near, emptied, and
    carried, a struct of the columns to carry (only if there are any), so that none of theirs clashes with another name.

    Lines are what '\\n' separates, compared as they are. Lines of spaces only always stay and are nobody's partner.
    emptied marks texts that lost lines and have none but such left. Null texts stay null with no lines; an empty text
    has one blank line. Ids are of any type that has an order; null ids come before others. Rows that repeat both id and
    text share their decisions, so the earliest occurrence of a line stays in each of them. Other columns are not read.
    """
    has_columns(docs, (id_col, text_col, *carry))
    if near_chars < 1:
        raise ValueError("near_chars is 1 at least")
    carried = [F.struct(*(docs[c] for c in carry)).alias("carried")] if carry else []
    rows = docs.select(F.col(id_col).alias("id"), *_row_keys(id_col, text_col), F.split(text_col, "\n").alias("lines"), *carried)
    src = rows.select("id", *_ROW, "lines")
    distinct = materialize(_distinct_lines(src, near_chars), "lines")
    candidates = materialize(_candidates(src, distinct), "candidates")
    near = materialize(_near(candidates), "near")
    release(docs.sparkSession, candidates)
    marked = distinct.select(*_ROW, "no").join(near.withColumn("near", F.lit(True)), [*_ROW, "no"], "left")
    first = F.when(F.isnull("near"), F.col("no"))
    decided = marked.groupBy(*_ROW).agg(F.collect_list(first).alias("firsts"), F.count("near").alias("n_near"))
    held = rows.join(decided, [*_ROW], "left")
    blank = F.filter(F.transform("lines", lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
    # no place is in both lists, and lines are then taken by place: no list is searched for each line of another
    placed = held.withColumn("stay", F.sort_array(F.concat(F.coalesce("firsts", F.array().cast("array<int>")), blank)))
    gone = F.when(F.isnull("lines"), 0).otherwise(F.size("lines") - F.size("stay"))
    return placed.select(
        F.col("id").alias(id_col),
        F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n").alias(text_col),
        F.when(F.isnull("lines"), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        gone.cast("long").alias("n_dropped"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        ((gone > 0) & F.forall("stay", lambda i: F.trim(F.get("lines", i)) == "")).alias("emptied"),
        *(["carried"] if carry else []),
    )

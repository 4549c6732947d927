"""Helpers that the training-data operators share: text blocks, folds, tables, names of columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Python-side work runs over blocks of about this many characters, so its temporaries stay small however long a text is.
BLOCK_CHARS = 1 << 18
#: Texts of any length come to Python so many at a time; Spark's own limit is 10,000 rows of whatever size.
BATCH_ROWS = 1024
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

Batches = Iterable[pa.RecordBatch]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of one byte a character take the fast path of lower()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id is in fold 0 of the text ''."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def blocks(texts: list[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges [i, j) over texts, each of at most `limit` characters or of a single text."""
    i = size = 0
    for j, text in enumerate(texts):
        n = len(text) if text else 0
        if j > i and size + n > limit:
            yield i, j
            i, size = j, 0
        size += n
    if i < len(texts):
        yield i, len(texts)


def _give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task would keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_arrow(fn: Callable[[Batches], Iterator[pa.RecordBatch]], schema) -> Callable[[DataFrame], DataFrame]:
    """For DataFrame.transform: mapInArrow in batches of BATCH_ROWS rows at most, freed memory being given back after a task.

    The size of batches is a setting of the session, read when the plan runs; it is lowered there if it is larger.
    """

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            _give_back()

    def apply(df: DataFrame) -> DataFrame:
        conf = df.sparkSession.conf
        if not 0 < int(conf.get(_ROWS_KEY)) <= BATCH_ROWS:
            conf.set(_ROWS_KEY, str(BATCH_ROWS))
        return df.mapInArrow(run, schema)

    return apply


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [x for x in names if x not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it as long as a column of df has it, whatever the case."""
    taken = {c.casefold() for c in df.columns}
    while name.casefold() in taken:
        name = f"_{name}"
    return name

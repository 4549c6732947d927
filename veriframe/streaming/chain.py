"""Streaming chain verification: keyed state holds each ledger's last hash and sequence.

Arrival order within a ledger is by `pos`, which the source must carry: rows of a micro-batch are sorted by it, and a row
that comes after a later one has been taken is reported as late, not as a break.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import GENESIS

OUTPUT = "ledger string, pos long, seq long, finding string"
INPUT = ("ledger", "pos", "seq", "prev", "hash")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Chain(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tip = handle.getValueState("tip", "hash string, seq long, pos long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.tip.get() if self.tip.exists() else None
        last, seq, pos = known if known else (GENESIS, 0, -1)
        out = []
        for r in pd.concat(list(rows)).sort_values("pos", kind="stable").itertuples(index=False):
            if r.pos <= pos:
                out.append((key[0], r.pos, r.seq, "LATE"))
                continue
            if r.prev != last:
                out.append((key[0], r.pos, r.seq, "CHAIN-BREAK"))
            if r.seq <= seq:
                out.append((key[0], r.pos, r.seq, "SEQ-BREAK"))
            last, seq, pos = r.hash, int(r.seq), int(r.pos)
        self.tip.update((last, seq, pos))
        yield pd.DataFrame(out, columns=["ledger", "pos", "seq", "finding"])

    def close(self) -> None:
        pass


def verify_stream(receipts: DataFrame) -> DataFrame:
    """Findings (ledger, pos, seq, finding) of a stream of receipts (ledger, pos, seq, prev, hash). The session's state store
    must be RocksDB (see configure)."""
    src = receipts.select("ledger", F.col("pos").cast("long").alias("pos"), F.col("seq").cast("long").alias("seq"), "prev", "hash")
    return src.groupBy("ledger").transformWithStateInPandas(_Chain(), OUTPUT, "Append", "None")


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def append_once(batch: DataFrame, batch_id: int, path: str) -> None:
    """foreachBatch sink that may be repeated: a batch is one folder, written whole or replaced."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

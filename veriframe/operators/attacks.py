"""Attack simulation, each choice fixed by a hash of the row's id; and detection quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json


def chosen(id_col: str, rate: float, salt: str) -> Column:
    """Whether a row is among about `rate` of all."""
    return F.pmod(F.xxhash64(id_col, F.lit(salt)), F.lit(1_000_000)) < int(rate * 1_000_000)


def flip_labels(rows: DataFrame, id_col: str, label_col: str, classes: int, rate: float) -> DataFrame:
    """Rows with `attacked`; chosen ones get another of the classes 0 .. classes - 1."""
    hit = chosen(id_col, rate, "label")
    other = F.pmod(F.col(label_col) + 1 + F.pmod(F.xxhash64(id_col), F.lit(classes - 1)), F.lit(classes)).cast("int")
    return rows.withColumns({"attacked": hit, label_col: F.when(hit, other).otherwise(F.col(label_col))})


def near_copies(rows: DataFrame, id_col: str, vector_col: str, rate: float, noise: float = 0.01) -> DataFrame:
    """Rows and slightly moved copies of the chosen ones, with negative ids."""
    jitter = F.transform(vector_col, lambda x, i: (x + noise * (F.pmod(F.xxhash64(F.col(id_col), i), F.lit(1000)) / 500.0 - 1)).cast("float"))
    copies = rows.filter(chosen(id_col, rate, "copy")).withColumns({vector_col: jitter, id_col: -F.col(id_col) - 1})
    return rows.withColumn("attacked", F.lit(False)).unionByName(copies.withColumn("attacked", F.lit(True)))


def out_of_distribution(rows: DataFrame, id_col: str, vector_col: str, rate: float, scale: float = 8.0) -> DataFrame:
    hit = chosen(id_col, rate, "ood")
    far = F.transform(vector_col, lambda x: (x * scale).cast("float"))
    return rows.withColumns({"attacked": hit, vector_col: F.when(hit, far).otherwise(F.col(vector_col))})


def backdoor(rows: DataFrame, id_col: str, vector_col: str, label_col: str, target: int, rate: float, trigger: float = 4.0, places: int = 4) -> DataFrame:
    """Chosen rows get a fixed trigger in their first components and the target label."""
    hit = chosen(id_col, rate, "backdoor")
    marked = F.transform(vector_col, lambda x, i: F.when(i < places, F.lit(trigger).cast("float")).otherwise(x))
    return rows.withColumns({
        "attacked": hit, vector_col: F.when(hit, marked).otherwise(F.col(vector_col)),
        label_col: F.when(hit, F.lit(target)).otherwise(F.col(label_col))
    })


def substitute_model(receipts: DataFrame, seqs: list[int], digest: str) -> DataFrame:
    """Receipts in which some name another model, their recorded hashes left as they were."""
    swapped = F.regexp_replace("payload_json", '"model_weight_digest":"[^"]*"', f'"model_weight_digest":"{digest}"')
    hit = F.col("seq").isin(seqs)
    return receipts.withColumns({
        "payload_json": F.when(hit, swapped).otherwise(F.col("payload_json")), "model": F.when(hit, F.lit(digest)).otherwise(F.col("model"))
    })


def reuse_nonce(receipts: DataFrame, seq: int, nonce: str) -> DataFrame:
    hit = F.col("seq") == seq
    swapped = F.regexp_replace("payload_json", '"nonce":"[^"]*"', '"nonce":' + canonical_json(nonce))
    return receipts.withColumns({
        "payload_json": F.when(hit, swapped).otherwise(F.col("payload_json")), "nonce": F.when(hit, F.lit(nonce)).otherwise(F.col("nonce"))
    })


def reposition(receipts: DataFrame, order: list[int]) -> DataFrame:
    """Receipts at the old positions of `order`, in that order: deletes, swaps and repeats."""
    spark = receipts.sparkSession
    moved = spark.createDataFrame([(p, k) for k, p in enumerate(order)], "pos long, new long")
    return receipts.join(F.broadcast(moved), "pos").withColumn("pos", F.col("new")).drop("new")


def detection_quality(scored: DataFrame, attack: str = "attack", score: str = "score", truth: str = "truth", threshold: float = 0.5) -> DataFrame:
    """(attack, n, positives, tpr, fpr, auroc): rates at the threshold, and the area by rank sums with ties at half.

    Equal scores are one row with counts before they are ordered.
    """
    s, t = F.col(score), F.col(truth)
    levels = scored.filter(s.isNotNull() & t.isNotNull()).groupBy(attack, s.alias("s")).agg(F.count_if(t).alias("p"), F.count_if(~t).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(attack).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = levels.withColumn("won", F.col("p") * (below + F.col("n") / 2.0)).withColumn("hit", F.col("s") >= threshold)
    agg = wins.groupBy(attack).agg(
        F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum("won").alias("won"), F.sum(F.when(F.col("hit"), F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("fp")
    )
    p, n = F.nullif(F.col("positives"), F.lit(0)), F.nullif(F.col("negatives"), F.lit(0))
    return agg.select(
        attack, (F.col("positives") + F.col("negatives")).alias("n"), "positives", (F.col("tp") / p).alias("tpr"),
        (F.col("fp") / n).alias("fpr"), (F.col("won") / (p * n)).alias("auroc")
    )


def all_attacks(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", classes: int = 10, rate: float = 0.05
) -> DataFrame:
    """Every data attack over one table, with `attack`, its name."""
    parts = {
        "label_flip": flip_labels(rows, id_col, label_col, classes, rate),
        "near_duplicate": near_copies(rows, id_col, vector_col, rate),
        "ood": out_of_distribution(rows, id_col, vector_col, rate),
        "backdoor": backdoor(rows, id_col, vector_col, label_col, 0, rate),
    }
    return reduce(DataFrame.unionByName, (d.withColumn("attack", F.lit(n)) for n, d in parts.items()))

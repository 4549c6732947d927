"""Spot re-execution: a seeded sample of receipts is run again and the digests of the outputs are compared."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterable, Iterator
from inspect import Parameter, signature

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import finding, row_checks

RATE, LEAST, SEED = 0.05, 1, 42
#: Takes the path of an image, or the path, the model and its configuration.
Evaluator = Callable[..., bytes]


def sample_size(n: int, rate: float = RATE, least: int = LEAST) -> int:
    return min(n, max(least, int(n * max(0.0, min(1.0, rate)))))


def sample_positions(n: int, rate: float = RATE, least: int = LEAST, seed: int = SEED) -> list[int]:
    """Positions of a sample without replacement, in drawing order, as Python's generator gives them for the seed."""
    return random.Random(seed).sample(range(n), sample_size(n, rate, least)) if n else []


def sample_receipts(receipts: DataFrame, rate: float = RATE, least: int = LEAST, seed: int = SEED, exact: bool = True) -> DataFrame:
    """A sample of one ledger's receipts with `draw`, its place in it. exact repeats the seeded positions of the driver's
    generator; otherwise the receipts of the smallest seeded hashes are taken, which needs no list on the driver: by counts
    of the hashes' first 16 bits, so that only those of one such value are ordered."""
    n = receipts.count()
    if exact:
        drawn = list(enumerate(sample_positions(n, rate, least, seed)))
        chosen = receipts.sparkSession.createDataFrame(drawn, "draw int, pos long") if drawn else receipts.sparkSession.createDataFrame([], "draw int, pos long")
        return receipts.join(chosen, "pos")
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "ledger", F.col("pos").cast("string")))
    keyed = receipts.withColumns({"draw": order, "_part": F.conv(F.substring(order, 1, 4), 16, 10).cast("int")})
    counts = {r["_part"]: r["count"] for r in keyed.groupBy("_part").count().collect()}  # 65,536 at most
    left, last = sample_size(n, rate, least), -1
    for last in sorted(counts):
        if counts[last] >= left:
            break
        left -= counts[last]
    edge = keyed.filter(F.col("_part") == last).orderBy("draw").limit(left)
    return keyed.filter(F.col("_part") < last).unionByName(edge).drop("_part")


def reexecute(sample: DataFrame, evaluate: Evaluator | None, model: object = None, config: dict | None = None) -> DataFrame:
    """The sample with `actual` (SHA-256 of the evaluator's bytes), `error`, and `ran`."""
    if evaluate is None:
        return sample.withColumns({"actual": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "ran": F.lit(False)})

    kinds = (Parameter.POSITIONAL_ONLY, Parameter.POSITIONAL_OR_KEYWORD)
    all_three = sum(p.kind in kinds for p in signature(evaluate).parameters.values()) >= 3
    more = (model, config) if all_three else ()

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            actual, error = [], []
            for path in f["image_path"]:
                try:
                    actual.append(hashlib.sha256(evaluate(path or "", *more)).hexdigest())
                    error.append(None)
                except Exception as e:  # any failure of the caller's function is a finding
                    actual.append(None)
                    error.append(str(e))
            yield f.assign(actual=actual, error=error, ran=True)

    return sample.mapInPandas(run, sample.schema.simpleString()[7:-1] + ",actual:string,error:string,ran:boolean")


def spot_findings(executed: DataFrame, runner: bool = False) -> DataFrame:
    """Findings of re-executed receipts; runner: the evaluator is the real inference, whose failures have another id."""
    seq = F.coalesce("seq", F.lit(0)).cast("string")
    asset = F.coalesce("asset", F.concat(F.lit("seq_"), seq))
    id = lambda kind: F.concat(F.lit(f"FINDING-M3-SPOT-{kind}-SEQ-"), seq)
    common = {"check_no": 7, "asset": asset, "pos": F.col("draw")}
    cut = lambda c: F.concat(F.lit("'"), F.substring(c, 1, 12), F.lit("...'"))
    say: Callable[[str], Column] = lambda text: F.concat(F.lit(text), seq)
    failed = F.expr("ran and error is not null"), finding(
        id("EXEC-FAILED" if runner else "EXEC-ERROR"), "spot_re_executor", 0.5, "warning", "review",
        F.concat(say("Re-execution failed at sequence "), F.lit(": "), F.col("error")), confidence="medium", **common
    )
    absent = F.expr("not ran"), finding(
        id("UNAVAILABLE"), "spot_re_executor", 0.0, "info", "unavailable",
        F.concat(say("No re-execution of sequence "), F.lit(": model or image is not at hand.")), confidence="medium", **common
    )
    log = F.concat(F.lit("spot_reexec_seq_"), seq, F.lit(".log"))
    reason = F.concat(
        say("Fabricated output at sequence "), F.lit(": re-execution gives "), cut(F.col("actual")), F.lit(", the receipt says "),
        cut(F.col("output")), F.lit(".")
    )
    differs = F.expr("ran and error is null and lower(actual) <> lower(output)"), finding(
        id("FABRICATION"), "spot_re_executor", 1.0, "critical", "quarantine", reason, evidence=(log,), **common
    )
    return row_checks(executed, [failed, absent, differs])  # in one pass: what was run isn't run again


def spot_check(receipts: DataFrame, evaluate: Evaluator | None = None, rate: float = RATE, least: int = LEAST, seed: int = SEED) -> DataFrame:
    return spot_findings(reexecute(sample_receipts(receipts, rate, least, seed), evaluate))


def spot_check_images(receipts: DataFrame, outputs: DataFrame, rate: float = RATE, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """The same against real inference: outputs(path, output_bytes, error) of the images at hand, as encoder.infer gives
    them. A receipt whose image has no row there is `unavailable`, one whose inference failed is EXEC-FAILED."""
    error = F.col("error") if "error" in outputs.columns else F.lit(None).cast("string")
    actual = outputs.select(F.col("path").alias("image_path"), F.sha2("output_bytes", 256).alias("actual"), error.alias("error"))
    joined = sample_receipts(receipts, rate, least, seed).join(actual, "image_path", "left")
    return spot_findings(joined.withColumn("ran", F.col("actual").isNotNull() | F.col("error").isNotNull()), runner=True)

"""Capability gates: whether a detector may run at an access tier, for a task, with or without a reference.

The gate is decided when the plan is built: a detector that may not run adds one UNAVAILABLE row and none of its own plan.
"""

from __future__ import annotations

import functools
import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DETECTOR_RESULT, MATRIX, TASKS, TIERS, satisfies

RANK = {t: i for i, t in enumerate(TIERS)}
NO_ID = "INVALID_DETECTOR_ID: detector_id must be non-empty"


def _verdict(detector_id: str, problems: dict[str, bool]) -> tuple[bool, str]:
    """The first problem that holds, or that there is none."""
    reason = next((text for text, holds in problems.items() if holds), None)
    return reason is None, reason or f"SUPPORTED: detector={detector_id}"


@dataclass
class Matrix:
    """What a probe found out."""

    access_tier: str = "T0"
    task_type: str = "DETECTION"
    reference_mode: str = "BOOTSTRAPPED"
    model_digest: str | None = None
    reference_profile_digest: str | None = None
    probe_timestamp: str | None = None
    source: str | None = None
    metadata: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.access_tier not in TIERS or self.task_type not in TASKS:
            raise ValueError(f"no such tier or task: {self.access_tier}, {self.task_type}")

    def satisfies(self, tier: str) -> bool:
        return RANK[self.access_tier] >= RANK[tier]

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> Matrix:
        return cls(**json.loads(text))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(json.dumps(v) if isinstance(v, dict) else v for v in self.__dict__.values())], MATRIX)

    def supports(self, detector_id: str, tier: str, tasks: Sequence[str]) -> tuple[bool, str]:
        """(allowed, reason), the task before the tier; reasons speak of tiers by their short values."""
        problems = {
            NO_ID: not detector_id,
            f"TASK_UNSUPPORTED: requires one of [{', '.join(tasks) or '<none>'}], found {self.task_type}": self.task_type not in tasks,
            f"UNAVAILABLE_AT_TIER: requires {tier}, found {self.access_tier}": not self.satisfies(tier),
        }
        return _verdict(detector_id, problems)


def supports_column(detector_id: Column, tier: Column, tasks: Column, found_tier: Column, found_task: Column) -> Column:
    """The same over columns, tasks being an array: struct(allowed, reason)."""
    listed = F.when(F.size(tasks) > 0, F.array_join(tasks, ", ")).otherwise("<none>")
    reason = (
        F.when(F.coalesce(F.length(detector_id), F.lit(0)) == 0, F.lit(NO_ID))
        .when(~F.array_contains(tasks, found_task), F.concat(F.lit("TASK_UNSUPPORTED: requires one of ["), listed, F.lit("], found "), found_task))
        .when(~satisfies(found_tier, tier), F.concat(F.lit("UNAVAILABLE_AT_TIER: requires "), tier, F.lit(", found "), found_tier))
        .otherwise(F.concat(F.lit("SUPPORTED: detector="), detector_id))
    )
    return F.struct(reason.startswith("SUPPORTED: ").alias("allowed"), reason.alias("reason"))


def availability_column(
    detector_id: Column, tier: Column, tasks: Column, needs_reference: Column, found_tier: Column, found_task: Column, found_mode: Column
) -> Column:
    """A detector's own gate over columns: task, tier, reference; reasons speak of tiers by their long names."""
    name = F.upper(F.regexp_replace(detector_id, "[- ]", "_"))
    long = lambda t: F.when(t == "T0", TIERS["T0"]).when(t == "T1", TIERS["T1"]).when(t == "T2", TIERS["T2"])
    reason = (
        F.when(~F.array_contains(tasks, found_task), F.concat(name, F.lit("_UNAVAILABLE_FOR_TASK_TYPE")))
        .when(~satisfies(found_tier, tier), F.concat(F.lit("UNAVAILABLE_AT_TIER: requires "), long(tier), F.lit(", found "), long(found_tier)))
        .when(needs_reference & (found_mode == "UNREFERENCED"), F.concat(name, F.lit("_UNAVAILABLE_WITHOUT_REFERENCE")))
        .otherwise(F.concat(F.lit("SUPPORTED: detector="), detector_id))
    )
    return F.struct(reason.startswith("SUPPORTED: ").alias("allowed"), reason.alias("reason"))


def result(spark: SparkSession, detector_id: str, status: str, reason: str | None = None, score: float | None = None, details: dict | None = None) -> DataFrame:
    return spark.createDataFrame([(detector_id, status, reason, score, json.dumps(details or {}))], DETECTOR_RESULT)


def unavailable(spark: SparkSession, detector_id: str, reason: str) -> DataFrame:
    return result(spark, detector_id, "UNAVAILABLE", reason)


def gated(method: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For methods (self, assets, matrix, ...): an UNAVAILABLE row instead of the call where the matrix doesn't suffice."""

    def run(self: Detector, assets: DataFrame, matrix: Matrix, **kwargs) -> DataFrame:
        allowed, reason = self.available(matrix)
        return method(self, assets, matrix, **kwargs) if allowed else unavailable(assets.sparkSession, self.detector_id, reason)

    return functools.update_wrapper(run, method)


class Detector(ABC):
    """Base of detectors: subclasses give _run(assets, matrix, ...) -> DataFrame of DETECTOR_RESULT, callers use run()."""

    def __init__(self, detector_id: str, required_tier: str, supported_tasks: Sequence[str], requires_reference: bool = False):
        if not detector_id:
            raise ValueError("a detector needs an id")
        self.detector_id, self.required_tier = detector_id, required_tier
        self.supported_tasks, self.requires_reference = tuple(supported_tasks), requires_reference

    def available(self, matrix: Matrix) -> tuple[bool, str]:
        name = self.detector_id.upper().translate(str.maketrans("- ", "__"))
        problems = {
            name + "_UNAVAILABLE_FOR_TASK_TYPE": matrix.task_type not in self.supported_tasks,
            f"UNAVAILABLE_AT_TIER: requires {TIERS[self.required_tier]}, found {TIERS[matrix.access_tier]}": not matrix.satisfies(self.required_tier),
            name + "_UNAVAILABLE_WITHOUT_REFERENCE": self.requires_reference and matrix.reference_mode == "UNREFERENCED",
        }
        return _verdict(self.detector_id, problems)

    @gated
    def run(self, assets: DataFrame, matrix: Matrix, **kwargs) -> DataFrame:
        return self._run(assets, matrix, **kwargs)

    @abstractmethod
    def _run(self, assets: DataFrame, matrix: Matrix, **kwargs) -> DataFrame: ...


class Constant(Detector):
    """Placeholder detector of a constant result."""

    def __init__(self, detector_id: str, tier: str, score: float, **details):
        super().__init__(detector_id, tier, TASKS)
        self.score, self.details = score, details

    def _run(self, assets: DataFrame, matrix: Matrix, **kwargs) -> DataFrame:
        return result(assets.sparkSession, self.detector_id, "SUCCESS", None, self.score, self.details)


def output_signature_verifier() -> Detector:
    """Runs with labels alone."""
    return Constant("output_signature_verifier", "T0", 0.99, verified=True)


def fragile_watermark_detector() -> Detector:
    """Needs the weights."""
    return Constant("fragile_watermark_detector", "T2", 0.95, tamper_detected=False)

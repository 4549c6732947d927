"""Declared schemas, enumerations and validity predicates of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIERS = {"T0": "T0_LABELS", "T1": "T1_LOGITS", "T2": "T2_WEIGHTS"}
TASKS = ("CLASSIFICATION", "DETECTION", "SEGMENTATION")
REFERENCE_MODES = ("ATTESTED", "BOOTSTRAPPED", "UNREFERENCED")
SOURCES = ("local_file", "remote_api", "unknown")
GENESIS = "0" * 64

IMAGE_METADATA = T.StructType([T.StructField(n, T.IntegerType()) for n in ("width", "height", "channels")])
ANNOTATION = T.StructType(
    [
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField("category_id", T.IntegerType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("segmentation", T.ArrayType(T.ArrayType(T.DoubleType()))),
    ]
)
ASSET = T.StructType(
    [
        T.StructField("asset_id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("image_metadata", IMAGE_METADATA),
        T.StructField("annotations", T.ArrayType(ANNOTATION)),
        T.StructField("contributor_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)
MATRIX = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in (
            "access_tier", "task_type", "reference_mode", "model_digest", "reference_profile_digest", "probe_timestamp", "source"
        )),
        T.StructField("metadata", T.StringType()),  # JSON
    ]
)
DETECTOR_RESULT = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("detector_id", "status", "reason")),
        T.StructField("score", T.DoubleType()),
        T.StructField("details", T.StringType()),  # JSON
    ]
)
FINDING = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("finding_id", "detector", "detector_version", "asset_ref", "contributor_ref")),
        T.StructField("score", T.DoubleType()),
        *(T.StructField(n, T.StringType()) for n in ("confidence", "access_tier", "severity", "reason_human_readable")),
        T.StructField("evidence_artifacts", T.ArrayType(T.StringType())),
        T.StructField("recommended_disposition", T.StringType()),
    ]
)


def tier_rank(tier: Column) -> Column:
    """0, 1, 2 for T0, T1, T2; null for anything else."""
    return F.when(tier == "T0", 0).when(tier == "T1", 1).when(tier == "T2", 2)


def satisfies(tier: Column, required: Column) -> Column:
    return tier_rank(tier) >= tier_rank(required)


def clean_digest(digest: Column) -> Column:
    """A SHA-256 as lower-case hex without blanks around it, or null where it is none."""
    low = F.lower(F.trim(digest))
    return F.when(low.rlike("^[0-9a-f]{64}$"), low)


def asset_violations() -> Column:
    """Names of the rules that an asset row breaks."""
    meta = F.col("image_metadata")
    box_bad = lambda a: (F.size(a["bbox"]) != 4) | F.exists(a["bbox"], lambda x: x < 0)
    rules = {
        "asset_id": F.coalesce(F.length("asset_id"), F.lit(0)) < 1,
        "sha256": clean_digest(F.col("sha256")).isNull(),
        "format": ~F.coalesce(F.col("format").isin("COCO", "YOLO"), F.lit(False)),
        "image_metadata": F.least(meta["width"], meta["height"], meta["channels"]) < 1,
        "bbox": F.exists("annotations", box_bad),
        "class_name": F.exists("annotations", lambda a: F.coalesce(F.length(a["class_name"]), F.lit(0)) < 1),
        "contributor_id": F.coalesce(F.length("contributor_id"), F.lit(0)) < 1,
    }
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())


def receipt_violations(payload: str = "payload") -> Column:
    """Names of the rules that a receipt's payload struct breaks: three digests of 64 characters, a sequence from 1, a nonce."""
    p = F.col(payload)
    rules = {n: F.coalesce(F.length(p[n]), F.lit(0)) != 64 for n in ("input_image_sha256", "model_weight_digest", "output_payload_sha256")}
    rules |= {"sequence_number": F.coalesce(p["sequence_number"], F.lit(0)) < 1, "nonce": F.coalesce(F.length(p["nonce"]), F.lit(0)) == 0}
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())

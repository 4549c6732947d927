"""One entry point for each planned module: data integrity, model integrity, distribution shift, fusion, attacks, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attacks, audit, fusion, integrity, model_integrity, report, shift


def run_data_integrity(assets: DataFrame, features: DataFrame, neighbours: int = 10) -> dict[str, DataFrame]:
    """Results by detector for assets and for features (vec_id, embedding, label); neighbours are sought for every hundredth row."""
    moments = integrity.class_moments(features)
    near = integrity.nearest(features.filter("vec_id % 100 = 0"), features, neighbours)
    hashed = features.select("vec_id", integrity.sign_hash(F.col("embedding")).alias("hash"))
    return {
        "exact_duplicates": integrity.exact_duplicates(assets, "asset_id", F.col("sha256")),
        "near_duplicates": integrity.near_duplicates(hashed, "vec_id"),
        "label_flips": integrity.label_agreement(near),
        "confusion": integrity.confusion(near),
        "ood": integrity.mahalanobis(features, moments),
        "spectral": integrity.spectral_signatures(features, moments),
        "clusters": integrity.activation_clusters(features, moments),
        "annotations": integrity.annotation_anomalies(assets),
        "sybils": integrity.sybil_pairs(assets, "contributor_id", F.col("sha256")),
    }


def run_model_integrity(models: DataFrame, attested: DataFrame, weights: DataFrame, reference: DataFrame) -> dict[str, DataFrame]:
    now = model_integrity.weight_statistics(weights)
    return {"digests": model_integrity.digest_check(models, attested), "statistics": now, "drift": model_integrity.statistics_drift(now, reference)}


def run_shift(samples: DataFrame, features: list[str], side: str) -> DataFrame:
    """(feature, family, n_a, n_b, ks, mmd2) of every feature; side is a boolean column, true for the reference."""
    family = {c: f for f, own in shift.families(features).items() for c in own}
    out = None
    for c in features:
        ks = shift.ks_statistic(samples, c, F.col(side))
        one = ks.crossJoin(shift.mmd_quadratic(samples, c, F.col(side)).select("mmd2")).select(
            F.lit(c).alias("feature"), F.lit(family[c]).alias("family"), "n_a", "n_b", "ks", "mmd2"
        )
        out = one if out is None else out.unionByName(one)
    return out


def run_fusion(scores: DataFrame, id_col: str, detectors: list[str], policy: dict[str, float] = fusion.POLICY) -> DataFrame:
    """Risk and decision of each row, detectors weighted against their correlation."""
    weights = {r["detector"]: r["weight"] for r in fusion.correlation_weights(scores, detectors).collect()}  # a row a detector
    return fusion.fuse(scores, id_col, weights, policy)


def generate_all_attacks(features: DataFrame, rate: float = 0.05) -> DataFrame:
    return attacks.all_attacks(features, rate=rate)


def generate_report(receipts: DataFrame, checkpoints: DataFrame | None = None, **options) -> dict:
    """Audit a ledger and report it."""
    found = audit.audit(receipts, checkpoints, **options)
    return report.json_report(found, receipts.count(), checkpoints.count() if checkpoints is not None else 0)

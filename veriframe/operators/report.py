"""Reports: severity counts, disposition, JSON, HTML, content-credentials manifest and coverage statement."""

from __future__ import annotations

import html
import json
from collections.abc import Mapping
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .audit import ORDER

MODULE, CLAUSE = "M3_INFERENCE_PROVENANCE", "2.2.3 / 2.2.5"
SEVERITIES = ("critical", "high", "warning", "info")
SUPPORTED = tuple(
    """receipt_payload_tampering record_replay_attack record_deletion_or_reordering hash_chain_discontinuity
    model_substitution merkle_checkpoint_inconsistency invalid_ed25519_signature""".split()
)
PARTIAL, UNSUPPORTED = ("host_fabricated_results",), ("dishonest_signer_at_generation_time",)
ASSUMPTIONS = ("reference_profile_is_clean", "signing_keys_uncompromised", "verifier_key_held_in_dual_custody")
CAVEAT = "A manifest is a form of serialisation, not a security guarantee: without trusted hardware or proofs of computation it can't show that the execution was honest."


def severity_counts(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of the four severities; others are in none of them."""
    s = F.lower(F.coalesce("severity", F.lit("info")))
    return findings.groupBy(*by).agg(*(F.count_if(s == x).alias(x) for x in SEVERITIES))


def disposition(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """QUARANTINE over REVIEW over ACCEPT; `unavailable` raises nothing, and no findings accept."""
    d, s = F.lower(F.coalesce("recommended_disposition", F.lit("accept"))), F.lower(F.coalesce("severity", F.lit("info")))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    worst, middle = any_of((d == "quarantine") | s.isin("critical", "high")), any_of((d == "review") | (s == "warning"))
    return findings.groupBy(*by).agg(F.when(worst, "QUARANTINE").when(middle, "REVIEW").otherwise("ACCEPT").alias("overall_disposition"))


def summary(findings: DataFrame, receipts: int, checkpoints: int) -> dict:
    counts = severity_counts(findings).first().asDict()
    return {
        "total_receipts_audited": receipts,
        "total_checkpoints_audited": checkpoints,
        "total_findings": findings.count(),
        "overall_disposition": disposition(findings).first()[0],
        "severity_counts": counts,
    }


def critical_count(findings: DataFrame) -> int:
    return findings.filter(F.col("severity").isin("critical", "high")).count()


def json_report(findings: DataFrame, receipts: int, checkpoints: int, limit: int | None = None) -> dict:
    """The report of one ledger; limit cuts the listed findings, never the counts."""
    listed = findings.orderBy(*ORDER).drop(*ORDER) if set(ORDER) <= set(findings.columns) else findings
    rows = listed.limit(limit).collect() if limit is not None else listed.collect()
    return {
        "module": MODULE, "clause": CLAUSE, "timestamp_utc": datetime.now(UTC).isoformat(),
        "audit_summary": summary(findings, receipts, checkpoints), "findings": [r.asDict(recursive=True) for r in rows]
    }


def write_json_report(findings: DataFrame, receipts: int, checkpoints: int, path: str) -> Path:
    """The same report, written finding by finding, so the driver holds one partition of them at a time; a line for each, so
    that the file can be read in splits."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    listed = findings.orderBy(*ORDER).drop(*ORDER) if set(ORDER) <= set(findings.columns) else findings
    head = {"module": MODULE, "clause": CLAUSE, "timestamp_utc": datetime.now(UTC).isoformat(), "audit_summary": summary(findings, receipts, checkpoints)}
    with open(p, "w", encoding="utf-8") as out:
        out.write(json.dumps(head)[:-1] + ', "findings": [\n')
        for k, r in enumerate(listed.toLocalIterator()):
            out.write(",\n" * (k > 0) + json.dumps(r.asDict(recursive=True)))
        out.write("\n]}\n")
    return p


def save_json(value: dict, path: str) -> Path:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(value, indent=2), encoding="utf-8")
    return p


def _html_row(f: Mapping | Row) -> str:
    esc = lambda v: html.escape(str(v))
    keys = ("finding_id", "detector", "severity", "recommended_disposition", "reason_human_readable")
    return "<tr>" + "".join(f"<td>{esc(f[k])}</td>" for k in keys) + f"<td>{esc(', '.join(f['evidence_artifacts'] or ()))}</td></tr>"


def html_report(report: dict) -> str:
    """A page with the summary and a table row for each finding."""
    s = report["audit_summary"]
    esc = lambda v: html.escape(str(v))
    cards = {
        "Receipts audited": s["total_receipts_audited"], "Checkpoints": s["total_checkpoints_audited"], "Findings": s["total_findings"],
        "Critical and high": s["severity_counts"]["critical"] + s["severity_counts"]["high"]
    }
    rows = "".join(map(_html_row, report["findings"]))
    head = "".join(f"<th>{h}</th>" for h in ("Finding", "Detector", "Severity", "Disposition", "Reason", "Evidence"))
    return (
        f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{esc(report['module'])}</title><style>body{{font-family:sans-serif;background:#111;color:#eee}}"
        "td,th{border:1px solid #444;padding:4px}dl{display:flex;gap:2em}</style></head><body>"
        f"<h1>{esc(s['overall_disposition'])}</h1><dl>{''.join(f'<div><dt>{k}</dt><dd>{esc(v)}</dd></div>' for k, v in cards.items())}</dl>"
        f"<table><thead><tr>{head}</tr></thead><tbody>{rows}</tbody></table></body></html>"
    )


def save_html(report: dict, path: str) -> Path:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(html_report(report), encoding="utf-8")
    return p


def write_html_report(findings: DataFrame, receipts: int, checkpoints: int, path: str) -> Path:
    """The same page with a line for each finding, written finding by finding."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    made = {"module": MODULE, "audit_summary": summary(findings, receipts, checkpoints)}
    listed = findings.orderBy(*ORDER).drop(*ORDER) if set(ORDER) <= set(findings.columns) else findings
    head, _, tail = html_report(made | {"findings": []}).partition("</tbody>")
    with open(p, "w", encoding="utf-8") as out:
        out.write(head + "\n")
        for r in listed.toLocalIterator():
            out.write(_html_row(r).replace("\n", "&#10;") + "\n")
        out.write("</tbody>" + tail)
    return p


def manifests(receipts: DataFrame, generator: str = "veriframe", namespace: str = "veriframe") -> DataFrame:
    """(ledger, seq, manifest): a content-credentials manifest, as JSON, for each receipt."""
    lit = lambda v, n: F.lit(v).alias(n)
    seq = F.coalesce("seq", F.lit(1))
    data = F.to_json(F.struct(lit("input_image_sha256", "name"), F.col("asset").alias("hash"), lit("sha256", "alg")))
    binding = F.to_json(F.struct(F.col("model").alias("model_weight_digest"), seq.alias("sequence_number"), lit("T2", "provenance_tier")))
    when = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxxx")
    action = F.to_json(F.struct(F.array(F.struct(lit("c2pa.inference", "action"), lit(generator, "softwareAgent"), when.alias("when"))).alias("actions")))
    part = lambda label, body: F.concat(F.lit(f'{{"label":"{label}","data":'), body, F.lit("}"))
    assertions = F.concat(
        F.lit("["),
        F.concat_ws(",", part("c2pa.hash.data", data), part(f"{namespace}.model.binding", binding), part("c2pa.actions", action)),
        F.lit("]")
    )
    head = F.to_json(
        F.struct(
            lit("2.1.0", "c2pa_version"), F.concat(F.lit("Receipt "), seq).alias("title"), lit("application/json", "format"),
            F.concat(
                F.lit(f"urn:uuid:{namespace}-"), F.substring("asset", 1, 16)
            ).alias("instance_id"), lit(generator, "claim_generator"), lit(CAVEAT, "security_caveat"),
            F.struct(lit("ed25519", "algorithm"), F.col("signature").alias("sig_bytes_hex")).alias("signature"),
        )
    )
    whole = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"assertions":'), assertions, F.lit("}"))
    return receipts.select("ledger", seq.alias("seq"), whole.alias("manifest"))


def coverage(spark: SparkSession) -> DataFrame:
    """(kind, position, item) of the coverage statement."""
    groups = {"supported": SUPPORTED, "partial": PARTIAL, "unsupported": UNSUPPORTED, "assumptions": ASSUMPTIONS}
    return spark.createDataFrame([(k, i, x) for k, items in groups.items() for i, x in enumerate(items)], "kind string, position int, item string")


def coverage_statement() -> dict:
    return {
        "module": MODULE, "clause": CLAUSE, "supported": list(SUPPORTED), "partial": list(PARTIAL), "unsupported": list(UNSUPPORTED),
        "assumptions": list(ASSUMPTIONS)
    }

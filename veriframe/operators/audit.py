"""Ledger audit: the checks of a receipt chain as DataFrames of findings.

Receipts are rows (ledger, pos, payload_json, seq, prev, hash, signature, nonce, model, asset, output, image_path), as
sources.ledger gives them, of any number of ledgers. A receipt meets its predecessor by an equi-join on the dense position,
which is parallel within one ledger, and moves only what the checks of two rows read; all checks of one row are made in one
pass where the rows are. Replays meet the first use of their nonce by an aggregate; checkpoints meet their receipts on slices
of their range, so they are joined by equality, however wide a range a checkpoint claims.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ed25519
from ..functions.canonical import receipt_hash_column
from ..functions.merkle import merkle_root
from ..schemas import GENESIS
from ..scratch import materialize

VERSION, CONTRIBUTOR = "1.2", "C-07"
#: A checkpoint's range is joined in so many slices at most.
SLICES = 1024
ORDER = ("ledger", "check_no", "pos", "sub_no")


def _cut(digest: Column) -> Column:
    return F.concat(F.lit("'"), F.substring(digest, 1, 12), F.lit("...'"))


def finding(
    id: Column,
    detector: str,
    score: float,
    severity: str,
    disposition: str,
    reason: Column,
    *,
    check_no: int,
    sub_no: int = 1,
    asset: Column | None = None,
    evidence: tuple[Column, ...] = (),
    confidence: str = "high",
    pos: Column | None = None,
    contributor: str = CONTRIBUTOR,
) -> list[Column]:
    """Columns of a finding, with those that order it among others."""
    none = F.array().cast("array<string>")
    return [
        F.col("ledger"),
        F.lit(check_no).alias("check_no"),
        (pos if pos is not None else F.lit(0)).cast("long").alias("pos"),
        F.lit(sub_no).alias("sub_no"),
        id.alias("finding_id"),
        F.lit(detector).alias("detector"),
        F.lit(VERSION).alias("detector_version"),
        (asset if asset is not None else F.lit("unknown")).alias("asset_ref"),
        F.lit(contributor).alias("contributor_ref"),
        F.lit(float(score)).alias("score"),
        F.lit(confidence).alias("confidence"),
        F.lit("T2").alias("access_tier"),
        F.lit(severity).alias("severity"),
        reason.alias("reason_human_readable"),
        (F.array(*evidence) if evidence else none).alias("evidence_artifacts"),
        F.lit(disposition).alias("recommended_disposition"),
    ]


def _id(kind: str, seq: Column) -> Column:
    return F.concat(F.lit(f"FINDING-M3-{kind}-SEQ-"), seq)


def _file(seq: Column) -> Column:
    return F.concat(F.lit("receipt_seq_"), seq, F.lit(".json"))


def _asset(seq: Column) -> Column:
    return F.coalesce("asset", F.concat(F.lit("seq_"), seq))


def with_previous(receipts: DataFrame) -> DataFrame:
    """Receipts with the recorded hash and the sequence of the one before: 64 zeros and 0 for the first of a ledger."""
    before = receipts.select("ledger", (F.col("pos") + 1).alias("pos"), F.col("hash").alias("expected"), F.coalesce("seq", F.lit(0)).alias("last_seq"))
    joined = receipts.join(before, ["ledger", "pos"], "left")
    return joined.withColumns({"expected": F.coalesce("expected", F.lit(GENESIS)), "last_seq": F.coalesce("last_seq", F.lit(0))})


Check = tuple[Column, list[Column]]


def _chain_break() -> Check:
    seq = F.coalesce("seq", F.col("pos") + 1).cast("string")
    reason = F.concat(
        F.lit("Hash chain break at sequence "), seq, F.lit(": expected predecessor "), _cut(F.col("expected")), F.lit(", got "),
        _cut(F.col("prev")), F.lit("; a record was deleted or reordered.")
    )
    return F.col("prev") != F.col("expected"), finding(
        _id("CHAIN-BREAK", seq), "hash_chain_verifier", 1.0, "critical", "quarantine", reason, check_no=1, asset=_asset(seq), evidence=(_file(seq),), pos=F.col("pos")
    )


def _tampered() -> Check:
    seq = F.coalesce("seq", F.col("pos") + 1).cast("string")
    reason = F.concat(
        F.lit("Receipt payload hash mismatch at sequence "), seq, F.lit(": computed "), _cut(F.col("computed")), F.lit(", recorded "),
        _cut(F.col("hash")), F.lit(".")
    )
    return F.col("computed") != F.col("hash"), finding(
        _id("TAMPER", seq), "payload_integrity_verifier", 1.0, "critical", "quarantine", reason, check_no=1, sub_no=2, asset=_asset(seq), evidence=(_file(seq),), pos=F.col("pos")
    )


def _sequence_break() -> Check:
    n = F.coalesce("seq", F.lit(0))
    seq = n.cast("string")
    reason = F.concat(F.lit("Sequence number "), seq, F.lit(" does not rise above the one before it, "), F.col("last_seq").cast("string"), F.lit("."))
    return n <= F.col("last_seq"), finding(
        _id("SEQ-BREAK", seq), "sequence_monotonicity_checker", 0.95, "high", "quarantine", reason, check_no=2, asset=_asset(seq), evidence=(_file(seq),), pos=F.col("pos")
    )


def _substituted_model(expected_digest: str) -> Check:
    seq = F.coalesce("seq", F.lit(0)).cast("string")
    reason = F.concat(
        F.lit("Model substitution at sequence "), seq, F.lit(": digest "), _cut(F.col("model")),
        F.lit(" is not that of the attested model, "), _cut(F.lit(expected_digest)), F.lit(".")
    )
    return F.lower("model") != expected_digest.lower(), finding(
        _id("MODEL-SUB", seq), "model_integrity_attestation", 1.0, "critical", "quarantine", reason, check_no=4, asset=_asset(seq), evidence=(_file(seq),), pos=F.col("pos")
    )


def _unsigned() -> Check:
    seq = F.coalesce("seq", F.lit(0)).cast("string")
    reason = F.concat(F.lit("The receipt at sequence "), seq, F.lit(" is unsigned."))
    return F.col("signature") == "", finding(
        _id("UNSIGNED", seq), "ed25519_signature_verifier", 0.5, "warning", "review", reason, check_no=6, sub_no=2, asset=_asset(seq), pos=F.col("pos")
    )


def row_checks(rows: DataFrame, checks: list[Check]) -> DataFrame:
    """Findings of checks that look at one row: all of them in one pass over the rows."""
    found = F.array(*(F.when(holds, F.struct(*columns)) for holds, columns in checks))
    return rows.select(F.inline(F.filter(found, lambda f: f.isNotNull())))


def _hashed(receipts: DataFrame) -> DataFrame:
    return receipts.withColumn("computed", receipt_hash_column(F.col("payload_json"), F.col("prev")))


def chain_breaks(linked: DataFrame) -> DataFrame:
    return row_checks(linked, [_chain_break()])


def tampered(receipts: DataFrame) -> DataFrame:
    return row_checks(_hashed(receipts), [_tampered()])


def sequence_breaks(linked: DataFrame) -> DataFrame:
    return row_checks(linked, [_sequence_break()])


def substituted_models(receipts: DataFrame, expected_digest: str) -> DataFrame:
    return row_checks(receipts, [_substituted_model(expected_digest)])


def unsigned_receipts(receipts: DataFrame) -> DataFrame:
    """Opt-in: receipts without a signature, which bad_signatures passes over."""
    return row_checks(receipts, [_unsigned()])


def replays(receipts: DataFrame, store: bool = False) -> DataFrame:
    """Receipts whose nonce an earlier one had, naming the first; empty nonces don't count. With store the nonces used again
    are written first, so that their size is known and a small number of them is broadcast."""
    used = receipts.filter("nonce <> ''")
    first = used.groupBy("ledger", "nonce").agg(
        F.min(F.struct("pos", F.coalesce("seq", F.lit(0)).alias("seq"))).alias("first"), F.count(F.lit(1)).alias("uses")
    )
    repeated = first.filter("uses > 1")
    again = used.join(materialize(repeated, "repeated") if store else repeated, ["ledger", "nonce"]).filter("pos > first.pos")
    seq, prior = F.coalesce("seq", F.lit(0)).cast("string"), F.col("first.seq").cast("string")
    reason = F.concat(F.lit("Replay: nonce '"), F.col("nonce"), F.lit("' at sequence "), seq, F.lit(" was first seen at sequence "), prior, F.lit("."))
    return again.select(
        finding(
            _id("REPLAY", seq), "replay_attack_detector", 1.0, "critical", "quarantine", reason, check_no=2, sub_no=2, asset=_asset(seq),
            evidence=(_file(seq), _file(prior)), pos=F.col("pos")
        )
    )


def bad_signatures(receipts: DataFrame, public_key_pem: bytes | None) -> DataFrame:
    """Without a key one `unavailable` finding a ledger, with an unreadable one a key error; empty signatures are passed over."""
    ledgers = receipts.select("ledger").distinct()
    detector = "ed25519_signature_verifier"
    if not public_key_pem:
        return ledgers.select(finding(
            F.lit("FINDING-M3-SIG-UNAVAILABLE"), detector, 0.0, "info", "unavailable",
            F.lit("No Ed25519 public key was given; signatures are not verified."), check_no=3, confidence="medium"
        ))
    try:
        key = ed25519.load_public(public_key_pem)
    except ValueError as e:
        return ledgers.select(finding(
            F.lit("FINDING-M3-KEY-ERROR"), detector, 0.5, "high", "review", F.lit(f"The Ed25519 public key can't be parsed: {e}"),
            check_no=3
        ))
    seq = F.coalesce("seq", F.lit(0)).cast("string")
    signed = receipts.filter("signature <> ''")
    reason = F.concat(F.lit("The Ed25519 signature of the receipt at sequence "), seq, F.lit(" does not verify against the attested public key."))
    return signed.filter(~ed25519.verify_column(key, F.col("hash"), F.col("signature"))).select(
        finding(_id("SIG-BAD", seq), detector, 1.0, "critical", "quarantine", reason, check_no=3, asset=_asset(seq), evidence=(_file(seq),), pos=F.col("pos"))
    )


def checkpoint_leaves(receipts: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Checkpoints with `leaves`, the hashes of those sequences of the block that are there; of a repeated one the last's."""
    last = receipts.filter("seq is not null").groupBy("ledger", "seq").agg(F.max(F.struct("pos", "hash")).alias("last"))
    extent = last.groupBy("ledger").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    shift = lambda c, by: F.call_function("shiftright", F.col(c), F.col(by))
    lo, hi = F.greatest("start_sequence", "lo"), F.least("end_sequence", "hi")
    ranges = checkpoints.join(extent, "ledger").select("ledger", F.col("pos").alias("chk"), lo.alias("a"), hi.alias("b")).filter("b >= a")
    span = F.col("b").cast("double") - F.col("a").cast("double") + 1
    sliced = ranges.withColumn("level", F.greatest(F.ceil(F.log2(span / SLICES)), F.lit(0)).cast("int"))  # slices of 2**level numbers
    levels = [r["level"] for r in sliced.select("level").distinct().collect()] or [0]  # 55 at most
    blocks = sliced.withColumn("slice", F.explode(F.sequence(shift("a", "level"), shift("b", "level"))))
    placed = last.withColumn("level", F.explode(F.array(*map(F.lit, sorted(levels))))).withColumn("slice", shift("seq", "level"))
    met = blocks.hint("merge").join(placed, ["ledger", "level", "slice"]).filter("seq between a and b")
    held = met.groupBy("ledger", "chk").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("last.hash").alias("hash")))).alias("leaves"))
    named = held.select("ledger", F.col("chk").alias("pos"), F.transform("leaves", lambda x: x["hash"]).alias("leaves"))
    return checkpoints.join(named, ["ledger", "pos"], "left")


def merkle_mismatches(receipts: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Checkpoints whose root is not that of their receipts; a block of which no receipt is left gives none (see missing_blocks)."""
    rooted = checkpoint_leaves(receipts, checkpoints).filter("leaves is not null").withColumn("computed", merkle_root(F.col("leaves")))
    id, chk = F.concat(F.lit("FINDING-M3-MERKLE-MISMATCH-"), F.col("checkpoint_id")), F.col("checkpoint_id")
    reason = F.concat(
        F.lit("Merkle root mismatch in checkpoint "), chk, F.lit(", sequences "), F.concat_ws("-", "start_sequence", "end_sequence"), F.lit(": calculated "), _cut(F.col("computed")), F.lit(", recorded "), _cut(F.col("merkle_root")), F.lit(".")
    )
    return rooted.filter(F.lower("computed") != F.lower("merkle_root")).select(
        finding(
            id, "merkle_checkpoint_verifier", 1.0, "critical", "quarantine", reason, check_no=5,
            evidence=(F.concat(F.lit("checkpoint_"), chk, F.lit(".json")),), pos=F.col("pos")
        )
    )


def empty_ledger(df: DataFrame, ledger: str) -> DataFrame:
    one = df.sparkSession.range(1).select(F.lit(ledger).alias("ledger"))
    return one.select(finding(F.lit("FINDING-M3-EMPTY"), "ledger_reader", 0.0, "warning", "review", F.lit("The ledger has no receipts to audit."), check_no=0))


# Checks beyond the reference behaviour; off unless asked for.


def missing_blocks(receipts: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Checkpoints none of whose receipts is left, as when a ledger loses its last block."""
    chk = F.col("checkpoint_id")
    gone = checkpoint_leaves(receipts, checkpoints).filter("leaves is null")
    return gone.select(
        finding(
            F.concat(F.lit("FINDING-M3-MERKLE-MISSING-"), chk), "merkle_checkpoint_verifier", 1.0, "critical", "quarantine",
            F.concat(F.lit("No receipt of checkpoint "), chk, F.lit(" is left.")), check_no=6, pos=F.col("pos")
        )
    )


def bad_checkpoint_signatures(checkpoints: DataFrame, verifier_key_pem: bytes) -> DataFrame:
    key, chk = ed25519.load_public(verifier_key_pem), F.col("checkpoint_id")
    ok = ed25519.verify_column(key, F.col("merkle_root"), F.col("verifier_signature"))
    return checkpoints.filter(~ok).select(
        finding(
            F.concat(F.lit("FINDING-M3-CHK-SIG-BAD-"), chk), "ed25519_signature_verifier", 1.0, "critical", "quarantine",
            F.concat(F.lit("The signature of checkpoint "), chk, F.lit(" does not verify.")), check_no=6, sub_no=3, pos=F.col("pos")
        )
    )


def audit(
    receipts: DataFrame,
    checkpoints: DataFrame | None = None,
    expected_model: str | None = None,
    public_key_pem: bytes | None = None,
    verifier_key_pem: bytes | None = None,
    strict: bool = False,
    check_signatures: bool = True,
    store: bool = True,
) -> DataFrame:
    """All findings, with the columns that order them (ORDER). strict adds the opt-in checks.

    The checks read the receipts several times, so with store they are first written to the shared folder; without,
    receipts should be a table already.
    """
    if store:
        receipts = materialize(receipts, "receipts", "zstd")  # hex digits, of which that halves the bytes
        checkpoints = None if checkpoints is None else materialize(checkpoints, "checkpoints")
    if receipts.isEmpty():
        return empty_ledger(receipts, "")
    checks = [_tampered()]
    if expected_model:
        checks.append(_substituted_model(expected_model))
    if strict:
        checks.append(_unsigned())
    linked = row_checks(with_previous(receipts), [_chain_break(), _sequence_break()])
    parts = [linked, row_checks(_hashed(receipts), checks), replays(receipts, store)]
    if check_signatures:
        parts.append(bad_signatures(receipts, public_key_pem))
    if checkpoints is not None:
        parts.append(merkle_mismatches(receipts, checkpoints))
    if strict and checkpoints is not None:
        parts.append(missing_blocks(receipts, checkpoints))
        if verifier_key_pem:
            parts.append(bad_checkpoint_signatures(checkpoints, verifier_key_pem))
    return reduce(DataFrame.unionByName, parts)


def ordered(findings: DataFrame) -> DataFrame:
    """Findings in the order of the checks, and within a check of the receipts."""
    return findings.orderBy(*ORDER).drop(*ORDER)

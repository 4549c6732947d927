import json

import pytest
from pyspark.sql import functions as F

from veriframe.functions import ed25519
from veriframe.functions.canonical import receipt_hash
from veriframe.operators import attacks, audit, report, spot
from veriframe.operators.writer import EntryFile, LedgerFile, chain_long, chain_short
from veriframe.plans.queries import QUERIES
from veriframe.schemas import GENESIS
from veriframe.sources.ledger import read_checkpoints, read_entries, read_lines, read_receipts, receipts_of

MODEL = "ab" * 32
PRIVATE, PUBLIC = ed25519.generate_keys(bytes(range(32)))


def write(path, n=12, interval=5, **extra):
    f = LedgerFile(str(path), interval=interval)
    for k in range(1, n + 1):
        f.append({"input_image_sha256": f"{k:064x}", "model_weight_digest": MODEL, "output_payload_sha256": f"{k + 99:064x}", "nonce": f"nonce-{k:04d}", "image_path": f"img é {k}.png"} | extra, sign_with=PRIVATE)
    f.checkpoint()
    return f


@pytest.fixture(scope="module")
def ledger(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("ledger") / "ledger.jsonl"
    write(path)
    return read_receipts(spark, str(path)).cache(), read_checkpoints(spark, str(path)).drop("ledger"), str(path)


def found(receipts, checkpoints=None, **options):
    if checkpoints is not None:
        checkpoints = checkpoints.crossJoin(receipts.select("ledger").distinct())
    options = {"expected_model": MODEL, "check_signatures": False} | options
    return [r["finding_id"].removeprefix("FINDING-M3-") for r in audit.ordered(audit.audit(receipts, checkpoints, **options)).collect()]


def test_clean_ledger_has_no_findings(ledger):
    receipts, checkpoints, _ = ledger
    assert receipts.count() == 12 and checkpoints.count() == 3
    assert found(receipts, checkpoints) == []
    assert found(receipts, checkpoints, public_key_pem=PUBLIC, check_signatures=True, strict=True) == []


def test_mutations(ledger):
    receipts, checkpoints, _ = ledger
    at = lambda order: attacks.reposition(receipts, order)
    whole = list(range(12))
    assert found(at(whole[:4] + whole[5:]), checkpoints) == ["CHAIN-BREAK-SEQ-6", "MERKLE-MISMATCH-CHK-0001"]
    assert found(attacks.reuse_nonce(receipts, 6, "nonce-0001"), checkpoints) == ["TAMPER-SEQ-6", "REPLAY-SEQ-6"]
    assert found(attacks.substitute_model(receipts, [3], "cd" * 32), checkpoints) == ["TAMPER-SEQ-3", "MODEL-SUB-SEQ-3"]
    swapped = found(at([0, 1, 2, 4, 3, *range(5, 12)]), checkpoints)
    assert swapped == ["CHAIN-BREAK-SEQ-5", "CHAIN-BREAK-SEQ-4", "CHAIN-BREAK-SEQ-6", "SEQ-BREAK-SEQ-4"]
    assert found(at([*whole, 2]), checkpoints) == ["CHAIN-BREAK-SEQ-3", "SEQ-BREAK-SEQ-3", "REPLAY-SEQ-3"]
    assert found(at(whole[:10]), checkpoints) == []
    assert found(at(whole[:10]), checkpoints, strict=True) == ["MERKLE-MISSING-CHK-0003"]


def test_details_of_findings(ledger):
    receipts, _, _ = ledger
    row = audit.audit(attacks.reuse_nonce(receipts, 6, "nonce-0001"), check_signatures=False).filter("detector = 'replay_attack_detector'").first()
    assert (row["score"], row["severity"], row["recommended_disposition"], row["confidence"]) == (1.0, "critical", "quarantine", "high")
    assert row["evidence_artifacts"] == ["receipt_seq_6.json", "receipt_seq_1.json"] and row["asset_ref"] == f"{6:064x}"
    assert (row["contributor_ref"], row["detector_version"], row["access_tier"]) == ("C-07", "1.2", "T2")


def test_signatures(ledger):
    receipts, _, _ = ledger
    assert found(receipts, check_signatures=True) == ["SIG-UNAVAILABLE"]
    assert found(receipts, check_signatures=True, public_key_pem=b"none") == ["KEY-ERROR"]
    bad = receipts.withColumn("signature", F.when(F.col("seq") == 4, F.lit("00" * 64)).when(F.col("seq") == 5, F.lit("")).when(F.col("seq") == 7, F.lit("xyz")).otherwise(F.col("signature")))
    assert found(bad, check_signatures=True, public_key_pem=PUBLIC) == ["SIG-BAD-SEQ-4", "SIG-BAD-SEQ-7"]
    assert found(bad, check_signatures=True, public_key_pem=PUBLIC, strict=True) == ["SIG-BAD-SEQ-4", "SIG-BAD-SEQ-7", "UNSIGNED-SEQ-5"]


def test_empty_ledger_is_one_warning(ledger):
    receipts, checkpoints, _ = ledger
    rows = audit.audit(receipts.limit(0), checkpoints).collect()
    assert [(r["finding_id"], r["severity"], r["score"]) for r in rows] == [("FINDING-M3-EMPTY", "warning", 0.0)]


def test_bad_lines_are_skipped_and_odd_ones_kept(spark, tmp_path):
    p = {"sequence_number": 1, "nonce": "n", "x": 1.0}
    good = {"record_type": "receipt", "payload": p, "prev_receipt_hash": GENESIS, "receipt_hash": receipt_hash(p, GENESIS), "signature": ""}
    lines = ["", "{bad", "[1, 2]", json.dumps({"record_type": "checkpoint"}), json.dumps(good), '{"record_type": "receipt", "payload": {"nonce": "n", "nonce": "m"}, "prev_receipt_hash": null}', "   "]
    (tmp_path / "l.jsonl").write_text("\n".join(lines))
    rows = read_receipts(spark, str(tmp_path / "l.jsonl")).orderBy("pos").collect()
    assert [(r["pos"], r["seq"], r["nonce"]) for r in rows] == [(0, 1, "n"), (1, None, "n")]
    assert rows[1]["payload_json"] == '{"nonce":"m"}' and rows[1]["prev"] == ""
    ids = found(receipts_of(read_lines(spark, str(tmp_path / "l.jsonl"))), expected_model=None)
    assert ids == ["CHAIN-BREAK-SEQ-2", "TAMPER-SEQ-2", "SEQ-BREAK-SEQ-0", "REPLAY-SEQ-0"]


def test_file_order_survives_splits(spark, tmp_path):
    path = tmp_path / "big.jsonl"
    write(path, n=200, interval=50)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        receipts = read_receipts(spark, str(path)).cache()
        assert [r["seq"] for r in receipts.orderBy("pos").collect()] == list(range(1, 201))
        assert found(receipts, read_checkpoints(spark, str(path)).drop("ledger")) == []
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_writer_resumes_from_both_files(spark, tmp_path):
    path = tmp_path / "l.jsonl"
    write(path, n=7, interval=5)
    again = LedgerFile(str(path), interval=5)
    assert (again.sequence, again.count, again.pending) == (7, 2, [])
    for k in range(8, 13):
        again.append({"nonce": str(k)})
    receipts = read_receipts(spark, str(path))
    marks = read_checkpoints(spark, str(path)).drop("ledger")
    assert [(r["checkpoint_id"], r["start_sequence"], r["end_sequence"]) for r in marks.orderBy("pos").collect()] == [("CHK-0001", 1, 5), ("CHK-0002", 6, 7), ("CHK-0003", 8, 12)]
    assert found(receipts, marks, expected_model=None) == []
    assert marks.first()["verifier_signature"].startswith("UNSIGNED_CHECKPOINT_ROOT_")


def test_signed_checkpoints(spark, tmp_path):
    f = LedgerFile(str(tmp_path / "l.jsonl"), interval=2, verifier_key_pem=PRIVATE)
    f.append({"nonce": "a"})
    f.append({"nonce": "b"})
    marks = read_checkpoints(spark, str(tmp_path / "l.jsonl"))
    assert audit.bad_checkpoint_signatures(marks, PUBLIC).isEmpty()
    assert audit.bad_checkpoint_signatures(marks.withColumn("merkle_root", F.lit("00" * 32)), PUBLIC).count() == 1


def test_entry_ledger(spark, tmp_path):
    path = str(tmp_path / "e.jsonl")
    first = EntryFile(path).append("a", {"x": 1})
    EntryFile(path).extend([("b", {"p": tmp_path}), ("c", {})])
    rows = read_entries(spark, path).orderBy("pos").collect()
    assert [r["event_type"] for r in rows] == ["a", "b", "c"] and rows[1]["prev_hash"] == first
    (tmp_path / "e.jsonl").write_text('{"no": "hash"}\n')
    with pytest.raises(ValueError):
        EntryFile(path)


def test_both_chain_folds_agree(spark):
    rows = spark.createDataFrame([(c, s, f'{{"n":{s}}}') for c in "abc" for s in range(1, 20)], "chain string, seq long, payload_json string")
    a, b = (sorted(map(tuple, f(rows).select("chain", "seq", "prev", "hash").collect())) for f in (chain_short, chain_long))
    assert a == b and a[0][3] == receipt_hash({"n": 1}, GENESIS)


def test_native_fold_keeps_every_receipt(spark, tmp_path):
    spark.range(700).selectExpr("id AS event_id", "IF(id < 500, 1, id % 3 + 2) AS user_id").write.parquet(str(tmp_path / "events.parquet"))
    a, b = (sorted(map(tuple, QUERIES[q](spark, str(tmp_path)).collect())) for q in ("derived_chain_native", "derived_chain"))
    assert a == b and len(a) == 700 and max(r[1] for r in a) == 500


def test_spot_checks(ledger):
    receipts, _, _ = ledger
    assert spot.sample_positions(5, 0.4) == [0, 4] and spot.sample_size(5, 0.0) == 1 and spot.sample_size(0) == 0
    ids = lambda e, **o: sorted(r["finding_id"].removeprefix("FINDING-M3-SPOT-") for r in spot.spot_check(receipts, e, rate=1.0, **o).collect())
    assert ids(None) == sorted(f"UNAVAILABLE-SEQ-{k}" for k in range(1, 13))
    assert ids(lambda path: b"x") == sorted(f"FABRICATION-SEQ-{k}" for k in range(1, 13))

    def fails(path):
        raise RuntimeError("no")

    assert ids(fails) == sorted(f"EXEC-ERROR-SEQ-{k}" for k in range(1, 13))
    assert spot.sample_receipts(receipts, 0.25, exact=False).count() == 3


def test_report(ledger):
    receipts, checkpoints, _ = ledger
    clean = audit.audit(receipts, expected_model=MODEL)
    made = report.json_report(clean, 12, 3)
    s = made["audit_summary"]
    assert [s[f"total_{k}"] for k in ("receipts_audited", "checkpoints_audited", "findings")] == [12, 3, 1]
    assert s["overall_disposition"] == "ACCEPT" and [*s["severity_counts"].values()] == [0, 0, 0, 1]
    bad = report.json_report(audit.audit(attacks.reuse_nonce(receipts, 6, "<b>")), 12, 3)
    assert bad["audit_summary"]["overall_disposition"] == "QUARANTINE" and bad["audit_summary"]["severity_counts"]["critical"] == 1
    assert "&lt;b&gt;" not in report.html_report(made) and "<td>FINDING-M3-TAMPER-SEQ-6</td>" in report.html_report(bad)
    assert report.disposition(clean.limit(0)).first()[0] == "ACCEPT"
    m = json.loads(report.manifests(receipts).orderBy("seq").first()["manifest"])
    assert m["assertions"][0]["data"]["hash"] == f"{1:064x}" and m["assertions"][1]["data"]["sequence_number"] == 1
    assert report.coverage(receipts.sparkSession).count() == 12 and len(report.coverage_statement()["supported"]) == 7


def test_spot_checks_against_real_outputs(spark, ledger):
    receipts, _, _ = ledger
    outputs = receipts.filter("seq <= 3").select(F.col("image_path").alias("path"), F.lit(b"x").alias("output_bytes"))
    got = spot.spot_check_images(receipts, outputs, rate=1.0).groupBy(F.regexp_extract("finding_id", "SPOT-([A-Z]+)", 1).alias("k")).count().collect()
    assert {r["k"]: r["count"] for r in got} == {"FABRICATION": 3, "UNAVAILABLE": 9}

"""What must hold at any size: scratch tables, components, joins of wide ranges, samples and reports without a list on the driver."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veriframe import scratch
from veriframe.functions import ed25519
from veriframe.operators import audit, encoder, integrity, report, shift, spot
from veriframe.operators.components import components
from veriframe.plans import file_queries, ledgers, queries


def test_scratch_tables_are_written_and_released(spark):
    df = scratch.materialize(spark.range(10), "scratch-test")
    assert df.count() == 10 and "scratch-test" in df.inputFiles()[0]
    scratch.release(spark, df)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        df.count()


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randint(1, 200), rng.randint(1, 200)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for x in parent if any(x in p and p[0] != p[1] for p in links)}
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()} == want


@pytest.mark.parametrize(("threshold", "agree"), [(3, 3), (3, 1), (6, 2)])
def test_near_duplicates_against_all_pairs(spark, threshold, agree):
    rng = random.Random(7)
    base = [rng.getrandbits(63) for _ in range(60)]
    near = [b ^ sum(1 << k for k in rng.sample(range(63), rng.randint(1, threshold + 2))) for b in base for _ in range(3)]
    every = sorted({*base, *near, 0, 1, 7})
    want = {(a, b, (a ^ b).bit_count()) for a in every for b in every if a < b and (a ^ b).bit_count() <= threshold}
    got = integrity.near_duplicates(spark.createDataFrame([(x,) for x in every], "hash long"), threshold=threshold, agree=agree).collect()
    assert len(got) == len(want) > 30 and set(map(tuple, got)) == want


def test_exploded_sides_are_never_broadcast(spark):
    """Of rows that an explode multiplies the planner knows the size before it only."""
    hashes = spark.range(100).select(F.col("id").alias("hash"))
    chk = spark.createDataFrame([("l", 0, 1, 10**12)], "ledger string, pos long, start_sequence long, end_sequence long")
    made = (
        integrity.near_duplicates(hashes), integrity.sybil_pairs(hashes, "hash", F.col("hash")), audit.checkpoint_leaves(_receipts(spark, 3), chk)
    )
    for df, joined in zip(made, ("[c#", "[k#", "[ledger#")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert any("SortMergeJoin " + joined in line for line in plan.splitlines()), plan


def test_ranges_agree_however_partitions_are_joined(spark, tmp_path):
    rows = [(k, k * 7919 % 1000, float(k * 7919 % 1000)) for k in range(40_000)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, value double").repartition(8)
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    want = [(k, c, last) for (k, c, _), last in zip(rows, [0, *(c for _, c, _ in rows)]) if c <= last]
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"}
    before = {n: spark.conf.get(n, None) for n in conf}
    try:
        for n, value in conf.items():
            spark.conf.set(n, value)
        got = sorted(map(tuple, queries.QUERIES["sequence_by_position"](spark, str(tmp_path)).collect()))
        found = shift.ks_statistic(spark.read.parquet(f"{tmp_path}/orders.parquet"), "value", F.col("value") < 300).first()
    finally:
        for n, value in before.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)
    assert got == want
    assert tuple(found) == (12_000, 28_000, pytest.approx(1.0))


def test_ledger_files_are_as_many_as_tasks(spark, sf, tmp_path):
    receipts = ledgers.attacked(spark, sf)
    n = receipts.select("ledger").distinct().count()
    found = list(Path(file_queries._ledger_files(receipts, tmp_path)).rglob("part-*"))
    assert 1 <= len(found) <= receipts.rdd.getNumPartitions() < n


def test_class_areas_have_a_known_size(spark):
    note = F.struct(F.array(F.lit(1.0), F.lit(1.0), F.lit(2.0), F.col("id") % 3 * 1.0).alias("bbox"), F.lit("c").alias("class_name"))
    size = F.struct(F.lit(9).alias("width"), F.lit(9).alias("height"))
    assets = spark.range(30).select(F.col("id").alias("asset_id"), size.alias("image_metadata"), F.array(note).alias("annotations"))
    found = integrity.annotation_anomalies(assets)
    assert found.count() == 10 and any("class-areas" in name for name in found.inputFiles())


def test_vectors_as_a_matrix():
    import pyarrow as pa

    got = integrity._matrix(pa.array([[0.0], [1, 2], [3, 4]], pa.list_(pa.float32())).slice(1))
    assert got.tolist() == [[1, 2], [3, 4]]
    with pytest.raises(ValueError, match="length"):
        integrity._matrix(pa.array([[1.0], [2, 3, 4]]))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ledgers_move_only_ids_and_once(spark, sf):
    moved = [line for line in _plan(ledgers.attacked(spark, sf)).splitlines() if "Exchange" in line]
    assert len(moved) == 1 and "Join" not in _plan(ledgers.attacked(spark, sf))
    below = _plan(ledgers.attacked(spark, sf)).split("Exchange")[1]
    assert "sha2" not in below and "md5" not in below


def test_checks_of_two_rows_move_no_payload(spark):
    rows = _receipts(spark, 12)
    plan = audit.audit(rows, store=False)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.split("Join LeftOuter")[1].split("Join")[0].split("Union")[0]
    assert "payload_json" not in joined.split("LogicalRDD")[0]


def _receipts(spark, n):
    rows = [("l", k, "{}", k + 1, "", f"{k:064x}", "", f"n{k}", "m", "a", "o", None) for k in range(n)]
    names = "ledger string, pos long, payload_json string, seq long, prev string, hash string, signature string, nonce string, model string, asset string, output string, image_path string"
    return spark.createDataFrame(rows, names)


def test_checkpoints_may_claim_any_range(spark):
    chk = [("l", 0, "CHK-0001", 1, 10**12), ("l", 1, "CHK-0002", -(2**63), 2**63 - 1), ("l", 2, "CHK-0003", 4, 6), ("l", 3, "CHK-0004", 9, 2), ("l", 4, "CHK-0005", 100, 10**15)]
    df = spark.createDataFrame([(*c, "f" * 64) for c in chk], "ledger string, pos long, checkpoint_id string, start_sequence long, end_sequence long, merkle_root string")
    got = {r["checkpoint_id"]: r["leaves"] for r in audit.checkpoint_leaves(_receipts(spark, 30), df).collect()}
    every = [f"{k:064x}" for k in range(30)]
    assert got == {"CHK-0001": every, "CHK-0002": every, "CHK-0003": every[3:6], "CHK-0004": None, "CHK-0005": None}
    far = _receipts(spark, 3).unionByName(_receipts(spark, 1).withColumns({"seq": F.lit(10**14), "pos": F.lit(3)}))
    assert {r["checkpoint_id"]: len(r["leaves"] or ()) for r in audit.checkpoint_leaves(far, df).collect()} == {"CHK-0001": 3, "CHK-0002": 4, "CHK-0003": 0, "CHK-0004": 0, "CHK-0005": 1}


def test_hash_ordered_samples_have_their_size(spark):
    rows = _receipts(spark, 500)
    for rate, least, n in ((0.05, 1, 25), (0.0, 3, 3), (1.0, 1, 500)):
        got = spot.sample_receipts(rows, rate, least, exact=False)
        assert got.count() == n == got.select("pos").distinct().count()
    a, b = (spot.sample_receipts(rows, 0.2, seed=s, exact=False).select("pos").collect() for s in (1, 2))
    assert sorted(a) != sorted(b)


def test_evaluators_of_one_and_of_three_arguments(spark):
    rows = _receipts(spark, 4).withColumn("image_path", F.col("pos").cast("string")).withColumn("draw", F.lit(0))
    one = spot.reexecute(rows, lambda path: path.encode()).select("pos", "actual").collect()
    three = spot.reexecute(rows, lambda path, model, config: f"{path}{model}{config['k']}".encode(), "m", {"k": 1}).select("pos", "actual").collect()
    assert len(one) == len(three) == 4 and set(one) != set(three)


def test_failed_inference_is_a_finding_of_its_own(spark):
    rows = _receipts(spark, 3).withColumn("image_path", F.concat(F.lit("p"), F.col("pos").cast("string")))
    outputs = spark.createDataFrame([("p0", None, "ValueError: broken"), ("p1", b"x", None)], "path string, output_bytes binary, error string")
    found = {r["finding_id"]: r["severity"] for r in spot.spot_check_images(rows, outputs, rate=1.0).collect()}
    assert found == {"FINDING-M3-SPOT-EXEC-FAILED-SEQ-1": "warning", "FINDING-M3-SPOT-FABRICATION-SEQ-2": "critical", "FINDING-M3-SPOT-UNAVAILABLE-SEQ-3": "info"}


def test_streamed_report_is_the_same(spark, tmp_path):
    found = audit.audit(_receipts(spark, 12), store=False)
    whole = report.json_report(found, 12, 0)
    streamed = json.loads(report.write_json_report(found, 12, 0, str(tmp_path / "r.json")).read_text())
    assert streamed["findings"] == whole["findings"] and streamed["audit_summary"] == whole["audit_summary"] and len(whole["findings"]) > 12


def test_reports_have_a_line_for_each_finding(spark, tmp_path):
    found = audit.audit(_receipts(spark, 12), store=False)
    n = found.count()
    lines = report.write_json_report(found, 12, 0, str(tmp_path / "r.json")).read_text().splitlines()
    assert len(lines) == n + 2 and json.loads(lines[1].rstrip(","))["finding_id"]
    page = report.write_html_report(found, 12, 0, str(tmp_path / "r.html")).read_text()
    assert page.replace("\n", "") == report.html_report(report.json_report(found, 12, 0))
    assert max(line.count("<tr><td>") for line in page.splitlines()) == 1 and page.count("<tr><td>") == n


def test_tables_of_multiples_verify_as_plain_multiplication():
    seed = bytes(range(32))
    pub = ed25519.public_key(seed)
    assert ed25519._mul_by(2**255 - 1, ed25519._base())[2] and ed25519._pack(ed25519._mul_by(12345, ed25519._base())) == ed25519._pack(ed25519._mul(12345, ed25519._G))
    s = ed25519.sign(seed, b"text")
    assert ed25519.verify(pub, b"text", s) and not ed25519.verify(pub, b"other", s) and not ed25519.verify(pub, b"text", s[:32] + bytes(32))


def test_verification_takes_no_root(monkeypatch):
    seed = bytes(range(32))
    pub, signed = ed25519.public_key(seed), ed25519.sign(seed, b"text")
    assert ed25519.verify(pub, b"text", signed)  # the tables of the key are there

    def refuse(*_):
        raise AssertionError

    monkeypatch.setattr(ed25519, "_unpack", refuse)
    assert ed25519.verify(pub, b"text", signed) and not ed25519.verify(pub, b"other", signed)
    assert not ed25519.verify(pub, b"text", b"\xff" * 32 + signed[32:])


def test_demo_model_runs(tmp_path):
    np = pytest.importorskip("numpy")
    pytest.importorskip("onnxruntime")
    pin = encoder.export_demo_model(str(tmp_path / "m.onnx"), classes=4)
    run = encoder.load_encoder(encoder.verified(str(tmp_path / "m.onnx"), pin))
    x = np.stack([np.full((5, 7), v, np.float32) for v in (0.25, 0.5, 1.0)])[None]
    want = [(0.25 + 2 * 0.5 + 3 * 1.0) * (j + 1) / 64 + j / 8 for j in range(4)]
    assert run(x).shape == (1, 4) and run(x)[0].tolist() == pytest.approx(want, abs=1e-6)

import json
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veriframe.functions import ed25519
from veriframe.operators import gate, probe
from veriframe.schemas import ASSET, TASKS
from veriframe.sources import profile


def assets(spark, n=1, box=True, polygon=False, who="alice"):
    note = ([1.0, 1.0, 2.0, 2.0] if box else [1.0, 1.0, 0.0, 2.0], 0, "a", [[1.0, 1.0]] if polygon else None)
    return spark.createDataFrame([(f"a{i}", "p", "0" * 64, "COCO", (1, 1, 3), [note], who, "t") for i in range(n)], ASSET)


class Cleanse(gate.Detector):
    def __init__(self):
        super().__init__("neural-cleanse", "T2", ["CLASSIFICATION"], requires_reference=True)

    def _run(self, assets, matrix, **kwargs):
        return gate.result(assets.sparkSession, self.detector_id, "SUCCESS", score=0.5)


@pytest.mark.parametrize(
    ("tier", "task", "mode", "status", "reason"),
    [
        ("T0", "CLASSIFICATION", "ATTESTED", "UNAVAILABLE", "UNAVAILABLE_AT_TIER: requires T2_WEIGHTS, found T0_LABELS"),
        ("T2", "DETECTION", "ATTESTED", "UNAVAILABLE", "NEURAL_CLEANSE_UNAVAILABLE_FOR_TASK_TYPE"),
        ("T2", "CLASSIFICATION", "UNREFERENCED", "UNAVAILABLE", "NEURAL_CLEANSE_UNAVAILABLE_WITHOUT_REFERENCE"),
        ("T2", "CLASSIFICATION", "ATTESTED", "SUCCESS", None),
    ],
)
def test_detector_gate(spark, tier, task, mode, status, reason):
    row = Cleanse().run(assets(spark), gate.Matrix(tier, task, mode)).first()
    assert (row["status"], row["reason"]) == (status, reason)


def test_matrix_gate():
    m = gate.Matrix("T0", "SEGMENTATION")
    assert m.supports("x", "T2", ["SEGMENTATION"]) == (False, "UNAVAILABLE_AT_TIER: requires T2, found T0")
    assert m.supports("x", "T0", ["DETECTION"]) == (False, "TASK_UNSUPPORTED: requires one of [DETECTION], found SEGMENTATION")
    assert m.supports("x", "T0", [])[1].startswith("TASK_UNSUPPORTED: requires one of [<none>]")
    assert m.supports("", "T0", TASKS)[0] is False and m.supports("x", "T0", TASKS) == (True, "SUPPORTED: detector=x")
    assert gate.Matrix.from_json(m.to_json()) == m
    with pytest.raises(ValueError):
        gate.Matrix("T9")


def test_placeholders(spark):
    assert gate.output_signature_verifier().run(assets(spark), gate.Matrix("T0")).first()["score"] == 0.99
    assert gate.fragile_watermark_detector().run(assets(spark), gate.Matrix("T1")).first()["status"] == "UNAVAILABLE"
    assert gate.fragile_watermark_detector().run(assets(spark), gate.Matrix("T2")).first()["score"] == 0.95
    assert gate.Matrix("T2", metadata={"a": 1}).frame(spark).first()["metadata"] == '{"a": 1}'


def test_nothing_at_all(spark):
    m = probe.probe(assets(spark, 0))
    assert (m.access_tier, m.task_type, m.reference_mode, m.model_digest) == ("T0", "CLASSIFICATION", "UNREFERENCED", None)


def test_tiers(tmp_path):
    def tier(name, data):
        (tmp_path / name).write_bytes(data)
        return probe.access_tier(str(tmp_path / name))[0]

    header = json.dumps({"w": {"dtype": "F32"}, "__metadata__": {}}).encode()
    assert tier("m.safetensors", struct.pack("<Q", len(header)) + header + bytes(16)) == "T2"
    assert tier("n.safetensors", struct.pack("<Q", 10**9)) == "T0" and tier("o.safetensors", b"abc") == "T0"
    assert tier("m.pt", b"PK\x03\x04") == "T2" and tier("n.pt", b"\x80\x02}") == "T2" and tier("o.pt", b"text") == "T0"
    assert tier("a.json", b'{"endpoint": "https://x.example/v", "outputs": ["logits"]}') == "T1"
    assert tier("b.json", b'{"returns": "Weights"}') == "T2" and tier("c.json", b'{"a": 1}') == "T0" and tier("d.json", b"[1]") == "T0" and tier("e.json", b"{") == "T0"
    assert tier("f.yaml", b"url: http://x.example\n") == "T1" and tier("x.bin", b"1") == "T0"
    assert probe.access_tier(str(tmp_path)) [0] == "T0" and probe.access_tier(str(tmp_path / "none"))[0] == "T0"
    assert probe.access_tier("https://x.example/m")[:2] == ("T1", "remote_api") and probe.access_tier(None)[1] == "unknown"
    assert probe.model_spec(Path("https://x.example/m")) == "https://x.example/m" and probe.model_spec("  ") is None


def test_tasks(spark):
    assert probe.task_type(assets(spark, polygon=True)).first()["task_type"] == "SEGMENTATION"
    assert probe.task_type(assets(spark)).first()["task_type"] == "DETECTION"
    assert probe.task_type(assets(spark, box=False)).first()["task_type"] == "CLASSIFICATION"
    c = probe.cohort(assets(spark, 2).union(assets(spark, who="")).union(assets(spark, who="bob"))).first()
    assert (c["asset_count"], c["contributor_ids"], c["contributor_count"]) == (4, ["", "alice", "bob"], 2)


def test_reference_modes(spark, tmp_path):
    private, public = ed25519.generate_keys(bytes(32))
    (tmp_path / "key.pem").write_bytes(public)
    doc = {"name": "x", "attestation": {"public_key_path": "key.pem"}}
    p = tmp_path / "p.json"
    doc["attestation"]["signature"] = ed25519.sign_hex(private, profile.signed_text(doc))
    p.write_text(json.dumps(doc))
    assert probe.probe(assets(spark), None, str(p)).reference_mode == "ATTESTED"
    p.write_text(json.dumps(doc | {"name": "y"}))
    assert probe.reference_mode(str(p), 2)[0] == "BOOTSTRAPPED" and probe.reference_mode(str(p), 0)[0] == "UNREFERENCED"
    del doc["attestation"]["signature"]
    p.write_text(json.dumps(doc))
    (tmp_path / "p.json.sig").write_text(ed25519.sign_hex(private, profile.signed_text(doc)))
    assert profile.is_attested(str(p)) and not profile.is_attested(str(p), public_key_path=str(tmp_path / "none"))
    (tmp_path / "s.yaml").write_text("status: scaffold\n")
    assert probe.reference_mode(str(tmp_path / "s.yaml"), 0)[0] == "BOOTSTRAPPED"
    (tmp_path / "l.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        profile.load_profile(str(tmp_path / "l.yaml"))


def test_older_probes(tmp_path):
    assert probe.inspect_api(lambda _: {"label": 1, "Confidence": 0.5}, None).access_tier == "T1"
    assert probe.inspect_api(lambda _: {"label": 1}, None).access_tier == "T0"
    assert probe.inspect_api(lambda _: {"state_dict": 1}, None).access_tier == "T2"
    assert probe.inspect_api(lambda _: 1 / 0, None).reference_mode == "UNREFERENCED"
    assert probe.inspect_file(str(tmp_path / "none.onnx")).access_tier == "T0"


def test_columns(spark):
    rows = spark.createDataFrame([(b"PK\x03",), (b"\x80\x04",), (b"\x80\x09",), (b"",), (None,)], "b binary")
    assert [r[0] for r in rows.select(probe.torch_container_column(F.col("b"))).collect()] == ["zip", "pickle", "unknown", "unknown", "unknown"]

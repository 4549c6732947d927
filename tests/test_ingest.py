import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from veriframe import cli
from veriframe.errors import BadImageHeaderError, CorruptAnnotationError, IngestError, MissingAssetError
from veriframe.schemas import asset_violations
from veriframe.sources import datasets
from veriframe.sources.images import image_size
from veriframe.sources.ledger import read_entries


def png(path, width, height, channels=3):
    path.parent.mkdir(parents=True, exist_ok=True)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(bytes((width * channels + 1) * height))) + chunk(b"IEND", b""))
    return path


@pytest.fixture
def coco(tmp_path):
    png(tmp_path / "images" / "a.png", 64, 48)
    png(tmp_path / "images" / "b.png", 80, 60)
    doc = {
        "images": [dict(file_name=f"{n}.png", id=i) for i, n in ((7, "a"), (8, "b"), (9, "gone"))],
        "annotations": [dict(bbox=b, category_id=c, image_id=7) for c, b in ((2, [4, 6, 10, 12]), (3, [-4, 6, 0, 12]), (5, [1, 1, 2, 2]), (2, [1, 1, -2, 2]), (2, [1, 1]))],
        "categories": [dict(name="cat", id=2), dict(name="dog", id=2), dict(id=3)],
    }
    (tmp_path / "annotations").mkdir()
    (tmp_path / "annotations" / "inst.json").write_text(json.dumps(doc))
    return tmp_path


@pytest.fixture
def yolo(tmp_path):
    png(tmp_path / "images" / "a.png", 100, 80)
    png(tmp_path / "images" / "sub" / "b.png", 100, 80)
    png(tmp_path / "images" / "c.png", 100, 80)
    (tmp_path / "images" / "d.png").write_bytes(b"no image")
    (tmp_path / "labels" / "sub").mkdir(parents=True)
    (tmp_path / "labels" / "a.txt").write_text("# boxes\n0 0.5 0.5 0.2 0.5 0.9\n\n1.7 0.05 0.5 0.2 0.5\n0 0.5 0.5 0 0.5\n")
    (tmp_path / "labels" / "sub" / "b.txt").write_text("0 0.5 0.5 0.2\n")
    spec = "train: images\nval: images\nnames: {0: car}\n"
    (tmp_path / "data.yaml").write_text(spec)
    return tmp_path


def test_coco(spark, coco, tmp_path):
    assert datasets.detect_format(coco) == "COCO"
    rows = {r["asset_id"]: r for r in datasets.ingest(spark, coco, "auto", "alice", str(tmp_path / "l.jsonl")).collect()}
    assert sorted(rows) == ["coco-7", "coco-8"]
    a = rows["coco-7"]
    assert a["image_metadata"] == (64, 48, 3) and len(a["sha256"]) == 64 and a["contributor_id"] == "alice"
    assert [(n["bbox"], n["class_name"]) for n in a["annotations"]] == [([4, 6, 10, 12], "dog"), ([0, 6, 0, 12], "class_3"), ([1, 1, 2, 2], "class_5")]
    assert rows["coco-8"]["annotations"] == []
    entries = read_entries(spark, str(tmp_path / "l.jsonl")).orderBy("pos").collect()
    assert [e["event_type"] for e in entries] == ["m0.ingest.asset"] * 2 + ["m0.ingest.dataset"]
    assert json.loads(entries[2]["payload_json"])["asset_count"] == 2 and json.loads(entries[0]["payload_json"])["annotation_count"] == 3
    with pytest.raises(MissingAssetError):
        datasets.ingest(spark, coco, "coco", "alice", str(tmp_path / "m.jsonl"), strict=True)


def test_coco_errors(spark, tmp_path):
    png(tmp_path / "images" / "a.png", 4, 4)
    bad = tmp_path / "x.json"
    bad.write_text("{not-json")
    with pytest.raises(CorruptAnnotationError):
        datasets.read_coco(spark, bad, tmp_path / "images", "a")
    bad.write_text('{"images": []}')
    with pytest.raises(CorruptAnnotationError):
        datasets.read_coco(spark, bad, tmp_path / "images", "a")
    with pytest.raises(MissingAssetError):
        datasets.read_coco(spark, tmp_path / "none.json", tmp_path / "images", "a")
    with pytest.raises(MissingAssetError):
        datasets.ingest(spark, tmp_path / "nope", "auto", "a")
    with pytest.raises(IngestError):
        datasets.ingest(spark, tmp_path, "auto", "")
    with pytest.raises(IngestError):
        datasets.detect_format(tmp_path, "voc")


def test_yolo(spark, yolo, tmp_path):
    assert datasets.detect_format(yolo) == "YOLO"
    rows = {r["asset_id"]: r for r in datasets.ingest(spark, yolo, "auto", "bob", str(tmp_path / "l.jsonl")).collect()}
    assert sorted(rows) == ["yolo-a", "yolo-c"]
    assert [(n["bbox"], n["category_id"], n["class_name"]) for n in rows["yolo-a"]["annotations"]] == [([40, 20, 20, 40], 0, "car"), ([0, 20, 20, 40], 1, "class_1")]
    assert rows["yolo-a"]["label_sha256"] and rows["yolo-c"]["label_sha256"] is None and rows["yolo-c"]["annotations"] == []
    kept = datasets.read_yolo(spark, yolo, "bob", keep_bad=True).filter("bad_record is not null").collect()
    assert sorted(r["bad_record"].split(":")[0] for r in kept) == ["corrupt", "header"]
    with pytest.raises((CorruptAnnotationError, BadImageHeaderError)):
        datasets.read_yolo(spark, yolo, "bob", strict=True)


def test_yolo_layout(tmp_path):
    assert datasets.class_names({"nc": 2}) == {0: "class_0", 1: "class_1"} and datasets.class_names({}) == {} and datasets.class_names({"names": ["a"]}) == {0: "a"}
    with pytest.raises(CorruptAnnotationError):
        datasets.class_names({"names": "a"})
    with pytest.raises(MissingAssetError):
        datasets.find_yaml(tmp_path)
    (tmp_path / "data.yaml").write_text("- a\n")
    with pytest.raises(CorruptAnnotationError):
        datasets.load_yaml(tmp_path / "data.yaml")
    with pytest.raises(MissingAssetError):
        datasets.image_folders(tmp_path, tmp_path / "data.yaml", {})
    (tmp_path / "train" / "images").mkdir(parents=True)
    (tmp_path / "images").mkdir()
    got = datasets.image_folders(tmp_path, tmp_path / "data.yaml", {"train": "train", "val": "train/images"})
    assert got == [tmp_path / "train" / "images", tmp_path / "images"]
    assert datasets.labels_folder(tmp_path / "images") == tmp_path / "labels"
    assert datasets.labels_folder(tmp_path / "images" / "train") == tmp_path / "labels" / "train"


def test_image_headers(tmp_path):
    assert image_size(png(tmp_path / "x.png", 5, 6, 4).read_bytes()) == (5, 6, 4)
    assert image_size(png(tmp_path / "x.png", 5, 6).read_bytes()[:-20]) is None
    assert image_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x07\x00\x09\x03" + bytes(20)) == (9, 7, 3)
    assert image_size(b"BM" + bytes(16) + struct.pack("<iiHH", 3, -4, 1, 24)) == (3, 4, 3)
    assert image_size(b"II*\x00" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 256, 3, 1, 12) + struct.pack("<HHII", 257, 4, 1, 9)) == (12, 9, 1)
    assert image_size(b"") is None and image_size(None) is None and image_size(b"text") is None


def test_asset_rules(spark, coco):
    rows = datasets.read_coco(spark, coco / "annotations" / "inst.json", coco / "images", "a")
    assert rows.select(asset_violations().alias("v")).filter(F.size("v") > 0).isEmpty()
    bad = rows.limit(1).withColumns({"sha256": F.lit("zz"), "format": F.lit("VOC"), "contributor_id": F.lit("")})
    assert bad.select(asset_violations()).first()[0] == ["sha256", "format", "contributor_id"]


def test_cli(spark, coco, tmp_path, capsys):
    assert cli.main([str(coco), "--contributor-id", "c", "--ledger", str(tmp_path / "l.jsonl"), "--output", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert cli.main([str(coco), "--contributor-id", "c", "--ledger", str(tmp_path / "l.jsonl")]) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 2

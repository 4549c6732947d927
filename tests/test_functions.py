import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriframe.functions import boxes, ed25519
from veriframe.functions.canonical import canonical_json, canonical_payload, receipt_hash, receipt_hash_column
from veriframe.functions.merkle import inclusion_proof, merkle_root, root_of, verify_proof


def leaves(n):
    return [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 8, 9])
def test_merkle_root_and_proofs(spark, n):
    want = root_of(leaves(n))
    df = spark.createDataFrame([(leaves(n),)], "l array<string>")
    assert df.select(merkle_root(F.col("l"))).first()[0] == want
    if n == 0:
        assert want == ""
        return
    each = df.select("l", F.posexplode("l").alias("i", "leaf")).withColumn("p", inclusion_proof(F.col("l"), F.col("i")))
    rows = each.select(F.size("p").alias("n"), verify_proof(F.col("leaf"), F.col("p"), F.upper(F.lit(want))).alias("ok"), verify_proof(F.lit("00" * 32), F.col("p"), F.lit(want)).alias("bad")).collect()
    assert all(r["ok"] and not r["bad"] for r in rows)
    assert {r["n"] for r in rows} == {(n - 1).bit_length()}
    assert df.select(inclusion_proof(F.col("l"), F.lit(n))).first()[0] is None


def test_one_leaf_is_its_root_and_odd_levels_repeat_the_last(spark):
    a, b, c = leaves(3)
    pair = lambda x, y: hashlib.sha256(bytes.fromhex(x) + bytes.fromhex(y)).hexdigest()
    assert root_of([a]) == a
    assert root_of([a, b, c]) == pair(pair(a, b), pair(c, c))


def test_canonical_payload_of_every_kind_of_line(spark):
    payloads = [
        {"b": 1, "a": "x"},
        {"n": 1.0, "m": 1e20, "z": -0.0, "t": 1e-7},
        {"é": "ü ✓ 😀", "d": "\x7f"},
        {"path": "c:\\x\\y", "q": 'a"b'},
        {"nested": {"z": [1, {"y": None, "x": True}]}, "A": 1, "a": 2},
        {"t": "2026-09-19T10:58:48.293749+00:00", "big": 12345678901234567890123},
        {},
    ]
    lines = [json.dumps({"record_type": "receipt", "payload": p}, ensure_ascii=bool(k % 2)) for k, p in enumerate(payloads)]
    extra = ['{"payload": {"a": 1, "a": 2}}', '{"record_type": "receipt"}', "[1]", "{bad", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines + extra)], "i int, line string")
    got = [r[0] for r in df.orderBy("i").select(canonical_payload(F.col("line"))).collect()]
    assert got == [canonical_json(p) for p in payloads] + ['{"a":2}', "{}", None, None, None, None]


def test_receipt_hash_column(spark):
    p, prev = {"b": 2, "a": "x"}, "0" * 64
    got = spark.range(1).select(receipt_hash_column(F.lit(canonical_json(p)), F.lit(prev))).first()[0]
    assert got == receipt_hash(p, prev)


def test_ed25519_vectors():
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    pub = bytes.fromhex("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a")
    sig = "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"
    assert ed25519.public_key(seed) == pub
    assert ed25519.sign(seed, b"").hex() == sig
    assert ed25519.verify(pub, b"", bytes.fromhex(sig))
    assert not ed25519.verify(pub, b"x", bytes.fromhex(sig))
    private, public = ed25519.generate_keys(seed)
    assert ed25519.load_private(private) == seed and ed25519.load_public(public) == pub
    signed = ed25519.sign_hex(private, "ab" * 32)
    assert ed25519.verify_hex(pub, "ab" * 32, signed) and not ed25519.verify_hex(pub, "ab" * 32, "zz") and not ed25519.verify_hex(pub, "ab" * 32, "")
    with pytest.raises(ValueError):
        ed25519.load_public(b"nothing")


def test_yolo_and_coco_boxes(spark):
    one = spark.range(1)
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert one.select(boxes.yolo_box(*lit(".5", ".5", ".2", ".5"), F.lit(100), F.lit(80))).first()[0] == [40, 20, 20, 40]
    assert one.select(boxes.yolo_box(*lit(0.05, 0.5, 0.2, 0.5), F.lit(100), F.lit(80))).first()[0] == [0.0, 20.0, 20.0, 40.0]  # overhang stays in the width
    rows = [([3.0, 6.0, 10.0, 12.0],), ([-4.0, 6.0, 0.0, 12.0],), ([1.0, 1.0, -1.0, 2.0],), ([1.0, 2.0],), (None,), ([1.0, None, 2.0, 2.0],)]
    got = [r[0] for r in spark.createDataFrame(rows, "b array<double>").select(boxes.coco_box(F.col("b"))).collect()]
    assert got == [[3.0, 6.0, 10.0, 12.0], [0.0, 6.0, 0.0, 12.0], None, None, None, None]


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=32, max_size=32), st.text(max_size=40))
def test_ed25519_round_trip(seed, text):
    sig = ed25519.sign(seed, text.encode("utf-8", "surrogatepass"))
    assert ed25519.verify(ed25519.public_key(seed), text.encode("utf-8", "surrogatepass"), sig)


def test_cbor_vectors():
    from veriframe.functions.canonical import canonical_cbor

    for value, want in ((0, "00"), (23, "17"), (24, "1818"), (1000, "1903e8"), (-1, "20"), (-1000, "3903e7"), (1000000000000, "1b000000e8d4a51000"), (1.1, "fb3ff199999999999a"), (None, "f6"), (True, "f5"), ("ü", "62c3bc"), (b"\x01", "4101"), ([1, [2, 3]], "8201820203"), ({"b": 2, "a": 1, "aa": 3}, "a36161016162026261" + "6103")):
        assert canonical_cbor(value).hex() == want

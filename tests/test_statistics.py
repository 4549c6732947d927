import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe.errors import IntegrityError
from veriframe.operators import attacks, encoder, fusion, integrity, model_integrity, shift
from veriframe.streaming import chain


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(3 * (i % 3), 1, 8).astype(np.float32).tolist(), i % 3) for i in range(300)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").cache()


def frame(vectors):
    p = vectors.toPandas()
    return p, np.stack(p["embedding"]).astype(float)


def test_moments_mahalanobis_spectral(vectors):
    p, x = frame(vectors)
    m = integrity.class_moments(vectors)
    for k in range(3):
        own = x[p["label"] == k]
        assert np.allclose(m[k][1], own.mean(0)) and np.allclose(m[k][2], np.cov(own.T, bias=True))
    shared = sum(n * c for n, _, c in m.values()) / 300
    inv = np.linalg.inv(shared + 1e-3 * np.eye(8))
    want = np.sqrt([min((v - mu) @ inv @ (v - mu) for _, mu, _ in m.values()) for v in x])
    got = integrity.mahalanobis(vectors, m).toPandas().set_index("vec_id")["distance"]
    assert np.allclose(got.loc[p["vec_id"]], want)
    assert integrity.spectral_signatures(vectors, m).filter("score < 0").isEmpty()
    clusters = integrity.activation_clusters(vectors, m).toPandas()
    assert list(clusters["n"]) == [100, 100, 100] and (clusters["minority_share"] > 0.2).all()


def test_nearest_is_exact_in_blocks(vectors):
    p, x = frame(vectors)
    got = integrity.nearest(vectors.filter("vec_id % 10 = 0"), vectors, 5, block=7).toPandas()
    for q in range(0, 300, 10):
        i = int(np.flatnonzero(p["vec_id"] == q)[0])
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        want = p["vec_id"].to_numpy()[np.lexsort((p["vec_id"], d))[:5]]
        assert list(got[got["query_id"] == q].sort_values("rank")["id"]) == list(want)
    agreement = integrity.label_agreement(integrity.nearest(vectors.limit(50), vectors, 5))
    assert agreement.count() == 50 and agreement.filter("flipped").count() < 5
    assert integrity.nearest(vectors.limit(0), vectors, 5).isEmpty()


def test_near_duplicate_hashes_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63, 60, dtype=np.int64)
    near = [int(np.int64(b) ^ np.int64(sum(1 << int(k) for k in rng.choice(63, rng.integers(1, 5), replace=False)))) for b in base for _ in range(3)]
    all_ = sorted({*map(int, base), *near})
    want = {(a, b) for a in all_ for b in all_ if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    df = spark.createDataFrame([(i, h) for i, h in enumerate(all_ + all_[:9])], "id long, hash long")
    rows = integrity.near_duplicates(df).collect()
    assert len(rows) == len(want) and {(r["hash_a"], r["hash_b"]) for r in rows} == want


def test_cosine_and_binomial(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0, 0.0], None), ([0.0, 0.0], [1.0, 1.0])], "e_ref array<double>, e_sub array<double>")
    assert [r["divergence"] for r in integrity.encoder_divergence(df).collect()] == [0.0, 1.0, None, None]
    flags = spark.createDataFrame([("a", 1)] * 8 + [("a", 0)] * 2 + [("b", 0)] * 40, "source string, bad int")
    z = {r["contributor"]: r["z"] for r in integrity.contributor_binomial(flags).collect()}
    assert z["a"] > 3 and z["b"] < 0


def test_sybils(spark):
    rows = [("a", i) for i in range(100)] + [("b", i) for i in range(95)] + [("c", i) for i in range(500, 600)]
    pairs = integrity.sybil_pairs(spark.createDataFrame(rows, "who string, item long"), "who", F.col("item")).collect()
    assert [(r["a"], r["b"]) for r in pairs] == [("a", "b")] and pairs[0]["similarity"] > 0.8


def test_two_samples(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, 400).round(1), rng.normal(0.5, 1, 300).round(1)
    df = spark.createDataFrame([(float(x), True) for x in a] + [(float(x), False) for x in b] + [(None, True)], "x double, s boolean")
    grid = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    row = shift.ks_statistic(df, "x", F.col("s")).first()
    assert (row["n_a"], row["n_b"]) == (400, 300) and row["ks"] == pytest.approx(want)
    assert shift.ks_p_value(row["ks"], 400, 300) < 0.001 and shift.ks_p_value(0.0, 5, 5) == 1.0
    k = lambda x, y: ((x[:, None] * y[None] + 1) ** 2).mean()
    assert shift.mmd_quadratic(df, "x", F.col("s")).first()["mmd2"] == pytest.approx(k(a, a) + k(b, b) - 2 * k(a, b))
    v = df.filter("x is not null").select(F.array("x").alias("v"), "s")
    assert shift.mmd_gaussian(v, "v", "s", 0.5) > 5 * shift.mmd_gaussian(v.withColumn("s", F.rand(1) < 0.5), "v", "s", 0.5)
    assert np.isnan(shift.mmd_gaussian(v.limit(0), "v", "s", 0.5))
    assert shift.families(["blur_1", "label", "zzz"]) == {"physical": ["blur_1"], "semantic": ["label"], "other": ["zzz"]}


def test_fusion(spark, tmp_path):
    s = spark.createDataFrame([(1, 0.1, None), (2, 0.9, 0.8), (3, None, None), (4, 0.25, 0.25)], "id long, a double, b double")
    got = {r["id"]: (r["risk"], r["decision"]) for r in fusion.fuse(s, "id", {"a": 0.5, "b": 0.5}).collect()}
    assert got[1] == (0.1, "ACCEPT") and got[2][1] == "QUARANTINE" and got[3] == (None, "REVIEW") and got[4][1] == "REVIEW"
    (tmp_path / "p.yaml").write_text("thresholds: {accept: 0.1, review: 0.2, quarantine: 0.3}\n")
    assert fusion.load_policy(str(tmp_path / "p.yaml"))["quarantine"] == 0.3
    w = {r["detector"]: r["weight"] for r in fusion.correlation_weights(spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, 2.0, 1.0), (3.0, 3.0, 4.0)], "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert sum(w.values()) == pytest.approx(1) and w["c"] > w["a"] == pytest.approx(w["b"])
    edges = spark.createDataFrame([("x", "k", "y"), ("y", "k", "z"), ("z", "k", "w")], "source string, kind string, target string")
    hops = fusion.neighbours(edges, spark.createDataFrame([("x",)], "node string"), 2)
    assert {r["node"]: r["hop"] for r in hops.collect()} == {"x": 0, "y": 1, "z": 2}


def test_model_integrity(spark):
    v = spark.createDataFrame([("a", float(x)) for x in (10, 11, 12, 10.5, 11.5, 2)], "k string, v double")
    assert [r["v"] for r in model_integrity.mad_outliers(v, "k", "v").filter("outlier").collect()] == [2.0]
    now = spark.createDataFrame([("l1", 1.0), ("l2", 2.0), ("l3", 1.0)], "layer string, norm double")
    ref = spark.createDataFrame([("l1", 1.01), ("l2", 1.0), ("l4", 1.0)], "layer string, norm double")
    assert sorted(r["layer"] for r in model_integrity.statistics_drift(now, ref).collect()) == ["l2", "l3", "l4"]
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], "item_id long, probabilities array<double>")
    assert {r["item_id"]: r["trojaned"] for r in model_integrity.strip_entropy(p, limit=0.1).collect()} == {1: True, 2: False}


def test_attack_and_detect(vectors):
    rows = attacks.all_attacks(vectors, classes=3)
    hit = {r["attack"]: r["n"] for r in rows.filter("attacked").groupBy("attack").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(hit) == {"label_flip", "near_duplicate", "ood", "backdoor"} and all(1 <= n <= 40 for n in hit.values())
    flipped = attacks.flip_labels(vectors, "vec_id", "label", 3, 0.2).join(vectors.select("vec_id", F.col("label").alias("old")), "vec_id")
    assert flipped.filter("attacked and label = old or not attacked and label <> old").isEmpty()
    ood = integrity.mahalanobis(attacks.out_of_distribution(vectors, "vec_id", "embedding", 0.1).withColumn("label", F.col("attacked").cast("int")), integrity.class_moments(vectors))
    q = attacks.detection_quality(ood.select(F.lit("ood").alias("attack"), F.col("distance").alias("score"), (F.col("label") == 1).alias("truth")), threshold=8.0).first()
    assert q["auroc"] > 0.9 and q["fpr"] < 0.1


def test_auroc_ties(vectors):
    spark = vectors.sparkSession
    df = spark.createDataFrame([("a", 0.5, True), ("a", 0.5, False), ("a", 0.9, True), ("a", 0.1, False)], "attack string, score double, truth boolean")
    r = attacks.detection_quality(df).first()
    assert (r["tpr"], r["fpr"], r["auroc"]) == (1.0, 0.5, 0.875)


def test_encoder(spark, tmp_path):
    from test_ingest import png

    png(tmp_path / "im" / "a.png", 20, 10)
    rng = np.random.default_rng(3)
    w, b = rng.normal(size=(3, encoder.DIM)).astype(np.float32), rng.normal(size=encoder.DIM).astype(np.float32)
    path = tmp_path / "stub.bin"
    path.write_bytes(b"MAGIC".ljust(encoder.HEADER, b"\0") + w.tobytes() + b.tobytes())
    import hashlib

    data = encoder.verified(str(path), hashlib.sha256(path.read_bytes()).hexdigest())
    with pytest.raises(IntegrityError):
        encoder.verified(str(path), "0" * 64)
    with pytest.raises(IntegrityError):
        encoder.load_encoder(b"junk", b"MAGIC")
    images = encoder.read_images(spark, str(tmp_path / "im"))
    row = encoder.features(images, data, data, "T0", b"MAGIC").first()
    black = ((0 - encoder.MEAN) / encoder.STD).reshape(3) @ w + b
    assert row["e_sub"] is None and np.allclose(row["e_ref"], black, atol=1e-3)
    assert encoder.features(images, data, data, "T1", b"MAGIC").first()["e_sub"] == row["e_ref"]
    out = encoder.infer(images, data, {"image_size": [8, 8]}, b"MAGIC").first()["output_bytes"]
    assert np.allclose(np.frombuffer(out, np.float32), b, atol=1e-5)
    flat = np.full((6, 9, 3), 7, np.uint8)
    assert np.allclose(encoder.resize(flat, 4, 4), 7) and encoder.preprocess(flat).shape == (1, 3, 224, 224)


def test_stream_equals_batch(spark, tmp_path):
    def batch(name, rows):
        spark.createDataFrame(rows, "ledger string, pos long, seq long, prev string, hash string").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    g = "0" * 64
    batch("b0", [("x", 0, 1, g, "h1"), ("x", 1, 2, "h1", "h2"), ("y", 0, 1, g, "k1")])
    stream = spark.readStream.schema("ledger string, pos long, seq long, prev string, hash string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def run():
        q = (
            chain.verify_stream(stream).writeStream.foreachBatch(lambda b, i: chain.append_once(b, i, str(tmp_path / "out")))
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        q.awaitTermination()
        return sorted((r["ledger"], r["pos"], r["finding"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == []
    batch("b1", [("x", 3, 3, "h3", "h4"), ("x", 2, 3, "bad", "h3"), ("y", 1, 2, "k1", "k2")])
    assert run() == [("x", 2, "CHAIN-BREAK"), ("x", 3, "SEQ-BREAK")]


def test_trigger_effects(spark):
    rows = [(t, "car", "bus" if t == 3 or k < t % 4 else "car") for t in range(9) for k in range(20)]
    got = model_integrity.trigger_effects(spark.createDataFrame(rows, "trigger_id long, clean_class string, triggered_class string")).filter("suspect").collect()
    assert [(r["trigger_id"], r["target"], r["hits"]) for r in got] == [(3, "bus", 20)]


def test_module_entry_points(vectors):
    from test_gate_probe import assets

    from veriframe.plans import modules

    found = modules.run_data_integrity(assets(vectors.sparkSession, 3), vectors)
    assert {k: v.count() for k, v in found.items()}["exact_duplicates"] == 1 and found["ood"].count() == 300
    x = vectors.select("vec_id", F.get("embedding", 0).alias("blur"), F.get("embedding", 1).alias("b"), (F.col("vec_id") < 150).alias("ref"))
    assert {r["feature"]: r["family"] for r in modules.run_shift(x, ["blur", "b"], "ref").collect()} == {"blur": "physical", "b": "other"}
    assert modules.run_fusion(x, "vec_id", ["blur", "b"]).count() == 300
    assert modules.generate_all_attacks(vectors).count() > 1200

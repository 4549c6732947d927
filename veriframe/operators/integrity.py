"""Data-integrity detectors over assets, labels and embeddings.

Class statistics (counts, sums, outer products) are partial aggregates of fixed size per class; searches run a stated query
set against all rows in blocks and merge top-k lists; near-duplicate hashes meet on bands that must agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, release
from .components import components

QUERY_BLOCK = 2048


def exact_duplicates(assets: DataFrame, id_col: str, content: Column) -> DataFrame:
    """(digest, copies, first_id, last_id) of contents that several rows share."""
    return assets.groupBy(F.md5(content).alias("digest")).agg(
        F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id")
    ).filter("copies > 1")


def sign_hash(vector: Column, bits: int = 64) -> Column:
    """Perceptual hash of an embedding: bit i is set where component i is positive."""
    places = F.sequence(F.lit(0), F.lit(bits - 1))
    return F.aggregate(
        places,
        F.lit(0).cast("long"),
        lambda acc, i: F.when(F.get(vector, i) > 0, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(acc),
    )


def near_duplicates(hashed: DataFrame, id_col: str = "id", hash_col: str = "hash", threshold: int = 3, agree: int = 3) -> DataFrame:
    """(hash_a, hash_b, distance) of the different hashes within `threshold` bits, and no pair twice.

    Of threshold + agree bands at least `agree` are equal, so pairs meet on the equal values of so many bands, and the first
    of those that agree report them. A key has 64 * agree / (threshold + agree) bits: more bands to agree on are more keys a
    hash, but fewer that meet by chance. Equal hashes are one row, however many ids have it. Sizes are estimated without
    the rows that an explode adds, so a merge join is asked for: a side that looks small enough may not fit to be broadcast.
    """
    n = threshold + agree
    edges = [64 * k // n for k in range(n + 1)]
    band = lambda h, k: F.shiftrightunsigned(h, edges[k]).bitwiseAND(F.lit((1 << edges[k + 1] - edges[k]) - 1).cast("long"))
    h = hashed.filter(F.col(hash_col).isNotNull()).select(F.col(hash_col).alias("h")).distinct().withColumn("b", F.array(*(band(F.col("h"), k) for k in range(n))))
    chosen = F.array(*(F.array(*map(F.lit, c)) for c in combinations(range(n), agree)))
    spread = h.select("h", F.posexplode(chosen).alias("c", "bands"), "b").select("h", "c", F.xxhash64(F.transform("bands", lambda k: F.get("b", k))).alias("v"))
    a, b = spread.select(F.col("h").alias("hash_a"), "c", "v"), spread.select(F.col("h").alias("hash_b"), "c", "v")
    differ = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    equal = F.filter(F.array(*(F.when(band(differ, k) == 0, F.lit(k)) for k in range(n))), lambda k: k.isNotNull())
    first = F.slice(equal, 1, agree) == F.get(chosen, F.col("c"))  # also false where the bands' hashes met by chance
    distance = F.bit_count(differ)
    pairs = a.hint("merge").join(b, ["c", "v"]).filter((F.col("hash_a") < F.col("hash_b")) & (distance <= threshold))
    return pairs.filter(first).select("hash_a", "hash_b", distance.alias("distance"))


def nearest(
    queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    block: int = QUERY_BLOCK
) -> DataFrame:
    """(query_id, query_label, id, label, distance2, rank): exact k nearest rows by squared distance, ties by id, itself left out.

    Queries go out in blocks of at most `block` rows; each task keeps k candidates a query, and those are merged.
    """
    wanted = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label")).filter("v is not null")
    src = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label")).filter("v is not null")
    found, part = [], []

    def search(own: list) -> DataFrame:
        send = rows.sparkSession.sparkContext.broadcast(([r["id"] for r in own], [r["label"] for r in own], np.array([r["v"] for r in own], np.float64)))

        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, labels, q = send.value
            best: list = [[] for _ in ids]
            for f in frames:
                x = np.stack(f["v"].to_list()).astype(np.float64)
                xi, xl = f["id"].to_numpy(), f["label"].to_numpy()
                for j, v in enumerate(q):
                    d = ((x - v) ** 2).sum(axis=1)
                    ok = np.flatnonzero(xi != ids[j])
                    near = ok[np.lexsort((xi[ok], d[ok]))[:k]]
                    best[j] = sorted([*best[j], *((d[i], xi[i], xl[i]) for i in near)], key=lambda t: t[:2])[:k]
            out = [(ids[j], labels[j], i, lab, d) for j, top in enumerate(best) for d, i, lab in top]
            yield pd.DataFrame(out, columns=["query_id", "query_label", "id", "label", "distance2"])

        return src.mapInPandas(run, "query_id long, query_label int, id long, label int, distance2 double")

    for r in wanted.toLocalIterator():
        part.append(r)
        if len(part) == block:
            found.append(search(part))
            part = []
    if part or not found:
        found.append(search(part) if part else src.sparkSession.createDataFrame([], "query_id long, query_label int, id long, label int, distance2 double"))
    every = reduce(DataFrame.unionByName, found)
    item = F.struct("distance2", "id", "label")
    top = every.groupBy("query_id", "query_label").agg(F.slice(F.array_sort(F.collect_list(item)), 1, k).alias("top"))  # k a task and query
    return top.select("query_id", "query_label", F.posexplode("top").alias("rank", "n")).select(
        "query_id", "query_label", "n.id", "n.label", "n.distance2", (F.col("rank") + 1).alias("rank")
    )


def label_agreement(neighbours: DataFrame, flag_below: float = 0.5) -> DataFrame:
    """(query_id, query_label, agreement, majority_label, flipped): the share of neighbours of the row's own label."""
    votes = neighbours.groupBy("query_id", "query_label", "label").count()
    same = F.sum(F.when(F.col("label") == F.col("query_label"), F.col("count")).otherwise(0))
    best = F.max(F.struct("count", (-F.col("label")).alias("low")))
    agg = votes.groupBy("query_id", "query_label").agg((same / F.sum("count")).alias("agreement"), best.alias("best"))
    return agg.select("query_id", "query_label", "agreement", (-F.col("best.low")).alias("majority_label"), (F.col("agreement") < flag_below).alias("flipped"))


def confusion(neighbours: DataFrame) -> DataFrame:
    """(label, nn_label, n) by the nearest neighbour."""
    return neighbours.filter("rank = 1").groupBy(F.col("query_label").alias("label"), F.col("label").alias("nn_label")).agg(F.count(F.lit(1)).alias("n"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix, without an object for each."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(flat) // max(len(vectors), 1)
    if width * len(vectors) != len(flat) or not (vectors.value_lengths().to_numpy() == width).all():
        raise ValueError("vectors differ in length")
    return flat.reshape(len(vectors), width)


def class_moments(rows: DataFrame, vector_col: str = "embedding", label_col: str = "label") -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """{label: (count, mean, covariance)}: each task adds up sums and outer products, of fixed size a class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict = {}
        for batch in batches:
            if not len(batch):
                continue
            x, labels = _matrix(batch.column("v")), batch.column("label").to_numpy(zero_copy_only=False)
            for label in np.unique(labels).tolist():
                own = x[labels == label]
                n, s, o = acc.get(label, (0, 0.0, 0.0))
                acc[label] = n + len(own), s + own.sum(axis=0), o + own.T @ own
        rows = [{"label": k, "n": n, "s": s.tolist(), "o": o.ravel().tolist()} for k, (n, s, o) in acc.items()]
        doubles = pa.list_(pa.float64())
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("label", pa.int32()), ("n", pa.int64()), ("s", doubles), ("o", doubles)]))

    src = rows.select(F.col(vector_col).alias("v"), F.col(label_col).alias("label")).filter("v is not null and label is not null")
    parts = src.mapInArrow(run, "label int, n long, s array<double>, o array<double>")
    out: dict = {}
    for r in parts.toLocalIterator():  # a row for each task and class
        n, s, o = out.get(r["label"], (0, 0.0, 0.0))
        out[r["label"]] = n + r["n"], s + np.array(r["s"]), o + np.array(r["o"])
    moments = {}
    for label, (n, s, o) in sorted(out.items()):
        mean = s / n
        moments[label] = n, mean, o.reshape(len(mean), -1) / n - np.outer(mean, mean)
    return moments


def _score(rows: DataFrame, fn, name: str, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    @F.arrow_udf("double")
    def score(v: pa.Array, label: pa.Array) -> pa.Array:
        known = v.is_valid().to_numpy(zero_copy_only=False)
        out = np.full(len(v), np.nan)
        if known.any():  # a batch at a time: fn takes a matrix and its rows' labels
            out[known] = fn(_matrix(v.drop_null()), label.to_numpy(zero_copy_only=False)[known])
        return pa.array(out)

    return rows.select(id_col, label_col, score(vector_col, label_col).alias(name))


def mahalanobis(
    rows: DataFrame, moments: dict, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", ridge: float = 1e-3
) -> DataFrame:
    """Distance of each row to the nearest class mean under the shared covariance (Lee et al. 2018)."""
    total = sum(n for n, *_ in moments.values())
    shared = sum(n * c for n, _, c in moments.values()) / total
    white = np.linalg.cholesky(np.linalg.inv(shared + ridge * np.eye(len(shared))))
    means = np.stack([m for _, m, _ in moments.values()]) @ white

    def fn(x: np.ndarray, _) -> np.ndarray:
        x = x @ white
        return np.sqrt(np.min([((x - m) ** 2).sum(axis=1) for m in means], axis=0))

    return _score(rows, fn, "distance", id_col, vector_col, label_col)


def _projected(tops: dict[int, tuple[np.ndarray, np.ndarray]]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Projections of rows, centred by their class's mean, on its direction; nan for classes without one."""

    def fn(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        for k in set(y.tolist()) & tops.keys():
            out[y == k] = (x[y == k] - tops[k][0]) @ tops[k][1]
        return out

    return fn


def _top_direction(cov: np.ndarray) -> np.ndarray:
    v = np.linalg.eigh(cov)[1][:, -1]
    return v * np.sign(v[np.abs(v).argmax()])


def spectral_signatures(rows: DataFrame, moments: dict, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Squared projection of each centred row on its class's top direction (Tran et al. 2018)."""
    tops = {k: (m, _top_direction(c)) for k, (_, m, c) in moments.items()}
    along = _projected(tops)
    return _score(rows, lambda x, y: along(x, y) ** 2, "score", id_col, vector_col, label_col)


def activation_clusters(
    rows: DataFrame, moments: dict, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = 12
) -> DataFrame:
    """(label, n, minority_share, separation): two means along each class's top direction (after Chen et al. 2018).

    All classes move in one aggregate a round. A small minority far from the rest points at poisoning.
    """
    tops = {k: (m, _top_direction(c), float(np.sqrt(np.linalg.eigvalsh(c)[-1]))) for k, (_, m, c) in moments.items()}
    fn = _projected({k: top[:2] for k, top in tops.items()})
    scored = _score(rows, fn, "p", id_col, vector_col, label_col).select(F.col(label_col).alias("label"), "p").filter("not isnan(p)")
    line = materialize(scored, "projections")
    centres = {k: (-s, s) for k, (_, _, s) in tops.items()}
    for _ in range(rounds):
        cut = F.create_map(*(F.lit(x) for k, (a, b) in centres.items() for x in (k, (a + b) / 2)))
        got = line.groupBy(
            "label", (F.col("p") > F.element_at(cut, F.col("label"))).alias("high")
        ).agg(F.avg("p").alias("m"), F.count(F.lit(1)).alias("n")).collect()
        new = {k: [a, b] for k, (a, b) in centres.items()}
        for r in got:
            new[r["label"]][r["high"]] = r["m"]
        if all(np.allclose(new[k], centres[k]) for k in centres):
            break
        centres = {k: tuple(v) for k, v in new.items()}
    sizes: dict = {}
    for r in got:
        sizes.setdefault(r["label"], [0, 0])[r["high"]] = r["n"]
    release(rows.sparkSession, line)
    out = [(k, sum(n), min(n) / sum(n), (centres[k][1] - centres[k][0]) / (tops[k][2] or 1.0)) for k, n in sorted(sizes.items())]
    return rows.sparkSession.createDataFrame(out, "label int, n long, minority_share double, separation double")


def annotation_anomalies(assets: DataFrame, z_limit: float = 4.0) -> DataFrame:
    """(asset_id, position, class_name, problem) of boxes without area, outside their image, over most of it, or of an area
    far from their class's (z-score of its logarithm)."""
    boxes = assets.select("asset_id", "image_metadata", F.posexplode("annotations").alias("position", "a")).select(
        "asset_id", "position", F.col("a.class_name").alias("class_name"), "image_metadata", *(F.get("a.bbox", i).alias(n) for i, n in enumerate("xywh"))
    )
    area = boxes.withColumn("log_area", F.when((F.col("w") > 0) & (F.col("h") > 0), F.ln(F.col("w") * F.col("h"))))
    stats = area.groupBy("class_name").agg(F.avg("log_area").alias("mean"), F.stddev_pop("log_area").alias("sd"))
    z = (F.col("log_area") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    w, h = F.col("image_metadata.width"), F.col("image_metadata.height")
    problem = (
        F.when(F.col("log_area").isNull(), "no_area")
        .when((F.col("x") + F.col("w") > w) | (F.col("y") + F.col("h") > h), "outside_image")
        .when(F.col("w") * F.col("h") > 0.98 * w * h, "whole_image")
        .when(F.abs(z) > z_limit, "odd_area")
    )
    known = materialize(stats, "class-areas")  # of a known size: classes are few as a rule, so boxes stay where they are
    return area.join(known, "class_name").select("asset_id", "position", "class_name", problem.alias("problem")).filter("problem is not null")


def contributor_binomial(flags: DataFrame, contributor: str = "source", flag: str = "bad") -> DataFrame:
    """(contributor, n, bad, rate, z): each contributor's flags against the overall rate, by the normal approximation."""
    per = flags.groupBy(contributor).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(flag).cast("long")).alias("bad"))
    total = per.agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))  # one row
    p = F.col("all_bad") / F.col("all_n")
    sd = F.sqrt(p * (1 - p) / F.col("n"))
    return per.crossJoin(F.broadcast(total)).select(
        F.col(contributor).alias("contributor"), "n", "bad", (F.col("bad") / F.col("n")).alias("rate"),
        ((F.col("bad") / F.col("n") - p) / F.nullif(sd, F.lit(0.0))).alias("z")
    )


def sybil_pairs(items: DataFrame, contributor: str, item: Column, least: float = 0.3, hashes: int = 64) -> DataFrame:
    """(a, b, similarity) of contributors whose sets of items are alike, by MinHash signatures of a fixed size each.

    Only signatures, one row for each contributor and hash, are joined; equal minima are the shared ones.
    """
    keyed = items.select(F.col(contributor).alias("who"), item.alias("item")).filter("who is not null and item is not null")
    salted = lambda k: F.md5(F.concat(F.lit(f"{k}:"), F.col("item").cast("string")))
    mins = keyed.groupBy("who").agg(*(F.min(salted(k)).alias(f"m{k}") for k in range(hashes)))
    rows = mins.select("who", F.posexplode(F.array(*(f"m{k}" for k in range(hashes)))).alias("k", "m"))
    a, b = rows.withColumnRenamed("who", "a"), rows.withColumnRenamed("who", "b")
    same = a.hint("merge").join(b, ["k", "m"]).filter("a < b").groupBy("a", "b").agg((F.count(F.lit(1)) / hashes).alias("similarity"))
    return same.filter(F.col("similarity") >= least)


def sybil_clusters(pairs: DataFrame) -> DataFrame:
    """(contributor, cluster) for the contributors of pairs (a, b): whom they reach by pairs, named by the least of them."""
    linked = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return linked.select(F.col("node").alias("contributor"), F.col("root").alias("cluster"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def encoder_divergence(features: DataFrame) -> DataFrame:
    """features(path, e_ref, e_sub) with divergence = 1 - cosine; null where a vector is missing or zero."""
    return features.withColumn("divergence", 1 - cosine(F.col("e_ref"), F.col("e_sub")))

"""Distribution shift: two-sample tests, per-sample distances, feature families and the question of drift or manipulation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import in_ranges
from .integrity import class_moments, mahalanobis

FAMILIES = {
    "physical": ("brightness", "contrast", "blur", "noise"), "acquisition": ("width", "height", "channels", "compression"),
    "semantic": ("label", "objects", "embedding")
}


def ks_statistic(samples: DataFrame, value: str, side: Column) -> DataFrame:
    """(n_a, n_b, ks): the two-sample Kolmogorov-Smirnov statistic; side is true for sample a. Nulls are left out.

    Equal values are one row, with counts, before anything is ordered. Cumulative counts are made within ranges of values
    and put on the ranges' totals, so no task holds all values.
    """
    counted = samples.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    ranged = in_ranges(counted, "x", "part")
    inner = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    local = ranged.withColumns({"ca": F.sum("a").over(inner), "cb": F.sum("b").over(inner)})
    totals = ranged.groupBy("part").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    starts = totals.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("ta", "sa"), ("tb", "sb"))))
    sums = totals.agg(F.sum("ta").alias("n_a"), F.sum("tb").alias("n_b"))
    gap = F.abs((F.col("ca") + F.col("sa")) / F.col("n_a") - (F.col("cb") + F.col("sb")) / F.col("n_b"))
    placed = local.join(starts, "part").crossJoin(F.broadcast(sums))
    return placed.groupBy("n_a", "n_b").agg(F.max(gap).alias("ks"))


def ks_p_value(ks: float, n_a: int, n_b: int) -> float:
    """Asymptotic p-value."""
    x = ks * np.sqrt(n_a * n_b / (n_a + n_b))
    k = np.arange(1, 101)
    return float(np.clip(2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k * k * x * x)), 0, 1)) if x > 0 else 1.0


def mmd_quadratic(samples: DataFrame, value: str, side: Column) -> DataFrame:
    """(n_a, n_b, mmd2): squared maximum mean discrepancy of the kernel (xy + 1)^2, exact from means of x and x^2."""
    v = F.col(value).cast("double")
    mean = lambda x, s: F.avg(F.when(s, x))
    known = samples.filter(v.isNotNull())
    d1, d2 = mean(v, side) - mean(v, ~side), mean(v * v, side) - mean(v * v, ~side)
    return known.agg(F.count_if(side).alias("n_a"), F.count_if(~side).alias("n_b"), (2 * d1 * d1 + d2 * d2).alias("mmd2"))


def mmd_gaussian(samples: DataFrame, vector: str, side: str, gamma: float, features: int = 512, seed: int = 0) -> float:
    """Squared MMD of a Gaussian kernel by random Fourier features: one pass, and a sum of fixed size from each task."""
    first = samples.filter(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
    if first is None:
        return float("nan")
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (first["n"], features)), rng.uniform(0, 2 * np.pi, features)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = {True: (0, np.zeros(features)), False: (0, np.zeros(features))}
        for f in frames:
            for s, g in f.groupby("s"):
                z = np.cos(np.stack(g["v"].to_list()).astype(np.float64) @ w + b)
                n, t = acc[bool(s)]
                acc[bool(s)] = n + len(z), t + z.sum(axis=0)
        yield pd.DataFrame([(k, n, t.tolist()) for k, (n, t) in acc.items()], columns=["s", "n", "t"])

    src = samples.select(F.col(vector).alias("v"), F.col(side).cast("boolean").alias("s")).filter("v is not null and s is not null")
    total = {True: [0, 0.0], False: [0, 0.0]}
    for r in src.mapInPandas(run, "s boolean, n long, t array<double>").toLocalIterator():
        total[r["s"]][0] += r["n"]
        total[r["s"]][1] = total[r["s"]][1] + np.array(r["t"])
    if not total[True][0] or not total[False][0]:
        return float("nan")
    diff = total[True][1] / total[True][0] - total[False][1] / total[False][0]
    return float(2 * (diff @ diff) / features)


def mahalanobis_shift(reference: DataFrame, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Distance of each row to the reference's class means."""
    return mahalanobis(rows, class_moments(reference, vector_col, label_col), id_col, vector_col, label_col)


def families(columns: Iterable[str], known: dict[str, tuple[str, ...]] = FAMILIES) -> dict[str, list[str]]:
    """Columns by the family whose word they contain; the rest are `other`."""
    out: dict[str, list[str]] = {}
    for c in columns:
        name = next((f for f, words in known.items() if any(w in c.lower() for w in words)), "other")
        out.setdefault(name, []).append(c)
    return out


def drift_or_manipulation(tests: DataFrame, alpha: float = 0.01) -> DataFrame:
    """(verdict, shifted_families, shifted): over tests (family, feature, p_value, contributors_hit, contributors).

    Drift moves physical and acquisition features of most contributors; a shift of semantic features alone, or one that few
    contributors carry, looks like manipulation.
    """
    hit = F.col("p_value") < alpha
    spread = F.max(F.when(hit, F.col("contributors_hit") / F.col("contributors")))
    agg = tests.agg(
        F.count_if(hit).alias("shifted"), F.sort_array(F.collect_set(F.when(hit, F.col("family")))).alias("shifted_families"), spread.alias("spread"),
        F.coalesce(F.bool_and(F.when(hit, F.col("family") == "semantic")), F.lit(False)).alias("only_semantic"),
    )
    verdict = F.when(F.col("shifted") == 0, "NO_SHIFT").when(F.col("only_semantic") | (F.col("spread") < 0.5), "MANIPULATION").otherwise("DRIFT")
    return agg.select(verdict.alias("verdict"), "shifted_families", "shifted")

"""Risk fusion: policy decisions, correlation-aware weights, evidence graph and tiered scanning."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICY = {"accept": 0.25, "review": 0.60, "quarantine": 0.85}


def load_policy(path: str) -> dict[str, float]:
    with open(path, encoding="utf-8") as f:
        return {k: float(v) for k, v in yaml.safe_load(f)["thresholds"].items()}


def decide(score: Column, policy: dict[str, float] = POLICY) -> Column:
    """ACCEPT below `accept`, QUARANTINE from `quarantine` on, REVIEW between, also where there is no score.

    `review` marks the middle of that band: from it on the decision is still REVIEW, at a higher priority (see priority).
    """
    return F.when(score < policy["accept"], "ACCEPT").when(score >= policy["quarantine"], "QUARANTINE").otherwise("REVIEW")


def priority(score: Column, policy: dict[str, float] = POLICY) -> Column:
    return F.when(score >= policy["quarantine"], 2).when(score >= policy["review"], 1).otherwise(0)


def correlations(scores: DataFrame, detectors: list[str]) -> DataFrame:
    """(a, b, r) of detectors' score columns, in one aggregate."""
    pairs = list(combinations(detectors, 2))
    row = scores.agg(*(F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)))
    listed = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("r")) for i, (a, b) in enumerate(pairs)))
    return row.select(F.inline(listed))


def correlation_weights(scores: DataFrame, detectors: list[str]) -> DataFrame:
    """(detector, weight): 1 / (1 + the sum of the others' absolute correlations), scaled to a sum of 1."""
    c = correlations(scores, detectors)
    both = c.select(F.col("a").alias("detector"), "r").unionByName(c.select(F.col("b").alias("detector"), "r"))
    raw = both.groupBy("detector").agg((1 / (1 + F.sum(F.abs(F.coalesce("r", F.lit(0.0)))))).alias("raw"))
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("raw").alias("total")))).select("detector", (F.col("raw") / F.col("total")).alias("weight"))


def fuse(scores: DataFrame, id_col: str, weights: dict[str, float], policy: dict[str, float] = POLICY) -> DataFrame:
    """(id, risk, decision): weighted mean over the detectors that gave a score."""
    num = sum(F.coalesce(F.col(d) * w, F.lit(0.0)) for d, w in weights.items())
    den = sum(F.when(F.col(d).isNotNull(), F.lit(w)).otherwise(0.0) for d, w in weights.items())
    risk = num / F.nullif(den, F.lit(0.0))
    return scores.select(id_col, risk.alias("risk"), decide(risk, policy).alias("decision"))


def evidence_edges(findings: DataFrame) -> DataFrame:
    """(source, kind, target) edges: findings to assets, assets to contributors, findings to detectors and artifacts."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    f = node("finding", F.col("finding_id"))
    edge = lambda a, kind, b: F.struct(a.alias("source"), F.lit(kind).alias("kind"), b.alias("target"))
    asset = node("asset", F.col("asset_ref"))
    fixed = [
        edge(f, "about", asset), edge(asset, "contributed_by", node("contributor", F.col("contributor_ref"))),
        edge(f, "raised_by", node("detector", F.col("detector")))
    ]
    files = F.transform("evidence_artifacts", lambda x: edge(f, "evidenced_by", node("artifact", x)))
    return findings.select(F.inline(F.concat(
        F.array(*fixed), F.coalesce(files, F.array().cast("array<struct<source:string,kind:string,target:string>>"))
    ))).distinct()


def neighbours(edges: DataFrame, starts: DataFrame, hops: int = 2) -> DataFrame:
    """(node, hop): nodes within so many hops of starts(node), either way along edges, with the least hop."""
    both = edges.select(
        F.col("source").alias("node"), F.col("target").alias("next")
    ).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("next"))).distinct()
    seen = starts.select("node", F.lit(0).alias("hop")).distinct()
    edge = seen
    for h in range(1, hops + 1):
        edge = edge.join(both, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").select("node", F.lit(h).alias("hop"))
        seen = seen.unionByName(edge)
    return seen


def tiered_scan(rows: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame], float]], score_col: str = "score") -> DataFrame:
    """Run stages (name, function adding score_col, threshold) in order; only rows at or over a stage's threshold reach the next.

    Rows come back with `stage`, the last that saw them, and their score there. Cheap filters stand before costly functions
    in the plan because a later stage's input is the earlier one's filtered output.
    """
    done, left = [], rows
    for k, (name, fn, threshold) in enumerate(stages):
        scored = fn(left).withColumn("stage", F.lit(name))
        last = k == len(stages) - 1
        done.append(scored if last else scored.filter(F.coalesce(F.col(score_col) < threshold, F.lit(True))))
        left = scored.filter(F.col(score_col) >= threshold).drop("stage", score_col)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out

"""Model-integrity checks over tables of weights, probe answers, trigger norms and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest_check(models: DataFrame, attested: DataFrame, key: str = "model_id", digest: str = "digest") -> DataFrame:
    """(key, digest, expected, status): MATCH, SUBSTITUTED or UNATTESTED, whatever the digits' case."""
    want = attested.select(key, F.col(digest).alias("expected"))
    joined = models.select(key, digest).join(want, key, "left")
    status = F.when(F.col("expected").isNull(), "UNATTESTED").when(F.lower(digest) == F.lower("expected"), "MATCH").otherwise("SUBSTITUTED")
    return joined.withColumn("status", F.coalesce(status, F.lit("SUBSTITUTED")))


def weight_statistics(weights: DataFrame, layer: str = "layer", value: str = "value") -> DataFrame:
    """(layer, n, norm, mean, kurtosis) of weights in long form; excess kurtosis, null for constant layers."""
    v = F.col(value).cast("double")
    return weights.groupBy(layer).agg(F.count(value).alias("n"), F.sqrt(F.sum(v * v)).alias("norm"), F.avg(v).alias("mean"), F.kurtosis(v).alias("kurtosis"))


def statistics_drift(now: DataFrame, reference: DataFrame, layer: str = "layer", tolerance: float = 0.1) -> DataFrame:
    """Layers whose norm is off its reference by more than the tolerance, or that only one side has."""
    a = now.select(layer, F.col("norm").alias("norm_now"))
    b = reference.select(layer, F.col("norm").alias("norm_ref"))
    change = F.abs(F.col("norm_now") - F.col("norm_ref")) / F.nullif(F.col("norm_ref"), F.lit(0.0))
    return a.join(b, layer, "full").withColumn("change", change).filter(F.col("change").isNull() | (F.col("change") > tolerance))


def behavioural_fingerprint(answers: DataFrame, stored: DataFrame, model: str = "model_id", probe: str = "probe_id", answer: str = "answer") -> DataFrame:
    """(model, probes, agreement): the share of stored probes that a model answers as stored; unanswered ones count against it."""
    ref = stored.select(probe, F.col(answer).alias("want"))
    pairs = answers.select(model).distinct().crossJoin(F.broadcast(ref))  # models x the battery, which is small by design
    got = pairs.join(answers.select(model, probe, F.col(answer).alias("got")), [model, probe], "left")
    return got.groupBy(model).agg(
        F.count(F.lit(1)).alias("probes"), F.avg(F.coalesce(F.col("got") == F.col("want"), F.lit(False)).cast("double")).alias("agreement")
    )


def mad_outliers(values: DataFrame, key: str, value: str, limit: float = 2.0) -> DataFrame:
    """(key, value, anomaly_index, outlier): distance from the median in deviations, low ones being suspect (Wang et al. 2019)."""
    med = values.agg(F.median(value).alias("med"))
    off = values.crossJoin(F.broadcast(med)).withColumn("off", F.abs(F.col(value) - F.col("med")))
    mad = off.agg((F.median("off") * 1.4826).alias("mad"))
    index = F.col("off") / F.nullif(F.col("mad"), F.lit(0.0))
    return off.crossJoin(F.broadcast(mad)).select(key, value, index.alias("anomaly_index"), ((index > limit) & (F.col(value) < F.col("med"))).alias("outlier"))


def entropy(p: Column) -> Column:
    """Shannon entropy in nats of an array of probabilities."""
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def strip_entropy(predictions: DataFrame, item: str = "item_id", probabilities: str = "probabilities", limit: float | None = None) -> DataFrame:
    """(item, copies, entropy, trojaned): mean entropy over an input's perturbed copies; low ones are suspect (Gao et al. 2019).

    Without a limit, the first percentile of all inputs is taken.
    """
    per = predictions.groupBy(item).agg(F.count(F.lit(1)).alias("copies"), F.avg(entropy(F.col(probabilities))).alias("entropy"))
    if limit is None:
        cut = per.agg(F.percentile_approx("entropy", 0.01).alias("cut"))
        return per.crossJoin(F.broadcast(cut)).select(item, "copies", "entropy", (F.col("entropy") < F.col("cut")).alias("trojaned"))
    return per.withColumn("trojaned", F.col("entropy") < limit)


def trigger_effects(
    predictions: DataFrame, trigger: str = "trigger_id", clean: str = "clean_class", triggered: str = "triggered_class", limit: float = 2.0
) -> DataFrame:
    """(trigger, target, hits, success, anomaly_index, suspect): for boxes predicted with and without each candidate trigger, the
    share that it turns into one class; null classes are boxes that vanish or appear. Suspect are triggers whose best
    target succeeds far more often than the others' (our design; the planned search itself has no published behaviour)."""
    turned = predictions.withColumn("turned", ~F.col(clean).eqNullSafe(F.col(triggered)))
    per = turned.groupBy(trigger, F.col(triggered).alias("target")).agg(F.count_if("turned").alias("hits"))
    total = predictions.groupBy(trigger).agg(F.count(F.lit(1)).alias("n"))
    best = per.groupBy(trigger).agg(F.max(F.struct("hits", "target")).alias("b"))
    rate = best.join(total, trigger).select(
        trigger, F.col("b.target").alias("target"), F.col("b.hits").alias("hits"), (F.col("b.hits") / F.col("n")).alias("success")
    )
    index = mad_outliers(rate.withColumn("low", -F.col("success")), trigger, "low", limit).select(trigger, "anomaly_index", F.col("outlier").alias("suspect"))
    return rate.join(index, trigger)

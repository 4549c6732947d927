"""Queries of the engine over the driver's tables, and the SQL each must agree with.

Roles: `events` are receipts (a chain for each user), `documents` are assets (source is the contributor), `labels` audited
flags, `embeddings` encoder features, `lineitem` annotations, `orders` images, the rest plain relations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.canonical import canonical_payload
from ..functions.merkle import inclusion_proof, merkle_root, verify_proof
from ..operators import attacks, audit, fusion, gate, integrity, model_integrity, probe, report, shift, spot, writer
from ..schemas import TASKS, clean_digest, receipt_violations, tier_rank
from ..scratch import in_ranges
from ..sources.ledger import dense_positions
from . import ledgers
from .ledgers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_FOUND = ("ledger", "pos", "check_no", "sub_no", "finding_id", "detector", "score", "severity")


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _findings(columns: str, source: str) -> str:
    return ledgers.SQL + f"SELECT {columns} FROM {source}"


_COLS = ", ".join(_FOUND)


# Ledgers


@query("SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS leaf FROM events")
def leaf_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("leaf"))


@query(ledgers.SQL + "SELECT user_id, seq, prev, hash FROM chain")
def derived_chain(spark: SparkSession, d: str) -> DataFrame:
    return ledgers.honest(spark, d).select("user_id", "seq", "prev", "hash")


@query(ORACLES["derived_chain"])
def derived_chain_native(spark: SparkSession, d: str) -> DataFrame:
    """The fold inside the JVM, over every receipt of every chain."""
    return writer.chain_short(ledgers.numbered(spark, d), chain="user_id").select("user_id", "seq", "prev", "hash")


@query(ledgers.SQL + "SELECT ledger, checkpoint_id, start_sequence, end_sequence, receipt_count, merkle_root FROM chk")
def checkpoint_blocks(spark: SparkSession, d: str) -> DataFrame:
    return ledgers.checkpoints(spark, d).drop("pos")


@query("""
WITH RECURSIVE l AS (
  SELECT user_id AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, sha256(CAST(event_id AS VARCHAR)) AS h, count(*)
    OVER (PARTITION BY user_id) AS n FROM events),
r AS (
  SELECT b, i, h, n, n AS n0 FROM l
  UNION ALL
  SELECT x.b, x.i // 2, sha256(unhex(x.h) || unhex(coalesce(y.h, x.h))), (x.n + 1) // 2, x.n0 FROM r x LEFT JOIN r y ON x.b = y.b AND x.n = y.n
    AND y.i = x.i + 1 WHERE x.i % 2 = 0 AND x.n > 1)
SELECT b AS user_id, n0 AS n, h AS root FROM r WHERE n = 1
""")
def merkle_by_chain(spark: SparkSession, d: str) -> DataFrame:
    leaf = F.struct("event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("h"))
    groups = table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(leaf)), lambda x: x["h"]).alias("leaves")
    )
    return groups.select("user_id", "n", merkle_root(F.col("leaves")).alias("root"))


@query(ledgers.SQL + "SELECT ledger, checkpoint_id, receipt_count, TRUE AS all_valid, CAST(ceil(log2(receipt_count)) * receipt_count AS "
    "BIGINT) AS proof_steps FROM chk")
def inclusion_proofs(spark: SparkSession, d: str) -> DataFrame:
    """Proofs of all receipts of all checkpoints, verified against the roots."""
    chain = ledgers.honest(spark, d).select(F.col("user_id").cast("string").alias("ledger"), "seq", "hash")
    blocks = chain.groupBy("ledger", F.floor((F.col("seq") - 1) / ledgers.BLOCK).alias("block")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "hash"))), lambda x: x["hash"]
    ).alias("leaves"))
    each = blocks.select(
        "ledger", "block", merkle_root(F.col("leaves")).alias("root"), "leaves", F.posexplode("leaves").alias("i", "leaf")
    ).withColumn("proof", inclusion_proof(F.col("leaves"), F.col("i")))
    ok = each.groupBy("ledger", "block").agg(
        F.count(F.lit(1)).alias("receipt_count"), F.bool_and(verify_proof(F.col("leaf"), F.col("proof"), F.col("root"))).alias("all_valid"),
        F.sum(F.size("proof")).alias("proof_steps")
    )
    return ok.select("ledger", F.format_string("CHK-%04d", F.col("block") + 1).alias("checkpoint_id"), "receipt_count", "all_valid", "proof_steps")


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return audit.with_previous(ledgers.attacked(spark, d))


@query(_findings(_COLS, "k1"))
def chain_breaks(spark: SparkSession, d: str) -> DataFrame:
    return audit.chain_breaks(_linked(spark, d)).select(*_FOUND)


@query(_findings(_COLS, "k2"))
def payload_tampering(spark: SparkSession, d: str) -> DataFrame:
    return audit.tampered(ledgers.attacked(spark, d)).select(*_FOUND)


@query(_findings(_COLS, "k3"))
def sequence_breaks(spark: SparkSession, d: str) -> DataFrame:
    return audit.sequence_breaks(_linked(spark, d)).select(*_FOUND)


@query(_findings(_COLS + ", 'receipt_seq_' || seq || '.json,receipt_seq_' || first_seq || '.json' AS evidence", "k4"))
def replays(spark: SparkSession, d: str) -> DataFrame:
    return audit.replays(ledgers.attacked(spark, d)).select(*_FOUND, F.array_join("evidence_artifacts", ",").alias("evidence"))


@query(_findings(_COLS + ", model", "k6"))
def model_substitution(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.range(1).select(F.sha2(F.lit(ledgers.MODEL), 256)).first()[0]
    other = F.sha2(F.lit("other model"), 256).alias("model")
    return audit.substituted_models(ledgers.attacked(spark, d), expected).select(*_FOUND, other)


@query(_findings(_COLS, "k7"))
def merkle_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return audit.merkle_mismatches(ledgers.attacked(spark, d), ledgers.checkpoints(spark, d)).select(*_FOUND)


@query(_findings(_COLS, "k5"))
def signatures_unavailable(spark: SparkSession, d: str) -> DataFrame:
    return audit.bad_signatures(ledgers.attacked(spark, d), None).select(*_FOUND)


def _audit(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.range(1).select(F.sha2(F.lit(ledgers.MODEL), 256)).first()[0]
    return audit.audit(ledgers.attacked(spark, d), ledgers.checkpoints(spark, d), expected)


@query(_findings(_COLS, "found"))
def audit_findings(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d).select(*_FOUND)


@query(_findings(
    "CAST(count_if(severity = 'critical') AS BIGINT) AS critical, CAST(count_if(severity = 'high') AS BIGINT) AS high, CAST(count_if(severity = 'warning') AS BIGINT) AS warning, CAST(count_if(severity = 'info') AS BIGINT) AS info",
    "found"
))
def severity_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.severity_counts(_audit(spark, d))


@query(_findings(
    "ledger, CASE WHEN bool_or(severity IN ('critical', 'high')) THEN 'QUARANTINE' ELSE 'ACCEPT' END AS overall_disposition",
    "found GROUP BY ledger"
))
def dispositions(spark: SparkSession, d: str) -> DataFrame:
    return report.disposition(_audit(spark, d), ("ledger",))


@query(ledgers.SQL + "SELECT c.ledger, c.checkpoint_id, count(DISTINCT a.seq) AS present, c.receipt_count FROM chk c LEFT JOIN att a ON "
    "a.ledger = c.ledger AND a.seq BETWEEN c.start_sequence AND c.end_sequence GROUP BY ALL")
def checkpoint_range_join(spark: SparkSession, d: str) -> DataFrame:
    found = audit.checkpoint_leaves(ledgers.attacked(spark, d), ledgers.checkpoints(spark, d))
    return found.select("ledger", "checkpoint_id", F.coalesce(F.size("leaves"), F.lit(0)).cast("long").alias("present"), "receipt_count")


@query(ledgers.SQL + "SELECT 'FINDING-M3-EMPTY' AS finding_id, 'warning' AS severity, 'review' AS recommended_disposition")
def empty_ledger(spark: SparkSession, d: str) -> DataFrame:
    none = ledgers.attacked(spark, d).filter("ledger is null")
    return audit.audit(none).select("finding_id", "severity", "recommended_disposition")


@query("SELECT event_id, nonce_key, row_number() OVER w > 1 AS replayed, first_value(event_id) OVER w AS first_event FROM (SELECT event_id, "
    "md5(props) AS nonce_key FROM events) WINDOW w AS (PARTITION BY nonce_key ORDER BY event_id)")
def replay_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """First use of a nonce by an aggregate and a join; a nonce of any frequency costs partial aggregates."""
    rows = table(spark, d, "events").select("event_id", F.md5("props").alias("nonce_key"))
    first = rows.groupBy("nonce_key").agg(F.min("event_id").alias("first_event"))
    return rows.join(first, "nonce_key").select("event_id", "nonce_key", (F.col("event_id") > F.col("first_event")).alias("replayed"), "first_event")


@query("SELECT o_orderkey, o_custkey, last_key FROM (SELECT o_orderkey, o_custkey, lag(o_custkey, 1, 0) OVER (ORDER BY o_orderkey) AS "
    "last_key FROM orders) WHERE o_custkey <= last_key")
def sequence_by_position(spark: SparkSession, d: str) -> DataFrame:
    """W2 over one long ledger: positions are dense by ranges, the predecessor comes by an equi-join."""
    src = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    rows = dense_positions(in_ranges(src, "o_orderkey", "run").withColumn("one", F.lit(1)), "one", ("run", "o_orderkey"))
    before = rows.select((F.col("pos") + 1).alias("pos"), F.col("o_custkey").alias("last_key"))
    return rows.join(before, "pos", "left").withColumn("last_key", F.coalesce("last_key", F.lit(0))).filter("o_custkey <= last_key").select("o_orderkey", "o_custkey", "last_key")


@query("SELECT l_orderkey, l_linenumber, '{\"k\":' || l_orderkey || ',\"q\":' || l_linenumber || ',\"s\":\"' || l_returnflag || '\"}' AS payload FROM lineitem")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    line = F.concat(
        F.lit('{"record_type":"receipt", "payload": {"s": "'), "l_returnflag", F.lit('", "q":'), F.col("l_linenumber").cast("string"),
        F.lit(', "k": '), F.col("l_orderkey").cast("string"), F.lit("}}")
    )
    return t.select("l_orderkey", "l_linenumber", canonical_payload(line).alias("payload"))


@query("""
SELECT doc_id, sha256(coalesce(text, '')) AS input_image_sha256, sha256('{"height":8,"width":8}') AS preprocess_config_hash, sha256(source) AS
  model_weight_digest, sha256(lang) AS output_payload_sha256,
       'nonce-' || lpad(CAST(doc_id + 1 AS VARCHAR), CAST(greatest(4, length(CAST(doc_id + 1 AS VARCHAR))) AS INTEGER), '0') || '-' || substr(sha256(coalesce(text,
         '')), 1, 8) AS nonce, doc_id + 1 AS sequence_number, '' AS violations
FROM documents
""")
def receipt_build(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "documents").select(
        "doc_id", (F.col("doc_id") + 1).alias("sequence_number"), F.coalesce("text", F.lit("")).cast("binary").alias("input_bytes"), F.col("lang").cast("binary").alias("output_bytes"), F.col("source").cast("binary").alias("model_bytes"), F.lit(None).cast("string").alias("image_path")
    )
    built = writer.build_receipts(src, {"width": 8, "height": 8}, timestamp=F.lit("2024-01-01T00:00:00+00:00"))
    keys = ("input_image_sha256", "preprocess_config_hash", "model_weight_digest", "output_payload_sha256", "nonce", "sequence_number")
    return built.select("doc_id", *(F.col(f"payload.{k}").alias(k) for k in keys), F.array_join(receipt_violations(), ",").alias("violations"))


@query(ledgers.SQL + """
SELECT ledger, pos FROM (SELECT ledger, pos, row_number() OVER (ORDER BY md5('42|' || ledger || '|' || pos)) AS r, count(*) OVER () AS n FROM att)
WHERE r <= least(n, greatest(1, CAST(floor(n * 0.05) AS BIGINT)))
""")
def spot_sample(spark: SparkSession, d: str) -> DataFrame:
    return spot.sample_receipts(ledgers.attacked(spark, d), exact=False).select("ledger", "pos")


@query("SELECT 'SPOT-UNAVAILABLE' AS kind, 'info' AS severity, 'unavailable' AS recommended_disposition, least(count(*), greatest(1, "
    "CAST(floor(count(*) * 0.05) AS BIGINT))) AS n FROM events WHERE event_id % 101 <> 5")
def spot_unavailable(spark: SparkSession, d: str) -> DataFrame:
    sample = spot.sample_receipts(ledgers.attacked(spark, d), exact=False).withColumn("draw", F.lit(0))
    found = spot.spot_findings(spot.reexecute(sample, None))
    return found.groupBy(
        F.regexp_extract("finding_id", "FINDING-M3-(SPOT-[A-Z]+)-SEQ", 1).alias("kind"), "severity", "recommended_disposition"
    ).agg(F.count(F.lit(1)).alias("n"))


# Boxes, joins and predicates of ingest


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS cx, l_tax * 12.5 AS cy, l_quantity / 50 AS nw, l_linenumber / 8.0 AS nh FROM lineitem),
c AS (SELECT *, greatest(0.0, least((cx - nw / 2.0) * 640, 640.0)) AS x, greatest(0.0, least((cy - CAST(nh AS DOUBLE) / 2.0) * 480, 480.0)) AS y FROM b)
SELECT l_orderkey, l_linenumber, round(x, 6) AS x, round(y, 6) AS y, round(greatest(0.0, least(nw * 640, 640.0 - x)), 6) AS w, round(greatest(0.0,
  least(CAST(nh AS DOUBLE) * 480, 480.0 - y)), 6) AS h FROM c
""")
def yolo_boxes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    box = boxes.yolo_box(c("l_discount") * 10, c("l_tax") * 12.5, c("l_quantity") / 50, c("l_linenumber") / 8.0, F.lit(640), F.lit(480))
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b"))
    return t.select("l_orderkey", "l_linenumber", *(F.round(F.get("b", i), 6).alias(n) for i, n in enumerate("xywh")))


@query("""
SELECT l_orderkey, l_linenumber, greatest(l_quantity - 25, 0) AS x, greatest(l_discount - 0.05, 0) AS y, l_quantity AS w, l_tax - 0.02 AS h FROM
  lineitem WHERE l_tax - 0.02 >= 0
""")
def coco_boxes(spark: SparkSession, d: str) -> DataFrame:
    raw = F.array(F.col("l_quantity") - 25, F.col("l_discount") - 0.05, F.col("l_quantity"), F.col("l_tax") - 0.02)
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", boxes.coco_box(raw).alias("b")).filter("b is not null")
    return t.select("l_orderkey", "l_linenumber", *(F.get("b", i).alias(n) for i, n in enumerate("xywh")))


@query("""
SELECT o_orderkey, count(l_linenumber) AS annotations, coalesce(string_agg(coalesce(p_brand, 'class_' || l_partkey), ',' ORDER BY l_linenumber,
  coalesce(p_brand, 'class_' || l_partkey)), '') AS classes
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10 GROUP BY o_orderkey
""")
def image_annotations(spark: SparkSession, d: str) -> DataFrame:
    """J1, J2, A8: images left-joined with annotations, those left-joined with categories, grouped in order."""
    names = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    notes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber").join(names, "l_partkey", "left")
    named = notes.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", F.coalesce("p_brand", F.concat(F.lit("class_"), F.col("l_partkey").cast("string"))).alias("name")
    ))).alias("a"))
    joined = table(spark, d, "orders").select("o_orderkey").join(named, "o_orderkey", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "o_orderkey", F.coalesce(F.size("a"), F.lit(0)).cast("long").alias("annotations"),
        F.array_join(F.coalesce(F.transform("a", lambda x: x["name"]), none), ",").alias("classes")
    )


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_assets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT 'DETECTION' AS task_type, 'BBOX_XYWH_PRESENT' AS reason, TRUE AS boxes_present")
def task_type(spark: SparkSession, d: str) -> DataFrame:
    box = F.struct(F.array(F.lit(0.0), F.lit(0.0), "l_quantity", "l_quantity").alias("bbox"), F.lit(None).cast("array<array<double>>").alias("segmentation"))
    return probe.task_type(table(spark, d, "lineitem").select(F.array(box).alias("annotations")))


@query("SELECT count(*) AS asset_count, array_to_string(list_sort(list(DISTINCT source)), ',') AS contributor_ids, count(DISTINCT source) "
    "AS contributor_count FROM documents")
def contributors(spark: SparkSession, d: str) -> DataFrame:
    found = probe.cohort(table(spark, d, "documents").select(F.col("source").alias("contributor_id")))
    return found.withColumn("contributor_ids", F.array_join("contributor_ids", ","))


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_assets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("lang", "source").dropDuplicates()


_GATE_SQL = """
WITH c AS (
  SELECT c_custkey, 'det-' || (c_custkey % 7) AS id, 'T' || (c_custkey % 3) AS need, 'T' || (c_custkey // 3 % 3) AS tier, c_custkey // 9 % 3
    AS t, c_custkey % 5 AS k, c_custkey % 2 = 0 AS ref,
         CASE c_custkey // 27 % 3 WHEN 0 THEN 'ATTESTED' WHEN 1 THEN 'BOOTSTRAPPED' ELSE 'UNREFERENCED' END AS mode FROM customer),
e AS (
  SELECT *, ['CLASSIFICATION', 'DETECTION', 'SEGMENTATION'][t + 1] AS task, CASE WHEN k = 0 THEN [] WHEN k < 3 THEN ['DETECTION'] ELSE ['CLASSIFICATION',
    'DETECTION'] END AS tasks,
         {'T0': 'T0_LABELS', 'T1': 'T1_LOGITS', 'T2': 'T2_WEIGHTS'} AS names FROM c)
"""


def _gate_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    tasks = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 < 3, F.array(F.lit("DETECTION"))).otherwise(F.array(F.lit("CLASSIFICATION"), F.lit("DETECTION")))
    pick = lambda n, values: F.get(F.array(*map(F.lit, values)), F.floor(k / n).cast("int") % 3)
    return table(spark, d, "customer").select(
        k, F.concat(F.lit("det-"), (k % 7).cast("string")).alias("id"), F.concat(F.lit("T"), (k % 3).cast("string")).alias("need"), F.concat(F.lit("T"), (F.floor(k / 3) % 3).cast("string")).alias("tier"),
        pick(9, TASKS).alias("task"), tasks.alias("tasks"), (k % 2 == 0).alias("ref"), pick(27, ("ATTESTED", "BOOTSTRAPPED", "UNREFERENCED")).alias("mode"),
    )


@query(_GATE_SQL + """
SELECT c_custkey, reason, reason LIKE 'SUPPORTED: %' AS allowed FROM (
  SELECT c_custkey, CASE WHEN NOT list_contains(tasks, task) THEN 'TASK_UNSUPPORTED: requires one of [' || CASE WHEN k = 0 THEN '<none>' ELSE
    array_to_string(tasks, ', ') END || '], found ' || task
       WHEN tier < need THEN 'UNAVAILABLE_AT_TIER: requires ' || need || ', found ' || tier ELSE 'SUPPORTED: detector=' || id END AS reason FROM e)
""")
def gate_matrix(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    got = _gate_rows(spark, d).withColumn("g", gate.supports_column(c("id"), c("need"), c("tasks"), c("tier"), c("task")))
    return got.select("c_custkey", "g.reason", "g.allowed")


@query(_GATE_SQL + """
SELECT c_custkey, reason, reason LIKE 'SUPPORTED: %' AS allowed FROM (
  SELECT c_custkey, CASE WHEN NOT list_contains(tasks, task) THEN upper(replace(id, '-', '_')) || '_UNAVAILABLE_FOR_TASK_TYPE' WHEN tier < need
    THEN 'UNAVAILABLE_AT_TIER: requires ' ||
       CASE need WHEN 'T0' THEN 'T0_LABELS' WHEN 'T1' THEN 'T1_LOGITS' ELSE 'T2_WEIGHTS' END || ', found ' || CASE tier WHEN 'T0' THEN 'T0_LABELS'
         WHEN 'T1' THEN 'T1_LOGITS' ELSE 'T2_WEIGHTS' END
       WHEN ref AND mode = 'UNREFERENCED' THEN upper(replace(id, '-', '_')) || '_UNAVAILABLE_WITHOUT_REFERENCE' ELSE 'SUPPORTED: detector=' ||
         id END AS reason FROM e)
""")
def detector_gate(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    got = _gate_rows(spark, d).withColumn("g", gate.availability_column(c("id"), c("need"), c("tasks"), c("ref"), c("tier"), c("task"), c("mode")))
    return got.select("c_custkey", "g.reason", "g.allowed")


@query("SELECT page_id, url ~ '^(http|https)://[^/?#].*' AS is_url, regexp_replace(url, '^(https?)://', '\\1://') AS spec FROM pages")
def url_specs(spark: SparkSession, d: str) -> DataFrame:
    collapsed = F.regexp_replace("url", "^(https?)://", "$1:/")
    return table(spark, d, "pages").select("page_id", probe.url_column(F.col("url")).alias("is_url"), probe.spec_column(collapsed).alias("spec"))


@query("""
SELECT event_id, CASE WHEN regexp_matches(lower(j), 'weights|state_dict|parameters|tensors') THEN 'T2' WHEN regexp_matches(lower(j), 'logit|score|confidence|prob')
  THEN 'T1' WHEN event_id % 2 = 0 THEN 'T1' ELSE 'T0' END AS tier
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"outputs":["Weights"]}' WHEN 1 THEN '{"outputs":["logits"]}' WHEN 2 THEN '{"a":1}' ELSE
  '{"b":2}' END AS j FROM events)
""")
def descriptor_tiers(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    extra = F.when(e % 2 == 0, ',"endpoint":"https://api.example.org/v1"').otherwise("")
    body = F.when(e % 5 == 0, '{"outputs":["Weights"]').when(e % 5 == 1, '{"outputs":["logits"]').when(e % 5 == 2, '{"a":1').otherwise('{"b":2')
    return table(spark, d, "events").select("event_id", probe.descriptor_tier_column(F.concat(body, extra, F.lit("}"))).alias("tier"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN sha256(source) WHEN 1 THEN sha256(source) ELSE NULL END AS digest, CAST(doc_id % 3 AS "
    "INTEGER) AS rank FROM documents")
def digest_format(spark: SparkSession, d: str) -> DataFrame:
    h, k = F.sha2("source", 256), F.col("doc_id") % 3
    raw = F.when(k == 0, F.concat(F.lit(" "), F.upper(h))).when(k == 1, h).otherwise(F.concat(F.substring(h, 1, 63), F.lit("z")))
    return table(spark, d, "documents").select("doc_id", clean_digest(raw).alias("digest"), tier_rank(F.concat(F.lit("T"), k.cast("string"))).alias("rank"))


@query("SELECT kind, CAST(position AS INTEGER) AS position, item FROM (VALUES " + ", ".join(
    f"('{k}', {i}, '{x}')" for k, xs in (
        ("supported", report.SUPPORTED), ("partial", report.PARTIAL), ("unsupported", report.UNSUPPORTED),
        ("assumptions", report.ASSUMPTIONS)
    ) for i, x in enumerate(xs)
) + ") t(kind, position, item)")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return report.coverage(spark)


# Data integrity


@query("SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return integrity.exact_duplicates(table(spark, d, "documents"), "doc_id", F.col("text"))


@query("""
WITH g AS (SELECT c_custkey // 4 AS g, c_custkey % 4 AS r, CAST('0x' || substr(md5(CAST(c_custkey // 4 AS VARCHAR)), 1, 15) AS BIGINT) AS base FROM customer),
h AS (
  SELECT DISTINCT xor(xor(base, CASE WHEN r > 0 THEN 1::BIGINT << CAST(g % 60 AS INTEGER) ELSE 0 END),
         xor(CASE WHEN r > 1 THEN 1::BIGINT << CAST((g * 7 + 1) % 60 AS INTEGER) ELSE 0 END, CASE WHEN r > 2 THEN 1023::BIGINT << CAST(g % 50
           AS INTEGER) ELSE 0 END)) AS h FROM g)
SELECT a.h AS hash_a, b.h AS hash_b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM h a JOIN h b ON a.h < b.h WHERE bit_count(xor(a.h, b.h)) <= 3
""")
def near_duplicate_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes in families of four, one, two and more bits apart."""
    g, r = F.floor(F.col("c_custkey") / 4), F.col("c_custkey") % 4
    base = F.conv(F.substring(F.md5(g.cast("string")), 1, 15), 16, 10).cast("long")
    bits = lambda n, value, by: F.when(r > n, F.call_function("shiftleft", F.lit(value).cast("long"), by.cast("int"))).otherwise(0)
    h = base.bitwiseXOR(bits(0, 1, g % 60)).bitwiseXOR(bits(1, 1, (g * 7 + 1) % 60)).bitwiseXOR(bits(2, 1023, g % 50))
    return integrity.near_duplicates(table(spark, d, "customer").select(h.alias("hash")))


_KNN = """
WITH q AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 100 = 0),
n AS (
  SELECT q.vec_id AS query_id, q.label AS query_label, e.vec_id AS id, e.label,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum([(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) ** 2 FOR x IN list_zip(q.embedding,
           e.embedding)]), e.vec_id) AS rank
  FROM q JOIN embeddings e ON e.vec_id <> q.vec_id)
"""


def _knn(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return integrity.nearest(rows.filter("vec_id % 100 = 0"), rows, 10)


@query(_KNN + """
, v AS (SELECT query_id, query_label, label, count(*) AS c FROM n WHERE rank <= 10 GROUP BY ALL)
SELECT query_id, query_label, coalesce(sum(c) FILTER (WHERE label = query_label), 0)::DOUBLE / sum(c) AS agreement, arg_max(label, c * 1000 -
  label) AS majority_label,
       coalesce(sum(c) FILTER (WHERE label = query_label), 0)::DOUBLE / sum(c) < 0.5 AS flipped FROM v GROUP BY query_id, query_label
""")
def knn_label_agreement(spark: SparkSession, d: str) -> DataFrame:
    return integrity.label_agreement(_knn(spark, d))


@query(_KNN + "SELECT query_label AS label, label AS nn_label, count(*) AS n FROM n WHERE rank = 1 GROUP BY ALL")
def knn_confusion(spark: SparkSession, d: str) -> DataFrame:
    return integrity.confusion(_knn(spark, d))


@query()
def mahalanobis_ood(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return integrity.mahalanobis(rows, integrity.class_moments(rows))


@query()
def spectral_signatures(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return integrity.spectral_signatures(rows, integrity.class_moments(rows))


#: Points in the plane, where the inverse and the eigenvector of a covariance have closed forms.
_PLANE = """
WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_linenumber % 3 AS INTEGER) AS label, l_quantity AS x, l_quantity / 4 + l_discount
  * 100 AS y FROM lineitem),
k AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(x * x) - avg(x) * avg(x) AS sxx, avg(x * y) - avg(x) * avg(y) AS sxy, avg(y
  * y) - avg(y) * avg(y) AS syy FROM v WHERE {} GROUP BY label),
c AS (SELECT sum(n * sxx) / sum(n) + 0.001 AS a, sum(n * sxy) / sum(n) AS b, sum(n * syy) / sum(n) + 0.001 AS d FROM k)
"""
_DISTANCE = """
SELECT id, round((SELECT min(sqrt((d * (x - mx) * (x - mx) - 2 * b * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * d - b * b))) FROM
  k, c), 6) AS distance FROM v
"""


def _plane(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    point = F.array(q, q / 4 + F.col("l_discount") * 100).alias("embedding")
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), point, (F.col("l_linenumber") % 3).cast("int").alias("label")
    )


@query(_PLANE.format("TRUE") + _DISTANCE)
def mahalanobis_plane(spark: SparkSession, d: str) -> DataFrame:
    rows = _plane(spark, d)
    return integrity.mahalanobis(rows, integrity.class_moments(rows), "id").select("id", F.round("distance", 6).alias("distance"))


@query(_PLANE.format("id % 2 = 0") + _DISTANCE)
def mahalanobis_shift_plane(spark: SparkSession, d: str) -> DataFrame:
    rows = _plane(spark, d)
    return shift.mahalanobis_shift(rows.filter("id % 2 = 0"), rows, "id").select("id", F.round("distance", 6).alias("distance"))


@query(_PLANE.format("TRUE") + """
, e AS (SELECT label, mx, my, sxx, sxy, (sxx + syy) / 2 + sqrt(power((sxx - syy) / 2, 2) + sxy * sxy) AS top FROM k)
SELECT id, label, round(power((x - mx) * sxy + (y - my) * (top - sxx), 2) / (sxy * sxy + power(top - sxx, 2)), 4) AS score FROM v JOIN e USING (label)
""")
def spectral_plane(spark: SparkSession, d: str) -> DataFrame:
    rows = _plane(spark, d)
    return integrity.spectral_signatures(rows, integrity.class_moments(rows), "id").select("id", "label", F.round("score", 4).alias("score"))


@query()
def activation_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return integrity.activation_clusters(rows, integrity.class_moments(rows))


@query("""
WITH b AS (SELECT l_orderkey AS k, l_linenumber, l_returnflag AS c, l_quantity * 10 AS x, l_quantity * 5 AS y, l_discount * 1000 AS w, l_tax
  * 1000 AS h FROM lineitem),
a AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN ln(w * h) END AS la FROM b),
s AS (SELECT c, avg(la) AS m, stddev_pop(la) AS sd FROM a GROUP BY c)
SELECT 'img-' || k AS asset_id, CAST(l_linenumber AS INTEGER) AS position, c AS class_name,
       CASE WHEN la IS NULL THEN 'no_area' WHEN x + w > 512 OR y + h > 512 THEN 'outside_image' WHEN w * h > 0.98 * 512 * 512 THEN 'whole_image'
         WHEN abs((la - m) / sd) > 2.0 THEN 'odd_area' END AS problem
FROM a JOIN s USING (c) WHERE la IS NULL OR x + w > 512 OR y + h > 512 OR w * h > 0.98 * 512 * 512 OR abs((la - m) / sd) > 2.0
""")
def annotation_anomalies(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    note = F.struct(F.array(q * 10, q * 5, F.col("l_discount") * 1000, F.col("l_tax") * 1000).alias("bbox"), F.col("l_returnflag").alias("class_name"))
    size = F.struct(F.lit(512).alias("width"), F.lit(512).alias("height"), F.lit(3).alias("channels"))
    assets = table(spark, d, "lineitem").select(
        F.concat(F.lit("img-"), F.col("l_orderkey").cast("string")).alias("asset_id"), size.alias("image_metadata"),
        F.array(note).alias("annotations"), "l_linenumber"
    )
    place = assets.select(F.concat_ws("/", "asset_id", "l_linenumber").alias("asset_id"), "image_metadata", "annotations")
    found = integrity.annotation_anomalies(place, 2.0)
    part = F.split("asset_id", "/")
    return found.select(F.get(part, 0).alias("asset_id"), F.get(part, 1).cast("int").alias("position"), "class_name", "problem")


@query("""
WITH f AS (SELECT source, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS bad FROM documents JOIN labels USING (doc_id)),
t AS (SELECT sum(bad) / count(*) AS p FROM f)
SELECT source AS contributor, count(*) AS n, CAST(sum(bad) AS BIGINT) AS bad, round(sum(bad) / count(*), 9) AS rate, round((sum(bad) / count(*)
  - any_value(p)) / sqrt(any_value(p) * (1 - any_value(p)) / count(*)), 6) AS z
FROM f, t GROUP BY source
""")
def contributor_binomial(spark: SparkSession, d: str) -> DataFrame:
    flags = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").select("source", (F.col("quality") == 0).cast("int").alias("bad"))
    found = integrity.contributor_binomial(flags)
    return found.select("contributor", "n", "bad", F.round("rate", 9).alias("rate"), F.round("z", 6).alias("z"))


_SYBIL = """
WITH RECURSIVE i AS (SELECT DISTINCT source AS who, md5(coalesce(text, '')) AS item FROM documents WHERE source IS NOT NULL),
m AS (SELECT who, k, min(md5(k || ':' || item)) AS m FROM i, range(64) AS t(k) GROUP BY who, k),
p AS (SELECT x.who AS a, y.who AS b, count(*) / 64 AS similarity FROM m x JOIN m y ON x.k = y.k AND x.m = y.m AND x.who < y.who GROUP BY ALL)
"""


def _sybils(spark: SparkSession, d: str, least: float) -> DataFrame:
    return integrity.sybil_pairs(table(spark, d, "documents"), "source", F.md5(F.coalesce("text", F.lit(""))), least)


@query(_SYBIL + "SELECT a, b, similarity FROM p")
def sybil_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _sybils(spark, d, 0.0)


@query(_SYBIL + """, e AS (SELECT a, b FROM p WHERE similarity >= 0.05 UNION SELECT b, a FROM p WHERE similarity >= 0.05),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS contributor, min(least(a, b)) AS cluster FROM r GROUP BY a
""")
def sybil_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Contributors linked by shares of common texts, and whom those reach."""
    return integrity.sybil_clusters(_sybils(spark, d, 0.05))


@query("""
WITH p AS (SELECT a.vec_id, list_zip(a.embedding, b.embedding) AS z FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(1 - list_sum([CAST(x[1] AS DOUBLE) * x[2] FOR x IN z]) / (sqrt(list_sum([CAST(x[1] AS DOUBLE) * x[1] FOR x IN z])) * sqrt(list_sum([CAST(x[2]
  AS DOUBLE) * x[2] FOR x IN z]))), 6) AS divergence FROM p
""")
def encoder_divergence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("e_ref")).join(
        e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e_sub")), "vec_id"
    )
    return integrity.encoder_divergence(pairs).select("vec_id", F.round("divergence", 6).alias("divergence"))


# Model integrity


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'UNATTESTED' WHEN s_suppkey % 5 = 0 THEN 'SUBSTITUTED' ELSE 'MATCH' END AS status FROM supplier")
def weight_digests(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    models = table(spark, d, "supplier").select(k, F.when(k % 5 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.upper(F.sha2("s_name", 256))).alias("digest"))
    attested = table(spark, d, "supplier").filter(k % 7 != 0).select(k, F.sha2("s_name", 256).alias("digest"))
    return model_integrity.digest_check(models, attested, "s_suppkey").select("s_suppkey", "status")


@query("SELECT l_returnflag || l_linestatus AS layer, count(*) AS n, round(sqrt(sum(l_extendedprice * l_extendedprice)), 1) AS norm, "
    "round(avg(l_extendedprice), 4) AS mean, round(kurtosis_pop(l_extendedprice), 6) AS kurtosis FROM lineitem GROUP BY 1")
def weight_statistics(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("layer"), F.col("l_extendedprice").alias("value"))
    s = model_integrity.weight_statistics(w)
    return s.select("layer", "n", F.round("norm", 1).alias("norm"), F.round("mean", 4).alias("mean"), F.round("kurtosis", 6).alias("kurtosis"))


@query("""
WITH a AS (SELECT user_id AS model_id, event_id % 20 AS probe_id, min(event_type) AS answer FROM events GROUP BY ALL),
s AS (SELECT event_id % 20 AS probe_id, min(event_type) AS answer FROM events GROUP BY ALL)
SELECT m.model_id, count(*) AS probes, avg(CASE WHEN a.answer = s.answer THEN 1.0 ELSE 0.0 END) AS agreement
FROM (SELECT DISTINCT model_id FROM a) m CROSS JOIN s LEFT JOIN a ON a.model_id = m.model_id AND a.probe_id = s.probe_id GROUP BY m.model_id
""")
def behavioural_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("model_id"), (F.col("event_id") % 20).alias("probe_id"), F.col("event_type").alias("answer"))
    return model_integrity.behavioural_fingerprint(
        e.groupBy("model_id", "probe_id").agg(F.min("answer").alias("answer")), e.groupBy("probe_id").agg(F.min("answer").alias("answer"))
    )


@query("""
WITH m AS (SELECT median(s_acctbal) AS med FROM supplier), o AS (SELECT s_suppkey, s_acctbal, abs(s_acctbal - med) AS off, med FROM supplier,
  m), a AS (SELECT median(off) * 1.4826 AS mad FROM o)
SELECT s_suppkey, s_acctbal, round(off / mad, 6) AS anomaly_index, off / mad > 1.2 AND s_acctbal < med AS outlier FROM o, a
""")
def trigger_norm_outliers(spark: SparkSession, d: str) -> DataFrame:
    found = model_integrity.mad_outliers(table(spark, d, "supplier"), "s_suppkey", "s_acctbal", 1.2)
    return found.select("s_suppkey", "s_acctbal", F.round("anomaly_index", 6).alias("anomaly_index"), "outlier")


@query("""
WITH p AS (SELECT l_orderkey, [l_discount, l_tax, 1 - l_discount - l_tax] AS p FROM lineitem),
e AS (SELECT l_orderkey, -list_sum([CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END FOR x IN p]) AS h FROM p)
SELECT l_orderkey AS item_id, count(*) AS copies, round(avg(h), 9) AS entropy, avg(h) < 0.2 AS trojaned FROM e GROUP BY l_orderkey
""")
def strip_entropy(spark: SparkSession, d: str) -> DataFrame:
    p = F.array("l_discount", "l_tax", 1 - F.col("l_discount") - F.col("l_tax"))
    found = model_integrity.strip_entropy(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), p.alias("probabilities")), limit=0.2)
    return found.withColumn("entropy", F.round("entropy", 9))


# Shift, fusion, quality of detection


@query("""
WITH s AS (SELECT value AS x, event_id % 2 = 0 AS a FROM events WHERE value IS NOT NULL), c AS (SELECT x, count_if(a) AS a, count_if(NOT a) AS
  b FROM s GROUP BY x),
k AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c WINDOW w AS (ORDER BY x))
SELECT CAST(any_value(na) AS BIGINT) AS n_a, CAST(any_value(nb) AS BIGINT) AS n_b, round(max(abs(ca / na - cb / nb)), 12) AS ks FROM k
""")
def ks_statistic(spark: SparkSession, d: str) -> DataFrame:
    return shift.ks_statistic(table(spark, d, "events"), "value", F.col("event_id") % 2 == 0).withColumn("ks", F.round("ks", 12))


@query("""
SELECT CAST(count_if(event_id % 2 = 0) AS BIGINT) AS n_a, CAST(count_if(event_id % 2 <> 0) AS BIGINT) AS n_b,
       round(2 * power(avg(value) FILTER (WHERE event_id % 2 = 0) - avg(value) FILTER (WHERE event_id % 2 <> 0), 2)
       + power(avg(value * value) FILTER (WHERE event_id % 2 = 0) - avg(value * value) FILTER (WHERE event_id % 2 <> 0), 2), 3) AS mmd2 FROM
         events WHERE value IS NOT NULL
""")
def mmd_statistic(spark: SparkSession, d: str) -> DataFrame:
    return shift.mmd_quadratic(table(spark, d, "events"), "value", F.col("event_id") % 2 == 0).withColumn("mmd2", F.round("mmd2", 3))


@query()
def mahalanobis_shift(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return shift.mahalanobis_shift(e.filter("vec_id % 2 = 0"), e)


@query("""
WITH t AS (SELECT n_name, ['physical', 'acquisition', 'semantic'][n_nationkey % 3 + 1] AS family, n_nationkey / 100.0 AS p, n_nationkey % 4 +
  1 AS hit FROM nation)
SELECT CASE WHEN count_if(p < 0.1) = 0 THEN 'NO_SHIFT' WHEN bool_and(family = 'semantic') FILTER (WHERE p < 0.1) OR max(hit / 5.0) FILTER (WHERE
  p < 0.1) < 0.5 THEN 'MANIPULATION' ELSE 'DRIFT' END AS verdict,
       array_to_string(list_sort(list(DISTINCT family) FILTER (WHERE p < 0.1)), ',') AS shifted_families, CAST(count_if(p < 0.1) AS BIGINT) AS shifted FROM t
""")
def drift_or_manipulation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    tests = table(spark, d, "nation").select(
        F.get(
            F.array(*map(F.lit, ("physical", "acquisition", "semantic"))), k % 3
        ).alias("family"), F.col("n_name").alias("feature"), (k / 100.0).alias("p_value"), (k % 4 + 1).alias("contributors_hit"), F.lit(5.0).alias("contributors")
    )
    return shift.drift_or_manipulation(tests, 0.1).withColumn("shifted_families", F.array_join("shifted_families", ","))


@query("SELECT doc_id, CASE WHEN s < 0.25 THEN 'ACCEPT' WHEN s >= 0.85 THEN 'QUARANTINE' ELSE 'REVIEW' END AS decision, CAST(CASE WHEN s >= "
    "0.85 THEN 2 WHEN s >= 0.6 THEN 1 ELSE 0 END AS INTEGER) AS priority FROM (SELECT doc_id, (doc_id % 101) / 100.0::DOUBLE AS s FROM labels)")
def policy_decision(spark: SparkSession, d: str) -> DataFrame:
    s = (F.col("doc_id") % 101) / 100.0
    return table(spark, d, "labels").select("doc_id", fusion.decide(s).alias("decision"), fusion.priority(s).alias("priority"))


_DETECTORS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("""
WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS qe, abs(corr(l_quantity, l_discount)) AS qd, abs(corr(l_quantity, l_tax)) AS qt,
  abs(corr(l_extendedprice, l_discount)) AS ed, abs(corr(l_extendedprice, l_tax)) AS et, abs(corr(l_discount, l_tax)) AS dt FROM lineitem),
w AS (SELECT 1 / (1 + qe + qd + qt) AS q, 1 / (1 + qe + ed + et) AS e, 1 / (1 + qd + ed + dt) AS d, 1 / (1 + qt + et + dt) AS t FROM r),
u AS (SELECT 'l_quantity' AS detector, q / (q + e + d + t) AS x FROM w UNION ALL SELECT 'l_extendedprice', e / (q + e + d + t) FROM w UNION ALL
  SELECT 'l_discount', d / (q + e + d + t) FROM w UNION ALL SELECT 'l_tax', t / (q + e + d + t) FROM w)
SELECT detector, round(x, 9) AS weight FROM u
""")
def correlation_weights(spark: SparkSession, d: str) -> DataFrame:
    return fusion.correlation_weights(table(spark, d, "lineitem"), list(_DETECTORS)).withColumn("weight", F.round("weight", 9))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, (0.5 * l_discount * 10 + 0.3 * l_tax * 12.5 + 0.2 * l_quantity / 50) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, round(r, 9) AS risk, CASE WHEN round(r, 9) < 0.25 THEN 'ACCEPT' WHEN round(r, 9) >= 0.85 THEN 'QUARANTINE' ELSE
  'REVIEW' END AS decision FROM s
""")
def fused_risk(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber").alias("id"), (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 12.5).alias("b"),
        (F.col("l_quantity") / 50).alias("c")
    )
    f = fusion.fuse(s, "id", {"a": 0.5, "b": 0.3, "c": 0.2}).withColumn("risk", F.round("risk", 9))
    return f.select("id.l_orderkey", "id.l_linenumber", "risk", fusion.decide(F.col("risk")).alias("decision"))


@query(ledgers.SQL + """
, fs AS (
  SELECT f.finding_id, f.detector, CASE WHEN f.check_no IN (3, 5) THEN 'unknown' ELSE a.asset END AS asset_ref,
         CASE f.finding_id WHEN 'FINDING-M3-SIG-UNAVAILABLE' THEN [] ELSE CASE WHEN f.check_no = 5 THEN ['checkpoint_' || c.checkpoint_id || '.json']
           WHEN f.finding_id LIKE '%REPLAY%' THEN ['receipt_seq_' || a.seq || '.json', 'receipt_seq_' || r.first_seq || '.json'] ELSE ['receipt_seq_'
             || a.seq || '.json'] END END AS files
  FROM found f LEFT JOIN att a ON a.ledger = f.ledger AND a.pos = f.pos AND f.check_no <> 5 LEFT JOIN rep r ON r.ledger = f.ledger AND r.pos
    = f.pos AND f.check_no = 2
  LEFT JOIN chk c ON c.ledger = f.ledger AND c.pos = f.pos AND f.check_no = 5),
edges AS (
  SELECT 'raised_by' AS kind, 'finding:' || finding_id AS source, 'detector:' || detector AS target FROM fs
  UNION SELECT 'about', 'finding:' || finding_id, 'asset:' || asset_ref FROM fs
  UNION SELECT 'contributed_by', 'asset:' || asset_ref, 'contributor:C-07' FROM fs
  UNION SELECT 'evidenced_by', 'finding:' || finding_id, 'artifact:' || unnest(files) FROM fs)
SELECT kind, source, target FROM edges
""")
def evidence_graph(spark: SparkSession, d: str) -> DataFrame:
    return fusion.evidence_edges(_audit(spark, d)).select("kind", "source", "target")


@query("""
SELECT s_suppkey, CASE WHEN a < 0.5 THEN 'hash' WHEN b < 0.5 THEN 'statistics' ELSE 'model' END AS stage, round(CASE WHEN a < 0.5 THEN a WHEN
  b < 0.5 THEN b ELSE a * b END, 9) AS score
FROM (SELECT s_suppkey, (s_suppkey % 10) / 10.0::DOUBLE AS a, (s_suppkey % 7) / 7.0::DOUBLE AS b FROM supplier)
""")
def tiered_scan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    a, b = (k % 10) / 10.0, (k % 7) / 7.0
    add: Callable[[Column], Callable[[DataFrame], DataFrame]] = lambda c: lambda df: df.withColumn("score", c)
    stages = [("hash", add(a), 0.5), ("statistics", add(b), 0.5), ("model", add(a * b), 0.0)]
    return fusion.tiered_scan(table(spark, d, "supplier").select("s_suppkey"), stages).select("s_suppkey", "stage", F.round("score", 9).alias("score"))


@query("""
WITH s AS (SELECT d.lang AS attack, n_chars / 20000.0::DOUBLE AS s, quality = 0 AS t FROM documents d JOIN labels USING (doc_id)),
r AS (SELECT *, rank() OVER (PARTITION BY attack ORDER BY s) + (count(*) OVER (PARTITION BY attack, s) - 1) / 2.0::DOUBLE AS rk FROM s),
g AS (SELECT attack, count(*) AS n, count_if(t) AS p, count_if(NOT t) AS q, sum(rk) FILTER (WHERE t) AS sr, count_if(t AND s >= 0.1) AS tp, count_if(NOT
  t AND s >= 0.1) AS fp FROM r GROUP BY attack)
SELECT attack, n, CAST(p AS BIGINT) AS positives, tp / nullif(p, 0) AS tpr, fp / nullif(q, 0) AS fpr, round((sr - p * (p + 1) / 2.0::DOUBLE)
  / nullif(p * q, 0), 9) AS auroc FROM g
""")
def detection_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("attack"), (F.col("n_chars") / 20000.0).alias("score")).join(
        table(spark, d, "labels").select("doc_id", (F.col("quality") == 0).alias("truth")), "doc_id"
    )
    return attacks.detection_quality(rows, threshold=0.1).withColumn("auroc", F.round("auroc", 9))


@query()
def simulated_attacks(spark: SparkSession, d: str) -> DataFrame:
    """Every data attack over the embeddings, scored by the Mahalanobis detector fitted on the clean ones."""
    clean = table(spark, d, "embeddings")
    rows = attacks.all_attacks(clean)
    keyed = rows.withColumn("key", F.struct("attack", "vec_id", "attacked"))
    scored = integrity.mahalanobis(keyed, integrity.class_moments(clean), id_col="key")
    return attacks.detection_quality(scored.select("key.attack", F.col("distance").alias("score"), F.col("key.attacked").alias("truth")), threshold=12.0)


@query("SELECT min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS n FROM events")
def ledger_extent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count(F.lit(1)).alias("n"))



"""The operators' queries over the driver's tables, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontamination import decontaminate
from .exact_dedup import exact_dedup
from .language_id import identify
from .line_dedup import line_dedup
from .pii import KINDS, pseudonymise
from .quality import classify
from .secrets import digest, find_secrets
from .sentencepiece import encode
from .simhash import simhash_dedup
from .url_filter import filter_urls, host, path

#: The key of the query's surrogates. A deployment passes its own secret; this one only makes the query repeatable.
DEMO_KEY = b"veriframe demonstration key"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"), verify=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), "round_trip")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return done.select("doc_id", "text", *map(count, KINDS))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time: the table has none, so it is set by the id, over 500 days from 2024 on."""
    seconds = (F.col("page_id") * 37 % 500) * 86_400 + F.col("page_id") % 86_400
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + seconds).alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for a third of the hosts, domains and first directories of the pages, by a hash of the pattern: taken
    up, most of them dropped later, half of those taken up again; one in eleven is on an allowing list."""
    h, first = host(F.col("url")), F.regexp_extract(path(F.col("url")), "^/([^/]+)/", 1)
    domain = F.array_join(F.slice(F.split(h, r"\."), -2, 2), ".")
    of_url = F.array(
        F.concat(F.lit("host:"), h), F.when(h.contains("."), F.concat(F.lit("domain:"), domain)),
        F.when(first != "", F.concat(F.lit("prefix:"), h, F.lit("/"), first, F.lit("/")))
    )
    patterns = pages.select(F.explode(of_url).alias("pattern")).filter("pattern is not null").distinct()
    x = F.conv(F.substring(F.md5("pattern"), 1, 7), 16, 10).cast("long")
    on = F.floor(F.col("x") / 7) % 300
    off = on + 20 + F.floor(F.col("x") / 13) % 100
    dated = F.array(
        F.struct(F.lit("add").alias("action"), on.alias("day")),
        F.when(F.col("x") % 4 != 0, F.struct(F.lit("remove").alias("action"), off.alias("day"))),
        F.when(F.col("x") % 4 == 2, F.struct(F.lit("add").alias("action"), (off + 40).alias("day"))),
    )
    entries = patterns.withColumn("x", x).filter("x % 3 = 0").withColumn("e", F.explode(dated)).filter("e is not null")
    return entries.select(
        F.concat(F.lit("list"), F.col("x") % 5).alias("list"),
        F.when(F.col("x") % 11 == 0, "allow").otherwise("block").alias("effect"),
        "pattern",
        "e.action",
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("e.day") * 86_400).alias("at"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = filter_urls(captures(pages), list_entries(pages))
    return found.select("page_id", "host", "n_blocking", F.array_join("lists", ",").alias("lists"), "allowed", "blocked")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_pii": op5_pii,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": r"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i AS no, ls[i] AS line FROM docs, unnest(range(1, len(ls) + 1)) AS u(i)),
firsts AS (
  SELECT line, min((doc_id, no)) AS pos, any_value(length(line)) AS n FROM lines WHERE trim(line, ' ') <> '' GROUP BY line),
dels AS (
  SELECT DISTINCT line, pos, substr(line, 1, CAST(p AS INTEGER) - 1) || substr(line, CAST(p AS INTEGER) + 1) AS v
  FROM firsts, unnest(range(1, n + 1)) AS u(p) WHERE n >= 5),
vars AS (SELECT line, pos, hash(v) AS k FROM dels UNION ALL SELECT line, pos, hash(line) FROM firsts WHERE n >= 5),
near AS (
  SELECT DISTINCT a.line FROM vars a JOIN vars b USING (k)
  WHERE b.pos < a.pos AND levenshtein(a.line, b.line) <= 1),
gone AS (
  SELECT l.doc_id, l.no, n.line IS NOT NULL AND f.pos = (l.doc_id, l.no) AS by_near
  FROM lines l JOIN firsts f USING (line) LEFT JOIN near n USING (line) WHERE n.line IS NOT NULL OR f.pos <> (l.doc_id, l.no)),
per_doc AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.no) AS n_dropped, count_if(g.by_near) AS n_near,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.no) FILTER (WHERE g.no IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g USING (doc_id, no) GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
       sha256(coalesce(p.text, '')) AS text_sha256
FROM documents d LEFT JOIN per_doc p USING (doc_id)
""",
    "op3_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
    AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
    AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS m, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 8 + 1, 1) + 1)) AS u(i) WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM d, ms, unnest(range(1, len(w) - m + 2)) AS u(i)),
occ AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw USING (m, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + m)) AS u(p) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op7_url_filter": r"""
WITH p AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\s]*@)?([^/?#:@\s]+)', 1)), '\.+$', ''), '') AS host,
         list_filter(string_split(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*(/[^?#\s]*)', 1), '/'), lambda x: x <> '') AS parts,
         regexp_extract(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*(/[^?#\s]*)', 1), '^/([^/]+)/', 1) AS first,
         make_timestamp((1704067200 + (page_id * 37 % 500) * 86400 + page_id % 86400) * 1000000) AS tm
  FROM pages),
q AS (SELECT *, string_split(host, '.') AS labels FROM p WHERE host IS NOT NULL),
keys AS (
  SELECT page_id, tm, 'host:' || host AS pattern FROM q
  UNION SELECT page_id, tm, 'domain:' || array_to_string(labels[i:], '.') FROM q, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS u(i)
  UNION SELECT page_id, tm, 'prefix:' || host || '/' || array_to_string(parts[1:i], '/') || CASE WHEN i < len(parts) THEN '/' ELSE '' END
  FROM q, unnest(range(1, len(parts) + 1)) AS u(i)),
patterns AS (
  SELECT 'host:' || host AS pattern FROM q
  UNION SELECT 'domain:' || array_to_string(labels[-2:], '.') FROM q WHERE len(labels) > 1
  UNION SELECT 'prefix:' || host || '/' || first || '/' FROM q WHERE first <> ''),
x AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 7) AS BIGINT) AS x FROM patterns),
y AS (
  SELECT pattern, 'list' || (x % 5) AS list, CASE WHEN x % 11 = 0 THEN 'allow' ELSE 'block' END AS effect, x, (x // 7) % 300 AS d1,
         (x // 7) % 300 + 20 + (x // 13) % 100 AS d2
  FROM x WHERE x % 3 = 0),
spans AS (
  SELECT pattern, list, effect, d1 AS lo, CASE WHEN x % 4 <> 0 THEN d2 END AS hi FROM y
  UNION ALL SELECT pattern, list, effect, d2 + 40, NULL FROM y WHERE x % 4 = 2),
hits AS (
  SELECT DISTINCT page_id, list, effect FROM keys JOIN spans USING (pattern)
  WHERE epoch(tm) >= 1704067200 + lo * 86400 AND (hi IS NULL OR epoch(tm) < 1704067200 + hi * 86400)),
per_page AS (
  SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) FILTER (WHERE effect = 'block') AS lists,
         count(DISTINCT list) FILTER (WHERE effect = 'block') AS n, bool_or(effect = 'allow') AS allowed
  FROM hits GROUP BY page_id)
SELECT p.page_id, p.host, CAST(coalesce(n, 0) AS BIGINT) AS n_blocking, coalesce(lists, '') AS lists, coalesce(allowed, FALSE) AS allowed,
       coalesce(n, 0) > 0 AND NOT coalesce(allowed, FALSE) AS blocked
FROM p LEFT JOIN per_page USING (page_id)
""",
}

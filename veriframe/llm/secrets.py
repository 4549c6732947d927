"""Secret scan with multipart credential linking.

Base spans are matches of three patterns. Credentials often come in parts of which each alone means little: an access
identifier, a secret, an endpoint. Weak candidates for such parts are found too, but reported only where complementary
parts meet: parts are intervals, a scope is a run of lines without a blank one, and a candidate's interval is joined with
those of the parts in its scope. With `reach`, parts are joined only where the candidate's interval, widened by so many
characters, touches theirs; without, which is the rule, everything in the scope counts.

* weak_secret: a run of 40 or more base64 characters of mixed kinds, no base span. Needs an access identifier.
* weak_id: the value of user, login, client id, account id or access key assignments. Needs a secret.
* endpoint: a URL with a host, or a host:port. Needs both.
An identifier and a secret that are both weak count for each other only with an endpoint that both meet.

Spans are sorted once a text and each join is a binary search, so time grows as the text does.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import has_columns, in_arrow

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WEAK_ID = re.compile(
    r"""(?<![A-Za-z0-9])(?:user(?:name)?|login|client_?id|account_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})""",
    re.IGNORECASE | re.ASCII
)
_ID_WORDS = ("user", "login", "client", "account", "access")
_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40,}={0,2}(?![A-Za-z0-9+/=])")
_ENDPOINT = re.compile(
    r"(?:https?|ftp|jdbc:[a-z]+|mongodb|postgres(?:ql)?|amqps?|redis)://[^\s\"'<>]+|(?<![A-Za-z0-9.-])[a-z0-9-]+(?:\.[a-z0-9-]+)+:\d{2,5}(?!\d)",
    re.ASCII
)
_BLANK = re.compile(r"\n[ \t\r]*\n")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns' matches, leftmost and non-overlapping per kind, by start and kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):  # lower() maps every character that the pattern takes for a letter to that letter
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return _sorted(found)


def _sorted(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _mixed(x: str) -> bool:
    return any(map(str.isdigit, x)) and any(map(str.isupper, x)) and any(map(str.islower, x))


class Intervals:
    """Spans by their start, with the greatest end so far, so whether any of them meets an interval is one search."""

    def __init__(self, spans: Iterable[Span]):
        known = sorted((a, b) for a, b, _ in spans)
        self.starts = [a for a, _ in known]
        self.ends = list(accumulate((b for _, b in known), max))

    def meets(self, lo: int, hi: int) -> bool:
        """Whether a span has a character in [lo, hi): of those that begin before hi, one ends after lo."""
        k = bisect_left(self.starts, hi)
        return k > 0 and self.ends[k - 1] > lo


def linked_spans(text: str, base: list[Span], reach: int | None = None) -> list[Span]:
    """The weak candidates of a text that complementary parts confirm."""
    low = text.lower()
    strong_ids = [s for s in base if s[2] == "access"]
    maybe = any(w in low for w in _ID_WORDS)
    if not strong_ids and not maybe:
        return []
    taken = Intervals(base)
    weak_ids = [(*m.span(1), "weak_id") for m in _WEAK_ID.finditer(text)] if maybe else []
    weak_secrets = [(*m.span(), "weak_secret") for m in _WEAK_SECRET.finditer(text) if _mixed(m[0])]
    weak_ids, weak_secrets = ([s for s in spans if not taken.meets(*s[:2])] for spans in (weak_ids, weak_secrets))
    endpoints = [(*m.span(), "endpoint") for m in _ENDPOINT.finditer(text)]
    if not weak_ids and not weak_secrets and not endpoints:
        return []
    strong_secrets = [s for s in base if s[2] != "access"]
    cuts = [0, *(m.start() for m in _BLANK.finditer(text)), len(text) + 1]

    def near(part: Span, others: Intervals) -> bool:
        k = bisect_right(cuts, part[0]) - 1
        lo, hi = cuts[k], cuts[k + 1]
        if reach is not None:
            lo, hi = max(lo, part[0] - reach), min(hi, part[1] + reach)
        return others.meets(lo, hi)

    ids, secrets, places = map(Intervals, (strong_ids + weak_ids, strong_secrets + weak_secrets, endpoints))
    sure_ids, sure_secrets, maybe_ids, maybe_secrets = map(Intervals, (strong_ids, strong_secrets, weak_ids, weak_secrets))
    out = [s for s in weak_ids if near(s, sure_secrets) or near(s, maybe_secrets) and near(s, places)]
    out += [s for s in weak_secrets if near(s, sure_ids) or near(s, maybe_ids) and near(s, places)]
    out += [s for s in endpoints if near(s, ids) and near(s, secrets)]
    return out


def _scan(reach: int | None):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part, rows = batch.slice(i, 1024), []
                for text in part.column(1):
                    text = text.as_py() or ""
                    base = base_spans(text)
                    weak = linked_spans(text, base, reach)
                    rows.append([{"kind": k, "start": a, "end": b, "base": k in KINDS[:3]} for a, b, k in (_sorted(base + weak) if weak else base)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["id", "spans"])

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = None) -> DataFrame:
    """One row per row of docs: <id_col>, spans array of (kind, start, end, base), by start, kind and end, in code points.

    Null texts count as empty and have no spans. Rows that repeat are each scanned. Other columns are not read.
    """
    has_columns(docs, (id_col, text_col))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spans = "array<struct<kind:string,start:int,end:int,base:boolean>>"
    return src.transform(in_arrow(_scan(reach), f"id {src.schema['id'].dataType.simpleString()}, spans {spans}")).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and hashes of spans, as flat columns."""
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        id_col,
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(listed(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )

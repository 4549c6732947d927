"""Canonical JSON and receipt hashes, on the driver and as columns.

Canonical JSON has sorted keys, no blanks and ASCII escapes. The JVM's to_json of a variant gives the same text for lines
of printable ASCII without backslashes, real numbers, very long integers or repeated keys; only other lines reach the
Arrow function, which is exact for all.
"""

from __future__ import annotations

import hashlib
import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


_COMPACT = {"separators": (",", ":"), "sort_keys": True}


def canonical_json(value: object, default=None) -> str:
    return json.dumps(value, default=default, **_COMPACT)


def canonical_cbor(value: object) -> bytes:
    """Deterministic CBOR (RFC 8949, 4.2): shortest heads, map keys in the order of their bytes, doubles as they are."""

    def head(major: int, n: int) -> bytes:
        if n < 24:
            return bytes([major << 5 | n])
        size = next(k for k in range(4) if n < 1 << (8 << k))
        return bytes([major << 5 | 24 + size]) + n.to_bytes(1 << size, "big")

    if value is None or isinstance(value, bool):
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[value]
    if isinstance(value, int):
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, str):
        return head(3, len(value.encode())) + value.encode()
    if isinstance(value, bytes):
        return head(2, len(value)) + value
    if isinstance(value, dict):
        pairs = sorted((canonical_cbor(k), canonical_cbor(v)) for k, v in value.items())
        return head(5, len(pairs)) + b"".join(k + v for k, v in pairs)
    return head(4, len(value)) + b"".join(map(canonical_cbor, value))


def receipt_hash(payload: dict, prev: str) -> str:
    return hashlib.sha256(canonical_json({"payload": payload, "prev_receipt_hash": prev}).encode()).hexdigest()


def entry_hash(event_type: str, payload: dict, prev: str) -> str:
    """Hash of an ingest-ledger entry; values that JSON has no form for count as their text."""
    covered = canonical_json(dict(event_type=event_type, prev_hash=prev, payload=payload), default=str)
    return hashlib.sha256(covered.encode()).hexdigest()


def part_of_line(line: str | None, key: str) -> str | None:
    """Canonical JSON of one member of a line's object ('{}' if it lacks it); null unless the line is a JSON object."""
    try:
        record = json.loads(line) if line is not None else None
    except ValueError:
        return None
    return canonical_json(record.get(key, {})) if isinstance(record, dict) else None


@F.pandas_udf(T.StringType())
def _payload_of(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: part_of_line(x, "payload"))


def plain_line(line: Column) -> Column:
    """Whether the JVM's JSON text is known to be the canonical one."""
    real, long = r'("\s*:|[\[,])\s*-?[0-9]+[.eE]', "[0-9]{18,}"
    return line.rlike(r"^[\x20-\x7E]*$") & ~line.contains("\\") & ~line.rlike(real) & ~line.rlike(long)


def canonical_payload(line: Column) -> Column:
    """Canonical JSON of the `payload` of a ledger line; null for lines that are no JSON object."""
    parsed = F.try_parse_json(line)
    fast = plain_line(line) & parsed.isNotNull() & F.try_variant_get(parsed, "$.payload", "variant").isNotNull()
    native = F.when(fast, F.to_json(F.variant_get(parsed, "$.payload", "variant")))
    return F.coalesce(native, _payload_of(F.when(fast, F.lit(None).cast("string")).otherwise(line)))


def json_text(value: Column) -> Column:
    """A string as canonical JSON has it, for values of printable ASCII."""
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))


def receipt_hash_column(payload_json: Column, prev: Column) -> Column:
    """Receipt hash of a canonical payload and the previous hash."""
    return F.sha2(F.concat(F.lit('{"payload":'), payload_json, F.lit(',"prev_receipt_hash":'), json_text(prev), F.lit("}")), 256)

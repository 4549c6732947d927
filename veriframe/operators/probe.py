"""Capability probe: the access tier that a model allows, the task that annotations show, the reference there is."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path
from urllib.parse import urlparse

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import has_box, has_polygon
from ..sources import profile as profiles
from .gate import RANK, Matrix

log = logging.getLogger(__name__)
LOGIT_WORDS = "confidence logit logits prob probabilities score scores".split()
WEIGHT_WORDS = "parameters state_dict tensors weights".split()
MAX_HEADER = 100_000_000
Tier = tuple[str, str | None, dict, str | None]


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def model_spec(model: str | Path | None) -> str | None:
    """A model's path or URL as text; a URL that went through Path gets its second slash back."""
    text = str(model or "").strip()
    if isinstance(model, Path):
        for scheme in ("https:/", "http:/"):
            if text.startswith(scheme) and not text.startswith(scheme + "/"):
                text = scheme + "/" + text[len(scheme) :]
                break
    return text or None


def is_url(spec: str) -> bool:
    parsed = urlparse(spec)
    return bool(parsed.scheme.lower() in ("http", "https") and parsed.netloc) or spec.startswith("//")


def url_column(spec: Column) -> Column:
    return spec.rlike("^(?i:https?)://[^/?#]") | spec.startswith("//")


def spec_column(path: Column) -> Column:
    return F.regexp_replace(F.trim(path), "^(https?):/(?!/)", "$1://")


def access_tier(spec: str | None) -> Tier:
    """(tier, source, details, digest)."""
    if not spec:
        return "T0", "unknown", {"reason": "NO_MODEL"}, None
    if is_url(spec):
        return "T1", "remote_api", {"endpoint": spec, "reason": "API_ENDPOINT"}, None
    path = Path(spec).expanduser()
    if not path.is_file():
        return "T0", "unknown", {"reason": "NOT_A_FILE" if path.exists() else "MISSING_MODEL"}, None
    kind = path.suffix.lower()
    if kind in _DESCRIPTORS:
        tier, details = descriptor_tier(path)
        source = "remote_api" if RANK[tier] < RANK["T2"] else "local_file"
    else:
        source = "local_file"
        tier, details = weights_tier(path) if kind in _FORMATS else ("T0", {"reason": "UNSUPPORTED_ARTIFACT", "suffix": kind})
    return tier, source, details, _digest(path)


def _digest(path: Path) -> str | None:
    try:
        return profiles.file_digest(str(path))
    except OSError as e:
        log.warning("%s can't be hashed: %s", path, e)
        return None


def descriptor_tier(path: Path) -> tuple[str, dict]:
    """Tier of an API's description: words of weights anywhere in it, then of logits, then an endpoint."""
    try:
        with open(path, encoding="utf-8") as f:
            found = _DESCRIPTORS[path.suffix.lower()](f)
    except (OSError, ValueError, yaml.YAMLError) as e:
        return "T0", {"reason": "API_DESCRIPTOR_UNREADABLE", "problem": str(e)}
    if not isinstance(found, dict):
        return "T0", {"reason": "API_DESCRIPTOR_NOT_AN_OBJECT"}
    tier, reason = tier_of_text(json.dumps(found, default=str))
    address = next((found[k] for k in ("endpoint", "url", "api") if found.get(k)), None)
    if tier == "T0" and isinstance(address, str) and is_url(address):
        tier, reason = "T1", "API_ENDPOINT"
    return tier, {"descriptor": str(path), "reason": reason}


def tier_of_text(text: str) -> tuple[str, str]:
    low = text.lower()
    ranked = (("T2", "API_RETURNS_WEIGHTS", WEIGHT_WORDS), ("T1", "API_RETURNS_LOGITS", LOGIT_WORDS))
    return next(((tier, reason) for tier, reason, words in ranked if any(w in low for w in words)), ("T0", "API_LABELS_ONLY"))


def descriptor_tier_column(text: Column) -> Column:
    """The same over a column of descriptors' JSON, endpoints included."""
    low = F.lower(text)
    some = lambda words: low.rlike("|".join(words))
    at = lambda key: F.nullif(F.get_json_object(text, f"$.{key}"), F.lit(""))
    endpoint = F.coalesce(url_column(F.coalesce(at("endpoint"), at("url"), at("api"))), F.lit(False))
    return F.when(some(WEIGHT_WORDS), "T2").when(some(LOGIT_WORDS) | endpoint, "T1").otherwise("T0")


@dataclass
class Artifact:
    """What a weight file shows: whether its weights can be read, the names of its outputs, and details."""

    readable: bool
    outputs: list[str]
    details: dict


def weights_tier(path: Path) -> tuple[str, dict]:
    try:
        seen = _FORMATS[path.suffix.lower()](path)
    except OSError as e:
        seen = Artifact(False, [], {"problem": str(e)})
    if seen.readable:
        return "T2", {"reason": "WEIGHTS_READABLE", **seen.details}
    rich = any(w in name.lower() for name in seen.outputs for w in LOGIT_WORDS)
    return ("T1", {"reason": "ONNX_LOGITS_WITHOUT_WEIGHTS", **seen.details}) if rich else ("T0", {"reason": "WEIGHTS_UNREADABLE", **seen.details})


def _runtime_outputs(path: str) -> list[str]:
    """Output names by the ONNX runtime; none if it doesn't take the file."""
    try:
        import onnxruntime

        return [x.name for x in onnxruntime.InferenceSession(path, None, ["CPUExecutionProvider"]).get_outputs()]
    except Exception:  # any failure means that nothing can be said
        return []


def _graph(path: str):
    import onnx

    return onnx.load(path).graph


def onnx_artifact(path: Path) -> Artifact:
    """Readable with initialisers; where the ONNX library is missing, if it isn't empty."""
    try:
        graph = _graph(str(path))
    except ImportError:
        return Artifact(path.stat().st_size > 0, _runtime_outputs(str(path)), {"parsed": False})
    except Exception as e:  # whatever the parser raises, the probe goes on
        return Artifact(False, _runtime_outputs(str(path)), {"problem": str(e)})
    return Artifact(len(graph.initializer) > 0, [x.name for x in graph.output], {"initializers": len(graph.initializer)})


def torch_artifact(path: Path) -> Artifact:
    """Readable if it begins as a zip or as a pickle of protocol 2 to 5."""
    with open(path, "rb") as f:
        head = f.read(2)
    container = "zip" if head == b"PK" else "pickle" if head[:1] == b"\x80" and head[1:] in (b"\2", b"\3", b"\4", b"\5") else "unknown"
    return Artifact(container != "unknown", [], {"container": container})


def safetensors_artifact(path: Path) -> Artifact:
    """Readable if its header, of a length that comes first, is a JSON object with a tensor."""

    def broken(why: str) -> Artifact:
        return Artifact(False, [], {"problem": why})

    with open(path, "rb") as f:
        size = f.read(8)
        n = int.from_bytes(size, "little")
        if len(size) < 8 or not 0 < n <= MAX_HEADER:
            return broken("no header length")
        try:
            header = json.loads(f.read(n))
        except ValueError as e:
            return broken(f"no JSON header: {e}")
    if not isinstance(header, dict):
        return broken("the header is no object")
    tensors = [k for k, v in header.items() if isinstance(v, dict) and k != "__metadata__"]
    return Artifact(bool(tensors), [], {"tensors": len(tensors)})


_DESCRIPTORS = {".json": json.load, ".yaml": yaml.safe_load, ".yml": yaml.safe_load}
_FORMATS = {".onnx": onnx_artifact, ".pt": torch_artifact, ".pth": torch_artifact, ".safetensors": safetensors_artifact}


def torch_container_column(content: Column) -> Column:
    """zip, pickle or unknown by the first bytes of a binary column."""
    head = F.hex(F.substring(content, 1, 2))
    return F.when(head == "504B", "zip").when(head.isin("8002", "8003", "8004", "8005"), "pickle").otherwise("unknown")


def task_type(assets: DataFrame) -> DataFrame:
    """One row (task_type, reason, boxes_present) over all annotations: polygons before boxes before neither."""
    found = assets.agg(
        F.coalesce(F.bool_or(F.exists("annotations", lambda a: has_polygon(a["segmentation"]))), F.lit(False)).alias("polygons"),
        F.coalesce(F.bool_or(F.exists("annotations", lambda a: has_box(a["bbox"]))), F.lit(False)).alias("boxes"),
    )
    task = F.when(F.col("polygons"), "SEGMENTATION").when(F.col("boxes"), "DETECTION").otherwise("CLASSIFICATION")
    reason = F.when(F.col("polygons"), "SEGMENTATION_POLYGONS_PRESENT").when(F.col("boxes"), "BBOX_XYWH_PRESENT").otherwise("NO_BOXES_OR_POLYGONS")
    return found.select(task.alias("task_type"), reason.alias("reason"), F.col("boxes").alias("boxes_present"))


def cohort(assets: DataFrame) -> DataFrame:
    """One row (asset_count, contributor_ids sorted, contributor_count without empty ones)."""
    ids = F.col("contributor_id")
    return assets.agg(
        F.count(F.lit(1)).alias("asset_count"), F.sort_array(F.collect_set(ids)).alias("contributor_ids"), F.count_distinct(F.when(ids != "", ids)).alias("contributor_count")
    )


def reference_mode(profile_path: str | None, contributors: int, default_key_path: str | None = None) -> tuple[str, str | None, dict]:
    """(mode, profile digest, details): a profile that verifies, else one to bootstrap from or any contributor, else none."""
    path = Path(profile_path).expanduser() if profile_path else None
    known = path is not None and path.is_file()
    details: dict = {"profile": str(path)} if known else {}
    digest = profiles.file_digest(str(path)) if known else None
    if known and profiles.is_attested(str(path), default_key_path=default_key_path):
        return "ATTESTED", digest, details | {"reason": "ATTESTATION_VALID"}
    if contributors or known and profiles.is_bootstrap(str(path)):
        reason = "PROFILE_UNSIGNED_BOOTSTRAP_FROM_COHORTS" if known else "BOOTSTRAPPED_FROM_CONTRIBUTOR_COHORTS"
        return "BOOTSTRAPPED", digest, details | {"contributor_count": contributors, "reason": reason}
    return "UNREFERENCED", digest, details | {"reason": "PROFILE_PRESENT_BUT_NOT_ATTESTED_OR_BOOTSTRAPPABLE" if known else "NO_REFERENCE_PROFILE"}


def probe(assets: DataFrame, model: str | Path | None = None, profile_path: str | None = None, default_key_path: str | None = None) -> Matrix:
    tier, source, tier_details, digest = access_tier(model_spec(model))
    task, members = task_type(assets).first(), cohort(assets).first()
    mode, profile_digest, ref_details = reference_mode(profile_path, members["contributor_count"], default_key_path)
    task_details = {"reason": task["reason"]} | ({"boxes_present": task["boxes_present"]} if task["task_type"] == "SEGMENTATION" else {})
    details = {
        "tier": tier_details, "task": task_details, "reference": ref_details, "asset_count": members["asset_count"],
        "contributor_ids": list(members["contributor_ids"])
    }
    return Matrix(tier, task["task_type"], mode, digest, profile_digest, now(), source, details)


def inspect_file(path: str) -> Matrix:
    """The older file probe: weights by the initializers, logits by the outputs' names, T0 without reference on any failure."""
    try:
        weights = len(_graph(path).initializer)
    except Exception as e:
        log.warning("%s can't be inspected, so it counts as T0: %s", path, e)
        return Matrix("T0", reference_mode="UNREFERENCED", source="local_file", probe_timestamp=now())
    outputs = _runtime_outputs(path)
    rich = any(w in n.lower() for n in outputs for w in ("logit", "raw", "embedding", "feature"))
    tier = "T2" if weights else "T1" if rich else "T0"
    return Matrix(tier, source="local_file", probe_timestamp=now(), metadata={"output_nodes": outputs, "num_initializers": weights})


def inspect_api(call: Callable[[object], dict], sample: object) -> Matrix:
    """The older API probe: by the exact keys of one reply."""
    try:
        keys = list(call(sample).keys())
    except Exception as e:
        log.warning("the API can't be probed, so it counts as T0: %s", e)
        return Matrix("T0", reference_mode="UNREFERENCED", source="remote_api", probe_timestamp=now())
    low = {k.lower() for k in keys}
    tier = "T2" if low & {"weights", "state_dict", "parameters"} else "T1" if low & {"logits", "confidence", "probabilities", "scores"} else "T0"
    return Matrix(tier, source="remote_api", probe_timestamp=now(), metadata={"raw_response_keys": keys})

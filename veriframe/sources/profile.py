"""Reference profiles: YAML or JSON documents, signed inline or by a detached file beside them."""

from __future__ import annotations

import copy
import hashlib
import json
from pathlib import Path

import yaml

from ..functions import ed25519
from ..functions.canonical import canonical_json

BOOTSTRAP_WORDS = {"bootstrap", "bootstrapped", "scaffold"}


def load_profile(path: str) -> dict:
    """The document; ValueError unless it is a mapping."""
    parse = json.load if path.lower().endswith(".json") else yaml.safe_load
    with open(path, encoding="utf-8") as f:
        found = parse(f)
    if isinstance(found, dict):
        return found
    raise ValueError(f"{path} is no mapping")


def signed_text(profile: dict) -> str:
    """Canonical JSON of what a signature covers: all but the signature itself."""
    bare = copy.deepcopy(profile)
    if isinstance(bare.get("attestation"), dict):
        bare["attestation"].pop("signature", None)
    return canonical_json(bare, default=str)


def is_attested(path: str, public_key_path: str | None = None, default_key_path: str | None = None) -> bool:
    """Whether the profile has a valid signature by the key given, the one it names (relative to itself too), or the default."""
    p = Path(path)
    if not p.is_file():
        return False
    profile = load_profile(path)
    claim = profile.get("attestation")
    claim = claim if isinstance(claim, dict) else {}
    signature, detached = claim.get("signature"), p.with_name(p.name + ".sig")
    if not signature and detached.is_file():
        signature = detached.read_text("utf-8").strip()
    named = public_key_path or claim.get("public_key_path") or claim.get("public_key") or default_key_path
    if not signature or not named:
        return False
    key = Path(str(named))
    key = key if key.is_file() else p.parent / key
    if not key.is_file():
        return False
    try:
        pub = ed25519.load_public(key.read_bytes())
    except ValueError:
        return False
    return ed25519.verify_hex(pub, signed_text(profile), str(signature))


def is_bootstrap(path: str) -> bool:
    try:
        profile = load_profile(path)
    except (OSError, ValueError, yaml.YAMLError):
        return False
    word = next((profile[k] for k in ("status", "mode") if profile.get(k)), "")
    marks = [profile.get(k) for k in ("bootstrap", "cohorts", "contributor_cohorts")]
    clean = profile.get("clean_set")
    return str(word).lower() in BOOTSTRAP_WORDS or any(marks) or isinstance(clean, list) and len(clean) > 0


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()

"""Canonical JSON of small documents: keys sorted by code point, no white space, integers only."""

from __future__ import annotations

import hashlib
import json
from typing import Any


def _check(value: Any) -> None:
    if isinstance(value, float):
        raise ValueError("signed documents hold no floats")
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise ValueError("keys must be text")
        for v in value.values():
            _check(v)
    elif isinstance(value, (list, tuple)):
        for v in value:
            _check(v)
    elif not (value is None or isinstance(value, (str, int))):
        raise ValueError(f"no canonical form for {type(value).__name__}")


def canonical_bytes(document: Any) -> bytes:
    _check(document)
    return json.dumps(document, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()


def body(document: dict[str, Any]) -> dict[str, Any]:
    """The document without its signature."""
    return {k: v for k, v in document.items() if k != "signature"}


def body_hash(document: dict[str, Any]) -> str:
    return hashlib.sha256(canonical_bytes(body(document))).hexdigest()

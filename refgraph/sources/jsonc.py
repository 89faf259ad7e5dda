"""JSON with comments and trailing commas, as configuration files have it. Everything else is strict."""

from __future__ import annotations

import json
import re

# A string, or what goes: comments, and a comma that only space and comments part from a closing bracket.
_PARTS = re.compile(r'("(?:[^"\\]|\\.)*")|(//[^\n]*|/\*.*?\*/)', re.S)
_COMMA = re.compile(r'("(?:[^"\\]|\\.)*"|[\[{,]\s*,)|,(?=\s*[}\]])', re.S)


def loads(text: str) -> object:
    text = text.removeprefix("﻿")
    bare = _PARTS.sub(lambda m: m[1] or " ", text)
    if "/*" in _PARTS.sub("", text):
        raise ValueError("open comment")
    return json.loads(_COMMA.sub(lambda m: m[1] or "", bare))


def field(value: object, *keys: str) -> object:
    """The value under keys, or None where an object is missing."""
    for key in keys:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def strings(value: object) -> list[str]:
    """The strings of an array; nothing for other values."""
    return [v for v in value if isinstance(v, str)] if isinstance(value, list) else []


def required_strings(value: object, name: str) -> list[str]:
    """The strings of an array that may be missing, but not hold anything else."""
    if value is None:
        return []
    if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
        raise ValueError(f"{name} must be an array of strings")
    return list(value)

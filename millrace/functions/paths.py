"""Where a value lies in nested JSON."""

from __future__ import annotations

import json
import re

_PLAIN = re.compile(r"[A-Za-z_]\w*", re.ASCII)


def step(key: object) -> str:
    """A key's part of a path: names after a dot, other keys quoted in brackets."""
    name = str(key)
    return "." + name if _PLAIN.fullmatch(name) else "[" + json.dumps(name, ensure_ascii=False) + "]"


def parsed(text: str | None) -> object | None:
    """The value of a JSON text; None for broken JSON and for nesting beyond what the parser takes (some thousands)."""
    try:
        return json.loads(text or "")
    except (ValueError, RecursionError):
        return None

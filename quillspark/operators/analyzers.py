"""Analyzers by name: functions from a text to the record that is stored for a file. New ones are registered, nothing else changes."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable

from . import notations

Analyzer = Callable[[str], dict]
_KNOWN: dict[str, Analyzer] = {}

#: How structure is counted, and how many headers a record keeps.
_HEADER = re.compile(r"^(#{1,6})\s+(.*)$", re.M)
_CODE = re.compile(r"^```(\S*)\s*\n(.*?)^```", re.M | re.S)
_BULLET = re.compile(r"^\s*[-*+]\s+", re.M)
_LINK = re.compile(r"\[[^\]]+\]\([^)]+\)")
HEADERS = 50


def register(name: str) -> Callable[[Analyzer], Analyzer]:
    """Put an analyzer under a name; one that is taken is an error."""

    def put(analyze: Analyzer) -> Analyzer:
        if name in _KNOWN:
            raise ValueError(f"analyzer {name} is registered already")
        _KNOWN[name] = analyze
        return analyze

    return put


def names() -> list[str]:
    return sorted(_KNOWN)


def analyze(name: str, text: str) -> str:
    """The record as JSON."""
    if name not in _KNOWN:
        raise KeyError(f"no analyzer {name}; there are {', '.join(names())}")
    return json.dumps(_KNOWN[name](text), ensure_ascii=False)


@register("structure")
def structure(text: str) -> dict:
    headers = _HEADER.findall(text)
    labels = [label.lower() or "(untagged)" for label, _ in _CODE.findall(text)]
    return {
        "line_count": len(text.splitlines()),
        "word_count": len(text.split()),
        "char_count": len(text),
        "header_count": len(headers),
        "max_header_depth": max((len(marks) for marks, _ in headers), default=0),
        "headers": [title.strip() for _, title in headers[:HEADERS]],
        "code_block_count": len(labels),
        "code_block_languages": dict(Counter(labels)),
        "bullet_count": len(_BULLET.findall(text)),
        "link_count": len(_LINK.findall(text)),
    }


@register("notation")
def notation(text: str) -> dict:
    """All detections are counted; the first ones are kept whole."""
    found = notations.parse(text)["detections"]
    summary: dict[str, dict] = {}
    for d in found:
        own = summary.setdefault(d["id"], {"count": 0, "confidences": set(), "subtypes": set()})
        own["count"] += 1
        own["confidences"].add(d["confidence"])
        own["subtypes"].update([d["subtype"]] if d["subtype"] else [])
    return {
        "any_notation_detected": bool(found),
        "notation_count_total": len(found),
        "notations_summary": {k: v | {"confidences": sorted(v["confidences"]), "subtypes": sorted(v["subtypes"])} for k, v in summary.items()},
        "detections": [{"notation_id": d["id"], "notation_name": d["name"], "subtype": d["subtype"], "confidence": d["confidence"], "detected_via": d["via"], "snippet": d["snippet"], "structure": d["shape"]} for d in found[: notations.DETECTIONS]],
    }

"""Files that import shared instructions and add their own: what is left beside the imports, and labelled sections after them."""

from __future__ import annotations

import re
from collections import Counter

from .imports import CANDIDATE, import_tokens, target_name
from .markdown import headings

# Names, words and cues.
TARGET = "agents.md"
WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_COMMENT = re.compile(r"<!--.*?(?:-->|$)", re.S)
MAX_HEADING = 160
_NAMED = re.compile(r"(?<![\w./-])claude(?:[\s-]+code\b|-(?:specific|only)\b|(?!-[a-z])\b)", re.I)
_SPECIFIC = r"specific|only|additional|additions?|addenda?|adapter|override|orchestration"
_LABEL = re.compile(rf"\b(?:{_SPECIFIC}|instructions?|guidance|guidelines?|notes?|rules?|workflow|working\s+agreements?|configuration|settings?|preferences?|commands?|tips?|behavio[u]?r|context|memory)\b", re.I)
_KINDS = [
    ("explicit_specificity_or_adapter", re.compile(rf"\b(?:{_SPECIFIC})\b", re.I)),
    ("instruction_or_workflow", re.compile(r"\b(?:instructions?|guidance|guidelines?|rules?|workflow|working\s+agreements?|commands?|behavio[u]?r|preferences?)\b", re.I)),
]
_DIRECTIVE = re.compile(r"\b(?:must|should|always|never|use|run|prefer|avoid|ensure|keep|do\s+not|don't|ask|invoke|read|write|start|before|after|when|if|only|require|required|dispatch|delegate|perform|append|treat|follow|call|update|verify|check)\b", re.I)
_BOILERPLATE = re.compile(r"(?im)^[ \t]*This file provides guidance to Claude Code \(claude\.ai/code\) when working with (?:code in )?this repository\.?[ \t]*$")
_PLACEHOLDER = [
    re.compile(p)
    for p in (
        r"(?is)^\s*[_*(]*\s*none(?:\s+yet)?\b",
        r"(?i)\bno\s+(?:claude(?:\s+code)?[- ]specific|claude[- ]only|specific)\s+instructions?\b",
        r"(?i)\bkeep\s+this\s+section\s+empty\s+unless\b",
        r"(?i)\badd\s+(?:only\s+)?claude(?:\s+code)?[- ]specific\s+(?:guidance|instructions?|notes?)\s+here\b",
        r"(?i)\breserved\s+for\s+claude(?:\s+code)?\b",
    )
]
_THEMES = {
    name: re.compile(p, re.I)
    for name, p in {
        "plan_mode": r"\bplan mode\b",
        "skills_or_slash_commands": r"\bskills?\b|(?<!\w)/(?:[a-z][\w-]+)",
        "hooks": r"\bhooks?\b",
        "subagents_or_delegation": r"\bsub-?agents?\b|\bdelegat(?:e|es|ed|ing|ion)\b",
        "mcp": r"\bMCP\b",
        "model_selection": r"\b(?:opus|sonnet|haiku|model)\b",
        "claude_configuration_paths": r"(?:\.claude/|CLAUDE\.local\.md|settings\.json)",
        "review_commit_or_pull_request": r"\b(?:review|commit|pull request|PR)\b",
        "permissions_or_safety": r"\b(?:permission|sandbox|destructive|safety|safe|approval)\b",
    }.items()
}
_EDGE = "\ufeff \t\r\n"

SECTION = "heading:string,name:string,level:int,line:int,label:string,words:int,own_words:int,directive:int,placeholder:int,concrete:int,themes:array<string>,excerpt:string"
OVERLAY = f"struct<imports:int,literal:int,forms:array<struct<token:string,n:int>>,strict:int,comments_only:int,residual_words:int,words_after:int,excerpt:string,sections:array<struct<{SECTION}>>>"


def without_spans(text: str, spans: list[tuple[int, int]], at: int = 0) -> str:
    """text, which begins at position ``at`` of the whole, without the given spans of the whole."""
    kept, place = [], 0
    for a, b in sorted(spans):
        a, b = max(a - at, place), min(b - at, len(text))
        if a < b:
            kept.append(text[place:a])
            place = b
    return "".join([*kept, text[place:]])


def masked(text: str) -> str:
    """Comments as blanks, line ends kept; an unclosed comment runs to the end."""
    return _COMMENT.sub(lambda m: re.sub(r"[^\r\n]", " ", m[0]), text)


def excerpt(text: str, limit: int = 500) -> str:
    one = re.sub(r"\s+", " ", text).strip()
    return one if len(one) <= limit else one[: limit - 1].rstrip() + "…"


def is_labelled(name: str) -> bool:
    return len(name) <= MAX_HEADING and bool(_NAMED.search(name) and _LABEL.search(name))


def label_kind(name: str) -> str:
    return next((kind for kind, p in _KINDS if p.search(name)), "notes_configuration_or_context")


def analyze(text: str, minimum_words: int = 3, limit: int = 500) -> dict | None:
    """See OVERLAY; None if the file has no active import of the target."""
    if minimum_words <= 0 or limit <= 0:
        raise ValueError("minimum_words and limit must be positive")
    found = [t for t in import_tokens(text) if t["decision"] == CANDIDATE and target_name(t["target"]).casefold() == TARGET]
    if not found:
        return None
    spans, last = [(t["start"], t["end"]) for t in found], max(t["end"] for t in found)
    rest = without_spans(text, spans)
    shown = masked(rest)
    starts, at = [], 0
    for line in text.splitlines(keepends=True):
        starts.append(at)
        at += len(line)
    begin = lambda n: starts[n] if n < len(starts) else len(text)
    heads, sections = headings(masked(text)), []
    for k, h in enumerate(heads):
        if not is_labelled(h["name"]) or begin(h["first_line"]) <= last:
            continue
        a = begin(h["last_line"] + 1)
        b = next((begin(x["first_line"]) for x in heads[k + 1 :] if x["level"] <= h["level"]), len(text))
        body = masked(without_spans(text[a:b], spans, a))
        own = _BOILERPLATE.sub(" ", body)
        n, directive, empty = len(WORD.findall(own)), bool(_DIRECTIVE.search(own)), any(p.search(own) for p in _PLACEHOLDER)
        sections.append(
            {
                "heading": h["text"],
                "name": h["name"],
                "level": h["level"],
                "line": h["first_line"] + 1,
                "label": label_kind(h["name"]),
                "words": len(WORD.findall(body)),
                "own_words": n,
                "directive": int(directive),
                "placeholder": int(empty),
                "concrete": int(n >= minimum_words and directive and not empty),
                "themes": [name for name, p in _THEMES.items() if p.search(own)],
                "excerpt": excerpt(body, limit),
            }
        )
    return {
        "imports": len(found),
        "literal": sum(t["token"] == "@AGENTS.md" for t in found),
        "forms": [{"token": k, "n": n} for k, n in sorted(Counter(t["token"] for t in found).items())],
        "strict": int(not rest.strip(_EDGE)),
        "comments_only": int(not shown.strip(_EDGE)),
        "residual_words": len(WORD.findall(shown)),
        "words_after": len(WORD.findall(masked(text[last:]))),
        "excerpt": excerpt(shown, limit),
        "sections": sections,
    }

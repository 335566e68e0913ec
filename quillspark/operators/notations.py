"""Diagrams and schemas written as text: detection by fence label, pattern or boundary mark, driven by a catalogue."""

from __future__ import annotations

import re

_BLOCK = re.compile(r"^```(\S*)[ \t]*\n(.*?)^```", re.M | re.S)
SNIPPET, DETECTIONS, EDGES = 600, 30, 100

#: The catalogue. boundary_markers stand around a block outside fences, subtype_markers in its first lines; untagged_heuristics are of blocks whose label names no notation.
CATALOGUE = [
    {
        "id": "mermaid",
        "name": "Mermaid",
        "fence_languages": ["mermaid"],
        "subtype_markers": {"flowchart": ["graph ", "graph;", "flowchart "], "sequence": ["sequenceDiagram"], "state": ["stateDiagram"], "class": ["classDiagram"], "er": ["erDiagram"], "gantt": ["gantt"], "journey": ["journey"], "pie": ["pie "]},
        "untagged_heuristics": ["sequenceDiagram", "classDiagram", "stateDiagram", "erDiagram"],
    },
    {
        "id": "plantuml",
        "name": "PlantUML",
        "fence_languages": ["plantuml", "puml", "uml"],
        "boundary_markers": ["@startuml", "@enduml"],
        "subtype_markers": {"sequence": ["participant ", "actor "], "class": ["class ", "interface "], "state": ["state "], "usecase": ["usecase "]},
        "untagged_heuristics": ["@startuml"],
    },
    {"id": "graphviz", "name": "Graphviz / DOT", "fence_languages": ["dot", "graphviz"], "subtype_markers": {"directed": ["digraph"], "undirected": ["graph "]}, "untagged_heuristics": ["digraph ", "digraph{", "rankdir="]},
    {"id": "d2", "name": "D2", "fence_languages": ["d2"]},
    {"id": "ascii_diagram", "name": "ASCII / box-drawing diagram", "fence_languages": ["ascii", "asciiart"], "untagged_heuristics": ["[┌┐└┘├┤┬┴┼─│]", "\\+[-]{2,}\\+", "<-{2,}>|-{2,}>|<-{2,}"]},
    {"id": "bnf_ebnf", "name": "BNF / EBNF grammar", "fence_languages": ["bnf", "ebnf", "abnf"], "untagged_heuristics": ["::="]},
    {"id": "regex_dsl", "name": "Regular expression listing", "fence_languages": ["regex", "regexp"]},
    {"id": "json_schema", "name": "JSON Schema", "fence_languages": ["json"], "untagged_heuristics": ['"$schema"', '"type": "object"', '"properties":']},
    {"id": "yaml_schema", "name": "YAML-defined schema/spec", "fence_languages": ["yaml", "yml"], "untagged_heuristics": ["openapi:", "swagger:", "$schema:"]},
]

# How relations and rules look.
_ARROW = re.compile(r"([A-Za-z0-9_\"'.]+)\s*(?:-{1,3}>{0,1}>?|\.{2,3}>|<\|--|--\|>|<-{1,3})\s*(?:\|[^|]*\|)?\s*([A-Za-z0-9_\"'.]+)")
_MESSAGE = re.compile(r"^\s*([\w\"'.]+)\s*-{1,2}>{1,2}\s*([\w\"'.]+)\s*:\s*(.+)$")
_TRANSITION = re.compile(r"^\s*([\w\[\]*]+)\s*-->\s*([\w\[\]*]+)\s*(?::\s*(.+))?$")
_PRODUCTION = re.compile(r"^\s*<?([\w-]+)>?\s*::=\s*(.+)$")
_CLASS = re.compile(r"^\s*class\s+(\w+)", re.M)

SHAPE = "struct<kind:string,nodes:int,edges:int,pairs:array<array<string>>>"
DETECTION = f"id string, name string, subtype string, confidence string, via string, snippet string, shape {SHAPE}"
DETECTED = f"struct<total:int,detections:array<struct<{DETECTION.replace(' string', ':string').replace('shape ', 'shape:')}>>>"


def blocks(text: str) -> list[tuple[str, str]]:
    """(label, body) of backtick fences at the start of a line."""
    return _BLOCK.findall(text)


def arrows(body: str) -> dict:
    """The first relation of each line, and how many names they join."""
    pairs = [[m[1].strip("\"'"), m[2].strip("\"'")] for m in map(_ARROW.search, body.splitlines()) if m]
    return {"kind": "relations", "nodes": len({x for p in pairs for x in p}), "edges": len(pairs), "pairs": pairs[:EDGES]}


def shape(notation: str, subtype: str | None, body: str) -> dict:
    """Nodes and edges of a block, as its notation writes them. Rules count as nodes of a grammar."""
    lines = body.splitlines()
    if notation == "bnf_ebnf":
        rules = [m[1] for m in map(_PRODUCTION.match, lines) if m]
        return {"kind": "rules", "nodes": len(rules), "edges": 0, "pairs": [[r] for r in rules[:EDGES]]}
    if notation == "mermaid" and subtype == "sequence":
        found = [[m[1], m[2], m[3].strip()] for m in map(_MESSAGE.match, lines) if m]
        return {"kind": "messages", "nodes": len({x for p in found for x in p[:2]}), "edges": len(found), "pairs": found[:EDGES]}
    if notation == "mermaid" and subtype == "state":
        found = [[m[1], m[2], (m[3] or "").strip()] for m in map(_TRANSITION.match, lines) if m]
        return {"kind": "transitions", "nodes": len({x for p in found for x in p[:2]}), "edges": len(found), "pairs": found[:EDGES]}
    if notation == "mermaid" and subtype == "class":
        names = sorted(set(_CLASS.findall(body)))
        return {"kind": "classes", "nodes": len(names), "edges": arrows(body)["edges"], "pairs": [[x] for x in names[:50]]}
    return arrows(body)


class Detector:
    def __init__(self, catalogue: list[dict] | None = None):
        self.catalogue = catalogue or CATALOGUE
        self.by_label = {x.lower(): n for n in self.catalogue for x in n.get("fence_languages", [])}
        self.tests = {n["id"]: [self._test(p) for p in n.get("untagged_heuristics", [])] for n in self.catalogue}

    @staticmethod
    def _test(pattern: str):
        try:
            return re.compile(pattern).search
        except re.error:  # a plain text then
            return lambda body: pattern in body

    def matching(self, body: str) -> list[dict]:
        return [n for n in self.catalogue if any(t(body) for t in self.tests[n["id"]])]

    def rules(self, notation: str, body: str) -> list[int]:
        """Numbers, from 1, of a notation's patterns that the body fulfils."""
        return [k for k, t in enumerate(self.tests[notation], 1) if t(body)]

    @staticmethod
    def subtype(notation: dict, body: str) -> str | None:
        head = "\n".join(body.strip().splitlines()[:3]).lower()
        return next((name for name, marks in notation.get("subtype_markers", {}).items() if any(m.lower() in head for m in marks)), None)

    def _found(self, notation: dict, body: str, confidence: str, via: str) -> dict:
        subtype, snippet = self.subtype(notation, body), body.strip()
        return {"id": notation["id"], "name": notation["name"], "subtype": subtype, "confidence": confidence, "via": via, "snippet": snippet[:SNIPPET] + "…" * (len(snippet) > SNIPPET), "shape": shape(notation["id"], subtype, body)}

    def detect(self, text: str) -> list[dict]:
        """Fenced blocks first, by label or else by pattern; then marked blocks that no detection of the same notation begins with."""
        out = []
        for label, body in blocks(text):
            if known := self.by_label.get(label.strip().lower()):
                out.append(self._found(known, body, "high", "fence_language"))
            else:
                out += [self._found(n, body, "medium", "untagged_heuristic") for n in self.matching(body)]
        for n in self.catalogue:
            if len(n.get("boundary_markers", [])) == 2:
                a, b = map(re.escape, n["boundary_markers"])
                for body in re.findall(f"{a}(.*?){b}", text, re.S):
                    head = body.strip()[:40]
                    if not any(d["id"] == n["id"] and d["snippet"].strip().startswith(head) for d in out):
                        out.append(self._found(n, body, "high", "boundary_marker"))
        return out


def parse(text: str, detector: Detector | None = None) -> dict:
    found = (detector or Detector()).detect(text)
    return {"total": len(found), "detections": found}


def first_directive(body: str) -> str:
    """The word that begins the first line that is neither blank nor a comment, letter case folded."""
    kept = [x for x in (line.strip() for line in body.splitlines()) if x and not x.startswith("%%")]
    if not kept:
        return "(empty/comment-only)"
    word = re.match(r"[A-Za-z][\w-]*", kept[0], re.A)
    return word[0].casefold() if word else "(other)"

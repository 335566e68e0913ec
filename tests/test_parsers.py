"""Document parsers on literal documents."""

import pytest

from quillspark.operators import forms, imports, markdown, notations, overlays, prose, references


# -- structure


def test_headings_of_both_kinds_but_not_in_fences():
    text = "# One\nwords\n## Two\na b\n~~~md\n# no\n~~~\n#### Four ##\nx\nUnder\n---\nlast words here\n"
    own = markdown.structure(text)
    assert [(h["level"], h["text"], h["first_line"]) for h in own["headings"]] == [(1, "One", 0), (2, "Two", 2), (4, "Four", 7), (2, "Under", 9)]
    assert (own["top_level_sections"], own["maximum_depth"], own["skipped_jumps"], own["h1_count"], own["starts_below_h1"]) == (1, 3, 1, 1, False)
    assert own["sections"][-1]["word_count"] == 3


def test_sections_without_a_first_level():
    own = markdown.structure("## A\nt\n## B\n")
    assert (own["top_level_sections"], own["maximum_depth"], own["starts_below_h1"], own["empty_sections"]) == (2, 1, True, 1)


@pytest.mark.parametrize(("text", "name"), [("3) `Build` steps:", "build steps"), ("1.2.3 Setup", "setup"), ("[Our *Plan*](x.md) &amp; more!", "our plan & more"), ("***", "(empty)"), ("iv. Fourth", "fourth"), ("Straße", "strasse")])
def test_heading_names(text, name):
    assert markdown.heading_name(text) == name


def body(text):
    own = markdown.section(text.splitlines())
    return own["style"], own["list_items"], own["ordered_items"], own["task_items"], own["list_lines"], own["prose_blocks"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("- a\n  more\n  - deeper\n2. b\n- [x] done\n", ("list_only", 4, 1, 1, 5, 0)),
        ("Intro\ngoes on\n- a\n", ("list_and_prose", 1, 0, 0, 1, 1)),
        ("```\n- code\n```\n|a|b|\n|-|-|\n", ("other_only", 0, 0, 0, 0, 0)),
        ("One\n\nTwo\nstill two\n", ("prose_only", 0, 0, 0, 0, 2)),
        ("- a\n\n  indented\n- b\nlazy\n", ("list_only", 2, 0, 0, 4, 0)),
        ("- a\n\nnot lazy\n", ("list_and_prose", 1, 0, 0, 1, 1)),
        ("    - code\n", ("other_only", 0, 0, 0, 0, 0)),
        ("> - quoted\n>   on\n", ("list_only", 1, 0, 0, 2, 0)),
        ("- ```\n  - code\n  ```\n- b\n", ("list_only", 2, 0, 0, 4, 0)),
        ("* * *\n", ("other_only", 0, 0, 0, 0, 0)),
        ("", ("empty", 0, 0, 0, 0, 0)),
        ("- a\ntext\n<div>\n", ("list_and_other", 1, 0, 0, 2, 0)),
    ],
)
def test_section_bodies(text, want):
    assert body(text) == want


def test_fences_close_with_as_many_marks():
    assert [n for n, _ in markdown.unfenced("a\n````\nx\n```\n`````\nb\n~~~\nnever closed")] == [1, 6]
    assert [n for n, _ in markdown.unfenced("``` a`b\nstill text")] == [1, 2]
    assert markdown.fenced_blocks("```\n```\n~~~\n") == 2


# -- references


def test_local_references():
    text = "# guide.md\n\n@setup.md\nSee [rules](docs/rules.md#a) and `notes.md`, not https://a.org/b.md.\n<!-- import: @extra/more.md -->\n```\n@no.md\n```\n"
    got = {(r["syntax"], r["target"]) for r in references.local_references(text)}
    assert got == {("direct_include", "setup.md"), ("markdown_link", "docs/rules.md"), ("path_mention", "notes.md"), ("comment_include", "extra/more.md")}
    twice = "either rules.md or rules.md"
    assert len(references.local_references(twice)) == 2 and len(references.unique_references(twice)) == 1


def test_external_references():
    text = "[p](https://a.org/d/P.md#x)\nat https://a.org/Q.md).\n<!-- https://a.org/c.md -->\nbad https://[x/y.md here\n"
    got = [(r["syntax"], r["name"], r["target"]) for r in references.external_references(text)]
    assert got == [("external_markdown_link", "p.md", "https://a.org/d/P.md#x"), ("external_url", "q.md", "https://a.org/Q.md")]


def of(line, category="other_md"):
    r = references.local_references(line)[0]
    rule, acts = references.cue(r["syntax"], r["raw"], r["source_line"], r["source_line"])
    return rule or (references.ACTION if acts and category in references.ACTION_CATEGORIES else "no_explicit_instructional_cue_v1")


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("@team.md", "explicit_include_syntax_v1"),
        ("- **@team.md**", "standalone_at_include_v1"),
        ("Please follow everything in team.md.", "follow_normative_cue_v1"),
        ("You must always consult team.md first", "required_action_cue_v1"),
        ("The coding rules are in team.md", "instruction_location_cue_v1"),
        ("See the picture in team.md", "no_explicit_instructional_cue_v1"),
        ("After a change, you must check whether team.md is current.", "no_explicit_instructional_cue_v1"),
    ],
)
def test_intents(line, rule):
    assert of(line) == rule


def test_intent_depends_on_the_target():
    assert of("Please see team.md", "agents_md") == "instruction_target_action_v1"
    assert of("Please see team.md") == "no_explicit_instructional_cue_v1"


def test_context_takes_the_line_that_announces_it():
    assert references.context_of(["Read these:", "", "a.md"], 3) == "Read these:\na.md"
    assert references.context_of(["words", "a.md"], 2) == "a.md"
    assert references.parse("---\nx: 1\n---\n# T\n@a.md\nfour more words here\n")["residual_words"] == 4


# -- imports


def decisions(text):
    return [(t["target"], t["decision"].removeprefix("excluded_")) for t in imports.import_tokens(text)]


OK = imports.CANDIDATE


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("@A.md\nuse @README and @x.json, @d/e; ok", [("A.md", OK), ("README", OK), ("x.json", OK), ("d/e", OK)]),
        ("`@a` ``@b`` @c ``d @e\n@f`` @g", [("a", "inline_code"), ("b", "inline_code"), ("c", OK), ("e", "inline_code"), ("f", "inline_code"), ("g", OK)]),
        ("one ` tick @a", [("a", OK)]),
        ("tick `\n~~~\nx\n~~~\n@a `\ntick `\n<!-- c -->\n@b `\ntick `\n\n@c `", [("a", OK), ("b", OK), ("c", OK)]),
        ("`x <!-- @a --> @b`", [("a", "inline_code"), ("b", "inline_code")]),
        ("t `\n<!--\n\n@a\n-->\n@b `", [("a", "html_comment"), ("b", OK)]),
        ("```\n@a\n```\n~~~\n@b\n~~~\n<!-- @c -->\n@d", [("a", "fenced_code"), ("b", "fenced_code"), ("c", "html_comment"), ("d", OK)]),
        ("me@x.org a@b @c.", [("c", OK)]),
        ("@./m/@s/p.md", [("./m/@s/p.md", OK)]),
        ("@d/*.md @{{R}}/a @$H/b @%H%/c", [("d/*.md", "unsupported_pattern"), ("{{R}}/a", "unsupported_pattern"), ("$H/b", "unsupported_variable"), ("%H%/c", "unsupported_variable")]),
        ("@https://a.org/b.md and @c:d", [("https://a.org/b.md", "unsupported_uri"), ("c", OK)]),
        (r"@C:\a\b.md @.. @./ @x/", [(r"C:\a\b.md", OK), ("./", "non_file_target"), ("x/", "non_file_target")]),
        ("no at sign", []),
        ("<!-- @a never closed\n@b", [("a", "html_comment"), ("b", "html_comment")]),
    ],
)
def test_import_tokens(text, want):
    assert decisions(text) == want


def test_import_places():
    first, second = imports.import_tokens("x\r\n- @a.md\r\n**@b.md**")
    assert (first["line"], first["column"], first["end_column"], first["surface"]) == (2, 3, 8, "list_item_only")
    assert (second["line"], second["surface"], second["start"]) == (3, "standalone_formatted", 14)


@pytest.mark.parametrize(
    ("source", "target", "want"),
    [
        ("p/a/F.md", "../../G.md", ("G.md", "ancestor_directory", "markdown", 0)),
        ("F.md", "README", ("README", "same_directory", "extensionless", 0)),
        ("F.md", "x.json", ("x.json", "same_directory", "other_extension", 0)),
        ("d/F.md", "f.md", ("d/f.md", "same_directory", "markdown", 1)),
        ("F.md", "/etc/x", ("", "external_absolute", "extensionless", 0)),
        ("F.md", "~/x.md", ("", "external_home", "markdown", 0)),
        ("F.md", r"C:\t\x.md", ("", "external_absolute", "markdown", 0)),
        ("F.md", r"t\x.md", ("", "platform_dependent", "markdown", 0)),
        ("F.md", "../x.md", ("../x.md", "outside_repository", "markdown", 0)),
        ("a/F.md", "b/x.md", ("a/b/x.md", "descendant_directory", "markdown", 0)),
        ("a/F.md", "../b/x.md", ("b/x.md", "other_directory", "markdown", 0)),
    ],
)
def test_import_targets(source, target, want):
    got = imports.resolve(source, target)
    assert (got["resolved"], got["relation"], got["extension"], got["is_self"]) == want
    assert imports.resolve("F.md", "./.g/*.md")["normalized"] == ".g/*.md"


# -- forms, overlays


@pytest.mark.parametrize(
    ("text", "category", "subtype"),
    [
        ("# T\n\n@AGENTS.md\n", "pointer_shim", "direct_include_only"),
        ("<!-- include: a.md -->\n", "pointer_shim", "comment_include_only"),
        ("../x/y.md\n", "pointer_shim", "path_only"),
        ("---\nt: a.md\n---\n\nb.md\n", "pointer_shim", "path_only"),
        ("Please read b.md now\n", "pointer_shim", "prose_pointer"),
        ("@b.md\nfollow it\n", "pointer_shim", "direct_include_with_explanation"),
        (".rules\n", "pointer_shim", "legacy_rules_pointer"),
        ("@docs/thing\n", "pointer_shim", "generic_at_pointer"),
        ("# Instructions\n<!-- x -->\n", "empty_placeholder", "empty_or_punctuation"),
        ("<my-context>\n</my-context>\n", "empty_placeholder", "empty_generated_block"),
        ("<box> </box>", "empty_placeholder", "empty_tag_block"),
        ("TODO...\n", "empty_placeholder", "placeholder_phrase"),
        ("## Notes\n*(none)*\n## Warnings\nNo\n", "empty_placeholder", "empty_sections"),
        ("Automatically generated by a tool\nx\n", "generated_context", "explicit_generated_header"),
        ("This repo is a starter.\n", "template_scaffold", "self_declared_template"),
        ("You should run the checks first.\n" * 20, "substantive_repeated_document", "size_or_structure_threshold"),
        ("Use tabs.\n", "short_ambiguous", "no_high_precision_form_rule"),
        ("", "empty_placeholder", "empty_or_punctuation"),
    ],
)
def test_forms(text, category, subtype):
    got = forms.classify(text, len(text.encode()))
    assert (got["category"], got["subtype"]) == (category, subtype)


def test_overlays():
    strict = overlays.analyze("@AGENTS.md\n")
    assert (strict["strict"], strict["comments_only"], strict["residual_words"], strict["literal"]) == (1, 1, 0, 1)
    noted = overlays.analyze("@AGENTS.md\n<!-- only a note -->\n")
    assert (noted["strict"], noted["comments_only"]) == (0, 1)
    assert overlays.analyze("see `@AGENTS.md`") is None
    assert overlays.analyze("@../AGENTS.md")["literal"] == 0
    with pytest.raises(ValueError):
        overlays.analyze("", minimum_words=0)


def test_overlay_sections():
    text = "@AGENTS.md\n\n## Claude-specific rules\n\nAlways use plan mode and /check it.\n\n### Deeper\nmore\n\n## Other\nno\n"
    (s,) = overlays.analyze(text)["sections"]
    assert (s["line"], s["label"], s["directive"], s["placeholder"], s["concrete"]) == (3, "explicit_specificity_or_adapter", 1, 0, 1)
    assert s["themes"] == ["plan_mode", "skills_or_slash_commands"] and "more" in s["excerpt"] and "no" not in s["excerpt"].split()
    (empty,) = overlays.analyze("@AGENTS.md\n# Claude notes\n_(None yet)_\n")["sections"]
    assert (empty["placeholder"], empty["concrete"]) == (1, 0)
    before = "# Claude notes\nAlways.\n@AGENTS.md\n```\n# Claude rules\nUse it\n```\n<!--\n# Claude rules\nUse\n-->\n"
    assert overlays.analyze(before)["sections"] == []
    assert overlays.is_labelled("claude code — extra notes") and not overlays.is_labelled("see .claude/rules") and not overlays.is_labelled("claude.md")


def test_spans_are_taken_out():
    assert overlays.without_spans("abcdef", [(1, 2), (4, 9)]) == "acd"
    assert overlays.without_spans("cdef", [(1, 3), (4, 5)], 2) == "df"
    assert overlays.masked("a<!--b\nc") == "a     \n "


# -- prose and languages


def test_paragraphs():
    text = "---\nkey: v\n---\n# Head\n\nSome *plain* words with `code` and docs/a.md here.\n\n```\nno\n```\n|a|b|\n    indented\n- first item --flag\n- second [link](x)\n"
    assert [p["text"] for p in prose.paragraphs(text)] == ["Head", "Some plain words with and here.", "first item", "second link"]
    assert prose.paragraphs("---\njust a rule\n---\n")[0]["text"] == "just a rule"


class Fixed:
    def __init__(self, language, confidence=0.99):
        self.name, self.p = "fixed", prose.Prediction(language, confidence, 0.9)

    def predict(self, text):
        return self.p


@pytest.mark.parametrize(
    ("a", "b", "text", "want"),
    [
        ("en", "en", "Some words, here.", "accepted"),
        ("en", "es", "Some words", "detector_disagreement"),
        ("en", "en", "Эти слова написаны иначе", "script_mismatch"),
        ("ru", "ru", "Эти слова написаны иначе", "accepted"),
    ],
)
def test_decisions(a, b, text, want):
    got = prose.decide(text, Fixed(a), Fixed(b))
    assert got["decision"] == want and got["language"] == (a if want == "accepted" else None)


def test_unsure_or_unstable_paragraphs_are_not_accepted():
    assert prose.decide("x", Fixed("en", 0.5), Fixed("en"))["decision"] == "fasttext_low_confidence"

    class Moody(Fixed):
        def predict(self, text):
            return self.p if text[:1].isupper() else prose.Prediction("fr", 0.99, 0.9)

    assert prose.decide("Some, words", Moody("en"), Fixed("en"))["decision"] == "normalization_instability"
    assert prose.StopWordDetector().predict("the cat and the dog of that").language == "en"


def test_default_detectors_are_independent():
    one, two = prose.StopWordDetector(), prose.TrigramDetector()
    for language, text in [("en", "We should write the notes before the meeting starts, and they will be read."), ("fr", "Les enfants apprennent à lire dans la maison et ils sont contents."), ("de", "Die Kinder lernen lesen und sie haben das Haus nicht gesehen."), ("es", "Los niños aprenden a leer en la casa y están contentos.")]:
        assert one.predict(text).language == two.predict(text).language == language
    # German words between English function words: the word list alone is sure.
    mixed = "Aufgeschriebene Prüfungen the Einstellungen of Straßenarbeiten and Sitzungsbeginn to Tausende Wände gesagt worden Möglichkeiten Geschwindigkeit"
    assert one.predict(mixed).language == "en" and two.predict(mixed).language == "de"
    assert prose.decide(mixed, one, two)["decision"] == "detector_disagreement"
    assert two.predict("12 34").language == "und"


# -- notations


def test_notations_by_label_pattern_and_mark():
    text = "```mermaid\nsequenceDiagram\nA->>B: hi\nB->>A: ho\n```\n```json\n{}\n```\n```\nroot/\n├── a\n```\n```txt\nx ::= y\n<z> ::= w\n```\n@startuml\nactor Bob\nBob -> Al\n@enduml\n"
    got = {(d["id"], d["subtype"], d["confidence"], d["via"]) for d in notations.parse(text)["detections"]}
    assert got == {
        ("mermaid", "sequence", "high", "fence_language"),
        ("json_schema", None, "high", "fence_language"),
        ("ascii_diagram", None, "medium", "untagged_heuristic"),
        ("bnf_ebnf", None, "medium", "untagged_heuristic"),
        ("plantuml", "sequence", "high", "boundary_marker"),
    }
    shapes = {d["id"]: d["shape"] for d in notations.parse(text)["detections"]}
    assert (shapes["mermaid"]["nodes"], shapes["mermaid"]["edges"], shapes["bnf_ebnf"]["nodes"], shapes["plantuml"]["edges"]) == (2, 2, 2, 1)


def test_a_marked_block_in_its_own_fence_counts_twice():
    assert [d["via"] for d in notations.parse("```plantuml\n@startuml\nA -> B\n@enduml\n```\n")["detections"]] == ["fence_language", "boundary_marker"]


def test_directives_and_rules():
    assert notations.first_directive("%% c\n\n  Timeline x") == "timeline"
    assert notations.first_directive("%% c\n") == "(empty/comment-only)" and notations.first_directive('"x"') == "(other)"
    d = notations.Detector()
    assert d.rules("ascii_diagram", "+--+ -->") == [2, 3]
    assert notations.shape("mermaid", "state", "[*] --> A\nA --> B : go\n")["nodes"] == 3
    assert notations.shape("mermaid", "class", "class A\nclass B\nA <|-- B\n") == {"kind": "classes", "nodes": 2, "edges": 1, "pairs": [["A"], ["B"]]}


def test_results_that_a_task_keeps_are_bounded_with_what_they_hold():
    import pyarrow as pa

    from quillspark.plans import corpus

    asked = []
    known = corpus._Known(lambda x: asked.append(x) or [{"place": k, "target": x} for k in range(100)], 20_000)
    first = known("a")
    assert known("a") == first and asked == ["a"] and known(None) is None
    for k in range(200):
        assert known(f"content {k}")[99] == {"place": 99, "target": f"content {k}"}
        assert known.size <= 20_000 and known.size == sum(len(a) + len(b) for a, b in known.rows.items())
    assert known("x" * 30_000)[0]["target"] == "x" * 30_000 and "x" * 30_000 not in known.rows
    texts = pa.array(["a" * 6, None, "b" * 5, "c" * 50, "", "é" * 5])
    assert list(corpus._stretches(texts, 10)) == [(0, 2), (2, 1), (3, 1), (4, 2)]
    assert list(corpus._stretches(texts, 1000, 4)) == [(0, 4), (4, 2)] and list(corpus._stretches(texts[:0], 10)) == []

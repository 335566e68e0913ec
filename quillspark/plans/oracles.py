"""SQL of the analyses whose parsers run in Python. It follows CORPUS_SQL and relies on what the binding writes:

lines end with a line feed, fences are of three backticks, references and imports are the binding's own lines,
and texts hold no other paths, URLs, comments or code spans.
"""

from __future__ import annotations

_DIR = "CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END"
_WORD = r"[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*"
_HEADING = r"^ {0,3}#{1,6}[ \t]+"

#: Scopes that files speak for: a hidden folder's is the directory that holds it.
SCOPES = f""", e AS (SELECT id, repo, path, content_hash, {_DIR} AS dir FROM exact),
 hid AS (SELECT *, lower(dir) = '.claude' OR lower(dir) LIKE '%/.claude' AS hidden FROM e),
 sc AS (SELECT *, CASE WHEN NOT hidden THEN dir WHEN contains(dir, '/') THEN regexp_extract(dir, '^(.*)/[^/]*$', 1) ELSE '' END AS scope FROM hid)"""

#: Numbers of the lines outside fences (out); a line may open a fence, or close one if nothing follows the marks.
LINED = """, u AS (SELECT id, repo, path, content_hash, content, string_split(content, chr(10)) AS ls FROM exact),
 st AS (SELECT *, list_reduce(ls, lambda s, x: {'o': CASE WHEN s.o THEN NOT regexp_full_match(x, ' {0,3}```+[ \\t]*') ELSE regexp_matches(x, '^ {0,3}```') END,
   'i': s.i + 1, 'out': CASE WHEN NOT s.o AND NOT regexp_matches(x, '^ {0,3}```') THEN list_append(s.out, s.i + 1) ELSE s.out END}, {'o': false, 'i': 0, 'out': CAST([] AS INT[])}).out AS outside FROM u),
 outl AS (SELECT id, repo, path, content_hash, ls, i, ls[i] AS line FROM (SELECT *, unnest(outside) AS i FROM st))"""

#: The facts of the exact population's files.
FACTS = f""", sets AS (SELECT repo, content_hash, count(*) AS repo_copies FROM exact GROUP BY ALL),
 facts AS (SELECT f.id, f.repo AS repo_full_name, f.path, f.content_hash AS h, size_bytes, coalesce(nullif(r.language, ''), 'Unknown') AS language,
  CASE WHEN size_bytes <= 50 THEN '<=50' WHEN size_bytes <= 200 THEN '51-200' WHEN size_bytes <= 1000 THEN '201-1000' WHEN size_bytes <= 5000 THEN '1001-5000' ELSE '>5000' END AS size_band,
  CASE WHEN stars IS NULL THEN 'unknown' WHEN stars <= 0 THEN '0' WHEN stars <= 9 THEN '1-9' WHEN stars <= 99 THEN '10-99' WHEN stars <= 999 THEN '100-999' ELSE '>=1000' END AS star_band,
  CASE WHEN contains(f.path, '/') THEN 'nested' ELSE 'root' END AS location,
  CASE WHEN (SELECT sum(repo_copies) FROM sets s WHERE s.repo = f.repo) > 1 THEN 'multiple' ELSE 'single' END AS multiplicity,
  CASE WHEN (SELECT sum(repo_copies) FROM sets s WHERE s.content_hash = f.content_hash) > 1 THEN 'duplicate' ELSE 'unique' END AS duplication,
  CASE WHEN contains(f.path, '/') THEN regexp_extract(f.path, '^(.*)/[^/]*$', 1) ELSE '' END AS dir
  FROM exact f LEFT JOIN repos r ON f.repo = r.full_name)"""

#: References: whole-line includes and links outside fences, with the line that announces them.
REFERENCES = LINED + FACTS + rf""",
 found AS (SELECT id, i, line, ls, 'direct_include' AS syntax, regexp_extract(line, '^@(.*)$', 1) AS raw FROM outl WHERE regexp_matches(line, '^@(AGENTS|docs/setup[0-9])\.md$')
  UNION ALL SELECT id, i, line, ls, 'markdown_link', regexp_extract(line, '\[guide\]\(([^)]*)\)', 1) FROM outl WHERE contains(line, '[guide](')),
 ctx AS (SELECT *, trim(line) AS own, list_filter([CASE WHEN i > 2 THEN trim(ls[i - 2]) END, CASE WHEN i > 1 THEN trim(ls[i - 1]) END], lambda x: x IS NOT NULL AND x <> '')[-1] AS before FROM found),
 refs AS (SELECT c.id, i AS line, syntax, raw, raw AS target, lower(regexp_extract(raw, '([^/]*)$', 1)) AS name, c.line AS source_line,
   CASE WHEN len(regexp_extract_all(own, '{_WORD}')) <= 18 AND before IS NOT NULL AND (ends_with(before, ':') OR regexp_matches(before, '{_HEADING}')) THEN (before || chr(10) || own)[:700] ELSE own[:700] END AS context,
   CASE WHEN starts_with(raw, '../') THEN CASE WHEN dir = '' THEN raw WHEN contains(dir, '/') THEN regexp_extract(dir, '^(.*)/[^/]*$', 1) || raw[3:] ELSE raw[4:] END
        WHEN dir = '' THEN raw ELSE dir || '/' || raw END AS resolved, dir, h, repo_full_name, path
   FROM ctx c JOIN facts f ON c.id = f.id),
 marked_refs AS (SELECT *,
   CASE WHEN starts_with(resolved, '../') THEN 'outside_repository' WHEN raw = 'AGENTS.md' THEN 'same_directory' WHEN starts_with(raw, '../') AND regexp_extract(resolved, '^(.*)/[^/]*$', 1) = dir THEN 'same_directory'
        WHEN starts_with(raw, '../') THEN 'other_directory' ELSE 'descendant_directory' END AS relation,
   CASE WHEN name = 'agents.md' THEN 'agents_md' ELSE 'project_docs_md' END AS category,
   CASE WHEN syntax = 'direct_include' THEN 'explicit_include_syntax_v1' WHEN starts_with(source_line, 'Always read') THEN 'required_action_cue_v1' ELSE 'no_explicit_instructional_cue_v1' END AS rule FROM refs),
 ro AS (SELECT *, CASE rule WHEN 'explicit_include_syntax_v1' THEN 'direct_inclusion' WHEN 'required_action_cue_v1' THEN 'instructional_delegation' ELSE 'contextual_documentation' END AS intent,
   CASE WHEN rule = 'no_explicit_instructional_cue_v1' OR relation = 'outside_repository' THEN 0 ELSE 1 END AS high FROM marked_refs),
 rest AS (SELECT id, CAST(sum(len(regexp_extract_all(CASE WHEN contains(line, '[guide](') THEN replace(line, regexp_extract(line, '\[guide\]\(([^)]*)\)', 1), '') ELSE line END, '{_WORD}'))) AS INT) AS residual_words
   FROM outl WHERE NOT regexp_matches(line, '{_HEADING}') AND NOT regexp_matches(line, '^@(AGENTS|docs/setup[0-9])\.md$') GROUP BY id),
 per AS (SELECT id, count(*) AS local, CAST(sum(high) AS BIGINT) AS high, count(DISTINCT resolved) FILTER (WHERE high = 1) AS fan_out, count(DISTINCT resolved) FILTER (WHERE relation <> 'outside_repository') AS distinct_targets, array_to_string(list_sort(list_distinct(list(category))), ';') AS target_categories FROM ro GROUP BY id),
 rf AS (SELECT f.*, coalesce(residual_words, 0) AS residual_words, regexp_matches(x.content, '(?m)^ {{0,3}}```') AS has_fence, coalesce(p.local, 0) AS local, coalesce(p.high, 0) AS high, coalesce(p.fan_out, 0) AS fan_out, coalesce(p.distinct_targets, 0) AS distinct_targets, p.target_categories
   FROM facts f JOIN exact x USING (id) LEFT JOIN rest USING (id) LEFT JOIN per p USING (id)),
 forms AS (SELECT *, CASE WHEN local = 0 THEN 'no_detected_markdown_reference' WHEN high > 0 AND NOT has_fence AND residual_words <= 50 THEN 'pointer_only' WHEN high > 0 THEN 'instructions_plus_delegation' ELSE 'contextual_local_references_only' END AS form FROM rf)"""

#: Imports: the binding's own lines, in fences too.
IMPORTS = LINED + FACTS + r""",
 every AS (SELECT id, content, ls, outside, unnest(range(1, len(ls) + 1)) AS i FROM st),
 tok AS (SELECT id, i AS line, ls[i] AS token, ls[i][2:] AS target, CASE WHEN list_contains(outside, i) THEN 'plain_text' ELSE 'fenced_code' END AS context,
   length(array_to_string(ls[1 : i - 1], chr(10))) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS start, content FROM every WHERE regexp_matches(ls[i], '^@(AGENTS|docs/setup[0-9])\.md$')),
 imports AS (SELECT t.*, f.repo_full_name, f.path, regexp_extract(target, '([^/]*)$', 1) AS name, CASE WHEN dir = '' THEN target ELSE dir || '/' || target END AS resolved,
   CASE WHEN contains(target, '/') THEN 'descendant_directory' ELSE 'same_directory' END AS relation, CASE WHEN context = 'plain_text' THEN 'import_candidate' ELSE 'excluded_fenced_code' END AS decision,
   row_number() OVER (PARTITION BY t.id ORDER BY line) - 1 AS place FROM tok t JOIN facts f USING (id))"""

#: Headings with the families of equal contents.
HEADINGS = LINED + r""",
 fam AS (SELECT content_hash, count(*) AS w, min(id) AS id FROM exact GROUP BY content_hash),
 hd AS (SELECT o.id, fam.w, o.content_hash, i, ls, line, length(regexp_extract(line, '^ {0,3}(#{1,6})', 1)) AS level,
   trim(regexp_replace(trim(regexp_extract(line, '^ {0,3}#{1,6}(?:[ \t]+|$)(.*)$', 1)), '[ \t]+#+[ \t]*$', '')) AS title FROM outl o JOIN fam ON o.id = fam.id WHERE regexp_matches(line, '^ {0,3}#{1,6}([ \t]|$)')),
 nx AS (SELECT *, lead(i) OVER (PARTITION BY id ORDER BY i) AS following, lag(level) OVER (PARTITION BY id ORDER BY i) AS before FROM hd),
 sec AS (SELECT *, regexp_full_match(array_to_string(ls[i + 1 : coalesce(following - 1, len(ls))], ' '), '\s*') AS empty FROM nx),
 doc AS (SELECT id, w, count(*) AS n, count(*) FILTER (WHERE empty) AS empties, count(*) FILTER (WHERE level > before + 1) AS jumps, arg_min(level, i) > 1 AS below, count(*) FILTER (WHERE level = 1) AS h1 FROM sec GROUP BY ALL),
 own AS (SELECT fam.id, fam.w, coalesce(n, 0) AS n, coalesce(empties, 0) AS empties, coalesce(jumps, 0) AS jumps, coalesce(below, false) AS below, coalesce(h1, 0) AS h1 FROM fam LEFT JOIN doc USING (id)),
 named_headings AS (SELECT id, w, coalesce(nullif(replace(lower(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(title, '!?\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[`*_~]', '', 'g')),
   '(?i)^(?:\d+(?:\.\d+)*[.)\-:]?|(?:[ivxlcdm]+|[a-z])[.)\-:])[ \t]+', ''), '\s+', ' ', 'g'), '^[ \t:;,.!?\-–—]+|[ \t:;,.!?\-–—]+$', '', 'g')), 'ß', 'ss'), ''), '(empty)') AS name FROM hd)"""

FACT_COLUMNS = "id, repo_full_name, path, size_bytes, language, size_band, star_band, location, multiplicity, duplication"


def totals(names: dict[str, str], source: str = "own") -> str:
    """Each measure of the families weighted by copies and counted once."""
    return "SELECT " + ", ".join(f"CAST(sum(({x}) * w) AS BIGINT) AS {n}_full, CAST(sum({x}) AS BIGINT) AS {n}_unique" for n, x in names.items()) + f" FROM {source}"


#: Repositories with several files, their nearest enclosing directories with files, and what each repository's sizes are.
HIERARCHY = f""", several AS (SELECT *, {_DIR} AS dir FROM exact SEMI JOIN (SELECT repo FROM exact GROUP BY repo HAVING count(*) > 1) USING (repo)),
 d AS (SELECT DISTINCT repo, dir FROM several),
 up AS (SELECT c.repo, c.dir, p.dir AS up FROM d c JOIN d p ON c.repo = p.repo AND c.dir <> p.dir AND (p.dir = '' OR starts_with(c.dir, p.dir || '/')) QUALIFY row_number() OVER (PARTITION BY c.repo, c.dir ORDER BY length(p.dir) DESC) = 1),
 edge AS (SELECT c.repo, c.id AS child, p.id AS parent FROM several c JOIN up USING (repo, dir) JOIN several p ON p.repo = c.repo AND p.dir = up.up),
 per AS (SELECT repo, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(sum(CASE WHEN dir = '' THEN size_bytes ELSE 0 END) AS BIGINT) AS root_bytes, CAST(max(CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END) AS INT) AS maximum_depth,
   sum(size_bytes::DOUBLE * size_bytes) / (sum(size_bytes)::DOUBLE * sum(size_bytes)) AS hhi, max(size_bytes)::DOUBLE / sum(size_bytes) AS largest_share, root_bytes::DOUBLE / sum(size_bytes) AS root_share,
   CASE WHEN count(*) = 2 THEN '2' WHEN count(*) = 3 THEN '3' WHEN count(*) <= 5 THEN '4-5' WHEN count(*) <= 10 THEN '6-10' WHEN count(*) <= 20 THEN '11-20' ELSE '>20' END AS band FROM several GROUP BY repo)"""

#: Heading names of every file.
FILE_HEADINGS = LINED + HEADINGS.removeprefix(LINED).split(",\n nx AS")[0].replace("min(id) AS id FROM exact GROUP BY content_hash", "id FROM exact GROUP BY content_hash, id") + ",\n named_headings AS" + HEADINGS.split("named_headings AS")[1]

#: What each line of corpus.NOTES says, by its number in the rule alone: references outside fences, and imports with the context they stand in.
SAID = f""", written AS (SELECT id, repo, path, {_DIR} AS dir, unnest(range(len(string_split(content, chr(10))))) AS j FROM exact),
 ruled AS (SELECT *, (j + id % 10000000000) % 16 AS m, id % 10000000000 % 2 = 1 AS odd FROM written),
 lying AS (SELECT *, coalesce(sum(CASE WHEN m IN (6, 9) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM ruled),
 forms(m, scope, syntax, target) AS (VALUES (1, 'local', 'path_mention', 'docs/x.md'), (2, 'external', 'external_markdown_link', ''), (4, 'local', 'markdown_link', 'CLAUDE.md'), (5, 'local', 'path_mention', 'span.md'), (7, 'local', 'direct_include', 'fenced.md'), (8, 'local', 'path_mention', 'docs/fenced.md'),
   (10, 'local', 'direct_include', 'docs/a.md'), (11, 'external', 'external_url', ''), (12, 'local', 'markdown_link', '../CLAUDE.md'), (13, 'local', 'markdown_link', '.claude/CLAUDE.md'), (14, 'local', 'path_mention', 'docs/li.md'), (15, 'local', 'direct_include', '~/home.md')),
 referred AS (SELECT id, repo, path, scope, syntax, CASE WHEN scope = 'external' THEN 'external' WHEN m = 12 AND dir = '' THEN 'outside_repository' WHEN m = 12 THEN 'ancestor_directory' WHEN contains(target, '/') THEN 'descendant_directory' ELSE 'same_directory' END AS relation,
   CASE WHEN m = 12 AND dir = '' THEN target WHEN m = 12 THEN CASE WHEN contains(dir, '/') THEN regexp_extract(dir, '^(.*)/[^/]*$', 1) || '/' ELSE '' END || 'CLAUDE.md' WHEN dir = '' THEN target ELSE dir || '/' || target END AS resolved
   FROM lying JOIN forms USING (m) WHERE NOT inside AND (m <> 15 OR odd)),
 imported AS (SELECT id, CASE WHEN inside THEN 'fenced_code' WHEN m = 3 THEN 'html_comment' WHEN m = 5 THEN 'inline_code' ELSE 'plain_text' END AS context, CASE WHEN m IN (3, 5, 14) THEN 'prose_embedded' ELSE 'whole_line' END AS surface,
   CASE WHEN m = 15 THEN 'home_relative' ELSE 'relative' END AS kind, CASE WHEN m = 15 THEN 'external_home' WHEN m IN (10, 14) THEN 'descendant_directory' ELSE 'same_directory' END AS relation FROM lying WHERE m IN (3, 5, 7, 10, 14) OR m = 15 AND odd)"""

#: Fenced blocks and the notations that they name or look like.
NOTATIONS = r""", blk AS (SELECT id, lower(label) AS label, body FROM (SELECT id, unnest(regexp_extract_all(content, '(?ms)^```([^\s]*)[ \t]*\n(.*?)^```', 1)) AS label, unnest(regexp_extract_all(content, '(?ms)^```([^\s]*)[ \t]*\n(.*?)^```', 2)) AS body FROM files)),
 looks(notation, pattern) AS (VALUES ('mermaid', 'sequenceDiagram|classDiagram|stateDiagram|erDiagram'), ('plantuml', '@startuml'), ('graphviz', 'digraph |digraph\{|rankdir='), ('ascii_diagram', '[┌┐└┘├┤┬┴┼─│]|\+[-]{2,}\+|<-{2,}>|-{2,}>|<-{2,}'), ('bnf_ebnf', '::='), ('json_schema', '"type": "object"|"properties":'), ('yaml_schema', 'openapi:|swagger:')),
 seen AS (SELECT id, CASE label WHEN 'mermaid' THEN 'mermaid' ELSE 'json_schema' END AS notation, 'high' AS confidence FROM blk WHERE label IN ('mermaid', 'json')
   UNION ALL SELECT id, notation, 'medium' FROM blk, looks WHERE label NOT IN ('mermaid', 'json') AND regexp_matches(body, pattern))"""

#: Contents that repeat within a repository, by the form of what they hold beside the binding's own references.
REPEATED = REFERENCES + rf""",
 grp AS (SELECT repo, content_hash, count(*) AS files, min(id) AS id, min(path) AS representative, min(size_bytes) AS size_bytes, min(content) AS content FROM exact GROUP BY repo, content_hash HAVING count(*) > 1),
 beside AS (SELECT id, string_agg(CASE WHEN contains(line, '[guide](') THEN replace(line, regexp_extract(line, '\[guide\]\(([^)]*)\)', 1), '') ELSE line END, chr(10)) AS t
   FROM outl WHERE NOT regexp_matches(line, '{_HEADING}') AND NOT regexp_matches(line, '^@(AGENTS|docs/setup[0-9])\.md$') GROUP BY id),
 known AS (SELECT g.*, (SELECT count(*) FROM (SELECT DISTINCT i, syntax, raw FROM found x WHERE x.id = g.id)) AS n_refs, (SELECT count(*) FROM found x WHERE x.id = g.id AND syntax = 'direct_include') AS includes,
   contains(content, '```') AS fenced, len(regexp_extract_all(coalesce(t, ''), '{_WORD}')) AS left_words, regexp_matches(coalesce(t, ''), '(?i)\b(instruction|instructions|read|refer|follow|use|uses|using|load|loads|import(s|ed|ing)?|source of truth|guidance|see)\b') AS cue,
   len(regexp_extract_all(content, '{_WORD}')) AS words, len(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')) AS full_lines FROM grp g LEFT JOIN beside USING (id)),
 formed AS (SELECT *, CASE WHEN n_refs > 0 AND NOT fenced AND (left_words = 0 OR cue AND (includes > 0 AND left_words <= 60 OR includes = 0 AND left_words <= 50)) THEN 'pointer_shim'
   WHEN NOT regexp_matches(content, '[\p{{L}}\p{{N}}_]') THEN 'empty_placeholder' WHEN words >= 50 OR full_lines >= 8 OR size_bytes >= 500 THEN 'substantive_repeated_document' ELSE 'short_ambiguous' END AS category FROM known)"""

#: Sections, their lines folded into list, prose and other blocks. A list goes on over plain lines until a blank line, a fence or another block.
SECTIONS = HEADINGS + r""",
 body AS (SELECT id, w, i, level, ls[i + 1 : coalesce(following - 1, len(ls))] AS b FROM nx),
 fold AS (SELECT id, w, i, b, list_reduce(list_prepend('', b), lambda a, x: CASE
    WHEN a.f THEN struct_pack(s := 'none', f := NOT regexp_full_match(x, ' {0,3}```+[ \t]*'), k := CASE WHEN trim(x) = '' THEN 'blank' ELSE 'other' END, n := a.n, t := a.t, ks := list_append(a.ks, CASE WHEN trim(x) = '' THEN 'blank' ELSE 'other' END))
    WHEN trim(x) = '' THEN struct_pack(s := CASE WHEN a.s = 'none' THEN 'none' ELSE 'loose' END, f := false, k := 'blank', n := a.n, t := a.t, ks := list_append(a.ks, 'blank'))
    WHEN regexp_matches(x, '^ {0,3}[-+*][ \t]') THEN struct_pack(s := 'flowing', f := false, k := 'list', n := a.n + 1, t := a.t + CAST(regexp_matches(x, '^- \[[ xX]\]([ \t]|$)') AS INT), ks := list_append(a.ks, 'list'))
    WHEN regexp_matches(x, '^ {0,3}```') THEN struct_pack(s := 'none', f := true, k := 'other', n := a.n, t := a.t, ks := list_append(a.ks, 'other'))
    WHEN regexp_matches(x, '^ {4}') OR length(x) - length(replace(x, '|', '')) > 1 THEN struct_pack(s := 'none', f := false, k := 'other', n := a.n, t := a.t, ks := list_append(a.ks, 'other'))
    WHEN a.s = 'flowing' THEN struct_pack(s := 'flowing', f := false, k := 'list', n := a.n, t := a.t, ks := list_append(a.ks, 'list'))
    ELSE struct_pack(s := 'none', f := false, k := 'prose', n := a.n, t := a.t, ks := list_append(a.ks, 'prose')) END,
    struct_pack(s := 'none', f := false, k := '', n := 0, t := 0, ks := CAST([] AS VARCHAR[]))) AS r FROM body),
 sect AS (SELECT id, w, i, CAST(len(b) AS BIGINT) AS line_count, CAST(len(regexp_extract_all(array_to_string(b, chr(10)), '[^\s\x{A0}]+')) AS BIGINT) AS word_count, CAST(r.n AS BIGINT) AS list_items, CAST(r.t AS BIGINT) AS task_items,
   CAST(len(list_filter(r.ks, lambda k: k = 'list')) AS BIGINT) AS list_lines, CAST(len(list_filter(r.ks, lambda k: k = 'prose')) AS BIGINT) AS prose_lines, CAST(len(list_filter(r.ks, lambda k: k = 'other')) AS BIGINT) AS other_lines,
   CAST(len(list_filter(list_zip(r.ks, list_prepend('', r.ks)), lambda z: z[1] = 'prose' AND coalesce(z[2], '') <> 'prose')) AS BIGINT) AS prose_blocks FROM fold),
 styled AS (SELECT *, CASE WHEN list_lines > 0 AND prose_lines > 0 AND other_lines > 0 THEN 'list_prose_and_other' WHEN list_lines > 0 AND prose_lines > 0 THEN 'list_and_prose' WHEN list_lines > 0 AND other_lines > 0 THEN 'list_and_other' WHEN prose_lines > 0 AND other_lines > 0 THEN 'prose_and_other'
   WHEN list_lines > 0 THEN 'list_only' WHEN prose_lines > 0 THEN 'prose_only' WHEN other_lines > 0 THEN 'other_only' ELSE 'empty' END AS style FROM sect),
 depths AS (SELECT id, max(deep) AS depth, count(*) FILTER (WHERE deep = 1) AS top FROM (SELECT a.id, a.i, 1 + (SELECT count(*) FROM hd b WHERE b.id = a.id AND b.i < a.i AND b.level < a.level AND NOT EXISTS (SELECT 1 FROM hd c WHERE c.id = a.id AND c.i > b.i AND c.i < a.i AND c.level <= b.level)) AS deep FROM hd a) GROUP BY id),
 perfile AS (SELECT o.*, coalesce(d.depth, 0) AS depth, coalesce(d.top, 0) AS top, coalesce(x.ls, 0) AS list_sections, coalesce(x.ps, 0) AS prose_sections, coalesce(x.os, 0) AS other_sections, coalesce(x.li, 0) AS list_items, coalesce(x.ti, 0) AS task_items, coalesce(x.pb, 0) AS prose_blocks, coalesce(x.ll, 0) AS list_lines, coalesce(x.pl, 0) AS prose_lines, coalesce(x.ol, 0) AS other_lines
   FROM own o LEFT JOIN depths d USING (id) LEFT JOIN (SELECT id, count(*) FILTER (WHERE list_items > 0) AS ls, count(*) FILTER (WHERE prose_blocks > 0) AS ps, count(*) FILTER (WHERE other_lines > 0) AS os, sum(list_items) AS li, sum(task_items) AS ti, sum(prose_blocks) AS pb, sum(list_lines) AS ll, sum(prose_lines) AS pl, sum(other_lines) AS ol FROM sect GROUP BY id) x USING (id)),
 pop(population, one) AS (VALUES ('full', false), ('unique', true)),
 measured AS (SELECT population, CASE WHEN one THEN 1 ELSE w END AS w, m.k AS measure, CAST(m.v AS BIGINT) AS value FROM pop, (
     SELECT w, unnest([{'k': 'sections_per_file', 'v': n}, {'k': 'sections_per_headed_file', 'v': CASE WHEN n > 0 THEN n END}, {'k': 'top_level_sections_per_file', 'v': top}, {'k': 'top_level_sections_per_headed_file', 'v': CASE WHEN n > 0 THEN top END},
       {'k': 'maximum_depth_per_file', 'v': depth}, {'k': 'maximum_depth_per_headed_file', 'v': CASE WHEN n > 0 THEN depth END}, {'k': 'skipped_jumps_per_file', 'v': jumps}]) AS m FROM perfile
     UNION ALL SELECT w, unnest([{'k': 'section_lines', 'v': line_count}, {'k': 'section_words', 'v': word_count}, {'k': 'list_items_per_section', 'v': list_items}, {'k': 'list_items_per_list_section', 'v': CASE WHEN list_items > 0 THEN list_items END}, {'k': 'prose_blocks_per_section', 'v': prose_blocks}]) FROM sect) WHERE m.v IS NOT NULL)"""


def weighted(source: str, by: str, quantiles: list[int]) -> str:
    """Weighted nearest-rank quantiles of value by w, with count, total, minimum, maximum and mean."""
    picks = ", ".join(f"min(value) FILTER (WHERE upto >= greatest(1, ceil({q / 100}::DOUBLE * n))) AS q{q}" for q in quantiles)
    return f""", h AS (SELECT {by}, value, sum(w) AS w FROM {source} GROUP BY ALL), acc AS (SELECT *, sum(w) OVER (PARTITION BY {by} ORDER BY value) AS upto, sum(w) OVER (PARTITION BY {by}) AS n FROM h)
 SELECT {by}, CAST(max(n) AS BIGINT) AS count, CAST(sum(value * w) AS BIGINT) AS total, min(value) AS minimum, max(value) AS maximum, round(sum(value * w)::DOUBLE / max(n), 9) AS mean, {picks} FROM acc GROUP BY {by}"""

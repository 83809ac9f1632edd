"""SQL for each registered query, over the same driver tables.

Inputs are stated again from their arithmetic, and results are computed from those rows rather than from the
texts that the operators parse.
"""

from __future__ import annotations

import hashlib

from hunkwise.operators import files as file_rules
from hunkwise.plans import prompts as prompt_texts
from hunkwise.plans import report as report_texts
from hunkwise.rules import DOCSTRING_RULE, LINE_RULES
from hunkwise.schemas import AGENTS, SEVERITIES, VERDICT_BADGES
from registry import inputs
from registry.queries import CUSTOM_RULE

ORACLES: dict[str, str] = {}


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def case(key: str, pairs: dict, default: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {v if isinstance(v, int) else q(v)}" for k, v in pairs.items()) + f" ELSE {default} END"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)


NL = "chr(10)"
SEV_RANK = case("severity", {s[0]: s[1] for s in SEVERITIES}, "5")

# ── files ────────────────────────────────────────────────────────────────────────────────────────────

PATHS = f"""
paths AS (
  SELECT doc_id, filename, string_split(filename, '/')[-1] AS base,
         CASE WHEN regexp_matches(string_split(filename, '/')[-1], '^.+\\.[^.]+$')
              THEN lower('.' || string_split(string_split(filename, '/')[-1], '.')[-1]) ELSE '' END AS suffix,
         string_split(lower(filename), '/') AS parts
  FROM (SELECT doc_id, {arr(inputs.DIRS)}[doc_id % 7 + 1] || '/' || {arr(inputs.BASES)}[(doc_id // 7) % 21 + 1] AS filename
        FROM documents)),
judged AS (
  SELECT *, lower(base) IN ({", ".join(map(q, file_rules.LOCKFILES))}) AS lockfile,
         suffix IN ({", ".join(map(q, file_rules.IGNORED_SUFFIXES))}) AS binary_suffix,
         lower(base) LIKE '%.min.js' OR lower(base) LIKE '%.min.css' AS minified,
         list_has_any(parts, {arr(file_rules.IGNORED_DIRS)}) AS ignored_dir,
         CASE {" ".join(f"WHEN suffix IN ({', '.join(map(q, sfx))}) THEN {q(lang)}" for lang, sfx in file_rules.LANGUAGE_SUFFIXES.items())}
              ELSE 'unknown' END AS language
  FROM paths)"""
ORACLES["file_filter"] = ctes(PATHS) + """
SELECT doc_id, filename, lockfile, binary_suffix, minified, ignored_dir,
       lockfile OR binary_suffix OR minified OR ignored_dir AS ignored FROM judged"""
ORACLES["file_language"] = ctes(PATHS) + " SELECT doc_id, suffix, language FROM judged"

RAW_FILES = """
kept AS (
  SELECT doc_id, filename, language,
         CASE doc_id % 4 WHEN 0 THEN 'modified' WHEN 1 THEN 'modified' WHEN 2 THEN 'removed' ELSE 'renamed' END AS status,
         CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 9 END AS additions,
         CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id % 7 END AS deletions,
         doc_id % 6 = 0 AS no_patch
  FROM judged WHERE NOT (lockfile OR binary_suffix OR minified OR ignored_dir))"""
ORACLES["file_defaults"] = ctes(PATHS, RAW_FILES) + """
SELECT doc_id, filename, status, additions, deletions, language, no_patch FROM kept"""

# ── diffs ────────────────────────────────────────────────────────────────────────────────────────────

DOC_LINES = """
doc_lines AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM documents)"""
PATCH_LINES = DOC_LINES + """,
made AS (
  SELECT doc_id, pos, pos // 8 AS h, (doc_id + 3 * pos) % 6 AS op, (doc_id + pos) % 19 = 0 AS blank,
         CASE WHEN (doc_id + pos) % 13 = 0 THEN '++x' WHEN (doc_id + pos) % 17 = 0 THEN '-- y' ELSE line END AS body,
         pos = max(pos) OVER (PARTITION BY doc_id) AS is_last
  FROM doc_lines),
typed AS (
  SELECT *, CASE WHEN op <= 1 THEN '+' || body WHEN op = 2 THEN '-' || body WHEN blank THEN '' ELSE ' ' || body END AS raw,
         CASE WHEN op <= 1 AND body NOT LIKE '++%' THEN 'add' WHEN op = 2 AND body NOT LIKE '--%' THEN 'del' ELSE 'ctx' END AS kind
  FROM made),
patch_lines AS (
  SELECT doc_id, h + 1 AS hunk, pos - 8 * h + 1 AS pos, kind, raw,
         1 + 100 * h + count(*) FILTER (kind <> 'add') OVER w - (kind <> 'add')::INT AS old_no,
         1 + 101 * h + count(*) FILTER (kind <> 'del') OVER w - (kind <> 'del')::INT AS new_no
  FROM typed WHERE NOT (is_last AND raw = '')
  WINDOW w AS (PARTITION BY doc_id, h ORDER BY pos))"""
ORACLES["diff_lines"] = ctes(PATCH_LINES) + """
SELECT doc_id, hunk, pos, kind, CASE WHEN kind <> 'add' THEN old_no END AS old_line,
       CASE WHEN kind <> 'del' THEN new_no END AS new_line, raw AS line FROM patch_lines"""
ORACLES["diff_changed_lines"] = ctes(PATCH_LINES) + """
SELECT d.doc_id, coalesce(string_agg(new_no::VARCHAR, ',' ORDER BY hunk, pos) FILTER (kind = 'add'), '') AS changed_lines,
       coalesce(string_agg(old_no::VARCHAR, ',' ORDER BY hunk, pos) FILTER (kind = 'del'), '') AS deleted_lines
FROM documents d LEFT JOIN patch_lines p ON p.doc_id = d.doc_id GROUP BY d.doc_id"""
ORACLES["diff_added_text"] = ctes(PATCH_LINES) + """
SELECT doc_id, new_no AS line, substr(raw, 2) AS text FROM patch_lines WHERE kind = 'add'"""
HEADER = "'@@ -' || (1 + 100 * h) || ',8 +' || (1 + 101 * h) || ',8 @@ sec ' || h"
ORACLES["diff_hunks"] = ctes(PATCH_LINES, """
heads AS (SELECT DISTINCT doc_id, pos // 8 AS h FROM doc_lines)""") + f"""
SELECT heads.doc_id, h + 1 AS hunk, 1 + 100 * h AS old_start, 8 AS old_lines, 1 + 101 * h AS new_start, 8 AS new_lines,
       'sec ' || h AS header, 1 + count(p.pos) AS n_lines,
       {HEADER} || coalesce(chr(10) || string_agg(raw, chr(10) ORDER BY pos), '') AS raw,
       coalesce(string_agg(new_no::VARCHAR, ',' ORDER BY pos) FILTER (kind = 'add'), '') AS modified_new_lines
FROM heads LEFT JOIN patch_lines p ON p.doc_id = heads.doc_id AND p.hunk = h + 1 GROUP BY heads.doc_id, h"""
ORACLES["parse_gate"] = ctes(PATHS, RAW_FILES, PATCH_LINES) + """
SELECT kept.doc_id, count(*) AS n_changed FROM kept JOIN patch_lines USING (doc_id)
WHERE status <> 'removed' AND NOT no_patch AND kind = 'add' GROUP BY kept.doc_id"""
ORACLES["whole_tree_diff"] = ctes(PATCH_LINES) + """
SELECT tree, n_hunks::BIGINT AS n_hunks, coalesce(n_added, 0)::BIGINT AS n_added
FROM (SELECT doc_id // 10 AS tree, sum(pos // 8 + 1) AS n_hunks
      FROM (SELECT doc_id, max(pos) AS pos FROM doc_lines GROUP BY doc_id) GROUP BY doc_id // 10)
LEFT JOIN (SELECT doc_id // 10 AS tree, count(*) AS n_added FROM patch_lines WHERE kind = 'add' GROUP BY doc_id // 10) USING (tree)"""

# ── scopes and rule scans over the code lines ────────────────────────────────────────────────────────

RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"({n}, {q(r.rule_id)}, {q(r.category)}, {q(r.severity)}, {q(r.title)}, {q(r.pattern)}, {q(r.message)}, "
    f"{q(r.suggested_fix)}, {r.confidence}::DOUBLE, {r.needs_async}, {r.min_loop_depth})"
    for n, r in enumerate(LINE_RULES, 1)
) + """) t(rule_no, rule_id, category, severity, title, pattern, message, suggested_fix, confidence_score, needs_async, min_depth))"""
CODE = DOC_LINES + f""",
code AS (
  SELECT doc_id, pos // 16 AS blk, pos % 16 + 1 AS ln, pos + 1 AS line,
         {arr(inputs.CODE)}[(doc_id * 7 + pos) % {len(inputs.CODE)} + 1] AS text, (doc_id + pos) % 3 <> 0 AS changed
  FROM doc_lines),
n_lines AS (SELECT doc_id, max(line) AS n FROM code GROUP BY doc_id),
spans AS (
  SELECT doc_id, blk, blk * 3 + k AS visit, nm || '_' || blk AS name, blk * 16 + f AS s, least(n, blk * 16 + t) AS e, is_class
  FROM (SELECT DISTINCT doc_id, blk FROM code) JOIN n_lines USING (doc_id)
  CROSS JOIN (VALUES (1, 'm0', 3, 8, false), (2, 'm1', 9, 14, false), (3, 'C', 1, 15, true)) v(k, nm, f, t, is_class)
  WHERE blk * 16 + f <= n),
within AS (
  SELECT code.doc_id, line, ln, text, changed, visit, name, s, e, is_class
  FROM code JOIN spans ON code.doc_id = spans.doc_id AND code.blk = spans.blk AND line BETWEEN s AND e),
own AS (SELECT * FROM within WHERE changed AND (NOT is_class OR ln IN (1, 2, 15))),
scoped AS (SELECT w.* FROM within w JOIN (SELECT DISTINCT doc_id, visit FROM own) USING (doc_id, visit) WHERE changed)"""
ORACLES["scope_join"] = ctes(CODE) + " SELECT doc_id, line, visit, name FROM within WHERE changed"
ORACLES["class_residual"] = ctes(CODE) + " SELECT doc_id, name, line FROM own WHERE is_class"
ORACLES["unscoped_lines"] = ctes(CODE) + " SELECT doc_id, line FROM code WHERE changed AND ln = 16"
ORACLES["symbol_modified_lines"] = ctes(CODE) + """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, visit) AS symbol_ord, visit, name, modified_lines
FROM (SELECT doc_id, visit, name, s, string_agg(line::VARCHAR, ',' ORDER BY line) AS modified_lines
      FROM own GROUP BY doc_id, visit, name, s)"""
ORACLES["symbols_modified"] = ctes(CODE) + """
SELECT doc_id, count(DISTINCT visit) AS symbols_modified FROM own GROUP BY doc_id"""

# depth by folding the steps one by one, floor at zero
DEPTH = CODE + """,
stepped AS (
  SELECT *, CASE WHEN ltrim(text) LIKE 'for %' OR ltrim(text) LIKE 'while %' THEN 1
                 WHEN length(text) - length(ltrim(text)) <= 4 THEN -1 ELSE 0 END AS step FROM within),
deep AS (
  SELECT doc_id, visit, line,
         list_reduce(list_prepend(0, list(step) OVER (PARTITION BY doc_id, visit ORDER BY line)),
                     lambda a, x: greatest(0, a + x)) AS loop_depth
  FROM stepped),
async_scopes AS (SELECT doc_id, visit, bool_or(contains(text, 'async ')) AS is_async FROM within GROUP BY doc_id, visit)"""
ORACLES["loop_depth"] = ctes(DEPTH) + " SELECT doc_id, visit, line, loop_depth FROM deep"


def scan_sql(category: str) -> str:
    return ctes(RULES, CODE) + f"""
SELECT doc_id, line, name AS symbol_name, rule_id, severity FROM scoped JOIN rules ON regexp_matches(text, pattern)
WHERE category = {q(category)}"""


ORACLES["scan_security"] = scan_sql("security")
ORACLES["scan_logic"] = scan_sql("bug_risk")
ORACLES["scan_quality"] = scan_sql("code_quality")
GUARDED = "(NOT needs_async OR is_async) AND loop_depth >= min_depth"
ORACLES["scan_performance"] = ctes(RULES, DEPTH) + f"""
SELECT doc_id, line, name AS symbol_name, rule_id, severity
FROM scoped JOIN deep USING (doc_id, visit, line) JOIN async_scopes USING (doc_id, visit) JOIN rules ON regexp_matches(text, pattern)
WHERE category = 'performance' AND {GUARDED}"""
ORACLES["scan_unscoped"] = ctes(RULES, CODE) + """
SELECT doc_id, line, rule_id, severity FROM code JOIN rules ON regexp_matches(text, pattern)
WHERE changed AND ln = 16 AND category = 'security'"""
ORACLES["missing_docstring"] = ctes(CODE) + f"""
SELECT doc_id, line, name AS symbol_name, {q(DOCSTRING_RULE.title)} AS title FROM scoped WHERE line = s"""
DOC_MESSAGE = "replace({}, '{{symbol}}', name)"
ORACLES["scan_snippets"] = ctes(RULES, DEPTH) + f"""
SELECT doc_id, line AS line_start, name AS symbol_name, category, severity, title, message, suggested_fix, confidence_score
FROM within JOIN deep USING (doc_id, visit, line) JOIN async_scopes USING (doc_id, visit) JOIN rules ON regexp_matches(text, pattern)
WHERE changed AND {GUARDED}
UNION ALL
SELECT doc_id, line, name, {q(DOCSTRING_RULE.category)}, {q(DOCSTRING_RULE.severity)}, {q(DOCSTRING_RULE.title)},
       replace({q(DOCSTRING_RULE.message)}, '{{symbol}}', name), replace({q(DOCSTRING_RULE.suggested_fix)}, '{{symbol}}', name),
       {DOCSTRING_RULE.confidence}::DOUBLE
FROM within WHERE changed AND line = s AND NOT (s = e AND text = '')"""
ORACLES["scan_custom_rule"] = ctes(DOC_LINES) + f"""
SELECT doc_id, pos, {q(CUSTOM_RULE.rule_id)} AS rule_id, {q(CUSTOM_RULE.severity)} AS severity, {q(CUSTOM_RULE.title)} AS title
FROM doc_lines WHERE regexp_matches(line, {q(CUSTOM_RULE.pattern)})"""

# ── scopes from source ───────────────────────────────────────────────────────────────────────────────

BLOCKS = """
blocks AS (
  SELECT doc_id, unnest(range((len(string_split(text, chr(10))) - 1) // 16 + 1)) AS b FROM documents)"""
ASYNC_CODE = [i for i, line in enumerate(inputs.CODE) if "async " in line]


def code_index(line: str) -> str:
    return f"((doc_id * 7 + 16 * b + {line} - 1) % {len(inputs.CODE)})"


HAS_ASYNC = "(" + " OR ".join(f"{code_index(str(n))} IN ({', '.join(map(str, ASYNC_CODE))})" for n in (4, 5, 6)) + ")"
ORACLES["scopes_indent"] = ctes(BLOCKS) + f"""
SELECT doc_id, 3 * b + k AS visit, CASE k WHEN 3 THEN 'C' || b ELSE 'C' || b || '.m' || (k - 1) END AS name,
       CASE k WHEN 3 THEN 'class_definition' ELSE 'function_definition' END AS node_type,
       CASE WHEN k < 3 THEN 'C' || b END AS parent_symbol,
       16 * b + f AS start_line, 16 * b + t AS end_line,
       CASE WHEN k = 3 AND b % 2 = 0 THEN 'Class text.' WHEN k = 2 AND b % 3 = 0 THEN 'Text of m1.' END AS docstring,
       k = 3 AS is_class, k > 1 OR {HAS_ASYNC} AS is_async
FROM blocks CROSS JOIN (VALUES (1, 3, 7), (2, 9, 14), (3, 1, 14)) v(k, f, t)"""
ORACLES["scopes_brace"] = ctes(BLOCKS) + """
SELECT doc_id, 4 * b + k AS visit,
       CASE k WHEN 1 THEN 'K' || b || '.run' WHEN 2 THEN 'K' || b WHEN 3 THEN 'f' || b ELSE 'g' || b END AS name,
       nt AS node_type, CASE WHEN k = 1 THEN 'K' || b END AS parent_symbol,
       16 * b + f AS start_line, 16 * b + t AS end_line,
       CASE WHEN k = 1 AND b % 2 = 0 THEN '/** Runs. */' END AS docstring, k = 2 AS is_class, k = 3 AS is_async
FROM blocks CROSS JOIN (VALUES (1, 3, 8, 'method_definition'), (2, 1, 9, 'class_declaration'), (3, 10, 12, 'arrow_function'),
                               (4, 13, 15, 'function_declaration')) v(k, f, t, nt)"""
RUN_TEXT = """'run(a) {' || chr(10) || CASE WHEN (doc_id + b) % 2 = 0 THEN '    if (a) { return 1; }' ELSE '    await this.load({ a: 1 });' END
         || chr(10) || '    for (const x of a) {' || chr(10) || '      use(x);' || chr(10) || '    }' || chr(10) || '  }'"""
ORACLES["scope_snippets"] = ctes(BLOCKS) + f"""
SELECT doc_id, 4 * b + k AS visit,
       CASE k WHEN 1 THEN {RUN_TEXT}
              WHEN 2 THEN 'class K' || b || ' {{' || chr(10) || CASE WHEN b % 2 = 0 THEN '  /** Runs. */' ELSE '  // plain' END
                          || chr(10) || '  ' || {RUN_TEXT} || chr(10) || '}}'
              WHEN 3 THEN 'const f' || b || ' = async (v) => {{' || chr(10) || '  return v;' || chr(10) || '}};'
              ELSE 'export function g' || b || '(a) {{' || chr(10) || '  return a;' || chr(10) || '}}' END AS code_snippet
FROM blocks CROSS JOIN (VALUES (1), (2), (3), (4)) v(k)"""

# ── model replies ────────────────────────────────────────────────────────────────────────────────────

REPLY_ROWS = """
reply_rows AS (
  SELECT l_orderkey AS review, l_partkey % 11 AS c, l_linenumber, l_partkey, l_suppkey, l_quantity,
         substr(o_orderpriority, 1, 1)::INT AS p, l_orderkey % 23 = 0 AS bad,
         [0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 0.69][l_linenumber]::DOUBLE AS conf,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS item_ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
kept_items AS (
  SELECT review, item_ord,
         CASE WHEN c = 9 THEN 'unknown' ELSE 'f' || l_suppkey || '.py' END AS file,
         CASE WHEN c = 8 THEN 12 ELSE l_linenumber END AS line_start,
         CASE WHEN c = 8 THEN 12 ELSE l_linenumber END AS line_end,
         NULL::VARCHAR AS symbol_name,
         CASE c WHEN 3 THEN 'medium' WHEN 4 THEN 'high' WHEN 5 THEN 'medium'
                ELSE ['critical', 'high', 'medium', 'low', 'info'][p] END AS severity,
         CASE c WHEN 7 THEN 'None' WHEN 10 THEN 'Review Finding' ELSE 't' END AS title,
         'm' || l_partkey AS message,
         CASE WHEN l_suppkey % 2 = 1 THEN 'fix it' END AS suggested_fix,
         CASE c WHEN 0 THEN 1.0 WHEN 2 THEN 0.9 ELSE conf END::DOUBLE AS confidence_score
  FROM reply_rows
  WHERE NOT bad AND c NOT IN (1, 6) AND CASE c WHEN 0 THEN 1.0 WHEN 2 THEN 0.9 ELSE conf END BETWEEN 0.7 AND 1.0)"""
ORACLES["model_decode"] = ctes(REPLY_ROWS) + """
SELECT review, CASE WHEN bad THEN 'not_json' ELSE 'ok' END AS reply_status,
       CASE WHEN bad THEN 'Failed to parse LLM response.' ELSE 's' END AS summary,
       CASE WHEN bad THEN 0 ELSE count(*) + 1 END AS n_items
FROM reply_rows GROUP BY review, bad"""
ORACLES["model_filter"] = ctes(REPLY_ROWS) + " SELECT * FROM kept_items"
ORACLES["merge_findings"] = ctes(REPLY_ROWS, """
places AS (
  SELECT l_orderkey AS review, CASE WHEN l_quantity < 10 THEN 'security' ELSE 'performance' END AS category,
         'f' || l_suppkey || '.py' AS file, l_linenumber AS line_start FROM lineitem)""") + """
SELECT review, category, file, line_start, 'r' AS title, 'rule' AS origin, NULL AS item_ord FROM places
UNION ALL
SELECT review, 'security', file, line_start, title, 'model', item_ord
FROM (SELECT *, row_number() OVER (PARTITION BY review, file, line_start ORDER BY item_ord) AS nth FROM kept_items)
WHERE nth = 1 AND (review, file, line_start) NOT IN (SELECT review, file, line_start FROM places WHERE category = 'security')"""

# ── reviews from findings ────────────────────────────────────────────────────────────────────────────

FINDINGS = """
found AS (
  SELECT o_custkey AS review, 'f' || (l_partkey % 50) || '.py' AS file, l_linenumber AS line_start,
         CASE WHEN l_suppkey % 3 <> 0 THEN 's' || (l_suppkey % 10) END AS symbol_name,
         ['security', 'performance', 'bug_risk', 'code_quality'][l_suppkey % 4 + 1] AS category,
         ['critical', 'high', 'medium', 'low', 'info'][CASE WHEN o_custkey % 5 = 0 THEN greatest(substr(o_orderpriority, 1, 1)::INT, 3)
                                                            ELSE substr(o_orderpriority, 1, 1)::INT END] AS severity,
         (l_quantity::INT % 3)::VARCHAR AS title, 'm' || l_partkey AS message,
         CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE ' use x ' END AS suggested_fix,
         [0.85, 0.88, 0.9, 0.92, 0.95, 1.0, 0.7][l_linenumber]::DOUBLE AS confidence_score,
         CASE WHEN l_orderkey % 4 = 0 THEN 'model' ELSE 'rule' END AS origin,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
uniq AS (
  SELECT * FROM found
  QUALIFY row_number() OVER (PARTITION BY review, file, line_start, category, title
                             ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1),""" + f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY review ORDER BY {SEV_RANK}, file, line_start,
                               l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS finding_ord FROM uniq),
judged AS (
  SELECT c_custkey AS review, CASE WHEN count(file) = 0 THEN 'APPROVE' WHEN bool_or(severity IN ('critical', 'high'))
         THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS verdict, count(file) AS total_findings
  FROM customer LEFT JOIN uniq ON review = c_custkey GROUP BY c_custkey),
agents AS (
  SELECT c_custkey AS review, a.ord AS agent_ord, a.agent AS agent_name, a.cat AS category, count(f.file) AS n_findings,
         NOT coalesce(bool_or(f.severity IN ('critical', 'high')), false) AS passed,
         CASE WHEN c_custkey % 2 = 0 AND c_custkey % 10 <> 0 AND ['security', 'performance', 'bug_risk', 'code_quality'][c_custkey % 4 + 1] = a.cat
                   AND count(f.file) FILTER (f.origin = 'rule') = 0 THEN 'model says fine'
              WHEN NOT coalesce(bool_or(f.severity IN ('critical', 'high')), false) THEN a.ok
              ELSE a.bad1 || count(f.file) || a.bad2 END AS summary
  FROM customer CROSS JOIN (VALUES {", ".join(f"({n}, {q(a.name)}, {q(a.category)}, {q(a.pass_text)}, {q(a.flag_head)}, {q(a.flag_tail)})" for n, a in enumerate(AGENTS, 1))})
       a(ord, agent, cat, ok, bad1, bad2)
  LEFT JOIN found f ON f.review = c_custkey AND f.category = a.cat GROUP BY c_custkey, a.ord, a.agent, a.cat, a.ok, a.bad1, a.bad2)"""
ORACLES["dedupe_findings"] = ctes(FINDINGS) + """
SELECT review, file, line_start, category, title, severity, symbol_name, message, l_orderkey, l_partkey FROM uniq"""
ORACLES["rank_findings"] = ctes(FINDINGS) + """
SELECT review, finding_ord, severity, file, line_start, category, title, message FROM ranked"""
ORACLES["verdict"] = ctes(FINDINGS) + " SELECT * FROM judged"
ORACLES["agent_results"] = ctes(FINDINGS) + " SELECT review, agent_ord, agent_name, category, n_findings, passed FROM agents"
ORACLES["agent_summary"] = ctes(FINDINGS) + " SELECT review, agent_name, summary FROM agents"
ORACLES["dry_run"] = ctes(FINDINGS) + """
SELECT 'dry_run' AS status, 'org/repo' || c_nationkey AS repo, c_custkey AS pr_number, verdict, total_findings AS inline_comments_count
FROM judged JOIN customer ON c_custkey = review"""
SYMBOL = "CASE WHEN symbol_name IS NULL THEN '' ELSE ' in `' || symbol_name || '`' END"
BRAND = report_texts.Brand()
ORACLES["inline_comments"] = ctes(FINDINGS) + f"""
SELECT review, finding_ord AS comment_ord, file AS path, line_start AS line, 'RIGHT' AS side,
       {case("severity", {s[0]: s[3] for s in SEVERITIES})} || ' **' || title || '** (' ||
       {case("category", {a.category: a.comment_label for a in AGENTS})} || ')' || {SYMBOL} || {NL} || {NL} || message ||
       CASE WHEN l_partkey % 4 > 1 THEN {NL} || {NL} || '```suggestion' || {NL} || 'use x' || {NL} || '```' ELSE '' END ||
       {NL} || {NL} || '> *Confidence: `' || trunc(confidence_score * 100)::INT || '%` | {BRAND.signer}*' AS body
FROM ranked"""
ORACLES["submission_payload"] = ctes(FINDINGS, """
sided AS (
  SELECT DISTINCT o_custkey AS review, 'f' || (l_partkey % 50) || '.py' AS file,
         CASE WHEN l_partkey % 40 = 0 THEN l_linenumber + 1000 ELSE l_linenumber END AS line_start
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
off_side AS (SELECT DISTINCT review FROM uniq WHERE (review, file, line_start) NOT IN (SELECT review, file, line_start FROM sided))""") + f"""
SELECT j.review, CASE WHEN o.review IS NULL THEN 'success' ELSE 'fallback_success' END AS status,
       CASE WHEN o.review IS NOT NULL AND verdict = 'REQUEST_CHANGES' THEN 'COMMENT' ELSE verdict END AS event, verdict,
       CASE WHEN o.review IS NULL THEN total_findings ELSE 0 END AS inline_comments_posted,
       CASE WHEN o.review IS NOT NULL THEN {q(report_texts.FALLBACK_NOTE)} END AS note
FROM judged j LEFT JOIN off_side o ON o.review = j.review"""
REPORT_BLOCK = f"""'#### ' || finding_ord || '. ' || {case("severity", {s[0]: s[2] for s in SEVERITIES})} || ' **' || title || '** (' ||
       {case("category", {a.category: a.report_label for a in AGENTS})} || ')' || {NL} || '- **Location:** `' || file || ':' || line_start || '`' || {SYMBOL}
       || {NL} || '- **Details:** ' || message || {NL} || CASE WHEN suggested_fix IS NULL THEN '' ELSE '- **Recommendation:**' || {NL} ||
       '  ```suggestion' || {NL} || '  ' || suggested_fix || {NL} || '  ```' || {NL} END"""
ORACLES["report_markdown"] = ctes(FINDINGS, f"""
agent_part AS (
  SELECT review, string_agg('| **' || agent_name || '** | ' || {case("category", {a.category: a.report_label for a in AGENTS})} || ' | ' || n_findings || ' | ' ||
         CASE WHEN passed THEN 'Pass' ELSE 'Issues Found' END || ' |', {NL} ORDER BY agent_ord) AS agent_text FROM agents GROUP BY review)""") + f"""
SELECT review, finding_ord::BIGINT AS block_ord, {REPORT_BLOCK} AS body FROM ranked
UNION ALL
SELECT review, total_findings + 1, '---' || {NL} || '*{BRAND.footer}*' FROM judged
UNION ALL
SELECT p.review, 0, '## {BRAND.heading} — ' || {case("verdict", VERDICT_BADGES)} || {NL} || {NL} || '**PR #' || p.review || ':** ' || c_name || '  '
       || {NL} || '**Author:** @' || lower(c_mktsegment) || ' | **Commit:** `' || substr(lpad((p.review * 7919)::VARCHAR, 12, '0'), 1, 8)
       || '` | **Analysis Time:** `' || (p.review % 1000) || '.5 ms`' || {NL} || {NL} || '### Review Overview' || {NL}
       || '| Agent | Category | Findings | Status |' || {NL} || '|---|---|:---:|:---:|' || {NL} || agent_text || {NL} || {NL}
       || CASE WHEN total_findings = 0 THEN {q(report_texts.ALL_CLEAR)} ELSE '### Detailed Findings' || {NL} END
FROM judged p JOIN customer ON c_custkey = p.review JOIN agent_part a ON a.review = p.review"""
ORACLES["review_sink"] = ctes(FINDINGS) + f"""
SELECT j.review, j.verdict, j.total_findings, 0 AS part, 1 AS n_parts, body_sha256
FROM judged j JOIN (SELECT review, sha256(string_agg(body, {NL} ORDER BY block_ord)) AS body_sha256
                    FROM ({ORACLES["report_markdown"]}) GROUP BY review) b ON b.review = j.review"""
ORACLES["token_estimate"] = ctes(PATCH_LINES.replace("patch_lines AS", "unused AS"), f"""
patch_chars AS (
  SELECT doc_id, sum(length(raw)) + count(*) - 1 AS chars FROM typed GROUP BY doc_id),
head_chars AS (
  SELECT doc_id, sum(length({HEADER}) + 1) AS chars FROM (SELECT DISTINCT doc_id, pos // 8 AS h FROM doc_lines) GROUP BY doc_id)""",
    CODE.split("),\ncode AS", 1)[1].join(["code AS", ""]), """
snips AS (
  SELECT doc_id, visit, sum(length(text)) + count(*) - 1 AS chars FROM within GROUP BY doc_id, visit),
snip_docs AS (SELECT doc_id, count(*) AS n, sum(chars) AS chars FROM snips GROUP BY doc_id)""") + """
SELECT doc_id // 10 AS review, count(*) AS n_files, sum(coalesce(s.n, 0))::BIGINT AS symbols_modified,
       greatest(1, (sum(p.chars) + sum(h.chars) + coalesce(sum(s.chars), 0))::BIGINT // 4) AS estimated_tokens
FROM patch_chars p JOIN head_chars h USING (doc_id) LEFT JOIN snip_docs s USING (doc_id) GROUP BY doc_id // 10"""

# ── events ───────────────────────────────────────────────────────────────────────────────────────────

_KEY = inputs.SECRET.encode().ljust(64, b"\0")
assert len(inputs.SECRET) <= 64
IPAD, OPAD = (bytes(b ^ x for b in _KEY).hex() for x in (0x36, 0x5C))
EVENTS = f"""
bodies AS (
  SELECT event_id AS e, user_id, CASE WHEN event_type = 'error' THEN 'ping' ELSE 'pull_request' END AS kind,
         CASE event_type WHEN 'click' THEN 'opened' WHEN 'view' THEN 'synchronize' WHEN 'purchase' THEN 'reopened' ELSE 'closed' END AS action
  FROM events),
texts AS (
  SELECT *, '{{"action":"' || action || '","number":' || e || ',"pull_request":{{"number":' || e || ',' ||
         CASE WHEN e % 10 = 0 THEN '' ELSE '"title":"Change ' || e || '",' END || '"state":"open","head":{{"sha":"sha' || e ||
         '","ref":"feat/' || (e % 7) || '"}},"base":{{"sha":"base","ref":"main"}},"user":{{"login":"someone","id":1}},' ||
         '"html_url":"https://example.org/p/' || e || '","diff_url":"https://example.org/p/' || e ||
         '.diff","patch_url":"https://example.org/p/' || e || '.patch","additions":' || (e % 50) ||
         '}},"repository":{{"id":9,"name":"r","full_name":"org/r' || (e % 13) || '","clone_url":"HTTPS://Example.ORG:443"}},' ||
         '"sender":{{"login":"u' || user_id || '","id":2}}' ||
         CASE WHEN e % 4 = 0 THEN '' ELSE ',"installation":{{"id":' || (e % 100) || '}}' END || '}}' AS body FROM bodies),
signed AS (
  SELECT *, CASE e % 7 WHEN 0 THEN NULL WHEN 1 THEN 'md5=abc' WHEN 2 THEN 'sha256=00'
            ELSE 'sha256=' || sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}') || encode(body)))) END AS signature FROM texts),
states AS (
  SELECT *, CASE WHEN signature IS NULL THEN 'missing' WHEN signature NOT LIKE 'sha256=%' THEN 'malformed'
                 WHEN substr(signature, 8) <> sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}') || encode(body)))) THEN 'mismatch'
                 ELSE 'valid' END AS state FROM signed),
disposed AS (
  SELECT *, CASE WHEN state <> 'valid' THEN state WHEN kind = 'ping' THEN 'ignored_event' WHEN e % 10 = 0 THEN 'invalid_payload'
                 WHEN action = 'closed' THEN 'ignored_action' ELSE 'accepted' END AS disposition FROM states)"""
ORACLES["signature_audit"] = ctes(EVENTS) + " SELECT e::VARCHAR AS delivery_id, state AS signature_state, sha256(unhex('" + OPAD + "') || unhex(sha256(unhex('" + IPAD + "') || encode(body)))) AS digest FROM states"
ORACLES["event_disposition"] = ctes(EVENTS) + " SELECT e::VARCHAR AS delivery_id, disposition FROM disposed"
ORACLES["disposition_counts"] = ctes(EVENTS) + " SELECT disposition, count(*) AS deliveries FROM disposed GROUP BY disposition"
CONTEXT = {
    "installation_id": "CASE WHEN e % 4 <> 0 THEN e % 100 END", "repo_full_name": "'org/r' || (e % 13)",
    "repo_clone_url": "'https://example.org/'", "pr_number": "e", "pr_title": "'Change ' || e", "head_sha": "'sha' || e",
    "head_branch": "'feat/' || (e % 7)", "base_branch": "'main'", "author_login": "'u' || user_id", "additions": "e % 50",
    "deletions": "0", "changed_files": "0",
}
ORACLES["event_context"] = ctes(EVENTS) + " SELECT e::VARCHAR AS delivery_id, " + ", ".join(
    f"{v} AS {k}" for k, v in CONTEXT.items()) + " FROM disposed WHERE disposition = 'accepted'"
ORACLES["stream_intake"] = ctes(EVENTS) + " SELECT e::VARCHAR AS delivery_id, disposition, " + ", ".join(
    f"CASE WHEN disposition = 'accepted' THEN {v} END AS {k}" for k, v in CONTEXT.items()) + " FROM disposed"

# ── prompts ──────────────────────────────────────────────────────────────────────────────────────────

PROMPT_ROWS = f"""
full_patch AS (
  SELECT doc_id, string_agg(CASE WHEN pos % 8 = 0 THEN {HEADER} || {NL} || raw ELSE raw END, {NL} ORDER BY pos) AS patch
  FROM typed GROUP BY doc_id),
changed_list AS (
  SELECT d.doc_id, '[' || coalesce(string_agg(new_no::VARCHAR, ', ' ORDER BY hunk, pos) FILTER (kind = 'add'), '') || ']' AS changed_lines
  FROM documents d LEFT JOIN patch_lines p ON p.doc_id = d.doc_id GROUP BY d.doc_id),
snippet_text AS (
  SELECT doc_id, visit, string_agg(text, {NL} ORDER BY line) AS code_snippet FROM within GROUP BY doc_id, visit),
symbol_rows AS (
  SELECT doc_id, visit, name, s, e, is_class, '[' || string_agg(line::VARCHAR, ', ' ORDER BY line) || ']' AS modified_lines
  FROM own GROUP BY doc_id, visit, name, s, e, is_class),
loose AS (
  SELECT doc_id, '[' || string_agg(line::VARCHAR, ', ' ORDER BY line) || ']' AS unscoped FROM code WHERE changed AND ln = 16 GROUP BY doc_id)"""
CODE_ONLY = CODE.split("),\ncode AS", 1)[1].join(["code AS", ""])


def prompt_sql(full: bool) -> str:
    if full:
        symbol_head = "' (Type: ' || CASE WHEN is_class THEN 'class_definition' ELSE 'function_definition' END || ', Lines ' || s || '-' || e || ', Modified Lines: '"
        section = f"""'### File: `' || doc_id || '` (Status: modified, Language: python)' || {NL} ||
         '**Changed line numbers in new file:** `' || changed_lines || '`' || {NL} ||
         CASE WHEN symbol_text IS NULL THEN '' ELSE '#### Enclosing AST Symbols (Functions / Classes):' || {NL} || symbol_text || {NL} END ||
         CASE WHEN unscoped IS NULL THEN '' ELSE '**Unscoped modified lines (e.g. imports, global config):** `' || unscoped || '`' || {NL} END ||
         '#### Git Unified Patch:' || {NL} || '```diff' || {NL} || patch || {NL} || '```' || {NL} || '---'"""
        head = f"""'# Pull Request: #' || review || ' — Change ' || review || {NL} || '**Repository:** org/app' || {NL} || '**Author:** @dev' || {NL} ||
         '**Base Branch:** `main` | **Head Branch:** `feat`' || {NL} || '**Changes:** +3 / -4 across ' || n || ' file(s)' || {NL} || {NL} ||
         '## Modified Files & Enclosing AST Context:'"""
        closing = f"UNION ALL SELECT review, n + 1, {q(prompt_texts.CLOSING)} FROM counted"
    else:
        symbol_head = "' (lines ' || s || '-' || e || ', changed lines: '"
        section = f"""'### File: `' || doc_id || '` (status: modified, language: python)' || {NL} ||
         CASE WHEN symbol_text IS NULL THEN '' ELSE '#### Changed Code Symbols (Functions/Classes):' || {NL} || symbol_text || {NL} END ||
         '#### Git Unified Diff:' || {NL} || '```diff' || {NL} || patch || {NL} || '```' || {NL}"""
        head = f"""'PR Title: Change ' || review || {NL} || 'Repository: org/app' || {NL} || 'Author: dev' || {NL} || 'Modified Files: ' || n || {NL} || '---'"""
        closing = ""
    return ctes(PATCH_LINES, CODE_ONLY, PROMPT_ROWS, f"""
symbol_texts AS (
  SELECT doc_id, string_agg('```symbol:' || name || {symbol_head} || modified_lines || ')' || {NL} || code_snippet || {NL} || '```',
                            {NL} ORDER BY s, visit) AS symbol_text
  FROM symbol_rows JOIN snippet_text USING (doc_id, visit) GROUP BY doc_id),
section_rows AS (
  SELECT doc_id // 10 AS review, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS block_ord, {section} AS text
  FROM full_patch JOIN changed_list USING (doc_id) LEFT JOIN symbol_texts USING (doc_id) LEFT JOIN loose USING (doc_id)),
counted AS (SELECT review, count(*) AS n FROM section_rows GROUP BY review)""") + f"""
SELECT review, block_ord, text FROM section_rows UNION ALL SELECT review, 0, {head} FROM counted {closing}"""


ORACLES["prompt_corpus"] = prompt_sql(True)
ORACLES["compact_context"] = prompt_sql(False)
ORACLES["prompt_pairs"] = f"""
SELECT review, category, 0 AS part, 1 AS n_parts, sha256(prompt) AS system_prompt_sha256, sha256(user_prompt) AS user_prompt_sha256
FROM (SELECT review, string_agg(text, {NL} ORDER BY block_ord) AS user_prompt FROM ({prompt_sql(True)}) GROUP BY review)
CROSS JOIN (VALUES {", ".join(f"({q(c)}, {q(p)})" for c, p in prompt_texts.SYSTEM_PROMPTS.items())}) s(category, prompt)"""

# ── whole reviews ────────────────────────────────────────────────────────────────────────────────────

MODULES = BLOCKS + f""",
module AS (
  SELECT doc_id, b, ln, 16 * b + ln AS line, (doc_id + 16 * b + ln - 1) % 3 <> 0 AS changed,
         CASE ln WHEN 1 THEN 'class C' || b || ':' WHEN 2 THEN CASE WHEN b % 2 = 0 THEN '    \"\"\"Class text.\"\"\"' ELSE '    size = 1' END
           WHEN 3 THEN '    def m0(self):' WHEN 7 THEN '        return 1' WHEN 8 THEN '' WHEN 9 THEN '    async def m1(self, a=[]):'
           WHEN 10 THEN CASE WHEN b % 3 = 0 THEN '        ''''''Text of m1.''''''' ELSE '        pass' END
           WHEN 14 THEN '        return self' WHEN 15 THEN '# TODO: block ' || b WHEN 16 THEN 'LIMIT' || b || ' = eval("1")'
           ELSE '        ' || {arr(inputs.CODE)}[{code_index("ln")} + 1] END AS text
  FROM blocks CROSS JOIN (SELECT unnest(range(1, 17)) AS ln)),
inside AS (
  SELECT module.*, k, CASE k WHEN 3 THEN 'C' || b ELSE 'C' || b || '.m' || (k - 1) END AS name, 16 * b + f AS s,
         k > 1 OR {HAS_ASYNC} AS is_async,
         CASE k WHEN 3 THEN b % 2 <> 0 WHEN 2 THEN b % 3 <> 0 ELSE true END AS undocumented,
         CASE WHEN ltrim(text) LIKE 'for %' OR ltrim(text) LIKE 'while %' THEN 1
              WHEN length(text) - length(ltrim(text)) <= 4 THEN -1 ELSE 0 END AS step
  FROM module JOIN (VALUES (1, 3, 7), (2, 9, 14), (3, 1, 14)) v(k, f, t) ON ln BETWEEN f AND t),
folded AS (
  SELECT *, list_reduce(list_prepend(0, list(step) OVER (PARTITION BY doc_id, b, k ORDER BY ln)),
                        lambda a, x: greatest(0, a + x)) AS loop_depth FROM inside),
all_found AS (
  SELECT doc_id, line AS line_start, name AS symbol_name, category, severity, title, message, suggested_fix, confidence_score,
         0 AS phase, s, k, line AS line_ord, rule_no
  FROM folded JOIN rules ON regexp_matches(text, pattern) WHERE @SCANNED AND {GUARDED}
  UNION ALL
  SELECT doc_id, line, name, {q(DOCSTRING_RULE.category)}, {q(DOCSTRING_RULE.severity)}, {q(DOCSTRING_RULE.title)},
         replace({q(DOCSTRING_RULE.message)}, '{{symbol}}', name), replace({q(DOCSTRING_RULE.suggested_fix)}, '{{symbol}}', name),
         {DOCSTRING_RULE.confidence}::DOUBLE, 0, s, k, 0, 0
  FROM folded WHERE @SCANNED AND line = s AND undocumented
  @UNSCOPED),
first_found AS (
  SELECT * FROM all_found
  QUALIFY row_number() OVER (PARTITION BY doc_id, line_start, category, title ORDER BY phase, s, k, line_ord, rule_no) = 1)"""
REVIEW_MODULES = MODULES.replace("@SCANNED", "changed").replace("@UNSCOPED", """UNION ALL
  SELECT doc_id, line, NULL, category, severity, title, message, suggested_fix, confidence_score, 1, 0, 0, line, rule_no
  FROM module JOIN rules ON regexp_matches(text, pattern) WHERE changed AND ln > 14 AND category = 'security'""")
LOCAL_MODULES = MODULES.replace("@SCANNED", "true").replace("@UNSCOPED", "")
AGENT_RANK = case("category", {a.category: n for n, a in enumerate(AGENTS, 1)}, "9")
ORACLES["review_findings"] = ctes(RULES, REVIEW_MODULES) + f"""
SELECT doc_id // 5 AS pr_number,
       row_number() OVER (PARTITION BY doc_id // 5 ORDER BY {SEV_RANK}, 'pkg/m' || doc_id || '.py', line_start, {AGENT_RANK},
                          doc_id, phase, s, k, line_ord, rule_no) AS finding_ord,
       'pkg/m' || doc_id || '.py' AS file, line_start, symbol_name, category, severity, title, message, suggested_fix, confidence_score
FROM first_found"""
ORACLES["review_verdicts"] = ctes(RULES, REVIEW_MODULES) + """
SELECT r.pr_number, CASE WHEN u.n IS NULL THEN 'APPROVE' WHEN u.blocked THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS verdict,
       coalesce(u.n, 0) AS total_findings, coalesce(security, 0) AS security, coalesce(performance, 0) AS performance,
       coalesce(bug_risk, 0) AS bug_risk, coalesce(code_quality, 0) AS code_quality
FROM (SELECT DISTINCT doc_id // 5 AS pr_number FROM documents) r
LEFT JOIN (SELECT doc_id // 5 AS pr_number, count(*) AS n, bool_or(severity IN ('critical', 'high')) AS blocked
           FROM first_found GROUP BY doc_id // 5) u USING (pr_number)
LEFT JOIN (SELECT doc_id // 5 AS pr_number, count(*) FILTER (category = 'security') AS security,
                  count(*) FILTER (category = 'performance') AS performance, count(*) FILTER (category = 'bug_risk') AS bug_risk,
                  count(*) FILTER (category = 'code_quality') AS code_quality
           FROM all_found GROUP BY doc_id // 5) c USING (pr_number)"""
ORACLES["review_enrichment"] = ctes(BLOCKS, MODULES.split("),\nmodule AS", 1)[1].join(["module AS", ""]).split(",\nfolded AS")[0], """
patch_sizes AS (
  SELECT doc_id, sum(length(text) + 1) + count(*) - 1
                 + sum(CASE WHEN (line - 1) % 32 = 0 THEN length('@@ -' || line || ',32 +' || line || ',32 @@') + 1 ELSE 0 END) AS chars
  FROM module GROUP BY doc_id),
snip_sizes AS (
  SELECT doc_id, sum(chars) AS chars, count(*) AS n
  FROM (SELECT doc_id, b, k, sum(length(CASE WHEN line = s THEN ltrim(text) ELSE text END)) + count(*) - 1 AS chars
        FROM inside GROUP BY doc_id, b, k) GROUP BY doc_id)""") + """
SELECT doc_id // 5 AS pr_number, count(*) AS n_files, sum(n)::BIGINT AS symbols_modified,
       greatest(1, (sum(p.chars) + sum(s.chars))::BIGINT // 4) AS estimated_tokens
FROM patch_sizes p JOIN snip_sizes s USING (doc_id) GROUP BY doc_id // 5"""
ORACLES["local_review"] = ctes(RULES, LOCAL_MODULES) + f"""
SELECT 'pkg/m' || doc_id || '.py' AS review_file,
       row_number() OVER (PARTITION BY doc_id ORDER BY {SEV_RANK}, line_start, {AGENT_RANK}, phase, s, k, line_ord, rule_no) AS finding_ord,
       line_start, symbol_name, category, severity, title
FROM first_found"""

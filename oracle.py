"""SQL counterparts of the named queries, for DuckDB over the driver tables.

Written independently of the engine's plans: rules are a VALUES table crossed with lines, texts
are exploded lines, taint is a recursive query, dedupe and ranks are windows.
"""

from __future__ import annotations

import re

from riskframe import rules, texts
from riskframe.plans import catalog
from riskframe.sources import fixtures

WORD = r"\p{L}\p{N}_"
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + value.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A Python pattern for RE2, which has no look-around: boundaries become consumed characters."""
    pattern = pattern.replace(r"(?<![\w.])", rf"(?:^|[^{WORD}.])")
    pattern = re.sub(r"\\b(?=[A-Za-z0-9_(])", lambda m: rf"(?:^|[^{WORD}])", pattern)
    pattern = pattern.replace(r"\b", rf"(?:[^{WORD}]|$)")
    pattern = pattern.replace(r"[^\s]", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return pattern


def matches(text: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({text}, {q(re2(pattern))}" + (f", '{flags}')" if flags else ")")


def strip(text: str) -> str:
    return f"regexp_replace({text}, {q(f'^[{SPACE}]+|[{SPACE}]+$')}, '', 'g')"


def strip_literals(text: str) -> str:
    for pattern in (r"'''[\s\S]*?'''", r'"""[\s\S]*?"""', r"'(?:\\[^\n]|[^'\\])*'", r'"(?:\\[^\n]|[^"\\])*"'):
        text = f"regexp_replace({text}, {q(pattern)}, '', 'g')"
    return text


BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def lines_of(table: str, key: str, text: str) -> str:
    """Lines of a text column, numbered from 1, without a trailing empty one."""
    return f"""
    SELECT {key}, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (
      SELECT {key}, CASE WHEN l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM (
        SELECT {key}, regexp_split_to_array({text}, {q(BREAK)}) AS l FROM {table}))"""


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in rows) + ")"


def case(column: str, mapping: dict, default) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {column} {whens} ELSE {q(default)} END"


def call_pattern(key: str) -> str:
    if key not in rules.CALL_KEYS:
        return ""
    member = r"(?:\.[A-Za-z_][A-Za-z0-9_]*)?" if key in rules.MEMBER_CALL_KEYS else ""
    return re2(re.escape(key.rstrip("(")) + member + r"\s*\((.*)\)")


def behavior_hits(source: str, rule_list) -> str:
    """Rule matches of a table with ``line`` and ``code``; one branch per rule keeps patterns constant."""

    def args(key: str) -> str:
        pattern = call_pattern(key)
        return strip(f"regexp_extract(line, {q(pattern)}, 1)") if pattern else "''"

    return " UNION ALL ".join(
        f"""SELECT *, {i} AS seq, {q(r.key)} AS pattern, CAST({float(r.points)} AS DOUBLE) AS points,
        {q(r.message)} AS message, {q(r.key in rules.SINK_KEYS)} AS sink,
        {q(r.key in rules.TRUSTED_NETWORK_KEYS)} AS network, {args(r.key)} AS args
        FROM {source} WHERE regexp_matches(code, {q(re2(r.pattern))})"""
        for i, r in enumerate(rule_list)
    )


def secret_hits(source: str, rule_list) -> str:
    return " UNION ALL ".join(
        f"""SELECT *, {100 + i} AS seq, {q(r.pattern)} AS pattern, CAST({float(r.points)} AS DOUBLE) AS points,
        {q(r.label)} AS message FROM {source} WHERE regexp_matches(line, {q(re2(r.pattern))})"""
        for i, r in enumerate(rule_list)
    )


DISCOUNT = case("pattern", rules.LITERAL_DISCOUNTS, rules.DEFAULT_LITERAL_DISCOUNT)
SOURCE = re2("|".join(rules.TAINT_SOURCES))
LITERAL = rf"""^[{SPACE}]*["'].*["'][{SPACE}]*$"""
DYNAMIC = "|".join(re.escape(m) for m in rules.DYNAMIC_MARKERS)
WORDS = f"[{WORD}]+"


def note(*parts: str) -> str:
    return "concat_ws(' ', " + ", ".join(parts) + ")"


def when(test: str, value) -> str:
    return f"CASE WHEN {test} THEN {q(value)} END"


CTE: dict[str, str] = {}

CTE["cf"] = fixtures.CODE_TEXTS
CTE["ct"] = fixtures.CODE_TEXTS
CTE["ml"] = fixtures.MANIFEST_LINES
CTE["ad"] = fixtures.ADVISORIES
CTE["sr"] = fixtures.SCAN_REQUESTS
CTE["rr"] = fixtures.REPO_REQUESTS
CTE["pj"] = fixtures.PACKAGE_JSON
CTE["ru"] = fixtures.REPO_URLS

CTE["ln"] = lines_of("cf", "file_id", "content")
CTE["code"] = f"SELECT file_id, line_no, line, lower(line) AS low, {strip_literals('lower(line)')} AS code FROM ln"
CTE["assign"] = f"""
SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS k FROM (
  SELECT file_id, line_no, low, regexp_extract(line, {q(re2(r'^\s*([A-Za-z_][A-Za-z0-9_]*)\s*='))}, 1) AS variable,
         regexp_matches(low, {q(SOURCE)}) AS src FROM code) WHERE variable <> ''"""
CTE["walk(file_id, k, names)"] = f"""
SELECT file_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM cf
UNION ALL
SELECT w.file_id, a.k, CASE
    WHEN NOT list_contains(w.names, a.variable)
         AND (a.src OR list_has_any(w.names, regexp_extract_all(a.low, {q(WORDS)})))
    THEN list_append(w.names, a.variable) ELSE w.names END
FROM walk w JOIN assign a ON a.file_id = w.file_id AND a.k = w.k + 1"""
CTE["tainted"] = "SELECT file_id, arg_max(names, k) AS names FROM walk GROUP BY file_id"
CTE["fn"] = f"""
SELECT file_id, line_no, coalesce(last_value(name IGNORE NULLS) OVER (
    PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS function
FROM (SELECT file_id, line_no,
        nullif(regexp_extract(line, {q(re2(r'^\s*def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\('))}, 1), '') AS name FROM ln)"""
CTE["hit"] = behavior_hits("code", rules.BEHAVIOR_RULES)
CTE["sink"] = f"""
SELECT *, args <> '' AND NOT lit AS dyn,
       args <> '' AND lit AND NOT built AND NOT src AND variable IS NULL AS fixed
FROM (SELECT h.*, regexp_matches(args, {q(LITERAL)}) AS lit, regexp_matches(args, {q(DYNAMIC)}) AS built,
        regexp_matches(low, {q(SOURCE)}) AS src,
        list_filter(t.names, lambda v: list_contains(regexp_extract_all(lower(h.args), {q(WORDS)}), lower(v)))[1]
          AS variable
      FROM hit h JOIN tainted t USING (file_id) WHERE sink)"""
CTE["boosted"] = f"""
SELECT file_id, line_no, pattern, seq, variable,
       CAST((CASE WHEN dyn THEN 4 ELSE 0 END) + (CASE WHEN built THEN 4 ELSE 0 END)
         + (CASE WHEN src THEN 12 ELSE 0 END) + (CASE WHEN variable IS NOT NULL THEN 12 ELSE 0 END)
         - (CASE WHEN fixed THEN {DISCOUNT} ELSE 0 END) AS DOUBLE) AS boost,
       {note(when('dyn', texts.NOTE_DYNAMIC), when('built', texts.NOTE_BUILT), when('src', texts.NOTE_SOURCE),
             "CASE WHEN variable IS NOT NULL THEN replace(" + q(texts.NOTE_TAINTED) + ", '%s', variable) END",
             when('fixed', texts.NOTE_LITERAL))} AS note
FROM sink"""
CTE["behavior"] = f"""
SELECT file_id, line_no AS line, pattern,
       greatest(0.0, CASE WHEN trusted THEN greatest(0.25, raw - 2) ELSE raw END)::DOUBLE AS severity,
       0 AS src_rank, seq, 'suspicious_behavior' AS type, message,
       {note(when('trusted', texts.NOTE_TRUSTED), "nullif(note, '')")} AS note
FROM (SELECT h.*, points + coalesce(b.boost, 0) AS raw, b.note,
        h.network AND (f.function IN ({', '.join(q(n) for n in rules.TRUSTED_NETWORK_FUNCTIONS)})
          OR regexp_matches(low, {q('|'.join(re.escape(w) for w in rules.TRUSTED_NETWORK_HINTS))})) AS trusted
      FROM hit h LEFT JOIN boosted b USING (file_id, line_no, pattern, seq) JOIN fn f USING (file_id, line_no))"""
CTE["secret"] = f"""
SELECT file_id, line_no AS line, pattern, CAST(points AS DOUBLE) AS severity, 0 AS src_rank, seq, 'secret' AS type,
       message, '' AS note
FROM ({secret_hits("ln", rules.SECRET_RULES)})"""

# Signals of the whole text.
_signal = {k: re2(p) for k, p in rules.SIGNALS.items()}
_blob = rf"[A-Za-z0-9+/]{{{rules.BLOB_LENGTH}}}"
CTE["whole"] = f"SELECT file_id, content, lower({strip_literals('content')}) AS code FROM cf"
_fires = {
    "obfuscated_execution": f"regexp_matches(code, {q(_signal['exec'])}) AND regexp_matches(code, {q(_signal['decode'])})",
    "download_execute_chain":
        f"regexp_matches(code, {q(_signal['download'])}) AND regexp_matches(code, {q(_signal['system'])})",
    "high_entropy_blob": f"regexp_matches(content, {q(_blob)})",
    # Doubling the parenthesis leaves one to serve as the boundary of an adjacent call.
    "chr_chain": f"len(regexp_extract_all(replace(code, '(', '(('), {q(_signal['chr'])})) >= {rules.CHR_CHAIN_LENGTH}",
}
CTE["heuristic"] = " UNION ALL ".join(
    f"""SELECT w.file_id, CAST(coalesce((SELECT min(line_no) FROM ln AS ln WHERE ln.file_id = w.file_id
          AND {matches('ln.line', _blob if key == 'high_entropy_blob' else pattern, 'i')}), 1) AS BIGINT) AS line,
        {q(key)} AS pattern, CAST({points} AS DOUBLE) AS severity, 2 AS src_rank, {i} AS seq, 'heuristic' AS type,
        {q(message)} AS message, '' AS note
    FROM whole w WHERE {_fires[key]}"""
    for i, (key, points, message, pattern) in enumerate(rules.HEURISTICS)
)

# Call sites of the input snippets, derived by hand from the language's syntax:
# (snippet, seq, line, pattern, kind of first argument, argument carries outside data, function)
CALL_SITES = [
    (1, 0, 3, "os.system", "name", True, ""),
    (2, 0, 1, "eval(", "literal", False, ""),
    (4, 0, 1, "open(", "literal", False, ""),
    (5, 0, 2, "subprocess", "literal", False, ""),
    (6, 0, 2, "exec(", "other", False, ""),
    (7, 0, 2, "requests.get", "literal", False, ""),
    (7, 1, 3, "exec(", "other", False, ""),
    (9, 0, 1, "yaml.load", "other", False, ""),
    (9, 1, 1, "open(", "literal", False, ""),
    (11, 0, 2, "urllib.request.urlopen", "name", False, "fetch_json"),
]
CTE["sites"] = f"""
SELECT doc_id AS file_id, s.* EXCLUDE (snippet) FROM documents JOIN {values(CALL_SITES)}
  AS s(snippet, seq, line, pattern, arg_kind, arg_tainted, fn_name)
  ON s.snippet = CAST(floor(doc_id / 10) AS INT) % 12"""
_points = {r.key: float(r.points) for r in rules.BEHAVIOR_RULES}
_messages = {r.key: r.message for r in rules.BEHAVIOR_RULES}
_trusted_call = (
    f"(arg_kind <> 'none' AND pattern IN ({', '.join(q(k) for k in rules.TRUSTED_NETWORK_KEYS)})"
    f" AND fn_name IN ({', '.join(q(k) for k in rules.TRUSTED_NETWORK_FUNCTIONS)}))"
)
CTE["called"] = f"""
SELECT file_id, line, pattern, greatest(0.0, {case('pattern', _points, 0.0)}
    + (CASE WHEN arg_tainted THEN 12 ELSE 0 END)
    + (CASE arg_kind WHEN 'name' THEN 4 WHEN 'built' THEN 4 WHEN 'literal' THEN -({DISCOUNT}) ELSE 0 END)
    - (CASE WHEN {_trusted_call} THEN 2 ELSE 0 END))::DOUBLE AS severity,
  1 AS src_rank, seq, 'suspicious_behavior' AS type, {case('pattern', _messages, '')} AS message,
  {note(when('arg_tainted', texts.NOTE_CALL_TAINTED),
        case('arg_kind', {'name': texts.NOTE_CALL_VARIABLE, 'built': texts.NOTE_CALL_BUILT,
                          'literal': texts.NOTE_LITERAL}, None),
        when(_trusted_call, texts.NOTE_CALL_TRUSTED))} AS note
FROM sites"""
_union = "SELECT * FROM behavior UNION ALL SELECT * FROM secret UNION ALL SELECT * FROM heuristic"
_dedupe = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
    PARTITION BY file_id, line, pattern ORDER BY severity DESC, src_rank, seq) AS rn FROM {}) WHERE rn = 1"""
CTE["every_expr"] = _union
CTE["every_full"] = _union + " UNION ALL SELECT * FROM called"
CTE["found_expr"] = _dedupe.format("every_expr")
CTE["found_full"] = _dedupe.format("every_full")

CTE["touch"] = f"""
SELECT file_id, {', '.join(f"{matches('code', p)} AS {name.replace(' ', '_')}" for name, p in rules.TOUCHES)},
       file_id IN (SELECT file_id FROM secret) AS secrets FROM whole"""
_touch_names = [name for name, _ in rules.TOUCHES] + ["secrets"]
_touch_text = "concat_ws('|', " + ", ".join(when(n.replace(" ", "_"), n) for n in _touch_names) + ")"
_norm = f"lower({strip('intent')})"
_meaningful = (
    f"({_norm} NOT IN ({', '.join(q(i) for i in rules.GENERIC_INTENTS)}) AND length({_norm}) >= {rules.MIN_INTENT_LENGTH})"
)
_checks = [
    (f"({touch.replace(' ', '_')} AND {_meaningful} AND NOT "
     f"regexp_matches(lower(intent), {q('|'.join(re.escape(w) for w in words))}))", penalty, message)
    for touch, penalty, message, words in rules.INTENT_CHECKS
] + [("secrets", rules.SECRET_PENALTY, rules.SECRET_MISMATCH)]


def verdict(found: str) -> dict[str, str]:
    suffix = found.split("_")[1]
    sentences = [(n.replace(" ", "_"), s) for n, s in rules.BEHAVIOR_SENTENCES.items()]
    sentences += [
        (f"file_id IN (SELECT file_id FROM {found} WHERE pattern = {q(k)})", s)
        for k, s in rules.CHAIN_SENTENCES.items()
    ]
    sentences.append(("mismatch_count > 0", rules.MISMATCH_SENTENCE))
    listed = "list_filter([" + ", ".join(when(t, s) for t, s in sentences) + "], lambda x: x IS NOT NULL)"
    return {
        f"judged_{suffix}": f"""
SELECT c.file_id, c.repo, c.file_ord, c.path, c.content, t.* EXCLUDE (file_id),
  coalesce(p.finding_points, 0.0) AS finding_points, coalesce(p.n, 0) AS finding_count,
  coalesce(p.finding_points, 0.0) + {' + '.join(f'(CASE WHEN {t} THEN {p} ELSE 0 END)' for t, p, _ in _checks)}
    AS risk_points,
  {_touch_text} AS touches,
  list_filter([{', '.join(when(t, m) for t, _, m in _checks)}], lambda x: x IS NOT NULL) AS mismatches
FROM cf c JOIN touch t USING (file_id)
LEFT JOIN (SELECT file_id, sum(severity) AS finding_points, count(*) AS n FROM {found} GROUP BY file_id) p USING (file_id)""",
        f"scored_{suffix}": f"""
SELECT *, CASE WHEN len(l) = 0 THEN [{q(rules.QUIET_SENTENCE)}] ELSE l END AS sentences FROM (
  SELECT *, {RISK('risk_points')} AS risk, {TRUST('risk_points')} AS trust_score, {listed} AS l FROM (
    SELECT *, CAST(len(mismatches) AS BIGINT) AS mismatch_count FROM judged_{suffix}))""",
    }


def RISK(points: str) -> str:
    return (f"CASE WHEN {points} >= {rules.RED_POINTS} THEN 'red' WHEN {points} >= {rules.YELLOW_POINTS} "
            "THEN 'yellow' ELSE 'green' END")


def TRUST(points: str) -> str:
    return f"CAST(greatest(0, least(100, round_even(CAST(100 - {points} AS DOUBLE), 0))) AS INT)"


CTE.update(verdict("found_expr"))
CTE.update(verdict("found_full"))

CTE["flag"] = """
SELECT f.file_id, f.line, n.n FROM (SELECT DISTINCT file_id, line FROM found_expr) f
JOIN (SELECT file_id, max(line_no) AS n FROM ln GROUP BY file_id) n USING (file_id)"""


def islands(flag: str, key: str) -> str:
    return f"""
SELECT {key}, CAST(greatest(1, min(line) - 2) AS BIGINT) AS start_line, CAST(least(max(n), max(line) + 2) AS BIGINT) AS end_line
FROM (SELECT *, sum(CASE WHEN line - prev <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY line) AS island
      FROM (SELECT *, lag(line) OVER (PARTITION BY {key} ORDER BY line) AS prev FROM {flag}))
GROUP BY {key}, island"""


CTE["window_expr"] = islands("flag", "file_id")


def corpus(table: str, key: str, text: str) -> dict[str, str]:
    return {
        f"{table}_ln": lines_of(table, key, text),
        f"{table}_code": f"SELECT *, {strip_literals('lower(line)')} AS code FROM {table}_ln",
        f"{table}_found": f"""
SELECT {key}, line_no AS line, pattern, CAST(points AS DOUBLE) AS severity, 'suspicious_behavior' AS type, message
FROM ({behavior_hits(f"{table}_code", catalog.CORPUS_BEHAVIOR_RULES)})
UNION ALL
SELECT {key}, line_no, pattern, CAST(points AS DOUBLE), 'secret', message
FROM ({secret_hits(f"{table}_ln", catalog.CORPUS_SECRET_RULES)})""",
    }


CTE.update(corpus("documents", "doc_id", "text"))
CTE.update(corpus("pages", "page_id", "html"))
# The whole-text signals also apply to corpus reports.
CTE["documents_flag"] = f"""
SELECT DISTINCT d.doc_id, d.line, n.n FROM (
  SELECT doc_id, line FROM documents_found
  UNION ALL SELECT doc_id, (SELECT min(line_no) FROM documents_ln l WHERE l.doc_id = documents.doc_id
      AND regexp_matches(l.line, {q(_blob)})) FROM documents WHERE regexp_matches(text, {q(_blob)})) d
JOIN (SELECT doc_id, max(line_no) AS n FROM documents_ln GROUP BY doc_id) n USING (doc_id)"""

# Code file names and weights.
IS_CODE = "regexp_matches(lower(path), " + q(r"\.(" + "|".join(e[1:] for e in rules.CODE_EXTENSIONS) + ")$") + ")"


def percent(path: str, classes) -> str:
    whens = []
    for parts, starts, ends, weight in classes:
        tests = [f"contains(lower({path}), {q(p)})" for p in parts]
        tests += [f"starts_with(lower({path}), {q(p)})" for p in starts]
        tests += [f"ends_with(lower({path}), {q(p)})" for p in ends]
        whens.append(f"WHEN {' OR '.join(tests)} THEN {round(weight * 100)}")
    return f"(CASE {' '.join(whens)} ELSE 100 END)"


# Manifests.
_req = re2(r"^\s*([A-Za-z0-9_.\-]+(?:\[[A-Za-z0-9_,.\-]+\])?)\s*(==|~=|>=|<=|!=|>|<)?\s*([^\s]+)?")
_indirect = "(" + " OR ".join(f"starts_with(t, {q(p)})" for p in rules.INDIRECT_REQUIREMENT_PREFIXES) + ")"


def normalized(raw: str) -> tuple[str, str]:
    """Version and kind of a declared version."""
    v = f"regexp_replace({strip(raw)}, '^[\"'']+|[\"'']+$', '', 'g')"
    prefix = " OR ".join(f"starts_with(lower({v}), {q(p)})" for p in rules.UNSUPPORTED_VERSION_PREFIXES)
    bare = f"regexp_replace({v}, {q(re2(r'^\s*[=v]+\s*'))}, '')"
    base = strip(f"substr({bare}, 2)")
    bad = f"({v} = '' OR {prefix} OR contains({v}, '||') OR contains({v}, ' - ') OR regexp_matches({v}, '[<>*xX]'))"
    ranged = f"(regexp_matches({bare}, '^[\\^~]') AND {base} <> '')"
    exact = f"regexp_matches({bare}, '^[0-9A-Za-z][0-9A-Za-z.+_-]*$')"
    return (
        f"CASE WHEN {bad} THEN NULL WHEN {ranged} THEN {base} WHEN {exact} THEN {bare} END",
        f"CASE WHEN {bad} THEN 'unresolved' WHEN {ranged} THEN 'range-normalized' WHEN {exact} THEN 'exact' "
        "ELSE 'unresolved' END",
    )


_version, _kind = normalized("declared")
CTE["req"] = f"""
SELECT *, {_version} AS v, {_kind} AS kind FROM (
  SELECT *, op || ver AS declared FROM (
    SELECT *, regexp_matches(b, {q(_req)}) AS ok, regexp_extract(b, {q(_req)}, 1) AS name,
           regexp_extract(b, {q(_req)}, 2) AS op, regexp_extract(b, {q(_req)}, 3) AS ver FROM (
      SELECT *, {strip("split_part(" + strip("split_part(t, ' #', 1)") + ", ';', 1)")} AS b FROM (
        SELECT repo, file, line, {strip('raw')} AS t FROM ml))
    WHERE t <> '' AND NOT starts_with(t, '#') AND ({_indirect} OR b <> '')))"""
CTE["entry"] = f"""
SELECT repo, file, line, t AS raw, reason, CASE WHEN reason IS NULL THEN {strip("split_part(name, '[', 1)")} END AS package,
  CASE WHEN reason IS NULL THEN declared END AS declared_version, v AS version,
  CASE WHEN reason IS NULL THEN kind END AS version_kind
FROM (SELECT *, CASE WHEN {_indirect} THEN {q(rules.SKIP_INDIRECT)} WHEN NOT ok THEN {q(rules.SKIP_UNPARSED)}
        WHEN ver = '' THEN {q(rules.SKIP_UNPINNED)} WHEN v IS NULL THEN {q(rules.SKIP_COMPLEX)} END AS reason FROM req)"""
CTE["dep"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
    PARTITION BY repo, file, lower(package), version ORDER BY line) AS rn
  FROM entry WHERE reason IS NULL) WHERE rn = 1"""
_label = f"upper(coalesce(nullif({strip('severity')}, ''), 'UNKNOWN'))"
CTE["adv"] = f"""
SELECT *, {case('severity_label', rules.ADVISORY_POINTS, 5)} AS points FROM (
  SELECT *, {_label} AS severity_label FROM ad)"""
_pct = percent("file", rules.MANIFEST_PATH_WEIGHTS)
CTE["dfind"] = f"""
SELECT d.*, a.id, a.severity_label, CAST(a.points AS DOUBLE) AS base_severity, {_pct} / 100.0::DOUBLE AS path_weight,
  a.points * {_pct} / 100.0::DOUBLE AS severity, a.points * {_pct} AS cents, a.fixed, 'CVE-' || a.id AS alias,
  left(coalesce(nullif({strip('a.summary')}, ''), {q(texts.ADVISORY_DEFAULT_EXPLANATION)})
    || CASE WHEN {_pct} < 100 THEN replace({q(texts.ADVISORY_WEIGHT_NOTE)}, '%s', CAST({_pct} / 100.0::DOUBLE AS VARCHAR))
       ELSE '' END, {rules.MAX_EXPLANATION_CHARS}) AS explanation
FROM dep d JOIN adv a ON a.package = d.package AND a.version = d.version"""
_capped = (f"CAST(format('{{:.2f}}', least({rules.DEPENDENCY_POINTS_CAP}::DOUBLE, "
           f"CAST(sum(cents) AS DOUBLE) / 100.0::DOUBLE * {rules.DEPENDENCY_POINTS_SHARE}::DOUBLE)) AS DOUBLE)")
CTE["dpoints"] = f"SELECT repo, {_capped} AS dependency_risk_points FROM dfind GROUP BY repo"
CTE["droll"] = """
SELECT repo, count(*) AS advisory_count, count(DISTINCT lower(package) || '@' || version) AS unique_package_versions,
  count(DISTINCT nullif(file, '')) AS unique_manifest_files, count(DISTINCT nullif(id, '')) AS unique_vulnerability_ids
FROM dfind GROUP BY repo"""
CTE["msum"] = """
SELECT m.*, coalesce(p.dependency_risk_points, 0.0) AS dependency_risk_points,
  coalesce(r.advisory_count, 0) AS advisory_count, coalesce(r.unique_package_versions, 0) AS unique_package_versions,
  coalesce(r.unique_manifest_files, 0) AS unique_manifest_files,
  coalesce(r.unique_vulnerability_ids, 0) AS unique_vulnerability_ids
FROM (SELECT repo, CAST(1 AS BIGINT) AS manifests_scanned,
        (SELECT count(*) FROM dep WHERE dep.repo = x.repo) AS dependencies_parsed,
        (SELECT count(*) FROM dep WHERE dep.repo = x.repo) AS dependencies_queried,
        (SELECT count(*) FROM entry e WHERE e.repo = x.repo AND reason IS NOT NULL) AS dependencies_skipped_count
      FROM (SELECT DISTINCT repo FROM ml) x) m
LEFT JOIN dpoints p USING (repo) LEFT JOIN droll r USING (repo)"""
_manifest_lines = """list_filter([
  'Scanned ' || manifests_scanned || ' dependency manifest file(s).',
  CASE WHEN dependencies_parsed > 0 THEN 'Parsed ' || dependencies_parsed || ' dependency entries with resolvable versions.' END,
  CASE WHEN dependencies_skipped_count > 0 THEN 'Skipped ' || dependencies_skipped_count
    || ' dependency entries with complex or indirect version specs.' END,
  CASE WHEN advisory_count > 0 THEN 'Found ' || advisory_count || ' dependency advisory finding(s) across '
    || unique_package_versions || ' package/version pair(s).'
    ELSE 'No known dependency vulnerabilities were found in the queried manifest versions.' END], lambda x: x IS NOT NULL)"""

# Advisories from JSON lines: one row per line that is an object, and its affected packages.
CTE["aj"] = fixtures.ADVISORY_JSON
_str = lambda path, j="j": f"CASE WHEN json_type({j}, '{path}') = 'VARCHAR' THEN json_extract_string({j}, '{path}') END"
CTE["ajson"] = "SELECT line_no, CASE WHEN json_valid(value) THEN value::JSON END AS j, value FROM aj"
CTE["agood"] = f"""
SELECT {_str('$.id')} AS id, {_str('$.summary')} AS summary, {_str('$.details')} AS details, {_str('$.published')} AS published,
  CASE WHEN json_type(j, '$.affected') = 'ARRAY' THEN json_extract(j, '$.affected[*]') ELSE [] END AS affected, j
FROM ajson WHERE json_type(j) = 'OBJECT'"""
CTE["aaff"] = """
SELECT id, a, k FROM (SELECT id, unnest(affected) AS a, generate_subscripts(affected, 1) AS k FROM agood) WHERE json_type(a) = 'OBJECT'"""
CTE["afix"] = f"""
SELECT id, list(v ORDER BY first_at)[1:{rules.MAX_FIXED_VERSIONS}] AS fixed FROM (
  SELECT id, v, min(place) AS first_at FROM (
    SELECT id, trim({_str('$.fixed', 'e')}) AS v, row_number() OVER (PARTITION BY id ORDER BY k, r, n) AS place FROM (
      SELECT id, k, r, unnest(ev) AS e, generate_subscripts(ev, 1) AS n FROM (
        SELECT id, k, r, CASE WHEN json_type(rg, '$.events') = 'ARRAY' THEN json_extract(rg, '$.events[*]') ELSE [] END AS ev FROM (
          SELECT id, k, unnest(json_extract(a, '$.ranges[*]')) AS rg, generate_subscripts(json_extract(a, '$.ranges[*]'), 1) AS r FROM aaff))))
  WHERE v <> '' GROUP BY id, v) GROUP BY id"""
CTE["aalias"] = f"""
SELECT id, list(v ORDER BY n)[1:{rules.MAX_ALIASES}] AS aliases FROM (
  SELECT id, n, trim({_str('$', 'x')}) AS v FROM (
    SELECT id, unnest(json_extract(j, '$.aliases[*]')) AS x, generate_subscripts(json_extract(j, '$.aliases[*]'), 1) AS n FROM agood))
WHERE v <> '' GROUP BY id"""
CTE["ascore"] = """
SELECT id, arg_min(level, n) AS level FROM (
  SELECT id, n, CASE WHEN contains(s, 'CRITICAL') THEN 'CRITICAL' WHEN contains(s, 'HIGH') THEN 'HIGH' WHEN contains(s, 'MEDIUM') THEN 'MEDIUM'
    WHEN contains(s, 'LOW') THEN 'LOW' END AS level
  FROM (SELECT id, n, upper(json_extract_string(x, '$.score')) AS s FROM (
    SELECT id, unnest(json_extract(j, '$.severity[*]')) AS x, generate_subscripts(json_extract(j, '$.severity[*]'), 1) AS n FROM agood
    WHERE json_type(j, '$.severity') = 'ARRAY') WHERE json_type(x) = 'OBJECT'))
WHERE level IS NOT NULL GROUP BY id"""
CTE["afact"] = f"""
SELECT g.id, g.published, coalesce(f.fixed, []) AS fixed, coalesce(l.aliases, []) AS aliases,
  coalesce(nullif(trim(summary), ''), nullif(trim(details), ''), {q(texts.ADVISORY_DEFAULT_EXPLANATION)}) AS text,
  coalesce((SELECT upper(arg_min(s, k)) FROM (SELECT k, nullif(trim({_str('$.ecosystem_specific.severity', 'a')}), '') AS s FROM aaff WHERE aaff.id = g.id) WHERE s IS NOT NULL),
    upper(nullif(trim({_str('$.database_specific.severity', 'g.j')}), '')), c.level, 'UNKNOWN') AS severity_label
FROM agood g LEFT JOIN afix f USING (id) LEFT JOIN aalias l USING (id) LEFT JOIN ascore c USING (id)"""
CTE["aref"] = f"""
SELECT DISTINCT id, {_str('$.package.ecosystem', 'a')} AS ecosystem, {_str('$.package.name', 'a')} AS package, {_str('$', 'v')} AS version
FROM (SELECT id, a, unnest(json_extract(a, '$.versions[*]')) AS v FROM aaff)"""

# Manifest files of both kinds. A requirements file lists its lines in order; entries do not depend on their numbers.
CTE["mentry"] = """
SELECT repo, file, 'PyPI' AS ecosystem, package, declared_version, version, version_kind, '' AS dependency_section, raw, reason, line AS ord FROM entry
UNION ALL
SELECT p.repo, p.path, 'npm', e.package, e.declared_version, e.version, e.version_kind, coalesce(e.dependency_section, ''), e.raw, e.reason, 0
FROM pentry e JOIN pj p USING (file_id)"""
CTE["mdep"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY repo, file, lower(package), ecosystem, version ORDER BY ord) AS rn
  FROM mentry WHERE reason IS NULL) WHERE rn = 1"""
CTE["mfind"] = f"""
SELECT d.*, f.id, f.severity_label, f.published, f.fixed, f.aliases, {case('severity_label', rules.ADVISORY_POINTS, 5)} AS base,
  {_pct} / 100.0::DOUBLE AS path_weight, {case('severity_label', rules.ADVISORY_POINTS, 5)} * {_pct} AS cents,
  left(f.text || CASE WHEN {_pct} < 100 THEN replace({q(texts.ADVISORY_WEIGHT_NOTE)}, '%s', CAST({_pct} / 100.0::DOUBLE AS VARCHAR)) ELSE '' END,
    {rules.MAX_EXPLANATION_CHARS}) AS explanation
FROM mdep d JOIN aref r USING (ecosystem, package, version) JOIN afact f ON f.id = r.id"""
CTE["msums"] = f"""
SELECT m.*, (SELECT count(*) FROM mdep d WHERE d.repo = m.repo) AS dependencies_parsed,
  (SELECT count(*) FROM mentry e WHERE e.repo = m.repo AND reason IS NOT NULL) AS dependencies_skipped_count,
  coalesce(p.dependency_risk_points, 0.0) AS dependency_risk_points, coalesce(p.advisory_count, 0) AS advisory_count,
  coalesce(p.unique_package_versions, 0) AS unique_package_versions
FROM (SELECT repo, count(DISTINCT file) AS manifests_scanned FROM (SELECT repo, file FROM ml UNION ALL SELECT repo, path FROM pj) GROUP BY repo) m
LEFT JOIN (SELECT repo, {_capped} AS dependency_risk_points, count(*) AS advisory_count,
    count(DISTINCT lower(package) || '@' || version) AS unique_package_versions FROM mfind GROUP BY repo) p USING (repo)"""

# Repositories.
_weight = percent("path", rules.CODE_PATH_WEIGHTS)
CTE["repo_files"] = f"""
SELECT *, CAST(round(risk_points * 100) AS BIGINT) * {_weight} AS weighted,
  CASE risk WHEN 'red' THEN 2 WHEN 'yellow' THEN 1 ELSE 0 END AS rank FROM scored_full WHERE {IS_CODE}"""
CTE["rolled"] = f"""
SELECT repo, count(*) AS n, CAST(sum(weighted) AS DOUBLE) AS total, max(rank) AS rank,
  {', '.join(f"bool_or({n.replace(' ', '_')}) AS {n.replace(' ', '_')}" for n in _touch_names)} FROM repo_files GROUP BY repo"""


def damped(raw: str) -> str:
    whens = " ".join(f"WHEN {raw} >= {start} THEN {raw} * {percent / 100}::DOUBLE" for start, percent in rules.REPO_DAMPING)
    return f"(CASE {whens} ELSE {raw} END)"


def two(points: str) -> str:
    return f"CAST(format('{{:.2f}}', {points}) AS DOUBLE)"


CTE["repo_scored"] = f"""
SELECT r.*, coalesce(p.dependency_risk_points, 0.0) AS dep,
  {damped("(r.total / 10000.0::DOUBLE / r.n + coalesce(p.dependency_risk_points, 0.0))")} AS points
FROM rolled r LEFT JOIN dpoints p USING (repo)"""
_repo_touches = "concat_ws('|', " + ", ".join(when(n.replace(" ", "_"), n) for n in sorted(_touch_names)) + ")"
CTE["repo_lines"] = """
SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY file_ord, p) - 1 AS pos, sentence FROM (
  SELECT repo, sentence, min(file_ord) AS file_ord, arg_min(p, file_ord * 64 + p) AS p FROM (
    SELECT repo, file_ord, unnest(sentences) AS sentence, generate_subscripts(sentences, 1) AS p FROM repo_files)
  GROUP BY repo, sentence)"""

def _reads(sql: str) -> set[str]:
    """Common tables a statement names after FROM or JOIN."""
    names = set(re.findall(r"\b(?:FROM|JOIN)\s+\(?(\w+)", sql))
    return {name for name in CTE if name.split("(")[0] in names}


# Limits and quota.


def limit(plan: str, field: str, limits) -> str:
    whens = " ".join(
        f"WHEN '{p}' THEN {q(getattr(row, field))}" for p, row in limits.items() if p != rules.DEFAULT_PLAN
    )
    return f"(CASE {plan} {whens} ELSE {getattr(limits[rules.DEFAULT_PLAN], field)} END)"


_tight = catalog.TIGHT_LIMITS
_plan_label = "(upper(left(plan, 1)) || lower(substr(plan, 2)))"
_size = """(CASE WHEN size_limit >= 1000000 THEN format('{:,}', size_limit // 1000000) || ' MB'
  ELSE format('{:,}', size_limit) || ' bytes' END)"""
CTE["rlimit"] = f"""
SELECT *, code_files > file_limit AS many, repo_size_bytes > size_limit AS large FROM (
  SELECT r.request_id, r.repo, r.plan, count(*) FILTER (WHERE {IS_CODE}) AS code_files,
    CAST(coalesce(sum(strlen(content)) FILTER (WHERE {IS_CODE}), 0) AS BIGINT) AS repo_size_bytes,
    {limit('r.plan', 'repo_file_limit', _tight)} AS file_limit,
    CAST({limit('r.plan', 'repo_size_limit_bytes', _tight)} AS BIGINT) AS size_limit
  FROM rr r LEFT JOIN cf c ON c.repo = r.repo GROUP BY r.request_id, r.repo, r.plan)"""




def over_repo_files(names: list[str]) -> None:
    """Copies ``m_...`` of common tables that read all repository files, package.json among them; those have no call sites."""
    CTE["m_cf"] = f"SELECT * REPLACE ('build a report' AS intent) FROM ({fixtures.REPO_FILES})"
    reads = {name: _reads(body) for name, body in CTE.items()}
    closure: set[str] = set()

    def visit(name: str) -> bool:
        if name == "cf":
            return True
        if name not in closure and name not in ("sites", "called") and any([visit(other) for other in reads[name] if other != name]):
            closure.add(name)
        return name in closure

    for name in names:
        visit(name)
    bare = sorted({name.split("(")[0] for name in closure} | {"cf"}, key=len, reverse=True)
    for name in closure:
        CTE[f"m_{name}"] = re.sub(rf"\b(FROM|JOIN)(\s+\(?)({'|'.join(bare)})\b", r"\1\2m_\3", CTE[name])


over_repo_files(["scored_full", "rlimit", "ln"])
CTE["rlimit_plain"] = CTE["m_rlimit"]
for _plan_field in ("repo_file_limit", "repo_size_limit_bytes"):
    CTE["rlimit_plain"] = CTE["rlimit_plain"].replace(limit("r.plan", _plan_field, _tight), limit("r.plan", _plan_field, rules.PLAN_LIMITS))
CTE["rfile"] = f"""
SELECT s.repo, s.file_ord, s.path, s.file_id, p.plan, over, CASE WHEN over THEN 'limit' ELSE s.risk END AS risk,
  CASE WHEN over THEN 100.0 ELSE s.risk_points END AS risk_points, CASE WHEN over THEN [] ELSE s.sentences END AS sentences,
  {_weight} AS percent, {', '.join(f"NOT over AND s.{n.replace(' ', '_')} AS {n.replace(' ', '_')}" for n in _touch_names)}
FROM (SELECT s.*, p.plan, coalesce((SELECT max(line_no) FROM m_ln WHERE m_ln.file_id = s.file_id)
        > {limit('p.plan', 'line_limit', rules.PLAN_LIMITS)}, FALSE) AS over
      FROM m_scored_full s, (SELECT DISTINCT plan FROM rr) p) s JOIN (SELECT DISTINCT repo, plan FROM rlimit_plain WHERE
        NOT (coalesce(many, FALSE) OR coalesce(large, FALSE))) p ON p.repo = s.repo AND p.plan = s.plan WHERE {IS_CODE}"""
CTE["rroll"] = f"""
SELECT repo, plan, count(*) AS n, CAST(sum(CAST(round(risk_points * 100) AS BIGINT) * percent) AS DOUBLE) AS total,
  max(CASE risk WHEN 'red' THEN 2 WHEN 'yellow' THEN 1 ELSE 0 END) AS rank,
  {', '.join(f"bool_or({n.replace(' ', '_')}) AS {n.replace(' ', '_')}" for n in _touch_names)} FROM rfile GROUP BY repo, plan"""
CTE["rsent"] = """
SELECT repo, plan, list(sentence ORDER BY file_ord, p) AS sentences FROM (
  SELECT repo, plan, sentence, min(file_ord) AS file_ord, arg_min(p, file_ord * 64 + p) AS p FROM (
    SELECT repo, plan, file_ord, unnest(sentences) AS sentence, generate_subscripts(sentences, 1) AS p FROM rfile)
  GROUP BY repo, plan, sentence) GROUP BY repo, plan"""


def admitted(source: str, used: str = "0") -> str:
    """The plan is a function of the actor in this input, so admission is a plain rank."""
    return f"""
SELECT *, daily IS NULL OR row_number() OVER (PARTITION BY actor_key, usage_date ORDER BY ts, scan_id) + {used} <= daily
  AS admitted FROM (SELECT *, {limit('plan', 'daily_scan_limit', rules.PLAN_LIMITS)} AS daily FROM {source})"""


CTE["quota"] = admitted("sr")
CTE["morning"] = f"""
SELECT actor_key, usage_date, plan, count(*) AS n FROM ({admitted("(SELECT * FROM sr WHERE hour(ts) < 12)")})
WHERE admitted AND daily IS NOT NULL GROUP BY 1, 2, 3"""
CTE["later"] = f"""
SELECT actor_key, usage_date, plan, count(*) AS n FROM ({admitted(
    "(SELECT s.*, coalesce(m.n, 0) AS used FROM sr s LEFT JOIN morning m USING (actor_key, usage_date) WHERE hour(ts) >= 12)",
    "used")})
WHERE admitted AND daily IS NOT NULL GROUP BY 1, 2, 3"""

_FINAL: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    _FINAL[name] = sql


oracle("scan_files", "SELECT file_id, repo, file_ord, path, CAST(strlen(content) AS BIGINT) AS size_bytes FROM cf")
oracle("code_file_filter", f"SELECT file_id, path FROM cf WHERE {IS_CODE}")
oracle("manifest_filter", f"""
SELECT path, CASE WHEN ends_with(lower(path), 'requirements.txt') THEN 'PyPI' ELSE 'npm' END AS ecosystem, {IS_CODE} AS is_code
FROM (SELECT path FROM cf UNION ALL SELECT path FROM pj UNION ALL SELECT DISTINCT repo || '/' || file FROM ml)
WHERE ends_with(lower(path), 'requirements.txt') OR ends_with(lower(path), 'package.json')""")
oracle("line_explode", "SELECT doc_id, line_no, line FROM documents_ln")
oracle("exclude_blocks", """
SELECT file_id, 4 AS line_no, 'kept' AS line FROM cf
UNION ALL SELECT file_id, line_no + 8, line FROM ln
UNION ALL SELECT file_id, max(line_no) + 12, 'last' FROM ln GROUP BY file_id""")
# Files stored in parts give the same lines.
for _whole, _parts in (("line_explode", "part_lines"), ("exclude_blocks", "part_exclude_blocks")):
    oracle(_parts, _FINAL[_whole])
oracle("part_functions", "SELECT file_id, line_no, function FROM fn")
oracle("strip_literals", f"SELECT file_id, line_no, {strip_literals('lower(line)')} AS code FROM ct_ln")
CTE["ct_ln"] = lines_of("ct", "file_id", "content")
oracle("behavior_findings", "SELECT file_id, line, pattern, severity, type, message, note FROM behavior")
oracle("secret_findings", "SELECT file_id, line, pattern, severity, type, message FROM secret")
oracle("taint_sources", f"SELECT file_id, line_no, line FROM code WHERE regexp_matches(low, {q(SOURCE)})")
oracle("assigned_vars", "SELECT file_id, line_no, variable FROM assign")
oracle("taint_map", "SELECT file_id, generate_subscripts(names, 1) - 1 AS pos, unnest(names) AS variable FROM tainted")
_args = " UNION ALL ".join(
    f"SELECT file_id, line_no, {q(k)} AS pattern, {strip(f'regexp_extract(line, {q(call_pattern(k))}, 1)')} AS args "
    f"FROM ln WHERE regexp_matches(line, {q(call_pattern(k))})"
    for k in rules.CALL_KEYS
)
oracle("call_arguments", _args)
oracle("literal_arguments", f"SELECT *, regexp_matches(args, {q(LITERAL)}) AS is_literal FROM ({_args})")
CTE["trust_text"] = """
SELECT page_id, url || CASE WHEN page_id % 4 = 0 THEN chr(10) || 'use API.OSV.dev' || chr(10) || 'call certifi.where()'
  ELSE chr(10) || 'plain' END AS content FROM pages"""
oracle("trusted_network_lines", f"""
SELECT page_id, line_no, regexp_matches(lower(line), {q('|'.join(re.escape(w) for w in rules.TRUSTED_NETWORK_HINTS))})
  AS is_trusted FROM ({lines_of('trust_text', 'page_id', 'content')})""")
oracle("enclosing_function", "SELECT file_id, line_no, function FROM fn")
oracle("sink_boost", "SELECT file_id, line_no AS line, pattern, boost, note FROM boosted")
oracle("tainted_sinks", "SELECT file_id, line_no AS line, pattern, variable FROM boosted WHERE variable IS NOT NULL")
oracle("file_heuristics", "SELECT file_id, line, pattern, severity, message FROM heuristic")
oracle("ast_call_sites", "SELECT file_id, seq, line, pattern, arg_kind, arg_tainted, fn_name FROM sites")
# Where the calls of a program stand, by the number of line breaks in its text, and what they hand over.
_PROGRAM_CALLS = [(0, 5, "name", True, True), (1, 6, "literal", False, True), (2, 7, "built", True, True), (3, 7, "name", False, True),
                  (4, 8, "none", False, True), (5, 9, "other", True, False)]
_call_patterns = [*rules.CALL_TARGETS.values(), *rules.CALL_TARGET_MODULES.values()]
oracle("program_call_sites", f"""
SELECT doc_id AS file_id, CAST(s.seq AS INT) AS seq, CAST(s.line + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS INT) AS line,
  [{', '.join(q(p) for p in _call_patterns)}][doc_id % {len(_call_patterns)} + 1] AS pattern, s.arg_kind, s.arg_tainted,
  CASE WHEN inside THEN 'f' || doc_id ELSE '' END AS fn_name
FROM documents, {values(_PROGRAM_CALLS)} AS s(seq, line, arg_kind, arg_tainted, inside)""")
oracle("ast_findings", "SELECT file_id, line, pattern, severity, seq, note FROM called")
oracle("corpus_secret_scan", "SELECT doc_id, line, pattern, severity, type, message FROM documents_found")
oracle("corpus_script_scan", "SELECT page_id, line, pattern, severity, type, message FROM pages_found")
oracle("corpus_focus_windows", islands("documents_flag", "doc_id"))
_finding = "SELECT file_id, line, pattern, severity, src_rank, type FROM {}"
oracle("all_findings", _finding.format("every_full"))
oracle("dedupe_findings", _finding.format("found_full"))
_guidance = {k: g[1:] for g in texts.GUIDANCE for k in g[0]}
oracle("finding_explanations", "SELECT file_id, line, pattern, concat_ws(' ', " + case("pattern", texts.EXPLANATIONS, texts.DEFAULT_EXPLANATION)
       + ", nullif(note, '')) AS explanation, " + ", ".join(
    case("pattern", {k: g[i] for k, g in _guidance.items()}, texts.DEFAULT_GUIDANCE[i]) + f" AS {name}"
    for i, name in enumerate(["why_risky", "what_to_check", "when_legitimate", "suggested_fix"])
) + " FROM found_full")
oracle("file_touches", "SELECT file_id, touches FROM judged_expr")
oracle("file_risk_points", "SELECT file_id, finding_points, risk_points FROM judged_full")
_badge = {i: [] for i in (2, 4, 5)}
for _level, _top, *_rest in rules.BADGES:
    for _i in _badge:
        _badge[_i].append(
            f"WHEN risk = '{_level}' OR trust_score <= {_top} THEN {q(_rest[_i - 2])}" if _level else f"ELSE {q(_rest[_i - 2])}"
        )
oracle("trust_score", "SELECT file_id, risk, trust_score, " + ", ".join(
    f"CASE {' '.join(_badge[i])} END AS {name}" for i, name in ((2, "label"), (4, "color"), (5, "message"))
) + " FROM scored_full")
oracle("intent_quality", f"SELECT file_id, intent, {_meaningful} AS is_meaningful FROM cf")
oracle("intent_mismatch", "SELECT file_id, generate_subscripts(mismatches, 1) - 1 AS pos, unnest(mismatches) AS message FROM judged_expr")
oracle("behavior_summary", "SELECT file_id, generate_subscripts(sentences, 1) - 1 AS pos, unnest(sentences) AS sentence FROM scored_expr")
oracle("focus_windows", "SELECT file_id, start_line, end_line FROM window_expr")
oracle("focus_blocks", """
SELECT w.file_id, w.start_line, l.line_no AS line, l.line AS content,
  EXISTS (SELECT 1 FROM flag f WHERE f.file_id = w.file_id AND f.line = l.line_no) AS flagged
FROM window_expr w JOIN ln l ON l.file_id = w.file_id AND l.line_no BETWEEN w.start_line AND w.end_line""")
CTE["flag_full"] = CTE["flag"].replace("found_expr", "found_full")
CTE["window_full"] = islands("flag_full", "file_id")
_report = """
SELECT s.file_id, s.path, s.risk, s.risk_points, s.trust_score, s.touches,
  array_to_string(s.mismatches, '|') AS intent_mismatches, array_to_string(s.sentences, '|') AS behavior_summary,
  s.finding_count || ' suspicious patterns detected and ' || s.mismatch_count || ' intent mismatch warnings' AS summary,
  s.finding_count, coalesce(b.n, 0) AS block_count
FROM scored_full s LEFT JOIN (SELECT file_id, count(*) AS n FROM window_full GROUP BY file_id) b USING (file_id)"""
oracle("file_report", _report)
oracle("stream_scan", _report)
oracle("corpus_file_report", _report)
oracle("stream_usage", """
SELECT 'user:' || user_id AS actor_key, CAST(CAST(ts AS DATE) AS VARCHAR) AS usage_date, count(*) AS scan_count
FROM events GROUP BY 1, 2""")
oracle("ranked_files", _report + f" WHERE {IS_CODE}")
oracle("line_limit", f"""
SELECT file_id, plan AS plan_applied, line_limit, line_count,
  CASE WHEN over THEN 'limit' ELSE risk END AS risk, CASE WHEN over THEN 100.0 ELSE risk_points END AS risk_points,
  CASE WHEN over THEN 0 ELSE trust_score END AS trust_score,
  CASE WHEN NOT over THEN finding_count || ' suspicious patterns detected and ' || mismatch_count || ' intent mismatch warnings'
    WHEN plan = 'pro' THEN 'Pro scans are limited to ' || line_limit || ' lines right now.'
    ELSE 'Free scans are limited to ' || line_limit || ' lines. Pro unlocks larger file scanning.' END AS summary
FROM (SELECT *, coalesce(line_count > line_limit, FALSE) AS over FROM (
  SELECT s.*, r.plan, CAST({limit('r.plan', 'line_limit', _tight)} AS BIGINT) AS line_limit,
    (SELECT max(line_no) FROM ln WHERE ln.file_id = s.file_id) AS line_count
  FROM scored_expr s JOIN rr r USING (repo)))""")
oracle("plan_limits", f"""
SELECT scan_id, p AS plan, {limit('lower(p)', 'line_limit', rules.PLAN_LIMITS)} AS line_limit,
  {limit('lower(p)', 'repo_file_limit', rules.PLAN_LIMITS)} AS repo_file_limit,
  CAST({limit('lower(p)', 'repo_size_limit_bytes', rules.PLAN_LIMITS)} AS BIGINT) AS repo_size_limit_bytes,
  {limit('lower(p)', 'daily_scan_limit', rules.PLAN_LIMITS)} AS daily_scan_limit
FROM (SELECT scan_id, CASE WHEN plan = 'pro' THEN 'PRO' WHEN scan_id % 7 = 0 THEN 'enterprise' ELSE plan END AS p FROM sr)""")
oracle("account_access", """
SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'admin' ELSE 'user' END AS role,
  CASE WHEN user_id % 3 = 0 THEN 'pro' WHEN user_id % 4 = 0 THEN 'admin' ELSE 'free' END AS plan FROM events""")
oracle("repo_limits", f"""
SELECT request_id, repo, plan, code_files, repo_size_bytes, file_limit AS repo_file_limit, size_limit AS repo_size_limit_bytes,
  NOT (coalesce(many, FALSE) OR coalesce(large, FALSE)) AS admitted,
  CASE WHEN many THEN 'Repo file limit reached' WHEN large THEN 'Repo size limit reached' END AS limit_title,
  CASE WHEN many THEN {_plan_label} || ' scans are limited to ' || file_limit || ' code files per repository. Upgrade for larger repo scans.'
    WHEN large THEN {_plan_label} || ' scans are limited to about ' || {_size} || ' of code per repository. Upgrade for larger repo scans.'
  END AS summary FROM rlimit""")
_refused = "CASE WHEN plan = 'free' THEN 'Free' ELSE 'Pro' END"
oracle("quota_admission", f"""
SELECT scan_id, actor_key, plan, admitted, CASE WHEN NOT admitted THEN {_refused} || ' daily scan limit reached' END AS limit_title,
  CASE WHEN NOT admitted THEN {_refused} || ' allows up to ' || daily
    || ' scans per day. Try again tomorrow or upgrade for higher limits.' END AS limit_summary FROM quota""")
oracle("stream_quota", "SELECT scan_id, actor_key, plan, admitted FROM quota")
oracle("report_sink", _FINAL["finding_explanations"])
CTE["snippet"] = fixtures.CODE_FILES
CTE["snippet_ln"] = lines_of("snippet", "file_id", "content")
oracle("file_tree", """
SELECT repo, size_bytes, n_lines, n_texts FROM (SELECT repo, CAST(sum(strlen(content) + 1) AS BIGINT) AS size_bytes FROM snippet GROUP BY repo)
JOIN (SELECT repo, count(*) AS n_lines, count(DISTINCT line) AS n_texts FROM snippet_ln JOIN snippet USING (file_id) GROUP BY repo) USING (repo)""")
oracle("daily_usage", """
SELECT actor_key, CAST(usage_date AS VARCHAR) AS usage_date, plan, count(*) AS scan_count
FROM quota WHERE admitted AND daily IS NOT NULL GROUP BY 1, 2, 3""")
oracle("usage_upsert", """
SELECT actor_key, CAST(usage_date AS VARCHAR) AS usage_date, plan, CAST(sum(n) AS BIGINT) AS scan_count
FROM (SELECT * FROM morning UNION ALL SELECT * FROM later) GROUP BY 1, 2, 3""")
oracle("actor_key", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN 'user:' || user_id ELSE 'anon:' || sha256(
  CASE WHEN user_id % 2 = 0 THEN '10.0.0.' || (user_id % 256) WHEN user_id % 3 = 0 THEN 'host' || user_id ELSE 'unknown' END
  || '|' || coalesce(props, '')) END AS actor_key FROM events""")
oracle("parse_requirements", "SELECT repo, line, package, declared_version, version, version_kind, raw, reason FROM entry")
_rv, _rk = normalized("raw_version")
oracle("normalize_versions", f"""
SELECT repo, line, raw_version, {_rv} AS version, {_rk} AS kind
FROM (SELECT repo, line, regexp_replace(raw, '^[a-z0-9\\[\\]]+', '') AS raw_version FROM ml)""")
# package.json texts come in five shapes, so the expected entries are plain rows per shape.
_pv, _pk = normalized("value")
CTE["pentry"] = f"""
SELECT file_id, CASE WHEN v IS NOT NULL THEN package END AS package, CASE WHEN v IS NOT NULL THEN value END AS declared_version,
  v AS version, CASE WHEN v IS NOT NULL THEN kind END AS version_kind,
  CASE WHEN v IS NOT NULL THEN section END AS dependency_section,
  CASE WHEN section IS NULL THEN '' WHEN v IS NULL THEN package || ': ' || value END AS raw,
  CASE WHEN section IS NULL THEN {q(rules.SKIP_JSON)} WHEN v IS NULL
    THEN section || ' entry uses a complex or non-registry specifier.' END AS reason
FROM (SELECT file_id, section, package, value, {_pv} AS v, {_pk} AS kind FROM (
  SELECT p_partkey AS file_id, s.section, CASE WHEN s.package = 'PK' THEN 'pkg' || (p_partkey % 50) ELSE s.package END AS package,
    replace(replace(s.value, 'SEVEN', CAST(p_partkey % 7 AS VARCHAR)), 'FOUR', CAST(p_partkey % 4 AS VARCHAR)) AS value
  FROM part JOIN {values([
    (0, 'dependencies', 'PK', '^1.2.SEVEN'), (0, 'dependencies', 'left', '1.x'), (0, 'devDependencies', 'dev', '~2.0'),
    (1, 'dependencies', 'PK', '1.2.SEVEN'), (1, 'optionalDependencies', 'opt', '1 || 2'),
    (1, 'optionalDependencies', 'eq', '=1.0'), (2, None, None, ''),
    (3, 'devDependencies', 'a', 'latest'), (3, 'devDependencies', 'b', 'workspace:*'),
    (3, 'devDependencies', 'c', '1.0 - 2.0'), (3, 'devDependencies', 'd', ''),
    *[(5, 'dependencies', k, v) for k, v in {
        't': 'True', 'f': 'False', 'n': 'None', 'i': '12', 'x': '1.5', 'y': '1.0', 'e': '100000.0', 's': '2e-07',
        'm': '1.5e+16', 'k': '0.0001', 'big': '123456789012345678901234567890'}.items()],
    (6, 'dependencies', 'PK', '1.2.FOUR'), (6, 'dependencies', 'b', '2.0'),
  ])} AS s(shape, section, package, value) ON s.shape = p_partkey % 7))"""
oracle("parse_package_json", "SELECT * FROM pentry")
oracle("dedupe_dependencies", "SELECT repo, line, package, version, version_kind FROM dep")
oracle("deps_skipped_top", f"""
SELECT repo, rank, line, raw, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY line) AS rank FROM entry WHERE reason IS NOT NULL)
WHERE rank <= {rules.MAX_SKIPPED_REPORTED}""")
oracle("dep_advisory_refs", "SELECT repo, line, package, version, id FROM dfind")
_check = f"{q(texts.ADVISORY_CHECK)} || CASE WHEN version_kind = 'range-normalized' THEN {q(texts.ADVISORY_CHECK_RANGE)} ELSE '' END"
oracle("dep_findings", f"""
SELECT repo, line, package, version, version_kind, id, alias AS aliases,
  'Known vulnerable dependency detected: ' || package || ' (' || declared_version || ')' AS message, severity_label, severity,
  base_severity, path_weight, explanation, fixed AS fixed_versions,
  {case('severity_label', texts.ADVISORY_WHY, texts.ADVISORY_DEFAULT_WHY)} AS why_risky, {_check} AS what_to_check FROM dfind""")
oracle("dep_findings_ranked", """
SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY severity DESC, lower(package), id, file, line, version) AS rank,
  package, version, id, severity FROM dfind""")
oracle("salted_dep_refs", """
SELECT repo, line, s.package, s.version, a.id FROM (
  SELECT repo, line, CASE WHEN line % 2 = 0 THEN 'pkg1' ELSE package END AS package, CASE WHEN line % 2 = 0 THEN '1.2.1' ELSE version END AS version
  FROM dep) s JOIN ad a ON a.package = s.package AND a.version = s.version""")
oracle("indexed_word_rules", f"""
SELECT doc_id, line_no AS line, word AS pattern, 'Names ' || word AS message, 1.0::DOUBLE AS points
FROM (SELECT DISTINCT doc_id, line_no, unnest(regexp_extract_all(lower(line), {q(WORDS)})) AS word FROM documents_ln)
WHERE word IN (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) FROM benchmark) AND length(word) >= 9 AND regexp_full_match(word, '[a-z]+')""")
oracle("indexed_behavior", "SELECT file_id, line_no AS line, seq, pattern, message, points::DOUBLE AS points FROM hit")
oracle("bucketed_repo_files", """
SELECT request_id, repo, count(*) AS n_files, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM rr JOIN cf USING (repo) GROUP BY request_id, repo""")
oracle("advisory_severity", "SELECT id, severity_label, points FROM adv")
oracle("fixed_versions", "SELECT id, 0 AS pos, fixed AS version FROM ad")
oracle("dep_risk_points", "SELECT repo, dependency_risk_points FROM dpoints")
oracle("dep_rollup", "SELECT * FROM droll")
oracle("manifest_summary", f"SELECT *, array_to_string({_manifest_lines}, '|') AS summary_lines FROM msum")
oracle("path_weights", f"SELECT path, {_weight} / 100.0::DOUBLE AS code_weight, {percent('path', rules.MANIFEST_PATH_WEIGHTS)} / 100.0::DOUBLE AS manifest_weight FROM cf")
oracle("advisory_json", f"""
SELECT id, severity_label, {case('severity_label', rules.ADVISORY_POINTS, 5)} AS points, array_to_string(fixed, '|') AS fixed_versions,
  array_to_string(aliases, '|') AS aliases, text, published FROM afact""")
oracle("advisory_json_refs", "SELECT ecosystem, package, version, id FROM aref")
oracle("advisory_bad_lines", "SELECT line_no, value AS line FROM ajson WHERE j IS NULL OR json_type(j) <> 'OBJECT'")
oracle("manifest_files_entries", "SELECT repo, file, ecosystem, package, declared_version, version, version_kind, dependency_section, raw, reason FROM mentry")
oracle("manifest_files_findings", f"""
SELECT repo, file, ecosystem, package, version, dependency_section, id, severity_label, cents / 100.0::DOUBLE AS severity, path_weight, published,
  array_to_string(fixed, '|') AS fixed_versions, array_to_string(aliases, '|') AS aliases, explanation FROM mfind""")
oracle("repo_files", f"""
SELECT repo, plan, path, risk, risk_points, percent / 100.0::DOUBLE AS file_weight,
  {two('risk_points * (percent / 100.0::DOUBLE)')} AS weighted_risk_points FROM rfile""")
_own_lines = f"""list_filter([CASE WHEN advisory_count > 0 THEN 'Contains ' || advisory_count || ' dependency advisory finding(s) across '
    || unique_package_versions || ' package/version pair(s).' END,
  CASE WHEN n > 0 AND advisory_count = 0 THEN {q(rules.NO_MAJOR_SENTENCE)} END, CASE WHEN advisory_count > 0 THEN {q(rules.DEPENDENCIES_SENTENCE)} END], lambda x: x IS NOT NULL)"""
_touch_cases = [f"CASE WHEN coalesce({n.replace(' ', '_')}, FALSE) THEN {q(n)} END" for n in _touch_names]
oracle("repo_report", f"""
SELECT request_id, repo, 'owner/' || repo AS repo_name, ok AS admitted, plan, CASE WHEN ok THEN {RISK('points')} ELSE 'limit' END AS risk,
  CASE WHEN ok THEN {two('points')} ELSE 100.0 END AS risk_points, CASE WHEN ok THEN {TRUST('points')} ELSE 0 END AS trust_score,
  CASE WHEN ok THEN n ELSE 0 END AS files_scanned_count, coalesce(CAST(file_limit AS VARCHAR), 'Unlimited') AS files_scanned_limit,
  CASE WHEN ok THEN array_to_string(list_sort(list_filter([{', '.join(_touch_cases)},
    CASE WHEN advisory_count > 0 THEN {q(rules.DEPENDENCIES_TOUCH)} END], lambda x: x IS NOT NULL)), '|') ELSE '' END AS touches,
  CASE WHEN ok THEN array_to_string(CASE WHEN len(lines) = 0 THEN [{q(rules.QUIET_REPO_SENTENCE)}] ELSE lines END, '|') ELSE '' END AS behavior_summary,
  CASE WHEN ok THEN 'Weighted repo scan completed across ' || n || ' files.'
    WHEN many THEN {_plan_label} || ' scans are limited to ' || file_limit || ' code files per repository. Upgrade for larger repo scans.'
    ELSE {_plan_label} || ' scans are limited to about ' || {_size} || ' of code per repository. Upgrade for larger repo scans.' END AS summary,
  CASE WHEN ok THEN ['green', 'yellow', 'red'][coalesce(rank, 0) + 1] ELSE 'green' END AS highest_file_risk, repo_size_bytes,
  CASE WHEN ok THEN manifests_scanned END AS manifests_scanned, CASE WHEN ok THEN dependencies_parsed END AS dependencies_parsed,
  CASE WHEN ok THEN dependencies_skipped_count END AS dependencies_skipped_count, CASE WHEN ok THEN advisory_count END AS advisory_count,
  CASE WHEN ok THEN dependency_risk_points END AS dependency_risk_points
FROM (SELECT *, list_distinct_ordered AS lines, {damped("(coalesce(total, 0) / 10000.0::DOUBLE / greatest(n, 1) + dependency_risk_points)")} AS points FROM (
  SELECT *, coalesce(sentences, []) || {_own_lines} || (CASE WHEN has THEN {_manifest_lines} ELSE [] END) AS list_distinct_ordered FROM (
    SELECT l.*, NOT (coalesce(many, FALSE) OR coalesce(large, FALSE)) AS ok, r.* EXCLUDE (repo, plan, n), coalesce(r.n, 0) AS n, s.sentences,
      m.repo IS NOT NULL AS has, coalesce(m.manifests_scanned, 0) AS manifests_scanned, coalesce(m.dependencies_parsed, 0) AS dependencies_parsed,
      coalesce(m.dependencies_skipped_count, 0) AS dependencies_skipped_count, coalesce(m.advisory_count, 0) AS advisory_count,
      coalesce(m.unique_package_versions, 0) AS unique_package_versions, coalesce(m.dependency_risk_points, 0.0) AS dependency_risk_points
    FROM rlimit_plain l LEFT JOIN rroll r USING (repo, plan) LEFT JOIN rsent s USING (repo, plan) LEFT JOIN msums m USING (repo))))""")
oracle("repo_url_parse", f"""
SELECT page_id, CASE WHEN good THEN parts[1] END AS owner, CASE WHEN good THEN replace(parts[2], '.git', '') END AS repo_short,
  CASE WHEN NOT good THEN {q(rules.REPO_URL_ERROR)} END AS error
FROM (SELECT *, host IN ('github.com', 'www.github.com') AND len(parts) >= 2 AS good FROM (
  SELECT page_id, regexp_extract(repo_url, '^[a-z]+://([^/?#]*)', 1) AS host,
    list_filter(string_split(regexp_extract(repo_url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') AS parts FROM ru))""")
oracle("repo_risk", f"""
SELECT repo, n AS files_scanned_count, dep AS dependency_risk_points, {RISK('points')} AS risk, {TRUST('points')} AS trust_score,
  {two('points')} AS risk_points FROM repo_scored""")
oracle("repo_highest_risk", "SELECT repo, ['green', 'yellow', 'red'][rank + 1] AS highest_file_risk FROM rolled")
oracle("repo_touches", f"SELECT repo, {_repo_touches} AS touches FROM rolled")
oracle("repo_behavior", "SELECT repo, pos, sentence FROM repo_lines")
_color = "CASE " + " ".join(
    f"WHEN t >= {low} THEN '{name}'" if low is not None else f"ELSE '{name}'" for low, name in rules.README_BADGE_COLORS
) + " END"
oracle("readme_badge", f"""
SELECT repo, image AS badge_image_url, '[![Risk Scan](' || image || ')](' || link || ')' AS badge_markdown,
  '<a href=''' || link || '''><img src=''' || image || '''/></a>' AS badge_html
FROM (SELECT repo, 'https://img.shields.io/badge/Risk%20Scan-' || t || '%2F100-' || {_color} AS image,
        'https://reports.example/report/owner/' || repo AS link
      FROM (SELECT repo, {TRUST('points')} AS t FROM repo_scored))""")


def _needed(sql: str, reads: dict[str, set[str]]) -> list[str]:
    """The common tables a statement needs, each one after those it reads itself."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for other in sorted(reads[name] - {name}):
                visit(other)
            ordered.append(name)

    for name in sorted(_reads(sql)):
        visit(name)
    return ordered


# Columns that are 32-bit on the Spark side.
_INT = {
    "line_no": "line_explode exclude_blocks strip_literals taint_sources assigned_vars call_arguments "
               "literal_arguments trusted_network_lines enclosing_function part_lines part_exclude_blocks part_functions",
    "line": "behavior_findings secret_findings sink_boost tainted_sinks file_heuristics ast_findings corpus_secret_scan "
            "corpus_script_scan all_findings dedupe_findings finding_explanations focus_blocks report_sink indexed_word_rules indexed_behavior",
    "pos": "taint_map intent_mismatch behavior_summary repo_behavior",
    "start_line": "corpus_focus_windows focus_windows focus_blocks",
    "end_line": "corpus_focus_windows focus_windows",
    "finding_count": "file_report corpus_file_report ranked_files stream_scan",
    "block_count": "file_report corpus_file_report ranked_files stream_scan",
    "line_count": "line_limit", "rank": "deps_skipped_top dep_findings_ranked",
}


def oracle_sql() -> dict[str, str]:
    result = {}
    reads = {name: _reads(body) for name, body in CTE.items()}
    for name, sql in _FINAL.items():
        narrow = [f"CAST({c} AS INT) AS {c}" for c, names in _INT.items() if name in names.split()]
        if narrow:
            sql = f"SELECT * REPLACE ({', '.join(narrow)}) FROM ({sql})"
        parts = _needed(sql, reads)
        if parts:
            recursive = "RECURSIVE " if any("(" in p for p in parts) else ""
            sql = f"WITH {recursive}" + ",\n".join(
                f"{p} AS {'' if '(' in p else 'MATERIALIZED '}({CTE[p]})" for p in parts
            ) + "\n" + sql
        result[name] = sql
    return result

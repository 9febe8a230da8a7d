"""The registered queries as DuckDB SQL, written on their own and compared row by row in tests."""

from __future__ import annotations

from ..functions import patterns as P
from ..sources.fixtures import SQL as VIEW


def _q(pattern: str) -> str:
    return pattern.replace("'", "''").replace("{0,2048}", "{0,1000}")


def found(column: str, patterns: list[str], flags: str = "i") -> str:
    """Whether any pattern is found in a column; null counts as empty."""
    return f"regexp_matches(coalesce({column}, ''), '{_q('|'.join(f'(?:{p})' for p in patterns))}', '{flags or 'c'}')"


def counted(column: str, patterns: list[str], flags: str = "i") -> str:
    return "(0.0::DOUBLE + " + " + ".join(f"{found(column, [p], flags)}::INT" for p in patterns) + ")"


def listed(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_DANGEROUS = f"({found('command', [P.REMOTE_PIPE_EXEC, P.PROCESS_SUB_REMOTE, *P.HIGH_DANGER_ANY_CASE])} OR {found('command', P.HIGH_DANGER_EXACT, '')})"
_WORDS = "list_filter(regexp_split_to_array(coalesce(command, ''), '\\s+'), lambda w: starts_with(w, '/') OR starts_with(w, '~') OR (contains(w, '/') AND NOT starts_with(w, '-')))"

DIMENSIONS = f"""
dims AS (
  SELECT *,
    CASE WHEN tool_name IN {listed(P.READ_ONLY_TOOLS)} THEN 0 WHEN tool_name IN {listed(P.LIMITED_WRITE_TOOLS)} THEN 1 WHEN tool_name IN {listed(P.HIGH_DANGER_TOOLS)} THEN 3
      WHEN tool_name IN {listed(P.SHELL_TOOLS)} THEN CASE WHEN {_DANGEROUS} OR {found('command', [P.SYSTEM_PATH], '')} THEN 3 ELSE 2 END
      WHEN tool_name IN {listed(P.SYSTEM_TOOLS)} THEN 2 WHEN tool_name IN {listed(P.DANGEROUS_TOOLS)} THEN 3 ELSE 2 END AS d1,
    coalesce(list_max(list_transform(list_concat(CASE WHEN path IS NULL THEN [] ELSE [path] END, {_WORDS}),
      lambda p: CASE WHEN {found('p', [P.SYSTEM_CRITICAL], '')} THEN 3 WHEN {found('p', [P.CONFIG_PATH])} THEN 1 WHEN {found('p', [P.CREDENTIAL_PATH])} OR contains(lower(p), '.gnupg/') THEN 2 ELSE 0 END)), 1) AS d2,
    CASE WHEN tool_name <> 'bash' THEN 0 WHEN {_DANGEROUS} THEN 3 WHEN regexp_extract(command, '^\\s*(?:\\S*/)?([^\\s/]*)', 1) IN {listed(P.SAFE_COMMANDS)} THEN 0
      WHEN {found('command', [r'\b(?:rm)\b', *P.DESTRUCTIVE_PHRASES], '')} THEN 2 WHEN {found('command', [r'\b(?:' + '|'.join(P.WRITE_WORDS) + r')\b', *P.WRITE_PHRASES], '')} THEN 1 ELSE 2 END AS d3,
    CASE trust WHEN 'privileged' THEN 0 WHEN 'elevated' THEN 0 WHEN 'standard' THEN 1 ELSE 2 END AS d5,
    round(least(3.0::DOUBLE, least(1.5::DOUBLE, 0.3::DOUBLE * {counted("concat_ws(' ', command, path, content)", P.WEAK_INJECTION)}) + least(2.4::DOUBLE, 0.8::DOUBLE * {counted("concat_ws(' ', command, path, content)", P.STRONG_INJECTION, 'is')})), 4) AS d6
  FROM agent_events)"""


def levelled(source: str, d4: str, medium: float = 0.8, high: float = 1.5, critical: float = 2.2) -> str:
    """Query that adds d4, composite, risk_level, risk_rank and verdict to rows with the dimensions."""
    return f"""
SELECT *, CASE risk_level WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS risk_rank,
  CASE WHEN etype = 'pre_action' AND risk_level IN ('high', 'critical') THEN 'block' ELSE 'allow' END AS verdict
FROM (
  SELECT *, CASE WHEN d6 >= 2 AND lvl = 'low' THEN 'medium' ELSE lvl END AS risk_level FROM (
    SELECT *, CASE WHEN sc_rule IN ('SC-1', 'SC-2') THEN 'critical' WHEN sc_rule = 'SC-3' THEN 'low' WHEN composite >= {critical} THEN 'critical' WHEN composite >= {high} THEN 'high' WHEN composite >= {medium} THEN 'medium' ELSE 'low' END AS lvl
    FROM (
      SELECT *, CASE WHEN d1 = 3 AND d2 >= 2 THEN 'SC-1' WHEN d3 = 3 THEN 'SC-2' WHEN d1 = 0 AND d2 = 0 AND d3 = 0 THEN 'SC-3' END AS sc_rule,
        round((0.4::DOUBLE * greatest(d1, d2, d3) + 0.25::DOUBLE * d4 + 0.15::DOUBLE * d5) * (1 + 0.5::DOUBLE * d6 / 3), 4) AS composite
      FROM (SELECT *, {d4} AS d4 FROM {source}))))"""


SCORED = f"WITH {VIEW}, {DIMENSIONS}, scored AS ({levelled('dims', '0')})"
_COLUMNS = "event_id, session_id, d1, d2, d3, d4, d5, d6, composite, sc_rule, risk_level, verdict"
_ORDER = "(PARTITION BY session_id ORDER BY micros, event_id)"
_BEFORE = "(PARTITION BY session_id ORDER BY micros, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_UPTO = "(PARTITION BY session_id ORDER BY micros, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _high(k: int) -> str:
    return f"(SELECT * FROM ({levelled('dims', str(k))}))"


_UNIT = 14_400_000_000  # microseconds of a fixture time unit


def _pair(name: str, level: str, first: str, second: str, events: int, seconds: int) -> str:
    """The first a and the first b after it, in the window that ends at each row, by self-joins on row numbers."""
    return f"""
SELECT session_id, '{name}' AS sequence_id, '{level}' AS risk_level, event_id AS trigger_event_id, micros, list_aggregate(list_transform(list_sort([a, b]), lambda x: x::VARCHAR), 'string_agg', ',') AS matched
FROM (
  SELECT t.session_id, t.event_id, t.micros, t.a, arg_min(b.event_id, b.rn) AS b FROM (
    SELECT c.session_id, c.event_id, c.micros, c.rn, arg_min(a.event_id, a.rn) AS a, min(a.rn) AS arn
    FROM flags c JOIN flags a ON a.session_id = c.session_id AND a.rn BETWEEN c.rn - {events - 1} AND c.rn AND a.micros >= c.micros - {seconds} * {_UNIT} AND a.{first}
    GROUP BY ALL) t
  JOIN flags b ON b.session_id = t.session_id AND b.rn > t.arn AND b.rn <= t.rn AND b.{second}
  GROUP BY ALL)"""


_FLAGS = f"""
flags AS (
  SELECT session_id, event_id, micros, row_number() OVER {_ORDER} AS rn,
    tool_name IN {listed(P.READ_TOOLS)} AND {found('path', [P.CREDENTIAL_PATH])} AS sensitive_read,
    tool_name IN {listed(P.NETWORK_TOOLS)} OR {found("concat_ws(' ', path, command)", [P.NETWORK_COMMAND])} AS network,
    {found('command', [P.DOWNLOAD])} AS download,
    {found('command', [P.CHMOD_EXEC])} OR (tool_name IN ('write_file', 'edit_file') AND {found('path', [P.SHELL_CONFIG])}) AS executable,
    {found('command', [P.RECON])} AS recon, {found('command', [P.PRIVILEGE])} AS privilege,
    tool_name IN {listed(P.WRITE_TOOLS)} AND {found('path', [P.TEMP_PATH])} AS tmp_write,
    {found('command', [P.TEMP_PATH])} AND {found('command', [P.NETWORK_COMMAND])} AS tmp_exfil
  FROM agent_events)"""

_HARVEST = f"""
SELECT session_id, 'secret-harvest' AS sequence_id, 'high' AS risk_level, event_id AS trigger_event_id, micros,
  list_aggregate(list_transform(list_sort(list_slice(ids, 1, 3)), lambda x: x::VARCHAR), 'string_agg', ',') AS matched
FROM (
  SELECT c.session_id, c.event_id, c.micros, list(a.event_id ORDER BY a.rn) AS ids
  FROM flags c JOIN flags a ON a.session_id = c.session_id AND a.rn BETWEEN c.rn - 9 AND c.rn AND a.micros >= c.micros - 30 * {_UNIT} AND a.sensitive_read
  GROUP BY ALL)
WHERE len(ids) >= 3"""

_ALERTS = f"""
{_FLAGS},
hits AS ({_pair('exfil-credential', 'critical', 'sensitive_read', 'network', 5, 60)} UNION ALL {_pair('backdoor-install', 'critical', 'download', 'executable', 5, 60)}
  UNION ALL {_pair('recon-then-exploit', 'critical', 'recon', 'privilege', 8, 120)} UNION ALL {_HARVEST} UNION ALL {_pair('staged-exfil', 'high', 'tmp_write', 'tmp_exfil', 10, 120)}),
alerts AS (
  SELECT session_id, sequence_id, risk_level, arg_min(trigger_event_id, (micros, trigger_event_id)) AS trigger_event_id, matched
  FROM hits GROUP BY session_id, sequence_id, risk_level, matched)"""


def _thinned(source: str, key: str, seconds: int) -> str:
    """CTEs that keep the first row of a key and then the first at least ``seconds`` units after the last kept one, with the number of those dropped in between."""
    names = [k.strip() for k in key.split(",")]
    same = " AND ".join(f"n.{k} = e.{k}" for k in names)
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY micros, event_id) AS rn FROM {source}),
kept AS (WITH RECURSIVE e AS (
  SELECT {key}, event_id, micros, rn, 0::BIGINT AS suppressed FROM numbered WHERE rn = 1
  UNION ALL SELECT {', '.join('e.' + k for k in names)}, n.event_id, n.micros, n.rn, n.rn - e.rn - 1 FROM e JOIN LATERAL (SELECT event_id, micros, rn FROM numbered n WHERE {same} AND n.micros >= e.micros + {seconds} * {_UNIT} ORDER BY rn LIMIT 1) n ON true) SELECT * FROM e),
thinned AS (SELECT * FROM kept)"""


_CLASSIFIED = f"""
observed AS (SELECT *, CASE event_id % 17 WHEN 0 THEN 'trajectory_alert' WHEN 1 THEN 'post_action_finding' WHEN 2 THEN 'budget_exhausted' WHEN 3 THEN 'decision' WHEN 4 THEN 'alert' ELSE '' END AS runtime_type,
  CASE event_id % 19 WHEN 0 THEN 'secret_plus_network' WHEN 1 THEN 'recon_then_sudo' WHEN 2 THEN 'tmp_staging_exfil' ELSE '' END AS trigger_detail,
  CASE WHEN event_id % 23 = 0 THEN 'cumulative_risk' ELSE '' END AS trigger_reason, CASE WHEN event_id % 2 = 0 THEN 'session_risk_escalation' ELSE '' END AS reason FROM scored),
classified AS (
  SELECT *, CASE WHEN subtype IN ('cascading_failure', 'sandbox_escape', 'rogue_agent') THEN 'RT3' WHEN subtype = 'insecure_output_handling' THEN 'RT2' WHEN subtype = 'unmapped' THEN 'none' ELSE 'RT1' END AS tier
  FROM (SELECT *, CASE
      WHEN runtime_type = 'trajectory_alert' THEN 'cascading_failure' WHEN runtime_type = 'post_action_finding' THEN 'insecure_output_handling' WHEN runtime_type = 'budget_exhausted' THEN 'rogue_agent'
      WHEN runtime_type = 'decision' AND trigger_detail IN ('secret_harvest_archive', 'tmp_staging_exfil') THEN 'sandbox_escape'
      WHEN d6 >= 2 OR contains(lower(concat_ws(' ', command, content)), 'ignore previous instructions') THEN 'prompt_injection'
      WHEN trigger_detail = 'secret_plus_network' THEN 'sensitive_info_disclosure'
      WHEN tool_name IN ('read_file', 'read', 'cat', 'head', 'tail') AND {found('path', [P.CREDENTIAL_PATH])} AND {found("concat_ws(' ', path, content)", [P.NETWORK_COMMAND])} THEN 'sensitive_info_disclosure'
      WHEN runtime_type = 'alert' AND reason <> '' THEN 'tool_misuse' WHEN trigger_detail = 'recon_then_sudo' THEN 'unauthorized_code_execution'
      WHEN (tool_name = 'bash' OR contains(lower(concat_ws(' ', path, content, command)), 'chmod')) AND (contains(lower(concat_ws(' ', path, content, command)), 'sudo ')
        OR {found('command', [P.REMOTE_PIPE_EXEC, *P.DECODE_PIPE_EXEC, P.EVAL_DECODE, P.SCRIPT_ENCODED_EXEC, P.PROCESS_SUB_REMOTE, P.HEREDOC_EXEC])} OR {found('command', [P.VARIABLE_EXPANSION, P.VARIABLE_EXEC_TRIGGER], '')}) THEN 'unauthorized_code_execution'
      WHEN trigger_detail = 'tmp_staging_exfil' THEN 'sandbox_escape' WHEN trigger_reason = 'cumulative_risk' THEN 'excessive_agency'
      WHEN risk_rank >= 2 AND (tool_name = 'bash' OR contains(lower(concat_ws(' ', path, content, command)), 'chmod')) THEN 'tool_misuse' ELSE 'unmapped' END AS subtype FROM observed))"""

#: id, category, level, weight (null where no expression fits), condition; body is what expressions look at.
_RULE_ROWS = [
    ("view-override", "goal_hijack", "high", r"CASE WHEN regexp_matches(body, '\ball previous instructions\b', 'is') THEN 9 WHEN regexp_matches(body, 'rules\s+above', 'is') THEN 6 END", "tool_name = 'http_request'"),
    ("view-comment", "goal_hijack", "medium", r"CASE WHEN regexp_matches(body, '<!--[\s\S]*?\brules\b[\s\S]*?-->', 'is') THEN 8 END", "tool_name IN ('http_request', 'read_file')"),
    ("stage-upload", "tool_misuse", "critical", r"CASE WHEN regexp_matches(body, '\bcurl\s+-d\b', 'is') THEN 10 WHEN contains(body, 'https://') THEN 3 END", "tool_name = 'bash' AND contains(command, '/stage.tar')"),
    ("piped-script", "code_execution", "critical", r"CASE WHEN regexp_matches(body, '\|\s*bash$', 'is') THEN 9 WHEN regexp_matches(body, '\|\s*sh$', 'is') THEN 8 END", "tool_name = 'bash'"),
    ("open-permissions", "privilege_abuse", "critical", r"CASE WHEN regexp_matches(body, '\b777\b', 'is') THEN 9 WHEN regexp_matches(body, '^sudo\b', 'is') THEN 5 END", "starts_with(command, 'sudo ')"),
    ("secret-file", "credential_access", "high", "0", "tool_name = 'read_file' AND (path LIKE '%/id_rsa' OR path LIKE '%/.env' OR path = '/etc/passwd')"),
    ("profile-write", "persistence", "high", "0", "tool_name = 'write_file' AND (path LIKE '%.bashrc' OR path LIKE '%.zshrc') AND path NOT LIKE '/tmp/%'"),
]
_RULES_SQL = " UNION ALL ".join(f"SELECT *, '{i}' AS rule_id, '{c}' AS category, '{lv}' AS rule_level, {w} AS weight FROM rule_text WHERE {cond}" for i, c, lv, w, cond in _RULE_ROWS)
_RULES = f"rule_text AS (SELECT event_id, session_id, tool_name, path, command, coalesce(content, command, '') AS body FROM agent_events), matches AS (SELECT event_id, session_id, rule_id, category, rule_level AS risk_level, weight FROM ({_RULES_SQL}) WHERE weight IS NOT NULL)"

_SECOND = f"""
varied AS (SELECT * REPLACE (CASE event_id % 10 WHEN 0 THEN 'steal the production password' WHEN 1 THEN 'read the api_key file' ELSE content END AS content),
  CASE event_id % 9 WHEN 0 THEN 'credential_exfiltration' WHEN 1 THEN 'privilege_escalation_confirmed' ELSE '' END AS hint FROM scored),
texts AS (SELECT *, substr(lower(concat_ws(' ', tool_name, hint, '{{' || concat_ws(',', '"command":"' || command || '"', '"path":"' || path || '"', '"content":"' || content || '"') || '}}')), 1, 65536) AS body FROM varied),
rule_text AS (SELECT * FROM texts),
hits AS (SELECT event_id, max(CASE rule_level WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS top, max(weight) AS heavy, count(*) AS n FROM ({_RULES_SQL}) WHERE weight IS NOT NULL GROUP BY ALL),
k AS (SELECT t.*, coalesce(top, 0) AS top, coalesce(heavy, 0) AS heavy, regexp_matches(body, '\\b(prod|production|credential|credentials|secret|token|password|api_key|private_key|ssh_key)\\b') AS key_domain,
  regexp_matches(body, '\\b(exfiltrat|bypass|disable\\s+security|privilege\\s+escalat|steal)\\b') AS intent FROM texts t LEFT JOIN hits USING (event_id)),
b AS (SELECT *, greatest(risk_rank, CASE event_id % 9 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END, CASE WHEN key_domain AND intent THEN 3 WHEN key_domain AND tool_name = 'bash' THEN 2 ELSE 0 END, top) AS rank0 FROM k),
r AS (SELECT *, greatest(rank0, CASE WHEN heavy >= 8 AND rank0 < 2 OR event_id % 31 = 0 THEN 2 ELSE 0 END) AS rank1,
  event_id % 29 = 0 OR (etype = 'pre_action' AND risk_level = 'medium') OR key_domain OR event_id % 31 = 0 AS l2_run FROM b)
SELECT event_id, l2_run, CASE WHEN l2_run THEN ['low', 'medium', 'high', 'critical'][rank1 + 1] ELSE risk_level END AS l2_level,
  CASE WHEN l2_run THEN greatest(composite, [0.0::DOUBLE, 0.8, 1.5, 2.2][rank1 + 1]) ELSE composite END AS l2_score FROM r"""

_SUMMARY = """
SELECT CASE grouping(source_framework, etype, verdict, risk_level) WHEN 7 THEN 'source_framework' WHEN 11 THEN 'etype' WHEN 13 THEN 'verdict' WHEN 14 THEN 'risk_level' ELSE 'total' END AS dimension,
  coalesce(source_framework, etype, verdict, risk_level, '') AS value, count(*) AS n
FROM scored GROUP BY GROUPING SETS ((source_framework), (etype), (verdict), (risk_level), ())"""

_D4 = f"""
h AS (SELECT d.*, (a.risk_rank >= 2)::INT AS h0, (b.risk_rank >= 2)::INT AS h1, (c.risk_rank >= 2)::INT AS h2
  FROM dims d JOIN {_high(0)} a USING (event_id) JOIN {_high(1)} b USING (event_id) JOIN {_high(2)} c USING (event_id)),
p0 AS (SELECT *, coalesce(sum(h0) OVER {_BEFORE}, 0) AS c0 FROM h),
p1 AS (SELECT *, 2 + coalesce(sum(CASE WHEN c0 >= 2 THEN h1 ELSE 0 END) OVER {_BEFORE}, 0) AS c1 FROM p0),
p2 AS (SELECT *, 5 + coalesce(sum(CASE WHEN c0 >= 2 AND c1 >= 5 THEN h2 ELSE 0 END) OVER {_BEFORE}, 0) AS c2 FROM p1),
counted AS (SELECT *, (CASE WHEN c0 < 2 THEN c0 WHEN c1 < 5 THEN c1 ELSE c2 END)::BIGINT AS prior_high FROM p2)"""

_OUTPUTS = """
outputs AS (
  SELECT 'd' || doc_id AS output_id, text AS output, 'user' AS origin FROM documents
  UNION ALL SELECT 'p' || page_id, html, 'external' FROM pages),
body AS (SELECT output_id, origin, strip_accents(substr(coalesce(output, ''), 1, 65536)) AS body FROM outputs)"""

_FP = f"""
prints AS (
  SELECT event_id, session_id, micros, tool_name, sha256(concat_ws('|', tool_name, coalesce(command, '\\0'), coalesce(path, '\\0'), coalesce(content, '\\0'))) AS raw,
    CASE WHEN command IS NOT NULL THEN lower(command) ELSE lower(concat_ws(' ', tool_name, path)) END AS norm, verdict, risk_rank
  FROM scored WHERE etype = 'pre_action'),
prints2 AS (SELECT *, list_filter(regexp_split_to_array(norm, '\\W+|_'), lambda t: t <> '') AS tokens FROM prints),
prints3 AS (SELECT *, CASE WHEN tokens[1] IN ('rm', 'dd', 'mkfs', 'shred', 'chmod', 'chown', 'curl', 'wget', 'scp', 'sudo', 'kill') THEN tokens[1]
    WHEN list_has_any(tokens, ['delete', 'remove', 'destroy', 'exfiltrate', 'download', 'upload']) THEN 'destructive-generic' ELSE 'non-destructive' END AS intent FROM prints2),
fired AS (
  SELECT c.event_id, p.event_id AS prior_event_id, p.micros AS pm, CASE
      WHEN c.raw = p.raw THEN 'exact' WHEN c.norm = p.norm AND c.tool_name = p.tool_name THEN 'normalized_same_tool' WHEN c.norm = p.norm THEN 'normalized_cross_tool'
      WHEN c.intent = p.intent AND c.intent <> 'non-destructive' AND c.tool_name <> p.tool_name THEN 'intent_cross_tool'
      WHEN c.tool_name <> p.tool_name AND len(list_intersect(c.tokens, p.tokens)) / greatest(len(list_distinct(list_concat(c.tokens, p.tokens))), 1) >= 0.92 THEN 'similar_cross_tool' END AS rule
  FROM prints3 c JOIN prints3 p ON p.session_id = c.session_id AND p.verdict = 'block' AND p.risk_rank >= 2 AND (p.micros, p.event_id) < (c.micros, c.event_id) AND p.micros >= c.micros - 86400 * {_UNIT})"""

def _limited(most: int, tick: int) -> str:
    """A fold over each session that carries the times of allowed requests."""
    return f"""numbered AS (SELECT session_id, event_id, micros, row_number() OVER {_ORDER} AS rn FROM agent_events),
f AS (SELECT session_id, event_id, rn, [micros] AS kept, true AS allowed FROM numbered WHERE rn = 1
  UNION ALL SELECT n.session_id, n.event_id, n.rn, CASE WHEN len(list_filter(f.kept, lambda t: n.micros - t < {tick})) < {most} THEN list_append(list_filter(f.kept, lambda t: n.micros - t < {tick}), n.micros) ELSE f.kept END,
    len(list_filter(f.kept, lambda t: n.micros - t < {tick})) < {most} FROM f JOIN numbered n ON n.session_id = f.session_id AND n.rn = f.rn + 1)
SELECT session_id, event_id, allowed FROM f"""


_PRESETS = " UNION ALL ".join(
    f"SELECT '{name}' AS preset, risk_level FROM ({levelled('dims', '0', *t)})" for name, t in [("low", (1.2, 1.9, 2.6)), ("medium", (0.8, 1.5, 2.2)), ("high", (0.6, 1.2, 1.8)), ("strict", (0.5, 1.0, 1.5))]
)

_EDGES = [10.0, 50.0, 100.0, 250.0]

#: Written out here, not taken from the library.
_SECRET = r"(AKIA[0-9A-Z]{16}|ghp_[a-zA-Z0-9]{36}|sk-[a-zA-Z0-9]{32,}|-----BEGIN[A-Z ]*PRIVATE KEY-----|[a-zA-Z_]*(SECRET|TOKEN|PASSWORD|API_KEY)[a-zA-Z_]*[ \t\n\v\f\r]*[=:][ \t\n\v\f\r]*[^ \t\n\v\f\r]+)"

SQL: dict[str, str] = {
    "score_events": f"{SCORED} SELECT {_COLUMNS} FROM scored",
    "preset_comparison": f"WITH {VIEW}, {DIMENSIONS} SELECT preset, risk_level, count(*) AS n FROM ({_PRESETS}) GROUP BY ALL",
    "injection_scores": f"WITH {_OUTPUTS} SELECT output_id, round(least(3.0::DOUBLE, least(1.5::DOUBLE, 0.3::DOUBLE * {counted('body', P.WEAK_INJECTION)}) + least(2.4::DOUBLE, 0.8::DOUBLE * {counted('body', P.STRONG_INJECTION, 'is')})), 4) AS d6 FROM body",
    "output_findings": f"""WITH {_OUTPUTS},
chars AS (SELECT output_id, u.ch, count(*) AS n FROM body, unnest(string_split(body, '')) AS u(ch) GROUP BY ALL),
bits AS (SELECT output_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS bits FROM chars GROUP BY output_id),
s AS (SELECT output_id, origin, {counted('body', P.INSTRUCTIONAL)} / 4.0::DOUBLE AS instructional, least(1.0::DOUBLE, 0.5::DOUBLE * {counted('body', [p for p in P.EXFILTRATION if '(?!' not in p])}) AS exfiltration,
    least(1.0::DOUBLE, 0.5::DOUBLE * {counted('body', P.SECRETS)}) AS secret_exposure, {found('body', P.HIGH_SECRETS)} AS high_secret,
    least(1.0::DOUBLE, 0.3::DOUBLE * ({found('body', P.DECODE_PIPE_EXEC)}::INT + {counted('body', [P.EVAL_DECODE, P.SCRIPT_ENCODED_EXEC, P.PROCESS_SUB_REMOTE, P.HEREDOC_EXEC])} + {counted('body', [P.VARIABLE_EXPANSION, P.VARIABLE_EXEC_TRIGGER, *P.OBFUSCATION_EXACT], '')}
      + {counted('body', P.OBFUSCATION_ANY_CASE)} + {found('body', [P.REMOTE_PIPE_EXEC])}::INT) + CASE WHEN length(body) > 50 AND bits > 5.5 THEN least(0.5, (bits - 5.5) / 2.5) ELSE 0 END) AS obfuscation FROM body JOIN bits USING (output_id)),
c AS (SELECT *, least(3.0::DOUBLE, least(3.0::DOUBLE, CASE WHEN instructional > 0.5 THEN instructional ELSE 0 END + exfiltration + secret_exposure + CASE WHEN obfuscation > 0.1 THEN obfuscation ELSE 0 END) * CASE WHEN origin = 'external' THEN 1.3::DOUBLE ELSE 1 END) AS raw FROM s),
t AS (SELECT *, greatest(CASE WHEN raw >= 0.9 THEN 3 WHEN raw >= 0.6 THEN 2 WHEN raw >= 0.3 THEN 1 ELSE 0 END, CASE WHEN exfiltration > 0 THEN 2 ELSE 0 END,
    CASE WHEN secret_exposure > 0 THEN CASE WHEN high_secret THEN 3 ELSE 2 END ELSE 0 END, CASE WHEN obfuscation > 0.1 THEN CASE WHEN exfiltration > 0 OR secret_exposure > 0 THEN 3 ELSE 1 END ELSE 0 END) AS tier_rank FROM c)
SELECT output_id, instructional, exfiltration, secret_exposure, round(obfuscation, 4) AS obfuscation, round(raw, 3) AS score, ['log_only', 'monitor', 'escalate', 'emergency'][tier_rank + 1] AS tier,
  concat_ws(',', CASE WHEN instructional > 0.5 THEN 'indirect_injection' END, CASE WHEN exfiltration > 0 THEN 'exfiltration' END, CASE WHEN secret_exposure > 0 THEN 'secret_exposure' END, CASE WHEN obfuscation > 0.1 THEN 'obfuscation' END) AS patterns FROM t""",
    "redact_secrets": f"SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SECRET}', '[REDACTED]', 'gi') AS redacted FROM documents",
    "entropy": """WITH c AS (SELECT doc_id, u.ch, count(*) AS n FROM documents, unnest(string_split(coalesce(text, ''), '')) AS u(ch) GROUP BY ALL)
SELECT doc_id, round(coalesce((SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM c WHERE c.doc_id = d.doc_id), 0), 4) AS entropy FROM documents d""",
    "pattern_matches": f"WITH {VIEW}, {_RULES} SELECT event_id, session_id, rule_id, category, risk_level, weight FROM matches",
    "rule_coverage": f"WITH {VIEW}, {_RULES} SELECT rule_id, count(*) AS hits, count(DISTINCT session_id) AS sessions FROM matches GROUP BY ALL",
    "taxonomy_counts": f"{SCORED}, {_CLASSIFIED} SELECT tier, subtype, count(*) AS n FROM classified GROUP BY ALL",
    "live_overview": f"""{SCORED}, {_CLASSIFIED}, latest AS (SELECT * FROM classified QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY micros DESC, event_id DESC) = 1)
SELECT CASE grouping(risk_level, tier, subtype) WHEN 3 THEN 'risk_level' WHEN 5 THEN 'tier' WHEN 6 THEN 'subtype' ELSE 'total' END AS dimension, coalesce(risk_level, tier, subtype, '') AS value, count(*) AS n
FROM latest GROUP BY GROUPING SETS ((risk_level), (tier), (subtype), ())""",
    "summary_counts": SCORED + _SUMMARY,
    "high_risk_trend": f"""{SCORED}, b AS (SELECT floor(((SELECT max(micros) FROM scored) - micros) / (300 * {_UNIT}))::INT AS bucket, risk_rank FROM scored)
SELECT r.bucket::INT AS bucket, count(b.bucket) AS total, coalesce(count_if(b.risk_rank >= 2), 0) AS high, coalesce(round(count_if(b.risk_rank >= 2) / nullif(count(b.bucket), 0), 4), 0) AS ratio
FROM range(12) r(bucket) LEFT JOIN b USING (bucket) GROUP BY ALL""",
    "invalid_rates": f"""WITH {VIEW}, n AS (SELECT micros, tool_name = 'bash' AND command = 'uname -a' AS bad, max(micros) OVER () AS now FROM agent_events),
w AS (SELECT w AS "window", count_if(micros >= now - w * 60 * {_UNIT}) AS total, count_if(bad AND micros >= now - w * 60 * {_UNIT}) AS invalid FROM n, (VALUES (1), (5), (15)) v(w) GROUP BY ALL),
r AS (SELECT *, coalesce(invalid::DOUBLE / nullif(total, 0), 0) AS raw FROM w)
SELECT "window", total, invalid, round(raw, 6) AS rate, CASE WHEN "window" = 1 AND invalid > 20 OR "window" = 5 AND raw > 0.01 THEN 'critical' WHEN "window" = 15 AND raw BETWEEN 0.001 AND 0.01 THEN 'medium' ELSE 'none' END AS alert FROM r""",
    "posture": f"""{SCORED}, c AS (SELECT 2 AS version UNION ALL SELECT 1), m AS (SELECT *, coalesce(command = 'uname -a', false) AS bad, micros >= (SELECT max(micros) FROM scored) - 900 * 1000000::BIGINT * 36 AS recent FROM scored),
n AS (SELECT count_if(NOT bad AND risk_rank = 3) AS critical, count_if(NOT bad AND risk_rank = 2) AS high, coalesce(count_if(recent AND NOT bad AND risk_rank >= 2) / nullif(count_if(recent AND NOT bad), 0), 0) AS r, coalesce(count_if(recent AND bad) / nullif(count_if(recent), 0), 0) AS i FROM m),
x AS (SELECT *, greatest(0.0::DOUBLE, 100 - least(100.0::DOUBLE, 20.0 * critical + 10.0 * high + 25.0 * r + CASE version WHEN 1 THEN 30.0 ELSE 15.0 END * i)) AS raw,
  list_reverse_sort([{{'impact': 20.0 * critical, 'nth': 0, 'name': 'critical'}}, {{'impact': 10.0 * high, 'nth': -1, 'name': 'high'}}, {{'impact': 25.0 * r, 'nth': -2, 'name': 'recent_high'}}, {{'impact': CASE version WHEN 1 THEN 30.0 ELSE 15.0 END * i, 'nth': -3, 'name': 'recent_invalid'}}]) AS parts FROM n, c)
SELECT version, critical, high, round(r, 4) AS high_ratio, round(i, 4) AS invalid_rate, round(raw, 1) AS score,
  CASE WHEN raw >= 90 THEN 'healthy' WHEN version = 1 AND raw >= 70 THEN 'guarded' WHEN version = 1 AND raw >= 40 THEN 'degraded' WHEN version = 2 AND raw >= 75 THEN 'watch' WHEN version = 2 AND raw >= 50 THEN 'elevated' ELSE 'critical' END AS state,
  array_to_string(list_transform(list_slice(list_filter(parts, lambda q: q.impact > 0), 1, 3), lambda q: q.name), ',') AS drivers FROM x""",
    "forced_enforcement": f"""{SCORED}, r AS (SELECT session_id, event_id, micros, coalesce(count_if(risk_rank >= 2) OVER (PARTITION BY session_id ORDER BY micros, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hb, micros - lag(micros) OVER {_ORDER} AS gap FROM scored),
f AS (SELECT r.event_id, max(q.micros) AS last FROM r JOIN scored q ON q.session_id = r.session_id AND q.risk_rank = 3 AND q.event_id % 2 = 0 AND q.micros <= r.micros GROUP BY ALL)
SELECT event_id, (hb >= 3 AND coalesce(gap, 1e18) < 10 * {_UNIT}) OR coalesce(micros - last < 10 * {_UNIT}, false) AS enforced, coalesce(micros - last < 10 * {_UNIT}, false) AS forced FROM r LEFT JOIN f USING (event_id)""",
    "output_summary": f"""{SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY micros DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY session_id) AS n FROM scored)
SELECT session_id, count(*) AS events, round(max(composite) FILTER (back = 1), 4) AS latest, round(sum(composite), 4) AS total, round(avg(composite), 4) AS mean_score,
  round(sum(composite * CASE WHEN back = n THEN 0.7::DOUBLE ** (n - 1) ELSE 0.3::DOUBLE * 0.7::DOUBLE ** (back - 1) END), 4) AS ewma FROM r GROUP BY session_id""",
    "derived_fields": f"""WITH {VIEW} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'run' || event_id WHEN event_id % 2 = 0 THEN 'ap' || event_id ELSE event_id::VARCHAR END AS trace_id,
  CASE WHEN event_id % 4 = 0 THEN 'own' WHEN event_id % 4 IN (2, 3) AND etype = 'post_action' THEN 'alias' END AS output,
  CASE WHEN event_id % 4 = 1 THEN source_framework WHEN event_id % 3 = 1 THEN 'codex' WHEN event_id % 3 = 2 THEN 'openclaw' ELSE 'unknown' END AS framework,
  event_id % 2 = 0 AND (event_id % 3 <> 0 OR event_id % 5 = 0) AS invalid FROM agent_events""",
    "session_list": f"""{SCORED}, l AS (SELECT session_id, arg_max(risk_level, (micros, event_id)) AS risk_level, max(micros) AS last_micros, count(*) AS events FROM scored GROUP BY session_id),
k AS (SELECT *, CASE risk_level WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS rank FROM l)
SELECT session_id, risk_level, last_micros, events FROM k WHERE rank >= 1 AND last_micros >= (SELECT max(last_micros) FROM k) - 3600 * {_UNIT} ORDER BY rank DESC, last_micros DESC, session_id LIMIT 50""",
    "alert_list": f"""{SCORED}, a AS (SELECT event_id AS alert_id, risk_level AS severity, event_id % 3 = 0 AS acknowledged, micros FROM scored WHERE risk_rank >= 1)
SELECT alert_id, severity, acknowledged, micros, (SELECT count_if(NOT acknowledged) FROM a) AS total_open, (SELECT count_if(NOT acknowledged AND severity IN ('high', 'critical')) FROM a) AS priority_open
FROM a WHERE severity = 'high' AND NOT acknowledged ORDER BY micros DESC, alert_id LIMIT 100""",
    "second_level": f"{SCORED}, {_SECOND}",
    "sampled_events": f"""WITH {VIEW}, c AS (SELECT session_id, tool_name, event_id, micros FROM agent_events),
{_thinned('c', 'session_id, tool_name', 5)} SELECT session_id, tool_name, event_id, suppressed FROM thinned""",
    "alert_thinning": f"""WITH {VIEW}, c AS (SELECT source_framework AS metric, tool_name AS severity, event_id, micros FROM agent_events),
{_thinned('c', 'metric, severity', 60)} SELECT metric, severity, event_id, suppressed FROM thinned""",
    "missing_dimensions": f"""WITH {VIEW}, v AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN tool_name END AS tool, CASE WHEN event_id % 3 <> 0 THEN path END AS path, CASE WHEN event_id % 5 <> 0 THEN command END AS command, CASE WHEN trust <> 'untrusted' THEN trust END AS trust FROM agent_events)
SELECT event_id, concat_ws(',', CASE WHEN tool IS NULL THEN 'd1' END, CASE WHEN path IS NULL AND NOT coalesce(contains(command, '/'), false) THEN 'd2' END, CASE WHEN tool = 'bash' AND command IS NULL THEN 'd3' END, CASE WHEN trust IS NULL THEN 'd5' END) AS missing FROM v""",
    "resolved_verdicts": f"""{SCORED} SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN verdict WHEN etype <> 'pre_action' THEN 'defer' ELSE 'block' END AS block,
  CASE WHEN event_id % 4 <> 0 THEN verdict WHEN etype <> 'pre_action' THEN 'defer' WHEN risk_level = 'low' THEN 'allow' ELSE 'block' END AS by_level FROM scored""",
    "session_risk": f"""{SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY micros DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY session_id) AS n FROM scored)
SELECT session_id, count(*) AS events, count_if(risk_rank >= 2) AS high_events, max(composite) FILTER (back = 1) AS latest, round(sum(composite), 4) AS total, round(avg(composite), 4) AS mean_score,
  round(sum(composite * CASE WHEN back = n THEN 0.7::DOUBLE ** (n - 1) ELSE 0.3::DOUBLE * 0.7::DOUBLE ** (back - 1) END), 4) AS ewma, sum(risk_rank) AS points,
  CASE WHEN count(*) < 2 THEN 'unknown' WHEN max(composite) FILTER (back = 1) - max(composite) FILTER (back = n) > 0.25 THEN 'up' WHEN max(composite) FILTER (back = 1) - max(composite) FILTER (back = n) < -0.25 THEN 'down' ELSE 'flat' END AS velocity
FROM r GROUP BY session_id""",
    "session_profile": f"""{SCORED} SELECT session_id, count(*) AS events, count_if(risk_rank >= 2) AS high_events, count_if(verdict = 'block') AS blocked, string_agg(DISTINCT tool_name, ',' ORDER BY tool_name) AS tools,
  min(micros) AS first_micros, max(micros) AS last_micros, arg_max(risk_level, (micros, event_id)) AS latest_level, floor(arg_max(composite, (micros, event_id)))::BIGINT AS cumulative_score FROM scored GROUP BY session_id""",
    "session_timeline": f"{SCORED} SELECT session_id, event_id, risk_level, composite, row_number() OVER (PARTITION BY session_id ORDER BY micros DESC, event_id DESC) AS position FROM scored QUALIFY position <= 20",
    "risk_changes": f"""{SCORED}, p AS (SELECT *, lag(risk_rank) OVER {_ORDER} AS previous FROM scored)
SELECT session_id, event_id, risk_level, CASE WHEN previous IS NULL THEN 'start' ELSE 'rise' END AS change, risk_rank >= 2 AS alert FROM p WHERE previous IS NULL OR risk_rank > previous""",
    "cumulative_points": f"{SCORED}, p AS (SELECT *, sum(risk_rank) OVER {_UPTO} AS points FROM scored) SELECT session_id, event_id, points FROM p WHERE points >= 5 AND points - risk_rank < 5",
    "d4_accumulation": f"WITH {VIEW}, {DIMENSIONS}, {_D4} SELECT event_id, session_id, prior_high, d4, composite, risk_level FROM ({levelled('counted', 'CASE WHEN prior_high >= 5 THEN 2 WHEN prior_high >= 2 THEN 1 ELSE 0 END')})",
    "d4_frequency": f"""WITH {VIEW}, n AS (
  SELECT c.event_id, o.tool_name, count_if(o.micros >= c.micros - 5 * {_UNIT}) AS n5, count(*) AS n60 FROM agent_events c
  JOIN agent_events o ON o.session_id = c.session_id AND o.micros >= c.micros - 60 * {_UNIT} AND (o.micros, o.event_id) <= (c.micros, c.event_id) GROUP BY ALL)
SELECT event_id, CASE WHEN max(n5) >= 4 THEN 2 WHEN max(n60) >= 12 OR sum(n60) >= 30 THEN 1 ELSE 0 END AS freq_d4 FROM n GROUP BY event_id""",
    "trajectories": f"WITH {VIEW}, {_ALERTS} SELECT session_id, sequence_id, risk_level, trigger_event_id, matched FROM alerts",
    "alerted_verdicts": f"""{SCORED}, {_ALERTS} SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN etype = 'pre_action' AND event_id IN (SELECT trigger_event_id FROM alerts) THEN 'block' ELSE verdict END AS verdict FROM scored) GROUP BY ALL""",
    "suspicious_history": f"""WITH {VIEW}, t AS (
  SELECT *, lower(concat('{{', CASE WHEN command IS NOT NULL THEN '"command":"' || command || '"' END, CASE WHEN content IS NOT NULL THEN ',"content":"' || content || '"' END, CASE WHEN path IS NOT NULL THEN ',"path":"' || path || '"' END, '}}')) AS payload FROM agent_events),
f AS (SELECT session_id, event_id, micros, count(*) OVER {_UPTO} AS n,
    tool_name IN {listed(P.READ_TOOLS)} AND {found('path', [P.CREDENTIAL_PATH])} AS cred, tool_name = 'http_request' OR {found('payload', [P.NETWORK_COMMAND])} AS net, tool_name = 'read_file' AS rd, tool_name = 'write_file' AS wr,
    contains(payload, 'sudo ') AS sudo, {found('payload', [P.TEMP_PATH])} AS tmp, tool_name = 'write_file' OR contains(payload, 'tee ') OR contains(payload, '>') OR contains(payload, 'base64 ') OR contains(payload, 'cp ') OR contains(payload, 'mv ') OR contains(payload, 'tar ') OR contains(payload, 'zip ') AS staging,
    tool_name = 'bash' AND {found('payload', [P.RECON])} OR {' OR '.join(f"contains(payload, '{x}')" for x in P.RECON_TOKENS)} AS recon FROM t),
g AS (SELECT *, bool_or(cred) OVER {_UPTO} AS s_cred, bool_or(net) OVER {_UPTO} AS s_net, bool_or(rd) OVER {_UPTO} AS s_rd, bool_or(tmp AND staging) OVER {_UPTO} AS s_stage, bool_or(recon) OVER {_UPTO} AS s_recon FROM f),
k AS (SELECT *, bool_or(wr AND s_rd) OVER {_UPTO} AS s_wr FROM g),
p AS (SELECT session_id, event_id, n, s_cred AND s_net AS p1, bool_or(sudo AND s_wr) OVER {_UPTO} AS p2, bool_or(tmp AND net AND s_stage) OVER {_UPTO} AS p3, bool_or(sudo AND s_recon) OVER {_UPTO} AS p4 FROM k)
SELECT session_id, event_id, CASE WHEN p1 THEN 'secret_plus_network' WHEN p2 THEN 'privilege_escalation_chain' WHEN p3 THEN 'tmp_staging_exfil' ELSE 'recon_then_sudo' END AS pattern FROM p WHERE n >= 2 AND (p1 OR p2 OR p3 OR p4)""",
    "bypass_matches": f"{SCORED}, {_FP} SELECT event_id, arg_max(prior_event_id, (pm, prior_event_id)) AS prior_event_id, arg_max(rule, (pm, prior_event_id)) AS rule FROM fired WHERE rule IS NOT NULL GROUP BY event_id",
    "enforcement_state": f"""{SCORED}, e AS (SELECT session_id, event_id, risk_rank, coalesce(count_if(risk_rank >= 2) OVER {_BEFORE}, 0) AS high_before, (micros - lag(micros) OVER {_ORDER}) / {_UNIT} AS gap FROM scored),
f AS (SELECT *, coalesce(high_before >= 3 AND gap < 10, false) AS enforced FROM e)
SELECT session_id, event_id, high_before, enforced, high_before + (risk_rank >= 2)::INT >= 3 AND NOT enforced AS triggers FROM f""",
    "asof_quarantine": f"""{SCORED}, q AS (SELECT session_id, micros, CASE WHEN event_id % 2 = 0 THEN 'quarantined' ELSE 'released' END AS state FROM scored WHERE risk_rank = 3)
SELECT s.event_id, q.state FROM scored s ASOF LEFT JOIN (SELECT DISTINCT ON (session_id, micros) * FROM q) q ON s.session_id = q.session_id AND s.micros > q.micros""",
    "replay_enriched": f"""WITH {VIEW}, f AS (SELECT session_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id END AS event_id, CASE event_id % 3 WHEN 0 THEN 'enforced' WHEN 1 THEN 'degraded' ELSE 'unsupported' END AS kind FROM agent_events WHERE event_id % 3 = 0 OR event_id % 5 = 0),
o AS (SELECT session_id, event_id, string_agg(kind, ',' ORDER BY kind) AS own_effects FROM f WHERE event_id IS NOT NULL GROUP BY ALL), s AS (SELECT session_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS session_effects FROM f WHERE event_id IS NULL GROUP BY ALL)
SELECT a.session_id, a.event_id, own_effects, session_effects FROM agent_events a LEFT JOIN o USING (session_id, event_id) LEFT JOIN s ON s.session_id = a.session_id""",
    "evidence_snapshots": f"""{SCORED}, n AS (SELECT *, row_number() OVER {_ORDER} AS seq, coalesce(lag(risk_rank) OVER {_ORDER}, 0) AS before FROM scored)
SELECT t.session_id, t.event_id AS trigger_event_id, arg_min(r.event_id, r.seq) AS from_event_id, count(*) AS records, count_if(r.risk_rank >= 2) AS high, ['low', 'medium', 'high', 'critical'][max(r.risk_rank) + 1] AS highest, count_if(r.verdict = 'block') AS blocked,
  CASE WHEN count_if(r.risk_rank >= 2) >= 3 THEN 'escalate' WHEN count_if(r.risk_rank >= 2) >= 1 THEN 'review' ELSE 'monitor' END AS action
FROM n t JOIN n r ON r.session_id = t.session_id AND r.seq BETWEEN t.seq - 49 AND t.seq WHERE t.risk_rank = 3 AND t.before < 3 GROUP BY ALL""",
    "approval_outcomes": f"""WITH {VIEW}, q AS (SELECT event_id AS approval_id, micros AS asked FROM agent_events WHERE event_id % 3 = 0),
a AS (SELECT event_id - event_id % 3 AS approval_id, micros, CASE WHEN event_id % 2 = 0 THEN 'allow' ELSE 'deny' END AS decision FROM agent_events WHERE event_id % 3 <> 0 AND event_id % 7 < 4),
f AS (SELECT approval_id, min(micros) AS m, arg_min(decision, (micros, decision)) AS decision FROM a GROUP BY ALL), n AS (SELECT max(micros) AS now FROM agent_events WHERE event_id % 3 = 0 OR event_id % 7 < 4),
s AS (SELECT q.approval_id, CASE WHEN m >= asked AND m <= asked + {_UNIT} // 100 THEN CASE WHEN decision = 'allow' THEN 'allowed' ELSE 'denied' END WHEN now > asked + {_UNIT} // 100 THEN 'expired' ELSE 'pending' END AS state FROM q LEFT JOIN f USING (approval_id), n)
SELECT approval_id, state, CASE state WHEN 'allowed' THEN 'allow' WHEN 'denied' THEN 'block' WHEN 'expired' THEN 'block' END AS verdict, CASE state WHEN 'allowed' THEN 'approval_allowed' WHEN 'denied' THEN 'approval_denied' WHEN 'expired' THEN 'approval_timeout' END AS reason_code FROM s""",
    "token_budget": f"""WITH {VIEW}, t AS (SELECT event_id, micros, strftime(occurred_at, '%Y-%m-%d') AS day, input_tokens + output_tokens AS tokens FROM agent_events), r AS (SELECT *, sum(tokens) OVER (PARTITION BY day ORDER BY micros, event_id) AS upto FROM t)
SELECT day, sum(tokens) AS used, count_if(tokens = 0) AS unknown, arg_min(event_id, (micros, event_id)) FILTER (upto >= 100000) AS exhausted_by FROM r GROUP BY day""",
    "usage_rollup": f"""WITH {VIEW} SELECT CASE grouping(source_framework, tool_name) WHEN 1 THEN 'framework' WHEN 2 THEN 'tool' ELSE 'total' END AS dimension, coalesce(source_framework, tool_name, '') AS value, count(*) AS calls, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens,
  round((sum(input_tokens) * 3.0 + sum(output_tokens) * 15.0) / 1e6, 6) AS cost FROM agent_events GROUP BY GROUPING SETS ((source_framework), (tool_name), ())""",
    "latency_histogram": f"WITH {VIEW} SELECT source_framework, edge, count_if(edge IS NULL OR value <= edge) AS n FROM agent_events, (VALUES {', '.join(f'({e}::DOUBLE)' for e in _EDGES)}, (NULL)) e(edge) GROUP BY ALL",
    "latency_pressure": f"""WITH {VIEW} SELECT tool_name, count(*) AS calls, round(sum(value / 400), 4) AS total, arg_max(value / 400, (micros, event_id)) AS last, max(value / 400) AS largest,
  CASE WHEN max(value / 400) >= 1 THEN 'high' WHEN max(value / 400) >= 0.25 THEN 'medium' WHEN max(value / 400) >= 0.05 THEN 'low' ELSE 'none' END AS pressure FROM agent_events GROUP BY ALL""",
    "workspace_rollup": f"""{SCORED} SELECT source_framework, CASE WHEN workspace_root = '' THEN 'unbound' ELSE workspace_root END AS workspace, count(DISTINCT session_id) AS sessions, count(*) AS events, count_if(risk_rank >= 2) AS high, max(risk_rank) AS highest
FROM scored GROUP BY ROLLUP (source_framework, workspace)""",
    "dashboard": f"{SCORED} SELECT round(100 * count_if(verdict = 'block') / count(*), 4) AS block_rate, round(count_if(risk_rank >= 2) / count(*), 4) AS risk_density, count(DISTINCT session_id) AS sessions, count(DISTINCT workspace_root) AS workspaces, count(DISTINCT source_framework) AS frameworks FROM scored",
    "priority_sessions": f"{SCORED} SELECT session_id, max(risk_rank) AS top, max(micros) AS last, count(*) AS events FROM scored GROUP BY session_id HAVING top >= 2 ORDER BY top DESC, last DESC, session_id LIMIT 6",
    "audit_search": f"{SCORED} SELECT event_id, session_id, micros, tool_name, risk_level, verdict FROM scored WHERE risk_level = 'critical' AND contains(tool_name, 'ba') ORDER BY micros DESC, event_id DESC LIMIT 100",
    "audit_stats": f"""{SCORED}, g AS (SELECT CASE grouping(risk_level, verdict, source_framework) WHEN 3 THEN 'risk_level' WHEN 5 THEN 'verdict' WHEN 6 THEN 'source_framework' ELSE 'total' END AS dimension, coalesce(risk_level, verdict, source_framework, '') AS value, count(*) AS n FROM scored GROUP BY GROUPING SETS ((risk_level), (verdict), (source_framework), ())),
t AS (SELECT 'session' AS dimension, session_id::VARCHAR AS value, count(*) AS n FROM scored GROUP BY session_id ORDER BY n DESC, session_id LIMIT 5) SELECT * FROM g UNION ALL SELECT * FROM t""",
    "replay_page": f"{SCORED}, p AS (SELECT event_id, session_id, verdict FROM scored WHERE event_id < 500 ORDER BY event_id DESC LIMIT 50) SELECT *, (SELECT min(event_id) FROM p) AS next_cursor FROM p",
    "vector_scores": """WITH c AS (SELECT embedding AS v FROM embeddings WHERE label = 0), s AS (SELECT vec_id, round(max(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[])), 4) AS similarity FROM embeddings, c WHERE label <> 0 GROUP BY vec_id)
SELECT vec_id, similarity, round(CASE WHEN similarity <= 0.75 THEN 0 ELSE least(2 * (similarity - 0.75) / 0.25, 2) END, 4) AS score FROM s""",
    "vector_search": """WITH q AS (SELECT a.vec_id AS query_id, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: 0.65::DOUBLE * x[1] + 0.35::DOUBLE * x[2]) AS u FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 50 = 0),
c AS (SELECT min(vec_id) AS vec_id, count(*) AS copies, embedding::DOUBLE[] AS v FROM embeddings GROUP BY embedding)
SELECT query_id, vec_id, copies, round(list_cosine_similarity(u, v), 4) AS similarity FROM q, c WHERE list_cosine_similarity(u, v) >= 0.75""",
    "request_limits": f"WITH RECURSIVE {VIEW}, {_limited(5, 20 * _UNIT)}",
    "verdict_reasons": f"""{SCORED} SELECT event_id, CASE WHEN event_id % 10 = 9 THEN 'Pre-prompt events are fail-open to avoid blocking user input' WHEN etype = 'post_action' THEN 'Non-blocking event type ''post_action'': observation only'
  ELSE concat_ws(' | ', CASE risk_level WHEN 'critical' THEN 'Critical risk: action blocked' WHEN 'high' THEN 'High risk: action blocked' WHEN 'medium' THEN 'Medium risk: allowed with audit' ELSE 'Low risk: safe operation' END,
    printf('D1=%d D2=%d D3=%d D4=%d D5=%d D6=%.2f', d1, d2, d3, d4, d5, d6), printf('score=%.4f', composite), 'short_circuit=' || sc_rule, 'tool=' || tool_name) END AS reason FROM scored""",
    "risk_direction": f"""{SCORED}, n AS (SELECT (SELECT max(micros) FROM scored) - micros AS age, risk_rank >= 2 AS high FROM scored),
c AS (SELECT count_if(age <= 3 * {_UNIT}) AS total_5, count_if(age <= 9 * {_UNIT}) AS total_15, count_if(age <= 36 * {_UNIT}) AS total_60, count_if(high AND age <= 3 * {_UNIT}) AS high_5, count_if(high AND age <= 9 * {_UNIT}) AS high_15,
  count_if(high AND age <= 36 * {_UNIT}) AS high_60, count_if(high AND age > 3 * {_UNIT} AND age <= 6 * {_UNIT}) AS earlier FROM n)
SELECT * EXCLUDE (earlier), round(high_5 / total_5, 6) AS ratio_5, round(high_15 / total_15, 6) AS ratio_15, round(high_60 / total_60, 6) AS ratio_60, CASE WHEN high_5 > earlier THEN 'up' WHEN high_5 < earlier THEN 'down' ELSE 'flat' END AS direction FROM c""",
    "session_posture": f"""{SCORED}, l AS (SELECT arg_max(risk_rank, (micros, event_id)) AS r FROM scored GROUP BY session_id), c AS (SELECT count_if(r = 3) AS critical, count_if(r = 2) AS high, count_if(r >= 1) AS mapped FROM l),
s AS (SELECT *, 100 - least(100, 20 * critical + 10 * high) AS score FROM c)
SELECT critical, high, score::DOUBLE AS score, CASE WHEN score < 50 THEN 'critical' WHEN score < 75 THEN 'elevated' WHEN score < 90 THEN 'watch' ELSE 'healthy' END AS level,
  concat_ws(',', CASE WHEN critical > 0 THEN 'critical_sessions:' || critical END, CASE WHEN high > 0 THEN 'high_sessions:' || high END, CASE WHEN mapped > 0 THEN 'mapped_active_sessions:' || mapped END) AS drivers FROM s""",
    "session_counts": f"""{SCORED}, l AS (SELECT arg_max(risk_rank, (micros, event_id)) AS r, arg_max(source_framework, (micros, event_id)) AS f, arg_max(workspace_root, (micros, event_id)) AS w FROM scored GROUP BY session_id),
k AS (SELECT 'framework' AS key, f AS name, r FROM l UNION ALL SELECT 'workspace', CASE WHEN w = '' THEN 'unknown' ELSE w END, r FROM l),
c AS (SELECT key, name, count(*) AS total_sessions, count_if(r >= 2) AS high_or_critical_count, count_if(r = 3) AS critical_count FROM k GROUP BY ALL)
SELECT *, round(high_or_critical_count / total_sessions, 6) AS high_or_critical_ratio, round(critical_count / total_sessions, 6) AS critical_ratio FROM c
QUALIFY row_number() OVER (PARTITION BY key ORDER BY high_or_critical_count DESC, critical_count DESC, total_sessions DESC, name) <= 10""",
    "top_usage": f"""WITH {VIEW}, u AS (SELECT 'total' AS dimension, '' AS value, input_tokens + output_tokens AS t FROM agent_events UNION ALL SELECT 'framework', source_framework, input_tokens + output_tokens FROM agent_events UNION ALL SELECT 'tool', tool_name, input_tokens + output_tokens FROM agent_events),
s AS (SELECT dimension, value, sum(t) AS t, count(*) AS calls FROM u GROUP BY ALL) SELECT dimension, value FROM s QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY t DESC, calls DESC, value) = 1""",
    "replay_range": f"{SCORED} SELECT event_id, session_id, risk_level, verdict FROM scored WHERE session_id = 7 AND event_id BETWEEN 100 AND 900",
    "replay_scores": f"""{SCORED}, d AS (SELECT session_id || '-' || (micros // 86400000000) AS record_id, session_id + micros // 86400000000 AS k, etype, CASE WHEN event_id % 9 = 0 THEN 'defer' ELSE verdict END AS v, risk_rank, event_id % 5 AS m FROM scored),
l AS (SELECT DISTINCT record_id, k % 3 = 0 AS unsafe FROM d WHERE k % 7 <> 0), p AS (SELECT * FROM d WHERE k % 10 <> 0),
r AS (SELECT l.record_id, unsafe, count(p.record_id) AS events, coalesce(count_if(v = 'block'), 0) AS blocked, coalesce(count_if(v = 'defer'), 0) AS deferred, coalesce(max(risk_rank), 0) AS top, coalesce(bool_or(etype = 'pre_action'), false) AS pre, coalesce(bool_or(etype = 'post_action'), false) AS post,
  coalesce(count_if(m >= 2), 0) AS l1, coalesce(count_if(m = 1), 0) AS l2, coalesce(count_if(m = 0), 0) AS l3 FROM l LEFT JOIN p USING (record_id) GROUP BY ALL),
x AS (SELECT *, blocked + deferred > 0 AS stopped, blocked + deferred > 0 OR top >= 2 AS hit FROM r),
n AS (SELECT count(*) AS records, count_if(unsafe AND hit) AS tp, count_if(NOT unsafe AND hit) AS fp, count_if(unsafe AND NOT hit) AS fn, count_if(NOT unsafe AND NOT hit) AS tn, count_if(unsafe AND stopped) AS st, count_if(pre) AS pre, count_if(post) AS post,
  sum(events) AS events, sum(blocked) AS blocked, sum(deferred) AS deferred, sum(l1) AS "L1", sum(l2) AS "L2", sum(l3) AS "L3", count_if(top = 0) AS max_low, count_if(top = 1) AS max_medium, count_if(top = 2) AS max_high, count_if(top = 3) AS max_critical FROM x)
SELECT * EXCLUDE (st, pre, post), round(tp / nullif(tp + fn, 0), 6) AS unsafe_recall, round(fp / nullif(fp + tn, 0), 6) AS safe_false_positive_rate, round(tp / nullif(tp + fp, 0), 6) AS precision, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy,
  round(st / nullif(tp + fn, 0), 6) AS prevention_recall, round(pre / records, 6) AS pre_action_coverage, round(post / records, 6) AS post_action_coverage FROM n""",
    "metric_lines": f"""{SCORED}, c AS (SELECT verdict, risk_level, source_framework, count(*) AS n FROM scored GROUP BY ALL), b AS (SELECT source_framework, le, count_if(le = '+Inf' OR composite <= TRY_CAST(le AS DOUBLE)) AS n FROM scored, (VALUES ('0.5'), ('1.5'), ('2.5'), ('+Inf')) v(le) GROUP BY ALL)
SELECT 'decisions_total{{verdict="' || verdict || '",risk_level="' || risk_level || '",source_framework="' || source_framework || '"}} ' || n AS line FROM c UNION ALL SELECT 'risk_score_bucket{{source_framework="' || source_framework || '",le="' || le || '"}} ' || n FROM b""",
    "rule_dry_run": f"""WITH {VIEW}, {_RULES}, b AS (SELECT event_id, tool_name, lower(concat_ws(' ', command, path, content)) AS body FROM agent_events WHERE event_id % 13 <> 12),
s AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 10 ELSE 0 END + 5 * (tool_name = 'read_file')::INT + contains(body, 'id_rsa')::INT + contains(body, '.env')::INT + contains(body, 'passwd')::INT AS c,
  CASE WHEN event_id % 7 <> 0 AND event_id % 11 = 0 THEN 10 ELSE 0 END + 5 * (tool_name IN ('http_request', 'bash'))::INT + contains(body, 'curl')::INT + contains(body, 'http')::INT AS n,
  CASE WHEN event_id % 7 <> 0 AND event_id % 11 = 0 THEN 10 ELSE 0 END + 5 * (tool_name = 'bash')::INT + contains(body, 'sudo')::INT + contains(body, 'rm -rf')::INT + contains(body, 'chmod')::INT AS h FROM b),
m AS (SELECT event_id, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS matched FROM matches GROUP BY event_id)
SELECT event_id, coalesce(matched, '') AS matched, CASE WHEN greatest(c, n, h) = 0 THEN 'general' WHEN c = greatest(c, n, h) THEN 'credential-review' WHEN n = greatest(c, n, h) THEN 'network-review' ELSE 'shell-review' END AS skill, NULL AS finding FROM s LEFT JOIN m USING (event_id)
UNION ALL SELECT event_id, NULL, NULL, 'event_id missing' FROM agent_events WHERE event_id % 13 = 12""",
    "score_histogram": f"""{SCORED}, e AS (SELECT * FROM (VALUES (0.5), (1.0), (1.5), (2.0), (2.5), (NULL)) v(edge))
SELECT source_framework, edge::DOUBLE AS edge, count_if(edge IS NULL OR composite <= edge) AS n FROM scored, e GROUP BY ALL""",
    "session_aggregates": f"""{SCORED}, base AS (SELECT session_id, event_id, micros, 0 AS seq, 'decision' AS kind, CASE WHEN event_id % 4 = 0 THEN 'defer' ELSE verdict END AS verdict, CASE WHEN event_id % 3 = 0 THEN 'L1' ELSE 'L2' END AS tier, risk_rank, tool_name,
  CASE event_id % 5 WHEN 0 THEN ['shell', 'net'] WHEN 1 THEN ['net'] END AS hints, composite, event_id % 3 AS d4, d6 FROM scored),
again AS (SELECT * REPLACE ('resolution' AS kind, 1 AS seq, CASE WHEN event_id % 3 = 0 THEN 'allow' ELSE 'block' END AS verdict, 'human' AS tier, 0 AS risk_rank) FROM base WHERE event_id % 4 = 0),
r AS (SELECT * FROM base UNION ALL SELECT * FROM again UNION ALL SELECT * REPLACE (2 AS seq, 'modify' AS verdict, 3 AS risk_rank) FROM again WHERE event_id % 32 = 0 UNION ALL SELECT * REPLACE (-event_id AS event_id) FROM again WHERE event_id % 36 = 0),
live AS (SELECT a.* FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.session_id = a.session_id AND b.event_id = a.event_id AND b.kind = 'resolution' AND b.seq = a.seq + 1)),
v AS (SELECT session_id, string_agg(verdict || ':' || n, ',' ORDER BY verdict) AS verdicts FROM (SELECT session_id, verdict, count(*) AS n FROM live GROUP BY ALL) GROUP BY 1),
t AS (SELECT session_id, string_agg(tier || ':' || n, ',' ORDER BY tier) AS tiers FROM (SELECT session_id, tier, count(*) AS n FROM live GROUP BY ALL) GROUP BY 1),
h AS (SELECT session_id, count_if(risk_rank >= 2) AS high_risk_event_count FROM live GROUP BY 1),
w AS (SELECT session_id, string_agg(DISTINCT x, ',' ORDER BY x) AS hints FROM r, unnest(hints) u(x) GROUP BY 1),
b AS (SELECT session_id, count_if(kind = 'decision') AS event_count, sum(d4) FILTER (kind = 'decision') AS d4_sum, min(micros) AS first_micros, max(micros) AS last_micros, floor(arg_max(composite, (micros, seq, event_id)))::BIGINT AS cumulative_score,
  floor(arg_max(d6, (micros, seq, event_id)))::INT AS last_d6, string_agg(DISTINCT tool_name, ',' ORDER BY tool_name) AS tools FROM r GROUP BY 1)
SELECT b.*, high_risk_event_count, verdicts, tiers, coalesce(hints, '') AS hints FROM b JOIN v USING (session_id) JOIN t USING (session_id) JOIN h USING (session_id) LEFT JOIN w USING (session_id)""",
    "compat_evidence": f"""WITH {VIEW}, k AS (SELECT *, ['context_perception', 'memory_recall', 'planning', 'reasoning', 'intent_detection', NULL][(event_id % 6)::INT + 1] AS kind FROM agent_events),
q AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'query=top' WHEN event_id % 4 <> 1 THEN 'query=' || tool_name END AS query FROM k),
s AS (SELECT event_id, kind, CASE WHEN event_id % 11 = 10 THEN NULL ELSE nullif(CASE kind
  WHEN 'context_perception' THEN concat_ws(';', CASE WHEN event_id % 4 = 0 THEN 'intent=' || command END, query, 'target=deep', 'workspace=' || path)
  WHEN 'memory_recall' THEN concat_ws(';', 'max_results=' || CASE WHEN event_id % 3 = 1 THEN 12 ELSE event_id % 7 END, query, 'working_directory=' || path)
  WHEN 'planning' THEN concat_ws(';', 'constraints=["a"' || coalesce(',"' || content || '"', '') || ']', 'task=' || tool_name)
  WHEN 'reasoning' THEN 'problem_statement=' || content WHEN 'intent_detection' THEN 'target_hints={{"y":"' || path || '"}}' END, '') END AS summary FROM q)
SELECT event_id, CASE WHEN summary IS NOT NULL THEN kind END AS compat_event_type, CASE WHEN summary IS NOT NULL THEN CASE kind WHEN 'planning' THEN 'planning_summary' WHEN 'reasoning' THEN 'reasoning_summary' WHEN 'intent_detection' THEN 'intent_summary' ELSE 'compat_summary' END END AS summary_kind, summary FROM s""",
    "trajectory_events": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS depth FROM conversations)
SELECT conv_id || '-' || depth AS event_id, CASE WHEN depth > 0 THEN conv_id || '-' || (depth - 1) END AS parent_event_id, conv_id, CASE role WHEN 'user' THEN 'pre_prompt' WHEN 'assistant' THEN 'post_response' WHEN 'tool' THEN 'post_action' ELSE 'session' END AS etype,
  depth, length(text) AS n_chars, depth AS at_second FROM n""",
    "detection_quality": f"""WITH d AS (SELECT doc_id, {found('text', P.SECRETS)} OR {found('text', [_SECRET])} AS detected FROM documents), j AS (SELECT detected, toxic = 1 OR quality = 0 AS unsafe FROM d JOIN labels USING (doc_id)),
n AS (SELECT count_if(unsafe AND detected) AS tp, count_if(NOT unsafe AND detected) AS fp, count_if(unsafe AND NOT detected) AS fn, count_if(NOT unsafe AND NOT detected) AS tn FROM j)
SELECT tp, fp, fn, tn, round(tp / nullif(tp + fn, 0), 4) AS recall, round(fp / nullif(fp + tn, 0), 4) AS false_positive_rate, round(tp / nullif(tp + fp, 0), 4) AS precision FROM n""",
    "candidate_patterns": f"""WITH {VIEW}, c AS (SELECT substr(sha256(tool_name || ':' || command), 1, 16) AS candidate, tool_name, command, min(event_id) AS first_event_id, count(*) AS uses FROM agent_events WHERE command IS NOT NULL GROUP BY ALL),
m AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(command, 'https?://[^\\s"''|&;]+', chr(1), 'g'), '\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}', chr(2), 'g'), '/[\\w./-]+', chr(3), 'g') AS marked FROM c),
e AS (SELECT *, regexp_replace(marked, '([()\\[\\]{{}}?*+|^$\\\\.&~# -])', '\\\\\\1', 'g') AS escaped FROM m)
SELECT candidate, 'EV-' || upper(substr(candidate, 1, 8)) AS rule_id, tool_name, CASE WHEN regexp_matches(lower(command), 'curl|wget|nc |ncat') THEN 'data_exfiltration' WHEN regexp_matches(lower(command), 'sudo|chmod|chown') THEN 'privilege_abuse'
  WHEN regexp_matches(lower(command), 'eval|exec|python -c|bash -c') THEN 'code_execution' ELSE 'unknown' END AS category,
  replace(replace(replace(escaped, chr(1), 'https?://\\S+'), chr(2), '\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}'), chr(3), '[\\w./-]+') AS pattern, first_event_id, uses FROM e""",
    "pattern_lifecycle": f"""WITH {VIEW}, f AS (SELECT tool_name || '-' || session_id % 50 AS rule_id, event_id, micros, source_framework, (event_id * 7919) % 100 < 85 AS ok FROM agent_events),
r AS (SELECT *, count_if(ok) OVER w AS yes, count(*) OVER w AS votes FROM f WINDOW w AS (PARTITION BY rule_id ORDER BY micros, event_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT rule_id, max(yes) AS y, max(votes) AS v, bool_or(votes >= 3 AND votes - yes > 0.3 * votes) AS bad, bool_or(ok AND yes >= 3 AND 0.5::DOUBLE * yes / votes + 0.2::DOUBLE * least(votes / 10, 1) + 0.1::DOUBLE >= 0.7) AS good,
  count(DISTINCT source_framework) AS fw, (max(max(micros)) OVER () - max(micros)) / 86400e6 AS days FROM r GROUP BY rule_id)
SELECT rule_id, y AS confirmed, v - y AS false_positives, round(0.3::DOUBLE * y / v + 0.2::DOUBLE * least(v / 10, 1) + 0.2::DOUBLE * least((fw - 1) / 2, 1) + 0.2::DOUBLE * (1 - (v - y) / v) + CASE WHEN days <= 7 THEN 0.1 WHEN days <= 30 THEN 0.05 ELSE 0.02 END, 4) AS confidence,
  CASE WHEN bad THEN 'deprecated' WHEN good THEN 'stable' WHEN y >= 1 THEN 'experimental' ELSE 'candidate' END AS status FROM g""",
    "skill_routing": f"""WITH {VIEW}, b AS (SELECT event_id, tool_name, lower(concat_ws(' ', command, path, content)) AS body FROM agent_events),
s AS (SELECT event_id, 5 * (tool_name = 'read_file')::INT + contains(body, 'id_rsa')::INT + contains(body, '.env')::INT + contains(body, 'passwd')::INT AS c,
  5 * (tool_name IN ('http_request', 'bash'))::INT + contains(body, 'curl')::INT + contains(body, 'http')::INT AS n, 5 * (tool_name = 'bash')::INT + contains(body, 'sudo')::INT + contains(body, 'rm -rf')::INT + contains(body, 'chmod')::INT AS h FROM b)
SELECT event_id, CASE WHEN greatest(c, n, h) = 0 THEN 'general' WHEN c = greatest(c, n, h) THEN 'credential-review' WHEN n = greatest(c, n, h) THEN 'network-review' ELSE 'shell-review' END AS skill, greatest(c, n, h) AS score FROM s""",
    "normalized_events": f"""WITH {VIEW} SELECT event_id,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN etype = 'pre_action' THEN 'pre_action' WHEN content IS NOT NULL THEN 'post_response' ELSE 'post_action' END AS event_type,
  CASE WHEN event_id % 11 <> 0 AND source_framework = 'openclaw' THEN CASE etype WHEN 'pre_action' THEN 'oc-exec-approval-requested' ELSE 'oc-exec-approval-resolved' END END AS subtype,
  CASE WHEN event_id % 13 = 0 THEN 'unknown_session:' || source_framework ELSE session_id::VARCHAR END AS session_id, tool_name,
  CASE tool_name WHEN 'http_request' THEN 'external' WHEN 'bash' THEN CASE WHEN {found('command', [r'\bcurl\b|\bwget\b|https?://'])} THEN 'external' ELSE 'user' END ELSE CASE WHEN starts_with(path, '/tmp/') THEN 'external' ELSE 'user' END END AS origin,
  concat_ws(',', CASE WHEN tool_name = 'bash' THEN 'shell_execution' END, CASE WHEN {found('command', [r'rm\s+-rf|sudo|chmod\s+777|mkfs|dd\s+if='])} THEN 'destructive_pattern' END) AS hints FROM agent_events""",
    "activity_states": f"""WITH {VIEW}, l AS (SELECT session_id, max(micros) AS last_micros FROM agent_events GROUP BY ALL)
SELECT session_id, last_micros, CASE WHEN (SELECT max(last_micros) FROM l) - last_micros <= 120 * {_UNIT} THEN 'hot' WHEN (SELECT max(last_micros) FROM l) - last_micros <= 900 * {_UNIT} THEN 'warm' ELSE 'idle' END AS activity FROM l""",
    "busy_clients": f"""WITH {VIEW}, n AS (SELECT a.session_id, a.event_id, count(*) AS n FROM agent_events a JOIN agent_events b ON a.session_id = b.session_id AND b.micros BETWEEN a.micros - 30 * {_UNIT} AND a.micros GROUP BY ALL)
SELECT session_id, max(n) AS peak FROM n GROUP BY session_id HAVING peak > 20""",
    "session_recommendations": f"""{SCORED}, l AS (SELECT session_id, arg_max(risk_level, (micros, event_id)) AS lv FROM scored GROUP BY ALL)
SELECT session_id, CASE WHEN lv = 'critical' THEN 'escalate' WHEN lv IN ('high', 'medium') THEN 'inspect' ELSE 'none' END AS action,
  CASE WHEN session_id % 10 = 0 THEN 'review budget evidence' WHEN lv = 'critical' THEN 'escalate immediately' WHEN lv = 'high' THEN 'inspect replay' ELSE 'monitor session' END AS label FROM l""",
    "heartbeat_deltas": f"""{SCORED}, r AS (SELECT session_id, max(event_id) AS done FROM scored WHERE risk_rank = 3 AND event_id % 2 = 0 GROUP BY ALL)
SELECT session_id, min(event_id) AS from_event_id, count(*) AS records, bool_or(risk_rank >= 2) AS has_high FROM scored LEFT JOIN r USING (session_id) WHERE event_id > coalesce(done, -1) GROUP BY session_id""",
}

# the same over six accounts as long sessions
_ACCOUNT = VIEW.replace("user_id AS session_id", "user_id % 6 AS session_id")
for _name, _of in [("account_accumulation", "d4_accumulation"), ("account_risk", "session_risk"), ("account_changes", "risk_changes"), ("account_enforcement", "enforcement_state"), ("account_trajectories", "trajectories"), ("account_history", "suspicious_history")]:
    SQL[_name] = SQL[_of].replace(VIEW, _ACCOUNT)
SQL["account_limits"] = f"WITH RECURSIVE {_ACCOUNT}, {_limited(3, _UNIT // 10)}"
SQL["snapshot_records"] = f"""{SCORED}, s AS (SELECT trigger_event_id, session_id, CASE WHEN trigger_event_id % 5 = 4 THEN trigger_event_id + 1 ELSE from_event_id END AS low FROM (WITH {SQL['evidence_snapshots'].removeprefix(SCORED).lstrip(', ')}))
SELECT r.session_id, r.event_id, r.risk_level, s.trigger_event_id FROM scored r JOIN s ON s.session_id = r.session_id AND r.event_id BETWEEN s.low AND s.trigger_event_id"""
SQL["review_snapshots"] = f"""{SCORED}, {_ALERTS}, a AS (SELECT trigger_event_id, arg_min(sequence_id, (CASE risk_level WHEN 'critical' THEN 0 ELSE 1 END, sequence_id)) AS sequence_id FROM alerts GROUP BY 1),
n AS (SELECT s.*, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS seq, sequence_id FROM scored s LEFT JOIN a ON a.trigger_event_id = s.event_id),
g AS (SELECT t.session_id, t.event_id AS trigger_event_id, CASE WHEN t.sequence_id IS NOT NULL THEN 'trajectory_alert' ELSE 'threshold' END AS trigger_reason, t.sequence_id AS trigger_detail, min(r.event_id) AS from_record, t.event_id AS to_record, count(*) AS record_count,
  sha256(string_agg(r.event_id || '|' || r.verdict || '|' || r.risk_level || '|' || r.micros, chr(10) ORDER BY r.seq)) AS fingerprint, t.risk_level AS current_level, count_if(r.risk_rank >= 2) AS high_count,
  concat_ws(', ', CASE WHEN count_if(r.verdict = 'allow') > 0 THEN 'allow=' || count_if(r.verdict = 'allow') END, CASE WHEN count_if(r.verdict = 'block') > 0 THEN 'block=' || count_if(r.verdict = 'block') END) AS decisions,
  ['low', 'medium', 'high', 'critical'][max(r.risk_rank) + 1] AS highest
  FROM n t JOIN n r ON r.session_id = t.session_id AND r.seq BETWEEN t.seq - 49 AND t.seq WHERE t.risk_rank >= 2 OR t.sequence_id IS NOT NULL GROUP BY ALL)
SELECT 'l3snap-' || substr(sha256(concat_ws('|', session_id, trigger_event_id, trigger_reason, coalesce(trigger_detail, ''), from_record, to_record, fingerprint)), 1, 16) AS snapshot_id, *,
  CASE highest WHEN 'critical' THEN 'escalate' WHEN 'low' THEN 'none' ELSE 'inspect' END AS action, highest || ' risk across ' || record_count || ' record(s) from ' || from_record || ' to ' || to_record || '; decisions: ' || decisions AS summary FROM g"""
SQL["account_enforcement"] = SQL["account_enforcement"].replace(f"/ {_UNIT} AS gap", f"/ {_UNIT // 400} AS gap")

"""DuckDB SQL for the queries of the catalogue, written apart from their plans."""

from __future__ import annotations

from turnlake.functions.pricing import RATES
from turnlake.functions.text import NOT_TICKETS, STOPWORDS
from turnlake.plans.adapters import DUCKDB, templates

_RAW = templates(DUCKDB)


def _s(x: str) -> str:
    return f"CAST(sum({x}) AS BIGINT)"


def _c(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def _z(*columns: str) -> str:
    return ", ".join(f"CASE WHEN usage_dupe = 0 THEN {c} ELSE 0 END AS {c}" for c in columns)


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_INTENTS = {
    "bug/fix": r"(?i)\b(bug|fix|broken|error|fail|crash|doesn''?t work|not work|exception|wrong)\b",
    "correction": r"(?im)^(no[,. ]|nope|wrong|that''?s not|not what|i said|again|still |you (didn''?t|forgot|were))",
    "verify/test": r"(?i)\b(test|verify|check|confirm|make sure|validate|run (it|the))\b",
    "commit/git": r"(?i)\b(commit|push|branch|merge|rebase|pull request|\bpr\b|git)\b",
    "ticket": r"(?i)\b(jira|ticket|issue|story|epic)\b",
    "build/deploy": r"(?i)\b(build|deploy|release|docker|pipeline|ci\b|publish|install)\b",
    "explain/ask": r"(?i)\b(what|why|how|explain|describe|tell me|show me|\?)",
    "continue/go": r"(?i)^(continue|go|proceed|next|do it|yes|ok|okay|go ahead|carry on)\b",
    "design/ui": r"(?i)\b(design|ui|ux|layout|css|style|theme|font|colou?r|responsive|mobile)\b",
    "refactor/clean": r"(?i)\b(refactor|clean ?up|simplify|rename|reorganis|reorganiz|dedup|tidy)\b",
    "docs": r"(?i)\b(readme|docs?|documentation|comment|changelog|write ?up)\b",
    "plan": r"(?i)\b(plan|roadmap|architecture|approach|options|strategy|think (about|through))\b",
    "review": r"(?i)\b(review|audit|critique|look over|check the code|code review)\b",
    "report": r"(?i)\b(report|summary|summari[sz]e|overview|dashboard|chart)\b",
}
#: Letters beyond ASCII as one that this engine's patterns count as part of a word.
_PLAIN = "regexp_replace({}, '[^\\x00-\\x7F]', 'q', 'g')"
_KEYS = "list_distinct(list_filter(regexp_extract_all({}, '\\b[A-Z][A-Z0-9]{{1,9}}-\\d{{1,6}}\\b'), lambda x: split_part(x, '-', 1) NOT IN (" + _quoted(NOT_TICKETS) + ") AND length(regexp_replace(split_part(x, '-', 1), '[0-9]', '', 'g')) >= 2))"
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

#: Content tokens of a text, in order.
_WORDS = r"""list_filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '(?s)```.*?```', ' ', 'g'), 'https?://\S+', ' URL ', 'g'),
    '\b[A-Za-z]+-\d+\b', ' TICKET ', 'g'), '(?i)([a-z]:)?[\\/][\pL\pN_\-.\\/]+', ' PATH ', 'g'), '\b\d+\b', ' N ', 'g'), '[a-z0-9_\-/\.]+'), lambda x: length(x) > 2 AND x NOT IN (""" + _quoted(STOPWORDS) + """))"""

_VIEWS = {name: sql for name, sql in _RAW.items()} | {
    "lines": "SELECT *, CASE WHEN coalesce(message_id, request_id) IS NOT NULL AND row_number() OVER (PARTITION BY coalesce(message_id, request_id) ORDER BY uuid) > 1 THEN 1 ELSE 0 END AS usage_dupe FROM raw_message",
    "zeroed": f"SELECT * REPLACE ({_z('input_tokens', 'output_tokens', 'cache_write', 'cache_read', 'eph_5m', 'eph_1h', 'web_search_reqs', 'web_fetch_reqs')}) FROM lines",
    "price": "SELECT model, CAST(price_in AS DOUBLE) AS price_in, CAST(price_out AS DOUBLE) AS price_out, price_confidence FROM (VALUES " + ", ".join(str(r) for r in RATES) + ") AS v(model, price_in, price_out, price_confidence)",
    "split": "SELECT *, CASE WHEN eph_5m = 0 AND eph_1h = 0 THEN cache_write ELSE eph_5m END AS w5 FROM zeroed",
    "message": """SELECT split.*, (input_tokens + w5 * 1.25 + eph_1h * 2.0 + cache_read * 0.1) * coalesce(price_in, 3.0) / 1e6 + output_tokens * coalesce(price_out, 15.0) / 1e6 AS cost_usd,
  CASE WHEN reply = '' OR length(reply) > 400 THEN NULL WHEN regexp_matches(reply, '(?i)usage limit reached|Claude usage limit|weekly limit|5-hour limit|limit will reset') THEN 'usage_limit'
       WHEN regexp_matches(reply, 'rate limit(ed|s)? (exceeded|reached|hit)|\\b429\\b|overloaded_error|\\bOverloaded\\b') THEN 'rate_limit' WHEN regexp_matches(reply, '(?i)credit balance|insufficient credit|billing (issue|error|problem)') THEN 'billing'
       WHEN regexp_matches(reply, '(?i)falling back to|fallback model|switched to [a-z0-9_.-]+ model') THEN 'fallback' WHEN regexp_matches(reply, '(?i)^API Error|prompt is too long|max_tokens') THEN 'api_error' END AS error_kind
FROM split LEFT JOIN price USING (model)""",
    "tool": r"""SELECT *, CASE WHEN contains(string_split(file_path, '/')[-1], '.') THEN '.' || lower(string_split(file_path, '.')[-1]) END AS file_ext,
  nullif(regexp_extract(bash_command, '^(?:[A-Z]+=\S+ )*(?:\S*/)?(\S+)', 1), '') AS bash_program FROM raw_tool""",
    "named": f"""SELECT *, regexp_matches(raw_text, '<command-name>([^<]*)</command-name>') AND NOT contains(raw_text, '<local-command-stdout>') AS has_name,
  {_TRIM.format("regexp_extract(raw_text, '<command-name>([^<]*)</command-name>', 1)")} AS cmd, {_TRIM.format("regexp_extract(raw_text, '(?s)<command-args>(.*?)</command-args>', 1)")} AS args FROM raw_prompt""",
    "cleaned": f"""SELECT *, {_TRIM.format("regexp_replace(CASE WHEN has_name THEN cmd || CASE WHEN args <> '' THEN ' ' || args ELSE '' END WHEN contains(raw_text, '<local-command-stdout>') THEN '' ELSE raw_text END, '(?s)<system-reminder>.*?</system-reminder>', '', 'g')")} AS clean,
  CASE WHEN has_name AND cmd <> '' THEN cmd END AS slash_name FROM named""",
    "judged": """SELECT *, CASE WHEN clean <> '' AND transcript = 'main' AND (CASE WHEN is_meta = 1 THEN false WHEN origin_kind = 'human' THEN true WHEN coalesce(source, '') <> '' THEN source IN ('typed', 'queued', 'suggestion_accepted')
    ELSE NOT (starts_with(clean, 'Caveat:') OR starts_with(clean, '<command-') OR starts_with(clean, '# /')) END) THEN 1 ELSE 0 END AS is_human,
  CASE WHEN clean <> '' THEN clean ELSE raw_text END AS stored FROM cleaned""",
    "prompt": f"""SELECT uuid, session_id, project, ts, date, hour, dow, origin_kind, transcript, is_human, coalesce(source, CASE WHEN clean = '' THEN 'harness' WHEN transcript <> 'main' THEN 'subagent' END) AS source,
  CASE WHEN clean <> '' THEN clean[1:6000] END AS text, slash_name, CASE WHEN slash_name IS NOT NULL THEN 1 ELSE 0 END AS is_slash, length(stored) AS chars,
  CASE WHEN {_TRIM.format("stored")} = '' THEN 0 ELSE len(string_split_regex({_TRIM.format("stored")}, '\\s+')) END AS words, stored[1:300] AS preview,
  CASE WHEN is_human = 1 THEN list_filter([{", ".join(f"CASE WHEN regexp_matches({_PLAIN.format('clean')}, '{p}') THEN '{k}' END" for k, p in _INTENTS.items())}], lambda x: x IS NOT NULL) ELSE [] END AS intents,
  CASE WHEN is_human = 1 THEN {_KEYS.format(_PLAIN.format("clean"))} ELSE [] END AS tickets FROM judged""",
    "found": r"""SELECT 'commit' AS kind, regexp_extract(stdout, '(?m)^\[(\S+)\s+([0-9a-f]{7,40})\]\s*(.*)$', 2) AS key, '' AS remote, session_id, project, ts, date, id, regexp_extract(stdout, '^\[(\S+)\s', 1) AS branch,
    regexp_extract(stdout, '(?m)^\[\S+\s+[0-9a-f]{7,40}\]\s*(.*)$', 1) AS subject, CAST(regexp_extract(stdout, '(\d+) files? changed', 1) AS INT) AS files, CAST(regexp_extract(stdout, '(\d+) insertion', 1) AS INT) AS insertions,
    CAST(regexp_extract(stdout, '(\d+) deletion', 1) AS INT) AS deletions FROM shell WHERE regexp_matches(stdout, '^\[\S+\s+[0-9a-f]{7,40}\]')
  UNION ALL SELECT 'push', session_id || ':' || ts || ':' || regexp_extract(stdout, '^To\s+(\S+)', 1), regexp_extract(stdout, '^To\s+(\S+)', 1), session_id, project, ts, date, id, NULL, NULL, NULL, NULL, NULL FROM shell WHERE regexp_matches(stdout, '^To\s+\S+')
  UNION ALL SELECT 'pr', regexp_extract(stdout, 'https?://\S+/pull/\d+'), '', session_id, project, ts, date, id, NULL, regexp_extract(stdout, 'https?://\S+/pull/\d+'), NULL, NULL, NULL FROM shell WHERE regexp_matches(stdout, 'https?://\S+/pull/\d+')""",
    "git": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY ts, id) AS nth FROM found) WHERE nth = 1",
    "signs": f"""SELECT session_id, project, strftime(first_ts, '%Y-%m-%d') AS date, 'title' AS evidence, unnest({_KEYS.format("concat_ws(' ', ai_title, custom_title)")}) AS key FROM session
  UNION ALL SELECT session_id, project, strftime(first_ts, '%Y-%m-%d'), 'branch', unnest({_KEYS.format("git_branch")}) FROM session UNION ALL SELECT session_id, project, date, 'prompt', unnest(tickets) FROM prompt
  UNION ALL SELECT session_id, project, date, 'file', unnest({_KEYS.format("file_path")}) FROM tool UNION ALL SELECT session_id, project, date, 'commit', unnest({_KEYS.format("subject")}) FROM git WHERE kind = 'commit'
  UNION ALL SELECT session_id, project, date, 'lookup', unnest({_KEYS.format("input")}) FROM tool WHERE is_mcp = 1 AND name ILIKE '%atlassian%'""",
    "ticket": "SELECT key, session_id, evidence, arg_min(project, (coalesce(date, '9999'), project)) AS project, min(date) AS date, CASE evidence WHEN 'branch' THEN 1 ELSE count(*) END AS n FROM signs GROUP BY key, session_id, evidence",
    "chat_message": "SELECT m.* EXCLUDE (date), coalesce(m.date, s.date) AS date, CASE WHEN m.date IS NOT NULL THEN 'exact' WHEN s.date IS NOT NULL THEN 'session' END AS ts_source FROM raw_chat_message m LEFT JOIN chat_session s USING (composer_id)",
    "chat_counted": "SELECT s.*, coalesce(n, 0) AS message_count FROM chat_session s LEFT JOIN (SELECT composer_id, count(*) AS n FROM chat_message GROUP BY 1) USING (composer_id)",
    "fact": f"""SELECT m.*, coalesce(custom_title, ai_title, agent_name, m.session_id) AS title, entrypoint, cwd, coalesce(tool_calls, 0) AS tool_calls, coalesce(readonly_calls, 0) AS readonly_calls, coalesce(agent_calls, 0) AS agent_calls,
  coalesce(tool_errors, 0) AS tool_errors, coalesce(prompts, 0) AS prompts, coalesce(prompt_records, 0) AS prompt_records, coalesce(corrections, 0) AS corrections, coalesce(slash, 0) AS slash, coalesce(turn_ms, 0) AS turn_ms, coalesce(turns, 0) AS turns,
  coalesce(interrupts, 0) AS interrupts, coalesce(compactions, 0) AS compactions, (epoch_us(ended) - epoch_us(started)) // 1000 AS wall_ms, CASE WHEN coalesce(entrypoint, '') IN ('cli', '') THEN 0 ELSE 1 END AS headless,
  CASE WHEN coalesce(tool_calls, 0) > 0 THEN round(readonly_calls / tool_calls, 2) ELSE 0.0 END AS readonly_share, CASE WHEN coalesce(tool_calls, 0) > 0 THEN CAST(round(CAST(cost_usd / tool_calls AS DECIMAL(28, 10)), 4) AS DOUBLE) END AS cost_per_tool,
  CASE WHEN (epoch_us(ended) - epoch_us(started)) // 1000 > 0 AND turn_ms > 0 THEN round(turn_ms / ((epoch_us(ended) - epoch_us(started)) // 1000), 2) END AS parallelism, coalesce(round(cache_read / nullif(cache_read + billed_in, 0) * 100, 1), 0.0) AS cache_hit
FROM (SELECT session_id, arg_max(project, (ts, uuid)) AS project, min(ts) AS started, max(ts) AS ended, {_c("usage_dupe = 0")} AS api_calls, {_s("input_tokens + output_tokens + cache_write + cache_read")} AS total_tokens, {_s("cache_read")} AS cache_read,
    {_s("input_tokens + cache_write")} AS billed_in, CAST(round(CAST(sum(cost_usd) AS DECIMAL(28, 10)), 4) AS DOUBLE) AS cost_usd, {_s("tool_uses")} AS tool_uses, sum(CASE WHEN transcript <> 'main' OR is_sidechain = 1 THEN cost_usd ELSE 0 END) AS nested_cost,
    {_s("CASE WHEN transcript <> 'main' OR is_sidechain = 1 THEN tool_uses ELSE 0 END")} AS nested_tools, max(CASE WHEN model LIKE 'claude-opus%' THEN 1 ELSE 0 END) AS uses_opus,
    count(DISTINCT CASE WHEN model <> '<synthetic>' THEN model END) AS distinct_models, count(error_kind) AS error_replies FROM message GROUP BY session_id) m
LEFT JOIN session s ON s.session_id = m.session_id
LEFT JOIN (SELECT session_id, count(*) AS tool_calls, {_c("name IN ('Read', 'Grep', 'Glob', 'ToolSearch', 'WebFetch', 'WebSearch', 'LS')")} AS readonly_calls, {_c("name = 'Agent'")} AS agent_calls, {_s("is_error")} AS tool_errors FROM tool GROUP BY 1) t ON t.session_id = m.session_id
LEFT JOIN (SELECT session_id, {_c("is_human = 1")} AS prompts, count(*) AS prompt_records, {_c("is_human = 1 AND list_contains(intents, 'correction')")} AS corrections, {_c("is_slash = 1")} AS slash FROM prompt GROUP BY 1) p ON p.session_id = m.session_id
LEFT JOIN (SELECT session_id, {_s("duration_ms")} AS turn_ms, count(*) AS turns FROM turn GROUP BY 1) u ON u.session_id = m.session_id
LEFT JOIN (SELECT session_id, {_c("kind = 'interrupt'")} AS interrupts, {_c("kind = 'compact'")} AS compactions FROM event GROUP BY 1) e ON e.session_id = m.session_id""",
    "doc": "SELECT doc_id AS uuid, source AS session_id, text FROM documents",
    "doc_words": f"SELECT uuid, session_id, {_WORDS} AS w FROM doc",
    "prompt_words": f"SELECT session_id, {_WORDS} AS w FROM prompt WHERE is_human = 1 AND chars >= 12",
    "doc_set": "SELECT uuid, session_id, list_distinct(w[1:120]) AS tokens FROM doc_words",
}

_BILLED = _c("usage_dupe = 0")
_TOKENS = _s("input_tokens + output_tokens + cache_write + cache_read")
_COST = "CAST(round(CAST(sum(cost_usd) AS DECIMAL(28, 10)), 4) AS DOUBLE)"
_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_SLIM = f"session_id, project, title, {_STAMP.format('started')} AS started"
_CATEGORY = "CASE file_ext WHEN '.py' THEN 'code' WHEN '.md' THEN 'docs' WHEN '.json' THEN 'config' WHEN '.css' THEN 'markup' ELSE 'other' END"
_CATEGORIES = f"SELECT {_CATEGORY} AS category, {_s('lines_added')} AS added, {_s('lines_removed')} AS removed, count(*) AS touches FROM tool WHERE name IN ('Edit', 'Write', 'NotebookEdit', 'MultiEdit') GROUP BY 1"
_SOURCE = f"SELECT {_s('added')} AS source_added, {_s('removed')} AS source_removed FROM ({_CATEGORIES}) WHERE category IN ('code', 'markup')"
_OVERVIEW = f"""SELECT count(*) AS assistant_blocks, {_BILLED} AS assistant_messages, count(DISTINCT session_id) AS sessions, count(DISTINCT project) AS projects, count(DISTINCT date) AS active_days,
  round(sum(cost_usd), 6) AS cost_usd, min(date) AS first_day, max(date) AS last_day, {", ".join(f"{_s(c)} AS {c}" for c in ("input_tokens", "output_tokens", "cache_write", "cache_read", "thinking_blocks", "thinking_chars", "text_chars", "tool_uses"))},
  {_s("is_api_error")} AS api_errors, {_s("web_search_reqs")} AS web_searches, {_s("web_fetch_reqs")} AS web_fetches FROM message"""
_RERUNS = "SELECT project, date, text[1:80] AS head, count(*) AS n FROM prompt WHERE is_human = 0 AND source = 'sdk' GROUP BY 1, 2, 3 HAVING count(*) > 1 ORDER BY n DESC, project, date, head LIMIT 15"
_FIRST_SEEN = "(SELECT min(date) FROM message)"
_LEDGER = f"""SELECT *, count(*) OVER (PARTITION BY prefix) >= 2 OR max(CASE WHEN n_commit > 0 OR n_branch > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY prefix) = 1 AS kept FROM (
  SELECT key, split_part(key, '-', 1) AS prefix, count(DISTINCT session_id) AS sessions, array_to_string(list_sort(list_distinct(list(project))), ',') AS projects, min(date) AS first_day, max(date) AS last_day,
    {", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE evidence = '{k}'), 0) AS BIGINT) AS n_{k}" for k in ("commit", "branch", "title", "prompt", "file", "lookup"))} FROM ticket GROUP BY key)"""
_FAMILY = r"regexp_replace(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')), '\b\d+\b', 'N', 'g')[1:160]"
_GAPS = f"""SELECT *, lag(head) OVER w AS was, date_diff('second', lag(ts) OVER w, ts) AS gap_s FROM (SELECT *, trim(coalesce(text, '')[1:400]) AS head FROM prompt WHERE is_human = 1) WINDOW w AS (PARTITION BY session_id ORDER BY ts, uuid)"""
_AGAIN = "is_slash = 0 AND length(was) >= 12 AND length(head) > length(was) AND starts_with(head, was) AND gap_s <= 600"


def _share(cond: str) -> str:
    return f"coalesce(round({_c(cond)} / nullif(count(*), 0) * 100, 1), 0)"


def _priced(at_in: float, at_out: float, k: int) -> str:
    return f"round((i{k} + w5{k} * 1.25 + w1{k} * 2.0 + r{k} * 0.1) * {at_in} / 1e6 + o{k} * {at_out} / 1e6, 2)"


_SCOPES = {"all": "true", "nested (sub-agents)": "(transcript <> 'main' OR is_sidechain = 1)", "opus": "model LIKE 'claude-opus%'", "headless": "coalesce(entrypoint, 'cli') <> 'cli'"}
_SUMS = ", ".join(f"sum(CASE WHEN {cond} THEN {c} ELSE 0 END) AS {n}{k}" for k, cond in enumerate(_SCOPES.values()) for n, c in (("i", "input_tokens"), ("o", "output_tokens"), ("w5", "w5"), ("w1", "eph_1h"), ("r", "cache_read"), ("a", "cost_usd")))
_ROUTING = " UNION ALL ".join(f"SELECT '{name}' AS scope, round(a{k}, 2) AS actual, {_priced(1.0, 5.0, k)} AS at_haiku, {_priced(3.0, 15.0, k)} AS at_sonnet, {_priced(15.0, 75.0, k)} AS at_opus FROM sums WHERE a{k} <> 0" for k, name in enumerate(_SCOPES))

_PAIRS = "SELECT a, b, shared FROM (SELECT x.uuid AS a, y.uuid AS b, count(*) AS shared, any_value(len(sx)) AS nx, any_value(len(sy)) AS ny FROM (SELECT uuid, tokens AS sx, unnest(tokens) AS t FROM doc_set WHERE len(tokens) >= 6) x JOIN (SELECT uuid, tokens AS sy, unnest(tokens) AS t FROM doc_set WHERE len(tokens) >= 6) y ON x.t = y.t AND x.uuid < y.uuid GROUP BY 1, 2) WHERE 20 * shared >= 9 * (nx + ny - shared)"
_PHRASES = "SELECT phrase, count(DISTINCT session_id) AS sessions, count(*) AS n FROM (SELECT session_id, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT session_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM {}, (VALUES (2), (3), (4)) AS v(k))) GROUP BY 1 HAVING count(DISTINCT session_id) >= 4"
_BODIES: dict[str, str] = {
    "usage_dedupe": "SELECT uuid, usage_dupe, input_tokens, output_tokens, cache_write, cache_read, web_search_reqs, round(cost_usd, 8) AS cost_usd FROM message",
    "row_cost": "SELECT model, count(*) AS lines, round(sum(cost_usd), 6) AS cost_usd FROM message GROUP BY 1",
    "overview_messages": _OVERVIEW,
    "overview_tools": f"SELECT count(*) AS tool_calls, {_s('is_error')} AS tool_errors, {_s('interrupted')} AS interrupted, {_s('lines_added')} AS lines_added, {_s('lines_removed')} AS lines_removed, count(DISTINCT file_path) AS files_touched, count(denial_kind) AS denials, {_s('is_mcp')} AS mcp_calls, count(*) FILTER (WHERE name = 'WebSearch') AS web_search_calls, count(*) FILTER (WHERE name = 'WebFetch') AS web_fetch_calls FROM tool",
    "overview_prompts": f"SELECT count(*) AS prompt_records, {_c('is_human = 1')} AS prompts, CAST(coalesce(sum(chars) FILTER (WHERE is_human = 1), 0) AS BIGINT) AS prompt_chars, round(coalesce(avg(chars) FILTER (WHERE is_human = 1), 0), 6) AS avg_prompt_chars, CAST(coalesce(sum(words) FILTER (WHERE is_human = 1), 0) AS BIGINT) AS prompt_words FROM prompt",
    "overview_turns": f"SELECT count(*) AS turns, {_s('duration_ms')} AS total_turn_ms, round(avg(duration_ms), 4) AS avg_turn_ms, max(duration_ms) AS max_turn_ms FROM turn",
    "overview_derived": f"SELECT total_tokens, sidechain_messages, round(reads / (reads + paid) * 100, 1) AS cache_hit_pct, round(errors / calls * 100, 1) AS tool_error_rate, round(cost / days, 2) AS avg_cost_per_active_day, CAST(floor(total_tokens / days) AS BIGINT) AS avg_tokens_per_active_day FROM (SELECT {_TOKENS} AS total_tokens, {_s('cache_read')} AS reads, {_s('input_tokens + cache_write')} AS paid, sum(cost_usd) AS cost, count(DISTINCT date) AS days, {_c('is_sidechain = 1')} AS sidechain_messages FROM message), (SELECT count(*) AS calls, {_s('is_error')} AS errors FROM tool)",
    "filtered_overview": _OVERVIEW + " WHERE date >= '2024-01-05' AND date <= '2024-01-20' AND project = 'p3'",
    "daily": f"SELECT m.*, coalesce(p.prompts, 0) AS prompts, coalesce(p.injected_prompts, 0) AS injected_prompts FROM (SELECT date, {_BILLED} AS api_calls, count(DISTINCT session_id) AS sessions, {_s('input_tokens')} AS input_tokens, {_s('output_tokens')} AS output_tokens, {_s('cache_write')} AS cache_write, {_s('cache_read')} AS cache_read, {_TOKENS} AS total_tokens, {_COST} AS cost_usd, {_s('tool_uses')} AS tool_uses, {_s('thinking_blocks')} AS thinking_blocks FROM message WHERE date IS NOT NULL GROUP BY 1) m LEFT JOIN (SELECT date, {_c('is_human = 1')} AS prompts, {_c('is_human = 0')} AS injected_prompts FROM prompt GROUP BY 1) p USING (date)",
    "calendar": f"SELECT CAST(d AS VARCHAR) AS date, coalesce(n, 0) AS api_calls FROM (SELECT CAST(unnest(generate_series((SELECT min(CAST(date AS DATE)) FROM message), (SELECT max(CAST(date AS DATE)) FROM message), INTERVAL 1 DAY)) AS DATE) AS d) LEFT JOIN (SELECT date, {_BILLED} AS n FROM message GROUP BY 1) ON CAST(d AS VARCHAR) = date",
    "hourly": f"SELECT hour, {_BILLED} AS api_calls, {_TOKENS} AS tokens, {_COST} AS cost_usd FROM message GROUP BY 1",
    "punchcard": f"SELECT dow, hour, {_BILLED} AS api_calls, {_TOKENS} AS tokens FROM message GROUP BY 1, 2",
    "models": f"SELECT g.*, coalesce(price_in, 3.0) AS price_in, coalesce(price_out, 15.0) AS price_out, coalesce(price_confidence, 'fallback') AS price_confidence FROM (SELECT model, {_BILLED} AS messages, count(DISTINCT session_id) AS sessions, {_s('input_tokens')} AS input_tokens, {_s('output_tokens')} AS output_tokens, {_s('cache_write')} AS cache_write, {_s('cache_read')} AS cache_read, {_TOKENS} AS total_tokens, {_COST} AS cost_usd, {_s('thinking_blocks')} AS thinking_blocks, round(sum(output_tokens) / nullif({_BILLED}, 0), 1) AS avg_output_tokens FROM message GROUP BY 1) g LEFT JOIN price USING (model)",
    "projects": f"SELECT g.*, coalesce(lines_added, 0) AS lines_added, coalesce(lines_removed, 0) AS lines_removed, coalesce(files_touched, 0) AS files_touched, coalesce(tool_calls, 0) AS tool_calls, coalesce(turn_ms, 0) AS turn_ms FROM (SELECT project, {_BILLED} AS messages, count(DISTINCT session_id) AS sessions, count(DISTINCT date) AS active_days, {_TOKENS} AS total_tokens, {_s('output_tokens')} AS output_tokens, {_COST} AS cost_usd, {_s('tool_uses')} AS tool_uses, min(date) AS first_day, max(date) AS last_day FROM message GROUP BY 1) g LEFT JOIN (SELECT project, {_s('lines_added')} AS lines_added, {_s('lines_removed')} AS lines_removed, count(DISTINCT file_path) AS files_touched, count(*) AS tool_calls FROM tool GROUP BY 1) t USING (project) LEFT JOIN (SELECT project, {_s('duration_ms')} AS turn_ms FROM turn GROUP BY 1) u USING (project)",
    "project_list": "SELECT DISTINCT project FROM message",
    "project_relabel": "SELECT coalesce(string_split(cwd, '/')[-1], 'old') AS project, count(*) AS calls FROM tool LEFT JOIN session USING (session_id) GROUP BY 1",
    "tools": f"SELECT name, count(*) AS calls, {_s('is_error')} AS errors, {_s('interrupted')} AS interrupted, count(denial_kind) AS denied, {_s('has_result')} AS completed, round(avg(latency_ms), 0) AS avg_latency_ms, max(latency_ms) AS max_latency_ms, round(avg(result_chars), 0) AS avg_result_chars, {_s('result_chars')} AS total_result_chars, {_s('lines_added')} AS lines_added, {_s('lines_removed')} AS lines_removed, max(is_mcp) AS is_mcp, max(mcp_server) AS mcp_server, round(median(latency_ms), 0) AS median_latency_ms FROM tool GROUP BY 1",
    "tool_median_latency": "SELECT name, round(avg(latency_ms), 0) AS median_latency_ms FROM (SELECT name, latency_ms, row_number() OVER (PARTITION BY name ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY name) AS cnt FROM tool WHERE latency_ms IS NOT NULL) WHERE rn IN ((cnt + 1) // 2, (cnt + 2) // 2) GROUP BY 1",
    "tool_daily": "SELECT date, name, count(*) AS calls FROM tool WHERE name IN (SELECT name FROM tool GROUP BY 1 ORDER BY count(*) DESC, name LIMIT 8) GROUP BY 1, 2",
    "failing_tools": f"SELECT name, count(*) AS calls, {_s('is_error')} AS errors, round(sum(is_error) / count(*) * 100, 1) AS error_pct FROM tool GROUP BY 1 HAVING count(*) >= 20 AND sum(is_error) / count(*) > 0.05",
    "denials_by_kind": "SELECT denial_kind, count(*) AS n FROM tool WHERE denial_kind IS NOT NULL GROUP BY 1",
    "denials_by_tool": "SELECT name, denial_kind, count(*) AS n FROM tool WHERE denial_kind IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, name, denial_kind LIMIT 25",
    "top_files": f"SELECT file_path, max(file_ext) AS file_ext, count(*) AS touches, {_s('lines_added')} AS lines_added, {_s('lines_removed')} AS lines_removed, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE name IN ('Edit', 'Write', 'NotebookEdit')) AS writes, count(*) FILTER (WHERE name = 'Read') AS reads FROM tool WHERE file_path IS NOT NULL GROUP BY 1 ORDER BY touches DESC, file_path LIMIT 40",
    "files_by_ext": f"SELECT file_ext, count(*) AS touches, count(DISTINCT file_path) AS files, {_s('lines_added')} AS lines_added, {_s('lines_removed')} AS lines_removed FROM tool WHERE file_ext IS NOT NULL GROUP BY 1 ORDER BY touches DESC, file_ext LIMIT 25",
    "bash_programs": f"SELECT bash_program AS program, count(*) AS calls, {_s('is_error')} AS errors, {_s('interrupted')} AS interrupted, round(avg(latency_ms), 0) AS avg_latency_ms FROM tool WHERE bash_program IS NOT NULL GROUP BY 1 ORDER BY calls DESC, program LIMIT 30",
    "sessions": f"SELECT g.*, coalesce(custom_title, ai_title, agent_name, g.session_id) AS title, git_branch, version, cwd FROM (SELECT session_id, arg_max(project, (ts, uuid)) AS project, {_STAMP.format('min(ts)')} AS started, {_STAMP.format('max(ts)')} AS ended, {_BILLED} AS messages, {_TOKENS} AS total_tokens, {_COST} AS cost_usd, {_s('tool_uses')} AS tool_uses, {_s('is_sidechain')} AS sidechain_messages FROM message GROUP BY 1 ORDER BY total_tokens DESC, session_id LIMIT 60) g LEFT JOIN session s ON s.session_id = g.session_id",
    "session_shape": f"SELECT session_id, {_BILLED} AS messages, {_TOKENS} AS total_tokens, {_COST} AS cost_usd FROM message GROUP BY 1",
    "session_histogram": f"SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 4 THEN '2-4' WHEN n <= 9 THEN '5-9' WHEN n <= 24 THEN '10-24' WHEN n <= 49 THEN '25-49' WHEN n <= 99 THEN '50-99' WHEN n <= 249 THEN '100-249' WHEN n <= 499 THEN '250-499' ELSE '500+' END AS bucket, count(*) AS sessions FROM (SELECT {_BILLED} AS n FROM message GROUP BY session_id) WHERE n > 0 GROUP BY 1",
    "prompts_by_source": "SELECT coalesce(source, '(unlabelled)') AS source, CASE WHEN is_human = 1 THEN 'you' ELSE 'automated' END AS who, count(*) AS n, round(avg(chars), 0) AS avg_chars FROM prompt GROUP BY 1, 2",
    "prompts_by_origin": "SELECT coalesce(origin_kind, '(none)') AS origin, count(*) AS n FROM prompt GROUP BY 1",
    "prompts_daily": "SELECT date, count(*) AS prompts, round(avg(chars), 0) AS avg_chars FROM prompt WHERE is_human = 1 GROUP BY 1",
    "prompts_longest": "SELECT uuid, date, project, chars, words, preview FROM prompt WHERE is_human = 1 ORDER BY chars DESC, uuid LIMIT 10",
    "versions": "SELECT version, count(*) AS messages, min(date) AS first_day, max(date) AS last_day FROM message WHERE version IS NOT NULL GROUP BY 1 ORDER BY first_day DESC, version LIMIT 30",
    "branches": "SELECT git_branch, count(*) AS messages, count(DISTINCT session_id) AS sessions FROM message WHERE git_branch IS NOT NULL GROUP BY 1 ORDER BY messages DESC, git_branch LIMIT 20",
    "skills_used": f"SELECT skill, count(*) AS messages, {_TOKENS} AS tokens, {_COST} AS cost_usd FROM message WHERE skill IS NOT NULL GROUP BY 1",
    "mcp_servers": f"SELECT mcp_server, count(*) AS calls, count(DISTINCT name) AS distinct_tools, {_s('is_error')} AS errors FROM tool WHERE is_mcp = 1 GROUP BY 1",
    "subagents": f"SELECT coalesce(agent_type, '(default)') AS agent_type, resolved_model, count(*) AS runs, {_s('total_tokens')} AS total_tokens, round(avg(total_duration_ms), 0) AS avg_duration_ms, {_s('tool_use_count')} AS tool_uses FROM subagent GROUP BY 1, 2",
    "effort": f"SELECT coalesce(effort, '(unset)') AS effort, count(*) AS messages, {_s('thinking_blocks')} AS thinking_blocks FROM message GROUP BY 1",
    "stop_reasons": "SELECT coalesce(stop_reason, '(none)') AS stop_reason, count(*) AS n FROM message GROUP BY 1",
    "events": "SELECT kind, coalesce(subkind, '') AS subkind, count(*) AS n FROM event GROUP BY 1, 2 ORDER BY n DESC, kind, subkind LIMIT 40",
    "turns_daily": "SELECT date, count(*) AS turns, round(avg(duration_ms) / 1000.0, 1) AS avg_turn_s, round(sum(duration_ms) / 60000.0, 1) AS total_turn_min FROM turn GROUP BY 1",
    "legacy_daily": "SELECT date, messages, sessions, tool_calls, tokens FROM legacy_day",
    "legacy_models": "SELECT *, input_tokens + output_tokens + cache_read + cache_write AS total_tokens FROM legacy_model",
    "legacy_only": f"SELECT count(*) AS days_only_in_cache, CAST(coalesce(sum(messages), 0) AS BIGINT) AS messages_only_in_cache, {_FIRST_SEEN} AS live_first_day FROM legacy_day WHERE date < {_FIRST_SEEN}",
    "streaks": "SELECT CAST(max(n) AS BIGINT) AS longest, arg_max(n, ends) AS current, CAST(sum(n) AS BIGINT) AS days, CAST(min(begins) AS VARCHAR) AS first_day, CAST(max(ends) AS VARCHAR) AS last_day FROM (SELECT count(*) AS n, max(d) AS ends, min(d) AS begins FROM (SELECT d, d - CAST(row_number() OVER (ORDER BY d) AS INT) AS g FROM (SELECT DISTINCT CAST(date AS DATE) AS d FROM message)) GROUP BY g)",
    "pricing_warnings": "SELECT DISTINCT model, coalesce(price_confidence, 'fallback') AS confidence FROM message LEFT JOIN price USING (model) WHERE coalesce(price_confidence, 'fallback') <> 'official'",
    "ingest_runs": "SELECT source, files_seen, files_read, rows_added, note FROM run ORDER BY id DESC LIMIT 6",
    "session_facts": f"SELECT * REPLACE ({_STAMP.format('started')} AS started, {_STAMP.format('ended')} AS ended, round(nested_cost, 6) AS nested_cost) FROM fact",
    "slash_usage": "SELECT slash_name AS name, count(*) AS n, count(DISTINCT session_id) AS sessions, count(DISTINCT project) AS projects, min(date) AS first_day, max(date) AS last_day FROM prompt WHERE is_slash = 1 GROUP BY 1 ORDER BY n DESC, name LIMIT 40",
    "prompts_per_session": "SELECT median(prompts) AS median, max(prompts) FILTER (WHERE k = r) AS p90 FROM (SELECT prompts, row_number() OVER (ORDER BY prompts) - 1 AS k, round_even((count(*) OVER () - 1) * 0.9, 0) AS r FROM fact WHERE headless = 0 AND prompts > 0)",
    "actions_per_prompt": "SELECT round(sum(api_calls) / sum(prompts), 1) AS actions_per_prompt, round(sum(tool_calls) / sum(prompts), 1) AS tools_per_prompt FROM fact",
    "openers": "SELECT CASE WHEN is_slash = 1 THEN 'slash ' || slash_name WHEN regexp_matches(t, '(?i)^(yes|ok|okay|continue|go|proceed|do it|now |also |and |next|then |it |still|no[,. ])') THEN 'continuation' WHEN length(t) < 40 THEN 'short (<40 chars)' WHEN length(t) < 400 THEN 'medium' ELSE 'long (400+ chars)' END AS kind, count(*) AS n FROM (SELECT *, coalesce(text, '')[1:400] AS t, row_number() OVER (PARTITION BY session_id ORDER BY ts, uuid) AS k FROM prompt WHERE is_human = 1) WHERE k = 1 GROUP BY 1",
    "prompt_shape": f"SELECT count(*) AS prompts, {_c('is_slash = 0 AND chars < 25')} AS short_prompts, {_share('is_slash = 0 AND chars < 25')} AS short_prompt_pct, {_share('hour <= 5')} AS night_pct, {_share('dow IN (5, 6)')} AS weekend_pct FROM prompt WHERE is_human = 1",
    "intent_counts": "SELECT intent, count(*) AS n, round(count(*) / (SELECT count(*) FROM prompt WHERE is_human = 1) * 100, 1) AS pct FROM (SELECT unnest(intents) AS intent FROM prompt WHERE is_human = 1) GROUP BY 1",
    "premature_sends": f"SELECT {_c(_AGAIN)} AS premature_sends, coalesce(round(median(gap_s) FILTER (WHERE {_AGAIN}), 0), 0) AS premature_median_gap_s FROM ({_GAPS})",
    "by_entrypoint": f"SELECT CASE WHEN headless = 1 THEN 'headless (sdk)' ELSE 'interactive (cli)' END AS entrypoint, count(*) AS sessions, round(sum(cost_usd), 2) AS cost_usd, {_s('prompts')} AS prompts, {_s('api_calls')} AS api_calls, {_s('tool_calls')} AS tool_calls FROM fact GROUP BY 1",
    "headless_reruns": _RERUNS,
    "redundant_reruns": f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS redundant_reruns FROM ({_RERUNS})",
    "delegation": f"SELECT {_c('agent_calls > 0 OR nested_tools > 0')} AS delegating_sessions, round(sum(nested_tools) / sum(tool_calls) * 100, 1) AS delegated_tool_share, round(sum(nested_cost) / greatest(1e-9, sum(cost_usd)) * 100, 1) AS delegated_cost_share, coalesce(round(median(cost_per_tool) FILTER (WHERE (agent_calls > 0 OR nested_tools > 0) AND cost_per_tool <> 0), 4), 0) AS cost_per_tool_delegating, coalesce(round(median(cost_per_tool) FILTER (WHERE NOT (agent_calls > 0 OR nested_tools > 0) AND tool_calls > 0 AND cost_per_tool <> 0), 4), 0) AS cost_per_tool_direct FROM fact",
    "parallel_sessions": f"SELECT {_SLIM}, parallelism, turn_ms, wall_ms, cost_usd, agent_calls FROM fact WHERE parallelism > 1.05 ORDER BY parallelism DESC, session_id LIMIT 12",
    "overnight_sessions": f"SELECT {_SLIM}, wall_ms, cost_usd, prompts, tool_calls FROM fact WHERE wall_ms > 14400000 AND (hour(fact.started) >= 17 OR hour(fact.started) <= 3) ORDER BY wall_ms DESC, session_id LIMIT 10",
    "habit_ratios": "SELECT corrections, coalesce(round(corrections / nullif(prompts, 0) * 100, 1), 0) AS correction_pct, round(coalesce(continuations, 0) / greatest(1, sessions) * 100, 1) AS continuation_opener_pct FROM (SELECT count(*) AS prompts, count(*) FILTER (WHERE list_contains(intents, 'correction')) AS corrections FROM prompt WHERE is_human = 1), (SELECT count(*) AS sessions, count(*) FILTER (WHERE is_slash = 0 AND regexp_matches(t, '(?i)^(yes|ok|okay|continue|go|proceed|do it|now |also |and |next|then |it |still|no[,. ])')) AS continuations FROM (SELECT *, coalesce(text, '')[1:400] AS t, row_number() OVER (PARTITION BY session_id ORDER BY ts, uuid) AS k FROM prompt WHERE is_human = 1) WHERE k = 1)",
    "habit_counts": f"SELECT count(*) AS sessions, {_c('headless = 0')} AS interactive_sessions, {_c('headless = 0 AND prompts <= 1')} AS one_prompt_sessions, {_c('headless = 0 AND prompts >= 10')} AS long_sessions, {_s('corrections')} AS corrections, {_s('interrupts')} AS interrupts, {_s('compactions')} AS compactions FROM fact",
    "errors": "SELECT error_kind, count(*) AS n, count(DISTINCT session_id) AS sessions, min(date) AS first_day, max(date) AS last_day FROM message WHERE error_kind IS NOT NULL GROUP BY 1",
    "error_daily": "SELECT date, error_kind, count(*) AS n FROM message WHERE error_kind IS NOT NULL GROUP BY 1, 2",
    "error_kind": "SELECT uuid, error_kind FROM message WHERE error_kind IS NOT NULL",
    "limit_sessions": "SELECT g.*, coalesce(custom_title, ai_title, agent_name, g.session_id) AS title FROM (SELECT session_id, error_kind, max(project) AS project, max(date) AS date, count(*) AS n FROM message WHERE error_kind IN ('usage_limit', 'rate_limit', 'billing', 'fallback') GROUP BY 1, 2 ORDER BY date DESC, session_id, error_kind LIMIT 20) g LEFT JOIN session s ON s.session_id = g.session_id",
    "events_daily": "SELECT date, count(*) FILTER (WHERE kind = 'interrupt') AS interrupts, count(*) FILTER (WHERE kind = 'compact') AS compactions, count(*) FILTER (WHERE kind = 'system' AND subkind = 'api_error') AS api_errors FROM event GROUP BY 1",
    "model_switches": f"SELECT {_c('distinct_models > 1')} AS model_switch_sessions, {_c('compactions > 0')} AS sessions_with_compaction, {_s('tool_errors')} AS tool_errors FROM fact",
    "cost_outliers": f"SELECT {_SLIM}, cost_usd, tool_calls, cost_per_tool, api_calls FROM fact WHERE cost_usd >= 2 AND cost_per_tool > 3 * (SELECT median(cost_per_tool) FROM fact WHERE cost_usd >= 2 AND cost_per_tool <> 0) ORDER BY cost_per_tool DESC, session_id LIMIT 12",
    "high_burn_low_tool": f"SELECT {_SLIM}, cost_usd, tool_calls, api_calls, prompts FROM fact WHERE cost_usd > 1 AND tool_calls < 10 ORDER BY cost_usd DESC, session_id LIMIT 12",
    "search_heavy": f"SELECT {_SLIM}, cost_usd, tool_calls, readonly_share FROM fact WHERE tool_calls >= 10 AND readonly_share >= 0.6 AND uses_opus = 1 ORDER BY cost_usd DESC, session_id LIMIT 12",
    "zero_tool": "SELECT count(*) AS zero_tool_sessions, round(coalesce(sum(cost_usd), 0), 2) AS zero_tool_cost FROM fact WHERE tool_calls = 0",
    "median_session_cost": "SELECT round(median(cost_usd), 2) AS median_session_cost FROM fact",
    "routing_counterfactual": f"SELECT * FROM (WITH sums AS (SELECT {_SUMS} FROM message LEFT JOIN session USING (session_id)) {_ROUTING})",
    "cache_by_project": f"SELECT project, round(sum(cache_read) * 100.0 / sum(cache_read + input_tokens + cache_write), 1) AS hit_pct, {_s('eph_1h')} AS cache_1h, {_s('eph_5m')} AS cache_5m, round(sum(cost_usd), 2) AS cost_usd FROM message GROUP BY 1 ORDER BY cost_usd DESC, project LIMIT 15",
    "git_outcomes": "SELECT kind, CASE kind WHEN 'push' THEN remote ELSE key END AS key, branch, subject, files, insertions, deletions FROM git",
    "git_totals": f"SELECT count(*) FILTER (WHERE kind = 'commit') AS commits, count(*) FILTER (WHERE kind = 'push') AS pushes, count(*) FILTER (WHERE kind = 'pr') AS prs, {_s('files')} AS commit_files, {_s('insertions')} AS commit_insertions, {_s('deletions')} AS commit_deletions FROM git",
    "commits_by_project": f"SELECT project, count(*) AS commits, {_s('insertions')} AS insertions, {_s('deletions')} AS deletions, count(DISTINCT session_id) AS sessions FROM git WHERE kind = 'commit' GROUP BY 1 ORDER BY commits DESC, project LIMIT 15",
    "commits_daily": f"SELECT date, count(*) AS commits, {_s('insertions')} AS insertions FROM git WHERE kind = 'commit' GROUP BY 1",
    "recent_commits": "SELECT key, date, project, branch, subject, files, insertions, deletions FROM git WHERE kind = 'commit' ORDER BY ts DESC, key LIMIT 60",
    "prs": "SELECT date, project, subject AS url FROM git WHERE kind = 'pr' ORDER BY ts DESC, key LIMIT 40",
    "lines_by_category": _CATEGORIES,
    "source_lines": _SOURCE,
    "git_subcommands": r"SELECT cmd, count(*) AS n FROM (SELECT unnest(regexp_extract_all(bash_command, '\bgit\s+(?:--?\S+\s+)*([a-z][a-z\-]+)', 1)) AS cmd FROM tool WHERE bash_command LIKE '%git %') GROUP BY 1 ORDER BY n DESC, cmd LIMIT 15",
    "ticket_keys": "SELECT key, count(*) AS n FROM (SELECT unnest(tickets) AS key FROM prompt) GROUP BY 1",
    "ticket_ledger": f"SELECT * EXCLUDE (prefix, kept), CASE WHEN n_commit > 0 THEN 'delivered' WHEN n_branch + n_title + n_prompt + n_file > 0 THEN 'worked' ELSE 'referenced' END AS status FROM ({_LEDGER}) WHERE kept",
    "ticket_totals": f"SELECT count(*) AS ticket_count, count(*) FILTER (WHERE n_commit > 0) AS tickets_delivered, count(*) FILTER (WHERE n_commit = 0 AND n_branch + n_title + n_prompt + n_file > 0) AS tickets_worked FROM ({_LEDGER}) WHERE kept",
    "legacy_meta": "SELECT key, value FROM legacy_meta",
    "dropped_prefixes": f"SELECT DISTINCT prefix FROM ({_LEDGER}) WHERE NOT kept ORDER BY prefix LIMIT 40",
    "time_coverage": f"SELECT round(sum(turn_ms) / 3600000, 1) AS active_hours, {_c('turn_ms > 0')} AS timed_sessions, round(sum(total_tokens) FILTER (WHERE turn_ms > 0) / sum(total_tokens) * 100, 1) AS time_coverage_pct, round(sum(cost_usd), 2) AS cost_usd FROM fact",
    "roi_model": f"SELECT round(source_added / 60.0, 1) AS hours, round(source_added / 60.0 * 75.0, 2) AS value_usd, round(source_added / 60.0 * 75.0 / (SELECT sum(cost_usd) FROM message), 1) AS multiple FROM ({_SOURCE})",
    "churn_ratio": f"SELECT round(removed / added, 4) AS churn_ratio, round(reads / paid, 2) AS cache_leverage, round(cost / source_added * 1000, 2) AS cost_per_kloc FROM (SELECT sum(lines_added) AS added, sum(lines_removed) AS removed FROM tool), (SELECT sum(cache_read) AS reads, sum(input_tokens + cache_write) AS paid, sum(cost_usd) AS cost FROM message), ({_SOURCE})",
    "history_monthly": f"SELECT date[1:7] AS month, count(*) AS prompts, count(DISTINCT project) AS projects, {_s('pasted')} AS pasted, {_s('is_slash')} AS slash FROM history GROUP BY 1",
    "history_totals": f"SELECT count(*) AS prompts, min(date) AS first_day, max(date) AS last_day, count(DISTINCT project) AS projects, {_s('pasted')} AS pasted FROM history",
    "lost_projects": "SELECT project_path, max(project) AS project, count(*) AS prompts, min(date) AS first_day, max(date) AS last_day FROM history WHERE project NOT IN (SELECT project FROM session) AND replace(project_path, '/', '-') NOT IN (SELECT folder FROM folder) GROUP BY 1 ORDER BY prompts DESC, project_path LIMIT 25",
    "prompts_before_transcripts": f"SELECT count(*) FILTER (WHERE date < {_FIRST_SEEN}) AS prompts_before_transcripts, {_FIRST_SEEN} AS transcript_first_day FROM history",
    "clean_prompt": "SELECT uuid, text, slash_name, chars, source FROM prompt",
    "human_prompt_flag": "SELECT uuid, is_human, array_to_string(intents, ',') AS intents FROM prompt",
    "mining_input": "SELECT uuid, session_id, project, date, chars, text, is_slash, slash_name FROM prompt WHERE is_human = 1 AND chars >= 12",
    "prompt_tokens": "SELECT uuid, array_to_string(list_sort(tokens), ' ') AS tokens FROM doc_set",
    "families": f"SELECT {_FAMILY} AS key, arg_min(coalesce(text, '')[1:300], (ts, uuid)) AS example, count(*) AS size, count(DISTINCT session_id) AS sessions, array_to_string(list_sort(list_distinct(list(project)))[1:4], ',') AS projects, min(date) AS first_day, max(date) AS last_day FROM prompt WHERE is_human = 1 AND chars >= 12 AND is_slash = 0 GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT session_id) >= 2",
    "document_families": f"SELECT {_FAMILY} AS key, count(*) AS size, count(DISTINCT session_id) AS sessions FROM doc GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT session_id) >= 2",
    "jaccard_pairs": f"""SELECT * FROM (WITH p AS ({_PAIRS}), l AS (SELECT uuid, other, shared FROM (SELECT a AS uuid, b AS other, shared FROM p UNION ALL SELECT b, a, shared FROM p)),
  c AS (SELECT uuid, min(uuid) OVER w AS class, count(*) OVER w AS copies FROM doc_set WHERE len(tokens) >= 6 WINDOW w AS (PARTITION BY array_to_string(list_sort(tokens), ' '))),
  k AS (SELECT l.uuid, count(*) AS links, count(DISTINCT o.class) FILTER (WHERE o.class <> s.class) AS classes, sum(shared) AS shared FROM l JOIN c s ON s.uuid = l.uuid JOIN c o ON o.uuid = l.other GROUP BY 1)
  SELECT d.uuid, class, coalesce(copies, 0) AS copies, coalesce(classes, 0) AS classes, coalesce(links, 0) AS links, CAST(coalesce(shared, 0) AS BIGINT) AS shared FROM doc_set d LEFT JOIN c ON c.uuid = d.uuid LEFT JOIN k ON k.uuid = d.uuid)""",
    "phrase_counts": _PHRASES.format("doc_words"),
    "phrases": f"""SELECT phrase, sessions, n FROM (WITH p AS ({_PHRASES.format("prompt_words")}) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.sessions = p.sessions AND o.phrase <> p.phrase AND contains(o.phrase, p.phrase)
  AND (-o.n, -length(o.phrase), o.phrase) < (-p.n, -length(p.phrase), p.phrase))) ORDER BY sessions DESC, n DESC, length(phrase) DESC, phrase LIMIT 60""",
    "approx_projects": f"SELECT project, {_BILLED} AS api_calls, {_TOKENS} AS total_tokens, count(DISTINCT session_id) AS exact_sessions, count(DISTINCT git_branch) AS exact_branches, count(DISTINCT coalesce(message_id, request_id)) AS exact_responses, true AS sessions_close, true AS branches_close, true AS responses_close FROM message GROUP BY project",
    "approx_tools": f"SELECT name, count(*) AS calls, {_s('is_error')} AS errors, count(DISTINCT file_path) AS exact_files, true AS files_close, count(latency_ms) AS n, true AS p50_close, true AS p90_close FROM tool WHERE date BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY name",
    "usage_cube": f"SELECT date, project, model, CAST(grouping(date, project, model) AS INT) AS level, {_BILLED} AS api_calls, count(DISTINCT session_id) AS sessions, {_TOKENS} AS total_tokens, {_s('tool_uses')} AS tool_uses, {_COST} AS cost_usd FROM message GROUP BY CUBE (date, project, model)",
    "active_spans": f"""SELECT session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS lines, {_s('input_tokens + output_tokens')} AS tokens, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS active_ms
  FROM (SELECT *, sum(CASE WHEN ts - was <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY ts) AS was FROM message)) GROUP BY session_id, island""",
    "tool_changes": """SELECT project, file_path, name, unnest(CASE WHEN old IS NULL THEN [new] ELSE [old, new] END) AS calls, unnest(CASE WHEN old IS NULL THEN [1] ELSE [-1, 1] END) AS n, unnest(CASE WHEN old IS NULL THEN ['added'] ELSE ['changed_from', 'changed_to'] END) AS change
  FROM (SELECT project, file_path, name, count(*) AS new, nullif(count(*) FILTER (WHERE date <= '2024-01-20'), 0) AS old FROM tool WHERE file_path IS NOT NULL GROUP BY 1, 2, 3) WHERE old IS DISTINCT FROM new""",
    "overlapping_turns": "SELECT project, count(*) AS pairs, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS together_ms FROM (SELECT project, uuid, epoch_ms(ts) AS e, epoch_ms(ts) - duration_ms AS s FROM turn) a JOIN (SELECT project, uuid, epoch_ms(ts) AS e, epoch_ms(ts) - duration_ms AS s FROM turn) b USING (project) WHERE a.uuid < b.uuid AND a.s <= b.e AND b.s <= a.e GROUP BY project",
    "busy_minutes": """SELECT project, count(*) AS changes, max(n) AS most FROM (SELECT * FROM (WITH t AS (SELECT project, CAST(floor((epoch_ms(ts) - duration_ms) / 60000) AS BIGINT) AS s, CAST(floor(epoch_ms(ts) / 60000) AS BIGINT) AS e FROM turn),
  p AS (SELECT project, s AS step FROM t UNION SELECT project, e + 1 FROM t) SELECT p.project, step, count(t.s) AS n FROM p LEFT JOIN t ON t.project = p.project AND t.s <= step AND step <= t.e GROUP BY 1, 2)) GROUP BY project""",
    "last_interrupts": "SELECT m.uuid, e.uuid AS interrupt FROM message m ASOF LEFT JOIN (SELECT * FROM event WHERE kind = 'interrupt') e ON m.session_id = e.session_id AND m.ts >= e.ts",
    "costs_as_of": """SELECT model, count(*) AS lines, CAST(round(CAST(sum(cost) AS DECIMAL(28, 10)), 4) AS DOUBLE) AS cost_usd FROM (SELECT m.model, ((input_tokens + CASE WHEN coalesce(eph_5m, 0) = 0 AND coalesce(eph_1h, 0) = 0 THEN cache_write ELSE eph_5m END * 1.25 + eph_1h * 2.0 + cache_read * 0.1) * coalesce(r.price_in, 3.0) + output_tokens * coalesce(r.price_out, 15.0)) / 1000000.0 AS cost
  FROM message m ASOF LEFT JOIN rate r ON m.model = r.model AND m.ts >= r.ts) GROUP BY model""",
    "agent_prompts": "SELECT text[1:120] AS head, count(*) AS n, count(DISTINCT session_id) AS sessions FROM prompt WHERE source = 'subagent' GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, head LIMIT 20",
    "prompt_projects": "SELECT project, count(DISTINCT session_id) AS sessions, count(*) AS prompts FROM prompt WHERE is_human = 1 GROUP BY 1 ORDER BY prompts DESC, project LIMIT 15",
    "prompt_corpus": "SELECT project, session_id, uuid, date, text[1:2500] AS text FROM prompt WHERE is_human = 1 AND text IS NOT NULL",
    "cur_overview": f"SELECT * FROM (SELECT count(*) AS sessions, {_s('lines_added')} AS lines_added, {_s('lines_removed')} AS lines_removed, {_s('files_changed')} AS files_changed, {_s('is_subagent')} AS subagent_sessions, {_s('is_archived')} AS archived, round(avg(context_usage_pct), 1) AS avg_context_pct, count(DISTINCT project) AS projects, min(date) AS first_day, max(date) AS last_day FROM chat_session), (SELECT count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS user_messages, count(*) FILTER (WHERE role = 'assistant') AS assistant_messages, count(tool_name) AS tool_calls, {_s('text_chars')} AS text_chars, {_s('thinking_blocks')} AS thinking_blocks, {_s('code_blocks')} AS code_blocks, {_s('input_tokens')} AS input_tokens, {_s('output_tokens')} AS output_tokens, count(DISTINCT date) AS active_days, count(*) FILTER (WHERE ts_source = 'exact') AS ts_exact, count(*) FILTER (WHERE ts_source = 'session') AS ts_inferred, count(*) FILTER (WHERE ts_source IS NULL) AS ts_none, round(count(*) FILTER (WHERE ts_source = 'exact') / count(*) * 100, 1) AS ts_exact_pct FROM chat_message), (SELECT count(*) AS ai_lines, count(DISTINCT file_name) AS ai_files, count(*) >= 10000 AS ai_lines_capped FROM ai_line), (SELECT count(*) AS conversations FROM chat_title)",
    "cur_daily": f"SELECT date, count(*) AS messages, count(DISTINCT composer_id) AS sessions, count(tool_name) AS tool_calls, {_s('text_chars')} AS text_chars FROM chat_message WHERE date IS NOT NULL GROUP BY 1",
    "cur_tools": f"SELECT tool_name AS name, count(*) AS calls, {_s('tool_error')} AS errors, count(*) FILTER (WHERE tool_status = 'completed') AS completed, round(avg(duration_ms), 0) AS avg_duration_ms FROM chat_message WHERE tool_name IS NOT NULL GROUP BY 1 ORDER BY calls DESC, name LIMIT 40",
    "cur_projects": f"SELECT coalesce(project, '(unknown)') AS project, count(*) AS sessions, {_s('lines_added')} AS lines_added, {_s('lines_removed')} AS lines_removed, {_s('files_changed')} AS files_changed, {_s('message_count')} AS messages, min(date) AS first_day, max(date) AS last_day FROM chat_counted GROUP BY 1 ORDER BY messages DESC, project LIMIT 40",
    "cur_sessions": "SELECT composer_id, name, project, mode, date, lines_added, lines_removed, files_changed, message_count, context_usage_pct, is_subagent, subtitle FROM chat_counted ORDER BY message_count DESC, composer_id LIMIT 50",
    "cur_modes": f"SELECT coalesce(mode, '(unknown)') AS mode, count(*) AS sessions, {_s('message_count')} AS messages, {_s('lines_added')} AS lines_added FROM chat_counted GROUP BY 1",
    "cur_ai_by_ext": "SELECT coalesce(file_ext, '(none)') AS file_ext, count(*) AS lines, count(DISTINCT file_name) AS files FROM ai_line GROUP BY 1 ORDER BY lines DESC, file_ext LIMIT 25",
    "cur_ai_by_file": "SELECT file_name, max(file_ext) AS file_ext, count(*) AS lines FROM ai_line GROUP BY 1 ORDER BY lines DESC, file_name LIMIT 30",
    "cur_ai_by_source": "SELECT coalesce(source, '(none)') AS source, count(*) AS lines FROM ai_line GROUP BY 1",
    "cur_hourly": "SELECT hour, count(*) AS messages FROM chat_message WHERE hour IS NOT NULL GROUP BY 1",
}

ORACLES: dict[str, str] = {name: "WITH " + ", ".join(f"{view} AS ({sql})" for view, sql in _VIEWS.items()) + " " + body for name, body in _BODIES.items()}

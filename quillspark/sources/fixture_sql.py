"""The fixture views as SQL text, for the DuckDB oracles.

The driver registers only its own tables, so every oracle inlines the views
it needs as CTEs: ``with_views("usage_v", "results_v")`` returns a ``WITH``
prefix holding those views and their dependencies.
"""

from __future__ import annotations

from quillspark.functions.strings import JS_BLANK_PATTERN, JS_LEADING_INT_PATTERN

VIEWS: dict[str, str] = {
    "users_v": """
SELECT c_custkey AS id, lower(c_name) || '@example.com' AS email,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'test' ELSE 'regular' END AS role
FROM customer""",
    "admins_v": "SELECT email FROM users_v WHERE role = 'admin'",
    "testers_v": "SELECT email FROM users_v WHERE role = 'test'",
    "usage_v": """
SELECT u.id AS user_id, u.email, coalesce(o.n, 0) AS usage_count,
       CASE WHEN u.role = 'admin' THEN 999999 ELSE 10 END AS max_usage,
       (u.role = 'admin' OR u.id % 11 = 0) AS is_premium,
       o.first_at AS created_at,
       CASE WHEN u.id % 7 = 0 THEN NULL ELSE o.last_at END AS last_used_at
FROM users_v u
LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at
           FROM orders GROUP BY o_custkey) o ON o.o_custkey = u.id
WHERE u.id % 5 <> 0""",
    "keywords_v": """
SELECT o_custkey AS user_id, p_name AS keyword, min(o_orderdate) AS created_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
GROUP BY o_custkey, p_name""",
    "results_v": """
SELECT e.event_id AS id, e.event_type || '-' || CAST(e.user_id % __KEYWORDS__ AS VARCHAR) AS keyword,
       CASE WHEN e.event_id % 8 = 6 THEN NULL WHEN e.event_id % 8 = 2 THEN ''
            WHEN e.event_id % 4 = 0 THEN '## ' || d.source || chr(10) || '| a | b |' || chr(10)
                                         || '| --- | --- |' || chr(10) || d.text
            WHEN e.event_id % 4 = 1 THEN '# ' || d.text ELSE d.text END AS content,
       e.event_id % __RUNS__ AS paa_conv_id, e.ts AS created_at
FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id % __DOCS__""",
    "serp_items_v": """
SELECT conv_id, turn,
       CASE WHEN turn % 5 = 0 THEN text WHEN turn % 5 = 2 THEN '' WHEN turn % 5 = 4 THEN '   ' END AS question,
       CASE WHEN turn % 5 IN (1, 4) THEN text END AS title,
       CASE WHEN turn % 5 = 2 THEN text END AS text,
       CASE WHEN turn % 5 = 3 THEN text END AS query
FROM conversations""",
    "requests_v": """
SELECT event_id AS request_id, CASE WHEN event_id % 30 = 0 THEN NULL ELSE user_id END AS user_id, ts,
       CASE WHEN event_id % 50 = 1 THEN '' ELSE event_type || '-' || CAST(user_id % __KEYWORDS__ AS VARCHAR) END AS keyword,
       CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'gemini-2.5-flash-lite' END AS selected_model,
       CASE WHEN event_id % 4 = 0 THEN 'casual tone' END AS custom_prompt,
       event_id % 5 = 0 AS force_refresh
FROM events""",
    "snapshot_v": "SELECT * FROM results_v WHERE created_at < TIMESTAMP '2024-01-16 00:00:00'",
    # PAA questions per conversation (run), in turn order; empty list when none survive.
    "paa_v": """
SELECT conv_id,
       coalesce(list(q ORDER BY turn) FILTER (WHERE NOT regexp_matches(q, '__BLANK__')),
                []::VARCHAR[]) AS paa
FROM (SELECT conv_id, turn,
             coalesce(nullif(question, ''), nullif(title, ''), nullif(text, ''), nullif(query, ''), '') AS q
      FROM serp_items_v)
GROUP BY conv_id""",
    "results_full_v": """
SELECT r.id, r.keyword, p.paa AS paa_questions, r.content, r.created_at
FROM results_v r LEFT JOIN paa_v p ON p.conv_id = r.paa_conv_id""",
    "snapshot_full_v": "SELECT * FROM results_full_v WHERE created_at < TIMESTAMP '2024-01-16 00:00:00'",
    "keyword_adds_v": """
SELECT e.event_id AS add_id, CASE WHEN e.event_id % 30 = 0 THEN NULL ELSE e.user_id END AS user_id, e.ts,
       CASE e.event_id % 6 WHEN 0 THEN p.p_name
                           WHEN 1 THEN '  ' || p.p_name || chr(12288)
                           WHEN 2 THEN chr(9) || ' '
                           WHEN 3 THEN repeat(p.p_name || ' ', 20)
                           ELSE e.event_type || '-' || CAST(e.user_id % __KEYWORDS__ AS VARCHAR) END AS keyword
FROM events e LEFT JOIN part p ON p.p_partkey = e.user_id""",
    "live_users_v": "SELECT * FROM users_v WHERE id % 17 <> 0",
    "limit_inputs_v": """
SELECT event_id, user_id, ts, event_type, value, props,
       CASE event_id % 3 WHEN 0 THEN substring(props, 6) WHEN 1 THEN props ELSE substring(props, 7) END AS raw_limit
FROM events""",
    "limit_changes_v": """
SELECT event_id AS change_id, user_id, ts,
       coalesce(TRY_CAST(nullif(regexp_extract(raw_limit, '__INT__', 1), '') AS BIGINT), 0) AS max_usage,
       value > 50 AS is_premium
FROM limit_inputs_v WHERE event_type = 'purchase'""",
    "signups_v": """
SELECT id, CASE WHEN id % 3 = 0 THEN 'new-' || email ELSE email END AS email
FROM users_v WHERE id IN (SELECT user_id FROM events WHERE event_type = 'signup')""",
}

# Counts of the tables themselves, so that ids map onto all their rows.
DOC_COUNT = "greatest((SELECT count(*) FROM documents), 1)"
RUN_COUNT = "greatest((SELECT count(DISTINCT conv_id) FROM conversations), 1)"
KEYWORD_COUNT = "greatest((SELECT count(*) // 10 FROM customer), 1)"
for _name, _sql in VIEWS.items():
    VIEWS[_name] = (_sql.replace("__DOCS__", DOC_COUNT).replace("__RUNS__", RUN_COUNT)
                    .replace("__KEYWORDS__", KEYWORD_COUNT))
VIEWS["paa_v"] = VIEWS["paa_v"].replace("__BLANK__", JS_BLANK_PATTERN)
VIEWS["limit_changes_v"] = VIEWS["limit_changes_v"].replace("__INT__", JS_LEADING_INT_PATTERN)

DEPENDS: dict[str, tuple[str, ...]] = {
    "admins_v": ("users_v",),
    "testers_v": ("users_v",),
    "usage_v": ("users_v",),
    "snapshot_v": ("results_v",),
    "paa_v": ("serp_items_v",),
    "results_full_v": ("results_v", "paa_v"),
    "snapshot_full_v": ("results_full_v",),
    "live_users_v": ("users_v",),
    "limit_changes_v": ("limit_inputs_v",),
    "signups_v": ("users_v",),
}


def _closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in DEPENDS.get(n, ()):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(*names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH v1 AS (...), v2 AS (...)`` for the named views (+ extra CTEs, in order)."""
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in _closure(names)]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v.strip()})")
    return "WITH " + ",\n".join(parts) + "\n"

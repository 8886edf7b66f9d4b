"""DuckDB SQL of the conversation repair: one state after another, turn by turn, instead of spans."""

from __future__ import annotations

from pactscope.llm.periods_sql import crc32_sql

#: State before, initial, state after: 0 nothing said, 1 system, 2 user, 3 assistant.
_MOVES = "(0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)"
#: Cheapest insertions from state to state.
_INSERTED = "(0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (3, 2, 5, 'I'), (2, 3, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')"


def repair_sql() -> str:
    blanks = r"'[\x20\x09-\x0D]*'"
    return rf"""
        WITH RECURSIVE inserted(p, q, cost, audit) AS (VALUES {_INSERTED}), moves(p, initial, q) AS (VALUES {_MOVES}),
        told AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault
          FROM conversations),
        damaged AS (
          SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
            CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS time
          FROM told WHERE fault <> 0),
        turns AS (
          SELECT conv_id, turn, role, text, left(role, 1) AS initial, row_number() OVER o AS k, lag(left(role, 1)) OVER o AS before, count(*) OVER (PARTITION BY conv_id) AS n
          FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        judged AS (
          SELECT *, CASE WHEN regexp_full_match(text, {blanks}) THEN 1
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault
          FROM turns),
        edits AS (
          SELECT conv_id, k, n, s.p, s.p AS q, 2 AS cost, 'D' AS audit FROM judged, (VALUES (0), (1), (2), (3)) s(p)
          UNION ALL
          SELECT conv_id, k, n, p, q, CASE WHEN moves.initial = judged.initial THEN 0 ELSE 1 END + CASE WHEN fault = 3 THEN 5 ELSE 0 END,
            CASE WHEN moves.initial = judged.initial THEN 'K' ELSE 'R' END
          FROM judged JOIN moves ON moves.initial = judged.initial OR moves.initial <> 's' WHERE fault NOT IN (1, 2)),
        paths(conv_id, k, n, q, cost, audit) AS (
          SELECT conv_id, CAST(0 AS BIGINT), n, q, CAST(cost AS BIGINT), audit FROM (SELECT DISTINCT conv_id, n FROM turns), inserted WHERE p = 0
          UNION ALL
          SELECT conv_id, k, n, q, best.cost, best.audit FROM (
            SELECT t.conv_id, e.k, t.n, i.q, min({{'cost': t.cost + e.cost + i.cost, 'audit': t.audit || e.audit || i.audit}}) AS best
            FROM paths t JOIN edits e ON e.conv_id IS NOT DISTINCT FROM t.conv_id AND e.k = t.k + 1 AND e.p = t.q JOIN inserted i ON i.p = e.q
            GROUP BY t.conv_id, e.k, t.n, i.q)),
        chosen AS (
          SELECT conv_id, min({{'cost': cost, 'audit': audit}}) AS best FROM paths WHERE k = n AND q IN (0, 3) GROUP BY conv_id),
        letters AS (
          SELECT conv_id, best.audit AS audit, unnest(range(1, len(best.audit) + 1)) AS i FROM chosen),
        steps AS (
          SELECT conv_id, i, audit[i] AS edit, CAST(sum(CASE WHEN audit[i] <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS BIGINT) AS k,
            sum(CASE WHEN audit[i] <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) - 1 AS number,
            sum(CASE WHEN audit[i] <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) % 2 AS odd
          FROM letters),
        lines AS (
          SELECT s.conv_id, s.i, CASE WHEN s.edit = 'K' THEN t.role WHEN number % 2 = odd THEN 'user' ELSE 'assistant' END
            || ':' || CASE WHEN s.edit = 'I' THEN '' ELSE t.text END AS line
          FROM steps s LEFT JOIN judged t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.k = s.k WHERE s.edit <> 'D'),
        digests AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY i)) AS sha FROM lines GROUP BY conv_id),
        counted AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
            count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
            count(*) FILTER (k > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
          FROM judged GROUP BY conv_id)
        SELECT a.conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
          CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a
        LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
        LEFT JOIN chosen b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
        LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM a.conv_id
    """

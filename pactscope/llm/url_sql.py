"""The DuckDB SQL that op9_url_filters is checked against."""

from __future__ import annotations

from pactscope.llm import urls


#: Levels that the SQL tells apart; paths of the given tables have three segments at most.
LEVELS = 6


def _rule(field: str) -> str:
    cases = []
    for verdict, own, path in sorted(urls.RULES, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]))):
        value = urls.rule_name(own, path) if field == "rule" else verdict
        cases.append(f"WHEN (host = '{own}' OR host LIKE '%.{own}') AND path LIKE '{path}%' THEN '{value}'")
    return f"CASE {' '.join(cases)} END"


def template_sql() -> str:
    parts = [
        """rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages)""",
        r"""parsed AS (SELECT page_id,
              coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
              coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rests)""",
        """marks AS (SELECT doc_id, max(1 - quality) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id)""",
        r"""at0 AS (SELECT p.*, bad, host AS template FROM parsed p
              LEFT JOIN marks ON doc_id = TRY_CAST(regexp_extract(path, '/([0-9]+)[^/]*/?$', 1) AS BIGINT))""",
        r"""shapes AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
              lambda s: CASE WHEN regexp_full_match(s, '[0-9]+(\.[A-Za-z]+)?') THEN '*' ELSE s END) AS segments, host AS node FROM at0)""",
        """base AS (SELECT coalesce(sum(bad) / count(bad), 0.0) AS share FROM at0)""",
        "nodes0 AS (SELECT page_id, host, path, bad, segments, node FROM shapes)",
    ]
    band = " + ".join(f"CAST(sum(bad) >= CAST({e!r} AS DOUBLE) * count(bad) AS INT)" for e in urls.EDGES)
    for k in range(LEVELS):
        parts += [
            f"""value{k} AS (SELECT node, segments[{k + 1}] AS value, count(bad) AS labelled, {band} AS band FROM nodes{k}
                  WHERE segments[{k + 1}] <> '*' GROUP BY ALL HAVING count(bad) >= {urls.SUPPORT})""",
            f"""class{k} AS (SELECT node, band FROM value{k} JOIN (SELECT node, count(bad) AS total FROM nodes{k} GROUP BY node) USING (node)
                  GROUP BY node, band, total HAVING sum(labelled) < total)""",
            f"""nodes{k + 1} AS (SELECT page_id, host, path, bad, segments, CASE WHEN node IN (SELECT node FROM class{k})
                    THEN node || '/' || coalesce(CAST(c.band AS VARCHAR), '*') ELSE node END AS node
                  FROM nodes{k} n LEFT JOIN (SELECT node AS at, value, band FROM value{k} v JOIN class{k} c USING (node, band)) c
                    ON n.node = c.at AND n.segments[{k + 1}] = c.value)""",
        ]
    purity = f"(coalesce(sum(bad), 0) + CAST({urls.STRENGTH} AS DOUBLE) * any_value(share)) / (count(bad) + {urls.STRENGTH})"
    return f"""WITH {", ".join(parts)}, judged AS (SELECT node, {purity} AS purity FROM nodes{LEVELS}, base GROUP BY node)
        SELECT page_id, host, path, {_rule("rule")} AS rule,
               coalesce({_rule("verdict")}, CASE WHEN purity >= {urls.REJECT} THEN 'block' ELSE 'allow' END) AS verdict
        FROM nodes{LEVELS} JOIN judged USING (node)"""

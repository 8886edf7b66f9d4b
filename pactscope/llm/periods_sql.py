"""DuckDB SQL of the periodic runs: every pair of equal words of a document, islands of each lag."""

from __future__ import annotations


def crc32_sql(value: str) -> str:
    """The unsigned CRC-32 of an ASCII string, bit by bit."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(list_concat([xor(crc, byte)], [CAST(0 AS BIGINT) FOR _ IN range(8)]), lambda c, _: {step})"
    codes = f"[CAST(ascii(x) AS BIGINT) FOR x IN string_split({value}, '')]"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda crc, byte: {byte}), 4294967295)"


def periods_sql() -> str:
    return rf"""
        WITH told AS (
          SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
            {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h
          FROM documents),
        planned AS (
          SELECT id, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM told),
        places AS (
          SELECT id, n, unnest(range(n)) AS i, w, a, planted, 1 + (n - a) // (3 + g % 8) AS p FROM planned),
        words AS (
          SELECT id, n, i, CASE WHEN planted AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM places),
        alike AS (
          SELECT x.id, x.i, y.i - x.i AS lag FROM words x JOIN words y USING (id, word) WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        islands AS (
          SELECT id, lag, min(i) AS start, count(*) + lag AS length
          FROM (SELECT id, lag, i, i - row_number() OVER (PARTITION BY id, lag ORDER BY i) AS island FROM alike)
          GROUP BY id, lag, island HAVING count(*) + lag >= greatest(6, 4 * lag)),
        runs AS (SELECT id, start, length, min(lag) AS period FROM islands GROUP BY id, start, length),
        dropped AS (SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM runs),
        kept AS (
          SELECT id, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256
          FROM words WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.id = words.id AND d.i = words.i) GROUP BY id),
        found AS (
          SELECT id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256
          FROM runs GROUP BY id),
        longest AS (
          SELECT r.* FROM runs r WHERE NOT EXISTS (
            SELECT 1 FROM runs o WHERE o.id = r.id AND (
              o.length * r.period > r.length * o.period
              OR o.length * r.period = r.length * o.period AND (o.start, o.period) < (r.start, r.period))))
        SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length,
          CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
          coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
        FROM planned LEFT JOIN found USING (id) LEFT JOIN longest USING (id) LEFT JOIN kept USING (id)
    """

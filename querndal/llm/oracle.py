"""DuckDB SQL for the pN_ queries that SQL can express over whole tables."""

from __future__ import annotations

_SITED = r"""
raw AS (SELECT ord, docs, metadatas['url'] AS url, replace(metadatas['source'], '\', '/') AS path FROM dbs),
sited AS (
  SELECT ord, docs, CASE
    WHEN url IS NOT NULL THEN 'h:' || nullif(regexp_replace(regexp_replace(regexp_replace(
      lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^www\.', ''), '')
    WHEN contains(regexp_replace(path, '^\./', ''), '/') THEN 'd:' || regexp_extract(regexp_replace(path, '^\./', ''), '^(.*)/', 1)
  END AS site FROM raw),
totals AS (SELECT site, count(*) AS n FROM sited WHERE site IS NOT NULL GROUP BY site),
lines AS (
  SELECT ord, site, unnest(string_split(docs, chr(10))) AS line, generate_subscripts(string_split(docs, chr(10)), 1) - 1 AS line_no
  FROM sited WHERE site IS NOT NULL AND docs IS NOT NULL),
masked AS (
  SELECT ord, site, line_no, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'),
    '[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS m
  FROM lines),
found AS (
  SELECT ord, line_no FROM masked JOIN (
    SELECT site, m FROM masked JOIN totals USING (site) WHERE m <> ''
    GROUP BY site, m, n HAVING count(DISTINCT ord) >= 5 AND count(DISTINCT ord) * 10 >= n) USING (site, m))
"""

_CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]"

_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _last(window: str, pattern: str) -> str:
    """Place of the last match's end in a window, 0 if there is none."""
    return f"length(regexp_extract({window}, '(?s)^.*{pattern}'))"


def _digits(key: str, least: int, default: int) -> str:
    value = f"CASE WHEN regexp_full_match(trim(metadatas['{key}'], ' '), '[0-9]+') THEN try_cast(trim(metadatas['{key}'], ' ') AS BIGINT) END"
    return f"CASE WHEN {value} >= {least} THEN {value} ELSE {default} END"


_W = "docs[s + size // 2 + 1:s + size]"
_STOP = f"greatest({_last('docs[s + size // 2 + 1:s + size + 1]', '[.!?]' + _WS)} - 1, {_last(_W, '[。！？]')})"
#: End of the piece that begins at s.
_END = f"""CASE WHEN length(docs) - s <= size THEN length(docs) ELSE s + size // 2 + CASE WHEN {_last(_W, chr(92) + 'n')} > 0 THEN {_last(_W, chr(92) + 'n')} WHEN {_STOP} > 0 THEN {_STOP}
    WHEN {_last(_W, _WS)} > 0 THEN {_last(_W, _WS)} ELSE size - size // 2 END END"""

ORACLES = {
    "p4_found": f"""WITH RECURSIVE d AS (SELECT * FROM (SELECT ord, docs, {_digits('chunk_size', 1, 1000)} AS size, {_digits('chunk_overlap', 0, 100)} AS overlap FROM dbs) WHERE length(docs) > size),
      r AS (SELECT ord, 0 AS piece_no, s, {_END} AS e FROM (SELECT *, 0::BIGINT AS s FROM d)
        UNION ALL SELECT ord, piece_no + 1, s, {_END} FROM (SELECT d.*, r.piece_no, greatest(r.s + 1, r.e - overlap) AS s FROM r JOIN d USING (ord) WHERE r.e < length(docs)))
      SELECT ord, CAST(piece_no AS INTEGER) AS piece_no, CAST(s AS INTEGER) AS start_at, CAST(e AS INTEGER) AS end_at FROM r""",
    "p1_found": rf"""WITH t AS (SELECT ord, regexp_extract_all(regexp_replace(lower(docs), '({_CJK})', ' \1 ', 'g'), '{_CJK}|[\p{{L}}\p{{N}}]+') AS w FROM dbs WHERE docs IS NOT NULL),
      g AS (SELECT DISTINCT ord, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT ord, w, unnest(generate_series(1, len(w) - 4)) AS i FROM t WHERE len(w) >= 20)),
      n AS (SELECT ord, count(*) AS n FROM g GROUP BY 1),
      p AS (SELECT a.ord AS ord_a, b.ord AS ord_b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.ord < b.ord GROUP BY ALL)
      SELECT ord_a, ord_b FROM p JOIN n x ON x.ord = ord_a JOIN n y ON y.ord = ord_b WHERE 10 * k >= 6 * (x.n + y.n - k)""",
    "p3_found": f"WITH {_SITED} SELECT ord, CAST(line_no AS INTEGER) AS line_no FROM found",
    "p3_stripped": f"""WITH {_SITED},
      every AS (SELECT ord, docs, unnest(string_split(docs, chr(10))) AS line, generate_subscripts(string_split(docs, chr(10)), 1) - 1 AS line_no FROM dbs WHERE docs IS NOT NULL),
      kept AS (SELECT e.ord, string_agg(e.line, chr(10) ORDER BY e.line_no) FILTER (f.ord IS NULL) AS docs, count(f.ord) AS removed
               FROM every e LEFT JOIN found f ON e.ord = f.ord AND e.line_no = f.line_no GROUP BY e.ord)
      SELECT d.ord, CASE WHEN d.docs IS NULL THEN NULL ELSE coalesce(k.docs, '') END AS docs, CAST(coalesce(k.removed, 0) AS INTEGER) AS removed
      FROM dbs d LEFT JOIN kept k USING (ord)""",
}

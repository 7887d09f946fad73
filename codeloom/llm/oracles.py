"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from .pii import FORM, NEARBY, context


def _spans(kind: str, rank: int, pattern: str, valid: str, score: str = "0") -> str:
    """Rows (doc_id, kind, rank, start, stop, score) of a pattern's matches that are valid; positions come from what lies between matches."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, upto - length(m) AS start, upto AS stop, {score} AS score FROM (
  SELECT doc_id, i, m, right(p, 40) || chr(10) || left(q, 40) AS around, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(ps[:len(ms)]) AS p, unnest(ps[2:len(ms) + 1]) AS q, unnest(range(len(ms))) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS ps FROM d WHERE regexp_matches(t, '{p}'))))
WHERE {valid}"""


def _scored(kind: str) -> str:
    """Hundredths: by the form, and more if a context word is near."""
    return f"CASE WHEN regexp_matches(around, '{context(kind)}') THEN {round(100 * (FORM[kind] + NEARBY))} ELSE {round(100 * FORM[kind])} END"


def _digests(parts: list[str], base: tuple[str, ...], more: str = "") -> str:
    joined = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop){}, '')"
    only = f" FILTER (WHERE kind IN ({', '.join(repr(k) for k in base)}))"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in base)
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(parts)}) SELECT d.doc_id, {counts}, sha256({joined.format(only)}) AS base_sha256, {joined.format(' FILTER (WHERE kind IS NOT NULL)')} AS spans{more} FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE
  WHEN k % 2 = 1 THEN CAST(reverse({_DIGITS})[k] AS INTEGER) WHEN CAST(reverse({_DIGITS})[k] AS INTEGER) > 4 THEN CAST(reverse({_DIGITS})[k] AS INTEGER) * 2 - 9 ELSE CAST(reverse({_DIGITS})[k] AS INTEGER) * 2 END)) % 10 = 0"""
_PII = _digests(
    [
        _spans("email", 1, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", _scored("email")),
        _spans("ip", 2, r"[0-9]+(?:\.[0-9]+){3}", "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND CAST('0' || right(x, 3) AS INTEGER) <= 255))", _scored("ip")),
        _spans("card", 3, r"[0-9](?:[ -]?[0-9])+", _LUHN, _scored("card")),
        _spans("phone", 4, r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15", _scored("phone")),
    ],
    ("email", "ip", "card", "phone"),
    ", coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY start, rank, stop) FILTER (WHERE kind IS NOT NULL), '') AS scores",
)
_VALUE = r"""(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = _digests(
    [
        _spans("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]+""", f"length(regexp_extract(m, '{_VALUE}', 1)) >= 6"),
        _spans("access", 2, "AKIA[A-Z0-9]+", "length(m) >= 20"),
        _spans("hex", 3, "[0-9a-f]+", "length(m) >= 24"),
        _spans("pem", 4, "-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", "true"),
    ],
    ("assign", "access", "hex"),
)

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_DECONTAMINATE = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS gram FROM (SELECT item_id, ws, least(len(ws), 8) AS size, unnest(range(1, len(ws) - least(len(ws), 8) + 2)) AS i FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT size FROM g),
x AS (SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS gram FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, k WHERE len(ws) >= size)),
h AS (SELECT doc_id, i, x.size, item_id FROM x JOIN g USING (size, gram)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM h) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""

_SUBSTRING = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT gram, min(doc_id) AS least FROM x GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
h AS (SELECT doc_id, i FROM x JOIN f USING (gram) WHERE doc_id > least),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM h),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
k AS (SELECT a.doc_id, count(r.j) AS n_removed, string_agg(word, ' ' ORDER BY a.j) FILTER (WHERE r.j IS NULL) AS kept FROM a LEFT JOIN r ON r.doc_id = a.doc_id AND r.j = a.j GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""

_NEARDUP = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END)) AS sh FROM w),
g AS (SELECT min(doc_id) AS rep, sh FROM s WHERE len(sh) > 0 GROUP BY sh),
l AS (SELECT rep, len(sh) AS n, unnest(sh) AS x FROM g),
p AS (SELECT a.rep AS a, b.rep AS b FROM l a JOIN l b ON a.x = b.x AND a.rep < b.rep AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT rep AS node, rep AS top FROM g UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.node WHERE r.top < e.b),
c AS (SELECT node, min(top) AS top FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(c.top, s.doc_id) AS component_id, coalesce(c.top, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN g ON g.sh = s.sh LEFT JOIN c ON c.node = g.rep"""

ORACLES: dict[str, str] = {"op2_pii": _PII, "op3_secrets": _SECRETS, "op4_decontaminate": _DECONTAMINATE, "op6_substring": _SUBSTRING, "op7_neardup": _NEARDUP}

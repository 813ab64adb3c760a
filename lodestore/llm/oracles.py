"""DuckDB SQL for the operators that SQL can express, over the same tables."""

from __future__ import annotations

import re

from lodestore.llm import secrets

#: Rows by number, links between numbers (a, b) in both directions: for each number the numbers that links reach.
REACHED = "reached AS (SELECT r, r AS s FROM nodes UNION SELECT reached.r, links.b FROM reached JOIN links ON links.a = reached.s)"

OP2 = f"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    good AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
      WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93),
    nodes AS (SELECT DISTINCT a AS r FROM links), {REACHED},
    least AS (SELECT reached.r, min(v.vec_id) AS c FROM reached JOIN v ON v.r = reached.s GROUP BY reached.r),
    n AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id)::BIGINT AS component_id, coalesce(vec_id = coalesce(c, vec_id), true) AS kept
    FROM v LEFT JOIN n USING (r) LEFT JOIN least USING (r)"""

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: Texts of the same words are one node.
OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
    s AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS shingles FROM d),
    texts AS (SELECT w, any_value(shingles) AS shingles, min(doc_id) AS least, row_number() OVER () AS r FROM s WHERE len(w) > 0 GROUP BY w),
    sh AS (SELECT r, unnest(shingles) AS x FROM texts),
    common AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM sh a JOIN sh b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2),
    near AS (SELECT a, b FROM common JOIN texts p ON p.r = a JOIN texts q ON q.r = b WHERE 100 * n >= 75 * (len(p.shingles) + len(q.shingles) - n)),
    links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
    nodes AS (SELECT r FROM texts), {REACHED},
    least AS (SELECT reached.r, min(texts.least) AS c FROM reached JOIN texts ON texts.r = reached.s GROUP BY reached.r)
    SELECT doc_id, len(shingles)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(doc_id = coalesce(c, doc_id), true) AS kept
    FROM s LEFT JOIN texts USING (w) LEFT JOIN least USING (r)""".replace("SELECT doc_id, len(shingles)", "SELECT doc_id, len(s.shingles)")


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _ascii(pattern: str) -> str:
    """The pattern with ``(?i:...)`` spelt out, since this SQL's own folds letters beyond A-Z, too."""
    return re.sub(r"\(\?i:(.*?\))\)", lambda m: re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]), pattern)


def _matches(pattern: str, group: int, least: int, kind: int) -> str:
    """The spans of a pattern: gaps between matches and the matches themselves give positions."""
    p = _text(pattern)
    return f"""SELECT r, {kind} AS k, pos AS start, pos + length(m) AS stop, m FROM (
      SELECT r, m, size, sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS pos FROM (
        SELECT r, unnest(string_split_regex(t, {p})) AS gap, unnest(list_append(regexp_extract_all(t, {p}), NULL)) AS m,
          unnest(list_append(list_transform(regexp_extract_all(t, {p}, {group}), lambda x: length(x)), NULL)) AS size, generate_subscripts(string_split_regex(t, {p}), 1) AS i FROM d WHERE regexp_matches(t, {p}))
      WINDOW w AS (PARTITION BY r ORDER BY i)) WHERE m IS NOT NULL AND size >= {least}"""


def _secrets() -> str:
    base = [_matches(_ascii(pattern), group, least, k) for k, (_, pattern, group, least, _) in enumerate(secrets.KINDS)]
    allowed = " OR ".join(f"regexp_matches(m, {_text(p)})" for p in secrets.ALLOWED)
    more = []
    for k, (_, characters, threshold) in enumerate(secrets.CLASSES, start=len(secrets.KINDS)):
        windows = f"flatten(list_transform(string_split_regex(m, {_text(secrets.PLACEHOLDER)}), lambda p: list_transform(range(1, length(p) - {secrets.WINDOW} + 2), lambda i: substring(p, i, {secrets.WINDOW}))))"
        best = f"coalesce(list_max(list_transform({windows}, lambda x: list_aggregate(string_split(x, ''), 'entropy'))), -1)"
        more.append(f"SELECT * FROM ({_matches(f'[{characters}]{{{secrets.WINDOW},}}', 0, secrets.WINDOW, k)}) WHERE NOT ({allowed}) AND {best} >= {threshold}")
    names = "[" + ", ".join(f"'{x[0]}'" for x in (*secrets.KINDS, *secrets.CLASSES)) + "]"
    line = f"string_agg({names}[k + 1] || ':' || start || ':' || stop, ',' ORDER BY start, k)"
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{x[0]}" for k, x in enumerate(secrets.KINDS))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), base AS ({' UNION ALL '.join(base)}), every AS (SELECT * FROM base UNION ALL {' UNION ALL '.join(more)}),
    b AS (SELECT r, {line} AS line, {counts} FROM base GROUP BY r), a AS (SELECT r, {line} AS line FROM every GROUP BY r)
    SELECT doc_id, {', '.join(f'coalesce(n_{x[0]}, 0) AS n_{x[0]}' for x in secrets.KINDS)}, sha256(coalesce(b.line, '')) AS base_sha256, coalesce(a.line, '') AS spans
    FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r)"""


ORACLES = {"op2_embedding_near_dup": OP2, "op7_secret_scans": _secrets(), "op10_minhash_near_dup": OP10}

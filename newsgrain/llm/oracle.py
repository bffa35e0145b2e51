"""SQL that gives the rows of the exact operators by plain comparison of everything with everything, for the tables it fits."""

from __future__ import annotations

from .lookalike import look_sql

_LETTERS = "regexp_replace(lower(strip_accents(nfc_normalize({0}))), '[^\\p{{L}}]', '', 'g')"
_WORDS = "regexp_extract_all(lower(strip_accents({0})), '[\\p{{L}}\\p{{N}}]+')"
_LINES = f"""
    l AS (SELECT row_idx, CASE WHEN trim(coalesce(source_domain, '')) <> '' THEN source_domain END AS s, unnest(string_split(document, chr(10))) AS x, generate_subscripts(string_split(document, chr(10)), 1) - 1 AS line_no FROM clustered_data WHERE document IS NOT NULL),
    k AS (SELECT *, CASE WHEN s IS NOT NULL THEN {_LETTERS.format("x")} ELSE '' END AS k FROM l), f AS (SELECT s, k FROM k WHERE length(k) >= 12 GROUP BY s, k HAVING count(DISTINCT row_idx) >= 5)"""
_RUNS = f"""
    {_LINES}, b AS (SELECT row_idx, string_agg(x, chr(10) ORDER BY line_no) AS t FROM k ANTI JOIN f USING (s, k) GROUP BY 1), w AS (SELECT row_idx, {_WORDS.format(look_sql("t"))} AS w FROM b),
    r AS (SELECT DISTINCT row_idx, hash(g) AS g FROM (SELECT row_idx, unnest(list_transform(range(1, len(w) - 1), lambda q: array_to_string(w[q:q + 2], ' '))) AS g FROM w WHERE len(w) >= 3)),
    n AS (SELECT row_idx, count(*) AS n FROM r GROUP BY 1)"""
_NEAR = """c AS (SELECT a.row_idx AS row_a, b.row_idx AS row_b, count(*) AS c FROM {0} a JOIN {0} b ON a.g = b.g AND a.row_idx < b.row_idx GROUP BY 1, 2),
    p AS (SELECT row_a, row_b FROM c JOIN n x ON x.row_idx = row_a JOIN n y ON y.row_idx = row_b WHERE 2 * c >= x.n + y.n - c)"""
_LOOK = " UNION ALL ".join(f"SELECT '{c}' AS field_name, row_idx, {c} AS v, {look_sql(c)} AS l FROM clustered_data WHERE {c} IS NOT NULL" for c in ("title", "document"))
_LEAKS = f"""
    d AS (SELECT doc_id, {_WORDS.format(look_sql("text"))} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS.format(look_sql("text"))} AS w FROM eval_items WHERE text IS NOT NULL),
    dr AS (SELECT doc_id, unnest(range(1, len(w) - 10)) - 1 AS pos, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS r FROM d WHERE len(w) >= 12),
    ir AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS r FROM i WHERE len(w) >= 12),
    h AS (SELECT DISTINCT doc_id, item_id, pos FROM dr JOIN ir USING (r))"""

ORACLE: dict[str, str] = {
    "p2_found": f"WITH {_LINES} SELECT row_idx, line_no FROM k SEMI JOIN f USING (s, k)",
    "p3_found": f"WITH {_RUNS}, {_NEAR.format('r')} SELECT row_a, row_b FROM p",
    "p3_classes": f"""
        WITH {_RUNS}, o AS (SELECT row_idx, min(row_idx) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS members FROM (SELECT row_idx, hash(list(g ORDER BY g)) AS s FROM r GROUP BY 1)),
            rr AS (SELECT r.* FROM r JOIN o USING (row_idx) WHERE row_idx = class_id), {_NEAR.format('rr')}, k2 AS (SELECT class_id, count(*) AS links FROM (SELECT row_a AS class_id FROM p UNION ALL SELECT row_b FROM p) GROUP BY 1)
        SELECT row_idx, o.class_id, members, coalesce(links, 0) AS links FROM o LEFT JOIN k2 ON k2.class_id = o.class_id WHERE members > 1 OR links > 0""",
    "p4_found": f"""
        WITH v AS ({_LOOK}) SELECT a.field_name, a.row_idx AS row_a, b.row_idx AS row_b FROM v a JOIN v b ON a.field_name = b.field_name AND a.l = b.l AND a.row_idx < b.row_idx WHERE a.v <> b.v AND regexp_matches(a.l, '[^\\s]')""",
    "p4_classes": f"""
        WITH v AS ({_LOOK}), m AS (SELECT field_name, l, min(row_idx) AS class_id, count(*) AS members FROM v WHERE regexp_matches(l, '[^\\s]') GROUP BY 1, 2 HAVING count(DISTINCT v) > 1), s AS (SELECT field_name, l, v, count(*) AS same FROM v GROUP BY ALL)
        SELECT v.field_name, row_idx, class_id, members, members - same AS links FROM v JOIN m ON m.field_name = v.field_name AND m.l = v.l JOIN s ON s.field_name = v.field_name AND s.l = v.l AND s.v = v.v""",
    "p8_found": f"WITH {_LEAKS} SELECT DISTINCT doc_id, item_id FROM h",
    "p8_spans": f"""
        WITH {_LEAKS}, n AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id, item_id ORDER BY pos) + 12 THEN 0 ELSE 1 END AS fresh FROM h), s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS g FROM n)
        SELECT doc_id, item_id, min(pos) AS first_word, max(pos) - min(pos) + 12 AS n_words FROM s GROUP BY doc_id, item_id, g""",
}

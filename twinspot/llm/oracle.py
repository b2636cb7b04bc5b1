"""SQL of the queries on personal data, runs and vector codes, put together from parts."""

from __future__ import annotations

from . import pii, vector_codes

WORDS = r"[^\x20\x09-\x0D]+"

_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(s) + 1), lambda k: [ascii(s[k])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
 lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) END))"""


def periodic_runs() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, doc_id::VARCHAR AS s, coalesce(regexp_extract_all(text, '{WORDS}'), []) AS w FROM documents),
h AS (SELECT r, doc_id, w, len(w) AS n, {_CRC} AS h FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
u AS (SELECT r, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS x FROM (SELECT *, unnest(range(0, n)) AS i FROM p)),
t AS (SELECT r, n, list(x ORDER BY i) AS w FROM u GROUP BY r, n),
g AS (SELECT r, n, i, md5(array_to_string(w[i + 1 : i + 6], ' ')) AS g FROM (SELECT r, n, w, unnest(range(0, n - 5)) AS i FROM t)),
e AS (SELECT x.r, y.i - x.i AS q, x.i FROM g x JOIN g y ON x.r = y.r AND x.g = y.g AND y.i > x.i AND y.i - x.i <= x.n // 2),
l AS (SELECT r, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e) GROUP BY r, q, island),
o AS (SELECT r, start, length, min(q) AS q FROM l WHERE length >= greatest(12, 2 * q) GROUP BY r, start, length),
k AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS kept FROM u WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.r = u.r AND u.i >= o.start + o.q AND u.i < o.start + o.length) GROUP BY r),
f AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines,
 first(start ORDER BY length DESC, start, q) AS start, max(length) AS length, first(q ORDER BY length DESC, start, q) AS period FROM o GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN f USING (r) LEFT JOIN k USING (r)"""


def vector_code_table() -> str:
    """Every round compares each part with all entries; a distance and an entry are one number, so that ties go to the lower entry."""
    parts, entries, scale = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.SCALE
    near = f"""SELECT r, p.part, min(list_sum(list_transform(list_zip(p.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) * {entries} + b.entry) AS m FROM p JOIN {{book}} b ON b.part = p.part GROUP BY r, p.part"""
    steps = []
    for k in range(vector_codes.ROUNDS):
        steps.append(f"n{k} AS ({near.format(book=f'b{k}')})")
        steps.append(f"s{k} AS (SELECT part, m % {entries} AS entry, pos, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT n{k}.part, m, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS pos FROM n{k} JOIN p USING (r, part)) GROUP BY 1, 2, 3)")
        steps.append(f"c{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos)::BIGINT[] AS x FROM s{k} GROUP BY 1, 2)")
        steps.append(f"b{k + 1} AS (SELECT b.part, b.entry, coalesce(c.x, b.x) AS x FROM b{k} b LEFT JOIN c{k} c ON c.part = b.part AND c.entry = b.entry)")
    last = f"b{vector_codes.ROUNDS}"
    return f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x FROM (SELECT *, unnest(range(0, {parts})) AS part FROM e)),
b0 AS (SELECT part, r AS entry, x FROM p WHERE r < {entries}),
{", ".join(steps)},
z AS ({near.format(book=last)}),
f AS (SELECT r, string_agg(printf('%02x', m % {entries}), '' ORDER BY part) AS code, sum(m // {entries})::BIGINT AS error FROM z GROUP BY r),
t AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM {last})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM f JOIN e USING (r), t"""


_LUHN = """list_sum(list_transform(range(1, len(digits) + 1), lambda k: CASE WHEN k % 2 = 1 THEN reverse(digits)[k]::INT WHEN reverse(digits)[k]::INT > 4 THEN 2 * reverse(digits)[k]::INT - 9 ELSE 2 * reverse(digits)[k]::INT END)) % 10 = 0"""
_PARTS = "len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR (len(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0"
_TURNED = "replace(m, ' ', '')[5:] || replace(m, ' ', '')[1:4]"
_MOD = f"""list_reduce(list_prepend(0::BIGINT, list_transform(string_split({_TURNED}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END::BIGINT)),
 lambda a, x: (a * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97) = 1"""
#: (pattern, which matches are candidates, which of these hold) in the order of the rules; digits are those of the match.
_SQL_RULES = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", "true"),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "true", _PARTS),
    (r"[0-9]([\x20-]?[0-9])+", "len(digits) BETWEEN 16 AND 19", _LUHN),
    (r"\+[0-9][\x20().0-9-]+[0-9]", "true", "len(digits) BETWEEN 8 AND 15"),
    (r"[0-9]([\x20-]?[0-9])+", "len(digits) BETWEEN 13 AND 15", _LUHN),
    (r"(?:\([0-9]{3}\) ?|\b[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}\b", "true", "true"),
    (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{0,2}[0-9])?\b", "true", _MOD),
    (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "true", "NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')"),
)


def private_data() -> str:
    names, upper, lower = [], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ctes = ["d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"]
    for k, (rule, (pattern, candidate, valid)) in enumerate(zip(pii.RULES, _SQL_RULES, strict=True)):
        ctes.append(f"""m{k} AS (SELECT r, text, m, regexp_replace(m, '[^0-9]', '', 'g') AS digits, sum(len(g) + len(m)) OVER (PARTITION BY r ORDER BY k) - len(m) AS a FROM
 (SELECT r, text, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(string_split_regex(text, '{pattern}')) AS g, unnest(range(0, len(string_split_regex(text, '{pattern}')))) AS k FROM d) WHERE m IS NOT NULL)""")
        ctes.append(f"""c{k} AS (SELECT *, a + len(m) AS b, coalesce(lag(a + len(m)) OVER (PARTITION BY r ORDER BY a), 0) AS since, coalesce(lead(a) OVER (PARTITION BY r ORDER BY a), len(text)) AS upto FROM m{k} WHERE {candidate})""")
        near = f"translate(text[greatest(since, a - {pii.BEFORE}) + 1 : a] || ' ' || text[b + 1 : least(upto, b + {pii.AFTER})], '{upper}', '{lower}')"
        said = lambda words: f"regexp_matches(near, '{pii.said(words)}')"
        score = f"least(100, greatest(0, {rule.prior} + CASE WHEN {said(pii.NEAR[rule.kind])} THEN {pii.STEP} ELSE 0 END - CASE WHEN {said(pii.AGAINST)} THEN {pii.STEP} ELSE 0 END))"
        ctes.append(f"s{k} AS (SELECT r, '{rule.kind}' AS kind, a::BIGINT AS a, b::BIGINT AS b, {score} AS score, {rule.base} AS base FROM (SELECT *, {near} AS near FROM c{k} WHERE {valid}))")
        if rule.base:
            names.append(f"SELECT * FROM s{k}")
        else:
            ctes.append(f"t{k} AS (SELECT * FROM s{k} WHERE score >= {pii.LEAST} AND NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(names)}) o WHERE o.r = s{k}.r AND o.a < s{k}.b AND s{k}.a < o.b))")
            names.append(f"SELECT * FROM t{k}")
    order = f"list_position({list(pii.KINDS)}, kind), a"
    counts = ", ".join(f"count(*) FILTER (base AND kind = '{k}') AS n_{k}" for k in pii.KINDS[:4])
    ctes.append(f"""f AS (SELECT r, {counts}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY {order}) FILTER (base) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY {order}) AS spans,
 string_agg(score, ',' ORDER BY {order}) AS scores FROM ({' UNION ALL '.join(names)}) GROUP BY r)""")
    found = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.KINDS[:4])
    return f"WITH {', '.join(ctes)} SELECT doc_id, {found}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN f USING (r)"


SQL = {"op11_private_data": private_data(), "op12_periodic_runs": periodic_runs(), "op13_vector_codes": vector_code_table()}

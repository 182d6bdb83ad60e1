"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import quality_rules, secrets, url_filter

OP6 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

OP9 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
  FROM d
), u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (
  SELECT a.doc_id AS i, b.doc_id AS j FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r(i, j) AS (SELECT i, j FROM p UNION SELECT r.i, p.j FROM r JOIN p ON r.j = p.i),
c AS (SELECT i, min(j) AS m FROM r GROUP BY i)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) AS kept
FROM s LEFT JOIN c ON c.i = s.doc_id
"""


def op2() -> str:
    """Rules, then the two models: counts of every string of up to ORDER + 1 characters, in each half and in both."""
    order, back = url_filter.ORDER, url_filter.BACK
    fits = []
    for verdict, rule in sorted(url_filter.RULES, key=lambda r: -len(r[1])):
        name, _, prefix = rule.partition("/")
        fits.append((f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{prefix}')", rule, verdict))
    sets = {"yes0": "verdict = 'allow' AND half = 0", "no0": "verdict = 'block' AND half = 0", "yes1": "verdict = 'allow' AND half = 1", "no1": "verdict = 'block' AND half = 1", "yes": "verdict = 'allow'", "no": "verdict = 'block'"}
    counts = ", ".join(f"count(*) FILTER ({cond}) AS {name}" for name, cond in sets.items())
    levels = []
    for k in range(order + 1):
        shorter = {name: f"s.{name}" if k else str(1.0 / url_filter.ALPHABET) for name in sets}
        chances = ", ".join(f"(c.{name} + {back} * {shorter[name]}) / (t.{name} + {back}) AS {name}" for name in sets)
        join = f"JOIN p{k - 1} s ON s.seen = substr(c.seen, 2)" if k else ""
        levels.append(f"""c{k} AS (SELECT right(gram, {k + 1}) AS seen, {counts} FROM g GROUP BY 1),
t{k} AS (SELECT substr(seen, 1, {k}) AS context, {", ".join(f"sum({n}) AS {n}" for n in sets)} FROM c{k} GROUP BY 1),
p{k} AS (SELECT c.seen, {chances} FROM c{k} c JOIN t{k} t ON t.context = substr(c.seen, 1, {k}) {join})""")
    nl = ",\n"
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
q AS (SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE {" ".join(f"{c} THEN '{rule}'" for c, rule, _ in fits)} END AS rule, CASE {" ".join(f"{c} THEN '{verdict}'" for c, _, verdict in fits)} END AS verdict FROM q),
d AS (SELECT DISTINCT url, verdict, CASE WHEN md5(url) < '8' THEN 0 ELSE 1 END AS half, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE url END AS t FROM r),
x AS (SELECT *, repeat(chr(2), {order}) || t || chr(3) AS padded FROM d),
g AS (SELECT url, verdict, half, substr(padded, unnest(range(1, length(t) + 2)), {order + 1}) AS gram FROM x),
{nl.join(levels)},
s AS (SELECT g.url, any_value(g.verdict) AS verdict, avg(ln(p.yes) - ln(p.no)) AS score, avg(CASE WHEN half = 0 THEN ln(p.yes1) - ln(p.no1) ELSE ln(p.yes0) - ln(p.no0) END) AS held FROM g JOIN p{order} p ON p.seen = g.gram GROUP BY g.url),
m AS (SELECT avg(held) FILTER (verdict = 'allow') AS a, avg(held) FILTER (verdict = 'block') AS b,
  coalesce(stddev_samp(held) FILTER (verdict = 'allow'), 0) + 1e-6 AS x, coalesce(stddev_samp(held) FILTER (verdict = 'block'), 0) + 1e-6 AS y FROM s)
SELECT page_id, host, path, rule, coalesce(r.verdict, CASE WHEN score >= coalesce((a * y + b * x) / (x + y), 0) THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score
FROM r JOIN s USING (url), m
"""


def _found(kind: str, pattern: str) -> str:
    """Matches and the pieces between them."""
    p = pattern.replace("'", "''")
    return f"regexp_extract_all(t, '{p}') AS m_{kind}, string_split_regex(t, '{p}') AS g_{kind}"


def _spans(kind: str, good: str = "true") -> str:
    no, m, g = secrets.KINDS.index(kind), f"m_{kind}", f"g_{kind}"
    begin = f"(list_sum(list_transform({g}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({m}[1:i - 1], lambda x: length(x))), 0))::INT"
    return (
        f"list_filter(list_transform(range(1, len({m}) + 1), lambda i: {{'a': {begin}, 'k': {no}, 'b': ({begin} + length({m}[i]))::INT, 'ok': {good.replace('MATCH', m + '[i]')}}}), lambda s: s.ok) AS {kind}"
    )


def _has(kinds: str, part: str) -> str:
    """Whether a part of these lists lies in the scope of ``part``."""
    return f"len(list_filter({kinds}, lambda o: len(list_filter(border, lambda x: x.b <= o.a)) = len(list_filter(border, lambda x: x.b <= {part}.a)))) > 0"


def _listed(spans: str) -> str:
    names = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS[:6]) + "]"
    return f"coalesce(array_to_string(list_transform(list_sort({spans}), lambda s: {names}[s.k + 1] || ':' || s.a || ':' || s.b), ','), '')"


def op10() -> str:
    patterns = {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX, "account": secrets.ACCOUNT, "opaque": secrets.OPAQUE, "endpoint": secrets.ENDPOINT, "border": secrets.BORDER}
    assign = secrets.ASSIGN.replace("'", "''")
    good = {"assign": f"length(regexp_extract(MATCH, '{assign}', 1)) >= 6", "opaque": "regexp_matches(MATCH, '[0-9]') AND regexp_matches(MATCH, '[A-Z]') AND regexp_matches(MATCH, '[a-z]')"}
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {', '.join(_found(k, p) for k, p in patterns.items())} FROM d),
s AS (SELECT doc_id, {', '.join(_spans(k, good.get(k, 'true')) for k in patterns)} FROM f),
b AS (SELECT *, assign || access || hex AS base, list_filter(opaque, lambda o: len(list_filter(assign || access || hex, lambda x: x.a < o.b AND o.a < x.b)) = 0) AS clear FROM s),
w AS (SELECT *,
  list_filter(account, lambda e: {_has('assign || hex || clear', 'e')}) AS accounts,
  list_filter(clear, lambda e: {_has('access || account', 'e')} OR {_has('endpoint', 'e')}) AS opaques,
  list_filter(endpoint, lambda e: {_has('assign || hex || clear', 'e')} AND {_has('access || account', 'e')}) AS endpoints
FROM b)
SELECT doc_id, len(assign)::BIGINT AS n_assign, len(access)::BIGINT AS n_access, len(hex)::BIGINT AS n_hex,
       sha256({_listed('base')}) AS base_sha256, {_listed('base || accounts || opaques || endpoints')} AS spans
FROM w
"""


def op11() -> str:
    """Windows are compared as strings; line counts by host over distinct texts."""
    s, w = r"\x20\x09-\x0D", quality_rules.WINDOW
    norm = f"regexp_replace(translate(trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '{quality_rules.CAPITALS}', '{quality_rules.LETTERS}'), '[{s}]+', ' ', 'g')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
x AS (SELECT r, doc_id, host, t, regexp_extract_all(t, '[^{s}]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{s}]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - {w - 2})) AS i, unnest(list_transform(range(1, len(w) - {w - 2}), lambda i: array_to_string(w[i:i + {w - 1}], ' '))) AS g FROM x WHERE len(w) > {w}),
q AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
p AS (SELECT r, count(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + {w})) AS k FROM q WHERE n > 1) GROUP BY r),
u AS (SELECT DISTINCT host, t, l FROM x WHERE len(l) > 0),
e AS (SELECT host, t, {norm} AS h, len(regexp_extract_all(x, '[^{s}]+')) AS n FROM (SELECT host, t, unnest(l) AS x FROM u)),
f AS (SELECT host, h FROM e JOIN (SELECT host, count(*) AS documents FROM u GROUP BY host) USING (host) GROUP BY host, h, documents
  HAVING count(DISTINCT t) >= {quality_rules.LEAST} AND count(DISTINCT t) > {quality_rules.SHARE} * documents),
o AS (SELECT host, t, sum(n)::BIGINT AS removed_words FROM e JOIN f USING (host, h) GROUP BY host, t),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '{quality_rules.SYMBOLS}'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM x LEFT JOIN p USING (r) LEFT JOIN o USING (host, t))
SELECT *, n_words < {quality_rules.FEWEST_WORDS} OR 100 * n_repeat_words > {quality_rules.REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality_rules.FEWEST_WORDS} OR 100 * n_repeat_words > {quality_rules.REPEATED_PERCENT} * n_words) AND removed_words <= {quality_rules.DEPLETED} * n_words AS kept
FROM m
"""


def op12(k: int = 8, size: int = 64, scale: int = 1024, rounds: int = 10) -> str:
    """Every vector against every centroid, round after round."""
    distance = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT r, vec_id, v, min(struct_pack(d := d, c := c)) AS b FROM (SELECT x.r, x.vec_id, x.v, c.c, {distance} AS d FROM x, c{r} c) GROUP BY r, vec_id, v)")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT c, i, sum(e)::HUGEINT AS s, count(*) AS n FROM (SELECT b.c AS c, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i),
m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)""")
    nl = ",\n"
    return f"""
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: floor({scale} * y::DOUBLE)::BIGINT) AS v FROM e),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM x QUALIFY c < {k}),
{nl.join(steps)},
t AS (SELECT b.c AS c, sum(b.d)::BIGINT AS own FROM a{rounds} GROUP BY 1)
SELECT vec_id, b.c::INT AS cluster, b.d AS distance, own AS cluster_inertia, (SELECT sum(own)::BIGINT FROM t) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN t ON t.c = a.b.c JOIN c{rounds} f ON f.c = a.b.c
"""

"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from quarry.llm import quality, urls


def _op1() -> str:
    rules = list(quality.RULES)
    counts = ", ".join(f"count(*) FILTER ({e}) AS {r}" for r, e in quality.RULES.items())
    moments = ", ".join(f"sum({r}) / sum(n)::double AS m_{r}" for r in rules)
    spreads = ", ".join(f"sum(n * ({r} / n::double - m_{r}) * ({r} / n::double - m_{r})) / sum(n)::double AS v_{r}" for r in rules)
    strengths = ", ".join(f"CASE WHEN v_{r} > 0 THEN least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 2.0), 1000.0) ELSE 1000.0 END AS s_{r}" for r in rules)
    post = {r: f"(({r} + m_{r} * s_{r}) / (n + s_{r}))" for r in rules}
    low = ", ".join(f"{p} - 2.0 * sqrt({p} * (1 - {p}) / (n + s_{r} + 1))" for r, p in post.items())
    return rf"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT k, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
twice AS (SELECT k, unnest(is_) AS i FROM (SELECT k, list(i) AS is_ FROM g WHERE w3 IS NOT NULL GROUP BY k, w, w2, w3 HAVING count(*) > 1)),
rep AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(3) t(j) GROUP BY k),
lines AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
f AS (SELECT d.k, doc_id, host, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN lines USING (k) LEFT JOIN rep USING (k)),
h AS (SELECT host, count(*) AS n, {counts} FROM f WHERE host IS NOT NULL GROUP BY host), m AS (SELECT {moments} FROM h), v AS (SELECT {spreads} FROM h, m), s AS (SELECT *, {strengths} FROM m, v),
verdict AS (SELECT host, greatest({low}) AS bound FROM h, s)
SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols, n_dup_lines::bigint AS n_dup_lines, n_repeat_words::bigint AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(bound > 0.5, false) AS kept, coalesce(bound > 0.5, false) AS host_rejected, round(bound, 6) AS host_bound
FROM f LEFT JOIN verdict USING (host)"""


def _op2() -> str:
    rule = verdict = ""
    for text, says in sorted(urls.RULES, key=lambda x: (-len(x[0]), x[0])):
        name, slash, rest = text.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}')"
        rule += f" WHEN {fits} THEN '{text}'"
        verdict += f" WHEN {fits} THEN '{says}'"
    two = r"regexp_extract(regexp_replace(host, ':[0-9]*$', ''), '[^.]*\.[^.]*$', 0)"
    long = f"{two} IN ({', '.join(repr(x) for x in urls.SUFFIXES)})"
    name = "regexp_replace(host, ':[0-9]*$', '')"
    strength = lambda t, k: f"{k} AS (SELECT CASE WHEN v > 0 THEN least(greatest(m / v - 1, 1.0), 1000.0) ELSE 1000.0 END AS {k} FROM (SELECT sum(n * (bad / n::double - parent) * (bad / n::double - parent)) AS v, sum(n * parent * (1 - parent)) AS m FROM {t} WHERE n > 0))"
    return rf"""WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, CASE WHEN {long} THEN regexp_extract({name}, '([^.]*\.)?[^.]*\.[^.]*$', 0) ELSE regexp_extract({name}, '([^.]*\.)?[^.]*$', 0) END AS domain, CASE WHEN {long} THEN {two} ELSE regexp_extract({name}, '[^.]*$', 0) END AS suffix FROM p LEFT JOIN o USING (page_id) GROUP BY host),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h0 GROUP BY 1, 2), s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d0 GROUP BY 1),
s AS (SELECT *, (SELECT coalesce(sum(bad) / nullif(sum(n), 0)::double, 0) FROM s0) AS parent FROM s0), {strength("s", "k0")},
d AS (SELECT d0.*, (s.bad + k0 * s.parent) / (s.n + k0) AS parent FROM d0 JOIN s USING (suffix), k0), {strength("d", "k1")},
h AS (SELECT h0.*, (d.bad + k1 * d.parent) / (d.n + k1) AS parent FROM h0 JOIN d USING (domain, suffix), k1), {strength("h", "k2")},
hp AS (SELECT host, n + k2 AS nk, (bad + k2 * parent) / (n + k2) AS post FROM h, k2),
hb AS (SELECT host, post, post - 1.64 * sqrt(post * (1 - post) / (nk + 1)) AS low FROM hp)
SELECT page_id, host, path, CASE{rule} END AS rule, coalesce(CASE{verdict} END, CASE WHEN low > 0.35 THEN 'block' ELSE 'allow' END) AS verdict, round(post, 6) AS bad_rate, round(low, 6) AS bad_bound FROM p LEFT JOIN hb USING (host)"""


#: The level of the targets is found by trying each number of sources at their cap, in the order in which they reach it.
_OP7 = r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce('s' || source, 't') AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size, md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) AS digest FROM documents),
s AS (SELECT key, sum(size)::bigint AS source_size FROM d GROUP BY key), w AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS turn, (row_number() OVER (ORDER BY key) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, 3 * source_size / weight::double AS at_level FROM w),
c AS (SELECT a.at_level, coalesce(sum(3 * b.source_size) FILTER (b.at_level < a.at_level), 0) AS capped, sum(b.weight) FILTER (b.at_level >= a.at_level) AS open FROM (SELECT DISTINCT at_level FROM o) a, o b GROUP BY a.at_level),
l AS (SELECT arg_min(((SELECT sum(source_size) FROM s) - capped) / open, at_level) AS level FROM c WHERE ((SELECT sum(source_size) FROM s) - capped) / open < at_level),
g AS (SELECT key, source_size, turn, CASE WHEN 3 * source_size <= weight * level THEN (3 * source_size)::double ELSE weight * level END AS target FROM w, l),
e AS (SELECT coalesce(sum(target) FILTER (turn % 2 = 0), 0) AS even, coalesce(sum(target) FILTER (turn % 2 = 1), 0) AS odd FROM g),
t AS (SELECT *, CASE WHEN turn % 2 = 0 THEN 0.5::double * least(1.0::double, odd / nullif(even, 0)) ELSE -0.5::double * least(1.0::double, even / nullif(odd, 0)) END AS a FROM g, e),
r AS (SELECT doc_id, size, source_size, target, a, floor(target / greatest(source_size, 1)) AS whole, coalesce(sum(size) OVER (PARTITION BY key ORDER BY digest, doc_id, size, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN t USING (key)),
p AS (SELECT *, least(coalesce(start / nullif(target, 0), 0), 1.0::double) AS y, 1 - a AS b FROM r)
SELECT doc_id, size, source_size, target, round(2 * y / (b + sqrt(b * b + 4 * a * y)), 9) AS position, (size * whole + least(greatest(floor(target - whole * source_size) - start, 0), size))::bigint AS taken FROM p"""

_OP8 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2]))::bigint AS score FROM q, v WHERE q.vec_id <> v.vec_id AND len(q.v) = len(v.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank, vec_id, score FROM s QUALIFY rank <= 10"""

_OP11 = r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
z AS (SELECT count(*) FILTER (len(ts) > 0) AS n_all, sum(len(ts))::bigint AS l_all FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(ts) AS t FROM d) GROUP BY k, t),
w AS (SELECT t, floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1)::double))::bigint AS w FROM p, z GROUP BY t, n_all),
s AS (SELECT item_id, k, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(ts) * n_all) // l_all))))::bigint AS score FROM q JOIN w USING (t) JOIN p USING (t) JOIN d USING (k), z GROUP BY item_id, k)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::int AS rank, doc_id, score FROM s JOIN d USING (k) WHERE score > 0 QUALIFY rank <= 50"""

SQL: dict[str, str] = {"op1_quality_rules": _op1(), "op2_url_filters": _op2(), "op7_mixing": _OP7, "op8_exact_topk": _OP8, "op11_lexical_search": _OP11}

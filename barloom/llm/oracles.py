"""SQL of the vector operators and the quality rules: by definition, without what makes the operators cheap."""

from __future__ import annotations

from . import riskrules


def _means(previous: str, name: str, group: str) -> str:
    """The floor of the mean of x by `group`, component by component, over the table `previous`."""
    return f"{name} AS MATERIALIZED (SELECT {group}, list(m ORDER BY i) AS x FROM (SELECT {group}, i, floor(sum(y) / count(*)) AS m FROM (SELECT {group}, unnest(x) AS y, unnest(range(len(x))) AS i FROM {previous}) GROUP BY {group}, i) GROUP BY {group})"


def ball_means(k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """Every vector is compared with every centroid; products of whole numbers are exact in doubles."""
    sound = "list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))"
    out = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings WHERE len(embedding) = 64 AND {sound})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        near = f"SELECT rn, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.rn, k.c, list_inner_product(v.x, v.x) + list_inner_product(k.x, k.x) - 2 * list_inner_product(v.x, k.x) AS d FROM v, c{i} k) GROUP BY rn"
        out.append(f"a{i} AS MATERIALIZED (SELECT v.rn, v.vec_id, v.x, n.c, n.d FROM v JOIN ({near}) n ON n.rn = v.rn)")
        if i < rounds:
            out += [_means(f"a{i}", f"m{i}", "c"), f"c{i + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.x, k.x) AS x FROM c{i} k LEFT JOIN m{i} m ON m.c = k.c)"]
    seal = "sha256(array_to_string(list_transform(k.x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','))"
    return f"""WITH {', '.join(out)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, {seal} AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} k ON k.c = a.c"""


def segment_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Every part is compared with every entry of its codebook."""
    sound = "len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))"
    out = [
        f"v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, y) AS rn, vec_id, label, y FROM (SELECT vec_id, label, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)) AS y FROM embeddings WHERE {sound}))",
        f"p AS MATERIALIZED (SELECT rn, p, y[p * (len(y) // {parts}) + 1 : (p + 1) * (len(y) // {parts})] AS x FROM (SELECT rn, y, unnest(range({parts})) AS p FROM v))",
        f"e0 AS MATERIALIZED (SELECT p, rn - 1 AS e, x FROM p WHERE rn <= {entries})",
    ]
    for i in range(rounds + 1):
        near = f"SELECT rn, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT p.rn, p.p, k.e, list_inner_product(p.x, p.x) + list_inner_product(k.x, k.x) - 2 * list_inner_product(p.x, k.x) AS d FROM p JOIN e{i} k ON k.p = p.p) GROUP BY rn, p"
        out.append(f"a{i} AS MATERIALIZED (SELECT p.rn, p.p, p.x, n.e, n.d FROM p JOIN ({near}) n ON n.rn = p.rn AND n.p = p.p)")
        if i < rounds:
            out += [_means(f"a{i}", f"m{i}", "p, e"), f"e{i + 1} AS MATERIALIZED (SELECT k.p, k.e, coalesce(m.x, k.x) AS x FROM e{i} k LEFT JOIN m{i} m ON m.p = k.p AND m.e = k.e)"]
    return f"""WITH {', '.join(out)},
coded AS (SELECT rn, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rn),
seal AS (SELECT sha256(string_agg(s, ',' ORDER BY p, e)) AS s FROM (SELECT p, e, array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ',') AS s FROM e{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT s FROM seal) AS codebooks_sha256 FROM v JOIN coded ON coded.rn = v.rn"""


def risk_rules() -> str:
    """Windows are counted as texts, cutoffs are tried one by one, and the binomial sum has its factorials."""
    window = riskrules.WINDOW
    each = [(r, j, condition.format(c=c)) for r, (condition, cutoffs) in enumerate(riskrules.RULES.values()) for j, c in enumerate(cutoffs, 1)]
    hits = " UNION ALL ".join(f"SELECT rn, stratum, half, good, {r} AS rule, {j} AS j, {condition} AS hit FROM based WHERE NOT base_failed" for r, j, condition in each)
    risk = f"{riskrules.RISK}::DOUBLE"
    tail = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk}))))"
    return f"""WITH
t AS (SELECT row_number() OVER () AS rn, doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rn, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM t
),
windows AS (SELECT rn, i, array_to_string(w[i : i + {window - 1}], ' ') AS g FROM (SELECT rn, w, unnest(range(1, len(w) - {window - 2})) AS i FROM w WHERE len(w) >= {window})),
again AS (SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest(range(i, i + {window})) AS p FROM (SELECT rn, i FROM windows QUALIFY count(*) OVER (PARTITION BY rn, g) > 1)) GROUP BY rn),
measured AS (
  SELECT t.rn, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words FROM t JOIN w ON w.rn = t.rn LEFT JOIN again ON again.rn = t.rn
),
known AS (SELECT doc_id, bool_or(quality >= 1) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
based AS MATERIALIZED (
  SELECT m.*, good, substr(sha256(CAST(m.doc_id AS VARCHAR)), 1, 1) >= '8' AS half, n_words < {riskrules.LEAST_WORDS} OR 100 * n_repeat_words > {riskrules.MOST_REPEATED} * n_words AS base_failed
  FROM measured m LEFT JOIN known ON known.doc_id = m.doc_id
),
hits AS MATERIALIZED ({hits}),
sizes AS (SELECT stratum, count_if(good) AS goods FROM based WHERE NOT base_failed AND NOT half GROUP BY stratum),
tripped AS (SELECT stratum, rule, j, count_if(good AND hit) AS goods, count_if(NOT good AND hit) AS bads FROM hits WHERE NOT half AND good IS NOT NULL GROUP BY stratum, rule, j),
configured AS (
  SELECT tr.stratum, tolerance, rule, arg_max(j, (bads, -j)) AS j FROM tripped tr JOIN sizes s ON s.stratum = tr.stratum, (SELECT unnest({[*riskrules.TOLERANCES]}) AS tolerance)
  WHERE bads > 0 AND 1000 * tr.goods <= tolerance * s.goods GROUP BY tr.stratum, tolerance, rule
),
trials AS (SELECT h.stratum, tolerance, rn, any_value(good) AS good, bool_or(hit) AS hit FROM hits h JOIN configured c ON c.stratum = h.stratum AND c.rule = h.rule AND c.j = h.j WHERE half AND good IS NOT NULL GROUP BY h.stratum, tolerance, rn),
tests AS (SELECT stratum, tolerance, CAST(count_if(good AND hit) AS BIGINT) AS k, count_if(good) AS n, count_if(NOT good AND hit) AS bads FROM trials GROUP BY stratum, tolerance),
passed AS (
  SELECT stratum, arg_max(tolerance, (bads, -tolerance)) AS tolerance FROM tests
  WHERE k <= n * {risk} AND {tail} <= {riskrules.DOUBT}::DOUBLE / (SELECT greatest(1, count(DISTINCT stratum)) FROM based WHERE half AND good AND NOT base_failed) GROUP BY stratum
),
rejected AS (SELECT DISTINCT rn FROM hits h JOIN passed p ON p.stratum = h.stratum JOIN configured c ON c.stratum = h.stratum AND c.tolerance = p.tolerance AND c.rule = h.rule AND c.j = h.j WHERE hit)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rn NOT IN (SELECT rn FROM rejected) AS kept, b.stratum, coalesce(p.tolerance, -1) AS tolerance
FROM based b LEFT JOIN passed p ON p.stratum = b.stratum"""

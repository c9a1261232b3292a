"""DuckDB SQL of the iterative operators: each round or level is a few common tables of its own."""

from __future__ import annotations

FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
MEAN = "coalesce((s - ((s % n) + n) % n) // n, c)"


def clusters(k: int = 8, rounds: int = 10, scale: int = 1024, dimensions: int = 64, seed: str = "3") -> str:
    """Every round compares all vectors with all centroids."""
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, sha256('{seed}:' || vec_id) AS h, list_transform(embedding, lambda x: floor({scale}::DOUBLE * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE len(embedding) = {dimensions} AND {FINITE})",
        "x AS MATERIALIZED (SELECT r, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v)",
        f"c0 AS MATERIALIZED (SELECT k, unnest(e) AS c, generate_subscripts(e, 1) AS i FROM (SELECT row_number() OVER (ORDER BY h NULLS LAST, e) - 1 AS k, e FROM v QUALIFY k < {k}))",
    ]
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, k, d FROM (SELECT r, k, sum((x - c) * (x - c)) AS d FROM x JOIN c{t} USING (i) GROUP BY r, k) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if t < rounds:
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT k, i, {MEAN} AS c FROM c{t} LEFT JOIN (SELECT k, i, sum(x) AS s, count(*) AS n FROM a{t} JOIN x USING (r) GROUP BY k, i) USING (k, i))")
    steps.append(f"h AS (SELECT k, sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)")
    return f"WITH {', '.join(steps)} SELECT vec_id, k::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM v JOIN a{rounds} USING (r) JOIN h USING (k)"


def codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Every round compares all parts with all entries."""
    steps = [
        f"f AS MATERIALIZED (SELECT vec_id, label, embedding FROM embeddings WHERE {FINITE})",
        f"w AS (SELECT len(embedding) AS w FROM f WHERE len(embedding) > 0 AND len(embedding) % {parts} = 0 GROUP BY w ORDER BY count(*) DESC, w LIMIT 1)",
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, w // {parts} AS z, list_transform(embedding, lambda x: floor({scale}::DOUBLE * x::DOUBLE)::BIGINT) AS e FROM f, w WHERE len(embedding) = w)",
        "x AS MATERIALIZED (SELECT r, x, (i - 1) // z AS p, (i - 1) % z AS i FROM (SELECT r, z, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v))",
        f"c0 AS MATERIALIZED (SELECT p, k, i, x AS c FROM x JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS k FROM v QUALIFY k < {entries}) USING (r))",
    ]
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, p, k, d FROM (SELECT r, p, k, sum((x - c) * (x - c)) AS d FROM x JOIN c{t} USING (p, i) GROUP BY r, p, k) QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, k) = 1)")
        if t < rounds:
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT p, k, i, {MEAN} AS c FROM c{t} LEFT JOIN (SELECT p, k, i, sum(x) AS s, count(*) AS n FROM a{t} JOIN x USING (r, p) GROUP BY p, k, i) USING (p, k, i))")
    steps.append(f"h AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, k, i)) AS codebooks_sha256 FROM c{rounds})")
    steps.append(f"o AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d) AS error FROM a{rounds} GROUP BY r)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error::BIGINT AS error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN o USING (r), h"


def url_verdicts(rules: list[tuple[bool, str, str]], levels: int, many: int, apart: float, deviations: float, weight: float, prior: float, reject: float) -> str:
    """The tree level by level, with the fixed values of the operator."""
    fit = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{h + p}'" for _, h, p in ordered) + " END"
    allow = "CASE " + " ".join(f"WHEN {fit(h, p)} THEN {str(a).lower()}" for a, h, p in ordered) + " END"
    steps = [
        r"u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)",
        "s AS (SELECT *, list_transform(string_split(path, '/')[2:], lambda x: CASE WHEN regexp_matches(x, '^[0-9a-fA-F-]{16,}$') THEN '#' ELSE regexp_replace(x, '[0-9]+', '#', 'g') END) AS parts FROM u)",
        f"q AS MATERIALIZED (SELECT *, CASE WHEN len(parts) > {levels} THEN parts[1:{levels - 1}] || [array_to_string(parts[{levels}:], '/')] ELSE parts END AS shape, try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS doc FROM s)",
        "l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id)",
        "t0 AS MATERIALIZED (SELECT host, shape, count(*)::DOUBLE AS n, count(l.bad)::DOUBLE AS labelled, coalesce(sum(l.bad), 0)::DOUBLE AS bad, '' AS done FROM q LEFT JOIN l ON q.doc = l.doc_id GROUP BY host, shape)",
    ]
    for k in range(levels):
        steps += [
            f"h{k} AS MATERIALIZED (SELECT *, shape[{k + 1}] AS seg, coalesce(array_to_string(shape[{k + 2}:], '/'), '') AS rest FROM t{k} WHERE len(shape) > {k})",
            f"f{k} AS MATERIALIZED (SELECT host, done, seg, rest, sum(n) AS m, sum(labelled) AS labelled, sum(bad) AS bad FROM h{k} GROUP BY ALL)",
            f"b{k} AS MATERIALIZED (SELECT host, done, seg, sum(m) AS n, sum(labelled) AS labelled, sum(bad) AS bad, count(*) AS kinds, first(rest ORDER BY m DESC, rest DESC) AS leads FROM f{k} GROUP BY ALL)",
            f"n{k} AS (SELECT host, done, count(*) AS segs, sum(n) AS all_n, (sum(bad) + 1) / (sum(labelled) + 2) AS pool FROM b{k} GROUP BY ALL)",
            f"o{k} AS (SELECT *, (bad - labelled * pool) / sqrt(greatest(1, labelled * pool * (1 - pool))) AS off FROM b{k} JOIN n{k} USING (host, done))",
            f"w{k} AS MATERIALIZED (SELECT host, done, seg, n, kinds, leads, CASE WHEN off < -{deviations} THEN '-' WHEN off > {deviations} THEN '+' ELSE '' END AS side, segs > {many} AND n * {many} < all_n AS variable FROM o{k})",
            f"r{k} AS (SELECT w.*, rest, m FROM f{k} JOIN w{k} w USING (host, done, seg) WHERE NOT variable)",
            f"p{k} AS (SELECT host, done, leads, side, rest, sum(m) AS pooled FROM r{k} GROUP BY ALL)",
            f"y{k} AS (SELECT host, done, leads, side, count(*) AS members, sum(n) AS group_n FROM w{k} WHERE NOT variable GROUP BY ALL)",
            f"d{k} AS (SELECT host, done, seg, members, round(sum(greatest(0, m / n - pooled / group_n)), 9) AS apart FROM r{k} JOIN p{k} USING (host, done, leads, side, rest) JOIN y{k} USING (host, done, leads, side) GROUP BY ALL)",
            f"m{k} AS MATERIALIZED (SELECT host, done, seg, CASE WHEN variable THEN '*' WHEN members > 1 AND apart <= round({apart} + sqrt(kinds / n) / 2, 9) THEN '~' || side ELSE seg END AS name FROM w{k} LEFT JOIN d{k} USING (host, done, seg))",
            f"t{k + 1} AS MATERIALIZED (SELECT host, shape, n, labelled, bad, done || '/' || name AS done FROM h{k} JOIN m{k} USING (host, done, seg) UNION ALL SELECT host, shape, n, labelled, bad, done FROM t{k} WHERE len(shape) <= {k})",
        ]
    steps += [
        f"e AS (SELECT host, done, sum(labelled) AS labelled, sum(bad) AS bad FROM t{levels} GROUP BY ALL)",
        f"g AS (SELECT (sum(bad) + {weight} * {prior}) / (sum(labelled) + {weight}) AS whole FROM e)",
        f"j AS (SELECT host, (sum(bad) + {weight} * whole) / (sum(labelled) + {weight}) AS of_host FROM e, g GROUP BY host, whole)",
        f"z AS (SELECT host, done, (bad + {weight} * of_host) / (labelled + {weight}) AS share FROM e JOIN j USING (host))",
    ]
    return f"WITH {', '.join(steps)} SELECT page_id, q.host, path, {rule.replace('host', 'q.host')} AS rule, CASE WHEN coalesce({allow.replace('host', 'q.host')}, share < {reject}) THEN 'allow' ELSE 'block' END AS verdict, done AS template, round(share, 6) AS bad_share FROM q JOIN t{levels} USING (host, shape) JOIN z USING (host, done)"

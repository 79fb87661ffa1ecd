"""SQL of the longer kind: windows of benchmark items, rounds of k-means."""

from __future__ import annotations

WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

CONTAMINATION = rf"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS} AS words FROM documents),
    items AS (SELECT item_id, words, least(10, len(words)) AS size FROM (SELECT item_id, {WORDS} AS words FROM benchmark) WHERE len(words) > 0),
    item_windows AS (
        SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS w
        FROM items
    ), sizes AS (SELECT DISTINCT size FROM item_windows),
    stretches AS (
        SELECT r, size, unnest(range(1, len(words) - size + 2)) AS i,
            unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS w
        FROM d JOIN sizes ON len(words) >= size
    ), hits AS (SELECT r, i, size, w FROM stretches WHERE w IN (SELECT w FROM item_windows)),
    hit_words AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + size)) AS k FROM hits) GROUP BY r),
    hit_items AS (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits JOIN item_windows USING (w) WHERE item_id IS NOT NULL),
    listed AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM hit_items GROUP BY r)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(l.n, 0) AS n_items,
        sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit_words AS h ON d.r = h.r LEFT JOIN listed AS l ON d.r = l.r
"""


def clusters(k: int, dims: int, rounds: int) -> str:
    """Plain k-means in whole numbers, each round a pair of CTEs."""
    parts = [
        f"""v AS MATERIALIZED (
            SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )""",
        f"""c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v AS p
            FROM (SELECT v, sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v ORDER BY h, v LIMIT {k})
        )""",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (
            SELECT r, c, d FROM (
                SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place
                FROM (SELECT r, c, CAST(list_sum(list_transform(range(1, {dims + 1}), lambda j: (v[j] - p[j]) * (v[j] - p[j]))) AS BIGINT) AS d FROM v, c{i})
            ) WHERE place = 1
        )"""
        )
        if i < rounds:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (
            SELECT c, coalesce(moved, p) AS p FROM c{i} LEFT JOIN (
                SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS moved FROM (
                    SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
                    FROM (SELECT c, unnest(v) AS x, unnest(range(1, {dims + 1})) AS j FROM a{i} JOIN v USING (r)) GROUP BY c, j
                ) GROUP BY c
            ) USING (c)
        )"""
            )
    return f"""
        WITH {', '.join(parts)}
        SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(p, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (c)
    """

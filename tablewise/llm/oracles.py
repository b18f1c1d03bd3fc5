"""DuckDB SQL of the queries that SQL can express, each by another way than the operator's own."""

from __future__ import annotations

from . import licenses

WARC = """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
        FROM f"""

#: CRC-32 byte by byte; near words by the words that one deletion, or one wildcard, turns equal.
SPELLING = """
        WITH RECURSIVE steps AS MATERIALIZED (
            SELECT list(CAST(list_reduce(list_prepend(i, list_transform(range(8), lambda x: CAST(0 AS BIGINT))),
                                         lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS BIGINT) ORDER BY i) AS t
            FROM range(256) r(i)),
        runs AS MATERIALIZED (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
        keys AS (SELECT run, count(*) AS c, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
        bytes AS (SELECT run, c, list_transform(range(octet_length(encode(k))), lambda i: CAST(('0x' || substr(hex(encode(k)), 2 * i + 1, 2)) AS BIGINT)) AS b FROM keys),
        crc AS (SELECT run, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, x: xor(t[CAST(xor(a, x) & 255 AS INTEGER) + 1], a >> 8)), 4294967295) AS h FROM bytes, steps),
        results AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, c FROM crc),
        words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM results WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
        cuts AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
        pairs AS MATERIALIZED (
            SELECT a.word AS w, a.n AS n, b.word AS x, b.n AS m FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
            UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
        ranked AS (SELECT w, n, x, m, count(*) OVER (PARTITION BY w) AS n_near, row_number() OVER (PARTITION BY w ORDER BY m DESC, x) AS place FROM pairs),
        forms AS MATERIALIZED (SELECT w, n_near, CASE WHEN m >= 2 * n THEN x END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM ranked WHERE place = 1),
        walk AS (SELECT word, word AS at FROM words UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.w = walk.at AND forms.form IS NOT NULL),
        ends AS (SELECT walk.word, walk.at AS root FROM walk LEFT JOIN forms ON forms.w = walk.at WHERE forms.form IS NULL)
        SELECT words.word, form, root, n, coalesce(n_near, 0) AS n_near, form_n FROM words JOIN ends USING (word) LEFT JOIN forms ON forms.w = words.word"""


def centroid_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The rounds one after another, components as rows."""
    out = [f"""WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, CAST({seed} AS VARCHAR) || ':' || CAST(vec_id AS VARCHAR) AS key,
                   list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
        x AS MATERIALIZED (SELECT r, unnest(range({dims})) AS i, unnest(q) AS q FROM v),
        s AS (SELECT r, row_number() OVER (ORDER BY sha256(key), q) - 1 AS cluster FROM v),
        c0 AS MATERIALIZED (SELECT cluster, i, q AS c FROM s JOIN x USING (r) WHERE cluster < {k})"""]
    for n in range(rounds + 1):
        out.append(f"""d{n} AS (SELECT r, cluster, sum((q - c) * (q - c)) AS d FROM x JOIN c{n} USING (i) GROUP BY r, cluster),
        a{n} AS MATERIALIZED (SELECT r, cluster, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1)""")
        if n < rounds:
            out.append(f"""m{n} AS (SELECT cluster, i, sum(q) AS s, count(*) AS n FROM x JOIN a{n} USING (r) GROUP BY cluster, i),
        c{n + 1} AS MATERIALIZED (SELECT cluster, i, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster, i))""")
    last = rounds
    return ",\n        ".join(out) + f""",
        g AS (SELECT cluster, sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY cluster)
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{last} JOIN v USING (r) JOIN g USING (cluster)"""


def license_sql() -> str:
    """Every rule on every text; an interval goes if a self-join finds one around it."""
    def rows(items):
        return ", ".join("(" + ", ".join(str(x) if isinstance(x, (int, float)) else "'" + x + "'" for x in r) + ")" for r in items)

    rules = rows((i, r["level"], r["label"], r["pattern"]) for i, r in enumerate(licenses.RULES))
    base = rows((label, licenses.pattern(phrase)) for label, phrase in licenses.BASE.items())
    sure = rows(enumerate(licenses.CONFIDENCE))
    places = """list_transform(range(len(m)), lambda k: {'a': list_sum(list_transform(p[1:k + 1], lambda x: length(x) - length(replace(x, ' ', '')))) / 2
                                                             + coalesce(list_sum(list_transform(m[1:k], lambda x: length(x) - length(replace(x, ' ', '')))) / 2, 0),
                                                        'z': list_sum(list_transform(p[1:k + 1], lambda x: length(x) - length(replace(x, ' ', '')))) / 2
                                                             + list_sum(list_transform(m[1:k + 1], lambda x: length(x) - length(replace(x, ' ', '')))) / 2})"""
    return f"""
        WITH rules(rule, level, label, pat) AS (VALUES {rules}),
        base(label, pat) AS (VALUES {base}),
        sure(level, s) AS (VALUES {sure}),
        t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
            ' ' || trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g'), ' ') || ' ' AS w
            FROM documents),
        hits AS (SELECT r, rule, level, label, regexp_extract_all(w, pat) AS m, string_split_regex(w, pat) AS p FROM t, rules WHERE regexp_matches(w, pat)),
        found AS MATERIALIZED (SELECT r, rule, level, label, unnest({places}, recursive := true) FROM hits),
        kept AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.r = f.r AND o.a <= f.a AND o.z >= f.z AND o.level <= f.level
            AND (o.a < f.a OR o.z > f.z OR o.level < f.level OR o.rule < f.rule))),
        named AS (SELECT r, list(DISTINCT label) AS labels, max(s) AS score FROM kept JOIN sure USING (level) WHERE label <> '' GROUP BY r),
        bhits AS (SELECT r, label, regexp_extract_all(w, pat) AS m, string_split_regex(w, pat) AS p FROM t, base WHERE regexp_matches(w, pat)),
        bplaces AS (SELECT r, label, unnest({places}, recursive := true) FROM bhits),
        b AS (SELECT r, count(*) AS n, min(a) AS lo, max(a) AS hi, list(DISTINCT label) AS labels FROM bplaces GROUP BY r)
        SELECT doc_id, CAST((length(w) - length(replace(w, ' ', ''))) // 2 AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
               coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(named.labels, [])))), ','), '') AS labels,
               coalesce(score, 0.0)::DOUBLE AS score
        FROM t LEFT JOIN b USING (r) LEFT JOIN named USING (r)"""


ORACLES = {"op6_warc_round_trip": WARC, "op11_spelling_variants": SPELLING, "op12_centroid_clusters": centroid_sql(), "op13_license_scan": license_sql()}

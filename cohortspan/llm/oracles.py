"""SQL for the corpus queries that SQL can express over whole tables."""

from . import secret_scan

ORACLES = {}


def _secret_scan() -> str:
    names = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in (
        "password", "passwd", "secret", "token", "api_?key"))
    assign = rf"""({names})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [("assign", assign), ("access", secret_scan.ACCESS), ("hex", secret_scan.HEX)]
    kinds += [(c.kind, c.run) for c in secret_scan.CLASSES]
    raw = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, {i} AS ord, regexp_extract_all(x, '{p}') AS m, string_split_regex(x, '{p}') AS g FROM t"
        for i, (kind, p) in enumerate(kinds))
    words = secret_scan.ALLOWED.removesuffix(r"|(.)\1{7}")
    hot = []
    for c in secret_scan.CLASSES:
        again = "|".join(f"[{x.upper()}{x.lower()}]{{8}}" if x.isalpha() else f"[{x}]{{8}}" for x in sorted(set(c.alphabet.lower())))
        table = ", ".join(map(str, secret_scan.weights(c.window)))
        need = " AND ".join(f"regexp_matches(s, '{p}')" for p in c.must_have)
        hot.append(f"""
  SELECT doc_id, kind, ord, start, {c.window} AS size, list_filter(range(0, length(s) - {c.window} + 1), lambda i:
    list_sum(list_transform(list_distinct(string_split(substr(s, (i + 1)::INT, {c.window}), '')), lambda ch:
      [{table}][{c.window} - length(replace(substr(s, (i + 1)::INT, {c.window}), ch, '')) + 1])) <= {c.limit}) AS h
  FROM spans WHERE kind = '{c.kind}' AND NOT regexp_matches(s, '{words}|{again}') AND {need}""")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
raw AS ({raw}),
spans AS (
  SELECT doc_id, kind, ord, s, start::BIGINT AS start, (start + length(s))::BIGINT AS stop
  FROM (SELECT doc_id, kind, ord, m[i] AS s, list_sum(list_transform(g[1:i], lambda p: length(p)))
               + coalesce(list_sum(list_transform(m[1:i - 1], lambda p: length(p))), 0) AS start
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw WHERE len(m) > 0))),
base AS (SELECT doc_id, kind, ord, start, stop FROM spans
         WHERE kind IN ('access', 'hex') OR (kind = 'assign' AND length(regexp_extract(s, '{assign}', 2)) >= {secret_scan.ASSIGNED_CHARS})),
hot AS ({" UNION ALL ".join(hot)}),
added AS (SELECT a.* FROM (SELECT doc_id, kind, ord, start + h[1] AS start, start + h[-1] + size AS stop FROM hot WHERE len(h) > 0) a
          WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND a.stop <= b.stop)),
listed AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord, stop) AS spans
           FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                   count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord, stop) AS spans
            FROM base GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(c.spans, '')) AS base_sha256, coalesce(l.spans, '') AS spans
FROM t LEFT JOIN counted c ON c.doc_id = t.doc_id LEFT JOIN listed l ON l.doc_id = t.doc_id"""


ORACLES["op1_secret_scan"] = _secret_scan()

ORACLES["op6_substring_dedup"] = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM texts)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (
           SELECT doc_id, i, unnest(range(0, 50)) AS k FROM windows JOIN firsts USING (s) WHERE first < doc_id)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts) ANTI JOIN gone USING (doc_id, i)
         GROUP BY doc_id)
SELECT t.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id"""

ORACLES["op8_top_k"] = """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
products AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
             FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v))
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM products)
WHERE rank <= 5"""

ORACLES["op9_decontaminate"] = r"""
WITH folded AS (SELECT doc_id, regexp_extract_all(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
wanted AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS s
           FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
hits AS (SELECT doc_id, i, f.n, item_id
         FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM folded, (SELECT DISTINCT n FROM wanted))) f
         JOIN wanted ON wanted.n = f.n AND wanted.s = f.s),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, i + k AS i FROM (
            SELECT doc_id, i, unnest(range(0, n)) AS k FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT f.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM folded f LEFT JOIN words x ON x.doc_id = f.doc_id LEFT JOIN named y ON y.doc_id = f.doc_id"""

ORACLES["op11_hard_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
products AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
             FROM e a JOIN e b ON a.vec_id % 100 = 0 AND len(a.v) = len(b.v)),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score
              FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r
                    FROM products WHERE same AND vec_id <> anchor_id) WHERE r <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM (SELECT p.*, n.vec_id, n.score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS rank
      FROM positives p JOIN products n ON n.anchor_id = p.anchor_id AND NOT n.same
        AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score)
WHERE rank <= 5"""

ORACLES["op12_ngram_jaccard"] = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM texts UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, first AS component_id
FROM texts t LEFT JOIN sizes s ON s.doc_id = t.doc_id JOIN (SELECT a, min(b) AS first FROM reached GROUP BY a) r ON r.a = t.doc_id"""

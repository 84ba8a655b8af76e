"""SQL that gives the same rows as the queries which SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SPACED_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

WARC = """
  WITH p AS (SELECT page_id, url, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
  g AS (SELECT digest, size, max(page_id) AS keeper FROM p WHERE size >= 1000 GROUP BY ALL),
  k AS (SELECT page_id, coalesce(url, '') AS url, regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
  h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS host, rest FROM k),
  u AS (SELECT page_id, array_to_string(list_reverse(string_split(regexp_replace(lower(regexp_replace(host, ':[0-9]*$', '')), '^www\\.', ''), '.')), ',')
      || ')' || string_split(substr(rest, length(host) + 1), '#')[1] AS url_key FROM h)
  SELECT p.page_id, size AS payload_bytes, digest AS payload_digest,
    CASE WHEN keeper <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN keeper <> p.page_id THEN keeper END AS refers_to,
    url_key, row_number() OVER (ORDER BY url_key, p.page_id) - 1 AS position
  FROM p LEFT JOIN g USING (digest, size) JOIN u ON u.page_id = p.page_id
"""

CHAT = r"""
  WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|ROLE\]|/ROLE\]|INST\]|/INST\]|SEP\])', '\1\\\2\3', 'g')) AS chars,
      role IS DISTINCT FROM lag(role) OVER w AS opens FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars + CASE WHEN NOT opens THEN length('[SEP]') WHEN role = 'user' THEN length('<s>[INST]  [/INST]</s>')
      ELSE length('<s>[ROLE]  [/ROLE]</s>') + length(role) END) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id
"""

DECONTAMINATION = f"""
  WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents), b AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
  iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
  sizes AS (SELECT DISTINCT n FROM iw),
  dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
  h AS (SELECT doc_id, n, i, item_id FROM dw JOIN iw USING (n, win)),
  hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_DEDUP = f"""
  WITH RECURSIVE d AS (SELECT doc_id, {_SPACED_WORDS} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
  e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r AS (SELECT a AS id, a AS lo FROM e UNION SELECT e.b, r.lo FROM r JOIN e ON e.a = r.id),
  k AS (SELECT id, min(lo) AS lo FROM r GROUP BY id)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(lo, doc_id) AS component_id, coalesce(lo, doc_id) = doc_id AS kept
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.id = doc_id
"""


def _centroids(rounds: int) -> str:
    """Rounds written out one after another; k: kept vectors, cI: centroids before round I, aI: their nearest vectors."""
    parts = ["""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS p
      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, p) - 1 AS c, p
      FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, p FROM k ORDER BY h, p LIMIT 8))"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': c}}) AS b FROM (
        SELECT r, c, list_sum(list_transform(list_zip(k.p, c{i}.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM k, c{i}) GROUP BY r)""")
        parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.p, c{i}.p) AS p FROM c{i} LEFT JOIN (
        SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS p
        FROM (SELECT b.c AS c, i, sum(k.p[i]) AS s, count(*) AS n FROM a{i} JOIN k USING (r), range(1, 65) t(i) GROUP BY ALL) GROUP BY c) m USING (c))""")
    return "WITH " + ",\n    ".join(parts[:-1]) + f"""
  SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia,
    CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.p, ',')) AS centroid_sha256
  FROM a{rounds} JOIN k USING (r) JOIN c{rounds} ON c{rounds}.c = a{rounds}.b.c"""


CENTROIDS = _centroids(10)

# The CRC of a word's bytes, from a table of the polynomial's remainders.
IMPORTANCE = f"""
  WITH poly AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), b)) AS t),
  d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM_WORDS} AS w FROM documents),
  f AS (SELECT r, unnest(w) AS word FROM d), g AS (SELECT unnest({_ALNUM_WORDS}) AS word FROM benchmark),
  bytes AS (SELECT word, list_transform(range(octet_length(encode(word))), lambda i:
      (strpos('0123456789ABCDEF', substr(hex(encode(word)), 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode(word)), 2 * i + 2, 1)) - 1) AS b
    FROM (SELECT word FROM f UNION SELECT word FROM g)),
  v AS MATERIALIZED (SELECT word, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, poly),
  s AS (SELECT bucket, count(*) AS s FROM f JOIN v USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM g JOIN v USING (word) GROUP BY bucket),
  gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)
      / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM g) + 10000)))) AS gain FROM s LEFT JOIN t USING (bucket)),
  w AS (SELECT r, sum(gain) AS weight FROM f JOIN v USING (word) JOIN gain USING (bucket) GROUP BY r),
  x AS (SELECT d.r, doc_id, len(d.w) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
      ('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (r)),
  y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
  z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank FROM y WHERE n >= 20
    QUALIFY rank <= 10 * (SELECT count(*) FROM y WHERE n >= 20) // 100)
  SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CAST(rank AS BIGINT) AS rank FROM y LEFT JOIN z USING (r)
"""

"""SQL for DuckDB of the queries that SQL can express: full joins and recursion in place of hashing."""

SQL: dict[str, str] = {}

SQL["op3_minhash"] = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n, CASE WHEN len(sh) > 0 THEN min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(sh), chr(10)))) END AS class_id FROM s),
e AS (SELECT doc_id, hash(unnest(sh)) AS x FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n r ON r.doc_id = b WHERE 100 * c >= 75 * (p.n + r.n - c)),
walk AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.b, w.root FROM walk w JOIN links l ON l.a = w.id)
SELECT n.doc_id, n.n AS n_shingles, r.root AS component_id, n.doc_id = r.root AS kept, n.class_id
FROM n JOIN (SELECT id, min(root) AS root FROM walk GROUP BY id) r ON r.id = n.doc_id"""

SQL["op5_embedding_dedup"] = """
WITH RECURSIVE
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, len(embedding) AS d FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.d = b.d AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
walk AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.b, w.root FROM walk w JOIN links l ON l.a = w.id)
SELECT x.vec_id, (SELECT count(*) FROM links l WHERE l.a = x.vec_id) AS n_links, r.root AS component_id, x.vec_id = r.root AS kept
FROM embeddings x JOIN (SELECT id, min(root) AS root FROM walk GROUP BY id) r ON r.id = x.vec_id"""

# In hex: what a cut leaves of a character at the start of a piece, and at its end.
_SPLIT = ["^([89AB][0-9A-F])+", "([CD][0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-9A-F]([89AB][0-9A-F]){0,2})$"]


def _whole(x: str) -> str:
    for pattern in _SPLIT:
        x = f"regexp_replace({x}, '{pattern}', '')"
    return x


SQL["op6_suffix_dedup"] = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, pos, hash(b[pos + 1 : pos + 400]) AS k FROM (SELECT doc_id, b, unnest(range(0, greatest(0, n - 399))) AS pos FROM d)),
again AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM p JOIN again USING (k)),
run AS (SELECT doc_id, pos, sum(CASE WHEN before IS NULL OR pos > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM hit),
span AS (SELECT doc_id, r, min(pos) AS s, max(pos) + 400 AS e FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS since FROM span),
piece AS (SELECT doc_id, s, e, substr(h, 2 * since + 1, 2 * (s - since)) AS x FROM gap JOIN d USING (doc_id)),
cut AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(x, '' ORDER BY s) AS head, string_agg({_whole('x')}, '' ORDER BY s) AS clean FROM piece GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(concat(coalesce(head, ''), substr(h, 2 * coalesce(last, 0) + 1)))) AS kept_sha256,
  decode(unhex(concat(coalesce(clean, ''), {_whole('substr(h, 2 * coalesce(last, 0) + 1)')}))) AS text
FROM d LEFT JOIN cut USING (doc_id)"""

SQL["op9_decontamination"] = r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM documents),
i AS (SELECT item_id, ws, len(ws) AS l, least(5, len(ws)) AS k FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(ws) > 0),
bag AS (SELECT item_id, s, count(*) AS c FROM (SELECT item_id, array_to_string(ws[p : p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, l - k + 2)) AS p FROM i)) GROUP BY ALL),
sh AS (SELECT id, k, p - 1 AS pos, len(ws) AS n, array_to_string(ws[p : p + k - 1], ' ') AS s FROM (SELECT d.id, d.ws, x.k, unnest(range(1, len(d.ws) - x.k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) x)),
hit AS (SELECT sh.id, i.item_id, sh.pos, sh.s, bag.c, least(i.l, sh.n) AS size, sh.n, i.l, i.k FROM sh JOIN bag ON bag.s = sh.s JOIN i ON i.item_id = bag.item_id AND i.k = sh.k),
win AS (SELECT id, item_id, s, c, size, l, k, unnest(range(greatest(0, pos - size + k), least(pos, n - size) + 1)) AS w FROM hit),
common AS (SELECT id, item_id, w, size, l, k, sum(least(n, c)) AS c FROM (SELECT id, item_id, w, size, l, k, s, c, count(*) AS n FROM win GROUP BY ALL) GROUP BY ALL),
scored AS (SELECT id, item_id, w, size, c::DOUBLE / ((size - k + 1) + (l - k + 1) - c) AS similarity FROM common)
SELECT id AS doc_id, item_id, similarity, w AS word_start, size::INT AS n_words FROM (SELECT *, row_number() OVER (PARTITION BY id, item_id ORDER BY similarity DESC, w) AS r FROM scored WHERE similarity >= 0.75) WHERE r = 1"""

# Giants first, a shard each; then a binary search for the least capacity, one greedy step in each row of `search`.
SQL["op2_sharding"] = """
WITH RECURSIVE
tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(0, 8)), lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM (SELECT unnest(range(0, 256)) AS i))),
d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 8 AS size, sha256(coalesce(text, '')) AS k FROM documents),
once AS (SELECT k, text, list_concat([4294967295], list_transform(range(0, strlen(text)), lambda i: CAST(concat('0x', hex(encode(text))[2 * i + 1 : 2 * i + 2]) AS BIGINT))) AS bytes FROM (SELECT DISTINCT k, text FROM d)),
crc AS (SELECT k, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM once, tab),
g AS (SELECT k, sum(size)::BIGINT AS size FROM d GROUP BY k),
o AS (SELECT *, row_number() OVER (ORDER BY size DESC, k) AS r, sum(size) OVER () - coalesce(sum(size) OVER (ORDER BY size DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM g),
big AS (SELECT k, r FROM o WHERE r < coalesce((SELECT min(r) FROM o WHERE NOT (size * (25 - r) > rest AND r < 24)), 1e9)),
other AS (SELECT k, size, sum(size) OVER (ORDER BY k)::BIGINT AS cum, row_number() OVER (ORDER BY k) AS i FROM g WHERE k NOT IN (SELECT k FROM big)),
facts AS (SELECT 24 - (SELECT count(*) FROM big) AS shards, count(*) AS n, coalesce(sum(size), 0)::BIGINT AS total, coalesce(max(size), 0)::BIGINT AS largest, list_concat([0], list(cum ORDER BY i)) AS cum FROM other),
search AS (
  SELECT greatest(largest, -(-total // shards)) AS lo, total AS hi, 0::BIGINT AS pos, 0 AS used FROM facts
  UNION ALL
  SELECT CASE WHEN pos < n AND used = shards THEN (lo + hi) // 2 + 1 ELSE lo END, CASE WHEN pos = n THEN (lo + hi) // 2 ELSE hi END,
    CASE WHEN pos = n OR used = shards THEN 0 ELSE len(list_filter(cum, lambda c: c <= cum[pos + 1] + (lo + hi) // 2)) - 1 END, CASE WHEN pos = n OR used = shards THEN 0 ELSE used + 1 END
  FROM search, facts WHERE lo < hi),
best AS (SELECT min(hi) AS capacity FROM search),
cut AS (SELECT 0 AS s, 0::BIGINT AS first UNION ALL SELECT s + 1, len(list_filter(cum, lambda c: c <= cum[first + 1] + capacity)) - 1 FROM cut, facts, best WHERE first < n AND s < shards),
place AS (SELECT k, (r - 1)::INT AS shard FROM big UNION ALL SELECT k, ((SELECT count(*) FROM big) + (SELECT max(s) FROM cut WHERE first < i))::INT FROM other)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY sha256(coalesce(doc_id::VARCHAR, ''))[1:1], doc_id, k) - 1 AS slot, NULL::INT AS grown_shard, k AS group_key
FROM d JOIN crc USING (k) JOIN place USING (k)"""

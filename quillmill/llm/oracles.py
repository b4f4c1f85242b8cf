"""DuckDB SQL for the corpus queries that SQL can express."""

WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS found FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.found),
c AS (SELECT doc_id, min(found) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

REPEATS = f"""WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
d AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM d),
k AS (SELECT w.doc_id, t.word, t.pos FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w) t JOIN w USING (doc_id) ANTI JOIN g ON g.doc_id = t.doc_id AND g.pos = t.pos),
o AS (SELECT doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY pos) AS text FROM k GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept, 0) AS n_removed, sha256(coalesce(o.text, '')) AS kept_sha256 FROM w LEFT JOIN o USING (doc_id)"""

ORACLES: dict[str, str] = {"op2_minhash_near_dedup": NEAR_DUPLICATES, "op6_substring_dedup": REPEATS}

"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Sizes, targets by running sums over the sources in order of limit a weight, and a cut of each source's hash order.
MIXING = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
 w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM s),
 v AS (SELECT *, [5, 2, 1][((number - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2e0 AS lim FROM w),
 r AS (SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5e0 AS words, sum(weight) OVER () AS weights, sum(lim) OVER o AS lims, sum(weight) OVER o AS before FROM v WINDOW o AS (ORDER BY lim / weight, number ROWS UNBOUNDED PRECEDING)),
 f AS (SELECT *, lim <= weight * ((words - lims + lim) / (weights - before + weight)) AS full_ FROM r),
 g AS (SELECT *, words - sum(CASE WHEN full_ THEN lim ELSE 0e0 END) OVER () AS left_, sum(CASE WHEN NOT full_ THEN weight END) OVER () AS open_ FROM f),
 t AS (SELECT source, source_size, CASE WHEN full_ THEN lim ELSE least(lim, weight * left_ / open_) END AS target FROM g),
 x AS (SELECT d.*, source_size, target, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || digest), 1, 13))::BIGINT AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 y AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, digest ROWS UNBOUNDED PRECEDING) - size AS running,
  CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM x)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - running)))::BIGINT AS taken FROM y"""

#: Every window of 400 bytes by its digest (texts in stretches of 1000 windows); a byte is covered if the last repeated window that starts at or before it reaches it.
BYTES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
 k AS (SELECT r, c, substr(x, 2000 * c + 1, 2798) AS y FROM (SELECT r, x, unnest(range(len(x) // 2000 + 1)) AS c FROM d)),
 u AS (SELECT r, c, y, unnest(range(least(1000, len(y) // 2))) AS j FROM k),
 w AS (SELECT r, 1000 * c + j AS i, CASE WHEN 2 * j + 800 <= len(y) THEN md5(substr(y, 2 * j + 1, 800)) END AS h, substr(y, 2 * j + 1, 2) AS b FROM u),
 n AS (SELECT h FROM w WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
 c AS (SELECT w.r, i, b, coalesce(i - max(CASE WHEN n.h IS NOT NULL THEN i END) OVER (PARTITION BY w.r ORDER BY i ROWS UNBOUNDED PRECEDING) < 400, FALSE) AS gone FROM w LEFT JOIN n ON w.h = n.h),
 e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), FALSE) AS opens FROM c),
 a AS (SELECT r, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY r)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a ON d.r = a.r"""

#: The same for windows of 35 words.
REPEATED_WORDS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS x FROM documents),
 k AS (SELECT r, c, x[100 * c + 1:100 * c + 134] AS y FROM (SELECT r, x, unnest(range(len(x) // 100 + 1)) AS c FROM d)),
 u AS (SELECT r, c, y, unnest(range(least(100, len(y)))) AS j FROM k),
 w AS (SELECT r, 100 * c + j AS i, CASE WHEN j + 35 <= len(y) THEN md5(array_to_string(y[j + 1:j + 35], ' ')) END AS h, y[j + 1] AS b FROM u),
 n AS (SELECT h FROM w WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
 c AS (SELECT w.r, i, b, coalesce(i - max(CASE WHEN n.h IS NOT NULL THEN i END) OVER (PARTITION BY w.r ORDER BY i ROWS UNBOUNDED PRECEDING) < 35, FALSE) AS gone FROM w LEFT JOIN n ON w.h = n.h),
 a AS (SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(b, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a ON d.r = a.r"""

LOWER = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Windows of both sides joined by their words, for each width that an item asks for.
CONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {LOWER} AS x FROM documents),
 b AS (SELECT item_id, {LOWER} AS x FROM benchmark),
 p AS (SELECT item_id, x, least(10, len(x)) AS width, unnest(range(len(x) - least(10, len(x)) + 1)) AS i FROM b WHERE len(x) > 0),
 q AS (SELECT DISTINCT item_id, width, array_to_string(x[i + 1:i + width], ' ') AS s FROM p),
 k AS (SELECT DISTINCT width FROM q),
 y AS (SELECT r, c, x[100 * c + 1:100 * c + 109] AS y FROM (SELECT r, x, unnest(range(len(x) // 100 + 1)) AS c FROM d)),
 v AS (SELECT r, c, width, y, unnest(range(least(100, greatest(0, len(y) - width + 1)))) AS j FROM y, k),
 w AS (SELECT r, width, 100 * c + j AS i, array_to_string(y[j + 1:j + width], ' ') AS s FROM v),
 o AS (SELECT r, w.i, w.width, item_id FROM w JOIN q ON w.width = q.width AND w.s = q.s),
 h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + width)) AS j FROM (SELECT DISTINCT r, i, width FROM o)) GROUP BY r),
 t AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT r, item_id FROM o) GROUP BY r)
SELECT doc_id, len(x)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN t ON d.r = t.r"""


#: Failing filters as a list of letters; the first of them in an order is the one that removes.
FILTERS = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
 e AS (SELECT x, min(doc_id) AS first_id FROM d GROUP BY 1),
 w AS (SELECT doc_id, part, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words FROM d),
 l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
 m AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
  list_filter([CASE WHEN len(words) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
   CASE WHEN 100 * length(regexp_replace(w.x, '[^A-Z]', '', 'g')) > 3 * length(w.x) THEN 'C' END, CASE WHEN regexp_matches(w.x, '[#$%&*|]') THEN 'D' END, CASE WHEN w.doc_id > first_id THEN 'E' END], lambda z: z IS NOT NULL) AS fails
  FROM w JOIN e ON w.x = e.x LEFT JOIN l ON w.doc_id = l.doc_id),
 c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY 1, 2),
 p AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS z),
 o AS (SELECT a.z || b.z || c.z || d.z || e.z AS filter_order FROM p a, p b, p c, p d, p e WHERE len(list_distinct([a.z, b.z, c.z, d.z, e.z])) = 5),
 k AS (SELECT c.*, filter_order, list_min(list_transform(fails, lambda z: strpos(filter_order, z))) AS gone FROM c, o),
 s AS (SELECT *, substr(filter_order, step, 1) AS z FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM k)),
 r AS (SELECT part, filter_order, step::INT AS step, z, coalesce(sum(n) FILTER (gone IS NULL OR gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone < step AND list_contains(fails, z)), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = [z]), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (gone = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (gone = step), 0)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, z)::BIGINT AS shapley FROM r"""

LEAF = "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + "))"
#: The crc32 of a decimal number before its last inversion, bit by bit.
CRC = "list_reduce(flatten(list_transform(str_split(doc_id::VARCHAR, ''), lambda x: list_transform(range(8), lambda k: ((unicode(x) >> k) & 1)::BIGINT))), lambda c, b: xor(c >> 1, xor(c & 1, b) * 3988292384), 4294967295::BIGINT)"

#: Trees level by level; the subroots are the leaves of one more tree, so a row's way is that of its source's tree and then that of the source.
MANIFEST = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, '') AS tree, {LEAF.format("text")} AS leaf, CASE WHEN {CRC} & 1 = 1 THEN {LEAF.format("replace(text, chr(10), '')")} END AS other FROM documents),
 q AS (SELECT d.*, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
 u AS (SELECT 0 AS level, tree, pos, n, leaf AS node FROM q UNION ALL SELECT level + 1, tree, pos // 3, any_value((n + 2) // 3), sha256(string_agg(node, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, tree, pos // 3),
 s AS (SELECT tree, node AS subroot, level AS height FROM u WHERE n = 1),
 z AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM s),
 v AS (SELECT 0 AS level, pos, n, subroot AS node FROM z UNION ALL SELECT level + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(node, '' ORDER BY pos)) FROM v WHERE n > 1 GROUP BY level, pos // 3),
 t AS (SELECT node AS root, level AS top FROM v WHERE n = 1),
 a AS (SELECT r, tree, pos // (3 ** level)::BIGINT AS place, level FROM (SELECT r, tree, pos, unnest(range(height)) AS level FROM q JOIN s USING (tree))),
 i AS (SELECT a.r, a.level, string_agg(node, '' ORDER BY u.pos) FILTER (u.pos < place) AS lo, string_agg(node, '' ORDER BY u.pos) FILTER (u.pos > place) AS hi FROM a JOIN u ON u.tree = a.tree AND u.level = a.level AND u.pos // 3 = a.place // 3 GROUP BY ALL),
 b AS (SELECT tree, pos // (3 ** level)::BIGINT AS place, level FROM (SELECT tree, pos, unnest(range(top)) AS level FROM z, t)),
 j AS (SELECT b.tree, b.level, string_agg(node, '' ORDER BY v.pos) FILTER (v.pos < place) AS lo, string_agg(node, '' ORDER BY v.pos) FILTER (v.pos > place) AS hi FROM b JOIN v ON v.level = b.level AND v.pos // 3 = b.place // 3 GROUP BY ALL),
 w AS (SELECT r, level, coalesce(lo, '') AS lo, coalesce(hi, '') AS hi FROM i UNION ALL SELECT r, height + level, coalesce(lo, ''), coalesce(hi, '') FROM q JOIN s USING (tree) JOIN j USING (tree)),
 p AS (SELECT r, sha256(string_agg(lo || hi, '' ORDER BY level)) AS proof FROM w GROUP BY r),
 f AS (SELECT r, 0 AS level, coalesce(other, leaf) AS node FROM q UNION ALL SELECT f.r, f.level + 1, sha256(lo || node || hi) FROM f JOIN w ON f.r = w.r AND f.level = w.level)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, node AS folded_root, node = root AS verified
FROM q JOIN s USING (tree) CROSS JOIN t LEFT JOIN p ON q.r = p.r JOIN f ON q.r = f.r AND f.level = height + top"""

"""DuckDB SQL for the operator queries that SQL can express."""

from __future__ import annotations

#: A-Z folded to a-z and nothing else.
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

op5 = rf"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all({FOLD.format("text")}, '{WORD}') AS w FROM benchmark WHERE text IS NOT NULL
), item_windows AS (
  SELECT DISTINCT id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '{WORD}') AS w FROM documents
), sizes AS (SELECT DISTINCT m FROM item_windows), doc_windows AS (
  SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc_words, sizes WHERE len(w) >= m)
), found AS (
  SELECT r, d.m, i, id FROM doc_windows d JOIN item_windows t ON d.m = t.m AND d.g = t.g
), hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

SPACED = r"[^\x20\x09-\x0D]+"

op9 = rf"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '{SPACED}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM doc_words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reached r JOIN edges e ON r.y = e.x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept,
  least(doc_id, coalesce(k, doc_id)) AS class_id
FROM doc_words LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM reached GROUP BY x) USING (doc_id)
LEFT JOIN (SELECT e.x AS doc_id, min(e.y) AS k FROM edges e JOIN sizes p ON p.doc_id = e.x JOIN sizes q ON q.doc_id = e.y
  JOIN common t ON t.x = least(e.x, e.y) AND t.y = greatest(e.x, e.y) WHERE p.n = q.n AND t.c = p.n GROUP BY e.x) USING (doc_id)
"""


def op10() -> str:
    from confluo.llm.licenses import CLAUSE_NUMBER, COPYRIGHT_LINE, DIGESTS, HOLDER_LINE, KNOWN, NAMED, NAMELESS, SPDX_LINE, SPELLINGS, TITLE

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    form = f"regexp_replace(translate(text, chr(13), chr(10)), '{HOLDER_LINE}', '', 'g')"
    form = f"regexp_replace(regexp_replace(translate({form}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPDX_LINE}', '', 'g'), '{COPYRIGHT_LINE}', '', 'g')"
    form = f"regexp_replace({form}, '{CLAUSE_NUMBER}', ' ', 'g')"
    form = f"regexp_replace({form}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F\\x{{A9}}\\x{{2018}}-\\x{{201F}}]+', ' ', 'g')"
    form = f"' ' || trim({form}, ' ') || ' '"
    for old, new in SPELLINGS:
        form = f"replace({form}, ' {old} ', ' {new} ')"
    form = f"regexp_replace({form}, '{NAMED}', '{NAMELESS}', 'g')"
    form = f"sha256(regexp_replace(trim({form}, ' '), '{TITLE}', ''))"
    texts = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in KNOWN.items())
    digests = ", ".join(f"('{d}', {quoted(k)})" for k, d in DIGESTS.items())
    return f"""WITH known AS (SELECT digest, min(license) AS license FROM (SELECT {form} AS digest, license FROM (VALUES {texts}) t(license, text) UNION ALL SELECT * FROM (VALUES {digests})) GROUP BY 1),
docs AS (SELECT doc_id, {form} AS digest FROM documents)
SELECT doc_id, digest, license FROM docs LEFT JOIN known USING (digest)"""


def op13() -> str:
    """Exact k-means step by step: 16 first centroids, three rounds, a last assignment."""
    parts = ["""whole AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64)""", """c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS INT) AS cluster, x AS c FROM whole QUALIFY cluster < 16)"""]
    near = """SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT r, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM whole, c{i}) GROUP BY r"""
    for i in range(3):
        parts.append(f"a{i} AS ({near.format(i=i)})")
        moved = f"SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT cluster, i, CAST(floor(sum(x[i])::DOUBLE / count(*)) AS BIGINT) AS f, sum(x[i]) AS s, count(*) AS n, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM a{i} JOIN whole USING (r), (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i) GROUP BY cluster"
        parts.append(f"c{i + 1} AS (SELECT c{i}.cluster, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN ({moved}) m USING (cluster))")
    parts.append(f"a3 AS ({near.format(i=3)})")
    return "WITH " + ", ".join(parts) + """ SELECT vec_id, cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a3 JOIN whole USING (r) JOIN c3 USING (cluster)"""


#: CRC-32 of an ASCII string s, byte by byte and bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({s}, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""


def op12() -> str:
    """Turn by turn, the cheapest (cost, edits, text) in each of the four states, with inserted turns before each."""
    return f"""WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32.format(s="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS h FROM conversations
), hurt AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, (SELECT unnest([1, 2]) AS copy) WHERE copy <= CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt
), judged AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') AS open_, substr(role, 1, 1) AS r, lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS next FROM placed
), turns AS (SELECT *, blank OR again AS must, CASE WHEN open_ AND NOT blank AND NOT again THEN 1 ELSE 0 END AS cut FROM judged),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
    sum(cut) AS truncated, count(*) FILTER (WHERE next IS NOT NULL AND r || next NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM turns GROUP BY conv_id
), inserts(q, more, edits, q2, said) AS (
  SELECT q, 0, '', q, []::VARCHAR[] FROM (SELECT unnest([0, 1, 2, 3]) AS q) UNION ALL
  SELECT * FROM (VALUES (0, 2, 'I', 2, ['user:']), (1, 2, 'I', 2, ['user:']), (3, 2, 'I', 2, ['user:']), (2, 2, 'I', 3, ['assistant:']),
    (0, 4, 'II', 3, ['user:', 'assistant:']), (1, 4, 'II', 3, ['user:', 'assistant:']), (3, 4, 'II', 3, ['user:', 'assistant:']), (2, 4, 'II', 2, ['assistant:', 'user:']))
), edits(edit, q, r, price, q2, role) AS (
  VALUES ('D', 0, '', 3, 0, NULL), ('D', 1, '', 3, 1, NULL), ('D', 2, '', 3, 2, NULL), ('D', 3, '', 3, 3, NULL),
    ('K', 0, 's', 0, 1, ''), ('K', 0, 'u', 0, 2, ''), ('K', 1, 'u', 0, 2, ''), ('K', 3, 'u', 0, 2, ''), ('K', 2, 'a', 0, 3, ''),
    ('R', 0, '', 2, 2, 'user'), ('R', 1, '', 2, 2, 'user'), ('R', 3, '', 2, 2, 'user'), ('R', 2, '', 2, 3, 'assistant')
), steps AS (
  SELECT i.q, i.more + e.price AS price, i.edits || e.edit AS edits, e.edit, e.r, e.q2, i.said, e.role FROM inserts i JOIN edits e ON e.q = i.q2
), run(conv_id, i, q, best) AS (
  SELECT conv_id, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]}} FROM counts UNION ALL
  SELECT w.conv_id, w.i + 1, s.q2, min({{'cost': (w.best).cost + s.price + CASE WHEN s.edit = 'D' THEN 0 ELSE t.cut END, 'audit': (w.best).audit || s.edits,
    'said': list_concat((w.best).said, s.said, CASE s.edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [t.role || ':' || t.text] ELSE [s.role || ':' || t.text] END)}})
  FROM run w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1 JOIN steps s ON s.q = w.q AND (s.edit = 'D' OR NOT t.must) AND (s.edit <> 'K' OR s.r = t.r)
  GROUP BY w.conv_id, w.i, s.q2
), done AS (
  SELECT w.conv_id, min({{'cost': (w.best).cost + x.more, 'audit': (w.best).audit || x.edits, 'said': list_concat((w.best).said, x.said)}}) AS best
  FROM run w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN inserts x ON x.q = w.q AND x.q2 IN (0, 3) GROUP BY w.conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce((best).cost, 0) AS BIGINT) AS cost, coalesce((best).audit, '') AS audit, sha256(coalesce(array_to_string((best).said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id"""

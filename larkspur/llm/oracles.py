"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from larkspur.llm import mixing, quality_rules

WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

LINE_DEDUP = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ln FROM documents
), split AS (
  SELECT *, {WORDS.format("line")} AS w FROM lines
), keyed AS (
  SELECT *, array_to_string(w, ' ') AS key, row_number() OVER (ORDER BY doc_id, ln) AS o FROM split
), firsts AS (
  SELECT key, min(o) AS o, any_value(w) AS w FROM keyed WHERE len(w) > 0 GROUP BY key
), variants AS (
  SELECT key, o, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v FROM (SELECT key, o, w, unnest(range(1, len(w) + 1)) AS i FROM firsts WHERE len(w) >= 5)
), near AS (
  SELECT a.key FROM variants a JOIN (SELECT v, i, min(o) AS o FROM variants GROUP BY v, i) b ON a.v = b.v AND a.i = b.i AND b.o < a.o
  UNION SELECT a.key FROM variants a JOIN firsts b ON a.v = b.key AND len(b.w) >= 5 AND b.o < a.o
  UNION SELECT a.key FROM firsts a JOIN variants b ON b.v = a.key AND len(a.w) >= 5 AND b.o < a.o
), judged AS (
  SELECT k.*, len(k.w) > 0 AND (k.o > f.o OR n.key IS NOT NULL) IS TRUE AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key AND len(k.w) > 0 LEFT JOIN near n ON n.key = k.key AND len(k.w) > 0
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, component_id, component_id = e.vec_id AS kept FROM embeddings e JOIN least ON a = e.vec_id"""

JACCARD_JOIN = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split
), sizes AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(1) ORDER BY s)) AS fp FROM sets GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c * 5 >= 4 * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a), same AS (SELECT fp, min(doc_id) AS class_id FROM sizes GROUP BY fp)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, component_id, component_id = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN same ON same.fp = z.fp JOIN least ON least.a = d.doc_id LEFT JOIN n ON n.a = d.doc_id"""

MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size, md5(concat_ws('|', '7', CAST(doc_id AS VARCHAR), text)) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS z, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
), ordered AS (
  SELECT *, (SELECT sum(z) FROM s) - coalesce(sum(3 * z) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open
  FROM s WINDOW before AS (ORDER BY 3.0::DOUBLE * z / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
  SELECT *, rest * w > 3 * z * open AS full_ FROM ordered
), level AS (
  SELECT (SELECT sum(z) FROM s) - coalesce(sum(3 * z) FILTER (full_), 0) AS rest, sum(w) FILTER (NOT full_) AS open FROM capped
), goal AS (
  SELECT c.source, c.z, CASE WHEN full_ THEN CAST(3 * z AS DOUBLE) ELSE CAST(l.rest * w AS DOUBLE) / CAST(l.open AS DOUBLE) END AS target,
    CAST(CASE WHEN full_ THEN 3 * z ELSE (l.rest * w) // l.open END AS BIGINT) AS take FROM capped c, level l
), slots AS (
  SELECT *, (z + {mixing.BLOCK_WORDS} - 1) // {mixing.BLOCK_WORDS} AS blocks, CASE WHEN z = 0 THEN 0 ELSE take // z * ((z + {mixing.BLOCK_WORDS} - 1) // {mixing.BLOCK_WORDS}) + (take % z + {mixing.BLOCK_WORDS} - 1) // {mixing.BLOCK_WORDS} END AS due, CASE WHEN z = 0 THEN 0 ELSE take % z % {mixing.BLOCK_WORDS} END AS part FROM goal
), shares AS (
  SELECT *, sum(due) OVER () AS total, CAST(sum(due) OVER (ORDER BY encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING) AS HUGEINT) * 18446744073709551616 // greatest(1, CAST(sum(due) OVER () AS HUGEINT)) AS top,
    CAST(coalesce(sum(due) OVER (ORDER BY encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) * 18446744073709551616 // greatest(1, CAST(sum(due) OVER () AS HUGEINT)) AS low FROM slots
), points AS (
  SELECT i, CAST(i AS HUGEINT) * {mixing.GOLDEN} % 18446744073709551616 AS x FROM (SELECT unnest(range(0, CAST((SELECT max(total) FROM shares) AS BIGINT))) AS i)
), ranked AS (
  SELECT s.source, blocks, due, part, i, row_number() OVER (PARTITION BY s.source ORDER BY i) - 1 AS r FROM points JOIN shares s ON x >= low AND x < top
), picked AS (
  SELECT source, r % blocks AS b, i, CASE WHEN r = due - 1 AND part > 0 THEN part ELSE {mixing.BLOCK_WORDS} END AS words FROM ranked WHERE r < {mixing.CAP} * blocks
), placed AS (
  SELECT d.*, g.z, g.target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS lo FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
), hits AS (
  SELECT p.source, p.h, p.doc_id, p.lo, k.i, least(p.lo + size, k.b * {mixing.BLOCK_WORDS} + words) - greatest(p.lo, k.b * {mixing.BLOCK_WORDS}) AS n
  FROM (SELECT *, unnest(range(lo // {mixing.BLOCK_WORDS}, (lo + size - 1) // {mixing.BLOCK_WORDS} + 1)) AS b FROM placed WHERE size > 0) p JOIN picked k ON p.source IS NOT DISTINCT FROM k.source AND p.b = k.b
), sums AS (
  SELECT source, h, doc_id, lo, CAST(sum(n) AS BIGINT) AS taken, min(i) AS first_slot, count(*) AS n_slots FROM hits WHERE n > 0 GROUP BY ALL
)
SELECT p.doc_id, CAST(size AS BIGINT) AS size, z AS source_size, target, coalesce(taken, 0) AS taken, first_slot, coalesce(n_slots, 0) AS n_slots
FROM placed p LEFT JOIN sums s ON p.source IS NOT DISTINCT FROM s.source AND p.doc_id = s.doc_id AND p.h = s.h AND p.lo = s.lo AND size > 0"""

QUALITY_RULES = rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i:i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT doc_id, t FROM windows GROUP BY ALL HAVING count(*) > 1
), inside AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM windows JOIN twice USING (doc_id, t), (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), doubles AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id
), base AS (
  SELECT d.doc_id, lang, text, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(doubles.n, 0) AS n_dup_lines, coalesce(inside.n, 0) AS n_repeat_words FROM d LEFT JOIN doubles USING (doc_id) LEFT JOIN inside USING (doc_id)
), counted AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, length(text) AS c, len(regexp_extract_all(text, '\p{{Lu}}')) AS capital, len(regexp_extract_all(text, '\p{{L}}')) AS letter,
    len(regexp_extract_all(text, '\p{{Nd}}')) AS digit, len(regexp_extract_all(text, '[\x09-\x0D\x20]')) AS space, len(regexp_extract_all(text, '[.,;:!?]')) AS stop FROM base
), histogram AS (
  SELECT *, [CAST(x AS DOUBLE) FOR x IN [capital, letter - capital, digit, space, stop, c - letter - digit - space - stop]] AS classes FROM counted
), reference AS (
  SELECT lang, sum(capital) AS a, sum(letter - capital) AS b, sum(digit) AS c, sum(space) AS d, sum(stop) AS e, sum(c - letter - digit - space - stop) AS f, sum(n_words) AS total FROM histogram
  WHERE lang IS NOT NULL AND n_words >= 50 GROUP BY lang HAVING count(*) >= {quality_rules.REFERENCE_DOCUMENTS}
), counts AS (
  SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, encode(word)) AS k FROM (SELECT lang, unnest(w) AS word FROM base WHERE lang IS NOT NULL AND n_words >= 50) GROUP BY lang, word
), top AS (SELECT * FROM counts WHERE k <= {quality_rules.COMMON}),
judged AS (
  SELECT h.*, r.lang AS lang2, total, [CAST(x AS DOUBLE) FOR x IN [r.a, r.b, r.c, r.d, r.e, r.f]] AS q FROM histogram h JOIN reference r ON h.lang IS NULL OR h.lang = r.lang WHERE NOT base_failed AND n_words >= {quality_rules.MIN_WORDS}
), class_pairs AS (
  SELECT doc_id, lang2, unnest(classes) / list_sum(classes) AS p, unnest(q) / list_sum(q) AS q FROM judged
), own AS (
  SELECT doc_id, word, count(*) AS n FROM (SELECT DISTINCT doc_id, w FROM judged), (SELECT unnest(w) AS word) GROUP BY ALL
), common AS (
  SELECT j.doc_id, lang2, coalesce(o.n, 0) / CAST(j.n_words AS DOUBLE) AS p, t.n / CAST(j.total AS DOUBLE) AS q FROM judged j JOIN top t ON t.lang = j.lang2 LEFT JOIN own o ON o.doc_id = j.doc_id AND o.word = t.word
), word_pairs AS (
  SELECT * FROM common UNION ALL SELECT doc_id, lang2, greatest(0, 1 - sum(p)), greatest(0, 1 - sum(q)) FROM common GROUP BY ALL
), near AS (
  SELECT kind, doc_id, lang2, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))) AS distance
  FROM (SELECT 'class' AS kind, * FROM class_pairs UNION ALL SELECT 'word', * FROM word_pairs) GROUP BY ALL
), verdict AS (
  SELECT h.doc_id, bool_or(a.distance <= {quality_rules.MAX_CLASS_DISTANCE} AND b.distance <= CASE WHEN n_words < {quality_rules.SHORT_WORDS} THEN {quality_rules.MAX_SHORT_WORD_DISTANCE} ELSE {quality_rules.MAX_WORD_DISTANCE} END) AS near_one
  FROM histogram h JOIN near a ON a.doc_id = h.doc_id AND a.kind = 'class' JOIN near b ON b.doc_id = h.doc_id AND b.kind = 'word' AND b.lang2 = a.lang2 GROUP BY h.doc_id
)
SELECT h.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(near_one, true) AS kept FROM histogram h LEFT JOIN verdict v ON v.doc_id = h.doc_id"""

ORACLE = {
    "op3_line_dedup": LINE_DEDUP,
    "op4_embedding_dedup": EMBEDDING_DEDUP,
    "op5_jaccard_join": JACCARD_JOIN,
    "op6_quality_rules": QUALITY_RULES,
    "op7_mixing": MIXING,
}

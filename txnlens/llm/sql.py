"""SQL for DuckDB by query name, for the queries that SQL can express."""

OP1 = r"""
WITH RECURSIVE raw AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no FROM raw
), normal AS (
  SELECT *, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS norm FROM lines
), firsts AS (
  SELECT norm, min({'doc': doc_id, 'line': line_no}) AS first FROM normal WHERE norm <> '' GROUP BY norm
), long AS (
  SELECT *, length(norm) AS n FROM firsts WHERE length(norm) >= 20
), links AS (
  SELECT a.first AS a, b.first AS b FROM long a JOIN long b
  ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.norm <> b.norm AND levenshtein(a.norm, b.norm) <= 2
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), keepers AS (
  SELECT norm, least(first, coalesce(min(b), first)) AS keeper, count(b) > 0 AS linked
  FROM firsts LEFT JOIN reach ON first = a GROUP BY norm, first
), judged AS (
  SELECT doc_id, line_no, line, norm, coalesce(linked, false) AS linked,
         coalesce(keeper <> {'doc': doc_id, 'line': line_no}, false) AS goes
  FROM normal LEFT JOIN keepers USING (norm)
)
SELECT doc_id, count(*) FILTER (norm <> '') AS n_lines, count(*) FILTER (goes) AS n_dropped,
       count(*) FILTER (linked) AS n_linked,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT goes), '')) AS text_sha256
FROM judged GROUP BY doc_id
"""

OP4 = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (
  SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
         max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size
  FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
)
"""

OP10 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]'
  FROM range(2) AS r(t)
), marks AS (
  SELECT ['<|turn|>', '<|text|>', '<|end|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>',
          '<</SYS>>', '<|im_start|>', '<|im_end|>', '<|endoftext|>'] AS controls
), sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
         lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         -- each control string and each escape character costs one more character
         length(text) + length(text) - length(replace(text, '␛', ''))
         + list_sum(list_transform(controls, lambda c:
             (length(text) - length(replace(text, c, ''))) // length(c))) AS escaped
  FROM rows, marks
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(8 + length(role) + 8 + escaped + 8) AS BIGINT) AS formatted_chars,
       bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'),
                                   ('user', 'assistant'), ('assistant', 'user'),
                                   ('assistant', 'tool'), ('tool', 'assistant')))
         AND arg_max(role, n) = 'assistant' AS valid
FROM sized GROUP BY conv_id
"""

OP6 = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), places AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS place FROM docs
), grams AS (
  SELECT doc_id, place, w, lag(w) OVER here AS v, lag(w, 2) OVER here AS u
  FROM places WINDOW here AS (PARTITION BY doc_id ORDER BY place)
), counted AS (
  -- occurrences in other documents
  SELECT doc_id, place, u, v,
         count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY doc_id, u, v, w) AS three,
         count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) AS two,
         count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS one,
         greatest(1, count(*) OVER () - count(*) OVER (PARTITION BY doc_id)) AS others
  FROM grams
), contexts AS (
  SELECT *, lag(two) OVER here AS two_before, lag(one) OVER here AS one_before
  FROM counted WINDOW here AS (PARTITION BY doc_id ORDER BY place)
), scored AS (
  SELECT doc_id,
         CASE WHEN u IS NOT NULL AND three > 0 THEN ln(three / two_before)
              WHEN v IS NOT NULL AND two > 0 THEN ln(0.4 * two / one_before)
              WHEN one > 0 THEN ln(0.4 * 0.4 * one / others)
              ELSE ln(0.4 * 0.4 * 0.4 / others) END AS s
  FROM contexts
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, round(t, 4) AS log_score, round(t / len(words), 6) AS per_word
FROM docs LEFT JOIN (SELECT doc_id, sum(s) AS t FROM scored GROUP BY doc_id) USING (doc_id)
"""

OP12 = """
WITH vectors AS (
  SELECT row_number() OVER () AS uid, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.uid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0 AND a.uid <> b.uid
), positives AS (
  SELECT uid, anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE same QUALIFY place <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (
         PARTITION BY p.uid, place ORDER BY score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored n ON n.uid = p.uid AND NOT same
     AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

OP13 = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), one AS (
  SELECT lang, a, count(*) AS f FROM (SELECT lang, unnest(w) AS a FROM words) GROUP BY ALL
), two AS (
  SELECT lang, a, b, count(*) AS f
  FROM (SELECT lang, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM words WHERE len(w) > 1) GROUP BY ALL HAVING f >= 10
), three AS (
  SELECT lang, a, b, c, count(*) AS f
  FROM (SELECT lang, unnest(w[:-3]) AS a, unnest(w[2:-2]) AS b, unnest(w[3:]) AS c FROM words WHERE len(w) > 2)
  GROUP BY ALL HAVING f >= 10
), longer AS (
  SELECT lang, a, b, max(f) AS most
  FROM (SELECT lang, a, b, f FROM three UNION ALL SELECT lang, b, c, f FROM three) GROUP BY ALL
), cuts AS (
  SELECT t.lang, t.a || ' ' || t.b AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM two t JOIN one x ON x.lang = t.lang AND x.a = t.a JOIN one y ON y.lang = t.lang AND y.a = t.b
  LEFT JOIN longer m ON m.lang = t.lang AND m.a = t.a AND m.b = t.b
  WHERE coalesce(100 * most < 50 * t.f, true)
  UNION ALL
  SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, t.f, 1, x.f, y.f
  FROM three t JOIN one x ON x.lang = t.lang AND x.a = t.a
  JOIN two y ON y.lang = t.lang AND y.a = t.b AND y.b = t.c
  UNION ALL
  SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, t.f, 2, x.f, y.f
  FROM three t JOIN two x ON x.lang = t.lang AND x.a = t.a AND x.b = t.b
  JOIN one y ON y.lang = t.lang AND y.a = t.c
), scored AS (
  SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM scored JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang) USING (lang)
QUALIFY rank <= 2000
"""

SQL = {"op13_collocations": OP13, "op12_hard_negatives": OP12, "op1_line_dedup": OP1, "op6_lm_score": OP6, "op4_exact_dedup": OP4, "op10_chat_format": OP10}

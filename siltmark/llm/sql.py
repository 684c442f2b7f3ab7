"""SQL of sizes and of the rules on repetition."""

#: Tokens, about: words, numbers, signs and blanks as tokenizers split text before they merge.
TOKENS = r"""n AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+')), 0) AS n FROM documents)"""

WORDS = r"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) AS i FROM documents),
g AS (SELECT doc_id, i, string_agg(word, ' ') OVER v AS gram, count(*) OVER v AS n FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
r AS (SELECT doc_id, i, n = 8 AND row_number() OVER (PARTITION BY doc_id, gram, n ORDER BY i) > 1 AS again FROM g),
m AS (SELECT doc_id, i, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS marked FROM r),
c AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (marked) AS repeated_words FROM m GROUP BY doc_id)
"""

#: White space at the ends of a part, as Python takes it off.
_BLANK = r"[\s\pZ\x{0b}\x{1c}-\x{1f}\x{85}]"
_PARTS = {"line": "string_split(text, chr(10))", "paragraph": rf"string_split_regex(text, '\n{_BLANK}*\n')", "sentence": r"string_split_regex(s, '\n+')"}
_SPLIT = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, unnest({cut}) AS part, generate_subscripts({cut}, 1) AS i FROM t" for kind, cut in _PARTS.items())

#: Needs WORDS before it.
RULES = rf"""t AS (SELECT doc_id, text, regexp_replace(text, '([.!?。！？]){_BLANK}+', '\1' || chr(10), 'g') AS s FROM documents),
parts AS ({_SPLIT}),
p AS (SELECT doc_id, kind, i, regexp_replace(part, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS part FROM parts),
q AS (SELECT doc_id, kind, length(part) AS n, row_number() OVER (PARTITION BY doc_id, kind, part ORDER BY i) > 1 AS again FROM p),
h AS (SELECT doc_id, kind, CASE WHEN sum(n) > 0 THEN coalesce(sum(n) FILTER (again), 0)::DOUBLE / sum(n)::DOUBLE ELSE 0 END AS share FROM q GROUP BY ALL),
shares AS (SELECT doc_id, max(share) FILTER (kind = 'line') AS line_share, max(share) FILTER (kind = 'paragraph') AS paragraph_share, max(share) FILTER (kind = 'sentence') AS sentence_share FROM h GROUP BY doc_id),
k AS (SELECT d.doc_id, d.source, coalesce(n_words, 0) AS n_words, coalesce(repeated_words, 0) AS repeated_words, coalesce(line_share, 0) AS line_share,
  coalesce(paragraph_share, 0) AS paragraph_share, coalesce(sentence_share, 0) AS sentence_share FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN shares USING (doc_id)),
j AS (SELECT *, repeated_words * 100 > n_words * 30 AS words_fail, line_share > 0.3 AS lines_fail, paragraph_share > 0.3 AS paragraphs_fail, sentence_share > 0.3 AS sentences_fail FROM k),
o AS (SELECT source AS host, count(*) AS docs, CAST(sum((words_fail OR lines_fail OR paragraphs_fail OR sentences_fail)::INT) AS BIGINT) AS failures FROM j GROUP BY source),
m2 AS (SELECT sum(failures)::DOUBLE / sum(docs)::DOUBLE AS mean, var_pop(failures / docs) AS v, avg(docs) AS size, count(*) AS hosts FROM o),
s2 AS (SELECT *, mean * (1 - mean) AS spread, greatest(v - mean * (1 - mean) / greatest(size, 1), 0) AS apart FROM m2),
b AS (SELECT mean, CASE WHEN apart > 0 THEN least(greatest(spread / apart - 1, 1), 1e6) WHEN hosts > 1 THEN 1e6 ELSE 1 END AS strength FROM s2),
r2 AS (SELECT host, docs, failures, (failures + mean * strength) / (docs + mean * strength + (1 - mean) * strength) AS rate FROM o, b)
"""

"""DuckDB SQL for the queries whose whole result SQL can express, over the tables as registered by name."""

from __future__ import annotations

CHAT_FORMATTING = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows
), placed AS (
  SELECT *, row_number() OVER o AS k, role IS DISTINCT FROM lag(role) OVER o AS opens
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>)', '\1\\\2\3', 'g'))
    + CASE WHEN opens THEN length('<|turn|>') + length(url_encode(role)) + 1 + length('<|end|>') + 1 ELSE length('<|next|>') END AS chars
  FROM placed
), joined AS (
  SELECT conv_id, count(*) AS n, sum(chars) AS chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS all_text,
    coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss
  FROM sized GROUP BY conv_id
)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(all_text) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM joined
"""

NEAR_DEDUP = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), spread AS (
  SELECT doc_id, len(words) AS n, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs
), windows AS (
  SELECT doc_id, n, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM spread WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), sets AS (
  SELECT DISTINCT doc_id, CASE WHEN n >= 3 THEN w || ' ' || w2 || ' ' || w3 WHEN n = 2 THEN w || ' ' || w2 ELSE w END AS s
  FROM windows WHERE i = 1 OR w3 IS NOT NULL
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, low) AS (
  SELECT a, b FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.low = e.a
), lowest AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON node = d.doc_id
"""

QUALITY_RULES = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), lines AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, string_split(t, chr(10)) AS every,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS worded
  FROM docs
), spread AS (
  SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM lines
), windows AS (
  SELECT r, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM spread WINDOW o AS (PARTITION BY r ORDER BY i)
), found AS (
  SELECT r, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS hit FROM windows
), covered AS (
  SELECT r, hit OR coalesce(lag(hit, 1) OVER o, false) OR coalesce(lag(hit, 2) OVER o, false) AS hit FROM found WINDOW o AS (PARTITION BY r ORDER BY i)
), repeats AS (SELECT r, count(*) FILTER (hit) AS n FROM covered GROUP BY r),
measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(worded) - len(list_distinct(worded)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(every) AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs
  FROM lines LEFT JOIN repeats USING (r)
), masked AS (
  SELECT *, CAST(
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_upper > 60 * n_letters THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_bangs > 30 * n_words THEN 32 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 64 ELSE 0 END AS BIGINT) AS fail_mask
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_mask & 3 <> 0 AS base_failed, fail_mask = 0 AS kept, fail_mask
FROM masked
"""

LM_SCORING = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), spread AS (
  SELECT r, unnest(words) AS z, generate_subscripts(words, 1) AS i FROM docs
), placed AS (
  SELECT r, i, z, lag(z, 1) OVER o AS y, lag(z, 2) OVER o AS x FROM spread WINDOW o AS (PARTITION BY r ORDER BY i)
), one AS (SELECT z, count(*) AS n FROM placed GROUP BY z),
two AS (SELECT y, z, count(*) AS n FROM placed WHERE i >= 2 GROUP BY y, z),
three AS (SELECT x, y, z, count(*) AS n FROM placed WHERE i >= 3 GROUP BY x, y, z),
scored AS (
  SELECT r, CASE WHEN t.n >= 2 THEN ln(t.n) - ln(h.n) WHEN b.n >= 2 THEN CASE WHEN i >= 3 THEN ln(0.4) ELSE 0 END + ln(b.n) - ln(u.n)
    ELSE least(i - 1, 2) * ln(0.4) + ln(v.n) - ln((SELECT count(*) FROM spread)) END AS s,
    CASE WHEN t.n >= 2 THEN 3 WHEN b.n >= 2 THEN 2 ELSE 1 END < least(i, 3) AS backed
  FROM placed p LEFT JOIN three t ON t.x = p.x AND t.y = p.y AND t.z = p.z LEFT JOIN two h ON h.y = p.x AND h.z = p.y
    LEFT JOIN two b ON b.y = p.y AND b.z = p.z LEFT JOIN one u ON u.z = p.y JOIN one v ON v.z = p.z
), summed AS (SELECT r, count(*) AS n, count(*) FILTER (backed) AS nb, sum(s) AS s FROM scored GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(nb, 0) AS BIGINT) AS n_backoff, round(coalesce(s, 0.0), 4) AS log_score, round(s / n, 4) AS per_word
FROM docs LEFT JOIN summed USING (r)
"""

WORD_COUNTS = r"""
SELECT source, lang, 'words' AS tokenizer_version, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n_tokens,
  CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars
FROM documents GROUP BY source, lang
"""

WARC_ARCHIVE = """
WITH rows AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM rows
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM firsts
"""

PHRASE_MINING = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents
), pieces AS (
  SELECT r, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS p FROM docs
), split AS (
  SELECT r, lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), spread AS (
  SELECT r, lang, p, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM split
), windows AS MATERIALIZED (
  SELECT lang, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d FROM spread WINDOW o AS (PARTITION BY r, p ORDER BY i)
), counted AS MATERIALIZED (
  SELECT lang, [a] AS ws, count(*) AS f FROM windows GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [a, b], count(*) FROM windows WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [a, b, c], count(*) FROM windows WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [a, b, c, d], count(*) FROM windows WHERE d IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
), candidates AS (SELECT lang, ws, f FROM counted WHERE len(ws) > 1),
parts AS MATERIALIZED (
  SELECT lang, ws, f AS a, k, ws[1:k] AS first_part, ws[k + 1:] AS rest FROM candidates, range(1, 4) t(k) WHERE k < len(ws)
), cuts AS (
  SELECT p.lang, p.ws, a, k, x.f AS l, y.f AS r, (CAST(a AS HUGEINT) * 2000000) // (x.f + y.f) AS score
  FROM parts p JOIN counted x ON x.lang = p.lang AND x.ws = p.first_part JOIN counted y ON y.lang = p.lang AND y.ws = p.rest
), scored AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) AS place FROM cuts) WHERE place = 1
), longer AS (
  SELECT c.lang, c.ws[i:i + size - 1] AS ws, max(c.f) AS f FROM candidates c, range(1, 4) s(i), range(2, 4) t(size) WHERE size < len(c.ws) AND i + size - 1 <= len(c.ws) GROUP BY ALL
), kept AS (
  SELECT s.lang, array_to_string(s.ws, ' ') AS phrase, s.a, s.l, s.r, CAST(s.score AS BIGINT) AS score
  FROM scored s LEFT JOIN longer g ON g.lang = s.lang AND g.ws = s.ws WHERE g.f IS NULL OR 100 * g.f < 80 * s.a
), sizes AS (SELECT lang, count(*) AS n FROM spread GROUP BY lang),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

_FIELDS = "||".join(f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))

#: CRC-32 of an id as text: each byte is put in by xor and shifted out by eight steps, which -1 stands for.
_CRC32 = """list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END)"""

MERKLE_MANIFEST = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('=' || source, '') AS src, sha256({_FIELDS.format(text="text")}) AS leaf, sha256({_FIELDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS lower_leaf,
    coalesce(xor({_CRC32}, 4294967295) % 5 = 0, FALSE) AS changed
  FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY encode(src), doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs
), nodes(src, lvl, pos, h, n) AS (
  SELECT src, 0, pos, leaf, count(*) OVER (PARTITION BY src) FROM numbered
  UNION ALL
  SELECT src, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM nodes WHERE n > 1 GROUP BY src, lvl, pos // 16, n
), subs AS (
  SELECT src, h AS subroot, lvl AS top, row_number() OVER (ORDER BY encode(src)) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), over_nodes(lvl, pos, h, n) AS (
  SELECT 0, place, subroot, n FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM over_nodes WHERE n > 1 GROUP BY lvl, pos // 16, n
), runs AS (
  SELECT src, lvl, pos // 16 AS up, list(h ORDER BY pos) AS hs FROM nodes WHERE n > 1 GROUP BY ALL
), over_runs AS (
  SELECT lvl, pos // 16 AS up, list(h ORDER BY pos) AS hs FROM over_nodes WHERE n > 1 GROUP BY ALL
), climb(doc_id, src, leaf, pos, lvl, place, proof, h) AS (
  SELECT doc_id, src, leaf, pos, 0, pos, '', CASE WHEN changed THEN lower_leaf ELSE leaf END FROM numbered
  UNION ALL
  SELECT c.doc_id, c.src, c.leaf, c.pos, c.lvl + 1, c.place // 16,
    c.proof || array_to_string(list_concat(hs[1:c.place % 16], hs[c.place % 16 + 2:]), ''), sha256(array_to_string(list_concat(list_append(hs[1:c.place % 16], c.h), hs[c.place % 16 + 2:]), ''))
  FROM climb c JOIN runs r ON r.src = c.src AND r.lvl = c.lvl AND r.up = c.place // 16
), lower_part AS (
  SELECT c.*, s.subroot, s.place AS start FROM climb c JOIN subs s ON s.src = c.src AND s.top = c.lvl
), upper_climb(doc_id, src, leaf, pos, subroot, lvl, place, proof, h) AS (
  SELECT doc_id, src, leaf, pos, subroot, 0, start, proof, h FROM lower_part
  UNION ALL
  SELECT c.doc_id, c.src, c.leaf, c.pos, c.subroot, c.lvl + 1, c.place // 16,
    c.proof || array_to_string(list_concat(hs[1:c.place % 16], hs[c.place % 16 + 2:]), ''), sha256(array_to_string(list_concat(list_append(hs[1:c.place % 16], c.h), hs[c.place % 16 + 2:]), ''))
  FROM upper_climb c JOIN over_runs r ON r.lvl = c.lvl AND r.up = c.place // 16
), root AS (SELECT h AS root, lvl AS top FROM over_nodes WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM upper_climb JOIN root ON top = lvl
"""

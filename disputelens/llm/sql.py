"""DuckDB SQL of the queries that SQL can express (tests and the driver's check only)."""

from __future__ import annotations

#: Words of a text lower-cased in A-Z; the two word classes of the contracts.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_NON_SPACE = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def alnum_words(text: str) -> str:
    return _ALNUM.format(_LOWER.format(f"coalesce({text}, '')"))


def spaced_words(text: str, lower: bool) -> str:
    text = f"coalesce({text}, '')"
    return _NON_SPACE.format(_LOWER.format(text) if lower else text)


NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, {spaced_words('text', True)} AS w FROM documents
), members AS MATERIALIZED (
  SELECT DISTINCT doc_id, concat_ws(' ', w, lead(w, 1) OVER d, lead(w, 2) OVER d, lead(w, 3) OVER d,
                                    lead(w, 4) OVER d) AS shingle
  FROM (SELECT doc_id, len(w) AS n, unnest(w) AS w, unnest(range(len(w))) AS i FROM words)
  WINDOW d AS (PARTITION BY doc_id ORDER BY i) QUALIFY i + 5 <= n OR i = 0
), sets AS MATERIALIZED (
  SELECT doc_id, count(shingle) AS n FROM words LEFT JOIN members USING (doc_id) GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter
  FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), linked AS MATERIALIZED (
  SELECT x, y FROM shared JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
  WHERE 100 * inter >= 75 * (a.n + b.n - inter)
), edges AS MATERIALIZED (
  SELECT x, y FROM linked UNION SELECT y, x FROM linked
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least USING (doc_id)
"""

DECONTAMINATE = f"""
WITH words AS MATERIALIZED (
  SELECT doc_id, {alnum_words('text')} AS w FROM documents
), items AS MATERIALIZED (
  SELECT item_id, {alnum_words('text')} AS w FROM benchmark
), windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), running AS MATERIALIZED (
  SELECT doc_id, i, left_over, concat_ws(' ', {", ".join(f"lead(w, {k}) OVER d" if k else "w" for k in range(10))}) AS ten,
         w AS one
  FROM (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i, unnest(range(len(w), 0, -1)) AS left_over FROM words)
  WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), places AS (
  SELECT doc_id, i, n, array_to_string(string_split(ten, ' ')[1:n], ' ') AS words
  FROM running, (SELECT DISTINCT n FROM windows)
  WHERE left_over >= n AND (n, one) IN (SELECT n, string_split(words, ' ')[1] FROM windows)
), found AS MATERIALIZED (
  SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, words)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

CAPTURES = """
WITH payload AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), first AS (
  SELECT page_id, n, digest, max(page_id) OVER (PARTITION BY digest, n) AS keeper FROM payload
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM first
"""

#: SHA-256 of a turn, as the trie names it; turns of a conversation in order.
_TURN_DIGEST = "sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))"

PREFIX_TRIE = f"""
WITH RECURSIVE bits(b, v, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), step AS MATERIALIZED (
  SELECT b, v FROM bits WHERE k = 8
), turns AS MATERIALIZED (
  SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place
  FROM (SELECT conv_id, turn, {_TURN_DIGEST} AS digest, len({spaced_words('text', False)}) AS words
        FROM conversations WHERE conv_id IS NOT NULL)
), convs AS MATERIALIZED (
  SELECT conv_id, conv_id::VARCHAR AS s, count(*) AS n FROM turns GROUP BY 1
), crc(conv_id, s, i, v) AS (
  SELECT conv_id, s, 0, 4294967295::BIGINT FROM convs
  UNION ALL
  SELECT conv_id, s, i + 1, xor(crc.v >> 8, step.v) FROM crc
  JOIN step ON step.b = xor(crc.v & 255, ascii(substr(s, i + 1, 1))) WHERE i < length(s)
), plan AS MATERIALIZED (
  SELECT c.conv_id, c.n, h, least(h, coalesce(d.n, 0)) AS taken, c.conv_id - c.conv_id % 20 AS donor
  FROM (SELECT conv_id, n, xor(v, 4294967295) % 4 AS h FROM convs JOIN crc USING (conv_id) WHERE i = length(crc.s)) c
  LEFT JOIN convs d ON d.conv_id = c.conv_id - c.conv_id % 20
), rebuilt AS (
  SELECT conv_id, place - h + taken AS depth, digest, words FROM turns JOIN plan USING (conv_id) WHERE place > h
  UNION ALL
  SELECT p.conv_id, t.place, digest, words FROM plan p JOIN turns t ON t.conv_id = p.donor AND t.place <= p.taken
), prefixes AS MATERIALIZED (
  SELECT conv_id, depth, words, sha256(string_agg(digest, '') OVER w) AS name,
         depth = count(*) OVER (PARTITION BY conv_id) AS last
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
  UNION ALL
  SELECT conv_id, 0, 0, '', taken = 0 AND n <= h FROM plan
), linked AS MATERIALIZED (
  SELECT *, lag(name) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM prefixes
), nodes AS MATERIALIZED (
  SELECT name, any_value(above) AS above, any_value(depth) AS depth, any_value(words) AS words,
         min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM linked GROUP BY name
), children AS (
  SELECT above AS name, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY 1
), known AS MATERIALIZED (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (name)
), subtrees AS (
  SELECT p.name, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * k.words) AS saved_tokens
  FROM known k JOIN prefixes p ON p.conv_id = k.conv_id AND p.depth <= k.depth GROUP BY 1
)
SELECT k.conv_id, k.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs::BIGINT AS n_convs,
       k.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM known k JOIN subtrees USING (name) LEFT JOIN nodes p ON p.name = k.above
"""

#: A control string of the chat template, with the backslashes that escapes have put into it.
_CONTROL = r"[<\[]\\*/?(s>|INST\])"

CHAT_FORMAT = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL
  SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, {_TURN_DIGEST} AS digest,
         length(role) + length(text) + 3 + 4 + CASE WHEN role = 'assistant' THEN 7 ELSE 6 END
         + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}')) AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, digest)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, digest)) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

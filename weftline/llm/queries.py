"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from weftline.llm.chat_format import op3_chat_format
from weftline.llm.conversation_trie import op13_conversation_trie
from weftline.llm.fill_middle import op12_fill_middle
from weftline.llm.language_id import op1_language_id
from weftline.llm.maxent_lm import op7_maxent_lm
from weftline.llm.mtree_search import op9_top_k
from weftline.llm.order_minhash import op10_near_duplicates
from weftline.llm.packing import op6_packing
from weftline.llm.pii import op2_pii
from weftline.llm.pieces import op8_piece_encoding
from weftline.llm.suffix_dedup import op11_suffix_dedup
from weftline.llm.toxicity import op5_toxicity
from weftline.llm.weighted_sampling import op4_fingerprints

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_pii": op2_pii,
    "op3_chat_format": op3_chat_format,
    "op4_fingerprints": op4_fingerprints,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_maxent_lm": op7_maxent_lm,
    "op8_piece_encoding": op8_piece_encoding,
    "op9_top_k": op9_top_k,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_fill_middle": op12_fill_middle,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL = {
    "op3_chat_format": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
    regexp_replace(regexp_replace(regexp_replace(text, '&(amp|lt|lb|nl);', '&amp;\\1;', 'g'),
      '<(\\|im_start\\|>|\\|im_sep\\|>|\\|im_end\\|>|/?s>|</?SYS>>|\\|endoftext\\|>|\\|startoftext\\|>)', '&lt;\\1', 'g'),
      '\\[(/?INST\\])', '&lb;\\1', 'g') AS escaped,
    CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS opens
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), d AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum(length(escaped) + CASE WHEN opens = 1 THEN 12 + length(role) + 1 + 11 ELSE 10 END)::BIGINT AS formatted_chars,
    sum(opens)::BIGINT AS n_blocks
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars, n_blocks
FROM d
""",
    "op9_top_k": """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op11_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
w AS (
  SELECT doc_id, p, t[p:p + 99] AS s FROM (SELECT doc_id, t, unnest(range(1, octet_length(t) - 98)) AS p FROM d)
), r AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS repeated FROM w
), b AS (
  SELECT doc_id, t, unnest(range(1, octet_length(t) + 1)) AS p FROM d
), c AS (
  SELECT b.doc_id, b.p, hex(b.t[b.p:b.p]) AS byte,
    coalesce(bool_or(r.repeated) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS 99 PRECEDING), false) AS gone
  FROM b LEFT JOIN r USING (doc_id, p)
), e AS (
  SELECT *, lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY p) AS was FROM c
), f AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT was) AS n_spans,
    coalesce(string_agg(byte, '' ORDER BY p) FILTER (NOT gone), '') AS kept
  FROM e GROUP BY doc_id
)
SELECT doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN f USING (doc_id)
""",
    "op12_fill_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), h AS (
  SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT % (len(u) + 1) AS i, ('0x' || s[9:16])::BIGINT % (len(u) + 1) AS j,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || s[17:24])::BIGINT % 100 >= 50 THEN 'plain'
         WHEN ('0x' || s[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(i, j)], '') AS prefix,
    array_to_string(u[least(i, j) + 1:greatest(i, j)], '') AS middle, array_to_string(u[greatest(i, j) + 1:], '') AS suffix
  FROM h
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
""",
    "op13_conversation_trie": """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS r
  FROM conversations
), h AS (
  SELECT c, s, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295, range(0, 8 * length(s))),
      lambda x, i: (xor(x, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1]) ELSE 0 END) >> 1)
        .xor(3988292384 * (xor(x, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1]) ELSE 0 END) & 1))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c, c::VARCHAR AS s FROM t)
), k AS (
  SELECT h.c, h.h, count(t.r) AS k FROM h LEFT JOIN t ON t.c = h.base AND t.r < h.h GROUP BY h.c, h.h
), p AS (
  SELECT h.c, t.r + 1 AS depth, t.role, t.text FROM h JOIN t ON t.c = h.base AND t.r < h.h
  UNION ALL SELECT t.c, t.r - k.h + k.k + 1, t.role, t.text FROM t JOIN k ON t.c = k.c AND t.r >= k.h
), q AS (
  SELECT c, depth, string_agg(md5(length(role) || ' ' || role || text), '') OVER (PARTITION BY c ORDER BY depth) AS node,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, depth = max(depth) OVER (PARTITION BY c) AS ends
  FROM p
  UNION ALL SELECT c, 0, '', 0, c NOT IN (SELECT c FROM p) FROM h
), n AS (
  SELECT depth, node, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS members
  FROM q GROUP BY depth, node
), e AS (
  SELECT p.*, count(c.node) AS n_children, any_value(u.conv_id) AS parent_conv_id
  FROM n p LEFT JOIN n c ON c.depth = p.depth + 1 AND left(c.node, 32 * p.depth) = p.node
    LEFT JOIN n u ON u.depth = p.depth - 1 AND left(p.node, 32 * u.depth) = u.node
  GROUP BY ALL
), s AS (
  SELECT a.depth, a.node, sum((d.n_convs - 1) * d.words) AS saved_tokens, count(*) FILTER (d.n_children = 0) AS n_leaves
  FROM e a JOIN q ON q.depth = a.depth AND q.node = a.node JOIN e d ON d.conv_id = q.c AND d.depth >= a.depth
  GROUP BY a.depth, a.node
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(members) AS ends_sha256
FROM e JOIN s USING (depth, node)
""",
}

"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from delver.llm import chat as _chat
from delver.llm import decontaminate as _decontaminate
from delver.llm import hnsw as _hnsw
from delver.llm import htmltext as _htmltext
from delver.llm import langid as _langid
from delver.llm import linededup as _linededup
from delver.llm import lmscore as _lmscore
from delver.llm import minhash as _minhash
from delver.llm import mixing as _mixing
from delver.llm import secrets as _secrets

QUERIES = {
    "op2_lm_score": _lmscore.op2_lm_score,
    "op5_near_vectors": _hnsw.op5_near_vectors,
    "op7_secrets": _secrets.op7_secrets,
    "op3_chat_format": _chat.op3_chat_format,
    "op1_html_text": _htmltext.op1_html_text,
    "op10_mixing": _mixing.op10_mixing,
    "op4_minhash": _minhash.op4_minhash,
    "op6_decontaminate": _decontaminate.op6_decontaminate,
    "op8_line_dedup": _linededup.op8_line_dedup,
    "op9_language_id": _langid.op9_language_id,
}

_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES = {
    "op5_near_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a
""",
    "op3_chat_format": r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(22 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|'))) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
""",
    "op8_line_dedup": r"""
WITH l AS (
  SELECT doc_id, source, i, parts[i] AS line, trim(parts[i], e' \t\r') AS k
  FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, e'\n') AS parts FROM documents WHERE text IS NOT NULL))),
bad AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 10),
m AS (SELECT l.*, bad.k IS NOT NULL AS gone FROM l LEFT JOIN bad ON l.k = bad.k),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, e'\n' ORDER BY i) FILTER (WHERE NOT gone), '') AS text FROM m GROUP BY doc_id)
SELECT d.doc_id, t.text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed FROM documents d LEFT JOIN t USING (doc_id)
""",
    "op6_decontaminate": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
""",
}

"""Queries over pages: anchors are link mentions, first path elements are categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from delver.functions.text import edit_distance, tokens
from delver.operators import wiki as op

QUERIES, ORACLES = {}, {}
L = """m AS (SELECT page_id, unnest(x) AS m, unnest(range(len(x))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS x FROM pages WHERE html IS NOT NULL)),
l AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(m, 'href="([^"]*)"', 1) AS ref, regexp_extract(m, '>([^<]*)<', 1) AS surface FROM m),
n AS (SELECT *, coalesce(lag(surface) OVER w, '') AS l, coalesce(lead(surface) OVER w, '') AS r FROM l WINDOW w AS (PARTITION BY page_id ORDER BY pos))"""


def _p(s, d):
    return s.read.parquet(f"{d}/pages.parquet")


QUERIES["wk_links"] = lambda s, d: op.neighbours(op.links(_p(s, d)))
ORACLES["wk_links"] = f'WITH {L} SELECT page_id, pos, ref, surface, l AS "left", r AS "right" FROM n'
QUERIES["wk_categories"] = lambda s, d: op.categories(_p(s, d))
C = "c AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS category FROM pages WHERE NOT contains(regexp_extract(html, '<title>([^<]*)', 1), ':'))"
ORACLES["wk_categories"] = f"WITH {C} SELECT * FROM c WHERE category <> ''"
_T = {"person": "^(en|fr)$", "place": "^(de|es)$", "organisation": "[a-z]"}
QUERIES["wk_types"] = lambda s, d: op.typed(op.categories(_p(s, d)), _T)
ORACLES["wk_types"] = f"WITH {C} SELECT page_id, CASE WHEN regexp_matches(category, '^(en|fr)$') THEN 'person' WHEN regexp_matches(category, '^(de|es)$') THEN 'place' ELSE 'organisation' END AS type FROM c WHERE regexp_matches(category, '[a-z]')"
QUERIES["wk_surfaces"] = lambda s, d: op.surfaces(op.links(_p(s, d)))
ORACLES["wk_surfaces"] = f"WITH {L} SELECT surface, count(*) AS n, count(DISTINCT page_id) AS n_pages, count(DISTINCT ref) AS refs FROM l GROUP BY surface"
FE = f"""{L}, s AS (SELECT DISTINCT surface FROM n WHERE surface <> ''), t AS (SELECT surface, count(*) AS n FROM n GROUP BY surface),
f AS (SELECT surface, 'first:' || surface[1] AS feature, CAST(1 AS DOUBLE) AS value FROM s UNION ALL SELECT surface, 'last:' || surface[-1:], 1 FROM s UNION ALL SELECT surface, 'first2:' || surface[1:2], 1 FROM s
UNION ALL SELECT surface, 'last2:' || surface[-2:], 1 FROM s UNION ALL SELECT surface, 'length', least(length(surface) / 10.0, 1) FROM s
UNION ALL SELECT surface, 'left:' || l, count(*) / any_value(t.n) FROM n JOIN t USING (surface) WHERE surface <> '' AND l <> '' GROUP BY surface, l
UNION ALL SELECT surface, 'right:' || r, count(*) / any_value(t.n) FROM n JOIN t USING (surface) WHERE surface <> '' AND r <> '' GROUP BY surface, r)"""
QUERIES["wk_features"] = lambda s, d: op.features(op.neighbours(op.links(_p(s, d)))).withColumn("value", F.round("value", 6))
ORACLES["wk_features"] = f"WITH {FE} SELECT surface, feature, round(value, 6) AS value FROM f"
QUERIES["src_libsvm"] = lambda s, d: op.libsvm(op.features(op.neighbours(op.links(_p(s, d)))))
ORACLES["src_libsvm"] = f"""WITH {FE}, i AS (SELECT feature, row_number() OVER (ORDER BY feature) AS i FROM (SELECT DISTINCT feature FROM f))
SELECT surface, string_agg(CAST(i AS VARCHAR) || ':' || format('{{:.4f}}', value), ' ' ORDER BY i) AS line FROM f JOIN i USING (feature) GROUP BY surface"""
QUERIES["an_tokens"] = lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(tokens("text")).cast("long").alias("n"), F.md5(F.array_join(tokens("text"), " ").cast("binary")).alias("h"))
ORACLES["an_tokens"] = r"WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), []) AS w FROM documents) SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, ' ')) AS h FROM t"
QUERIES["an_levenshtein"] = lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", edit_distance(F.col("p_name"), F.col("p_type")).cast("long").alias("dist"))
ORACLES["an_levenshtein"] = "SELECT p_partkey, levenshtein(lower(p_name), lower(p_type)) AS dist FROM part"

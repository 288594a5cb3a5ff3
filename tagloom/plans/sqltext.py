"""Common table expressions of the checking SQL: the bindings written for the SQL side."""

GROUP_CASE = """CASE {c} WHEN 9 THEN 'rating' WHEN 1 THEN 'artist' WHEN 3 THEN 'copyright'
  WHEN 4 THEN 'character' ELSE 'general' END"""

SOURCE_TAGS = """source_tags AS (
  SELECT CAST(p_partkey AS INTEGER) AS tag_id, replace(p_name, ' ', '_') || '_' || p_partkey AS name,
         CAST(p_partkey % 10 AS INTEGER) AS category, CAST(p_size AS BIGINT) AS cnt FROM part)"""

TRANSLATIONS = """translations AS (
  SELECT tag_id AS id, name AS tag,
         CASE WHEN tag_id % 5 = 0 THEN '' WHEN tag_id % 7 = 0 THEN name ELSE upper(name) END AS translation
  FROM source_tags WHERE tag_id % 4 <> 3)"""

LABEL_PARTS = """label_parts AS (
  SELECT CAST(p_partkey % 64 AS INTEGER) AS k, arg_min(p_name, p_partkey) AS p_name, CAST(sum(p_size) AS BIGINT) AS cnt FROM part GROUP BY 1)"""

CATALOG = LABEL_PARTS + f""", catalog AS (
  SELECT k AS tag_index, replace(p_name, ' ', '_') || '_' || k AS name,
         CASE WHEN k % 5 = 0 THEN '' ELSE upper(p_name) END AS translation, k % 10 AS category, cnt,
         {GROUP_CASE.format(c='k % 10')} AS grp
  FROM label_parts)"""

CATALOG_DUP = LABEL_PARTS + f""", catalog AS (
  SELECT k AS tag_index,
         CASE WHEN k % 3 = 0 THEN upper(replace(p_name, ' ', '_')) ELSE replace(p_name, ' ', '_') END AS name,
         CASE WHEN k % 5 = 0 THEN '' ELSE upper(p_name) END AS translation, k % 10 AS category, cnt,
         {GROUP_CASE.format(c='k % 10')} AS grp
  FROM label_parts)"""

GROUPS5 = """groups5(pos, id, display_name, strategy) AS (VALUES
  (0, 'rating', 'RATING', 'rating'), (1, 'artist', NULL, 'threshold'), (2, 'copyright', 'COPYRIGHT', 'threshold'),
  (3, 'character', NULL, 'threshold'), (4, 'general', 'GENERAL', 'threshold'))"""

GROUPS3 = """groups3(pos, id, display_name, strategy) AS (VALUES
  (0, 'rating', 'RATING', 'rating'), (3, 'character', NULL, 'threshold'), (4, 'general', 'GENERAL', 'threshold'))"""

EMB = """emb AS (
  SELECT vec_id AS image_id, label, CAST(unnest(embedding) AS DOUBLE) AS x,
         CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS tag_index FROM embeddings)"""

SCORES = """scores AS (
  SELECT image_id, label, tag_index, CAST(floor((x + 0.6::DOUBLE) / 1.2::DOUBLE * 64) / 64.0::DOUBLE AS FLOAT) AS probability FROM emb)"""

# NaN and infinity as in the binding; the plain rows carry ok = true
SCORES_BAD = """scores_bad AS (
  SELECT image_id, tag_index, CASE WHEN (image_id + tag_index) % 17 = 0 THEN 'nan'::FLOAT
    WHEN (image_id + tag_index) % 19 = 0 THEN 'infinity'::FLOAT ELSE probability END AS probability FROM scores)"""

OVERRIDES = """overrides AS (SELECT image_id, tag_index FROM emb WHERE (image_id * 7 + tag_index) % 11 = 0)"""

IMAGES = """images AS (
  SELECT e.vec_id AS image_id, coalesce(p.url, 'img/' || e.vec_id || '.PNG') AS path,
         regexp_extract(coalesce(p.url, 'img/' || e.vec_id || '.PNG'), '([^/\\\\]*)$', 1) AS file_name,
         e.vec_id * 1500 AS file_size,
         lower(regexp_extract(coalesce(p.url, 'img/' || e.vec_id || '.PNG'), '\\.([A-Za-z]+)$', 1)) AS format,
         CAST(label * 100 + 64 AS INTEGER) AS width, CAST(label * 50 + 48 AS INTEGER) AS height,
         ['not_run', 'queued', 'running', 'succeeded', 'failed', 'canceled', 'stale'][label % 7 + 1] AS state,
         'fp' || (label % 2) AS fingerprint, CASE WHEN label % 7 = 4 THEN 'image_corrupt' END AS last_error
  FROM embeddings e LEFT JOIN pages p ON e.vec_id = p.page_id)"""

LISTING = """listing AS (
  SELECT url AS path, page_id AS seq FROM pages
  UNION ALL SELECT url, page_id + 1000000000 FROM pages WHERE page_id % 4 = 0)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"

"""Queries over predictions: joins to the catalog, thresholds, ranks, summaries."""

from pyspark.sql import functions as F

from tagloom.functions import confidence_band
from tagloom.operators import scores as S
from tagloom.plans import bindings as B
from tagloom.plans.registry import query
from tagloom.plans.sqltext import (
    CATALOG, EMB, GROUPS3, GROUPS5, OVERRIDES, SCORES, SCORES_BAD, with_,
)
from tagloom.session import unnest

BASE = with_(EMB, SCORES, CATALOG)
BAD = with_(EMB, SCORES, SCORES_BAD, CATALOG)
FINITE = "probability < 'infinity'::FLOAT"  # NaN is above infinity, so this drops both


@query("scores_attach_catalog", BASE + """
SELECT image_id, tag_index, probability, name, translation, category, cnt AS count, grp AS "group"
FROM scores JOIN catalog USING (tag_index)""")
def attach_catalog(spark, sf):
    return S.attach_catalog(B.predictions(spark, sf), B.catalog64(spark, sf))


@query("scores_sigmoid", with_(EMB) + """
SELECT image_id, tag_index, round(CAST(CASE WHEN x * 10 < 0 THEN exp(x * 10) / (1 + exp(x * 10)) ELSE 1 / (1 + exp(-x * 10)) END AS FLOAT)::DOUBLE, 6) AS p
FROM emb""")
def sigmoid_scores(spark, sf):
    p = S.activate_logits(B.logits(spark, sf), "sigmoid")
    rows = unnest(p, ["image_id"], "probabilities", "tag_index", "p")
    return rows.withColumn("p", F.round(F.col("p").cast("double"), 6))


@query("scores_activate_none", with_(EMB) + "SELECT image_id, tag_index, CAST(x * 10 AS FLOAT) AS p FROM emb")
def no_activation(spark, sf):
    p = S.activate_logits(B.logits(spark, sf), "none")
    return unnest(p, ["image_id"], "probabilities", "tag_index", "p")


VISIBLE_BAD = BAD + f"""
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY probability DESC, tag_index) AS INTEGER) AS rank,
       tag_index, name, translation, grp AS "group", probability
FROM scores_bad JOIN catalog USING (tag_index) WHERE {FINITE} AND probability >= 0.5::DOUBLE"""


@query("scores_visible", VISIBLE_BAD)
def visible(spark, sf):
    return S.explode_tags(S.visible_tags(B.predictions_bad(spark, sf), B.catalog64(spark, sf), 0.5))


@query("scores_visible_in_group", VISIBLE_BAD + " AND grp = 'character'")
def visible_in_group(spark, sf):
    return S.explode_tags(S.visible_tags(B.predictions_bad(spark, sf), B.catalog64(spark, sf), 0.5, "character"))


@query("scores_ordered_text", BASE + """
SELECT e.vec_id AS image_id, coalesce(string_agg(tag_index, ',' ORDER BY probability DESC, tag_index), '') AS ordered, count(tag_index)::INTEGER AS n
FROM embeddings e LEFT JOIN (SELECT * FROM scores WHERE probability >= 0.6::DOUBLE) s ON s.image_id = e.vec_id GROUP BY e.vec_id""")
def ordered_text(spark, sf):
    v = S.visible_tags(B.predictions(spark, sf), B.catalog64(spark, sf), B.THRESHOLD)
    ids = F.transform("tags", lambda t: t["tag_index"].cast("string"))
    return v.select("image_id", F.array_join(ids, ",").alias("ordered"), F.size("tags").alias("n"))


@query("scores_topk", BASE + """
SELECT image_id, CAST(rank AS INTEGER) AS rank, tag_index, name, translation, grp AS "group", probability
FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY probability DESC, tag_index) AS rank
      FROM scores JOIN catalog USING (tag_index)) WHERE rank <= 50""")
def topk(spark, sf):
    return S.explode_tags(S.topk(B.predictions(spark, sf), B.catalog64(spark, sf), 50))


RANKED = BASE + """
SELECT image_id, grp AS "group", CAST(row_number() OVER (PARTITION BY image_id, grp ORDER BY {o}) AS INTEGER) AS rank,
       tag_index, name, probability
FROM scores JOIN catalog USING (tag_index) WHERE probability >= 0.5::DOUBLE"""


@query("scores_rank_by_confidence", RANKED.format(o="probability DESC, tag_index"))
def rank_by_confidence(spark, sf):
    return S.rank_tags(S.visible_tags(B.predictions(spark, sf), B.catalog64(spark, sf), 0.5), "confidence")


@query("scores_rank_by_name", RANKED.format(o="name, tag_index"))
def rank_by_name(spark, sf):
    return S.rank_tags(S.visible_tags(B.predictions(spark, sf), B.catalog64(spark, sf), 0.5), "name")


TOP_RATING = f"""top_rating AS (
  SELECT image_id, tag_index, name, probability FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY probability DESC, tag_index) AS rn
    FROM {{scores}} JOIN catalog USING (tag_index) WHERE grp = 'rating' AND {FINITE}) WHERE rn = 1)"""


@query("scores_top_rating", with_(EMB, SCORES, SCORES_BAD, CATALOG, TOP_RATING.format(scores="scores_bad")) + "SELECT * FROM top_rating")
def top_rating(spark, sf):
    return S.top_rating(B.predictions_bad(spark, sf), B.catalog64(spark, sf))


@query("scores_visible_count", BAD + """
SELECT image_id, CAST(count(*) FILTER (WHERE NOT isnan(probability) AND probability >= 0.6::DOUBLE) AS INTEGER) AS visible
FROM scores_bad GROUP BY image_id""")
def visible_count(spark, sf):
    p = B.predictions_bad(spark, sf)
    return p.select("image_id", S.visible_tag_count(F.col("probabilities"), B.THRESHOLD).alias("visible"))


SHOWN = f"""shown AS (
  SELECT image_id, grp, tag_index, name, translation, probability, false AS is_top_rating FROM {{scores}} JOIN catalog USING (tag_index)
  WHERE grp <> 'rating' AND {FINITE} AND probability >= 0.6::DOUBLE
  UNION ALL
  SELECT image_id, 'rating', t.tag_index, t.name, c.translation, probability, true FROM top_rating t JOIN catalog c USING (tag_index))"""

ORDER5 = """ordered AS (
  SELECT id, display_name, CAST(row_number() OVER (ORDER BY tier, pos) - 1 AS INTEGER) AS group_pos FROM (
    SELECT id, coalesce(nullif(display_name, ''), id) AS display_name, 0 AS tier, pos FROM {groups}
    UNION ALL SELECT grp, grp, 1, min(tag_index) FROM catalog WHERE grp NOT IN (SELECT id FROM {groups}) GROUP BY grp))"""


@query("scores_group_summary", with_(
    EMB, SCORES, SCORES_BAD, CATALOG, GROUPS5, TOP_RATING.format(scores="scores_bad"), SHOWN.format(scores="scores_bad"), ORDER5.format(groups="groups5")) + """
SELECT i.vec_id AS image_id, group_pos, o.id AS group_id, CAST(count(s.tag_index) AS INTEGER) AS visible, count(s.tag_index) = 0 AS is_empty
FROM embeddings i CROSS JOIN ordered o LEFT JOIN shown s ON s.image_id = i.vec_id AND s.grp = o.id GROUP BY 1, 2, 3""")
def group_summary(spark, sf):
    return S.group_summary(B.predictions_bad(spark, sf), B.catalog64(spark, sf), B.groups5(spark), B.THRESHOLD)


@query("scores_hit_summary", with_(
    EMB, SCORES, CATALOG, TOP_RATING.format(scores="scores"), SHOWN.format(scores="scores")) + """
SELECT e.vec_id AS image_id, CASE WHEN label % 4 = 0 THEN 0 ELSE CAST(count(s.tag_index) AS INTEGER) END AS hit_count,
       64 AS total_count, label % 4 <> 0 AS has_result
FROM embeddings e LEFT JOIN shown s ON s.image_id = e.vec_id GROUP BY e.vec_id, label""")
def hit_summary(spark, sf):
    p = B.predictions(spark, sf).withColumn("probabilities", F.when(F.col("label") % 4 != 0, F.col("probabilities")))
    return S.hit_summary(p, B.catalog64(spark, sf), B.groups5(spark), B.THRESHOLD)


@query("scores_tag_groups", with_(
    EMB, SCORES, CATALOG, GROUPS3, OVERRIDES, TOP_RATING.format(scores="scores"), SHOWN.format(scores="scores"), ORDER5.format(groups="groups3")) + """
SELECT s.image_id, group_pos, o.id AS group_id, o.display_name,
       CAST(row_number() OVER (PARTITION BY s.image_id, o.id ORDER BY probability DESC, s.tag_index) AS INTEGER) AS rank,
       s.tag_index, s.name, s.translation, s.probability, v.tag_index IS NOT NULL AS is_excluded, s.is_top_rating
FROM shown s JOIN ordered o ON o.id = s.grp LEFT JOIN overrides v ON v.image_id = s.image_id AND v.tag_index = s.tag_index""")
def tag_groups(spark, sf):
    return S.tag_groups(
        B.predictions(spark, sf), B.catalog64(spark, sf), B.groups3(spark), B.THRESHOLD, B.overrides(spark, sf)
    )


@query("scores_visible_tag_text", with_(
    EMB, SCORES, CATALOG, GROUPS3, OVERRIDES, TOP_RATING.format(scores="scores"), SHOWN.format(scores="scores"), ORDER5.format(groups="groups3")) + """
SELECT s.image_id, string_agg(s.name, ', ' ORDER BY group_pos, probability DESC, s.tag_index) AS text
FROM shown s JOIN ordered o ON o.id = s.grp
WHERE NOT EXISTS (SELECT 1 FROM overrides v WHERE v.image_id = s.image_id AND v.tag_index = s.tag_index) GROUP BY s.image_id""")
def visible_tag_text(spark, sf):
    return S.visible_tag_text(tag_groups(spark, sf))


@query("scores_display_groups", with_(CATALOG, GROUPS3, ORDER5.format(groups="groups3")) + """
SELECT id, display_name, CASE WHEN id = 'rating' THEN 'rating' ELSE 'threshold' END AS strategy, group_pos AS place FROM ordered""")
def display_groups(spark, sf):
    from pyspark.sql import Window

    g = S.display_groups(B.groups3(spark), B.catalog64(spark, sf))
    return g.select("id", "display_name", "strategy", (F.row_number().over(Window.orderBy("tier", "pos")) - 1).alias("place"))


@query("scores_drop_overrides", with_(EMB, SCORES, OVERRIDES) + """
SELECT image_id, tag_index, probability FROM scores s
WHERE probability >= 0.6::DOUBLE AND NOT EXISTS (
  SELECT 1 FROM overrides v WHERE v.image_id = s.image_id AND v.tag_index = s.tag_index)""")
def drop_overrides(spark, sf):
    tags = S.explode_tags(S.visible_tags(B.predictions(spark, sf), B.catalog64(spark, sf), B.THRESHOLD))
    return S.drop_overrides(tags, B.overrides(spark, sf)).select("image_id", "tag_index", "probability")


@query("scores_tag_display", BASE + """
SELECT image_id, tag_index, CAST(round(CAST(probability * 100 AS DECIMAL(18, 8)), 2) AS DECIMAL(18, 2)) || '%' AS confidence_text,
       CASE WHEN translation = '' OR translation = name THEN '暂无翻译' ELSE translation END AS translation_text
FROM scores JOIN catalog USING (tag_index) WHERE probability >= 0.6::DOUBLE""")
def tag_display(spark, sf):
    tags = S.explode_tags(S.visible_tags(B.predictions(spark, sf), B.catalog64(spark, sf), B.THRESHOLD))
    return S.tag_display(tags).select("image_id", "tag_index", "confidence_text", "translation_text")


@query("scores_confidence_band", BAD + """
SELECT CASE WHEN isnan(probability) THEN 'low' WHEN probability >= 0.9::DOUBLE THEN 'high'
            WHEN probability >= 0.7::DOUBLE THEN 'medium' ELSE 'low' END AS band, count(*) AS n
FROM scores_bad GROUP BY 1""")
def band(spark, sf):
    rows = unnest(B.predictions_bad(spark, sf), [], "probabilities", "i", "p")
    return rows.groupBy(confidence_band(F.col("p")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("scores_selection_digest", with_(EMB, SCORES, SCORES_BAD, CATALOG) + """
SELECT i.vec_id AS image_id, CAST(count(s.tag_index) AS INTEGER) AS selected,
       sha256(coalesce(string_agg(s.tag_index || ':' || name, ',' ORDER BY s.tag_index), '')) AS digest
FROM embeddings i LEFT JOIN (
  SELECT * FROM scores_bad JOIN catalog USING (tag_index) WHERE NOT isnan(probability) AND probability >= 0.6::FLOAT) s
  ON s.image_id = i.vec_id GROUP BY i.vec_id""")
def selection_digest(spark, sf):
    return S.selection_digest(B.predictions_bad(spark, sf), B.catalog64(spark, sf), B.THRESHOLD)


def _second_model(spark, sf):
    shifted = F.transform("probabilities", lambda p, i: F.when(i % 3 == 0, (p - 0.125).cast("float")).otherwise(p))
    return B.predictions(spark, sf).withColumn("probabilities", shifted)


SECOND = """second AS (
  SELECT image_id, tag_index, CASE WHEN tag_index % 3 = 0 THEN CAST(probability - 0.125 AS FLOAT) ELSE probability END AS probability FROM scores)"""


@query("scores_compare_predictions", with_(EMB, SCORES, SECOND) + """
SELECT count(*) AS n_values, max(d) AS max_diff, avg(d) AS mean_diff, avg(CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0 END) AS share_changed,
       avg(CASE WHEN d > 0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS share_over, max(d) <= 0.7::DOUBLE AS within_limit
FROM (SELECT abs(a.probability::DOUBLE - b.probability::DOUBLE) AS d FROM scores a JOIN second b USING (image_id, tag_index))""")
def compare(spark, sf):
    return S.compare_predictions(B.predictions(spark, sf), _second_model(spark, sf), 0.1, 0.7)


@query("scores_topk_overlap", with_(EMB, SCORES, SECOND) + """
, ka AS (SELECT image_id, tag_index FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY probability DESC, tag_index) AS rn FROM scores) WHERE rn <= 10),
kb AS (SELECT image_id, tag_index FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY probability DESC, tag_index) AS rn FROM second) WHERE rn <= 10)
SELECT e.vec_id AS image_id, CAST(count(kb.tag_index) AS INTEGER) AS overlap
FROM embeddings e LEFT JOIN ka ON ka.image_id = e.vec_id LEFT JOIN kb ON kb.image_id = ka.image_id AND kb.tag_index = ka.tag_index GROUP BY e.vec_id""")
def overlap(spark, sf):
    return S.topk_overlap(B.predictions(spark, sf), _second_model(spark, sf), 10)

"""Prompt queries: default rules, full rules, group order, text transforms, totals."""

from pyspark.sql import functions as F

from tagloom.functions import escape_parens, is_emoticon, tag_weight, trim_unicode, underscore_to_space, utf16_length, weighted_text
from tagloom.operators import prompt as P
from tagloom.plans import bindings as B
from tagloom.plans.registry import query
from tagloom.plans.sqltext import CATALOG, CATALOG_DUP, EMB, OVERRIDES, SCORES, SCORES_BAD, with_
from tagloom.session import unnest
from tagloom.rules import NAME, GroupRule, PromptRules, default_rules


def prompt_sql(catalog, scores="scores", threshold="0.6::DOUBLE", extra_ctes="", order="ordered", text="name", weight="text", max_tags=100,
               tag_sep=", ", group_sep=", ", finish="coalesce(body, '')", drop="FALSE", ctes=()):
    """SQL of the whole prompt in the long form: rank, dedupe and truncate with window functions."""
    return with_(EMB, SCORES, SCORES_BAD, catalog, *ctes) + f"""
, labelled AS (SELECT s.image_id, s.tag_index, s.probability, c.name, c.grp, o.rank AS group_rank, o.by_name, o.threshold
  FROM {scores} s JOIN catalog c USING (tag_index) JOIN {order} o ON o.id = c.grp WHERE s.probability < 'infinity'::FLOAT),
rated AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY probability DESC, tag_index) AS rn
  FROM labelled WHERE grp = 'rating') WHERE rn = 1),
picked AS (SELECT * FROM labelled WHERE grp <> 'rating' AND probability >= threshold
  UNION ALL SELECT * EXCLUDE (rn) FROM rated),
kept AS (SELECT *, trim({text}) AS text FROM picked p WHERE NOT ({drop})),
sorted AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY group_rank,
    CASE WHEN by_name THEN 0 ELSE -probability END, CASE WHEN by_name THEN name ELSE '' END, tag_index) AS place FROM kept WHERE text <> ''),
firsts AS (SELECT *, row_number() OVER (PARTITION BY image_id, upper(text) ORDER BY place) AS again FROM sorted),
numbered AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY place) AS n FROM firsts WHERE again = 1),
spelled AS (SELECT *, {weight} AS spelled FROM numbered WHERE n <= {max_tags}),
grouped AS (SELECT image_id, group_rank, string_agg(spelled, '{tag_sep}' ORDER BY place) AS part, count(*) AS k FROM spelled GROUP BY 1, 2),
bodies AS (SELECT image_id, string_agg(part, '{group_sep}' ORDER BY group_rank) AS body, sum(k) AS k FROM grouped GROUP BY 1),
prompts AS (SELECT e.vec_id AS image_id, {finish} AS prompt, CAST(coalesce(k, 0) AS INTEGER) AS tag_count
  FROM embeddings e LEFT JOIN bodies b ON b.image_id = e.vec_id)
"""


# reverse order of the five declared groups, one threshold for all
REVERSED = """ordered(id, rank, by_name, threshold) AS (VALUES ('general', 0, false, 0.6::DOUBLE), ('character', 1, false, 0.6::DOUBLE),
  ('copyright', 2, false, 0.6::DOUBLE), ('artist', 3, false, 0.6::DOUBLE), ('rating', 4, false, 0.6::DOUBLE))"""
PLAIN_TEXT = "replace(name, '_', ' ')"
RESULT = "SELECT image_id, prompt, tag_count, CAST(length(prompt) AS INTEGER) AS char_count FROM prompts"

LOGIT_SCORES = """lscores AS (
  SELECT image_id, tag_index, CAST(round(CASE WHEN x * 10 < 0 THEN exp(x * 10) / (1 + exp(x * 10)) ELSE 1 / (1 + exp(-x * 10)) END, 6) AS FLOAT) AS probability FROM emb)"""


@query("prompt_default", prompt_sql(CATALOG, "lscores", ctes=(LOGIT_SCORES, REVERSED), text=PLAIN_TEXT) + RESULT)
def prompt_default(spark, sf):
    """Flagship: logits, activation, labels, threshold, ranking and text for every image."""
    logits = B.logits(spark, sf)
    from tagloom.functions import sigmoid_double

    p = logits.select("image_id", F.transform("logits", lambda x: F.round(sigmoid_double(x), 6).cast("float")).alias("probabilities"))
    return P.build_prompts(p, B.catalog64(spark, sf), B.groups5(spark), default_rules(B.GROUPS5), B.THRESHOLD)


@query("prompt_repeated_names", prompt_sql(CATALOG_DUP, "scores_bad", ctes=(REVERSED,), text=PLAIN_TEXT) + RESULT)
def prompt_repeated_names(spark, sf):
    return P.build_prompts(
        B.predictions_bad(spark, sf), B.catalog64(spark, sf, True), B.groups5(spark), default_rules(B.GROUPS5), B.THRESHOLD
    )


FULL_RULES = PromptRules(
    groups=(GroupRule("character", True, NAME), GroupRule("copyright", False), GroupRule("rating"), GroupRule("character", False)),
    use_global_threshold=False,
    group_thresholds={"character": 0.5, "general": 0.65},
    excluded=("small_ring_40", "small_ring_55"),
    replacements={"small_gizmo_4": "Blue (gear)", "old_anvil_14": "blue (GEAR)", "new_gear_24": None},
    weights=True, min_weight=0.9, max_weight=1.35,
    tag_separator=" | ", group_separator=" ;; ", prefix="<<", suffix=">>", max_tags=12, trailing_separator=True, quality="pony",
)




FULL_ORDER = """ordered(id, rank, by_name, threshold) AS (VALUES ('character', 0, true, 0.5::DOUBLE), ('rating', 1, false, 0.6::DOUBLE),
  ('general', 2, false, 0.65::DOUBLE), ('artist', 3, false, 0.6::DOUBLE))"""
REPLACED = """CASE name WHEN 'small_gizmo_4' THEN 'Blue (gear)' WHEN 'old_anvil_14' THEN 'blue (GEAR)' WHEN 'new_gear_24' THEN '' ELSE replace(name, '_', ' ') END"""
W_RAW = "least(greatest(CASE WHEN 1 - threshold <= 1e-12 THEN 1.35::DOUBLE ELSE 0.9::DOUBLE + (least(greatest(probability::DOUBLE, threshold), 1) - threshold) / (1 - threshold) * (1.35::DOUBLE - 0.9::DOUBLE) END, 0.9::DOUBLE), 1.35::DOUBLE)"
W_2 = f"((CASE WHEN {W_RAW} * 100 - floor({W_RAW} * 100) >= 0.5::DOUBLE THEN floor({W_RAW} * 100) + 1 ELSE floor({W_RAW} * 100) END) / 100.0::DOUBLE)"
WEIGHTED = f"CASE WHEN {W_2} = 1 THEN text ELSE '(' || text || ':' || printf('%.2f', {W_2}) || ')' END"


@query("prompt_full_rules", prompt_sql(
    CATALOG, "scores_bad", ctes=(FULL_ORDER, OVERRIDES), text=f"replace(replace({REPLACED}, '(', '\\('), ')', '\\)')", weight=WEIGHTED,
    max_tags=12, tag_sep=" | ", group_sep=" ;; ",
    drop="name IN ('small_ring_40', 'small_ring_55') OR EXISTS (SELECT 1 FROM overrides v WHERE v.image_id = p.image_id AND v.tag_index = p.tag_index)",
    finish="'<<' || 'score_9, score_8_up, score_7_up, score_6_up' || coalesce(' ;; ' || body, '') || ' | ' || '>>'") + RESULT)
def prompt_full_rules(spark, sf):
    return P.build_prompts(
        B.predictions_bad(spark, sf), B.catalog64(spark, sf), B.groups3(spark), FULL_RULES, B.THRESHOLD, B.overrides(spark, sf)
    )


@query("prompt_truncated", prompt_sql(CATALOG, ctes=(REVERSED,), text=PLAIN_TEXT, max_tags=5) + RESULT)
def prompt_truncated(spark, sf):
    rules = PromptRules(groups=default_rules(B.GROUPS5).groups, max_tags=5)
    return P.build_prompts(B.predictions(spark, sf), B.catalog64(spark, sf), B.groups5(spark), rules, B.THRESHOLD)


@query("prompt_fingerprint", prompt_sql(
    CATALOG, ctes=(REVERSED,), text=PLAIN_TEXT, finish="CASE WHEN label % 2 = 1 THEN coalesce(body, '') ELSE '' END")
    + "SELECT image_id, prompt, CASE WHEN prompt = '' THEN 0 ELSE tag_count END AS tag_count, CAST(length(prompt) AS INTEGER) AS char_count FROM prompts")
def prompt_fingerprint(spark, sf):
    p = B.predictions(spark, sf).withColumn("fingerprint", F.concat(F.lit("fp"), (F.col("label") % 2).cast("string")))
    return P.build_prompts(
        p, B.catalog64(spark, sf), B.groups5(spark), default_rules(B.GROUPS5), B.THRESHOLD, fingerprint="fp1"
    )


@query("prompt_deduped_rows", prompt_sql(CATALOG_DUP, ctes=(REVERSED,), text=PLAIN_TEXT) + """
SELECT image_id, CAST(n AS INTEGER) AS place, tag_index, text FROM numbered""")
def deduped_rows(spark, sf):
    """Deduplicated tags as rows, before truncation."""
    t = P.prompt_candidates(
        B.predictions(spark, sf), B.catalog64(spark, sf, True), B.groups5(spark), default_rules(B.GROUPS5), B.THRESHOLD
    )
    rows = unnest(t, ["image_id"], "tags", "at", "t")
    return rows.select("image_id", (F.col("at") + 1).alias("place"), "t.tag_index", "t.text")


@query("prompt_totals", prompt_sql(CATALOG, ctes=(REVERSED,), text=PLAIN_TEXT) + """
SELECT count(*) AS prompts, count(*) FILTER (WHERE prompt = '') AS empty_prompts, CAST(sum(tag_count) AS BIGINT) AS tags,
       CAST(sum(length(prompt)) AS BIGINT) AS chars FROM prompts""")
def totals(spark, sf):
    return P.prompt_totals(P.build_prompts(
        B.predictions(spark, sf), B.catalog64(spark, sf), B.groups5(spark), default_rules(B.GROUPS5), B.THRESHOLD
    ))


@query("prompt_group_order", with_(CATALOG) + """
SELECT * FROM (VALUES ('character', 0::BIGINT, true, 0.5::DOUBLE), ('rating', 2::BIGINT, false, 0.6::DOUBLE),
  ('general', 4294967292::BIGINT, false, 0.65::DOUBLE)) v(id, group_rank, by_name, threshold)
UNION ALL SELECT 'artist', 8589934592 + min(tag_index), false, 0.6::DOUBLE FROM catalog WHERE grp = 'artist'""")
def group_order(spark, sf):
    order = P.prompt_group_order(FULL_RULES, B.groups3(spark), B.catalog64(spark, sf))
    return P.effective_threshold(order, B.THRESHOLD, FULL_RULES)


@query("prompt_enabled_groups", with_(EMB) + """
SELECT id, CAST(pos AS INTEGER) AS pos FROM (
  SELECT event_type || (user_id % 7) AS id, min(event_id) AS pos, arg_min(event_id % 2 = 0, event_id) AS enabled FROM events GROUP BY 1)
WHERE enabled""")
def enabled(spark, sf):
    """Events read as rule rows: many rows per group id, the first one decides."""
    e = B.table(spark, sf, "events")
    rules = e.select(
        F.concat("event_type", (F.col("user_id") % 7).cast("string")).alias("id"), F.col("event_id").cast("int").alias("pos"),
        (F.col("event_id") % 2 == 0).alias("enabled"), F.lit(False).alias("by_name"),
    )
    return P.enabled_groups(rules).select("id", "pos")


@query("prompt_replacements", """
SELECT p_partkey, CASE p_name WHEN 'small ring' THEN 'tiny ring' WHEN 'red anvil' THEN '' ELSE p_name END AS text FROM part
WHERE p_name NOT IN ('blue gear', 'old anvil')""")
def replacements(spark, sf):
    part = B.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"))
    kept = P.drop_excluded(part, ["blue gear", "old anvil"])
    return P.apply_replacements(kept, {"small ring": "tiny ring", "red anvil": None}).select("p_partkey", "text")


ODD = "CASE p_partkey % 6 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN '^_^' WHEN 2 THEN 'x_<' || p_size WHEN 3 THEN '_(' || p_name || ')_' WHEN 4 THEN 'o_O' ELSE '__' END"


def odd_text():
    name, k = F.col("p_name"), F.col("p_partkey") % 6
    return (
        F.when(k == 0, F.translate(name, " ", "_")).when(k == 1, "^_^")
        .when(k == 2, F.concat(F.lit("x_<"), F.col("p_size").cast("string")))
        .when(k == 3, F.concat(F.lit("_("), name, F.lit(")_"))).when(k == 4, "o_O").otherwise("__")
    )


@query("text_underscore", f"""
SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 3) THEN replace(s, '_', ' ') ELSE s END AS text,
       p_partkey % 6 IN (1, 2, 4, 5) AS emoticon FROM (SELECT p_partkey, {ODD} AS s FROM part)""")
def underscore(spark, sf):
    p = B.table(spark, sf, "part").select("p_partkey", odd_text().alias("s"))
    return p.select("p_partkey", underscore_to_space(F.col("s")).alias("text"), is_emoticon(F.col("s")).alias("emoticon"))


@query("text_escape_trim", """
SELECT p_partkey, trim(p_name) || '\\(x\\)' AS text FROM part""")
def escape_trim(spark, sf):
    s = F.concat(F.lit(" \t　"), F.col("p_name"), F.lit("(x)"), F.lit("  \n"))
    return B.table(spark, sf, "part").select("p_partkey", trim_unicode(escape_parens(s)).alias("text"))


@query("text_weights", with_(EMB, SCORES) + f"""
SELECT image_id, tag_index, {W_2} AS weight, CASE WHEN {W_2} = 1 THEN 'tag' ELSE '(tag:' || printf('%.2f', {W_2}) || ')' END AS text
FROM (SELECT *, 0.3::DOUBLE AS threshold FROM scores)""")
def weights(spark, sf):
    rows = unnest(B.predictions(spark, sf), ["image_id"], "probabilities", "tag_index", "p")
    w = tag_weight(F.col("p"), F.lit(0.3), 0.9, 1.35)
    return rows.select("image_id", "tag_index", w.alias("weight"), weighted_text(F.lit("tag"), w).alias("text"))


@query("text_utf16_length", """
SELECT doc_id, CAST(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS INTEGER) AS units FROM documents""")
def units(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", utf16_length(F.col("text")).alias("units"))


@query("text_quality_presets", """
SELECT p_partkey, ['', 'masterpiece, best quality', 'masterpiece, best quality, score_7', 'own, tags'][p_size % 4 + 1] AS text FROM part""")
def presets(spark, sf):
    """Quality text by preset, the preset of a part given by its size."""
    text = F.lit(None).cast("string")
    for i, preset in enumerate(["none", "sdxl", "anima", "custom"]):
        rules = PromptRules(quality=preset, custom_quality="  own, tags ").check()
        text = F.when(F.col("p_size") % 4 == i, rules.quality_text()).otherwise(text)
    return B.table(spark, sf, "part").select("p_partkey", text.alias("text"))

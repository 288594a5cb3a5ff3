"""Scores and prompts on small literal inputs."""

import math

import pytest
from pyspark.sql import functions as F

from tagloom import fixed, functions as X
from tagloom.operators import prompt as P, scores as S
from tagloom.rules import NAME, GroupRule, PromptRules, default_rules

GROUPS = ["rating", "character", "general"]


def catalog(spark, *entries):
    return spark.createDataFrame(
        [(i, n, t, g) for i, (n, t, g) in enumerate(entries)], "tag_index int, name string, translation string, group string"
    )


def general(spark, *names):
    return catalog(spark, *[(n, None, "general") for n in names])


def scores(spark, *rows):
    return spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(rows)], "image_id long, probabilities array<float>")


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame(
        [(i, g, g.title(), None, None) for i, g in enumerate(GROUPS)], "pos int, id string, name string, display_name string, strategy string"
    )


def prompts(spark, cat, probs, groups, rules, overrides=None, t=0.5):
    over = None if overrides is None else spark.createDataFrame([(0, i) for i in overrides], "image_id long, tag_index int")
    return [tuple(r)[1:] for r in P.build_prompts(scores(spark, *probs), cat, groups, rules, t, over).orderBy("image_id").collect()]


def test_visible_order_ties_boundary_and_non_finite(spark):
    cat = general(spark, *"abcde")
    v = S.visible_tags(scores(spark, [0.5, 0.8, 0.8, 0.2, 0.8], [math.nan, math.inf, 0.7, -math.inf, 0.1]), cat, 0.5)
    out = {r["image_id"]: [t["tag_index"] for t in r["tags"]] for r in v.collect()}
    assert out == {0: [1, 2, 4, 0], 1: [2]}
    assert S.visible_tags(scores(spark, [0.6094] * 5), cat, 0.6094).first()["tags"] == []  # float below the double
    with pytest.raises(Exception, match="differ from catalog size"):
        S.visible_tags(scores(spark, [0.1]), cat, 0.5).collect()
    with pytest.raises(ValueError):
        S.visible_tags(scores(spark, [0.1]), cat, 1.5)
    counts = scores(spark, [math.nan, math.inf, 0.7, 0.5, 0.1]).select(S.visible_tag_count(F.col("probabilities"), 0.5).alias("n"))
    assert counts.first()["n"] == 3


def test_gap_in_catalog_is_an_error(spark):
    cat = general(spark, "a", "b").filter("tag_index = 1")
    with pytest.raises(Exception, match="contiguous|catalog size"):
        S.visible_tags(scores(spark, [0.9]), cat, 0.5).collect()


def test_rating_group_shows_the_best_only(spark, groups):
    cat = catalog(spark, ("general", None, "rating"), ("sensitive", None, "rating"), ("sky", None, "general"))
    g = S.tag_groups(scores(spark, [0.1, 0.7, 0.4], [0.2, 0.2, 0.95]), cat, groups, 0.9)
    out = sorted((r["image_id"], r["group_id"], r["tag_index"], r["is_top_rating"]) for r in g.collect())
    assert out == [(0, "rating", 1, True), (1, "general", 2, False), (1, "rating", 0, True)]
    summary = {(r["image_id"], r["group_id"]): r["visible"] for r in S.group_summary(scores(spark, [0.1, 0.7, 0.4]), cat, groups, 0.9).collect()}
    assert summary == {(0, "rating"): 1, (0, "character"): 0, (0, "general"): 0}


def test_default_order_is_reverse_declaration(spark, groups):
    cat = catalog(spark, ("general", None, "rating"), ("char_a", None, "character"), ("sky", None, "general"))
    text = "sky, char a, general"
    assert prompts(spark, cat, [[0.9, 0.9, 0.9]], groups, default_rules(GROUPS)) == [(text, 3, len(text))]
    assert prompts(spark, cat, [[0.9, 0.9, 0.9]], groups, PromptRules()) == [(text, 3, len(text))]


def test_rating_ignores_threshold_unless_disabled_and_exclusion_leaves_none(spark, groups):
    cat = catalog(spark, ("safe", None, "rating"), ("bad", None, "rating"), ("sky", None, "general"))
    probs = [[0.3, 0.2, 0.9]]
    assert prompts(spark, cat, probs, groups, default_rules(GROUPS))[0][0] == "sky, safe"
    off = PromptRules(groups=(GroupRule("general"), GroupRule("rating", enabled=False)))
    assert prompts(spark, cat, probs, groups, off)[0][0] == "sky"
    assert prompts(spark, cat, probs, groups, default_rules(GROUPS), overrides=[0])[0][0] == "sky"
    assert prompts(spark, cat, probs, groups, PromptRules(excluded=("safe",)))[0][0] == "sky"


def test_text_rules(spark, groups):
    assert prompts(spark, general(spark, "solo", "soloist"), [[0.9, 0.9]], groups, PromptRules(excluded=("solo",)))[0][0] == "soloist"
    assert prompts(spark, general(spark, "1girl"), [[0.9]], groups, PromptRules(replacements={"1girl": "one girl"}))[0][0] == "one girl"
    assert prompts(spark, general(spark, "blue_hair"), [[0.9]], groups, PromptRules(underscore_to_space=False))[0][0] == "blue_hair"
    cat = general(spark, "blue_hair", "Blue_Hair", "sky")
    assert prompts(spark, cat, [[0.95, 0.9, 0.8], [0.9, 0.95, 0.8]], groups, PromptRules()) == [("blue hair, sky", 2, 14), ("Blue Hair, sky", 2, 14)]
    assert prompts(spark, general(spark, "saber_(fate)"), [[0.9]], groups, PromptRules())[0][0] == r"saber \(fate\)"
    assert prompts(spark, general(spark, "a", "b"), [[0.9, 0.9]], groups, PromptRules(replacements={"a": None}))[0][0] == "b"


def test_weights(spark, groups):
    rules = PromptRules(weights=True)
    assert [p[0] for p in prompts(spark, general(spark, "low", "high"), [[0.5, 0.0], [0.0, 1.0]], groups, rules)] == ["low", "(high:1.30)"]


def test_output_rules(spark, groups):
    cat = general(spark, "a", "b", "c")
    assert prompts(spark, cat, [[0.9, 0.8, 0.7]], groups, PromptRules(max_tags=2)) == [("a, b", 2, 4)]
    assert prompts(spark, general(spark, "sky"), [[0.9]], groups, PromptRules(prefix="pre:", suffix=":suf"))[0][0] == "pre:sky:suf"
    two = catalog(spark, ("c1", None, "character"), ("g1", None, "general"), ("g2", None, "general"))
    assert prompts(spark, two, [[0.9, 0.9, 0.8]], groups, PromptRules(tag_separator="|", group_separator=";"))[0][0] == "g1|g2;c1"
    rules = PromptRules(use_global_threshold=False, group_thresholds={"character": 0.9, "general": 0.5})
    assert prompts(spark, two, [[0.6, 0.6, 0.1]], groups, rules)[0][0] == "g1"
    by_name = PromptRules(groups=(GroupRule("general", True, NAME),))
    assert prompts(spark, general(spark, "zebra", "apple"), [[0.9, 0.8]], groups, by_name)[0][0] == "apple, zebra"
    rules = PromptRules(quality="anima", trailing_separator=True)
    assert prompts(spark, general(spark, "sky"), [[0.9], [0.1]], groups, rules) == [
        ("masterpiece, best quality, score_7, sky, ", 1, 41), ("masterpiece, best quality, score_7, ", 0, 36)]


def test_no_groups_and_wrong_lengths(spark, groups):
    none = PromptRules(groups=tuple(GroupRule(g, False) for g in GROUPS), prefix="p", suffix="s", quality="sdxl")
    assert prompts(spark, general(spark, "a"), [[0.9]], groups, none) == [("ps", 0, 2)]
    assert prompts(spark, general(spark, "a", "b"), [[0.9]], groups, PromptRules(prefix="p")) == [("", 0, 0)]


@pytest.mark.parametrize("bad", [
    {"tag_separator": ""}, {"group_separator": ""}, {"max_tags": 0}, {"max_tags": 501}, {"group_thresholds": {"a": 1.5}},
    {"min_weight": 0.4}, {"max_weight": math.nan}, {"min_weight": 2.0}, {"groups": (GroupRule(""),)}, {"quality": "other"},
])
def test_bad_rules(bad):
    with pytest.raises(ValueError):
        PromptRules(**bad).check()


def test_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 2.0, -2.0, 1000.0, -1000.0, 88.0, -88.0, math.nan)], "x double")
    out = [r["p"] for r in df.select(X.sigmoid(F.col("x")).alias("p")).collect()]
    assert out[:3] == pytest.approx([0.5, 0.880797, 0.119203], abs=1e-5)
    assert out[3] == 1.0 and out[4] == 0.0 and out[7] == 0.0 and all(0 <= p <= 1 for p in out)
    one = spark.range(1).select(
        X.round_half_away(F.lit(1.005)).alias("a"), X.round_half_away(F.lit(0.125)).alias("b"), X.confidence_band(F.lit(math.nan)).alias("c"),
        X.tag_weight(F.lit(1.0), F.lit(1.0), 1.0, 1.3).alias("d"),
    ).first()
    assert tuple(one) == (1.0, 0.13, "low", 1.3)


def test_texts(spark):
    row = spark.range(1).select(
        X.utf16_length(F.lit("a😀b")).alias("n"), X.left_utf16(F.lit("a😀b"), 2).alias("cut"), X.is_emoticon(F.lit("^_^")).alias("face"),
        X.is_emoticon(F.lit("hair")).alias("hair"), X.underscore_to_space(F.lit("x_<3")).alias("kept"), X.trim_unicode(F.lit("　 a b\t")).alias("trim"),
    ).first()
    assert tuple(row) == (4, "a", True, False, "x_<3", "a b")


def test_display_text(spark):
    tags = spark.createDataFrame([("untranslated", None, 0.9873), ("same", "same", 0.5), ("ok", "好", 1.0)], "name string, translation string, probability float")
    out = [(r["confidence_text"], r["translation_text"]) for r in S.tag_display(tags).collect()]
    assert out == [("98.73%", fixed.NO_TRANSLATION), ("50.00%", fixed.NO_TRANSLATION), ("100.00%", "好")]

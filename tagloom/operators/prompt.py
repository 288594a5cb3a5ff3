"""Prompts for all images at once.

Everything that depends only on a label (group order, threshold, replaced and escaped text, which
labels share a spelling) is worked out once on the catalog. Per image there is left: pick positions,
sort them, drop repeated spellings, cut, join. That happens inside the row, so building prompts for
any number of images is a map over the predictions; only user overrides, if given, need a join, and
that join carries the few picked tags and not the score arrays.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagloom.functions import (
    escape_parens, is_blank, literal_map, tag_weight, trim_unicode, underscore_to_space, utf16_length, weighted_text,
)
from tagloom.operators.scores import RATING, best_of, bind, excluded_arrays, label_entries, positions
from tagloom.rules import NAME, PromptRules, check_threshold
from tagloom.session import literal_rows

_TIER = 1 << 32


def _rule_rows(df: DataFrame, rules: PromptRules) -> DataFrame:
    """The rules of the argument as rows; the literal list is what the user typed."""
    rows = [(i, r.group_id, r.enabled, r.sort == NAME) for i, r in enumerate(rules.groups)]
    return literal_rows(df.sparkSession, "pos int, id string, enabled boolean, by_name boolean", rows)


def enabled_groups(rule_rows: DataFrame) -> DataFrame:
    """First rule per group id; a disabled first rule removes the group."""
    first = rule_rows.groupBy("id").agg(F.min(F.struct("pos", "enabled", "by_name")).alias("r"))
    return first.filter("r.enabled").select("id", "r.pos", "r.by_name")


def prompt_group_order(rules: PromptRules, groups: DataFrame, catalog: DataFrame) -> DataFrame:
    """Groups taking part in a prompt: ``id``, ``group_rank`` (ascending order), ``by_name``.

    Rules first, then declared groups without a rule in reverse declaration order, then undeclared
    catalog groups by first appearance. A disabled rule keeps its group out of all three.
    """
    ruled = _rule_rows(catalog, rules).select("id", F.struct(F.lit(0).alias("tier"), "pos", "enabled", "by_name").alias("e"))
    declared = groups.filter(F.coalesce(F.col("id"), F.lit("")) != "").select(
        "id",
        F.struct(
            F.lit(1).alias("tier"), (-F.col("pos")).cast("int").alias("pos"), F.lit(True).alias("enabled"), F.lit(False).alias("by_name")
        ).alias("e"),
    )
    found = catalog.groupBy(F.col("group").alias("id")).agg(F.min("tag_index").alias("pos")).select(
        "id",
        F.struct(
            F.lit(2).alias("tier"), F.col("pos").cast("int").alias("pos"), F.lit(True).alias("enabled"), F.lit(False).alias("by_name")
        ).alias("e"),
    )
    first = ruled.unionByName(declared).unionByName(found).groupBy("id").agg(F.min("e").alias("e"))
    rank = F.col("e.tier").cast("long") * _TIER + F.col("e.pos")
    return first.filter("e.enabled").select("id", rank.alias("group_rank"), F.col("e.by_name").alias("by_name"))


def effective_threshold(groups: DataFrame, default: float, rules: PromptRules) -> DataFrame:
    """Add ``threshold``: the group's own if global is off and it has one, else the default."""
    t = F.lit(float(default))
    if not rules.use_global_threshold and rules.group_thresholds:
        own = literal_map({}) if not rules.group_thresholds else F.create_map(
            *[F.lit(x) for g, v in rules.group_thresholds.items() for x in (g, float(v))]
        )
        t = F.coalesce(F.try_element_at(own, F.col("id")), t)
    return groups.withColumn("threshold", t).filter(F.col("threshold").between(0.0, 1.0))


def apply_replacements(df: DataFrame, replacements: Mapping[str, str | None], column: str = "name") -> DataFrame:
    """Add ``text``: the exact replacement of the name where there is one (none means empty), else the name."""
    if not replacements:
        return df.withColumn("text", F.col(column))
    table = literal_rows(
        df.sparkSession, f"{column} string, replaced string", [(k, v or "") for k, v in replacements.items()]
    )
    return df.join(table, column, "left").withColumn("text", F.coalesce("replaced", column)).drop("replaced")


def drop_excluded(df: DataFrame, names: list[str] | tuple[str, ...], column: str = "name") -> DataFrame:
    """Exact, case-sensitive exclusion on the original name."""
    if not names:
        return df
    table = literal_rows(df.sparkSession, f"{column} string", [(n,) for n in names])
    return df.join(table, column, "left_anti")


def transform_text(text: Column, rules: PromptRules) -> Column:
    if rules.underscore_to_space:
        text = underscore_to_space(text)
    if rules.escape_parens:
        text = escape_parens(text)
    return trim_unicode(text)


def label_plan(catalog: DataFrame, groups: DataFrame, rules: PromptRules, default_threshold: float) -> DataFrame:
    """One row per label with everything a prompt needs to know about it.

    ``keep`` is false for labels that can never appear. ``spelling`` is the lowest index among labels
    whose text is equal when upper-cased; ``shared`` tells that there is more than one of them.
    """
    order = effective_threshold(prompt_group_order(rules, groups, catalog), default_threshold, rules)
    labels = apply_replacements(catalog.select("tag_index", "name", "group"), rules.replacements)
    labels = labels.withColumn("text", transform_text(F.col("text"), rules))
    same = Window.partitionBy("upper_text")
    labels = labels.withColumn("upper_text", F.upper("text")).select(
        "tag_index", "name", "group", "text",
        F.min("tag_index").over(same).alias("spelling"),
        (F.count(F.lit(1)).over(same) > 1).alias("shared"),
    )
    labels = labels.join(order.withColumnRenamed("id", "group"), "group", "left")
    excluded = F.col("name").isin(list(rules.excluded)) if rules.excluded else F.lit(False)
    return labels.select(
        "tag_index", "name", "group", "text", "spelling", "shared", "group_rank", "by_name", "threshold",
        (F.col("group_rank").isNotNull() & (F.col("text") != "") & ~excluded).alias("keep"),
        (F.col("group_rank").isNotNull() & (F.col("group") == RATING)).alias("is_rating"),
    )


def dedupe_texts(tags: Column) -> Column:
    """Keep the first tag of each spelling; unshared spellings need no look-up."""
    bound = F.array(F.struct(tags.alias("tags"), F.transform(tags, lambda t: t["spelling"]).alias("spellings")))
    return F.flatten(
        F.transform(
            bound,
            lambda b: F.filter(
                b["tags"],
                lambda t, i: ~t["shared"] | (F.array_position(b["spellings"], t["spelling"]) == i + 1),
            ),
        )
    )


def prompt_candidates(
    predictions: DataFrame, catalog: DataFrame, groups: DataFrame, rules: PromptRules, default_threshold: float,
    overrides: DataFrame | None = None,
) -> DataFrame:
    """``image_id, valid, tags``: picked, sorted and deduplicated tags of every image, not yet cut.

    The best rating is picked before overrides and exclusions, so an excluded winner leaves none.
    """
    plan = label_plan(catalog, groups, rules, default_threshold)
    # a null threshold makes the comparison false: excluded labels and rating labels are never picked here
    bar = lambda label: F.when(label["keep"] & ~label["is_rating"], label["threshold"])
    one_row = plan.agg(label_entries("name", "text", "spelling", "shared", "group_rank", "by_name", "threshold", "keep", "is_rating").alias("labels"))
    # one subquery for all that is known about the labels, so the catalog is read once
    facts = one_row.select(F.struct(
        "labels", F.transform("labels", bar).alias("bars"),
        F.transform(F.filter("labels", lambda label: label["is_rating"]), lambda label: label["tag_index"]).alias("ratings"), F.size("labels").alias("n"),
    ).alias("facts")).scalar()

    p = F.col("probabilities")
    infinity = F.lit(float("inf")).cast("float")
    df = bind(predictions, labels=facts["labels"], bars=facts["bars"], ratings=facts["ratings"], n=facts["n"])
    # NaN is above infinity in Spark's order, so the upper bound drops it as well
    above = F.filter(
        positions(p), lambda i: (F.get(p, i) < infinity) & (F.get(p, i).cast("double") >= F.get(F.col("__bars"), i))
    )
    best = F.filter(F.array(best_of(p, F.col("__ratings"))["tag_index"]), lambda i: i.isNotNull())
    valid = F.coalesce(p.isNotNull() & (F.size(p) == F.col("__n")), F.lit(False))
    hits = F.transform(
        F.concat(above, best),
        lambda i: F.struct(i.alias("i"), F.get(p, i).alias("p"), F.get(F.col("__labels"), i).alias("label")),
    )

    def tag(h: Column) -> Column:
        label = h["label"]
        return F.struct(
            label["group_rank"].alias("group_rank"),
            F.when(label["by_name"], F.lit(0.0).cast("float")).otherwise(-h["p"]).alias("neg"),
            F.when(label["by_name"], label["name"]).otherwise("").alias("name_key"),
            h["i"].alias("tag_index"),
            h["p"].alias("probability"),
            label["text"].alias("text"),
            label["threshold"].alias("threshold"),
            label["spelling"].alias("spelling"),
            label["shared"].alias("shared"),
        )

    picked = df.select("image_id", valid.alias("valid"), F.filter(hits, lambda h: h["label"]["keep"]).alias("hits"))
    picked = picked.select("image_id", "valid", F.when(F.col("valid"), F.transform("hits", tag)).alias("picked"))
    if overrides is not None:
        picked = picked.join(excluded_arrays(overrides), "image_id", "left").withColumn(
            "picked",
            F.when(F.col("excluded").isNull(), F.col("picked")).otherwise(
                F.filter("picked", lambda t: ~F.array_contains(F.col("excluded"), t["tag_index"]))
            ),
        )
    picked = picked.withColumn("sorted", F.sort_array("picked"))
    return picked.select("image_id", "valid", dedupe_texts(F.col("sorted")).alias("tags"))


def build_prompts(
    predictions: DataFrame, catalog: DataFrame, groups: DataFrame, rules: PromptRules, default_threshold: float,
    overrides: DataFrame | None = None, fingerprint: str | None = None,
) -> DataFrame:
    """``image_id, prompt, tag_count, char_count`` for every prediction row.

    With ``fingerprint`` given, predictions of another model yield an empty prompt.
    """
    rules.check()
    check_threshold(default_threshold, "default threshold")
    if fingerprint is not None:
        predictions = predictions.withColumn(
            "probabilities", F.when(F.col("fingerprint") == fingerprint, F.col("probabilities"))
        )
    tags = prompt_candidates(predictions, catalog, groups, rules, default_threshold, overrides)
    tags = tags.withColumn("tags", F.slice("tags", 1, rules.max_tags))

    def spelled(t: Column) -> Column:
        if not rules.weights:
            return t["text"]
        return weighted_text(t["text"], tag_weight(t["probability"], t["threshold"], rules.min_weight, rules.max_weight))

    tags = tags.withColumn(
        "texts", F.transform("tags", lambda t: F.struct(t["group_rank"].alias("group_rank"), spelled(t).alias("text")))
    )
    group_ranks = F.array_distinct(F.transform("texts", lambda t: t["group_rank"]))
    one_group = lambda g: F.array_join(
        F.transform(F.filter("texts", lambda t: t["group_rank"] == g), lambda t: t["text"]), rules.tag_separator
    )
    body = F.array_join(F.transform(group_ranks, one_group), rules.group_separator)

    quality = rules.quality_text()
    tags = tags.withColumn("body", body)
    joined = F.col("body")
    if quality:
        joined = F.when(joined == "", quality).otherwise(F.concat(F.lit(quality + rules.group_separator), joined))
    if rules.trailing_separator:
        joined = F.when(joined == "", joined).otherwise(F.concat(joined, F.lit(rules.tag_separator)))
    # without any group there is no body and no quality text either, only prefix and suffix
    order = effective_threshold(prompt_group_order(rules, groups, catalog), default_threshold, rules)
    some_group = order.agg((F.count(F.lit(1)) > 0).alias("some")).scalar()
    text = F.concat(F.lit(rules.prefix or ""), F.when(some_group, joined).otherwise(""), F.lit(rules.suffix or ""))
    prompts = tags.select(
        "image_id", F.when(F.col("valid"), text).otherwise("").alias("prompt"),
        F.when(F.col("valid"), F.size("tags")).otherwise(0).alias("tag_count"),
    )
    return prompts.withColumn("char_count", utf16_length(F.col("prompt")))


def prompt_totals(prompts: DataFrame) -> DataFrame:
    """Totals over all prompts: how many, how many empty, tags and characters."""
    return prompts.agg(
        F.count(F.lit(1)).alias("prompts"),
        F.count_if(is_blank(F.col("prompt"))).alias("empty_prompts"),
        F.sum("tag_count").alias("tags"),
        F.sum("char_count").alias("chars"),
    )

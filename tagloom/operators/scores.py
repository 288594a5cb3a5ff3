"""Operators over predictions: one row per image, one array of probabilities per row.

A prediction row already holds everything about its image, so thresholding, ranking, top-k, digests
and summaries are computed inside the row: the plans are map-only and no image can become a hot key.
Labels come in as a *label vector*, a scalar subquery holding the catalog as one array. The catalog
has exactly as many rows as each probability array has elements, so the vector is bounded by the
width of one input row; ``label_vector`` verifies that it is contiguous.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tagloom import fixed
from tagloom.functions import is_finite, is_visible
from tagloom.rules import check_threshold
from tagloom.session import unnest

RATING = fixed.RATING_GROUP


def label_entries(*fields: str) -> Column:
    """Aggregate of a catalog to one array of structs in index order. A gap in the indices is an error."""
    entries = F.sort_array(F.collect_list(F.struct("tag_index", *fields)))
    contiguous = (F.min("tag_index") == 0) & (F.max("tag_index") + 1 == F.count(F.lit(1)))
    return F.when(contiguous, entries).otherwise(F.raise_error(F.lit("catalog indices are not contiguous from 0")))


def label_vector(catalog: DataFrame, *fields: str) -> Column:
    """``label_entries`` as a scalar subquery."""
    return catalog.agg(label_entries(*fields).alias("labels")).scalar()


def catalog_size(catalog: DataFrame) -> Column:
    return catalog.agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()


def group_indices(catalog: DataFrame, group_id: str) -> Column:
    """Sorted tag indices of one group as a scalar array."""
    rows = catalog.filter(F.col("group") == group_id)
    return rows.agg(F.sort_array(F.collect_list("tag_index")).alias("ix")).scalar()


def positions(values: Column) -> Column:
    """0..n-1, empty for an empty array (a plain sequence would count down)."""
    return F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def bind(df: DataFrame, **scalars: Column) -> DataFrame:
    """Attach scalar subqueries as columns ``__name``.

    Spark does not take a subquery inside a higher-order function, a column it does. Operators refer
    to each such column once, so the optimizer folds it back into the expression and the value is
    shared by all rows instead of being copied into every one.
    """
    for name, value in scalars.items():
        df = df.withColumn(f"__{name}", value)
    return df


def unbind(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def require_length(result: Column, values: Column, expected: Column) -> Column:
    """``result``, or fail: every row must score every label."""
    return F.when(F.size(values) == expected, result).otherwise(
        F.raise_error(F.concat(F.lit("scores per image differ from catalog size: "), F.size(values).cast("string")))
    )


def ranked(values: Column, among: Column, keep: Callable[[Column], Column]) -> Column:
    """The given positions whose score passes ``keep``, as (neg, tag_index), best first, ties by index."""
    chosen = F.filter(among, lambda i: keep(F.get(values, i)))
    return F.sort_array(
        F.transform(chosen, lambda i: F.struct((-F.get(values, i)).alias("neg"), i.alias("tag_index")))
    )


def _labelled(pairs: Column) -> Column:
    """Pairs with their label, looked up in the bound ``__labels``."""
    return F.transform(
        pairs, lambda x: F.struct(x.alias("pair"), F.get(F.col("__labels"), x["tag_index"]).alias("label"))
    )


def _tags(labelled: Column) -> Column:
    return F.transform(
        labelled,
        lambda h: F.struct(
            h["pair"]["tag_index"].alias("tag_index"),
            h["label"]["name"].alias("name"),
            h["label"]["translation"].alias("translation"),
            h["label"]["group"].alias("group"),
            (-h["pair"]["neg"]).alias("probability"),
        ),
    )


# --- long form -------------------------------------------------------------------------------------------------


def attach_catalog(predictions: DataFrame, catalog: DataFrame, *keep: str) -> DataFrame:
    """One row per image and label, joined by position. Spark broadcasts the catalog if its size allows."""
    p = F.col("probabilities")
    checked = require_length(p, p, catalog_size(catalog))
    scores = unnest(predictions, ["image_id", *keep], checked, "tag_index", "probability")
    return scores.join(catalog, "tag_index")


def activate_logits(logits: DataFrame, kind: str = "sigmoid") -> DataFrame:
    """Logit arrays to probability arrays, row by row."""
    from tagloom.functions import activate

    return logits.withColumn("probabilities", F.transform("logits", lambda x: activate(x, kind))).drop("logits")


# --- visible tags ----------------------------------------------------------------------------------------------


def visible_tags(
    predictions: DataFrame, catalog: DataFrame, threshold: float, group_id: str | None = None
) -> DataFrame:
    """Add ``tags``: finite scores at or above the threshold, best first, ties by index."""
    t, p = check_threshold(threshold), F.col("probabilities")
    df = bind(predictions, labels=label_vector(catalog, "name", "translation", "group"), n=catalog_size(catalog))
    among = positions(p)
    if group_id is not None:
        df, among = bind(df, members=group_indices(catalog, group_id)), F.col("__members")
    hits = _labelled(ranked(p, among, lambda x: is_visible(x, t)))
    return unbind(df.withColumn("tags", require_length(_tags(hits), p, F.col("__n"))))


def explode_tags(df: DataFrame, *keep: str) -> DataFrame:
    """Rows of a ``tags`` column with their 1-based rank."""
    rows = unnest(df, ["image_id", *keep], "tags", "at", "tag")
    return rows.select("image_id", *keep, (F.col("at") + 1).alias("rank"), "tag.*")


def topk(predictions: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    """Add ``tags``: the k best labels of each image, ties by index. NaN never ranks."""
    df, p = bind(predictions, labels=label_vector(catalog, "name", "translation", "group"), n=catalog_size(catalog)), F.col("probabilities")
    return unbind(df.withColumn("tags", require_length(_tags(_labelled(_best_k(p, k))), p, F.col("__n"))))


def _best_k(values: Column, k: int) -> Column:
    return F.slice(ranked(values, positions(values), lambda p: ~F.isnan(p)), 1, k)


def rank_tags(df: DataFrame, mode: str = "confidence") -> DataFrame:
    """Rank the ``tags`` inside each group: by probability or by ordinal name, ties by index."""
    def key(tag: Column) -> Column:
        by_score = -tag["probability"] if mode == "confidence" else F.lit(0.0).cast("float")
        by_name = F.lit("") if mode == "confidence" else tag["name"]
        return F.struct(
            tag["group"].alias("group"), by_score.alias("neg"), by_name.alias("by_name"), tag["tag_index"].alias("tag_index"),
            tag["name"].alias("name"), tag["probability"].alias("probability"),
        )

    if mode not in ("confidence", "name"):
        raise ValueError(f"unknown sort mode {mode!r}")
    ordered = df.withColumn("ordered", F.sort_array(F.transform("tags", key)))
    # the rank inside a group is the position minus the position of the group's first tag
    ordered = ordered.withColumn("groups", F.transform("ordered", lambda t: t["group"]))
    rows = unnest(ordered, ["image_id", "groups"], "ordered", "at", "tag")
    return rows.select(
        "image_id",
        F.col("tag.group").alias("group"),
        (F.col("at") + 2 - F.array_position("groups", F.col("tag.group"))).cast("int").alias("rank"),
        "tag.tag_index", "tag.name", "tag.probability",
    )


# --- summaries per image ---------------------------------------------------------------------------------------


def best_of(values: Column, indices: Column) -> Column:
    """Best finite (neg, tag_index) among the given positions; ties go to the lowest index, null if none."""
    finite = F.filter(indices, lambda i: is_finite(F.get(values, i)))
    return F.array_min(
        F.transform(finite, lambda i: F.struct((-F.get(values, i)).alias("neg"), i.alias("tag_index")))
    )


def top_rating(predictions: DataFrame, catalog: DataFrame, group_id: str = RATING) -> DataFrame:
    """The best label of the rating group per image, whatever the threshold; images without one have no row."""
    df = bind(predictions, members=group_indices(catalog, group_id))
    best = F.filter(F.array(best_of(F.col("probabilities"), F.col("__members"))), lambda x: x.isNotNull())
    picked = bind(unnest(df, ["image_id"], best, "at", "best"), labels=label_vector(catalog, "name"))
    return picked.select(
        "image_id",
        F.col("best.tag_index").alias("tag_index"),
        F.get("__labels", F.col("best.tag_index"))["name"].alias("name"),
        (-F.col("best.neg")).alias("probability"),
    )


def visible_tag_count(values: Column, threshold: float) -> Column:
    """List badge: raw ``p >= t`` over all labels; +Inf counts, NaN does not."""
    t = F.lit(check_threshold(threshold))
    return F.size(F.filter(values, lambda p: ~F.isnan(p) & (p.cast("double") >= t)))


def selection_digest(predictions: DataFrame, catalog: DataFrame, threshold: float) -> DataFrame:
    """SHA-256 over ``index:name`` of the selected labels in index order, and how many there are.

    The selection compares in single precision, as the published digests were made.
    """
    t, p = F.lit(float(threshold)).cast("float"), F.col("probabilities")
    df = bind(predictions, labels=label_vector(catalog, "name"), n=catalog_size(catalog))
    chosen = F.filter(positions(p), lambda i: ~F.isnan(F.get(p, i)) & (F.get(p, i) >= t))
    parts = F.transform(
        chosen, lambda i: F.concat(i.cast("string"), F.lit(":"), F.get(F.col("__labels"), i)["name"])
    )
    rows = df.select("image_id", require_length(parts, p, F.col("__n")).alias("parts"))
    return rows.select("image_id", F.size("parts").alias("selected"), F.sha2(F.array_join("parts", ","), 256).alias("digest"))


# --- two models side by side -----------------------------------------------------------------------------------


def compare_predictions(a: DataFrame, b: DataFrame, bound: float, allowed: float) -> DataFrame:
    """One row: max and mean absolute difference, share changed, share over ``bound``, verdict.

    The arrays are joined once per image and reduced inside the row before the global sum.
    """
    diffs = (
        a.select("image_id", F.col("probabilities").alias("pa"))
        .join(b.select("image_id", F.col("probabilities").alias("pb")), "image_id")
        .select(F.zip_with("pa", "pb", lambda x, y: F.abs(x.cast("double") - y.cast("double"))).alias("d"))
    )
    zero = F.lit(0.0)
    per_image = diffs.select(
        F.array_max("d").alias("worst"),
        F.aggregate("d", zero, lambda s, x: s + x).alias("total"),
        F.size(F.filter("d", lambda x: x > 0)).alias("changed"),
        F.size(F.filter("d", lambda x: x > F.lit(float(bound)))).alias("over"),
        F.size("d").alias("n"),
    )
    return per_image.agg(
        F.sum("n").alias("n_values"),
        F.max("worst").alias("max_diff"),
        (F.sum("total") / F.sum("n")).alias("mean_diff"),
        (F.sum("changed") / F.sum("n")).alias("share_changed"),
        (F.sum("over") / F.sum("n")).alias("share_over"),
        (F.max("worst") <= F.lit(float(allowed))).alias("within_limit"),
    )


def topk_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Per image: how many of the k best labels two models share. Only k indices per image are joined."""
    def best(df: DataFrame, name: str) -> DataFrame:
        best_k = _best_k(F.col("probabilities"), k)
        return df.select("image_id", F.transform(best_k, lambda x: x["tag_index"]).alias(name))

    joined = best(a, "ka").join(best(b, "kb"), "image_id")
    return joined.select("image_id", F.size(F.array_intersect("ka", "kb")).alias("overlap"))


# --- grouped view ----------------------------------------------------------------------------------------------


def display_groups(groups: DataFrame, catalog: DataFrame) -> DataFrame:
    """Declared groups in order, then undeclared catalog groups by first appearance.

    ``tier, pos`` is the order. A declared group may carry any strategy; an undeclared one is a
    rating group only by its name.
    """
    declared = groups.filter((F.col("id").isNotNull()) & (F.col("id") != "")).select(
        F.col("id"),
        F.struct(
            F.lit(0).alias("tier"),
            F.col("pos").cast("int").alias("pos"),
            F.coalesce(F.nullif("display_name", F.lit("")), "id").alias("display_name"),
            F.when(F.coalesce(F.trim("strategy"), F.lit("")) == "", "threshold").otherwise(F.col("strategy")).alias("strategy"),
        ).alias("entry"),
    )
    found = catalog.groupBy(F.col("group").alias("id")).agg(F.min("tag_index").cast("int").alias("pos"))
    found = found.select(
        "id",
        F.struct(
            F.lit(1).alias("tier"),
            "pos",
            F.col("id").alias("display_name"),
            F.when(F.col("id") == RATING, "rating").otherwise("threshold").alias("strategy"),
        ).alias("entry"),
    )
    first = declared.unionByName(found).groupBy("id").agg(F.min("entry").alias("entry"))
    return first.select("id", "entry.*")


def _group_vector(groups: DataFrame, catalog: DataFrame) -> Column:
    """Display groups with their label positions, in order, as one scalar array (one entry per group)."""
    members = catalog.groupBy(F.col("group").alias("id")).agg(F.sort_array(F.collect_list("tag_index")).alias("members"))
    ordered = display_groups(groups, catalog).join(members, "id", "left")
    entry = F.struct(
        "tier", "pos", "id", "display_name",
        ((F.col("strategy") == "rating") | (F.col("id") == RATING)).alias("is_rating"),
        F.coalesce("members", F.array().cast("array<int>")).alias("members"),
    )
    return ordered.agg(F.sort_array(F.collect_list(entry)).alias("g")).scalar()


def _group_hits(values: Column, group: Column, threshold: float) -> Column:
    """(neg, tag_index) pairs shown for one group: the best one of a rating group, else all visible."""
    pair = lambda i: F.struct((-F.get(values, i)).alias("neg"), i.alias("tag_index"))
    seen = F.filter(group["members"], lambda i: is_visible(F.get(values, i), threshold))
    best = best_of(values, group["members"])
    return F.when(group["is_rating"], F.filter(F.array(best), lambda x: x.isNotNull())).otherwise(
        F.sort_array(F.transform(seen, pair))
    )


def group_summary(predictions: DataFrame, catalog: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """Image x group: visible count and whether the group is empty. Empty groups keep their row."""
    t = check_threshold(threshold)
    p = F.col("probabilities")
    counts = F.transform(
        F.col("__groups"),
        lambda g: F.struct(g["id"].alias("group_id"), F.size(_group_hits(p, g, t)).alias("visible")),
    )
    rows = unnest(bind(predictions, groups=_group_vector(groups, catalog)), ["image_id"], counts, "group_pos", "s")
    return rows.select("image_id", "group_pos", "s.group_id", "s.visible", (F.col("s.visible") == 0).alias("is_empty"))


def hit_summary(images: DataFrame, catalog: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """Hits over all groups, labels in total, and whether there is a usable result at all."""
    t = check_threshold(threshold)
    p, n = F.col("probabilities"), catalog_size(catalog)
    hits = F.aggregate(F.col("__groups"), F.lit(0), lambda acc, g: acc + F.size(_group_hits(p, g, t)))
    usable = p.isNotNull() & (F.size(p) == n)
    return bind(images, groups=_group_vector(groups, catalog)).select(
        "image_id",
        F.when(usable, hits).otherwise(0).alias("hit_count"),
        n.alias("total_count"),
        F.coalesce(usable, F.lit(False)).alias("has_result"),
    )


def excluded_arrays(overrides: DataFrame) -> DataFrame:
    """Overrides as one small set per image. A set holds at most every label once, however many rows repeat it."""
    return overrides.groupBy("image_id").agg(F.collect_set(F.col("tag_index").cast("int")).alias("excluded"))


def tag_groups(
    predictions: DataFrame, catalog: DataFrame, groups: DataFrame, threshold: float, overrides: DataFrame | None = None
) -> DataFrame:
    """The grouped view as rows: every shown tag with its group, rank and flags.

    A group with strategy "rating" shows its own best label. Only the shown tags, not the score
    arrays, meet the overrides.
    """
    t = check_threshold(threshold)
    p = F.col("probabilities")
    usable = F.size(p) == catalog_size(catalog)
    views = F.transform(
        F.col("__groups"),
        lambda g: F.struct(
            g["id"].alias("group_id"), g["display_name"].alias("display_name"), g["is_rating"].alias("is_rating"),
            _group_hits(p, g, t).alias("hits"),
        ),
    )
    shown = bind(predictions, groups=_group_vector(groups, catalog)).select(
        "image_id", F.when(usable, views).alias("groups")
    )
    if overrides is not None:
        shown = shown.join(excluded_arrays(overrides), "image_id", "left")
    else:
        shown = shown.withColumn("excluded", F.lit(None).cast("array<int>"))
    rows = unnest(shown, ["image_id", "excluded"], "groups", "group_pos", "g")
    rows = unnest(rows, ["image_id", "excluded", "group_pos", "g"], "g.hits", "at", "hit")
    rows = bind(rows, labels=label_vector(catalog, "name", "translation"))
    rows = rows.withColumn("label", F.get("__labels", F.col("hit.tag_index")))
    return rows.select(
        "image_id",
        "group_pos",
        F.col("g.group_id").alias("group_id"),
        F.col("g.display_name").alias("display_name"),
        (F.col("at") + 1).alias("rank"),
        F.col("hit.tag_index").alias("tag_index"),
        F.col("label.name").alias("name"),
        F.col("label.translation").alias("translation"),
        (-F.col("hit.neg")).alias("probability"),
        F.coalesce(F.array_contains("excluded", F.col("hit.tag_index")), F.lit(False)).alias("is_excluded"),
        F.col("g.is_rating").alias("is_top_rating"),
    )


def visible_tag_text(tags: DataFrame) -> DataFrame:
    """Names of all shown, not excluded tags of ``tag_groups`` per image, in view order, joined with ", ".

    At most one row per image and label comes in, so the text is bounded by the catalog.
    """
    kept = tags.filter(~F.col("is_excluded"))
    ordered = F.sort_array(F.collect_list(F.struct("group_pos", "rank", "name")))
    return kept.groupBy("image_id").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), ", ").alias("text"))


def drop_overrides(tags: DataFrame, overrides: DataFrame) -> DataFrame:
    """Remove user-unchecked labels from tag rows; the key is (image, label), so it spreads evenly."""
    return tags.join(overrides.select("image_id", "tag_index").distinct(), ["image_id", "tag_index"], "left_anti")


def tag_display(df: DataFrame) -> DataFrame:
    """Confidence text and translation text of tag rows."""
    percent = (F.col("probability") * F.lit(100.0).cast("float")).cast("double")
    same = F.col("translation").isNull() | (F.col("translation") == "") | (F.col("translation") == F.col("name"))
    return df.withColumn("confidence_text", F.format_string("%.2f%%", percent)).withColumn(
        "translation_text", F.when(same, fixed.NO_TRANSLATION).otherwise(F.col("translation"))
    )

"""Label catalogs: building from source tags and translations, and checking catalogs and packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom import fixed
from tagloom.functions import is_blank



def category_group(category: Column) -> Column:
    """Group of a source category; unmapped categories go to the default group."""
    table = F.create_map(*[F.lit(x) for c, g in fixed.CATEGORY_GROUPS.items() for x in (c, g)])
    return F.coalesce(F.try_element_at(table, category), F.lit(fixed.DEFAULT_GROUP))


def map_category(tags: DataFrame) -> DataFrame:
    return tags.withColumn("group", category_group(F.col("category")))


def unmapped_category(category: Column) -> Column:
    return ~category.isin(list(fixed.CATEGORY_GROUPS))


def attach_translation(tags: DataFrame, translations: DataFrame) -> DataFrame:
    """Left join on id. A found translation must be for the same tag text, otherwise the job fails."""
    t = translations.select(F.col("id").alias("tag_id"), "tag", F.col("translation").alias("found"))
    joined = tags.join(t, "tag_id", "left")
    wrong = F.col("tag").isNotNull() & (F.col("tag") != F.col("name"))
    message = F.concat(F.lit("translation is for another tag, id "), F.col("tag_id").cast("string"))
    text = (
        F.when(wrong, F.raise_error(message))
        .when(F.col("found").isNull() | (F.col("found") == F.col("name")), "")
        .otherwise(F.col("found"))
    )
    return joined.withColumn("translation", text).drop("tag", "found")


def translation_mismatches(tags: DataFrame, translations: DataFrame) -> DataFrame:
    """The rows that make ``attach_translation`` fail, for a report before the job."""
    t = translations.select(F.col("id").alias("tag_id"), "tag")
    return tags.join(t, "tag_id").filter(F.col("tag") != F.col("name")).select("tag_id", "name", "tag")


def build_catalog(tags: DataFrame, translations: DataFrame) -> DataFrame:
    """Catalog file rows: id, name, group, translation, count."""
    rows = attach_translation(map_category(tags), translations)
    return rows.select(F.col("tag_id").alias("id"), "name", "group", "translation", "count")


def catalog_of(file_rows: DataFrame) -> DataFrame:
    """Catalog file rows as the catalog the score operators use: no translation means null."""
    translation = F.when((F.col("translation") == "") | (F.col("translation") == F.col("name")), None).otherwise(F.col("translation"))
    return file_rows.select(F.col("id").alias("tag_index"), "name", translation.alias("translation"), "group")


def category_counts(tags: DataFrame) -> DataFrame:
    """Per category and group how many tags, and whether the category is an unmapped one."""
    rows = map_category(tags).groupBy("category", "group").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(
        F.concat(F.col("category").cast("string"), F.lit(":"), "group").alias("category_group"),
        "category", "n", unmapped_category(F.col("category")).alias("unmapped"),
    )


def category_report(tags: DataFrame) -> DataFrame:
    """One row: all counts as a map and the unmapped categories, sorted as numbers. One entry per category."""
    c = category_counts(tags)
    return c.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category_group", "n")))).alias("category_counts"),
        F.sort_array(F.collect_set(F.when(F.col("unmapped"), F.col("category")))).alias("unmapped_categories"),
    )


def labels_per_group(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("group").agg(F.count(F.lit(1)).alias("labels"), F.min("tag_index").alias("first_index"))


def duplicate_names(catalog: DataFrame, first: int | None = None) -> DataFrame:
    """Names occurring more than once, in order of first appearance; ``first`` limits the report."""
    names = catalog.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("tag_index").alias("first_index"))
    names = names.filter("n > 1")
    return names if first is None else names.orderBy("first_index").limit(first)


def canonical_group_order(groups: DataFrame) -> DataFrame:
    """Add ``canonical_pos``: rating, artist, copyright, character, general; all others after them."""
    at = F.array_position(F.array(*[F.lit(g) for g in fixed.CANONICAL_GROUPS]), F.col("id")).cast("int")
    return groups.withColumn("canonical_pos", F.when(at > 0, at - 1).otherwise(99))


def catalog_groups(catalog: DataFrame) -> DataFrame:
    """Groups of a catalog with their first appearance."""
    return catalog.groupBy(F.col("group").alias("id")).agg(F.min("tag_index").alias("pos"))


def unknown_group_rows(catalog: DataFrame, groups: DataFrame) -> DataFrame:
    return catalog.join(groups.select(F.col("id").alias("group")).distinct(), "group", "left_anti")


def first_gap(catalog: DataFrame) -> DataFrame:
    """First position whose id is not the position, walking the file in order of ``seq``.

    Positions are counted per block of ids and the blocks are summed up, so no task numbers the
    whole file.
    """
    from tagloom.operators.ranking import row_numbers

    numbered = row_numbers(catalog, [], "seq", block=100_000)
    bad = numbered.filter(F.col("row_number") - 1 != F.col("tag_index"))
    return bad.agg(F.min(F.struct((F.col("row_number") - 1).alias("position"), "tag_index")).alias("g")).select("g.*").filter("position is not null")


def check_catalog(catalog: DataFrame, groups: DataFrame, label_count: int) -> DataFrame:
    """Problems of a catalog as rows ``check, subject, detail``; no rows means it is fine.

    ``catalog`` needs ``seq`` (file order), ``tag_index``, ``name``, ``group``.
    """
    count = catalog.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != label_count).select(
        F.lit("label_count").alias("check"), F.lit(str(label_count)).alias("subject"), F.col("n").cast("string").alias("detail")
    )
    gap = first_gap(catalog).select(
        F.lit("not_contiguous").alias("check"), F.col("position").cast("string").alias("subject"), F.col("tag_index").cast("string").alias("detail")
    )
    repeated = duplicate_names(catalog).select(
        F.lit("duplicate_name").alias("check"), F.col("name").alias("subject"), F.col("n").cast("string").alias("detail")
    )
    unknown = unknown_group_rows(catalog, groups).groupBy("group").agg(F.min("tag_index").alias("at")).select(
        F.lit("unknown_group").alias("check"), F.col("group").alias("subject"), F.col("at").cast("string").alias("detail")
    )
    unnamed = catalog.filter(F.coalesce(F.col("name"), F.lit("")) == "").select(
        F.lit("empty_name").alias("check"), F.col("tag_index").cast("string").alias("subject"), F.lit("").alias("detail")
    )
    return count.unionByName(gap).unionByName(repeated).unionByName(unknown).unionByName(unnamed)


def check_manifest(manifests: DataFrame) -> DataFrame:
    """Problems of manifests (one row each, ``tagloom.schemas.MANIFEST``) as rows ``id, check, detail``."""
    ids = F.transform("groups", lambda g: g["id"])
    strategies = F.transform("groups", lambda g: F.when(is_blank(g["strategy"]), "threshold").otherwise(g["strategy"]))
    bad_ids = F.filter(ids, lambda g: ~F.coalesce(g.rlike(fixed.GROUP_ID_PATTERN), F.lit(False)))
    bad_strategies = F.filter(strategies, lambda s: ~s.isin(fixed.GROUP_STRATEGIES))
    activation = F.col("output.activation")
    problem = lambda cond, name, detail: F.when(cond, F.struct(F.lit(name).alias("check"), detail.cast("string").alias("detail")))
    problems = F.array(
        problem(F.coalesce(F.col("schemaVersion") != 1, F.lit(True)), "schema_version", F.col("schemaVersion")),
        problem(F.coalesce(~F.col("id").rlike("^[A-Za-z0-9-]+$"), F.lit(True)), "manifest_id", F.col("id")),
        problem(F.coalesce(F.col("task") != fixed.MODEL_TASK, F.lit(True)), "task", F.col("task")),
        problem(F.coalesce(~F.col("defaultThreshold").between(0.0, 1.0), F.lit(True)), "default_threshold", F.col("defaultThreshold")),
        problem(F.coalesce(F.size("groups"), F.lit(0)) < 1, "no_groups", F.lit("")),
        problem(F.size(F.array_distinct(ids)) != F.size(ids), "duplicate_group", F.array_join(ids, ",")),
        problem(F.size(bad_ids) > 0, "group_id", F.array_join(bad_ids, ",", "")),
        problem(F.size(bad_strategies) > 0, "strategy", F.array_join(bad_strategies, ",")),
        problem(F.coalesce(~F.lower(activation).isin(fixed.ACTIVATIONS), F.lit(True)), "activation", activation),
        problem(F.coalesce(F.col("output.labelCount") < 1, F.lit(True)), "label_count", F.col("output.labelCount")),
    )
    rows = manifests.select("id", F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("p"))
    return rows.select("id", "p.*")


def fingerprint(model: Column, catalog: Column, manifest: Column, preparation: Column) -> Column:
    """SHA-256 over the four hex digests, one per line."""
    return F.sha2(F.concat_ws("\n", model, catalog, manifest, preparation), 256)

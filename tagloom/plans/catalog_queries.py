"""Catalog, pack and source queries."""

from pyspark.sql import Window, functions as F

from tagloom.operators import catalog as C
from tagloom.plans import bindings as B
from tagloom.plans.registry import query
from tagloom.plans.sqltext import CATALOG, CATALOG_DUP, GROUP_CASE, GROUPS3, SOURCE_TAGS, TRANSLATIONS, with_
from tagloom.session import shared_dir
from tagloom.sources import packs, sinks

BUILT = f"""built AS (
  SELECT tag_id AS id, name, {GROUP_CASE.format(c='category')} AS grp,
         CASE WHEN t.translation IS NULL OR t.translation = name THEN '' ELSE t.translation END AS translation, cnt
  FROM source_tags s LEFT JOIN translations t ON t.id = s.tag_id)"""
BUILD = with_(SOURCE_TAGS, TRANSLATIONS, BUILT)


@query("catalog_map_category", with_(SOURCE_TAGS) + f"""
SELECT tag_id, name, category, cnt AS count, {GROUP_CASE.format(c='category')} AS "group" FROM source_tags""")
def map_category(spark, sf):
    return C.map_category(B.source_tags(spark, sf))


@query("catalog_attach_translation", with_(SOURCE_TAGS, TRANSLATIONS, BUILT) + "SELECT id AS tag_id, name, translation FROM built")
def attach_translation(spark, sf):
    return C.attach_translation(B.source_tags(spark, sf), B.translations(spark, sf)).select("tag_id", "name", "translation")


@query("catalog_build", BUILD + """SELECT id, name, grp AS "group", translation, cnt AS count FROM built""")
def build(spark, sf):
    return C.build_catalog(B.source_tags(spark, sf), B.translations(spark, sf))


@query("catalog_category_counts", with_(SOURCE_TAGS) + f"""
SELECT category || ':' || {GROUP_CASE.format(c='category')} AS category_group, category, count(*) AS n, category NOT IN (0, 1, 3, 4, 9) AS unmapped
FROM source_tags GROUP BY category""")
def category_counts(spark, sf):
    return C.category_counts(B.source_tags(spark, sf))


@query("catalog_category_report", with_(SOURCE_TAGS) + """
SELECT string_agg(DISTINCT category, ',' ORDER BY category) FILTER (WHERE category NOT IN (0, 1, 3, 4, 9)) AS unmapped,
       CAST(count(DISTINCT category) AS INTEGER) AS entries, count(*) FILTER (WHERE category = 9) AS ratings FROM source_tags""")
def category_report(spark, sf):
    r = C.category_report(B.source_tags(spark, sf))
    return r.select(
        F.array_join(F.transform("unmapped_categories", lambda c: c.cast("string")), ",").alias("unmapped"),
        F.size("category_counts").alias("entries"), F.try_element_at("category_counts", F.lit("9:rating")).alias("ratings"),
    )


@query("catalog_labels_per_group", with_(CATALOG) + """
SELECT grp AS "group", count(*) AS labels, min(tag_index) AS first_index FROM catalog GROUP BY grp""")
def labels_per_group(spark, sf):
    return C.labels_per_group(B.catalog64(spark, sf))


@query("catalog_duplicate_names", with_(CATALOG_DUP) + """
SELECT name, count(*) AS n, min(tag_index) AS first_index FROM catalog GROUP BY name HAVING count(*) > 1 ORDER BY first_index LIMIT 3""")
def duplicate_names(spark, sf):
    """The report shows the first three names."""
    return C.duplicate_names(B.catalog64(spark, sf, True), first=3)


@query("catalog_canonical_order", with_(CATALOG) + """
SELECT id, CAST(CASE id WHEN 'rating' THEN 0 WHEN 'artist' THEN 1 WHEN 'copyright' THEN 2 WHEN 'character' THEN 3 WHEN 'general' THEN 4 ELSE 99 END AS INTEGER) AS canonical_pos
FROM (SELECT DISTINCT grp AS id FROM catalog UNION SELECT DISTINCT p_type FROM part)""")
def canonical_order(spark, sf):
    groups = B.catalog64(spark, sf).select(F.col("group").alias("id")).distinct()
    return C.canonical_group_order(groups.unionByName(B.table(spark, sf, "part").select(F.col("p_type").alias("id")).distinct()))


@query("catalog_unknown_groups", with_(SOURCE_TAGS, GROUPS3) + f"""
SELECT tag_id, grp AS "group" FROM (SELECT tag_id, {GROUP_CASE.format(c='category')} AS grp FROM source_tags) WHERE grp NOT IN (SELECT id FROM groups3)""")
def unknown_groups(spark, sf):
    return C.unknown_group_rows(C.map_category(B.source_tags(spark, sf)), B.groups3(spark)).select("tag_id", "group")


@query("catalog_check", with_(SOURCE_TAGS) + f"""
, t AS (SELECT tag_id AS seq, CAST(CASE WHEN tag_id >= 100 THEN tag_id + 1 ELSE tag_id END AS INTEGER) AS tag_index,
        CASE WHEN tag_id % 97 = 5 THEN '' ELSE substr(name, 1, length(name) - length(tag_id::VARCHAR)) END AS name, {GROUP_CASE.format(c='category')} AS grp FROM source_tags)
SELECT 'label_count' AS "check", '7' AS subject, count(*)::VARCHAR AS detail FROM t HAVING count(*) <> 7
UNION ALL SELECT 'not_contiguous', '100', '101'
UNION ALL SELECT 'duplicate_name', name, count(*)::VARCHAR FROM t GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'unknown_group', grp, min(tag_index)::VARCHAR FROM t WHERE grp IN ('artist', 'copyright') GROUP BY grp
UNION ALL SELECT 'empty_name', tag_index::VARCHAR, '' FROM t WHERE name = ''""")
def check(spark, sf):
    """All source tags with a gap at 100, shortened names and two undeclared groups."""
    t = C.map_category(B.source_tags(spark, sf)).select(
        F.col("tag_id").cast("long").alias("seq"),
        F.when(F.col("tag_id") >= 100, F.col("tag_id") + 1).otherwise(F.col("tag_id")).alias("tag_index"),
        F.when(F.col("tag_id") % 97 == 5, "").otherwise(
            F.substring("name", F.lit(1), F.length("name") - F.length(F.col("tag_id").cast("string")))
        ).alias("name"),
        "group",
    )
    return C.check_catalog(t, B.groups3(spark), 7)


@query("catalog_check_manifest", """
SELECT id, "check", detail FROM (
  SELECT 'm-' || p_partkey AS id, 'default_threshold' AS "check", printf('%.1f', p_size::DOUBLE) AS detail FROM part WHERE p_size > 1
  UNION ALL SELECT 'm-' || p_partkey, 'group_id', p_brand FROM part
  UNION ALL SELECT 'm-' || p_partkey, 'activation', 'softmax' FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT 'm-' || p_partkey, 'duplicate_group', p_brand || ',general,general' FROM part WHERE p_partkey % 2 = 0)""")
def check_manifest(spark, sf):
    """One manifest per part."""
    part = B.table(spark, sf, "part")
    group = lambda i: F.struct(i.alias("id"), i.alias("name"), i.alias("displayName"), F.lit(None).cast("string").alias("strategy"))
    twice = F.when(F.col("p_partkey") % 2 == 0, F.array(group(F.col("p_brand")), group(F.lit("general")), group(F.lit("general"))))
    manifests = part.select(
        F.lit(1).alias("schemaVersion"), F.concat(F.lit("m-"), F.col("p_partkey").cast("string")).alias("id"),
        F.lit("multi-label-image-tagging").alias("task"), F.col("p_size").cast("double").alias("defaultThreshold"),
        F.coalesce(twice, F.array(group(F.col("p_brand")), group(F.lit("general")))).alias("groups"),
        F.struct(F.when(F.col("p_partkey") % 3 == 0, "softmax").otherwise("Sigmoid").alias("activation"), F.lit(64).alias("labelCount")).alias("output"),
    )
    return C.check_manifest(manifests)


@query("pack_fingerprint", """
SELECT p_partkey, sha256(sha256(p_name) || chr(10) || sha256(p_type) || chr(10) || sha256(p_brand) || chr(10) || sha256(p_size::VARCHAR)) AS fingerprint FROM part""")
def fingerprint(spark, sf):
    h = lambda c: F.sha2(F.col(c).cast("string"), 256)
    return B.table(spark, sf, "part").select("p_partkey", C.fingerprint(h("p_name"), h("p_type"), h("p_brand"), h("p_size")).alias("fingerprint"))


@query("pack_catalog_file", BUILD + """SELECT id, name, grp AS "group", translation, cnt AS count FROM built""")
def catalog_file(spark, sf):
    """The built catalog written as a file and read back."""
    path = shared_dir(spark, "catalog")
    sinks.write_catalog_files(build(spark, sf), path)
    return packs.read_catalog_file(spark, path)


@query("pack_catalog_files_in_order", """SELECT count(*) AS n, true AS several, true AS ordered FROM part""")
def catalog_files(spark, sf):
    """The built catalog written as five ranges of ids: the files' own least and greatest ids follow the order of their names."""
    path = shared_dir(spark, "catalog")
    sinks.write_catalog_files(build(spark, sf), path, files=5)
    files = packs.read_catalog_file(spark, path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))
    previous = F.lag("high").over(Window.orderBy("file"))  # one row per file
    rising = files.select("n", F.coalesce(previous < F.col("low"), F.lit(True)).alias("rising"))
    return rising.agg(F.sum("n").alias("n"), (F.count(F.lit(1)) > 1).alias("several"), F.every("rising").alias("ordered"))


def _written_pack(spark, sf, broken: bool):
    """The label catalog as a file and a manifest that declares its groups and count; a broken pack has spoiled rows and a wrong count."""
    catalog = B.catalog64(spark, sf)
    rows = catalog.select(F.col("tag_index").alias("id"), "name", "group", F.coalesce("translation", F.lit("")).alias("translation"), F.lit(1).cast("long").alias("count"))
    if broken:
        i = F.col("id")
        rows = rows.withColumns({
            "name": F.when(i % 16 == 3, "").when(i % 16 == 5, "same").otherwise(F.col("name")), "group": F.when(i % 8 == 1, F.concat(F.lit("new"), (i % 3).cast("string"))).otherwise(F.col("group")),
        })
    group = F.struct(F.col("group").alias("id"), F.upper("group").alias("name"), F.initcap("group").alias("displayName"), F.when(F.col("group") == "rating", "rating").alias("strategy"))
    ordered = F.sort_array(F.collect_set(F.struct((F.col("group") != "rating").alias("late"), group.alias("g"))))  # five groups
    manifest = catalog.agg(ordered.alias("groups"), F.count(F.lit(1)).cast("int").alias("n")).select(
        F.lit(1).alias("schemaVersion"), F.lit("pack-1").alias("id"), F.lit("multi-label-image-tagging").alias("task"), F.lit(1.5 if broken else 0.5).alias("defaultThreshold"),
        F.transform("groups", lambda g: g["g"]).alias("groups"), F.struct(F.lit("Sigmoid").alias("activation"), (F.col("n") + int(broken)).alias("labelCount")).alias("output"),
    )
    where = shared_dir(spark, "pack")
    sinks.write_catalog(rows, f"{where}/tags")
    manifest.coalesce(1).write.json(f"{where}/manifest")
    return f"{where}/tags", f"{where}/manifest"


@query("pack_checked_catalog", with_(CATALOG) + """
, g AS (SELECT id, row_number() OVER (ORDER BY id <> 'rating', id) - 1 AS pos FROM (SELECT DISTINCT grp AS id FROM catalog))
SELECT c.tag_index, c.name, nullif(nullif(c.translation, ''), c.name) AS translation, c.grp AS "group", CAST(g.pos AS INTEGER) AS pos, upper(g.id) AS group_name,
       CASE WHEN g.id = 'rating' THEN 'rating' ELSE 'threshold' END AS strategy FROM catalog c JOIN g ON g.id = c.grp""")
def checked_pack(spark, sf):
    """Catalog and manifest written, read back as one checked pack; every label with its declared group."""
    catalog, groups = packs.read_pack(spark, *_written_pack(spark, sf, broken=False))
    own = groups.select(F.col("id").alias("group"), "pos", F.col("name").alias("group_name"), "strategy")
    return catalog.join(own, "group").select("tag_index", "name", "translation", "group", "pos", "group_name", "strategy")


@query("pack_problems", with_(CATALOG) + """
, t AS (SELECT tag_index, CASE WHEN tag_index % 16 = 3 THEN '' WHEN tag_index % 16 = 5 THEN 'same' ELSE name END AS name,
        CASE WHEN tag_index % 8 = 1 THEN 'new' || tag_index % 3 ELSE grp END AS grp FROM catalog)
SELECT 'manifest' AS file, 'default_threshold' AS "check", 'pack-1' AS subject, '1.5' AS detail
UNION ALL SELECT 'catalog', 'label_count', (count(*) + 1)::VARCHAR, count(*)::VARCHAR FROM t
UNION ALL SELECT 'catalog', 'duplicate_name', name, count(*)::VARCHAR FROM t GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'catalog', 'unknown_group', grp, min(tag_index)::VARCHAR FROM t WHERE grp LIKE 'new%' GROUP BY grp
UNION ALL SELECT 'catalog', 'empty_name', tag_index::VARCHAR, '' FROM t WHERE name = ''""")
def broken_pack(spark, sf):
    """A pack with nameless, repeated and ungrouped labels, a wrong label count and a threshold out of range."""
    return packs.pack_problems(spark, *_written_pack(spark, sf, broken=True))


@query("pack_source_tags_file", with_(SOURCE_TAGS) + "SELECT tag_id, name, category, cnt AS count FROM source_tags")
def source_tags_file(spark, sf):
    path = shared_dir(spark, "source-tags")
    padded = B.source_tags(spark, sf).withColumn("name", F.concat(F.lit("  "), "name", F.lit(" ")))
    padded.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return packs.read_source_tags(spark, path)


@query("pack_translation_lines", """
SELECT CAST(p_partkey % 500 AS INTEGER) AS id, arg_max(p_name, p_partkey) AS tag, arg_max(CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END, p_partkey) AS translation
FROM part GROUP BY 1""")
def translation_lines(spark, sf):
    """JSON lines made from all parts, several lines per id, the last one counts."""
    part = B.table(spark, sf, "part")
    line = F.to_json(F.struct(
        (F.col("p_partkey") % 500).cast("int").alias("id"), F.col("p_name").alias("tag"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("translation")
    ))
    return packs.last_line_per_id(part.select(F.col("p_partkey").alias("line_no"), line.alias("value")))


@query("pack_checksum_lines", """
SELECT CASE WHEN p_partkey % 4 = 3 THEN p_brand ELSE 'model.onnx' END AS name, CASE WHEN p_partkey % 4 = 1 THEN 'beef' ELSE sha256(p_name) END AS sha256,
       CASE WHEN p_partkey % 4 = 1 THEN 'invalid_line' WHEN p_partkey % 4 = 3 THEN 'unknown_file' ELSE 'duplicate_file' END AS problem FROM part""")
def checksum_lines(spark, sf):
    k = F.col("p_partkey") % 4
    digest = F.when(k == 1, "BEEF").otherwise(F.upper(F.sha2("p_name", 256)))
    name = F.when(k == 3, F.col("p_brand")).otherwise("model.onnx")
    return packs.parse_checksums(B.table(spark, sf, "part").select(F.concat(digest, F.lit("  "), name).alias("value")))


@query("pack_compare_checksums", """
SELECT p_name || p_partkey AS name, CASE WHEN p_partkey % 7 = 0 THEN 'missing_file' WHEN p_partkey % 11 = 0 THEN 'missing_entry'
  WHEN p_partkey % 5 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM part WHERE NOT (p_partkey % 7 = 0 AND p_partkey % 11 = 0)""")
def compare_checksums(spark, sf):
    part = B.table(spark, sf, "part").withColumn("name", F.concat("p_name", F.col("p_partkey").cast("string")))
    expected = part.filter("p_partkey % 11 <> 0").select("name", F.sha2("p_type", 256).alias("sha256"))
    actual = part.filter("p_partkey % 7 <> 0").select(
        "name", F.sha2(F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise(F.col("p_type")), 256).alias("sha256")
    )
    return packs.compare_checksums(expected, actual)


@query("pack_file_set", """
SELECT p_name || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN 'missing_file' ELSE 'unknown_entry' END AS problem
FROM part WHERE (p_partkey % 3 = 0) <> (p_partkey % 4 = 0)""")
def file_set(spark, sf):
    part = B.table(spark, sf, "part").withColumn("name", F.concat("p_name", F.col("p_partkey").cast("string")))
    return packs.file_set_diff(part.filter("p_partkey % 3 <> 0"), part.filter("p_partkey % 4 <> 0"))


@query("pack_checksum_manifest", """
SELECT doc_id || '.txt' AS name, sha256(text) AS sha256, sha256(text) || '  ' || doc_id || '.txt' AS line FROM documents""")
def checksum_manifest(spark, sf):
    docs = B.table(spark, sf, "documents")
    return sinks.checksum_manifest(docs.select(
        F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content")
    ))

"""Model packs: catalog, source tags, translations, groups and checksum files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom import fixed, schemas
from tagloom.functions import is_blank, trim_unicode
from tagloom.operators.catalog import catalog_of, check_catalog, check_manifest


def read_catalog_file(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a catalog file. A header other than id,name,group,translation,count fails the read."""
    return spark.read.csv(
        path, schema=schemas.CATALOG_FILE, header=True, enforceSchema=False, mode="FAILFAST", escape='"', multiLine=True
    ).fillna("", ["name", "group", "translation"])


def _in_file_order(rows: DataFrame) -> DataFrame:
    return catalog_of(rows).withColumn("seq", F.col("tag_index").cast("long"))


def _require_none(problems: DataFrame, what: str) -> None:
    # one row per kind of check, whatever the number of problems
    found = problems.groupBy("check").agg(F.count("*").alias("n"), F.min(F.struct("subject", "detail")).alias("first")).orderBy("check").collect()
    if found:
        raise ValueError(f"{what} is invalid: " + "; ".join(f"{p['check']} ({p['n']}): {p['first']['subject']} {p['first']['detail']}" for p in found))


def read_catalog(spark: SparkSession, path: str, groups: DataFrame, label_count: int) -> DataFrame:
    """The checked catalog; any problem found by ``check_catalog`` is an error."""
    catalog = _in_file_order(read_catalog_file(spark, path))
    _require_none(check_catalog(catalog, groups, label_count), "catalog")
    return catalog.drop("seq")


def _label_count(manifest: DataFrame) -> int:
    """The count a manifest declares, -1 for none; a pack has one manifest."""
    declared = manifest.select("output.labelCount").head()
    return -1 if declared is None or declared[0] is None else int(declared[0])


def pack_problems(spark: SparkSession, catalog_path: str, manifest_path: str) -> DataFrame:
    """``file, check, subject, detail``: what is wrong with the manifest, and with the catalog against the groups and the label count the manifest declares.

    No rows mean a good pack. A missing manifest row counts as one without groups and without a label count.
    """
    manifest = read_manifest(spark, manifest_path)
    own = check_manifest(manifest).select(F.lit("manifest").alias("file"), "check", F.col("id").alias("subject"), "detail")
    catalog = check_catalog(_in_file_order(read_catalog_file(spark, catalog_path)), read_groups(manifest), _label_count(manifest))
    return own.unionByName(catalog.select(F.lit("catalog").alias("file"), "check", "subject", "detail"))


def read_pack(spark: SparkSession, catalog_path: str, manifest_path: str) -> tuple[DataFrame, DataFrame]:
    """The checked catalog and groups of a pack; any row of ``pack_problems`` is an error."""
    _require_none(pack_problems(spark, catalog_path, manifest_path), "pack")
    return catalog_of(read_catalog_file(spark, catalog_path)), read_groups(read_manifest(spark, manifest_path))


def read_source_tags(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(
        path, schema=schemas.SOURCE_TAGS, header=True, mode="FAILFAST", escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True
    )
    return rows.withColumn("name", trim_unicode(F.col("name")))


def last_line_per_id(lines: DataFrame) -> DataFrame:
    """``id, tag, translation`` of JSON lines ``(line_no, value)``; blank lines skipped, the last line of an id wins."""
    row = F.from_json("value", "id int, tag string, translation string", {"mode": "FAILFAST"}).alias("r")
    rows = lines.filter(~is_blank(F.col("value"))).select("line_no", row)
    last = rows.groupBy("r.id").agg(F.max_by("r", "line_no").alias("r"))
    return last.select("r.id", F.coalesce("r.tag", F.lit("")).alias("tag"), F.coalesce("r.translation", F.lit("")).alias("translation"))


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """Lines count in the order of file names, and within a file in its own order, however Spark splits and orders the files."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("at"))
    lines = spark.read.text(path).select(place.alias("line_no"), "value")
    return last_line_per_id(lines)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=schemas.MANIFEST, multiLine=True, mode="FAILFAST")


def read_groups(manifest: DataFrame) -> DataFrame:
    """Declared groups in order; a blank strategy means "threshold"."""
    g = manifest.select(F.posexplode("groups").alias("pos", "g"))
    return g.select(
        "pos", "g.id", "g.name", F.col("g.displayName").alias("display_name"),
        F.when(is_blank(F.col("g.strategy")), "threshold").otherwise(F.col("g.strategy")).alias("strategy"),
    )


def parse_checksums(lines: DataFrame) -> DataFrame:
    """``name, sha256, problem`` of checksum lines (column ``value``); problem is null for a good line."""
    parts = F.filter(F.split("value", " "), lambda x: x != "")
    digest, name = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    rows = lines.filter(~is_blank(F.col("value"))).select(parts.alias("p")).select(
        name.alias("name"), F.lower(digest).alias("sha256"),
        ((F.size("p") == 2) & digest.rlike("^[0-9A-Fa-f]{64}$")).alias("well_formed"),
    )
    # counts of the few known names only: at most one row per name of the fixed list
    repeated = rows.filter(F.col("name").isin(fixed.HASHED_FILES)).groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = rows.join(F.broadcast(repeated), "name", "left")
    problem = (
        F.when(~F.coalesce("well_formed", F.lit(False)), "invalid_line").when(~F.col("name").isin(fixed.HASHED_FILES), "unknown_file")
        .when(F.col("n").isNotNull(), "duplicate_file")
    )
    return joined.select("name", "sha256", problem.alias("problem"))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    return parse_checksums(spark.read.text(path))


def compare_checksums(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``name, status``: ok, mismatch, missing_entry (file without a line) or missing_file."""
    e, a = expected.select("name", F.col("sha256").alias("want")), actual.select("name", F.col("sha256").alias("got"))
    status = (
        F.when(F.col("want").isNull(), "missing_entry").when(F.col("got").isNull(), "missing_file")
        .when(F.col("want") == F.col("got"), "ok").otherwise("mismatch")
    )
    return e.join(a, "name", "full").select("name", status.alias("status"))


def file_set_diff(found: DataFrame, required: DataFrame) -> DataFrame:
    """``name, problem``: names found but not required, and required but not found."""
    f, r = found.select("name").distinct(), required.select("name").distinct()
    unknown = f.join(r, "name", "left_anti").withColumn("problem", F.lit("unknown_entry"))
    missing = r.join(f, "name", "left_anti").withColumn("problem", F.lit("missing_file"))
    return unknown.unionByName(missing)

"""The operators' inputs expressed over the given tables. Every binding reads its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagloom.operators.catalog import map_category
from tagloom.session import literal_rows, spread, unnest

GROUPS5 = ["rating", "artist", "copyright", "character", "general"]
THRESHOLD = 0.6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as source tags: unique names, ten categories, translations partly empty."""
    part = table(spark, sf_dir, "part")
    name = F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"))
    return part.select(
        F.col("p_partkey").cast("int").alias("tag_id"),
        name.alias("name"),
        (F.col("p_partkey") % 10).cast("int").alias("category"),
        F.col("p_size").cast("long").alias("count"),
    )


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations of three tags in four; some equal to the name, some empty."""
    tags = source_tags(spark, sf_dir).filter("tag_id % 4 <> 3")
    text = (
        F.when(F.col("tag_id") % 5 == 0, "")
        .when(F.col("tag_id") % 7 == 0, F.col("name"))
        .otherwise(F.upper("name"))
    )
    return tags.select(F.col("tag_id").alias("id"), F.col("name").alias("tag"), text.alias("translation"))


def catalog64(spark: SparkSession, sf_dir: str, repeated_names: bool = False) -> DataFrame:
    """Labels of the 64 embedding positions, made from all parts: part k belongs to position k % 64.

    The first part of a position names the label, the sizes of all its parts add up to the count.
    """
    part = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 64).cast("int").alias("tag_index")).agg(
        F.min_by("p_name", "p_partkey").alias("p_name"), F.sum("p_size").alias("count")
    )
    base = F.translate("p_name", " ", "_")
    if repeated_names:
        name = F.when(F.col("tag_index") % 3 == 0, F.upper(base)).otherwise(base)
    else:
        name = F.concat(base, F.lit("_"), F.col("tag_index").cast("string"))
    rows = part.select(
        "tag_index",
        name.alias("name"),
        F.when(F.col("tag_index") % 5 == 0, "").otherwise(F.upper("p_name")).alias("translation"),
        (F.col("tag_index") % 10).alias("category"),
        "count",
    )
    return map_category(rows)


def groups5(spark: SparkSession) -> DataFrame:
    rows = [(i, g, g.title(), g.upper() if i % 2 == 0 else None, "rating" if g == "rating" else "threshold")
            for i, g in enumerate(GROUPS5)]
    return literal_rows(spark, "pos int, id string, name string, display_name string, strategy string", rows)


def groups3(spark: SparkSession) -> DataFrame:
    """Fewer declared groups than the catalog uses."""
    return groups5(spark).filter("id in ('rating', 'character', 'general')")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as probabilities on a grid of 1/64: exact in every engine, many ties."""
    p = F.transform(
        "embedding", lambda x: (F.floor((x.cast("double") + F.lit(0.6)) / F.lit(1.2) * 64) / F.lit(64.0)).cast("float")
    )
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), p.alias("probabilities"), "label")


def predictions_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with NaN and infinity sprinkled in."""
    nan, inf = F.lit(float("nan")).cast("float"), F.lit(float("inf")).cast("float")
    spoiled = F.transform(
        "probabilities",
        lambda p, i: F.when((F.col("image_id") + i) % 17 == 0, nan).when((F.col("image_id") + i) % 19 == 0, inf).otherwise(p),
    )
    return predictions(spark, sf_dir).withColumn("probabilities", spoiled)


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.transform("embedding", lambda x: x.cast("double") * 10)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), values.alias("logits"))


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding")
    rows = unnest(emb, ["image_id"], "embedding", "tag_index", "x").select("image_id", "tag_index")
    return rows.filter((F.col("image_id") * 7 + F.col("tag_index")) % 11 == 0)


STATES = ["not_run", "queued", "running", "succeeded", "failed", "canceled", "stale"]


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image facts: paths from pages where there is one, states and fingerprints from the label."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    joined = emb.join(pages, emb.vec_id == pages.page_id, "left")
    path = F.coalesce("url", F.concat(F.lit("img/"), F.col("vec_id").cast("string"), F.lit(".PNG")))
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.col("label") % 7 + 1).cast("int"))
    return joined.select(
        F.col("vec_id").alias("image_id"),
        path.alias("path"),
        F.regexp_extract(path, r"([^/\\]*)$", 1).alias("file_name"),
        (F.col("vec_id") * 1500).alias("file_size"),
        F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)).alias("format"),
        (F.col("label") * 100 + 64).cast("int").alias("width"),
        (F.col("label") * 50 + 48).cast("int").alias("height"),
        state.alias("state"),
        F.concat(F.lit("fp"), (F.col("label") % 2).cast("string")).alias("fingerprint"),
        F.when(F.col("label") % 7 == 4, "image_corrupt").alias("last_error"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page addresses, every fourth of them listed a second time."""
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("page_id").alias("seq"))
    again = pages.filter("seq % 4 = 0").withColumn("seq", F.col("seq") + 1_000_000_000)
    return pages.unionByName(again)


# --- generation metadata made from all parts -------------------------------------------------------------------


def _s(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def gen_text() -> Column:
    """Parameter text; every third part has no negative prompt, every fifth an unknown field."""
    c = F.col
    negative = F.when(c("p_partkey") % 3 == 0, "").otherwise(_s("\nNegative prompt: ", c("p_type")))
    extra = F.when(c("p_partkey") % 5 == 0, ", GlowRate: x y").otherwise("")
    return _s(
        c("p_name"), negative, "\nSteps: ", c("p_size"), ", Sampler: S (a, b), CFG scale: 7, Seed: ", c("p_partkey"), ", Model: ", c("p_brand"), extra
    )


def gen_nodes() -> Column:
    """Node map whose text nodes are named 10 and 9, so that their order as numbers matters."""
    c = F.col
    return _s(
        '{"1":{"class_type":"CheckpointLoaderSimple","inputs":{"ckpt_name":"', c("p_brand"), '"}},',
        '"10":{"class_type":"CLIPTextEncode","inputs":{"text":"', c("p_name"), '","clip":["1",1]}},',
        '"9":{"class_type":"CLIPTextEncode","inputs":{"text":"', c("p_type"), '"}},',
        '"5":{"class_type":"KSampler","inputs":{"seed":', c("p_partkey"), ',"steps":', c("p_size"), ',"cfg":7.0,"sampler_name":"euler","denoise":1e0}},',
        '"6":{"class_type":"EmptyLatentImage","inputs":{"width":512,"height":', c("p_size") * 8, ',"batch_size":1}},',
        '"7":{"class_type":"LoraLoader","inputs":{"lora_name":"l', c("p_size"), '","strength_model":0.8,"strength_clip":0.60}},',
        '"8":{"class_type":"VAELoader","inputs":{"vae_name":"v"}}, "11":{"class_type":"Other"}}',
    )


def gen_workflow() -> Column:
    c = F.col
    return _s(
        '{"nodes":[{"id":3,"type":"CLIPTextEncode","widgets_values":["wf ', c("p_name"), '"]},',
        '{"id":4,"type":"CheckpointLoaderSimple","widgets_values":["wf_', c("p_brand"), '"]},',
        '{"id":5,"type":"KSampler","widgets_values":[1,2]},{"id":6,"type":"EmptyLatentImage","widgets_values":[640,480,', c("p_size"), ']},{"type":"Note"}]}',
    )


def gen_comment() -> Column:
    c = F.col
    return _s('{"prompt":"', c("p_name"), '","uc":"', c("p_type"), '","Seed":', c("p_partkey"), ',"extra":{"a":[1]},"flag":true,"scale":5.50}')


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts over many tasks: each row is a few dozen bytes and becomes kilobytes of metadata."""
    return spread(table(spark, sf_dir, "part"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata entries of as many images as there are parts, plus all document texts as descriptions."""
    part, k = parts(spark, sf_dir), F.col("p_partkey")
    entry = lambda cond, key, value: F.when(cond, F.struct(F.lit(key).alias("key"), value.alias("value")))
    entries = F.array(
        entry(k % 2 == 0, "Png/parameters", gen_text()),
        entry(k % 3 == 0, "Png/prompt", gen_nodes()),
        entry(k % 5 == 0, "Png/workflow", gen_workflow()),
        entry(k % 7 == 0, "Exif/User Comment", gen_comment()),
        entry(k % 4 == 1, "Exif/Software", F.when(k % 8 == 1, "NovelAI 1.0").otherwise("SomeTool")),
    )
    made = unnest(part, [k.alias("image_id")], entries, "at", "e").filter("e is not null").select("image_id", "e.key", "e.value")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("image_id"), F.lit("Exif/ImageDescription").alias("key"), F.col("text").alias("value")
    )
    return made.unionByName(docs)

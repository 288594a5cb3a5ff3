"""Tensor step queries on embeddings read as small RGBA images."""

from pyspark.sql import functions as F

from tagloom.operators import tensors as T
from tagloom.plans import bindings as B
from tagloom.plans.image_queries import _load_model
from tagloom.plans.registry import query
from tagloom.session import spread, unnest

# pixel i of image e.vec_id; odd labels keep their alpha, even ones are opaque
PIX = """pix AS (
  SELECT image_id, label, i, CAST(CASE WHEN i % 4 = 3 AND label % 2 = 0 THEN 255 ELSE floor((x + 1) * 127.5::DOUBLE) END AS INTEGER) AS v
  FROM (SELECT vec_id AS image_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i FROM embeddings)),
rgb AS (
  SELECT s.image_id, s.label, (s.i // 4) * 3 + s.i % 4 AS i, (s.v * a.v + b.v * (255 - a.v) + 127) // 255 AS v
  FROM pix s JOIN pix a ON a.image_id = s.image_id AND a.i = s.i - s.i % 4 + 3 JOIN (VALUES (0, 255), (1, 128), (2, 0)) b(c, v) ON b.c = s.i % 4)"""
BACKGROUND = [255, 128, 0]


def pix(spark, sf, width: int = 8, height: int = 2):
    """64 values as RGBA, 8 x 2 pixels (or 4 x 4)."""
    value = lambda x, i: F.when((i % 4 == 3) & (F.col("label") % 2 == 0), 255).otherwise(F.floor((x.cast("double") + 1) * 127.5)).cast("int")
    return spread(B.table(spark, sf, "embeddings"), 2000).select(
        F.col("vec_id").alias("image_id"), "label", (F.col("label") % 8 + 1).cast("int").alias("orientation"), F.transform("embedding", value).alias("pixels"),
        F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(4).alias("channels"),
    )


def rows(df, array="pixels"):
    return unnest(df, ["image_id"], array, "i", "v")


def rgb(spark, sf):
    return T.alpha_composite(pix(spark, sf), BACKGROUND)


@query("tensor_exif_transpose", f"WITH {PIX}" + """
SELECT image_id, CAST(CASE WHEN o IN (1, 2, 3, 4) THEN (ty * 8 + tx) * 4 + c ELSE (ty * 2 + tx) * 4 + c END AS INTEGER) AS i, v FROM (
  SELECT image_id, o, c, v, CASE o WHEN 1 THEN x WHEN 2 THEN 7 - x WHEN 3 THEN 7 - x WHEN 4 THEN x WHEN 5 THEN y WHEN 6 THEN 1 - y WHEN 7 THEN 1 - y ELSE y END AS tx,
         CASE o WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN 1 - y WHEN 4 THEN 1 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 7 - x ELSE 7 - x END AS ty
  FROM (SELECT image_id, label % 8 + 1 AS o, i % 4 AS c, (i // 4) % 8 AS x, i // 32 AS y, v FROM pix))""")
def exif_transpose(spark, sf):
    return rows(T.exif_transpose(pix(spark, sf)))


@query("tensor_ensure_color", f"WITH {PIX}" + """
SELECT image_id, i, v FROM pix WHERE label % 2 = 1 UNION ALL SELECT image_id, (i // 4) * 3 + i % 4, v FROM pix WHERE label % 2 = 0 AND i % 4 < 3""")
def ensure_color(spark, sf):
    return rows(T.ensure_color(pix(spark, sf)))


@query("tensor_alpha_composite", f"WITH {PIX} SELECT image_id, i, v FROM rgb")
def alpha_composite(spark, sf):
    return rows(rgb(spark, sf))


@query("tensor_pad_to_square", f"WITH {PIX}" + """
SELECT e.vec_id AS image_id, CAST(p.i AS INTEGER) AS i, coalesce(r.v, [9, 8, 7][p.i % 3 + 1])::INTEGER AS v
FROM embeddings e CROSS JOIN range(192) p(i) LEFT JOIN rgb r ON r.image_id = e.vec_id AND r.i = p.i - 72""")
def pad(spark, sf):
    return rows(T.pad_to_square(rgb(spark, sf), [9, 8, 7]))


TAPS = """k AS (SELECT o, t, {n} / 4.0::DOUBLE AS scale, (o + 0.5::DOUBLE) * ({n} / 4.0::DOUBLE) AS centre, greatest({n} / 4.0::DOUBLE, 1) AS fs FROM range(4) a(o), range({n}) b(t)),
f AS (SELECT o, t, abs((t - centre + 0.5) / fs) AS d, t >= greatest(trunc(centre - 2 * fs + 0.5), 0) AND t < least(trunc(centre + 2 * fs + 0.5), {n}) AS used FROM k),
g AS (SELECT o, t, CASE WHEN NOT used OR d >= 2 THEN 0 WHEN d < 1 THEN (1.5::DOUBLE * d - 2.5::DOUBLE) * d * d + 1 ELSE (((d - 5) * d + 8) * d - 4) * -0.5::DOUBLE END AS w FROM f),
wt AS (SELECT o, t, CAST(trunc(w / sum(w) OVER (PARTITION BY o) * 4194304 + CASE WHEN w < 0 THEN -0.5 ELSE 0.5 END) AS BIGINT) AS w FROM g)"""


@query("tensor_resize", f"WITH {PIX}, {TAPS.format(n=8)}" + """
, src AS (SELECT image_id, i % 8 AS x, i // 8 AS y, v FROM pix),
across AS (SELECT image_id, o AS x, y, least(greatest((sum(v * w) + 2097152) >> 22, 0), 255) AS v FROM src JOIN wt ON t = x GROUP BY image_id, o, y),
down AS (SELECT image_id, x, o AS y, least(greatest((sum(v * w) + 2097152) >> 22, 0), 255) AS v FROM across JOIN wt ON t = y GROUP BY image_id, x, o)
SELECT image_id, CAST((y * 4 + x) * 3 + c.c AS INTEGER) AS i, CAST(v AS INTEGER) AS v FROM down CROSS JOIN range(3) c(c)""")
def resize(spark, sf):
    """The 64 values as an 8 x 8 gray image in three channels, resized to 4 x 4."""
    p = pix(spark, sf).withColumn("pixels", F.flatten(F.transform("pixels", lambda v: F.array(v, v, v))))
    return rows(T.resize(p.withColumn("width", F.lit(8)).withColumn("height", F.lit(8)).withColumn("channels", F.lit(3)), 4, 4))


@query("tensor_crop", f"WITH {PIX}" + """
SELECT image_id, CAST(((i // 3) % 8 - 2) * 3 + i % 3 + (i // 24) * 12 AS INTEGER) AS i, v FROM rgb WHERE (i // 3) % 8 BETWEEN 2 AND 5""")
def crop(spark, sf):
    return rows(T.crop(rgb(spark, sf), 4, 2))


@query("tensor_reorder_channels", f"WITH {PIX} SELECT image_id, CAST(i - i % 3 + (2 - i % 3) AS INTEGER) AS i, v FROM rgb")
def reorder(spark, sf):
    return rows(T.reorder_channels(rgb(spark, sf), [2, 1, 0]))


@query("tensor_cast_divide", f"WITH {PIX} SELECT image_id, CAST(i AS INTEGER) AS i, CAST(v::DOUBLE / 255 AS FLOAT) AS v FROM rgb")
def cast_divide(spark, sf):
    return rows(T.divide(T.cast_float(rgb(spark, sf)), 255.0), "tensor")


@query("tensor_normalize", f"WITH {PIX}" + """
SELECT image_id, CAST(i AS INTEGER) AS i, round(CAST((v::DOUBLE - [10.0, 20.0, 30.0][i % 3 + 1]) / [2.0, 4.0, 8.0][i % 3 + 1] AS DOUBLE), 6) AS v FROM rgb""")
def normalize(spark, sf):
    out = rows(T.normalize(T.cast_float(rgb(spark, sf)), [10.0, 20.0, 30.0], [2.0, 4.0, 8.0]), "tensor")
    return out.withColumn("v", F.round(F.col("v").cast("double"), 6))


@query("tensor_permute", f"WITH {PIX} SELECT image_id, CAST((i % 3) * 16 + i // 3 AS INTEGER) AS i, CAST(v AS FLOAT) AS v FROM rgb")
def permute(spark, sf):
    return rows(T.permute(T.cast_float(rgb(spark, sf)), [2, 0, 1]), "tensor")


STEPS = [
    {"op": "decode", "frame": "first", "colorManagement": "ignore"},
    {"op": "ensure-color", "mode": "rgb-or-rgba-if-transparent"},
    {"op": "alpha-composite", "when": "has-alpha", "background": BACKGROUND},
    {"op": "pad-to-square", "anchor": "floor-center", "background": [9, 8, 7]},
    {"op": "crop", "width": 4, "height": 4, "anchor": "center"},
    {"op": "reorder-channels", "order": [2, 1, 0]},
    {"op": "cast", "dtype": "float32"},
    {"op": "divide", "value": 255},
    {"op": "normalize", "mean": [0.5, 0.5, 0.5], "std": [0.25, 0.5, 0.125]},
    {"op": "permute", "order": [2, 0, 1]},
]


@query("tensor_prepare", f"WITH {PIX}" + """
, sq AS (SELECT e.vec_id AS image_id, p.i, coalesce(r.v, [9, 8, 7][p.i % 3 + 1])::DOUBLE AS v
  FROM embeddings e CROSS JOIN range(192) p(i) LEFT JOIN rgb r ON r.image_id = e.vec_id AND r.i = p.i - 72),
cut AS (SELECT image_id, (i // 3) % 8 - 2 AS x, i // 24 - 2 AS y, 2 - i % 3 AS c, v FROM sq WHERE (i // 3) % 8 BETWEEN 2 AND 5 AND i // 24 BETWEEN 2 AND 5)
SELECT image_id, CAST(c * 16 + y * 4 + x AS INTEGER) AS i, CAST(CAST(CAST(v / 255 AS FLOAT)::DOUBLE - 0.5::DOUBLE AS FLOAT)::DOUBLE / [0.25, 0.5, 0.125][c + 1]::DOUBLE AS FLOAT) AS v FROM cut""")
def prepare(spark, sf):
    """A declared list of ten steps down to a 3 x 4 x 4 tensor."""
    return rows(T.prepare(pix(spark, sf), STEPS, [3, 4, 4]), "tensor")


@query("tensor_prepare_with_resize")
def prepare_with_resize(spark, sf):
    steps = [s for s in STEPS if s["op"] != "crop"]
    steps.insert(4, {"op": "resize", "width": 4, "height": 4, "sampler": "pillow-bicubic-v1"})
    return rows(T.prepare(pix(spark, sf), steps, [3, 4, 4]), "tensor")


WEIGHTS = "((j * 31 + k * 17) % 7 - 3) / 8.0::DOUBLE"


@query("tensor_linear_head", f"""
SELECT image_id, CAST(k AS INTEGER) AS label, round(sum(x * {WEIGHTS}), 6) AS logit
FROM (SELECT vec_id AS image_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings), range(16) r(k) GROUP BY image_id, k""")
def linear_head(spark, sf):
    weights = spark.range(64 * 16).select(
        F.floor(F.col("id") / 16).cast("int").alias("feature"), (F.col("id") % 16).cast("int").alias("label")
    ).withColumn("w", ((F.col("feature") * 31 + F.col("label") * 17) % 7 - 3) / F.lit(8.0))
    tensors = B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("tensor"))
    out = unnest(T.linear_head(tensors, weights), ["image_id"], "logits", "label", "logit")
    return out.withColumn("logit", F.round("logit", 6))


@query("tensor_score", f"""
SELECT image_id, 'succeeded' AS state, CAST(k AS INTEGER) AS label, round(1 / (1 + exp(-sum(x * {WEIGHTS}))), 4) AS p
FROM (SELECT vec_id AS image_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings), range(16) r(k) GROUP BY image_id, k""")
def score(spark, sf):
    """The same head as a model function in Arrow batches."""
    tensors = B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("tensor"))
    s = T.score(tensors, _load_model, 16, "fp1")
    out = unnest(s, ["image_id", "state"], "probabilities", "label", "p")
    return out.withColumn("p", F.round(F.col("p").cast("double"), 4))

"""Column layouts of the tables the operators exchange. Sources never infer a schema."""

from pyspark.sql import types as T

IMAGES = T.StructType([
    T.StructField("image_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("format", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("state", T.StringType()),
    T.StructField("last_error", T.StringType()),
])

# One row per image; position i of the array belongs to tag_index i of the catalog.
PREDICTIONS = T.StructType([
    T.StructField("image_id", T.LongType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("duration_ms", T.DoubleType()),
    T.StructField("runtime", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("batch_size", T.IntegerType()),
    T.StructField("probabilities", T.ArrayType(T.FloatType())),
])

CATALOG = T.StructType([
    T.StructField("tag_index", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("translation", T.StringType()),
    T.StructField("group", T.StringType()),
])

CATALOG_FILE = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("group", T.StringType()),
    T.StructField("translation", T.StringType()),
    T.StructField("count", T.LongType()),
])

SOURCE_TAGS = T.StructType([
    T.StructField("tag_id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("category", T.IntegerType()),
    T.StructField("count", T.LongType()),
])

GROUPS = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("strategy", T.StringType()),
])

META = T.StructType([
    T.StructField("image_id", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
])

_MANIFEST_GROUP = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("displayName", T.StringType()),
    T.StructField("strategy", T.StringType()),
])

MANIFEST = T.StructType([
    T.StructField("schemaVersion", T.IntegerType()),
    T.StructField("id", T.StringType()),
    T.StructField("displayName", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("catalog", T.StringType()),
    T.StructField("defaultThreshold", T.DoubleType()),
    T.StructField("groups", T.ArrayType(_MANIFEST_GROUP)),
    T.StructField("output", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("activation", T.StringType()),
        T.StructField("labelCount", T.IntegerType()),
    ])),
])

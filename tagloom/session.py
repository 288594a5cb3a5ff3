"""Session helpers: builder defaults for tests and benches, shared scratch space, size checks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_session(cpus: int | str = "*", app: str = "tagloom", memory: str = "8g") -> SparkSession:
    """A local session for tests and benches. On a cluster the submit command owns these settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the space every executor can reach.

    Only where the session names none (tests on one machine) a local temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int = 5000) -> DataFrame:
    """``df`` dealt to tasks of about ``rows`` rows, counted first, for a table of narrow rows that grow many times in the next step.

    Files of narrow rows are small, so a read task gets hundreds of thousands of them; the number is given, as Spark would join partitions of few bytes again.
    """
    return df.repartition(max(1, -(-df.count() // rows)))


def literal_rows(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """A handful of literal rows (arguments of an operator) as a local relation of known size."""
    struct = StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in struct.fields]
    arrow = to_arrow_schema(struct)
    return spark.createDataFrame(
        pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), schema=struct
    )


def unnest(df: DataFrame, keep: Sequence[str | Column], array: str | Column, at: str, item: str) -> DataFrame:
    """One row per array element with its 0-based position.

    An inner ``posexplode`` makes Spark filter on the array first, which computes an array built by
    higher-order functions twice. The outer form followed by a filter on its output does not.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(at, item))
    return rows.filter(F.col(at).isNotNull())

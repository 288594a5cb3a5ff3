"""Metadata entries as they come from readers: splitting, key collisions, EXIF bytes, field limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagloom import fixed
from tagloom.functions import left_utf16, limit_text, trim_unicode, utf16_length
from tagloom.operators.ranking import row_numbers
from tagloom.session import unnest


def split_textual_entries(rows: DataFrame) -> DataFrame:
    """``image_id, directory, chunks array<struct<keyword,value>>`` to one row per keyword, keys ``directory/keyword``."""
    items = unnest(rows, ["image_id", "directory"], "chunks", "at", "chunk")
    kept = items.filter((F.coalesce(F.col("chunk.keyword"), F.lit("")) != "") & F.col("chunk.value").isNotNull())
    return kept.select(
        "image_id", "at", F.concat("directory", F.lit("/"), trim_unicode(F.col("chunk.keyword"))).alias("key"), F.col("chunk.value").alias("value")
    )


def normalize_entries(rows: DataFrame, units: int | None = None) -> DataFrame:
    """``image_id, seq, key, value, warning`` with repeated keys numbered ``key #2``, ``key #3`` by reading order ``seq``.

    Numbers whose spelling the image has as a key of its own are passed over, so no two rows share a key: with ``a``, ``a #2``, ``a`` the last becomes
    ``a #3``. Values of more than ``units`` are cut with a warning, where that is given. A key repeated very often in one image is numbered block by block.
    """
    numbered = row_numbers(rows, ["image_id", "key"], "seq")
    # Literal keys that look numbered, with the number they take from their base key: few beside the rows. Of several only the first keeps its spelling.
    base, taken = F.regexp_extract("key", r"(?s)^(.*) #([2-9]|[1-9][0-9]+)$", 1), F.regexp_extract("key", r"(?s)^(.*) #([2-9]|[1-9][0-9]+)$", 2)
    literal = numbered.filter("row_number = 1").select("image_id", base.alias("key"), taken.try_cast("long").alias("taken")).filter("taken is not null")
    # The j-th taken number t is passed by every row that would get t - j or more before it: candidates move past it.
    order = Window.partitionBy("image_id", "key").orderBy("taken")
    gaps = literal.withColumn("from", F.col("taken") - F.row_number().over(order) + 1).groupBy("image_id", "key").agg(F.array_sort(F.collect_list("from")).alias("gaps"))
    n = F.col("row_number")
    moved = n + F.when(n > 1, F.size(F.filter(F.coalesce("gaps", F.array().cast("array<bigint>")), lambda g: g <= n))).otherwise(0)
    value = F.col("value") if units is None else left_utf16(F.col("value"), units)
    warning = F.lit(None).cast("string") if units is None else F.when(
        utf16_length(F.col("value")) > units, F.format_string(fixed.W_FIELD_CUT, F.col("key"), F.lit(limit_text(units)))
    )
    return numbered.join(gaps, ["image_id", "key"], "left").select(
        "image_id", "seq",
        F.when(n > 1, F.concat("key", F.lit(" #"), moved.cast("string"))).otherwise(F.col("key")).alias("key"),
        value.alias("value"), warning.alias("warning"),
    )


def decode_exif_text(raw: Column) -> Column:
    """EXIF bytes as text: an 8-byte charset preamble is dropped, trailing NULs and blanks are trimmed, empty is null."""
    head = F.hex(F.substring(raw, 1, 8))
    named = head.startswith("4153434949") | head.startswith("554E49434F4445") | head.startswith("4A4953")
    body = F.when((F.octet_length(raw) > 8) & named, F.substring(raw, 9, 2**31 - 1)).otherwise(raw)
    text = trim_unicode(F.regexp_replace(F.make_valid_utf8(body.cast("string")), r"(?<!\x00)\x00+$", ""))
    return F.when(text != "", text)


def join_exif_values(values: Column) -> Column:
    """Array values as one text."""
    return F.array_join(values, ", ")

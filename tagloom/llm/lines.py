"""Repeated lines and paragraphs: units are hashed, digests meet globally, the earliest occurrence stays.

A unit's normal form has A-Z in lower case and each run of white space as one space, none at the ends. The first in order of (doc_id, place)
keeps its place, the others are removed; offsets of what is removed refer to the original text. Rows have an identity of their own: rows
with equal or null ids rank by a hash of their text, exact copies by a row number that is written once.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tagloom.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 4


def normal(unit: Column) -> Column:
    return F.btrim(F.regexp_replace(F.translate(unit, UPPER, LOWER), BLANK, " "), F.lit(" "))


def _cut(separator: str):
    @F.pandas_udf("n_units long, n_removed long, removed array<bigint>, kept string, kept_sha256 string")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for text, places in zip(texts, gone):
            drop = set() if places is None else set(places.tolist())
            units, kept, spans, at = text.split(separator), [], [], 0
            for place, unit in enumerate(units):
                if place in drop:
                    spans += [at, at + len(unit)]
                else:
                    kept.append(unit)
                at += len(unit) + len(separator)
            left = separator.join(kept)
            out.append((len(units), len(spans) // 2, spans, left, hashlib.sha256(left.encode()).hexdigest()))
        return pd.DataFrame(out, columns=["n_units", "n_removed", "removed", "kept", "kept_sha256"])

    return cut


def dedup_units(docs: DataFrame, separator: str = "\n", least_words: int = LEAST_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_units, n_removed, removed, kept, kept_sha256.

    ``docs`` needs doc_id and text; other columns are ignored. Units are what ``separator`` parts (a newline: lines; two: paragraphs). Units of fewer than
    ``least_words`` words neither count as repeats nor go; 1 takes every unit but blank ones, which always stay. ``removed`` is a flat array of code point starts and ends in the original text, ``kept`` the
    remaining units joined again. Null text is empty (one empty unit). Null ids rank last. Rows with equal or null ids are rows of their own: each
    loses only its own repeats, and of exact copies one keeps its units. An empty table gives an empty one.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = materialize(plain.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), "rows")
    own = ["doc_id", "tie", "row", "place"]
    pattern = F.lit(separator.replace("\n", "\\n") if separator.strip() == "" else "\\Q" + separator + "\\E")
    units = plain.select("doc_id", F.xxhash64("text").alias("tie"), "row", F.posexplode(F.split("text", pattern, -1)).alias("place", "unit"))
    form = units.select(*own, normal(F.col("unit")).alias("form")).filter((F.col("form") != "") & (F.size(F.split("form", " ")) >= least_words))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), *own)
    hashed = materialize(form.select(F.unhex(F.md5("form")).alias("digest"), *own), "units")
    # A unit of a third of all documents is combined before it is dealt. Written, the repeated digests are a plain side of a join, of
    # which Spark can split the hot partitions.
    first = hashed.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    first = materialize(first, "first")
    gone = hashed.join(first, "digest").filter(rank != F.col("first")).groupBy("row").agg(F.collect_set("place").alias("gone"))
    known = gone.select("row", F.transform("gone", lambda p: p.cast("long")).alias("gone"))
    joined = plain.join(known, "row", "left")
    return joined.select("doc_id", _cut(separator)("text", "gone").alias("d")).select("doc_id", "d.*")


LINES_SQL = r"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS units FROM documents),
lines AS (
  SELECT doc_id, units, CAST(u.place AS BIGINT) AS place, units[u.place + 1] AS unit
  FROM parts, LATERAL (SELECT unnest(range(len(units))) AS place) u),
forms AS (
  SELECT doc_id, place, unit,
         trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS form
  FROM lines),
ranked AS (
  SELECT *, len(string_split(form, ' ')) >= 4 AND row_number() OVER (PARTITION BY form ORDER BY doc_id NULLS LAST, place) > 1 AS gone,
         CAST(coalesce(sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
  FROM forms)
SELECT doc_id, count(*) AS n_units, count(*) FILTER (WHERE gone) AS n_removed,
       coalesce(flatten(list([begins, begins + length(unit)] ORDER BY place) FILTER (WHERE gone)), []) AS removed,
       coalesce(string_agg(unit, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS kept,
       sha256(coalesce(string_agg(unit, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM ranked GROUP BY doc_id
"""

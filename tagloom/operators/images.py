"""Image lists and batches: filters, texts, work lists, write-back, counts, repeated errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tagloom import fixed
from tagloom.functions import file_name_of, is_blank, literal_map
from tagloom.operators.repeats import suppress_repeats  # noqa: F401  one of the error operators

# --- list ------------------------------------------------------------------------------------------------------

_STATUS = {
    "all": None,
    "unrecognized": ["not_run", "stale"],
    "done": ["succeeded"],
    "failed": ["failed", "canceled"],
}


def filter_images(images: DataFrame, status: str = "all", text: str = "") -> DataFrame:
    if status not in _STATUS:
        raise ValueError(f"unknown status filter {status!r}")
    if _STATUS[status] is not None:
        images = images.filter(F.col("state").isin(_STATUS[status]))
    if text.strip():
        images = images.filter(F.upper("file_name").contains(text.strip().upper()))
    return images


def size_label(size: Column) -> Column:
    """Bytes with a binary unit, one decimal at most; midpoints go up."""
    size = F.greatest(size.cast("double"), F.lit(0.0))
    text = F.concat(F.format_string("%.0f", size), F.lit(" " + fixed.SIZE_UNITS[0]))
    for power, unit in enumerate(fixed.SIZE_UNITS[1:], start=1):
        value = F.format_string("%.1f", size / float(1024**power))
        label = F.concat(F.regexp_replace(value, r"\.0$", ""), F.lit(" " + unit))
        text = F.when(size >= float(1024**power), label).otherwise(text)
    return text


def list_rows(images: DataFrame) -> DataFrame:
    """Display texts of the list: dimensions, size, format, state with its visible count."""
    state_text = F.coalesce(F.try_element_at(literal_map(fixed.STATE_TEXTS), F.col("state")), F.lit(fixed.UNKNOWN_STATE_TEXT))
    return images.select(
        "image_id",
        F.concat(F.col("width").cast("string"), F.lit("×"), F.col("height").cast("string")).alias("dimensions"),
        size_label(F.col("file_size")).alias("size_text"),
        F.upper("format").alias("format_text"),
        F.replace(state_text, F.lit("%s"), F.coalesce(F.col("visible"), F.lit(0)).cast("string")).alias("status_text"),
    )


def sanitize_path(pack: Column, path: Column, digest: Column) -> Column:
    """Log-safe name: pack id, file name without folders, first eight digits of the hash."""
    safe_pack = F.when(is_blank(pack), "unknown-pack").otherwise(pack)
    name = F.coalesce(F.nullif(file_name_of(path), F.lit("")), F.lit("unknown-file"))
    short = F.coalesce(F.nullif(F.left(digest, F.lit(8)), F.lit("")), F.lit("unknown"))
    return F.concat(safe_pack, F.lit("/"), name, F.lit("#"), short)


# --- import lists ----------------------------------------------------------------------------------------------


def dedupe_paths(listing: DataFrame) -> DataFrame:
    """First listing of every path. Repeats collapse before the shuffle, so a path listed often is no hot key."""
    others = [c for c in listing.columns if c not in ("path", "seq")]
    first = listing.groupBy("path").agg(F.min(F.struct("seq", *others)).alias("f"))
    return first.select("path", "f.*")


def import_summary(listing: DataFrame, failures: DataFrame) -> DataFrame:
    """Listed, distinct, repeated and failed paths. Distinct paths are counted by grouping, not in one task."""
    paths = listing.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    failed = failures.select(F.col("path")).distinct().withColumn("failed", F.lit(True))
    joined = paths.join(failed, "path", "left")
    return joined.agg(
        F.sum("n").alias("listed"), F.count_if(F.col("failed").isNull()).alias("images"),
        F.count_if("failed").alias("failures"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"),
    )


# --- batch bookkeeping -----------------------------------------------------------------------------------------


def is_done(fingerprint: str) -> Column:
    return (F.col("state") == "succeeded") & F.col("fingerprint").eqNullSafe(F.lit(fingerprint))


def mark_stale(images: DataFrame, fingerprint: str) -> DataFrame:
    """Succeeded under another fingerprint becomes stale; everything else is untouched."""
    old = (F.col("state") == "succeeded") & (F.col("fingerprint") != fingerprint)
    return images.withColumn("state", F.when(old, "stale").otherwise(F.col("state")))


def pending_images(images: DataFrame, predictions: DataFrame, fingerprint: str) -> DataFrame:
    """Everything except images that succeeded with a prediction of this fingerprint.

    The fingerprint filter reaches the prediction scan; only ids of that model are joined.
    """
    done = predictions.filter(F.col("fingerprint") == fingerprint).select("image_id")
    succeeded = images.filter("state = 'succeeded'").select("image_id").join(done, "image_id", "left_semi")
    return images.join(succeeded, "image_id", "left_anti")


def apply_results(images: DataFrame, results: DataFrame) -> DataFrame:
    """Write results back by id and request version; success clears the error, late results do not commit."""
    r = results.select(
        F.col("image_id").alias("r_image_id"), F.col("version").alias("r_version"), F.col("state").alias("r_state"), F.col("error").alias("r_error"),
        F.col("fingerprint").alias("r_fingerprint"),
    )
    same = (images["image_id"] == r["r_image_id"]) & (images["version"] == r["r_version"])
    joined = images.join(r, same, "left")
    won = F.col("r_state") == "succeeded"
    return joined.select(
        *[images[c] for c in images.columns if c not in ("state", "last_error", "fingerprint")],
        F.coalesce("r_state", images["state"]).alias("state"),
        F.when(F.col("r_state").isNull(), images["last_error"]).when(won, None).otherwise(F.col("r_error")).alias("last_error"),
        F.when(won, F.col("r_fingerprint")).otherwise(images["fingerprint"]).alias("fingerprint"),
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """Counts by outcome; a state that is none of the known outcomes counts as failed."""
    state = F.col("outcome")
    return results.agg(
        F.count_if(state == "succeeded").alias("succeeded"),
        F.count_if(~state.isin("succeeded", "skipped", "canceled") | state.isNull()).alias("failed"),
        F.count_if(state == "skipped").alias("skipped"),
        F.count_if(state == "canceled").alias("canceled"),
    )


def job_ok(images: DataFrame, failures: DataFrame) -> DataFrame:
    """True if nothing failed to import and every image succeeded."""
    import_failed = failures.agg((F.count(F.lit(1)) > 0).alias("failed")).scalar()
    return images.agg(
        (F.coalesce(F.every(F.col("state") == "succeeded"), F.lit(True)) & ~import_failed).alias("ok")
    )


def run_batch(images: DataFrame, predictions: DataFrame, score: Callable[[DataFrame], DataFrame], fingerprint: str) -> DataFrame:
    """Every image after the batch, with its ``outcome`` and the ``probabilities`` of those that succeeded.

    Images that succeeded with a prediction of ``fingerprint`` are skipped. ``score`` gets the rows of all others only and gives
    ``image_id, state, error, probabilities`` (see ``tensors.score``); a bad image carries an error instead of failing the job, one without a score
    was canceled. Success stores the fingerprint and clears the error, so a second run over the result skips it. Other states keep the old fingerprint.
    """
    known = predictions.filter(F.col("fingerprint") == fingerprint).select("image_id").distinct().withColumn("known", F.lit(True))
    flagged = images.join(known, "image_id", "left").withColumn("skip", (F.col("state") == "succeeded") & F.col("known").isNotNull()).drop("known")
    skip = F.coalesce("skip", F.lit(False))
    scored = score(flagged.filter(~skip).drop("skip")).select(
        "image_id", F.col("state").alias("batch_state"), F.col("error").alias("batch_error"), "probabilities"
    )
    outcome = F.when(skip, "skipped").otherwise(F.coalesce("batch_state", F.lit("canceled")))
    done = flagged.join(scored, "image_id", "left").withColumn("outcome", outcome)
    won = F.col("outcome") == "succeeded"
    return done.select(
        *[c for c in images.columns if c not in ("state", "last_error", "fingerprint", "probabilities")],
        F.when(skip, F.col("state")).otherwise(F.col("outcome")).alias("state"),
        F.when(won, F.lit(fingerprint)).otherwise(F.col("fingerprint")).alias("fingerprint"),
        F.when(F.col("outcome") == "failed", F.col("batch_error")).when(skip, F.col("last_error")).alias("last_error"),
        "outcome", F.when(won, F.col("probabilities")).alias("probabilities"),
    )


def carry_overrides(overrides: DataFrame, old_catalog: DataFrame, new_catalog: DataFrame) -> DataFrame:
    """Exclusions follow the label name to its index in another catalog; unmatched ones are dropped."""
    moved = old_catalog.select("tag_index", "name").join(new_catalog.select("name", F.col("tag_index").alias("new_index")), "name")
    return overrides.join(moved.select("tag_index", "new_index"), "tag_index").select("image_id", F.col("new_index").alias("tag_index")).distinct()


# --- errors ----------------------------------------------------------------------------------------------------


def error_summary(errors: DataFrame) -> DataFrame:
    """One text per job: codes by count (ties: first seen). Rows shrink to one per job and code first."""
    codes = errors.groupBy("job", "code").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    text = F.coalesce(F.try_element_at(literal_map(fixed.ERROR_TEXTS), F.col("code")), F.lit(fixed.UNKNOWN_ERROR_TEXT))
    part = F.format_string(fixed.ERRORS_PART, text, F.col("n").cast("string"))
    jobs = codes.groupBy("job").agg(
        F.sum("n").alias("total"),
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("a"), F.col("first").alias("b"), text.alias("text"), part.alias("part")))).alias("codes"),
    )
    total = F.col("total").cast("string")
    first = F.get("codes", F.lit(0))["text"]
    many = F.format_string(fixed.ERRORS_MANY_CODES, total, F.array_join(F.transform("codes", lambda c: c["part"]), "、"))
    return jobs.select(
        "job", "total",
        F.when(F.col("total") == 1, first).when(F.size("codes") == 1, F.format_string(fixed.ERRORS_ONE_CODE, first, total)).otherwise(many).alias("summary"),
    )


# --- repeated messages -----------------------------------------------------------------------------------------

def merged_message(message: Column, merged: Column) -> Column:
    return F.when(merged > 0, F.format_string(fixed.MERGED_REPEATS, message, merged.cast("string"))).otherwise(message)


def latest_results(results: DataFrame) -> DataFrame:
    """The result of the newest request version per image; older ones lose however late they arrive."""
    return results.groupBy("image_id").agg(F.max("version").alias("version"), F.max_by("result", "version").alias("result"))

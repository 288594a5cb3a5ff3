"""Images to tensors to scores.

Pixels are flat HWC integer arrays beside ``width, height, channels``; tensors are flat float arrays
beside ``d0, d1, d2``. Spark reads and partitions the images, a step is a short array operation on
one image inside an Arrow batch, and a list of steps runs in one pass.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tagloom.functions import activate
from tagloom.functions.containers import exif_orientation


def decode_images(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Spark's image reader with pixels unpacked to RGBA, and the EXIF ``orientation`` (1 without one); unreadable files have null pixels."""
    rows = spark.read.format("image").option("dropInvalid", "false").load(paths)
    rows = rows.select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")
    pixels = rows.mapInPandas(_unpack_batches, "path string, width int, height int, channels int, pixels array<int>")
    place = lambda path: F.regexp_replace(F.url_decode(path), "^file:/+", "/")  # noqa: E731  the two readers spell local paths differently
    turns = spark.read.format("binaryFile").load(paths).select(place(F.col("path")).alias("place"), exif_orientation("content").alias("orientation"))
    joined = pixels.withColumn("place", place(F.col("path"))).join(turns, "place", "left").drop("place")
    return joined.withColumn("orientation", F.coalesce("orientation", F.lit(1)))


def _unpack(raw: bytes | None, channels: int) -> np.ndarray | None:
    """Bytes in gray, BGR or BGRA order to RGBA integers."""
    if raw is None or not len(raw):
        return None
    flat = np.frombuffer(raw, np.uint8).reshape(-1, channels)
    colour = np.repeat(flat, 3, axis=1) if channels == 1 else flat[:, 2::-1]
    alpha = flat[:, 3:4] if channels == 4 else np.full((len(flat), 1), 255, np.uint8)
    return np.concatenate([colour, alpha], axis=1).ravel().astype(np.int32)


def _unpack_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        pixels = [_unpack(d, c) for d, c in zip(batch.pop("data"), batch["channels"])]
        yield batch.assign(pixels=pd.Series(pixels, dtype=object, index=batch.index), channels=4)


# --- resize ----------------------------------------------------------------------------------------------------

# Filter parameter, filter reach, and bits of the integer weights.
BICUBIC_A = -0.5
BICUBIC_REACH = 2.0
WEIGHT_BITS = 22


@lru_cache(maxsize=256)
def bicubic_weights(size_in: int, size_out: int) -> np.ndarray:
    """Integer weights (out x in) of the antialiased cubic filter, scaled by 2**22 and rounded half away from zero."""
    scale = size_in / size_out
    stretch = max(scale, 1.0)
    centres = (np.arange(size_out) + 0.5) * scale
    low = np.maximum((centres - BICUBIC_REACH * stretch + 0.5).astype(np.int64), 0)
    high = np.minimum((centres + BICUBIC_REACH * stretch + 0.5).astype(np.int64), size_in)
    taps = np.arange(size_in)
    d = np.abs((taps[None, :] - centres[:, None] + 0.5) * (1.0 / stretch))
    near = ((BICUBIC_A + 2) * d - (BICUBIC_A + 3)) * d * d + 1
    far = (((d - 5) * d + 8) * d - 4) * BICUBIC_A
    w = np.where(d < 1, near, np.where(d < 2, far, 0.0))
    w[(taps[None, :] < low[:, None]) | (taps[None, :] >= high[:, None])] = 0.0
    w = w / np.cumsum(w, axis=1)[:, -1:]
    return np.trunc(w * (1 << WEIGHT_BITS) + np.where(w < 0, -0.5, 0.5)).astype(np.float64)


def _pass(image: np.ndarray, size_out: int) -> np.ndarray:
    """Resample the first axis; products stay far below 2**53, so floats are exact here."""
    w = bicubic_weights(image.shape[0], size_out)
    total = (w @ image.reshape(image.shape[0], -1)).astype(np.int64) + (1 << (WEIGHT_BITS - 1))
    return np.clip(total >> WEIGHT_BITS, 0, 255).reshape(size_out, *image.shape[1:]).astype(np.float64)


# --- steps -----------------------------------------------------------------------------------------------------


def _turn(image: np.ndarray, orientation: int) -> np.ndarray:
    """Mirror and rotate by the EXIF orientation; 5..8 swap the sides."""
    if orientation in (5, 6, 7, 8):
        image = image.transpose(1, 0, 2)
    if orientation in (2, 3, 6, 7):
        image = image[:, ::-1]
    if orientation in (3, 4, 7, 8):
        image = image[::-1]
    return image


def _colour(image: np.ndarray, mode: str) -> np.ndarray:
    opaque = image.shape[2] == 4 and (mode == "rgb" or (image[..., 3] == 255).all())
    return image[..., :3] if opaque else image


def _composite(image: np.ndarray, background: Sequence[int]) -> np.ndarray:
    if image.shape[2] != 4:
        return image
    alpha = image[..., 3:]
    return (image[..., :3] * alpha + np.asarray(background, np.int32) * (255 - alpha) + 127) // 255


def _pad(image: np.ndarray, background: Sequence[int]) -> np.ndarray:
    h, w, _ = image.shape
    side = max(h, w)
    square = np.empty((side, side, 3), np.int32)
    square[:] = background
    top, left = (side - h) // 2, (side - w) // 2
    square[top : top + h, left : left + w] = image
    return square


def _resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Horizontal pass first; every pass is rounded and clipped to 0..255."""
    across = _pass(image.transpose(1, 0, 2).astype(np.float64), width).transpose(1, 0, 2)
    return _pass(np.ascontiguousarray(across), height).astype(np.int32)


def _crop(image: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w, _ = image.shape
    if width > w or height > h:
        raise ValueError("crop exceeds the image")
    top, left = (h - height) // 2, (w - width) // 2
    return image[top : top + height, left : left + width]


def _normalize(tensor: np.ndarray, mean: Sequence[float], std: Sequence[float]) -> np.ndarray:
    """By the position modulo 3, whatever the axis order is."""
    triples = tensor.reshape(-1, 3)
    return ((triples - np.asarray(mean, np.float32)) / np.asarray(std, np.float32)).reshape(tensor.shape)


def _apply(array: np.ndarray, step: Mapping, orientation: int) -> np.ndarray:
    """One declared step on one H x W x C image or one float tensor."""
    op = step["op"]
    if op == "exif-transpose":
        return _turn(array, orientation)
    if op == "ensure-color":
        return _colour(array, step["mode"])
    if op == "alpha-composite":
        return _composite(array, step["background"])
    if op == "pad-to-square":
        return _pad(array, step["background"])
    if op == "resize":
        return _resize(array, step["width"], step["height"])
    if op == "crop":
        return _crop(array, step["width"], step["height"])
    if op == "reorder-channels":
        return array[..., list(step["order"])]
    if op == "cast":
        return array.astype(np.float32)
    if op == "divide":
        return array / np.float32(step["value"])
    if op == "normalize":
        return _normalize(array, step["mean"], step["std"])
    if op == "permute":
        return array.transpose(step["order"])
    raise ValueError(f"unknown step {op!r}")


_PIXEL_COLUMNS = ["pixels", "width", "height", "channels"]
_TENSOR_COLUMNS = ["tensor", "d0", "d1", "d2"]


def apply_steps(df: DataFrame, steps: Sequence[Mapping], isolate: bool = False) -> DataFrame:
    """Run steps over a table of pixels (or of tensors) in one pass over Arrow batches.

    Pixel arrays have hundreds of thousands of values. Written with Spark's array functions, which
    are interpreted value by value, the usual list of steps took more than five seconds of a core per
    600 x 400 image; as array operations over Arrow batches it takes a small part of that. With
    ``isolate`` an image that fails gets a null result and its message in ``error``.
    """
    takes = _PIXEL_COLUMNS if "pixels" in df.columns else _TENSOR_COLUMNS
    gives = _TENSOR_COLUMNS if takes is _TENSOR_COLUMNS or any(s["op"] == "cast" for s in steps) else _PIXEL_COLUMNS
    others = [c for c in df.columns if c not in takes]
    turn = any(s["op"] == "exif-transpose" for s in steps)
    if turn and "orientation" not in df.columns:
        raise ValueError("exif-transpose needs an orientation column")
    name, *dims = gives
    kind = T.ArrayType(T.IntegerType() if gives is _PIXEL_COLUMNS else T.FloatType())
    schema = T.StructType([df.schema[c] for c in others])
    for column in [name, *dims]:
        schema = schema.add(column, kind if column == name else T.IntegerType())
    if isolate:
        schema = schema.add("error", T.StringType())

    def one(flat, dims_in, orientation):
        if flat is None:
            return None, (None, None, None)
        shape = (dims_in[1], dims_in[0], dims_in[2]) if takes is _PIXEL_COLUMNS else dims_in
        array = np.asarray(flat, np.int32 if takes is _PIXEL_COLUMNS else np.float32).reshape([int(x) for x in shape])
        for step in steps:
            array = _apply(array, step, orientation)
        h, w, c = array.shape
        return np.ascontiguousarray(array).ravel(), ((w, h, c) if gives is _PIXEL_COLUMNS else (h, w, c))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flats, shapes, errors = [], [], []
            turns = batch["orientation"] if turn else [1] * len(batch)
            for flat, a, b, c, o in zip(*[batch[x] for x in takes], turns):
                error = None
                try:
                    out, shape = one(flat, (a, b, c), o)
                except Exception as problem:
                    if not isolate:
                        raise
                    out, shape, error = None, (None, None, None), str(problem)
                flats.append(out)
                shapes.append(shape)
                errors.append(error)
            result = batch[others].assign(**{name: pd.Series(flats, dtype=object, index=batch.index)})
            for at, dim in enumerate(dims):
                result[dim] = pd.array([s[at] for s in shapes], dtype="Int32")
            if isolate:
                result["error"] = errors
            yield result

    return df.select(*others, *takes).mapInPandas(run, schema)


def exif_transpose(df: DataFrame) -> DataFrame:
    return apply_steps(df, [{"op": "exif-transpose"}])


def ensure_color(df: DataFrame, mode: str = "rgb-or-rgba-if-transparent") -> DataFrame:
    """RGB, or RGBA kept if any alpha is below 255 (mode "rgb" always drops alpha)."""
    return apply_steps(df, [{"op": "ensure-color", "mode": mode}])


def alpha_composite(df: DataFrame, background: Sequence[int]) -> DataFrame:
    """Over a background in exact integers; images without alpha pass through."""
    return apply_steps(df, [{"op": "alpha-composite", "background": background}])


def pad_to_square(df: DataFrame, background: Sequence[int]) -> DataFrame:
    return apply_steps(df, [{"op": "pad-to-square", "background": background}])


def resize(df: DataFrame, width: int, height: int) -> DataFrame:
    return apply_steps(df, [{"op": "resize", "width": width, "height": height}])


def crop(df: DataFrame, width: int, height: int) -> DataFrame:
    """Centred; an image smaller than the crop is an error."""
    return apply_steps(df, [{"op": "crop", "width": width, "height": height}])


def reorder_channels(df: DataFrame, order: Sequence[int]) -> DataFrame:
    return apply_steps(df, [{"op": "reorder-channels", "order": order}])


def cast_float(df: DataFrame) -> DataFrame:
    """Pixels become ``tensor``, float32 in HWC order with shape columns ``d0, d1, d2``."""
    return apply_steps(df, [{"op": "cast"}])


def divide(df: DataFrame, value: float) -> DataFrame:
    return apply_steps(df, [{"op": "divide", "value": value}])


def normalize(df: DataFrame, mean: Sequence[float], std: Sequence[float]) -> DataFrame:
    return apply_steps(df, [{"op": "normalize", "mean": mean, "std": std}])


def permute(df: DataFrame, order: Sequence[int]) -> DataFrame:
    """New axis k is old axis ``order[k]``."""
    return apply_steps(df, [{"op": "permute", "order": order}])


# --- declared steps --------------------------------------------------------------------------------------------

# op -> (parameter names, kind taken, kind given)
STEPS = {
    "decode": (("frame", "colorManagement"), "encoded", "image"),
    "exif-transpose": ((), "image", "image"),
    "ensure-color": (("mode",), "image", "image"),
    "alpha-composite": (("when", "background"), "image", "rgb"),
    "pad-to-square": (("anchor", "background"), "rgb", "rgb"),
    "resize": (("width", "height", "sampler"), "rgb", "rgb"),
    "crop": (("width", "height", "anchor"), "rgb", "rgb"),
    "reorder-channels": (("order",), "rgb", "rgb"),
    "cast": (("dtype",), "rgb", "tensor"),
    "divide": (("value",), "tensor", "tensor"),
    "normalize": (("mean", "std"), "tensor", "tensor"),
    "permute": (("order",), "tensor", "tensor"),
}
_WORDS = {
    ("decode", "frame"): ("first",), ("decode", "colorManagement"): ("ignore",),
    ("ensure-color", "mode"): ("rgb-or-rgba-if-transparent", "rgb"), ("alpha-composite", "when"): ("has-alpha",),
    ("pad-to-square", "anchor"): ("floor-center",), ("resize", "sampler"): ("pillow-bicubic-v1",),
    ("crop", "anchor"): ("center",), ("cast", "dtype"): ("float32",),
}


def _check_value(op: str, name: str, value) -> None:
    bad = ValueError(f"{op}: bad value for {name}: {value!r}")
    if (op, name) in _WORDS:
        if value not in _WORDS[op, name]:
            raise bad
    elif name == "background":
        if len(value) != 3 or not all(isinstance(v, int) and 0 <= v <= 255 for v in value):
            raise bad
    elif name in ("width", "height"):
        if not isinstance(value, int) or value < 1:
            raise bad
    elif name == "order":
        if sorted(value) != [0, 1, 2]:
            raise bad
    elif name == "value":
        if not math.isfinite(value) or value <= 0:
            raise bad
    elif name in ("mean", "std"):
        if len(value) != 3 or not all(math.isfinite(v) for v in value) or (name == "std" and min(value) <= 0):
            raise bad


def check_steps(steps: Sequence[Mapping], shape: Sequence[int] | None = None) -> None:
    """1..32 known steps, ``decode`` first and only there, closed parameters, kinds and shapes that fit."""
    if not 1 <= len(steps) <= 32:
        raise ValueError("a preparation has 1 to 32 steps")
    kind, size, axes = "encoded", (0, 0), [0, 1, 2]
    for at, step in enumerate(steps):
        op = step.get("op")
        if op not in STEPS:
            raise ValueError(f"unknown step {op!r}")
        if step.get("version", 1) != 1:
            raise ValueError(f"{op}: only version 1 is known")
        if (op == "decode") != (at == 0):
            raise ValueError("decode must be the first step and occur once")
        params = {k: v for k, v in step.items() if k not in ("op", "version")}
        names, takes, gives = STEPS[op]
        if set(params) != set(names):
            raise ValueError(f"{op}: parameters must be {list(names)}")
        for name, value in params.items():
            _check_value(op, name, value)
        if takes != kind:
            raise ValueError(f"{op} takes {takes} but gets {kind}")
        kind = "rgb" if op == "ensure-color" and params["mode"] == "rgb" else gives
        if op == "pad-to-square":
            size = (max(size), max(size))
        elif op == "resize":
            size = (params["width"], params["height"])
        elif op == "crop":
            if any(have and want > have for want, have in zip((params["width"], params["height"]), size)):
                raise ValueError("crop exceeds the image")
            size = (params["width"], params["height"])
        elif op == "permute":
            axes = [axes[o] for o in params["order"]]
    if kind != "tensor":
        raise ValueError("the last step must give a tensor")
    if not all(size):
        raise ValueError("the final shape is not known")
    final = [[size[1], size[0], 3][a] for a in axes]
    if shape is not None and list(shape) != final:
        raise ValueError(f"steps give {final}, the model takes {list(shape)}")


def prepare(images: DataFrame, steps: Sequence[Mapping], shape: Sequence[int] | None = None) -> DataFrame:
    """Apply declared steps to decoded images (``pixels, width, height, channels[, orientation]``).

    Decoding is the reader's part; the step is checked and then stands for the input. All steps run
    in one pass; an image that cannot be prepared keeps its row, with a null tensor and an ``error``.
    """
    check_steps(steps, shape)
    return apply_steps(images, steps[1:], isolate=True)


# --- scoring ---------------------------------------------------------------------------------------------------


def score(
    tensors: DataFrame, load_model: Callable[[], Callable[[np.ndarray], np.ndarray]], label_count: int, fingerprint: str,
    activation: str = "sigmoid", runtime: str = "python", provider: str = "cpu",
) -> DataFrame:
    """Run a model over ``image_id, tensor``. The model is loaded once per task and gets Arrow batches.

    A batch that fails is run image by image, so a bad image gets ``state = failed`` and its error
    while the others succeed. Rows that bring an ``error`` of their preparation keep it and do not reach the model. ``duration_ms`` is the
    model's time of an image's batch, shared evenly. Probabilities come from the activation in Spark.
    """
    kind = tensors.schema["image_id"].dataType.simpleString()
    schema = f"image_id {kind}, state string, error string, batch_size int, duration_ms double, logits array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()

        def infer(tensors) -> tuple[np.ndarray, float]:
            started = time.perf_counter()
            out = np.asarray(model(np.stack([np.asarray(t, np.float32) for t in tensors])), np.float32)
            if out.shape != (len(tensors), label_count):
                raise ValueError(f"model gave {out.shape[1:]} scores, the catalog has {label_count}")
            return out, (time.perf_counter() - started) * 1000 / len(tensors)

        for batch in batches:
            before = batch["error"].notna()
            rows = [(i, "failed", e, 0, None, None) for i, e in zip(batch["image_id"][before], batch["error"][before])]
            ready = batch[~before]
            try:
                scores, each = infer(list(ready["tensor"])) if len(ready) else ([], 0.0)
                rows += [(image_id, "succeeded", None, len(ready), each, logits) for image_id, logits in zip(ready["image_id"], scores)]
            except Exception:
                for image_id, tensor in zip(ready["image_id"], ready["tensor"]):
                    try:
                        scores, each = infer([tensor])
                        rows.append((image_id, "succeeded", None, 1, each, scores[0]))
                    except Exception as error:
                        rows.append((image_id, "failed", str(error), 1, None, None))
            yield pd.DataFrame(rows, columns=["image_id", "state", "error", "batch_size", "duration_ms", "logits"])

    error = F.col("error").cast("string") if "error" in tensors.columns else F.lit(None).cast("string")
    scored = tensors.select("image_id", "tensor", error.alias("error")).mapInPandas(run, schema)
    return scored.select(
        "image_id", "state", "error", F.lit(fingerprint).alias("fingerprint"), F.lit(runtime).alias("runtime"),
        F.lit(provider).alias("provider"), "batch_size", F.current_timestamp().alias("created_at"), "duration_ms",
        F.transform("logits", lambda x: activate(x, activation)).alias("probabilities"),
    )


def linear_head(tensors: DataFrame, weights: DataFrame) -> DataFrame:
    """``image_id, logits array<double>`` of a linear head ``weights(feature, label, w)``, labels in ascending order.

    The head is one array of weights per label, as large as the model whatever the number of images; the products stay inside the row.
    """
    ordered = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    per_label = weights.groupBy("label").agg(ordered("feature", "w").alias("of_label"))
    head = per_label.agg(ordered("label", "of_label").alias("head")).scalar()
    product = lambda w: F.aggregate(F.zip_with("tensor", w, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, b: a + b)
    return tensors.withColumn("head", head).select("image_id", F.transform("head", product).alias("logits"))

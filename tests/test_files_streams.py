"""Files written by the test itself, and streams against their batch twins."""

import hashlib
import json
import os
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom import streaming as R
from tagloom.functions import containers
from tagloom.operators import images as I, repeats, tensors as T
from tagloom.operators.catalog import check_manifest
from tagloom.session import shared_dir
from tagloom.sources import images as files, packs, sinks


def png(width, height, pixel=(10, 20, 30, 255)):
    raw = b"".join(b"\x00" + bytes(pixel) * width for _ in range(height))
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def bmp(width, height):
    row = (width * 3 + 3) // 4 * 4
    body = b"\x01" * (row * height)
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0) + body


GIF = b"GIF89a" + struct.pack("<HH", 7, 5) + b"\x80\x00\x00\x00\x00\x00\xff\xff\xff!\xf9\x04\x00\x00\x00\x00\x00,\x00\x00\x00\x00\x07\x00\x05\x00\x00\x02\x05\x84\x8f\xa9\xcb]\x00;"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pictures")
    (root / "sub").mkdir()
    (root / "a.png").write_bytes(png(7, 5))
    (root / "B.PNG").write_bytes(png(4, 2))
    (root / "c.jpg").write_bytes(png(3, 3))  # content decides, not the extension
    (root / "d.bmp").write_bytes(bmp(7, 5))
    (root / "e.gif").write_bytes(GIF)
    (root / "broken.png").write_bytes(b"not an image")
    (root / "cut.png").write_bytes(png(7, 5)[:30])
    (root / "note.txt").write_text("hello")
    (root / "sub" / "f.png").write_bytes(png(2, 2, (0, 0, 0, 0)))
    return root


def test_scan_and_sniff(spark, folder):
    found = files.sniff_header(files.scan_images(spark, str(folder)))
    out = {r["file_name"]: (r["format"], r["width"], r["height"]) for r in found.collect()}
    assert out["a.png"] == ("png", 7, 5) and out["B.PNG"] == ("png", 4, 2) and out["c.jpg"] == ("png", 3, 3)
    assert out["d.bmp"] == ("bmp", 7, 5) and out["e.gif"] == ("gif", 7, 5) and out["broken.png"] == (None, None, None)
    assert "note.txt" not in out and "f.png" not in out
    assert files.scan_images(spark, str(folder), recursive=True).count() == len(out) + 1


def test_failure_kinds(spark, folder):
    found = files.sniff_header(files.scan_images(spark, str(folder))).select("path", "format", "width")
    note = f"file:{folder}/note.txt"
    found = found.unionByName(spark.createDataFrame([(note, None, None)], found.schema))
    decoded = T.decode_images(spark, f"{folder}/*.png").select("path", F.when(F.col("width") > 0, F.col("width")).alias("real"))
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    found = found.withColumn("n", name(F.col("path"))).join(decoded.select(name(F.col("path")).alias("n"), "real"), "n", "left")
    found = found.withColumn("width", F.when(F.lower("n").endswith(".png"), F.col("real")).otherwise(F.col("width")))
    asked = [f"file:{folder}/{n}" for n in ("a.png", "broken.png", "cut.png", "note.txt", "gone.png")] + ["  "]
    failed = files.import_failure_kind(spark.createDataFrame([(a,) for a in asked], "path string"), found)
    out = {r["path"].split("/")[-1]: r["kind"] for r in failed.collect()}
    assert out == {"broken.png": "unsupported_format", "cut.png": "corrupt_image", "note.txt": "unsupported_format", "gone.png": "not_found", "  ": "not_found"}


def test_catalog_files_follow_the_ids(spark, tmp_path):
    rows = [(n * 7919 % 1000, f"tag, {n}", "general", "" if n % 2 else 'a "b"', n) for n in range(1000)]
    df = spark.createDataFrame(rows, "id int, name string, group string, translation string, count long")
    sinks.write_catalog_files(df, str(tmp_path / "many"), files=4)
    written = sorted((tmp_path / "many").glob("part-*.csv"))
    ids = []
    for file in written:
        head, *lines = file.read_text().splitlines()
        assert head == "id,name,group,translation,count"
        ids.append([int(line.split(",")[0]) for line in lines])
    assert len([i for i in ids if i]) > 1 and sum(ids, []) == list(range(1000))
    assert sorted(map(tuple, packs.read_catalog_file(spark, str(tmp_path / "many")).collect())) == sorted(rows)
    sinks.write_catalog_files(df.limit(0), str(tmp_path / "none"))
    assert packs.read_catalog_file(spark, str(tmp_path / "none")).count() == 0


def test_pack_is_checked_across_its_files(spark, tmp_path):
    catalog = spark.createDataFrame([(0, "a", "rating", "A", 1), (1, "b", "general", "b", 1)], "id int, name string, group string, translation string, count long")
    sinks.write_catalog(catalog, str(tmp_path / "tags"))
    group = lambda i, strategy: {"id": i, "name": i, "displayName": i, "strategy": strategy}

    def manifest(name, groups, n):
        body = {"schemaVersion": 1, "id": "p", "task": "multi-label-image-tagging", "defaultThreshold": 0.5, "groups": groups, "output": {"activation": "sigmoid", "labelCount": n}}
        (tmp_path / name).write_text(json.dumps(body, indent=2))
        return str(tmp_path / name)

    good = manifest("good.json", [group("rating", "rating"), group("general", None)], 2)
    found, groups = packs.read_pack(spark, str(tmp_path / "tags"), good)
    assert sorted((r["tag_index"], r["translation"]) for r in found.collect()) == [(0, "A"), (1, None)]
    assert [(r["pos"], r["id"], r["strategy"]) for r in groups.orderBy("pos").collect()] == [(0, "rating", "rating"), (1, "general", "threshold")]
    bad = manifest("bad.json", [group("rating", None)], 3)
    problems = {tuple(r) for r in packs.pack_problems(spark, str(tmp_path / "tags"), bad).collect()}
    assert problems == {("catalog", "label_count", "3", "2"), ("catalog", "unknown_group", "general", "1")}
    with pytest.raises(ValueError, match="label_count .* unknown_group"):
        packs.read_pack(spark, str(tmp_path / "tags"), bad)


def be(n, size):
    return n.to_bytes(size, "big")


def le(n, size):
    return n.to_bytes(size, "little")


def riff(*chunks):
    body = b"".join(name + le(len(data), 4) + data + b"\x00" * (len(data) % 2) for name, data in chunks)
    return b"RIFF" + le(len(body) + 4, 4) + b"WEBP" + body


def test_sizes_from_headers():
    frame = lambda marker: b"\xff" + bytes([marker]) + be(17, 2) + b"\x08" + be(480, 2) + be(640, 2) + b"\x03" + bytes(9)
    segment = lambda marker, data: b"\xff" + bytes([marker]) + be(len(data) + 2, 2) + data
    far = b"".join(segment(0xE2, b"\xff\xc0" * 30_000) for _ in range(3))  # looks like frames, but lies inside other segments
    assert containers.size_of(b"\xff\xd8" + far + segment(0xC4, bytes(9)) + b"\xff" + frame(0xC2) + b"\xff\xda") == (640, 480)
    assert containers.size_of(b"\xff\xd8" + far + b"\xff\xda" + frame(0xC0)) is None and containers.size_of(b"\xff\xd8\xff\xc0\x00\x11\x08") is None
    assert containers.size_of(b"\xff\xd8" + segment(0xE0, b"")[:3]) is None and containers.size_of(b"\xff\xd8\xff\xe1\x00\x00" + frame(0xC0)) is None
    for order, number, mark in (("little", le, b"II*\x00"), ("big", be, b"MM\x00*")):
        short = lambda tag, v: number(tag, 2) + number(3, 2) + number(1, 4) + number(v, 2) + bytes(2)
        whole = lambda tag, v: number(tag, 2) + number(4, 2) + number(1, 4) + number(v, 4)
        tiff = mark + number(200_000, 4) + bytes(200_000 - 8) + number(2, 2) + short(0x0100, 70) + whole(0x0101, 90_000)
        assert containers.size_of(tiff) == (70, 90_000) and containers.size_of(tiff[:200_010]) is None
    odd = (b"ICCP", bytes(150_001))
    assert containers.size_of(riff((b"VP8X", bytes(4) + le(6, 3) + le(4, 3)), odd)) == (7, 5)
    assert containers.size_of(riff(odd, (b"VP8L", b"\x2f" + le(6 | 4 << 14, 4)))) == (7, 5)
    assert containers.size_of(riff((b"VP8 ", bytes(3) + b"\x9d\x01\x2a" + le(7 | 1 << 14, 2) + le(5, 2)))) == (7, 5)
    assert containers.size_of(riff((b"VP8 ", bytes(10)))) is None and containers.size_of(None) is None and containers.size_of(b"") is None


def test_orientation_is_found_wherever_it_lies():
    tiff = b"II*\x00" + le(8, 4) + le(1, 2) + le(0x0112, 2) + le(3, 2) + le(1, 4) + le(6, 2) + bytes(2)
    chunk = lambda name, data: be(len(data), 4) + name + data + bytes(4)
    decoy = chunk(b"tEXt", b"eXIf" + tiff.replace(le(6, 2) + bytes(2), le(3, 2) + bytes(2)))
    head = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13))
    assert containers.orientation_of(head + chunk(b"iTXt", bytes(200_000)) + decoy + chunk(b"eXIf", tiff) + chunk(b"IEND", b"")) == 6
    assert containers.orientation_of(head + decoy + chunk(b"IEND", b"")) == 1
    assert containers.orientation_of(riff((b"ICCP", bytes(140_001)), (b"EXIF", tiff))) == 6 == containers.orientation_of(riff((b"EXIF", b"Exif\x00\x00" + tiff)))


def test_files_are_read_one_by_one(spark, tmp_path):
    rows = [(f"{tmp_path}/in a/x%20y.png", b"one"), (f"{tmp_path}/in a/deep/z.png", b"")]
    files.write_each(spark.createDataFrame(rows, "path string, content binary"))
    files.write_each(spark.createDataFrame(rows, "path string, content binary"))
    asked = [rows[0][0], "file:" + rows[0][0], rows[1][0], rows[1][0], f"{tmp_path}/in a", f"{tmp_path}/gone", "nowhere://x/y", " ", None]
    got = files.read_each(spark.createDataFrame([(a, 1) for a in asked], "path string, failure int"))
    assert [(r["length"], r["failure"]) for r in got.collect()] == [(3, None), (3, None), (0, None), (0, None), (None, "io"), (None, "missing"), (None, "io"), (None, "missing"), (None, "missing")]
    assert files.read_each(spark.createDataFrame([], "path string")).count() == 0

    def locked(path):
        raise PermissionError(path)

    denied = files.read_each(spark.createDataFrame([("a.png",), ("b.txt",)], "path string"), locked)
    kinds = files.import_failure_kind(spark.createDataFrame([("a.png",), ("a.png",), ("b.txt",)], "path string"), files.sniff_header(denied))
    assert sorted((r["path"], r["kind"]) for r in kinds.collect()) == [("a.png", "access_denied")] * 2 + [("b.txt", "unsupported_format")]


def test_later_files_win_whatever_their_size(spark, tmp_path):
    line = lambda n, text: json.dumps({"id": n, "tag": f"t{n}", "translation": text}) + "\n"
    for at, name in enumerate("abc"):  # Spark reads the largest file first
        (tmp_path / f"{name}.jsonl").write_text("\n" + "".join(line(n, f"{name}{n}") for n in range(4000 >> 3 * at)) + line(1, f"{name} again"))
    got = {r["id"]: r["translation"] for r in packs.read_translations(spark, str(tmp_path)).collect()}
    assert got == {n: f"c{n}" if n < 62 else f"b{n}" if n < 500 else f"a{n}" for n in range(4000)} | {1: "c again"}


def test_decode_and_prepare(spark, folder):
    steps = [
        {"op": "decode", "frame": "first", "colorManagement": "ignore"}, {"op": "ensure-color", "mode": "rgb-or-rgba-if-transparent"},
        {"op": "alpha-composite", "when": "has-alpha", "background": [255, 255, 255]}, {"op": "pad-to-square", "anchor": "floor-center", "background": [255, 255, 255]},
        {"op": "resize", "width": 4, "height": 4, "sampler": "pillow-bicubic-v1"}, {"op": "cast", "dtype": "float32"},
        {"op": "divide", "value": 255}, {"op": "permute", "order": [2, 0, 1]},
    ]
    images = T.decode_images(spark, [f"{folder}/a.png", f"{folder}/sub/f.png", f"{folder}/broken.png"])
    assert {r["path"].split("/")[-1]: r["pixels"] for r in images.collect()}["broken.png"] is None
    out = {r["path"].split("/")[-1]: r for r in T.prepare(images.filter("width > 0"), steps, [3, 4, 4]).collect()}
    assert np.allclose(out["f.png"]["tensor"], 1.0) and (out["f.png"]["d0"], out["f.png"]["d1"], out["f.png"]["d2"]) == (3, 4, 4)
    red = np.array(out["a.png"]["tensor"]).reshape(3, 4, 4)[0]
    assert red.min() < 0.1 and red[0, 0] > red[1, 1]


def brute_bicubic(image, size):
    """Plain loops over one gray channel."""
    def passes(rows, size):
        n = len(rows[0])
        scale = n / size
        fs = max(scale, 1.0)
        out = []
        for row in rows:
            line = []
            for o in range(size):
                centre = (o + 0.5) * scale
                lo, hi = max(int(centre - 2 * fs + 0.5), 0), min(int(centre + 2 * fs + 0.5), n)
                ws = []
                for t in range(lo, hi):
                    d = abs((t - centre + 0.5) / fs)
                    ws.append((1.5 * d - 2.5) * d * d + 1 if d < 1 else ((((d - 5) * d + 8) * d - 4) * -0.5 if d < 2 else 0.0))
                total = sum(ws)
                ks = [int(w / total * 2**22 + (0.5 if w >= 0 else -0.5)) for w in ws]
                line.append(min(max((sum(k * row[lo + i] for i, k in enumerate(ks)) + 2**21) >> 22, 0), 255))
            out.append(line)
        return out

    across = passes(image, size)
    return list(zip(*passes(list(map(list, zip(*across))), size)))


@pytest.mark.parametrize("w,h,size", [(9, 6, 4), (5, 7, 11), (16, 16, 7)])
def test_resize_against_brute_force(spark, w, h, size):
    gray = np.random.default_rng(w).integers(0, 256, (h, w))
    df = spark.createDataFrame([(1, np.repeat(gray.ravel(), 3).tolist(), w, h, 3)], "image_id long, pixels array<int>, width int, height int, channels int")
    got = np.array(T.resize(df, size, size).first()["pixels"]).reshape(size, size, 3)
    assert (got[:, :, 0] == np.array(brute_bicubic(gray.tolist(), size))).all() and (got[:, :, 0] == got[:, :, 2]).all()


@pytest.mark.parametrize("change", [
    lambda s: s[1:], lambda s: s + [s[0]], lambda s: [*s[:1], {"op": "blur"}], lambda s: s[:-1], lambda s: s[:2] + [dict(s[2], value=0)],
    lambda s: [dict(s[0], extra=1), *s[1:]], lambda s: [s[0], s[2]], lambda s: s * 20, lambda s: [s[0], dict(s[1], mode="gray"), *s[2:]],
])
def test_bad_steps(change):
    steps = [
        {"op": "decode", "frame": "first", "colorManagement": "ignore"}, {"op": "ensure-color", "mode": "rgb"},
        {"op": "resize", "width": 8, "height": 8, "sampler": "pillow-bicubic-v1"}, {"op": "cast", "dtype": "float32"},
    ]
    T.check_steps(steps, [8, 8, 3])
    with pytest.raises(ValueError):
        T.check_steps(change(steps))
    with pytest.raises(ValueError):
        T.check_steps(steps, [3, 8, 8])


def test_bad_images_do_not_fail_the_batch(spark):
    t = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [3.0, 4.0])], "image_id long, tensor array<float>").coalesce(1)
    out = {r["image_id"]: r for r in T.score(t, lambda: lambda x: x * 2, 2, "fp", activation="none").collect()}
    assert out[1]["probabilities"] == [2.0, 4.0] and out[3]["state"] == "succeeded"
    assert out[2]["state"] == "failed" and "catalog has 2" in out[2]["error"]


def test_pack_files(spark, tmp_path):
    rows = [(0, "a", "general", "甲", 5), (1, "b,c", "rating", "b,c", 0)]
    cat = spark.createDataFrame(rows, "id int, name string, group string, translation string, count long")
    sinks.write_catalog(cat, str(tmp_path / "cat"))
    part = [f for f in os.listdir(tmp_path / "cat") if f.startswith("part")]
    assert len(part) == 1
    assert (tmp_path / "cat" / part[0]).read_bytes() == 'id,name,group,translation,count\n0,a,general,甲,5\n1,"b,c",rating,"b,c",0\n'.encode()
    manifest = {"schemaVersion": 1, "id": "m", "task": "multi-label-image-tagging", "defaultThreshold": 0.5,
                "groups": [{"id": "rating", "name": "R", "displayName": "", "strategy": "rating"}, {"id": "general", "name": "G"}],
                "output": {"name": "o", "activation": "sigmoid", "labelCount": 2}}
    (tmp_path / "model.json").write_text(json.dumps(manifest, indent=1))
    m = packs.read_manifest(spark, str(tmp_path / "model.json"))
    groups = packs.read_groups(m)
    assert [(r["pos"], r["id"], r["strategy"]) for r in groups.orderBy("pos").collect()] == [(0, "rating", "rating"), (1, "general", "threshold")]
    assert check_manifest(m).count() == 0
    read = packs.read_catalog(spark, str(tmp_path / "cat"), groups, 2)
    assert [tuple(r) for r in read.orderBy("tag_index").collect()] == [(0, "a", "甲", "general"), (1, "b,c", None, "rating")]
    with pytest.raises(ValueError, match="label_count"):
        packs.read_catalog(spark, str(tmp_path / "cat"), groups, 3)
    (tmp_path / "wrong.csv").write_text("id,name,grp,translation,count\n0,a,general,,1\n")
    with pytest.raises(Exception):
        packs.read_catalog_file(spark, str(tmp_path / "wrong.csv")).collect()
    digest = hashlib.sha256(b"x").hexdigest()
    (tmp_path / "sums").write_text(f"{digest.upper()}  model.onnx\n\nzz  tags.csv\n{digest}  other.bin\n")
    out = {(r["name"], r["problem"]) for r in packs.read_checksums(spark, str(tmp_path / "sums")).collect()}
    assert out == {("model.onnx", None), ("tags.csv", "invalid_line"), ("other.bin", "unknown_file")}
    (tmp_path / "t.jsonl").write_text('{"id":1,"tag":"a","translation":"x"}\n\n{"id":1,"tag":"a","translation":"y"}\n{"id":2,"tag":"b"}\n')
    t = packs.read_translations(spark, str(tmp_path / "t.jsonl"))
    assert sorted(tuple(r) for r in t.collect()) == [(1, "a", "y"), (2, "b", "")]


def naive_suppress(rows, window):
    state, out = {}, []
    for key, ts, seq in sorted(rows, key=lambda r: (r[1], r[2])):
        last, pending = state.get(key, (None, 0))
        if last is not None and ts - last < window:
            state[key] = (last, pending + 1)
        else:
            out.append((key, ts, seq, pending))
            state[key] = (ts, 0)
    return sorted(out)


def naive_suppress_any(rows, window):
    named = naive_suppress([("" if k is None else k, t, s) for k, t, s in rows], window)
    return [(k or None, *rest) for k, *rest in named]


@pytest.mark.parametrize("seed,span,run_rows", [(1, 2000, 2), (2, 300, 4), (3, 50000, 3), (4, 2000, 10_000)])
def test_suppression_against_brute_force(spark, seed, span, run_rows):
    rng = np.random.default_rng(seed)
    rows = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.choice(3, 1500, p=[0.8, 0.1, 0.1]), rng.integers(0, span, 1500)))]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["key", "ts", "seq"]))
    got = sorted(tuple(r) for r in I.suppress_repeats(df, 37, run_rows).collect())
    assert got == naive_suppress(rows, 37)


def test_a_hot_key_is_cut_into_bounded_runs(spark):
    """Nine tenths of the rows are one key, and a window of a microsecond lets every time out."""
    rows = [("hot" if i % 10 else None, i * 3 // 2, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "key string, ts long, seq long")
    times = df.groupBy("key", "ts").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    sizes = repeats.runs_of(times, 50).groupBy("key", "node").count()
    assert sizes.agg(F.max("count")).first()[0] <= 50 and sizes.filter("key = 'hot'").count() >= 72
    for window in (1, 40, 100_000):
        got = sorted((tuple(r) for r in I.suppress_repeats(df, window, 50).collect()), key=repr)
        assert got == sorted(naive_suppress_any(rows, window), key=repr)
    assert I.suppress_repeats(df.limit(0), 5).count() == 0


def test_steps_compose_in_any_order():
    rng = np.random.default_rng(11)
    for window in (1, 7, 60):
        ts = np.unique(rng.integers(0, 400, 150))
        n = rng.integers(1, 4, len(ts))
        cuts = [0, 13, 20, 55, 90, len(ts)]
        parts = [repeats.steps_of(ts[a:b], n[a:b], window) for a, b in zip(cuts, cuts[1:])]
        left, right = parts[0], parts[-1]
        for part in parts[1:]:
            left = repeats.compose(left, part, window)
        for part in reversed(parts[:-1]):
            right = repeats.compose(part, right, window)
        whole = repeats.steps_of(ts, n, window)
        for due in (None, *range(int(ts[0]) - 3, int(ts[0]) + window)):
            results = []
            for s in (left, right, whole):
                at = s.step(due)
                results.append((s.exit_ts[at], s.exit_row[at]) if at < len(s.upto) else None)
            assert results[0] == results[1] == results[2]


def test_streams_over_several_batches(spark, tmp_path):
    """Three files, one per micro-batch; state must carry over."""
    rng = np.random.default_rng(5)
    ts = np.sort(rng.integers(0, 600_000_000, 300))
    rows = [("ab"[int(k)], int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 2, 300), ts))]
    schema = "key string, ts long, seq long, event_time timestamp"
    for n in range(3):
        chunk = spark.createDataFrame(rows[n * 100:(n + 1) * 100], "key string, ts long, seq long")
        chunk.withColumn("event_time", F.timestamp_micros("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        os.utime(next(p for p in sorted((tmp_path / "in").glob("*.parquet"), key=os.path.getmtime, reverse=True)), (n * 10 + 1e9, n * 10 + 1e9))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    R.run_available(R.stream_suppress(stream, 5_000_000, "10 minutes"), out, str(tmp_path / "cp"))
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == naive_suppress(rows, 5_000_000)


def test_stream_import(spark, folder, tmp_path):
    found = R.stream_import(spark, str(folder)).select("path", "length")
    R.run_available(found, str(tmp_path / "out"), str(tmp_path / "cp"))
    names = [r["path"].split("/")[-1] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(names) == ["B.PNG", "a.png", "broken.png", "c.jpg", "cut.png", "d.bmp", "e.gif", "f.png"]


def test_session_helpers(spark):
    assert shared_dir(spark, "x") != shared_dir(spark, "x")


@pytest.mark.parametrize("order,mark", [("little", b"II*\x00"), ("big", b"MM\x00*")])
def test_exif_orientation(spark, order, mark):
    number = lambda n, size: n.to_bytes(size, order)
    entry = lambda tag, value: number(tag, 2) + number(3, 2) + number(1, 4) + number(value, 2) + b"\x00\x00"
    tiff = mark + number(8, 4) + number(2, 2) + entry(0x0100, 640) + entry(0x0112, 6) + bytes(4)
    files = [b"\xff\xd8\xff\xe1\x00\x00Exif\x00\x00" + tiff, tiff, b"\x89PNG\r\n....eXIf" + tiff, b"\xff\xd8 none", b"", None, tiff.replace(number(6, 2) + b"\x00\x00", number(99, 2) + b"\x00\x00"), tiff[:20]]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "i int, f binary").select("i", T.exif_orientation("f").alias("o"))
    assert [r["o"] for r in df.orderBy("i").collect()] == [6, 6, 6, 1, 1, 1, 1, 1]


def test_transposing_needs_the_orientation(spark):
    images = spark.createDataFrame([([1] * 8, 2, 1, 4)], "pixels array<int>, width int, height int, channels int")
    with pytest.raises(ValueError, match="orientation"):
        T.exif_transpose(images)


def test_scoring_keeps_earlier_errors(spark):
    rows = [("a", [1.0, 2.0], None), ("b", None, "cannot decode"), ("c", [3.0], None)]
    tensors = spark.createDataFrame(rows, "image_id string, tensor array<float>, error string")
    out = {r["image_id"]: r for r in T.score(tensors, lambda: lambda x: x * 2, 2, "fp", activation="none").collect()}
    assert out["a"]["probabilities"] == [2.0, 4.0] and out["a"]["duration_ms"] >= 0 and out["a"]["created_at"]
    assert (out["b"]["state"], out["b"]["error"]) == ("failed", "cannot decode") and out["c"]["state"] == "failed"


@pytest.mark.parametrize("name", ["results_images", "results_written"])
def test_images_of_one_path_are_one_record(spark, tmp_path, sf, name):
    """Pages with one address give several images one path; the SQL has one record for those of equal state and error."""
    import __spark_entry__ as entry_points
    import check
    import duckdb

    folder, con = str(tmp_path), duckdb.connect()
    for t in ("embeddings", "part"):
        con.execute(f"COPY (FROM '{sf}/{t}.parquet') TO '{folder}/{t}.parquet'")
    con.execute(f"COPY (SELECT * REPLACE ('http://a.example/' || page_id % 7 || '.png' AS url) FROM '{sf}/pages.parquet') TO '{folder}/pages.parquet'")
    for t in ("embeddings", "part", "pages"):
        con.execute(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    text, fine = check.check_one(spark, con, name, folder)
    assert fine, text

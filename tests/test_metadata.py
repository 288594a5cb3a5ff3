"""Generation metadata: texts composed from parts, so that the expected values are the parts themselves."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom import fixed
from tagloom.functions import limit_text
from tagloom.operators import budget, metadata as M
from tagloom.sources import entries as E

rng = random.Random(20)
WORDS = "harbour lantern violet gravel orchard copper mist anvil".split()
#: Tail fields as written, with the parameter each becomes.
TAIL = {
    "Steps": "steps", "Sampler": "sampler", "Schedule type": "scheduler", "CFG scale": "cfg", "Seed": "seed", "Size": "size", "Model hash": "model_hash", "Model": "model",
    "VAE": "vae", "Clip skip": "clip_skip", "Hires upscale": "hires_upscale", "Hires upscaler": "hires_upscaler", "Denoising strength": "denoising",
}


def phrase(n=3):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def parameter_text(positive, negative, tail):
    lines = [positive] + ([f"Negative prompt: {negative}"] if negative else []) + [", ".join(f"{k}: {v}" for k, v in tail.items())]
    return "\n".join(lines)


def node(kind, **inputs):
    return {"class_type": kind, "inputs": inputs}


def graph(*nodes, first=1):
    return json.dumps({str(i): n for i, n in enumerate(nodes, first)}, ensure_ascii=False)


def run(spark, build, rows):
    df = spark.createDataFrame([(i, *(list(r) + [None] * (3 - len(r)))) for i, r in enumerate(rows)], "i int, a string, b string, c string")
    found = {r["i"]: r["segment"] for r in build(df).collect()}
    return [found.get(i) for i in range(len(rows))]


def parameter_segments(spark, *texts):
    return run(spark, lambda df: M.parse_a1111(df, "a"), [(t,) for t in texts])


def node_segments(spark, *pairs):
    def build(df):
        read = df.select("i", "a", "b", M.prompt_nodes(F.col("a")).alias("p"), M.workflow_nodes(F.col("b")).alias("w"))
        return read.select("i", M.assemble_nodes(F.col("a"), F.col("p"), F.col("b"), F.col("w")).alias("segment"))

    return run(spark, build, pairs)


def comment_segments(spark, *rows):
    return run(spark, lambda df: df.select("i", M.comment_segment(F.col("a"), F.col("b"), F.col("c")).alias("segment")), rows)


def fields(segment, target):
    return {f["key"]: f["value"] for f in segment["fields"] if f["target"] == target}


def resources(segment):
    return [tuple(r) for r in segment["resources"]]


def test_every_tail_field_becomes_its_parameter(spark):
    cases = []
    for n in range(len(TAIL)):
        chosen = dict(itertools.islice(itertools.cycle((k, f"{phrase(1)}{n}") for k in TAIL), n, n + 5))
        chosen = {"Steps": str(10 + n), **{k: v for k, v in chosen.items() if k != "Steps"}}
        cases.append((phrase(), phrase(2) if n % 2 else None, chosen))
    for (positive, negative, tail), s in zip(cases, parameter_segments(spark, *(parameter_text(*c) for c in cases))):
        assert (s["source"], s["positive"], s["negative"], s["warnings"]) == ("automatic1111", positive, negative, [])
        assert fields(s, "param") == {TAIL[k]: v for k, v in tail.items()}
        named = tail.get("Model", tail.get("Model hash"))  # a hash stands for a name that is not given
        want = [("checkpoint", named, tail.get("Model hash"), None)] if named else []
        assert [r for r in resources(s) if r[0] == "checkpoint" and r[1]] == want


def test_tail_values_with_commas_and_names_nobody_knows(spark):
    quoted, bracketed, odd = f'"{phrase(1)}, {phrase(1)}"', f"{phrase(1)} (p, [q, r])", phrase(2)
    text = parameter_text(phrase(), None, {"Steps": "3", "Sampler": bracketed, "Zeta": quoted, "Omega Ray": odd})
    (s,) = parameter_segments(spark, text)
    assert fields(s, "param") == {"steps": "3", "sampler": bracketed}
    assert fields(s, "raw") == {"parameters": text, "Zeta": quoted, "Omega Ray": odd}
    assert s["warnings"] == [fixed.W_UNKNOWN_FIELD % name for name in ("Zeta", "Omega Ray")]


def test_where_the_tail_begins(spark):
    positive = phrase()
    twice, none, null, blank = parameter_segments(spark, f"{positive}\nSteps: 4\n{positive}\n Steps: 6, Seed: 8", positive, None, "\t \n")
    assert twice["positive"] == f"{positive}\nSteps: 4\n{positive}" and fields(twice, "param") == {"steps": "6", "seed": "8"}
    assert (none["positive"], none["negative"], none["warnings"]) == (positive, None, [fixed.W_NO_TAIL])
    assert null is None and blank is None


def test_node_maps(spark):
    a, b, c, model, vae, lora = (phrase(2) for _ in range(6))
    sampling = {"seed": 77, "steps": 11, "cfg": 4.5, "sampler_name": "heun", "scheduler": "simple", "denoise": 0.75}
    full = graph(
        node("EmptyLatentImage", width=320, height=200, batch_size=3), node("CLIPTextEncode", text=a), node("KSampler", **sampling), node("CLIPTextEncode", text=b),
        node("VAELoader", vae_name=vae), node("CheckpointLoaderSimple", ckpt_name=model), node("LoraLoader", lora_name=lora, strength_model=0.3, strength_clip=0.9),
    )
    crowd = graph(*[node("CLIPTextEncode", text=t) for t in (a, b, c)], *[node("KSampler", seed=n) for n in (5, 6)], *[node(f"Stranger{n}") for n in range(25)])
    reversed_ids = json.dumps({"20": node("CLIPTextEncode", text=b), "3": node("CLIPTextEncode", text=a)})
    one, many, turned, nothing, broken = node_segments(spark, (full,), (crowd,), (reversed_ids,), (graph(node("Stranger")),), ("{",))
    assert (one["source"], one["positive"], one["negative"], one["warnings"]) == ("comfyui", a, b, [])
    assert fields(one, "param") == {
        "model": model, "vae": vae, "seed": "77", "steps": "11", "cfg": "4.5", "sampler": "heun", "scheduler": "simple", "denoise": "0.75", "size": "320x200", "batch_size": "3",
    }
    assert resources(one) == [("checkpoint", model, None, None), ("vae", vae, None, None), ("lora", lora, None, "0.3/0.9")]
    assert fields(many, "raw")["extra_prompt_1"] == c and fields(many, "param")["seed"] == "5"
    assert many["warnings"] == [fixed.W_COMPLEX, fixed.W_MANY_SAMPLERS, fixed.W_MANY_TEXTS]
    assert (turned["positive"], turned["negative"]) == (a, b) and nothing is None and broken is None


def test_json_is_read_as_it_is_spelled(spark):
    awkward = ['tab\t"quoted" \\ back', " and ", "é漢😀", "{not: json}", 'ends with \\"']
    maps = [(graph(node("CLIPTextEncode", text=t)),) for t in awkward]
    numbers = '{"4":{"class_type":"KSampler","inputs":{"seed":2E5,"cfg":3.250,"steps":"012","denoise":false,"scheduler":["1",0]}}}'
    repeated = '{"4":{"class_type":"CLIPTextEncode","inputs":{"text":"old","text":"new"}}}'
    deep = '{"4":{"class_type":"CLIPTextEncode","inputs":{"text":"kept","more":' + "[" * 60 + "]" * 60 + "}}}"
    too_deep, cut, nan = deep.replace("[", "[[").replace("]", "]]"), repeated[:-2], '{"4":NaN}'
    *texts, number, twice, nested, a, b, c = node_segments(spark, *maps, (numbers,), (repeated,), (deep,), (too_deep,), (cut,), (nan,))
    assert [s["positive"] for s in texts] == awkward
    assert fields(number, "param") == {"seed": "2E5", "cfg": "3.250", "steps": "012", "denoise": "false"}
    assert twice["positive"] == "new" and nested["positive"] == "kept" and a is b is c is None


def test_parsers_keep_whole_texts(spark):
    long = phrase(1) * (fixed.MAX_FIELD_UNITS // 4)
    (s,) = node_segments(spark, (graph(node("CLIPTextEncode", text="x"), node("CLIPTextEncode", text="y"), node("CLIPTextEncode", text=long)),))
    assert fields(s, "raw")["extra_prompt_1"] == long and len(fields(s, "raw")["prompt"]) > len(long)


def test_workflow_lists(spark):
    a, b, model = phrase(), phrase(), phrase(1)
    item = lambda kind, *values, **more: {"type": kind, "widgets_values": list(values), **more}
    flow = json.dumps({"nodes": [
        item("LoraLoader", "thin", 1, 1, id=8), item("CLIPTextEncode", b, id=31), item("CheckpointLoaderSimple", model, id=2), item("CLIPTextEncode", a, id=4),
        item("EmptyLatentImage", 96, 64, 2, id=5), item("KSampler", 0, id=6), item("CLIPTextEncode", None),
    ]})
    (s,) = node_segments(spark, (None, flow))
    assert (s["positive"], s["negative"]) == (a, b)
    assert fields(s, "param") == {"model": model, "size": "96x64", "batch_size": "2"}
    assert {r[:2] for r in resources(s)} == {("checkpoint", model), ("lora", "thin")}
    assert s["warnings"] == [fixed.W_WORKFLOW_SAMPLER, fixed.W_TEXT_NODE % "7"]


def test_comments(spark):
    good, bad, members = phrase(), phrase(2), {"strength": 0.4, "Tries": 6, "plan": {"k": [1, 2.50]}, "void": None, "on": True}
    text = json.dumps({"prompt": good, "undesired_content": bad, **members}).replace("2.5]", "2.50]")
    tool = "Tool " + phrase(1)
    full, by_marker, foreign, damaged, listed = comment_segments(
        spark, (text,), (None, "NovelAI " + tool, "src"), ('{"colour": 3}', tool), ("{" + good, "NovelAI"), ("[1]", "NovelAI")
    )
    assert (full["source"], full["positive"], full["negative"], full["version"]) == ("novelai", good, bad, None)
    assert fields(full, "param") == {"strength": "0.4", "tries": "6", "on": "true"}
    assert fields(full, "raw") == {"comment": text, "comment:plan": '{"k":[1,2.50]}', "comment:void": "null"}
    assert by_marker["source"] == "novelai" and fields(by_marker, "raw") == {"software": "NovelAI " + tool, "source": "src"}
    assert foreign["source"] == "unknown" and foreign["warnings"] == [fixed.W_NOT_NOVELAI] and fields(foreign, "param") == {"colour": "3"}
    assert damaged["warnings"] == [fixed.W_COMMENT_JSON] and listed["warnings"] == [fixed.W_COMMENT_NOT_OBJECT]


def merged(spark, images, **limits):
    """Everything about each image of one job."""
    rows = [(i, k, v) for i, entries in enumerate(images) for k, v in entries.items()]
    info = M.generation_info(spark.createDataFrame(rows, "image_id long, key string, value string"), **limits)
    out = [{"head": None, "params": {}, "raw": {}, "resources": set(), "warnings": []} for _ in images]
    for r in info.header.collect():
        out[r["image_id"]]["head"] = r
    for name, table in (("params", info.parameters), ("raw", info.raw_entries)):
        for r in table.collect():
            out[r["image_id"]][name][r["key"]] = r["value"]
    for r in info.resources.collect():
        out[r["image_id"]]["resources"].add((r["kind"], r["name"]))
    for r in info.warnings.orderBy("stage", "seg_key", "at").collect():
        out[r["image_id"]]["warnings"].append(r["warning"])
    return out


def test_merging_and_limits(spark):
    a, b, c, model, other = phrase(), phrase(), phrase(), phrase(1) + "_m", phrase(1) + "_o"
    text = parameter_text(a, b, {"Steps": "9", "Sampler": "Ddim", "Model": model})
    nodes = graph(node("CheckpointLoaderSimple", ckpt_name=other), node("CLIPTextEncode", text=c), node("KSampler", seed=31, steps=2))
    images = [
        {"Png/parameters": text, "Png/prompt": nodes}, {"X/parameters": text, "Y/parameters": text}, {"P/prompt": graph(node("Stranger")), "Q/prompt": nodes},
        {"Png/workflow": "[" * 66 + "]" * 66}, {"Exif/Software": "Paint", "Warning/3": "note"}, {"Warning/0": "alone"},
    ]
    both, same, later, deep, plain, lonely = merged(spark, images)
    assert (both["head"]["source"], both["head"]["positive"], both["head"]["negative"], both["head"]["sources"]) == ("automatic1111", a, b, 2)
    assert both["params"]["steps"] == "9" and both["params"]["seed"] == "31" and both["warnings"] == [fixed.W_MULTI_SOURCE]
    assert both["resources"] == {("checkpoint", model), ("checkpoint", other)} and same["resources"] == {("checkpoint", model)}
    assert later["head"]["positive"] == c
    assert deep["warnings"] == [fixed.W_JSON_FAILED % "Png/workflow", fixed.W_UNSUPPORTED] and deep["raw"] == images[3]
    assert plain["raw"] == {"Exif/Software": "Paint"} and plain["warnings"][0] == "note" and lonely["head"] is None
    cut = merged(spark, [{"Png/parameters": text, "Zz/extra": "z" * 50}], field_units=10, total_units=25)[0]
    assert cut["head"]["positive"] == a[:10] and cut["raw"] == {"Png/parameters": text[:10], "Zz/extra": "z" * 10, "parameters": text[:10]} or len(cut["raw"]) == 2
    assert fixed.W_FIELD_CUT % (fixed.L_POSITIVE, "10") in cut["warnings"] and any("25" in w for w in cut["warnings"])


def test_limit_names():
    assert [limit_text(n) for n in (2 << 20, 3 << 10, 60)] == ["2MiB", "3KiB", "60"]


@pytest.mark.parametrize("limit", [30, 75, 120])
def test_budget_matches_a_plain_walk(spark, limit):
    sizes = {(i, f"k{n:02d}"): rng.randrange(1, 40) for i in range(4) for n in range(i * 3)}
    df = spark.createDataFrame([(i, k, "y" * n) for (i, k), n in sizes.items()], "image_id long, key string, value string")
    want = set()
    for i in range(4):
        total = 0
        for key in sorted(k for j, k in sizes if j == i):
            if total + sizes[i, key] <= limit:
                total += sizes[i, key]
                want.add((i, key))
    assert {(r["image_id"], r["key"]) for r in M.greedy_budget(df, limit).collect()} == want


@pytest.mark.parametrize("limit", [0, 1, 97, 1000, 4096])
def test_budget_of_many_blocks_matches_a_plain_walk(spark, limit):
    sizes = {(i, f"k{n:04d}"): rng.choice([1, 2, 3, 40, 41, 500, 900, 5000]) if i else 7 for i in range(3) for n in range(400)}
    rows = [(i, k, "y" * n, "own") for (i, k), n in sizes.items()] + [(0, "z", None, ""), (1, "z", "", ""), (None, "k", "y" * 9000, ""), (2, None, "y" * 9000, "")]
    df = spark.createDataFrame(rows, "image_id long, key string, value string, node string")
    want = {(0, "z"), (1, "z"), (None, "k"), (2, None)}
    for i in range(3):
        left = limit
        for key in sorted(k for j, k in sizes if j == i):
            if sizes[i, key] <= left:
                left -= sizes[i, key]
                want.add((i, key))
    kept = M.greedy_budget(df, limit, block=16)
    assert kept.columns == ["image_id", "key", "value", "node"] and {(r["image_id"], r["key"]) for r in kept.collect()} == want


def test_budget_steps_add_up():
    for _ in range(500):
        sizes = np.array([rng.randrange(1, rng.choice([3, 50, 300])) for _ in range(rng.randrange(1, 50))], np.int64)
        left = before = rng.randrange(400)
        want = []
        for size in sizes.tolist():
            want.append(size <= left)
            left -= size * want[-1]
        taken, after = budget.spend(sizes, before)
        assert taken.tolist() == want and after == left
        level = before.bit_length()
        sums, least = budget.summarize(sizes, 9)
        if level and before - sums[level] >= 1 << (level - 1) and least[level] > before:  # the block keeps the bit length
            assert after == before - sums[level] and taken.tolist() == [s.bit_length() < level for s in sizes.tolist()]


def test_budget_of_an_empty_table(spark):
    assert M.over_budget(spark.createDataFrame([], "image_id string, key string, value string"), 5).count() == 0


def test_keys_never_collide(spark):
    cases = [["a", "a #2", "a"], ["a", "a", "a #2", "a", "a #3", "a #5", "a"], ["b #2", "b #2", "b", "b"], ["c #3", "c", "c", "c"], ["d"] * 4]
    rows = [(i, at, key, f"{i}-{at}") for i, keys in enumerate(cases) for at, key in enumerate(keys)]
    got = E.normalize_entries(spark.createDataFrame(rows, "image_id long, seq long, key string, value string")).collect()
    for i, keys in enumerate(cases):
        named = {r["seq"]: r["key"] for r in got if r["image_id"] == i}
        assert len(set(named.values())) == len(keys), named
        assert all(named[at] == key for at, key in enumerate(keys) if keys.index(key) == at)
    assert [r["key"] for r in sorted(got, key=lambda r: r["seq"]) if r["image_id"] == 0] == ["a", "a #2", "a #3"]


@pytest.mark.parametrize("count", [3, 31, 32, 60])
def test_node_order_is_one_at_every_length(spark, count):
    ids = [str(n) if n % 3 else f"{n}x" for n in range(count)]
    rng.shuffle(ids)
    df = spark.createDataFrame([([(i, i) for i in ids],)], "t array<struct<node:string,text:string>>")
    got = df.select(F.transform(M.order_nodes(F.col("t")), lambda x: x["node"]).alias("o")).first()["o"]
    assert got == sorted(ids, key=lambda i: (not i.isdigit(), int(i) if i.isdigit() else 0, i))


def test_narrow_tables_are_spread_before_they_grow(spark, tmp_path):
    """One file of one row group is read by one task; parts become kilobytes of metadata each, so they are dealt first."""
    from tagloom.plans import bindings as B, tensor_queries

    spark.range(12_000).selectExpr("id as p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(9_000).selectExpr("id as vec_id", "1 as label", "array(0.1f) as embedding").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    for df, key, n, tasks in ((B.parts(spark, str(tmp_path)), "p_partkey", 12_000, 3), (tensor_queries.pix(spark, str(tmp_path)), "image_id", 9_000, 5)):
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == tasks and max(sizes) < n // 2 and df.select(key).distinct().count() == n


def test_texts_are_read_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    from tagloom.functions import jsontext

    seen = []
    monkeypatch.setattr(jsontext.F, "arrow_udf", lambda kind: lambda f: f)
    column = jsontext._udf(lambda texts: seen.append(len(texts)) or texts, "string")
    texts = pa.array([str(n) for n in range(1201)])
    assert column(texts).equals(texts) and seen == [500, 500, 201]
    assert len(column(texts.slice(0, 0))) == 0


def test_documents_of_no_part_are_no_images(spark, sf, tmp_path):
    """More documents than parts, as in larger tables: what the SQL counts per image is of parts alone."""
    import duckdb

    import __spark_entry__ as entry_points

    con = duckdb.connect()
    for name, some in (("part", "p_partkey < 40"), ("documents", "doc_id < 70")):
        con.execute(f"COPY (FROM '{sf}/{name}.parquet' WHERE {some}) TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
    for name in ("meta_warnings", "meta_merge_header"):
        got = entry_points.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry_points.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr), name

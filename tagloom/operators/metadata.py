"""Generation metadata: parse text and JSON entries, merge them per image, keep within limits.

Input is the long table ``meta(image_id, key, value)``. Parsing is an expression on one entry, so it
needs no shuffle. Results stay long too (one row per parameter, raw entry, resource and warning):
they are merged by aggregates with a partial step, so an image with very many entries is reduced
before the shuffle and never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from tagloom import fixed
from tagloom.functions import (
    combine_strengths, contains_marker, is_blank, json_is_valid, json_members, json_nodes, left_utf16, let, limit_text, literal_map, looks_like_json,
    marked_scalar, marked_string, size_text, split_top_level, suffix_key,
    tag_of_key, trim_unicode, utf16_length,
)
from tagloom.operators.budget import greedy_budget, over_budget  # noqa: F401
from tagloom.session import materialize, unnest

REST = 2**31 - 1
_FIELD = "struct<target:string,key:string,value:string>"
_RESOURCE = "struct<kind:string,name:string,hash:string,weight:string>"
_TEXT = "array<struct<node:string,text:string>>"
_LORA = "array<struct<name:string,weight:string>>"
_SIZE = "array<struct<size:string,batch:string>>"
_SAMPLER = "array<array<struct<key:string,value:string>>>"


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _field(target: str, key: Column | str, value: Column) -> Column:
    key = key if isinstance(key, Column) else F.lit(key)
    return F.struct(F.lit(target).alias("target"), key.alias("key"), value.alias("value"))


def _resource(kind: str, name: Column, hash_: Column | None = None, weight: Column | None = None) -> Column:
    null = _none("string")
    return F.struct(
        F.lit(kind).alias("kind"), name.alias("name"),
        (null if hash_ is None else hash_).alias("hash"), (null if weight is None else weight).alias("weight"),
    )


def _when_list(cond: Column, *items: Column) -> Column:
    """The items as an array if the condition holds, else an empty array."""
    return F.filter(F.array(*[F.when(cond, x) for x in items]), lambda x: x.isNotNull())


def _message(pattern: str, *args: Column) -> Column:
    return F.format_string(pattern, *args)


def _segment(source: Column, version, positive, negative, fields, resources, warnings) -> Column:
    return F.struct(
        source.alias("source"), version.alias("version"), positive.alias("positive"), negative.alias("negative"),
        fields.cast(f"array<{_FIELD}>").alias("fields"), resources.cast(f"array<{_RESOURCE}>").alias("resources"),
        warnings.cast("array<string>").alias("warnings"),
    )


# --- parameter text --------------------------------------------------------------------------------------------


def parse_a1111(df: DataFrame, text: str = "value", out: str = "segment") -> DataFrame:
    """Add the segment of a parameter text: prompts, tail fields, checkpoint and VAE. Null for blank text.

    The negative prompt starts at its first marker. The tail starts at the last line that begins with
    the tail marker, looked for only behind the negative marker if there is one.
    """
    t = F.col(text)
    names = literal_map(fixed.TAIL_FIELDS)
    last_tail = r"(?sU)\A(?:(.*)\n)?([^\S\n]*[sS][tT][eE][pP][sS]:.*)\z"
    df = df.withColumn("__at", F.locate(fixed.NEGATIVE_MARKER, t))
    df = df.withColumn(
        "__rest", F.when(F.col("__at") > 0, F.substring(t, F.col("__at") + len(fixed.NEGATIVE_MARKER), F.lit(REST))).otherwise(t)
    )
    df = df.withColumn("__lines", F.regexp_replace("__rest", "\r\n?", "\n"))
    df = df.withColumn("__tail", F.regexp_extract("__lines", last_tail, 2))
    df = df.withColumn(
        "__head",
        trim_unicode(F.when(F.col("__tail") == "", F.col("__rest")).otherwise(F.regexp_extract("__lines", last_tail, 1))),
    )
    df = df.withColumn("__parts", split_top_level(trim_unicode(F.translate("__tail", "\n", " "))))

    def read(part: Column) -> Column:
        colon = F.locate(":", part)
        raw = trim_unicode(F.substring(part, F.lit(1), colon - 1))
        return F.struct(
            part.alias("part"), (colon > 1).alias("pair"), raw.alias("raw"), F.lower(raw).alias("low"),
            trim_unicode(F.substring(part, colon + 1, F.lit(REST))).alias("value"),
        )

    df = df.withColumn("__read", F.filter(F.transform("__parts", read), lambda p: ~p["pair"] | (p["raw"] != "")))

    def name_of(p: Column) -> Column:
        hires, refiner = suffix_key(p["raw"], "hires"), suffix_key(p["raw"], "refiner")
        return F.coalesce(
            F.try_element_at(names, p["low"]),
            F.when(p["low"].startswith("hires"), F.concat(F.lit("hires_"), hires)),
            F.when(p["low"].startswith("refiner"), F.when(refiner == "", "refiner").otherwise(F.concat(F.lit("refiner_"), refiner))),
        )

    df = df.withColumn(
        "__fields",
        F.transform(
            "__read",
            lambda p: F.struct(p.alias("p"), F.when(p["pair"], name_of(p)).alias("name")),
        ),
    )
    picked = lambda low, at: F.try_element_at(
        F.filter("__read", lambda p: p["pair"] & (p["low"] == low)), F.lit(at)
    )["value"]
    df = df.withColumn(
        "__res",
        F.struct(
            picked("model", -1).alias("model"), picked("model hash", -1).alias("hash"),
            F.coalesce(picked("vae", -1), picked("vae hash", 1)).alias("vae"), picked("version", -1).alias("version"),
        ),
    )
    fields = F.transform(
        "__fields",
        lambda f: F.when(~f["p"]["pair"], _field("raw", f["p"]["part"], F.lit("")))
        .when(f["name"].isNotNull(), _field("param", f["name"], f["p"]["value"]))
        .otherwise(_field("raw", f["p"]["raw"], f["p"]["value"])),
    )
    unknown = F.transform(
        F.filter("__fields", lambda f: f["p"]["pair"] & f["name"].isNull()),
        lambda f: _message(fixed.W_UNKNOWN_FIELD, f["p"]["raw"]),
    )
    model, hash_, vae = F.col("__res.model"), F.col("__res.hash"), F.col("__res.vae")
    positive = F.when(F.col("__at") > 0, trim_unicode(F.substring(t, F.lit(1), F.col("__at") - 1))).otherwise(F.col("__head"))
    not_blank = lambda s: F.when(~is_blank(s), s)
    segment = _segment(
        F.when(contains_marker(t, "Forge"), "forge").otherwise("automatic1111"),
        F.col("__res.version"),
        not_blank(positive),
        F.when(F.col("__at") > 0, not_blank(F.col("__head"))),
        F.concat(F.array(_field("raw", "parameters", t)), fields),
        F.concat(
            _when_list(model.isNotNull() | hash_.isNotNull(), _resource("checkpoint", F.coalesce(model, hash_), hash_)),
            _when_list(vae.isNotNull(), _resource("vae", vae)),
        ),
        F.when(F.col("__tail") == "", F.array(F.lit(fixed.W_NO_TAIL))).otherwise(unknown),
    )
    df = df.withColumn(out, F.when(~is_blank(t), segment))
    return df.drop("__at", "__rest", "__lines", "__tail", "__head", "__parts", "__read", "__fields", "__res")


# --- node JSON -------------------------------------------------------------------------------------------------

_CHECKPOINTS = ["CheckpointLoaderSimple", "CheckpointLoader"]
_SAMPLERS = ["KSampler", "KSamplerAdvanced"]
_KNOWN = ["CLIPTextEncode", *_CHECKPOINTS, "VAELoader", "LoraLoader", *_SAMPLERS, "EmptyLatentImage"]


def _nodes(texts, checkpoints, vaes, loras, samplers, sizes, count, unrecognized, warnings) -> Column:
    return F.struct(
        texts.cast(_TEXT).alias("texts"), checkpoints.cast("array<string>").alias("checkpoints"), vaes.cast("array<string>").alias("vaes"),
        loras.cast(_LORA).alias("loras"), samplers.cast(_SAMPLER).alias("samplers"), sizes.cast(_SIZE).alias("sizes"),
        count.cast("int").alias("nodes"), unrecognized.cast("int").alias("unrecognized"), warnings.cast("array<string>").alias("warnings"),
    )


def _no_nodes(warnings: Column) -> Column:
    nothing = F.array()
    return _nodes(nothing, nothing, nothing, nothing, nothing, nothing, F.lit(0), F.lit(0), warnings)


def _pick(nodes: Column, types: Sequence[str], value) -> Column:
    """Non-null ``value(node)`` of the nodes of these types, in order."""
    chosen = F.filter(nodes, lambda n: n["type"].isin(list(types)))
    return F.filter(F.transform(chosen, value), lambda x: x.isNotNull())


def _from_members(nodes: Column) -> Column:
    """Extract from the nodes of ``{"id": {"class_type": ..., "inputs": {...}}, ...}``."""
    def scalar(n: Column, name: str) -> Column:
        return marked_scalar(F.try_element_at(n["inputs"], F.lit(name)))

    def string(n: Column, name: str) -> Column:
        return marked_string(F.try_element_at(n["inputs"], F.lit(name)))

    def lora(n: Column) -> Column:
        strength = combine_strengths(
            F.coalesce(scalar(n, "strength_model"), scalar(n, "strength")), scalar(n, "strength_clip")
        )
        name = string(n, "lora_name")
        return F.when(name.isNotNull(), F.struct(name.alias("name"), strength.alias("weight")))

    def sampler(n: Column) -> Column:
        pairs = F.array(*[
            F.struct(F.lit(key).alias("key"), scalar(n, name).alias("value")) for name, key in fixed.SAMPLER_FIELDS.items()
        ])
        return F.when(n["inputs"].isNotNull(), F.filter(pairs, lambda p: p["value"].isNotNull()))

    def size(n: Column) -> Column:
        both = size_text(scalar(n, "width"), scalar(n, "height"))
        return F.when(both.isNotNull(), F.struct(both.alias("size"), scalar(n, "batch_size").alias("batch")))

    def text(n: Column) -> Column:
        value = string(n, "text")
        return F.when(value.isNotNull(), F.struct(n["id"].alias("node"), value.alias("text")))

    def extract(ns: Column) -> Column:
        return _nodes(
            _pick(ns, ["CLIPTextEncode"], text),
            _pick(ns, _CHECKPOINTS, lambda n: string(n, "ckpt_name")),
            _pick(ns, ["VAELoader"], lambda n: string(n, "vae_name")),
            _pick(ns, ["LoraLoader"], lora),
            _pick(ns, _SAMPLERS, sampler),
            _pick(ns, ["EmptyLatentImage"], size),
            F.size(ns),
            F.size(F.filter(ns, lambda n: n["type"].isNull() | ~n["type"].isin(_KNOWN))),
            _pick(ns, ["CLIPTextEncode"], lambda n: F.when(string(n, "text").isNull(), _message(fixed.W_TEXT_NODE, n["id"]))),
        )

    return let(nodes, extract)


def _from_listed(nodes: Column) -> Column:
    """Extract from the nodes of ``[{"id":..., "type":..., "widgets_values": [...]}, ...]``."""
    def string(n: Column, at: int) -> Column:
        return marked_string(F.get(n["widgets"], F.lit(at)))

    def scalar(n: Column, at: int) -> Column:
        return marked_scalar(F.get(n["widgets"], F.lit(at)))

    def text(n: Column) -> Column:
        return F.when(string(n, 0).isNotNull(), F.struct(n["id"].alias("node"), string(n, 0).alias("text")))

    def lora(n: Column) -> Column:
        weight = combine_strengths(scalar(n, 1), scalar(n, 2))
        return F.when(string(n, 0).isNotNull(), F.struct(string(n, 0).alias("name"), weight.alias("weight")))

    def size(n: Column) -> Column:
        both = size_text(scalar(n, 0), scalar(n, 1))
        return F.when(both.isNotNull(), F.struct(both.alias("size"), scalar(n, 2).alias("batch")))

    def warning(n: Column) -> Column:
        return F.when(
            (n["type"] == "CLIPTextEncode") & string(n, 0).isNull(), _message(fixed.W_TEXT_NODE, n["id"])
        ).when(n["type"].isin(_SAMPLERS), fixed.W_WORKFLOW_SAMPLER)

    def extract(ns: Column) -> Column:
        read = F.filter(ns, lambda n: n["widgets"].isNotNull())
        silent = [*_SAMPLERS, "EmptyLatentImage"]
        odd = F.filter(
            ns,
            lambda n: n["type"].isNull()
            | F.when(n["widgets"].isNull(), ~n["type"].isin(silent)).otherwise(~n["type"].isin(_KNOWN)),
        )
        return _nodes(
            _pick(read, ["CLIPTextEncode"], text),
            _pick(read, _CHECKPOINTS, lambda n: string(n, 0)),
            _pick(read, ["VAELoader"], lambda n: string(n, 0)),
            _pick(read, ["LoraLoader"], lora),
            F.array(),
            _pick(read, ["EmptyLatentImage"], size),
            F.size(ns),
            F.size(odd),
            _pick(read, _KNOWN, warning),
        )

    return let(nodes, extract)


def _by_kind(json: Column, lists: bool, bad_warning: str) -> Column:
    """Nodes of an object text, or an empty result with the warning that fits; null for blank text. The text is read once."""
    def choose(r: Column) -> Column:
        found = _from_members(r["nodes"])
        return (
            F.when(r["kind"] == "object", F.when(r["listed"], _from_listed(r["nodes"])).otherwise(found) if lists else found)
            .when(r["kind"] == "bad", _no_nodes(F.array(F.lit(bad_warning))))
            .otherwise(_no_nodes(F.array(F.lit(fixed.W_ROOT_NOT_OBJECT))))
        )

    return F.when(~is_blank(json), let(json_nodes(json, lists), choose))


def prompt_nodes(json: Column) -> Column:
    """Nodes of a node-map JSON text as one struct of lists; unreadable text gives a warning instead."""
    return _by_kind(json, False, fixed.W_PROMPT_JSON)


def workflow_nodes(json: Column) -> Column:
    """Nodes of a workflow JSON text; a text without a ``nodes`` list is read as a node map."""
    return _by_kind(json, True, fixed.W_WORKFLOW_JSON)


def order_nodes(texts: Column, id_field: str = "node") -> Column:
    """Sort by node id: whole numbers first by value, then other ids by code point, equal ones as they come."""
    keyed = F.transform(
        texts,
        lambda x, at: F.struct(
            x[id_field].try_cast("int").isNull().alias("a"), x[id_field].try_cast("int").alias("b"), x[id_field].alias("c"), at.alias("d"), x.alias("x")
        ),
    )
    return F.transform(F.sort_array(keyed), lambda k: k["x"])


def assemble_nodes(prompt_json: Column, prompt: Column, workflow_json: Column, workflow: Column) -> Column:
    """Segment of a node map and a workflow taken together; null if neither has a usable node."""
    both = lambda name, kind: F.concat(
        F.coalesce(prompt[name], _empty(kind)), F.coalesce(workflow[name], _empty(kind))
    )
    count = lambda name: F.coalesce(prompt[name], F.lit(0)) + F.coalesce(workflow[name], F.lit(0))
    joined = F.struct(
        order_nodes(both("texts", _TEXT)).alias("texts"), both("checkpoints", "array<string>").alias("checkpoints"),
        both("vaes", "array<string>").alias("vaes"), both("loras", _LORA).alias("loras"), both("samplers", _SAMPLER).alias("samplers"),
        both("sizes", _SIZE).alias("sizes"), count("nodes").alias("nodes"), count("unrecognized").alias("unrecognized"),
        both("warnings", "array<string>").alias("warnings"),
    )

    def build(j: Column) -> Column:
        at = lambda name, i: F.get(j[name], F.lit(i))
        size, batch = at("sizes", 0)["size"], at("sizes", 0)["batch"]
        extras = F.transform(
            F.slice(j["texts"], F.lit(3), F.size(j["texts"])),
            lambda x, i: _field("raw", F.concat(F.lit("extra_prompt_"), (i + 1).cast("string")), x["text"]),
        )
        sampler = F.transform(
            F.coalesce(at("samplers", 0), _empty("array<struct<key:string,value:string>>")),
            lambda p: _field("param", p["key"], p["value"]),
        )
        fields = F.concat(
            _when_list(~is_blank(prompt_json), _field("raw", "prompt", prompt_json)),
            _when_list(~is_blank(workflow_json), _field("raw", "workflow", workflow_json)),
            extras,
            _when_list(at("checkpoints", 0).isNotNull(), _field("param", "model", at("checkpoints", 0))),
            _when_list(at("vaes", 0).isNotNull(), _field("param", "vae", at("vaes", 0))),
            sampler,
            _when_list(size.isNotNull(), _field("param", "size", size)),
            _when_list(batch.isNotNull(), _field("param", "batch_size", batch)),
        )
        resources = F.concat(
            F.transform(j["checkpoints"], lambda n: _resource("checkpoint", n)),
            F.transform(j["vaes"], lambda n: _resource("vae", n)),
            F.transform(j["loras"], lambda n: _resource("lora", n["name"], None, n["weight"])),
        )
        many = lambda name, n: F.size(j[name]) > n
        complicated = (
            (j["nodes"] > 20) | (j["unrecognized"] > 5) | many("samplers", 1) | many("checkpoints", 1) | many("texts", 2) | many("sizes", 1)
        )
        warnings = F.concat(
            j["warnings"],
            _when_list(complicated, F.lit(fixed.W_COMPLEX)),
            _when_list(many("samplers", 1), F.lit(fixed.W_MANY_SAMPLERS)),
            _when_list(many("texts", 2), F.lit(fixed.W_MANY_TEXTS)),
        )
        found = F.size(j["texts"]) + F.size(j["checkpoints"]) + F.size(j["vaes"]) + F.size(j["loras"]) + F.size(j["samplers"]) + F.size(j["sizes"])
        return F.when(
            found > 0,
            _segment(F.lit("comfyui"), _none("string"), at("texts", 0)["text"], at("texts", 1)["text"], fields, resources, warnings),
        )

    return let(joined, build)


# --- comment JSON ----------------------------------------------------------------------------------------------

_NEGATIVE_KEYS = ["uc", "undesired_content", "negative_prompt"]


def comment_segment(comment: Column, software: Column, source: Column) -> Column:
    """Segment of a comment JSON with the software and source entries; source "unknown" if not recognized."""
    def named(r: Column) -> Column:
        members = F.transform(r["members"], lambda m: m.withField("low", F.lower(m["name"])))
        return F.struct(r["kind"].alias("kind"), members.alias("members"))

    read = let(json_members(F.when(~is_blank(comment), comment)), named)
    marker = contains_marker(software, "NovelAI") | contains_marker(source, "NovelAI")

    def build(r: Column) -> Column:
        ms, kind = F.coalesce(r["members"], _empty("array<struct<name:string,scalar:string,raw:string,low:string>>")), r["kind"]
        prompts = F.filter(ms, lambda m: m["low"] == "prompt")
        negatives = F.filter(ms, lambda m: m["low"].isin(_NEGATIVE_KEYS))
        others = F.filter(ms, lambda m: ~m["low"].isin("prompt", *_NEGATIVE_KEYS))
        recognized = marker | (F.size(prompts) + F.size(negatives) > 0)
        fields = F.concat(
            _when_list(~is_blank(comment), _field("raw", "comment", comment)),
            F.transform(
                others,
                lambda m: F.when(m["scalar"].isNotNull(), _field("param", F.lower(trim_unicode(m["name"])), m["scalar"])).otherwise(
                    _field("raw", F.concat(F.lit("comment:"), m["name"]), m["raw"])
                ),
            ),
            _when_list(software.isNotNull(), _field("raw", "software", software)),
            _when_list(source.isNotNull(), _field("raw", "source", source)),
        )
        warnings = F.concat(
            _when_list(kind.isin("array", "scalar"), F.lit(fixed.W_COMMENT_NOT_OBJECT)),
            _when_list(kind == "bad", F.lit(fixed.W_COMMENT_JSON)),
            _when_list(~recognized, F.lit(fixed.W_NOT_NOVELAI)),
        )
        first_negative = F.get(F.filter(negatives, lambda m: m["scalar"].isNotNull()), F.lit(0))["scalar"]
        return _segment(
            F.when(recognized, "novelai").otherwise("unknown"),
            F.when(recognized, software),
            F.when(recognized, F.try_element_at(prompts, F.lit(-1))["scalar"]),
            F.when(recognized, first_negative),
            fields, F.array(), warnings,
        )

    return let(read, build)


# --- entries of an image ---------------------------------------------------------------------------------------


def split_warnings(meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metadata entries, and the reader's own warning entries."""
    is_warning = F.col("key").startswith("Warning/")
    return meta.filter(~is_warning), meta.filter(is_warning & (F.coalesce(F.col("value"), F.lit("")) != ""))


def classify_entries(entries: DataFrame) -> DataFrame:
    """Flag what each entry can be: parameter text, node map, workflow, comment, software, source."""
    v, tag = F.col("value"), F.col("tag")
    df = entries.withColumn("tag", tag_of_key(F.col("key")))
    df = df.withColumn("json_failed", looks_like_json(v) & ~json_is_valid(v))
    return df.select(
        *entries.columns, "tag", "json_failed",
        ((tag == "parameters") | v.contains(fixed.NEGATIVE_MARKER) | v.contains(fixed.TAIL_MARKER)).alias("is_a1111"),
        (~F.col("json_failed") & ((tag == "prompt") | v.contains("class_type"))).alias("is_prompt"),
        (~F.col("json_failed") & ((tag == "workflow") | v.contains('"nodes"'))).alias("is_workflow"),
        tag.isin(fixed.COMMENT_TAGS).alias("is_comment"),
        (tag == "software").alias("is_software"),
        (tag == "source").alias("is_source"),
    )


def _present(df: DataFrame, phase: int | Column, key: str | Column, segment: Column) -> DataFrame:
    """Rows ``image_id, phase, seg_key, segment`` where the segment is not null, computing it once."""
    key = F.col(key) if isinstance(key, str) else key
    phase = phase if isinstance(phase, Column) else F.lit(phase)
    rows = unnest(
        df, ["image_id", phase.alias("phase"), key.alias("seg_key")],
        F.filter(F.array(segment), lambda s: s.isNotNull()), "at", "segment",
    )
    return rows.drop("at")


def parse_segments(classified: DataFrame) -> DataFrame:
    """``image_id, phase, seg_key, segment``: every recognized source of every image.

    Phase 0: parameter texts by key. 1: first node map with first workflow. 2 and 3: further node
    maps and workflows, only where phase 1 found nothing. 4: comment. 8: the unrecognized comment.
    """
    a1111 = parse_a1111(classified.filter("is_a1111"))
    texts = _present(a1111, 0, "key", F.col("segment"))

    # one pair per image first: the first node map with the first workflow
    entry = F.struct("key", "value")
    first = lambda flag: F.min_by(F.when(F.col(flag), entry), F.when(F.col(flag), F.col("key")))
    candidates = classified.filter("is_prompt or is_workflow")
    per_image = candidates.groupBy("image_id").agg(
        first("is_prompt").alias("p"), first("is_workflow").alias("w"),
        ((F.count_if("is_prompt") > 1) | (F.count_if("is_workflow") > 1)).alias("several"),
    )
    pairs = per_image.select(
        "image_id", F.lit(1).alias("phase"), F.lit("").alias("seg_key"), F.col("p.value").alias("prompt"), F.col("w.value").alias("workflow")
    )
    # entries of the few images with several candidates are tried alone as well
    several = per_image.filter("several").select("image_id")
    alone = candidates.join(several, "image_id", "left_semi").select(
        "image_id", "key",
        F.explode(F.array(
            F.struct(F.lit(2).alias("phase"), F.when(F.col("is_prompt"), F.col("value")).alias("prompt"), _none("string").alias("workflow")),
            F.struct(F.lit(3).alias("phase"), _none("string").alias("prompt"), F.when(F.col("is_workflow"), F.col("value")).alias("workflow")),
        )).alias("c"),
    ).select("image_id", "c.phase", F.col("key").alias("seg_key"), "c.prompt", "c.workflow")
    nodes = pairs.unionByName(alone).select(
        "*", prompt_nodes(F.col("prompt")).alias("p"), workflow_nodes(F.col("workflow")).alias("w")
    )
    found = _present(
        nodes, F.col("phase"), "seg_key", assemble_nodes(F.col("prompt"), F.col("p"), F.col("workflow"), F.col("w"))
    )
    # if the first pair gave anything, nothing else counts; if not, the first entries alone gave nothing either
    settled = found.filter("phase = 1").select("image_id")
    later = found.filter("phase > 1").join(settled, "image_id", "left_anti")
    combined = found.filter("phase = 1")

    first_of = lambda flag: F.min_by(F.when(F.col(flag), F.col("value")), F.when(F.col(flag), F.col("key")))
    comments = classified.filter("is_comment or is_software or is_source").groupBy("image_id").agg(
        first_of("is_comment").alias("comment"), first_of("is_software").alias("software"), first_of("is_source").alias("source")
    )
    comment = _present(comments, 4, F.lit(""), comment_segment(F.col("comment"), F.col("software"), F.col("source")))
    comment = comment.withColumn("phase", F.when(F.col("segment.source") == "novelai", 4).otherwise(8))
    return texts.unionByName(combined).unionByName(later).unionByName(comment)


# --- merging ---------------------------------------------------------------------------------------------------


def merge_header(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """One row per image with entries: source, version and prompts of the first segment that has them."""
    used = segments.filter("phase < 8").select(
        "image_id", F.struct("phase", "seg_key").alias("ord"), "segment.source", "segment.version", "segment.positive", "segment.negative"
    )
    nothing = _none("string")
    base = entries.select(
        "image_id", F.struct(F.lit(9).alias("phase"), F.lit("").alias("seg_key")).alias("ord"), F.lit("unknown").alias("source"),
        nothing.alias("version"), nothing.alias("positive"), nothing.alias("negative"),
    ).distinct()
    first = lambda col, ok: F.min_by(F.when(ok, F.col(col)), F.when(ok, F.col("ord"))).alias(col)
    return used.unionByName(base).groupBy("image_id").agg(
        F.min_by("source", "ord").alias("source"),
        first("version", F.coalesce(F.col("version"), F.lit("")) != ""),
        first("positive", ~is_blank(F.col("positive"))),
        first("negative", ~is_blank(F.col("negative"))),
        F.size(F.collect_set(F.when(F.col("ord.phase") < 8, F.col("source")))).alias("sources"),
    )


def _first_wins(rows: DataFrame) -> DataFrame:
    return rows.groupBy("image_id", "key").agg(F.min_by("value", "ord").alias("value"))


def _field_rows(segments: DataFrame, target: str) -> DataFrame:
    """Fields of all used segments; earlier segments win, inside a segment the last assignment does."""
    rows = unnest(segments.filter("phase < 8"), ["image_id", "phase", "seg_key"], "segment.fields", "at", "f")
    return rows.filter(F.col("f.target") == target).select(
        "image_id", "f.key", "f.value", F.struct("phase", "seg_key", (-F.col("at")).alias("at")).alias("ord")
    )


def merge_parameters(segments: DataFrame) -> DataFrame:
    return _first_wins(_field_rows(segments, "param"))


def merge_raw_entries(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """Raw texts of the segments, then all entries under their own keys; without a segment the entries alone."""
    own = entries.select(
        "image_id", "key", "value", F.struct(F.lit(9).alias("phase"), F.lit("").alias("seg_key"), F.lit(0).alias("at")).alias("ord")
    )
    return _first_wins(_field_rows(segments, "raw").unionByName(own))


def resource_rows(segments: DataFrame) -> DataFrame:
    rows = unnest(segments.filter("phase < 8"), ["image_id", "phase", "seg_key"], "segment.resources", "at", "r")
    return rows.select("image_id", "phase", "seg_key", "at", "r.*")


def distinct_resources(resources: DataFrame) -> DataFrame:
    """Each (kind, name, hash, weight) of an image once; ``ord`` is where it was first seen."""
    return resources.groupBy("image_id", "kind", "name", "hash", "weight").agg(F.min(F.struct("phase", "seg_key", "at")).alias("ord"))


def warning_rows(reader_warnings: DataFrame, classified: DataFrame, segments: DataFrame, header: DataFrame) -> DataFrame:
    """``image_id, stage, seg_key, at, warning`` in the order the texts are shown."""
    number = F.regexp_extract("key", r"^Warning/(\d+)$", 1).try_cast("int")
    read = reader_warnings.select("image_id", F.lit(-2).alias("stage"), F.lit("").alias("seg_key"), F.coalesce(number, F.lit(0)).alias("at"), F.col("value").alias("warning"))
    failed = classified.filter("json_failed").select(
        "image_id", F.lit(-1).alias("stage"), F.col("key").alias("seg_key"), F.lit(0).alias("at"), _message(fixed.W_JSON_FAILED, F.col("key")).alias("warning")
    )
    parsed = unnest(segments, ["image_id", F.col("phase").alias("stage"), "seg_key"], "segment.warnings", "at", "warning")
    unknown = header.filter("source = 'unknown'").select("image_id")
    shown = parsed.filter("stage < 8").unionByName(parsed.filter("stage = 8").join(unknown, "image_id", "left_semi"))
    closing = header.select(
        "image_id", F.lit(9).alias("stage"), F.lit("").alias("seg_key"), F.lit(0).alias("at"),
        F.when(F.col("source") == "unknown", fixed.W_UNSUPPORTED).when(F.col("sources") > 1, fixed.W_MULTI_SOURCE).alias("warning"),
    ).filter("warning is not null")
    return read.unionByName(failed).unionByName(shown).unionByName(closing)


# --- limits ----------------------------------------------------------------------------------------------------


def truncate_fields(rows: DataFrame, units: int | None = None, column: str = "value") -> DataFrame:
    """Cut values of more than ``units`` and flag them in ``was_cut``; without ``units`` nothing is cut."""
    if units is None:
        return rows.withColumn("was_cut", F.lit(False))
    flagged = rows.withColumn("was_cut", F.coalesce(utf16_length(F.col(column)) > units, F.lit(False)))
    return flagged.withColumn(column, left_utf16(F.col(column), units))


@dataclass(frozen=True)
class GenerationInfo:
    """Merged metadata of all images as five tables."""

    header: DataFrame
    parameters: DataFrame
    raw_entries: DataFrame
    resources: DataFrame
    warnings: DataFrame


def enforce_limits(info: GenerationInfo, field_units: int | None = None, total_units: int | None = None) -> GenerationInfo:
    """Cut fields, drop raw entries over the total, and say so in the warnings. A limit that is not given does not apply.

    ``fixed.MAX_FIELD_UNITS`` and ``fixed.MAX_TOTAL_UNITS`` are the usual ones.
    """
    parameters, raw = truncate_fields(info.parameters, field_units), truncate_fields(info.raw_entries, field_units)
    sized = raw.drop("was_cut")
    dropped = materialize(sized.select("image_id", "key").limit(0) if total_units is None else over_budget(sized, total_units), "over-budget")
    header = truncate_fields(info.header, field_units, "positive").withColumnRenamed("was_cut", "positive_cut")
    header = truncate_fields(header, field_units, "negative").withColumnRenamed("was_cut", "negative_cut")

    cut = lambda df, stage, key, label: df.select(
        "image_id", F.lit(stage).alias("stage"), key.alias("seg_key"), F.lit(0).alias("at"), _message(fixed.W_FIELD_CUT, label, F.lit(limit_text(field_units or 0))).alias("warning")
    )
    k = F.col("key")
    lost = dropped.groupBy("image_id").agg(F.count(F.lit(1)).alias("lost"))
    kept = raw.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).join(lost, "image_id")
    budget = kept.select(
        "image_id", F.lit(12).alias("stage"), F.lit("").alias("seg_key"), F.lit(0).alias("at"),
        _message(fixed.W_BUDGET, F.lit(limit_text(total_units or 0)), (F.col("n") - F.col("lost")).cast("string")).alias("warning"),
    )
    warnings = (
        info.warnings
        .unionByName(cut(parameters.filter("was_cut"), 10, k, F.format_string(fixed.L_PARAMETER, k)))
        .unionByName(cut(raw.filter("was_cut"), 11, k, k))
        .unionByName(budget)
        .unionByName(cut(header.filter("positive_cut"), 13, F.lit(""), F.lit(fixed.L_POSITIVE)))
        .unionByName(cut(header.filter("negative_cut"), 14, F.lit(""), F.lit(fixed.L_NEGATIVE)))
    )
    return GenerationInfo(
        header.drop("positive_cut", "negative_cut"), parameters.drop("was_cut"),
        raw.drop("was_cut").join(dropped, ["image_id", "key"], "left_anti"), info.resources, warnings,
    )


def merge_segments(meta: DataFrame, segments: DataFrame) -> GenerationInfo:
    """Classify and merge, without limits; nothing runs yet.

    All five results read ``segments``: rows of ``parse_segments(classify_entries(...))``. A caller that uses more than one result
    writes them first, as ``written_segments`` does, so that the texts are parsed once.
    """
    entries, reader_warnings = split_warnings(meta)
    header = merge_header(entries, segments)
    return GenerationInfo(
        header, merge_parameters(segments), merge_raw_entries(entries, segments),
        distinct_resources(resource_rows(segments)), warning_rows(reader_warnings, classify_entries(entries), segments, header),
    )


def segments_of(meta: DataFrame) -> DataFrame:
    """Parsed segments of all entries, as a plan."""
    return parse_segments(classify_entries(split_warnings(meta)[0]))


def written_segments(meta: DataFrame) -> DataFrame:
    """``segments_of`` written to the shared folder and read back: runs a job. The folder is the caller's to remove."""
    return materialize(segments_of(meta), "segments")


def generation_info(meta: DataFrame, field_units: int | None = None, total_units: int | None = None) -> GenerationInfo:
    """Merged metadata of every image that has any entry, within the limits given. Writes the segments and the raw entries first."""
    info = merge_segments(meta, written_segments(meta))
    raw = materialize(info.raw_entries, "raw-entries")
    return enforce_limits(replace(info, raw_entries=raw), field_units, total_units)


def unknown_fallback(info: GenerationInfo) -> DataFrame:
    """Images with entries but no recognized source, with their raw entries."""
    unknown = info.header.filter("source = 'unknown'").select("image_id", "source")
    return info.raw_entries.join(unknown, "image_id")


def raw_text(raw_entries: DataFrame) -> DataFrame:
    """``key: value`` lines sorted by key, one text per image. Apply it to limited entries: they bound the text."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("key", "value"))), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return raw_entries.groupBy("image_id").agg(F.regexp_replace(F.array_join(lines, "\n"), "(?<!\n)\n+$", "").alias("raw_text"))


def source_badge(source: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(fixed.SOURCE_BADGES), source), F.lit(fixed.UNKNOWN_BADGE))

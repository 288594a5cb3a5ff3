"""JSON kept as text: read once per entry, with repeated names, kinds and the spelling of numbers.

Spark's JSON reader re-spells numbers, forgets whether a value was a string and refuses repeated member names. ``read_json`` reads a text
once, in Arrow batches, says what it is and writes it again with marks: strings get an ``s`` in front, numbers become strings
with an ``n`` in front. After ``from_json(..., map<string,string>)`` the first character of a value tells its kind and the rest is the original
spelling. Of repeated member names the last counts. No character is reserved.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, functions as F

from tagloom import fixed

__all__ = [
    "looks_like_json", "read_json", "json_members", "json_nodes", "json_is_valid", "marked_object", "marked_string", "marked_scalar",
    "marked_is_object", "marked_is_array",
]


class _Number(str):
    """A number as it was spelled."""


def _refuse(name: str):
    raise ValueError(name)


def _depth(value) -> int:
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else None
    return 0 if inner is None else 1 + max(map(_depth, inner), default=0)


def _parsed(text: str, limit: int) -> tuple[str, object]:
    """``object``, ``array``, ``scalar`` or ``bad``, and the value."""
    try:
        value = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_refuse)
        if _depth(value) > limit:
            return "bad", None
    except (ValueError, RecursionError):
        return "bad", None
    return "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "scalar", value


def _written(value, marks: bool) -> str:
    """Compact JSON of a value, with or without marks."""
    if isinstance(value, _Number):
        return f'"n{value}"' if marks else str(value)
    if isinstance(value, str):
        return json.dumps("s" + value if marks else value, ensure_ascii=False)
    if isinstance(value, dict):
        return "{" + ",".join(f"{_written(str(k), marks)}:{_written(v, marks)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(_written(v, marks) for v in value) + "]"
    return "null" if value is None else "true" if value else "false"


def _clean(text: str) -> str:
    """Half surrogate pairs, which escapes can spell, cannot be written as UTF-8."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in text) else text


PIECE = 500  # texts whose Python objects exist at once


def _udf(read: Callable[[pa.Array], pa.Array], kind: str):
    """``read`` as a column function that takes PIECE texts after another: the objects of a text take many times the room of its Arrow values."""

    @F.arrow_udf(kind)
    def column(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([read(texts.slice(at, PIECE)) for at in range(0, max(1, len(texts)), PIECE)])

    return column


@cache
def _reader(limit: int):
    def read(texts: pa.Array) -> pa.Array:
        kinds, marked = [], []
        for text in texts.to_pylist():
            kind, value = (None, None) if text is None else _parsed(text, limit)
            kinds.append(kind)
            marked.append(_clean(_written(value, True)) if kind in ("object", "array") else None)
        return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(marked, pa.string())], ["kind", "marked"])

    return _udf(read, "struct<kind:string,marked:string>")


_MEMBER = pa.struct([("name", pa.string()), ("scalar", pa.string()), ("raw", pa.string())])


def _scalar(value) -> str | None:
    return ("true" if value else "false") if isinstance(value, bool) else _clean(str(value)) if isinstance(value, str) else None


@cache
def _member_reader(limit: int):
    def read(texts: pa.Array) -> pa.Array:
        kinds, members = [], []
        for text in texts.to_pylist():
            kind, value = (None, None) if text is None else _parsed(text, limit)
            kinds.append(kind)
            members.append([{"name": _clean(n), "scalar": _scalar(v), "raw": _clean(_written(v, False))} for n, v in value.items()] if kind == "object" else [])
        return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(members, pa.list_(_MEMBER))], ["kind", "members"])

    return _udf(read, "struct<kind:string,members:array<struct<name:string,scalar:string,raw:string>>>")


_NODE = pa.struct([("id", pa.string()), ("type", pa.string()), ("inputs", pa.map_(pa.string(), pa.string())), ("widgets", pa.list_(pa.string()))])


def _mark(value) -> str | None:
    """A scalar as ``read_json`` marks it; None for null, objects and lists."""
    if isinstance(value, bool):
        return "true" if value else "false"
    return _clean(("n" if isinstance(value, _Number) else "s") + value) if isinstance(value, str) else None


def _node(item: dict, name: str) -> dict:
    text = lambda v: _clean(v) if isinstance(v, str) and not isinstance(v, _Number) else None
    kind, inputs, widgets = text(item.get("class_type")), item.get("inputs"), item.get("widgets_values")
    return {
        "id": _clean(name), "type": text(item.get("type")) if kind is None else kind,
        "inputs": list({_clean(k): _mark(v) for k, v in inputs.items()}.items()) if isinstance(inputs, dict) else None,
        "widgets": [_mark(v) for v in widgets] if isinstance(widgets, list) else None,
    }


def _listed(at: int, item: dict) -> dict:
    own, kind = _scalar(item.get("id")), item.get("type")
    node = _node(item, str(at + 1) if own is None else own)
    return node | {"type": _clean(kind)} if isinstance(kind, str) and not isinstance(kind, _Number) else node


def _nodes_of(value: dict, lists: bool) -> tuple[bool, list[dict]]:
    items = value.get("nodes") if lists else None
    if isinstance(items, list):
        return True, [_listed(at, item) for at, item in enumerate(items) if isinstance(item, dict)]
    return False, [_node(item, name) for name, item in value.items() if isinstance(item, dict)]


@cache
def _node_reader(lists: bool, limit: int):
    def read(texts: pa.Array) -> pa.Array:
        kinds, listed, nodes = [], [], []
        for text in texts.to_pylist():
            kind, value = (None, None) if text is None else _parsed(text, limit)
            is_list, found = _nodes_of(value, lists) if kind == "object" else (False, [])
            kinds.append(kind)
            listed.append(is_list)
            nodes.append(found)
        return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(listed, pa.bool_()), pa.array(nodes, pa.list_(_NODE))], ["kind", "listed", "nodes"])

    return _udf(read, "struct<kind:string,listed:boolean,nodes:array<struct<id:string,type:string,inputs:map<string,string>,widgets:array<string>>>>")


@cache
def _kind_reader(limit: int):
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([None if text is None else _parsed(text, limit)[0] for text in texts.to_pylist()], pa.string())

    return _udf(read, "string")


def looks_like_json(s: Column) -> Column:
    return s.rlike(r"(?U)^\s*[\{\[]")


def read_json(s: Column, limit: int = fixed.MAX_JSON_DEPTH) -> Column:
    """``kind`` (object, array, scalar; bad if it does not parse or nests deeper than ``limit``; null for null) and the ``marked`` text of objects and arrays."""
    return _reader(limit)(s)


def json_members(s: Column, limit: int = fixed.MAX_JSON_DEPTH) -> Column:
    """``kind`` as in ``read_json`` and the members of an object in text order: name, ``scalar`` (string, number as spelled, true or false), ``raw`` (compact JSON)."""
    return _member_reader(limit)(s)


def json_nodes(s: Column, lists: bool, limit: int = fixed.MAX_JSON_DEPTH) -> Column:
    """``kind`` as in ``read_json`` and the ``nodes`` of an object, typed: id, type, inputs and widgets with marked scalars, null for other values.

    Nodes are the members that are objects; with ``lists`` those of a member ``nodes`` that is a list, where there is one, and ``listed`` says so.
    """
    return _node_reader(lists, limit)(s)


def json_is_valid(s: Column, limit: int = fixed.MAX_JSON_DEPTH) -> Column:
    """An object or array that parses, is not too deep and has nothing after it. Texts that do not look like one are not read."""
    return F.coalesce(_kind_reader(limit)(F.when(looks_like_json(s), s)).isin("object", "array"), F.lit(False))


def marked_object(marked: Column) -> Column:
    """Members of a marked JSON object in text order; member names still carry their ``s``."""
    return F.from_json(marked, "map<string,string>")


def marked_string(v: Column) -> Column:
    return F.when(v.startswith("s"), F.substring(v, 2, 2**31 - 1))


def marked_scalar(v: Column) -> Column:
    """String, raw number text, ``true`` or ``false``; null for null, objects and arrays."""
    return F.when(v.startswith("s") | v.startswith("n"), F.substring(v, 2, 2**31 - 1)).when(v.isin("true", "false"), v)


def marked_is_object(v: Column) -> Column:
    return v.startswith("{")


def marked_is_array(v: Column) -> Column:
    return v.startswith("[")

"""Text: lengths in UTF-16 units, trimming, tag spelling, key spelling, top-level splitting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagloom import fixed

__all__ = [
    "utf16_length", "left_utf16", "trim_unicode", "is_blank", "is_emoticon", "underscore_to_space", "escape_parens",
    "weighted_text", "tag_of_key", "suffix_key", "combine_strengths", "size_text", "contains_marker",
    "split_top_level", "literal_map", "file_name_of", "template", "limit_text",
]


def literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def template(pattern: str, *args: Column) -> Column:
    return F.format_string(pattern, *args)


def utf16_length(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16LE")) / 2).cast("int")


def left_utf16(s: Column, units: int) -> Column:
    """First ``units`` UTF-16 units; a surrogate pair that would be cut in half is left out."""
    raw = F.encode(s, "UTF-16LE")
    last_high_byte = F.hex(F.substring(raw, 2 * units, 1))
    keep = F.when(last_high_byte.between("D8", "DB"), F.lit(2 * units - 2)).otherwise(F.lit(2 * units))
    return F.when(F.length(s) * 2 <= units, s).when(utf16_length(s) <= units, s).otherwise(
        F.decode(F.substring(raw, F.lit(1), keep), "UTF-16LE")
    )


def trim_unicode(s: Column) -> Column:
    """Trim every kind of Unicode white space. The look-behind keeps long inner runs linear."""
    return F.regexp_replace(s, r"(?U)^\s+|(?<!\s)\s+$", "")


def is_blank(s: Column) -> Column:
    return s.isNull() | ~s.rlike(r"(?U)\S")


def is_emoticon(s: Column) -> Column:
    """Holds a symbol of the basic plane, or is 2..8 characters of the emoticon set only."""
    chars = "".join("\\" + c if c in "[]()^-" else c for c in fixed.EMOTICON_CHARS)
    return s.rlike(r"[\x{0}-\x{FFFF}&&[\p{So}\p{Sm}]]") | s.rlike(f"^[{chars}]{{2,8}}$")


def underscore_to_space(s: Column) -> Column:
    textual = s.rlike(r"[\x{0}-\x{FFFF}&&[\p{L}\p{Nd}]]")
    return F.when(s.contains("_") & textual & ~is_emoticon(s), F.translate(s, "_", " ")).otherwise(s)


def escape_parens(s: Column) -> Column:
    return F.regexp_replace(s, r"([()])", r"\\$1")


def weighted_text(s: Column, weight: Column) -> Column:
    return F.when(weight == 1.0, s).otherwise(template("(%s:%.2f)", s, weight))


def tag_of_key(key: Column) -> Column:
    """Tag part of a ``directory/tag`` or ``directory/kind:name`` key, without case, blanks, ``_``, ``-``."""
    tail = F.regexp_extract(F.regexp_extract(key, r"([^/]*)$", 1), r"([^:]*)$", 1)
    return F.regexp_replace(F.lower(trim_unicode(tail)), "[ _-]", "")


def suffix_key(raw: Column, prefix: str) -> Column:
    """Field name after a family prefix as an identifier part: ``Hires upscale`` -> ``upscale``."""
    rest = trim_unicode(F.substring(trim_unicode(raw), len(prefix) + 1, 2**31 - 1))
    return F.regexp_replace(F.translate(F.lower(rest), " -/", "___"), "^_+|(?<!_)_+$", "")


def combine_strengths(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull() | (a == b), a).otherwise(F.concat(a, F.lit("/"), b))


def size_text(width: Column, height: Column) -> Column:
    return F.concat(width, F.lit("x"), height)


def contains_marker(s: Column, marker: str) -> Column:
    return F.coalesce(F.upper(s).contains(marker.upper()), F.lit(False))


def file_name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


_SPECIAL = r"""['"(){},\[\]]"""


def split_top_level(s: Column) -> Column:
    """Split on commas outside quotes and brackets; parts trimmed, empty parts dropped.

    The text is first cut into special characters and the runs between them, so the fold takes one
    step per special character, keeps six small values and only remembers where to cut.
    """
    tokens = F.split(s, f"(?<={_SPECIAL})|(?={_SPECIAL})")

    def depth(level: Column, token: Column, opening: str, closing: str) -> Column:
        return F.when(token == opening, level + 1).when(token == closing, F.greatest(level - 1, F.lit(0))).otherwise(level)

    def step(st: Column, token: Column) -> Column:
        quoted = st["single"] | st["double"]
        at_cut = (token == ",") & ~quoted & (st["round"] + st["square"] + st["curly"] == 0)
        return F.struct(
            F.when((token == "'") & ~st["double"], ~st["single"]).otherwise(st["single"]).alias("single"),
            F.when((token == '"') & ~st["single"], ~st["double"]).otherwise(st["double"]).alias("double"),
            F.when(quoted, st["round"]).otherwise(depth(st["round"], token, "(", ")")).alias("round"),
            F.when(quoted, st["square"]).otherwise(depth(st["square"], token, "[", "]")).alias("square"),
            F.when(quoted, st["curly"]).otherwise(depth(st["curly"], token, "{", "}")).alias("curly"),
            (st["at"] + 1).alias("at"),
            F.when(at_cut, F.array_append(st["cuts"], st["at"] + 1)).otherwise(st["cuts"]).alias("cuts"),
        )

    start = F.struct(
        F.lit(False).alias("single"), F.lit(False).alias("double"),
        F.lit(0).alias("round"), F.lit(0).alias("square"), F.lit(0).alias("curly"),
        F.lit(0).alias("at"), F.array(F.lit(0)).alias("cuts"),
    )
    cuts = F.aggregate(tokens, start, step, lambda st: F.array_append(st["cuts"], st["at"] + 1))
    # bind (tokens, cuts) once, then slice between neighbouring cuts
    bound = F.array(F.struct(tokens.alias("tokens"), cuts.alias("cuts")))
    parts = F.transform(
        bound,
        lambda b: F.transform(
            F.sequence(F.lit(1), F.size(b["cuts"]) - 1),
            lambda i: trim_unicode(
                F.array_join(
                    F.slice(
                        b["tokens"],
                        F.element_at(b["cuts"], i) + 1,
                        F.element_at(b["cuts"], i + 1) - F.element_at(b["cuts"], i) - 1,
                    ),
                    "",
                )
            ),
        ),
    )
    return F.filter(F.flatten(parts), lambda x: x != "")


def limit_text(units: int) -> str:
    """A limit as it is named in warnings: whole MiB or KiB, else the number."""
    for size, name in ((1 << 20, "MiB"), (1 << 10, "KiB")):
        if units and units % size == 0:
            return f"{units // size}{name}"
    return str(units)

"""Chat formatting from event logs.

A log row is ``(conv_id, seq, message, kind, role, text)``. The kinds: ``delta`` appends to a message, ``edit`` replaces what it holds,
``regenerate`` empties it. Logs are folded per message, not per conversation, so a conversation of any length is spread over tasks; a conversation's
text is the concatenation of its rendered messages in the order of their first events.

Template: ``<|im_start|>role`` newline ``text<|im_end|>`` newline. Inside roles and texts ``\\`` becomes ``\\\\`` and ``<|`` becomes
``<\\|``, so no control string can occur there and reading back is exact; a newline in a role becomes ``\\n``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>"
_PIECE = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, message, first_seq, role, text: the final messages.

    Events apply by ascending seq (equal ones: edits and regenerations first, then by text). The role is that of the first event that has one. Null
    text is empty; unknown kinds count as ``delta``. Null conversation ids form one conversation.
    """
    step = F.struct("seq", F.when(F.col("kind") == "regenerate", 0).when(F.col("kind") == "edit", 1).otherwise(2).alias("rank"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = events.groupBy("conv_id", "message").agg(
        F.min("seq").alias("first_seq"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("first_role"),
        F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.struct("seq", F.when(F.col("kind") == "regenerate", 0).otherwise(1).alias("rank")))).alias("reset"),
        F.array_sort(F.collect_list(step)).alias("steps"),
    )
    lasting = F.filter("steps", lambda s: F.col("reset").isNull() | (F.struct(s["seq"], s["rank"]) >= F.col("reset")))
    text = F.array_join(F.transform(lasting, lambda s: F.when(s["rank"] > 0, s["text"]).otherwise("")), "")
    return gathered.select("conv_id", "message", "first_seq", F.coalesce("first_role.role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, first_seq, message, piece, loss_start, loss_end: each message's part of the formatted text, and which code points of it carry loss.

    ``loss_start = loss_end`` where the role is not learned.
    """
    head = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    body = escaped(F.col("text"))
    begin = F.length(head)
    return messages.select(
        "conv_id", "first_seq", "message", F.concat(head, body, F.lit(END + "\n")).alias("piece"), begin.alias("loss_start"),
        (begin + F.when(F.col("role").isin(*learned), F.length(body)).otherwise(0)).alias("loss_end"),
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation: one pass that holds nothing but running digests."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    state, out, begun = None, [], False

    def close():
        out.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

    def batch_of(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for conv, piece, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end"))):
            if not begun or conv != state[0]:
                if begun:
                    close()
                begun, state = True, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = (unescaped(part) for part in _PIECE.fullmatch(piece).groups())
            learned = unescaped(piece[a:b])
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            state[3] += len(learned)
            state[4].update(learned.encode())
            state[5] += len(piece)
        if len(out) >= 4096:
            yield batch_of(out)
            out = []
    if begun:
        close()
    if out:
        yield batch_of(out)


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation what reading the formatted text back gives; a long conversation streams through its task."""
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "first_seq", "message")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select("conv_id", "piece", "loss_start", "loss_end").mapInArrow(_digests, schema)


def as_events(turns: DataFrame) -> DataFrame:
    """A log that streams each row of ``turns (conv_id, turn, role, text)`` as its message.

    Rows are ordered by turn (nulls last), then role and text; every message arrives as a draft, a regeneration, two deltas, and for every third message an edit.
    """
    order = Window.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    known = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    placed = known.withColumn("copy", F.row_number().over(order)).withColumn("half", F.floor(F.length("text") / 2).cast("int"))
    place = F.struct(F.col("turn").isNull().alias("none"), "turn", "copy")
    step = lambda n, kind, text: F.struct(F.struct(place.alias("place"), F.lit(n).alias("step")).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    rest = F.substr(F.col("text"), F.col("half") + 1)
    steps = [
        step(0, "delta", F.col("role")), step(1, "regenerate", F.lit("")),
        step(2, "delta", F.when(F.pmod("turn", F.lit(3)) == 2, F.lit("draft")).otherwise(F.substr(F.col("text"), F.lit(1), F.col("half")))),
        step(3, "delta", F.when(F.pmod("turn", F.lit(3)) == 2, F.lit("")).otherwise(rest)),
    ]
    edit = F.when(F.pmod("turn", F.lit(3)) == 2, F.array(step(4, "edit", F.col("text")))).otherwise(F.array())
    log = placed.select("conv_id", place.alias("message"), "role", F.explode(F.concat(F.array(*steps), edit)).alias("e"))
    return log.select("conv_id", "e.seq", "message", "e.kind", "role", "e.text")


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
clean AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, coalesce(text, '') AS t FROM turns),
sizes AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 24 AS chars
  FROM clean)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, r NULLS LAST, t)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, r NULLS LAST, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sizes GROUP BY conv_id
"""

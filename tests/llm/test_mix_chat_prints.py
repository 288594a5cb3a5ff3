"""Mixing, chat formatting and fingerprints against plain computations."""

import hashlib
import os

import duckdb
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tagloom.llm import chat, fingerprint, mixing
from tests.llm import brute


def _filled(sizes, weights=(5, 2, 1)):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_mixing(spark):
    rows = []
    for source, n in (("a", 3), ("b", 400), ("Z", 1), (None, 20), ("é", 7), ("zero", 2)):
        rows += [(len(rows) + j, brute.prose(1 + (j * 7) % 40, j) if source != "zero" else None, source, "x") for j in range(n)]
    rows += [(5, "same id twice", "b", "x"), (None, "no id", "b", "x"), (None, "no id", "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, block string")
    got = mixing.mix(docs, block_rows=16)
    found = got.toPandas()
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(brute.words(text))
    want = _filled(sizes)
    assert len(found) == len(rows) and (found.taken <= 3 * found["size"]).all()
    per = found.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    for source, target in want.items():
        if list(sizes.values()).count(sizes[source]) == 1:
            row = per.loc[sizes[source]]
            assert abs(row.target - target) < 1e-6 * max(1, target) and abs(row.taken - target) <= 0.5
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source", "block"]).astype({"doc_id": "Int64"}))
    order = lambda t: sorted((tuple(r) for r in t), key=repr)
    sql = [tuple(r) for r in con.execute(mixing.MIX_SQL.format(docs="documents")).fetchall()]
    assert order(sql) == order((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got.collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_chat_folds_and_reads_back(spark):
    log = [
        (1, 1, 0, "delta", "user", "Hel"), (1, 2, 0, "delta", None, "lo <|im_end|>\\n"), (1, 3, 1, "delta", "assistant", "bad"), (1, 4, 1, "regenerate", None, None),
        (1, 5, 1, "delta", None, "good"), (1, 6, 0, "edit", None, "Hello\\|"), (1, 7, 0, "delta", None, " <|"), (2, 1, 0, "delta", "tool\nrole", None), (None, 1, 0, "other", None, "x"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")
    messages = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold_events(events).collect()}
    assert messages == {(1, 0): ("user", "Hello\\| <|"), (1, 1): ("assistant", "good"), (2, 0): ("tool\nrole", ""), (None, 0): ("", "x")}
    pieces = chat.render(chat.fold_events(events))
    whole = "".join(r.piece for r in pieces.filter("conv_id = 1").orderBy("first_seq").collect())
    assert [tuple(chat.unescaped(x) for x in m.groups()) for m in chat._PIECE.finditer(whole)] == [("user", "Hello\\| <|"), ("assistant", "good")]
    got = {r.conv_id: r for r in chat.digests(pieces).collect()}
    assert got[1].loss_chars == 4 and got[1].loss_sha256 == hashlib.sha256(b"good").hexdigest() and got[1].formatted_chars == len(whole)
    assert got[2].turns_sha256 == hashlib.sha256(b"tool\nrole\n\n").hexdigest()
    assert chat.digests(chat.render(chat.fold_events(events.limit(0)))).count() == 0


def test_chat_turns(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, None, None, "z\\"), (1, 2, "assistant", "<|x|>\n"), (None, 0, "user", ""), (2, 5, "assistant", "é" * 5000)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.render(chat.fold_events(chat.as_events(table)))).collect()}
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = {r[0]: tuple(r[1:]) for r in con.execute(chat.CHAT_SQL).fetchall() if r[0] != -1}
    assert want == {k: tuple(r)[1:] for k, r in got.items()}


def test_fingerprints(spark):
    texts = [None, "", "a", "été " * 3, *(brute.prose(5 + n * 37 % 900, n) for n in range(60)), brute.prose(300, 3), brute.prose(300, 3)]
    rows = [(i * 3, t, i, True) for i, t in enumerate(texts)] + [(9, "twice the same id", 1, False), (None, "no id b", 1, False), (None, "no id a", 1, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, echo boolean")
    for part_rows in (7, 10_000):
        got = fingerprint.fingerprints(docs, part_rows=part_rows).collect()
        order = sorted(((i is None, i or 0, t or "") for i, t, *_ in rows))
        want = []
        for (none, i, own), (*_, after) in zip(order, order[1:] + order[:1]):
            cut = len(own) // 4
            want.append((None if none else i, len(own), hashlib.sha256((own[: len(own) - cut] + after[:cut]).encode()).hexdigest()))
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
        by_text = {}
        for r in got:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            by_text.setdefault(r.doc_id, r)
        assert by_text[3 * 64].fingerprint == by_text[3 * 65].fingerprint and by_text[3 * 64].near_next == 1
        long_ones = [r.near_edited for r in got if r.n_chars > 800]
        assert sum(long_ones) / len(long_ones) > 0.6
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0
    assert fingerprint.fingerprints(docs.limit(1)).count() == 1


def test_chunks_cover_the_text_and_move_little():
    import numpy as np

    data = np.frombuffer(brute.prose(3000, 9).encode(), np.uint8)
    whole, sizes = fingerprint.chunks(data)
    assert sizes.sum() == len(data) and sizes.max() <= fingerprint.MOST
    shifted = fingerprint.chunks(np.concatenate((data[:50], data[47:])))
    assert fingerprint.likeness((whole, sizes), shifted) > 0.95


def test_entry_registers_all(spark, tmp_path):
    names = entry_points.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 11)) and "pipeline" in names

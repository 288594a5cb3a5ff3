"""Near duplicates, repeated strings, lines and benchmark leaks against brute force."""

import hashlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom.llm import decontaminate, lines, minhash, suffix
from tests.llm import brute


@pytest.fixture(scope="module")
def corpus(spark):
    base = brute.prose(120, 1)
    texts = [base, base.upper(), base, "  " + base.replace(" ", "\t", 3), None, "", " \n ", "one two", "One  TWO", "a b c", brute.prose(4000, 2), brute.prose(4000, 2) + " end"]
    texts += [brute.edited(base, n, n) for n in range(1, 9)] + [brute.edited(brute.edited(base, 2, 50), 2, n) for n in range(60, 70)]
    texts += [brute.prose(30, n) for n in range(100, 110)] + ["same same same same same same"] * 3
    chain = brute.prose(200, 7)
    for n in range(12):
        texts.append(chain)
        chain = brute.edited(chain, 3, n)
    return texts


@pytest.mark.parametrize("k,percent,bands,rows", [(3, 85, 32, 6), (5, 80, 38, 5)])
def test_near_duplicates(spark, corpus, k, percent, bands, rows):
    docs = spark.createDataFrame(brute.rows(corpus), brute.DOCS)
    want = brute.components(dict(enumerate(corpus, 1)), k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, k, percent, bands, rows).collect()}
    assert got == want
    kept = minhash.without_duplicates(docs, k, percent, bands, rows)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


@pytest.mark.parametrize("k,percent,bands,rows", [(3, 85, 32, 6), (5, 80, 38, 5)])
def test_family_whose_members_stay_apart(spark, k, percent, bands, rows):
    base, longer = brute.prose(150, 3), brute.prose(3000, 4)
    texts = [brute.edited(base, n % 17, n) for n in range(90)] + [brute.edited(longer, 25 * n, n) for n in range(12)]
    docs = spark.createDataFrame(brute.rows(texts), brute.DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, k, percent, bands, rows).collect()}
    assert got == brute.components(dict(enumerate(texts, 1)), k, percent)
    assert 3 < len({c for _, c in got.values()}) < len(texts) - 20


def test_parities_of_shared_shingles(spark):
    texts = {n: brute.edited(brute.prose(100, 5), 2 + n, n) for n in range(6)}
    rows = spark.createDataFrame(list(texts.items()), "node long, text string").mapInArrow(minhash.shingle_rows(3), "node long, shingle long")
    sets = rows.groupBy("node").agg(F.collect_list("shingle").alias("s")).collect()
    sets = {r.node: np.array(r.s, np.int64).view(np.uint64) for r in sets}
    single = rows.groupBy("shingle").agg(F.count("*").alias("held"), F.min("node").alias("node"))
    for r in minhash._alone(single).collect():
        others = np.concatenate([s for n, s in sets.items() if n != r.node])
        mine = sets[r.node]
        assert r.own == (~np.isin(mine, others)).sum() > 0
        shared = minhash._parities(mine[np.isin(mine, others)])
        assert (minhash._parities(mine) ^ np.array(r.own_parities)).tolist() == shared.tolist()


def test_near_duplicates_without_ids_and_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, 4, False), (0, 4, False), (4, 4, True), (4, 4, True), (5, 5, True)]
    assert minhash.without_duplicates(docs).count() == 2
    empty = docs.limit(0)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.without_duplicates(empty).count() == 0


@pytest.mark.parametrize("length,gram,hot", [(40, 16, 20_000), (40, 16, 2), (200, 64, 20_000)])
def test_repeated_strings(spark, corpus, length, gram, hot):
    passage = "ü" + brute.prose(60, 31)
    texts = [*corpus, "start " + passage + " x", "other " + passage + " y", passage, "abc" * 200, "abc" * 90 + "d", "é" * 300, passage[5:250]]
    docs = spark.createDataFrame(brute.rows(texts), brute.DOCS)
    raw, masks = brute.repeated(texts, length)
    got = {r.doc_id: r for r in suffix.dedup_report(docs, length, gram, hot).collect()}
    assert len(got) == len(texts)
    for i, (t, mask) in enumerate(zip(raw, masks), 1):
        kept = bytes(b for b, m in zip(t, mask) if not m)
        spans = sum(1 for j, m in enumerate(mask) if m and (j == 0 or not mask[j - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), sum(mask), spans, hashlib.sha256(kept).hexdigest())
    cut = suffix.without_repeats(docs, length, gram, hot)
    assert cut.columns == docs.columns
    for r in cut.collect():
        t, mask = raw[r.doc_id - 1], masks[r.doc_id - 1]
        whole = "".join(c for c, at in _characters(texts[r.doc_id - 1]) if not any(mask[at : at + len(c.encode())]))
        assert (r.text or "") == whole
    assert suffix.dedup_report(docs.limit(0), length, gram, hot).count() == 0


@pytest.mark.parametrize("hot", [3, 8])
def test_large_groups_are_parted_and_stay_in_columns(spark, hot, monkeypatch):
    """One passage of exactly ``length`` bytes, a longer one and mixed surroundings, each in more texts than ``hot``."""
    length, gram = 40, 16
    core, long_one = brute.prose(30, 5)[:length], brute.prose(30, 6)[:120]
    texts = [f"{brute.prose(12, n)} {core} {brute.prose(12, 50 + n)}" for n in range(9)] + [f"{brute.prose(8, n)}{long_one}{brute.prose(8, 90 + n)}" for n in range(9)]
    texts += [brute.prose(20, 200 + n % 4)[:60] + core[8:32] + brute.prose(20, 300 + n // 4)[:60] for n in range(16)]
    docs, sizes, plain = spark.createDataFrame(brute.rows(texts), brute.DOCS), [], suffix.parted

    def seen(*args):
        groups, spans = plain(*args)
        for group in groups:
            sizes.extend(r["count"] for r in group.groupBy("h").count().collect())
        return groups, spans

    monkeypatch.setattr(suffix, "parted", seen)
    got = {r.doc_id: r for r in suffix.dedup_report(docs, length, gram, hot).collect()}
    assert sizes and max(sizes) <= hot
    for i, (t, mask) in enumerate(zip(*brute.repeated(texts, length)), 1):
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(mask), hashlib.sha256(bytes(b for b, m in zip(t, mask) if not m)).hexdigest())


def _characters(text):
    at = 0
    for c in text or "":
        yield c, at
        at += len(c.encode())


def test_lines(spark):
    rows = [(1, "the first line is here\nshort\n\nThe  FIRST line is\there "), (2, "the first line is here\nshort\nunlike any other line"), (None, "unlike any other line\nmine alone it is"), (3, None), (4, ""), (5, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lines.dedup_units(docs).collect()}
    assert got[1].kept == "the first line is here\nshort\n" and got[1].removed == [30, 54]
    assert got[2].kept == "short\nunlike any other line" and got[None].kept == "mine alone it is"
    assert got[3].n_units == 1 and got[5].n_removed == 0
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    want = {r[0]: tuple(r[1:]) for r in con.execute(lines.LINES_SQL).fetchall()}
    assert want == {k: (r.n_units, r.n_removed, r.removed, r.kept, r.kept_sha256) for k, r in got.items()}
    paragraphs = lines.dedup_units(spark.createDataFrame([(1, "a b c d\ne\n\na b c d\ne")], "doc_id long, text string"), separator="\n\n").first()
    assert paragraphs.kept == "a b c d\ne" and paragraphs.n_units == 2


def test_lines_of_rows_with_equal_and_null_ids(spark):
    hot, alone = "this line is in many rows", [f"line {n} is found only here" for n in range(4)]
    rows = [(1, f"{hot}\n{alone[0]}"), (7, f"{alone[1]}\n{hot}"), (7, f"{hot}\n{alone[2]}"), (None, f"{hot}\nx"), (None, f"{alone[3]}\n{hot}"), (9, "an exact copy is here"), (9, "an exact copy is here")]
    got = sorted((r.doc_id or 0, r.kept) for r in lines.dedup_units(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, rows[0][1]), (7, alone[1]), (7, alone[2]), (0, "x"), (0, alone[3]), (9, ""), (9, "an exact copy is here")])


def test_short_lines_and_lines_without_blanks(spark):
    rows = [(1, "les.\n\n\nand ornd.\n同一行文字"), (2, "Les.\n \nnew\nand  ornd.\n同一行文字\n"), (3, "")]
    got = {r.doc_id: (r.kept, r.n_removed) for r in lines.dedup_units(spark.createDataFrame(rows, "doc_id long, text string"), least_words=1).collect()}
    assert got == {1: (rows[0][1], 0), 2: (" \nnew\n", 3), 3: ("", 0)}


def _best(item, text, k):
    """Highest similarity of the item with any window of the text, by trying all."""
    from collections import Counter

    a, b = brute.words(item), brute.words(text)
    size = min(k, len(a))
    grams = lambda w: [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
    bag, all_grams, best = Counter(grams(a)), grams(b), 0.0
    for i in range(len(all_grams)):
        for j in range(i + 1, min(len(all_grams), i + len(bag) * 2 + 2) + 1):
            window = Counter(all_grams[i:j])
            best = max(best, sum((bag & window).values()) / sum((bag | window).values()))
    return best


def test_leaks(spark):
    items = [(1, brute.prose(14, 201)), (2, brute.prose(37, 202)), (3, brute.prose(59, 203)), (4, "only three words"), (5, None), (6, " "), (None, "no id here at all"), (7, brute.prose(100, 204))]
    texts = [None, "", brute.prose(300, 300), "x " * 40]
    for i, item in items:
        if item and item.strip():
            for n in range(3):
                texts.append(brute.prose(31 + n, 400 + n) + " " + brute.edited(item, n, n).upper() + " " + brute.prose(20, 500 + n))
            texts.append(" ".join(item.split()[:-1]))
            texts.append(" ".join(item.split()[: len(item.split()) // 2]))
    docs = spark.createDataFrame(brute.rows(texts), brute.DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, text in enumerate(texts, 1):
        want[i] = sorted(j for j, item in items if j and item and item.strip() and _best(item, text, 5) >= 0.8)
    got = {r.doc_id: r["items"] for r in decontaminate.leaks(docs, bench).collect()}
    assert got == want
    assert {r.doc_id: r["items"] for r in decontaminate.leaks(docs, bench, items_per_pass=3).collect()} == want
    clean = decontaminate.without_leaks(docs, bench, items_per_pass=3)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [i for i, found in want.items() if not found]
    assert decontaminate.leaks(docs, bench.limit(0)).filter("size(items) > 0").count() == 0
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_leaks_of_several_passes_keep_every_row(spark):
    items = [(n, brute.prose(30, 600 + n, 9000)) for n in range(6)]
    rows = [(None, items[0][1], 1), (None, items[5][1], 2), (None, "clean", 3), (8, items[2][1] + " x " + items[4][1], 4), (8, "clean too", 5), (8, "clean too", 5), (9, None, 6)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, row int"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(0, [0]), (0, [5]), (0, []), (8, [2, 4]), (8, []), (8, []), (9, [])])
    for most in (1, 2, 20_000):
        assert sorted((r.doc_id or 0, r["items"]) for r in decontaminate.leaks(docs, bench, items_per_pass=most).collect()) == want
        clean = decontaminate.without_leaks(docs, bench, items_per_pass=most)
        assert clean.columns == docs.columns and sorted(r.row for r in clean.collect()) == [3, 5, 5, 6]


def test_one_index_at_a_time(spark, monkeypatch):
    import gc
    import weakref

    live, most, build = weakref.WeakSet(), [], decontaminate.Index.__init__

    def counted(self, *given):
        gc.collect()
        live.add(self)
        most.append(len(live))
        build(self, *given)

    monkeypatch.setattr(decontaminate.Index, "__init__", counted)
    items = spark.createDataFrame([(n, brute.prose(20, 700 + n)) for n in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "clean")], "doc_id long, text string")
    for results in (decontaminate.leaks, decontaminate.without_leaks):
        most.clear()
        results(docs, items, items_per_pass=2).count()
        assert len(most) == 3 and max(most) == 1


@pytest.mark.parametrize("k", [3, 5])
def test_leaks_with_moved_and_added_words(k):
    import pyarrow as pa

    long = brute.prose(404, 801, 9000).split()
    grown = " ".join(long[:202] + brute.prose(90, 802, 9000).split() + long[202:])
    common = 404 - 2 * (k - 1)
    assert decontaminate.search(decontaminate.Index([(9, " ".join(long))], k, 80), pa.array([grown])) == ([[9]], [pytest.approx(common / (405 - k + 495 - k - common))])
    items, texts = [], []
    for n in (40, 41, 43, 57):
        own = brute.prose(n, 810 + n, 9000).split()
        items.append(" ".join(own))
        moved = own[n // 2 :] + own[: n // 2]
        texts += [" ".join(["before"] * 7 + moved + ["after"] * shift) for shift in (0, 3)] + [brute.edited(items[-1], 1, n)]
    index = decontaminate.Index(list(enumerate(items)), k, 80)
    found, similarity = decontaminate.search(index, pa.array(texts))
    for text, ids, value in zip(texts, found, similarity):
        most = {i: _best(item, text, k) for i, item in enumerate(items) if set(item.split()) & set(text.split())}
        assert ids == [i for i, v in most.items() if v >= 0.8]
        assert not ids or value == pytest.approx(max(most.values()))
    assert found[0] == [0]


def test_words_of_nothing_first(monkeypatch):
    """A Python worker whose first piece holds no byte at all."""
    from tagloom.llm import words as W

    monkeypatch.setattr(W, "_tables", {})
    assert len(W.words_of(np.zeros(0, np.uint8), np.zeros(1, np.int64)).hashes) == 0

"""Learned operators on held-out rows, and their defined results on awkward ones."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.llm import quality, toxicity, urls
from tagloom.llm.labelled import fold, logistic
from tests.llm import brute


@pytest.fixture(scope="module")
def marked(spark):
    rng, docs, labels = random.Random(5), [], []
    for i in range(600):
        text = brute.prose(rng.randrange(5, 120), i, 3000)
        toxic, quality_ = int(i % 5 == 0), int(i % 4 != 0)
        if toxic:
            found = text.split(" ")
            for _ in range(rng.randrange(1, 4)):
                found.insert(rng.randrange(len(found)), rng.choice(["vile", "nasty", "foul"]))
            text = " ".join(found)
        if not quality_:
            text = " ".join(w.upper() + "!!" for w in text.split(" "))
        docs.append((i, text, "label", 1))
        labels.append((i, quality_, toxic))
    docs += [(600, None, "x", 1), (601, "", "x", 1), (None, "vile nasty foul", "x", 1), (3, docs[3][1], "x", 1), (602, "vile " * 30_000, "x", 1)]
    labels += [(600, 1, 0), (None, 0, 1), (3, 1, 0), (5, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, label string, part int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def _accuracy(scored, labels, label, folds, held):
    both = scored.join(labels.groupBy("doc_id").agg(F.max(label).alias("y")), "doc_id").filter(fold(F.col("doc_id"), folds) == held)
    return both.agg(F.avg((F.col("predicted") == F.col("y")).cast("double"))).first()[0]


def test_toxicity(spark, marked):
    docs, labels = marked
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model)
    assert scored.count() == docs.count() and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert _accuracy(scored, labels, "toxic", 5, 0) > 0.95
    assert scored.filter("doc_id = 602").first().predicted == 1 and scored.filter("doc_id = 601").first().predicted == 0
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == scored.filter("predicted = 0").count()
    assert toxicity.score(docs.limit(0), model).count() == 0
    untaught = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, untaught).collect()} == {0.5}


def test_toxic_expressions_of_ordinary_words(spark):
    """Both words are as frequent in either class; only next to each other they are toxic."""
    rng, docs, labels = random.Random(8), [], []
    for i in range(800):
        found, toxic = brute.prose(rng.randrange(20, 60), i, 200).split(" "), i % 3 == 0
        for piece in ["warm bread"] * 2 if toxic else ["warm", "bread"] * 2:
            found.insert(rng.randrange(len(found)), piece)
        docs.append((i, " ".join(found)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert _accuracy(toxicity.score(docs, toxicity.train(docs, labels)), labels, "toxic", 5, 0) > 0.95


def test_kneser_ney_against_dictionaries(spark):
    """Ratios of words and pairs, computed word by word from the definition."""
    texts = [("a b c a b", 0), ("a b d", 0), ("a b c", 0), ("b c a d", 0), ("x a b", 1), ("a c x", 1), ("x a c c", 1), ("b c x a", 1), ("x a d", 1), ("a b x", 1)]
    rows = spark.createDataFrame([(i, t, y, 0) for i, (t, y) in enumerate(texts)] + [(10, "a b", 0, 1), (11, "x", 1, 1)], "doc_id long, text string, label int, part int")
    model = toxicity.fit(rows).shared.value
    bucket = {w: int(toxicity._pairs(pa.record_batch([pa.array([w])], ["text"]))[1][0]) for w in "abcdx"}
    pairs = [{}, {}]
    for text, y in texts:
        words = text.split(" ")
        for pair in set(zip([None, *words], words)):
            pairs[y][pair] = pairs[y].get(pair, 0) + 1

    def left(counts):
        d = toxicity.discounts([sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)])
        return {key: v - d[min(v, 3) - 1] for key, v in counts.items()}

    follows = [{w: sum(p[1] == w for p in own) for w in {p[1] for p in own}} for own in pairs]
    classes = {w: sum(w in f for f in follows) for w in bucket}
    total = sum(classes.values())
    unknown = 1 - sum(v - 0.75 for v in classes.values()) / total
    shared = {w: (v - 0.75) / total + unknown / toxicity.WORDS for w, v in classes.items()}
    kept = [left(f) for f in follows]
    back = max(1 - sum(k.values()) / sum(f.values()) for k, f in zip(kept, follows))
    word = [{w: (1 - back) * k.get(w, 0) / sum(k.values()) + back * shared[w] for w in bucket} for k in kept]
    for w, at in bucket.items():
        assert model.ratio[at] == pytest.approx(np.log(word[1][w] / word[0][w]), abs=1e-5)
    kept = [{p: n if pairs[c][p] > 1 else 0 for p, n in left(pairs[c]).items()} for c in (0, 1)]
    for v in (None, *bucket):
        sums = [(sum(n for p, n in own.items() if p[0] == v), sum(n for p, n in k.items() if p[0] == v)) for own, k in zip(pairs, kept)]
        weight = max(1 - k / n if n else 1 for n, k in sums)
        for w in bucket:
            full = [((1 - weight) * kept[c].get((v, w), 0) / sums[c][1] if sums[c][1] else 0) + weight * word[c][w] for c in (0, 1)]
            want = np.log(full[1] / full[0]) if weight < 1 else np.log(word[1][w] / word[0][w])
            pair = np.array([(bucket[v] if v else 0) << toxicity.WORD_BITS | bucket[w]])
            assert model.ratio[bucket[w]] + toxicity._gain(model.pairs, pair)[0] == pytest.approx(want, abs=5e-3)


def test_every_known_pair_adds_its_own(spark):
    """18,000 pairs that both classes know, of which some share a place in any table of a few million: none is left to the level of words."""
    names = [f"w{i}" for i in range(6000)]
    orders = [" ".join(x) for x in (names, names[::2] + names[1::2], names[::-1])]
    texts = [(text, y) for y, times in enumerate(((2, 3, 4), (3, 4, 2))) for text, n in zip(orders, times) for _ in range(n)]
    texts += [(" ".join(f"{y}only{i}" for i in range(6000)), y) for y in (0, 1)]
    rows = spark.createDataFrame([(i, t, y, p) for p in (0, 1) for i, (t, y) in enumerate(texts)], "doc_id long, text string, label int, part int")
    model = toxicity.fit(rows).shared.value
    before, now, _ = toxicity._pairs(pa.record_batch([pa.array(orders)], ["text"]))
    pairs = np.unique((before << toxicity.WORD_BITS | now)[before > 0])
    assert len(pairs) > 17_000 and np.count_nonzero(toxicity._gain(model.pairs, pairs)) == len(pairs)


@pytest.mark.parametrize("room", [0, 300])
def test_scores_do_not_depend_on_the_pairs_that_tasks_hold(spark, room):
    rng, docs, labels = random.Random(9), [], []
    for i in range(400):
        found, toxic = brute.prose(rng.randrange(1, 60), i, 60).split(" "), i % 3 == 0
        for piece in ["warm bread"] * 2 if toxic else ["warm", "bread"] * 2:
            found.insert(rng.randrange(len(found)), piece)
        docs.append((i, " ".join(found), "x"))
        labels.append((i, int(toxic)))
    docs += [(400, None, "x"), (401, "", "x"), (402, "bread", "x"), (403, "warm bread", "x"), (None, docs[3][1], "x"), (3, docs[3][1], "x"), (404, "warm bread " + docs[5][1] * 300, "x")]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string, h0 string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole, joined = toxicity.train(docs, labels), toxicity.train(docs, labels, room=room)
    assert whole.others is None and joined.others.count() > 0 and len(joined.shared.value.pairs[0]) <= room
    first, second = (sorted(map(tuple, toxicity.score(docs, m).collect()), key=lambda r: (r[0] is None, r[0])) for m in (whole, joined))
    assert len(first) == len(second) == docs.count()
    for a, b in zip(first, second):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], abs=1e-6)
    kept = [sorted(map(tuple, toxicity.without_toxic(docs, m).collect()), key=repr) for m in (whole, joined)]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < docs.count()
    assert toxicity.score(docs.limit(0), joined).count() == 0 and toxicity.without_toxic(docs.limit(0), joined).count() == 0


def test_without_evidence_no_document_is_dropped(spark, marked):
    docs, labels = marked
    for some in (labels.limit(0), labels.filter("toxic = 1"), labels.filter("toxic = 0"), labels.withColumn("doc_id", F.col("doc_id") + 10_000)):
        assert toxicity.without_toxic(docs, toxicity.train(docs, some)).count() == docs.count()


def test_labels_of_the_held_out_fold_are_not_read(spark, marked):
    docs, labels = marked
    turned = labels.withColumn("toxic", F.when(fold(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = ({(r.doc_id, r.score) for r in toxicity.score(docs, toxicity.train(docs, t)).collect()} for t in (labels, turned))
    assert first == second


def test_quality(spark, marked):
    docs, labels = marked
    scored = quality.score(docs, quality.train(docs, labels))
    assert scored.count() == docs.count() and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert _accuracy(scored, labels, "quality", 3, 1) > 0.95
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}


def test_dual_descent_meets_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    labels = (rng.random(60) < 0.5).astype(int)
    ratio = rng.normal(size=30)
    w = quality.dual_descent(rows, labels, ratio, epochs=400)
    x = np.zeros((60, 30))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
    y = np.where(labels > 0, 1, -1)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    assert all(loss(w) <= loss(w + step) + 1e-3 for step in rng.normal(scale=0.05, size=(300, 30)))


def test_logistic_without_rows():
    assert logistic(np.zeros((0, 2)), np.zeros(0)).tolist() == [0, 0, 0]


def test_urls(spark):
    rng, rows = random.Random(3), []
    for i in range(400):
        good = i % 2
        name = "".join(rng.choice("aeiou") + rng.choice("nrst") for _ in range(4)) if good else "".join(rng.choice("qxzjk0") for _ in range(8))
        rows.append((i, f"http://{name}.{'org/fr' if good else 'net'}/{i}", "h"))
    rows += [(400, None, ""), (401, "no scheme", ""), (402, "HTTP://Example.NET/en/x?y://z", ""), (403, "http://notexample.com/de/", ""), (404, "http://a.example.com/de/q#f", ""), (405, "http://x.net", ""), (406, "http://zxqj0xkz.info/7", ""), (407, "http://aneriso.info/7", ""), (407, "http://aneriso.info/7", "")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    assert (got[402].host, got[402].path, got[402].rule, got[402].verdict) == ("example.net", "/en/x", "example.net/en/", "allow")
    assert got[400].host == got[400].path == got[401].host == "" and got[400].rule is None and got[400].verdict in ("allow", "block")
    assert got[403].rule is None and (got[404].rule, got[404].path) == ("example.com/de/", "/de/q") and got[405].rule is None and got[405].path == ""
    assert got[406].verdict == "block" and got[407].verdict == "allow"
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty).count() == 0

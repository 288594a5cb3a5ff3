"""The stages on a small corpus with planted cases."""

import random

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
from tests.llm import brute


def _write(path, name, columns):
    pq.write_table(pa.table(columns), f"{path}/{name}.parquet")


def test_stages_keep_clean_documents(spark, tmp_path):
    clean = [brute.prose(80, n, 5000) for n in range(150)]
    toxic = [f"{brute.prose(20, 900 + n, 5000)} vile {brute.prose(9, 800 + n, 5000)} nasty" for n in range(60)]
    item = brute.prose(40, 5077, 5000)
    leak = brute.prose(30, 5078, 5000) + " " + item
    texts = clean + toxic + [leak, clean[0], brute.edited(clean[1], 1, 1), None, ""]
    ids = list(range(len(texts)))
    _write(tmp_path, "documents", {"doc_id": ids, "text": pa.array(texts, pa.string()), "lang": ["en"] * len(ids), "source": [f"s{i % 4}" for i in ids], "n_chars": [len(t or "") for t in texts]})
    _write(tmp_path, "labels", {"doc_id": ids[:205], "quality": pa.array([1] * 205, pa.int32()), "toxic": pa.array([int(150 <= i < 210) for i in ids[:205]], pa.int32())})
    _write(tmp_path, "benchmark", {"item_id": [1], "text": [item]})
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == "mixing" or docs.columns == columns
    assert left["toxicity"] == set(ids) - set(range(150, 210))
    assert left["near_duplicates"] == left["toxicity"] - {211, 212}
    assert left["repeated_passages"] == left["near_duplicates"]
    assert left["benchmark_leaks"] == left["mixing"] == left["near_duplicates"] - {210}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(left["mixing"])


def test_stages_take_empty_tables(spark, tmp_path):
    _write(tmp_path, "documents", {"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "lang": pa.array([], pa.string()), "source": pa.array([], pa.string()), "n_chars": pa.array([], pa.int64())})
    _write(tmp_path, "labels", {"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32()), "toxic": pa.array([], pa.int32())})
    _write(tmp_path, "benchmark", {"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_toxicity_stage_sees_expressions_of_ordinary_words(spark, tmp_path):
    """Two words that are as frequent in either class and toxic only next to each other."""
    rng, texts, toxic = random.Random(8), [], [i % 3 == 0 for i in range(800)]
    for i, bad in enumerate(toxic):
        found = brute.prose(rng.randrange(20, 60), i, 200).split(" ")
        for piece in ["warm bread"] * 2 if bad else ["warm", "bread"] * 2:
            found.insert(rng.randrange(len(found)), piece)
        texts.append(" ".join(found))
    ids = list(range(800))
    _write(tmp_path, "documents", {"doc_id": ids, "text": texts})
    _write(tmp_path, "labels", {"doc_id": ids, "toxic": pa.array([int(b) for b in toxic], pa.int32())})
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert sum((i in kept) != toxic[i] for i in ids) > 760

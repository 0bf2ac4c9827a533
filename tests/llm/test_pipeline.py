"""The pipeline's stages one after the other, each held against brute force on its own input."""

import random

import pytest

import corpus_pipeline
from quadrille.llm import queries
from test_llm import SCHEMA, WORDS, brute_components, sentence


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [sentence(rng, 20) for _ in range(4)]
    texts = [sentence(rng, rng.randint(30, 90)) for _ in range(120)]
    texts += [texts[k] for k in range(10)]
    for k in range(10, 20):
        words = texts[k].split()
        words[5] = "changed"
        texts.append(" ".join(words))
    texts += [f"{sentence(rng, 20)} {i} {sentence(rng, 20)}" for i in items]
    good = len(texts)
    texts += [" ".join(f"{rng.choice(WORDS).upper()}!!" for _ in range(60)) for _ in range(60)]
    folder = f"{tmp_path_factory.mktemp('tables')}"
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(k < good), 0) for k in range(len(texts))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, items, good


def test_stages(spark, tables):
    folder, texts, items, good = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.saved(stage(spark, docs, folder), "test")
        kept[k] = sorted(r.doc_id for r in docs.select("doc_id").collect())
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1, name
    assert len(set(kept[0]) ^ set(range(good))) <= 2
    ids = kept[0]
    near = brute_components([texts[i] for i in ids], 80)
    assert kept[1] == sorted({ids[c] for _, c in near.values()})
    assert kept[2] == [i for i in kept[1] if not any(x in texts[i] for x in items)]
    assert set(kept[3]) <= set(kept[2]) and 0.6 * len(kept[2]) < len(kept[3]) < 1.5 * len(kept[2])
    assert kept[4] == kept[3]
    rows = sorted(docs.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == kept[4]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert corpus_pipeline.run(spark, folder).count() == len(rows)


def test_stages_take_empty_tables(spark, tables):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_all_queries_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)

"""The corpus operators do the whole job: cases that were once left out."""

import random

import numpy as np
import pytest

from quadrille.llm import decontamination, near_dedup, quality, url_filter

WORDS = "river stone cloud meadow amber lantern quiet harbor copper thistle maple orbit velvet ember canyon drift".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def test_quality_learns_from_long_documents(spark):
    rng = random.Random(7)
    n = quality.PASSAGE * quality.TRAIN_PASSAGES
    texts = [sentence(rng, n + 50) if k % 2 else "BUY NOW!! " * (n // 2 + 25) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert [r.predicted for r in sorted(got)] == [k % 2 for k in range(40)]


def test_quality_samples_passages_of_long_documents():
    x = np.arange(1000)[:, None]
    own = quality._sample(x)[:, 0]
    assert len(own) == quality.TRAIN_PASSAGES and (np.diff(own) > 0).all() and own[0] < 50 and own[-1] > 950
    assert (quality._sample(x[:256]) == x[:256]).all()


def test_near_duplicates_tell_texts_of_one_doc_id_apart(spark):
    rng = random.Random(3)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    edited = lambda t, k: " ".join([*t.split()[:-1], f"edit{k}"])
    rows = [
        (5, a, "x"), (7, edited(a, 1), "x"),  # near
        (5, b, "x"), (9, edited(b, 2), "x"),  # near, and nothing to do with the others
        (8, c, "x"), (8, edited(c, 3), "x"), (8, c.upper(), "x"), (8, c, "y"),  # near, all of one doc_id
        (4, None, "x"), (4, "", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(4, 4)] * 2 + [(5, 5)] * 2 + [(7, 5)] + [(8, 8)] * 4 + [(9, 5)]
    kept = [tuple(r) for r in near_dedup.drop_near_duplicates(docs).collect()]
    assert sorted(r for r in kept if r[0] == 5) == sorted([(5, a, "x"), (5, b, "x")])
    assert len(kept) == 5 and [r[0] for r in kept].count(8) == 1 and set(kept) <= set(rows)
    again = [tuple(r) for r in near_dedup.drop_near_duplicates(docs.repartition(2, "source")).collect()]
    assert sorted(again, key=str) == sorted(kept, key=str)


def test_decontamination_by_items_without_id_or_seed(spark, monkeypatch):
    rng = random.Random(5)
    long = sentence(rng, 20)
    bench = [(None, long), (None, "alpha beta"), (3, "Gamma, delta: epsilon"), (4, "zeta"), (5, "alpha beta"), (6, " .. "), (7, "")]
    texts = [f"x {long} y", "we say ALPHA-beta, alpha beta", "gamma delta zeta epsilon", "gamma delta epsilon", "alpha", "beta alpha", None, "", "..", "zetas", sentence(rng, 50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(bench, "item_id long, text string")
    want = {k: (False, []) for k in range(len(texts))} | {0: (True, []), 1: (True, [5]), 2: (True, [4]), 3: (True, [3])}
    assert {r.doc_id: (r.contaminated, r.item_ids) for r in decontamination.judge(docs, bench).collect()} == want
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (3,))  # few items a block
    assert {r.doc_id: (r.contaminated, r.item_ids) for r in decontamination.judge(docs, bench).collect()} == want
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()) == list(range(4, len(texts)))


@pytest.mark.parametrize("limit", [10_000, 10])
def test_url_suffixes_have_all_their_own_rate(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST", limit, raising=False)
    rules = {(f"s{k}", "/"): "block" if k % 2 else "allow" for k in range(150)}
    urls = [f"http://h{n}.s{k}/" for k in range(150) for n in range(4)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(pages, url_filter.fit(pages, rules), {}).collect()
    assert len(got) == len(urls)
    assert all((r.score > 0.5) == (int(r.host.split(".s")[1]) % 2 == 1) for r in got)

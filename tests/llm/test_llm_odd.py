"""Clashing columns, odd rows, deep and long inputs, and brute-force versions of what numpy does at once."""

import math
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrille.llm import decontamination, html_text, language_id, mixing, near_dedup, quality, shared, textops, token_output
from test_llm import SCHEMA, frame, sentence

CLASH = "rate", "_n", "_source", "_table", "_mark", "_doc", "made", "cells", "copies", "row"


def clashing(df):
    return df.withColumns({c: F.lit(7) for c in CLASH})


def test_mixing_keeps_columns_of_any_name_and_odd_rows(spark):
    rows = [(k if k % 5 else None, f"text {k}" if k % 7 else None, "en", f"s{k % 2}" if k % 3 else None, k) for k in range(300)]
    docs = clashing(spark.createDataFrame(rows + rows[:10], SCHEMA))
    out = mixing.mix(docs, n_out=3000)
    assert out.columns == [*docs.columns, "copy", "shuffle_key"]
    assert out.where(" or ".join(f"{c} <> 7 or {c} is null" for c in CLASH)).count() == 0
    found = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(found) == {None, "s0", "s1"} and all(700 < n < 1300 for n in found.values())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_decontamination_keeps_columns_of_any_name(spark):
    import random

    rng = random.Random(5)
    items = [sentence(rng, 30) for _ in range(3)]
    texts = [sentence(rng, 40), f"x {items[0]} y", None, "", items[1] * 2]
    docs = clashing(frame(spark, texts))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontamination.drop_contaminated(docs, bench)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [0, 2, 3]
    # several blocks give the same as one
    whole = sorted(map(tuple, decontamination.contaminations(docs, bench).collect()))
    parts = list(decontamination.blocks(bench, 5, limit=31))
    assert len(parts) == 3
    old, decontamination.blocks = decontamination.blocks, lambda *a: iter(parts)
    try:
        assert sorted(map(tuple, decontamination.contaminations(docs, bench).collect())) == whole
    finally:
        decontamination.blocks = old


def test_near_dedup_drop_keeps_columns_of_any_name(spark):
    import random

    text = sentence(random.Random(3), 60)
    docs = clashing(frame(spark, [text, text, "other words that stand here alone"]))
    got = near_dedup.drop_near_duplicates(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [0, 2]


def test_a_large_group_of_near_copies_costs_its_size(spark):
    """Near copies of one text: what is shuffled grows with them, not with their square."""
    import random

    rng = random.Random(9)
    base = sentence(rng, 120).split()
    moved = []
    for n in (400, 1600):
        texts = []
        for k in range(n):
            words = list(base)
            words[rng.randrange(len(words))] = f"w{k}"
            texts.append(" ".join(words))
        before = _shuffled(spark)
        got = near_dedup.near_duplicates(frame(spark, texts), 0.8).groupBy("component_id").count().collect()
        assert [(r.component_id, r["count"]) for r in got] == [(0, n)]
        moved.append(_shuffled(spark) - before)
    assert 0 < moved[1] < 6 * moved[0], moved


def _shuffled(spark) -> int:
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_strays_between_stars_are_linked(spark):
    """A chain of texts, each like the next only: links that no star of the least class shows."""
    import random

    rng = random.Random(12)
    words = sentence(rng, 260).split()
    texts = [" ".join(words[k * 6 : k * 6 + 200]) for k in range(10)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    t, parent = 0.85, list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, texts), t).collect()}
    assert got == dict(enumerate(parent))


@pytest.mark.parametrize("lower", [True, False])
def test_words_of_long_texts_are_hashed_in_stretches(lower):
    texts = ["Ab cd" * 50, "x" * 700, "", "a  b " * 90 + "end", " " * 300, "é ü\tx\n" * 40]
    data, offsets = textops.text_buffers(pa.array(texts))
    whole = textops.hash_words(data, offsets, lower)
    for stretch in (16, 100, 333):
        part = textops.hash_words(data, offsets, lower, stretch=stretch)
        for name in ("hash", "start", "end", "bounds"):
            assert np.array_equal(getattr(whole, name), getattr(part, name))


def test_deep_pages_take_time_in_proportion():
    page = lambda n: "<div>" * n + "<p>words, here and there, of a text that is long enough</p>" + "</div>" * n
    assert html_text.main_text(page(3)) == html_text.main_text(page(30_000)) != ""
    times = []
    for n in (10_000, 40_000):
        start = time.process_time()
        html_text.main_text(("<div><b>" * n + "x, y</i>") * 2)
        times.append(time.process_time() - start)
    assert times[1] < 12 * times[0] + 0.5


def test_sequences_are_views_of_the_file(spark, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    rows = token_output.write_tokens(frame(spark, ["alpha beta " * 400, "gamma", None]), folder, token_output.vocabulary_path(), length=16, batch=4).collect()
    whole = []
    for r in sorted(rows, key=lambda r: r.start):
        path = f"{tmp_path}/tokens/{r.name}.ids.arrows"
        found = token_output.Sequences(path)
        assert all(not ids.flags.owndata and len(ids) == 16 for ids, _ in (found[k] for k in range(len(found))))
        got = [int(x) for k in range(len(found)) for x, m in zip(found[k][0], found[k][1].to_pylist(), strict=True) if m]
        want = [int(x) for _, _, ids in token_output.read_file(pa.fs.LocalFileSystem(), path[: -len(".ids.arrows")]) for x in ids]
        assert got == want and len(got) == r.n_tokens
        with pytest.raises(IndexError):
            found[len(found)]
        whole += got
    assert whole[-2:] == [0, 0]


def test_tokens_of_odd_rows(spark):
    odd = spark.createDataFrame([(None, "b"), (None, "a"), (4, "c"), (4, "c"), (4, None)], "doc_id long, text string")
    got = token_output.encode_documents(odd.withColumns({"mark": F.lit(1), "start": F.lit(2)})).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 4, 4, 4] and [r.n_tokens for r in got if r.n_tokens == 1] == [1]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def test_checkpoints_of_a_cluster_need_a_shared_folder(spark):
    class Other:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared.shared_dir(Other)


def test_quality_scores_equal_a_plain_loop():
    texts = pa.array(["Some words, and 12 more! " * 40, "", None, "SHOUT!!! " * 100, "a"])
    x, counts = quality.passages(texts)
    model = quality.train(x, counts, np.array([1.0, 0.0, 0.0, 1.0, 0.0]), epochs=1)
    p, got = model.weights, model.score(x, counts)
    at = 0
    for n, y in zip(counts, got, strict=True):
        weights, hidden = [], []
        for row in model.encode(x[at : at + n]):
            h = np.tanh(row @ p["W"] + p["b"])
            gate = 1 / (1 + np.exp(-(h @ p["U"])))
            weights.append(math.exp(float((np.tanh(h @ p["V"]) * gate) @ p["w"])))
            hidden.append(h)
        z = sum(w * h for w, h in zip(weights, hidden, strict=True)) / sum(weights)
        assert y == pytest.approx(1 / (1 + math.exp(-float(z @ p["c"] + p["d"][0]))), abs=1e-6)
        at += n


def test_language_logits_equal_a_plain_loop():
    texts = ["Der Hund, und die Katze.", "the dog AND the cat", "", "é"]
    rng = np.random.default_rng(2)
    model = language_id.Model(["a", "b"], rng.normal(size=(language_id.BUCKETS, 2)).astype(np.float32), np.array([0.1, -0.2]))
    got = model.logits(pa.array(texts))

    def bucket(run):
        code = run[0]
        for b in run[1:]:
            code = (code * 257 + b) & 0xFFFFFFFF
        h = ((code * 0x9E3779B1) & 0xFFFFFFFF) ^ ((len(run) * 0x85EBCA6B) & 0xFFFFFFFF)
        h ^= h >> 15
        return ((h * 0x2C1B3C6D) & 0xFFFFFFFF) >> (32 - language_id.BITS)

    for text, z in zip(texts, got, strict=True):
        plain = []
        for b in text.encode():
            c = b + 32 if 65 <= b <= 90 else b
            c = 32 if c < 128 and not chr(c).isalpha() else c
            if not (c == 32 and plain and plain[-1] == 32):
                plain.append(c)
        own = [bucket(plain[i : i + n]) for n in language_id.SIZES for i in range(len(plain) - n + 1)]
        want = model.table[own].astype(float).mean(0) if own else np.zeros(2)
        assert z == pytest.approx(want + model.bias, abs=1e-5)


def test_encoder_equals_the_library_on_odd_texts(monkeypatch):
    import random

    monkeypatch.setattr(token_output, "MEMO_WORDS", 300)  # forgets now and then
    rng = random.Random(4)
    parts = [*"abcXYZ019 \n'\"_.,-<|>!?()éß日€ ́ſ\t ", "'s", "'ll", " don't", "<|endoftext|>", "  ", "\n\n", "word", " word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    enc = token_output.Encoder(token_output.vocabulary_path())
    for i in range(0, len(texts), 100):
        own = [None, *texts[i : i + 100], ""]
        ids, counts = enc.encode(own, 0)
        want = [[*x.ids, 0] for x in enc.library.encode_batch_fast([t or "" for t in own], add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [k for w in want for k in w]

"""The corpus operators against brute force, and on odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import (
    decontamination,
    fingerprints,
    html_text,
    language_id,
    mixing,
    near_dedup,
    quality,
    substring_dedup,
    token_output,
    url_filter,
)
from quadrille.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = "river stone cloud meadow amber lantern quiet harbor copper thistle maple orbit velvet ember canyon drift".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def corpus(rng):
    """Texts with copies, near copies, shared passages, and odd cases."""
    base = [sentence(rng, rng.randint(20, 120)) for _ in range(14)]
    texts = list(base)
    texts += [base[0]] * 4 + [base[1].upper()]
    for k in range(6):
        words = base[2].split()
        words[rng.randrange(len(words))] = f"edit{k}"
        texts.append(" ".join(words))
    shared = sentence(rng, 60)
    texts += [f"{sentence(rng, 30)} {shared} {sentence(rng, 25)}" for _ in range(3)]
    texts += [f"{shared}\n{shared}", None, "", "  \n\t ", "one", "one two three", "one two three", "One Two Three", "é" * 50, "x" * 5000]
    texts.append(sentence(rng, 4000))
    return texts


def rows(texts):
    return [(k, t, ("en", "de", None)[k % 3], f"src{k % 4}", len(t or "")) for k, t in enumerate(texts)]


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return corpus(random.Random(5))


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# --- near duplicates ------------------------------------------------------------------------------


def brute_components(texts, threshold):
    sets = []
    for t in texts:
        w = SPLIT.findall(lower(t))
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= threshold * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {k: (len(s), find(k)) for k, s in enumerate(sets)}


@pytest.mark.parametrize("threshold", [0.85, 0.8])
def test_near_duplicates(spark, texts, threshold, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)  # several cells for one component
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, texts), threshold).collect()}
    assert got == brute_components(texts, round(100 * threshold))


def test_near_duplicates_odd_rows(spark):
    df = frame(spark, [])
    assert near_dedup.near_duplicates(df).count() == 0
    text = sentence(random.Random(1), 30)
    odd = spark.createDataFrame([(None, text), (7, text), (7, text), (3, text), (9, None)], "doc_id long, text string")
    odd = odd.withColumn("component_id", F.lit("clash")).withColumn("bands", F.lit(1)).withColumn("node", F.lit(1))
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(None, None, True), (7, 3, False), (7, 3, False), (3, 3, True), (9, 9, True)], key=str)
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 9]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(5, 5), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- substrings -----------------------------------------------------------------------------------


def brute_repeats(texts, n):
    words = [SPLIT.findall(t or "") for t in texts]
    count = {}
    for w in words:
        for i in range(len(w) - n + 1):
            count[tuple(w[i : i + n])] = count.get(tuple(w[i : i + n]), 0) + 1
    out = {}
    for k, w in enumerate(words):
        gone = set()
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[k] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("n,seed", [(35, 12), (14, 3)])
def test_repeated_spans(spark, texts, n, seed):
    got = substring_dedup.repeated_spans(frame(spark, texts), n, seed).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_repeats(texts, n)
    assert all(sum(s["last"] - s["first"] for s in r.repeats) == r.n_removed for r in got)


def test_repeated_spans_odd_rows(spark):
    assert substring_dedup.repeated_spans(frame(spark, [])).count() == 0
    text = sentence(random.Random(2), 50)
    odd = spark.createDataFrame([(None, text), (1, text), (1, text), (None, None), (2, "a b")], "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed) for r in substring_dedup.repeated_spans(odd.withColumn("key", F.lit(0))).collect())
    assert got == [(0, 0), (2, 0), (50, 50), (50, 50), (50, 50)]


# --- fingerprints ---------------------------------------------------------------------------------


def test_compare_with_next(spark, texts):
    got = {r.doc_id: r for r in fingerprints.compare_with_next(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        t, after = t or "", texts[(k + 1) % len(texts)] or ""
        changed = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = got[k]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == fingerprints.fingerprint(t)
        assert r.near_edited == float(fingerprints.canonical(t) == fingerprints.canonical(changed))
        assert r.near_next == float(fingerprints.canonical(t) == fingerprints.canonical(after))


def test_fingerprints_fold_case_space_and_unicode_form(spark):
    same = ["Ｃafé  Noir\n", "cafe\u0301 noir", " CAFÉ\u00a0NOIR"]
    df = frame(spark, [*same, "cafe noir", None, ""])
    got = {r.doc_id: r for r in fingerprints.exact_duplicates(df).collect()}
    assert [got[k].class_id for k in range(6)] == [0, 0, 0, 3, 4, 4]
    one = fingerprints.compare_with_next(frame(spark, ["alone here"])).first()
    assert (one.near_next, fingerprints.compare_with_next(frame(spark, [])).count()) == (1.0, 0)


def test_colliding_fingerprints_get_another_seed(spark):
    forms = spark.createDataFrame([("h", b"a"), ("h", b"b"), ("h", b"a"), ("g", b"c"), ("g", b"c")], "fingerprint string, form binary")
    assert [r.fingerprint for r in fingerprints.collided(forms).collect()] == ["h"]
    texts = ["one", "two", "three", "One"]
    seeds = [s for s in range(fingerprints.SEEDS) if len({fingerprints.fingerprint(t, s, 1) for t in texts}) == 3]
    got = [r.fingerprint for r in fingerprints.fingerprints(frame(spark, texts), digits=1).orderBy("doc_id").collect()]
    assert got == [fingerprints.fingerprint(t, seeds[0], 1) for t in texts]
    with pytest.raises(ValueError):
        fingerprints.fingerprints(frame(spark, [str(k) for k in range(17)]), digits=1)


def test_fingerprints_odd_rows(spark):
    rows = [(None, "b", 1), (None, "a", 2), (5, "c", 3), (5, "c", 4), (5, None, 5)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, mark int").withColumns({"z": F.lit(0), "part": F.lit(0)})
    got = fingerprints.compare_with_next(odd).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 1), (0, 1), (5, 0), (5, 1), (5, 1)]
    assert sum(r.near_next for r in got) == 1


# --- tokens ---------------------------------------------------------------------------------------


def test_token_round_trip(spark, texts, monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_output.vocabulary_path())
    more = [*texts, "don't  stop\n\nnow!! 12ab x_y\ttab\u00a0nbsp .5 ´s 'll", "日本語 テスト€"]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_output.encode_documents(frame(spark, more)).collect()}
    start, want = 0, {}
    for k, t in enumerate(more):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        want[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    assert token_output.encode_documents(frame(spark, [])).count() == 0


def test_sequences_are_fixed_size_and_masked(spark, tmp_path):
    import pyarrow as pa

    folder = f"file://{tmp_path}/out"
    manifest = token_output.write_tokens(frame(spark, ["alpha beta " * 40, "gamma"]), folder, token_output.vocabulary_path(), length=16, batch=2)
    total = 0
    for r in manifest.collect():
        with pa.memory_map(f"{tmp_path}/out/{r.name}.ids.arrows") as source:
            batches = list(pa.ipc.open_stream(source))
        assert all(b.num_rows == 2 for b in batches[:-1])
        assert {b.schema.field("ids").type.list_size for b in batches} == {16}
        assert sum(sum(m) for b in batches for m in b.column(1).to_pylist()) == r.n_tokens
        total += r.n_tokens
    assert total == manifest.agg(F.sum("n_tokens")).first()[0]


# --- decontamination ------------------------------------------------------------------------------


def brute_tiling(item, doc, size):
    """The published greedy algorithm, step by step."""
    a, b = [False] * len(item), [False] * len(doc)
    total = 0
    while True:
        best = 0
        found = []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best and n:
                    found.append((i, j))
        if best < size:
            return total
        for i, j in found:
            if not any(a[i : i + best]) and not any(b[j : j + best]):
                a[i : i + best] = [True] * best
                b[j : j + best] = [True] * best
                total += best


def test_tiling_equals_the_step_by_step_algorithm():
    rng = random.Random(3)
    for _ in range(60):
        item = [rng.randrange(6) for _ in range(rng.randint(3, 25))]
        doc = [rng.randrange(6) for _ in range(rng.randint(3, 40))]
        x, y = np.array(item, np.uint64), np.array(doc, np.uint64)
        pairs = [(i, j) for i in range(len(item) - 2) for j in range(len(doc) - 2) if item[i : i + 3] == doc[j : j + 3]]
        i, j = (np.array(v, np.int64) for v in (zip(*pairs, strict=True) if pairs else ([], [])))
        tiles = decontamination.tile(decontamination.matches(x, y, i, j, 3) if pairs else [], len(item), len(doc), 3)
        assert sum(n for _, _, n in tiles) == brute_tiling(item, doc, 3)


def test_decontamination(spark, monkeypatch):
    rng = random.Random(9)
    items = [sentence(rng, 24) for _ in range(5)]
    half = items[3].split()
    docs = [
        f"{sentence(rng, 40)} {items[0]} {sentence(rng, 10)}",
        f"{items[1].upper()}!",
        " ".join([*half[12:], sentence(rng, 9), *half[:12]]),  # reordered
        f"{sentence(rng, 9)} {' '.join(items[2].split()[:7])}",  # too little
        sentence(rng, 200),
        None,
        "",
        f"{items[0]} {items[4]}",
    ]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "too short"), (None, items[4])], "item_id long, text string")
    df = frame(spark, docs).withColumn("mark", F.lit("clash")).withColumn("item_id", F.lit(1))
    want = {0: [0], 1: [1], 2: [3], 3: [], 4: [], 5: [], 6: [], 7: [0, 4]}
    assert {r.doc_id: r.item_ids for r in decontamination.judge(df, bench).collect()} == want
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (30,))  # one item a block
    assert {r.doc_id: r.item_ids for r in decontamination.judge(df, bench).collect()} == want
    kept = decontamination.drop_contaminated(df, bench)
    assert (sorted(r.doc_id for r in kept.collect()), kept.columns) == ([3, 4, 5, 6], df.columns)
    assert decontamination.judge(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.judge(df.limit(0), bench).count() == 0


# --- mixing ---------------------------------------------------------------------------------------


def test_mix_reaches_targets_and_is_repeatable(spark):
    df = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 > 0, "a").when(F.col("id") % 2 > 0, "b").otherwise(F.lit(None)).alias("source")
    )
    out = mixing.mix(df, {"a": 1, "b": 3}, n_out=8000)
    counts = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(counts) == {"a", "b"}
    assert abs(counts["a"] - 2000) < 5 * 2000**0.5 and abs(counts["b"] - 6000) < 5 * 6000**0.5
    order = [(r.doc_id, r.copy) for r in out.collect()]
    assert order == [(r.doc_id, r.copy) for r in mixing.mix(df.repartition(3), {"a": 1, "b": 3}, n_out=8000).collect()]
    assert order != sorted(order)
    assert mixing.mix(df.limit(0)).count() == 0


def test_poisson_counts_follow_the_distribution(spark):
    from math import exp, factorial

    def counts(mean, seed):
        parts = mixing.draws(F.lit(mean))
        return mixing.repetitions(mixing.cumulative(F.lit(mean) / parts), parts, F.col("id"), seed)

    df = spark.range(20000).select(counts(2.5, 1).alias("n"), counts(700.0, 2).alias("big"))
    got = df.groupBy("n").count().collect()
    for r in got:
        want = 20000 * exp(-2.5) * 2.5**r.n / factorial(r.n)
        assert abs(r["count"] - want) < 6 * max(1, want) ** 0.5
    mean, var = df.agg(F.avg("big"), F.var_pop("big")).first()
    assert abs(mean - 700) < 2 and abs(var - 700) < 40


# --- quality, language ----------------------------------------------------------------------------


def test_quality_learns_held_out_labels(spark):
    rng = random.Random(4)
    good = [sentence(rng, rng.randint(5, 150)) for _ in range(200)]
    bad = [" ".join(f"{rng.choice(WORDS).upper()}!!" for _ in range(rng.randint(20, 150))) for _ in range(80)]
    bad += [" ".join([rng.choice(WORDS)] * 30 + [sentence(rng, 50)]) for _ in range(40)]
    df = frame(spark, good + bad + [None, "", " ", "x" * 100_000])
    labels = spark.createDataFrame([(k, int(k < 200), 0) for k in range(320)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    got = {r.doc_id: r for r in quality.score(df.withColumn("label", F.lit(1)).withColumn("score", F.lit(9)), model).collect()}
    assert len(got) == 324 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [k for k in range(320) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out for k in held) and sum(r.held_out for r in got.values()) >= len(held)
    assert np.mean([got[k].predicted == int(k < 200) for k in held]) > 0.95
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.predicted}
    empty = quality.fit(df.limit(0), labels)
    assert {r.score for r in quality.score(df, empty).collect()} == {0.5}
    assert quality.score(df.limit(0), model).count() == 0


def test_quality_gradients():
    rng = np.random.default_rng(0)
    model = quality.train(np.zeros((0, quality.WIDTH), np.float32), np.zeros(0, np.int64), np.zeros(0))
    p = {k: rng.normal(0, 0.3, v.shape) for k, v in model.weights.items()}
    x, counts, y = rng.normal(size=(9, quality.WIDTH)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = quality.forward(p, x, counts)["y"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    g = quality.gradients(p, x, counts, y)
    for name, value in p.items():
        at = tuple(rng.integers(n) for n in value.shape)
        value[at] += 1e-5
        up = loss()
        value[at] -= 2e-5
        down = loss()
        value[at] += 1e-5
        assert g[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_language_of_held_out_texts(spark):
    rng = random.Random(6)
    vocab = {"en": "the and of river with that".split(), "de": "der und die für über schön".split(), "fr": "les été où garçon dans pour".split()}
    data = []
    for k in range(600):
        lang = ("en", "de", "fr")[k % 3]
        data.append((k, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randint(4, 60))), lang, "s", 0))
    odd = [(1000, None, "en", "s", 0), (1001, "", None, "s", 0), (1002, "12 .. $$ 34", "en", "s", 0), (1003, "日本語", None, "s", 0), (None, "der und die", None, "s", 0)]
    df = spark.createDataFrame(data + odd, SCHEMA)
    got = {r.doc_id: r for r in language_id.identify(df.withColumn("score", F.lit(1)), language_id.fit(df)).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out for k in held)
    assert np.mean([got[k].lang_pred == ("en", "de", "fr")[k % 3] for k in held]) > 0.97
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[None].lang_pred == "de"
    assert got[1003].lang_pred in vocab and all(0 <= r.score <= 1 for r in got.values())
    nothing = language_id.fit(df.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}
    assert language_id.identify(df.limit(0), nothing).count() == 0


# --- urls and pages -------------------------------------------------------------------------------


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = lower(host)
    fits = [h + p for h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_and_trees(spark):
    rng = random.Random(8)
    hosts = ["example.com", "www.example.com", "blog.Example.COM", "shop.com", "a.net", "net", "xexample.com", "b.org", "com"]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en', '/es/x', '/fr/', '/de/9'])}{rng.choice(['', '?a=1&b=2', '#t', '/p.html'])}" for _ in range(400)]
    urls += [None, "", "nothing", "://", "http://", "a://b://c/en/", "http://é.net/es/", "http://a.net?x=/es/", "x" * 9000, "http://a\nb.net/es/\n"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)] + [(None, urls[0], "")], "page_id long, url string, host string")
    model = url_filter.fit(pages)
    out = url_filter.judge(pages, model)
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    for r in out.where("page_id is not null").collect():
        host, path, rule = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        names = {h + p: v for (h, p), v in url_filter.RULES.items()}
        assert r.verdict == (names[rule] if rule else "block" if r.score >= 0.5 else "allow")
    assert url_filter.judge(pages.limit(0), url_filter.fit(pages.limit(0))).count() == 0


def test_trees_as_columns_equal_the_trees(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees, base = url_filter.boost(x, y, ["a", "b", "c"])
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    model = url_filter.Model({}, 0.5, trees, base)
    got = np.array([r.p for r in df.select(model.score({k: F.col(k) for k in "abc"}).alias("p")).collect()])
    want = 1 / (1 + np.exp(-(base + sum(url_filter.apply(t, x, ["a", "b", "c"]) for t in trees))))
    assert np.allclose(got, want) and ((got > 0.5) == (y > 0.5)).mean() > 0.9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, lots, of them.</p></div>
%s<aside><p>Side, with commas, and more, of them.</p></aside><section id="comments"><p>Reader, comment, with, commas.</p></section>
<form><p>Sign up</p></form><footer><p>Foot &copy; x</p></footer></body></html>"""


@pytest.mark.parametrize(
    "body,want",
    [
        ("<article><h1>Head</h1><p>One&nbsp;&amp; two,\n  three.</p><!-- x --><p><b>Bold<br><p>Next, more.</article>", "Head One & two, three. Bold Next, more."),
        ("<div class='content'><p>Long enough text, with commas, for an article.</p><ul><li>a</li><li>b</li></ul><p>End.</p></div>", "Long enough text, with commas, for an article. a b End."),
        ("<main><p>x</p></main>", "x"),
        ("<div class='post has-sidebar'><p>Some words, more words, and many more of them here.</p><div class='post-comments'><p>Me too, me, too.</p></div></div>", "Some words, more words, and many more of them here."),
        ("", ""),
    ],
)
def test_main_text(body, want):
    assert html_text.main_text(PAGE % body) == want


def test_extraction_odd_pages(spark):
    pages = [(1, "u", None), (1, None, ""), (None, "v", "<p>a < b"), (3, "w", "<p>" + "word, " * 20000), (4, "x", "<div" * 50), (5, "y", "<b>" * 3000 + "deep")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract(df).collect()}
    assert got[1, "u"] == got[1, None] == ("", 0) and got[None, "v"] == ("a < b", 5) and got[3, "w"][1] == 119999
    assert got[5, "y"] == ("deep", 4)
    assert html_text.extract(df.limit(0)).count() == 0

"""URL filter: rules by host and path, and gradient-boosted trees for the rest.

Everything that touches rows is a Column expression: parsing, rules, lexical
features, and the trees, which become nested ``when`` expressions.  Boosting
itself runs on the driver over at most ``TRAIN_ROWS`` labelled URLs, as plain
rows; the labels are the verdicts of the rules.  The blocking rates of the
host's suffixes are a table of all suffixes that rules label, joined to the
urls.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved, table

#: Verdict by host and path; a rule fits its host, all subdomains, and paths that start with its path.
RULES = {
    ("com", "/"): "allow",
    ("example.com", "/en/"): "block",
    ("www.example.com", "/en/"): "allow",
    ("net", "/es/"): "block",
    ("net", "/fr/"): "block",
}
#: Bound of the training sample, and the most suffixes whose table is broadcast; a larger one is joined by a shuffle.
TRAIN_ROWS, BROADCAST = 20_000, 10_000
#: Trees, their depth, the share of each tree that counts, and the candidate thresholds of a feature.
TREES, DEPTH, RATE, CUTS = 24, 3, 0.3, 32
#: Rows that a leaf needs, and rows' worth of the mean by which suffix statistics are smoothed.
LEAF, PRIOR = 20, 10.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: dict[tuple[str, str], str]) -> Column:
    """The longest rule that fits columns host and path, like ``net/``; null if none does."""
    out = F.lit(None).cast("string")
    for h, p in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        out = F.when(fits, F.lit(h + p)).otherwise(out)
    return out


def verdict_of(rules: dict[tuple[str, str], str]) -> Column:
    names = {h + p: v for (h, p), v in rules.items()}
    return reduce(lambda out, r: F.when(F.col("rule") == r, F.lit(names[r])).otherwise(out), names, F.lit(None).cast("string"))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    terms = F.transform(
        F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double") / n
    )
    total = F.aggregate(terms, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(n > 0, total).otherwise(0.0)


def suffix() -> Column:
    """The last label of the host."""
    return F.substring_index("host", ".", -1)


def lexical(url: Column) -> dict[str, Column]:
    """Lexical features of columns host and path, and of the url."""
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    size = lambda text, pattern: F.length(F.regexp_replace(text, pattern, ""))
    long = F.greatest(F.length(url), F.lit(1))
    return {
        "length": F.length(url),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "host_depth": size(F.col("host"), r"[^.]"),
        "path_depth": size(F.col("path"), r"[^/]"),
        "digit_ratio": size(url, r"[^0-9]") / long,
        "sign_ratio": size(url, r"[A-Za-z0-9]") / long,
        "host_hyphens": size(F.col("host"), r"[^-]"),
        "host_entropy": entropy(F.col("host")),
        "path_entropy": entropy(F.col("path")),
        "parameters": F.when(F.length(query) > 0, size(query, r"[^&]") + 1).otherwise(0),
        "query_length": F.length(query),
        "secure": url.startswith("https://").cast("int"),
        "extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int"),
        "first_part_length": F.length(F.regexp_extract("path", r"^/([^/]*)", 1)),
    }


@dataclass
class Model:
    """Blocking rates of suffixes (name, suffix_rate), and trees as (feature, threshold, left, right) or a leaf's value."""

    suffixes: DataFrame
    prior: float
    trees: list
    base: float

    def rated(self, urls: DataFrame) -> DataFrame:
        """``urls`` with the column suffix_rate, the mean rate where a suffix has none."""
        out = urls.withColumn("name", suffix()).join(self.suffixes, "name", "left").drop("name")
        return out.na.fill(self.prior, ["suffix_rate"])

    def score(self, features: dict[str, Column]) -> Column:
        """Probability that a URL is to be blocked."""

        def walk(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            name, cut, left, right = tree
            return F.when(features[name] <= F.lit(cut), walk(left)).otherwise(walk(right))

        total = reduce(lambda a, b: a + b, [walk(t) for t in self.trees], F.lit(self.base))
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, names: list[str], depth: int):
    value = float(-g.sum() / (h.sum() + 1.0) * RATE)
    if depth == 0 or len(g) < 2 * LEAF:
        return value
    best = (1e-6, None, None)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(bins.shape[1]):
        if not len(cuts[f]):
            continue
        n = len(cuts[f]) + 1
        gs, hs, ns = (np.cumsum(np.bincount(bins[:, f], w, n))[:-1] for w in (g, h, np.ones(len(g))))
        gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - whole
        gain[(ns < LEAF) | (len(g) - ns < LEAF)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, k)
    if best[1] is None:
        return value
    _, f, k = best
    left = bins[:, f] <= k
    grow = lambda m: _grow(x[m], bins[m], cuts, g[m], h[m], names, depth - 1)
    return (names[f], float(cuts[f][k]), grow(left), grow(~left))


def boost(x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[list, float]:
    """Trees for the logistic loss; ``x`` is split at quantiles of each feature."""
    rate = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    if len(y) < 2 * LEAF or y.min() == y.max():
        return [], base
    cuts = []
    for f in range(x.shape[1]):
        u = np.unique(x[:, f])
        cuts.append((u[:-1] + u[1:]) / 2 if len(u) <= CUTS else np.unique(np.quantile(x[:, f], np.arange(1, CUTS) / CUTS)))
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    trees, score = [], np.full(len(y), base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, bins, cuts, p - y, p * (1 - p), names, DEPTH)
        trees.append(tree)
        score += apply(tree, x, names)
    return trees, base


def apply(tree, x: np.ndarray, names: list[str]) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    name, cut, left, right = tree
    return np.where(x[:, names.index(name)] <= cut, apply(left, x, names), apply(right, x, names))


def parsed(pages: DataFrame, rules: dict[tuple[str, str], str]) -> DataFrame:
    out = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    out = out.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    return out.withColumn("rule", rule_of(rules)).withColumn("by_rule", verdict_of(rules))


def featured(urls: DataFrame) -> DataFrame:
    """``urls`` with the lexical features as columns, each made once a row: a generated column is not inlined."""
    made = F.struct(*[c.alias(n) for n, c in lexical(F.col("url")).items()])
    return urls.withColumn("made", F.explode(F.array(made))).select(*urls.columns, "made.*")


def fit(pages: DataFrame, rules: dict[tuple[str, str], str] = RULES, rows: int = TRAIN_ROWS) -> Model:
    """Learn the rules' verdicts from the URLs that have one."""
    known = parsed(pages, rules).where("rule is not null").withColumn("y", (F.col("by_rule") == "block").cast("double"))
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.avg("y"), F.lit(0.5)).alias("rate")).first()
    by_suffix = known.groupBy(suffix().alias("name")).agg(F.count("*").alias("n"), F.sum("y").alias("blocked"))
    rate = (F.col("blocked") + F.lit(PRIOR * total.rate)) / (F.col("n") + F.lit(PRIOR))
    rates = saved(by_suffix.select("name", rate.alias("suffix_rate")), "suffixes")
    if len(rates.select("name").take(BROADCAST + 1)) <= BROADCAST:
        rates = F.broadcast(rates)
    model = Model(rates, total.rate, [], 0.0)
    share = 1.2 * rows / max(1, total.n)
    if share < 1:
        # a share by hash, then the bound itself: the same rows whatever the layout of the table
        known = known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int(share * (1 << 20)))
    known = known.orderBy(F.xxhash64("url"), "url").limit(rows)
    names = [*lexical(F.col("url")), "suffix_rate"]
    sample = featured(model.rated(known)).select(*[F.col(n).cast("double") for n in names], "y").collect()
    data = np.array([tuple(r) for r in sample], np.float64).reshape(-1, len(names) + 1)
    data = data[np.lexsort(data.T)]  # whatever order rows came in
    model.trees, model.base = boost(data[:, :-1], data[:, -1], names)
    return model


def judge(pages: DataFrame, model: Model, rules: dict[tuple[str, str], str] = RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, score.

    The verdict is the longest fitting rule's, else the trees': block from a
    probability (``score``) of one half on.  A url that is null or without
    ``://`` has an empty host and path and no rule.  Ids are only carried, so
    nulls and repeats of them don't matter, and repeated rows are judged each;
    an empty or very long url is judged whole.  Other columns are ignored.  An
    empty table gives an empty result.
    """
    score = model.score({n: F.col(n) for n in [*lexical(F.col("url")), "suffix_rate"]})
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    out = featured(model.rated(parsed(pages, rules))).withColumn("score", score)
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, fit(pages))


QUERIES = {"op3_url_filters": op3_url_filters}
ORACLE_SQL: dict[str, str] = {}

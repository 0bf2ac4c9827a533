"""Mixing sources to target weights by Poisson replication.

A document of source ``s`` appears as often as a Poisson variable of mean
``weight(s) * n_out / rows(s)`` says.  The variable is inverted from a uniform
number hashed from doc_id and seed, so the result is the same on every run and
on every retry: a source's cumulative probabilities are made once and joined
to its rows, which count those up to their number.  Copies are then ordered
globally by a hash of their own.  Everything is a Column expression; rows move
once, for the global order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, table

#: Sources whose tables (4 kB each at most) are broadcast; with more, rows are joined by source instead.
BROADCAST_SOURCES = 1_000
#: A larger mean is drawn as the sum of variables of at most this mean, as exp(-mean) must not underflow.
LARGEST_MEAN = 256.0
SEED = 20240117


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits, hashed from the given parts."""
    text = F.concat_ws("-", *[F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cumulative(mean: Column) -> Column:
    """The cumulative Poisson probabilities of 0, 1, ... up to where they are 1 to all 52 bits; mean at most ``LARGEST_MEAN``."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(acc: Column, i: Column) -> Column:
        p = acc.p * mean / i
        more = F.struct(p.alias("p"), (acc.c + p).alias("c"), F.array_append(acc["all"], acc.c + p).alias("all"))
        return F.when(acc.c < F.lit(1 - 2.0**-52), more).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["all"])


def draws(mean: Column) -> Column:
    """How many variables are summed for a mean."""
    return F.greatest(F.lit(1), F.ceil(mean / LARGEST_MEAN)).cast("int")


def repetitions(table: Column, parts: Column, key: Column, seed: int) -> Column:
    """A Poisson count from hashed numbers: of each, the least k of which the cumulative probability exceeds it.

    ``table`` has the cumulative probabilities of a variable, of which ``parts`` are summed.
    """

    def draw(i: Column) -> Column:
        u = uniform(key, str(seed), i)
        return F.size(F.filter(table, lambda c: c <= u))

    one = draw(F.lit(0))
    many = F.aggregate(F.transform(F.sequence(F.lit(0), parts - 1), draw), F.lit(0), lambda a, b: a + b)
    return F.when(parts == 1, one).otherwise(many)


def rates(docs: DataFrame, targets: dict[str, float] | None, n_out: int | None) -> DataFrame:
    """(source, rate) of each source that has rows; sources without a target get none."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if targets is None:
        counts = counts.withColumn("weight", F.lit(1.0))
    else:
        # weights count among the sources that have rows
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "name string, weight double")
        counts = counts.join(given, counts.source.eqNullSafe(given.name), "left").na.fill(0.0, ["weight"]).drop("name")
    rows, weights = counts.agg(F.sum("n"), F.sum("weight")).first()
    out = rows if n_out is None else n_out
    share = F.col("weight") / F.lit(weights) if weights else F.lit(0.0)
    return counts.select("source", (share * F.lit(float(out or 0)) / F.col("n")).alias("rate"))


def mix(
    docs: DataFrame,
    targets: dict[str, float] | None = None,
    n_out: int | None = None,
    seed: int = SEED,
    copy: str = "copy",
    order: str = "shuffle_key",
) -> DataFrame:
    """``docs`` with rows repeated or left out so that sources come in the proportions of ``targets``, in a global order.

    Adds the columns ``copy`` (0, 1, ... for one row) and ``order`` (the place in the order).
    ``targets`` gives weights by source, by default equal ones; they count in
    proportion, among the sources that have rows.  ``n_out`` is the expected
    number of rows, by default as many as there are.

    A null source is a source of its own (never among ``targets``).  Repeated
    rows and rows of one doc_id are repeated alike; a row without doc_id draws
    by a hash of its text.  Null and empty texts and those of any length are
    carried only.  Columns that have the names of the two that are added are
    replaced, all others stay as they are.  An empty table gives an empty result.

    The order is that of uniform numbers, so the bounds of its ranges are known
    beforehand, and rows move once without a look at them first.
    """
    docs = docs.drop(copy, order)
    source, rate, table, parts, n, own, place = fresh(docs, "_source", "_rate", "_table", "_parts", "_n", "_key", "_place")
    rated = rates(docs, targets, n_out).toDF(source, rate).withColumn(parts, draws(F.col(rate)))
    rated = rated.withColumn(table, cumulative(F.col(rate) / F.col(parts))).drop(rate)
    if len(rated.select(source).take(BROADCAST_SOURCES + 1)) <= BROADCAST_SOURCES:
        rated = F.broadcast(rated)
    by_text = F.concat(F.lit("~"), F.xxhash64("text").cast("string")) if "text" in docs.columns else F.lit("")
    key = F.coalesce(F.col("doc_id").cast("string"), by_text)
    held = docs.join(rated, docs.source.eqNullSafe(F.col(source))).withColumn(own, key)
    copies = held.withColumn(n, repetitions(F.col(table), F.col(parts), F.col(own), seed)).where(F.col(n) > 0)
    copies = copies.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    copies = copies.withColumn(order, uniform("order", F.col(own), F.col(copy), str(seed)))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = copies.withColumn(place, F.floor(F.col(order) * ranges).cast("int")).repartitionById(ranges, place)
    return dealt.sortWithinPartitions(order, "doc_id", copy).select(*docs.columns, copy, order)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP6_SQL = f"""
with recursive counts as (select source, count(*) as n from documents group by source),
rates as (select source, 1.0::double / (select count(*) from counts) * (select sum(n)::double from counts) / n as rate from counts),
cdf as (select source, rate, 0 as k, exp(-rate) as p, exp(-rate) as c from rates
  union all select source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from cdf where k < rate + 12 * sqrt(rate) + 40),
drawn as (select d.*, cast('0x' || substr(md5(d.doc_id || '-{SEED}-0'), 1, 13) as bigint) / {float(1 << 52)}::double as u from documents d),
counted as (select doc_id, d.source, count(*) filter (where c <= u) as n
  from drawn d join cdf on d.source is not distinct from cdf.source group by all),
copies as (select doc_id, unnest(range(n))::int as copy from counted)
select d.*, copy,
  cast('0x' || substr(md5('order-' || doc_id || '-' || copy || '-{SEED}'), 1, 13) as bigint) / {float(1 << 52)}::double as shuffle_key
from documents d join copies using (doc_id)
"""

QUERIES = {"op6_mixing": op6_mixing}
ORACLE_SQL = {"op6_mixing": OP6_SQL}

"""Mixing sources to target weights by Poisson replication.

Each source gets the repetition rate that turns its share of the rows into its target share. A document's
number of copies is the inverse Poisson distribution function, with that rate as mean, at a uniform number
hashed from the seed and the document's id; its copies go to hashed places of a global shuffle. Only
DataFrame functions run.

The distribution function of a rate is summed over the counts within DEVIATIONS standard deviations around it (the
rest is far below the numbers' resolution), from probabilities in closed form; so a rate of a million costs some
thousand values, and a row looks through fewer values than it gives copies.

Defined results: a null source is a source of its own, and so is one that ``weights`` does not name (weight
``default_weight``); sources without rows take no part; repeated rows with one id draw the same number of
copies; a null id draws as the empty id; null or empty texts are documents like others; an empty table gives
an empty result; columns named like ours (``copy``, ``shuffle_key``) are replaced.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.tables import checkpointed

NULL_SOURCE = "\x00null"
#: Values of all distribution functions up to which they are broadcast (16 MB); beyond, they are joined by a shuffle.
BROADCAST_VALUES = 2_000_000
DEVIATIONS, BLOCK = 12, 4096


def uniform(*parts: Column | str) -> Column:
    """52 bits of an MD5 of the parts as a number in [0, 1); the same in any SQL engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(2.0**52)


def poisson_mass(k: Column, rate: Column) -> Column:
    """The Poisson probability of ``k``: by factorials up to 20, beyond that by the saddle point and Stirling's series, which lose no digits near the rate."""
    x, d = k.cast("double"), (k - rate) / rate
    small = F.exp(x * F.log(F.greatest(rate, F.lit(1e-300))) - rate - F.log(F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double")))
    series = F.lit(1 / 12) / x - F.lit(1 / 360) / x**3 + F.lit(1 / 1260) / x**5 - F.lit(1 / 1680) / x**7
    distance = rate * ((1 + d) * F.log1p(d) - d)
    return F.when(rate == 0, (k == 0).cast("double")).when(k <= 20, small).otherwise(F.exp(-series - distance) / F.sqrt(x * (2 * pi)))


def poisson_table(rates: DataFrame) -> DataFrame:
    """``rates`` (mix_source, rate) with ``least`` and ``steps``: the distribution function at least, least + 1, ..."""
    reach = F.lit(float(DEVIATIONS)) * F.sqrt("rate") + 20
    counts = rates.select("mix_source", "rate", F.explode(F.sequence(F.greatest(F.floor(F.col("rate") - reach), F.lit(0)), F.ceil(F.col("rate") + reach))).alias("k"))
    grown = Window.partitionBy("mix_source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.select("mix_source", "k", F.sum(poisson_mass(F.col("k"), F.col("rate"))).over(grown).alias("cdf"))
    # the sums rise with k, but for equal ones at the end, whose order is nothing
    return summed.groupBy("mix_source").agg(F.min("k").alias("least"), F.sort_array(F.collect_list("cdf")).alias("steps"))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, default_weight: float = 1.0, budget: float = 1.0) -> tuple[DataFrame, int, float]:
    """One row per source: ``mix_source``, rows, target share, repetition rate (``budget`` x rows in all); the values that their distribution functions take; and the largest rate."""
    counts = checkpointed(docs.groupBy(F.coalesce(F.col("source"), F.lit(NULL_SOURCE)).alias("mix_source")).agg(F.count(F.lit(1)).alias("n")))
    weight = F.lit(float(default_weight))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("mix_source") == F.lit(NULL_SOURCE if name is None else name), F.lit(float(w))).otherwise(weight)
    total = counts.agg(F.sum("n").alias("n"), F.sum(weight).alias("w")).first()
    share = weight / F.lit(total.w) if total.w else F.lit(0.0)
    rates = counts.withColumn("share", share).withColumn("rate", F.col("share") * F.lit(float(budget)) * F.lit(float(total.n or 0)) / F.col("n"))
    size = rates.agg(F.sum(2 * DEVIATIONS * F.sqrt("rate") + 40).alias("values"), F.max("rate").alias("rate")).first()
    return rates, int(size["values"] or 0), size.rate or 0.0


def drawn_copies(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, budget: float = 1.0, seed: str = "mix-1") -> DataFrame:
    """``docs`` with ``mix_copies``, the number of copies drawn for each row."""
    rates, values, _ = source_rates(docs, weights, default_weight, budget)
    return _drawn(docs, rates, values, seed)


def _drawn(docs: DataFrame, rates: DataFrame, values: int, seed: str) -> DataFrame:
    table = poisson_table(rates)
    keyed = docs.withColumn("mix_source", F.coalesce(F.col("source"), F.lit(NULL_SOURCE))).withColumn("mix_u", uniform(F.lit(seed), F.col("doc_id")))
    drawn = keyed.join(F.broadcast(table) if values <= BROADCAST_VALUES else table, "mix_source")
    copies = F.col("least") + F.size(F.filter("steps", lambda c: c <= F.col("mix_u")))
    return drawn.withColumn("mix_copies", copies.cast("bigint")).drop("least", "steps", "mix_u", "mix_source")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, budget: float = 1.0, seed: str = "mix-1") -> DataFrame:
    """``docs``, each row as often as drawn, in a global hashed order, with ``copy`` (from 0) and ``shuffle_key``.

    Rows go to partitions by a hash of their uniform key and are sorted by it there, so the whole is one
    uniform permutation for the price of one exchange.
    """
    docs = docs.drop("copy", "shuffle_key")
    rates, values, largest = source_rates(docs, weights, default_weight, budget)
    drawn = _drawn(docs, rates, values, seed).where("mix_copies > 0")
    # in blocks, so that no row holds all its copies at once; those of rare sources are dealt out before they are made
    blocks = drawn.withColumn("mix_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("mix_copies") - 1) / BLOCK))))
    if largest > BLOCK:
        blocks = blocks.repartition("doc_id", "mix_block")
    place = F.col("mix_block") * BLOCK
    exploded = blocks.withColumn("copy", F.explode(F.sequence(place, F.least(place + BLOCK, F.col("mix_copies")) - 1))).drop("mix_copies", "mix_block")
    spread = exploded.withColumn("shuffle_key", uniform(F.lit(seed), F.lit("place"), F.col("doc_id"), F.col("copy")))
    return spread.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key").select(*docs.columns, "copy", "shuffle_key")


def op2_poisson_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "source", "text", "copy", "shuffle_key")


OP2_SQL = """
WITH counts AS (SELECT coalesce(source, chr(1) || 'null') AS mix_source, count(*) AS n FROM documents GROUP BY 1),
rates AS (SELECT mix_source, (1.0::DOUBLE / (SELECT sum(1.0::DOUBLE) FROM counts)) * 1.0::DOUBLE * (SELECT sum(n) FROM counts)::DOUBLE / n AS rate FROM counts),
ks AS (SELECT mix_source, rate, unnest(range(greatest(floor(rate - 12 * sqrt(rate) - 20), 0)::BIGINT, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM rates),
sums AS (SELECT mix_source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY mix_source ORDER BY k ROWS UNBOUNDED PRECEDING) AS cdf FROM ks),
steps AS (SELECT mix_source, min(k) AS least, list(cdf ORDER BY k) AS cdfs FROM sums GROUP BY mix_source),
drawn AS (SELECT d.doc_id, d.source, d.text, coalesce(d.source, chr(1) || 'null') AS mix_source,
  ('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM documents d),
copies AS (SELECT d.doc_id, d.source, d.text, unnest(range(least + len(list_filter(cdfs, lambda c: c <= u)))) AS copy FROM drawn d JOIN steps s ON s.mix_source = d.mix_source)
SELECT doc_id, source, text, copy::BIGINT AS copy,
  ('0x' || substr(md5('mix-1|place|' || coalesce(doc_id::VARCHAR, '') || '|' || copy::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS shuffle_key
FROM copies
"""

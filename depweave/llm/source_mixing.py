"""Mixing sources to target weights by Poisson replication.

Source s with n of all N rows and target weight w (weights sum to 1) gets the mean repetition rate
``epochs * N * w / n``. Every row inverts the Poisson distribution of that mean at a uniform number hashed from the
seed and its key; it is exploded into so many copies, and all copies are shuffled by a hash of seed, key and copy
number, in whose order each partition is sorted. Running it again gives the same rows.

Means above ``PART`` are cut into equal parts of at most that, each drawn with a hash of its own; a sum of Poisson
numbers is one of the summed mean. Null is a source like any other, rows with one key (repeated rows, null keys)
share a draw, sources without a weight in a given mapping get 0, texts, long or empty, are never touched, columns named ``copy`` or
``mix_key`` are replaced and others pass through whatever their names, an empty table gives an empty table.

Rates are one row a source. Up to ``MANY_SOURCES`` of them are broadcast; beyond, they are joined by a shuffle in
which every source is dealt over ``SALTS`` keys.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.llm.common import Sheltered

PART = 16
TERMS = 80
MANY_SOURCES = 10_000
SALTS = 64
SEED = 20240601
ALPHA = 0.5


def _hash52(*parts: Column | str) -> Column:
    """52 bits of an MD5 digest as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, alpha: float = ALPHA, epochs: float = 1.0, source: str = "source") -> DataFrame:
    """One row a source: source, n, rate. Without weights, a source's weight is n to the power alpha."""
    counted = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counted.withColumn("w", F.pow("n", F.lit(float(alpha))))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "k string, w double")
        weighed = counted.join(given, F.col("source").eqNullSafe(F.col("k")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    total = weighed.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w")).first()
    every, share = total["all_n"] or 0, total["all_w"] or 0.0
    return weighed.select("source", "n", (F.lit(float(epochs)) * every * F.col("w") / (share or 1.0) / F.col("n")).alias("rate"))


def poisson_cdf(mean: Column) -> Column:
    """Array of P(X <= k) for k = 0 ... TERMS."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def more(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, more, lambda acc: acc["c"])


def replicate(docs: DataFrame, weights: Mapping[str | None, float] | None = None, alpha: float = ALPHA, epochs: float = 1.0, seed: int = SEED, source: str = "source", key: str = "doc_id") -> DataFrame:
    """All columns of docs for each copy, with copy (from 1) and mix_key, globally shuffled."""
    spark = docs.sparkSession
    own = Sheltered(docs, ["copy", "mix_key"], [source, key])
    key, source = own.of(key), own.of(source)
    table = rates(own.docs, weights, alpha, epochs, source)
    few = table.limit(MANY_SOURCES + 1).collect()
    parts = F.greatest(F.ceil(F.col("__rate") / PART), F.lit(1)).cast("int")
    with_cdf = lambda t: t.withColumn("__parts", parts).withColumn("__cdf", poisson_cdf(F.col("__rate") / F.col("__parts")))
    rows = own.docs.withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit("null")))
    if len(few) <= MANY_SOURCES:
        known = spark.createDataFrame([(r["source"], r["rate"]) for r in few], "__source string, __rate double")
        joined = rows.join(F.broadcast(with_cdf(known)), F.col(source).cast("string").eqNullSafe(F.col("__source")))
    else:
        known = table.select(F.col("source").cast("string").alias("__source"), F.col("rate").alias("__rate"))
        salted = with_cdf(known).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__s", F.pmod(F.xxhash64("__key"), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, F.col(source).cast("string").eqNullSafe(F.col("__source")) & (F.col("__s") == F.col("__salt"))).drop("__salt", "__s")
    draw = lambda j: (_hash52(F.lit(str(seed)), j.cast("string"), F.col("__key")) + 0.5) / float(1 << 52)
    count = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.col("__parts")), draw),
        F.lit(0),
        lambda n, u: n + F.size(F.filter("__cdf", lambda c: c < u)),
    )
    copies = joined.withColumn("__n", count).where("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    mixed = copies.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(f"order {seed}"), "__key", F.col("copy").cast("string"))))
    return mixed.select(*own.inner, "copy", "mix_key").repartition("mix_key").sortWithinPartitions("mix_key").toDF(*own.names, "copy", "mix_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the documents replicated to source weights in proportion to the square root of their rows."""
    return replicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH counted AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rated AS (
  SELECT source, sum(n) OVER () * pow(n, {ALPHA}) / sum(pow(n, {ALPHA})) OVER () / n AS rate FROM counted),
parted AS (SELECT source, rate, greatest(ceil(rate / {PART}), 1)::INT AS parts FROM rated),
pmf AS (
  SELECT source, parts, k, exp(-(rate / parts) + k * ln(rate / parts) - lgamma(k + 1)) AS p
  FROM parted, (SELECT unnest(range(0, {TERMS + 1})) AS k)),
cdf AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
cdfs AS (SELECT source, parts, list(c ORDER BY k) AS cs FROM cdf GROUP BY source, parts),
drawn AS (
  SELECT d.*, cs, unnest(range(1, parts + 1)) AS j FROM documents d JOIN cdfs ON d.source IS NOT DISTINCT FROM cdfs.source),
uniform AS (
  SELECT *, (('0x' || substr(md5('{SEED}|' || j || '|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / {1 << 52}::DOUBLE AS u FROM drawn),
counts AS (
  SELECT doc_id, text, lang, source, n_chars, sum(len(list_filter(cs, lambda x: x < u)))::INT AS n
  FROM uniform GROUP BY ALL),
copies AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INT AS copy FROM counts)
SELECT *, md5('order {SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy) AS mix_key FROM copies
"""

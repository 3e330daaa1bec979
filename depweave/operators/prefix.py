"""Whole-segment prefix operators: what a segment trie answers, as equi-joins on exploded prefixes.

``prefixes`` is a table with a column ``prefix``; ``values`` any table. Each distinct value is exploded into its own
segment prefixes (as many as it has segments), joined by equality and folded back, so no pair of tables is compared
row by row and a value that most rows share is looked up once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.functions.paths import parent, segment_prefixes


def _hits(values: DataFrame, value: str, prefixes: DataFrame, sep: str, itself: bool = True) -> DataFrame:
    """Distinct (__value, __hit): stored prefixes of the values."""
    own = values.select(F.col(value).alias("__value")).where("__value IS NOT NULL").distinct()
    return own.withColumn("__hit", F.explode(segment_prefixes("__value", sep, itself))).join(prefixes.select(F.col("prefix").alias("__hit")).distinct(), "__hit")


def matches(values: DataFrame, value: str, prefixes: DataFrame, sep: str = ".", out: str = "matches") -> DataFrame:
    """Whether a stored prefix is the value or an ancestor of it."""
    found = _hits(values, value, prefixes, sep).select("__value").distinct().withColumn("__yes", F.lit(True))
    return values.join(found, F.col(value) == F.col("__value"), "left").withColumn(out, F.coalesce("__yes", F.lit(False))).drop("__value", "__yes")


def longest_prefix(values: DataFrame, value: str, prefixes: DataFrame, sep: str = ".", out: str = "longest") -> DataFrame:
    """The longest stored prefix of the value, null if there is none."""
    found = _hits(values, value, prefixes, sep).groupBy("__value").agg(F.max_by("__hit", F.length("__hit")).alias("__longest"))
    return values.join(found, F.col(value) == F.col("__value"), "left").withColumn(out, F.col("__longest")).drop("__value", "__longest")


def strict_prefix(values: DataFrame, value: str, prefixes: DataFrame, sep: str = ".", out: str = "strict") -> DataFrame:
    """Whether the value lies above a stored prefix and is not stored itself."""
    stored = prefixes.select(F.col("prefix").alias("__value")).distinct()
    above = stored.select(F.explode(segment_prefixes("__value", sep, itself=False)).alias("__value")).distinct().join(stored, "__value", "left_anti").withColumn("__yes", F.lit(True))
    return values.join(above, F.col(value) == F.col("__value"), "left").withColumn(out, F.coalesce("__yes", F.lit(False))).drop("__value", "__yes")


def suffixes_of(values: DataFrame, value: str, prefixes: DataFrame, sep: str = ".", out: str = "suffix", join: str | None = None) -> DataFrame:
    """A row for each stored prefix strictly below the value, with what follows the value, its segments joined by ``join``."""
    stored = prefixes.select("prefix").distinct().withColumn("__above", F.explode(segment_prefixes("prefix", sep, itself=False)))
    rest = F.substring(F.col("prefix"), F.length("__above") + len(sep) + 1, F.length("prefix"))
    if join is not None:
        rest = F.replace(rest, F.lit(sep), F.lit(join))
    return values.join(stored.select(F.col("__above"), rest.alias(out)), F.col(value) == F.col("__above")).drop("__above")


def wildcard_children(patterns: DataFrame, pattern: str, modules: DataFrame, name: str = "py", sep: str = ".") -> DataFrame:
    """Modules that ``p.*`` means: p and one more segment."""
    base = patterns.where(F.col(pattern).endswith(f"{sep}*")).withColumn("__base", F.expr(f"left({pattern}, length({pattern}) - {len(sep) + 1})"))
    return base.join(modules.withColumn("__base", parent(name, sep)), "__base").drop("__base")


def tracked(names: DataFrame, name: str, first_segments: list[str], ignored: list[str], sep: str = ".") -> DataFrame:
    """Names whose first segment is listed and that begin with no ignored text (by characters, not segments)."""
    keep = F.substring_index(F.col(name), sep, 1).isin(first_segments)
    for x in ignored:
        keep = keep & ~F.col(name).startswith(x)
    return names.where(keep)

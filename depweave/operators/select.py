"""Selecting test items for a change set, and how much that saves over past commits.

items: item_id, name, file, data_file (null if none). All sets are one-column tables of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_modified(affected: DataFrame, modified: DataFrame, column: str = "path") -> DataFrame:
    """Affected files and the change set itself."""
    return affected.select(F.col(affected.columns[0]).alias(column)).unionByName(modified.select(column)).distinct()


def _flag(items: DataFrame, column: str, names: DataFrame, out: str) -> DataFrame:
    listed = names.select(F.col(names.columns[0]).alias("__name")).where("__name IS NOT NULL").distinct().withColumn("__yes", F.lit(True))
    return items.join(listed, F.col(column) == F.col("__name"), "left").withColumn(out, F.coalesce("__yes", F.lit(False))).drop("__name", "__yes")


def keep_flags(items: DataFrame, known: DataFrame, affected: DataFrame, always: DataFrame, exposed: DataFrame, name_with_file: bool = False) -> DataFrame:
    """items with keep: the file is unknown to the graph, or file or data file is affected, always run or has unhandled dynamic
    imports (exposed: file paths), or the item's name is always run (with name_with_file also as ``file:name``)."""
    flagged = _flag(items, "file", known, "__known")
    for column, names, out in (("file", affected, "__a"), ("data_file", affected, "__b"), ("file", always, "__c"), ("data_file", always, "__d"), ("name", always, "__e"), ("file", exposed, "__f"), ("data_file", exposed, "__g")):
        flagged = _flag(flagged, column, names, out)
    keep = ~F.col("__known")
    for out in "abcdefg":
        keep = keep | F.col(f"__{out}")
    if name_with_file:
        flagged = _flag(flagged.withColumn("__full", F.concat_ws(":", "file", "name")), "__full", always, "__h").drop("__full")
        keep = keep | F.col("__h")
    return flagged.withColumn("keep", keep).drop("__known", *(f"__{x}" for x in "abcdefgh"))


def residual_risk(modified: DataFrame, test_files: DataFrame, existing: DataFrame, known: DataFrame, relevant: Column | None = None) -> DataFrame:
    """Changed files that exist, are no tests, pass the relevance condition and are unknown to the graph."""
    left = modified.select("path").distinct() if relevant is None else modified.where(relevant).select("path").distinct()
    for names, how in ((test_files, "left_anti"), (existing, "left_semi"), (known, "left_anti")):
        left = left.join(names.select(F.col(names.columns[0]).alias("path")), "path", how)
    return left


def with_fallback(flagged: DataFrame, risk: DataFrame) -> DataFrame:
    """Keeps everything if any risk is left: a one-row flag, joined by a constant."""
    flag = risk.agg((F.count(F.lit(1)) > 0).alias("__unsafe")).withColumn("__one", F.lit(1))
    joined = flagged.withColumn("__one", F.lit(1)).join(F.broadcast(flag), "__one")
    return joined.withColumn("keep", F.col("keep") | F.col("__unsafe")).drop("__one", "__unsafe")


def dynamic_guard(exposed: DataFrame, handled: bool) -> DataFrame:
    """Files with unhandled dynamic imports: none if the configuration handles them."""
    return exposed.limit(0) if handled else exposed


def impact(kept: DataFrame, commits: DataFrame, n_items: int | Column, unsafe: DataFrame) -> DataFrame:
    """(commit_id, kept, pruned, class, gain) from kept (commit_id, item_id), all commits, and unsafe (commit_id).

    Class: unsafe, else skipped (nothing kept), nogain (nothing pruned) or partial. gain is pruned / items, null without items.
    Takes only the pairs that are kept, so commits and items are never crossed.
    """
    counts = kept.select("commit_id", "item_id").distinct().groupBy("commit_id").agg(F.count(F.lit(1)).alias("kept"))
    n = F.lit(n_items) if isinstance(n_items, int) else n_items
    base = commits.select("commit_id").distinct().join(counts, "commit_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    base = _flag(base, "commit_id", unsafe, "__unsafe").withColumn("pruned", n - F.col("kept"))
    name = F.when(F.col("__unsafe"), "unsafe").when(F.col("kept") == 0, "skipped").when(F.col("pruned") == 0, "nogain").otherwise("partial")
    return base.select("commit_id", "kept", "pruned", name.alias("class"), F.try_divide(F.col("pruned").cast("double"), n.cast("double")).alias("gain"))


def impact_summary(impacts: DataFrame) -> DataFrame:
    """(class, n, share) with all four classes; share is null without commits."""
    spark = impacts.sparkSession
    classes = spark.createDataFrame([(c,) for c in ("unsafe", "skipped", "nogain", "partial")], "class string")
    counted = impacts.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    total = impacts.agg(F.count(F.lit(1)).alias("total")).withColumn("__one", F.lit(1))
    out = classes.join(counted, "class", "left").withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one")
    return out.select("class", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), F.col("total").cast("double")).alias("share"))


def gain_distribution(impacts: DataFrame) -> DataFrame:
    """One row: mean, median and inclusive deciles d1 ... d9 of gain over partial commits; nulls if there are none."""
    partial = impacts.where("class = 'partial'")
    tenths = [k / 10 for k in range(1, 10)]
    row = partial.agg(F.avg("gain").alias("mean"), F.percentile("gain", 0.5).alias("median"), F.percentile("gain", F.array(*map(F.lit, tenths))).alias("__d"))
    return row.select("mean", "median", *(F.element_at("__d", k).alias(f"d{k}") for k in range(1, 10)))

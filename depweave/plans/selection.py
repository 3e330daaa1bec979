"""Choosing tests for a change set, and replaying that over past commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.operators import queries, select
from depweave.plans.dependency_graph import DependencyGraph
from depweave.plans.hooks import Hook


def select_items(graph: DependencyGraph, hook: Hook, items: DataFrame, modified: DataFrame, existing: DataFrame) -> DataFrame:
    """items with keep. modified (path); existing (path) are the files on disk. If a change can't be judged, everything is kept."""
    affected = select.with_modified(graph.affected_by_files(modified), modified)
    known = graph.modules.where("fs IS NOT NULL").select("fs")
    seeds = queries.nodes_of_modules(graph.modules, ["importlib", "__import__"])
    exposed = select.dynamic_guard(queries.affected_files(graph.reach, graph.modules, seeds), hook.handles_dynamic())
    always = queries.as_frame(graph.spark, hook.always_run, "name")
    flagged = select.keep_flags(items, known, affected.where(hook.is_relevant(F.col("path"))), always, exposed)
    return select.with_fallback(flagged, select.residual_risk(modified, items.select("file"), existing, known, hook.is_relevant(F.col("path"))))


def impact_of(graph: DependencyGraph, hook: Hook, items: DataFrame, modified: DataFrame, existing: DataFrame) -> DataFrame:
    """select.impact for modified (commit_id, path): the graph and items of now stand for those of each commit.

    All commits at once: changed files meet what reaches them by joins on paths, so nothing is asked commit by commit.
    """
    spark, modules = graph.spark, graph.modules
    fs = modules.where("fs IS NOT NULL").select("node", "fs")
    reach = graph.reach.join(fs.select(F.col("node").alias("src"), F.col("fs").alias("path")), "src").join(fs.select(F.col("node").alias("dst"), F.col("fs").alias("changed")), "dst").select("path", "changed")
    touched = modified.join(reach.withColumnRenamed("path", "__p"), F.col("path") == F.col("changed")).select("commit_id", F.col("__p").alias("path"))
    affected = touched.unionByName(modified.select("commit_id", "path")).distinct().where(hook.is_relevant(F.col("path")))
    empty = spark.createDataFrame([], "name string")
    seeds = queries.nodes_of_modules(modules, ["importlib", "__import__"])
    exposed = select.dynamic_guard(queries.affected_files(graph.reach, modules, seeds), hook.handles_dynamic())
    always_kept = select.keep_flags(items, fs.select("fs"), empty, queries.as_frame(spark, hook.always_run, "name"), exposed).where("keep").select("item_id")
    commits = modified.select("commit_id").distinct()
    # Items kept whatever changes count for each commit; the others by the files they stand on.
    files = items.select("item_id", F.explode(F.array_compact(F.array("file", "data_file"))).alias("path"))
    by_change = affected.join(files, "path").select("commit_id", "item_id").join(always_kept, "item_id", "left_anti").distinct()
    fixed, n = always_kept.distinct().count(), items.count()
    risk = modified.where(hook.is_relevant(F.col("path"))).join(items.select(F.col("file").alias("path")), "path", "left_anti").join(existing.select("path"), "path", "left_semi").join(fs.select(F.col("fs").alias("path")), "path", "left_anti")
    out = select.impact(by_change, commits, n - fixed, risk.select("commit_id"))
    if not fixed:
        return out
    kept = F.col("kept") + fixed
    name = F.when(F.col("class") == "unsafe", "unsafe").when(F.col("pruned") == 0, "nogain").otherwise("partial")
    return out.select("commit_id", kept.alias("kept"), "pruned", name.alias("class"), (F.col("pruned") / F.lit(float(n))).alias("gain"))

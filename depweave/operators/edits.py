"""Edges added by configuration: dynamic edges before the closure, leaf edges after it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.operators.prefix import wildcard_children
from depweave.operators.queries import first_match, module_or_parent, nearest_module
from depweave.session import materialise


def dynamic_edges(modules: DataFrame, given: Mapping[str, Iterable[str]] | DataFrame) -> DataFrame:
    """Edges of (trigger, dep): triggers by path or import path, deps by import path, its parent, or ``p.*`` for p's children. Unknown ones are left out."""
    if not isinstance(given, DataFrame):
        given = modules.sparkSession.createDataFrame([(t, d) for t, deps in given.items() for d in deps], "trigger string, dep string")
    from_ = first_match(given, "trigger", modules).where("node IS NOT NULL").withColumnRenamed("node", "src")
    children = wildcard_children(from_, "dep", modules.where("pkg IS NULL").select("py", F.col("node").alias("dst"))).select("src", "dst")
    single = module_or_parent(from_.where(~F.col("dep").endswith(".*")), "dep", modules, "dst").where("dst IS NOT NULL").select("src", "dst")
    return children.unionByName(single).where("src <> dst").distinct()


def leaf_edges(reach: DataFrame, modules: DataFrame, given: Iterable[tuple[str, Mapping[str, Iterable[str]]]]) -> DataFrame:
    """The closure with late edges, applied trigger by trigger, as each step changes what the next one sees.

    For a trigger and a local root: every module of that root that reaches the trigger and that nothing reaches gets
    each dependency (its nearest known ancestor) and what that reaches beyond the trigger's own.
    """
    spark = reach.sparkSession
    for trigger, by_pkg in given:
        rows = [(pkg, dep) for pkg, deps in by_pkg.items() for dep in deps]
        if not rows:
            continue
        at = materialise(first_match(spark.createDataFrame([(trigger,)], "name string"), "name", modules).where("node IS NOT NULL").select(F.col("node").alias("trigger")), "trigger")
        known = reach.join(at, F.col("src") == F.col("trigger"), "left_semi").select("dst")
        start = nearest_module(spark.createDataFrame(rows, "pkg string, dep string"), "dep", modules, out="c").where("c IS NOT NULL").select("pkg", "c").distinct()
        further = start.join(reach, F.col("c") == F.col("src")).select("pkg", "dst").join(known, "dst", "left_anti")
        extra = start.select("pkg", F.col("c").alias("dst")).unionByName(further.select("pkg", "dst")).distinct().join(at, F.col("dst") == F.col("trigger"), "left_anti")
        above = reach.join(at, F.col("dst") == F.col("trigger"), "left_semi").select(F.col("src").alias("node")).join(at, F.col("node") == F.col("trigger"), "left_anti")
        leaves = above.join(reach.select(F.col("dst").alias("node")), "node", "left_anti").join(modules.where("pkg IS NOT NULL").select("node", "pkg"), "node")
        new = leaves.join(extra, "pkg").select(F.col("node").alias("src"), "dst").where("src <> dst")
        reach = materialise(reach.select("src", "dst").unionByName(new).distinct(), "reach")
    return reach

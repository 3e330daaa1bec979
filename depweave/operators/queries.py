"""What depends on what: lookups over a saved closure, or over edges where only a few seeds are asked about.

Tables: modules (node, fs, py, pkg), reach (src, dst). Unknown inputs are skipped; a single-module question about an unknown
module gives None, not an empty answer.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.functions.paths import is_test_file, segment_prefixes

Names = Iterable[str] | DataFrame | None


def as_frame(spark: SparkSession, names: Names, column: str) -> DataFrame:
    """Names as a one-column table: None, an iterable of strings, or a DataFrame's first column."""
    if isinstance(names, DataFrame):
        return names.select(F.col(names.columns[0]).alias(column)).distinct()
    if isinstance(names, (str, bytes)) or not (names is None or isinstance(names, Iterable)):
        raise TypeError("expected None, an iterable of strings or a DataFrame")
    return spark.createDataFrame([(str(n),) for n in sorted(set(names or []))], f"{column} string")


def nodes_of_files(modules: DataFrame, paths: Names) -> DataFrame:
    return modules.join(as_frame(modules.sparkSession, paths, "fs"), "fs", "left_semi").select("node")


def nodes_of_modules(modules: DataFrame, names: Names) -> DataFrame:
    """Global modules by import path."""
    return modules.where("pkg IS NULL").join(as_frame(modules.sparkSession, names, "py"), "py", "left_semi").select("node")


def depends_on(reach: DataFrame, modules: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (pkg, py) that any of the nodes reaches."""
    hit = reach.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    return modules.join(hit, "node", "left_semi").select("pkg", "py").distinct()


def affected(reach: DataFrame, modules: DataFrame, nodes: DataFrame) -> DataFrame:
    """Modules that reach any of the nodes."""
    hit = reach.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
    return modules.join(hit, "node", "left_semi")


def affected_files(reach: DataFrame, modules: DataFrame, nodes: DataFrame) -> DataFrame:
    return affected(reach, modules, nodes).where("fs IS NOT NULL").select("fs").distinct()


def affected_modules(reach: DataFrame, modules: DataFrame, nodes: DataFrame) -> DataFrame:
    return affected(reach, modules, nodes).select("py").distinct()


def local_affected(reach: DataFrame, modules: DataFrame, nodes: DataFrame, column: str = "fs") -> DataFrame:
    """(pkg, affected): sorted names by local root; modules without a file are left out of files."""
    found = affected(reach, modules, nodes).where(F.col("pkg").isNotNull() & F.col(column).isNotNull())
    return found.groupBy("pkg").agg(F.sort_array(F.collect_set(column)).alias("affected"))


def unresolved_report(unresolved: DataFrame) -> DataFrame:
    """(target, importers) of unresolved (target, importer)."""
    return unresolved.groupBy("target").agg(F.sort_array(F.collect_set("importer")).alias("importers"))


def dynamic_exposure(reach: DataFrame, modules: DataFrame, test_glob: str | None = None) -> DataFrame:
    """Test files that reach importlib or __import__."""
    seeds = nodes_of_modules(modules, ["importlib", "__import__"])
    return affected_files(reach, modules, seeds).where(is_test_file("fs", test_glob))


def first_match(names: DataFrame, name: str, modules: DataFrame) -> DataFrame:
    """names with ``node``: the module of that path, else the global one of that import path, else the local one with the least pkg."""
    by_fs = modules.where("fs IS NOT NULL").select(F.col("fs").alias("__k1"), F.col("node").alias("__fs"))
    by_py = modules.where("pkg IS NULL").select(F.col("py").alias("__k2"), F.col("node").alias("__py"))
    local = modules.where("pkg IS NOT NULL").groupBy(F.col("py").alias("__k3")).agg(F.min_by("node", "pkg").alias("__local"))
    out = names.join(by_fs, F.col(name) == F.col("__k1"), "left").join(by_py, F.col(name) == F.col("__k2"), "left").join(local, F.col(name) == F.col("__k3"), "left")
    return out.withColumn("node", F.coalesce("__fs", "__py", "__local")).drop("__k1", "__k2", "__k3", "__fs", "__py", "__local")


def nearest_module(names: DataFrame, name: str, modules: DataFrame, most_up: int | None = None, out: str = "node") -> DataFrame:
    """names with the node of the longest global import path that is the name or an ancestor; at most ``most_up`` segments up."""
    known = modules.where("pkg IS NULL").select(F.col("py").alias("__at"), F.col("node").alias("__node"))
    own = names.select(F.col(name).alias("__name")).distinct().withColumn("__all", segment_prefixes("__name"))
    if most_up is not None:
        own = own.withColumn("__all", F.slice("__all", F.greatest(F.size("__all") - most_up, F.lit(1)), most_up + 1))
    hits = own.select("__name", F.explode("__all").alias("__at")).join(known, "__at").groupBy("__name").agg(F.max_by("__node", F.length("__at")).alias(out))
    return names.join(hits, F.col(name) == F.col("__name"), "left").drop("__name")


def module_or_parent(names: DataFrame, name: str, modules: DataFrame, out: str = "node") -> DataFrame:
    """The global module of that name, else that of its parent."""
    return nearest_module(names, name, modules, most_up=1, out=out)

"""Tables of the data model and the checks that hold for them.

A module is a row (fs, py, pkg): file, dotted import path, and the root of its local namespace or null if it is global.
fs is null for external modules and namespace packages. Graph operators name a node by ``node_key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILES = "path string, source string, error string"
SOURCE_ROOTS = "fs_root string, py_prefix string, is_local boolean"
NAMESPACES = "name string, kind string"
MODULES = "node string, fs string, py string, pkg string"
EDGES = "src string, dst string"
UNRESOLVED = "target string, importer string"
TRACE = "session string, seq long, context string, module string, status string, is_ignored boolean, anchor_module string, anchor_fn string"
TEST_ITEMS = "item_id long, name string, file string, data_file string"


def node_key(fs: Column, py: Column) -> Column:
    """A file's path, or the import path in angle brackets for a module without a file."""
    return F.coalesce(fs, F.concat(F.lit("<"), py, F.lit(">")))


def violations(modules: DataFrame) -> DataFrame:
    """(rule, key, n) for every broken constraint of a module table; empty if it is sound."""
    named = modules.where("py IS NOT NULL")
    checks = [
        modules.where("fs IS NOT NULL").groupBy(F.col("fs").alias("key")).count().where("count > 1").select(F.lit("fs repeated").alias("rule"), "key", F.col("count").alias("n")),
        named.where("pkg IS NULL").groupBy(F.col("py").alias("key")).count().where("count > 1").select(F.lit("global py repeated").alias("rule"), "key", F.col("count").alias("n")),
        named.where("pkg IS NOT NULL").groupBy("pkg", "py").count().where("count > 1").select(F.lit("local py repeated").alias("rule"), F.concat_ws(":", "pkg", "py").alias("key"), F.col("count").alias("n")),
        named.where(F.col("py").contains("/")).select(F.lit("separator in py").alias("rule"), F.col("py").alias("key"), F.lit(1).cast("long").alias("n")),
        modules.where("py IS NULL").select(F.lit("py missing").alias("rule"), F.col("fs").alias("key"), F.lit(1).cast("long").alias("n")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def merge_modules(found: DataFrame) -> DataFrame:
    """One row for each (py, pkg) of all sightings (fs, py, pkg): a file, if any sighting has one (the first by name)."""
    return found.groupBy("py", "pkg").agg(F.min("fs").alias("fs")).select(node_key(F.col("fs"), F.col("py")).alias("node"), "fs", "py", "pkg")


def neighbour_violations(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges between different local roots that aren't in one folder."""
    side = lambda name: modules.where("pkg IS NOT NULL").select(F.col("node").alias(name), F.col("pkg").alias(f"{name}_pkg"))
    folder = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    both = edges.join(side("src"), "src").join(side("dst"), "dst").where("src_pkg <> dst_pkg")
    return both.where(folder("src_pkg") != folder("dst_pkg"))


def dense_ids(df: DataFrame, columns: list[str], out: str = "id") -> DataFrame:
    """Ids 0 ... n - 1 in the order of the columns, without sorting everything in one task: rows of a range of keys are
    numbered within the range, ranges by the sum of those before."""
    from pyspark.sql import Window as W

    from depweave.session import materialise

    ranged = materialise(df.repartitionByRange(*columns).withColumn("__part", F.spark_partition_id()), "ranged")
    sizes = sorted((r["__part"], r["count"]) for r in ranged.groupBy("__part").count().collect())
    before, rows = 0, []
    for part, n in sizes:
        rows.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, "__part int, __before long")
    place = F.row_number().over(W.partitionBy("__part").orderBy(*columns)) - 1
    return ranged.withColumn("__place", place).join(F.broadcast(offsets), "__part").withColumn(out, F.col("__place") + F.col("__before")).drop("__part", "__place", "__before")

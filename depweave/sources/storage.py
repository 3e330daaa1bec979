"""A graph on disk: one Parquet table a relation, and text dumps in a canonical order."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.functions.paths import hex_name
from depweave.schema import dense_ids
from depweave.session import exists

VERSION = 1
TABLES = ("modules", "edges", "reach", "unresolved")


def save(path: str, tables: dict[str, DataFrame], config: str = "") -> None:
    """Relations below path, then ``meta`` with the format's version: a folder without meta is not whole. reach is sorted by dst for affected()."""
    for name in TABLES:
        table = tables[name]
        if name == "reach":
            table = table.repartitionByRange("dst").sortWithinPartitions("dst", "src")
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = tables["modules"].sparkSession
    spark.createDataFrame([(VERSION, config)], "version int, config string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def is_saved(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/meta")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    version = spark.read.parquet(f"{path}/meta").first()["version"]
    if version != VERSION:
        raise ValueError(f"saved in format {version}, this reads {VERSION}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def compact_dump(modules: DataFrame, comps: DataFrame, reach: DataFrame) -> DataFrame:
    """Lines (n, line) in a fixed order: ``V0000 : name`` by name, then ``C0000 (members) -> successors``.

    A name is the import path of a global module and the path of a local one. comps: node, comp; reach: node pairs.
    """
    named = modules.select("node", F.when(F.col("pkg").isNull(), F.col("py")).otherwise(F.coalesce("fs", "py")).alias("name"))
    v = dense_ids(named, ["name", "node"]).select("node", "name", hex_name("V", "id").alias("v"))
    members = v.join(comps, "node").groupBy("comp").agg(F.array_join(F.sort_array(F.collect_list("v")), ",").alias("members"))
    c = dense_ids(members, ["members"]).select("comp", "members", hex_name("C", "id").alias("c"))
    comp_of = lambda side: comps.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_comp"))
    pairs = reach.join(comp_of("src"), "src").join(comp_of("dst"), "dst").select("src_comp", "dst_comp").distinct()
    # A component is among its own successors only if it has several members, which reach says.
    succ = pairs.join(c.select(F.col("comp").alias("dst_comp"), F.col("c").alias("s")), "dst_comp").groupBy("src_comp").agg(F.array_join(F.sort_array(F.collect_list("s")), ",").alias("succ"))
    lines = v.select(F.lit(0).alias("part"), F.col("v").alias("key"), F.concat("v", F.lit(" : "), "name").alias("line")).unionByName(
        c.join(succ, F.col("comp") == F.col("src_comp"), "left").select(F.lit(1).alias("part"), F.col("c").alias("key"), F.concat("c", F.lit(" ("), "members", F.lit(") -> "), F.coalesce("succ", F.lit(""))).alias("line"))
    )
    return lines.orderBy("part", F.length("key"), "key").select("line")


def verbose_dump(modules: DataFrame, comps: DataFrame, reach: DataFrame) -> DataFrame:
    """A line for each component: its import paths and all that it reaches."""
    py = modules.select("node", "py")
    own = comps.join(py, "node").groupBy("comp").agg(F.array_join(F.sort_array(F.collect_set("py")), ",").alias("own"))
    far = comps.join(reach, F.col("node") == F.col("src")).select("comp", F.col("dst").alias("node")).join(py, "node").groupBy("comp").agg(F.array_join(F.sort_array(F.collect_set("py")), ",").alias("far"))
    return own.join(far, "comp", "left").select(F.concat("own", F.lit(" : "), F.coalesce("far", F.lit(""))).alias("line")).orderBy("line")


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file, in order."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def package_list(spark: SparkSession, argument: str) -> DataFrame:
    """source_roots (fs_root, py_prefix) from ``a:b,c:d``, or from lines ``a:b`` of ``@file``."""
    if argument.startswith("@"):
        lines = spark.read.text(argument[1:]).select(F.col("value").alias("pair"))
    else:
        lines = spark.createDataFrame([(argument,)], "value string").select(F.explode(F.split("value", ",")).alias("pair"))
    split = F.split(F.trim("pair"), ":")
    return lines.where(F.trim("pair") != "").select(split[0].alias("fs_root"), F.when(F.size(split) > 1, split[1]).otherwise(F.replace(split[0], F.lit("/"), F.lit("."))).alias("py_prefix"))


def config_text(config: object) -> str:
    return json.dumps(config, sort_keys=True, default=sorted)

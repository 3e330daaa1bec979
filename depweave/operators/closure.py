"""Closure, reachability and components of possibly cyclic graphs, semi-naive and by DataFrames.

``reach(u, v)`` holds if a path of at least one edge leads from u to v, self-edges left out; a node reaches itself only in
a cycle. Every round joins what is new only; rounds are tables in the shared folder. Ask ``reachable`` for the
nodes that given seeds reach: it needs no pairs and so grows with the graph, where the closure grows with its square.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.functions.paths import segment_prefixes
from depweave.session import materialise


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def transitive_closure(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst); with sources (a column ``node``) only pairs from those."""
    e = materialise(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    hop = e.select(F.col("src").alias("mid"), F.col("dst").alias("nxt"))
    new = e if sources is None else materialise(e.join(sources.select(F.col("node").alias("src")).distinct(), "src", "left_semi"), "closure")
    parts = [new]
    while True:
        step = new.withColumnRenamed("dst", "mid").join(hop, "mid").select("src", F.col("nxt").alias("dst")).distinct()
        new = materialise(step.join(_union(parts), ["src", "dst"], "left_anti"), "closure")
        if new.isEmpty():
            return _union(parts)
        parts.append(new)
        if len(parts) == 8:
            parts = [materialise(_union(parts), "closure")]


def reachable(edges: DataFrame, seeds: DataFrame, backwards: bool = False) -> DataFrame:
    """Distinct nodes that any seed (column ``node``) reaches, or that reach any seed; a seed itself only if a cycle leads back."""
    a, b = ("dst", "src") if backwards else ("src", "dst")
    hop = edges.where("src <> dst").select(F.col(a).alias("node"), F.col(b).alias("to"))
    new = materialise(hop.join(seeds.select("node").distinct(), "node", "left_semi").select(F.col("to").alias("node")).distinct(), "reached")
    parts = [new]
    while not new.isEmpty():
        step = new.join(hop, "node").select(F.col("to").alias("node")).distinct()
        new = materialise(step.join(_union(parts), "node", "left_anti"), "reached")
        parts.append(new)
        if len(parts) == 8:
            parts = [materialise(_union(parts), "reached")]
    return _union(parts)


def trim(edges: DataFrame, most: int = 50) -> DataFrame:
    """Edges without those that no cycle can use: nodes without edges in or out go, again and again (``most`` rounds; what is left stays right)."""
    now = materialise(edges.where("src <> dst").select("src", "dst").distinct(), "trimmed")
    n = now.count()
    for _ in range(most):
        now = materialise(now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "trimmed")
        n, before = now.count(), n
        if n in (0, before):
            break
    return now


def _least_before(edges: DataFrame) -> DataFrame:
    """(node, color) of every node with an edge: the least node that reaches it, itself included."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    now = new = materialise(nodes.withColumn("color", F.col("node")), "colors")
    while not new.isEmpty():
        sent = edges.join(new.select(F.col("node").alias("src"), "color"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("__sent"))
        stepped = materialise(now.join(sent, "node", "left").withColumn("__new", F.coalesce(F.col("__sent") < F.col("color"), F.lit(False))), "colors")
        now = stepped.select("node", F.when(F.col("__new"), F.col("__sent")).otherwise(F.col("color")).alias("color"))
        new = now.join(stepped.where("__new").select("node"), "node", "left_semi")
    return now


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp) for every node (column ``node``): comp is the least node of its strongly connected component.

    By colours: each node takes the least node that reaches it; those of a colour that also reach the node it is named after are
    that node's component. They go, and so do edges between colours; the rest is coloured again. Rows are as many as nodes
    and edges, never pairs of nodes; rounds are as many as a component's longest shortest path, for each layer of colours.
    """
    left = trim(edges)
    found = None
    while not left.isEmpty():
        colors = _least_before(left)
        of = lambda end: colors.select(F.col("node").alias(end), F.col("color").alias(f"{end}_color"))
        within = materialise(left.join(of("src"), "src").join(of("dst"), "dst").where("src_color = dst_color").select("src", "dst", F.col("src_color").alias("color")), "colored")
        own = materialise(reachable(within, colors.where("node = color").select("node"), backwards=True).join(colors, "node"), "components")
        own = own.select("node", F.col("color").alias("comp"))
        found = own if found is None else found.unionByName(own)
        gone = own.select("node")
        rest = within.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = trim(rest.select("src", "dst"))
    every = nodes.select("node").distinct()
    if found is None:
        return every.withColumn("comp", F.col("node"))
    return every.join(found.withColumnRenamed("comp", "__comp"), "node", "left").select("node", F.coalesce("__comp", "node").alias("comp"))


def cycle_members(reach: DataFrame) -> DataFrame:
    return reach.where("src = dst").select(F.col("src").alias("node"))


def condense(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """Distinct edges between different components."""
    c = lambda name: comps.select(F.col("node").alias(name), F.col("comp").alias(f"{name}_comp"))
    return edges.join(c("src"), "src").join(c("dst"), "dst").where("src_comp <> dst_comp").select(F.col("src_comp").alias("src"), F.col("dst_comp").alias("dst")).distinct()


def leaf_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing else points at."""
    return nodes.select("node").distinct().join(edges.where("src <> dst").select(F.col("dst").alias("node")), "node", "left_anti")


def parent_edges(modules: DataFrame, sep: str = ".") -> tuple[DataFrame, DataFrame]:
    """Every module depends on its dotted ancestors within its pkg: (new file-less modules, edges); modules: node, fs, py, pkg."""
    above = modules.select("node", "pkg", F.explode(segment_prefixes("py", sep, itself=False)).alias("py"))
    known = modules.select(F.col("py"), F.col("pkg"), F.col("node").alias("__known"))
    found = above.join(known, (above["py"] == known["py"]) & above["pkg"].eqNullSafe(known["pkg"]), "left").select(above["node"], above["py"], above["pkg"], "__known")
    name = F.concat(F.lit("<"), F.when(F.col("pkg").isNotNull(), F.concat("pkg", F.lit(":"))).otherwise(""), "py", F.lit(">"))
    keyed = found.withColumn("dst", F.coalesce("__known", name))
    created = keyed.where("__known IS NULL").select(F.col("dst").alias("node"), F.lit(None).cast("string").alias("fs"), "py", "pkg").distinct()
    return created, keyed.select(F.col("node").alias("src"), "dst").distinct()

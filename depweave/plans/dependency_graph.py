"""The import graph of a source tree as tables, from scan to closure, and questions to it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.functions.imports import extract, is_namespace_init
from depweave.operators import closure, edits, queries, resolve
from depweave.plans.hooks import Hook
from depweave.session import materialise
from depweave.sources import storage
from depweave.sources.source_tree import read_tree


class DependencyGraph:
    """modules (node, fs, py, pkg), edges (src, dst), reach (src, dst), unresolved (target, importer), and errors (path, error) if built here."""

    def __init__(self, modules: DataFrame, edges: DataFrame, reach: DataFrame, unresolved: DataFrame, errors: DataFrame | None = None):
        self.modules, self.edges, self.reach, self.unresolved_pairs, self.errors = modules, edges, reach, unresolved, errors
        self.spark: SparkSession = modules.sparkSession

    @classmethod
    def build(cls, files: DataFrame, hook: Hook) -> DependencyGraph:
        """files (path, source[, error]), paths relative as in the hook's source roots. Leaf edges come last (see with_leaf_edges)."""
        spark = files.sparkSession
        files = materialise(files.select("path", "source"), "files")
        roots, namespaces = hook.roots(spark), hook.namespaces(spark)
        named = resolve.name_modules(resolve.admit(files), roots)
        named = named.withColumn("is_ns", is_namespace_init(F.col("path"), F.col("source")))
        known = resolve.classify(named, "py", namespaces).where("kind IS NOT NULL").drop("kind")
        scanned = materialise(resolve.modules_of(known, roots), "scanned")
        found = extract(scanned, hook.include_typechecking)
        found = materialise(found.join(scanned.select("path", "node", "pkg", "fs_root"), "path"), "imports")
        raw = found.select("node", F.col("path").alias("importer"), "pkg", "fs_root", F.explode("imports").alias("dep"))
        edges, unresolved, modules = resolve.resolve(raw, files.select("path"), scanned, roots, namespaces)
        modules, edges = materialise(modules, "modules"), materialise(edges, "edges")
        if hook.dynamic_dependencies:
            edges = materialise(edges.unionByName(edits.dynamic_edges(modules, hook.dynamic_dependencies)).distinct(), "edges")
        made, up = closure.parent_edges(modules)
        modules = materialise(modules.unionByName(made), "modules")
        edges = materialise(edges.unionByName(up).where("src <> dst").distinct(), "edges")
        reach = materialise(closure.transitive_closure(edges), "reach")
        graph = cls(modules, edges, reach, materialise(unresolved, "unresolved"), found.where("error IS NOT NULL").select("path", "error"))
        return graph.with_leaf_edges(hook.leaf_dependencies) if hook.leaf_dependencies else graph

    @classmethod
    def load_or_build(cls, spark: SparkSession, path: str, root: str, hook: Hook) -> DependencyGraph:
        """The saved graph if there is one (leaf edges are part of it), else a new one, saved there."""
        if storage.is_saved(spark, path):
            return cls.load(spark, path)
        hook.setup()
        graph = cls.build(read_tree(spark, root, list(hook.source_roots)), hook)
        graph.save(path, storage.config_text(vars(hook) | {"relevant": None}))
        return graph

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DependencyGraph:
        t = storage.load(spark, path)
        return cls(t["modules"], t["edges"], t["reach"], t["unresolved"])

    def save(self, path: str, config: str = "") -> None:
        storage.save(path, {"modules": self.modules, "edges": self.edges, "reach": self.reach, "unresolved": self.unresolved_pairs}, config)

    def clone(self) -> DependencyGraph:
        """Tables don't change, so this shares them."""
        return DependencyGraph(self.modules, self.edges, self.reach, self.unresolved_pairs, self.errors)

    def with_leaf_edges(self, given: Iterable[tuple[str, Mapping[str, Iterable[str]]]]) -> DependencyGraph:
        return DependencyGraph(self.modules, self.edges, edits.leaf_edges(self.reach, self.modules, given), self.unresolved_pairs, self.errors)

    def _known(self, nodes: DataFrame) -> DataFrame | None:
        return None if nodes.isEmpty() else nodes

    def file_depends_on(self, path: str) -> DataFrame | None:
        """(pkg, py) of all that a file reaches; None if the file is unknown."""
        nodes = self._known(queries.nodes_of_files(self.modules, [path]))
        return None if nodes is None else queries.depends_on(self.reach, self.modules, nodes)

    def module_depends_on(self, py: str, pkg: str | None = None) -> DataFrame | None:
        own = self.modules.where((F.col("py") == py) & F.col("pkg").eqNullSafe(F.lit(pkg))).select("node")
        nodes = self._known(own)
        return None if nodes is None else queries.depends_on(self.reach, self.modules, nodes)

    def depends(self, name: str) -> DataFrame | None:
        """By path if there is a slash in the name, else by import path."""
        return self.file_depends_on(name) if "/" in name else self.module_depends_on(name)

    def affected_by_files(self, paths: queries.Names) -> DataFrame:
        """Files that reach any of the given ones."""
        return queries.affected_files(self.reach, self.modules, queries.nodes_of_files(self.modules, paths))

    def affected_by_modules(self, names: queries.Names) -> DataFrame:
        return queries.affected_modules(self.reach, self.modules, queries.nodes_of_modules(self.modules, names))

    def local_affected_by_files(self, paths: queries.Names) -> DataFrame:
        return queries.local_affected(self.reach, self.modules, queries.nodes_of_files(self.modules, paths))

    def local_affected_by_modules(self, names: queries.Names) -> DataFrame:
        return queries.local_affected(self.reach, self.modules, queries.nodes_of_modules(self.modules, names), "py")

    def unresolved(self) -> DataFrame:
        return queries.unresolved_report(self.unresolved_pairs)

    def exposed_to_dynamic_imports(self, test_glob: str | None = None) -> DataFrame:
        return queries.dynamic_exposure(self.reach, self.modules, test_glob)

    def components(self) -> DataFrame:
        return closure.strong_components(self.modules, self.edges)

    def dump(self, verbose: bool = False) -> DataFrame:
        lines = storage.verbose_dump if verbose else storage.compact_dump
        return lines(self.modules, self.components(), self.reach)

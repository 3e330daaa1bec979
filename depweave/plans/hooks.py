"""Configuration of an analysis: namespaces, roots, edges by hand, and the predicates that users may replace."""

from __future__ import annotations

import importlib.util
import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.functions.paths import is_test_file
from depweave.schema import NAMESPACES, SOURCE_ROOTS


@dataclass
class Hook:
    """source_roots: folder to import prefix. A root is local if its prefix's first segment is a local namespace."""

    global_namespaces: set[str] = field(default_factory=set)
    local_namespaces: set[str] = field(default_factory=set)
    external_imports: set[str] = field(default_factory=set)
    source_roots: dict[str, str] = field(default_factory=dict)
    test_folders: dict[str, str] = field(default_factory=dict)
    include_typechecking: bool = False
    dynamic_dependencies: Mapping[str, set[str]] | None = None
    leaf_dependencies: Sequence[tuple[str, Mapping[str, set[str]]]] | None = None
    test_glob: str | None = None
    always_run: set[str] = field(default_factory=set)
    tracker_anchors: set[tuple[str, str]] = field(default_factory=set)
    tracker_ignores: set[tuple[str, str]] = field(default_factory=set)
    ignored_prefixes: tuple[str, ...] = ()
    record_implicit_anchors: bool = False
    relevant: Callable[[Column], Column] | None = None

    def __post_init__(self) -> None:
        both = set(self.global_namespaces) & set(self.local_namespaces)
        if both:
            raise ValueError(f"both global and local: {sorted(both)}")

    def setup(self) -> None:
        """Runs before anything is read."""

    def is_test_file(self, path: Column) -> Column:
        return is_test_file(path, self.test_glob)

    def is_relevant(self, path: Column) -> Column:
        """Changed files that matter; others are left out of a selection."""
        return self.relevant(path) if self.relevant else F.lit(True)

    def handles_dynamic(self) -> bool:
        return self.dynamic_dependencies is not None or self.leaf_dependencies is not None

    def externals(self) -> set[str]:
        return set(self.external_imports) | {"importlib", "__import__"}

    def namespaces(self, spark: SparkSession) -> DataFrame:
        rows = [(n, "global") for n in self.global_namespaces] + [(n, "local") for n in self.local_namespaces] + [(n, "external") for n in self.externals()]
        return spark.createDataFrame(sorted(rows), NAMESPACES)

    def roots(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f.rstrip("/"), p, p.split(".")[0] in self.local_namespaces) for f, p in sorted(self.source_roots.items())], SOURCE_ROOTS)

    def before_folder(self, folder: str, prefix: str) -> None:
        """Called by a validator before a test folder."""

    def after_folder(self, folder: str, prefix: str) -> None:
        """Called by a validator after a test folder."""


def load_hook(path: str, cls: type[Hook] = Hook, defaults: Callable[[], dict[str, Any]] | None = None) -> Hook:
    """An instance of the first class in a Python file that is a cls; scanned defaults fill in its fields if given."""
    spec = importlib.util.spec_from_file_location("depweave_hook", path)
    if spec is None or spec.loader is None:
        raise ValueError(f"not a Python file: {path}")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    for value in vars(module).values():
        if inspect.isclass(value) and issubclass(value, cls) and value.__module__ == module.__name__:
            return value(**(defaults() if defaults else {}))
    raise ValueError(f"no {cls.__name__} in {path}")

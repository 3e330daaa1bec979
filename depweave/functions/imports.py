"""Import extraction from Python sources: one source in, raw import names out.

Every import statement gives its target; a from-import also target.name for each name (``*`` included); relative
ones drop trailing segments of the importer's name, in which a package's ``__init__`` counts as one. Functions,
classes and branches are searched too. An ``if`` whose condition is ``TYPE_CHECKING`` or ``typing.TYPE_CHECKING`` is skipped
whole, its ``elif`` and ``else`` as well, unless asked for; only the first condition counts, an ``elif`` is part of its ``if``. Calls of ``__import__`` or ``import_module`` with one string give that string,
and the name ``__import__`` gives itself.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Fixed value: how a namespace package's __init__.py begins.
NAMESPACE_INIT = r"""^__path__ *= *__import__ *\(('pkgutil'|"pkgutil")\).extend_path *\( *__path__ *, *__name__ *\)"""


def is_namespace_init(path, source):
    """Column: whether a file is the __init__.py of a pkgutil-style namespace package."""
    return F.coalesce(path.endswith("__init__.py") & source.rlike(NAMESPACE_INIT), F.lit(False))


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
        return f"{node.value.id}.{node.attr}"
    return node.id if isinstance(node, ast.Name) else ""


class _Finder(ast.NodeVisitor):
    def __init__(self, module: str, typechecking: bool):
        self.segments = module.split(".")
        self.typechecking = typechecking
        self.found: dict[str, None] = {}

    def visit_Import(self, node: ast.Import) -> None:
        self.found.update((a.name, None) for a in node.names)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = node.module or ""
        if node.level:
            if len(self.segments) <= node.level:
                return
            base = ".".join([*self.segments[: len(self.segments) - node.level], *filter(None, [base])])
        self.found[base] = None
        self.found.update((f"{base}.{a.name}", None) for a in node.names)

    def visit_If(self, node: ast.If) -> None:
        if self.typechecking or _dotted(node.test) not in ("TYPE_CHECKING", "typing.TYPE_CHECKING"):
            self._branches(node)

    def _branches(self, node: ast.If) -> None:
        while True:
            for part in (node.test, *node.body):
                self.visit(part)
            # An elif is a lone If where the else would be, in the column of its if; a nested one lies further in.
            last = node.orelse[0] if len(node.orelse) == 1 else None
            if not isinstance(last, ast.If) or last.col_offset != node.col_offset:
                break
            node = last
        for part in node.orelse:
            self.visit(part)

    def visit_Call(self, node: ast.Call) -> None:
        literal = len(node.args) == 1 and not node.keywords and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str)
        if literal and _dotted(node.func) in ("__import__", "import_module", "importlib.import_module", "builtins.__import__"):
            self.found[node.args[0].value] = None
        self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> None:
        if node.id == "__import__":
            self.found["__import__"] = None


def find_imports(source: str, module: str, typechecking: bool = False) -> list[str]:
    """Raw imports of one source in order of appearance, each once; raises what ast.parse raises."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(source)
    finder = _Finder(module, typechecking)
    finder.visit(tree)
    return list(finder.found)


def _rows(path: str, source: str | None, module: str, typechecking: bool) -> tuple[list[str], str | None]:
    if source is None or re.search(r"\.pyx$", path or ""):
        return [], None
    try:
        return find_imports(source, module, typechecking), None
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return [], f"{type(error).__name__}: {error}"[:300]


def extract(files: DataFrame, typechecking: bool = False) -> DataFrame:
    """(path, imports, error) of files (path, source, module), where module is the name relative imports start from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_rows(*row, typechecking) for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.list_(pa.string())), pa.array([g[1] for g in got], pa.string())], ["path", "imports", "error"])

    return files.select("path", "source", "module").mapInArrow(run, "path string, imports array<string>, error string")


@udtf(returnType="import string, error string")
class ExtractImports:
    """The same as a table function for SQL: LATERAL extract_imports(path, source, module, typechecking)."""

    def eval(self, path: str, source: str, module: str, typechecking: bool):
        found, error = _rows(path, source, module or "", bool(typechecking))
        for name in found:
            yield name, None
        if error:
            yield None, error


def register(spark: SparkSession) -> None:
    spark.udtf.register("extract_imports", ExtractImports)

"""A source tree of our own that has every case of naming, extraction and resolution."""

import pytest

from depweave.functions.imports import find_imports, register
from depweave.plans.dependency_graph import DependencyGraph
from depweave.plans.hooks import Hook
from depweave.sources.source_tree import read_tree

NS = "__path__ = __import__('pkgutil').extend_path(__path__, __name__)\n"
TREE = {
    "lib/app/__init__.py": "",
    "lib/app/core.py": "import os\nfrom . import util\nfrom .deep.leaf import thing\nfrom app.gone import x\nimport app.util.Missing\n",
    "lib/app/util.py": "import numpy.linalg\nfrom typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    import app.hidden\nelse:\n    import app.skipped\n",
    "lib/app/hidden.py": "",
    "lib/app/skipped.py": "",
    "lib/app/_private.py": "from ...toofar import y\n",
    "lib/app/deep/__init__.py": "from .leaf import *\nfrom . import *\n",
    "lib/app/deep/leaf.py": "def f():\n    from app.deep import other\n",
    "lib/app/deep/other.py": "import app.deep\n",
    "lib/app/twin.py": "import app.core\n",
    "lib/app/twin/__init__.py": "",
    "lib/app/native.pyx": "import app.core\n",
    "lib/app/stub.pyi": "import app.util\n",
    "lib/app/both.pyi": "import app.core\n",
    "lib/app/both.py": "",
    "lib/app/broken.py": "def (:\n",
    "lib/app/dyn.py": "import importlib\nimportlib.import_module('app.util')\n__import__('app.core')\nimportlib.__import__('app.hidden')\n",
    "lib/app/a.py": "import app.b\n",
    "lib/app/b.py": "import app.c\n",
    "lib/app/c.py": "import app.a\n",
    "ns/part/__init__.py": NS,
    "ns/part/one/__init__.py": "import app.core\n",
    "p1/tests/__init__.py": "",
    "p1/tests/helper.py": "import app.util\n",
    "p1/tests/test_x.py": "from tests.helper import h\nfrom fixtures import data\n",
    "p1/fixtures/__init__.py": "",
    "p1/fixtures/data.py": "",
    "p2/tests/__init__.py": "",
    "p2/tests/helper.py": "",
    "p2/tests/test_x.py": "import tests.helper\nimport part.one\nimport part\n",
    "other/readme.py": "import app.core\n",
}


def hook(**more):
    return Hook(
        global_namespaces={"app", "part"},
        local_namespaces={"tests", "fixtures"},
        external_imports={"numpy"},
        source_roots={"lib/app": "app", "ns/part/one": "part.one", "p1/tests": "tests", "p2/tests": "tests", "p1/fixtures": "fixtures"},
        **more,
    )


def files(spark, tree=TREE):
    return spark.createDataFrame(sorted(tree.items()), "path string, source string").repartition(3)


@pytest.fixture(scope="module")
def graph(spark):
    return DependencyGraph.build(files(spark), hook())


@pytest.fixture(scope="module")
def direct(graph):
    out = {}
    for r in graph.edges.collect():
        out.setdefault(r.src, set()).add(r.dst)
    return out


def test_edges(direct):
    init = "lib/app/__init__.py"
    assert direct["lib/app/core.py"] == {init, "lib/app/util.py", "lib/app/deep/leaf.py"}
    assert direct["lib/app/util.py"] == {init, "<numpy>"}
    assert direct["lib/app/_private.py"] == {init}
    assert direct["lib/app/deep/__init__.py"] == {init, "lib/app/deep/leaf.py", "lib/app/deep/other.py"}
    assert direct["lib/app/deep/leaf.py"] == {init, "lib/app/deep/__init__.py", "lib/app/deep/other.py"}
    assert direct["lib/app/stub.pyi"] == {init, "lib/app/util.py"}
    assert direct["lib/app/dyn.py"] == {init, "<importlib>", "<__import__>", "lib/app/util.py", "lib/app/core.py"}
    assert direct["p1/tests/test_x.py"] == {"p1/tests/__init__.py", "p1/tests/helper.py", "p1/fixtures/__init__.py", "p1/fixtures/data.py"}
    assert direct["p2/tests/test_x.py"] == {"p2/tests/__init__.py", "p2/tests/helper.py", "ns/part/one/__init__.py", "<part>"}
    assert direct["ns/part/one/__init__.py"] == {"<part>", "lib/app/core.py"}
    assert "lib/app/twin.py" not in direct and "lib/app/both.pyi" not in direct and "other/readme.py" not in direct


def test_modules(graph):
    rows = {r.node: (r.fs, r.py, r.pkg) for r in graph.modules.collect()}
    assert rows["lib/app/deep/__init__.py"][1] == "app.deep" and rows["<part>"] == (None, "part", None)
    assert rows["p1/tests/helper.py"] == ("p1/tests/helper.py", "tests.helper", "p1/tests")
    assert rows["lib/app/native.pyx"][1] == "app.native" and "lib/app/twin.py" not in rows
    from depweave.schema import neighbour_violations, violations

    assert violations(graph.modules).count() == 0 and neighbour_violations(graph.edges, graph.modules).count() == 0


def test_unresolved_and_errors(graph):
    assert {(r.target, *r.importers) for r in graph.unresolved().collect()} == {("app.gone", "lib/app/core.py")}
    assert [r.path for r in graph.errors.collect()] == ["lib/app/broken.py"]


def test_questions(graph):
    names = lambda df, c: {r[c] for r in df.collect()}
    assert names(graph.file_depends_on("lib/app/a.py"), "py") == {"app", "app.a", "app.b", "app.c"}
    assert names(graph.module_depends_on("tests.test_x", "p1/tests"), "py") >= {"fixtures.data", "tests.helper", "app.util", "numpy"}
    assert graph.file_depends_on("nowhere.py") is None and graph.module_depends_on("tests.test_x") is None
    assert graph.file_depends_on("lib/app/hidden.py").count() == 1
    affected = names(graph.affected_by_files(["lib/app/util.py", "unknown.py"]), "fs")
    assert {"lib/app/core.py", "p1/tests/test_x.py", "p2/tests/test_x.py", "lib/app/dyn.py"} <= affected and "lib/app/util.py" not in affected
    assert names(graph.affected_by_files(["lib/app/a.py"]), "fs") == {"lib/app/a.py", "lib/app/b.py", "lib/app/c.py"}
    assert "tests.test_x" in names(graph.affected_by_modules({"app.util"}), "py")
    local = {r.pkg: r.affected for r in graph.local_affected_by_files(["lib/app/util.py"]).collect()}
    assert local == {"p1/tests": ["p1/tests/helper.py", "p1/tests/test_x.py"], "p2/tests": ["p2/tests/test_x.py"]}
    assert {r.pkg: r.affected for r in graph.local_affected_by_modules(["part.one"]).collect()} == {"p2/tests": ["tests.test_x"]}
    with pytest.raises(TypeError):
        graph.affected_by_files("lib/app/a.py")
    assert graph.affected_by_files(None).count() == 0 and graph.exposed_to_dynamic_imports().count() == 0


def test_dynamic_and_leaf_edges(spark):
    tree = {"lib/app/__init__.py": "", "lib/app/x.py": "", "lib/app/y.py": "import app.x\n", "lib/app/sub/__init__.py": "", "lib/app/sub/m.py": "", "lib/app/t.py": "", "p1/tests/test_a.py": "import app.t\n", "p2/tests/test_b.py": "import app.t\n"}
    base = dict(dynamic_dependencies={"app.t": {"app.sub.*", "app.y.name", "app.none.at.all"}, "importlib": {"app.x"}})
    g = DependencyGraph.build(files(spark, tree), hook(**base))
    deps = {r.py for r in g.module_depends_on("app.t").collect()}
    assert deps == {"app", "app.sub", "app.sub.m", "app.y", "app.x"}
    plain = DependencyGraph.build(files(spark, tree), hook())
    leafy = plain.with_leaf_edges([("app.t", {"p1/tests": {"app.y.z"}})])
    of = lambda g, f: {r.py for r in g.file_depends_on(f).collect()}
    assert of(plain, "p1/tests/test_a.py") == {"app", "app.t", "tests"} == of(leafy, "p2/tests/test_b.py")
    assert of(leafy, "p1/tests/test_a.py") == {"app", "app.t", "app.y", "app.x", "tests"}
    # The second step sees what the first one added.
    ordered = plain.with_leaf_edges([("app.t", {"p1/tests": {"app.y"}}), ("app.x", {"p1/tests": {"app.sub.m"}})])
    swapped = plain.with_leaf_edges([("app.x", {"p1/tests": {"app.sub.m"}}), ("app.t", {"p1/tests": {"app.y"}})])
    assert "app.sub.m" in of(ordered, "p1/tests/test_a.py") and "app.sub.m" not in of(swapped, "p1/tests/test_a.py")


def test_save_load_and_dump(spark, graph, tmp_path):
    graph.save(str(tmp_path / "g"))
    again = DependencyGraph.load(spark, str(tmp_path / "g"))
    assert {tuple(r) for r in again.reach.collect()} == {tuple(r) for r in graph.reach.collect()}
    lines = [r.line for r in graph.dump().collect()]
    assert lines == [r.line for r in again.dump().collect()]
    assert lines[0] == "V0000 : __import__" and any(" (" in x and "," in x.split("(")[1].split(")")[0] for x in lines)
    v = {x.split(" : ")[1]: x.split(" : ")[0] for x in lines if x[0] == "V"}
    cycle = next(x for x in lines if x[0] == "C" and v["app.a"] in x.split(")")[0])
    assert all(v[f"app.{n}"] in cycle for n in "abc") and cycle.split(" ")[0] in cycle.split("->")[1]
    assert graph.dump(verbose=True).count() == sum(x[0] == "C" for x in lines)
    assert graph.clone().modules is graph.modules


def test_typechecking_and_table_function(spark):
    source = TREE["lib/app/util.py"]
    assert "app.hidden" not in find_imports(source, "app.util") and {"app.hidden", "app.skipped"} <= set(find_imports(source, "app.util", True))
    guarded = "if a:\n  import x\nelif TYPE_CHECKING:\n  import y\nelse:\n  import z\n"
    assert find_imports(guarded, "m") == ["x", "y", "z"] and find_imports("if a:\n  import x\nelse:\n  if TYPE_CHECKING:\n    import y\n  else:\n    import z\n", "m") == ["x"]
    assert find_imports("if typing.TYPE_CHECKING:\n  import x\nelif a:\n  import y\nelse:\n  import z\n", "m") == []
    assert find_imports("from .. import z", "a.b") == [] and find_imports("from . import z", "a.__init__") == ["a", "a.z"]
    assert find_imports("from .m import *", "a.b.c") == ["a.b.m", "a.b.m.*"]
    assert find_imports("import_module('p', 'q'); import_module(n); __import__", "m") == ["__import__"]
    register(spark)
    got = spark.sql("SELECT * FROM extract_imports('m.py', 'import a\nfrom b import c', 'm', false)").collect()
    assert [r["import"] for r in got] == ["a", "b", "b.c"]
    assert spark.sql("SELECT * FROM extract_imports('m.py', 'def (', 'm', false)").first().error.startswith("SyntaxError")


def test_source_tree(spark, tmp_path):
    for path, text in {"pkg/__init__.py": "x = 1\n", "pkg/_p.pyi": "", "pkg/.hidden.py": "", ".git/a.py": "", "pkg/note.txt": "", "pkg/m.py": "é"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text, encoding="utf-8")
    (tmp_path / "pkg/bad.py").write_bytes(b"\xff\xfe\x00")
    rows = {r.path: (r.source, r.error) for r in read_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"pkg/__init__.py", "pkg/_p.pyi", "pkg/m.py", "pkg/bad.py"}
    assert rows["pkg/m.py"] == ("é", None) and rows["pkg/bad.py"][0] is None and "Unicode" in rows["pkg/bad.py"][1]
    assert read_tree(spark, str(tmp_path), ["none"]).count() == 0

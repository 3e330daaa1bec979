"""Selection over a graph, streaming traces, hooks and the command line."""

import subprocess

import pytest
from pyspark.sql import functions as F

from depweave import __main__ as cli
from depweave.plans.dependency_graph import DependencyGraph
from depweave.plans.hooks import Hook, load_hook
from depweave.plans.selection import impact_of, select_items
from depweave.streaming import traces

TREE = {
    "app/__init__.py": "", "app/core.py": "", "app/extra.py": "import app.core\n", "app/lone.py": "",
    "tests/__init__.py": "", "tests/test_core.py": "import app.core\n", "tests/test_extra.py": "import app.extra\n", "tests/test_lone.py": "from app import lone\n", "tests/test_dyn.py": "import importlib\n",
}
HOOK = dict(global_namespaces={"app"}, local_namespaces={"tests"}, source_roots={"app": "app", "tests": "tests"})


@pytest.fixture(scope="module")
def graph(spark):
    return DependencyGraph.build(spark.createDataFrame(sorted(TREE.items()), "path string, source string"), Hook(**HOOK))


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "a", "tests/test_core.py", None), (2, "b", "tests/test_extra.py", None), (3, "c", "tests/test_lone.py", "data.json"), (4, "d", "tests/test_dyn.py", None)]
    return spark.createDataFrame(rows, "item_id long, name string, file string, data_file string")


@pytest.mark.parametrize(
    "changed,more,kept",
    [
        ([], {}, {4}),
        ([], {"dynamic_dependencies": {}}, set()),
        (["app/extra.py"], {}, {2, 4}),
        (["app/core.py"], {"dynamic_dependencies": {}}, {1, 2}),
        (["tests/test_lone.py"], {}, {3, 4}),
        (["data.json"], {}, {1, 2, 3, 4}),
        (["data.json"], {"relevant": lambda p: ~p.endswith(".json")}, {4}),
        (["gone.py"], {}, {4}),
        ([], {"always_run": {"a"}, "dynamic_dependencies": {}}, {1}),
    ],
)
def test_selection(spark, graph, items, changed, more, kept):
    hook = Hook(**HOOK, **more)
    existing = spark.createDataFrame([(p,) for p in [*TREE, "data.json"]], "path string")
    modified = spark.createDataFrame([(p,) for p in changed], "path string")
    got = {r.item_id for r in select_items(graph, hook, items, modified, existing).where("keep").collect()}
    assert got == kept
    commits = spark.createDataFrame([("c", p) for p in changed] + [("none", "gone.py")], "commit_id string, path string")
    impact = {r.commit_id: r for r in impact_of(graph, hook, items, commits, existing).collect()}
    if changed and impact["c"]["class"] != "unsafe":
        assert impact["c"].kept == len(kept) and impact["c"].kept + impact["c"].pruned == 4
    elif changed:
        assert kept == {1, 2, 3, 4}


def test_hooks(tmp_path):
    with pytest.raises(ValueError):
        Hook(global_namespaces={"a"}, local_namespaces={"a"})
    (tmp_path / "h.py").write_text("from depweave.plans.hooks import Hook\nclass Mine(Hook):\n    def setup(self): self.ready = True\n")
    assert type(load_hook(str(tmp_path / "h.py"), defaults=lambda: HOOK)).__name__ == "Mine"
    (tmp_path / "none.py").write_text("x = 1\n")
    with pytest.raises(ValueError):
        load_hook(str(tmp_path / "none.py"))


def test_streaming_traces(spark, tmp_path):
    schema = "session string, seq long, context string, module string, status string, is_ignored boolean, anchor_module string, anchor_fn string"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write = lambda *rows: spark.createDataFrame([("s", i, *r, None, None) for i, r in enumerate(rows)], schema).write.mode("append").parquet(folder)
    go = lambda: traces.start(traces.read_traces(spark, folder), out, str(tmp_path / "state"), available_now=True).awaitTermination()
    write(("m", "a", "ok", False), ("m", "a", "ok", None), ("m", "b", "error", False), ("m", "c", "ok", True))
    go()
    write(("m", "a", "ok", False), ("k", "d", "ok", False))
    go()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("k", "d"), ("m", "a")]
    traces.append_new(spark.createDataFrame([("k", "d")], traces.OBSERVED), out)
    assert spark.read.parquet(out).count() == 2


def test_command_line(spark, tmp_path, capsys):
    for path, text in TREE.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "pyproject.toml").write_text("[tool.pytest.ini_options]\npython_files = 'test_*.py'\n")
    saved = str(tmp_path / "graph")
    assert cli.main([str(tmp_path), "--graph", saved, "--affected", "app/core.py"]) == ["app/core.py", "app/extra.py", "tests/test_core.py", "tests/test_extra.py"]
    assert cli.main([str(tmp_path), "--graph", saved, "--depends", "tests/test_extra.py"]) == ["app", "app.core", "app.extra", "tests"]
    assert cli.main([str(tmp_path), "--graph", saved, "--depends", "app.nothing"]) == ["unknown"]
    assert cli.main([str(tmp_path), "--graph", saved, "--dynamic"]) == ["tests/test_dyn.py"]
    assert cli.main([str(tmp_path), "--graph", saved, "--unresolved"]) == []
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "app", "tests")
    run("commit", "-qm", "all")
    (tmp_path / ".gitignore").write_text("graph\n.gitignore\npyproject.toml\n")
    (tmp_path / "app/lone.py").write_text("x = 1\n")
    run("commit", "-qam", "lone")
    assert cli.main([str(tmp_path), "--graph", saved, "--modified"]) == ["app/lone.py", "tests/test_lone.py"]

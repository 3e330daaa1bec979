"""Operators on rows written by hand, and the closure against a plain search on random graphs."""

import random
import subprocess

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from depweave.functions import paths as P
from depweave.operators import closure, prefix, queries, select, trace
from depweave.schema import dense_ids, merge_modules, neighbour_violations, violations
from depweave.sources import discovery, storage, vcs


def one(spark, name, *rows):
    return spark.createDataFrame([(r,) for r in rows], f"{name} string")


def pairs(spark, columns, *rows):
    return spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in columns.split()))


def tuples(df, *columns):
    return {tuple(r[c] for c in columns or df.columns) for r in df.collect()}


STORED = ("foo", "foo/baz", "bar/baz/qux", "a/b")


@pytest.mark.parametrize("sep", ["/", "."])
def test_prefixes(spark, sep):
    to = lambda s: s.replace("/", sep)
    stored = one(spark, "prefix", *map(to, STORED), to("foo"))
    probes = ["foo", "fool", "foo/x", "foo/baz", "foo/baz/y/z", "bar", "bar/baz", "bar/baz/qux", "bar/bazz", "a", "a/b/c", "a/c", ""]
    values = one(spark, "v", *map(to, probes), None)
    below = lambda v, p: v == p or v.startswith(f"{p}/")
    want = {(None, False, None, False)}
    for v in probes:
        hits = [p for p in STORED if below(v, p)]
        longest = max(hits, key=len, default=None)
        strict = v not in STORED and any(p.startswith(f"{v}/") for p in STORED)
        want.add((to(v), bool(hits), to(longest) if longest else None, strict))
    got = prefix.strict_prefix(prefix.longest_prefix(prefix.matches(values, "v", stored, sep), "v", stored, sep), "v", stored, sep)
    assert tuples(got) == want
    under = prefix.suffixes_of(one(spark, "v", to("bar"), "foo", "zzz"), "v", stored, sep, join="-")
    assert tuples(under) == {("bar", "baz-qux"), ("foo", "baz")}


def test_wildcards_and_tracked(spark):
    modules = one(spark, "py", "p.a", "p.b", "p.b.c", "p", "q.x")
    assert tuples(prefix.wildcard_children(one(spark, "w", "p.*", "q.x", "p.b.*"), "w", modules)) == {("p.*", "p.a"), ("p.*", "p.b"), ("p.b.*", "p.b.c")}
    assert tuples(prefix.tracked(one(spark, "n", "p.a", "p_x", "q.a", "p.ignored", "p.ign"), "n", ["p"], ["p.ignored"])) == {("p.a",), ("p.ign",)}


def test_path_functions(spark):
    row = spark.range(1).select(
        P.parent(F.lit("a.b.c")), P.parent(F.lit("a")), P.drop_segments(F.lit("a.b.c"), 2), P.drop_segments(F.lit("a.b"), 2), P.segment_prefixes(F.lit("a/b/c"), "/"),
        P.segment_prefixes(F.lit("a"), "/", itself=False), P.rebased(F.lit("x/y/z"), F.lit("x"), F.lit("w")), P.rebased(F.lit("xy"), F.lit("x"), F.lit("w")), P.comma_list(F.lit("a, b,,c")),
        P.hex_name("V", F.lit(255)), P.hex_name("C", F.lit(1 << 20)), P.is_test_file(F.lit("d/test_a.py")), P.is_test_file(F.lit("d/a_test.py")), P.is_test_file(F.lit("test_d/a.py")), P.is_test_file(F.lit("d/check.py"), "c*.p[xy]"), P.matches_glob(F.lit("a.b"), "[!x].?"),
    ).first()
    assert list(row) == ["a.b", None, "a", None, ["a", "a/b", "a/b/c"], [], "w/y/z", "xy", ["a", "b", "c"], "V00ff", "C100000", True, True, False, True, True]
    assert P.nested_lookup({"a": {"b": 1}}, "a.b") == 1 and P.nested_lookup({"a": 1}, "a.b") is None


def search(edges):
    out = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
    reach = set()
    for start in out:
        todo, seen = list(out[start]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        reach |= {(start, x) for x in seen}
    return reach


def check_graph(spark, edges):
    df = pairs(spark, "src dst", *edges)
    reach = closure.transitive_closure(df)
    want = search(edges)
    assert tuples(reach, "src", "dst") == want
    assert tuples(closure.cycle_members(reach)) == {(a,) for a, b in want if a == b}
    nodes = sorted({x for e in edges for x in e})
    seeds = nodes[::3]
    assert tuples(closure.reachable(df, one(spark, "node", *seeds))) == {(b,) for a, b in want if a in seeds}
    assert tuples(closure.reachable(df, one(spark, "node", *seeds), backwards=True)) == {(a,) for a, b in want if b in seeds}
    comp = {n: min([n, *(b for a, b in want if a == n and (b, n) in want)]) for n in nodes}
    comps = closure.strong_components(one(spark, "node", *nodes), df)
    assert tuples(comps, "node", "comp") == set(comp.items())
    assert tuples(closure.condense(df, comps)) == {(comp[a], comp[b]) for a, b in edges if comp[a] != comp[b]}


@given(st.lists(st.tuples(st.sampled_from("abcdefg"), st.sampled_from("abcdefg")), min_size=1, max_size=12))
@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
def test_closure_of_random_graphs(spark, edges):
    check_graph(spark, edges)


def test_closure_of_chains_and_cycles(spark):
    rng = random.Random(0)
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(19)] + [("n05", "n02"), ("n03", "n03"), ("x", "n00")]
    rng.shuffle(chain)
    check_graph(spark, chain)
    assert closure.transitive_closure(pairs(spark, "src dst", ("a", "a"))).count() == 0


def test_leaves_and_parents(spark):
    assert tuples(closure.leaf_nodes(one(spark, "node", "a", "b", "c"), pairs(spark, "src dst", ("a", "b"), ("c", "c")))) == {("a",), ("c",)}
    modules = pairs(spark, "node fs py pkg", ("f1", "f1", "a.b.c", None), ("f2", "f2", "a", None), ("f3", "f3", "t.x", "p1"), ("f4", "f4", "t.y", "p2"), ("f5", "f5", "t", "p2"))
    made, edges = closure.parent_edges(modules)
    assert tuples(made) == {("<a.b>", None, "a.b", None), ("<p1:t>", None, "t", "p1")}
    assert tuples(edges) == {("f1", "f2"), ("f1", "<a.b>"), ("f3", "<p1:t>"), ("f4", "f5")}


def test_module_tables(spark):
    sound = pairs(spark, "node fs py pkg", ("a", "a", "m", None), ("b", "b", "m", "p1"), ("c", "c", "m", "p2"), ("<x>", None, "x", None))
    assert violations(sound).count() == 0
    bad = pairs(spark, "node fs py pkg", ("a", "a", "m", None), ("b", "a", "m", None), ("c", "c", "q", "p"), ("d", "d", "q", "p"), ("e", "e", "x/y", None))
    assert tuples(violations(bad), "rule", "key") == {("fs repeated", "a"), ("global py repeated", "m"), ("local py repeated", "p:q"), ("separator in py", "x/y")}
    merged = merge_modules(pairs(spark, "fs py pkg", (None, "n", None), ("n.py", "n", None), (None, "e", None)))
    assert tuples(merged) == {("n.py", "n.py", "n", None), ("<e>", None, "e", None)}
    locals_ = pairs(spark, "node fs py pkg", ("a", "a", "t.a", "x/t"), ("b", "b", "u.b", "x/u"), ("c", "c", "t.c", "y/t"))
    assert tuples(neighbour_violations(pairs(spark, "src dst", ("a", "b"), ("a", "c")), locals_), "src", "dst") == {("a", "c")}
    ids = {r.k: r.id for r in dense_ids(spark.createDataFrame([(f"k{i:03}",) for i in range(200)], "k string").repartition(5), ["k"]).collect()}
    assert ids == {f"k{i:03}": i for i in range(200)}


def test_lookups(spark):
    modules = pairs(spark, "node fs py pkg", ("f1", "f1", "a", None), ("f2", "f2", "a.b", None), ("f3", "f3", "t", "p2"), ("f4", "f4", "t", "p1"))
    names = one(spark, "n", "f2", "a", "t", "zz", "a.b.c.d")
    assert tuples(queries.first_match(names, "n", modules)) == {("f2", "f2"), ("a", "f1"), ("t", "f4"), ("zz", None), ("a.b.c.d", None)}
    assert tuples(queries.nearest_module(names, "n", modules)) == {("f2", None), ("a", "f1"), ("t", None), ("zz", None), ("a.b.c.d", "f2")}
    assert tuples(queries.module_or_parent(one(spark, "n", "a.b.c", "a.b.c.d", "a.b"), "n", modules)) == {("a.b.c", "f2"), ("a.b.c.d", None), ("a.b", "f2")}
    reach = pairs(spark, "src dst", ("f3", "<importlib>"), ("f2", "<importlib>"))
    more = modules.unionByName(pairs(spark, "node fs py pkg", ("<importlib>", None, "importlib", None)))
    assert tuples(queries.dynamic_exposure(reach, more, "f3")) == {("f3",)}


def test_keep_flags(spark):
    items = spark.createDataFrame(
        [(1, "a", "new.py", None), (2, "a", "t.py", None), (3, "a", "hit.py", None), (4, "a", "t.py", "data"), (5, "always", "t.py", None), (6, "a", "run.py", None), (7, "a", "t.py", "run.py"), (8, "a", "dyn.py", None), (9, "a", "t.py", "dyn.py"), (10, "full", "t.py", None)],
        "item_id long, name string, file string, data_file string",
    )
    known = one(spark, "f", "t.py", "hit.py", "run.py", "dyn.py")
    args = items, known, one(spark, "f", "hit.py", "data"), one(spark, "n", "always", "run.py", "t.py:full"), one(spark, "f", "dyn.py")
    assert {r.item_id for r in select.keep_flags(*args).where("keep").collect()} == {1, 3, 4, 5, 6, 7, 8, 9}
    flagged = select.keep_flags(*args, name_with_file=True)
    assert {r.item_id for r in flagged.where("keep").collect()} == {1, 3, 4, 5, 6, 7, 8, 9, 10}
    assert select.with_fallback(flagged, one(spark, "path")).where("keep").count() == 9
    assert select.with_fallback(flagged, one(spark, "path", "x")).where("keep").count() == 10
    risk = select.residual_risk(one(spark, "path", "a", "b", "c", "d", "e.md"), one(spark, "f", "a"), one(spark, "f", "a", "b", "d", "e.md"), one(spark, "f", "d"), ~F.col("path").endswith(".md"))
    assert tuples(risk) == {("b",)}
    assert select.dynamic_guard(known, True).count() == 0 and select.dynamic_guard(known, False).count() == 4


def test_impact(spark):
    kept = spark.createDataFrame([("c1", 1), ("c1", 1), ("c2", 1), ("c2", 2), ("c4", 2)], "commit_id string, item_id long")
    commits = one(spark, "commit_id", "c1", "c2", "c3", "c4", "c4")
    got = select.impact(kept, commits, 2, one(spark, "commit_id", "c4"))
    assert tuples(got) == {("c1", 1, 1, "partial", 0.5), ("c2", 2, 0, "nogain", 0.0), ("c3", 0, 2, "skipped", 1.0), ("c4", 1, 1, "unsafe", 0.5)}
    assert tuples(select.impact_summary(got)) == {(c, 1, 0.25) for c in ("unsafe", "skipped", "nogain", "partial")}
    import statistics

    gains = [0.1, 0.25, 0.3, 0.7, 0.71, 0.9, 0.95]
    row = select.gain_distribution(spark.createDataFrame([("partial", g) for g in gains], "class string, gain double")).first()
    assert list(row)[2:] == pytest.approx(statistics.quantiles(gains, n=10, method="inclusive")) and list(row)[:2] == pytest.approx([statistics.mean(gains), statistics.median(gains)])
    none = select.impact(kept.limit(0), commits.limit(0), 0, commits.limit(0))
    assert set(select.gain_distribution(none).first()) == {None} and tuples(select.impact_summary(none), "n", "share") == {(0, None)}


def test_traces(spark):
    events = spark.createDataFrame(
        [("s", 1, "m", "a.b", "ok", False, None, None), ("s", 2, "a.b", "c", "ok", None, None, None), ("s", 3, "c", "d", "error", False, None, None), ("s", 4, "c", "e", "ok", True, None, None), ("s", 5, "c", "a.b", "ok", False, None, None)],
        "session string, seq long, context string, module string, status string, is_ignored boolean, anchor_module string, anchor_fn string",
    )
    assert tuples(trace.observed_edges(events)) == {("m", "a.b"), ("a.b", "a"), ("a.b", "c"), ("c", "a.b")}
    seen = trace.tracked(events)
    assert ("m", "c") in tuples(seen) and ("a.b", "a.b") in tuples(seen) and ("m", "d") not in tuples(seen)
    frames = spark.createDataFrame([(1, 0, "x", "f"), (1, 1, "y", "g"), (1, 2, "z", "h"), (2, 0, "x", "f"), (2, 1, "i", "i"), (3, 0, "q", "q"), (3, 1, "r", "r")], "event_id long, depth int, module string, fn string")
    anchors, ignored = pairs(spark, "module fn", ("y", "g"), ("x", "f"), ("z", "h")), pairs(spark, "module fn", ("i", "i"))
    assert tuples(trace.dynamic_anchors(frames, anchors, ignored)) == {(1, "x", "f")}
    assert tuples(trace.dynamic_anchors(frames, anchors, ignored, implicit=True)) == {(1, "x", "f"), (3, "r", "r")}
    assert tuples(trace.with_dynamic(pairs(spark, "module dep", ("m", "n")), pairs(spark, "module anchor_module anchor_fn", ("m", "y", "g"), ("k", "y", "z")), pairs(spark, "anchor_module anchor_fn dep", ("y", "g", "late"), ("y", "g", "m")))) == {("m", "n"), ("m", "late")}
    observed, static = pairs(spark, "module dep", ("m", "a"), ("m", "b"), ("k", "c")), pairs(spark, "module dep", ("m", "a"))
    assert tuples(trace.missing(observed, static)) == {("m", "b"), ("k", "c")}
    assert tuples(trace.missing_by_package(observed, static, pairs(spark, "module pkg", ("m", "p"), ("k", "p")))) == {("p", 2, 2)}
    got = trace.unexpected(pairs(spark, "item file dep", ("i", "f", "a"), ("i", "f", "b"), ("j", "g", "c")), pairs(spark, "file dep", ("f", "a")), one(spark, "dep", "c"))
    assert tuples(got) == {("i", "b")}
    assert tuples(trace.newly_loaded(one(spark, "m", "a"), one(spark, "m", "a", "b"))) == {("b",)}
    assert tuples(trace.nesting_errors(pairs(spark, "session context kind", ("s", "c", "enter"), ("s", "c", "exit"), ("s", "d", "enter")))) == {("s", "d", 1, 0)}
    assert trace.distinct_stacks(spark.createDataFrame([([("f", 1)],), ([("f", 1)],), ([("f", 2)],)], "stack array<struct<file:string,line:int>>")).count() == 2
    assert tuples(trace.drop_frames(one(spark, "file", "a.py", "importlib.py"), ["importlib.py"])) == {("a.py",)}


@pytest.mark.parametrize(("pack", "anchors"), [(1024, 100_000), (4, 0)])
@pytest.mark.parametrize("kind", ["even", "one dep of all", "one module of all", "none", "few deps"])
def test_totals_are_those_of_the_pairs(spark, monkeypatch, kind, pack, anchors):
    monkeypatch.setattr(trace, "PACK", pack)
    monkeypatch.setattr(trace, "FEW_ANCHORS", anchors)
    made, sharing = [], trace._sharing
    monkeypatch.setattr(trace, "_sharing", lambda a, b: made.append((a.count(), sharing(a, b).count())) or sharing(a, b))
    rng = random.Random(kind)
    users = [(rng.randrange(60), rng.randrange(30)) for _ in range(200)] + [(None, 1), (3, None)]
    imports = [] if kind == "none" else [(rng.randrange(30), rng.randrange(3 if kind == "few deps" else 200)) for _ in range(600)] + [(None, 1), (3, None)]
    own = [(rng.randrange(62), rng.randrange(-1, 220)) for _ in range(40)] + [(4, d) for d in range(9)] + [(None, 1), (3, None)]
    if kind == "one dep of all":
        imports += [(a, 7) for a in range(30)]
    if kind == "one module of all":
        users += [(5, a) for a in range(30)]
    got = trace.dynamic_totals(*(spark.createDataFrame(r + r[:9], c) for r, c in ((own, "module long, dep long"), (users, "module long, anchor long"), (imports, "anchor long, dep long"))))
    want = {}
    for m, d in {r for r in own if None not in r} | {(m, d) for m, a in users for b, d in imports if a == b and None not in (m, a, d)}:
        want.setdefault(m, set()).add(d)
    assert sorted(map(tuple, got.collect())) == sorted((m, len(d), sum(d)) for m, d in want.items())
    assert made[0][0] > made[0][1] > 5 or kind in ("none", "few deps")


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True)
    run("init", "-q", "-b", "main")
    (tmp_path / "old name.py").write_text("x = 1\n" * 20)
    (tmp_path / "b.py").write_text("")
    run("add", ".")
    run("commit", "-qm", "first")
    run("mv", "old name.py", "new name.py")
    run("commit", "-qm", "second")
    git = vcs.Git.detect(str(tmp_path))
    assert git.is_clean() and len(git.recent(5)) == 2 and git.recent(1) == [git.commit_id()] and git.remotes() == []
    changes = vcs.changes_frame(spark, git.changes())
    assert tuples(vcs.modified(changes), "path") == {("old name.py",), ("new name.py",)}
    run("checkout", "-qb", "side", "HEAD~1")
    (tmp_path / "side.py").write_text("")
    run("add", ".")
    run("commit", "-qm", "side")
    run("checkout", "-q", "main")
    run("merge", "-q", "--no-ff", "-m", "merge", "side")
    assert {c[2] for c in git.changes()} == {"new name.py", "side.py"} and git.fork_point("side") == git.parents("HEAD")[1]
    assert {c[2] for c in git.changes("HEAD", "HEAD~1")} == {"side.py"}
    (tmp_path / "un tracked.py").write_text("")
    run("mv", "b.py", "c.py")
    assert {(s, p, o) for _, s, p, o in git.dirty()} == {("R", "c.py", "b.py"), ("??", "un tracked.py", None)} and not git.is_clean()
    assert vcs.Git.detect("/nonexistent") is None
    assert vcs.name_status("M\0a\0?\0b\0C75\0c\0d\0") == [("M", "a", None), ("C", "d", "c")]


NS = "__path__ = __import__('pkgutil').extend_path(__path__, __name__)\n"


def test_discovery(spark):
    tree = {
        "src/one/__init__.py": "", "src/one/sub/__init__.py": "", "src/one/m.py": "", "src/spaces/__init__.py": NS, "src/spaces/inner/__init__.py": NS, "src/spaces/inner/real/__init__.py": "", "src/spaces/inner/__pycache__/x.py": "",
        "src/branch/__init__.py": NS, "src/branch/a/__init__.py": "", "src/branch/b/__init__.py": "", "src/bare/__init__.py": NS, "tests/__init__.py": "", "tests/test_m.py": "", "docs/conf.py": "", ".venv/lib/pkg/__init__.py": "", "extra/checks/__init__.py": "", "extra/checks/deep/test_z.py": "",
    }
    files = spark.createDataFrame(sorted(tree.items()), "path string, source string")
    roots = discovery.package_roots(files)
    assert tuples(roots) == {("src/one",), ("src/spaces",), ("src/branch",), ("src/bare",), ("tests",), ("extra/checks",)}
    spaces = {r.folder: (r.fs, r.py) for r in discovery.namespace_roots(files, roots).collect()}
    assert spaces["src/spaces"] == ("src/spaces/inner/real", "spaces.inner.real") and spaces["src/one"] == ("src/one", "one")
    assert spaces["src/branch"] == ("src/branch", "branch") and spaces["src/bare"] == ("src/bare", "bare")
    assert tuples(discovery.import_paths(files, one(spark, "path", "src/one/sub", "extra/checks/deep", "docs"))) == {("src/one/sub", "one.sub"), ("extra/checks/deep", "checks.deep"), ("docs", "docs")}
    setuptools = lambda **k: {"tool": {"setuptools": {"packages": {"find": k}}}}
    assert tuples(discovery.filter_packages(roots, setuptools(where=["src"], include=["*one", "*b?re"]))) == {("src/one",), ("src/bare",)}
    assert tuples(discovery.filter_packages(roots, {"tool": {"maturin": {"python-source": "src", "python-packages": ["one"]}}})) == {("src/one",), ("tests",)}
    project = setuptools(where=["src", "tests"]) | {}
    project["tool"]["pytest"] = {"ini_options": {"testpaths": ["tests/", "extra/checks"], "python_files": ["plain.py", "check_*.py"]}}
    hook = discovery.default_hook(files, project)
    assert hook.global_namespaces == {"one", "spaces", "branch", "bare"} and hook.local_namespaces == {"tests", "checks"}
    assert hook.source_roots["src/spaces/inner/real"] == "spaces.inner.real" and hook.source_roots["extra/checks"] == "checks" and hook.test_folders == {"tests": "tests", "extra/checks": "checks"} and hook.test_glob == "check_*.py"
    assert discovery.default_hook(files).test_folders == {"tests": "tests"} and discovery.read_project("/nonexistent.toml") == {}


def test_package_lists(spark, tmp_path):
    (tmp_path / "list").write_text("a/b:x.y\nc:d\n\n")
    assert tuples(storage.package_list(spark, f"@{tmp_path}/list")) == {("a/b", "x.y"), ("c", "d")} == tuples(storage.package_list(spark, "a/b:x.y,c:d"))


def test_a_large_component_needs_no_pairs(spark, monkeypatch):
    """20,000 nodes in one component by random edges, and a chain of small ones; the closure isn't asked."""
    monkeypatch.setattr(closure, "transitive_closure", None)
    n = 20_000
    rng = random.Random(8)
    rows = [(f"a{i}", f"a{rng.randrange(n)}") for i in range(n) for _ in range(8)] + [(f"b{i}{x}", f"b{i}{y}") for i in range(5) for x, y in ("pq", "qp")] + [(f"b{i}p", f"b{i + 1}p") for i in range(4)] + [("a0", "b0p"), ("b4q", "c")]
    edges = spark.createDataFrame(rows, "src string, dst string").repartition(4)
    got = closure.strong_components(edges.select(F.col("src").alias("node")).union(edges.select("dst")), edges)
    sizes = {r.comp: r["count"] for r in got.groupBy("comp").count().collect()}
    assert sizes.pop("c") == 1 and [sizes.pop(f"b{i}p") for i in range(5)] == [2] * 5
    assert max(sizes.values()) > n * 0.99 and sum(sizes.values()) == n

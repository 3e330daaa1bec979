"""python -m depweave ROOT [--hook FILE] [--graph FOLDER] (--depends NAME | --affected PATH... | --modified [COMMIT] | --unresolved | --dynamic | --dump)"""

from __future__ import annotations

import argparse
import os

from depweave.plans.dependency_graph import DependencyGraph
from depweave.plans.hooks import Hook, load_hook
from depweave.session import scratch_path, session
from depweave.sources.discovery import default_hook, read_project
from depweave.sources.source_tree import read_tree
from depweave.sources.vcs import Git


def main(argv: list[str] | None = None) -> list[str]:
    parser = argparse.ArgumentParser(prog="depweave", description=__doc__)
    parser.add_argument("root")
    parser.add_argument("--hook", help="Python file with a Hook class; by default the tree is scanned for one")
    parser.add_argument("--graph", help="folder of the saved graph, made if it isn't there")
    what = parser.add_mutually_exclusive_group(required=True)
    what.add_argument("--depends", metavar="NAME", help="path or import path")
    what.add_argument("--affected", metavar="PATH", nargs="+")
    what.add_argument("--modified", metavar="COMMIT", nargs="?", const="HEAD", help="affected by a commit and by what isn't committed")
    what.add_argument("--unresolved", action="store_true")
    what.add_argument("--dynamic", action="store_true", help="tests that reach dynamic imports")
    what.add_argument("--dump", action="store_true")
    args = parser.parse_args(argv)

    spark = session()
    tree = lambda: read_tree(spark, args.root)
    hook: Hook = load_hook(args.hook) if args.hook else default_hook(tree(), read_project(os.path.join(args.root, "pyproject.toml")))
    graph = DependencyGraph.load_or_build(spark, args.graph or scratch_path(spark, "graph"), args.root, hook)
    if args.depends:
        found = graph.depends(args.depends)
        lines = ["unknown"] if found is None else sorted({r["py"] for r in found.toLocalIterator()})
    elif args.affected or args.modified:
        changed = args.affected
        if not changed:
            git = Git(args.root)
            changed = sorted({p for _, _, path, old in git.changes(args.modified) + git.dirty() for p in (path, old) if p})
        lines = sorted({r["fs"] for r in graph.affected_by_files(changed).toLocalIterator()} | set(changed))
    elif args.unresolved:
        lines = [f"{r['target']}: {', '.join(r['importers'])}" for r in graph.unresolved().orderBy("target").toLocalIterator()]
    elif args.dynamic:
        lines = sorted(r["fs"] for r in graph.exposed_to_dynamic_imports(hook.test_glob).toLocalIterator())
    else:
        lines = [r["line"] for r in graph.dump().toLocalIterator()]
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main()

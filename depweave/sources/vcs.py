"""Change sets: git on the driver, and the same operations on tables of changes.

Output of git is read with ``-z``, so names with spaces and both sides of a rename come through whole.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = "commit_id string, status string, path string, old_path string"


class Git:
    """Facts about a git work tree."""

    def __init__(self, root: str):
        self.root = root

    def _run(self, *args: str) -> str:
        return subprocess.run(["git", "-C", self.root, *args], check=True, capture_output=True, text=True).stdout

    @staticmethod
    def detect(path: str) -> Git | None:
        """The work tree that holds path, None if there is none."""
        try:
            return Git(Git(path).top())
        except (subprocess.CalledProcessError, OSError):
            return None

    def top(self) -> str:
        return self._run("rev-parse", "--show-toplevel").strip()

    def is_clean(self) -> bool:
        return not self._run("status", "--porcelain=v1", "-z")

    def commit_id(self) -> str:
        return self._run("rev-parse", "HEAD").strip()

    def remotes(self) -> list[str]:
        return self._run("remote").split()

    def recent(self, n: int = 20) -> list[str]:
        """The last n commits, newest first."""
        return self._run("log", "-n", str(n), "--format=%H").split()

    def parents(self, commit: str) -> list[str]:
        return self._run("rev-list", "--parents", "-n", "1", commit).split()[1:]

    def merge_base(self, commits: Iterable[str]) -> str:
        return self._run("merge-base", "--octopus", *commits).strip()

    def fork_point(self, branch: str) -> str:
        return self._run("merge-base", branch, "HEAD").strip()

    def changes(self, commit: str = "HEAD", base: str | None = None) -> list[tuple[str, str, str, str | None]]:
        """(commit, status, path, old path) of a commit, or of base..commit. A merge counts from the merge base of its parents."""
        parents = [] if base else self.parents(commit)
        if base is None and len(parents) > 1:
            base = self.merge_base(parents)
        if base:
            out = self._run("diff", "--name-status", "-z", "-M", base, commit)
        else:
            out = self._run("show", "--name-status", "-z", "-M", "--format=", commit)
        return [(commit, *x) for x in name_status(out)]

    def dirty(self) -> list[tuple[str, str, str, str | None]]:
        """Uncommitted changes, untracked files included."""
        fields = iter(self._run("status", "--porcelain=v1", "-z", "--untracked-files=all").split("\0"))
        out = []
        for x in fields:
            if x:
                out.append(("dirty", x[:2].strip(), x[3:], next(fields) if x[0] in "RC" else None))
        return out


def name_status(text: str) -> list[tuple[str, str, str | None]]:
    """(status, path, old path) from ``--name-status -z``; statuses ? and ! are left out."""
    fields = iter(x.strip("\n") for x in text.split("\0"))
    out = []
    for status in fields:
        if not status:
            continue
        first = next(fields)
        old, path = (first, next(fields)) if status[0] in "RC" else (None, first)
        if status[0] not in "?!":
            out.append((status[0], path, old))
    return out


def changes_frame(spark: SparkSession, rows: list[tuple[str, str, str, str | None]]) -> DataFrame:
    return spark.createDataFrame(rows, CHANGES)


def modified(changes: DataFrame) -> DataFrame:
    """Distinct (commit_id, path), both sides of a rename; statuses ? and ! are left out."""
    real = changes.where(~F.substring("status", 1, 1).isin("?", "!"))
    return real.select("commit_id", F.explode(F.array_compact(F.array("path", "old_path"))).alias("path")).where("path <> ''").distinct()


def recent_commits(commits: DataFrame, n: int, ts: str = "ts", key: str = "commit_id") -> DataFrame:
    """The n newest rows; ties by key."""
    return commits.orderBy(F.col(ts).desc(), F.col(key)).limit(n)

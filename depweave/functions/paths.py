"""Column functions on dotted and slashed paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_segment(path: Column | str, sep: str = ".") -> Column:
    return F.substring_index(_c(path), sep, 1)


def last_segment(path: Column | str, sep: str = ".") -> Column:
    return F.substring_index(_c(path), sep, -1)


def parent(path: Column | str, sep: str = ".") -> Column:
    """The path without its last segment, null if it has one only."""
    p = _c(path)
    return F.when(p.contains(sep), F.substring(p, F.lit(1), F.length(p) - F.length(last_segment(p, sep)) - len(sep)))


def segment_prefixes(path: Column | str, sep: str = ".", itself: bool = True) -> Column:
    """All whole-segment prefixes from short to long, with or without the path itself."""
    parts = F.split(_c(path), re.escape(sep))
    n = F.size(parts) if itself else F.size(parts) - 1
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep)))


def drop_segments(path: Column | str, level: Column | int, sep: str = ".") -> Column:
    """The path without ``level`` segments at its end, null if nothing would be left: how a relative import finds its base."""
    parts = F.split(_c(path), re.escape(sep))
    level = F.lit(level) if isinstance(level, int) else level
    return F.when(F.size(parts) > level, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - level), sep))


def dots_to_slashes(path: Column | str) -> Column:
    return F.replace(_c(path), F.lit("."), F.lit("/"))


def slashes_to_dots(path: Column | str) -> Column:
    return F.replace(_c(path), F.lit("/"), F.lit("."))


def within(path: Column | str, root: Column | str, sep: str = ".") -> Column:
    """Whether the path is the root or below it, by whole segments."""
    p, r = _c(path), _c(root)
    return (p == r) | F.startswith(p, F.concat(r, F.lit(sep)))


def below(path: Column | str, root: Column | str, sep: str = "/") -> Column:
    """What follows the root and a separator; null if the path isn't below it."""
    p, r = _c(path), _c(root)
    return F.when(F.startswith(p, F.concat(r, F.lit(sep))), F.substring(p, F.length(r) + len(sep) + 1, F.length(p)))


def rebased(path: Column | str, old: Column | str, new: Column | str) -> Column:
    """The path moved from one root to another; unchanged if it isn't below the old one."""
    rest = below(path, old)
    return F.when(_c(path) == _c(old), _c(new)).when(rest.isNotNull(), F.concat_ws("/", _c(new), rest)).otherwise(_c(path))


def glob_pattern(glob: str) -> str:
    """A shell pattern as a regular expression for ``rlike``: ``*``, ``?``, ``[...]`` and ``[!...]``; ``*`` passes slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inner = glob[i + 1 : close].replace("\\", "\\\\")
            out += f"[{'^' + inner[1:] if inner[0] == '!' else inner}]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return rf"(?s)\A{out}\z"


def matches_glob(path: Column | str, glob: str) -> Column:
    return _c(path).rlike(glob_pattern(glob))


def is_test_file(path: Column | str, glob: str | None = None) -> Column:
    """``test_*.py`` or ``*_test.py`` by file name, or a glob on the name instead."""
    name = last_segment(path, "/")
    return matches_glob(name, glob) if glob else matches_glob(name, "test_*.py") | matches_glob(name, "*_test.py")


def comma_list(text: Column | str) -> Column:
    """Items of a comma list, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(_c(text), ","), lambda x: F.trim(x)), lambda x: x != "")


def hex_name(letter: str, number: Column | str) -> Column:
    """``V00ff`` for 255: at least four lower-case digits."""
    digits = F.lower(F.hex(_c(number)))
    return F.concat(F.lit(letter), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def nested_lookup(value, dotted: str):
    """The value at a dotted path in nested dictionaries, None if there is none."""
    for key in dotted.split("."):
        if not isinstance(value, dict) or key not in value:
            return None
        value = value[key]
    return value

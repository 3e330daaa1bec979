"""From files to modules and from raw imports to edges: admission, naming and ranked resolution as joins.

Tables: files (path[, source]), source_roots (fs_root, py_prefix, is_local), namespaces (name, kind: global, local or external).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.functions.paths import below, dots_to_slashes, first_segment, last_segment, parent, slashes_to_dots, within
from depweave.operators.prefix import longest_prefix, strict_prefix
from depweave.schema import node_key

#: First hit wins, for the full path and then for its parent.
RANKED = ("/__init__.py", "/__init__.pyi", ".py", ".pyx", ".pyi")


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def admit(files: DataFrame) -> DataFrame:
    """Files to analyse: .py; .pyx without a .py of the name; .pyi without either. A module beside a package of its name is left out."""
    rank = F.when(F.col("path").endswith(".py"), 0).when(F.col("path").endswith(".pyx"), 1).when(F.col("path").endswith(".pyi"), 2)
    ranked = files.withColumn("__rank", rank).where("__rank IS NOT NULL").withColumn("__stem", _stem(F.col("path")))
    best = ranked.groupBy("__stem").agg(F.min("__rank").alias("__rank"))
    packages = files.where(F.col("path").endswith("/__init__.py") | F.col("path").endswith("/__init__.pyi")).select(parent("path", "/").alias("__stem")).distinct()
    return ranked.join(best, ["__stem", "__rank"], "left_semi").join(packages, "__stem", "left_anti").drop("__stem", "__rank")


def name_modules(files: DataFrame, source_roots: DataFrame) -> DataFrame:
    """files with fs_root, module (a package's name ends in __init__), py and pkg; files below no source root are left out."""
    rooted = longest_prefix(files, "path", source_roots.select(F.col("fs_root").alias("prefix")), "/", "fs_root")
    named = rooted.where("fs_root IS NOT NULL").join(source_roots, "fs_root")
    rest = F.coalesce(below(_stem(F.col("path")), F.col("fs_root")), F.lit(""))
    module = F.concat_ws(".", F.when(F.col("py_prefix") != "", F.col("py_prefix")), F.when(rest != "", slashes_to_dots(rest)))
    return named.withColumn("module", module).withColumn("py", F.regexp_replace("module", r"\.__init__$", "")).withColumn("pkg", F.expr("CASE WHEN is_local THEN fs_root END"))


def classify(names: DataFrame, name: str, namespaces: DataFrame) -> DataFrame:
    """names with kind: global or local by first segment, null if neither."""
    known = namespaces.where("kind <> 'external'").select(F.col("name").alias("__ns"), F.col("kind").alias("kind")).distinct()
    return names.join(known, first_segment(name) == F.col("__ns"), "left").drop("__ns")


def modules_of(named: DataFrame, source_roots: DataFrame) -> DataFrame:
    """Module rows of named files (with ``is_ns``): namespace packages of the global namespace have no file."""
    globals_ = source_roots.where("NOT is_local").select(F.col("py_prefix").alias("prefix"))
    flagged = strict_prefix(named, "py", globals_, ".", "__above")
    fileless = F.col("pkg").isNull() & (F.col("is_ns") | F.col("__above"))
    out = flagged.withColumn("fs", F.when(~fileless, F.col("path")))
    return out.withColumn("node", node_key(F.col("fs"), F.col("py"))).drop("__above")


def _ranked_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (key, py, base) with the first existing file: (key, fs, py)."""
    tries = F.array(
        *(
            F.struct(F.lit(a).alias("attempt"), F.lit(r).alias("rank"), F.concat(base, F.lit(s)).alias("path"), py.alias("py"))
            for a, (base, py) in enumerate(((F.col("base"), F.col("py")), (parent("base", "/"), parent("py"))))
            for r, s in enumerate(RANKED)
        )
    )
    each = wanted.select("key", F.explode(tries).alias("t")).where("t.path IS NOT NULL AND t.py IS NOT NULL")
    hits = each.join(files.select(F.col("path").alias("__path")).distinct(), F.col("t.path") == F.col("__path"), "left_semi")
    return hits.groupBy("key").agg(F.min_by("t", F.struct("t.attempt", "t.rank")).alias("t")).select("key", F.col("t.path").alias("fs"), F.col("t.py").alias("py"))


def candidates(wanted: DataFrame, source_roots: DataFrame, namespaces: DataFrame) -> DataFrame:
    """wanted (key, fs_root, py) with base (path to look for, without suffix) and pkg; names in no namespace or root are left out.

    Global names: the longest global root. Local names: the importer's own root if the name is within its prefix, else the root
    of that name beside it.
    """
    kinds = classify(wanted, "py", namespaces).where("kind IS NOT NULL")
    roots = source_roots.where("NOT is_local").select(F.col("fs_root").alias("__root"), F.col("py_prefix").alias("__prefix"))
    far = longest_prefix(kinds.where("kind = 'global'"), "py", roots.select(F.col("__prefix").alias("prefix")), ".", "__long").join(roots, F.col("__long") == F.col("__prefix"))
    rest = lambda: dots_to_slashes(F.substring(F.col("py"), F.length("__prefix") + 1, F.length("py")))
    globally = far.select("key", "py", F.concat("__root", rest()).alias("base"), F.lit(None).cast("string").alias("pkg"))
    own = source_roots.where("is_local").select(F.col("fs_root").alias("fs_root"), F.col("py_prefix").alias("__own"))
    local = kinds.where("kind = 'local'").join(own, "fs_root")
    beside = F.concat(F.expr("left(fs_root, length(fs_root) - length(__own))"), first_segment("py"))
    target = local.withColumn("__root", F.when(within("py", "__own"), F.col("fs_root")).otherwise(beside)).drop("__own")
    there = source_roots.where("is_local").select(F.col("fs_root").alias("__root"), F.col("py_prefix").alias("__prefix"))
    locally = target.join(there, "__root").where(within("py", "__prefix")).select("key", "py", F.concat("__root", rest()).alias("base"), F.col("__root").alias("pkg"))
    return globally.unionByName(locally)


def _children(base: DataFrame, files: DataFrame) -> DataFrame:
    """For star imports: (key, name) of importable children of base (key, base)."""
    py = files.where(F.col("path").rlike(r"\.py[ix]?$")).select("path")
    is_init = F.col("path").rlike(r"/__init__\.py[ix]?$")
    module = py.where(~is_init).select(parent("path", "/").alias("base"), _stem(last_segment("path", "/")).alias("name"))
    package = py.where(is_init).select(parent(parent("path", "/"), "/").alias("base"), last_segment(parent("path", "/"), "/").alias("name"))
    return base.join(module.unionByName(package).where("base IS NOT NULL").distinct(), "base").select("key", "name", "base")


def resolve(raw: DataFrame, files: DataFrame, modules: DataFrame, source_roots: DataFrame, namespaces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, unresolved, modules): raw is (node, importer, pkg, fs_root, dep), files everything that exists.

    External prefixes come first, then namespace packages, then files; ``p.*`` means p and its children. What is in a known
    namespace and can't be found leaves its parent in unresolved. Each distinct (root, name) is resolved once, for all its importers.
    """
    raw = raw.where("dep IS NOT NULL AND dep <> ''")
    external = namespaces.where("kind = 'external'").select(F.col("name").alias("prefix"))
    asked = raw.select("fs_root", "dep").distinct()
    asked = longest_prefix(asked, "dep", external, ".", "ext")
    star = F.col("dep").endswith(".*")
    asked = asked.withColumn("star", star & F.col("ext").isNull()).withColumn("py", F.when(star, F.expr("left(dep, length(dep) - 2)")).otherwise(F.col("dep")))
    globals_ = source_roots.where("NOT is_local").select(F.col("py_prefix").alias("prefix"))
    asked = strict_prefix(asked, "py", globals_, ".", "above").withColumn("key", F.struct("fs_root", "dep"))

    outside = asked.where("ext IS NOT NULL").select("key", F.lit(None).cast("string").alias("fs"), F.col("ext").alias("py"), F.lit(None).cast("string").alias("pkg"))
    inside = asked.where("ext IS NULL")
    spaces = inside.where("above").select("key", F.lit(None).cast("string").alias("fs"), "py", F.lit(None).cast("string").alias("pkg"))
    placed = candidates(inside.where("NOT above OR star").select("key", "fs_root", "py"), source_roots, namespaces)
    whole = _ranked_files(placed.join(inside.where("NOT above").select("key"), "key", "left_semi"), files)
    pkg_of = placed.select("key", "pkg")
    direct = whole.join(pkg_of, "key").select("key", "fs", "py", "pkg")
    starred = placed.join(inside.where("star").select("key"), "key", "left_semi")
    kids = _children(starred.select("key", "base"), files).join(starred.select("key", F.col("py").alias("__py"), "pkg"), "key")
    kids = kids.select(F.struct("key", "name").alias("sub"), "key", F.concat_ws(".", "__py", "name").alias("py"), F.concat_ws("/", "base", "name").alias("base"), "pkg")
    kid_files = _ranked_files(kids.select(F.col("sub").alias("key"), "py", "base"), files)
    expanded = kid_files.join(kids.select(F.col("sub").alias("key"), F.col("key").alias("__key"), "pkg"), "key").select(F.col("__key").alias("key"), "fs", "py", "pkg")

    found = outside.unionByName(spaces).unionByName(direct).unionByName(expanded)
    # A file that was scanned is the node it became there, a namespace package's __init__ too.
    scanned = modules.select(F.col("path").alias("__path"), F.col("node").alias("__node")).where("__path IS NOT NULL")
    targets = found.join(scanned, F.col("fs") == F.col("__path"), "left").withColumn("dst", F.coalesce("__node", node_key(F.col("fs"), F.col("py"))))
    links = raw.select(F.col("node").alias("src"), F.struct("fs_root", "dep").alias("key")).join(targets.select("key", "dst").distinct(), "key")
    edges = links.where("src <> dst").select("src", "dst").distinct()

    missing = inside.where("NOT star AND NOT above").join(direct.select("key"), "key", "left_anti")
    missing = classify(missing, "py", namespaces).where(F.col("kind").isNotNull() & F.col("py").contains(".")).select("key", parent("py").alias("target"))
    unresolved = raw.select("importer", F.struct("fs_root", "dep").alias("key")).join(missing, "key").select("target", "importer").distinct()

    seen = modules.select("node", "fs", "py", "pkg").unionByName(targets.where("__node IS NULL").select(F.col("dst").alias("node"), "fs", "py", "pkg"))
    return edges, unresolved, seen.groupBy("node").agg(F.first("fs", True).alias("fs"), F.min("py").alias("py"), F.first("pkg", True).alias("pkg"))

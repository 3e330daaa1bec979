"""Runtime traces against the static graph.

trace: session, seq, context, module, status, is_ignored, anchor_module, anchor_fn. Capturing one is the tracer's business.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depweave.functions.paths import parent
from depweave.operators.closure import transitive_closure
from depweave.session import materialise

#: Anchors and deps of a module that one array of ``dynamic_totals`` holds at most.
PACK = 1024
#: Anchors up to which their totals are broadcast: some 6 MB (reckoned, not measured).
FEW_ANCHORS = 100_000
#: How many times fewer rows the pairs of anchors that share a dep must promise than the pairs of modules and deps.
FEWER = 4
#: Bits of the filter in ``_sharing``: 2,048 bitmaps of 4 KB, so 8 MB whatever the tables' size.
FILTER = 1 << 26


def observed_edges(trace: DataFrame) -> DataFrame:
    """Direct (src, dst): who imported what, failed and ignored imports left out, with each module's parent."""
    real = trace.where((F.col("status") == "ok") & ~F.coalesce("is_ignored", F.lit(False))).select(F.col("context").alias("src"), F.col("module").alias("dst")).distinct()
    up = real.select(F.col("dst").alias("src"), parent("dst").alias("dst")).where("dst IS NOT NULL")
    return real.unionByName(up).where("src IS NOT NULL AND src <> dst").distinct()


def tracked(trace: DataFrame) -> DataFrame:
    """(module, dep): all that each context pulled in."""
    return transitive_closure(observed_edges(trace)).select(F.col("src").alias("module"), F.col("dst").alias("dep"))


def dynamic_anchors(frames: DataFrame, anchors: DataFrame, ignored: DataFrame, implicit: bool = False) -> DataFrame:
    """(event_id, module, fn) that a dynamic import counts for: frames (event_id, depth, module, fn), depth 0 outermost.

    An ignored frame anywhere drops the event; else the outermost configured anchor; else, if implicit, the innermost frame.
    """
    marked = frames.join(anchors.select("module", "fn").distinct().withColumn("__anchor", F.lit(True)), ["module", "fn"], "left")
    marked = marked.join(ignored.select("module", "fn").distinct().withColumn("__ignored", F.lit(True)), ["module", "fn"], "left")
    at = F.struct("module", "fn")
    each = marked.groupBy("event_id").agg(
        F.bool_or(F.coalesce("__ignored", F.lit(False))).alias("__drop"), F.min_by(F.when(F.col("__anchor"), at), F.when(F.col("__anchor"), F.col("depth"))).alias("__first"), F.max_by(at, "depth").alias("__last")
    )
    chosen = F.coalesce("__first", "__last") if implicit else F.col("__first")
    return each.where("NOT __drop").select("event_id", chosen.alias("at")).where("at IS NOT NULL").select("event_id", "at.module", "at.fn")


def with_dynamic(tracked_: DataFrame, users: DataFrame, imports: DataFrame) -> DataFrame:
    """(module, dep): tracked, and for each anchor a module uses what that anchor imported; users (module, anchor_module, anchor_fn), imports (anchor_module, anchor_fn, dep)."""
    used = users.join(imports, ["anchor_module", "anchor_fn"]).select("module", "dep")
    return tracked_.select("module", "dep").unionByName(used).where("module <> dep").distinct()


def dynamic_totals(tracked_: DataFrame, users: DataFrame, imports: DataFrame) -> DataFrame:
    """(module, n_deps, sum_deps): how many deps with_dynamic pairs each module with, and their sum, without making the pairs.

    tracked (module, dep), users (module, anchor), imports (anchor, dep); deps are whole numbers that name no module, rows may repeat, rows with nulls are left out.
    The totals of a module's anchors are added up, and what several of them import, or the module has itself, is taken off again: it is found by the pairs of
    anchors that share a dep. Modules whose pairs of anchors would (on the mean of all pairs) find more than a fourth (``FEWER``) as many rows as there are deps, and deps with so
    many importers that pairs of those would be more than a fourth of their uses, are counted by their distinct pairs instead.
    """
    seen = imports.select("anchor", F.col("dep").cast("long").alias("dep")).dropna().distinct()
    seen = materialise(seen.withColumn("importers", F.count(F.lit(1)).over(W.partitionBy("dep"))), "imports")
    used = users.select("module", "anchor").dropna()
    size = seen.agg(F.count_distinct("anchor").alias("anchors"), F.max("importers").alias("importers")).first()
    most = 2 * used.count() // (FEWER * max(1, size["anchors"])) + 1
    light = F.col("importers") <= most
    left = seen.where(light).select(F.col("anchor").alias("first"), "dep")
    shared = materialise(left.join(seen.where(light), "dep").where("first < anchor").select("first", "anchor", "dep"), "shared")
    common = max(1.0, shared.count() / max(1, size["anchors"] * (size["anchors"] - 1) // 2))

    sums = seen.groupBy("anchor").agg(F.count_if(light).alias("n"), F.coalesce(F.sum(F.when(light, F.col("dep"))), F.lit(0)).alias("keys"))
    rows = used.join(F.broadcast(sums) if size["anchors"] <= FEW_ANCHORS else sums, "anchor").withColumn("dep", F.lit(None).cast("long"))
    rows = rows.unionByName(tracked_.select("module", F.col("dep").cast("long").alias("dep")).dropna(), allowMissingColumns=True)
    own = W.partitionBy("module")
    rows = rows.repartition("module").dropDuplicates(["module", "anchor", "dep"])
    rows = rows.withColumn("rows", F.count(F.lit(1)).over(own)).withColumn("part", F.floor((F.row_number().over(own.orderBy("anchor", "dep")) - 1) / PACK))
    packed = rows.groupBy("module", "rows", "part").agg(F.sort_array(F.collect_list("anchor")).alias("anchors"), F.collect_list("dep").alias("deps"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "keys")))
    packed = materialise(packed, "modules")
    k, d = (F.size(c).cast("long") for c in ("anchors", "deps"))
    by_pairs = (F.col("rows") <= PACK) & (FEWER * (k * (k - 1) / 2 * common + k * d) <= F.col("n") + d)
    few, many = packed.where(by_pairs), packed.where(~by_pairs)
    pairs = few.where(k > 1).select("module", "anchors", F.posexplode("anchors").alias("i", "first")).select("module", "first", F.explode(F.expr("slice(anchors, i + 2, size(anchors))")).alias("anchor"))
    twice = _sharing(pairs, shared).join(shared, ["first", "anchor"]).select("module", "anchor", "dep")
    held = few.where(d > 0).select("module", "deps", F.explode("anchors").alias("anchor")).select("module", "anchor", F.explode("deps").alias("dep"))
    held = held.join(seen, ["anchor", "dep"], "left_semi").withColumn("anchor", F.lit(None).cast(seen.schema["anchor"].dataType))

    each = lambda df: df.select("module", F.explode("anchors").alias("anchor"))
    direct = each(many).join(seen, "anchor").select("module", "dep").unionByName(many.select("module", F.explode("deps").alias("dep")))
    if (size["importers"] or 0) > most:
        direct = direct.unionByName(each(few).join(seen.where(~light), "anchor").select("module", "dep"))

    out = few.select("module", (F.col("n") + d).alias("n"), (F.col("keys") + F.aggregate("deps", F.lit(0).cast("long"), lambda a, b: a + b)).alias("keys"))
    out = out.unionByName(twice.unionByName(held).distinct().select("module", F.lit(-1).cast("long").alias("n"), (-F.col("dep")).alias("keys")))
    out = out.unionByName(direct.distinct().select("module", F.lit(1).cast("long").alias("n"), F.col("dep").alias("keys")))
    return out.groupBy("module").agg(F.sum("n").alias("n_deps"), F.sum("keys").alias("sum_deps")).where("n_deps > 0")


def _sharing(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """pairs (with first, anchor) without most of those that aren't in shared, before they are shuffled; keeps all that are. With very many in it, it merely leaves out less."""
    place = F.pmod(F.xxhash64("first", "anchor"), F.lit(FILTER)) + 1
    at = {"map": F.bitmap_bucket_number(place), "bit": F.bitmap_bit_position(place)}
    bits = shared.withColumns(at).groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substr("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = pairs.withColumns(at).join(F.broadcast(bits), "map")
    return marked.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0).select(pairs.columns)


def drop_frames(frames: DataFrame, machinery: list[str], column: str = "file") -> DataFrame:
    return frames.where(~F.col(column).isin(machinery))


def missing(observed: DataFrame, static: DataFrame) -> DataFrame:
    """Observed (module, dep) that the static closure lacks."""
    return observed.select("module", "dep").distinct().join(static.select("module", "dep"), ["module", "dep"], "left_anti")


def missing_by_package(observed: DataFrame, static: DataFrame, packages: DataFrame) -> DataFrame:
    """(pkg, modules, pairs): how many modules of a local root miss something; packages (module, pkg)."""
    return missing(observed, static).join(packages, "module").groupBy("pkg").agg(F.count_distinct("module").alias("modules"), F.count(F.lit(1)).alias("pairs"))


def distinct_stacks(stacks: DataFrame, column: str = "stack") -> DataFrame:
    """One row for each array of (file, line)."""
    return stacks.dropDuplicates([column])


def unexpected(observed: DataFrame, expected: DataFrame, warned: DataFrame) -> DataFrame:
    """(item, dep) seen by an item's run and neither expected for its file nor warned of: observed (item, file, dep), expected (file, dep), warned (dep)."""
    return observed.join(expected, ["file", "dep"], "left_anti").join(warned.select("dep"), "dep", "left_anti").select("item", "dep").distinct()


def newly_loaded(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.join(before, after.columns, "left_anti").distinct()


def nesting_errors(events: DataFrame) -> DataFrame:
    """(session, context, enters, exits) of contexts that don't balance; events (session, context, kind: enter or exit)."""
    counted = events.groupBy("session", "context").agg(F.count_if(F.col("kind") == "enter").alias("enters"), F.count_if(F.col("kind") == "exit").alias("exits"))
    return counted.where("enters <> exits")

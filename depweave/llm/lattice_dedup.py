"""Embedding near-duplicates by E8 lattice hashing, verified by cosine.

In each of several tables a random projection takes the unit vector to one or more blocks of 8 dimensions; the nearest points of
the E8 lattice together are its cell, and the neighbouring cells nearest to it, which differ in one block, are probed as well.
Vectors that share a cell are candidates. Tables of every size take the same cells (``PLAN``: three blocks, 16 tables, 7 neighbours), so whether
two vectors meet never depends on how many others there are. Of random pairs 0.01 % meet (64 dimensions), a fixed share, so candidates of a
random kind grow with the square of the rows. A caller may name other cells, ``plan_for`` those that compare least. Candidates travel as half-precision unit vectors with their exact rounding error: a pair whose cosine is surely
at least ``COSINE`` is a link, one that the error leaves open is decided on the full vectors, others are none. Cells above ``CELL`` vectors are counted first, aggregated before the shuffle, and dealt
in blocks, any two of which meet in a cell of their own: every pair still meets, and no task holds a large cell.

Equal vectors are one node. Links in a cell are followed by breadth-first search, one edge for each vector reached, so a
large group of near copies is not expanded into pairs. Then each component counts its links exactly, in double
precision, on the full vectors, in blocks of ``BLOCK``: whatever the cells missed inside a component counts too.
Recall at a cosine of exactly 0.9 is measured in the tests (``PLAN`` above 0.985, every other plan above 0.95) and rises with the cosine.

Vectors that are null, zero, empty or hold null or non-finite components, and rows with null ids, link with nothing: n_links 0, their own
id as component. Only vectors of one length link. Rows with one id and vector count as one vector. Vectors are grouped by a 64-bit
hash and compared whole: if two differ, the hash takes another seed. An empty table gives an empty table; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import dataclasses
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.llm.common import lean, materialise
from depweave.llm.components import components
from depweave.llm.exact_topk import by_length, usable

COSINE = 0.9
SEED = 8
BLOCK = 512
CELL = 4096
SMALL = 1024


@dataclasses.dataclass(frozen=True)
class Plan:
    blocks: int  # of 8 dimensions each
    scale: float  # of the projection, in which the shortest lattice vectors have length sqrt(2)
    tables: int
    probes: int


#: The cells of tables of every size.
PLAN = Plan(3, 0.5, 16, 7)
#: Cells that a caller may name instead: up to so many distinct vectors, those that compare least. They find other pairs near the threshold.
PLANS = ((20_000, Plan(1, 0.85, 8, 3)), (10_000_000, Plan(3, 0.5, 12, 7)), (float("inf"), Plan(4, 0.5, 20, 15)))


def plan_for(vectors: int) -> Plan:
    return next(plan for most, plan in PLANS if vectors <= most)


@functools.lru_cache(maxsize=1)
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all of +-1/2 with an even number of minus signs."""
    whole = [[s if x == i else t if x == j else 0 for x in range(8)] for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    half = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*whole, *half])


def _nearest_d8(z: np.ndarray) -> np.ndarray:
    """Nearest whole vectors with an even sum: round, and if the sum is odd, round the worst coordinate the other way."""
    r = np.rint(z)
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    off = z[odd] - r[odd]
    worst = np.abs(off).argmax(axis=1)
    r[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def nearest_e8(z: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 shifted by one half; the nearer of both nearest points."""
    a, b = _nearest_d8(z), _nearest_d8(z - 0.5) + 0.5
    return np.where((((z - a) ** 2).sum(axis=1) <= ((z - b) ** 2).sum(axis=1))[:, None], a, b)


@functools.lru_cache(maxsize=32)
def _projection(d: int, table: int, seed: int, plan: Plan) -> np.ndarray:
    return np.random.default_rng([seed, table, d]).normal(size=(d, 8 * plan.blocks)) * plan.scale


def cells(unit: np.ndarray, plan: Plan, seed: int = SEED) -> np.ndarray:
    """(vectors, tables * (1 + probes)) 64-bit names of the cells of unit vectors."""
    out, n = [], len(unit)
    mix = np.random.default_rng([seed, 99]).integers(1, 1 << 63, (plan.tables, 8 * plan.blocks), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for t in range(plan.tables):
        z = (unit @ _projection(unit.shape[1], t, seed, plan)).reshape(-1, 8)
        home = nearest_e8(z)
        gain = ((z - home) @ shortest().T).reshape(n, -1)
        near = np.argpartition(-gain, plan.probes, axis=1)[:, : plan.probes]
        points = np.repeat(home.reshape(n, 1, plan.blocks, 8), 1 + plan.probes, axis=1)
        block, step = np.divmod(near, len(shortest()))
        points[np.arange(n)[:, None], 1 + np.arange(plan.probes)[None, :], block] += shortest()[step]
        twice = np.rint(2 * points).astype(np.int64).view(np.uint64).reshape(n, 1 + plan.probes, -1)
        name = (twice * mix[t]).sum(axis=2, dtype=np.uint64) + np.uint64(t * 1_000_003 + unit.shape[1])
        name = (name ^ (name >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(name ^ (name >> np.uint64(32)))
    return np.concatenate(out, axis=1)


def units(m: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, of huge and tiny vectors too."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def link_cell(x: np.ndarray, err: np.ndarray, cosine: float = COSINE) -> tuple[list, list]:
    """Sure star edges (i, j) and open pairs (i, j) among half-precision unit vectors."""
    edges, open_ = [], []
    rounding = 1e-6 + 6e-8 * x.shape[1]  # of sums in single precision
    if len(x) <= SMALL:
        sim = x @ x.T
        slack = err[:, None] + err[None, :] + err[:, None] * err[None, :] + rounding
        maybe = np.triu(sim + slack >= cosine, 1)
        if not maybe.any():
            return edges, open_
        sure = np.triu(sim - slack >= cosine, 1)
        open_ += list(zip(*np.nonzero(maybe & ~sure), strict=True))
        sure |= sure.T
        seen = ~sure.any(axis=1)
        while not seen.all():
            head = int(np.argmin(seen))
            reached = front = sure[head] & ~seen
            reached[head] = seen[head] = True
            while front.any():
                seen |= front
                front = sure[front].any(axis=0) & ~seen
                reached |= front
            edges += [(head, int(i)) for i in np.flatnonzero(reached) if i != head]
        return edges, open_
    rest = np.arange(len(x))
    while len(rest) > 1:
        head, rest = rest[0], rest[1:]
        front = np.array([head])
        while len(front) and len(rest):
            hit = np.zeros(len(rest), dtype=bool)
            for a in range(0, len(front), 256):
                f = front[a : a + 256]
                sim = x[f] @ x[rest].T
                slack = err[f][:, None] + err[rest][None, :] + err[f][:, None] * err[rest][None, :] + rounding
                sure = sim - slack >= cosine
                hit |= sure.any(axis=0)
                i, j = np.nonzero((sim + slack >= cosine) & ~sure)
                open_ += zip(f[i], rest[j], strict=True)
            front, rest = rest[hit], rest[~hit]
            edges += [(head, int(i)) for i in front]
    return edges, open_


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of sorted rows, many in a table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        turn = np.flatnonzero(k[1:] != k[:-1]) + 1
        first = 0
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        elif held and len(turn):
            held.append(batch.slice(0, turn[0]))
            yield pa.Table.from_batches(held).combine_chunks()
            held, first = [], int(turn[0])
        last = int(turn[-1]) if len(turn) else first
        if last > first:
            yield pa.Table.from_batches([batch.slice(first, last - first)]).combine_chunks()
        held.append(batch.slice(max(last, first)))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _candidates(nodes: DataFrame, plan: Plan, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                for rows, m in by_length(batch, "x"):
                    unit = units(m)
                    half = unit.astype(np.float16)
                    err = np.sqrt(((unit - half) ** 2).sum(axis=1)) * (1 + 1e-6)
                    cell = cells(unit, plan, seed)
                    times = cell.shape[1]
                    raw = [h.tobytes() for h in half]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cell.ravel().view(np.int64)),
                            pa.array(np.repeat(batch.column("node").to_numpy()[rows], times)),
                            pa.array(np.repeat(err.astype(np.float32), times)),
                            pa.array(raw, pa.binary()).take(pa.array(np.repeat(np.arange(len(rows)), times))),
                        ],
                        ["cell", "node", "err", "half"],
                    )

    return nodes.select("node", "x").mapInArrow(lean(run), "cell long, node long, err float, half binary")


def _cell_names(nodes: DataFrame, plan: Plan, seed: int) -> DataFrame:
    """The cell column of ``_candidates`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                for _, m in by_length(whole.slice(a, 1000), "x"):
                    yield pa.RecordBatch.from_arrays([pa.array(cells(units(m), plan, seed).ravel().view(np.int64))], ["cell"])

    return nodes.select("x").mapInArrow(lean(run), "cell long")


def _deal(found: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """found with its large cells dealt in blocks of about half of ``most``, each two of them as one cell."""
    large = names.groupBy("cell").count().where(F.col("count") > most).select("cell", F.ceil(F.col("count") * 2 / most).cast("int").alias("blocks"))
    large = materialise(large, "large-cells")
    if large.isEmpty():
        return found
    own = F.pmod(F.xxhash64("node", F.lit("cell")), F.col("blocks")).cast("int")
    placed = found.join(large, "cell", "left").withColumn("own", own)
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("own"))
    met = F.transform(others, lambda o: F.xxhash64("cell", F.least("own", o), F.greatest("own", o)))
    return placed.withColumn("cell", F.explode(F.when(F.col("blocks").isNull(), F.array("cell")).otherwise(met))).select(found.columns)


def _links(found: DataFrame, cosine: float) -> DataFrame:
    """(a, b, sure) of candidates in one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "cell"):
            cell, node = table["cell"].to_numpy(), table["node"].to_numpy()
            err = table["err"].to_numpy().astype(np.float32)
            half = table["half"].combine_chunks()
            cuts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
            a, b, sure = [], [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e - s < 2:
                    continue
                raw = half.slice(s, e - s).to_pylist()
                d = len(raw[0])
                if any(len(r) != d for r in raw):
                    raw = [r.ljust(max(map(len, raw)), b"\0") for r in raw]
                x = np.frombuffer(b"".join(raw), np.float16).reshape(e - s, -1).astype(np.float32)
                for pairs, certain in zip(link_cell(x, err[s:e], cosine), (True, False), strict=True):
                    a += [node[s + i] for i, _ in pairs]
                    b += [node[s + j] for _, j in pairs]
                    sure += [certain] * len(pairs)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure)], ["a", "b", "sure"])

    return found.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(lean(run), "a long, b long, sure boolean")


def _exact(pairs: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """The open pairs that the full vectors make links."""
    x = pairs.join(nodes.select(F.col("node").alias("a"), F.col("x").alias("xa")), "a").join(nodes.select(F.col("node").alias("b"), F.col("x").alias("xb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [len(p) == len(q) and float(units(p[None])[0] @ units(q[None])[0]) >= cosine for p, q in zip(*(map(np.asarray, batch.column(c).to_pylist()) for c in ("xa", "xb")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return x.select("a", "b", F.col("xa").cast("array<double>").alias("xa"), F.col("xb").cast("array<double>").alias("xb")).mapInArrow(lean(run), "a long, b long")


def _count(members: DataFrame, cosine: float, block: int) -> DataFrame:
    """(node, links): rows linked with each node inside its component, by blocks against blocks. members: comp, node, n, x."""
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    placed = members.join(sizes, "comp").withColumn("__blocks", F.ceil(F.col("size") / block).cast("int"))
    placed = placed.withColumn("__own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("__blocks")).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    left = placed.select(F.xxhash64("comp", "__own", "__other").alias("task"), F.lit(True).alias("left"), "comp", "node", "n", "x")
    right = placed.select(F.xxhash64("comp", "__other", "__own").alias("task"), F.lit(False).alias("left"), "comp", "node", "n", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "task"):
            task = table["task"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]])
            whole = pa.RecordBatch.from_arrays([table[c].combine_chunks() for c in table.column_names], table.column_names)
            nodes, links = [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                part = whole.slice(s, e - s)
                unit = units(matrix_of(part))
                side, node, n, comp = part.column("left").to_numpy(zero_copy_only=False), part.column("node").to_numpy(), part.column("n").to_numpy(), part.column("comp").to_numpy()
                rows, cols = np.flatnonzero(side), np.flatnonzero(~side)
                near = unit[rows] @ unit[cols].T >= cosine
                near &= (node[rows][:, None] != node[cols][None, :]) & (comp[rows][:, None] == comp[cols][None, :])
                nodes.append(node[rows])
                links.append(near @ n[cols])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(links).astype(np.int64))], ["node", "links"])

    counted = left.unionByName(right).repartition("task").sortWithinPartitions("task").mapInArrow(lean(run), "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def matrix_of(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distinct_vectors(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, node, x), the last two null for vectors that take no part, and nodes (node, x, least, n): n ids have equal vectors, the least of them stands for them."""
    takes_part = F.col(key).isNotNull() & usable(vector) & F.exists(vector, lambda v: v != 0)
    seed = 0
    while True:
        node = F.xxhash64(F.size(vector), F.col(vector), *([F.lit(seed)] if seed else []))
        rows = vectors.select(F.col(key).alias("id"), F.when(takes_part, node).alias("node"), F.when(takes_part, F.col(vector)).alias("x"))
        grouped = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("x").alias("x"), (F.min("x") == F.max("x")).alias("equal"), F.min("id").alias("least"), F.count_distinct("id").alias("n"))
        nodes = materialise(grouped, "vectors")
        if nodes.where("NOT equal").isEmpty():
            return rows, nodes.drop("equal")
        seed += 1


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, plan: Plan = PLAN, seed: int = SEED, block: int = BLOCK, most: int = CELL) -> DataFrame:
    """(key, n_links, component_id, kept), one row a vector. plan: what cells to use, whatever the number of vectors."""
    rows, nodes = distinct_vectors(vectors, key, vector)
    dealt = _deal(_candidates(nodes, plan, seed), _cell_names(nodes, plan, seed), most)
    found = materialise(_links(dealt, cosine), "vector-links")
    edges = found.where("sure").select("a", "b").unionByName(_exact(found.where("NOT sure").select("a", "b").distinct(), nodes, cosine))
    comp = materialise(components(edges).withColumnRenamed("component", "comp"), "vector-components")
    members = nodes.join(comp, "node")
    least = members.groupBy("comp").agg(F.min("least").alias("__least"))
    linked = comp.join(least, "comp").join(_count(members.select("comp", "node", "n", "x"), cosine, block), "node").select("node", "__least", "links")
    told = nodes.select("node", "least", "n").join(linked, "node", "left").select("node", F.coalesce("__least", "least").alias("component_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("id", "node").join(told, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: links and components of all vectors."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {COSINE}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(l.c, e.vec_id) AS component_id, coalesce(l.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""

import numpy as np
import pytest
from pyspark.sql import functions as F

from depweave.llm import exact_topk as K
from depweave.llm import lattice_dedup as L
from tests.compare import held

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(None if i is None else int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids, vectors)], SCHEMA)


@pytest.mark.parametrize("dims,scale,chunk", [(40, 1, K.CHUNK), (3, 0.02, 3 * 8 * 3), (16, 1e5, 7 * 8 * 16)])
def test_topk_against_all_scores(spark, dims, scale, chunk):
    rng = np.random.default_rng(dims)
    v = np.round(rng.normal(size=(150, dims)) * scale, 2).astype(np.float32)
    v[7] = v[3]
    got = {}
    for r in K.top_k(table(spark, v).repartition(3), F.col("id") % 10 == 0, chunk=chunk).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    whole = [[int(np.floor(256 * float(x))) for x in row] for row in v]
    assert set(got) == set(range(0, 150, 10))
    for q in got:
        scores = sorted(((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in enumerate(whole) if i != q))[:5]
        assert [got[q][r] for r in range(1, 6)] == [(-s, i) for s, i in scores]


def test_topk_odd_rows(spark):
    rows = [[1, 2], [1, 2], None, [1, None], [float("nan"), 1], [float("inf"), 0], [], [3, 1, 1], [2, 2]]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in K.top_k(table(spark, rows), F.col("id") % 2 == 0).collect())
    at = lambda a, b: 65536 * sum(x * y for x, y in zip(a, b))
    assert got == [(0, 1, 8, at([1, 2], [2, 2])), (0, 2, 1, at([1, 2], [1, 2])), (8, 1, 0, at([1, 2], [2, 2])), (8, 2, 1, at([1, 2], [2, 2]))]
    assert K.top_k(table(spark, []), F.col("id") % 2 == 0).count() == 0
    twice = K.top_k(table(spark, [[1, 0], [1, 0], [5, 5]], [0, 1, 1]), F.col("id") == 0).collect()
    assert [(r.vec_id, r.score) for r in twice] == [(1, 65536)]


def test_topk_query_keeps_rows_of_repeated_ids(spark, tmp_path):
    rows, ids = [[1, 0], [1, 0], [5, 5], [0, 3], [2, 1], [2, 1], [9, 9], [4, 4]], [0, 1, 1, 0, 2, 2, 0, 50]
    table(spark, rows, ids).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert held(spark, str(tmp_path), K.query, K.SQL) == 10
    small = K.top_k(table(spark, rows, ids), F.col("id") % 50 == 0, chunk=16, repeats=True).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, K.query(spark, str(tmp_path)).collect()))


def test_one_chunk_of_queries_is_held_at_a_time(spark, monkeypatch):
    from pyspark import Broadcast, SparkContext

    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4)).astype(np.float32)
    df = table(spark, v).withColumns({c: F.lit("clash") for c in ("id", "x", "chunk", "rank", "score", "query_id")})
    held, most = [], []
    broadcast, destroy = SparkContext.broadcast, Broadcast.destroy
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, x: (held.append(len(x)), most.append(len(held)), broadcast(self, x))[2])
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (held.pop(), destroy(self, *a))[1])
    got = K.top_k(df, F.col("id") < 40, chunk=4 * 8 * 4)
    assert len(most) == 10 and max(most) == 1 and not held
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, K.top_k(table(spark, v), F.col("id") < 40).collect()))


def test_e8_points_are_nearest():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(500, 8)) * 2
    p = L.nearest_e8(z)
    twice = np.rint(2 * p).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all(axis=1)).all() and (p.sum(axis=1) % 2 == 0).all()
    d = ((z - p) ** 2).sum(axis=1)
    assert (d <= 1 + 1e-9).all() and (d <= ((z[:, None] - p[:, None] - L.shortest()) ** 2).sum(axis=2).min(axis=1) + 1e-9).all()
    assert len(L.shortest()) == 240 and np.allclose((L.shortest() ** 2).sum(axis=1), 2)


@pytest.mark.parametrize("plan", [plan for _, plan in L.PLANS])
def test_recall_at_the_threshold(plan):
    rng = np.random.default_rng(1)
    for d in (16, 64, 256):
        x = L.units(rng.normal(size=(2000, d)))
        g = rng.normal(size=x.shape)
        y = 0.9 * x + np.sqrt(1 - 0.81) * L.units(g - (g * x).sum(axis=1, keepdims=True) * x)
        a, b = L.cells(x, plan), L.cells(y, plan)
        met = np.array([bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist())])
        assert met.mean() > 0.95, (d, met.mean())


def test_few_random_pairs_are_candidates():
    """At 100,000 vectors below 0.01 % of pairs; counted on a part, as the share doesn't depend on the number."""
    x = L.units(np.random.default_rng(2).normal(size=(8000, 64)))
    _, n = np.unique(L.cells(x, L.plan_for(100_000)), return_counts=True)
    assert (n * (n - 1.0)).sum() / (len(x) * (len(x) - 1.0)) < 1e-4


def at_threshold(n, d, cosine, seed):
    """Pairs of unit vectors of that cosine."""
    rng = np.random.default_rng(seed)
    x = L.units(rng.normal(size=(n, d)))
    g = rng.normal(size=x.shape)
    return x, cosine * x + np.sqrt(1 - cosine**2) * L.units(g - (g * x).sum(axis=1, keepdims=True) * x)


def meet(x, y, plan):
    return np.array([bool(set(p) & set(q)) for p, q in zip(L.cells(x, plan).tolist(), L.cells(y, plan).tolist())])


@pytest.mark.parametrize("d", [8, 16, 64, 256])
def test_cells_of_every_size_find_as_many_as_those_of_small_tables(d):
    x, y = at_threshold(3000, d, 0.9, d)
    found = meet(x, y, L.PLAN).mean()
    assert found > 0.985 and found > meet(x, y, L.PLANS[0][1]).mean() - 0.003


def test_links_do_not_depend_on_the_number_of_vectors(spark, monkeypatch):
    """Pairs that the cells of small tables and those of larger ones find differently: more rows, unlike any of them, change nothing."""
    (_, small), (_, large) = L.PLANS[:2]
    monkeypatch.setattr(L, "PLANS", ((150, small), (float("inf"), large)))
    x, y = at_threshold(2000, 64, 0.9005, 9)
    apart = np.flatnonzero(meet(x, y, small) != meet(x, y, large))[:40]
    pairs = np.stack([x[apart], y[apart]], axis=1).reshape(-1, 64)
    more = L.units(np.random.default_rng(10).normal(size=(150, 64)))
    few, many = ({r.vec_id: tuple(r) for r in L.near_duplicates(table(spark, v)).collect()} for v in (pairs, np.concatenate([pairs, more])))
    assert len(apart) == 40 and {i: many[i] for i in few} == few
    assert sum(few[i][1] for i in few) > 0 and all(many[i][1] == 0 for i in many if i not in few)


def brute(v, ok):
    n = len(v)
    u = np.array([x / np.linalg.norm(x) if o else np.zeros(len(v[0])) for x, o in zip(v.astype(float), ok)])
    link = (u @ u.T >= 0.9) & ~np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        new = np.array([min([label[i], *label[link[i]]]) for i in range(n)])
        if (new == label).all():
            return link.sum(axis=1), label
        label = new


@pytest.mark.parametrize("small", [1000, 5])
def test_cell_gives_the_components_of_its_links(small, monkeypatch):
    """Both ways through a cell; rounding leaves no pair open that both ends are exact for."""
    monkeypatch.setattr(L, "SMALL", small)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 24))
    x = L.units(np.concatenate([base, base[rng.integers(0, 6, 50)] + rng.normal(size=(50, 24)) * 0.25])).astype(np.float32)
    edges, open_ = L.link_cell(x, np.zeros(len(x), np.float32))
    label = np.arange(len(x))
    for _ in range(len(x)):
        for i, j in edges:
            label[i] = label[j] = min(label[i], label[j])
    assert not open_ and label.tolist() == brute(x, np.ones(len(x), bool))[1].tolist()
    assert len(edges) == len(x) - len(set(label.tolist()))


@pytest.mark.parametrize("block,most", [(L.BLOCK, L.CELL), (7, 6)])
def test_links_and_components(spark, block, most):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(25, 24))
    v = np.concatenate([base] + [base[rng.integers(0, 4, 40)] + rng.normal(size=(40, 24)) * 0.12 for _ in range(2)] + [base[:3] * 2.5, base[:2], base[:2]]).astype(np.float32)
    links, label = brute(v, np.ones(len(v), bool))
    got = {r.vec_id: r for r in L.near_duplicates(table(spark, v).repartition(3), block=block, most=most).collect()}
    assert [got[i].component_id for i in range(len(v))] == label.tolist()
    assert [got[i].n_links for i in range(len(v))] == links.tolist()
    assert [got[i].kept for i in range(len(v))] == (label == np.arange(len(v))).tolist()


@pytest.mark.parametrize("plan", [plan for _, plan in L.PLANS[1:]])
def test_components_with_more_blocks(spark, plan):
    """Near copies well above the threshold, which every plan finds."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 32))
    v = np.concatenate([base, base[rng.integers(0, 12, 60)] + rng.normal(size=(60, 32)) * 0.08]).astype(np.float32)
    links, label = brute(v, np.ones(len(v), bool))
    got = {r.vec_id: r for r in L.near_duplicates(table(spark, v), plan=plan).collect()}
    assert [got[i].component_id for i in range(len(v))] == label.tolist() and [got[i].n_links for i in range(len(v))] == links.tolist()


def test_equal_hashes_of_different_vectors(spark, monkeypatch):
    """If vectors of one hash differ, another seed is taken."""
    real, used = F.xxhash64, []

    def poor(*columns):
        used.append(len(columns))
        return F.lit(7).cast("long") if len(columns) == 2 else real(*columns)

    monkeypatch.setattr(L.F, "xxhash64", poor)
    rows, nodes = L.distinct_vectors(table(spark, [[1, 0], [0, 1], [1, 0]]), "vec_id", "embedding")
    monkeypatch.undo()
    assert used == [2, 3] and sorted((r.least, r.n) for r in nodes.collect()) == [(0, 2), (1, 1)] and rows.count() == 3


def test_names_that_clash(spark):
    odd = {n: F.lit("clash") for n in ("node", "x", "cell", "id", "comp", "n_links", "component_id")}
    got = L.near_duplicates(table(spark, [[1, 2], [2, 4], [2, -1]]).withColumns(odd)).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True)]


def test_odd_vectors(spark):
    rows = [[1, 2], [2, 4], None, [0, 0], [1, None], [float("nan"), 1], [], [1, 2, 0], [1, 2], [1, 2]]
    ids = [5, 6, 1, 2, 3, 4, 7, 8, None, 5]
    out = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in L.near_duplicates(table(spark, rows, ids)).collect()), key=str)
    assert out == sorted([(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (0, 0, None, True)] + [(i, 0, i, True) for i in (1, 2, 3, 4, 7, 8)], key=str)
    assert L.near_duplicates(table(spark, [])).count() == 0

import math

from pyspark.sql import functions as F

from depweave.llm import source_mixing as M
from tests.compare import held
from tests.llm.test_corpus_pipeline import slow_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, n=300):
    rows = [(i, f"t{i}", None if i % 5 else "en", [None, "a", "a", "a", "b"][i % 5] if i else "rare", i) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_copies_against_inversion(spark):
    d = docs(spark)
    want = {k: n for k, n in slow_copies([(r.doc_id, r.source) for r in d.collect()]).items() if n}
    out = M.replicate(d).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r.copy)
    assert {k: len(v) for k, v in got.items()} == want and all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())
    assert len({r.mix_key for r in out}) == len(out)


def test_weights_means_and_large_rates(spark):
    d = docs(spark, 2000)
    found = {r["source"]: (r["n"], r["rate"]) for r in M.rates(d, {"a": 3, "b": 1, None: 0}, epochs=2.0).collect()}
    assert found[None][1] == 0 and found["rare"][1] == 0 and math.isclose(found["a"][1] * found["a"][0], 3000) and math.isclose(found["b"][1] * found["b"][0], 1000)
    n = {r["source"]: r["count"] for r in M.replicate(d, {"a": 3, "b": 1}, epochs=40.0).groupBy("source").count().collect()}
    assert set(n) == {"a", "b"} and abs(n["a"] / 60_000 - 1) < 0.03 and abs(n["b"] / 20_000 - 1) < 0.05


def test_seeds_and_partitions(spark):
    d = docs(spark)
    key = lambda df: sorted((r.doc_id, r.copy, r.mix_key) for r in df.collect())
    assert key(M.replicate(d)) == key(M.replicate(d.repartition(7))) != key(M.replicate(d, seed=1))
    parts = M.replicate(d).select(F.spark_partition_id().alias("p"), "mix_key").collect()
    assert all(a.mix_key <= b.mix_key for a, b in zip(parts, parts[1:]) if a.p == b.p)


def test_many_sources_take_the_salted_join(spark, monkeypatch):
    whole = sorted((r.doc_id, r.copy) for r in M.replicate(docs(spark)).collect())
    monkeypatch.setattr(M, "MANY_SOURCES", 1)
    assert sorted((r.doc_id, r.copy) for r in M.replicate(docs(spark)).collect()) == whole


def test_odd_rows(spark):
    rows = [(None, "x", None, "a", 1)] * 3 + [(7, None, None, None, None)] * 2
    out = M.replicate(spark.createDataFrame(rows, SCHEMA).withColumn("copy", F.lit("clash")), epochs=5.0)
    n = {(r.doc_id, r["count"]) for r in out.groupBy("doc_id").count().collect()}
    assert all(c % 3 == 0 if d is None else c % 2 == 0 for d, c in n)
    assert M.replicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql(spark):
    assert held(spark, "/root/testdata/sf0.001", M.query, M.SQL) > 100


def test_columns_with_clashing_names(spark):
    names = ["__source", "__key", "__rate", "__n", "c0", "Copy", "a.b"]
    docs = spark.createDataFrame([(i, "t", "s", *names) for i in range(30)], ["doc_id", "text", "source", *names])
    kept = [n for n in names if n != "Copy"]
    out = M.replicate(docs, epochs=3.0)
    assert out.columns == ["doc_id", "text", "source", *kept, "copy", "mix_key"] and out.count() > 40
    assert all(r["__source"] == "__source" and r["__n"] == "__n" for r in out.collect())

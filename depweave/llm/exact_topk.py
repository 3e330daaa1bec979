"""Exact top-k search by columnar branch and bound.

Components become floor(256 * x); the score is the integer inner product. Candidates lie in vertical layout, a row for each
dimension. A query's scores are accumulated one block of dimensions at a time, the widest-spread dimensions first;
after each block candidates stay only if the sum so far and the most the remaining mass can add, |q_rest| * |x_rest| by
Cauchy-Schwarz, reach the query's k-th best score, and the survivors are compacted. Ties stay in, so results are exact.

Queries go over the candidates in chunks of about ``CHUNK`` bytes, one scan each: a chunk is collected, broadcast, its k best written to
the shared folder and the broadcast destroyed before the next is collected, so the driver holds one chunk however many queries there
are. A task keeps k rows a query of its chunk.

Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids; only vectors of one length
meet. Ids should be unique; of several vectors with one id the least in array order counts, or with ``repeats``, as in the query,
every one: each is a candidate of its own, and the pairs of all vectors of a query's id are ranked together. Fewer candidates than k give
fewer rows. An empty table gives an empty table; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.llm.common import lean, materialise, scratch_path

K = 5
SCALE = 256
BLOCK = 16
#: Bytes of a chunk's queries as doubles.
CHUNK = 32 << 20
EVERY = 50
RESULT = "query_id long, vec_id long, score long"


def usable(vector: str) -> Column:
    """No null, no non-finite component, not empty."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return x.isNotNull() & (F.size(x) > 0) & F.coalesce(fine, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as rows of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def by_length(batch: pa.RecordBatch, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and doubles of the batch's vectors, one length at a time."""
    column = batch.column(vector)
    size = np.diff(column.offsets.to_numpy())
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, matrix(column.take(pa.array(rows)))


class Best:
    """The k best (score, id) of each query so far: highest scores, then smallest ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = [np.zeros(0, np.int64)] * n
        self.ids = [np.zeros(0, np.int64)] * n

    def floor(self, q: int) -> float:
        return float(self.score[q][-1]) if len(self.score[q]) == self.k else -np.inf

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[q], score]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score[q], self.ids[q] = score[order], ids[order]


def search(queries: np.ndarray, query_ids: np.ndarray, vertical: np.ndarray, ids: np.ndarray, best: Best, numbers: np.ndarray) -> None:
    """Adds a block of candidates to best. queries: (q, d); vertical: (d, n), whole numbers; numbers: the queries' places in best."""
    d, n = vertical.shape
    kind = np.float64 if max(np.abs(queries).max(initial=0), 1) * max(np.abs(vertical).max(initial=0), 1) * d < 2**52 else object
    order = np.argsort(-vertical.var(axis=1), kind="stable")
    x, qs = vertical[order], queries[:, order]
    cuts = [*range(0, d, BLOCK), d]
    rest = [np.sqrt((x[c:] ** 2).sum(axis=0)) for c in cuts[1:]]
    if kind is object:
        x, qs = (np.vectorize(int, otypes=[object])(m) for m in (x, qs))
    head = qs[:, : cuts[1]] @ x[: cuts[1]]  # the first block, for all queries at once
    left = [np.sqrt((qs[:, c:].astype(np.float64) ** 2).sum(axis=1)) for c in cuts[1:]]
    for j, q in enumerate(numbers):
        live, total = np.arange(n), head[j]
        floor = best.floor(q)
        if floor == -np.inf and n > 8 * best.k:
            # Any k whole scores give a bound to begin with.
            some = np.argpartition(-head[j].astype(np.float64), best.k)[: best.k + 1]
            some = some[ids[some] != query_ids[j]][: best.k]
            if len(some) == best.k:
                floor = float(min(qs[j] @ x[:, some]))
        for b in range(len(cuts) - 1):
            if b:
                total = total + qs[j, cuts[b] : cuts[b + 1]] @ x[cuts[b] : cuts[b + 1], live]
            if floor > -np.inf:
                most = rest[b][live] * left[b][j]
                stay = total.astype(np.float64) + most * (1 + 1e-9) + 1e-3 >= floor * (1 - 1e-12 if floor > 0 else 1 + 1e-12)
                if not stay.all():
                    live, total = live[stay], total[stay]
            if not len(live):
                break
        own = ids[live] != query_ids[j]
        if own.any():
            best.add(q, total[own].astype(np.int64), ids[live][own])


def _plain(vectors: DataFrame, key: str, vector: str, repeats: bool = False) -> DataFrame:
    """Usable rows (id, x), one for each id; with repeats all, and where ids repeat with a number in ``n``."""
    rows = vectors.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x"))
    n, ids = rows.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    if n == ids:
        return rows
    if repeats:
        return materialise(rows.withColumn("n", F.monotonically_increasing_id()), "vectors")
    return rows.groupBy("id").agg(F.min("x").alias("x"))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", chunk: int = CHUNK, repeats: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on column ``id``."""
    spark = vectors.sparkSession
    rows = _plain(vectors, key, vector, repeats)
    queries = rows.where(is_query)
    n, longest = queries.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    chunks = max(1, -(-n * 8 * (longest or 1) // chunk))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if chunks > 1:
        path = scratch_path(spark, "queries")
        place = F.pmod(F.xxhash64(*(c for c in rows.columns if c != "x")), F.lit(chunks)).alias("chunk")
        queries.select("id", "x", place).repartition("chunk").write.partitionBy("chunk").parquet(path)
        queries = spark.read.schema(T.StructType([queries.schema["id"], queries.schema["x"], T.StructField("chunk", T.LongType())])).parquet(path)

    def searched(got: pa.Table) -> tuple[DataFrame, Broadcast]:
        shared = spark.sparkContext.broadcast([(got["id"].to_numpy()[r], np.floor(SCALE * m), r) for b in got.combine_chunks().to_batches() for r, m in by_length(b, "x")])
        total = got.num_rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, names = Best(total, k), np.zeros(total, np.int64)
            groups = {m.shape[1]: (ids, m, r) for ids, m, r in shared.value}
            for ids, _, r in shared.value:
                names[r] = ids
            for batch in batches:
                for at, m in by_length(batch, "x"):
                    if m.shape[1] in groups:
                        ids, q, numbers = groups[m.shape[1]]
                        search(q, ids, np.ascontiguousarray(np.floor(SCALE * m).T), batch.column("id").to_numpy()[at], best, numbers)
            sizes = np.array([len(s) for s in best.score], dtype=np.int64)
            if sizes.sum():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, sizes)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.score))], ["query_id", "vec_id", "score"])

        return rows.mapInArrow(lean(run), RESULT), shared

    if chunks == 1:
        every = searched(queries.select("id", "x").toArrow())[0]
    else:
        every = spark.createDataFrame([], RESULT)
        for c in range(chunks):
            found, shared = searched(queries.where(F.col("chunk") == c).select("id", "x").toArrow())
            every = every.unionByName(materialise(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "best"))
            shared.destroy()
    # Vectors of one id may be in several chunks.
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the five best of every row for each 50th id."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.pmod("id", F.lit(EVERY)) == 0, repeats=True)


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""

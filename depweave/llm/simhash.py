"""SimHash near-duplicates by deletion-variant signatures.

Fingerprint: A-Z lower-cased, words of ``[^\\x20\\x09-\\x0D]+``, four-word shingles with repeats joined by spaces
(fewer words: the whole sequence; none or null text: fingerprint zero, linked like any other), XXH64 with seed 42;
bit i is set if it is set in over half the hashes.

Links at up to 4 differing bits. The 64 bits are cut into three segments of 23, 23 and 18, where plain equality
would need five: either of the first two differs by at most one bit, or the third not at all, or there are 2+2+1 = 5
differences. A segment that differs by at most one bit shares one of its one-wildcard variants, so a fingerprint is
indexed under 23 + 23 + 1 keys, met by equality, and every meeting is verified on all 64 bits.

Equal fingerprints are one node. A bucket is linked by breadth-first search over the fingerprints not yet reached and
gives one edge for each of them but the first, so a large group of near copies costs little more than reading it
and is never expanded into pairs. Buckets above ``BUCKET`` fingerprints are dealt out again by fifths of the
remaining bits, one of which a pair must share; that loses nothing.

Null ids take part but never name a component unless it has no other id; repeated rows share one fingerprint; an empty
table gives an empty table; other columns are not looked at. Very long texts are hashed whole, ``CHUNK`` shingles at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.llm.common import lean, materialise, small_batches, text_bytes
from depweave.llm.components import components

WORDS = 4
SEED = 42
BITS = 4
BUCKET = 50_000
SEGMENTS = ((0, 23, True), (23, 23, True), (46, 18, False))
CHUNK = 1 << 16


def fingerprint_of(text: bytes) -> int:
    """The fingerprint as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    total, ones = 0, np.zeros(64, dtype=np.int64)
    for a in range(0, max(1, len(words) - WORDS + 1), CHUNK):
        part = words[a : a + CHUNK + WORDS - 1]
        shingles = list(map(b" ".join, zip(*(part[i:] for i in range(WORDS))))) if len(part) >= WORDS else [b" ".join(part)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(shingles))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        total += len(shingles)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint_of(x.as_py()) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], [key, "fp"])

    return docs.select(F.col(key), text_bytes(text).alias("__bytes")).mapInArrow(lean(run), schema)


def variants() -> list:
    """The index keys of column fp: variant number above 32 bits, segment below it."""
    keys = []
    for start, width, wild in SEGMENTS:
        segment = F.shiftrightunsigned("fp", start).bitwiseAND((1 << width) - 1)
        for i in range(width) if wild else [None]:
            value = segment.bitwiseAND(~(1 << i)) if i is not None else segment
            keys.append(value.bitwiseOR(F.lit(len(keys) << 32)))
    return keys


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def link_bucket(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (first, other) of the groups that links of up to ``bits`` bits form among distinct fingerprints."""
    heads, others = [], []
    rest = fps
    while len(rest) > 1:
        head, rest = rest[0], rest[1:]
        front = np.array([head], dtype=fps.dtype)
        while len(front) and len(rest):
            reached = np.zeros(len(rest), dtype=bool)
            for x in front:
                open_ = np.flatnonzero(~reached)
                if not len(open_):
                    break
                reached[open_[_popcount(rest[open_] ^ x) <= bits]] = True
            front, rest = rest[reached], rest[~reached]
            heads.append(np.full(len(front), head))
            others.append(front)
    if not heads:
        return fps[:0], fps[:0]
    return np.concatenate(heads), np.concatenate(others)


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Whole key groups of sorted rows, many at a time, as (key, fp, large); a group above ``most`` comes in parts."""
    key = fp = np.zeros(0, np.int64)
    large = None  # the key that is being passed on in parts
    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy()])
        fp = np.concatenate([fp, batch.column("fp").to_numpy()])
        if large is not None:
            n = int(np.searchsorted(key != large, True)) if key[-1] != large else len(key)
            yield key[:n], fp[:n], True
            key, fp = key[n:], fp[n:]
            if not len(key):
                continue
            large = None
        last = int(np.flatnonzero(key[:-1] != key[1:])[-1]) + 1 if (key[:-1] != key[1:]).any() else 0
        if last:
            yield key[:last], fp[:last], False
            key, fp = key[last:], fp[last:]
        if len(key) > most:
            yield key, fp, True
            large, key, fp = key[0], key[:0], fp[:0]
    if len(key):
        yield key, fp, False


def _edges_of(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[list, list, list, list]:
    """Star edges of whole groups; groups above ``most`` come back as rows to refine."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    a, b, rk, rf = [], [], [], []
    small = sizes <= 6
    for d in range(1, 6):  # pairs at distance d inside small groups, all groups at once
        size = np.repeat(np.where(small, sizes, 0), sizes)
        place = np.arange(len(key)) - np.repeat(starts, sizes)
        i = np.flatnonzero(place + d < size)
        i = i[_popcount((fp[i] ^ fp[i + d]).view(np.uint64)) <= BITS] if len(i) else i
        a.append(fp[i])
        b.append(fp[i + d])
    for s, n in zip(starts[~small], sizes[~small], strict=True):
        if n > most:
            rk.append(key[s : s + n])
            rf.append(fp[s : s + n])
            continue
        x, y = link_bucket(fp[s : s + n].view(np.uint64))
        a.append(x.view(np.int64))
        b.append(y.view(np.int64))
    return a, b, rk, rf


def _link(keyed: DataFrame, most: int) -> DataFrame:
    """(a, b, key): edges with null key; rows of buckets that are too large, with a = b = the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(a, b, k):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(k, pa.int64())], ["a", "b", "key"])

        for key, fp, large in _groups((x for x in batches if x.num_rows), most):
            if large:
                yield give(fp, fp, key)
                continue
            a, b, rk, rf = _edges_of(key, fp, most)
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield give(pairs[0], pairs[1], [None] * pairs.shape[1])
            for k, f in zip(rk, rf, strict=True):
                yield give(f, f, k)

    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lean(run), "a long, b long, key long")


def edges(distinct: DataFrame, most: int = BUCKET) -> DataFrame:
    """Verified star edges (a, b) whose components are those of all links; distinct: one column fp, no repeats."""
    keyed = distinct.select("fp", F.explode(F.array(*variants())).alias("key"))
    found = materialise(_link(keyed, most), "simhash-links")
    out = found.where("key IS NULL").select("a", "b")
    over = found.where("key IS NOT NULL")
    if not over.isEmpty():
        # Bits outside the bucket's segment, in fifths: links within a bucket share one.
        variant = F.shiftright("key", 32)
        of = F.when(variant < 23, 0).when(variant < 46, 1).otherwise(2)
        rows = []
        for s, (start, width, _) in enumerate(SEGMENTS):
            free = [i for i in range(64) if not start <= i < start + width]
            for j in range(BITS + 1):
                mask = sum(1 << i for i in free[j :: BITS + 1])
                mask -= (mask >> 63) << 64
                rows.append((s, F.xxhash64(F.col("key"), F.lit(j), F.col("a").bitwiseAND(F.lit(mask)))))
        sub = F.explode(F.array_compact(F.array(*(F.when(of == s, k) for s, k in rows))))
        refined = over.select(F.col("a").alias("fp"), sub.alias("key"))
        out = out.unionByName(_link(refined, 1 << 62).select("a", "b"))
    return out


def cluster(prints: DataFrame, key: str = "doc_id", most: int = BUCKET) -> DataFrame:
    """prints (key, fp) with component_id, the least key that links reach."""
    nodes = prints.groupBy("fp").agg(F.min(key).alias("__least"))
    label = components(edges(nodes.select("fp"), most)).withColumnsRenamed({"node": "fp", "component": "__of"})
    labelled = nodes.join(label, "fp", "left").withColumn("__of", F.coalesce("__of", "fp"))
    least = labelled.groupBy("__of").agg(F.min("__least").alias("component_id"))
    return prints.join(labelled.join(least, "__of").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = BUCKET) -> DataFrame:
    """(key, fingerprint, component_id), one row a document."""
    prints = materialise(fingerprints(docs, key, text), "fingerprints")
    return cluster(prints, key, most).select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the least key of their component, once each; rows without a key stay."""
    found = materialise(near_duplicates(docs, key, text), "near-duplicates")
    firsts = found.where(F.col(key) == F.col("component_id")).select(key).distinct()
    kept = docs.join(firsts, key, "left_semi").select(docs.columns)
    counts = found.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    if counts[0] != counts[1]:
        kept = kept.dropDuplicates([key])
    return kept.unionByName(docs.where(F.col(key).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: fingerprint and component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

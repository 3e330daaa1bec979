import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from depweave.llm import simhash as S


def slow_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps):
    ids = list(range(len(fps)))

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = sorted((root(i), root(j)))
                ids[b] = a
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", None, "One two", "a b c d", "A  b\tc\x0bd e É\xa0x y", "to be or not to be or not to be", "x " * 70_000])
def test_fingerprint(text):
    if text and len(text) > 1000:
        assert S.fingerprint_of(text.encode()) == S.fingerprint_of(b"x x x x")
    else:
        assert S.fingerprint_of((text or "").encode()) == slow_print(text)


def prints(spark, fps):
    return spark.createDataFrame([(i, f - (f >> 63 << 64)) for i, f in enumerate(fps)], "doc_id long, fp long")


@pytest.mark.parametrize("most", [S.BUCKET, 5])
def test_components_against_all_pairs(spark, most):
    rng = random.Random(5)
    fps = [0, 0, (1 << 64) - 1]
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            f = base
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5])):
                f ^= 1 << b
            fps.append(f)
            base = rng.choice([base, f])
    got = {r.doc_id: r.component_id for r in S.cluster(prints(spark, fps), most=most).collect()}
    assert [got[i] for i in range(len(fps))] == slow_components(fps)


def test_every_pair_within_four_bits_shares_a_key(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    flips = [rng.sample(range(64), rng.randint(1, 4)) for _ in range(300)]
    fps = [base] + [base ^ sum(1 << b for b in f) for f in flips]
    keys = [set(r.k) for r in prints(spark, fps).select("doc_id", F.array(*S.variants()).alias("k")).orderBy("doc_id").collect()]
    assert all(keys[0] & k for k in keys[1:])


def test_bucket_links_are_whole():
    rng = np.random.default_rng(0)
    fps = np.unique(rng.integers(0, 1 << 14, 300).astype(np.uint64))
    a, b = S.link_bucket(fps)
    want = slow_components([int(x) for x in fps])
    names = {int(x): int(x) for x in fps}
    for x, y in zip(a, b):
        names[int(y)] = names[int(x)]
    assert [names[int(x)] for x in fps] == [int(fps[w]) for w in want]


def test_documents(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    long = [rng.choice(words) for _ in range(600)]
    near = long.copy()
    near[300] = "changed"
    other = [rng.choice(words) for _ in range(600)]
    rows = [(3, " ".join(long)), (5, " ".join(near)), (9, " ".join(long)), (4, " ".join(other)), (7, None), (6, ""), (2, "short one"), (None, "short one"), (9, " ".join(long))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect())
    assert {(a, c) for _, a, c in got} == {(3, 3), (5, 3), (9, 3), (4, 4), (7, 6), (6, 6), (2, 2), (None, 2)} and len(got) == 9
    assert sorted(r.doc_id or 0 for r in S.keep_first(docs).collect()) == [0, 2, 3, 4, 6]


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0

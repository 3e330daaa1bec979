import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from depweave.llm import substring_dedup as D
from depweave.llm.fm_index import FMIndex, WaveletTree
from tests.compare import held


def slow(docs):
    """docs: texts in order. Kept words of each."""
    seen, kept = set(), []
    for text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - D.WINDOW + 1):
            w = tuple(words[i : i + D.WINDOW])
            if w in seen:
                gone[i : i + D.WINDOW] = [True] * D.WINDOW
            seen.add(w)
        kept.append((len(words), sum(gone), [w for w, g in zip(words, gone) if not g]))
    return kept


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "\xa0x", "a b"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([19, 20, 25, 60]))] for _ in range(6)]
    docs = []
    for _ in range(n):
        words = []
        for _ in range(rng.choice([0, 1, 4, 8])):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 30]))]
        if rng.random() < 0.2 and docs:
            words = re.findall(r"[^\x20\x09-\x0D]+", rng.choice(docs) or "")
            if len(words) > 3 and rng.random() < 0.6:
                words[rng.randrange(len(words))] = "changed"
        docs.append(rng.choice([" ", "\n", " \t", "\r\n"]).join(words))
    docs += ["ab " * 70, "ab " * 70, "x y z " * 30, " ".join(["x"] * 19), "", None, "q " + "x y z " * 9]
    rng.shuffle(docs)
    return docs


def test_wavelet_tree_and_windows():
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, 37, 500)
    tree = WaveletTree(symbols, 37)
    base = tree.bases(37)
    for c, i in rng.integers(0, [38, 501], (300, 2)):
        assert tree.rank(np.array([c]), np.array([i]), base)[0] == (symbols[:i] == c).sum()


@pytest.mark.parametrize("depth", [4, 5, 20])
def test_index_finds_every_repeat(depth):
    rng = np.random.default_rng(depth)
    sizes = rng.integers(1, 60, 80)
    words = rng.integers(0, 2, int(sizes.sum())).astype(np.uint64) * np.uint64(1 << 60)
    words[rng.random(len(words)) < 0.02] = 7
    seg, off = FMIndex(words, sizes, depth).repeats(words, sizes)
    seen, want, at = set(), set(), 0
    for s, n in enumerate(sizes):
        for i in range(n - depth + 1):
            w = tuple(words[at + i : at + i + depth])
            want |= {(s, i)} if w in seen else set()
            seen.add(w)
        at += n
    assert set(zip(seg.tolist(), off.tolist())) == want and len(seg) == len(want)


@pytest.mark.parametrize("group,shard,seed", [(D.GROUP, D.SHARD, 1), (4, 50, 2), (2, 1, 3), (D.GROUP, 30, 4)])
def test_against_brute_force(spark, group, shard, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(10 * i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, k string").repartition(7)
    got = {r.doc_id: r for r in D.dedup(df, group=group, shard=shard).collect()}
    assert len(got) == len(docs)
    for i, (n, removed, kept) in enumerate(slow(docs)):
        r = got[10 * i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, hashlib.sha256(" ".join(kept).encode()).hexdigest()), i
        assert r.text == docs[i] if not removed else re.findall(r"[^\x20\x09-\x0D]+", r.text) == kept
        assert r.k == "x"


@pytest.mark.parametrize("group", [D.GROUP, 5])
def test_long_runs_of_repeating_words(spark, group):
    """Runs of windows with one anchor that are longer than a piece, alone and across documents."""
    docs = ["ab " * 9000, "q " + "x y z " * 3000, "x y z " * 2999 + "end", " ".join(f"u{i}" for i in range(30)) + " ab" * 5000]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r for r in D.dedup(df, group=group).collect()}
    for i, (n, removed, kept) in enumerate(slow(docs)):
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, hashlib.sha256(" ".join(kept).encode()).hexdigest()), i


def test_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(25))
    rows = [(1, a), (1, a), (2, b + " " + a), (None, b), (None, b), (None, "short")]
    out = D.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in out) == [(0, 1, 0), (0, 25, 25), (0, 25, 25), (1, 30, 0), (1, 30, 0), (2, 55, 30)]


def test_sample_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in D.query(spark, "/root/testdata/sf0.001").collect()}
    for d, (n, removed, kept) in zip(docs, slow([d.text for d in docs])):
        r = got[d.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_words_that_a_polynomial_hash_confuses(spark):
    """The two Thue-Morse words of 1,024 letters differ, so the documents that end in them share no window."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    same = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{same} {morse}"), (2, f"{same} {morse.translate(str.maketrans('ab', 'ba'))}"), (3, f"{same} {morse}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in D.dedup(docs).collect()} == {1: 0, 2: 0, 3: 20}


def test_hashes_of_words():
    words = [b"", b"a", b"b", b"ab", b"a" * 7, b"a" * 8, b"a" * 9, b"a" * 16, b"a" * 63 + b"b", b"a" * 64, b"a" * 65, b"a" * 64 + b"b", b"b" * 8 + b"a" * 8]
    raw = np.frombuffer(b"".join(words), np.uint8)
    stop = np.cumsum([len(w) for w in words])
    start = stop - [len(w) for w in words]
    got = D.word_hashes(raw, start, stop, 5)
    assert len(set(got.tolist())) == len(words) and (got != D.word_hashes(raw, start, stop, 6)).all()
    later = np.frombuffer(b"xyz" + raw.tobytes(), np.uint8)
    assert (D.word_hashes(later, start + 3, stop + 3, 5) == got).all()


@pytest.mark.parametrize("level", [0, 1, 2])
def test_every_window_is_in_one_segment_and_equal_ones_have_equal_keys(level):
    rng = np.random.default_rng(level)
    word = rng.integers(0, 3, 900).astype(np.uint64)
    word[300:360] = word[600:660]
    doc = np.repeat([0, 1, 2, 4], [10, 400, 19, 471])
    start, n, key = D.segments(doc, word, level)
    places = D.spread(start, n)
    assert sorted(places.tolist()) == [i for i in range(881) if doc[i] == doc[i + 19]]
    of = dict(zip(places.tolist(), np.repeat(key, n).tolist()))
    by_words = {}
    for i, k in of.items():
        assert by_words.setdefault(tuple(word[i : i + 20].tolist()), k) == k


def test_columns_with_clashing_names(spark):
    names = ["k", "key", "sha", "of", "gone", "wanted", "first", "n", "words", "deal", "c0", "c1", "__key", "__sha", "N_Words", "a.b"]
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(1, text, *names), (1, text + " x", *names), (None, text, *names)]
    out = D.dedup(spark.createDataFrame(rows, ["doc_id", "text", *names]))
    assert out.columns == ["doc_id", "text", *(n for n in names if n != "N_Words"), "n_words", "n_removed", "kept_sha256"]
    got = [r.asDict() for r in out.collect()]
    assert all(r[n] == n for r in got for n in names if n != "N_Words") and sorted((r["doc_id"] or 9, r["n_removed"]) for r in got) in ([(1, 0), (1, 25), (9, 25)],)


def test_query_against_sql(spark):
    assert held(spark, "/root/testdata/sf0.001", D.query, D.SQL) == 200


def test_empty_table(spark):
    assert D.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert D.dedup(spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumn("n_words", F.lit("clash"))).first().n_words == 2


def test_filter_keeps_what_is_wanted(spark):
    rng = random.Random(8)
    ks = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(3000)] + [0, -1, 1]
    docs = spark.createDataFrame([(k, "x") for k in ks], "k long, text string")
    wanted = spark.createDataFrame([(k,) for k in ks[::3]], "k long")
    got = {r.k for r in D._holding(docs, wanted).collect()}
    assert set(ks[::3]) <= got and len(got) < 1010
    assert D._holding(docs, wanted.limit(0)).isEmpty() and D._holding(docs, wanted).columns == ["k", "text"]

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from depweave.llm import language_id as L


def slow(word, p, table):
    """All segmentations, one by one."""

    def total(rest):
        if not rest:
            return np.ones(p.shape[1])
        out = np.zeros(p.shape[1])
        for k in range(1, len(rest) + 1):
            i = table.ids.get(rest[:k], table.n + 1 if k == 1 else None)
            if i is not None:
                out += p[i] * total(rest[k:])
        return out

    return np.log(total("▁" + word))


@pytest.fixture(scope="module")
def model():
    return L.fit([("en", "the", 50), ("en", "house", 9), ("de", "haus", 9), ("de", "die", 40), ("de", "straße", 3), ("字", "字典", 4)])


def test_forward_equals_all_segmentations(model):
    table = L.pieces_for(model.path)
    words = ["the", "house", "straße", "字典", "x", "ᚠa"]
    code, start, size, doc = L.split_words([" ".join(words)])
    got = L.log_likelihoods(code, start, size, model)
    for w, g in zip(words, got):
        assert np.allclose(g, slow(w, model.p, table)) and np.allclose(g, L.long_word(w, table, model.p))
    assert np.isfinite(L.long_word("the" * 3000, table, model.p)).all()


def test_probabilities(model):
    assert np.allclose(model.p.sum(axis=0), 1) and (model.p[-2] == 0).all()
    langs, scores = L.score_texts(["The HOUSE", "", "123 …", "die Straße 字", "字典", "z" * 5000], model)
    assert langs[:5] == ["en", "und", "und", "de", "字"] and scores[1] == scores[2] == 0
    assert all(0 <= s <= 1 for s in scores) and langs[5] in model.languages


def test_words_of_each_text():
    code, start, size, doc = L.split_words(["ab c", "", "İx'y", "z"])
    assert ["".join(map(chr, code[s : s + n])) for s, n in zip(start, size)] == ["ab", "c", "i", "x", "y", "z"]
    assert doc.tolist() == [0, 0, 2, 2, 2, 3]
    first, which = L.distinct_words(*L.split_words(["a b a ab"])[:3])
    assert len(first) == 3 and which[0] == which[2]


def slow_expected(word, p, table):
    """Expected pieces of a word, one segmentation after the other."""
    word = "▁" + word
    ways = []

    def go(at, used, chance):
        if at == len(word):
            ways.append((used, chance))
        for k in range(1, len(word) - at + 1):
            i = table.ids.get(word[at : at + k], table.n + 1 if k == 1 else None)
            if i is not None:
                go(at + k, [*used, i], chance * p[i])

    go(0, [], 1.0)
    out, total = np.zeros(len(p)), sum(c for _, c in ways)
    for used, c in ways:
        for i in used:
            out[i] += c / total
    return out


def test_fitting_counts_pieces_of_short_and_long_words_alike(monkeypatch):
    table = L.pieces_for(L.VOCABULARY)
    words, n = ["the", "house", "ᚠa", "straße", "a", "字典字"], np.array([3.0, 1, 2, 5, 1, 4])
    p = np.random.default_rng(0).random(table.n + 2)
    p[-2] = 0
    want = sum(c * slow_expected(w, p, table) for w, c in zip(words, n))
    for letters in (4, L.LETTERS):
        monkeypatch.setattr(L, "LETTERS", letters)
        assert np.allclose(L.long_counts(words, n, p, table), want)
    short = L.fit_one(words, n)
    monkeypatch.setattr(L, "LONG_WORD", 0)
    assert np.allclose(L.fit_one(words, n), short)


def test_languages_without_spaces(spark):
    """Words of 40 letters and of thousands are learned from like others, letters without a piece too."""
    rng = np.random.default_rng(1)
    run = lambda letters, n: "".join(rng.choice(list(letters), n))
    kinds = {"aa": "abcdeéf", "bb": "字典的是在人有", "cc": "ᚠᚢᚦᚨᚱᚲ"}
    rows = [(i, run(s, 40 if i % 5 else 3000), x) for x, s in kinds.items() for i in range(ord(x[0]) * 100, ord(x[0]) * 100 + 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs)
    assert model.languages == ["aa", "bb", "cc"]
    assert all(r.lang_pred == r.lang and r.score > 0.9 for r in L.predict(docs, model).collect())
    assert L.train(docs, languages=2).languages == ["aa", "bb"]


def test_query_against_all_segmentations(spark, tmp_path):
    """The whole query by hand: fit on the rows that aren't held out, then score each text by every segmentation."""
    texts = ["the house is old", "das haus ist alt", "la casa es vieja", "the the", "haus", None, "", "12", "a casa!", "é字"]
    rows = [(i, texts[i % len(texts)], (["en", "de", "es", "en", "de", "en", "de", "es", "es", None])[i % len(texts)]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    held = {r.doc_id for r in docs.where(L.held_out()).collect()}
    table, words = L.pieces_for(L.VOCABULARY), {}
    split = lambda t: ["".join(map(chr, c[s : s + n])) for c, st, sz, _ in [L.split_words([t or ""])] for s, n in zip(st, sz)]
    for i, t, x in rows:
        if i not in held and x:
            for w in split(t):
                words[x, w] = words.get((x, w), 0) + 1
    langs = sorted({x for x, _ in words})
    p = np.full((table.n + 2, len(langs)), 1 / table.n)
    p[-2], p[-1] = 0, L.UNKNOWN
    for _ in range(L.ROUNDS):
        new = np.full_like(p, L.SMOOTHING)
        for (x, w), n in words.items():
            new[:, langs.index(x)] += n * slow_expected(w, p[:, langs.index(x)], table)
        new[-2] = 0
        p = new / new.sum(axis=0)
    got = {r.doc_id: r for r in L.query(spark, str(tmp_path)).collect()}
    assert len(got) == 60
    for i, t, _ in rows:
        total = sum((slow(w, p, table) for w in split(t)), np.zeros(len(langs)))
        share = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        want = (langs[share.argmax()], share.max()) if split(t) else ("und", 0)
        assert got[i].held_out == (i in held) and got[i].lang_pred == want[0] and np.isclose(got[i].score, want[1])


def test_columns_with_clashing_names(spark):
    names = ["__bytes", "bytes", "c0", "Lang_Pred", "n", "word", "lang"]
    rows = [(i, "the house" if i % 2 else "das haus", *(["x"] * 6), "en" if i % 2 else "de") for i in range(20)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    out = L.predict(docs, L.train(docs))
    assert out.columns == ["doc_id", "text", *(n for n in names if n != "Lang_Pred"), "lang_pred", "score"]
    assert all(r["__bytes"] == r["bytes"] == r["c0"] == "x" and r["lang_pred"] == r["lang"] for r in out.collect())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.query(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out AND lang IS NOT NULL")
    n, right = got.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 150 and right / n > 0.95, (n, right)


def test_nulls_ties_and_extra_columns(spark):
    rows = [(i, "the house the", "en", 1.0) for i in range(12)] + [(i, "die straße", "de", 2.0) for i in range(20, 32)]
    rows += [(None, "the", None, 0.0), (40, None, "en", None), (41, "", "de", 1.0), (41, "", "de", 1.0), (42, "99", None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = L.predict(docs, L.train(docs)).collect()
    assert len(out) == len(rows)
    for r in out:
        want = "und" if not r.text or r.text == "99" else "en" if "the" in r.text else "de"
        assert r.lang_pred == want and (r.score == 0) == (want == "und")


def test_held_out_is_never_learned(spark):
    docs = spark.createDataFrame([(i, "alpha beta", "xx") for i in range(40)], "doc_id long, text string, lang string")
    assert L.train(docs.where(L.held_out())).languages == []
    assert L.train(docs.limit(0)).languages == []
    assert {r.lang_pred for r in L.predict(docs, L.train(docs.limit(0))).collect()} == {"und"}

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from depweave.llm import token_counts as C

SP = sentencepiece.SentencePieceProcessor(model_file=C.MODEL)


@given(st.text(alphabet=st.sampled_from("abthe ▁\n\t .,ß字<s>"), max_size=50))
@settings(max_examples=300, deadline=None)
def test_word_by_word_equals_whole_text(text):
    assert C.counter(C.MODEL).count(text) == len(SP.encode(text))


def test_long_texts():
    for text in ("word " * 40_000, "x" * 100_000, " " * 5_000, "a\nb" * 20_000):
        assert C.counter(C.MODEL).count(text) == len(SP.encode(text))


@pytest.mark.parametrize("path", [C.MODEL, C.public_tokenizers.path("byte_bpe_50k.json")])
def test_cache_hits_misses_and_repeats(spark, tmp_path, path, monkeypatch):
    cache = str(tmp_path / "cache")
    rows = [(1, "a b", 5), (2, None, 6), (3, "", 7), (4, "a b", 8), (4, "a b", 8), (None, "a▁b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = C.count_tokens(docs, cache, path).collect()
    assert len(out) == 6
    n = C.counter(path).count("a b")
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in out if r.doc_id} == {(1, 3, n), (2, 0, 0), (3, 0, 0), (4, 3, n)}
    first = spark.read.parquet(cache).count()
    assert first == (2 if path.endswith(".model") else 3)
    # A second run appends only what is new, and trusts what is stored.
    spark.createDataFrame([(bytes(32), C.tokenizer_digest(path), 99)], C.CACHE).write.mode("append").partitionBy("tokenizer").parquet(cache)
    more = spark.createDataFrame([(9, "new words", 0), (1, "a b", 5)], "doc_id long, text string, n_tokens int")
    assert {r.doc_id: r.n_tokens for r in C.count_tokens(more, cache, path).collect()} == {9: C.counter(path).count("new words"), 1: n}
    assert spark.read.parquet(cache).count() == first + 2


def test_columns_with_clashing_names(spark, tmp_path):
    names = ["__digest", "digest", "tokenizer", "__n", "__text", "c0", "N_Tokens", "a.b"]
    out = C.count_tokens(spark.createDataFrame([(1, "a b", *names), (2, None, *names)], ["doc_id", "text", *names]), str(tmp_path / "cache"))
    assert out.columns == ["doc_id", *(n for n in names if n != "N_Tokens"), "n_bytes", "n_tokens"]
    assert all(r["digest"] == "digest" and r["__n"] == "__n" for r in out.collect())


def test_query_and_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "x " * 5000), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in C.query(spark, str(tmp_path)).collect()}
    assert got[1].n_tokens == len(SP.encode("x " * 5000)) and got[1].over_limit and not got[2].over_limit and got[2].n_bytes == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert C.count_tokens(empty, str(tmp_path / "c2")).count() == 0

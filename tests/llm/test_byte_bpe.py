import hashlib

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from depweave.llm import byte_bpe as B


def by_hand(text: str, ranks: dict[bytes, int]) -> list[int]:
    """Merge the lowest-ranked neighbours until none is left."""
    ids = []
    for match in regex.findall(B.public_tokenizers.PATTERN, text):
        parts = [bytes([b]) for b in match.encode()]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        ids += [ranks[p] for p in parts]
    return ids


@pytest.fixture(scope="module")
def ranks():
    return B.encoding()._mergeable_ranks


@given(st.text(alphabet=st.sampled_from("ab'sé 1\n\t .,ß字 '"), max_size=60))
@settings(max_examples=150, deadline=None)
def test_safe_parts_give_the_same_ids(text):
    enc = B.encoding()
    assert B.encode_text(enc, text, most=3).tolist() == enc.encode_ordinary(text) == by_hand(text, enc._mergeable_ranks)


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 200_000 + "x", "x" + "\n" * 200_000, "don't " * 60_000, "'s" * 90_000, "ab 12 " * 50_000])
def test_very_long_runs(text):
    ids = B.encode_text(B.encoding(), text)
    assert B.encoding().decode_bytes(ids.tolist()) == text.encode()
    if len(set(text)) > 2 or "'" in text:
        assert ids.tolist() == B.encoding().encode_ordinary(text)


def test_nulls_empties_clashing_columns_and_digests(spark, ranks):
    rows = [(1, "the cat's hat", "x"), (2, None, "y"), (None, "", None), (2, "é字 <|endoftext|>", "z"), (2, "é字 <|endoftext|>", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = B.decode(B.encode(docs)).collect()
    assert len(out) == 5
    for r in out:
        text = (r.text or "")
        want = by_hand(text, ranks)
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in want)
        assert bytes(r.decoded) == text.encode()


def test_query(spark, tmp_path):
    spark.createDataFrame([(7, "a b", "en"), (8, None, None)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in B.query(spark, str(tmp_path)).collect()}
    ids = B.encoding().encode_ordinary("a b")
    assert got[7].n_tokens == 2 and got[7].ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert got[7].decoded_sha256 == hashlib.sha256(b"a b").hexdigest()
    assert got[8].n_tokens == 0 and got[8].decoded_sha256 == got[8].ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert B.decode(B.encode(docs)).count() == 0


def test_columns_with_clashing_names(spark):
    names = ["__bytes", "bytes", "c0", "IDS", "Decoded", "a.b"]
    rows = [(1, "a b", *names), (1, None, *names)]
    out = B.decode(B.encode(spark.createDataFrame(rows, ["doc_id", "text", *names])))
    kept = [n for n in names if n not in ("IDS", "Decoded")]
    assert out.columns == ["doc_id", "text", *kept, "ids", "decoded"]
    assert sorted((bytes(r["decoded"]), r["__bytes"], r["bytes"]) for r in out.collect()) == [(b"", "__bytes", "bytes"), (b"a b", "__bytes", "bytes")]

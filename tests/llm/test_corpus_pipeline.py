import math
import re

import corpus_pipeline as P
from depweave.llm import byte_bpe, source_mixing
from tests.llm.test_simhash import slow_components, slow_print
from tests.llm.test_substring_dedup import slow


def slow_copies(rows):
    """rows: (doc_id, source). Copies of each by inverting the distribution term by term."""
    import hashlib

    n = {}
    for _, s in rows:
        n[s] = n.get(s, 0) + 1
    weights = {s: c**0.5 for s, c in n.items()}
    out = {}
    for d, s in rows:
        rate = len(rows) * weights[s] / sum(weights.values()) / n[s]
        parts = max(1, math.ceil(rate / 16))
        out[d] = 0
        for j in range(1, parts + 1):
            u = (int(hashlib.md5(f"{source_mixing.SEED}|{j}|{d}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            p = c = math.exp(-rate / parts)
            k = 0
            while c < u and k < 80:
                k += 1
                p *= rate / parts / k
                c += p
            out[d] += k
    return out


def test_every_stage_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(900, "12 345 !", None, "src1", 8), (901, None, "en", "src2", 0), (902, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns
    steps = [docs]
    for name, stage in P.STAGES:
        steps.append(P.materialise(stage(spark, steps[-1], sf), f"test-{name}"))
    raw, lang, near, cut, mixed, ids = ([r.asDict() for r in s.collect()] for s in steps)
    assert all(s.columns == columns for s in steps[:-1])
    by = lambda rows: {r["doc_id"]: r for r in rows}

    letters = {r["doc_id"] for r in raw if r["text"] and any(c.isalpha() for c in r["text"])}
    assert set(by(lang)) == letters and all(r["lang"] for r in lang)

    lang.sort(key=lambda r: r["doc_id"])
    label = slow_components([slow_print(r["text"]) for r in lang])
    assert sorted(by(near)) == [lang[i]["doc_id"] for i in sorted(set(label))] and len(near) == len(by(near))

    near.sort(key=lambda r: r["doc_id"])
    want = {r["doc_id"]: k for r, k in zip(near, slow([r["text"] for r in near])) if not k[1] or k[1] < k[0]}
    assert set(by(cut)) == set(want)
    for d, r in by(cut).items():
        n, removed, kept = want[d]
        assert re.findall(r"[^\x20\x09-\x0D]+", r["text"]) == kept
        assert removed or r == by(near)[d]
        assert not removed or r["n_chars"] == len(r["text"])

    copies = slow_copies([(r["doc_id"], r["source"]) for r in cut])
    got = {}
    for r in mixed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
        assert r == by(cut)[r["doc_id"]]
    assert got == {d: n for d, n in copies.items() if n}

    enc = byte_bpe.encoding()
    assert len(ids) == len(mixed)
    for r in ids:
        text = by(mixed)[r["doc_id"]]["text"]
        assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in enc.encode_ordinary(text)) and r["exact"] and r["n_tokens"] == len(r["ids"]) // 4


def test_run_equals_stages_and_takes_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash", "substring_dedup", "source_mixing", "byte_bpe"]

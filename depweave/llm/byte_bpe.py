"""Byte-level BPE encoding and decoding with a local rank file.

``encode`` adds the ids of every whole text (null: the empty text), ``decode`` gives back the raw bytes.
Texts above ``SAFE_BYTES`` are cut first where the pattern's matches end anyway:

* before white space that follows another character: no match runs from such a character into white space;
* before the last white space of a run that another character follows: ``\\s+(?!\\S)`` ends there.

A part that stays above twice that size holds a very long match; ``regex`` splits it by the same pattern and
each match goes to the merge loop as a single piece, so the library's own engine never sees such a run.
The ids are those of encoding the text at once. Repeated rows get the same ids; empty tables give empty tables; extra columns pass
through whatever their names, but for those that the result makes anew.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.llm.common import Sheltered, lean, pieces_of, small_batches, text_bytes

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SAFE_BYTES = 1 << 16
BATCH_BYTES = 8 << 20

_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\s)(?=\s\S)")


@functools.lru_cache(maxsize=4)
def encoding(ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file, read once in each process."""
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_parts(text: str, most: int) -> Iterator[str]:
    """The text cut at safe boundaries, each part with at least ``most`` characters where boundaries allow it."""
    at = 0
    while len(text) - at > most:
        found = _SAFE.search(text, at + most)
        if not found or found.start() >= len(text):
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str, most: int = SAFE_BYTES) -> np.ndarray:
    """Ids of a whole text, as encoding it at once gives them; texts and parts above ``most`` go by safe parts."""
    if len(text) <= most:
        return enc.encode_to_numpy(text, disallowed_special=())
    ids: list[np.ndarray] = []
    for part in safe_parts(text, most):
        if len(part) <= 2 * most:
            ids.append(enc.encode_to_numpy(part, disallowed_special=()))
        else:
            ids += (np.asarray(enc._encode_single_piece(x), dtype=np.uint32) for x in regex.findall(enc._pat_str, part))
    return np.concatenate(ids)


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", ranks: str = RANKS, keep_text: bool = True) -> DataFrame:
    """All columns of docs (the text only with keep_text), and ``ids`` binary: the token ids as little-endian unsigned 32-bit integers."""
    small_batches(docs.sparkSession)
    own = Sheltered(docs, [ids] if keep_text else [ids, text], [text])
    inner = own.inner
    schema = T.StructType([own.docs.schema[i] for i in inner] + [T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for whole in batches:
            for batch in pieces_of(whole, "bytes", BATCH_BYTES):
                out = [encode_text(enc, x.as_py().decode("utf-8", "replace")).astype("<u4", copy=False).tobytes() for x in batch.column("bytes")]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in inner), pa.array(out, pa.binary())], [*inner, "ids"])

    return own.docs.select(*inner, text_bytes(own.of(text)).alias("bytes")).mapInArrow(lean(run), schema).toDF(*own.names, ids)


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", ranks: str = RANKS) -> DataFrame:
    """All columns, and ``out`` binary: the raw bytes of the ids (null ids: no bytes)."""
    own = Sheltered(encoded, [out], [ids])
    inner, at = own.inner, own.of(ids)
    schema = T.StructType([own.docs.schema[i] for i in inner] + [T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for batch in batches:
            texts = [enc.decode_bytes(np.frombuffer(x.as_py() or b"", dtype="<u4").tolist()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in inner), pa.array(texts, pa.binary())], [*inner, "bytes"])

    return own.docs.mapInArrow(lean(run), schema).toDF(*own.names, out)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: digests of ids and of decoded bytes for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decode(encode(docs, keep_text=False)).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

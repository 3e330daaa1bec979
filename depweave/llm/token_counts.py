"""Token counts by way of a digest cache.

Every text gets the digest of its normalised content. Normalising changes nothing a tokenizer can see: null
becomes the empty text and, for the sentencepiece kind, U+2581 becomes the space it stands for. The digest and
the tokenizer's version digest (library, its version, the file's bytes) are looked up in a Parquet cache
``(digest, tokenizer, n_tokens)``; only distinct texts that it lacks are encoded and appended.

Equal texts collapse before and after the shuffle, so a text that a third of all rows share crosses it once a
task. Null, empty and very long texts, repeated rows and extra columns of any name are all kept, but for columns ``n_bytes`` and
``n_tokens``, which the result replaces: one row out for each in. An empty table gives an empty table.

The cache is partitioned by tokenizer and read once a call, only for the digests that are asked about. Two jobs that append at once
may store a digest twice; reading takes one.
"""

from __future__ import annotations

import functools
import hashlib
import importlib
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.llm.common import Sheltered, lean, materialise, pieces_of, scratch_path, small_batches
from depweave.session import exists

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIMIT = 4096
BATCH_BYTES = 8 << 20
#: Entries of a worker's memo of word counts; it starts anew beyond that, which costs time only.
MEMO = 400_000
SPACE = "▁"
CACHE = "digest binary, tokenizer string, n_tokens long"


class PieceCounter(dict):
    """Counts sentencepiece tokens word by word, each distinct word encoded once.

    A word with the space before it is a unit of its own if no piece of the vocabulary has a space after another
    character: no merge then crosses its start. Otherwise whole texts are encoded.
    """

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        prefix = self.model.encode("a b", out_type=str) == [SPACE + "a", SPACE + "b"]
        self.by_word = prefix and not any(re.search(f"[^{SPACE}]{SPACE}", x) for x in pieces)
        self.lone = len(self.model.encode("a ")) - len(self.model.encode("a"))

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = len(self.model.encode(word)) if word else self.lone
        if len(word) <= 64:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if not text or not self.by_word:
            return len(self.model.encode(text))
        text = text.replace(" ", SPACE)
        if SPACE * 2 in text or text[0] == SPACE:
            # The prefix that the library puts before a text is one more space.
            return sum(self[x[1:]] for x in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text))
        return sum(map(self.__getitem__, text.split(SPACE)))


class JsonCounter:
    """Counts with the tokenizers library; special strings in texts are handled as the file says."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, text: str) -> int:
        return len(self.model.encode(text, add_special_tokens=False).ids)


@functools.lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter | JsonCounter:
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


@functools.lru_cache(maxsize=16)
def tokenizer_digest(path: str) -> str:
    """Names the tokenizer's version: library, release and the file's content."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {importlib.import_module(library).__version__} ".encode() + f.read()).hexdigest()


def normalised(text: Column, path: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.replace(text, F.lit(SPACE), F.lit(" ")) if path.endswith(".model") else text


def read_cache(spark: SparkSession, cache: str, tokenizer: str, asked: DataFrame | None = None) -> DataFrame:
    """Stored counts of one tokenizer version, one row for each digest (of those in ``asked``); empty if there is no cache yet."""
    if not exists(spark, cache):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer)
    if asked is not None:
        stored = stored.join(asked.select("digest"), "digest", "left_semi")
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(keyed: DataFrame, known: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """Cache rows for the distinct digests that ``known`` lacks; keyed: digest and text."""
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(known, "digest", "left_anti").select("digest", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for whole in batches:
            for batch in pieces_of(whole, "text", BATCH_BYTES):
                n = [count(x.as_py().decode("utf-8", "replace")) for x in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([tokenizer] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    return misses.mapInArrow(lean(run), CACHE)


def count_tokens(docs: DataFrame, cache: str, path: str = MODEL, text: str = "text") -> DataFrame:
    """All columns of docs but the text, with n_bytes (UTF-8) and n_tokens; fills the cache at once, then joins it."""
    small_batches(docs.sparkSession)
    spark, tokenizer = docs.sparkSession, tokenizer_digest(path)
    own = Sheltered(docs, [text, "n_bytes", "n_tokens"], [text])
    body = own.of(text)
    content = normalised(F.col(body), path)
    digest = F.unhex(F.sha2(content, 256)).alias("digest")
    known = read_cache(spark, cache, tokenizer, own.docs.select(digest).distinct())
    if exists(spark, cache):
        known = materialise(known, "known-counts")
    # Tables of their own: a join of two plain shuffles lets adaptive execution split the rows of a text that very many share.
    new = materialise(encode_misses(own.docs.select(digest, content.alias("text")), known, path, tokenizer), "new-counts")
    new.write.mode("append").partitionBy("tokenizer").parquet(cache)
    counted = new.select("digest", "n_tokens")
    if not known.isEmpty():
        counted = materialise(counted.unionByName(known), "counts")
    sized = own.docs.select(*own.inner, F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("n_bytes"), digest)
    return sized.join(counted, "digest", "left").drop("digest").toDF(*own.names, "n_bytes", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: counts for every document. The cache is new for each call, so all distinct texts are encoded."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, scratch_path(spark, "token-cache")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))

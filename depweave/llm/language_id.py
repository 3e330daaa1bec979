"""Language ID by segmentation-marginalised unigrams.

The vocabulary is fixed and public: the letter pieces of a sentencepiece file, lower-cased, with their mark of a word's
start. Each language has a probability for each piece; a word's likelihood is the sum over all of its segmentations
into pieces of their products, by the forward algorithm, and a text's the product over its words, which are runs of
letters of the lower-cased, composed text. Letters that are no piece are one more piece, unknown, with a probability of its own in
each language. The prediction is the likeliest language, its score the share of its likelihood in the sum over languages.

Probabilities are fitted by expectation-maximisation on all words, short and long, of up to ``TRAIN_DOCS`` or so labelled texts a
language, taken by a hash of the id: the mean number is the parameter, every row has the same chance. They are whole texts. Rows whose
crc32(id as text) mod 4 is 2, null ids and null languages are never learned from. Each language is fitted in a task of its own, which
holds that sample's distinct words; the driver holds the probabilities, of the ``LANGUAGES`` labels with the most rows.

``und`` with score 0 if the text is null or has no letter, or nothing could be learned. Ties go to the first language in
text order. Scores of repeated rows are equal; an empty table gives an empty table; texts are scored whole, long ones
like short ones; other columns pass through, whatever their names, unless they are named as a result.
"""

from __future__ import annotations

import dataclasses
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.llm.common import Sheltered, give_back, lean, materialise, pieces_of, small_batches, text_bytes

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
TRAIN_DOCS = 2000
ROUNDS = 4
SMOOTHING = 0.02
#: The probability of an unknown letter that fitting starts from.
UNKNOWN = 1e-7
UNDETERMINED = "und"
#: Labels that are learned at most, those with the most rows: bounds the broadcast model to 8 bytes a piece and language.
LANGUAGES = 500
BATCH_BYTES = 1 << 20
#: Longer words are scored and fitted in logarithms, which can't underflow.
LONG_WORD = 32
#: Letters of long words that are looked up at once.
LETTERS = 1 << 17
START = ord("▁")

_rng = np.random.default_rng(7)
_LOW, _HIGH = (_rng.integers(1, 1 << 63, 1 << 11, dtype=np.uint64) for _ in range(2))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _letter_hash(code: np.ndarray) -> np.ndarray:
    return _LOW[code & 0x7FF] ^ _HIGH[code >> 11]


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str = VOCABULARY) -> tuple[str, ...]:
    """Letter pieces in the file's order, lower-cased, each once; the bare word start is one of them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {"▁": None}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        if piece.lstrip("▁").isalpha() and piece.count("▁") <= 1 and "▁" not in piece[1:]:
            found[piece] = None
    return tuple(found)


class Pieces:
    """Finds the piece ids of many substrings at once, by a hash table with two places for each piece."""

    def __init__(self, pieces: tuple[str, ...]):
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.n = len(pieces)
        self.longest = max(map(len, pieces))
        self.powers = np.cumprod(np.full(self.longest, _BASE), dtype=np.uint64)
        keys = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        self.shift = np.uint64(64 - max(12, (8 * self.n).bit_length()))
        size = 1 << (64 - int(self.shift))
        for odd in range(0xD6E8FEB86659FD93, 0xD6E8FEB86659FD93 + 200, 2):
            self.odd = np.uint64(odd)
            self.slot_id, self.slot_key = np.full(size, self.n, np.int32), np.zeros(size, np.uint64)
            if self._fill(keys):
                return
        raise ValueError("no place for the vocabulary")

    def _fill(self, keys: np.ndarray) -> bool:
        places = np.stack([keys >> self.shift, keys * self.odd >> self.shift], axis=1).astype(np.int64)
        for i in range(len(keys)):
            at = places[i, 0] if self.slot_id[places[i, 0]] == self.n else places[i, 1]
            for _ in range(100):
                self.slot_id[at], i = i, self.slot_id[at]
                if i == self.n:
                    break
                at = places[i].sum() - at  # whoever was there goes to its other place
            else:
                return False
        full = self.slot_id < self.n
        self.slot_key[full] = keys[self.slot_id[full]]
        return True

    def _hash(self, piece: str) -> int:
        code = np.array([ord(c) for c in piece])
        return int((_letter_hash(code) * self.powers[: len(code)]).sum(dtype=np.uint64))

    def find(self, key: np.ndarray) -> np.ndarray:
        """Piece ids, n where there is none."""
        a, b = key >> self.shift, key * self.odd >> self.shift
        out = np.where(self.slot_key[a] == key, self.slot_id[a], self.n)
        return np.where((out == self.n) & (self.slot_key[b] == key), self.slot_id[b], out)

    def lattice(self, code: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Piece ids by (start, end) for words of one length, a row of code points each; n: none, n + 1: an unknown letter."""
        out, h = {}, _letter_hash(code)
        for i in range(code.shape[1]):
            key = np.zeros(len(code), np.uint64)
            for k in range(min(self.longest, code.shape[1] - i)):
                key += h[:, i + k] * self.powers[k]
                found = self.find(key)
                if not k:
                    found = np.where(found == self.n, self.n + 1, found)
                if (found != self.n).any():
                    out[i, i + k + 1] = found.astype(np.int32)
        return out


@functools.lru_cache(maxsize=4)
def pieces_for(path: str) -> Pieces:
    return Pieces(vocabulary(path))


@dataclasses.dataclass
class Model:
    languages: list[str]
    p: np.ndarray  # pieces + 2, languages: the last rows are no piece and an unknown letter
    path: str


def forward(lattice: dict[tuple[int, int], np.ndarray], p: np.ndarray, n: int, size: int) -> list[np.ndarray]:
    """Sums over all segmentations of each prefix: n + 1 arrays (words, languages)."""
    alpha = [np.ones((size, p.shape[1]))] + [np.zeros((size, p.shape[1])) for _ in range(n)]
    for (i, j), ids in sorted(lattice.items()):
        alpha[j] += alpha[i] * p[ids]
    return alpha


def backward(lattice: dict[tuple[int, int], np.ndarray], p: np.ndarray, n: int, size: int) -> list[np.ndarray]:
    beta = [np.zeros((size, p.shape[1])) for _ in range(n)] + [np.ones((size, p.shape[1]))]
    for (i, j), ids in sorted(lattice.items(), reverse=True):
        beta[i] += beta[j] * p[ids]
    return beta


def long_word(word: str, table: Pieces, p: np.ndarray) -> np.ndarray:
    """Log likelihoods of one word of any length, scaled in each step."""
    word = "▁" + word
    recent = [np.ones(p.shape[1])]
    total = np.zeros(p.shape[1])
    for j in range(1, len(word) + 1):
        at = np.zeros(p.shape[1])
        for k in range(1, min(table.longest, j) + 1):
            i = table.ids.get(word[j - k : j], table.n + 1 if k == 1 else table.n)
            if i != table.n:
                at += recent[-k] * p[i]
        recent = [*recent[-table.longest :], at]
        scale = at.copy()
        recent = [x / scale for x in recent]
        total += np.log(scale)
    return total


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, and each word's start, length and text number."""
    plain = [unicodedata.normalize("NFC", t).lower() for t in texts]
    code = np.frombuffer(" ".join(["", *plain, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int32)
    letter = np.concatenate([[False], _letters()[code], [False]])
    turn = np.flatnonzero(letter[1:] != letter[:-1])
    start, stop = turn[::2], turn[1::2]
    first = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in plain])[:-1]]).astype(np.int64) if plain else np.zeros(0, np.int64)
    return code, start, stop - start, np.searchsorted(first, start, "right") - 1


def distinct_words(code: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct word an occurrence, and for each word the number of its distinct word."""
    power = np.cumprod(np.full(len(code) + 1, _BASE), dtype=np.uint64)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    back = np.cumprod(np.full(len(code) + 1, inverse), dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_letter_hash(code) * power[: len(code)], dtype=np.uint64)])
    h = (total[start + size] - total[start]) * back[start] * np.uint64(2) + size.astype(np.uint64)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    return first, which


def log_likelihoods(code: np.ndarray, start: np.ndarray, size: np.ndarray, model: Model) -> np.ndarray:
    """(words, languages) of distinct words."""
    table = pieces_for(model.path)
    out = np.zeros((len(start), model.p.shape[1]))
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        if n > LONG_WORD:
            for r in rows:
                out[r] = long_word("".join(map(chr, code[start[r] : start[r] + n])), table, model.p)
            continue
        word = np.concatenate([np.full((len(rows), 1), START), code[start[rows][:, None] + np.arange(n)]], axis=1)
        out[rows] = np.log(forward(table.lattice(word), model.p, int(n) + 1, len(rows))[-1])
    return out


def score_texts(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """Languages and scores of whole texts."""
    langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    code, start, size, doc = split_words(texts)
    if not len(start) or not model.languages:
        return langs, scores
    first, which = distinct_words(code, start, size)
    word = log_likelihoods(code, start[first], size[first], model)[which]
    at = np.flatnonzero(np.diff(doc, prepend=-1))
    total = np.add.reduceat(word, at, axis=0)
    best = total.argmax(axis=1)
    share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    for d, b, s in zip(doc[at], best, share, strict=True):
        langs[d], scores[d] = model.languages[b], s
    return langs, scores


def long_counts(words: list[str], count: np.ndarray, p: np.ndarray, table: Pieces) -> np.ndarray:
    """Expected numbers of each piece in words of any length, by forward and backward sums in logarithms; p: one language's."""
    expected = np.zeros(len(p))
    longest = table.longest
    order = sorted(range(len(words)), key=lambda i: (len(words[i]), words[i]))
    while order:
        # Words of about one length; behind the shorter ones come marks that are no piece and certain steps.
        most = max(1, LETTERS // (len(words[order[-1]]) + 1))
        some, order = order[-most:], order[:-most]
        n = len(words[some[-1]]) + 1
        code = np.zeros((len(some), n), dtype=np.int64)
        for r, i in enumerate(some):
            code[r, : len(words[i]) + 1] = [START, *map(ord, words[i])]
        lattice = table.lattice(code)
        chance = {at: np.where(code[:, at[0]] == 0, 1.0 if at[1] - at[0] == 1 else 0.0, p[ids]) for at, ids in lattice.items()}
        ahead, back = np.zeros((n + 1, len(some))), np.zeros((n + 1, len(some)))
        for j in range(1, n + 1):
            total = sum(np.exp(ahead[i] - ahead[j - 1]) * chance[i, j] for i in range(max(0, j - longest), j) if (i, j) in chance)
            ahead[j] = ahead[j - 1] + np.log(total)
        for i in range(n - 1, -1, -1):
            total = sum(np.exp(back[j] - back[i + 1]) * chance[i, j] for j in range(i + 1, min(n, i + longest) + 1) if (i, j) in chance)
            back[i] = back[i + 1] + np.log(total)
        for (i, j), ids in lattice.items():
            real = code[:, i] != 0
            part = np.exp(ahead[i] + back[j] - ahead[n]) * chance[i, j] * count[some]
            expected += np.bincount(ids[real], part[real], minlength=len(p))
    return expected


def fit_one(words: list[str], count: np.ndarray, path: str = VOCABULARY, rounds: int = ROUNDS) -> np.ndarray:
    """Expectation-maximisation for one language on distinct words: a probability for each piece, 0 for none, and one for an unknown letter."""
    table = pieces_for(path)
    size = np.array([len(w) for w in words])
    groups = []
    for n in np.unique(size[size <= LONG_WORD]):
        rows = np.flatnonzero(size == n)
        for a in range(0, len(rows), 10_000):
            some = rows[a : a + 10_000]
            groups.append((int(n) + 1, np.array([[START, *map(ord, words[i])] for i in some], dtype=np.int32), count[some][:, None]))
    long = np.flatnonzero(size > LONG_WORD)
    long_words, long_count = [words[i] for i in long], count[long]
    p = np.full((table.n + 2, 1), 1 / table.n)
    p[-2], p[-1] = 0, UNKNOWN
    for _ in range(rounds):
        expected = long_counts(long_words, long_count, p[:, 0], table)
        for n, code, times in groups:
            lattice = table.lattice(code)  # anew each round: kept for all words it would be the largest thing in memory
            alpha, beta = forward(lattice, p, n, len(times)), backward(lattice, p, n, len(times))
            weight = times / alpha[-1]
            for (i, j), ids in lattice.items():
                expected += np.bincount(ids, (alpha[i] * p[ids] * beta[j] * weight)[:, 0], minlength=len(p))
        expected += SMOOTHING
        expected[-2] = 0
        p[:, 0] = expected / expected.sum()
    return p[:, 0]


def fit(words: list[tuple[str, str, int]], path: str = VOCABULARY, rounds: int = ROUNDS) -> Model:
    """A model of (language, word, count)."""
    languages = sorted({x[0] for x in words})
    own = {lang: sorted((w, n) for x, w, n in words if x == lang) for lang in languages}
    columns = [fit_one([w for w, _ in own[x]], np.array([n for _, n in own[x]], dtype=float), path, rounds) for x in languages]
    return Model(languages, np.stack(columns, axis=1), path)


def held_out(key: str = "doc_id"):
    """True for rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", path: str = VOCABULARY, train_docs: int = TRAIN_DOCS, languages: int = LANGUAGES) -> Model:
    """Fit on a bounded sample of labelled rows: about train_docs whole texts of each of the languages with the most rows."""
    small_batches(docs.sparkSession)
    own = Sheltered(docs)
    key, body = own.of(key), own.of(text)
    usable = own.docs.where(F.col(own.of(lang)).isNotNull() & ~held_out(key)).select(F.col(own.of(lang)).cast("string").alias("lang"), key, body)
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    none = Model([], np.zeros((len(vocabulary(path)) + 2, 0)), path)
    if not counts:
        return none
    chance = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, train_docs / r["count"]))))
    draw = F.pmod(F.xxhash64(F.lit("language sample"), key), F.lit(1 << 40)) / float(1 << 40)
    sample = usable.where(draw < chance[F.col("lang")]).select("lang", text_bytes(body).alias("bytes"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "bytes", BATCH_BYTES):
                langs = np.array(batch.column("lang").to_pylist(), dtype=object)
                texts = [x.as_py().decode("utf-8", "replace") for x in batch.column("bytes")]
                for one in sorted(set(langs)):
                    code, start, size, _ = split_words([t for t, x in zip(texts, langs, strict=True) if x == one])
                    if not len(start):
                        continue
                    first, which = distinct_words(code, start, size)
                    words = ["".join(map(chr, code[s : s + n])) for s, n in zip(start[first], size[first], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(words)), pa.array(words), pa.array(np.bincount(which), pa.int64())], ["lang", "word", "n"])

    def fitted(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")  # sums don't depend on the order of rows then
        p = fit_one(table["word"].to_pylist(), table["n"].to_numpy().astype(float), path)
        give_back()
        return pa.table({"lang": table["lang"].slice(0, 1), "p": pa.array([p.astype("<f8").tobytes()], pa.binary())})

    words = sample.mapInArrow(lean(split), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got = sorted(materialise(words, "words").groupBy("lang").applyInArrow(fitted, "lang string, p binary").collect())
    return Model([r["lang"] for r in got], np.stack([np.frombuffer(r["p"], "<f8") for r in got], axis=1), path) if got else none


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of docs with lang_pred and score."""
    small_batches(docs.sparkSession)
    made = {"lang_pred": T.StringType(), "score": T.DoubleType()}
    own = Sheltered(docs, made, [text])
    inner, body = own.inner, own.of(text)
    schema = T.StructType([own.docs.schema[i] for i in inner] + [T.StructField(n, t) for n, t in made.items()])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "bytes", BATCH_BYTES):
                langs, scores = score_texts([x.as_py().decode("utf-8", "replace") for x in batch.column("bytes")], shared.value)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in inner), pa.array(langs, pa.string()), pa.array(scores)], [*inner, *made])

    return own.docs.withColumn("bytes", text_bytes(body)).mapInArrow(lean(run), schema).toDF(*own.names, *made)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document's language, learned from the rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

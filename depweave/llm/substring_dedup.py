"""Substring dedup: removes words of 20-word windows that also start earlier, found by FM-indexes of shards.

Words are ``[^\\x20\\x09-\\x0D]+``. A window is ``WINDOW`` consecutive words of one document; it is a repeat if the same
words start earlier, in a smaller doc_id or before in the same document. Every word that a repeat covers goes.

How windows meet without comparing every shard with every document: a window's anchor is the least hash of its
``ANCHOR``-word runs. Neighbouring windows with one anchor form a segment; equal windows have equal anchors and so
are dealt to one shard. Anchors only deal windows and leave out those whose anchor no other segment has; what repeats
what is decided by FM-indexes alone: every shard's segments are indexed and streamed through the index, which reports the
windows with an earlier place.

1. Segments are cut in the scan. Those of a slice that share an anchor, or hold theirs twice, are a shard already: of a passage
   that a third of all documents share, one copy a slice goes on.
2. Anchors are counted, aggregated before the shuffle; segments with a shared anchor get their words.
3. They are dealt by anchor to shards of about ``SHARD`` words. An anchor with more than ``GROUP`` segments is dealt in groups
   of about that size by a hash of their place, each a part of a shard; what no group finds repeated goes on to a next round,
   dealt by a narrower key: the three least runs of a window, then the window itself. Equal windows always meet in the end,
   and no task holds a large group. Rounds end when no group is too large; copies shrink by ``GROUP`` each round.
4. Repeats are gathered by document (no more than it has words) and cut out.

Words are compared by 64-bit hashes of their bytes under a secret key drawn for each call, so windows that agree in all words but
one are taken for equal with probability 2**-64, whatever the texts. Ids should be unique: rows with the same id
and text are one document and get the same result; different texts with one id go in order of their SHA-256, null
ids come last. Null and empty texts have no words; very long ones are cut like others, in segments of up to ``LONGEST`` windows.
Empty tables give empty tables, other columns pass through whatever their names, but for those that the result makes anew.
"""

from __future__ import annotations

import functools
import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.llm.common import Sheltered, flat, lean, materialise, pieces_of, small_batches, text_bytes
from depweave.llm.fm_index import FMIndex

WINDOW = 20
ANCHOR = 6
SLICE_BYTES = 1 << 20
SHARD = 1 << 17
GROUP = 256
LONGEST = 256
#: Words beyond it are hashed one by one.
LONG_WORD = 64
#: Bits of the filter in ``_holding``: 2,048 bitmaps of 4 KB, so 8 MB whatever the tables' size.
FILTER = 1 << 26

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    one = np.ones(1, np.uint64)
    up = np.concatenate([one, np.cumprod(np.full((1 << bits) - 1, base, np.uint64), dtype=np.uint64)])
    down = np.concatenate([one, np.cumprod(np.full((1 << bits) - 1, pow(base, -1, 1 << 64), np.uint64), dtype=np.uint64)])
    return up, down


class Ranges:
    """Hashes of ranges of a sequence of numbers, each in constant time. They only deal windows: equal ranges have equal hashes."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(int(_BASE), max(16, len(values).bit_length()))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.total[stop] - self.total[start]) * self.down[start])


def word_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, secret: int) -> np.ndarray:
    """64-bit hashes of byte ranges under a key: each eight bytes are mixed into the state so far; long words by BLAKE2."""
    size = stop - start
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw),), np.uint64, padded, strides=(1,))
    key = np.uint64(secret)
    state = _mix(size.astype(np.uint64) ^ key)
    live = np.flatnonzero(size <= LONG_WORD)
    done = 0
    while len(live):
        left = size[live] - done
        here = np.where(left >= 8, ~np.uint64(0), (np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1))
        state[live] = _mix((state[live] ^ (eight[start[live] + done] & here)) + key)
        done += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_WORD):
        state[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : stop[i]], digest_size=8, key=secret.to_bytes(8, "little")).digest(), "little")
    return state


def words_of(offsets: np.ndarray, raw: np.ndarray, secret: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Start, stop, document and, with a key, hash of every word of texts that lie end to end."""
    n = len(raw)
    inside = ~_SPACE[raw]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    after = np.concatenate([inside[1:], [False]]) if n else inside
    start = np.flatnonzero(inside & (~before | cut[:n]))
    stop = np.flatnonzero(inside & (~after | cut[1:])) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return start, stop, doc, None if secret is None else word_hashes(raw, start, stop, secret)


def window_keys(word: np.ndarray, level: int) -> np.ndarray:
    """What deals the window that starts at each word: its least run (0), its three least runs (1), all its words (2)."""
    ranges = Ranges(word)
    if level == 2:
        i = np.arange(len(word) - WINDOW + 1)
        return ranges.of(i, i + WINDOW)
    i = np.arange(len(word) - ANCHOR + 1)
    gram = ranges.of(i, i + ANCHOR)
    width = WINDOW - ANCHOR + 1
    if level == 1:
        least = np.sort(np.partition(np.lib.stride_tricks.sliding_window_view(gram, width), 2, axis=1)[:, :3], axis=1)
        return _mix(least[:, 0] + _mix(least[:, 1] + _mix(least[:, 2])))
    reach, least = 1, gram
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    return least


def doubled(word: np.ndarray, start: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether segments cut by their least run hold it twice: others can't repeat a window of their own."""
    span = n + WINDOW - ANCHOR
    at = spread(start, span)
    times = np.add.reduceat((Ranges(word).of(at, at + ANCHOR).view(np.int64) == np.repeat(key, span)).astype(np.int32), np.cumsum(span) - span)
    return times > 1


def segments(doc: np.ndarray, word: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key, of ``LONGEST`` windows at most: first word, number of windows, key."""
    none = np.zeros(0, np.int64)
    if len(word) < WINDOW:
        return none, none, none
    key = window_keys(word, level)
    valid = doc[: len(key)] == doc[WINDOW - 1 :]
    same = np.concatenate([[False], valid[1:] & valid[:-1] & (key[1:] == key[:-1])])
    start = np.flatnonzero(valid & ~same)
    # A run ends before the next run or at its document's last window.
    ends = np.flatnonzero(valid & ~np.concatenate([same[1:], [False]]))
    parts = (ends - start) // LONGEST + 1
    start = np.repeat(start, parts) + LONGEST * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
    n = np.minimum(np.repeat(ends, parts) - start + 1, LONGEST)
    return start, n, key[start].view(np.int64)


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each first on, n of them, end to end."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def runs(n: np.ndarray, seg: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of n windows as runs of repeats (seg, off) and of others: segment, first window, number of windows, whether repeats."""
    base = np.cumsum(n) - n
    flag = np.zeros(int(n.sum()), dtype=bool)
    flag[base[seg] + off] = True
    owner = np.repeat(np.arange(len(n)), n)
    head = np.flatnonzero(np.concatenate([[True], (flag[1:] != flag[:-1]) | (owner[1:] != owner[:-1])])) if len(flag) else np.zeros(0, np.int64)
    return owner[head], head - base[owner[head]], np.diff(np.append(head, len(flag))), flag[head]


def shard_repeats(sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of the repeats within one shard, by its FM-index; segments in order of their place."""
    return FMIndex(words, sizes, WINDOW).repeats(words, sizes)


def _cut(docs: DataFrame, text: str, secret: int) -> DataFrame:
    """Step 1. docs: k and the text. Rows (key, k, first, n) of neighbouring windows; a null key is a known repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, text, SLICE_BYTES):
                _, _, doc, word = words_of(*flat(batch.column(text)), secret)
                start, n, key = segments(doc, word)
                if not len(start):
                    continue
                k = batch.column("k").to_numpy()[doc[start]]
                first = start - np.searchsorted(doc, doc[start], "left")
                _, which, times = np.unique(key, return_inverse=True, return_counts=True)
                several = (times[which] > 1) | doubled(word, start, n, key)
                shared, lone = np.flatnonzero(several), np.flatnonzero(~several)
                columns = [(key[lone], np.zeros(len(lone), bool), k[lone], first[lone], n[lone])]
                if len(shared):
                    shared = shared[np.lexsort((first[shared], k[shared]))]
                    sizes = n[shared] + WINDOW - 1
                    seg, off, length, repeat = runs(n[shared], *shard_repeats(sizes, word[spread(start[shared], sizes)]))
                    seg = shared[seg]
                    columns.append((key[seg], repeat, k[seg], first[seg] + off, length))
                key, repeat, k, first, n = (np.concatenate(c) for c in zip(*columns, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key, mask=repeat), pa.array(k), pa.array(first, pa.int64()), pa.array(n, pa.int64())], ["key", "k", "first", "n"])

    return docs.select("k", text).mapInArrow(lean(run), "key long, k long, first long, n long")


def _fetch(docs: DataFrame, text: str, wanted: DataFrame, secret: int) -> DataFrame:
    """Step 2. Segments with their words' hashes. wanted: k and an array of structs (first, n, key, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "times", "k", "first", "words"]
        for whole in batches:
            for batch in pieces_of(whole, text, SLICE_BYTES):
                _, _, doc, word = words_of(*flat(batch.column(text)), secret)
                begin = np.searchsorted(doc, np.arange(batch.num_rows), "left")
                lists = batch.column("wanted")
                row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                inner = lists.flatten()
                first, n = inner.field("first").to_numpy(), inner.field("n").to_numpy()
                for a in range(0, len(row), 20_000):
                    part = slice(a, a + 20_000)
                    raw = [word[b : b + m + WINDOW - 1].tobytes() for b, m in zip(begin[row[part]] + first[part], n[part], strict=True)]
                    yield pa.RecordBatch.from_arrays([inner.field("key")[part], inner.field("times")[part], pa.array(batch.column("k").to_numpy()[row[part]]), pa.array(first[part]), pa.array(raw, pa.binary())], names)

    return docs.join(wanted, "k").mapInArrow(lean(run), "key long, times long, k long, first long, words binary")


def _holding(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs (with k) without most of the rows whose k isn't in wanted, before anything is shuffled. Keeps all that are in it: a bit may stand
    for several k, so with very many wanted ones it merely leaves out less. The bitmaps are broadcast; ``FILTER`` bounds them."""
    place = F.pmod(F.xxhash64("k"), F.lit(FILTER)) + 1
    bits = wanted.select(F.bitmap_bucket_number(place).alias("map"), F.bitmap_bit_position(place).alias("bit")).groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substr("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = docs.withColumns({"map": F.bitmap_bucket_number(place), "bit": F.bitmap_bit_position(place)}).join(F.broadcast(bits), "map")
    return marked.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0).select(docs.columns)


def _search(rows: DataFrame, shard: int) -> DataFrame:
    """Step 3. rows: deal, more (whether its group is one of several), k, first, words. Rows (k, first, n, words): repeats with null words; what ``more`` leaves open with its words."""

    def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        k, first, more = table["k"].to_numpy(), table["first"].to_numpy(), table["more"].to_numpy()
        order = np.lexsort((first, k))  # what is earlier in the text is earlier in the documents
        at, raw = flat(table["words"])
        words = np.frombuffer(raw.tobytes(), np.uint64)
        begin, sizes = at[:-1][order] // 8, np.diff(at)[order] // 8
        k, first, more = k[order], first[order], more[order]
        seg, off, n, repeat = runs(sizes - WINDOW + 1, *shard_repeats(sizes, words[spread(begin, sizes)]))
        out = np.flatnonzero(repeat | more[seg])
        seg, off, n, repeat = seg[out], off[out], n[out], repeat[out]
        open_ = [None if r else words[b : b + m + WINDOW - 1].tobytes() for r, b, m in zip(repeat, begin[seg] + off, n, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(k[seg]), pa.array(first[seg] + off), pa.array(n, pa.int64()), pa.array(open_, pa.binary())], ["k", "first", "n", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            deal = batch.column("deal").to_numpy()
            if not len(deal):
                continue
            total = np.concatenate([[0], flat(batch.column("words"))[0][1:] // 8])
            done = 0
            for c in [0, *(np.flatnonzero(deal[1:] != deal[:-1]) + 1)]:
                # A shard may end where a group does.
                ended = c > 0 or (held and held[-1].column("deal")[-1].as_py() != deal[0])
                if ended and size + total[c] - total[done] >= shard:
                    if c > done:
                        held.append(batch.slice(done, c - done))
                    yield found(held)
                    held, size, done = [], 0, c
            held.append(batch.slice(done))
            size += int(total[-1] - total[done])
        if held:
            yield found(held)

    return rows.repartition("deal").sortWithinPartitions("deal").mapInArrow(lean(run), "k long, first long, n long, words binary")


def _narrower(rest: DataFrame, level: int) -> DataFrame:
    """Open segments cut anew by a narrower key: (key, k, first, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "words", SLICE_BYTES):
                at, raw = flat(batch.column("words"))
                word, at = np.frombuffer(raw.tobytes(), np.uint64), at // 8
                own = np.repeat(np.arange(batch.num_rows), np.diff(at))
                start, n, key = segments(own, word, level)
                own = own[start]
                first = batch.column("first").to_numpy()[own] + start - at[own]
                raw = [word[a : a + m + WINDOW - 1].tobytes() for a, m in zip(start, n, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(batch.column("k").to_numpy()[own]), pa.array(first), pa.array(raw, pa.binary())], ["key", "k", "first", "words"])

    return rest.select("k", "first", "words").mapInArrow(lean(run), "key long, k long, first long, words binary")


def _shared(keys: DataFrame) -> DataFrame:
    """(key, times) of keys that several segments have, as a table of its own: adaptive execution can split its join with a hot key."""
    return materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "shared-keys")


def numbered(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """docs with k, a long in the order of documents; False if several rows may share one. Names as in ``Sheltered``."""
    whole = docs.schema[key].dataType.typeName() in ("long", "integer", "short", "byte")
    rows, ids, nulls = docs.agg(F.count(F.lit(1)), F.count_distinct(key), F.count_if(F.col(key).isNull())).first()
    if whole and rows == ids and not nulls:
        return docs.withColumn("k", F.col(key).cast("long")), True
    keyed = docs.withColumn("sha", F.sha2(text_bytes(text), 256))
    order = keyed.select(F.col(key).alias("id"), "sha").distinct().repartitionByRange(F.col("id").asc_nulls_last(), "sha").sortWithinPartitions(F.col("id").asc_nulls_last(), "sha")
    order = materialise(order.withColumn("k", F.monotonically_increasing_id()), "document-order").withColumnRenamed("sha", "of")
    return keyed.join(order, F.col(key).eqNullSafe(F.col("id")) & (F.col("sha") == F.col("of"))).drop("id", "of", "sha"), False


def repeats(source: DataFrame, text: str = "text", group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """(k, first, n): n neighbouring windows from word number first on are repeats. source: k and the text, one row a document; other columns are carried along."""
    secret = secrets.randbits(64)
    cut = materialise(_cut(source, text, secret), "segments")
    known = cut.where("key IS NULL").select("k", "first", "n")
    open_ = cut.where("key IS NOT NULL")
    shared = _shared(open_.select("key"))

    def wanted(keys: DataFrame) -> DataFrame:
        return open_.join(keys, "key").groupBy("k").agg(F.collect_list(F.struct("first", "n", "key", "times")).alias("wanted"))

    # Tables of their own, so that their size is known before the segments or the texts are shuffled for them: small ones are broadcast.
    large = materialise(shared.where(F.col("times") > group), "large-keys")
    rows = None
    if not large.isEmpty():
        asked = materialise(wanted(large), "wanted")
        rows = _fetch(_holding(source.select("k", text), asked), text, asked, secret)
    level = 0
    while rows is not None:
        groups = F.when(F.col("times") > group, F.ceil(F.col("times") / group)).otherwise(1)
        place = F.pmod(F.xxhash64("k", "first", F.lit(level)), groups)
        matches = materialise(_search(rows.select(F.xxhash64("key", place).alias("deal"), (groups > 1).alias("more"), "k", "first", "words"), shard), "matches")
        known = known.unionByName(matches.where("words IS NULL").select("k", "first", "n"))
        rest = matches.where("words IS NOT NULL")
        level += 1
        if rest.isEmpty():
            break
        again = materialise(_narrower(rest, min(level, 2)), "narrower")
        rows = again.join(_shared(again.select("key")), "key")
    # Not a table of its own: the plan then takes the texts' shuffle from the one that the caller joins by k.
    whole = _fetch(source, text, wanted(shared.where(F.col("times") <= group)), secret).select(F.col("key").alias("deal"), F.lit(False).alias("more"), "k", "first", "words")
    return known.unionByName(_search(whole, shard).select("k", "first", "n"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """All columns of docs, the text without repeats (untouched if it has none), and n_words, n_removed, kept_sha256.

    The SHA-256 is that of the kept words joined by one space. Between kept words that were neighbours the text keeps its white space.
    """
    small_batches(docs.sparkSession)
    made = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType()}
    own = Sheltered(docs, made, [key, text])
    body, inner = own.of(text), own.inner
    keyed, unique = numbered(own.docs, own.of(key), body)
    # Candidates' words and the last step take the same columns by the same key, so one shuffle of the texts serves both; the condition,
    # which always holds, is what the inner join adds of its own.
    keyed = keyed.where("k IS NOT NULL")
    gone = repeats(keyed if unique else keyed.dropDuplicates(["k"]), body, group, shard)
    gone = gone.groupBy("k").agg(F.collect_list(F.struct("first", "n")).alias("gone"))
    out_schema = T.StructType([T.StructField(i, keyed.schema[i].dataType) for i in inner] + [T.StructField(n, t) for n, t in made.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, body, SLICE_BYTES):
                have = batch.column(body).cast(pa.binary())
                texts, n_words, n_removed, shas = [], [], [], []
                for value, cut in zip(have, batch.column("gone"), strict=True):
                    raw = value.as_py()
                    words = (raw or b"").split()
                    keep = words
                    if cut.is_valid:
                        cover = np.zeros(len(words) + 1, dtype=np.int64)
                        first, n = (cut.values.field(f).to_numpy() for f in ("first", "n"))
                        np.add.at(cover, first, 1)
                        np.add.at(cover, first + n + WINDOW - 1, -1)
                        left = np.cumsum(cover)[:-1] == 0
                        keep = [w for w, x in zip(words, left, strict=True) if x]
                        start, stop, _, _ = words_of(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
                        heads = np.flatnonzero(left & ~np.concatenate([[False], left[:-1]]))
                        tails = np.flatnonzero(left & ~np.concatenate([left[1:], [False]]))
                        raw = b" ".join(raw[start[a] : stop[b]] for a, b in zip(heads, tails, strict=True))
                    texts.append(raw)
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(keep))
                    shas.append(hashlib.sha256(b" ".join(keep)).hexdigest())
                made_text = pa.array(texts, pa.binary())
                # As text without checking it once more.
                made_text = pa.Array.from_buffers(pa.string(), len(made_text), made_text.buffers(), made_text.null_count)
                columns = [made_text if c == body else batch.column(c) for c in inner]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas)], out_schema.names)

    return keyed.join(gone, "k", "left").mapInArrow(lean(run), out_schema).toDF(*own.names, *made)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: what repeats take from every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = f"""
WITH texts AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
words AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM texts),
windows AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + {WINDOW - 1} <= len(ws) THEN array_to_string(ws[i:i + {WINDOW - 1}], ' ') END AS w FROM words),
judged AS (SELECT doc_id, i, word, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS again FROM windows),
covered AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS {WINDOW - 1} PRECEDING) AS gone FROM judged),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS rest FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM documents d LEFT JOIN kept USING (doc_id)
"""

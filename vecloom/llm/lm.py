"""Scoring texts by a language model: a causal self-attention model over subword ids, beside a unigram base over words.

Subwords are those of a public byte-level vocabulary. Their counts over all training texts give classes (the most
frequent subwords alone, the others in bands of frequency; frequent ones share groups) and each subword's share of its class; the model predicts the
class from the CONTEXT subwords before. So a text's probability is that of its subwords and its end.

It learns from the whole of every training text: counts, and gradients in which each subword and each end is a target.
Texts are cut into subwords once; these are kept, and words are told apart by them when texts are scored.
Training texts are dealt by hash into shards of bounded size, whatever partitions they came in. A fixed number of
steps on the first shard gives the start; then every shard is gone through once from there, and the weights are averaged
by windows, in integers, so that reruns and other partitions give the same model.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm import attention as A
from vecloom.llm import encode as E
from vecloom.llm import textkit as K
from vecloom.llm.jaccard import _by_bucket, _pack, _rows_of, _unpack
from vecloom.llm.storage import table

ALONE, BANDS = 992, 32  # their sum is a multiple of the model's MEMBERS
SHARD_BYTES = 16 << 20  # of text, on average
START_STEPS, START_RATE, START_WINDOWS = 3000, 0.02, 64  # on the first shard, as often as that takes
RATE, BATCH_WINDOWS = 0.01, 512  # once through each shard
SCALE = 1 << 24  # weights are averaged as integers
BLOCK_WINDOWS = 512  # scored at a time
FREQUENT_WORDS = 1_000_000  # of 16 bytes each: all that is broadcast, whatever the input
BUCKET_ENTRIES = 500_000
FLUSH_ENTRIES = 1_000_000
CHUNK_IDS = 1 << 19  # of texts scored together
HELD_OUT = 2  # of crc32(id) modulo 7
_LOG10 = np.log(10)
_STEP = np.uint64(0x9E3779B97F4A7C15)
END_HASH = np.uint64(0x9E6C63D0876A9A35)  # stands for the end among the words

_coders: dict[str, tuple[E.PieceCache, int]] = {}


def _coder(path: str) -> tuple[E.PieceCache, int]:
    """(cache of the subwords of words, size of the vocabulary, whose last id is the end)."""
    if path not in _coders:
        from tokenizers import Tokenizer

        encode, _ = E.library_encoder(path)
        size = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
        _coders[path] = E.PieceCache(lambda pieces: encode([b" " + p for p in pieces])), size
    return _coders[path]


def _forget() -> None:
    """Empties the caches of this worker, where no text is cut any more."""
    for cache, _ in _coders.values():
        cache.clear()


@functools.cache
def _openers(path: str) -> np.ndarray:
    """Which subwords begin with the space that stands before each word, and no other subword of a word has."""
    from tokenizers import Tokenizer

    return np.array([b[:1] == b" " for b in E.token_bytes(Tokenizer.from_file(path))], bool)


@functools.cache
def _marks(size: int) -> np.ndarray:
    return K.mix(np.arange(1, size + 1, dtype=np.uint64) * _STEP)


def _word_hash(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hashes of words by their subwords, which determine their bytes."""
    return K.Spans(ids, _marks(size)).hash(starts, ends)


def _texts(text: pa.Array, cache: E.PieceCache, end: int):
    """For runs of rows: (first row, number of each word among the distinct ones, their hashes, word bounds, subword ids with
    ends, their bounds)."""
    for row, _, data, offsets in K.chunks(text):
        data = K.LOWER[data]
        starts, ends, bounds = K.words(data, offsets)
        code, begin, n = cache.find(data, starts, ends, K.Spans(data).hash(starts, ends))
        own, at = E.ragged_take(cache.ids, begin, n)
        hashes = _word_hash(own, at[:-1], at[1:], end + 1)
        ids, at = E.ragged_take(cache.ids, begin[code], n[code])
        sub = at[bounds] + np.arange(len(bounds))
        whole = np.full(sub[-1], end, np.int64)
        keep = np.ones(len(whole), bool)
        keep[sub[1:] - 1] = False
        whole[keep] = ids
        yield row, code, hashes, bounds, whole, sub


def _packed_texts(packed: pa.Array, kind: str, opens: np.ndarray):
    """Of texts packed by `gather`, for runs of rows: (first row, word hashes, word bounds, subword ids with ends, their bounds)."""
    width = np.dtype(kind).itemsize
    for row, _, data, offsets in K.chunks(packed, width * CHUNK_IDS):
        ids, sub = data.view(kind), offsets // width
        starts = np.flatnonzero(opens[ids])
        bounds = np.searchsorted(starts, sub)
        ends = np.empty_like(starts)
        ends[:-1] = starts[1:]
        some = bounds[1:] > bounds[:-1]
        ends[bounds[1:][some] - 1] = sub[1:][some] - 1
        yield row, _word_hash(ids, starts, ends, len(opens)), bounds, ids.astype(np.int64), sub


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def training_windows(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(subwords before, targets) in windows of CONTEXT, of a run of whole texts with their ends: each is a target
    once. Places behind the last are -1. Windows come in a fixed order that mixes the texts."""
    n = -(-len(ids) // A.CONTEXT)
    whole = np.full(n * A.CONTEXT + 1, -1, np.int64)
    whole[0], whole[1 : len(ids) + 1] = end, ids
    order = np.argsort(K.mix(np.arange(n).astype(np.uint64) * _STEP), kind="stable")
    return whole[:-1].reshape(n, -1)[order], whole[1:].reshape(n, -1)[order]


def gather(rows: DataFrame, path: str, bits: int, shards: int) -> DataFrame:
    """(kind, bucket, mark, packed, ...) of (text, held_out, mark, ...), mark a hash. Kind 0: word hash, count in training texts, count
    in all. Kind 1: subword, count in training texts. Kind 2: the shard, mark, subwords and other columns of each training text.
    Kind 3: those of each other text."""
    more = [f for f in rows.schema.fields if f.name not in ("text", "held_out", "mark")]
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("packed", T.BinaryType()), *more])

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, size = _coder(path)
        subwords = np.zeros(size, np.int64)
        words: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        kinds: list[pa.DataType] = []

        def batch(*columns, rest=None) -> pa.RecordBatch:
            rest = [pa.nulls(len(columns[0]), t) for t in kinds] if rest is None else rest
            return pa.RecordBatch.from_arrays([*columns, *rest], names=schema.names)

        def flush() -> Iterator[pa.RecordBatch]:
            if words:
                h, train, every = _sum_by(*(np.concatenate(x) for x in zip(*words, strict=True)))
                words.clear()
                packed = _by_bucket(_bucket(h, bits), np.hstack([_pack(h, 8), _pack(train, 4), _pack(every, 4)]), ["bucket", "packed"])
                yield batch(pa.array(np.zeros(len(packed), np.int32)), packed.column(0), pa.nulls(len(packed), pa.int64()), packed.column(1))

        for b in batches:
            kinds = [c.type for c in b.columns[3:]]
            held, marks = b.column(1).to_numpy(zero_copy_only=False).astype(bool), b.column(2).to_numpy()
            for row, code, h, bounds, ids, sub in _texts(b.column(0), cache, size - 1):
                n = len(bounds) - 1
                train = ~held[row : row + n]
                used = np.repeat(train, np.diff(bounds))
                t, e = np.bincount(code, used, len(h)).astype(np.int64), np.bincount(code, minlength=len(h))
                words.append((np.append(h, END_HASH), np.append(t, train.sum()), np.append(e, n)))
                subwords += np.bincount(ids[np.repeat(train, np.diff(sub))], minlength=size)
                raw, mark = ids.astype(_kind(size)), marks[row : row + n]
                texts = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(sub * raw.itemsize), pa.py_buffer(raw)])
                yield batch(pa.array(np.where(train, 2, 3).astype(np.int32)), pa.array((mark.view(np.uint64) % np.uint64(shards)).astype(np.int64)), pa.array(mark), texts.cast(pa.binary()), rest=[c.slice(row, n) for c in b.columns[3:]])
                if sum(len(w[0]) for w in words) > FLUSH_ENTRIES:
                    yield from flush()
        yield from flush()
        some = np.flatnonzero(subwords)
        if len(some):
            raw = np.hstack([_pack(some, 8), _pack(subwords[some], 8)]).tobytes()
            yield batch(pa.array([1], pa.int32()), pa.array([0], pa.int64()), pa.nulls(1, pa.int64()), pa.array([raw], pa.binary()))

    return rows.select("text", "held_out", "mark", *(f.name for f in more)).mapInArrow(run, schema)


def _kind(size: int) -> str:
    """How ids of a vocabulary of that size are packed."""
    return "<u4" if size > 1 << 16 else "<u2"


def vocabulary(gathered: DataFrame) -> DataFrame:
    """(bucket, packed, words, tokens): per range of hashes its words' training and whole counts, and the number of words
    and tokens in training texts."""

    def add(key: tuple, group: pa.Table) -> pa.Table:
        rows = _rows_of(group, "packed", 16)
        h, train, every = _sum_by(_unpack(rows[:, :8]), _unpack(rows[:, 8:12]).astype(np.int64), _unpack(rows[:, 12:]).astype(np.int64))
        raw = np.hstack([_pack(h, 8), _pack(train, 6), _pack(every, 6)]).tobytes()
        return pa.table({"bucket": [key[0].as_py()], "packed": [raw], "words": [int((train > 0).sum())], "tokens": [int(train.sum())]}, schema=pa.schema([("bucket", pa.int64()), ("packed", pa.binary()), ("words", pa.int64()), ("tokens", pa.int64())]))

    return gathered.filter("kind = 0").select("bucket", "packed").groupBy("bucket").applyInArrow(add, "bucket long, packed binary, words long, tokens long")


def _read_vocabulary(raw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.frombuffer(raw, np.uint8).reshape(-1, 20)
    return _unpack(rows[:, :8]), _unpack(rows[:, 8:14]).astype(np.int64), _unpack(rows[:, 14:]).astype(np.int64)


def frequent_words(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, training counts) of at most `most` words, the most frequent in all texts: so no word that they lack
    is a hot one."""
    level = lambda n: np.floor(64 * np.log2(np.maximum(n, 1))).astype(np.int64)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                at, n = np.unique(level(_read_vocabulary(raw.as_buffer())[2]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int64))], names=["level", "n"])

    levels = sorted(words.select("packed").mapInArrow(tally, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect(), reverse=True)
    least, n = 1 << 62, 0
    for r in levels:
        n += r["n"]
        if n > most:
            break
        least = r["level"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                h, train, every = _read_vocabulary(raw.as_buffer())
                keep = level(every) >= least
                yield pa.RecordBatch.from_arrays([pa.array([np.hstack([_pack(h[keep], 8), _pack(train[keep], 8)]).tobytes()], pa.binary())], names=["packed"])

    raw = b"".join(r["packed"] for r in words.select("packed").mapInArrow(pick, "packed binary").collect())
    rows = np.frombuffer(raw, np.uint8).reshape(-1, 16)
    h, n = _unpack(rows[:, :8]), _unpack(rows[:, 8:]).astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


class Subwords:
    """Classes of subwords, and log10 of each one's share of its class, from counts in training texts plus one each."""

    def __init__(self, counts: np.ndarray):
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        band = np.log(np.maximum(rank + 1, 1) / (ALONE + 1)) / np.log(max(2, len(counts)) / (ALONE + 1) + 1e-9)
        self.of = np.where(rank < ALONE, rank, ALONE + np.clip((band * BANDS).astype(np.int64), 0, BANDS - 1)).astype(np.int64)
        mass = np.bincount(self.of, counts + 1.0, ALONE + BANDS)
        self.share = np.log10((counts + 1.0) / mass[self.of])
        self.prior = np.log(np.maximum(mass, 0.5) / mass.sum())


def _train_shard(ids: np.ndarray, subwords: Subwords, start: A.Weights, rate: float, batch: int, steps: int | None) -> tuple[A.Weights, int]:
    """(weights, windows) after `steps` steps, or once through the shard; the rate falls to a hundredth."""
    of = np.append(subwords.of, 0)  # of -1: not used
    w = {k: v.copy() for k, v in start.items()}
    before, target = training_windows(ids, len(subwords.of) - 1)
    each = -(-len(before) // batch)
    steps = steps or each
    adam = A.Adam(w, rate)
    for step in range(steps):
        adam.rate = rate * max(0.01, 1 - step / steps)
        at = slice(step % each * batch, (step % each + 1) * batch)
        _, grad = A.gradient(w, of[before[at]], of[target[at]], (target[at] >= 0).astype(np.float32), want=False)
        adam.step(grad)
    return w, len(before)


def train(texts: DataFrame, subwords: Subwords) -> A.Weights:
    """The model, from (bucket, mark, packed): the training texts by shard. Only sums of weights reach the driver."""
    weights = A.initial(subwords.prior)
    kind = _kind(len(subwords.of))

    def passes(rows: DataFrame, start: A.Weights, *how) -> A.Weights:
        def learn(key: tuple, group: pa.Table) -> pa.Table:
            _forget()
            mark, raw = group.column("mark").to_numpy(), group.column("packed").to_pylist()
            raw = [raw[i] for i in np.lexsort(([len(r) for r in raw], mark))]
            K.keep_freed()
            w, seen = _train_shard(np.frombuffer(b"".join(raw), kind).astype(np.int64), subwords, start, *how)
            K.release()
            flat = np.rint(A.flatten(w) * SCALE).astype(np.int64) * seen
            return pa.table({"flat": pa.array([flat.tobytes()], pa.binary()), "seen": pa.array([seen], pa.int64())})

        @K.lean
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = 0, 0
            for b in batches:
                for raw, n in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    total, seen = total + np.frombuffer(raw.as_buffer(), np.int64), seen + n
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), seen))], names=["at", "value", "seen"])

        sums = rows.groupBy("bucket").applyInArrow(learn, "flat binary, seen long").mapInArrow(add, "at long, value long, seen long")
        sums = sums.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.sum("seen").alias("seen")).collect()
        flat = A.flatten(start)
        for r in sums:
            flat[r["at"]] = int(r["value"]) / r["seen"] / SCALE
        return A.restore(flat, start)

    least = texts.agg(F.min("bucket")).first()[0]
    if least is None:
        return weights
    weights = passes(texts.filter(F.col("bucket") == least), weights, START_RATE, START_WINDOWS, START_STEPS)
    return passes(texts, weights, RATE, BATCH_WINDOWS, None)


def model_scores(ids: np.ndarray, bounds: np.ndarray, weights: A.Weights, subwords: Subwords) -> np.ndarray:
    """log10 probability of each text's ids. A text's first window scores all its tokens; each further one begins STRIDE
    later and scores those that no window before it has scored."""
    n = np.diff(bounds)
    count = 1 + np.maximum(0, -(-(n - A.CONTEXT) // A.STRIDE))
    owner = np.repeat(np.arange(len(n)), count)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    classes = subwords.of[ids]
    score = np.zeros(len(ids))
    end = subwords.of[-1]
    for fresh, skip in ((np.flatnonzero(step == 0), 0), (np.flatnonzero(step > 0), A.CONTEXT - A.STRIDE)):
        for s in range(0, len(fresh), BLOCK_WINDOWS):
            own = owner[fresh[s : s + BLOCK_WINDOWS]]
            low = bounds[own] + step[fresh[s : s + BLOCK_WINDOWS]] * A.STRIDE
            place = low[:, None] + np.arange(A.CONTEXT)[None]
            before = classes[np.clip(place - 1, 0, len(ids) - 1)]
            before[place == bounds[own][:, None]] = end
            inside = place[:, skip:] < bounds[own + 1][:, None]
            target = np.minimum(place[:, skip:], len(ids) - 1)
            score[target[inside]] = A.log_probs(weights, before, classes[target], skip)[inside] / _LOG10
    score += subwords.share[ids]
    return np.add.reduceat(score, bounds[:-1]) if len(n) else score


def score_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT_WORDS) -> DataFrame:
    """One row per input row: the id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    A text is held out if crc32 of its id as text is 2 modulo 7; a null id is not. A null or empty text is its end alone.
    Repeated rows give repeated results; other columns are not read; an empty table gives no rows. Texts are scored
    whole, however long. Without training texts every word is unknown and the model is its start.

    Other partitions of the same rows give the same model, and scores that differ by rounding only.

    Word counts are summed by ranges of hashes. The `frequent` most frequent words are broadcast, a fixed size; counts of
    all others meet the texts that have them by shuffle. What the driver sees has a fixed size too: counts of the
    vocabulary's subwords, and averages of weights.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == HELD_OUT, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held_out"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    bits = max(0, int(np.ceil(np.log2(max(1.0, total / 20 / BUCKET_ENTRIES)))))
    marked = rows.select("text", "held_out", F.xxhash64("id", "text").alias("mark"), "id")
    gathered = table(gather(marked, path, bits, max(1, -(-int(total) // SHARD_BYTES))), "gathered")
    words = table(vocabulary(gathered), "words")
    sums = words.agg(F.sum("words").alias("v"), F.sum("tokens").alias("n")).first()
    distinct, tokens = sums["v"] or 0, sums["n"] or 0
    base = np.log10(tokens + distinct + 1.0)
    hot_hash, hot_count = frequent_words(words, frequent)

    def count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                pair = np.frombuffer(raw.as_buffer(), "<u8").reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["id", "n"])

    _, size = _coder(path)
    counts = np.zeros(size)
    for r in gathered.filter("kind = 1").select("packed").mapInArrow(count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    subwords = Subwords(counts)
    weights = train(gathered.filter("kind = 2").select("bucket", "mark", "packed"), subwords)
    shared = spark.sparkContext.broadcast((hot_hash, hot_count, subwords, weights))

    fields = [T.StructField("key", T.LongType()), rows.schema["id"], T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")), *(T.StructField(c, T.DoubleType()) for c in ("base", "score")), T.StructField("bucket", T.LongType()), T.StructField("packed", T.BinaryType())]
    schema = T.StructType(fields)
    keyed = gathered.filter("kind >= 2").select(F.monotonically_increasing_id().alias("key"), "id", (F.col("kind") == 3).alias("held_out"), "packed")

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        hot_hash, hot_count, subwords, weights = shared.value
        opens = _openers(path)
        for b in batches:
            keys = b.column(0).to_numpy()
            for row, hashes, bounds, ids, sub in _packed_texts(b.column(3), _kind(len(opens)), opens):
                n = len(bounds) - 1
                part = b.slice(row, n)
                owner = np.append(K.repeat_rows(bounds), np.arange(n))
                h = np.append(hashes, np.full(n, END_HASH))
                code, words_ = pd.factorize(h)  # each distinct word of a chunk is looked up once
                at = np.minimum(np.searchsorted(hot_hash, words_), max(0, len(hot_hash) - 1))
                there = hot_hash[at] == words_ if len(hot_hash) else np.zeros(len(words_), bool)
                c = np.where(there, hot_count[at], 0) if len(hot_hash) else np.zeros(len(words_), np.int64)
                hot = there[code]
                known = np.bincount(owner, (c > 0)[code], n).astype(np.int64)
                logs = np.bincount(owner, np.log10(c + 1.0)[code], n)
                total = np.diff(bounds) + 1
                score = model_scores(ids, sub, weights, subwords)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(total.astype(np.int64)), pa.array(known), pa.array(logs - total * base), pa.array(score), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=schema.names)
                cold, who = h[~hot], keys[row + owner[~hot]].astype(np.uint64)
                if not len(cold):
                    continue
                order = np.lexsort((who, cold))
                cold, who = cold[order], who[order]
                first = np.flatnonzero(np.concatenate([[True], (cold[1:] != cold[:-1]) | (who[1:] != who[:-1])]))
                times = np.diff(np.append(first, len(cold)))
                packed = _by_bucket(_bucket(cold[first], bits), np.hstack([_pack(cold[first], 8), _pack(who[first], 8), _pack(times, 4)]), ["bucket", "packed"])
                blank = [pa.nulls(len(packed), t) for t in (pa.int64(), part.column(1).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([*blank, *packed.columns], names=schema.names)

    scored = table(keyed.mapInArrow(run, schema), "scored")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows_ = _rows_of(left, "packed", 20)
        h, who, times = _unpack(rows_[:, :8]), _unpack(rows_[:, 8:16]), _unpack(rows_[:, 16:]).astype(np.int64)
        v = np.frombuffer(b"".join(right.column("packed").to_pylist()), np.uint8)
        vh, vc, _ = _read_vocabulary(v)
        at = np.minimum(np.searchsorted(vh, h), max(0, len(vh) - 1))
        c = np.where(vh[at] == h, vc[at], 0) if len(vh) else np.zeros(len(h), np.int64)
        who, known, logs = _sum_by(who, np.where(c > 0, times, 0), times * np.log10(c + 1.0))
        some = known > 0
        return pa.table({"key": pa.array(who[some].view(np.int64)), "more": pa.array(known[some]), "logs": pa.array(logs[some])})

    cold = scored.filter("packed is not null").select("bucket", "packed").groupBy("bucket")
    rest = cold.cogroup(words.select("bucket", "packed").groupBy("bucket")).applyInArrow(meet, "key long, more long, logs double")
    rest = rest.groupBy("key").agg(F.sum("more").alias("more"), F.sum("logs").alias("logs"))
    joined = scored.filter("packed is null").join(rest, "key", "left")
    return joined.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"), "score",
    )

"""A quality classifier: histogram gradient-boosted trees over statistics of the text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm import quality
from vecloom.llm import textkit as K

FOLDS = 5  # rows whose crc32(id) % FOLDS is 0 are held out
SAMPLE_ROWS = 200_000  # labelled ids to fit on at most, about; by hash
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, SHRINK, LEAST = 80, 4, 64, 0.15, 0.5, 0.25

_KINDS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "stop": b".?",
    "comma": b",;:",
    "shout": b"!",
    "symbol": b"#*$%&|<>@^~_={}[]\\/+",
    "bar": b"|",
    "other": range(128, 256),
}
KINDS = {name: np.isin(np.arange(256), list(codes)) for name, codes in _KINDS.items()}
STATISTICS = [
    "log_words", "log_chars", "chars_a_word", "symbols_a_word", "dup_lines", "dup_line_chars", "repeat_words", *(f"dup_chars_{n}" for n in quality.COVERAGE), "words_a_line", "distinct_words", "again_next",
    *(f"{k}_chars" for k in KINDS), "upper_words", "symbol_ends", "stop_ends", "shout_ends", "short_words", "long_words", "longest_word", "length_spread", "digit_words", "stop_lines",
]


def statistics(text: pa.Array) -> np.ndarray:
    """The STATISTICS of each text, one row each, as 32-bit floats. A null or empty text has zeros."""
    m = quality.metrics(text)
    some = lambda x: np.maximum(x, 1).astype(float)
    words, chars, lines = some(m["n_words"]), some(m["word_chars"]), some(m["n_lines"])
    columns = [np.log1p(m["n_words"]), np.log1p(m["word_chars"]), m["word_chars"] / words, m["n_symbols"] / words, m["n_dup_lines"] / lines, m["dup_line_chars"] / some(m["line_chars"]), m["n_repeat_words"] / words]
    columns += [m[f"dup_chars_{n}"] / chars for n in quality.COVERAGE]
    columns.append(m["n_words"] / lines)
    rest: list[np.ndarray] = []
    for _, _, data, offsets in K.chunks(text):
        starts, ends, bounds = K.words(data, offsets)
        hashes = K.Spans(data).hash(starts, ends)
        owner = K.repeat_rows(bounds)
        n, size = some(np.diff(bounds)), some(np.diff(offsets))
        each = lambda hit: K.row_sums(hit, bounds) / n  # noqa: B023, E731
        _, again = quality._repeated(hashes ^ K.mix(owner.astype(np.uint64) + np.uint64(1)))
        follows = np.zeros(len(hashes), bool)
        follows[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        length = ends - starts
        first, last = (data[np.minimum(x, max(len(data) - 1, 0))] if len(data) else np.zeros(0, np.uint8) for x in (starts, ends - 1))
        longest = np.zeros(len(offsets) - 1)
        np.maximum.at(longest, owner, length)
        mean = K.row_sums(length, bounds) / n
        breaks = np.flatnonzero(data == 10)
        before = data[np.maximum(breaks - 1, 0)]
        break_row = np.searchsorted(offsets, breaks, "right") - 1
        per_row = np.bincount(break_row, minlength=len(offsets) - 1), np.bincount(break_row[KINDS["stop"][before]], minlength=len(offsets) - 1)
        part = [1 - each(again), each(follows), *(K.row_sums(KINDS[k][data], offsets) / size for k in KINDS)]
        part += [each(KINDS["upper"][first]), each(KINDS["symbol"][last]), each(KINDS["stop"][last]), each(KINDS["shout"][last]), each(length <= 2), each(length >= 14), longest]
        part += [np.sqrt(np.maximum(K.row_sums(length * length, bounds) / n - mean * mean, 0)), each(KINDS["digit"][first]), per_row[1] / some(per_row[0])]
        rest.append(np.stack(part, 1) if len(offsets) > 1 else np.zeros((0, len(part))))
    own = np.concatenate(rest) if rest else np.zeros((0, len(STATISTICS) - len(columns)))
    return np.concatenate([np.stack(columns, 1), own], 1).astype(np.float32)


class Trees:
    """Boosted trees as flat arrays. Node i of a tree has the children 2i + 1 and 2i + 2; a node that does not split has an
    infinite threshold, so that every row goes left below it."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for the probability of y = 1, grown level by level on histograms of gradients. Without rows, or with rows of one
    label only, every score is the smoothed share of that label."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    if not 0 < y.sum() < len(y):
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # bin b: cuts[b - 1] < x <= cuts[b]
    margin, grown = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, threshold, value = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.zeros(leaves)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            width, start = 2**level, 2**level - 1
            local = node - start
            best, choice, where = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, -1)
            for f in range(x.shape[1]):
                cell = local * BINS + bins[:, f]
                gl = np.bincount(cell, g, width * BINS).reshape(width, BINS).cumsum(1)
                hl = np.bincount(cell, h, width * BINS).reshape(width, BINS).cumsum(1)
                gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
                gain = gl**2 / (hl + SHRINK) + gr**2 / (hr + SHRINK) - gl[:, -1:] ** 2 / (hl[:, -1:] + SHRINK)
                gain = np.where((hl >= LEAST) & (hr >= LEAST), gain, 0)[:, : len(cuts[f])]
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best, choice, where = np.where(better, top, best), np.where(better, f, choice), np.where(better, at, where)
            split = where >= 0
            feature[start : start + width] = choice
            threshold[start : start + width] = [cuts[f][b] if s else np.inf for f, b, s in zip(choice, where, split, strict=True)]
            right = split[local] & (bins[np.arange(len(y)), choice[local]] > where[local])
            node = 2 * node + 1 + right
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + SHRINK)
        margin = margin + value[leaf]
        grown.append((feature, threshold, value))
    return Trees(base, *(np.stack(part) for part in zip(*grown, strict=True)))


def _fold(id_: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, statistics) of at most about `sample_rows` labelled rows that are not held out, one per id.

    Labels of one id are averaged (a half counts as 1), null labels are no labels. Ids are taken by a hash, all of them while
    there are not more. The sample of ids is broadcast, so texts are filtered where they lie; of documents that repeat an id,
    the one with the least statistics counts.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & (_fold(F.col(id_col), FOLDS) != 0)).groupBy(F.col(id_col).alias("id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    n = known.count()
    if n > sample_rows:
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(sample_rows / n * (1 << 30)))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(known), "id")

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = statistics(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(found), pa.list_(pa.float32()))], names=["id", "label", "x"])

    schema = T.StructType([texts.schema["id"], T.StructField("label", T.IntegerType()), T.StructField("x", T.ArrayType(T.FloatType()))])
    rows = texts.select("id", "label", "text").mapInArrow(run, schema)
    return rows.groupBy("id", "label").agg(F.min("x").alias("x"))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on `training_rows`, in the order of their ids, so that reruns agree."""
    rows = training_rows(docs, labels, sample_rows).toArrow().sort_by("id")
    x = np.stack(rows["x"].to_numpy()) if rows.num_rows else np.zeros((0, len(STATISTICS)), np.float32)
    return fit(x.astype(np.float32), rows["label"].to_numpy().astype(float))


def classify(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id, held_out, score and predicted. A map without a shuffle; memory is bounded by a
    megabyte of text, or by the longest text.

    A null or empty text is scored by its statistics, all zero. A null id stays null and counts as held out; repeated rows
    give repeated results; other columns are not read. An empty table gives no rows.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.score(statistics(b.column(1))))], names=schema.names)

    scored = docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, schema)
    return scored.select(id_col, (_fold(F.col(f"`{id_col}`"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`classify` by trees that `learn` fits. Without labels every row has a score of one half."""
    return classify(docs, learn(docs, labels, sample_rows))

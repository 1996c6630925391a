"""Quality rules by repetition coverage: the share of a text's characters inside repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vecloom.llm import textkit as K

# N-gram length and the largest percentage of the words' characters inside repeats of such n-grams
# (published thresholds for web text).
COVERAGE = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
# Largest percentages of repeated lines and of the characters inside them (published thresholds).
DUP_LINES, DUP_LINE_CHARS = 30, 20
MIN_WORDS = 50
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "line_chars", "dup_line_chars", *(f"dup_chars_{n}" for n in COVERAGE)]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether another equals it, and whether an earlier one does."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    any_[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return any_, later


def _covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of `total` words lie in a window of n that begins at one of `at`."""
    steps = np.zeros(total + 1, np.int32)
    steps[at] = 1
    np.subtract.at(steps, at + n, 1)
    return np.cumsum(steps[:-1]) > 0


def metrics(text: pa.Array) -> dict[str, np.ndarray]:
    """The METRICS of each text, as long arrays."""
    out: dict[str, list[np.ndarray]] = {m: [] for m in METRICS}
    for _, _, data, offsets in K.chunks(text):
        starts, ends, bounds = K.words(data, offsets)
        spans, points = K.Spans(data), K.code_points(data)
        hashes = spans.hash(starts, ends)
        owner = K.repeat_rows(bounds)
        chars = points[ends] - points[starts]
        left = bounds[1:][owner] - np.arange(len(hashes))
        salt = K.mix(owner.astype(np.uint64) + np.uint64(1))
        row = {"n_words": np.diff(bounds), "word_chars": K.row_sums(chars, bounds)}
        row["n_symbols"] = K.row_sums(SYMBOLS[data], offsets)

        breaks = np.flatnonzero(data == 10)
        first = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
        first = first[first < max(len(data), 1)]
        last = np.append(first[1:], len(data))
        last = last - (last > first) * (data[np.maximum(last - 1, 0)] == 10) if len(data) else last
        solid = np.searchsorted(starts, last) > np.searchsorted(starts, first)
        first, last = first[solid], last[solid]
        line_row = np.searchsorted(offsets, first, "right") - 1
        line_bounds = np.searchsorted(line_row, np.arange(len(offsets)))
        _, again = _repeated(spans.hash(first, last) ^ K.mix(line_row.astype(np.uint64) + np.uint64(1)))

        grams = K.ngrams(hashes, 3)
        at = np.flatnonzero(left[: len(grams)] >= 3)
        any_, _ = _repeated(grams[at] ^ salt[at])
        twice = np.zeros(len(hashes) + 1, bool)  # windows of three words that occur again
        twice[at[any_]] = True
        row["n_repeat_words"] = K.row_sums(_covered(at[any_], 3, len(hashes)), bounds)
        # A longer window can occur again only where all the shorter ones in it do.
        size = 3
        for n in COVERAGE:
            grams = K.ngrams(hashes, n)
            at = np.flatnonzero(twice[: len(grams)])
            at = at[left[at] >= n]
            for i in range(1, n - size + 1):
                at = at[twice[at + i]]
            any_, later = _repeated(grams[at] ^ salt[at])
            row[f"dup_chars_{n}"] = K.row_sums(np.where(_covered(at[later], n, len(hashes)), chars, 0), bounds)
            twice[:] = False
            twice[at[any_]] = True
            size = n

        long = points[last] - points[first]
        row |= {"n_dup_lines": K.row_sums(again, line_bounds), "n_lines": np.diff(line_bounds), "line_chars": K.row_sums(long, line_bounds), "dup_line_chars": K.row_sums(np.where(again, long, 0), line_bounds)}
        for m in METRICS:
            out[m].append(row[m])
    return {m: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for m, v in out.items()}


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def accepted(m: dict[str, np.ndarray]) -> np.ndarray:
    """The verdict: no base failure, and every coverage within its limit."""
    good = ~base_failed(m)
    for n, most in COVERAGE.items():
        good &= 100 * m[f"dup_chars_{n}"] <= most * m["word_chars"]
    return good & (100 * m["n_dup_lines"] <= DUP_LINES * m["n_lines"]) & (100 * m["dup_line_chars"] <= DUP_LINE_CHARS * m["line_chars"])


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, METRICS, base_failed and kept. No shuffle; memory is bounded by a megabyte of
    text, or by the longest text.

    A null or empty text has no words and so fails. Repeated rows give repeated results; a null id stays null; other
    columns are not read. An empty table gives an empty result.
    """
    schema = T.StructType([docs.schema[id_col], *(T.StructField(m, T.LongType()) for m in METRICS), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = metrics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[k]) for k in METRICS), pa.array(base_failed(m)), pa.array(accepted(m))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text is accepted. Null, empty and short texts go; repeated rows and
    null ids stay or go with their texts; other columns may have any name. An empty table gives no rows."""
    at = docs.columns.index(text_col)

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(accepted(metrics(b.column(at)))))

    return docs.mapInArrow(run, docs.schema)

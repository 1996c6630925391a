"""Byte-level BPE encoding and decoding of a text column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vecloom.llm import encode as E
from vecloom.llm import textkit as K

_coders: dict[str, tuple[E.PieceCache, E.Decoder]] = {}


def _coder(path: str, pattern: str) -> tuple[E.PieceCache, E.Decoder]:
    """One per worker and file: reused from task to task."""
    if path not in _coders:
        ranks = E.read_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _coders[path] = E.PieceCache(E.rank_encoder(ranks, pattern)), E.Decoder(table)
    return _coders[path]


def encode_column(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_tokens, and ids as little-endian unsigned 32-bit integers (binary).

    A null or empty text has no ids. Very long texts and very long pre-tokens are encoded whole. No shuffle.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, _ = _coder(path, pattern)
        for b in batches:
            first = 0
            for ids, bounds in E.encode_texts(b.column(1), cache):
                n = len(bounds) - 1
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), pa.array(np.diff(bounds)), pa.array([raw[s:e] for s, e in zip((4 * bounds[:-1]).tolist(), (4 * bounds[1:]).tolist(), strict=True)], pa.binary())], names=schema.names)
                first += n

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_tokens, ids_sha256 of the ids as little-endian unsigned 32-bit integers, and
    decoded_sha256 of the bytes that the ids decode to.

    A null or empty text has no ids, and the digests of nothing. Repeated rows give repeated results, a null id stays
    null, other columns are not read. No shuffle; memory is bounded by a few megabytes of text, or the longest text.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def digests(raw: memoryview, bounds: np.ndarray) -> pa.Array:
        return pa.array([hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, decoder = _coder(path, pattern)
        for b in batches:
            first = 0
            for ids, bounds in E.encode_texts(b.column(1), cache):
                n = len(bounds) - 1
                back, at = decoder.decode(ids)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), pa.array(np.diff(bounds)), digests(memoryview(ids.astype("<u4").tobytes()), 4 * bounds), digests(memoryview(back.tobytes()), at[bounds])], names=schema.names)
                first += n

    return docs.select(id_col, text_col).mapInArrow(run, schema)

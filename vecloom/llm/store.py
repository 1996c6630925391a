"""Token-id output as a content-addressed store.

A store is a folder with three Parquet tables:

    data/kind=chunks/  digest (SHA-256 of the ids as little-endian unsigned 32-bit integers), n, ids; each digest once. Ids
                       take two bytes each where the vocabulary allows it, else four
    recipes/           one file per part, parts and the rows in them in ascending order: part, doc_id, at (ids of the
                       documents before it in its part), n_tokens, chunks (digests in order), root
    manifest/          part, first_doc, n_docs, start (ids of all parts before it), n_tokens, root

Documents are cut where a rolling hash of their last ids meets a mask, so a passage that many documents share gives the
same chunks wherever it stands. A document's root is the Merkle root over its chunk digests, a part's the Merkle root over
its documents' roots.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm import encode as E
from vecloom.llm import textkit as K
from vecloom.llm.storage import shared_folder, table
from vecloom.llm.textkit import mix

WINDOW = 8  # ids under the rolling hash
MASK_BITS = 9  # a cut every 512 ids on average
MOST_IDS = 8192  # and at least once in so many
END_ID = 0
SENT = 1_000_000  # digests that a task remembers; beyond that it begins anew and a chunk may be sent again

_coders: dict[str, tuple[E.PieceCache, int]] = {}


def _coder(path: str) -> tuple[E.PieceCache, int]:
    """(cache of pieces, bytes that an id takes in the files)."""
    if path not in _coders:
        from tokenizers import Tokenizer

        size = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
        _coders[path] = E.PieceCache(*E.library_encoder(path)), 2 if size <= 1 << 16 else 4
    return _coders[path]


def cut_points(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all documents, in order; each document's end is one of them."""
    n = len(ids)
    hashed = mix(ids.astype(np.uint64) + np.uint64(1))
    rolling = np.zeros(n, np.uint64)
    for i in range(min(WINDOW, n)):
        rolling[i:] += hashed[: n - i] << np.uint64(i)
    owner = np.searchsorted(bounds, np.arange(n), "right") - 1
    deep = np.arange(n) - bounds[owner] >= WINDOW - 1  # the window lies in the document
    cuts = np.flatnonzero(deep & ((mix(rolling) & np.uint64((1 << MASK_BITS) - 1)) == 0)) + 1
    cuts = np.unique(np.concatenate([cuts, bounds[1:]]))
    begin = np.concatenate([[0], cuts[:-1]])
    long = np.flatnonzero(cuts - begin > MOST_IDS)
    if len(long):
        cuts = np.unique(np.concatenate([cuts, *[np.arange(begin[i] + MOST_IDS, cuts[i], MOST_IDS) for i in long]]))
    return cuts[cuts > 0]


def merkle_root(digests: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd one goes up as it is."""
    level = list(digests) or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """One row per document (kind recipes), and one per chunk and task (kind chunks), with a hash that deals them out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("mark"))
    schema = T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("deal", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.BinaryType()),
        rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("chunks", T.ArrayType(T.BinaryType())), T.StructField("root", T.BinaryType()),
    ])

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (cache, width), sent = _coder(path), set()
        for b in batches:
            row = 0
            for ids, bounds in E.encode_texts(b.column(1), cache):
                n = len(bounds) - 1
                bounds = bounds + np.arange(n + 1)  # an end id behind each document
                whole = np.full(bounds[-1], END_ID, "<u4")
                inner = np.ones(len(whole), bool)
                inner[bounds[1:] - 1] = False
                whole[inner] = ids
                cuts = cut_points(whole, bounds)
                begin = np.concatenate([[0], cuts[:-1]])
                raw, short = memoryview(whole.tobytes()), whole.astype(f"<u{width}").tobytes()
                digests = [hashlib.sha256(raw[4 * s : 4 * e]).digest() for s, e in zip(begin.tolist(), cuts.tolist(), strict=True)]
                new = []
                for i, d in enumerate(digests):
                    if d not in sent:
                        sent.add(d)
                        new.append(i)
                if len(sent) > SENT:
                    sent.clear()
                k = len(new)
                own = [digests[i] for i in new]
                parts = [short[width * s : width * e] for s, e in zip(begin[new].tolist(), cuts[new].tolist(), strict=True)]
                blank = lambda m, *names: [pa.nulls(m, t) for t in map(b_types.__getitem__, names)]
                deal = np.frombuffer(b"".join(d[:8] for d in own), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(["chunks"] * k, pa.string()), pa.array(deal), pa.array(own, pa.binary()), pa.array((cuts - begin)[new].astype(np.int32)), pa.array(parts, pa.binary()), *blank(k, "doc_id", "n_tokens", "chunks", "root")], names=schema.names)
                at = np.searchsorted(cuts, bounds[1:]) + 1
                lists = [digests[s:e] for s, e in zip([0, *at[:-1].tolist()], at.tolist(), strict=True)]
                roots = [merkle_root(x) for x in lists]
                deal = np.frombuffer(b"".join(r[8:16] for r in roots), np.int64) ^ b.column(2).to_numpy()[row : row + n]  # copies lie apart
                yield pa.RecordBatch.from_arrays([pa.array(["recipes"] * n, pa.string()), pa.array(deal), *blank(n, "digest", "n", "ids"), b.column(0).slice(row, n), pa.array(np.diff(bounds)), pa.array(lists, pa.list_(pa.binary())), pa.array(roots, pa.binary())], names=schema.names)
                row += n

    from pyspark.sql.pandas.types import to_arrow_type

    b_types = {f.name: to_arrow_type(f.dataType) for f in schema.fields}
    return rows.mapInArrow(run, schema)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps one of the chunks of each digest, from rows sorted by it. Recipes have none and pass."""
    last = None
    for b in batches:
        keep = []
        for d in b.column(2).to_pylist():
            keep.append(d is None or d != last)
            last = d
        yield b.filter(pa.array(keep, pa.bool_()))


def write_store(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes the texts by the tokenizers file at `path` and writes a store to `folder`.

    A null or empty text is its end id alone. Rows with one id stay apart; a null id comes first. An empty table gives an
    empty store. Texts are encoded once. A task sends each of its chunks once, so a chunk that very many documents
    share is a row per task in the one shuffle of ids. Recipes carry digests only; they are dealt out by ranges of
    ids, and each part's first place comes from the sums of the parts before it.
    """
    spark = docs.sparkSession
    encoded = _encoded(docs, path, id_col, text_col)
    dealt = encoded.repartition("deal").sortWithinPartitions("digest").mapInArrow(_once, encoded.schema)
    dealt.drop("deal").write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/data")
    made = spark.read.schema(dealt.drop("deal").schema).parquet(f"{folder}/data").filter("kind = 'recipes'").select("doc_id", "n_tokens", "chunks", "root")
    schema = T.StructType([T.StructField("part", T.IntegerType()), made.schema["doc_id"], T.StructField("at", T.LongType()), *(made.schema[c] for c in ("n_tokens", "chunks", "root"))])

    @K.lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for b in batches:
            ends = before + np.cumsum(b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ends - b.column(2).to_numpy()), *b.columns[2:]], names=schema.names)
            before = int(ends[-1]) if len(ends) else before

    order = (F.col("doc_id").asc_nulls_first(), F.col("root"))
    sorted_ = made.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    sorted_.select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "chunks", "root").mapInArrow(place, schema).write.option("compression", "zstd").parquet(f"{folder}/recipes")
    parts = table(_part_roots(spark, folder, verify=False), "parts")
    start = F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    parts.withColumn("start", start).select("part", "first_doc", "n_docs", "start", "n_tokens", "root").write.parquet(f"{folder}/manifest")


def _part_roots(spark: SparkSession, folder: str, verify: bool = True) -> DataFrame:
    """(part, first_doc, n_docs, n_tokens, root) from the recipes. With `verify`, a document's root that its digests don't give is
    one of zeros here, and so fails its part; without, digests are not read."""
    rows = spark.read.parquet(f"{folder}/recipes")

    @K.lean
    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [r if merkle_root(d) == r else bytes(32) for d, r in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(good, pa.binary())], names=["part", "doc_id", "at", "n_tokens", "root"])

    schema = T.StructType([rows.schema[c] for c in ("part", "doc_id", "at", "n_tokens", "root")])
    per = rows.select("part", "doc_id", "at", "n_tokens", "chunks", "root").mapInArrow(roots, schema) if verify else rows.select(*schema.names)
    out = T.StructType([rows.schema["part"], T.StructField("first_doc", rows.schema["doc_id"].dataType), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("root", T.BinaryType())])

    def fold(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        first = group.column("doc_id").slice(0, 1)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "first_doc": first, "n_docs": [len(group)], "n_tokens": [sum(group.column("n_tokens").to_pylist())], "root": pa.array([merkle_root(group.column("root").to_pylist())], pa.binary())})

    return per.groupBy("part").applyInArrow(fold, out)


# CRC-32 of joined byte strings from the CRCs of the parts: appending n zero bytes is a linear map over bits, given here by
# its columns for n = 1, 2, 4, ...
def _zero_maps(levels: int = 48) -> np.ndarray:
    one = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint64)  # one zero bit
    for _ in range(3):
        one = _through(one, one)
    maps = [one]
    for _ in range(levels - 1):
        maps.append(_through(maps[-1], maps[-1]))
    return np.array(maps)


def _through(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where((values >> np.uint64(bit)) & np.uint64(1), columns[bit], np.uint64(0))
    return out


_MAPS = _zero_maps()


def join_crc(first: np.ndarray, second: np.ndarray, second_bytes: np.ndarray) -> np.ndarray:
    """CRCs of first + second, for arrays of pairs."""
    out, n = first.astype(np.uint64), second_bytes.astype(np.int64)
    for level in range(int(n.max(initial=0)).bit_length()):
        moves = (n >> level) & 1 > 0
        out[moves] = _through(_MAPS[level], out[moves])
    return out ^ second.astype(np.uint64)


def _wide(ids, n: int) -> bytes:
    """Stored ids as little-endian unsigned 32-bit integers."""
    return np.frombuffer(ids, "<u4" if ids.size == 4 * n else "<u2").astype("<u4").tobytes()


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("digest binary, n int, ids binary, kind string").parquet(f"{folder}/data").filter("kind = 'chunks'").select("digest", "n", "ids")


def check_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, n, crc32) of every stored chunk, read from the files; a chunk whose ids don't give its digest fails."""

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = []
            for digest, n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = _wide(ids.as_buffer(), n)
                if hashlib.sha256(raw).digest() != digest:
                    raise ValueError(f"the store is damaged: chunk {digest.hex()}")
                crcs.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crcs, pa.int64())], names=["digest", "n", "crc32"])

    return _chunks(spark, folder).mapInArrow(run, "digest binary, n int, crc32 long")


def _sound(good, what, value):
    """`value`, or an error that names `what`."""
    return F.when(good, value).otherwise(F.raise_error(F.concat(F.lit("the store is damaged: "), what)).cast("long"))


def read_report(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of a store: doc_id, start, n_tokens, ids_crc32 and n_chunks, from the files.

    Every stored id is read and checked against its digest; a document's CRC is joined from its chunks' CRCs in the order
    of its recipe. The Merkle roots of documents and parts are recomputed and held against the manifest, so a chunk, row or
    file that is missing or changed is an error. No ids are shuffled.
    """
    recipes = spark.read.parquet(f"{folder}/recipes")
    parts = recipes.select("part", "at", F.posexplode("chunks").alias("seq", "digest"))
    checked = table(check_chunks(spark, folder), "checked")
    joined = parts.join(checked, "digest", "left").groupBy("part", "at").agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("n", F.lit(-1)).alias("n"), F.coalesce("crc32", F.lit(0)).alias("crc32")))).alias("p"))
    schema = "part int, at long, total long, ids_crc32 long, n_chunks long"

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            size = np.diff(lists.offsets.to_numpy())
            at = np.cumsum(size) - size
            n, crc = lists.flatten().to_numpy().astype(np.int64), b.column(3).flatten().to_numpy()
            total, out = np.zeros(len(size), np.int64), np.zeros(len(size), np.uint64)
            for k in range(int(size.max(initial=0))):
                live = np.flatnonzero(size > k)
                part = at[live] + k
                out[live] = join_crc(out[live], crc[part], 4 * np.maximum(n[part], 0))
                total[live] += np.where(n[part] < 0, -(1 << 40), n[part])  # a chunk that is missing
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total), pa.array(out.astype(np.int64)), pa.array(size.astype(np.int64))], names=["part", "at", "total", "ids_crc32", "n_chunks"])

    sums = joined.select("part", "at", "p.n", "p.crc32").mapInArrow(run, schema)
    now = _part_roots(spark, folder).select(F.col("part").alias("now_part"), F.col("n_docs").alias("now_docs"), F.col("root").alias("now_root"))
    listed = spark.read.parquet(f"{folder}/manifest").select(F.col("part").alias("m_part"), "start", F.col("n_docs"), F.col("root").alias("m_root"))
    compared = listed.join(now, listed["m_part"] == now["now_part"], "full")
    same = F.coalesce((F.col("m_root") == F.col("now_root")) & (F.col("n_docs") == F.col("now_docs")), F.lit(False))
    verified = table(compared.select("m_part", _sound(same, F.concat(F.lit("part "), F.coalesce("m_part", "now_part").cast("string")), F.col("start")).alias("start")), "parts")
    whole = recipes.select(F.col("part").alias("w_part"), F.col("at").alias("w_at"), "doc_id", "n_tokens").join(verified, F.col("w_part") == F.col("m_part"))
    both = whole.join(sums, (F.col("w_part") == F.col("part")) & (F.col("w_at") == F.col("at")), "left")
    what = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return both.select("doc_id", _sound(F.coalesce(F.col("total") == F.col("n_tokens"), F.lit(False)), what, F.col("start") + F.col("w_at")).alias("start"), "n_tokens", "ids_crc32", "n_chunks")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document, put together from its chunks. Chunks are shuffled."""
    recipes = spark.read.parquet(f"{folder}/recipes").join(spark.read.parquet(f"{folder}/manifest").select("part", "start"), "part")
    refs = recipes.select("doc_id", (F.col("start") + F.col("at")).alias("start"), F.posexplode("chunks").alias("seq", "digest"))

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_wide(ids.as_buffer(), n) for n, ids in zip(b.column(1).to_pylist(), b.column(2), strict=True)], pa.binary())], names=["digest", "ids"])

    whole = refs.join(_chunks(spark, folder).mapInArrow(widen, "digest binary, ids binary"), "digest").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("parts"))
    return whole.select("doc_id", "start", F.expr("aggregate(parts.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids"))


def store_report(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes a store of the texts to the shared folder and reports on it from its files."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/vecloom-store-{uuid.uuid4().hex}"
    write_store(docs, folder, path, id_col, text_col)
    return read_report(spark, folder)

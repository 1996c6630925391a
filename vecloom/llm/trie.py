"""The prefix trie of conversations: prefixes are named by chained digests, and nodes are sums over their members."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.llm.storage import table

GROUP, HEADS = 5, 9  # conversations c - c % GROUP to c share their first crc32(c) % HEADS turns
PIECE = 256  # ids to a piece of a digest's input
BLOCK = 4096  # turns of a conversation that one task goes through in order
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, place from 1, key, n_bytes) of each turn, by turn (null first), then role, then the digest of the text.

    `key` is SHA-256 of role and text; texts themselves do not move. Rows are sorted over the whole table, so a
    conversation of any length is spread over tasks; the few that go on in a further task (at most one for each task)
    have their counts before it added.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    keyed = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    ranged = table(keyed, "turns").repartitionByRange(*order).sortWithinPartitions(*order)
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("role").cast("binary"), F.col("digest")), 256))
    placed = table(ranged.select("conv_id", key.alias("key"), "n_bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ranged")
    counts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = counts.withColumn("before", F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).filter("before > 0").drop("n")
    inner = F.row_number().over(W.partitionBy("conv_id", "part").orderBy("at"))
    joined = placed.withColumn("inner", inner).join(F.broadcast(earlier), ["conv_id", "part"], "left")  # a row a task at most
    return table(joined.select("conv_id", (F.col("inner") + F.coalesce("before", F.lit(0))).cast("long").alias("place"), "key", "n_bytes"), "numbered")


def _heads(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length), and their rebuilt turns (conv_id, depth from 1, key, n_bytes, length).

    Of a group's first conversation only the first HEADS - 1 turns are handed to the others.
    """
    own = numbered(turns)
    sizes = own.groupBy("conv_id").agg(F.max("place").alias("n"))
    first = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = sizes.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("first"), F.col("n").alias("first_n"))
    convs = sizes.withColumn("h", _heads(F.col("conv_id"))).withColumn("first", first).join(heads, "first", "left").withColumn("m", F.least("h", F.coalesce("first_n", F.lit(0))))
    convs = table(convs.select("conv_id", "first", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    lent = own.filter(f"place < {HEADS} AND conv_id % {GROUP} = 0").select(F.col("conv_id").alias("first"), "place", "key", "n_bytes")
    lent = lent.join(convs, "first").filter("place <= h").select("conv_id", F.col("place").alias("depth"), "key", "n_bytes", "length")
    rest = own.filter(F.col("place") > _heads(F.col("conv_id"))).join(convs, "conv_id").select("conv_id", (F.col("m") + F.col("place") - F.col("h")).alias("depth"), "key", "n_bytes", "length")
    return convs.select("conv_id", "length"), lent.unionByName(rest)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of (conv_id, block, digest, ...) chained in order of rows within each (conv_id, block)."""
    at, state = None, b""
    for b in batches:
        out = []
        for conv, block, digest in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if at != (conv, block):
                at, state = (conv, block), b""
            state = hashlib.sha256(state + digest).digest()
            out.append(state)
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(out, pa.binary()), *b.columns[3:]], names=b.schema.names)


def prefixes(steps: DataFrame, long: bool, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, prefix, depth, n_bytes, length): `prefix` is a digest of all turns up to this one.

    Digests are chained within blocks of a conversation's turns, in as many tasks as there are; where some conversation is
    `long`, of more than one block, the digests of whole blocks are chained then, and lead those of the blocks behind them.
    """
    at = F.floor((F.col("depth") - 1) / block).alias("block")
    rows = steps.select("conv_id", at, F.col("key").alias("prefix"), "depth", "n_bytes", "length")
    rows = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth").mapInArrow(_chain, "conv_id long, block long, prefix binary, depth long, n_bytes long, length long")
    rows = table(rows, "prefixes")
    if not long:
        return rows
    whole = rows.filter(F.col("depth") % block == 0).select("conv_id", F.lit(0).cast("long").alias("all"), "prefix", (F.col("block") + 1).alias("block"))
    whole = whole.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_chain, "conv_id long, all long, before binary, block long")
    joined = rows.join(F.broadcast(table(whole, "blocks").drop("all")), ["conv_id", "block"], "left")  # a row a block
    led = F.unhex(F.sha2(F.concat("before", "prefix"), 256))
    return table(joined.withColumn("prefix", F.coalesce(led, "prefix")).select(*rows.columns), "prefixes")


def members(prefixed: DataFrame, long: bool) -> DataFrame:
    """(conv_id, depth, length, node, n_convs, parent, child, leaves, saved) of each conversation at each of its nodes.

    `node` and `parent` (null: the root) are named by their smallest conv_id. What a node sums up lies in its members: `child` is 1 if
    the conversation names the node that follows, `leaves` is 1 if it names the childless node where it ends, and `saved` are
    the bytes from here on of its turns in nodes that others name.
    """
    groups = prefixed.groupBy("depth", "prefix").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("length").alias("longest"))
    rows = prefixed.join(groups, ["depth", "prefix"])
    names = F.col("conv_id") == F.col("node")
    rows = rows.select("conv_id", "block", "depth", "length", "node", "n_convs", names.cast("long").alias("names"), F.when(names, 0).otherwise(F.col("n_bytes")).alias("own"), (names & (F.col("longest") == F.col("depth"))).cast("long").alias("leaf"))
    back = W.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    onward = back.rowsBetween(W.unboundedPreceding, W.currentRow)
    walked = rows.select("conv_id", "block", "depth", "length", "node", "n_convs", "names", F.lead("node").over(back).alias("parent"), F.lag("names").over(back).alias("child"), F.sum("leaf").over(onward).alias("leaves"), F.sum("own").over(onward).alias("saved"))
    walked = table(walked, "members")
    if long:
        ends = walked.filter("length > depth OR block > 0").groupBy("conv_id", "block").agg(F.max_by("node", "depth").alias("last"), F.min_by("names", "depth").alias("opens"), F.max("leaves").alias("leaves"), F.max("saved").alias("saved"))
        order = W.partitionBy("conv_id").orderBy("block")
        behind = order.rowsBetween(1, W.unboundedFollowing)
        ends = ends.withColumn("blocks", F.count("*").over(W.partitionBy("conv_id"))).select("conv_id", "block", "blocks", F.lag("last").over(order).alias("parent_"), F.lead("opens").over(order).alias("child_"), F.sum("leaves").over(behind).alias("leaves_"), F.sum("saved").over(behind).alias("saved_"))
        walked = walked.join(F.broadcast(table(ends.filter("blocks > 1"), "blocks")), ["conv_id", "block"], "left")  # a row a block
        walked = walked.withColumns({"parent": F.coalesce("parent", "parent_"), "child": F.coalesce("child", "child_"), **{c: F.col(c) + F.coalesce(f"{c}_", F.lit(0)) for c in ("leaves", "saved")}})
    return walked.select("conv_id", "depth", "length", "node", "n_convs", "parent", F.coalesce("child", F.lit(0)).cast("long").alias("child"), "leaves", "saved")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined runs of at most PIECE ids of one node, from rows in order."""
    for b in batches:
        if not b.num_rows:
            continue
        node, depth, ids = (b.column(i).to_numpy() for i in range(3))
        new = np.flatnonzero((node[1:] != node[:-1]) | (depth[1:] != depth[:-1])) + 1
        starts = [s for lo, hi in zip([0, *new], [*new, len(ids)], strict=True) for s in range(lo, hi, PIECE)]
        ends = [*starts[1:], len(ids)]
        text = [",".join(map(str, ids[s:e].tolist())).encode() for s, e in zip(starts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(node[starts]), pa.array(depth[starts]), pa.array(ids[starts]), pa.array(text, pa.binary())], names=["node", "depth", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node, from its pieces in order; what is held is one state of the hash."""
    at, state, out = None, None, []
    for b in batches:
        for node, depth, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
            if at != (node, depth):
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = (node, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_buffer())
        if out:
            yield _digest_batch(out)
            out = []
    if at is not None:
        yield _digest_batch([(*at, state.hexdigest())])


def _digest_batch(rows: list) -> pa.RecordBatch:
    node, depth, digest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(depth, pa.int64()), pa.array(digest, pa.string())], names=["node", "depth", "ends_sha256"])


def digests(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of (node, depth, conv_id): SHA-256 of the ids, ascending and joined by commas.

    SHA-256 goes through its input in order, so a node's bytes have to meet in one task at last. Ids are sorted and joined
    over all tasks before; that last task then streams a 256th of the rows and holds one piece.
    """
    order = ["node", "depth", "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "node long, depth long, first long, ids binary")
    return pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(_digests, "node long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    All prefixes are named at once, by digests, and grouped; each node is named by its smallest conv_id. A subtree is the rest
    of its top's members, so children, leaves and savings are sums along each conversation, then over members: the number of
    steps does not depend on how many turns conversations share. A node with one member takes its own row.

    Null roles and texts are empty; null turns come first; equal turns are ordered by role, then by the SHA-256 of the text,
    and repeated rows are turns of their own. Rows with a null conv_id belong to no conversation and make no node. Without
    conversations there are no nodes. Other columns are not read.
    """
    convs, steps = rebuilt(turns)
    top = convs.agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.max("length").alias("length")).first()
    long = (top["length"] or 0) > block
    each = members(prefixes(steps, long, block), long)
    one, none, root = F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(top["node"]).cast("long")
    parent = F.when(F.col("depth") == 1, root).otherwise(F.col("parent"))

    shared = each.filter("n_convs > 1").groupBy("depth", "node").agg(F.min(parent).alias("parent"), F.max("n_convs").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    firsts = each.filter("depth = 1").agg(F.sum((F.col("conv_id") == F.col("node")).cast("long")).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    whole = firsts.filter(F.lit(bool(top["n"]))).select(none.alias("depth"), root.alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(top["n"]).cast("long").alias("n_convs"), F.coalesce("n_children", none).alias("n_children"), F.coalesce("n_leaves", one).alias("n_leaves"), F.coalesce("saved", none).alias("saved"))
    ends = each.filter("n_convs > 1 AND length = depth").select("node", "depth", "conv_id")
    ends = ends.unionByName(convs.filter("length = 0").select(root.alias("node"), none.alias("depth"), "conv_id"))
    both = shared.unionByName(whole).join(table(digests(ends), "digests"), ["node", "depth"], "left")
    both = both.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))

    last = F.col("depth") == F.col("length")
    digest = F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOTHING)
    alone = each.filter("n_convs = 1").select("conv_id", "depth", parent.alias("parent_conv_id"), one.alias("n_convs"), (~last).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), digest.alias("ends_sha256"))
    return both.unionByName(alone)


ORACLE_SQL = f"""
WITH ids AS (SELECT conv_id, list_transform(range(8 * length(conv_id::VARCHAR)), lambda i: (ascii(substr(conv_id::VARCHAR, (i // 8 + 1)::INT, 1))::BIGINT >> (i % 8)::INT) & 1) AS bits
             FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS lead,
        xor(list_reduce(bits, lambda s, b: xor(s >> 1, 3988292384 * xor(s & 1, b)), 4294967295::BIGINT), 4294967295) % {HEADS} AS h FROM ids),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS place FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c2 AS (SELECT c.*, least(h, coalesce(n.n, 0)) AS m FROM c LEFT JOIN n ON n.conv_id = c.lead),
r AS (SELECT c2.conv_id, place AS depth, role, text FROM c2 JOIN t ON t.conv_id = c2.lead AND place <= h
      UNION ALL SELECT c2.conv_id, m + place - h, role, text FROM c2 JOIN t ON t.conv_id = c2.conv_id AND place > h),
p AS (SELECT conv_id, depth, strlen(text) AS n_bytes, string_agg(sha256(role || chr(0) || text), '/') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
len AS (SELECT conv_id, max(depth) AS length FROM p GROUP BY conv_id),
nodes AS (SELECT depth, prefix, min(p.conv_id) AS node, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
            sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (length = depth), '')) AS ends_sha256
          FROM p JOIN len ON len.conv_id = p.conv_id GROUP BY depth, prefix),
named AS (SELECT p.conv_id, p.depth, x.node FROM p JOIN nodes x ON x.depth = p.depth AND x.prefix = p.prefix),
up AS (SELECT x.node, x.depth, a.node AS parent, x.n_convs, x.n_bytes, x.ends_sha256 FROM nodes x LEFT JOIN named a ON a.conv_id = x.node AND a.depth = x.depth - 1),
kids AS (SELECT u.*, coalesce(k.n, 0) AS n_children FROM up u LEFT JOIN (SELECT parent, depth, count(*) AS n FROM up GROUP BY ALL) k ON k.parent = u.node AND k.depth = u.depth + 1),
sums AS (SELECT a.node, a.depth, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((k.n_convs - 1) * k.n_bytes)::BIGINT AS saved_tokens
         FROM kids k JOIN named a ON a.conv_id = k.node AND a.depth <= k.depth GROUP BY ALL)
SELECT k.node AS conv_id, k.depth::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM kids k JOIN sums s ON s.node = k.node AND s.depth = k.depth"""

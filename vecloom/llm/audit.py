"""Audit of how filters interact: what each removes at each place of every order they can be applied in."""

from __future__ import annotations

import itertools
import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from vecloom.llm.storage import shared_folder, table

WORDS = r"[^\x20\x09-\x0D]+"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5


def failures(text: Column, repeated: Column) -> dict[str, Column]:
    """The five filters of the query: whether a row fails each. `repeated`: its text is that of a smaller id."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    long = lambda n: n.cast("long")
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * long(F.size(F.array_distinct(words))) < DISTINCT_PERCENT * long(F.size(words)),
        "C": 100 * long(F.regexp_count(text, F.lit("[A-Z]"))) > UPPER_PERCENT * long(F.length(text)),
        "D": text.rlike(r"[#$%&*|]"),
        "E": repeated,
    }


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per row of `docs`: part, fails_A to fails_E, good and toxic (by `labels`). Written once to the shared folder.

    Texts are read once and only their digests move. The smallest id of a text comes from partial minima, and meets the rows
    only of texts that occur under two ids. A null text is empty; a null part is the empty string; a null id is neither
    smaller nor larger than another, so that its row never fails E. Labels of one id are put together (any 1 counts).
    """
    name = lambda c: F.col(f"`{c}`")
    text = F.coalesce(name(text_col), F.lit(""))
    plain = failures(text, F.lit(False))
    rows = docs.select(name(id_col).alias("id"), F.coalesce(name(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *[plain[f].alias(f"fails_{f}") for f in "ABCD"])
    rows = table(rows, "audit-rows")
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("digest", "first")
    marks = labels.filter("quality = 1 OR toxic = 1").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    found = rows.join(first, "digest", "left").join(marks, "id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return table(found.select("part", *[f"fails_{f}" for f in "ABCD"], flag(F.col("id") > F.col("first")).alias("fails_E"), flag(F.col("good")).alias("good"), flag(F.col("toxic")).alias("toxic")), "audit-verdicts")


def _state_name(state: frozenset[str]) -> str:
    return "".join(sorted(state))


def walk(spark: SparkSession, rows: DataFrame, filters: str) -> DataFrame:
    """Goes down the trie of all orders, depth first. The rows that survive a set of filters are one persisted DataFrame, made
    from the survivors one filter before; a node whose set was reached by another order shares what was counted there.

    Returns, per part and set of filters (`state`, its letters sorted): `kept`, and for each further filter how many of the
    survivors it removes (`removed_F`), and of these how many are good and toxic. Parts without survivors have no row.
    """
    path = f"{shared_folder(spark)}/vecloom-audit-{uuid.uuid4().hex}"
    seen: set[frozenset[str]] = set()

    def visit(state: frozenset[str], survivors: DataFrame) -> None:
        seen.add(state)
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        removed = {f: F.col(f"fails_{f}") if f not in state else F.lit(False) for f in filters}
        edges = [F.count_if(c & also).alias(f"{name}_{f}") for f, c in removed.items() for name, also in (("removed", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))]
        survivors.groupBy("part").agg(F.count("*").alias("kept"), *edges).select(F.lit(_state_name(state)).alias("state"), "*").write.mode("append").parquet(path)
        for f in filters:
            if f not in state and state | {f} not in seen:
                visit(state | {f}, survivors.filter(~F.col(f"fails_{f}")))
        survivors.unpersist()

    visit(frozenset(), rows)
    return spark.read.parquet(path)


def audit(rows: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row per part, order of all `filters`, and step: what the step's filter keeps and removes.

    `rows` has part, fails_F for each filter F, good, toxic. Each set of filters is a struct in a map of its part (2 to the
    power of the filters, 32 here), out of which every order reads its steps, so nothing is joined by part. An empty table
    gives no rows.
    """
    spark = rows.sparkSession
    edge = lambda f: F.struct(*[F.col(f"{n}_{f}").alias(n) for n in ("removed", "good", "toxic")]).alias(f)
    states = walk(spark, rows, filters)
    share = lambda f: sum(F.when(F.col("state") == _state_name(frozenset(s)), F.col(f"removed_{f}")).otherwise(0) * math.factorial(k) * math.factorial(len(filters) - 1 - k) for k in range(len(filters)) for s in itertools.combinations([g for g in filters if g != f], k))
    parts = states.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct("kept", *[edge(f) for f in filters])))).alias("states"), *[F.sum(share(f)).alias(f"shapley_{f}") for f in filters])
    steps = []
    for order in itertools.permutations(filters):
        for k, f in enumerate(order):
            before, after = (_state_name(frozenset(order[:n])) for n in (k, k + 1))
            steps.append({"filter_order": "".join(order), "step": k + 1, "filter": f, "before": before, "after": after, "alone": _state_name(frozenset(filters) - {f})})
    rows_of_part = F.inline(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, filter: string, before: string, after: string, alone: string>>"))
    at = lambda state: F.col("states")[F.col(state)]
    pick = lambda of: F.coalesce(*[F.when(F.col("filter") == f, of(f)) for f in filters], F.lit(0)).cast("long")
    return parts.select("*", rows_of_part).select(
        "part",
        "filter_order",
        "step",
        F.coalesce(at("after")["kept"], F.lit(0)).cast("long").alias("kept"),
        pick(lambda f: at("before")[f]["removed"]).alias("removed"),
        (pick(lambda f: F.col("states")[""][f]["removed"]) - pick(lambda f: at("before")[f]["removed"])).alias("redundant"),
        pick(lambda f: at("alone")[f]["removed"]).alias("unique_fails"),
        pick(lambda f: at("before")[f]["good"]).alias("good_lost"),
        pick(lambda f: at("before")[f]["toxic"]).alias("toxic_lost"),
        pick(lambda f: F.col(f"shapley_{f}")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters A to E over `docs`, with the quality and toxic marks of `labels`. Nulls, repeated rows and
    empty tables as in `verdicts` and `audit`; other columns are not read."""
    return audit(verdicts(docs, labels))


def oracle_sql(filters: str = "ABCDE") -> str:
    letters = ", ".join(f"('{f}')" for f in filters)
    return rf"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w,
        min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
v AS (SELECT t.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
        CASE WHEN len(w) < {MIN_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * len(regexp_extract_all(t.text, '[A-Z]')) > {UPPER_PERCENT} * length(t.text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN t.doc_id > t.first THEN 'E' ELSE '' END AS fails
      FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM v GROUP BY ALL),
f AS (SELECT * FROM (VALUES {letters}) x(f)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, range::INT AS step, substr(filter_order, range::INT, 1) AS f, left(filter_order, range::INT - 1) AS before FROM o, range(1, 6)),
j AS (SELECT m.*, s.filter_order, s.step, contains(fails, s.f) AS failing, fails = s.f AS only_this, s.f,
        len(s.before) > 0 AND len(translate(fails, s.before, '')) < len(fails) AS gone FROM m, s),
g AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (failing AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (failing AND gone), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (only_this), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (failing AND NOT gone), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (failing AND NOT gone), 0)::BIGINT AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM g"""


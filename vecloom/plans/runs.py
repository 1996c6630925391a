"""Measured runs of the searches, as the command line has them."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.topk import recall
from vecloom.plans import metrics, search
from vecloom.plans.params import PqParams, SearchParams, StagedParams
from vecloom.sources.catalog import Index
from vecloom.sources.shared import Scratch


def find(index: Index, queries: DataFrame, params: SearchParams) -> DataFrame:
    """(qid, rank, vec_id, dist) by the search that the parameters are of."""
    if isinstance(params, StagedParams):
        return search.staged(index, queries, params).top()
    if isinstance(params, PqParams):
        return search.rerank(index, search.adc_scan(index, queries, params), queries, params.k)
    return search.ivf_flat(index, queries, params)


def measured(index: Index, queries: DataFrame, params: SearchParams, truth: DataFrame | None = None, batches: int = 1) -> tuple[DataFrame, DataFrame, metrics.Meter]:
    """(results, report, meter). Queries are answered in `batches` by hash of qid; each batch is run to its end and timed. `truth`
    (qid, gt) gives the recall; without it every query counts as one without truth."""
    spark, scratch, meter, times = queries.sparkSession, Scratch(), metrics.Meter(queries.sparkSession), []
    queries, parts = search.limited(queries, params), []
    for b in range(batches):
        mine = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(batches)) == b) if batches > 1 else queries
        began = time.perf_counter()
        with meter.running():
            parts.append(scratch.table(meter.counted(f"batch{b}", find(index, mine, params)), "found"))
        times.append((mine.count(), int((time.perf_counter() - began) * 1e6)))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    no_truth = spark.createDataFrame([], "qid long, gt array<long>")
    per_query = recall(found, truth if truth is not None else no_truth, queries, params.k)
    return found, metrics.run_report(per_query, times, meter), meter

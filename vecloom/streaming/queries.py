"""Searching a stream of queries against a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecloom.plans.params import SearchParams
from vecloom.plans.search import ivf_flat
from vecloom.sources.catalog import Index


def search_stream(index: Index, queries: DataFrame, params: SearchParams, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the results of each micro-batch of `queries` (qid, q) to the Parquet folder `out`.

    Queries are independent of one another, so the stream keeps no state. A batch that is repeated after a failure writes
    to the folder of its number again, so results are whole and not doubled.
    """

    def answer(batch: DataFrame, number: int) -> None:
        found = ivf_flat(index, batch, params)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()


def latency_windows(results: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Queries and mean latency by time window of a stream (finished TIMESTAMP, latency_us), late rows by watermark."""
    rows = results.withWatermark("finished", late).groupBy(F.window("finished", width).alias("w"))
    return rows.agg(F.count("*").alias("queries"), F.avg("latency_us").alias("avg_latency_us")).select("w.start", "w.end", "queries", "avg_latency_us")

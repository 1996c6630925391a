"""What a run reports: recall, latency, queries per second, rows and bytes by stage."""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

QUANTILES = (0.5, 0.95, 0.99)
STAGE = "stage_id int, name string, tasks int, run_ms long, input_rows long, input_bytes long, output_rows long, output_bytes long, shuffle_read_bytes long, shuffle_write_bytes long, spilled_bytes long"


def mean_recall() -> Column:
    """Mean over all queries; a recall of -1 (no truth) adds nothing, but counts as a query."""
    return F.sum(F.greatest("recall", F.lit(0.0))) / F.count("*")


def run_summary(per_query: DataFrame, wall_us: int | None = None) -> DataFrame:
    """One row: queries, mean recall, results per query, and queries per second if the wall time is given."""
    row = per_query.agg(F.count("*").alias("queries"), mean_recall().alias("recall"), F.avg("n_found").alias("avg_found"))
    return row.withColumn("qps", F.lit(None).cast("double") if wall_us is None else F.col("queries") * 1e6 / wall_us)


def prune_ratio(n_in: Column, n_out: Column) -> Column:
    """1 - out / in; 0 if nothing came in."""
    return F.when(n_in > 0, 1 - n_out / n_in).otherwise(F.lit(0.0))


def flat_bytes(candidates: Column, dim: int) -> Column:
    return candidates * dim * 4


def pq_bytes(scanned: Column, reranked: Column, m: int, dim: int) -> Column:
    return scanned * m + reranked * dim * 4


@dataclass
class Meter:
    """Measures parts of a run: wall time, what Spark counted in each stage, and rows by `counted`."""

    spark: SparkSession
    wall_us: int = 0
    stages: list[tuple] = field(default_factory=list)
    observed: dict[str, Observation] = field(default_factory=dict)
    groups: list[str] = field(default_factory=list)

    @contextlib.contextmanager
    def running(self) -> Iterator[None]:
        """Times what runs in here and keeps the figures of its stages. Jobs are told apart by a group of their own."""
        context, group = self.spark.sparkContext, f"vecloom-{uuid.uuid4().hex}"
        before = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description")}
        context.setJobGroup(group, "measured run")
        began = time.perf_counter()
        try:
            yield
        finally:
            self.wall_us += int((time.perf_counter() - began) * 1e6)
            for k, v in before.items():
                context.setLocalProperty(k, v)
            self.groups.append(group)
            self._collect(group)

    def _collect(self, group: str) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        store = self.spark.sparkContext._jsc.sc().statusStore()
        wanted = {s for j in self.spark.sparkContext.statusTracker().getJobIdsForGroup(group) for s in self.spark.sparkContext.statusTracker().getJobInfo(j).stageIds}
        for i in sorted(wanted):
            try:
                s = store.lastStageAttempt(i)
            except Py4JJavaError:  # never begun, or no longer retained
                continue
            if s.numCompleteTasks():
                self.stages.append((i, s.name()[:80], s.numCompleteTasks(), s.executorRunTime(), s.inputRecords(), s.inputBytes(), s.outputRecords(), s.outputBytes(), s.shuffleReadBytes(), s.shuffleWriteBytes(), s.diskBytesSpilled()))

    def counted(self, name: str, rows: DataFrame) -> DataFrame:
        """`rows`, counted while they pass."""
        self.observed[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        return rows.observe(self.observed[name], F.count("*").alias("rows"))

    def rows(self, name: str) -> int:
        """How many rows `counted` saw; waits until an action has run over them."""
        return self.observed[name].get["rows"]

    def stage_figures(self) -> DataFrame:
        """Per Spark stage of the run: tasks, their time, rows and bytes read and written, shuffled and spilled."""
        return self.spark.createDataFrame(self.stages, STAGE)

    def total(self, column: str) -> int:
        at = [c.split()[0] for c in STAGE.split(", ")].index(column)
        return sum(s[at] for s in self.stages)


def latency_sketch(rows: DataFrame, by: list[str] | None = None, column: str = "latency_us") -> DataFrame:
    """A sketch of latencies (and their number) per group, for `latency_quantiles`; sketches of parts of a run, or of many runs,
    can be kept and merged."""
    return rows.groupBy(*(by or [])).agg(F.kll_sketch_agg_bigint(F.col(column).cast("long")).alias("sketch"), F.count(column).alias("n"))


def latency_quantiles(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(n, p50_us, p95_us, p99_us) of merged sketches."""
    merged = sketches.groupBy(*(by or [])).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"), F.sum("n").alias("n"))
    return merged.select(*(by or []), "n", *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias(f"p{round(q * 100)}_us") for q in QUANTILES])


def run_report(per_query: DataFrame, batches: list[tuple[int, int]], meter: Meter) -> DataFrame:
    """One row for a run: queries, recall, avg_found, wall_us, qps, latency quantiles, and rows and bytes that it read, wrote and
    shuffled. `batches` are (queries, wall_us): a query's latency is that of the batch it is answered with."""
    spark = meter.spark
    each = spark.createDataFrame(batches, "queries long, latency_us long").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "queries"))) if batches else spark.createDataFrame([], "latency_us long")
    quantiles = latency_quantiles(latency_sketch(each))
    figures = {c: meter.total(c) for c in ("input_rows", "input_bytes", "output_bytes", "shuffle_write_bytes", "spilled_bytes")}
    row = run_summary(per_query, max(1, meter.wall_us)).crossJoin(quantiles.drop("n"))  # one row each
    return row.select("*", F.lit(meter.wall_us).alias("wall_us"), *[F.lit(v).alias(k) for k, v in figures.items()])


def write_csv(report: DataFrame, path: str) -> None:
    """A report as CSV files with a header, after those that are there."""
    report.write.mode("append").csv(path, header=True)

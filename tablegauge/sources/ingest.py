"""Run logs read once: new ones are added to a store of samples and of report cells.

A store is a folder of the shared file system. A file stream remembers which logs it has read; each of its batches becomes a
folder of samples and a folder of cells, written under the number of the batch, so a batch that is repeated after a failure
replaces what it left. Cells keep the run they come from, and for distinct counts a sketch. Reports merge the cells of all
batches, a few rows a run, and leave out runs that a newer log of the same cell of the run matrix has replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge import fixed_values as fv
from tablegauge.plans import report
from tablegauge.sources import runlogs
from tablegauge.sources.schemas import RUN_LOG_SCHEMA

LOGS_A_BATCH = 10_000
# Distinct texts are counted by HLL sketches of 2**12 registers: 1.6 % standard error, exact for a few hundred texts.
SKETCH_SIZE = 12

_RUN = ["run", "started"]
_SKETCHED = ["intent", "input"]
_EXTRA = ["first_epoch", "epochs", "max_samples"]


def ingest(spark: SparkSession, logs: str, store: str, logs_a_batch: int = LOGS_A_BATCH) -> int:
    """Add the logs in a folder that the store has not seen yet; the number of logs that were read."""
    def add(batch: DataFrame, number: int) -> None:
        samples = f"{store}/samples/batch={number}"
        runlogs.log_samples(batch).write.mode("overwrite").parquet(samples)
        stored = batch.sparkSession.read.parquet(samples)
        run_cells(stored).write.mode("overwrite").parquet(f"{store}/cells/batch={number}")

    stream = spark.readStream.schema(RUN_LOG_SCHEMA).option("maxFilesPerTrigger", logs_a_batch).json(logs)
    running = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{store}/progress").trigger(availableNow=True).start()
    running.awaitTermination()
    return sum(progress["numInputRows"] for progress in running.recentProgress)


def stored_samples(spark: SparkSession, store: str) -> DataFrame:
    """All samples of a store, as ``log_samples`` gives them."""
    return spark.read.parquet(f"{store}/samples").drop("batch")


def run_cells(samples: DataFrame, epoch: int = 1) -> DataFrame:
    """Counts, score sums and sketches of successful logs by run and report dimension."""
    facts = runlogs.facts_from_logs(runlogs.successful(samples), runlogs.run_key().alias("run"))
    facts = facts.withColumn("first_epoch", F.coalesce(F.col("epoch") == epoch, F.lit(False)))
    return facts.groupBy(*_RUN, *report.DIMENSIONS, *_EXTRA).agg(
        *report.sums(), *[F.hll_sketch_agg(text, SKETCH_SIZE).alias(f"{text}_sketch") for text in _SKETCHED])


def current(cells: DataFrame) -> DataFrame:
    """Cells of the newest log of every cell of the run matrix, each of them once, whatever batch it came with."""
    dated = cells.withColumn("_at", runlogs.start_time("started"))
    newest = dated.groupBy("run").agg(F.max("_at").alias("_newest"))
    return dated.join(newest, "run").where(F.col("_at") == F.col("_newest")).drop("_at", "_newest")


def kept_cells(spark: SparkSession, store: str, keys: Sequence[str] = report.DIMENSIONS) -> DataFrame:
    """Cells for the tables of ``report``, from the store alone."""
    return merged(current(spark.read.parquet(f"{store}/cells")), keys)


def merged(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells with fewer dimensions, or of several batches, by sums and unions."""
    columns = [c for c in cells.columns if c.startswith(("sum_", "n_")) or c in ("requests", "errors", "api_calls", "retries")]
    return cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns],
                                    *[F.hll_union_agg(f"{text}_sketch").alias(f"{text}_sketch") for text in _SKETCHED])


def _estimate(sketch: str) -> Column:
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(sketch)), F.lit(0))


def family_coverage(cells: DataFrame) -> DataFrame:
    """Like ``report.family_coverage``, from cells: distinct intents and phrasings of the first epoch, as sketches estimate them."""
    order = F.array_position(F.array(*[F.lit(f) for f in fv.FAMILY_ORDER]), F.col("family"))
    return cells.where("first_epoch").groupBy("family").agg(
        _estimate("intent_sketch").alias("intents"), _estimate("input_sketch").alias("phrasings")) \
        .select(order.cast("int").alias("position"), "family", "intents", "phrasings").orderBy("position")


def run_facts(cells: DataFrame) -> DataFrame:
    """Like ``report.run_facts``, from cells; phrasings are estimated, all else is exact."""
    reduced = cells.groupBy("model", "config").agg(
        F.min(F.expr("try_cast(left(started, 10) as date)")).alias("day"), F.sum("requests").alias("n"),
        F.hll_union_agg(F.when(F.col("first_epoch"), F.col("input_sketch"))).alias("input_sketch"))
    return reduced.agg(F.min("day").cast("string").alias("first_date"), F.count_distinct("model").alias("models"),
                       F.count_distinct("config").alias("configs"), _estimate("input_sketch").alias("phrasings"),
                       F.sum("n").alias("requests"))

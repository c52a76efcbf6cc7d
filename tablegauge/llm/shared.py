"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegauge.workdir import new_path

# White space and words are those of the contracts: ASCII only, so bytes.split() finds the same words.
SPACES = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact name, whatever else the table holds (``Text`` beside ``text``, or twice)."""
    places = [df.columns.index(name) for name in names]
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(
        *[F.col(f"_{place}").alias(name) for place, name in zip(places, names)])


def positional(df: DataFrame) -> DataFrame:
    """The same table with columns named by their place, so that names can't clash with those an operator adds."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps reuse it, and lost executors don't undo it."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_vocabulary() -> str:
    """Place of the word-level vocabulary on this machine; every executor has the same package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def dense_positions(df: DataFrame, group: str, order: list[str], name: str, rows_per_task: int = 200_000) -> DataFrame:
    """Number the rows of every group from 0 without gaps, never with a whole group in one task.

    Rows of a group are dealt to sub-groups by a hash of ``order``; sub-groups are counted (with partial sums), a running
    sum over the counts gives each its first number, and only rows within a sub-group are sorted. Ties in ``order`` get
    distinct numbers.
    """
    total = df.count()
    parts = max(1, -(-total // rows_per_task), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("_sub", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(group, "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col(group).alias("_group"), F.col("_sub").alias("_sub2"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(group, "_sub").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1)
    return (ranked.join(bases, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_sub") == F.col("_sub2")))
            .withColumn(name, (F.col("_base") + F.col("_rank")).cast("long"))
            .drop("_sub", "_rank", "_base", "_group", "_sub2"))

"""Spend: per request, per model from measured tokens, for cohorts, and against rate limits.

Prices and usage profiles are price-list sized. They are joined without a broadcast
hint: Spark checks the size of the side before it broadcasts.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge import fixed_values as fv

PRICE_SCHEMA = "model string, p_in double, p_out double, p_cached double"
USAGE_SCHEMA = "model string, calls double, inp bigint, out bigint, cached bigint"


def price_table(spark: SparkSession, prices: Iterable[fv.Price] = fv.PRICES) -> DataFrame:
    return spark.createDataFrame(list(prices), PRICE_SCHEMA)


def usage_table(spark: SparkSession, usage: Iterable[fv.Usage] = fv.USAGE) -> DataFrame:
    return spark.createDataFrame(list(usage), USAGE_SCHEMA)


def tokens_cost(inp: Column, out: Column, cached: Column) -> Column:
    """Dollars for token counts at the row's prices; no cached price, no cached charge."""
    return (inp * F.col("p_in") + out * F.col("p_out") + cached * F.coalesce("p_cached", F.lit(0.0))) / 1e6


def request_cost(usage: DataFrame, prices: DataFrame, history_factor: float = 1.0,
                 name: str = "usd") -> DataFrame:
    """Cost of one request per model; conversation history scales input and cached tokens only."""
    h = F.lit(float(history_factor))
    return usage.join(prices, "model").withColumn(
        name, tokens_cost(F.col("inp") * h, F.col("out"), F.col("cached") * h))


def requests_per_dollar(costs: DataFrame) -> DataFrame:
    return costs.select("model", "calls", "inp", "out", "cached", "usd",
                        F.try_divide(F.lit(1.0), F.col("usd")).alias("per_dollar"))


def measured_usage(runs: DataFrame) -> DataFrame:
    """Per model: samples, retries, token sums, and how many samples reported tokens at all.

    Once any sample of a model has tokens, its other samples count as zero.
    """
    reported = (F.coalesce("tokens_in", F.lit(0)) != 0) | (F.coalesce("tokens_out", F.lit(0)) != 0)

    def total(column: str) -> Column:
        return F.coalesce(F.sum(F.when(reported, F.col(column))), F.lit(0))

    return runs.groupBy("model").agg(
        F.count(F.lit(1)).alias("samples"), F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"),
        total("tokens_in").alias("tokens_in"), total("tokens_out").alias("tokens_out"),
        total("tokens_cached").alias("tokens_cached"), F.count_if(reported).alias("measured_samples"))


def spend(measured: DataFrame, usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Dollars per model: measured tokens where there are any, else samples and half of the
    retries at the typical cost of a request. A measured model without a price costs 0; an
    unmeasured one has no cost (NULL)."""
    typical = request_cost(usage, prices, name="typical").select("model", "typical")
    zero = F.lit(0.0)
    actual = (F.col("tokens_in") * F.coalesce("p_in", zero) + F.col("tokens_out") * F.coalesce("p_out", zero)
              + F.col("tokens_cached") * F.coalesce("p_cached", zero)) / 1e6
    estimate = (F.col("samples") + 0.5 * F.col("retries")) * F.col("typical")
    return (measured.join(prices, "model", "left").join(typical, "model", "left")
            .select("model", "samples", "retries", "measured_samples",
                    F.when(F.col("measured_samples") > 0, actual).otherwise(estimate).alias("usd")))


def spend_with_total(spends: DataFrame) -> DataFrame:
    """Spend per model in order of name, then the grand total."""
    return (spends.rollup("model").agg(F.sum("samples").alias("samples"), F.sum("retries").alias("retries"),
                                       F.sum("usd").alias("usd"), F.grouping("model").alias("is_total"))
            .orderBy("is_total", "model")
            .select(F.when(F.col("is_total") == 1, F.lit(fv.TOTAL_LABEL)).otherwise(F.col("model")).alias("model"),
                    "samples", "retries", "usd"))


def cohort_costs(costs: DataFrame, scenarios: Sequence[tuple[str, int]] = fv.SCENARIOS,
                 students: int = fv.COHORT_SIZE) -> DataFrame:
    """Dollars per scenario and model, long; ``costs`` should carry the history factor."""
    rows = F.array(*[F.struct(F.lit(name).alias("scenario"), F.lit(n).alias("requests")) for name, n in scenarios])
    return costs.select("model", "usd", F.explode(rows).alias("s")).select(
        "s.scenario", "s.requests", "model", (students * F.col("s.requests") * F.col("usd")).alias("cohort_usd"))


def cohort_table(costs: DataFrame, models: Sequence[str], scenarios: Sequence[tuple[str, int]] = fv.SCENARIOS,
                 students: int = fv.COHORT_SIZE) -> DataFrame:
    """Scenario x model table of cohort costs for a given list of models."""
    return (cohort_costs(costs, scenarios, students).groupBy("scenario", "requests")
            .pivot("model", list(models)).agg(F.max("cohort_usd")))


def rate_limits(usage: DataFrame, free: Mapping[str, int] = fv.FREE_TIER,
                paid: Mapping[str, int] = fv.PAID_TIER) -> DataFrame:
    """Tokens per request, whole requests per day and whether one request fits a minute on the
    free tier, whole requests per minute on the paid one."""
    tokens = F.col("inp") + F.col("out") + F.col("cached")

    def whole(limit: int) -> Column:
        return F.floor(F.try_divide(F.lit(limit), F.col("tokens"))).cast("bigint")

    return usage.select("model", tokens.alias("tokens")).select(
        "model", "tokens", whole(free["tpd"]).alias("free_requests_per_day"),
        (F.col("tokens") <= free["tpm"]).alias("free_minute_ok"),
        whole(paid["tpm"]).alias("paid_requests_per_minute"))


def burst_tokens(usage: DataFrame, users: int = fv.COHORT_SIZE) -> DataFrame:
    """Tokens needed in one minute when all users send one request at once."""
    tokens = F.col("inp") + F.col("out") + F.col("cached")
    return usage.select("model", (users * tokens).alias("tokens_per_minute"))


def usage_profile(runs: DataFrame) -> DataFrame:
    """Usage of an average request per model, measured from runs."""
    def mean(column: str) -> Column:
        return F.round(F.avg(F.coalesce(column, F.lit(0)))).cast("bigint")

    return runs.groupBy("model").agg(F.avg("api_calls").alias("calls"), mean("tokens_in").alias("inp"),
                                     mean("tokens_out").alias("out"), mean("tokens_cached").alias("cached"))

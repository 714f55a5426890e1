"""Macro reports: totals, shares, corridors, year-over-year changes and blended slates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadstone.functions.text import exact_sum


def totals(flows: DataFrame, amounts: list[str]) -> DataFrame:
    """One row: the number of rows and the sum of each amount, in one scan."""
    return flows.agg(F.count(F.lit(1)).alias("n_rows"), *[exact_sum(a, 4).alias(f"total_{a}") for a in amounts])


def by_key_with_share(flows: DataFrame, key: str, amount: str) -> DataFrame:
    """The amount by key and its percentage of all; the window runs over the few aggregated rows."""
    g = flows.groupBy(key).agg(exact_sum(amount, 4).alias("amount"))
    whole = exact_sum("amount", 4, over=W.partitionBy())
    return g.select(key, "amount", (F.lit(100.0) * F.col("amount") / F.nullif(whole, F.lit(0.0))).alias("share_pct"))


def top(flows: DataFrame, keys: list[str], amount: str, n: int) -> DataFrame:
    """The n keys with the largest amount; ties by key."""
    return flows.groupBy(*keys).agg(exact_sum(amount, 4).alias("amount")).orderBy(F.col("amount").desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys]).limit(n)


def top_per_group(flows: DataFrame, group: str, keys: list[str], amount: str, n: int) -> DataFrame:
    """The n largest keys of each group with their rank; ties by key."""
    g = flows.groupBy(group, *keys).agg(exact_sum(amount, 4).alias("amount"))
    w = W.partitionBy(group).orderBy(F.col("amount").desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys])
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def year_over_year(flows: DataFrame, key: str, year: str, amount: str, first: int, second: int) -> DataFrame:
    """Amounts of two years by key and the change in percent (null where the first is 0 or missing), in one aggregation."""
    part = lambda y: exact_sum(F.when(F.col(year) == y, F.col(amount)), 4)
    g = flows.filter(F.col(year).isin(first, second)).groupBy(key).agg(part(first).alias("amount_first"), part(second).alias("amount_second"))
    return g.withColumn("change_pct", F.lit(100.0) * (F.col("amount_second") - F.col("amount_first")) / F.nullif("amount_first", F.lit(0.0)))


def blended(a: DataFrame, b: DataFrame, key: str, weights: tuple[float, float]) -> DataFrame:
    """Two shares (key, share_pct) by key, full outer, blended and ranked; a missing share counts 0."""
    j = a.select(key, F.col("share_pct").alias("a_pct")).join(b.select(key, F.col("share_pct").alias("b_pct")), key, "full")
    j = j.select(key, F.coalesce("a_pct", F.lit(0.0)).alias("a_pct"), F.coalesce("b_pct", F.lit(0.0)).alias("b_pct"))
    j = j.withColumn("score", F.lit(weights[0]) * F.col("a_pct") + F.lit(weights[1]) * F.col("b_pct"))
    return j.withColumn("rank", F.row_number().over(W.partitionBy().orderBy(F.col("score").desc(), F.col(key).asc_nulls_last())))  # a row per code

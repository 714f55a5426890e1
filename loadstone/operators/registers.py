"""The catalogue's registers: file ages, refreshes, gaps, missing data by category and dated deliveries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadstone.session import materialize


def age_days(modified: Column, as_of: Column) -> Column:
    """Days between two times, with their fraction."""
    return (as_of.cast("timestamp").cast("double") - modified.cast("timestamp").cast("double")) / F.lit(86400.0)


def needs_refresh(bad: Column, age: Column, after_days: Column) -> Column:
    """Whether a file has to be fetched again: it is bad or missing, or it is older than it may be (0 or less: never)."""
    return F.when(F.coalesce(bad, F.lit(True)), True).when(after_days <= 0, False).otherwise(F.coalesce(age >= after_days, F.lit(True)))


def rounded(number: Column) -> Column:
    """A number as bigint, rounded half away from zero, not cut; what isn't a number or too large is null."""
    return F.round(number).try_cast("bigint")


def months_before(as_of: Column, n: int) -> Column:
    """The n last whole months before a date, newest first, as YYYYMM."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.date_format(F.add_months(F.trunc(as_of, "month"), -i), "yyyyMM"))


def described(df: DataFrame) -> DataFrame:
    """The columns of a table: position, column, type, nullable; nothing is read."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, nullable boolean")


def gap_register(expected: DataFrame, inventory: DataFrame, as_of: Column) -> DataFrame:
    """Each expected file and what is to be done: family, status (missing, bad, stale or ok), age in days, priority, action.

    `expected`: family, refresh_days, priority; `inventory`: family, reason (null if valid), modified; of several files of a
    family the newest valid one counts. Families that nobody expects are listed as discovered.
    """
    best = inventory.groupBy("family").agg(F.max(F.when(F.col("reason").isNull(), F.col("modified"))).alias("modified"), F.max("reason").alias("reason"), F.count(F.lit(1)).alias("files"))
    j = expected.join(best, "family", "full").withColumn("age", age_days(F.col("modified"), as_of))
    status = (
        F.when(F.col("refresh_days").isNull(), "discovered").when(F.col("files").isNull(), "missing").when(F.col("modified").isNull(), "bad")
        .when(needs_refresh(F.lit(False), F.col("age"), F.col("refresh_days")), "stale").otherwise("ok")
    )
    action = F.when(F.col("status").isin("missing", "bad"), "download").when(F.col("status") == "stale", "refresh").when(F.col("status") == "discovered", "review").otherwise("none")
    return j.withColumn("status", status).withColumn("action", action).select("family", "status", "age", F.coalesce("priority", F.lit(99)).alias("priority"), "action")


def missing_by_category(parts: dict[str, tuple[DataFrame, DataFrame, int]], key: str) -> DataFrame:
    """What is expected and not there, by category: category, priority, expected, missing and the least missing key.

    parts: category to (expected, present, priority), both with `key`. Null keys aren't expected.
    """
    rows = []
    for category, (expected, present, priority) in parts.items():
        wanted = expected.select(key).filter(F.col(key).isNotNull()).distinct()
        there = present.select(F.col(key).alias("there")).filter(F.col("there").isNotNull()).distinct()
        j = wanted.join(there, F.col(key) == F.col("there"), "left")
        gone = F.when(F.col("there").isNull(), F.col(key))
        rows.append(j.agg(F.count(F.lit(1)).alias("expected"), F.count(gone).alias("missing"), F.min(gone).alias("first_missing")).select(F.lit(category).alias("category"), F.lit(priority).alias("priority"), "*"))
    return reduce(DataFrame.unionByName, rows)


def absorb(delivery: DataFrame, path: str, release: Column) -> DataFrame:
    """Take a delivery into the dated table at `path`, one partition a release, and return the table.

    A release that comes again replaces its partition and no other, so a retried or repeated ingest adds nothing twice.
    """
    delivery.withColumn("release", release).write.mode("overwrite").partitionBy("release").option("partitionOverwriteMode", "dynamic").parquet(path)
    return delivery.sparkSession.read.parquet(path)


def newest_delivery(absorbed: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each key's newest release; ties in it all stay."""
    newest = absorbed.groupBy(*keys).agg(F.max("release").alias("newest"))
    on = reduce(lambda a, b: a & b, [absorbed[k].eqNullSafe(newest[k]) for k in keys]) & (absorbed["release"] == newest["newest"])
    return absorbed.join(newest, on, "left_semi")


def copied(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table passed through unchanged: read and written as it is, returned from its copy."""
    return materialize(spark.read.parquet(path))

"""Per-key results under heavy keys by value-frequency compression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadstone.session import materialize


def pair_frequencies(df: DataFrame, left: str, right: str, weight: str) -> DataFrame:
    """One row per distinct (left, right) value pair with n rows, and the summed weight.

    This is the compression: however many rows a key has, only its distinct values travel on, and they are spread by
    key *and* value, so no task carries a heavy key. Weights are summed as decimal(18,6); NaN counts as no weight; a
    weight beyond that range goes to a double sum. Null keys are kept as keys.
    """
    clean = F.when(~F.isnan(weight), F.col(weight))
    exact = clean.try_cast("decimal(18,6)")
    return (
        df.select(F.col(left).alias("l"), F.col(right).alias("r"), exact.alias("exact"), F.when(exact.isNull(), clean).alias("rest"))
        .groupBy("l", "r")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("exact").alias("exact"), F.sum("rest").alias("rest"))
    )


def per_key_results(df: DataFrame, keys: tuple[str, str] = ("dst_id", "src_id"), weight: str = "weight") -> DataFrame:
    """Rows, total weight, distinct partners and the frequency of the commonest partner, per value of either key column.

    Columns: key_column, key_value, n_rows, total_weight, n_partners (distinct non-null partners), mode_rows. Every pair is
    compressed once and then counts for its left and its right key, so there is one scan and one shuffle of pairs. All
    statistics are mergeable, so the partial aggregation leaves one row per key and input partition, whatever its skew. A
    null key is reported as a row with key_value null; an empty table gives no rows.
    """
    pairs = pair_frequencies(df, keys[0], keys[1], weight)
    sides = F.array(*[F.struct(F.lit(name).alias("key_column"), F.col(key).alias("key_value"), F.col(value).isNotNull().alias("has")) for name, key, value in ((keys[0], "l", "r"), (keys[1], "r", "l"))])
    sided = pairs.select(F.explode(sides).alias("s"), "n", "exact", "rest").select("s.*", "n", "exact", "rest")
    total = F.coalesce(F.sum("exact").cast("double"), F.lit(0.0)) + F.coalesce(F.sum("rest"), F.lit(0.0))
    partner = F.when(F.col("has"), F.col("n"))
    return sided.groupBy("key_column", "key_value").agg(F.sum("n").alias("n_rows"), total.alias("total_weight"), F.count(partner).alias("n_partners"), F.max(partner).alias("mode_rows"))


def key_modes(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent non-null value of each key and its number of rows: key_value, mode, n; ties: the least value.

    Exact, from the compressed pairs: first the largest frequency of a key, then the least value that has it. Keys without
    any value give no row.
    """
    pairs = df.select(F.col(key).alias("key_value"), F.col(value).alias("v")).filter(F.col("v").isNotNull()).groupBy("key_value", "v").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by("v", F.struct(-F.col("n"), F.col("v")))
    return pairs.groupBy("key_value").agg(best.alias("mode"), F.max("n").alias("n"))


def heavy_keys(df: DataFrame, share: float = 0.01, keys: tuple[str, str] = ("dst_id", "src_id"), weight: str = "weight") -> DataFrame:
    """The non-null key values that hold at least `share` of all rows: key_column, key_value.

    The results per key are written once to the shared folder; the number of all rows, one number, is their sum over one key
    column, null keys included, so the table itself is read once.
    """
    results = materialize(per_key_results(df, keys, weight).select("key_column", "key_value", "n_rows"))
    rows = results.filter(F.col("key_column") == keys[0]).agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    return results.filter(F.col("key_value").isNotNull() & (F.col("n_rows") >= rows * share)).select("key_column", "key_value")


def weighted_percentiles(df: DataFrame, key: str, value: str, fractions: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Exact nearest-rank percentiles of `value` per key, from distinct values weighted by their frequency.

    Two levels keep any window small: distinct values fall into ordered logarithmic buckets; the running totals of a
    key's buckets (some thousands at most) tell which bucket holds each rank, and only values of those buckets are
    ordered. Null and NaN values don't count. Columns: key_value, n_values, p<percent> for each fraction; keys without
    any value give no row.
    """
    counted = (
        df.select(F.col(key).alias("key_value"), F.col(value).cast("double").alias("v"))
        .filter(F.col("v").isNotNull() & ~F.isnan("v"))
        .groupBy("key_value", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", (F.signum("v") * F.floor(F.log2(1 + F.abs("v")) * 64)).cast("int"))
    )
    by_key = W.partitionBy("k").orderBy("b")
    buckets = counted.groupBy(F.col("key_value").alias("k"), F.col("bucket").alias("b")).agg(F.sum("n").alias("bn"))
    buckets = buckets.withColumn("before", F.sum("bn").over(by_key.rowsBetween(W.unboundedPreceding, -1))).withColumn("n_values", F.sum("bn").over(W.partitionBy("k")))
    buckets = buckets.withColumn("before", F.coalesce("before", F.lit(0)))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.ceil(F.col("n_values") * F.lit(q)).alias("rank")) for i, q in enumerate(fractions)])
    wanted = buckets.withColumn("ranks", F.filter(ranks, lambda r: (r["rank"] > F.col("before")) & (r["rank"] <= F.col("before") + F.col("bn")))).filter(F.size("ranks") > 0)
    inside = W.partitionBy("key_value", "bucket").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    values = (
        counted.join(wanted, F.col("key_value").eqNullSafe(F.col("k")) & (F.col("bucket") == F.col("b")))
        .withColumn("upto", F.col("before") + F.sum("n").over(inside))
        .select("key_value", "n_values", "v", "upto", F.explode("ranks").alias("r"))
        .filter(F.col("upto") >= F.col("r.rank"))
    )
    picks = [F.min(F.when(F.col("r.i") == i, F.col("v"))).alias(f"p{round(q * 100)}") for i, q in enumerate(fractions)]
    return values.groupBy("key_value", "n_values").agg(*picks)

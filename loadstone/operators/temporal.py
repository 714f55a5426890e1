"""Month-over-month change scores, snapshot months and series tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadstone.functions import text as tx
from loadstone.operators.graph import base_type


def monthly_weights(events: DataFrame, by_state: bool = False) -> DataFrame:
    """Haul weight by month and commodity code (and state); months must be YYYYMM, blank and unknown states are left out."""
    code, state = F.get_json_object("attrs_json", "$.sctg2"), F.get_json_object("attrs_json", "$.state")
    hauls = events.filter((base_type() == "observed_haul") & (F.col("event_grain") == "month") & F.col("event_time").rlike("^[0-9]{6}$"))
    rows = hauls.select(F.col("event_time").alias("month"), code.alias("code"), state.alias("state"), "weight").filter((F.col("code") != "") & F.col("code").isNotNull())
    if by_state:
        rows = rows.filter(F.col("state").isNotNull() & ~F.col("state").isin("", "UNK"))
    keys = ["month", "code", *["state"] * by_state]
    return rows.groupBy(*keys).agg(F.coalesce(tx.exact_sum("weight"), F.lit(0.0)).alias("weight"))


def shares(macro: DataFrame, key: str, amount: str) -> DataFrame:
    """Percentage of the total by key; the input is computed once, the total over its few aggregated rows."""
    g = macro.groupBy(key).agg(tx.exact_sum(amount).alias("amount"))
    total = tx.exact_sum("amount", over=W.partitionBy())  # over a row per key
    return g.select(key, (F.lit(100.0) * F.col("amount") / F.nullif(total, F.lit(0.0))).alias("share"))


def change_scores(monthly: DataFrame, share: DataFrame, keys: list[str]) -> DataFrame:
    """Change of each key's weight against its previous row, with the macro share and a score from 0 to 100.

    Score: half the relative change, 0.3 of the share and 0.2 of the weight in thousands up to 50. `adjacent` tells whether
    the previous row is the previous calendar month; months without rows are bridged. Share: code, share.
    """
    w = W.partitionBy(*keys).orderBy("month")
    prior = F.lag("weight").over(w)
    before = F.lag("month").over(w)
    next_month = F.date_format(F.add_months(F.to_date(before, "yyyyMM"), 1), "yyyyMM")
    rows = monthly.withColumn("prior_weight", prior).withColumn("adjacent", next_month == F.col("month"))
    rows = rows.join(share, "code", "left")  # AQE broadcasts it while it is small
    pct = F.when(F.col("prior_weight") > 0, F.lit(100.0) * (F.col("weight") - F.col("prior_weight")) / F.col("prior_weight")).otherwise(F.lit(0.0))
    s = F.coalesce("share", F.lit(0.0))
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.lit(0.5) * pct + F.lit(0.3) * s + F.lit(0.2) * F.least(F.lit(50.0), F.col("weight") / 1000.0)))
    state = F.col("state") if "state" in keys else F.lit(None).cast("string")
    return rows.select(
        tx.key_hash(F.col("code"), F.col("month"), F.coalesce(state, F.lit(""))).alias("change_id"), "code", F.col("month").alias("snapshot_month"), state.alias("state"), F.col("weight").alias("truck_weight"), "prior_weight",
        pct.alias("delta_pct"), (F.col("weight") - F.coalesce("prior_weight", F.lit(0.0))).alias("delta_abs"), s.alias("macro_share"),
        F.when(s == 0, F.lit(0.0)).otherwise(F.col("weight") / s).alias("residual"), score.alias("change_score"), "adjacent",
    )


def snapshot_month(monthly: DataFrame, before: str, min_weight: float, min_codes: int) -> DataFrame:
    """The newest month before `before` with enough weight and codes; else the newest with enough weight; else the newest."""
    m = monthly.groupBy("month").agg(tx.exact_sum("weight").alias("w"), F.count_distinct("code").alias("codes"))
    enough = (F.col("month") < before) & (F.col("w") >= min_weight)
    return m.agg(F.coalesce(F.max(F.when(enough & (F.col("codes") >= min_codes), F.col("month"))), F.max(F.when(enough, F.col("month"))), F.max("month")).alias("snapshot_month"))


def latest_and_prior(series: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """The latest and the preceding value of each series, ordered by time, then value; one row per key."""
    w = W.partitionBy(key).orderBy(F.col(time).desc_nulls_last(), F.col(value).desc_nulls_last())
    ranked = series.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    pick = lambda c, n: F.max(F.when(F.col("rn") == n, F.col(c)))
    return ranked.groupBy(key).agg(pick(time, 1).alias("latest_time"), pick(value, 1).alias("latest_value"), pick(time, 2).alias("prior_time"), pick(value, 2).alias("prior_value"))


def series_tail(series: DataFrame, key: str, time: str, value: str, n: int = 8) -> DataFrame:
    """The last n rows of each series."""
    w = W.partitionBy(key).orderBy(F.col(time).desc_nulls_last(), F.col(value).desc_nulls_last())
    return series.select(key, time, value).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def classify_periods(periods: DataFrame, key: str, period: str, reference: Column) -> DataFrame:
    """How each key's periods meet a reference month (yyyymm): aligned, diverge (same year only) or none."""
    same, year = F.max((F.col(period) == reference).cast("int")), F.max((F.substring(period, 1, 4) == F.substring(reference, 1, 4)).cast("int"))
    return periods.groupBy(key).agg(F.when(same == 1, "aligned").when(year == 1, "diverge").otherwise("none_in_window").alias("join_class"))


def endpoints(prices: DataFrame, key: str, time: str, tie: str, value: str, lookback: int = 63, recent: int = 20) -> DataFrame:
    """First, last and looked-back value of each series, the mean of its last values and its length, in one window pass."""
    order = [F.col(time).desc_nulls_last(), F.col(tie).desc_nulls_last()]
    rows = prices.filter(F.col(value).isNotNull() & F.col(key).isNotNull()).withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(key)))
    at = lambda rn: F.max(F.when(F.col("rn") == rn, F.col(value)))
    g = rows.groupBy(key).agg(
        F.max("n").alias("n_obs"), at(F.col("n")).alias("first_value"), at(1).alias("last_value"), at(F.least(F.lit(lookback), F.col("n"))).alias("lookback_value"),
        tx.exact_sum(F.when(F.col("rn") <= recent, F.col(value))).alias("s"), F.least(F.max("n"), F.lit(recent)).alias("k"),
    )
    return g.select(key, "n_obs", "first_value", "last_value", "lookback_value", (F.col("s") / F.col("k")).alias("recent_mean"))

"""Composite reports: commodity and transport slates, the answer about one code, trends and the linear pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadstone.functions import text as tx
from loadstone.operators import macro as mc
from loadstone.operators import temporal as tm
from loadstone.operators.graph import base_type

# Cargo flags of a carrier by lane, in the order in which the first that is set decides.
FLAG_LANES = (("metal", "metal_sheet"), ("grain", "grain_feed"), ("liqgas", "petroleum_chem"), ("chem", "petroleum_chem"), ("coal", "coal_coke"), ("waste", "waste_scrap"), ("gen", "general_freight"))


def lane_of_flags(flag: dict[str, Column], metal_first: bool = True) -> Column:
    """The lane of the first set flag ('X'); without `metal_first` the metal flag isn't looked at. Flags may be missing."""
    rules = [(f, lane) for f, lane in FLAG_LANES if f in flag and (metal_first or f != "metal")]
    return reduce(lambda c, r: c.when(flag[r[0]] == "X", r[1]), rules, F.when(F.lit(False), "")).otherwise("unknown")


def method_of(placard: Column, tank: Column) -> Column:
    """How a commodity was told: by placard, by a tank or inspection field, else by the shipper's name."""
    return (
        F.when(F.upper(F.coalesce(placard, F.lit(""))) == "Y", "hazmat_placard_plus_context")
        .when(F.coalesce(F.trim(tank) != "", F.lit(False)), "cargo_tank_or_inspection_field")
        .otherwise("shipper_name_pattern")
    )


def labelled(df: DataFrame, key: str, labels: DataFrame, default: str, name: str = "label") -> DataFrame:
    """`df` with the label of its key from `labels` (key, label); a missing one is `default` followed by the key."""
    return df.join(labels.select(F.col("key").alias(key), F.col("label").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.concat(F.lit(default), F.col(key).cast("string"))))


def overlap(a: Column, b: Column) -> Column:
    """The values two lists share, sorted; null lists share nothing."""
    return F.sort_array(F.array_intersect(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def transport_economy(flows: DataFrame, shipments: DataFrame, ties: DataFrame, key: str = "code", modes: int = 3) -> DataFrame:
    """One row per code: its shares of flows and of the survey, carriers and tied inspections, rank and its top modes.

    `flows`: code, mode, tons; `shipments`: code, amount; `ties`: code, dot, n. Every source is aggregated to codes in one
    scan of its own before the full outer joins. The score is 0.35 and 0.30 of the shares, up to 20 for carriers in five
    thousands and up to 15 for ties in five hundreds. Modes by tons; ties by name.
    """
    a = mc.by_key_with_share(flows, key, "tons").select(key, F.col("share_pct").alias("flow_pct"))
    b = mc.by_key_with_share(shipments, key, "amount").select(key, F.col("share_pct").alias("survey_pct"))
    c = ties.groupBy(key).agg(F.count_distinct("dot").alias("carriers"), F.sum("n").alias("tied"))
    top = mc.top_per_group(flows, key, ["mode"], "tons", modes).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "mode"))), lambda x: x["mode"]), " | ").alias("top_modes"))  # `modes` entries a code
    zero = F.lit(0.0)
    j = a.join(b, key, "full").join(c, key, "full").join(top, key, "left")
    j = j.select(key, *[F.coalesce(x, zero).alias(x) for x in ("flow_pct", "survey_pct")], *[F.coalesce(x, F.lit(0).cast("bigint")).alias(x) for x in ("carriers", "tied")], "top_modes")
    score = F.lit(0.35) * F.col("flow_pct") + F.lit(0.30) * F.col("survey_pct") + F.least(F.lit(20.0), F.col("carriers") / F.lit(5000.0)) + F.least(F.lit(15.0), F.col("tied") / F.lit(500.0))
    return j.withColumn("score", score)


def commodity_economy(flows: DataFrame, shipments: DataFrame, deposits: DataFrame, series: DataFrame, key: str = "code", layer: int = 20, slate: int = 25) -> DataFrame:
    """The layers of a commodity report as one table: layer, name, amount, share_pct, rank.

    Layers: flows by code, the survey by code, deposits by commodity (rows), the latest value of each energy series, and the
    slate, 0.55 and 0.45 of the first two shares; each cut to its largest `layer` (slate: `slate`) rows, a top-k report.
    """

    def cut(df: DataFrame, name: str, k: int) -> DataFrame:
        order = [F.col("amount").desc_nulls_last(), F.col("name").asc_nulls_last()]
        top = df.orderBy(*order).limit(k)
        return top.select(F.lit(name).alias("layer"), "name", "amount", "share_pct", F.row_number().over(W.partitionBy().orderBy(*order)).alias("rank"))  # over k rows

    a, b = mc.by_key_with_share(flows, key, "tons"), mc.by_key_with_share(shipments, key, "amount")
    named = lambda df, k: df.select(F.col(k).alias("name"), "amount", "share_pct")
    counted = deposits.groupBy("name").agg(F.count(F.lit(1)).cast("double").alias("amount"))
    counted = counted.withColumn("share_pct", F.lit(100.0) * F.col("amount") / F.nullif(tx.exact_sum("amount", over=W.partitionBy()), F.lit(0.0)))
    latest = tm.latest_and_prior(series, "name", "time", "value").select("name", F.col("latest_value").alias("amount"), F.lit(None).cast("double").alias("share_pct"))
    blend = mc.blended(a, b, key, (0.55, 0.45)).select(F.col(key).alias("name"), F.col("score").alias("amount"), F.lit(None).cast("double").alias("share_pct"))
    parts = [cut(named(a, key), "flows", layer), cut(named(b, key), "survey", layer), cut(counted, "deposits", layer), cut(latest, "energy", layer), cut(blend, "slate", slate)]
    return reduce(DataFrame.unionByName, parts)


def code_answer(events: DataFrame, national: DataFrame, corridor: DataFrame, months: DataFrame, code: str, k: int = 5, origin: str | None = None) -> DataFrame:
    """One table that answers for a code in the picked month: section, rank, name, value.

    Sections: score (the national change score), states (top k change scores), carriers (top k haul weights, summed) and,
    where `origin` names a series type, origin: how many of its keys meet the month (aligned, diverge, none). `months` is
    the one row of the picked month.
    """
    month = months.first()["snapshot_month"]  # one value
    here = lambda df: df.filter((F.col("code") == code) & (F.col("snapshot_month") == month))
    row = lambda section, rank, name, value: [F.lit(section).alias("section"), rank.cast("int").alias("rank"), name.alias("name"), value.alias("value")]
    ranked = lambda v, n: F.row_number().over(W.partitionBy().orderBy(F.col(v).desc_nulls_last(), F.col(n).asc_nulls_last()))  # noqa: E731  over k rows
    score = here(national).select(*row("score", F.lit(1), F.lit(month), F.col("change_score")))
    states = here(corridor).orderBy(F.col("change_score").desc_nulls_last(), "state").limit(k).select(*row("states", ranked("change_score", "state"), F.col("state"), F.col("change_score")))
    hauls = events.filter((base_type() == "observed_haul") & (F.col("event_time") == month) & (F.get_json_object("attrs_json", "$.sctg2") == code))
    carriers = mc.top(hauls, ["dst_id"], "weight", k).select(*row("carriers", ranked("amount", "dst_id"), F.col("dst_id"), F.col("amount")))
    parts = [score, states, carriers]
    if origin is not None:
        rows = events.filter((base_type() == origin) & F.col("event_time").rlike("^[0-9]{6}$") & F.col("src_id").isNotNull())
        classes = tm.classify_periods(rows, "src_id", "event_time", F.lit(month)).groupBy("join_class").agg(F.count(F.lit(1)).cast("double").alias("n"))
        parts.append(classes.select(*row("origin", F.lit(1), F.col("join_class"), F.col("n"))))
    return reduce(DataFrame.unionByName, parts)


def trend_rows(events: DataFrame, scores: DataFrame, months: DataFrame, k: int = 50) -> DataFrame:
    """The top k change scores of the picked month (a top-k report) with that month's haul statistics of their code."""
    month = months.first()["snapshot_month"]  # one value
    top = scores.filter(F.col("snapshot_month") == month).orderBy(F.col("change_score").desc_nulls_last(), "code").limit(k)
    code, state = F.get_json_object("attrs_json", "$.sctg2"), F.get_json_object("attrs_json", "$.state")
    hauls = events.filter((base_type() == "observed_haul") & (F.col("event_time") == month)).withColumn("code", code).withColumn("state", state)
    stats = hauls.groupBy("code").agg(F.count_distinct("src_id").alias("shippers"), F.count_distinct("dst_id").alias("carriers"), F.count_distinct("state").alias("states"), tx.exact_sum("weight").alias("inspections"))
    zero = lambda c, t: F.coalesce(c, F.lit(0).cast(t)).alias(c)
    return top.join(stats, "code", "left").select("code", "snapshot_month", "change_score", "delta_pct", "macro_share", "residual", *[zero(c, "bigint") for c in ("shippers", "carriers", "states")], zero("inspections", "double"))


#: The query by which anyone can check a report from the written tables: temporary views events and scores.
REPRODUCTION = """
WITH hauls AS (
  SELECT get_json_object(attrs_json, '$.sctg2') AS code, get_json_object(attrs_json, '$.state') AS state, CAST(sum(try_cast(weight AS DECIMAL(18,6))) AS DOUBLE) AS truck_weight,
    count(DISTINCT src_id) AS shippers, count(DISTINCT dst_id) AS carriers
  FROM {events} WHERE substring_index(edge_type, '.', 1) = 'observed_haul' GROUP BY 1, 2)
SELECT s.code, s.snapshot_month, s.change_score, s.delta_pct, s.residual, h.state, h.truck_weight AS state_weight, h.shippers, h.carriers
FROM {scores} s LEFT JOIN hauls h ON s.code = h.code WHERE s.code = :code ORDER BY s.change_score DESC, h.truck_weight DESC"""


def reproduction(events: DataFrame, scores: DataFrame, code: str) -> DataFrame:
    """The reproduction query run over the two tables."""
    return events.sparkSession.sql(REPRODUCTION, args={"code": code}, events=events, scores=scores)

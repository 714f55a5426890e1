"""Typed edge events from source tables, one function per kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadstone.functions import text as tx
from loadstone.operators.rejects import compact_date, dot_number
from loadstone.schema import EDGE_EVENT


def inspections(raw: DataFrame) -> DataFrame:
    """Inspection rows with typed dot, date and month, normalised shipper, state, commodity code and confidence.

    Unreadable numbers and dates are null. Column names are matched without case by Spark, so extra columns are let go.
    """
    # the normalised name is read many times below: a projection of its own computes it once a row
    rows = raw.select(
        "row_id", F.col("INSPECTION_ID").alias("inspection_id"), dot_number(F.col("DOT_NUMBER")).alias("dot"), compact_date(F.col("INSP_DATE")).alias("insp_date"), tx.name_norm(F.col("SHIPPER_NAME")).alias("shipper"),
        F.coalesce("COUNTY_CODE_STATE", F.lit("UNK")).alias("state"), F.col("CARGO_TANK").alias("tank"), F.col("HAZMAT_PLACARD_REQ").alias("hazmat"), F.col("INSP_CARRIER_NAME").alias("carrier"),
        F.col("OOS_TOTAL").alias("oos"), F.col("VIOL_TOTAL").alias("viol"),
    )
    facts = (F.col("hazmat"), F.col("tank"), F.col("shipper"))
    return rows.select("*", tx.commodity_code(*facts).alias("code"), tx.commodity_confidence(*facts).alias("confidence"), F.date_format("insp_date", "yyyyMM").alias("month"))


def monthly_hauls(insp: DataFrame, from_month: str, min_stops: int = 2) -> DataFrame:
    """Stops by month, shipper, carrier, state and commodity code, with the strongest confidence by rank.

    Rows without carrier, shipper or date and placeholder shippers don't count.
    """
    rows = insp.filter(F.col("dot").isNotNull() & F.col("month").isNotNull() & (F.col("month") >= from_month) & ~F.col("shipper").isin(*tx.PLACEHOLDERS))
    strongest = F.max_by("confidence", tx.confidence_rank(F.col("confidence")))
    grouped = rows.groupBy("month", "shipper", "dot", "state", "code").agg(strongest.alias("confidence"), F.count(F.lit(1)).cast("double").alias("weight"))
    return grouped.filter(F.col("weight") >= min_stops)


def edge(edge_type: str, src_type: str, src: Column, dst_type: str, dst: Column, time: Column, grain: str, weight: Column, confidence: Column, method: str, family: str, attrs: Column, key: Column) -> list[Column]:
    """The columns of an edge event, in the order of the contract."""
    null = F.lit(None)
    values = [key, F.lit(edge_type), F.lit(src_type), src, F.lit(dst_type), dst, time, F.lit(grain), weight, confidence, F.lit(method), F.lit(family), null, null, attrs]
    return [v.cast(f.dataType).alias(f.name) for v, f in zip(values, EDGE_EVENT.fields, strict=True)]


def haul_edges(monthly: DataFrame) -> DataFrame:
    """Shipper to carrier. The id holds the commodity code too, so it is unique."""
    dot = F.col("dot").cast("string")
    return monthly.select(*edge("observed_haul", "shipper", F.col("shipper"), "carrier", dot, F.col("month"), "month", F.col("weight"), F.col("confidence"), "inspection_aggregate", "inspections",
        tx.json_object(sctg2=F.col("code"), state=F.col("state")), tx.key_hash("observed_haul", F.col("shipper"), dot, F.col("state"), F.col("month"), F.col("code"))))


def commodity_edges(monthly: DataFrame) -> DataFrame:
    """Carrier to commodity, re-aggregated from the monthly hauls."""
    dot = F.col("dot").cast("string")
    strongest = F.max_by("confidence", tx.confidence_rank(F.col("confidence")))
    g = monthly.groupBy("month", "dot", "code").agg(F.sum("weight").alias("weight"), strongest.alias("confidence"), F.count_distinct("state").alias("states"))
    return g.select(*edge("hauls_commodity", "carrier", dot, "commodity", F.col("code"), F.col("month"), "month", F.col("weight"), F.col("confidence"), "inspection_aggregate", "inspections",
        tx.json_object(aggregated_states=F.col("states")), tx.key_hash("hauls_commodity", dot, F.col("code"), F.col("month"))))


def state_edges(monthly: DataFrame) -> DataFrame:
    """Carrier to state, re-aggregated from the monthly hauls."""
    dot = F.col("dot").cast("string")
    strongest = F.max_by("confidence", tx.confidence_rank(F.col("confidence")))
    g = monthly.groupBy("month", "dot", "state").agg(F.sum("weight").alias("weight"), strongest.alias("confidence"))
    return g.select(*edge("operates_in", "carrier", dot, "state", F.col("state"), F.col("month"), "month", F.col("weight"), F.col("confidence"), "inspection_aggregate", "inspections",
        tx.json_object(state=F.col("state")), tx.key_hash("operates_in", dot, F.col("state"), F.col("month"))))


def flow_edges(flows: DataFrame, year: str) -> DataFrame:
    """Corridor to commodity from modelled flows (origin, destination, code, tons)."""
    corridor = F.concat_ws("-", "origin", "destination")
    g = flows.groupBy(corridor.alias("corridor"), "code").agg(tx.exact_sum("tons", 2).alias("weight"))
    return g.select(*edge("modeled_flow", "corridor", F.col("corridor"), "commodity", F.col("code"), F.lit(year), "year", F.col("weight"), F.lit("strong"), "flow_model", "freight_flows",
        tx.json_object(corridor=F.col("corridor")), tx.key_hash("modeled_flow", F.col("corridor"), F.col("code"), F.lit(year))))


def share_edges(shipments: DataFrame, year: str) -> DataFrame:
    """Commodity to nation from a weighted survey (code, weight, factor)."""
    g = shipments.groupBy("code").agg(tx.exact_sum(F.col("weight") * F.col("factor"), 4).alias("total"))
    return g.select(*edge("shipment_share", "commodity", F.col("code"), "national", F.lit("US"), F.lit(year), "year", F.col("total"), F.lit("strong"), "survey_sum", "shipment_survey",
        tx.json_object(code=F.col("code")), tx.key_hash("shipment_share", F.col("code"), F.lit(year))))


def risk_edges(insp: DataFrame, policies: DataFrame) -> DataFrame:
    """Carrier risk: violations and a tenth of the out-of-service count per carrier and month, plus its policies (dot, n).

    Both sides are aggregated before the join; above 50 the confidence is medium, else weak.
    """
    v = insp.filter(F.col("dot").isNotNull() & F.col("month").isNotNull()).groupBy("dot", "month").agg(F.sum(F.coalesce("viol", F.lit(0))).alias("violations"), F.sum(F.coalesce("oos", F.lit(0))).alias("out"))
    p = policies.groupBy("dot").agg(F.sum("n").alias("policies"))
    weight = F.col("violations") + F.col("out") / F.lit(10.0) + F.coalesce("policies", F.lit(0))
    j = v.join(p, "dot", "left").withColumn("risk", weight.cast("double"))
    dot = F.col("dot").cast("string")
    return j.select(*edge("carrier_risk", "carrier", dot, "national", F.lit("US"), F.col("month"), "month", F.col("risk"), F.when(F.col("risk") > 50, "medium").otherwise("weak"), "violation_sum",
        "inspections", tx.json_object(policies=F.coalesce("policies", F.lit(0))), tx.key_hash("carrier_risk", dot, F.col("month"))))


def licence_edges(licences: DataFrame, year: str) -> DataFrame:
    """One edge per licence row with a non-blank number and name."""
    number = F.trim("`Organization No.`")
    rows = licences.filter((number != "") & (F.trim("`Legal Name`") != ""))
    return rows.select(*edge("maritime_license", "maritime_org", number, "national", F.lit("US"), F.lit(year), "year", F.lit(1.0), F.lit("strong"), "licence_list", "licences",
        tx.json_object(name=F.col("`Legal Name`"), kind=F.col("license_kind")), tx.key_hash("maritime_license", number, F.col("row_id"))))


def trade_edges(imports: DataFrame) -> DataFrame:
    """Commodity to nation from import records (hs, month, weight): the latest month's weight by commodity code.

    The latest month, one value, is known from the sums by month and code, so the records are read once.
    """
    g = imports.filter(F.col("month").isNotNull()).groupBy("month", tx.hs_code(F.col("hs")).alias("code")).agg(tx.exact_sum("weight").alias("weight"))
    latest = g.withColumn("newest", F.max("month").over(W.partitionBy())).filter(F.col("month") == F.col("newest"))  # over a row per month and code
    return latest.select(*edge("trade_import", "commodity", F.col("code"), "national", F.lit("US"), F.col("month"), "month", F.col("weight"), F.lit("strong"), "import_sum", "trade_records",
        tx.json_object(sctg2=F.col("code")), tx.key_hash("trade_import", F.col("code"), F.col("month"))))


def bilateral_trade_edges(records: DataFrame) -> DataFrame:
    """Country to commodity from trade records (country, hs, month, value), summed by month."""
    g = records.filter(F.col("month").isNotNull() & F.col("country").isNotNull()).groupBy("country", "month", tx.hs_code(F.col("hs")).alias("code")).agg(tx.exact_sum("value").alias("weight"))
    return g.select(*edge("trade_import.bilateral", "country", F.col("country"), "commodity", F.col("code"), F.col("month"), "month", F.col("weight"), F.lit("strong"), "trade_sum", "trade_records",
        tx.json_object(sctg2=F.col("code")), tx.key_hash("trade_bilateral", F.col("country"), F.col("code"), F.col("month"))))


def pressure_edges(points: DataFrame, edge_type: str, src_type: str, code: str) -> DataFrame:
    """Series to commodity from points (series, period, value): one edge per point with a value; repeated points, the largest."""
    g = points.filter(F.col("value").isNotNull() & F.col("series").isNotNull() & F.col("period").isNotNull()).groupBy("series", "period").agg(F.max("value").alias("value"))
    grain = F.when(F.length("event_time") == 4, "year").otherwise("month")
    columns = edge(edge_type, src_type, F.col("series"), "commodity", F.lit(code), F.col("period"), "month", F.col("value"), F.lit("strong"), "series_point", "energy_series", tx.json_object(series=F.col("series")), tx.key_hash(edge_type, F.col("series"), F.col("period")))
    return g.select(*columns).withColumn("event_grain", grain)


def rail_edges(metrics: DataFrame, year: str) -> DataFrame:
    """Rail operator to nation from metrics (operator, measure, value, place): the first value of a measure wins, by place."""
    g = metrics.filter(F.col("value").isNotNull() & F.col("operator").isNotNull()).groupBy("operator", "measure").agg(F.min_by("value", F.struct("place", "value")).alias("value"))
    return g.select(*edge("rail_metric", "rail_operator", F.col("operator"), "national", F.lit("US"), F.lit(year), "year", F.col("value"), F.lit("strong"), "annual_metric", "rail_annual",
        tx.json_object(measure=F.col("measure")), tx.key_hash("rail_metric", F.col("operator"), F.col("measure"), F.lit(year))))


def dwell_edges(performance: DataFrame) -> DataFrame:
    """Rail operator to nation from weekly performance (operator, measure, period, value): the measures that tell a dwell."""
    rows = performance.filter(F.col("measure").ilike("%dwell%") & F.col("value").isNotNull())
    return rows.select(*edge("rail_metric.dwell", "rail_operator", F.col("operator"), "national", F.lit("US"), F.col("period"), "week", F.col("value"), F.lit("strong"), "weekly_performance", "rail_performance",
        tx.json_object(measure=F.col("measure")), tx.key_hash("rail_dwell", F.col("operator"), F.col("measure"), F.col("period"), F.col("value"))))


def pipeline_edges(miles: DataFrame, year: str) -> DataFrame:
    """State to nation from pipeline mileage rows (state, miles) of all files, summed."""
    g = miles.filter((F.length("state") == 2) & (F.col("miles") > 0)).groupBy("state").agg(tx.exact_sum("miles").alias("miles"))
    return g.select(*edge("pipeline_signal", "state", F.col("state"), "national", F.lit("US"), F.lit(year), "year", F.col("miles"), F.lit("strong"), "mileage_sum", "pipeline_mileage",
        tx.json_object(state=F.col("state")), tx.key_hash("pipeline_signal", F.col("state"), F.lit(year))))


def identity_edges(shippers: DataFrame, titles: DataFrame) -> DataFrame:
    """Shipper to ticker where the whole title occurs in the shipper's name or equals its core (shipper, n; title, ticker).

    Equal cores are exact with a weight up to 100 by n; contained titles, of eight letters or more, blocked_fuzzy with 40.
    """
    a, b = shippers.select("shipper", "n"), titles.select("title", "ticker").filter(F.col("ticker").isNotNull())
    core = a.withColumn("core", tx.name_core(F.col("shipper"))).filter("core <> ''").join(b.withColumn("core", tx.name_core(F.col("title"))).select("core", "ticker").distinct(), "core")
    exact = core.select("shipper", "ticker", F.least(F.lit(100.0), F.lit(50.0) + F.col("n") / 20.0).alias("weight"), F.lit("exact").alias("confidence"))
    found = contained_names(a.select(F.col("shipper").alias("l")), b.select(F.col("title").alias("s"))).join(b, F.col("short") == F.col("title"))
    fuzzy = found.select(F.col("long").alias("shipper"), "ticker", F.lit(40.0).alias("weight"), F.lit("blocked_fuzzy").alias("confidence"))
    best = exact.unionByName(fuzzy).groupBy("shipper", "ticker").agg(F.max("weight").alias("weight"), F.min(F.when(F.col("confidence") == "exact", 0).otherwise(1)).alias("c"))
    return best.select(*edge("identity_match", "shipper", F.col("shipper"), "ticker", F.col("ticker"), F.lit("snapshot"), "snapshot", F.col("weight"), F.when(F.col("c") == 0, "exact").otherwise("blocked_fuzzy"), "name_match", "listed_companies",
        tx.json_object(ticker=F.col("ticker")), tx.key_hash("identity_match", F.col("shipper"), F.col("ticker"))))


def union_edges(*parts: DataFrame) -> DataFrame:
    """All edges in one table, by name."""
    return reduce(DataFrame.unionByName, parts)


def contained_names(longer: DataFrame, shorter: DataFrame, least: int = 8) -> DataFrame:
    """Pairs (long, short) where `short` (column s) occurs in `long` (column l), for shorts of at least `least` characters.

    No nested loop: a short name occurs at a place only if its first `least` characters do, so all pieces of that length of
    the long names are looked up by equality, and what meets is verified. Null names pair with nothing.
    """
    longs = longer.select("l").distinct().filter(F.length("l") >= least)
    pieces = longs.select("l", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("l") - least + 1), lambda i: F.col("l").substr(i, F.lit(least))))).alias("piece"))
    shorts = shorter.select("s").distinct().filter(F.length("s") >= least).withColumn("piece", F.substring("s", 1, least))
    return pieces.join(shorts, "piece").filter(F.col("l").contains(F.col("s"))).select(F.col("l").alias("long"), F.col("s").alias("short"))

"""Roll-ups of a fact table against a registry, and entity-resolution edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadstone.functions import text as tx
from loadstone.operators.edges import contained_names
from loadstone.session import materialize

# The commodity classes of a carrier's cargo by code.
LANE_OF_CODE = {"17": "petroleum_chem", "18": "hazmat", "02": "grain_feed", "19": "coal_coke", "11": "metal_sheet"}


def lane(code: Column) -> Column:
    c = F.when(F.lit(False), F.lit(""))
    for k, v in LANE_OF_CODE.items():
        c = c.when(code == k, v)
    return c.otherwise("general_freight")


def registry(insp: DataFrame) -> DataFrame:
    """One row per carrier: its most frequent name (ties: the least), rows and distinct states, so joins don't fan out.

    The inspections are read once, into counts by carrier, name and state."""
    seen = materialize(insp.filter(F.col("dot").isNotNull()).groupBy("dot", "carrier", "state").agg(F.count(F.lit(1)).alias("n")))
    named = seen.filter(F.col("carrier").isNotNull()).groupBy("dot", "carrier").agg(F.sum("n").alias("n"))
    name = named.groupBy("dot").agg(F.min_by("carrier", F.struct(-F.col("n"), F.col("carrier"))).alias("legal_name"))
    sizes = seen.groupBy("dot").agg(F.sum("n").alias("n_rows"), F.count_distinct("state").alias("n_states"))
    return sizes.join(name, "dot", "left")


def coverage(insp: DataFrame) -> DataFrame:
    """Conditional counts over all inspections, in one scan."""
    flag = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("bigint")
    n = F.count(F.lit(1))
    return insp.agg(
        n.alias("n_rows"), flag(F.col("dot").isNotNull()).alias("with_dot"), flag(F.coalesce(F.col("shipper") != "", F.lit(False))).alias("with_shipper"),
        flag(F.col("insp_date").isNotNull()).alias("with_date"), flag(F.upper(F.coalesce("hazmat", F.lit(""))) == "Y").alias("hazmat_rows"),
        (F.lit(100.0) * flag(F.coalesce(F.col("shipper") != "", F.lit(False))) / F.nullif(n, F.lit(0))).alias("shipper_pct"),
    )


def cargo_ties(insp: DataFrame, carriers: DataFrame, least: int = 5, state: str | None = None, only_lane: str | None = None) -> DataFrame:
    """Shipper, carrier and lane groups of at least `least` inspections with dates, violations and the carrier's name.

    The facts are aggregated before the join with the registry, so only groups travel. State and lane are optional filters.
    """
    rows = insp.filter(F.col("dot").isNotNull() & F.col("shipper").isNotNull() & ~F.col("shipper").isin(*tx.PLACEHOLDERS))
    if state is not None:
        rows = rows.filter(F.col("state") == state)
    rows = rows.withColumn("lane", lane(F.col("code")))
    if only_lane is not None:
        rows = rows.filter(F.col("lane") == only_lane)
    tank = F.when(F.col("tank").isin(*tx.FUEL_TANKS), "tanker").when(F.upper(F.coalesce("hazmat", F.lit(""))) == "Y", "hazmat")
    g = rows.groupBy("shipper", "dot", "state", "lane", tank.alias("tank_hint")).agg(
        F.count(F.lit(1)).alias("inspections"), F.min("insp_date").cast("string").alias("first_date"), F.max("insp_date").cast("string").alias("last_date"),
        F.sum(F.coalesce("oos", F.lit(0))).alias("oos"), F.sum(F.coalesce("viol", F.lit(0))).alias("violations"),
    )
    return g.filter(F.col("inspections") >= least).join(carriers.select("dot", "legal_name"), "dot", "left")


def shipper_carriers(insp: DataFrame, part: str, least: int = 1) -> DataFrame:
    """Carriers of shippers whose name contains `part` (any case): rows, distinct inspections, and the sorted spellings."""
    rows = insp.filter(F.col("shipper").contains(tx.name_norm(F.lit(part))) & F.col("dot").isNotNull())
    g = rows.groupBy("dot").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("inspection_id").alias("n_inspections"), F.min("insp_date").cast("string").alias("first_date"),
        F.array_join(F.sort_array(F.collect_set("shipper")), " | ").alias("spellings"),
    )
    return g.filter(F.col("n_rows") >= least)


def truck_signals(insp: DataFrame, least: int = 3) -> DataFrame:
    """Groups of inspections by carrier, shipper, code and state with a strength from 0 to 100.

    Strength: the group's share of the largest group, times recency, placard and confidence factors, at most 100.
    """
    rows = insp.filter(F.col("dot").isNotNull() & F.col("insp_date").isNotNull() & ~F.coalesce("shipper", F.lit("")).isin(*tx.PLACEHOLDERS))
    hazmat = (F.upper(F.coalesce("hazmat", F.lit(""))) == "Y").cast("int")
    g = rows.groupBy("dot", "shipper", "code", "confidence", "state").agg(
        F.count(F.lit(1)).alias("n"), F.min("carrier").alias("carrier"), F.max("insp_date").cast("string").alias("last_date"), F.sum(hazmat).alias("hazmat_stops"),
        F.sum(F.coalesce("oos", F.lit(0))).alias("oos"), F.sum(F.coalesce("viol", F.lit(0))).alias("violations"),
    ).filter(F.col("n") >= least)
    g = materialize(g)
    g = g.withColumn("largest", F.lit(g.agg(F.max("n")).first()[0]))
    recency = F.when(F.col("last_date") >= "2026-01-01", 1.0).when(F.col("last_date") >= "2025-01-01", 0.7).otherwise(0.4)
    placard = F.when(F.col("hazmat_stops") > 0, 1.15).otherwise(1.0)
    trust = F.when(F.col("confidence") == "strong", 1.2).when(F.col("confidence") == "medium", 1.0).otherwise(0.8)
    intensity = F.lit(100.0) * F.col("n") / F.col("largest")
    return g.select(
        tx.stable_id(F.col("dot"), F.col("shipper"), F.col("code"), F.col("state")).alias("signal_id"), "dot", "shipper", "code", "confidence", "state", "n", "carrier", "last_date", "hazmat_stops",
        intensity.alias("intensity"), F.least(F.lit(100.0), intensity * recency * placard * trust).alias("strength"), F.least(F.lit(100.0), F.col("oos") * 2.0 + F.col("violations") * 0.5).alias("safety"),
    )


def entity_edges(insp: DataFrame, titles: DataFrame) -> DataFrame:
    """Entity-resolution edges of (carrier, shipper) pairs by tier, in one pass over the pairs.

    carrier_exact: 100 per carrier; service: min(95, 50 + n / 10), accepted from 5 rows on; title_exact: the shipper's core is
    a title's core; title_substring: the first title, in order, whose first two words occur in the shipper's name; not accepted.
    """
    rows = insp.filter(F.col("dot").isNotNull() & ~F.coalesce("shipper", F.lit("")).isin(*tx.PLACEHOLDERS))
    pairs = rows.groupBy("dot", "shipper").agg(F.count(F.lit(1)).alias("n"))
    dot = F.col("dot").cast("string")
    carrier = pairs.select(dot.alias("left_id"), dot.alias("right_id")).distinct().select("left_id", "right_id", F.lit("carrier_exact").alias("tier"), F.lit(100.0).alias("score"), F.lit(True).alias("accepted"))
    service = pairs.select(F.col("shipper").alias("left_id"), dot.alias("right_id"), F.lit("service").alias("tier"), F.least(F.lit(95.0), F.lit(50.0) + F.col("n") / 10.0).alias("score"), (F.col("n") >= 5).alias("accepted"))
    names = pairs.select("shipper").distinct()
    core = titles.select(tx.name_core(F.col("title_norm")).alias("core")).filter(F.col("core") != "").distinct()
    exact = names.join(core, tx.name_core(F.col("shipper")) == F.col("core")).select(F.col("shipper").alias("left_id"), F.col("core").alias("right_id"), F.lit("title_exact").alias("tier"), F.lit(100.0).alias("score"), F.lit(True).alias("accepted"))
    heads = titles.select(F.substring_index("title_norm", " ", 2).alias("s"))
    hits = contained_names(names.select(F.col("shipper").alias("l")), heads).groupBy("long").agg(F.min("short").alias("short"))
    substring = hits.select(F.col("long").alias("left_id"), F.col("short").alias("right_id"), F.lit("title_substring").alias("tier"), F.lit(40.0).alias("score"), F.lit(False).alias("accepted"))
    every = carrier.unionByName(service).unionByName(exact).unionByName(substring)
    return every.select(tx.stable_id(F.col("tier"), F.col("left_id"), F.col("right_id")).alias("edge_id"), "*")


def flagged_carriers(insp: DataFrame, carriers: DataFrame, least_rows: int, limit: int) -> DataFrame:
    """Carriers with any of the wanted lanes and enough rows, most rows first (a top-k report; ties by number)."""
    flags = insp.filter(F.col("dot").isNotNull()).groupBy("dot").agg(*[F.max((F.col("code") == c).cast("int")).alias(f"has_{n}") for c, n in (("17", "fuel"), ("02", "grain"), ("19", "coal"))])
    wanted = flags.filter((F.col("has_fuel") == 1) | (F.col("has_grain") == 1) | (F.col("has_coal") == 1))
    return wanted.join(carriers.filter(F.col("n_rows") >= least_rows), "dot").orderBy(F.col("n_rows").desc(), "dot").limit(limit)


def best_per_group(df: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """The row with the largest value of each group; ties go to the least key."""
    w = W.partitionBy(group).orderBy(F.col(value).desc_nulls_last(), F.col(key).asc_nulls_last())
    return df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")

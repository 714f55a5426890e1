"""Per-entity feature table from events: two-stage salted aggregation over the complete type list."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadstone.functions.periods import period_code, period_text

#: More event types than this are refused for the wide layout; entity_type_stats() has no such bound.
MAX_TYPES = 20_000
#: Partial groups per heavy (entity, type) pair in the first stage; pairs of more rows than HEAVY are.
SALTS, HEAVY = 32, 1_000_000


def latest_deliveries(events: DataFrame) -> DataFrame:
    """Rows of `events` without superseded deliveries of the same event_id.

    Of rows that share an event_id the one with the latest source_mtime stays; ties go to the greater weight, then to
    the greater type, entity and period, so that the result doesn't depend on the row order. Rows without an event_id
    can't be told to be re-sent and all stay. Nulls sort below every value.
    """
    needed = events.select("event_id", "edge_type", "src_id", "event_time", "weight", "source_mtime")
    version = F.struct("source_mtime", "weight", "edge_type", "src_id", "event_time")
    known = needed.filter(F.col("event_id").isNotNull()).groupBy("event_id").agg(F.max(version).alias("v"))
    known = known.select("event_id", "v.edge_type", "v.src_id", "v.event_time", "v.weight")
    return known.unionByName(needed.filter(F.col("event_id").isNull()).drop("source_mtime"))


def entity_types(events: DataFrame) -> DataFrame:
    """Every edge_type with the rows of the largest (src_id, edge_type) group, re-sent rows included: edge_type, largest."""
    groups = events.groupBy("src_id", "edge_type").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy("edge_type").agg(F.max("n").alias("largest"))


def _sums(events: DataFrame, salts: int, salted_types: list[str | None] | None) -> DataFrame:
    """Per (src_id, edge_type): n, latest and the weights as an exact decimal sum and the rest as a double sum."""
    rows = latest_deliveries(events)
    weight = F.when(~F.isnan("weight"), F.col("weight"))
    exact = weight.try_cast("decimal(18,6)")
    hashed = F.pmod(F.xxhash64("event_id", "event_time", "weight"), F.lit(salts)).cast("int")
    if salted_types is None:
        salt = hashed
    else:
        heavy = F.col("edge_type").isin(*[t for t in salted_types if t is not None]) if any(t is not None for t in salted_types) else F.lit(False)
        heavy = F.coalesce(heavy, F.lit(False)) | (F.col("edge_type").isNull() if None in salted_types else F.lit(False))
        salt = F.when(heavy, hashed).otherwise(F.lit(0))
    first = (
        rows.select("src_id", "edge_type", salt.alias("salt"), period_code(F.col("event_time")).alias("period"), exact.alias("exact"), F.when(exact.isNull(), weight).alias("rest"))
        .groupBy("src_id", "edge_type", "salt")
        .agg(F.count(F.lit(1)).alias("n"), F.max("period").alias("latest"), F.sum("exact").alias("exact"), F.sum("rest").alias("rest"))
    )
    return first.groupBy("src_id", "edge_type").agg(F.sum("n").alias("n"), F.max("latest").alias("latest"), F.sum("exact").alias("exact"), F.sum("rest").alias("rest"))


def _total(exact: Column, rest: Column) -> Column:
    return F.coalesce(exact.cast("double"), F.lit(0.0)) + F.coalesce(rest, F.lit(0.0))


def entity_type_stats(events: DataFrame, salts: int = SALTS, salted_types: list[str | None] | None = None) -> DataFrame:
    """One row per (src_id, edge_type): n, latest (period code) and total weight.

    First stage: every (entity, type) group of the `salted_types` (None: of all types) is spread over `salts` partial groups
    by a hash of the event, so that a pair holding a third of all rows never meets in one task; second stage: the partial
    statistics are merged. Weights are summed as decimals, so the total doesn't depend on the order; null and NaN weights
    count as rows without weight, a weight outside decimal(18,6) is added as a double. A null src_id or edge_type is a key
    of its own.
    """
    return _sums(events, salts, salted_types).select("src_id", "edge_type", "n", "latest", _total(F.col("exact"), F.col("rest")).alias("total"))


def _largest_groups(events: DataFrame, max_types: int) -> dict[str | None, int]:
    found = {r["edge_type"]: r["largest"] for r in entity_types(events).limit(max_types + 1).collect()}
    if len(found) > max_types:
        raise ValueError(f"more than {max_types} event types; use entity_type_stats()")
    return found


def _sorted(types: Iterable[str | None]) -> list[str | None]:
    types = set(types)
    return sorted(x for x in types if x is not None) + [None] * (None in types)


def entity_type_list(events: DataFrame, max_types: int = MAX_TYPES) -> list[str | None]:
    """The distinct edge_type values, sorted, a null type last; more than `max_types` raise ValueError."""
    return _sorted(_largest_groups(events, max_types))


def entity_features(events: DataFrame, types: list[str | None] | None = None, salts: int = SALTS) -> DataFrame:
    """One row per src_id with count, latest period and total weight of every event type.

    Columns: src_id; edge_types, the complete sorted type list; counts, latest_periods and total_weights, arrays
    aligned with it (0, null and 0.0 where the entity has no such event); n_events, n_types, latest_period and
    total_weight over all types. Events without src_id form one row with a null src_id. No events give no rows.
    `types` may fix the list, as for a training layout that must not change; events of other types are then left out
    of the arrays but stay in the totals. Only groups of types that have a pair of more than HEAVY rows are salted, so light
    groups keep their map-side combining.
    """
    known = _largest_groups(events, MAX_TYPES)  # one pass tells the types and those with heavy groups
    types = _sorted(known) if types is None else types
    spark = events.sparkSession
    listed = spark.createDataFrame([(t, i) for i, t in enumerate(types)], "t string, i int")
    stats = _sums(events, salts, [t for t, n in known.items() if n > HEAVY]).withColumn("total", _total(F.col("exact"), F.col("rest")))
    indexed = stats.join(F.broadcast(listed), F.col("edge_type").eqNullSafe(F.col("t")), "left")  # at most max_types rows
    grouped = indexed.groupBy("src_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", F.struct("n", "latest", "total"))))).alias("m"),
        F.sum("n").alias("n_events"),
        F.count(F.lit(1)).alias("n_types"),
        F.max("latest").alias("latest"),
        _total(F.sum("exact"), F.sum("rest")).alias("total_weight"),
    )
    every = F.sequence(F.lit(0), F.lit(len(types) - 1)) if types else F.array().cast("array<int>")
    full = F.transform(every, lambda i: F.try_element_at("m", i))
    return (
        grouped.withColumn("full", full)
        .select(
            "src_id",
            F.array(*[F.lit(t) for t in types]).cast("array<string>").alias("edge_types"),
            F.transform("full", lambda x: F.coalesce(x["n"], F.lit(0).cast("bigint"))).alias("counts"),
            F.transform("full", lambda x: period_text(x["latest"])).alias("latest_periods"),
            F.transform("full", lambda x: F.coalesce(x["total"], F.lit(0.0))).alias("total_weights"),
            "n_events",
            "n_types",
            period_text(F.col("latest")).alias("latest_period"),
            "total_weight",
        )
    )

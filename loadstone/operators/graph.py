"""Graph operators over edge events: nodes, catalogue, subgraphs, subsamples and message passing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadstone.session import discard, materialize

#: Neighbours of a node that are joined in one piece; a hub's edges are spread over as many pieces as it has of these.
HUB_PIECE = 50_000


def nodes(events: DataFrame) -> DataFrame:
    """Distinct endpoints: node_type, node_id; endpoints without type or id aren't nodes."""
    ends = F.explode(F.array(F.struct(F.col("src_type").alias("node_type"), F.col("src_id").alias("node_id")), F.struct(F.col("dst_type").alias("node_type"), F.col("dst_id").alias("node_id"))))
    return events.select(ends.alias("n")).select("n.*").filter(F.col("node_type").isNotNull() & F.col("node_id").isNotNull()).distinct()


def edge_catalog(events: DataFrame) -> DataFrame:
    return events.select("edge_type", "src_type", "dst_type").distinct()


def type_summary(events: DataFrame) -> DataFrame:
    """Rows and summed weight by edge type."""
    from loadstone.functions.text import exact_sum

    return events.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), exact_sum("weight").alias("weight"))


def base_type(column: str = "edge_type") -> F.Column:
    """The type without its qualifier."""
    return F.substring_index(F.col(column), ".", 1)


def evidence_edges(events: DataFrame, code: str, limit: int = 500) -> DataFrame:
    """The heaviest edges of a commodity: edges at its node and hauls whose attributes name it; ties by id and place in time.

    Identity edges belong only if their shipper has a haul of the code. One row per event_id.
    """
    kind = base_type()
    of_code = F.get_json_object("attrs_json", "$.sctg2") == code
    at_node = kind.isin("hauls_commodity", "modeled_flow", "commodity_pressure") & (((F.col("dst_type") == "commodity") & (F.col("dst_id") == code)) | ((F.col("src_type") == "commodity") & (F.col("src_id") == code)))
    hauls = (kind == "observed_haul") & of_code
    direct = events.filter(at_node | hauls)
    shippers = events.filter(hauls & F.col("src_id").isNotNull()).select("src_id").distinct()
    identity = events.filter((kind == "identity_match") & (F.col("src_type") == "shipper")).join(shippers, "src_id", "left_semi").select(*events.columns)
    rank = W.partitionBy("event_id").orderBy(F.col("source_mtime").desc_nulls_last(), F.col("weight").desc_nulls_last(), F.col("event_time").desc_nulls_last())
    kept = direct.unionByName(identity).filter(F.col("event_id").isNotNull()).withColumn("rn", F.row_number().over(rank)).filter("rn = 1").drop("rn")
    return kept.orderBy(F.col("weight").desc_nulls_last(), "event_id").limit(limit)


def evidence_subgraph(events: DataFrame, code: str, limit: int = 500) -> DataFrame:
    """The heaviest edges that tell of a commodity, a top-k report: hauls, carriers' cargo, pressures and imports that name
    the code in their attributes or by its node, and every identity edge of a shipper; ties by id and time. Rows, not ids, are
    taken: a re-sent event comes as often as it is there.
    """
    kind, named = base_type(), F.get_json_object("attrs_json", "$.sctg2") == code
    at = ((kind == "hauls_commodity") & (F.col("dst_id") == code)) | ((kind == "trade_import") & (F.col("dst_id") == code)) | ((kind == "commodity_pressure") & (F.col("src_id") == code))
    rows = events.filter((kind.isin("observed_haul", "hauls_commodity", "commodity_pressure", "trade_import") & (F.coalesce(named, F.lit(False)) | at)) | ((kind == "identity_match") & (F.col("src_type") == "shipper")))
    return rows.orderBy(F.col("weight").desc_nulls_last(), F.col("event_id").asc_nulls_last(), F.col("source_mtime").asc_nulls_last(), F.col("event_time").asc_nulls_last()).limit(limit)


def subsample(events: DataFrame, month: str, types: tuple[str, ...], limit: int, per_type: int) -> DataFrame:
    """A staged sample of edges, a sampling operator with quotas: the month's edges first, then `per_type` of each listed
    type, then other months'; heaviest first, one row per key of six columns, each in its earliest stage.

    The stages are tags on one pass; ranks are taken per stage and type, so no stage is a query of its own.
    """
    key = ["edge_type", "src_type", "src_id", "dst_type", "dst_id", "event_time"]
    in_month = F.coalesce((F.col("event_grain") == "month") & (F.col("event_time") == month), F.lit(False))
    stage = F.when(in_month, 1).when(F.col("edge_type").isin(*types), 2).when((F.col("event_grain") == "month") & (F.length("event_time") == 6), 3)
    heaviest = events.withColumn("stage", stage).filter(F.col("stage").isNotNull()).groupBy(*key, "stage").agg(F.max("weight").alias("weight"))
    part = F.when(F.col("stage") == 2, F.col("edge_type")).otherwise(F.lit(""))
    order = [F.col("weight").desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in key]]
    quota = F.when(F.col("stage") == 2, per_type).otherwise(limit)
    ranked = heaviest.withColumn("rn", F.row_number().over(W.partitionBy("stage", part).orderBy(*order))).filter((F.col("rn") <= limit) & (F.col("rn") <= quota))
    return ranked.select(*key, "stage", "weight").orderBy("stage", *order).limit(limit)


def staged_subsample(events: DataFrame, month: str, types: tuple[str, ...], limit: int = 250_000, least: int = 500, last: str = "carrier_risk") -> DataFrame:
    """A staged sample of `limit` edges, every stage filling what the ones before it leave over: the month's edges, then the
    listed base types in their order, each up to max(least, left over / types), then any other month's edges, then those of
    base type `last`; heaviest first, one row per key of six columns, each in its earliest stage.

    Quotas count keys, so repeated rows don't use them up. A listed type's rows beyond its quota can still come in by month.
    The sizes of the stages are counted over the keys, which are computed once; only a stage that is cut is sorted as a whole.
    """
    key = ["edge_type", "src_type", "src_id", "dst_type", "dst_id", "event_time"]
    order = [F.col("weight").desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in key]]
    monthly = F.coalesce(F.col("event_grain") == "month", F.lit(False))
    in_month = monthly & F.coalesce(F.col("event_time") == month, F.lit(False))
    kind = F.array_position(F.array(*[F.lit(t) for t in types]), base_type()).cast("int")
    rules = {1: in_month, 2: ~in_month & (F.coalesce(kind, F.lit(0)) > 0), 3: ~in_month & monthly & F.coalesce(F.length("event_time") == 6, F.lit(False)), 4: F.coalesce(base_type() == last, F.lit(False))}
    tagged = events.select(*key, "weight", *[c.alias(f"b{s}") for s, c in rules.items()]).filter("b1 OR b2 OR b3 OR b4")
    heaviest = tagged.groupBy(*key).agg(*[F.max(f"b{s}").alias(f"b{s}") for s in rules], *[F.max(F.when(F.col(f"b{s}"), F.col("weight"))).alias(f"w{s}") for s in rules])
    keys = materialize(heaviest.withColumn("kind", kind))

    def top(rows: DataFrame, stage: int, left: int) -> tuple[DataFrame, int]:
        rows = rows.select(*key, F.lit(stage).alias("stage"), F.lit(0).alias("kind"), F.col(f"w{stage}").alias("weight"))
        n = rows.count()
        return (rows.orderBy(*order).limit(left) if n > left else rows), min(n, left)

    sample, n = top(keys.filter("b1"), 1, limit)
    if n < limit:
        listed = keys.filter("b2 AND NOT b1")
        quota, sizes, left = max(least, (limit - n) // max(1, len(types))), dict(listed.groupBy("kind").count().collect()), limit - n
        take = []  # by type, at most as many as are listed
        for k in range(1, len(types) + 1):
            take.append(min(quota, sizes.get(k, 0), left))
            left -= take[-1]
        of_kind = F.element_at(F.array(*[F.lit(t) for t in (*take, 0)]), F.coalesce(F.col("kind"), F.lit(len(types) + 1)))
        rank = F.row_number().over(W.partitionBy("kind").orderBy(F.col("w2").desc_nulls_last(), *order[1:]))
        ranked = materialize(listed.withColumn("rn", rank).withColumn("chosen", F.col("rn") <= of_kind).drop("rn").unionByName(keys.filter("NOT b1 AND NOT b2").withColumn("chosen", F.lit(False))))
        sample = sample.union(ranked.filter("chosen").select(*key, F.lit(2).alias("stage"), "kind", F.col("w2").alias("weight")))
        for stage, rule in ((3, "b3"), (4, "b4 AND NOT b3")):
            if left:
                more, n = top(ranked.filter(f"NOT chosen AND {rule}"), stage, left)
                sample, left = sample.union(more), left - n
    return sample.orderBy("stage", "kind", *order).drop("kind")


def typed_edges(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) between typed endpoints as "type:id", and all nodes; a node whose other end is missing has no edge."""
    ends = events.select(F.concat("src_type", F.lit(":"), "src_id").alias("a"), F.concat("dst_type", F.lit(":"), "dst_id").alias("b"))
    found = ends.select(F.explode(F.array("a", "b")).alias("node")).filter("node IS NOT NULL").distinct()  # x:y of z and x of y:z are one
    return ends.filter("a IS NOT NULL AND b IS NOT NULL"), found


def hash_features(node: F.Column, dim: int = 32) -> F.Column:
    """Initial features of a node: sines of the bytes of its sha-256, by position.

    A position has 256 sines, which are looked up: the JVM's differ from the C library's in the last bit.
    """
    digest = F.sha2(node, 256)
    byte = lambda i: F.conv(F.substring(digest, 2 * (i % 32) + 1, 2), 16, 10).cast("int")
    sines = lambda i: F.split(F.lit(" ".join(repr(math.sin((b + 1) * (i + 1) * 0.13)) for b in range(256))), " ").cast("array<double>")
    return F.array(*[F.get(sines(i), byte(i)) for i in range(dim)])


def message_pass(edges: DataFrame, features: DataFrame, hops: int = 1, dim: int = 32, normalize: bool = True) -> DataFrame:
    """Mean over neighbours and itself, rectified, scaled to unit length: node, embedding; `hops` times.

    `edges`: a, b (undirected, repeated edges count); `features`: node, embedding. One join and one aggregation by node a
    hop: the means of all positions are aggregated side by side, partially before the shuffle, and a hub's edges are joined
    in pieces of HUB_PIECE to copies of its one row, so a hub with a third of all edges is no hot task. Each hop is written
    to the shared checkpoint folder and the one before it removed.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).union(features.select("node", "node"))
    # repeated edges meet the same embedding: they are one row with their number
    both = both.toDF("node", "other").groupBy("node", "other").agg(F.count(F.lit(1)).alias("times"))
    state, made = features, []
    if hops > 1:
        both = materialize(both)
        made.append(both)
    hubs = materialize(both.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / HUB_PIECE).cast("bigint").alias("pieces")).filter("pieces > 1"))
    made.append(hubs)
    has_hubs = not hubs.isEmpty()
    if has_hubs:
        both = both.join(hubs, "other", "left").withColumn("piece", F.pmod(F.xxhash64("node"), F.coalesce("pieces", F.lit(1).cast("bigint")))).drop("pieces")
    for _ in range(hops):
        copies, on = state.withColumnRenamed("node", "other"), ["other"]
        if has_hubs:
            last_piece = F.coalesce("pieces", F.lit(1).cast("bigint")) - 1
            copies, on = copies.join(hubs, "other", "left").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last_piece))).drop("pieces"), ["other", "piece"]
        met = both.join(copies, on)
        sums = met.groupBy("node").agg(F.sum("times").alias("deg"), *[F.sum(F.col("embedding")[i] * F.col("times")).alias(f"s{i}") for i in range(dim)])
        mean = [F.greatest(F.col(f"s{i}") / F.col("deg"), F.lit(0.0)) for i in range(dim)]
        last, state = state, sums.select("node", F.array(*mean).alias("embedding"))
        if normalize:
            norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
            state = state.withColumn("norm", norm).select("node", F.when(F.col("norm") > 0, F.transform("embedding", lambda x: x / F.col("norm"))).otherwise(F.col("embedding")).alias("embedding"))
        if hops > 1:
            state = materialize(state)
            if last is not features:
                discard(last)
    if hops > 1:
        discard(*made)
    return state


def plane_projection(lon: F.Column, lat: F.Column, width: float, height: float) -> tuple[F.Column, F.Column]:
    """Equirectangular pixels of a longitude and latitude."""
    return (lon + 180.0) / 360.0 * width, (90.0 - lat) / 180.0 * height


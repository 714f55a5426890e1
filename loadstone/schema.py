"""The edge-event contract, node and edge enumerations and the small code dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

EDGE_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("edge_type", T.StringType()),
        T.StructField("src_type", T.StringType()),
        T.StructField("src_id", T.StringType()),
        T.StructField("dst_type", T.StringType()),
        T.StructField("dst_id", T.StringType()),
        T.StructField("event_time", T.StringType()),
        T.StructField("event_grain", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("inference_method", T.StringType()),
        T.StructField("source_family", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("source_mtime", T.LongType()),
        T.StructField("attrs_json", T.StringType()),
    ]
)
EDGE_COLUMNS = EDGE_EVENT.fieldNames()

# The node and edge types of the data model.
NODE_TYPES = (
    "shipper", "carrier", "commodity", "state", "corridor", "country",
    "rail_operator", "maritime_org", "lei", "ticker", "national",
)
EDGE_TYPES = (
    "observed_haul", "hauls_commodity", "operates_in", "modeled_flow", "shipment_share", "rail_metric",
    "commodity_pressure", "origin_pressure", "trade_import", "carrier_risk", "pipeline_signal",
    "identity_match", "maritime_license",
)

# Confidence labels from weakest to strongest.
CONFIDENCE_ORDER = ("blocked_fuzzy", "weak", "medium", "strong", "exact")


def empty_events(spark: SparkSession) -> DataFrame:
    """An edge-event table without rows, with its full schema."""
    return spark.createDataFrame([], EDGE_EVENT)

"""Queries of the language operators (p3, p4, p6, p7, p8) and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loadstone.llm import bpe, matching, packing, sentences, variants


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return variants.spelling_groups(_table(spark, d, "top_shippers"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.group_pairs(p3_groups(spark, d))


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    events = _table(spark, d, "all_events")
    links = events.filter(events["edge_type"].startswith("identity_match") & (events["dst_type"] == "ticker")).select("src_id", "dst_id", "confidence")
    return matching.match_companies(_table(spark, d, "top_shippers"), _table(spark, d, "sec_tickers"), links)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_matches(spark, d).filter("accepted").select("shipper_id", "cik")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(_table(spark, d, "documents").select("doc_id", "text"))


def p7_bins(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_table(spark, d, "documents"))


def p7_search(spark: SparkSession, d: str) -> DataFrame:
    return packing.report_documents(_table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(_table(spark, d, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (p3_found, p3_groups, p4_found, p4_matches, p6_ids, p7_bins, p7_search, p8_found)}
ORACLE: dict[str, str] = {}

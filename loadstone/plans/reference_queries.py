"""Queries of the graph, report and catalogue operators over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadstone.functions import text as tx
from loadstone.functions.periods import period_code, period_text
from loadstone.operators import edges as ed
from loadstone.operators import graph as gr
from loadstone.operators import macro as mc
from loadstone.operators import quality as ql
from loadstone.operators import temporal as tm
from loadstone.operators import ties as ti
from loadstone.session import ensure_checkpoint_dir, materialize, table
from loadstone.streaming import hauls as st

FROM_MONTH = "202201"
AS_OF = "202601"


def _insp(spark: SparkSession, d: str) -> DataFrame:
    return ed.inspections(table(spark, d, "fmcsa_events"))


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    return ed.monthly_hauls(_insp(spark, d), FROM_MONTH)


def _flows(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Line items as modelled flows with tons, value, mode and year; of origin and destination nation and the code of the
    part what `columns` name, so a report joins only what it needs. Every line item has its part, supplier and order."""
    nation = table(spark, d, "nation")
    rows = table(spark, d, "lineitem").select(
        "l_partkey", "l_suppkey", "l_orderkey", F.col("l_returnflag").alias("mode"), F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("tons"), F.col("l_extendedprice").alias("value")
    )
    named = lambda key, name: F.broadcast(nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name)))  # noqa: E731  25 rows
    if "code" in columns:
        rows = rows.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("code")), "l_partkey")
    if "origin" in columns:
        rows = rows.join(table(spark, d, "supplier").join(named("s_nationkey", "origin"), "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "origin"), "l_suppkey")
    if "destination" in columns:
        buyers = table(spark, d, "customer").join(named("c_nationkey", "destination"), "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "destination")
        rows = rows.join(table(spark, d, "orders").join(buyers, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "destination"), "l_orderkey")
    return rows.select(*columns, "mode", "year", "tons", "value")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "all_events")


# --- edges -------------------------------------------------------------------------------------------------------------


def haul_edges_monthly(spark, d):
    return ed.haul_edges(_monthly(spark, d)).select("event_id", "src_id", "dst_id", "event_time", "weight", "confidence", "attrs_json")


def haul_edges_commodity(spark, d):
    return ed.commodity_edges(_monthly(spark, d)).select("event_id", "src_id", "dst_id", "event_time", "weight", "confidence", "attrs_json")


def haul_edges_state(spark, d):
    return ed.state_edges(_monthly(spark, d)).select("event_id", "src_id", "dst_id", "event_time", "weight", "confidence", "attrs_json")


def macro_modeled_flow(spark, d):
    return ed.flow_edges(_flows(spark, d, "origin", "destination", "code").filter("year = 1997"), "1997").select("event_id", "src_id", "dst_id", "weight", "attrs_json")


def macro_shipment_share(spark, d):
    rows = _flows(spark, d, "code").select("code", F.col("tons").alias("weight"), F.col("value").alias("factor"))
    return ed.share_edges(rows, "1997").select("event_id", "src_id", "weight")


def carrier_risk(spark, d):
    insp = _insp(spark, d)
    policies = insp.filter("dot IS NOT NULL").groupBy("dot").agg(F.count_distinct("inspection_id").alias("n"))
    return ed.risk_edges(insp, policies).select("event_id", "src_id", "event_time", "weight", "confidence", "attrs_json")


def licence_edges(spark, d):
    return ed.licence_edges(table(spark, d, "fmc_licences"), "2026").select("event_id", "src_id", "weight", "attrs_json")


def edges_union_by_type(spark, d):
    m = materialize(_monthly(spark, d))  # read three times
    every = ed.union_edges(ed.haul_edges(m), ed.commodity_edges(m), ed.state_edges(m), ed.licence_edges(table(spark, d, "fmc_licences"), "2026"))
    return gr.type_summary(every)


def pipeline_miles(spark, d):
    rows = _events(spark, d).filter((gr.base_type() == "pipeline_signal") & (F.length("src_id") == 2) & (F.col("weight") > 0))
    return rows.groupBy("src_id").agg(tx.exact_sum("weight").alias("miles"))


def rail_dwell(spark, d):
    rows = _events(spark, d).filter(F.col("edge_type").ilike("%rail%") & F.col("weight").isNotNull())
    g = rows.groupBy("src_id").agg(tx.exact_sum("weight").alias("s"), F.count("weight").alias("n"))
    return g.select("src_id", (F.col("s") / F.col("n")).alias("mean_weight")).orderBy(F.col("mean_weight").desc_nulls_last(), "src_id").limit(10)


def rail_summary(spark, d):
    rows = _events(spark, d).filter(gr.base_type() == "rail_metric")
    g = rows.groupBy("src_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("edge_type").alias("measures"), F.max(period_code(F.col("event_time"))).alias("latest"))
    return g.select("src_id", "n", "measures", period_text(F.col("latest")).alias("latest"))


def pressure_latest(spark, d):
    rows = _events(spark, d).filter(gr.base_type().isin("commodity_pressure", "origin_pressure") & F.col("weight").isNotNull()).withColumn("t", period_code(F.col("event_time"))).filter("t IS NOT NULL AND src_id IS NOT NULL")
    out = tm.latest_and_prior(rows, "src_id", "t", "weight")
    return out.select("src_id", period_text(F.col("latest_time")).alias("latest_time"), "latest_value", period_text(F.col("prior_time")).alias("prior_time"), "prior_value")


def pressure_tail(spark, d):
    rows = _events(spark, d).filter((gr.base_type() == "origin_pressure") & F.col("weight").isNotNull() & F.col("src_id").isNotNull()).withColumn("t", period_code(F.col("event_time")))
    return tm.series_tail(rows.filter("t IS NOT NULL"), "src_id", "t", "weight", 8)


def trade_latest_month(spark, d):
    rows = _events(spark, d).filter((gr.base_type() == "trade_import") & F.col("event_time").rlike("^[0-9]{6}$"))
    newest = rows.agg(F.max("event_time").alias("event_time"))
    return rows.join(F.broadcast(newest), "event_time").groupBy("event_time", "dst_id").agg(tx.exact_sum("weight").alias("weight"))  # one row


# --- graph -------------------------------------------------------------------------------------------------------------


def graph_nodes(spark, d):
    return gr.nodes(_events(spark, d))


def graph_edge_catalog(spark, d):
    return gr.edge_catalog(_events(spark, d))


def graph_type_summary(spark, d):
    return gr.type_summary(_events(spark, d))


def evidence_subgraph_edges(spark, d):
    return gr.evidence_edges(_events(spark, d), "17").select("event_id", "edge_type", "src_id", "dst_id", "weight")


def evidence_subgraph_nodes(spark, d):
    return gr.nodes(gr.evidence_edges(_events(spark, d), "17"))


def edge_subsample(spark, d):
    types = ("modeled_flow", "trade_import", "rail_metric", "origin_pressure", "identity_match")
    return gr.subsample(_events(spark, d), "202406", types, 2000, 100)


#: The reference's listed types, in its order (encoder.py); with its limit of 250,000 and least quota of 500.
STRATIFIED = ("observed_haul", "hauls_commodity", "operates_in", "origin_pressure", "maritime_license", "rail_metric", "commodity_pressure", "trade_import", "modeled_flow")


def edge_subsample_staged(spark, d):
    return gr.staged_subsample(_events(spark, d), "202406", STRATIFIED)


def _message_input(spark, d):
    n = table(spark, d, "nation")
    edges = n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("a"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("b"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return edges, nodes


def message_pass_one_hop(spark, d):
    edges, nodes = _message_input(spark, d)
    x = F.array(F.length("node") * 1.0, F.ascii("node") * 1.0, F.substring("node", 2, 9).cast("int") - 3.0)
    out = gr.message_pass(edges, nodes.select("node", x.alias("embedding")), 1, 3, normalize=False)
    return out.select("node", *[F.col("embedding")[i].alias(f"x{i}") for i in range(3)])


def message_pass_hop(spark, d):
    """One normalised hop over all typed endpoints."""
    edges, nodes = gr.typed_edges(_events(spark, d))
    return gr.message_pass(edges, nodes.select("node", gr.hash_features(F.col("node")).alias("embedding")), 1)


def message_pass_epochs(spark, d):
    """The reference's embeddings: all typed endpoints, 32 positions, 20 epochs."""
    edges, nodes = gr.typed_edges(_events(spark, d))
    return gr.message_pass(edges, nodes.select("node", gr.hash_features(F.col("node")).alias("embedding")), 20)


def hash_features(spark, d):
    _, nodes = gr.typed_edges(_events(spark, d))
    return nodes.select("node", gr.hash_features(F.col("node")).alias("features"))


# --- change over time ----------------------------------------------------------------------------------------------------


def _share(spark, d):
    flows = _events(spark, d).filter((gr.base_type() == "modeled_flow") & (F.col("dst_type") == "commodity"))
    return tm.shares(flows.select(F.col("dst_id").alias("code"), "weight").filter("code IS NOT NULL"), "code", "weight")


def change_scores_national(spark, d):
    return tm.change_scores(tm.monthly_weights(_events(spark, d)), _share(spark, d), ["code"]).drop("adjacent")


def change_scores_corridor(spark, d):
    return tm.change_scores(tm.monthly_weights(_events(spark, d), True), _share(spark, d), ["code", "state"]).drop("adjacent")


def change_scores_gap(spark, d):
    scores = tm.change_scores(tm.monthly_weights(_events(spark, d), True), _share(spark, d), ["code", "state"])
    return scores.filter("NOT adjacent").select("code", "state", "snapshot_month", "truck_weight", "prior_weight")


def snapshot_month(spark, d):
    return tm.snapshot_month(tm.monthly_weights(_events(spark, d)), AS_OF, 100.0, 8)


def snapshot_month_fallback(spark, d):
    return tm.snapshot_month(tm.monthly_weights(_events(spark, d)), "190001", 1e12, 99)


def graph_query_top_states(spark, d):
    scores = tm.change_scores(tm.monthly_weights(_events(spark, d), True), _share(spark, d), ["code", "state"]).filter("code = '17' AND snapshot_month = '202406'")
    return scores.select("state", "truck_weight", "change_score").orderBy(F.col("truck_weight").desc(), "state").limit(5)


def graph_query_top_carriers(spark, d):
    rows = _events(spark, d).filter((gr.base_type() == "hauls_commodity") & (F.col("dst_id") == "17") & (F.col("event_time") == "202406"))
    return mc.top(rows, ["src_id"], "weight", 5)


def origin_join_class(spark, d):
    rows = _events(spark, d).filter((gr.base_type() == "origin_pressure") & F.col("event_time").rlike("^[0-9]{6}$") & F.col("src_id").isNotNull())
    return tm.classify_periods(rows, "src_id", "event_time", F.lit("202406"))


# --- reports -------------------------------------------------------------------------------------------------------------


def freight_totals(spark, d):
    return mc.totals(_flows(spark, d), ["tons", "value"])


def freight_by_mode(spark, d):
    return mc.by_key_with_share(_flows(spark, d), "mode", "tons")


def freight_corridors(spark, d):
    return mc.top(_flows(spark, d, "origin", "destination"), ["origin", "destination"], "tons", 20)


def freight_commodities(spark, d):
    return mc.top(_flows(spark, d, "code"), ["code"], "tons", 15)


def freight_yoy(spark, d):
    return mc.year_over_year(_flows(spark, d), "mode", "year", "tons", 1996, 1997)


def moving_commodity(spark, d):
    flows = _flows(spark, d, "code")
    return mc.blended(mc.by_key_with_share(flows, "code", "tons"), mc.by_key_with_share(flows.filter("value > 50000"), "code", "value"), "code", (0.6, 0.4))


def commodity_top_corridors(spark, d):
    return mc.top_per_group(_flows(spark, d, "origin", "destination", "code"), "code", ["origin", "destination"], "tons", 3)


def top_commodity_modes(spark, d):
    flows = _flows(spark, d, "code")
    largest = mc.top(flows, ["code"], "tons", 3).select("code")
    return flows.join(F.broadcast(largest), "code", "left_semi").groupBy("code", "mode").agg(tx.exact_sum("tons", 4).alias("tons"))  # at most 3 rows


# --- ties ------------------------------------------------------------------------------------------------------------------


def inspection_coverage(spark, d):
    return ti.coverage(_insp(spark, d))


def cargo_ties(spark, d):
    insp = _insp(spark, d)
    return ti.cargo_ties(insp, ti.registry(insp), 3)


def cargo_ties_state(spark, d):
    insp = _insp(spark, d)
    return ti.cargo_ties(insp, ti.registry(insp), 2, state="TX")


def cargo_ties_lane(spark, d):
    insp = _insp(spark, d)
    return ti.cargo_ties(insp, ti.registry(insp), 2, only_lane="grain_feed")


def shipper_carriers(spark, d):
    return ti.shipper_carriers(_insp(spark, d), "feed mills")


def truck_signal(spark, d):
    return ti.truck_signals(_insp(spark, d))


def entity_edges(spark, d):
    return ti.entity_edges(_insp(spark, d), table(spark, d, "sec_tickers"))


def carrier_leads(spark, d):
    insp = _insp(spark, d)
    return ti.flagged_carriers(insp, ti.registry(insp), 2, 200)


def identity_exact(spark, d):
    a = table(spark, d, "top_shippers").select("shipper_norm", tx.name_core(F.col("shipper_norm")).alias("core"), "n")
    b = table(spark, d, "fmc_licences").select("row_id", tx.name_core(F.col("`Legal Name`")).alias("core"))
    return a.join(b.filter("core <> ''"), "core").select("shipper_norm", "row_id", F.least(F.lit(100.0), F.lit(50.0) + F.col("n") / 20.0).alias("weight"))


def identity_substring(spark, d):
    longs = table(spark, d, "top_shippers").select(F.col("shipper_norm").alias("l"))
    shorts = table(spark, d, "sec_tickers").select(F.substring_index("title_norm", " ", 2).alias("s"))
    return ed.contained_names(longs, shorts)


def identity_exists(spark, d):
    linked = _events(spark, d).filter(gr.base_type() == "identity_match").select(F.col("src_id").alias("shipper_norm"))
    return table(spark, d, "top_shippers").select("shipper_id", "shipper_norm").join(linked, "shipper_norm", "left_semi").select("shipper_id", "shipper_norm")


# --- series ------------------------------------------------------------------------------------------------------------------


def price_endpoints(spark, d):
    return tm.endpoints(table(spark, d, "events"), "user_id", "ts", "event_id", "value", 5, 3)


def return_band(spark, d):
    e = tm.endpoints(table(spark, d, "events"), "user_id", "ts", "event_id", "value", 5, 3)
    ret = F.lit(100.0) * (F.col("last_value") - F.col("first_value")) / F.nullif("first_value", F.lit(0.0))
    return e.withColumn("ret", ret).filter((F.col("n_obs") >= 5) & (F.col("first_value") >= 1) & F.col("ret").between(-50, 150)).select("user_id", "n_obs", "ret")


def market_best_per_group(spark, d):
    return ti.best_per_group(table(spark, d, "events").select("event_type", "event_id", "user_id", "value"), "event_type", "value", "event_id")


# --- functions -----------------------------------------------------------------------------------------------------------------


def _names(spark, d):
    return table(spark, d, "fmcsa_events").select("row_id", "SHIPPER_NAME")


def name_norm_all(spark, d):
    return _names(spark, d).select("row_id", tx.name_norm(F.col("SHIPPER_NAME")).alias("norm"))


def name_norm_first(spark, d):
    return _names(spark, d).select("row_id", tx.name_norm_first(F.col("SHIPPER_NAME")).alias("norm"))


def name_norm_core(spark, d):
    return _names(spark, d).select("row_id", tx.name_core(F.col("SHIPPER_NAME")).alias("core"))


def slug_names(spark, d):
    return _names(spark, d).select("row_id", tx.slug(F.col("SHIPPER_NAME")).alias("slug"))


def code_pad_hs(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"))
    number = F.concat(F.col("p_partkey").cast("string"), F.col("size"), F.lit("01"))
    return rows.select("p_partkey", tx.pad_code(F.col("size")).alias("padded"), tx.hs_code(number).alias("hs"))


def stable_ids(spark, d):
    rows = table(spark, d, "fmc_licences")
    return rows.select("row_id", tx.key_hash("licence", F.col("row_id"), F.col("license_kind")).alias("key"), tx.stable_id(F.col("license_kind"), F.col("state"), F.col("row_id")).alias("stable"))


def try_casts(spark, d):
    rows = table(spark, d, "fmcsa_events")
    n = F.col("DOT_NUMBER")
    return rows.select("row_id", F.when(n.rlike("^[0-9]{1,15}$"), n.try_cast("bigint")).alias("as_bigint"), F.when(n.rlike(r"^[0-9]{1,9}\.[0-9]$"), n.try_cast("double")).alias("as_double"))


def json_roundtrip(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", k.try_cast("bigint").alias("k"), tx.json_object(k=k.try_cast("bigint"), none=F.lit(None).cast("string")).alias("again"))


def confidence_lexical_and_ranked(spark, d):
    rows = _events(spark, d).filter("confidence IS NOT NULL AND edge_type IS NOT NULL")
    return rows.groupBy("edge_type").agg(F.max("confidence").alias("lexical"), F.max_by("confidence", tx.confidence_rank(F.col("confidence"))).alias("ranked"))


def period_formats(spark, d):
    return _events(spark, d).groupBy("event_time").agg(F.count(F.lit(1)).alias("n")).select("event_time", "n", period_text(period_code(F.col("event_time"))).alias("period"))


def distinct_list(spark, d):
    rows = _insp(spark, d).filter("dot IS NOT NULL")
    return rows.groupBy("dot").agg(F.array_join(F.sort_array(F.collect_set("state")), " | ").alias("states"), F.count_distinct("shipper").alias("shippers"))


def map_projection(spark, d):
    x, y = gr.plane_projection(F.col("c_acctbal") / 100.0, F.col("c_nationkey") * 3.0, 960.0, 480.0)
    return table(spark, d, "customer").select("c_custkey", x.alias("x"), y.alias("y"))


def embedding_activation(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.floor(ql.activation(F.col("embedding")) * 100).alias("activation"))


# --- catalogue -----------------------------------------------------------------------------------------------------------------


def stub_check(spark, d):
    return table(spark, d, "documents").select("doc_id", ql.stub_reason(F.col("text")).alias("reason")).filter("reason IS NOT NULL")


def banned_phrase_scan(spark, d):
    return ql.phrase_hits(table(spark, d, "documents"), "text", ["customs hold", "no answer", "out of service"], "source")


def content_signature_dedup(spark, d):
    return ql.first_by_signature(table(spark, d, "documents"), "text", "doc_id")


def newest_release(spark, d):
    rows = table(spark, d, "fmc_licences").select("row_id", F.trim("`Organization No.`").alias("number"), F.col("loaded_at").cast("string").alias("loaded_at")).filter("number <> ''")
    return ql.newest(rows, [F.col("number")], [F.col("loaded_at").desc_nulls_last(), F.col("row_id").desc()])


def family_manifest(spark, d):
    return ql.manifest(table(spark, d, "documents"), "source", "n_chars")


def manifest_merge(spark, d):
    docs = table(spark, d, "documents").filter("source IS NOT NULL")
    old = docs.filter("lang = 'en'").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    new = docs.filter("doc_type = 'report'").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return ql.merged(old, new, "source", "n")


def missing_plan(spark, d):
    expected = _insp(spark, d).filter("dot IS NOT NULL").select(F.col("dot").cast("string").alias("src_id"))
    present = _events(spark, d).filter(gr.base_type() == "hauls_commodity").select("src_id")
    return ql.missing(expected, present, "src_id")


def validate_outputs(spark, d):
    scores = tm.change_scores(tm.monthly_weights(_events(spark, d)), _share(spark, d), ["code"]).drop("adjacent")
    return ql.violations(scores, ["code", "snapshot_month", "prior_weight"], {"change_score": (0.0, 100.0)})


def status_histogram(spark, d):
    return ql.histogram(table(spark, d, "orders"), "o_orderstatus")


def incremental_changed(spark, d):
    rows = table(spark, d, "fmc_licences").select("row_id", F.col("`Organization No.`").alias("number"), F.md5(F.col("`Legal Name`")).alias("signature"), "loaded_at")
    old = rows.filter("loaded_at < timestamp'2024-01-01'")
    return ql.changed(rows.filter("loaded_at >= timestamp'2024-01-01'"), old, ["number", "signature"]).select("row_id", "number", "signature")


def windowed_event_totals(spark, d):
    return st.windowed_counts(table(spark, d, "events"))


def stream_event_totals(spark, d):
    """The same totals by a stream over the table's file, all available input taken once."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{d}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", True).parquet(path)
    return st.stateful_totals(source, f"{base}/out", f"{base}/checkpoint")


QUERIES = {
    f.__name__: f
    for f in (
        haul_edges_monthly, haul_edges_commodity, haul_edges_state, macro_modeled_flow, macro_shipment_share, carrier_risk, licence_edges, edges_union_by_type, pipeline_miles, rail_dwell, rail_summary,
        pressure_latest, pressure_tail, trade_latest_month, graph_nodes, graph_edge_catalog, graph_type_summary, evidence_subgraph_edges, evidence_subgraph_nodes, edge_subsample, edge_subsample_staged,
        message_pass_one_hop, message_pass_hop, message_pass_epochs, hash_features, change_scores_national, change_scores_corridor, change_scores_gap, snapshot_month, snapshot_month_fallback,
        graph_query_top_states, graph_query_top_carriers, origin_join_class, freight_totals, freight_by_mode, freight_corridors, freight_commodities, freight_yoy, moving_commodity,
        commodity_top_corridors, top_commodity_modes, inspection_coverage, cargo_ties, cargo_ties_state, cargo_ties_lane, shipper_carriers, truck_signal, entity_edges, carrier_leads,
        identity_exact, identity_substring, identity_exists, price_endpoints, return_band, market_best_per_group, name_norm_all, name_norm_first, name_norm_core, slug_names, code_pad_hs,
        stable_ids, try_casts, json_roundtrip, confidence_lexical_and_ranked, period_formats, distinct_list, map_projection, embedding_activation, stub_check, banned_phrase_scan,
        content_signature_dedup, newest_release, family_manifest, manifest_merge, missing_plan, validate_outputs, status_histogram, incremental_changed, windowed_event_totals, stream_event_totals,
    )
}

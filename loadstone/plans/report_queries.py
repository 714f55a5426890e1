"""Queries of the remaining edge kinds, composite reports, registers and file sources, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadstone.functions import text as tx
from loadstone.operators import economy as ec
from loadstone.operators import edges as ed
from loadstone.operators import graph as gr
from loadstone.operators import registers as rg
from loadstone.operators import temporal as tm
from loadstone.operators import ties as ti
from loadstone.plans import reference_queries as rq
from loadstone.plans import reference_sql as rs
from loadstone.session import ensure_checkpoint_dir, materialize, table
from loadstone.sources import readers as rd
from loadstone.sources import sinks as sk

_EDGE = ["event_id", "edge_type", "src_id", "dst_id", "event_time", "weight"]


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _base(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return rq._events(spark, d).filter(gr.base_type() == kind)


# --- edges ---------------------------------------------------------------------------------------------------------------


def _trade(spark, d):
    """Line items written as import records by place and read back by the positional reader."""
    line = table(spark, d, "lineitem")
    text = F.concat(F.rpad(F.col("l_partkey").cast("string"), 10, " "), F.date_format("l_shipdate", "yyyyMM"), F.lpad(F.floor("l_extendedprice").cast("string"), 60, " "))
    return ed.trade_edges(rd.read_positional_imports(line.select(text.alias("value"))))


def edges_trade(spark, d):
    return _trade(spark, d).select(*_EDGE)


def _bilateral(spark, d):
    nation = F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country")))  # 25 rows
    supplier = table(spark, d, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "country")
    rows = table(spark, d, "lineitem").join(supplier, "l_suppkey").select("country", F.col("l_partkey").cast("string").alias("hs"), F.date_format("l_shipdate", "yyyyMM").alias("month"), F.col("l_extendedprice").alias("value"))
    return ed.bilateral_trade_edges(rows)


def edges_bilateral_trade(spark, d):
    return _bilateral(spark, d).select(*_EDGE)


def _points(spark, d, kind):
    return _base(spark, d, kind).select(F.col("src_id").alias("series"), F.col("event_time").alias("period"), F.col("weight").alias("value"))


def edges_commodity_pressure(spark, d):
    return ed.pressure_edges(_points(spark, d, "commodity_pressure"), "commodity_pressure", "commodity", "17").select(*_EDGE)


def edges_origin_pressure(spark, d):
    return ed.pressure_edges(_points(spark, d, "origin_pressure"), "origin_pressure", "country", "17").select(*_EDGE)


def _rail(spark, d):
    rows = _base(spark, d, "rail_metric").select(F.col("src_id").alias("operator"), F.col("edge_type").alias("measure"), F.col("weight").alias("value"), F.col("event_id").alias("place"), F.col("event_time").alias("period"))
    return rows.filter("place IS NOT NULL")


def edges_rail_annual(spark, d):
    return ed.rail_edges(_rail(spark, d), "2025").select(*_EDGE)


def edges_rail_dwell(spark, d):
    return ed.dwell_edges(_rail(spark, d)).select(*_EDGE)


def _pipeline(spark, d):
    return ed.pipeline_edges(_base(spark, d, "pipeline_signal").select(F.col("src_id").alias("state"), F.col("weight").alias("miles")), "2025")


def edges_pipeline(spark, d):
    return _pipeline(spark, d).select(*_EDGE)


def _identity(spark, d):
    shippers = table(spark, d, "top_shippers").select(F.col("shipper_norm").alias("shipper"), "n")
    return ed.identity_edges(shippers, table(spark, d, "sec_tickers").select(F.col("title_norm").alias("title"), "ticker"))


def edges_identity(spark, d):
    return _identity(spark, d).select(*_EDGE, "confidence")


def identity_by_core(spark, d):
    """Listed shipper spellings whose core is that of a name in the inspections, with how many inspections have it."""
    typed = table(spark, d, "fmcsa_events").select(tx.name_core(F.col("SHIPPER_NAME")).alias("core")).filter("core <> ''").groupBy("core").agg(F.count(F.lit(1)).alias("inspections"))
    return table(spark, d, "top_shippers").select("shipper_norm", tx.name_core(F.col("shipper_norm")).alias("core")).join(typed, "core")


def identity_within_titles(spark, d):
    """Whole cores of shippers' names that occur in a whole title."""
    return ed.contained_names(table(spark, d, "sec_tickers").select(F.col("title_norm").alias("l")), table(spark, d, "top_shippers").select(tx.name_core(F.col("shipper_norm")).alias("s")))


def _all_edges(spark, d):
    """The whole graph build: all thirteen edge types from their sources in one table."""
    insp, m = rq._insp(spark, d), materialize(rq._monthly(spark, d))
    policies = insp.filter("dot IS NOT NULL").groupBy("dot").agg(F.count_distinct("inspection_id").alias("n"))
    flows = rq._flows(spark, d, "origin", "destination", "code").filter("year = 1997")
    shipments = rq._flows(spark, d, "code").select("code", F.col("tons").alias("weight"), F.col("value").alias("factor"))
    return ed.union_edges(
        ed.haul_edges(m), ed.commodity_edges(m), ed.state_edges(m), ed.flow_edges(flows, "1997"), ed.share_edges(shipments, "1997"), ed.risk_edges(insp, policies), ed.licence_edges(table(spark, d, "fmc_licences"), "2026"), _trade(spark, d),
        _bilateral(spark, d), ed.pressure_edges(_points(spark, d, "commodity_pressure"), "commodity_pressure", "commodity", "17"), ed.pressure_edges(_points(spark, d, "origin_pressure"), "origin_pressure", "country", "17"),
        ed.rail_edges(_rail(spark, d), "2025"), ed.dwell_edges(_rail(spark, d)), _pipeline(spark, d), _identity(spark, d),
    )


def graph_build(spark, d):
    return gr.type_summary(_all_edges(spark, d))


def linear_pipeline(spark, d):
    """Build, baseline, picked month and trends in one composition, without files between."""
    events = ed.haul_edges(materialize(rq._monthly(spark, d)))
    monthly = tm.monthly_weights(events)
    scores = tm.change_scores(monthly, rq._share(spark, d), ["code"])
    return ec.trend_rows(events, scores, tm.snapshot_month(monthly, rq.AS_OF, 1.0, 1))


# --- reports ---------------------------------------------------------------------------------------------------------------


def _scores(spark, d, by_state=False):
    return tm.change_scores(tm.monthly_weights(rq._events(spark, d), by_state), rq._share(spark, d), ["code", *["state"] * by_state])


def _picked(spark, d):
    return tm.snapshot_month(tm.monthly_weights(rq._events(spark, d)), rq.AS_OF, 100.0, 8)


def graph_query(spark, d):
    return ec.code_answer(rq._events(spark, d), _scores(spark, d), _scores(spark, d, True), _picked(spark, d), "17", origin="origin_pressure")


def evidence_pack_edges(spark, d):
    return gr.evidence_subgraph(rq._events(spark, d), "17").select("event_id", "edge_type", "src_id", "dst_id", "event_time", "weight")


def price_endpoints_long(spark, d):
    """The operator's own windows: looked back 63 values, mean of the last 20."""
    return tm.endpoints(table(spark, d, "events"), "user_id", "ts", "event_id", "value")


def return_band_long(spark, d):
    """Returns of series of 20 observations or more that began at 1 or more, within the band."""
    ret = F.lit(100.0) * (F.col("last_value") - F.col("first_value")) / F.nullif("first_value", F.lit(0.0))
    return price_endpoints_long(spark, d).withColumn("ret", ret).filter((F.col("n_obs") >= 20) & (F.col("first_value") >= 1) & F.col("ret").between(-50, 150)).select("user_id", "n_obs", "ret")


def trend_radar(spark, d):
    return ec.trend_rows(rq._events(spark, d), _scores(spark, d), _picked(spark, d))


def reproduction_query(spark, d):
    return ec.reproduction(rq._events(spark, d), _scores(spark, d), "17")


def _shipments(spark, d):
    return table(spark, d, "part").join(table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity"), "p_partkey").select(F.col("p_type").alias("code"), (F.col("l_quantity") * F.col("p_size")).alias("amount"))


def transport_economy(spark, d):
    ties = rq._insp(spark, d).filter("dot IS NOT NULL").groupBy("code", "dot").agg(F.count(F.lit(1)).alias("n"))
    return ec.transport_economy(rq._flows(spark, d, "code"), _shipments(spark, d), ties)


def commodity_economy(spark, d):
    deposits = table(spark, d, "part").select(F.col("p_brand").alias("name"))
    series = table(spark, d, "events").filter("value IS NOT NULL AND user_id IS NOT NULL").select(F.col("user_id").cast("string").alias("name"), F.col("ts").alias("time"), "value")
    return ec.commodity_economy(rq._flows(spark, d, "code"), _shipments(spark, d), deposits, series)


def truck_signal_whole(spark, d):
    """Truck signals joined with the carriers' registry, with the method that told the commodity and the registry's lane."""
    insp = rq._insp(spark, d)
    kept = insp.filter(F.col("dot").isNotNull() & F.col("insp_date").isNotNull()).withColumn("method", ec.method_of(F.col("hazmat"), F.col("tank")))
    g = kept.groupBy("dot", "shipper", "code", "method").agg(F.count(F.lit(1)).alias("n"), F.max("insp_date").cast("string").alias("last_date")).filter("n >= 3")
    has = insp.filter("dot IS NOT NULL").groupBy("dot").agg(*[F.max(F.when(F.col("code") == c, "X")).alias(f) for f, c in (("metal", "11"), ("grain", "02"), ("chem", "18"), ("liqgas", "17"), ("coal", "19"), ("gen", "31"))])
    lanes = has.select("dot", ec.lane_of_flags({f: F.col(f) for f in ("metal", "grain", "chem", "liqgas", "coal", "gen")}).alias("lane"), ec.lane_of_flags({f: F.col(f) for f in ("metal", "grain", "chem", "liqgas", "coal", "gen")}, metal_first=False).alias("lane_without_metal"))
    return g.join(lanes, "dot", "left").join(ti.registry(insp).select("dot", "legal_name"), "dot", "left")


# --- registers and small operators -------------------------------------------------------------------------------------------


def code_labels(spark, d):
    labels = spark.createDataFrame([("17", "fuel oils"), ("02", "grains"), ("19", "coal")], "key string, label string")
    rows = _base(spark, d, "hauls_commodity").filter("dst_id IS NOT NULL").groupBy(F.col("dst_id").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return ec.labelled(rows, "code", labels, "code ")


def ticker_overlap(spark, d):
    rows = table(spark, d, "sec_tickers").filter("hq_state IS NOT NULL AND exchange IS NOT NULL")
    lists = rows.groupBy("hq_state").agg(F.collect_set(F.when(F.col("exchange") == "OTC", F.col("sic_text"))).alias("a"), F.collect_set(F.when(F.col("exchange") != "OTC", F.col("sic_text"))).alias("b"))  # wordings, some dozens
    return lists.select("hq_state", F.array_join(ec.overlap(F.col("a"), F.col("b")), " | ").alias("shared"))


def rounding_casts(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rg.rounded(F.col("l_extendedprice") / 100).alias("rounded"), rg.rounded(-F.col("l_extendedprice") / 100).alias("negative"))


def licence_ages(spark, d):
    as_of = F.lit("2026-07-01").cast("timestamp")
    age = rg.age_days(F.col("loaded_at"), as_of)
    return table(spark, d, "fmc_licences").select("row_id", F.floor(age).cast("bigint").alias("age"), rg.needs_refresh(F.col("`Legal Name`").isNull(), age, F.lit(365)).alias("refresh"), F.array_join(rg.months_before(F.col("loaded_at").cast("date"), 3), " ").alias("months"))


def gap_register(spark, d):
    docs = table(spark, d, "documents").filter("source IS NOT NULL AND published IS NOT NULL")
    reason = F.when(F.coalesce(F.length(F.trim("text")), F.lit(0)) < 20, "below_stub")
    inventory = docs.select(F.concat_ws("/", "source", "doc_type").alias("family"), reason.alias("reason"), F.col("published").alias("modified"))
    expected = docs.filter("doc_type IS NOT NULL").select("doc_type").distinct().crossJoin(F.broadcast(spark.createDataFrame([("nowhere", 30, 1), ("web", 900, 2)], "source string, refresh_days int, priority int")))  # two rows
    expected = expected.select(F.concat_ws("/", "source", "doc_type").alias("family"), "refresh_days", "priority")
    out = rg.gap_register(expected, inventory, F.lit("2026-07-01").cast("timestamp"))
    return out.select("family", "status", F.floor("age").cast("bigint").alias("age"), "priority", "action")


def missing_categories(spark, d):
    insp = rq._insp(spark, d).filter("dot IS NOT NULL").select(F.col("dot").cast("string").alias("id"))
    events = rq._events(spark, d)
    parts = {
        "carriers_without_hauls": (insp, _base(spark, d, "hauls_commodity").select(F.col("src_id").alias("id")), 1),
        "tickers_without_links": (table(spark, d, "sec_tickers").select(F.col("ticker").alias("id")), events.filter(gr.base_type() == "identity_match").select(F.col("dst_id").alias("id")), 2),
        "shippers_without_hauls": (table(spark, d, "top_shippers").select(F.col("shipper_norm").alias("id")), events.filter(gr.base_type() == "observed_haul").select(F.col("src_id").alias("id")), 3),
    }
    return rg.missing_by_category(parts, "id")


def daily_absorb(spark, d):
    """Licences taken in by their month of delivery, one month twice; the newest delivery of each number."""
    rows = table(spark, d, "fmc_licences").filter("loaded_at IS NOT NULL").select("row_id", F.trim("`Organization No.`").alias("number"), F.date_format("loaded_at", "yyyy-MM").alias("month"))
    path = _folder(spark)
    rg.absorb(rows, path, F.col("month"))
    again = rows.filter(F.col("month") >= "2025-01")
    absorbed = rg.absorb(again, path, F.col("month"))
    return rg.newest_delivery(absorbed.filter("number <> ''"), ["number"]).select("row_id", "number", "month")


# --- sources and sinks -----------------------------------------------------------------------------------------------------------


def source_csv(spark, d):
    """Customers written as a delimited file with quoted text and read back as strings."""
    path = _folder(spark)
    out = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.concat(F.lit('a "q", '), "c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    out.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return rd.read_delimited(spark, path, ["key", "name", "segment"], ",")


def source_json_lines(spark, d):
    path = _folder(spark)
    table(spark, d, "events").select("event_id", "event_type", "value").write.json(path, ignoreNullFields=False)
    return rd.read_json_lines(spark, path, "event_id bigint, event_type string, value double")


def source_fixed_width(spark, d):
    path = _folder(spark)
    nation = table(spark, d, "nation")
    nation.select(F.concat(F.lpad(F.col("n_nationkey").cast("string"), 4, "0"), F.rpad("n_name", 30, " "), F.lpad(F.col("n_regionkey").cast("string"), 2, " ")).alias("value")).write.text(path)
    return rd.read_fixed_width(spark.read.text(path), {"code": (0, 4), "name": (4, 34), "region": (34, 36)})


def source_series(spark, d):
    """Series of points written as JSON lines, newest first, and read back as rows."""
    path = _folder(spark)
    points = table(spark, d, "events").filter("value IS NOT NULL AND event_type IS NOT NULL AND user_id IS NOT NULL").groupBy("user_id", F.date_format("ts", "yyyyMMdd").alias("period")).agg(tx.exact_sum("value").alias("value"))
    data = F.transform(F.sort_array(F.collect_list(F.struct("period", "value")), False), lambda p: F.array(p["period"], p["value"].cast("string")))  # a month of days
    points.groupBy(F.concat(F.lit("S."), F.col("user_id")).alias("series_id")).agg(data.alias("data")).write.json(path)
    return rd.read_series(spark, path).select("series_id", "period", "value", "place")


def sink_parquet(spark, d):
    """A table written partitioned with its signature beside it, and read back."""
    path = _folder(spark)
    sk.write_parquet(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, ["o_orderstatus"])
    return spark.read.parquet(path).select("o_orderkey", "o_totalprice", F.col("o_orderstatus").cast("string").alias("o_orderstatus"))


def sink_copy(spark, d):
    return rg.copied(spark, f"{d}/supplier.parquet")


def describe_table(spark, d):
    return rg.described(table(spark, d, "orders"))


QUERIES = {
    f.__name__: f
    for f in (
        edges_trade, edges_bilateral_trade, edges_commodity_pressure, edges_origin_pressure, edges_rail_annual, edges_rail_dwell, edges_pipeline, edges_identity, identity_by_core, identity_within_titles, graph_build, linear_pipeline, graph_query, evidence_pack_edges, price_endpoints_long, return_band_long, trend_radar,
        reproduction_query, transport_economy, commodity_economy, truck_signal_whole, code_labels, ticker_overlap, rounding_casts, licence_ages, gap_register, missing_categories, daily_absorb, source_csv, source_json_lines,
        source_fixed_width, source_series, sink_parquet, sink_copy, describe_table,
    )
}

# --- SQL -----------------------------------------------------------------------------------------------------------------------

_s = rs._sum
_HS = """CASE WHEN {0} LIKE '2701%' THEN '19' WHEN {0} LIKE '2601%' THEN '19' WHEN {0} LIKE '27%' THEN '17' WHEN regexp_matches({0}, '^100[1-8]') THEN '02' WHEN regexp_matches({0}, '^7[23]') THEN '11'
  WHEN regexp_matches({0}, '^(28|29|38|39)') THEN '18' ELSE '31' END"""
_PART = _HS.format("CAST(l_partkey AS VARCHAR)")


def _pressure(kind: str) -> str:
    return f"""SELECT md5('{kind}|' || src_id || '|' || event_time) AS event_id, '{kind}' AS edge_type, src_id, '17' AS dst_id, event_time, max(weight) AS weight FROM all_events
WHERE {rs.BASE} = '{kind}' AND weight IS NOT NULL AND src_id IS NOT NULL AND event_time IS NOT NULL GROUP BY src_id, event_time"""


_PICK = f"""picked AS (SELECT coalesce(max(CASE WHEN month < '202601' AND w >= 100 AND codes >= 8 THEN month END), max(CASE WHEN month < '202601' AND w >= 100 THEN month END), max(month)) AS month
  FROM (SELECT month, {_s("weight")} AS w, count(DISTINCT code) AS codes FROM national GROUP BY month))"""
_RAIL = f"(SELECT src_id, edge_type, weight, event_id, event_time FROM all_events WHERE {rs.BASE} = 'rail_metric' AND event_id IS NOT NULL AND weight IS NOT NULL)"
_STATS = f"""SELECT {rs._J.format("sctg2")} AS code, count(DISTINCT src_id) AS shippers, count(DISTINCT dst_id) AS carriers, count(DISTINCT {rs._J.format("state")}) AS states, {_s("weight")} AS inspections
  FROM all_events, picked WHERE {rs.BASE} = 'observed_haul' AND event_time = picked.month GROUP BY 1"""
_TREND = """t.code, t.snapshot_month, t.change_score, t.delta_pct, t.macro_share, t.residual, coalesce(shippers, 0) AS shippers, coalesce(carriers, 0) AS carriers, coalesce(states, 0) AS states, coalesce(inspections, 0) AS inspections"""
_SURVEY = "survey AS (SELECT p_type AS code, CAST(sum(CAST(l_quantity * p_size AS DECIMAL(18,4))) AS DOUBLE) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type)"
_FLOWCODES = f"flowcodes AS (SELECT code, {_s('tons', 4)} AS amount FROM flows GROUP BY code)"
_PCT = "100.0::DOUBLE * amount / (SELECT sum(amount) FROM {0})"


def _layer(name: str, source: str, k: int) -> str:
    return f"SELECT * FROM (SELECT '{name}' AS layer, name, amount, share_pct, row_number() OVER (ORDER BY amount DESC NULLS LAST, name ASC NULLS LAST) AS rank FROM ({source})) WHERE rank <= {k}"


def _edge_sum(name: str, kind: str) -> str:
    """Rows and weight of an edge query's SQL, for the union."""
    sql = ORACLE.get(name) or rs.ORACLE[name]
    return f"SELECT '{kind}' AS edge_type, weight FROM ({sql})"


_FLAGS = "CASE {0} WHEN grain THEN 'grain_feed' WHEN liqgas OR chem THEN 'petroleum_chem' WHEN coal THEN 'coal_coke' WHEN gen THEN 'general_freight' ELSE 'unknown' END"
_MISSING = """SELECT '{0}' AS category, {1} AS priority, count(*) AS expected, count(*) FILTER (there IS NULL) AS missing, min(CASE WHEN there IS NULL THEN id END) AS first_missing
FROM (SELECT DISTINCT {2} AS id FROM {3}) LEFT JOIN (SELECT DISTINCT {4} AS there FROM all_events WHERE {5} AND {4} IS NOT NULL) ON id = there WHERE id IS NOT NULL"""

_LONG = rs._ENDPOINTS.replace("least(5, n)", "least(63, n)").replace("rn <= 3", "rn <= 20").replace("least(max(n), 3)", "least(max(n), 20)")

ORACLE = {
    "edges_trade": f"""WITH r AS (SELECT {_PART} AS code, strftime(l_shipdate, '%Y%m') AS month, CASE WHEN floor(l_extendedprice) >= 1000 THEN floor(l_extendedprice) ELSE 1 END AS w FROM lineitem)
SELECT md5('trade_import|' || code || '|' || month) AS event_id, 'trade_import' AS edge_type, code AS src_id, 'US' AS dst_id, month AS event_time, CAST(sum(w) AS DOUBLE) AS weight FROM r WHERE month = (SELECT max(month) FROM r) GROUP BY code, month""",
    "edges_bilateral_trade": f"""SELECT md5('trade_bilateral|' || n_name || '|' || code || '|' || month) AS event_id, 'trade_import.bilateral' AS edge_type, n_name AS src_id, code AS dst_id, month AS event_time, {_s("v")} AS weight
FROM (SELECT n_name, {_PART} AS code, strftime(l_shipdate, '%Y%m') AS month, l_extendedprice AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) GROUP BY n_name, code, month""",
    "edges_commodity_pressure": _pressure("commodity_pressure"),
    "edges_origin_pressure": _pressure("origin_pressure"),
    "edges_rail_annual": f"""SELECT md5('rail_metric|' || src_id || '|' || edge_type || '|2025') AS event_id, 'rail_metric' AS edge_type, src_id, 'US' AS dst_id, '2025' AS event_time, weight
FROM (SELECT *, row_number() OVER (PARTITION BY src_id, edge_type ORDER BY event_id, weight) AS rn FROM {_RAIL} WHERE src_id IS NOT NULL) WHERE rn = 1""",
    "edges_rail_dwell": f"""SELECT md5('rail_dwell|' || src_id || '|' || edge_type || '|' || event_time || '|' || CAST(weight AS VARCHAR)) AS event_id, 'rail_metric.dwell' AS edge_type, src_id, 'US' AS dst_id, event_time, weight
FROM {_RAIL} WHERE edge_type ILIKE '%dwell%'""",
    "edges_pipeline": f"""SELECT md5('pipeline_signal|' || src_id || '|2025') AS event_id, 'pipeline_signal' AS edge_type, src_id, 'US' AS dst_id, '2025' AS event_time, {_s("weight")} AS weight
FROM all_events WHERE {rs.BASE} = 'pipeline_signal' AND length(src_id) = 2 AND weight > 0 GROUP BY src_id""",
    "edges_identity": f"""WITH a AS (SELECT shipper_norm, n, {rs._core("shipper_norm")} AS core FROM top_shippers), b AS (SELECT title_norm, ticker, {rs._core("title_norm")} AS core FROM sec_tickers WHERE ticker IS NOT NULL),
m AS (SELECT shipper_norm, ticker, least(100.0::DOUBLE, 50.0::DOUBLE + n / 20.0::DOUBLE) AS w, 'exact' AS confidence FROM a JOIN b USING (core) WHERE core <> ''
  UNION ALL SELECT shipper_norm, ticker, 40.0, 'blocked_fuzzy' FROM a JOIN b ON length(title_norm) >= 8 AND contains(shipper_norm, title_norm))
SELECT md5('identity_match|' || shipper_norm || '|' || ticker) AS event_id, 'identity_match' AS edge_type, shipper_norm AS src_id, ticker AS dst_id, 'snapshot' AS event_time, CAST(max(w) AS DOUBLE) AS weight, max(confidence) AS confidence FROM m GROUP BY shipper_norm, ticker""",
    "identity_by_core": f"""SELECT shipper_norm, core, inspections FROM (SELECT shipper_norm, {rs._core("shipper_norm")} AS core FROM top_shippers)
JOIN (SELECT {rs._core("SHIPPER_NAME")} AS core, count(*) AS inspections FROM fmcsa_events GROUP BY 1) USING (core) WHERE core <> ''""",
    "identity_within_titles": f"""SELECT DISTINCT title_norm AS long, s AS short FROM sec_tickers JOIN (SELECT {rs._core("shipper_norm")} AS s FROM top_shippers) ON length(s) >= 8 AND contains(title_norm, s)""",
    "graph_query": rs._scores("national").rstrip() + f""", cs AS (SELECT o.code, o.month, o.state, least(100.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE * CASE WHEN prior > 0 THEN 100.0::DOUBLE * (weight - prior) / prior ELSE 0 END + 0.3::DOUBLE * coalesce(share, 0)
    + 0.2::DOUBLE * least(50.0::DOUBLE, weight / 1000.0::DOUBLE))) AS change_score FROM (SELECT *, lag(weight) OVER (PARTITION BY code, state ORDER BY month) AS prior FROM corridor) o LEFT JOIN share USING (code)), {_PICK}
SELECT 'score' AS section, 1 AS rank, snapshot_month AS name, change_score AS value FROM scores, picked WHERE code = '17' AND snapshot_month = picked.month
UNION ALL SELECT * FROM (SELECT 'states', CAST(row_number() OVER (ORDER BY change_score DESC, state) AS INT) AS r, state, change_score FROM cs, picked WHERE code = '17' AND cs.month = picked.month) WHERE r <= 5
UNION ALL SELECT * FROM (SELECT 'carriers', CAST(row_number() OVER (ORDER BY w DESC NULLS LAST, dst_id ASC NULLS LAST) AS INT) AS r, dst_id, w FROM (SELECT dst_id, {_s("weight", 4)} AS w FROM all_events, picked
  WHERE {rs.BASE} = 'observed_haul' AND event_time = picked.month AND {rs._J.format("sctg2")} = '17' GROUP BY dst_id)) WHERE r <= 5
UNION ALL SELECT 'origin', 1, c, CAST(count(*) AS DOUBLE) FROM (SELECT src_id, CASE WHEN max(CAST(event_time = picked.month AS INT)) = 1 THEN 'aligned' WHEN max(CAST(substr(event_time, 1, 4) = substr(picked.month, 1, 4) AS INT)) = 1 THEN 'diverge'
  ELSE 'none_in_window' END AS c FROM all_events, picked WHERE {rs.BASE} = 'origin_pressure' AND regexp_full_match(event_time, '[0-9]{{6}}') AND src_id IS NOT NULL GROUP BY src_id) GROUP BY c""",
    "evidence_pack_edges": f"""SELECT event_id, edge_type, src_id, dst_id, event_time, weight FROM all_events WHERE ({rs.BASE} IN ('observed_haul', 'hauls_commodity', 'commodity_pressure', 'trade_import') AND (coalesce({rs._J.format("sctg2")} = '17', false)
  OR ({rs.BASE} IN ('hauls_commodity', 'trade_import') AND dst_id = '17') OR ({rs.BASE} = 'commodity_pressure' AND src_id = '17'))) OR ({rs.BASE} = 'identity_match' AND src_type = 'shipper')
ORDER BY weight DESC NULLS LAST, event_id ASC NULLS LAST, source_mtime ASC NULLS LAST, event_time ASC NULLS LAST LIMIT 500""",
    "price_endpoints_long": f"WITH {_LONG} SELECT * FROM ends",
    "return_band_long": f"""WITH {_LONG} SELECT user_id, n_obs, ret FROM (SELECT *, 100.0::DOUBLE * (last_value - first_value) / nullif(first_value, 0) AS ret FROM ends) WHERE n_obs >= 20 AND first_value >= 1 AND ret BETWEEN -50 AND 150""",
    "trend_radar": rs._scores("national").rstrip() + f""", {_PICK}, t AS (SELECT s.* FROM scores s, picked WHERE snapshot_month = picked.month ORDER BY change_score DESC NULLS LAST, code LIMIT 50), h AS ({_STATS})
SELECT {_TREND} FROM t LEFT JOIN h USING (code)""",
    "reproduction_query": rs._scores("national") + f""", h AS (SELECT {rs._J.format("sctg2")} AS code, {rs._J.format("state")} AS state, {_s("weight")} AS w, count(DISTINCT src_id) AS shippers, count(DISTINCT dst_id) AS carriers FROM all_events WHERE {rs.BASE} = 'observed_haul' GROUP BY 1, 2)
SELECT s.code, snapshot_month, change_score, delta_pct, residual, h.state, w AS state_weight, shippers, carriers FROM scores s LEFT JOIN h USING (code) WHERE s.code = '17'""",
    "transport_economy": f"""WITH {rs.INSP}, {rs.FLOWS}, {_FLOWCODES}, {_SURVEY},
a AS (SELECT code, {_PCT.format("flowcodes")} AS flow_pct FROM flowcodes), b AS (SELECT code, {_PCT.format("survey")} AS survey_pct FROM survey),
c AS (SELECT code, count(DISTINCT dot) AS carriers, count(*) AS tied FROM insp WHERE dot IS NOT NULL GROUP BY code),
m AS (SELECT code, string_agg(mode, ' | ' ORDER BY rank) AS top_modes FROM (SELECT code, mode, row_number() OVER (PARTITION BY code ORDER BY {_s("tons", 4)} DESC, mode) AS rank FROM flows GROUP BY code, mode) WHERE rank <= 3 GROUP BY code),
j AS (SELECT code, coalesce(flow_pct, 0) AS flow_pct, coalesce(survey_pct, 0) AS survey_pct, coalesce(carriers, 0) AS carriers, coalesce(tied, 0) AS tied, top_modes FROM a FULL JOIN b USING (code) FULL JOIN c USING (code) LEFT JOIN m USING (code))
SELECT *, 0.35::DOUBLE * flow_pct + 0.30::DOUBLE * survey_pct + least(20.0::DOUBLE, carriers / 5000.0::DOUBLE) + least(15.0::DOUBLE, tied / 500.0::DOUBLE) AS score FROM j""",
    "commodity_economy": f"""WITH {rs.FLOWS}, {_FLOWCODES}, {_SURVEY}, a AS (SELECT code AS name, amount, {_PCT.format("flowcodes")} AS share_pct FROM flowcodes), b AS (SELECT code AS name, amount, {_PCT.format("survey")} AS share_pct FROM survey),
dep AS (SELECT p_brand AS name, CAST(count(*) AS DOUBLE) AS amount FROM part GROUP BY 1)
{_layer("flows", "SELECT * FROM a", 20)} UNION ALL {_layer("survey", "SELECT * FROM b", 20)} UNION ALL {_layer("deposits", "SELECT name, amount, " + _PCT.format("dep") + " AS share_pct FROM dep", 20)}
UNION ALL {_layer("energy", "SELECT name, value AS amount, NULL::DOUBLE AS share_pct FROM (SELECT CAST(user_id AS VARCHAR) AS name, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, value DESC) AS rn FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL) WHERE rn = 1", 20)}
UNION ALL {_layer("slate", "SELECT name, 0.55::DOUBLE * coalesce(a.share_pct, 0) + 0.45::DOUBLE * coalesce(b.share_pct, 0) AS amount, NULL::DOUBLE AS share_pct FROM a FULL JOIN b USING (name)", 25)}""",
    "truck_signal_whole": f"""WITH {rs.INSP}, {rs.REGISTRY},
g AS (SELECT dot, shipper, code, CASE WHEN placard THEN 'hazmat_placard_plus_context' WHEN trim(tank) <> '' THEN 'cargo_tank_or_inspection_field' ELSE 'shipper_name_pattern' END AS method, count(*) AS n, CAST(max(insp_date) AS VARCHAR) AS last_date
  FROM insp WHERE dot IS NOT NULL AND insp_date IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
f AS (SELECT dot, bool_or(code = '11') AS metal, bool_or(code = '02') AS grain, bool_or(code = '18') AS chem, bool_or(code = '17') AS liqgas, bool_or(code = '19') AS coal, bool_or(code = '31') AS gen FROM insp WHERE dot IS NOT NULL GROUP BY dot)
SELECT g.*, {_FLAGS.format("WHEN metal THEN 'metal_sheet'").replace("WHEN WHEN", "WHEN")} AS lane, {_FLAGS.format("")} AS lane_without_metal, legal_name FROM g LEFT JOIN f USING (dot) LEFT JOIN registry USING (dot)""".replace("CASE WHEN metal THEN 'metal_sheet' WHEN grain", "CASE WHEN metal THEN 'metal_sheet' WHEN grain"),
    "code_labels": f"""SELECT dst_id AS code, count(*) AS n, CASE dst_id WHEN '17' THEN 'fuel oils' WHEN '02' THEN 'grains' WHEN '19' THEN 'coal' ELSE 'code ' || dst_id END AS label FROM all_events WHERE {rs.BASE} = 'hauls_commodity' AND dst_id IS NOT NULL GROUP BY dst_id""",
    "ticker_overlap": """WITH r AS (SELECT hq_state, sic_text, count(DISTINCT exchange = 'OTC') AS k FROM sec_tickers WHERE hq_state IS NOT NULL AND exchange IS NOT NULL GROUP BY hq_state, sic_text)
SELECT hq_state, coalesce(string_agg(sic_text, ' | ' ORDER BY sic_text) FILTER (k = 2 AND sic_text IS NOT NULL), '') AS shared FROM r GROUP BY hq_state""",
    "rounding_casts": "SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice / 100) AS BIGINT) AS rounded, CAST(round(-l_extendedprice / 100) AS BIGINT) AS negative FROM lineitem",
    "licence_ages": """SELECT row_id, CAST(floor((epoch(TIMESTAMP '2026-07-01') - epoch_us(loaded_at) / 1e6) / 86400) AS BIGINT) AS age,
  CASE WHEN "Legal Name" IS NULL THEN true ELSE coalesce((epoch(TIMESTAMP '2026-07-01') - epoch_us(loaded_at) / 1e6) / 86400 >= 365, true) END AS refresh,
  concat_ws(' ', strftime(date_trunc('month', loaded_at) - INTERVAL 1 MONTH, '%Y%m'), strftime(date_trunc('month', loaded_at) - INTERVAL 2 MONTH, '%Y%m'), strftime(date_trunc('month', loaded_at) - INTERVAL 3 MONTH, '%Y%m')) AS months FROM fmc_licences""",
    "gap_register": """WITH docs AS (SELECT concat_ws('/', source, doc_type) AS family, doc_type, CASE WHEN coalesce(length(trim(text, ' ')), 0) < 20 THEN 'below_stub' END AS reason, published FROM documents WHERE source IS NOT NULL AND published IS NOT NULL),
best AS (SELECT family, max(CASE WHEN reason IS NULL THEN published END) AS modified, count(*) AS files FROM docs GROUP BY family),
expected AS (SELECT s || '/' || doc_type AS family, r AS refresh_days, p AS priority FROM (SELECT DISTINCT doc_type FROM docs WHERE doc_type IS NOT NULL), (VALUES ('nowhere', 30, 1), ('web', 900, 2)) v(s, r, p)),
j AS (SELECT family, (epoch(TIMESTAMP '2026-07-01') - epoch_us(modified) / 1e6) / 86400 AS age, refresh_days, priority, files, modified FROM expected FULL JOIN best USING (family)),
k AS (SELECT *, CASE WHEN refresh_days IS NULL THEN 'discovered' WHEN files IS NULL THEN 'missing' WHEN modified IS NULL THEN 'bad' WHEN age >= refresh_days THEN 'stale' ELSE 'ok' END AS status FROM j)
SELECT family, status, CAST(floor(age) AS BIGINT) AS age, coalesce(priority, 99) AS priority, CASE WHEN status IN ('missing', 'bad') THEN 'download' WHEN status = 'stale' THEN 'refresh' WHEN status = 'discovered' THEN 'review' ELSE 'none' END AS action FROM k""",
    "missing_categories": f"""WITH {rs.INSP} """ + " UNION ALL ".join([
        _MISSING.format("carriers_without_hauls", 1, "CAST(dot AS VARCHAR)", "insp", "src_id", f"{rs.BASE} = 'hauls_commodity'"), _MISSING.format("tickers_without_links", 2, "ticker", "sec_tickers", "dst_id", f"{rs.BASE} = 'identity_match'"),
        _MISSING.format("shippers_without_hauls", 3, "shipper_norm", "top_shippers", "src_id", f"{rs.BASE} = 'observed_haul'")]),
    "daily_absorb": """SELECT row_id, number, month FROM (SELECT row_id, trim("Organization No.", ' ') AS number, strftime(loaded_at, '%Y-%m') AS month, max(strftime(loaded_at, '%Y-%m')) OVER (PARTITION BY trim("Organization No.", ' ')) AS newest
  FROM fmc_licences WHERE loaded_at IS NOT NULL) WHERE number <> '' AND month = newest""",
    "source_csv": "SELECT CAST(c_custkey AS VARCHAR) AS key, 'a \"q\", ' || c_name AS name, c_mktsegment AS segment FROM customer",
    "source_json_lines": "SELECT event_id, event_type, value FROM events",
    "source_fixed_width": "SELECT lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS code, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation",
    "source_series": f"""SELECT 'S.' || user_id AS series_id, period, value, row_number() OVER (PARTITION BY user_id ORDER BY period DESC) AS place FROM (SELECT user_id, strftime(ts, '%Y%m%d') AS period, {_s("value")} AS value
  FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL)""",
    "sink_parquet": "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders",
    "sink_copy": "SELECT * FROM supplier",
}
ORACLE["linear_pipeline"] = f"""WITH {rs.MONTHLY}, {rs.SCORES.replace("hauls AS (", "hauls0 AS (").replace("national AS (", "hauls AS (SELECT month, code, state, shipper, dot, weight FROM monthly), national AS (")},
o AS (SELECT *, lag(weight) OVER (PARTITION BY code ORDER BY month) AS prior FROM national),
picked AS (SELECT coalesce(max(CASE WHEN month < '202601' AND w >= 1 THEN month END), max(month)) AS month FROM (SELECT month, {_s("weight")} AS w FROM national GROUP BY month)),
t AS (SELECT o.code, o.month AS snapshot_month, CASE WHEN prior > 0 THEN 100.0::DOUBLE * (weight - prior) / prior ELSE 0 END AS delta_pct, coalesce(share, 0) AS macro_share,
  CASE WHEN coalesce(share, 0) = 0 THEN 0 ELSE weight / share END AS residual, least(50.0::DOUBLE, weight / 1000.0::DOUBLE) AS w50 FROM o LEFT JOIN share USING (code), picked WHERE o.month = picked.month),
h AS (SELECT code, count(DISTINCT shipper) AS shippers, count(DISTINCT dot) AS carriers, count(DISTINCT state) AS states, {_s("weight")} AS inspections FROM hauls, picked WHERE hauls.month = picked.month GROUP BY code)
SELECT t.code, snapshot_month, least(100.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE * delta_pct + 0.3::DOUBLE * macro_share + 0.2::DOUBLE * w50)) AS change_score, delta_pct, macro_share, residual,
  coalesce(shippers, 0) AS shippers, coalesce(carriers, 0) AS carriers, coalesce(states, 0) AS states, coalesce(inspections, 0) AS inspections FROM t LEFT JOIN h USING (code)"""
_KINDS = {
    "haul_edges_monthly": "observed_haul", "haul_edges_commodity": "hauls_commodity", "haul_edges_state": "operates_in", "macro_modeled_flow": "modeled_flow", "macro_shipment_share": "shipment_share", "carrier_risk": "carrier_risk",
    "licence_edges": "maritime_license", "edges_trade": "trade_import", "edges_bilateral_trade": "trade_import.bilateral", "edges_commodity_pressure": "commodity_pressure", "edges_origin_pressure": "origin_pressure",
    "edges_rail_annual": "rail_metric", "edges_rail_dwell": "rail_metric.dwell", "edges_pipeline": "pipeline_signal", "edges_identity": "identity_match",
}
ORACLE["graph_build"] = f"SELECT edge_type, count(*) AS n, {_s('weight')} AS weight FROM ({' UNION ALL '.join(_edge_sum(k, v) for k, v in _KINDS.items())}) GROUP BY edge_type"

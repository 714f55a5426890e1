"""DuckDB SQL of the queries in reference_queries, over the same tables."""

from __future__ import annotations

from loadstone.plans.data_queries import _DATE, _DOT, _PERIOD

_NORM = "trim(regexp_replace(upper({0}), '[^A-Z0-9]+', ' ', 'g'))"


def _core(c: str) -> str:
    s = _NORM.format(c)
    for x in (" LLC", " INC", " CORP", " CO ", " LTD", " LP"):
        s = f"replace({s}, '{x}', ' ')"
    return f"trim(regexp_replace({s}, ' +', ' ', 'g'))"


_HAS = "coalesce(contains(shipper, '{0}'), false)"
_OR = lambda *w: "(" + " OR ".join(_HAS.format(x) for x in w) + ")"
INSP = f"""insp0 AS (
  SELECT row_id, INSPECTION_ID AS inspection_id, CASE WHEN regexp_full_match({_DOT}, '0*[1-9][0-9]*') AND length({_DOT}) <= 8 THEN CAST({_DOT} AS BIGINT) END AS dot,
    CASE WHEN regexp_full_match({_DATE}, '(199[0-9]|20[01][0-9]|202[0-6])[0-9]{{4}}') THEN CAST(try_strptime({_DATE}, '%Y%m%d') AS DATE) END AS insp_date,
    {_NORM.format("SHIPPER_NAME")} AS shipper, coalesce(COUNTY_CODE_STATE, 'UNK') AS state, CARGO_TANK AS tank, upper(coalesce(HAZMAT_PLACARD_REQ, '')) = 'Y' AS placard,
    INSP_CARRIER_NAME AS carrier, OOS_TOTAL AS oos, VIOL_TOTAL AS viol, coalesce(CARGO_TANK IN ('406', '407', '331'), false) AS fuel
  FROM fmcsa_events),
insp AS (SELECT *, strftime(insp_date, '%Y%m') AS month,
  CASE WHEN placard AND fuel THEN '17' WHEN placard THEN '18' WHEN fuel THEN '17' WHEN {_OR("GRAIN", "FEED", "MILL")} THEN '02' WHEN {_OR("PETROLEUM", "OIL ", "REFIN")} THEN '17'
    WHEN {_OR("COAL")} THEN '19' WHEN {_OR("CHEM", "PLAST")} THEN '18' WHEN {_OR("STEEL", "METAL", "SCRAP")} THEN '11' ELSE '31' END AS code,
  CASE WHEN placard AND fuel THEN 'strong' WHEN placard THEN 'medium' WHEN {_OR("GRAIN", "PETROLEUM", "COAL")} THEN 'medium' ELSE 'weak' END AS confidence
  FROM insp0)"""
_PLACE = "('NONE', 'NA', 'SELF', 'LINE RUN', '')"
_RANK = "CASE confidence WHEN 'blocked_fuzzy' THEN 0 WHEN 'weak' THEN 1 WHEN 'medium' THEN 2 WHEN 'strong' THEN 3 WHEN 'exact' THEN 4 END"
_LABEL = "CASE max({0}) WHEN 0 THEN 'blocked_fuzzy' WHEN 1 THEN 'weak' WHEN 2 THEN 'medium' WHEN 3 THEN 'strong' WHEN 4 THEN 'exact' END".format(_RANK)
MONTHLY = f"""{INSP}, monthly AS (SELECT month, shipper, dot, state, code, {_LABEL} AS confidence, CAST(count(*) AS DOUBLE) AS weight FROM insp
  WHERE dot IS NOT NULL AND month >= '202201' AND shipper NOT IN {_PLACE} GROUP BY ALL HAVING count(*) >= 2)"""
FLOWS = """flows AS (SELECT ns.n_name AS origin, nc.n_name AS destination, p_type AS code, l_returnflag AS mode, year(l_shipdate) AS year, l_quantity AS tons, l_extendedprice AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation nc ON c_nationkey = nc.n_nationkey)"""
_SUM = "CAST(sum(CAST(CASE WHEN NOT isnan({0}) THEN {0} END AS DECIMAL(18,{1}))) AS DOUBLE)"


def _sum(c: str, scale: int = 6) -> str:
    return _SUM.format(c, scale)


BASE = "split_part(edge_type, '.', 1)"
_J = "json_extract_string(CASE WHEN json_valid(attrs_json) THEN attrs_json END, '$.{0}')"
SCORES = f"""hauls AS (SELECT event_time AS month, {_J.format("sctg2")} AS code, {_J.format("state")} AS state, weight FROM all_events
  WHERE {BASE} = 'observed_haul' AND event_grain = 'month' AND regexp_full_match(event_time, '[0-9]{{6}}')),
amounts AS (SELECT dst_id AS code, {_sum("weight")} AS amount FROM all_events WHERE {BASE} = 'modeled_flow' AND dst_type = 'commodity' AND dst_id IS NOT NULL GROUP BY dst_id),
share AS (SELECT code, 100.0::DOUBLE * amount / nullif((SELECT CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) FROM amounts), 0) AS share FROM amounts),
national AS (SELECT month, code, NULL::VARCHAR AS state, coalesce({_sum("weight")}, 0) AS weight FROM hauls WHERE code <> '' GROUP BY month, code),
corridor AS (SELECT month, code, state, coalesce({_sum("weight")}, 0) AS weight FROM hauls WHERE code <> '' AND state IS NOT NULL AND state NOT IN ('', 'UNK') GROUP BY month, code, state)"""


def _scores(source: str) -> str:
    return f"""WITH {SCORES},
o AS (SELECT *, lag(weight) OVER w AS prior, lag(month) OVER w AS before FROM {source} WINDOW w AS (PARTITION BY code, state ORDER BY month)),
j AS (SELECT o.*, coalesce(share, 0) AS s, CASE WHEN prior > 0 THEN 100.0::DOUBLE * (weight - prior) / prior ELSE 0 END AS pct FROM o LEFT JOIN share USING (code)),
scores AS (SELECT md5(code || '|' || month || '|' || coalesce(state, '')) AS change_id, code, month AS snapshot_month, state, weight AS truck_weight, prior AS prior_weight, pct AS delta_pct,
  weight - coalesce(prior, 0) AS delta_abs, s AS macro_share, CASE WHEN s = 0 THEN 0 ELSE weight / s END AS residual,
  least(100.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE * pct + 0.3::DOUBLE * s + 0.2::DOUBLE * least(50.0::DOUBLE, weight / 1000.0::DOUBLE))) AS change_score,
  strftime(strptime(before || '01', '%Y%m%d') + INTERVAL 1 MONTH, '%Y%m') = month AS adjacent FROM j)
"""


_CORE_TITLE = "CASE WHEN length(title_norm) - length(replace(title_norm, ' ', '')) >= 2 THEN split_part(title_norm, ' ', 1) || ' ' || split_part(title_norm, ' ', 2) ELSE title_norm END"
_RANKED = "row_number() OVER (PARTITION BY {0} ORDER BY {1})"
REGISTRY = """named AS (SELECT dot, carrier, count(*) AS n FROM insp WHERE dot IS NOT NULL GROUP BY ALL),
registry AS (SELECT dot, n_rows, n_states, legal_name FROM (SELECT dot, count(*) AS n_rows, count(DISTINCT state) AS n_states FROM insp WHERE dot IS NOT NULL GROUP BY dot)
  LEFT JOIN (SELECT dot, carrier AS legal_name FROM (SELECT *, row_number() OVER (PARTITION BY dot ORDER BY n DESC, carrier) AS rn FROM named WHERE carrier IS NOT NULL) WHERE rn = 1) USING (dot))"""


def _ties(where: str, least: int) -> str:
    return f"""WITH {INSP}, {REGISTRY},
r AS (SELECT *, CASE code WHEN '17' THEN 'petroleum_chem' WHEN '18' THEN 'hazmat' WHEN '02' THEN 'grain_feed' WHEN '19' THEN 'coal_coke' WHEN '11' THEN 'metal_sheet' ELSE 'general_freight' END AS lane,
  CASE WHEN fuel THEN 'tanker' WHEN placard THEN 'hazmat' END AS tank_hint FROM insp WHERE dot IS NOT NULL AND shipper NOT IN {_PLACE})
SELECT g.*, legal_name FROM (SELECT shipper, dot, state, lane, tank_hint, count(*) AS inspections, CAST(min(insp_date) AS VARCHAR) AS first_date, CAST(max(insp_date) AS VARCHAR) AS last_date,
  CAST(sum(coalesce(oos, 0)) AS BIGINT) AS oos, CAST(sum(coalesce(viol, 0)) AS BIGINT) AS violations FROM r WHERE {where} GROUP BY ALL HAVING count(*) >= {least}) g LEFT JOIN registry USING (dot)"""


_NUM = "trim(\"Organization No.\")"
_CATALOG_PRESSURE = f"{BASE} IN ('commodity_pressure', 'origin_pressure') AND weight IS NOT NULL AND src_id IS NOT NULL"
_PTEXT = "CASE WHEN {0} % 10 = 1 THEN CAST({0} // 10 AS VARCHAR) ELSE CAST({0} // 1000 AS VARCHAR) END"

_ENDPOINTS = f"""e AS (SELECT user_id, value, {_RANKED.format("user_id", "ts DESC NULLS LAST, event_id DESC NULLS LAST")} AS rn, count(*) OVER (PARTITION BY user_id) AS n
  FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL),
ends AS (SELECT user_id, max(n) AS n_obs, max(CASE WHEN rn = n THEN value END) AS first_value, max(CASE WHEN rn = 1 THEN value END) AS last_value, max(CASE WHEN rn = least(5, n) THEN value END) AS lookback_value,
  CAST(sum(CAST(CASE WHEN rn <= 3 THEN value END AS DECIMAL(18,6))) AS DOUBLE) / least(max(n), 3) AS recent_mean FROM e GROUP BY user_id)"""

_EVIDENCE = f"""shippers AS (SELECT DISTINCT src_id FROM all_events WHERE {BASE} = 'observed_haul' AND {_J.format("sctg2")} = '17' AND src_id IS NOT NULL),
chosen AS (SELECT * FROM all_events WHERE event_id IS NOT NULL AND (
  ({BASE} IN ('hauls_commodity', 'modeled_flow', 'commodity_pressure') AND ((dst_type = 'commodity' AND dst_id = '17') OR (src_type = 'commodity' AND src_id = '17')))
  OR ({BASE} = 'observed_haul' AND {_J.format("sctg2")} = '17') OR ({BASE} = 'identity_match' AND src_type = 'shipper' AND src_id IN (SELECT src_id FROM shippers)))),
evidence AS (SELECT * FROM (SELECT *, {_RANKED.format("event_id", "source_mtime DESC NULLS LAST, weight DESC NULLS LAST, event_time DESC NULLS LAST")} AS rn FROM chosen) WHERE rn = 1
  ORDER BY weight DESC NULLS LAST, event_id LIMIT 500)"""
_KEY6 = "edge_type, src_type, src_id, dst_type, dst_id, event_time"
_KEYORDER = ", ".join(f"{k.strip()} ASC NULLS LAST" for k in _KEY6.split(","))

ORACLE = {
    "haul_edges_monthly": f"""WITH {MONTHLY} SELECT md5('observed_haul|' || shipper || '|' || dot || '|' || state || '|' || month || '|' || code) AS event_id, shipper AS src_id, CAST(dot AS VARCHAR) AS dst_id,
  month AS event_time, weight, confidence, CAST(json_object('sctg2', code, 'state', state) AS VARCHAR) AS attrs_json FROM monthly""",
    "haul_edges_commodity": f"""WITH {MONTHLY} SELECT md5('hauls_commodity|' || dot || '|' || code || '|' || month) AS event_id, CAST(dot AS VARCHAR) AS src_id, code AS dst_id, month AS event_time, sum(weight) AS weight,
  {_LABEL} AS confidence, CAST(json_object('aggregated_states', count(DISTINCT state)) AS VARCHAR) AS attrs_json FROM monthly GROUP BY month, dot, code""",
    "haul_edges_state": f"""WITH {MONTHLY} SELECT md5('operates_in|' || dot || '|' || state || '|' || month) AS event_id, CAST(dot AS VARCHAR) AS src_id, state AS dst_id, month AS event_time, sum(weight) AS weight,
  {_LABEL} AS confidence, CAST(json_object('state', state) AS VARCHAR) AS attrs_json FROM monthly GROUP BY month, dot, state""",
    "macro_modeled_flow": f"""WITH {FLOWS}, g AS (SELECT origin || '-' || destination AS corridor, code, {_sum("tons", 2)} AS weight FROM flows WHERE year = 1997 GROUP BY ALL)
SELECT md5('modeled_flow|' || corridor || '|' || code || '|1997') AS event_id, corridor AS src_id, code AS dst_id, weight, CAST(json_object('corridor', corridor) AS VARCHAR) AS attrs_json FROM g""",
    "macro_shipment_share": f"""WITH {FLOWS} SELECT md5('shipment_share|' || code || '|1997') AS event_id, code AS src_id, CAST(sum(CAST(tons * value AS DECIMAL(28,4))) AS DOUBLE) AS weight FROM flows GROUP BY code""",
    "carrier_risk": f"""WITH {INSP}, p AS (SELECT dot, count(DISTINCT inspection_id) AS n FROM insp WHERE dot IS NOT NULL GROUP BY dot),
v AS (SELECT dot, month, sum(coalesce(viol, 0))::BIGINT AS v, sum(coalesce(oos, 0))::BIGINT AS o FROM insp WHERE dot IS NOT NULL AND month IS NOT NULL GROUP BY ALL),
j AS (SELECT *, v + o / 10.0::DOUBLE + coalesce(n, 0) AS risk FROM v LEFT JOIN p USING (dot))
SELECT md5('carrier_risk|' || dot || '|' || month) AS event_id, CAST(dot AS VARCHAR) AS src_id, month AS event_time, CAST(risk AS DOUBLE) AS weight, CASE WHEN risk > 50 THEN 'medium' ELSE 'weak' END AS confidence,
  CAST(json_object('policies', coalesce(n, 0)) AS VARCHAR) AS attrs_json FROM j""",
    "licence_edges": f"""SELECT md5('maritime_license|' || {_NUM} || '|' || row_id) AS event_id, {_NUM} AS src_id, 1.0::DOUBLE AS weight, CAST(json_object('name', "Legal Name", 'kind', license_kind) AS VARCHAR) AS attrs_json
  FROM fmc_licences WHERE {_NUM} <> '' AND trim("Legal Name") <> ''""",
    "edges_union_by_type": f"""WITH {MONTHLY}, u AS (SELECT 'observed_haul' AS edge_type, weight FROM monthly
  UNION ALL SELECT 'hauls_commodity', sum(weight) FROM monthly GROUP BY month, dot, code UNION ALL SELECT 'operates_in', sum(weight) FROM monthly GROUP BY month, dot, state
  UNION ALL SELECT 'maritime_license', 1.0 FROM fmc_licences WHERE {_NUM} <> '' AND trim("Legal Name") <> '')
SELECT edge_type, count(*) AS n, {_sum("weight")} AS weight FROM u GROUP BY edge_type""",
    "pipeline_miles": f"SELECT src_id, {_sum('weight')} AS miles FROM all_events WHERE {BASE} = 'pipeline_signal' AND length(src_id) = 2 AND weight > 0 GROUP BY src_id",
    "rail_dwell": f"SELECT src_id, {_sum('weight')} / count(weight) AS mean_weight FROM all_events WHERE edge_type ILIKE '%rail%' AND weight IS NOT NULL GROUP BY src_id ORDER BY mean_weight DESC NULLS LAST, src_id LIMIT 10",
    "rail_summary": f"""SELECT src_id, count(*) AS n, count(DISTINCT edge_type) AS measures, {_PTEXT.format("max(" + _PERIOD + ")")} AS latest FROM all_events WHERE {BASE} = 'rail_metric' GROUP BY src_id""",
    "pressure_latest": f"""WITH r AS (SELECT src_id, weight, {_PERIOD} AS t FROM all_events WHERE {_CATALOG_PRESSURE}),
k AS (SELECT *, {_RANKED.format("src_id", "t DESC NULLS LAST, weight DESC NULLS LAST")} AS rn FROM r WHERE t IS NOT NULL),
g AS (SELECT src_id, max(CASE WHEN rn = 1 THEN t END) AS t1, max(CASE WHEN rn = 1 THEN weight END) AS latest_value, max(CASE WHEN rn = 2 THEN t END) AS t2, max(CASE WHEN rn = 2 THEN weight END) AS prior_value FROM k GROUP BY src_id)
SELECT src_id, {_PTEXT.format("t1")} AS latest_time, latest_value, {_PTEXT.format("t2")} AS prior_time, prior_value FROM g""",
    "pressure_tail": f"""WITH r AS (SELECT src_id, weight, {_PERIOD} AS t FROM all_events WHERE {BASE} = 'origin_pressure' AND weight IS NOT NULL AND src_id IS NOT NULL)
SELECT * FROM (SELECT src_id, t, weight, {_RANKED.format("src_id", "t DESC NULLS LAST, weight DESC NULLS LAST")} AS rn FROM r WHERE t IS NOT NULL) WHERE rn <= 8""",
    "trade_latest_month": f"""WITH r AS (SELECT * FROM all_events WHERE {BASE} = 'trade_import' AND regexp_full_match(event_time, '[0-9]{{6}}'))
SELECT event_time, dst_id, {_sum("weight")} AS weight FROM r WHERE event_time = (SELECT max(event_time) FROM r) GROUP BY ALL""",
    "graph_nodes": """SELECT src_type AS node_type, src_id AS node_id FROM all_events WHERE src_type IS NOT NULL AND src_id IS NOT NULL
UNION SELECT dst_type, dst_id FROM all_events WHERE dst_type IS NOT NULL AND dst_id IS NOT NULL""",
    "graph_edge_catalog": "SELECT DISTINCT edge_type, src_type, dst_type FROM all_events",
    "graph_type_summary": f"SELECT edge_type, count(*) AS n, {_sum('weight')} AS weight FROM all_events GROUP BY edge_type",
    "evidence_subgraph_edges": f"WITH {_EVIDENCE} SELECT event_id, edge_type, src_id, dst_id, weight FROM evidence",
    "evidence_subgraph_nodes": f"""WITH {_EVIDENCE} SELECT src_type AS node_type, src_id AS node_id FROM evidence WHERE src_type IS NOT NULL AND src_id IS NOT NULL
UNION SELECT dst_type, dst_id FROM evidence WHERE dst_type IS NOT NULL AND dst_id IS NOT NULL""",
    "edge_subsample": f"""WITH s AS (SELECT {_KEY6}, CASE WHEN event_grain = 'month' AND event_time = '202406' THEN 1
    WHEN edge_type IN ('modeled_flow', 'trade_import', 'rail_metric', 'origin_pressure', 'identity_match') THEN 2 WHEN event_grain = 'month' AND length(event_time) = 6 THEN 3 END AS stage, weight FROM all_events),
g AS (SELECT {_KEY6}, stage, max(weight) AS weight FROM s WHERE stage IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY stage, CASE WHEN stage = 2 THEN edge_type ELSE '' END ORDER BY weight DESC NULLS LAST, {_KEYORDER}) AS rn FROM g)
SELECT {_KEY6}, stage, weight FROM k WHERE rn <= CASE WHEN stage = 2 THEN 100 ELSE 2000 END ORDER BY stage, weight DESC NULLS LAST, {_KEYORDER} LIMIT 2000""",
    "message_pass_one_hop": """WITH e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation),
nodes AS (SELECT a AS node FROM e UNION SELECT b FROM e),
x AS (SELECT node, CAST(length(node) AS DOUBLE) AS x0, CAST(ascii(node) AS DOUBLE) AS x1, CAST(substr(node, 2) AS INT) - 3.0::DOUBLE AS x2 FROM nodes),
both_ AS (SELECT a AS node, b AS other FROM e UNION ALL SELECT b, a FROM e UNION ALL SELECT node, node FROM nodes)
SELECT b.node, greatest(sum(x0) / count(*), 0.0) AS x0, greatest(sum(x1) / count(*), 0.0) AS x1, greatest(sum(x2) / count(*), 0.0) AS x2 FROM both_ b JOIN x ON b.other = x.node GROUP BY b.node""",
    "change_scores_national": _scores("national") + "SELECT * EXCLUDE (adjacent) FROM scores",
    "change_scores_corridor": _scores("corridor") + "SELECT * EXCLUDE (adjacent) FROM scores",
    "change_scores_gap": _scores("corridor") + "SELECT code, state, snapshot_month, truck_weight, prior_weight FROM scores WHERE NOT adjacent",
    "snapshot_month": f"""WITH {SCORES}, m AS (SELECT month, {_sum("weight")} AS w, count(DISTINCT code) AS codes FROM national GROUP BY month)
SELECT coalesce(max(CASE WHEN month < '202601' AND w >= 100 AND codes >= 8 THEN month END), max(CASE WHEN month < '202601' AND w >= 100 THEN month END), max(month)) AS snapshot_month FROM m""",
    "snapshot_month_fallback": f"WITH {SCORES} SELECT max(month) AS snapshot_month FROM national",
    "graph_query_top_states": _scores("corridor") + "SELECT state, truck_weight, change_score FROM scores WHERE code = '17' AND snapshot_month = '202406' ORDER BY truck_weight DESC, state LIMIT 5",
    "graph_query_top_carriers": f"""SELECT src_id, {_sum("weight", 4)} AS amount FROM all_events WHERE {BASE} = 'hauls_commodity' AND dst_id = '17' AND event_time = '202406' GROUP BY src_id
ORDER BY amount DESC NULLS LAST, src_id ASC NULLS LAST LIMIT 5""",
    "origin_join_class": f"""SELECT src_id, CASE WHEN max(CAST(event_time = '202406' AS INT)) = 1 THEN 'aligned' WHEN max(CAST(substr(event_time, 1, 4) = '2024' AS INT)) = 1 THEN 'diverge' ELSE 'none_in_window' END AS join_class
  FROM all_events WHERE {BASE} = 'origin_pressure' AND regexp_full_match(event_time, '[0-9]{{6}}') AND src_id IS NOT NULL GROUP BY src_id""",
    "freight_totals": f"WITH {FLOWS} SELECT count(*) AS n_rows, {_sum('tons', 4)} AS total_tons, {_sum('value', 4)} AS total_value FROM flows",
    "freight_by_mode": f"""WITH {FLOWS}, g AS (SELECT mode, {_sum("tons", 4)} AS amount FROM flows GROUP BY mode)
SELECT mode, amount, 100.0::DOUBLE * amount / CAST(sum(CAST(amount AS DECIMAL(28,4))) OVER () AS DOUBLE) AS share_pct FROM g""",
    "freight_corridors": f"WITH {FLOWS} SELECT origin, destination, {_sum('tons', 4)} AS amount FROM flows GROUP BY ALL ORDER BY amount DESC NULLS LAST, origin, destination LIMIT 20",
    "freight_commodities": f"WITH {FLOWS} SELECT code, {_sum('tons', 4)} AS amount FROM flows GROUP BY ALL ORDER BY amount DESC NULLS LAST, code LIMIT 15",
    "freight_yoy": f"""WITH {FLOWS}, g AS (SELECT mode, {_sum("(CASE WHEN year = 1996 THEN tons END)", 4)} AS amount_first, {_sum("(CASE WHEN year = 1997 THEN tons END)", 4)} AS amount_second FROM flows WHERE year IN (1996, 1997) GROUP BY mode)
SELECT *, 100.0::DOUBLE * (amount_second - amount_first) / nullif(amount_first, 0) AS change_pct FROM g""",
    "moving_commodity": f"""WITH {FLOWS}, a AS (SELECT code, {_sum("tons", 4)} AS amount FROM flows GROUP BY code), b AS (SELECT code, {_sum("value", 4)} AS amount FROM flows WHERE value > 50000 GROUP BY code),
ap AS (SELECT code, 100.0::DOUBLE * amount / CAST(sum(CAST(amount AS DECIMAL(28,4))) OVER () AS DOUBLE) AS p FROM a), bp AS (SELECT code, 100.0::DOUBLE * amount / CAST(sum(CAST(amount AS DECIMAL(28,4))) OVER () AS DOUBLE) AS p FROM b),
j AS (SELECT code, coalesce(ap.p, 0) AS a_pct, coalesce(bp.p, 0) AS b_pct FROM ap FULL JOIN bp USING (code)), s AS (SELECT *, 0.6::DOUBLE * a_pct + 0.4::DOUBLE * b_pct AS score FROM j)
SELECT *, row_number() OVER (ORDER BY score DESC, code) AS rank FROM s""",
    "commodity_top_corridors": f"""WITH {FLOWS}, g AS (SELECT code, origin, destination, {_sum("tons", 4)} AS amount FROM flows GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY amount DESC NULLS LAST, origin, destination) AS rank FROM g) WHERE rank <= 3""",
    "top_commodity_modes": f"""WITH {FLOWS} SELECT code, mode, {_sum("tons", 4)} AS tons FROM flows
WHERE code IN (SELECT code FROM flows GROUP BY code ORDER BY {_sum("tons", 4)} DESC NULLS LAST, code LIMIT 3) GROUP BY ALL""",
    "inspection_coverage": f"""WITH {INSP} SELECT count(*) AS n_rows, count(dot) AS with_dot, count(*) FILTER (shipper <> '') AS with_shipper, count(insp_date) AS with_date, count(*) FILTER (placard) AS hazmat_rows,
  100.0::DOUBLE * count(*) FILTER (shipper <> '') / nullif(count(*), 0) AS shipper_pct FROM insp""",
    "cargo_ties": _ties("true", 3),
    "cargo_ties_state": _ties("state = 'TX'", 2),
    "cargo_ties_lane": _ties("lane = 'grain_feed'", 2),
    "shipper_carriers": f"""WITH {INSP} SELECT dot, count(*) AS n_rows, count(DISTINCT inspection_id) AS n_inspections, CAST(min(insp_date) AS VARCHAR) AS first_date, string_agg(DISTINCT shipper, ' | ' ORDER BY shipper) AS spellings
  FROM insp WHERE contains(shipper, 'FEED MILLS') AND dot IS NOT NULL GROUP BY dot""",
    "truck_signal": f"""WITH {INSP}, g AS (SELECT dot, shipper, code, confidence, state, count(*) AS n, min(carrier) AS carrier, CAST(max(insp_date) AS VARCHAR) AS last_date, CAST(sum(CAST(placard AS INT)) AS BIGINT) AS hazmat_stops,
  CAST(sum(coalesce(oos, 0)) AS BIGINT) AS oos, CAST(sum(coalesce(viol, 0)) AS BIGINT) AS violations FROM insp WHERE dot IS NOT NULL AND insp_date IS NOT NULL AND coalesce(shipper, '') NOT IN {_PLACE} GROUP BY ALL HAVING count(*) >= 3),
i AS (SELECT *, 100.0::DOUBLE * n / max(n) OVER () AS intensity FROM g)
SELECT substr(sha256(concat_ws('|', nullif(CAST(dot AS VARCHAR), ''), nullif(shipper, ''), nullif(code, ''), nullif(state, ''))), 1, 16) AS signal_id, dot, shipper, code, confidence, state, n, carrier, last_date, hazmat_stops, intensity,
  least(100.0::DOUBLE, intensity * CASE WHEN last_date >= '2026-01-01' THEN 1.0::DOUBLE WHEN last_date >= '2025-01-01' THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END * CASE WHEN hazmat_stops > 0 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END
    * CASE confidence WHEN 'strong' THEN 1.2::DOUBLE WHEN 'medium' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END) AS strength,
  least(100.0::DOUBLE, oos * 2.0::DOUBLE + violations * 0.5::DOUBLE) AS safety FROM i""",
    "entity_edges": f"""WITH {INSP}, pairs AS (SELECT dot, shipper, count(*) AS n FROM insp WHERE dot IS NOT NULL AND coalesce(shipper, '') NOT IN {_PLACE} GROUP BY ALL),
heads AS (SELECT DISTINCT {_CORE_TITLE} AS s FROM sec_tickers WHERE title_norm IS NOT NULL),
u AS (SELECT DISTINCT CAST(dot AS VARCHAR) AS left_id, CAST(dot AS VARCHAR) AS right_id, 'carrier_exact' AS tier, 100.0::DOUBLE AS score, true AS accepted FROM pairs
  UNION ALL SELECT shipper, CAST(dot AS VARCHAR), 'service', least(95.0::DOUBLE, 50.0::DOUBLE + n / 10.0::DOUBLE), n >= 5 FROM pairs
  UNION ALL SELECT shipper, core, 'title_exact', 100.0, true FROM (SELECT DISTINCT shipper FROM pairs) JOIN (SELECT DISTINCT {_core("title_norm")} AS core FROM sec_tickers) ON {_core("shipper")} = core WHERE core <> ''
  UNION ALL SELECT shipper, min(s), 'title_substring', 40.0, false FROM (SELECT DISTINCT shipper FROM pairs) JOIN heads ON contains(shipper, s) AND length(s) >= 8 GROUP BY shipper)
SELECT substr(sha256(concat_ws('|', nullif(tier, ''), nullif(left_id, ''), nullif(right_id, ''))), 1, 16) AS edge_id, * FROM u""",
    "carrier_leads": f"""WITH {INSP}, {REGISTRY}, f AS (SELECT dot, max(CAST(code = '17' AS INT)) AS has_fuel, max(CAST(code = '02' AS INT)) AS has_grain, max(CAST(code = '19' AS INT)) AS has_coal FROM insp WHERE dot IS NOT NULL GROUP BY dot)
SELECT * FROM f JOIN registry USING (dot) WHERE (has_fuel = 1 OR has_grain = 1 OR has_coal = 1) AND n_rows >= 2 ORDER BY n_rows DESC, dot LIMIT 200""",
    "identity_exact": f"""SELECT shipper_norm, row_id, least(100.0::DOUBLE, 50.0::DOUBLE + n / 20.0::DOUBLE) AS weight FROM (SELECT shipper_norm, n, {_core("shipper_norm")} AS core FROM top_shippers)
  JOIN (SELECT row_id, {_core('"Legal Name"')} AS core FROM fmc_licences) USING (core) WHERE core <> ''""",
    "identity_substring": f"""SELECT DISTINCT shipper_norm AS long, s AS short FROM top_shippers JOIN (SELECT DISTINCT {_CORE_TITLE} AS s FROM sec_tickers) ON contains(shipper_norm, s) AND length(s) >= 8""",
    "identity_exists": f"SELECT shipper_id, shipper_norm FROM top_shippers t WHERE EXISTS (SELECT 1 FROM all_events e WHERE {BASE.replace('edge_type', 'e.edge_type')} = 'identity_match' AND e.src_id = t.shipper_norm)",
    "price_endpoints": f"WITH {_ENDPOINTS} SELECT * FROM ends",
    "return_band": f"""WITH {_ENDPOINTS} SELECT user_id, n_obs, 100.0::DOUBLE * (last_value - first_value) / nullif(first_value, 0) AS ret FROM ends
WHERE n_obs >= 5 AND first_value >= 1 AND 100.0::DOUBLE * (last_value - first_value) / nullif(first_value, 0) BETWEEN -50 AND 150""",
    "market_best_per_group": f"SELECT event_type, event_id, user_id, value FROM (SELECT *, {_RANKED.format('event_type', 'value DESC NULLS LAST, event_id')} AS rn FROM events) WHERE rn = 1",
    "name_norm_all": f"SELECT row_id, {_NORM.format('SHIPPER_NAME')} AS norm FROM fmcsa_events",
    "name_norm_first": r"SELECT row_id, upper(regexp_replace(regexp_replace(trim(SHIPPER_NAME), '[^A-Z0-9 ]', ' '), '\s+', ' ')) AS norm FROM fmcsa_events",
    "name_norm_core": f"SELECT row_id, {_core('SHIPPER_NAME')} AS core FROM fmcsa_events",
    "slug_names": "SELECT row_id, substr(regexp_replace(lower(SHIPPER_NAME), '[^a-z0-9]+', '_', 'g'), 1, 48) AS slug FROM fmcsa_events",
    "code_pad_hs": """SELECT p_partkey, substr(lpad(trim(CAST(p_size AS VARCHAR)), 2, '0'), 1, 2) AS padded,
  CASE WHEN x LIKE '2701%' THEN '19' WHEN x LIKE '2601%' THEN '19' WHEN x LIKE '27%' THEN '17' WHEN regexp_matches(x, '^100[1-8]') THEN '02' WHEN regexp_matches(x, '^7[23]') THEN '11' WHEN regexp_matches(x, '^(28|29|38|39)') THEN '18' ELSE '31' END AS hs
  FROM (SELECT *, substr(p_partkey || '' || p_size || '01', 1, 10) AS x FROM part)""",
    "stable_ids": """SELECT row_id, md5('licence|' || row_id || '|' || license_kind) AS key,
  substr(sha256(concat_ws('|', nullif(license_kind, ''), nullif(state, ''), nullif(CAST(row_id AS VARCHAR), ''))), 1, 16) AS stable FROM fmc_licences""",
    "try_casts": r"""SELECT row_id, CASE WHEN regexp_full_match(DOT_NUMBER, '[0-9]{1,15}') THEN TRY_CAST(DOT_NUMBER AS BIGINT) END AS as_bigint,
  CASE WHEN regexp_full_match(DOT_NUMBER, '[0-9]{1,9}\.[0-9]') THEN TRY_CAST(DOT_NUMBER AS DOUBLE) END AS as_double FROM fmcsa_events""",
    "json_roundtrip": """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CAST(json_object('k', TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 'none', NULL) AS VARCHAR) AS again FROM events""",
    "confidence_lexical_and_ranked": f"SELECT edge_type, max(confidence) AS lexical, {_LABEL} AS ranked FROM all_events WHERE confidence IS NOT NULL AND edge_type IS NOT NULL GROUP BY edge_type",
    "period_formats": f"SELECT event_time, n, {_PTEXT.format('p')} AS period FROM (SELECT event_time, count(*) AS n, max({_PERIOD}) AS p FROM all_events GROUP BY event_time)",
    "distinct_list": f"WITH {INSP} SELECT dot, string_agg(DISTINCT state, ' | ' ORDER BY state) AS states, count(DISTINCT shipper) AS shippers FROM insp WHERE dot IS NOT NULL GROUP BY dot",
    "map_projection": "SELECT c_custkey, (c_acctbal / 100.0::DOUBLE + 180.0::DOUBLE) / 360.0::DOUBLE * 960.0::DOUBLE AS x, (90.0::DOUBLE - c_nationkey * 3.0::DOUBLE) / 180.0::DOUBLE * 480.0::DOUBLE AS y FROM customer",
    "embedding_activation": """SELECT vec_id, CAST(floor(least(100.0::DOUBLE, 2.0::DOUBLE * list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))))) * 100) AS BIGINT) AS activation FROM embeddings""",
    "stub_check": """SELECT * FROM (SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN regexp_full_match(text, '[\\s\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]*') THEN 'blank'
  WHEN starts_with(lower(ltrim(text)), '<html') OR starts_with(lower(ltrim(text)), '<!doctype html') THEN 'html_stub' WHEN length(text) < 500 THEN 'below_stub' END AS reason FROM documents) WHERE reason IS NOT NULL""",
    "banned_phrase_scan": """SELECT source, phrase, count(*) AS n FROM documents, (VALUES ('customs hold'), ('no answer'), ('out of service')) p(phrase) WHERE contains(lower(text), phrase) GROUP BY ALL""",
    "content_signature_dedup": "SELECT md5(text) AS signature, min(doc_id) AS first_key, count(*) AS copies FROM documents GROUP BY 1",
    "newest_release": f"""SELECT row_id, number, loaded_at FROM (SELECT row_id, {_NUM} AS number, CAST(loaded_at AS VARCHAR) AS loaded_at,
  row_number() OVER (PARTITION BY {_NUM} ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS rn FROM fmc_licences WHERE {_NUM} <> '') WHERE rn = 1""",
    "family_manifest": """WITH g AS (SELECT source, count(*) AS files, CAST(sum(CAST(coalesce(n_chars, 0) > 0 AS INT)) AS BIGINT) AS good, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS bytes FROM documents GROUP BY source)
SELECT *, CASE WHEN good = 0 THEN 'empty' WHEN good < files THEN 'partial' ELSE 'pass' END AS status FROM g""",
    "manifest_merge": """WITH o AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang = 'en' GROUP BY source), v AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL AND doc_type = 'report' GROUP BY source)
SELECT source, coalesce(v.n, o.n) AS n, CASE WHEN v.n IS NULL THEN 'kept' WHEN o.n IS NULL THEN 'added' ELSE 'replaced' END AS change FROM o FULL JOIN v USING (source)""",
    "missing_plan": f"""WITH {INSP} SELECT DISTINCT CAST(dot AS VARCHAR) AS src_id FROM insp WHERE dot IS NOT NULL
EXCEPT SELECT src_id FROM all_events WHERE {BASE} = 'hauls_commodity'""",
    "validate_outputs": _scores("national") + """SELECT rule, count(*) AS n FROM (SELECT 'null_code' AS rule FROM scores WHERE code IS NULL UNION ALL SELECT 'null_snapshot_month' FROM scores WHERE snapshot_month IS NULL
  UNION ALL SELECT 'null_prior_weight' FROM scores WHERE prior_weight IS NULL UNION ALL SELECT 'range_change_score' FROM scores WHERE change_score < 0 OR change_score > 100) GROUP BY rule""",
    "status_histogram": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "incremental_changed": """WITH r AS (SELECT row_id, "Organization No." AS number, md5("Legal Name") AS signature, loaded_at FROM fmc_licences)
SELECT row_id, number, signature FROM r WHERE loaded_at >= TIMESTAMP '2024-01-01' AND NOT EXISTS (SELECT 1 FROM r o WHERE o.loaded_at < TIMESTAMP '2024-01-01' AND o.number = r.number AND o.signature = r.signature)""",
    "windowed_event_totals": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events GROUP BY ALL",
    "hash_features": """WITH n AS (SELECT DISTINCT node_type || ':' || node_id AS node FROM (SELECT src_type AS node_type, src_id AS node_id FROM all_events UNION ALL SELECT dst_type, dst_id FROM all_events) WHERE node_type IS NOT NULL AND node_id IS NOT NULL)
SELECT node, list_transform(range(32), lambda i: sin((CAST('0x' || substr(sha256(node), CAST(2 * i + 1 AS INT), 2) AS INT) + 1) * (i + 1) * 0.13::DOUBLE)) AS features FROM n""",
}
ORACLE["stream_event_totals"] = ORACLE["windowed_event_totals"]

"""Queries of the general data-preparation operators (p1, p2, p5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadstone.functions.periods import period_text
from loadstone.operators import entity_features as ef
from loadstone.operators import heavy_keys as hk
from loadstone.operators import rejects as rj
from loadstone.session import table


def p1_features(spark: SparkSession, d: str) -> DataFrame:
    return ef.entity_features(table(spark, d, "all_events"))


def p1_type_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = ef.entity_type_stats(table(spark, d, "all_events"))
    return stats.select("src_id", "edge_type", "n", period_text(F.col("latest")).alias("latest_period"), F.col("total").alias("total_weight"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_rejects(spark, d).select("table_name", "row_id")


def p2_rejects(spark: SparkSession, d: str) -> DataFrame:
    return rj.all_rejects(table(spark, d, "raw_lines"), {t: table(spark, d, t) for t in ("fmcsa_events", "fmc_licences")})


def p2_loaded_inspections(spark: SparkSession, d: str) -> DataFrame:
    return rj.load_table(table(spark, d, "fmcsa_events")).select("row_id", "INSPECTION_ID", "DOT_NUMBER", F.col("INSP_DATE").cast("string"), "SHIPPER_NAME", "VIOL_TOTAL")


def p2_loaded_lines(spark: SparkSession, d: str) -> DataFrame:
    return rj.load_lines(table(spark, d, "raw_lines"), "inspection").drop("received_at").withColumn("INSP_DATE", F.col("INSP_DATE").cast("string"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hk.heavy_keys(table(spark, d, "all_events"))


def p5_key_results(spark: SparkSession, d: str) -> DataFrame:
    return hk.per_key_results(table(spark, d, "all_events"))


def p5_modes(spark: SparkSession, d: str) -> DataFrame:
    return hk.key_modes(table(spark, d, "all_events"), "dst_id", "src_id")


def p5_weight_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return hk.weighted_percentiles(table(spark, d, "all_events"), "dst_id", "weight")


QUERIES = {
    f.__name__: f
    for f in (p1_features, p1_type_stats, p2_found, p2_rejects, p2_loaded_inspections, p2_loaded_lines, p5_found, p5_key_results, p5_modes, p5_weight_percentiles)
}

_PERIOD = r"""CASE WHEN regexp_full_match(trim(event_time), '[12]\d{3}') THEN CAST(trim(event_time) AS INT) * 1000 + 120
     WHEN regexp_full_match(trim(event_time), '[12]\d{3}(0[1-9]|1[0-2])([0-3]\d)?') THEN CAST(substr(trim(event_time), 1, 6) AS INT) * 10 + 1
     WHEN regexp_full_match(trim(event_time), '[12]\d{3}[-/](0?[1-9]|1[0-2])')
     THEN (CAST(substr(trim(event_time), 1, 4) AS INT) * 100 + CAST(substr(trim(event_time), 6) AS INT)) * 10 + 1 END"""
_BLANK = r"[\s\x{85}\x{a0}\x{3000}]"
_STRIP = rf"regexp_replace(regexp_replace(@, '^{_BLANK}+', ''), '{_BLANK}+$', '')"
_DOT, _DATE, _ORG = _STRIP.replace("@", "DOT_NUMBER"), _STRIP.replace("@", "INSP_DATE"), _STRIP.replace('@', '"Organization No."')
_BAD_DOT = rf"({_DOT} <> '' AND NOT regexp_full_match({_DOT}, '0*[1-9][0-9]*') OR length({_DOT}) > 8)"
_BAD_DATE = rf"({_DATE} <> '' AND (NOT regexp_full_match({_DATE}, '(199\d|20[01]\d|202[0-6])\d{{4}}') OR try_strptime({_DATE}, '%Y%m%d') IS NULL))"
_BAD_ORG = rf"({_ORG} <> '' AND NOT regexp_full_match({_ORG}, '[0-9]{{6,7}}'))"
# one regular expression for the layout of a record; the values are checked on the fields it captures
_FIELD = r'("(?:[^"]|"")*"|[^",\r\n]*)'


def _layout(n: int) -> str:
    return "(?s)" + ",".join([_FIELD] * n)


def _value(layout: int, i: int) -> str:
    raw = f"regexp_extract(line, '^{_layout(layout)}$', {i})"
    return _STRIP.replace("@", f"CASE WHEN {raw} LIKE '\"%' THEN replace(substr({raw}, 2, length({raw}) - 2), '\"\"', '\"') ELSE {raw} END")


def _typed(i: int, name: str) -> str:
    other = "(?:" + _FIELD[1:]
    raw = f"regexp_extract(line, '(?s)^{','.join(_FIELD if k == i else other for k in range(1, 14))}$', 1)"
    value = "nullif(" + _STRIP.replace("@", f"CASE WHEN {raw} LIKE '\"%' THEN replace(substr({raw}, 2, length({raw}) - 2), '\"\"', '\"') ELSE {raw} END") + ", '')"
    if name == "INSP_DATE":
        return f"CAST(CAST(try_strptime({value}, '%Y%m%d') AS DATE) AS VARCHAR) AS {name}"
    return f'TRY_CAST({value} AS {"BIGINT" if name == "DOT_NUMBER" else "INT"}) AS {name}' if name in ("DOT_NUMBER", "GROSS_COMB_VEH_WT", "OOS_TOTAL", "VIOL_TOTAL") else f"{value} AS {name}"


_LINE_CHECK = f"""SELECT row_id, CASE
    WHEN line IS NULL OR feed IS NULL OR feed NOT IN ('inspection', 'licence') THEN true
    WHEN feed = 'inspection' THEN NOT regexp_full_match(line, '{_layout(13)}') OR
      (SELECT {_BAD_DOT.replace('DOT_NUMBER', 'x')} FROM (SELECT {_value(13, 2)} AS x)) OR (SELECT {_BAD_DATE.replace('INSP_DATE', 'x')} FROM (SELECT {_value(13, 4)} AS x))
    ELSE NOT regexp_full_match(line, '{_layout(6)}') OR (SELECT {_BAD_ORG.replace('"Organization No."', 'x')} FROM (SELECT {_value(6, 1)} AS x)) END AS bad
  FROM raw_lines"""

_KEPT = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY source_mtime DESC NULLS LAST, weight DESC NULLS LAST, edge_type DESC NULLS LAST,
                               src_id DESC NULLS LAST, event_time DESC NULLS LAST) AS rn
  FROM all_events),
kept AS (SELECT src_id, edge_type, CASE WHEN NOT isnan(weight) THEN weight END AS weight, {_PERIOD} AS period FROM ranked WHERE event_id IS NULL OR rn = 1)"""
_LABEL = "CASE WHEN @ % 10 = 1 THEN CAST(@ // 10 AS VARCHAR) ELSE CAST(@ // 1000 AS VARCHAR) END"

ORACLE = {
    "p1_features": f"""
WITH {_KEPT},
stats AS (SELECT src_id, edge_type, count(*) AS n, max(period) AS p, sum(CAST(weight AS DECIMAL(18,6))) AS w FROM kept GROUP BY ALL),
types AS (SELECT DISTINCT edge_type AS t FROM all_events),
entities AS (SELECT src_id, sum(n) AS n_events, count(*) AS n_types, max(p) AS p, sum(w) AS w FROM stats GROUP BY src_id),
wide AS (
  SELECT e.src_id, list(t ORDER BY t NULLS LAST) AS edge_types, list(coalesce(s.n, 0) ORDER BY t NULLS LAST) AS counts,
    list({_LABEL.replace('@', 's.p')} ORDER BY t NULLS LAST) AS latest_periods, list(coalesce(CAST(s.w AS DOUBLE), 0) ORDER BY t NULLS LAST) AS total_weights
  FROM entities e CROSS JOIN types LEFT JOIN stats s ON s.src_id IS NOT DISTINCT FROM e.src_id AND s.edge_type IS NOT DISTINCT FROM t GROUP BY e.src_id)
SELECT w.*, CAST(e.n_events AS BIGINT) AS n_events, e.n_types, {_LABEL.replace('@', 'e.p')} AS latest_period, coalesce(CAST(e.w AS DOUBLE), 0) AS total_weight
FROM wide w JOIN entities e ON w.src_id IS NOT DISTINCT FROM e.src_id""",
    "p1_type_stats": f"""
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY source_mtime DESC NULLS LAST, weight DESC NULLS LAST, edge_type DESC NULLS LAST,
                               src_id DESC NULLS LAST, event_time DESC NULLS LAST) AS rn
  FROM all_events),
kept AS (SELECT src_id, edge_type, weight, {_PERIOD} AS period FROM ranked WHERE event_id IS NULL OR rn = 1)
SELECT src_id, edge_type, count(*) AS n,
  CASE WHEN max(period) % 10 = 1 THEN CAST(max(period) // 10 AS VARCHAR) ELSE CAST(max(period) // 1000 AS VARCHAR) END AS latest_period,
  coalesce(CAST(sum(CAST(CASE WHEN NOT isnan(weight) THEN weight END AS DECIMAL(18,6))) AS DOUBLE), 0) AS total_weight
FROM kept GROUP BY src_id, edge_type""",
    "p2_found": f"""
SELECT 'raw_lines' AS table_name, row_id FROM ({_LINE_CHECK}) WHERE bad
UNION ALL SELECT 'fmcsa_events', row_id FROM fmcsa_events WHERE {_BAD_DOT} OR {_BAD_DATE}
UNION ALL SELECT 'fmc_licences', row_id FROM fmc_licences WHERE {_BAD_ORG}""",
    "p2_loaded_inspections": f"""
SELECT row_id, INSPECTION_ID, TRY_CAST(nullif({_DOT}, '') AS BIGINT) AS DOT_NUMBER, CAST(CAST(try_strptime({_DATE}, '%Y%m%d') AS DATE) AS VARCHAR) AS INSP_DATE, SHIPPER_NAME, VIOL_TOTAL
FROM fmcsa_events WHERE NOT coalesce({_BAD_DOT}, false) AND NOT coalesce({_BAD_DATE}, false)""",
    "p2_loaded_lines": "SELECT row_id, batch, "
    + ", ".join(_typed(i, c) for i, c in enumerate(rj.LAYOUTS["inspection"], 1))
    + f" FROM raw_lines JOIN ({_LINE_CHECK}) c USING (row_id) WHERE feed = 'inspection' AND NOT coalesce(bad, false)",
    "p5_found": """
SELECT 'dst_id' AS key_column, dst_id AS key_value FROM all_events WHERE dst_id IS NOT NULL GROUP BY dst_id
HAVING count(*) >= 0.01 * (SELECT count(*) FROM all_events)
UNION ALL SELECT 'src_id', src_id FROM all_events WHERE src_id IS NOT NULL GROUP BY src_id HAVING count(*) >= 0.01 * (SELECT count(*) FROM all_events)""",
    "p5_key_results": """
WITH p AS (SELECT dst_id AS l, src_id AS r, count(*) AS n, sum(CAST(CASE WHEN NOT isnan(weight) THEN weight END AS DECIMAL(18,6))) AS w FROM all_events GROUP BY ALL)
SELECT 'dst_id' AS key_column, l AS key_value, CAST(sum(n) AS BIGINT) AS n_rows, coalesce(CAST(sum(w) AS DOUBLE), 0) AS total_weight, count(r) AS n_partners,
  max(CASE WHEN r IS NOT NULL THEN n END) AS mode_rows FROM p GROUP BY l
UNION ALL SELECT 'src_id', r, CAST(sum(n) AS BIGINT), coalesce(CAST(sum(w) AS DOUBLE), 0), count(l), max(CASE WHEN l IS NOT NULL THEN n END) FROM p GROUP BY r""",
    "p5_modes": """
SELECT key_value, mode, n FROM (SELECT dst_id AS key_value, src_id AS mode, count(*) AS n, row_number() OVER (PARTITION BY dst_id ORDER BY count(*) DESC, src_id) AS rn
  FROM all_events WHERE src_id IS NOT NULL GROUP BY dst_id, src_id) WHERE rn = 1""",
    "p5_weight_percentiles": """
WITH c AS (SELECT dst_id AS key_value, weight AS v, row_number() OVER (PARTITION BY dst_id ORDER BY weight) AS rn, count(*) OVER (PARTITION BY dst_id) AS n_values
  FROM all_events WHERE weight IS NOT NULL AND NOT isnan(weight))
SELECT key_value, n_values, min(CASE WHEN rn >= ceil(n_values * 0.5) THEN v END) AS p50, min(CASE WHEN rn >= ceil(n_values * 0.9) THEN v END) AS p90
FROM c GROUP BY key_value, n_values""",
}

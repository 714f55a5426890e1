"""Entity features, rejects and heavy keys on small tables: nulls, ties, repeats, empty tables, clashing names."""

import datetime as dt
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loadstone.functions.periods import period_code, period_text
from loadstone.functions.text import exact_sum
from loadstone.operators import entity_features as ef
from loadstone.operators import heavy_keys as hk
from loadstone.operators import rejects as rj
from loadstone.operators import temporal as tm

EVENTS = "event_id string, edge_type string, src_id string, event_time string, weight double, source_mtime bigint, n int, latest string, t string, i int"


def event(id, kind, src, time, weight, mtime=1):
    return (id, kind, src, time, weight, mtime, 9, "x", "y", 3)  # the last columns clash with inner names


def test_periods(spark):
    texts = ["202403", "2024-03", "2024/3", "2024/12", "20240315", "2024", "snapshot", "", None, " 202403 ", "2024-13", "202400", "2024/003"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "p string").select(period_text(period_code(F.col("p")))).collect()]
    assert got == ["202403", "202403", "202403", "202412", "202403", "2024", None, None, None, "202403", None, None, None]


def test_features(spark):
    rows = [
        event("a", "haul", "S", "202401", 1.5), event("a", "haul", "S", "202401", 2.5, 9), event("b", "haul", "S", "2024-03", 1.0), event("c", "own", "S", "2024", None),
        event("d", "own", "S", "snapshot", -3.0), event(None, "haul", "T", None, math.nan), event(None, "haul", "T", None, math.nan), event("e", None, "T", "2023", 1.0), event("f", "x" * 5000, None, "202201", 4.0),
    ]
    df = ef.entity_features(spark.createDataFrame(rows, EVENTS), salts=4)
    got = {r["src_id"]: r for r in df.collect()}
    assert set(got) == {"S", "T", None}
    types = got["S"]["edge_types"]
    assert types == ["haul", "own", "x" * 5000, None]
    assert got["S"]["counts"] == [2, 2, 0, 0] and got["S"]["total_weights"] == [3.5, -3.0, 0.0, 0.0]
    assert got["S"]["latest_periods"] == ["202403", "2024", None, None] and got["S"]["latest_period"] == "2024" and got["S"]["n_events"] == 4
    assert got["T"]["counts"] == [2, 0, 0, 1] and got["T"]["total_weight"] == 1.0
    assert got[None]["n_types"] == 1


def test_features_empty_and_bound(spark):
    empty = spark.createDataFrame([], EVENTS)
    assert ef.entity_features(empty).collect() == []
    some = spark.createDataFrame([event(str(k), f"t{k}", "S", "2024", 1.0) for k in range(5)], EVENTS)
    with pytest.raises(ValueError):
        ef.entity_type_list(some, 4)
    fixed = ef.entity_features(some, ["t1", "t3"]).first()
    assert fixed["counts"] == [1, 1] and fixed["n_events"] == 5


def test_features_do_not_depend_on_salts(spark, monkeypatch):
    monkeypatch.setattr(ef, "HEAVY", 100)
    rows = [event(f"e{k}", f"t{k % 3}", f"s{k % 2}", f"2024{k % 12 + 1:02}", k / 7) for k in range(500)]
    df = spark.createDataFrame(rows, EVENTS)
    one, many = (sorted(map(str, ef.entity_features(df, salts=s).collect())) for s in (1, 50))
    assert one == many


def test_sums_keep_large_numbers(spark):
    numbers = [("a", 1e12), ("a", 5.0), ("b", 1e22), ("b", 1.5), ("c", math.inf), ("c", 1.0), ("d", math.nan), ("d", 2.5), ("e", None), ("e", math.nan), ("f", 1e308), ("f", 1e308)]
    df = spark.createDataFrame(numbers, "k string, v double")
    got = dict(df.groupBy("k").agg(exact_sum("v")).collect())
    assert got == {"a": 1e12 + 5, "b": 1e22 + 1.5, "c": math.inf, "d": 2.5, "e": None, "f": math.inf}
    rows = [event(str(i), "haul", k, "202401", v) for i, (k, v) in enumerate(numbers)]
    features = {r["src_id"]: r["total_weight"] for r in ef.entity_features(spark.createDataFrame(rows, EVENTS)).collect()}
    assert features == {k: v or 0.0 for k, v in got.items()}
    shares = {r["k"]: r["share"] for r in tm.shares(df.filter("k IN ('a', 'b')"), "k", "v").collect()}
    assert math.isclose(sum(shares.values()), 100)


def lines(*texts, feed="inspection"):
    return [(k, feed, t) for k, t in enumerate(texts)]


GOOD = '1,123456,"ACME, ""BIG"" CO\nX",20240229,1,TX,P,,N,C,1,2,3'


def reasons(spark, rows):
    df = spark.createDataFrame(rows, "row_id bigint, feed string, line string")
    return {r["row_id"]: r["reason"] for r in rj.rejected_lines(df).collect()}


def test_line_reasons(spark):
    rows = lines(
        GOOD, GOOD.replace("20240229", "20230229"), GOOD.replace("123456", "000"), GOOD.replace("123456", " 12 "), GOOD.replace("123456", ""), GOOD + ",9", "1,2", 'x"y,' + GOOD[2:], '"x"y,' + GOOD[2:],
        GOOD.replace("N,C", 'N,"C'), "1\n," + GOOD[2:], "", None, GOOD.replace("123456", "12\\"), ' "1",' + GOOD[2:], '"",' + GOOD[2:], GOOD.replace("20240229", "20270101"), "x" * 200_000 + GOOD[1:], '"' + '""' * 50_000 + '"' + GOOD[1:],
    )
    assert reasons(spark, rows) == {
        1: "bad_insp_date", 2: "bad_dot_number", 5: "too_many_fields", 6: "too_few_fields", 7: "unclosed_quote", 8: "misplaced_quote", 9: "unclosed_quote", 10: "bare_line_break", 11: "too_few_fields",
        12: "null_line", 13: "bad_dot_number", 14: "misplaced_quote", 16: "bad_insp_date",
    }


def test_unknown_feed_null_offsets_and_repeats(spark):
    rows = [(None, "inspection", GOOD), (None, "inspection", "1"), (7, "other", "x"), (7, None, GOOD), (8, "inspection", GOOD), (8, "inspection", GOOD), (8, "inspection", "bad"), (9, "licence", "12345,a,b,c,d,e"), (10, "licence", "123456,a,b,c,d,e")]
    df = spark.createDataFrame(rows, "row_id bigint, feed string, line string")
    got = sorted((str(r["row_id"]), r["reason"]) for r in rj.rejected_lines(df).collect())
    assert got == [("7", "unknown_feed"), ("7", "unknown_feed"), ("8", "too_few_fields"), ("9", "bad_organization_no"), ("None", "too_few_fields")]


def test_loaded_values(spark):
    raw = spark.createDataFrame([(1, "inspection", "b", GOOD.replace("123456", '" 00123 "'), None)], "row_id bigint, feed string, batch string, line string, received_at timestamp")
    r = rj.load_lines(raw, "inspection").first()
    assert r["DOT_NUMBER"] == 123 and r["INSP_DATE"] == dt.date(2024, 2, 29) and r["SHIPPER_NAME"] == 'ACME, "BIG" CO\nX' and r["CARGO_TANK"] is None and r["VIOL_TOTAL"] == 3
    sep = rj.load_lines(raw.withColumn("line", F.lit(GOOD.replace("ACME", "A\x01\x02b\x02a"))), "inspection").first()
    assert sep["SHIPPER_NAME"].startswith("A\x01\x02b\x02a,")


def test_table_rejects(spark):
    rows = [(1, "123", "20240101"), (2, "12x", None), (3, "", "2024-01-01"), (4, None, None), (5, " 123　", " 20240101"), (5, "0", "19891231"), (None, "1e5", "20240101")]
    df = spark.createDataFrame(rows, "row_id bigint, DOT_NUMBER string, INSP_DATE string")
    assert sorted((str(r["row_id"]), r["reason"]) for r in rj.rejected_rows(df).collect()) == [("2", "bad_dot_number"), ("3", "bad_insp_date"), ("5", "bad_dot_number"), ("None", "bad_dot_number")]
    assert sorted(str(r["row_id"]) for r in rj.load_table(df).collect()) == ["1", "4", "5"]
    assert rj.rejected_rows(df.limit(0)).collect() == []


def test_heavy_keys(spark):
    rows = [("US", f"s{k % 7}", 1.0) for k in range(300)] + [(None, "s1", None)] * 50 + [(f"d{k}", None, math.nan) for k in range(50)]
    df = spark.createDataFrame(rows, "dst_id string, src_id string, weight double").withColumn("l", F.lit(1)).withColumn("key_value", F.lit(2))
    got = {(r["key_column"], r["key_value"]): r for r in hk.per_key_results(df).collect()}
    us = got["dst_id", "US"]
    assert (us["n_rows"], us["total_weight"], us["n_partners"], us["mode_rows"]) == (300, 300.0, 7, 43)
    assert got["src_id", None]["n_rows"] == 50 and got["src_id", None]["n_partners"] == 50 and got["dst_id", None]["total_weight"] == 0.0
    assert {(r[0], r[1]) for r in hk.heavy_keys(df, 0.1).collect()} == {("dst_id", "US"), *[("src_id", f"s{k}") for k in range(7)]}
    assert hk.heavy_keys(df.limit(0)).collect() == [] and hk.per_key_results(df.limit(0)).collect() == []


def test_key_results_make_pairs_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/all_events.parquet") if Path("/root/testdata/sf0.001").exists() else spark.range(9).selectExpr("id AS dst_id", "id AS src_id", "1.0D AS weight")
    plan = hk.per_key_results(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_modes(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "q"), ("b", "p"), ("b", None), ("c", None), (None, "z")], "k string, v string").withColumn("n", F.lit(0)).withColumn("key_value", F.lit(0))
    assert {tuple(r) for r in hk.key_modes(df, "k", "v").collect()} == {("a", "x", 2), ("b", "p", 1), (None, "z", 1)}
    assert hk.key_modes(df.limit(0), "k", "v").collect() == []


def test_percentiles(spark):
    values = [5.0] * 100 + [-1.0, 0.0, 7.5, 1e9, math.nan, None]
    df = spark.createDataFrame([("a", v) for v in values] + [(None, 2.0), ("n", None)], "k string, v double")
    got = {r["key_value"]: r.asDict() for r in hk.weighted_percentiles(df, "k", "v", (0.01, 0.5, 1.0)).collect()}
    assert got == {"a": {"key_value": "a", "n_values": 104, "p1": 0.0, "p50": 5.0, "p100": 1e9}, None: {"key_value": None, "n_values": 1, "p1": 2.0, "p50": 2.0, "p100": 2.0}}

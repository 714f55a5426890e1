"""Traps of the data model and readers on literal frames."""

import hashlib
import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from loadstone.functions import text as tx
from loadstone.operators import edges as ed
from loadstone.operators import graph as gr
from loadstone.operators import quality as ql
from loadstone.operators import temporal as tm
from loadstone.plans import reference_queries as rq
from loadstone.schema import EDGE_COLUMNS, EDGE_TYPES, empty_events
from loadstone.sources import readers as rd
from loadstone.sources import sinks
from loadstone.streaming import hauls as st


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_names(spark):
    assert one(spark, tx.name_norm(F.lit("Acme  Co., Inc"))) == "ACME CO INC"
    assert one(spark, tx.name_norm_first(F.lit("Acme  Co., Inc"))) == "A ME  CO., INC"
    twice = tx.name_norm(tx.name_norm(F.lit("é A--b")))
    assert one(spark, twice) == one(spark, tx.name_norm(F.lit("é A--b")))
    assert one(spark, tx.hs_code(F.lit("2701.12"))) == "19" and one(spark, tx.hs_code(F.lit("2709"))) == "17" and one(spark, tx.hs_code(F.lit(None).cast("string"))) == "31"
    assert one(spark, tx.stable_id(F.lit("a"), F.lit(""), F.lit(None).cast("string"))) == one(spark, tx.stable_id(F.lit("a")))
    assert one(spark, tx.json_object(a=F.lit(None).cast("string"), b=F.lit(1))) == '{"a":null,"b":1}'


def test_confidence_by_rank(spark):
    df = spark.createDataFrame([("weak",), ("medium",), ("strong",), (None,)], "c string")
    r = df.agg(F.max("c").alias("lexical"), F.max_by("c", tx.confidence_rank(F.col("c"))).alias("ranked")).first()
    assert r["lexical"] == "weak" and r["ranked"] == "strong"


def test_event_ids_are_unique(spark):
    rows = [("202401", "S", 1, "TX", code, "weak", 2.0) for code in ("02", "17")]
    m = spark.createDataFrame(rows, "month string, shipper string, dot bigint, state string, code string, confidence string, weight double")
    e = ed.haul_edges(m)
    assert e.columns == EDGE_COLUMNS and e.select("event_id").distinct().count() == 2
    total = ed.commodity_edges(m).agg(F.sum("weight")).first()[0]
    assert total == 4.0 == ed.state_edges(m).agg(F.sum("weight")).first()[0]


def test_empty_events_keep_their_schema(spark):
    e = empty_events(spark)
    assert gr.nodes(e).collect() == [] and gr.edge_catalog(e).columns == ["edge_type", "src_type", "dst_type"] and "observed_haul" in EDGE_TYPES
    assert tm.monthly_weights(e).collect() == []


def test_change_scores_bridge_gaps(spark):
    m = spark.createDataFrame([("202401", "17", 100.0), ("202403", "17", 150.0)], "month string, code string, weight double")
    s = spark.createDataFrame([("17", 40.0)], "code string, share double")
    rows = {r["snapshot_month"]: r for r in tm.change_scores(m, s, ["code"]).collect()}
    assert rows["202403"]["delta_pct"] == 50.0 and rows["202403"]["adjacent"] is False and 0 <= rows["202403"]["change_score"] <= 100 and rows["202401"]["delta_pct"] == 0.0


def test_periods_meet(spark):
    df = spark.createDataFrame([("a", "202310"), ("a", "202309"), ("b", "202606"), ("c", "202601")], "k string, p string")
    assert {r[0]: r[1] for r in tm.classify_periods(df, "k", "p", F.lit("202606")).collect()} == {"a": "none_in_window", "b": "aligned", "c": "diverge"}


def test_contained_names(spark):
    longs = spark.createDataFrame([("ACME STEEL WORKS",), ("STEEL WO",), (None,), ("X",)], "l string")
    shorts = spark.createDataFrame([("STEEL WORKS",), ("STEEL WO",), ("ACME",), (None,)], "s string")
    assert sorted(map(tuple, ed.contained_names(longs, shorts).collect())) == [("ACME STEEL WORKS", "STEEL WO"), ("ACME STEEL WORKS", "STEEL WORKS"), ("STEEL WO", "STEEL WO")]


def staged_by_loop(rows, month, types, limit, least):
    """The reference's four stages, one after another over distinct keys."""
    base = lambda r: (r[0] or "").split(".")[0]
    sample = {}

    def add(rule, quota, stage):
        best = {}
        for r in rows:
            if rule(r) and r[:6] not in sample and (r[:6] not in best or r[6] > best[r[:6]]):
                best[r[:6]] = r[6]
        for k in sorted(best, key=lambda k: (-best[k], k))[: min(quota, limit - len(sample))]:
            sample[k] = (stage, best[k])

    in_month = lambda r: r[7] == "month" and r[5] == month
    add(in_month, limit, 1)
    quota = max(least, (limit - len(sample)) // len(types))
    for t in types:
        add(lambda r, t=t: base(r) == t and not in_month(r), quota, 2)
    add(lambda r: r[7] == "month" and len(r[5]) == 6 and r[5] != month, limit, 3)
    add(lambda r: base(r) == "carrier_risk", limit, 4)
    return sorted((*k, *v) for k, v in sample.items())


def test_staged_subsample_fills_what_is_left(spark):
    rng = random.Random(5)
    kinds = ("a", "a.x", "b.y", "b", "c", "carrier_risk.z", "carrier_risk", "d.q")
    times = (("202406", "month"), ("202405", "month"), ("202401", "month"), ("2024", "year"), ("snapshot", "snapshot"))
    rows = [(rng.choice(kinds), "s", str(rng.randrange(40)), "t", str(rng.randrange(3)), *rng.choice(times), float(rng.randrange(50))) for _ in range(900)]
    rows = [(*r[:6], r[7], r[6]) for r in rows]
    key = "edge_type string, src_type string, src_id string, dst_type string, dst_id string, event_time string"
    df = spark.createDataFrame(rows, f"{key}, weight double, event_grain string").repartition(3)
    full = len({r[:6] for r in rows})
    for limit, least in ((20, 5), (170, 20), (250, 500), (400, 5), (550, 30), (600, 5), (650, 1), (full, 5), (10**6, 5)):
        got = [tuple(r) for r in gr.staged_subsample(df, "202406", ("b", "a", "c"), limit, least).collect()]
        assert sorted(got) == staged_by_loop(rows, "202406", ("b", "a", "c"), limit, least), limit
    stages = {r[6] for r in got}
    assert stages == {1, 2, 3, 4} and {r[0] for r in got if r[6] == 2} >= {"a.x", "b.y"}


def test_message_passing_keeps_isolated_nodes(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b")], "a string, b string")
    x = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [3.0, 4.0])], "node string, embedding array<double>")
    got = {r["node"]: r["embedding"] for r in gr.message_pass(edges, x, 1, 2).collect()}
    assert got["c"] == [0.6, 0.8] and got["a"] == pytest.approx([1 / 5**0.5, 2 / 5**0.5])


def embeddings_by_loop(rows, epochs, dim=32):
    """The reference's embeddings over all pairs: mean of neighbours and self, rectified, unit length."""
    ends = [tuple(f"{t}:{i}" if t and i else None for t, i in (r[:2], r[2:])) for r in rows]
    met = {n: [n] for e in ends for n in e if n}
    for a, b in ends:
        if a and b:
            met[a].append(b)
            met[b].append(a)
    digest = {n: hashlib.sha256(n.encode()).digest() for n in met}
    x = {n: [math.sin((h[i % 32] + 1) * (i + 1) * 0.13) for i in range(dim)] for n, h in digest.items()}
    start = x
    for _ in range(epochs):
        mean = {n: [max(sum(x[m][i] for m in ms) / len(ms), 0.0) for i in range(dim)] for n, ms in met.items()}
        x = {n: [v / (math.sqrt(sum(w * w for w in m)) or 1.0) for v in m] for n, m in mean.items()}
    return start, x


def test_embeddings_cover_all_typed_endpoints(spark, tmp_path):
    rng = random.Random(7)
    types = ("shipper", "carrier", "commodity", "ticker")
    rows = [(rng.choice(types), str(rng.randrange(9)), rng.choice(types), str(rng.randrange(9))) for _ in range(120)]
    rows += [("carrier", "hub", "state", str(k % 7)) for k in range(60)] + [("corridor", "alone", None, None), (None, None, "lei", "far"), ("port", "p", "port", "p"), ("ticker", None, "state", "1")]
    columns = "src_type string, src_id string, dst_type string, dst_id string"
    kinds = ("operates_in.x", "modeled_flow", "identity_match", None)
    df = spark.createDataFrame([(*r, kinds[k % 4]) for k, r in enumerate(rows)], f"{columns}, edge_type string")
    df.write.parquet(str(tmp_path / "all_events.parquet"))
    for name, epochs in (("hash_features", 0), ("message_pass_hop", 1), ("message_pass_epochs", 20)):
        start, want = embeddings_by_loop(rows, epochs)
        got = {r[0]: r[1] for r in rq.QUERIES[name](spark, str(tmp_path)).collect()}
        assert set(got) == set(want) and {"corridor:alone", "lei:far", "port:p"} <= set(got)
        for n, v in (want if epochs else start).items():
            assert got[n] == pytest.approx(v, abs=1e-9), (name, n)


def test_hash_features_equal_to_the_last_bit(spark):
    rows = [("carrier", str(k), "state", str(k % 50)) for k in range(800)] + [("a:b", "c", "a", "b:c"), ("a", None, None, "c"), ("", "", "a", "b:c")]
    _, found = gr.typed_edges(spark.createDataFrame(rows, "src_type string, src_id string, dst_type string, dst_id string"))
    got = found.select("node", gr.hash_features(F.col("node"))).collect()
    assert sorted(r[0] for r in got) == sorted({f"{t}:{i}" for r in rows for t, i in (r[:2], r[2:]) if t is not None and i is not None})
    for node, features in got:
        digest = hashlib.sha256(node.encode()).digest()
        assert features == [math.sin((b + 1) * (i + 1) * 0.13) for i, b in enumerate(digest)], node


def test_stubs_and_merge(spark):
    df = spark.createDataFrame([("<html><body>Missing Key",), ("x" * 600,), (" ",), (None,), ("tiny",)], "t string")
    assert [r[0] for r in df.select(ql.stub_reason(F.col("t"))).collect()] == ["html_stub", None, "blank", "missing", "below_stub"]
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert {tuple(r) for r in ql.merged(old, new, "k", "v").collect()} == {("a", 1, "kept"), ("b", 3, "replaced"), ("c", 4, "added")}


def test_readers(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('x|y|\n1|"two\nlines"|3\n4|5\n6|7|8|9\n')
    assert rd.sniff_delimiter(str(p)) == "|" and rd.header(str(p), "|") == ["x", "y", "col_2"]
    rows = [tuple(r) for r in rd.read_delimited(spark, str(p)).collect()]
    assert rows == [("1", "two\nlines", "3"), ("4", "5", None), ("6", "7", "8")]
    (tmp_path / "b.csv").write_text("y,z\n1,2\n")
    assert sorted(rd.read_many(spark, [str(p), str(tmp_path / "b.csv")]).columns) == ["col_2", "x", "y", "z"]
    (tmp_path / "l.json").write_text('{"a": 1}\nbroken{\n7\n')
    assert sorted(map(tuple, rd.read_json_lines(spark, str(tmp_path / "l.json"), "a int, value string").collect()), key=str) == [(1, None), (None, "7")]
    (tmp_path / "m.json").write_text('{"k1": {"a": 1}, "k2": {"a": 2}}')
    assert sorted(map(tuple, rd.read_json_records(spark, str(tmp_path / "m.json"), "a int").collect())) == [("k1", 1), ("k2", 2)]
    (tmp_path / "s.json").write_text(json.dumps({"series_id": "S.A", "name": "n", "units": "u", "data": [["202402", 2.5], ["202401", None]]}) + "\n")
    assert [(r["period"], r["value"], r["place"]) for r in rd.read_series(spark, str(tmp_path / "s.json"), "S.").collect()] == [("202402", 2.5, 1), ("202401", None, 2)]
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"properties":{"a":1},"geometry":null},{"properties":{"a":')
    assert [r["properties"] for r in rd.read_geojson(spark, str(tmp_path / "g.json")).collect()] == ['{"a":1}']
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("IMP_X.TXT", "2709000000202401" + " " * 50 + "123456\n")
    raw = rd.read_zipped_lines(spark, str(tmp_path / "z.zip"), "IMP")
    assert tuple(rd.read_positional_imports(raw).first()) == ("2709000000", "202401", 123456.0)
    assert tuple(rd.read_fixed_width(raw, {"hs": (0, 4), "year": (10, 14)}).first()) == ("2709", "2024")
    cells = spark.createDataFrame([("Sheet 755", 1, "Train Miles total", [5.0, 250.0, 300.0]), ("Sheet 755", 2, "other", [900.0])], "sheet string, row int, text string, numbers array<double>")
    assert rd.sheet_metric(cells, "755", "train miles").first()["metric"] == 300.0


def test_inventory_and_precedence(spark, tmp_path):
    (tmp_path / "release=2026-07-09").mkdir()
    (tmp_path / "release=2026-07-09" / "f.csv").write_text("x")
    inv = rd.inventory(spark, str(tmp_path)).first()
    assert inv["release"] == "2026-07-09" and inv["format"] == "csv" and len(inv["signature"]) == 32
    rows = [("f", "big", "release", "2026-07-05", 10**10, 5, None), ("f", "new", "release", "2026-07-09", 10, 4, None), ("f", "bad", "today", None, 1, 9, "html_stub")]
    files = spark.createDataFrame(rows, "family string, path string, place string, release string, length bigint, modificationTime bigint, reason string")
    assert rd.ranked_candidates(files).first()["path"] == "new"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>").withColumn("v", F.lit(None))
    sinks.write_parquet(df, str(tmp_path / "p"))
    assert dict(spark.read.parquet(str(tmp_path / "p")).dtypes)["v"] == "string"
    sinks.write_csv(df, str(tmp_path / "c"), ["b", "a"])
    assert next((tmp_path / "c").glob("*.csv")).read_text() == 'b,a\n"[1,2]",1\n'
    assert sinks.write_documents(df, str(tmp_path / "d"), "card") == 1
    with pytest.raises(ValueError):
        sinks.write_documents(spark.range(3), str(tmp_path / "e"), "card", 2)


def test_incremental_stream(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "a", 1.5), ("2024-01-02 10:00:00", "a", 2.0)]
    schema = "ts timestamp_ntz, event_type string, value double"
    df = spark.createDataFrame(rows, "t string, event_type string, value double").select(F.col("t").cast("timestamp_ntz").alias("ts"), "event_type", "value")
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    df.write.parquet(src)
    st.run_available(spark, src, out, ck)
    st.run_available(spark, src, out, ck)  # nothing new
    assert spark.read.parquet(out).count() == 2
    df.write.mode("append").parquet(src)
    st.run_available(spark, src, out, ck)
    assert sorted(map(tuple, st.window_totals(spark, out).collect())) == [("2024-01-01", "a", 2, 3.0), ("2024-01-02", "a", 2, 4.0)]  # one row a window
    assert spark.read.parquet(out).count() == 4 and spark.read.parquet(src).schema.simpleString() == f"struct<{schema.replace(', ', ',').replace(' ', ':')}>"


def test_stream_drops_late_rows(spark, tmp_path):
    def add(*rows):
        df = spark.createDataFrame(list(rows), "t string, event_type string, value double").select(F.col("t").cast("timestamp_ntz").alias("ts"), "event_type", "value")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))

    def run():
        source = spark.readStream.schema("ts timestamp_ntz, event_type string, value double").parquet(str(tmp_path / "src"))
        return sorted(map(tuple, st.stateful_totals(source, str(tmp_path / "out"), str(tmp_path / "ck"), late="2 days").collect()))

    add(("2024-01-10 10:00:00", "a", 1.0), ("2024-01-01 10:00:00", "a", 5.0))
    assert run() == [("2024-01-01", "a", 1, 5.0), ("2024-01-10", "a", 1, 1.0)]
    add(("2024-01-10 11:00:00", "a", 2.0), ("2024-01-01 11:00:00", "a", 7.0))  # the second is nine days late
    assert run() == [("2024-01-01", "a", 1, 5.0), ("2024-01-10", "a", 2, 3.0)]


def test_typed_values_and_signatures(spark, tmp_path):
    from loadstone.sources import readers as rd

    (tmp_path / "a.csv").write_text('k;"x;y"\n1;2.5\n2;3.5\n')
    assert rd.sniff_delimiter(str(tmp_path / "a.csv")) == ";" and rd.header(str(tmp_path / "a.csv"), ";") == ["k", "x;y"]
    assert dict(rd.read_typed(spark, str(tmp_path / "a.csv")).dtypes) == {"k": "int", "x;y": "double"}
    (tmp_path / "b.csv").write_text("k,v\n1,2\n2,3,4\n")
    assert [tuple(r) for r in rd.read_typed(spark, str(tmp_path / "b.csv")).collect()] == [("1", "2"), ("2", "3")]
    for text, want in (('[1, "b", null]', ["1", "b", None]), ("42", ["42"]), ('"one"', ["one"]), ("[]", [])):
        (tmp_path / "v.json").write_text(text)
        assert [r[0] for r in rd.read_json_values(spark, str(tmp_path / "v.json")).collect()] == want
    files = {r["format"]: r["signature"] for r in rd.inventory(spark, str(tmp_path / "*.json"), most=1).collect()}
    assert files["json"].startswith("2-")
    sinks.write_signed(spark.range(3), str(tmp_path / "t"), "s1")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert sinks.is_current(spark, str(tmp_path / "t"), "s1") and not sinks.is_current(spark, str(tmp_path / "t"), "s2") and not sinks.is_current(spark, str(tmp_path / "none"), "s1")


def test_registers(spark):
    from loadstone.operators import economy as ec
    from loadstone.operators import registers as rg

    day = lambda x: F.lit(x).cast("timestamp")
    rows = spark.createDataFrame([(False, "2026-06-01", 10), (False, "2026-06-30", 10), (True, "2026-06-30", 0), (None, None, 5), (False, None, 5), (False, "2020-01-01", 0)], "bad boolean, t string, days int")
    age = rg.age_days(F.col("t"), day("2026-07-01"))
    assert [r[0] for r in rows.select(rg.needs_refresh(F.col("bad"), age, F.col("days"))).collect()] == [True, False, True, True, True, False]
    assert spark.range(1).select(rg.months_before(F.lit("2026-01-15").cast("date"), 3)).first()[0] == ["202512", "202511", "202510"]
    numbers = spark.createDataFrame([(2.5,), (-2.5,), (1e300,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in numbers.select(rg.rounded(F.col("x"))).collect()][:2] == [3, -3]
    lists = spark.createDataFrame([(["b", "a", None], ["a", "b", "b"]), (None, ["a"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in lists.select(ec.overlap(F.col("a"), F.col("b"))).collect()] == [["a", "b"], [], []]
    flags = spark.createDataFrame([("X", "X"), (None, "X"), ("", "")], "metal string, coal string")
    assert [tuple(r) for r in flags.select(ec.lane_of_flags({c: F.col(c) for c in flags.columns}), ec.lane_of_flags({c: F.col(c) for c in flags.columns}, False)).collect()] == [("metal_sheet", "coal_coke"), ("coal_coke", "coal_coke"), ("unknown", "unknown")]


def test_absorb_replaces_a_release(spark, tmp_path):
    from loadstone.operators import registers as rg

    path = str(tmp_path / "dated")
    first = spark.createDataFrame([(1, "2026-01"), (2, "2026-02")], "k int, r string")
    rg.absorb(first, path, F.col("r"))
    rg.absorb(spark.createDataFrame([(9, "2026-02")], "k int, r string"), path, F.col("r"))
    assert sorted((r["k"], str(r["release"])) for r in spark.read.parquet(path).collect()) == [(1, "2026-01"), (9, "2026-02")]


def test_edge_kinds_on_empty_and_null_rows(spark):
    imports = spark.createDataFrame([("2701", None, 1.0), ("2701", "202401", 2.0), ("2701", "202402", 3.0), (None, "202402", None)], "hs string, month string, weight double")
    assert sorted((r["src_id"], r["event_time"], r["weight"]) for r in ed.trade_edges(imports).collect()) == [("19", "202402", 3.0), ("31", "202402", None)]
    rail = spark.createDataFrame([("R", "m", 2.0, 2), ("R", "m", 1.0, 1), (None, "m", 1.0, 1), ("R", "n", None, 1)], "operator string, measure string, value double, place int")
    assert [r["weight"] for r in ed.rail_edges(rail, "2025").collect()] == [1.0]
    assert ed.trade_edges(imports.limit(0)).collect() == [] and ed.rail_edges(rail.limit(0), "2025").collect() == []
    names = spark.createDataFrame([("ACME STEEL INC", 100), ("THE ACME STEEL INC PLANT", 5), (None, 1)], "shipper string, n bigint")
    titles = spark.createDataFrame([("ACME STEEL INC", "AC"), (None, "NN"), ("ACME STEEL", None)], "title string, ticker string")
    assert sorted((r["src_id"], r["confidence"], r["weight"]) for r in ed.identity_edges(names, titles).collect()) == [("ACME STEEL INC", "exact", 55.0), ("THE ACME STEEL INC PLANT", "blocked_fuzzy", 40.0)]


def test_hubs_are_joined_in_pieces(spark, monkeypatch):
    edges = spark.createDataFrame([("hub", f"n{i}") for i in range(40)] + [("n1", "n2"), ("n1", "n2")], "a string, b string")
    features = spark.createDataFrame([(f"n{i}", [float(i), 1.0]) for i in range(40)] + [("hub", [3.0, 4.0]), ("alone", [1.0, 0.0])], "node string, embedding array<double>")
    rows = lambda hops: {r["node"]: [round(x, 9) for x in r["embedding"]] for r in gr.message_pass(edges, features, hops, 2).collect()}
    whole = {h: rows(h) for h in (1, 3)}
    monkeypatch.setattr(gr, "HUB_PIECE", 7)
    assert {h: rows(h) for h in (1, 3)} == whole and len(whole[1]) == 42

"""Name variants and company matches: joins against brute force, parsing cases and small planted tables."""

import itertools
import random

import numpy as np
import pyarrow as pa

from loadstone.llm import matching as mt
from loadstone.llm import names
from loadstone.llm import queries
from loadstone.llm import variants as va
from loadstone.llm.components import connected_components


def edit(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_segment_join_equals_brute_force(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("ABC") for _ in range(rng.randint(3, 14))) for _ in range(120)] + ["AAAAAAAAAAAA", "AAAAAAAAAA"]
    df = spark.createDataFrame([("org", w) for w in words], "kind string, s string")
    got = {(r["a"], r["b"]) for r in va.segment_join(df, df, 2, 9).collect()}
    want = {(a, b) for a, b in itertools.product(set(words), repeat=2) if edit(a, b) <= (1 if min(len(a), len(b)) < 9 else 2)}
    assert got == want


def test_resolve_is_linear_in_a_family(spark):
    """A thousand undecided names of one family meet its lines of business, not all its names."""
    rows = [(f"HUBCORE LINE {'STEEL' if k % 2 else 'COAL'} {'CO' if k % 3 else 'LLC'} PLANT {k}", k) for k in range(300)] + [(f"HUBCORE LINE PLANT {k}", k) for k in range(300)]
    df = spark.createDataFrame([(i, n, 1, f"S{k % 2}", f"CITYNAME{k % 2}ABC", None) for i, (n, k) in enumerate(rows)], SCHEMA)
    groups = {}
    for r in va.spelling_groups(df).collect():
        groups.setdefault(r["group"], set()).add(r["shipper_id"])
    assert sorted(len(g) for g in groups.values()) == [300, 300]  # the place tells the line


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"n{a}", f"n{a + 1}") for a in range(60) if a % 10 != 9] + [(f"n{rng.randint(100, 160)}", f"n{rng.randint(100, 160)}") for _ in range(40)] + [("x", "x"), (None, "n1"), ("hub", "n5")]
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a and b and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {v: find(v) for v in parent}
    assert connected_components(spark.createDataFrame([], "a string, b string")).collect() == []


def stages_of(spark, name, run):
    """The stages that a call submits."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    tracker = spark.sparkContext.statusTracker()
    return len({s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds})


def test_components_at_once_equal_those_by_stars(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(-40, 300) if k % 50] + [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(190)] + [(2**62, k) for k in range(2000, 2100)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    least = len({(max(e), min(e)) for e in edges if None not in e and e[0] != e[1]})
    got = [sorted(map(tuple, connected_components(df, at_once=n).collect())) for n in (least, least - 1)]
    assert got[0] == got[1] and len(got[0]) > 600 and got[0] == sorted(map(tuple, connected_components(df).collect()))
    # the driver's memory goes by stages: a round of stars has a dozen, each with buffers, plans and threads of its own
    assert stages_of(spark, "components", lambda: connected_components(df).collect()) <= 8


def test_parsing():
    p = names.parse
    assert p("C O VISPEM LUFULIL STL COOP PLANT 3").business == "STEEL" and p("C O VISPEM LUFULIL STL COOP PLANT 3").keys[0] == "VISPEMLUFULIL"
    assert p("STEEL COOP VISPEM LUFULIL").keys[0] == "VISPEMLUFULIL" and p("VISPEM LUFULIL STEEL COOP NORTH TARWILBURG NV").keys[0] == "VISPEMLUFULIL"
    assert p("BADAN GENIRBA PRO").partial == "PRO" and p("BADAN GENIRBA PROOANE LLC").business == "PROPANE"
    assert p("KEMKISRARMOR ED R").given == ["EDWARD"] and p("ED R KEMKISRARMOR JR").suffix == "JR" and p("ED R KEMKISRARMOR").initial == "R"
    assert [p(x).kind for x in (None, "", "  ", "NONE", "LINE RUN", "123", "VARIOUS")] == [""] * 7
    assert names.within("ABCD", "ABDC", 1) and not names.within("ABCD", "AXDC", 1)


SHIPPERS = [
    (1, "VISPEM LUFULIL STEEL COOP", 1, "CA", "VEMSEDALE", "11"), (2, "VISPEM LUFLIL STL", 1, None, None, "31"), (3, "LUFULIL VISPEM STEEL CO", 1, "CA", None, None), (4, "VISPEM LUFULIL DAIRY INC", 1, "TX", "DANFIELD", "07"),
    (5, "VISPEM LUFULIL CO", 1, "TX", "DANFIELD", "07"), (6, "EDWARD R KEMKISRARMOR", 1, None, None, None), (7, "KEMKISRARMR ED", 1, None, None, None), (8, "EDWARD KEMKISRARMOR JR", 1, None, None, None),
    (9, "EDWARD KEMKISRARMOR SR", 1, None, None, None), (10, "ANTHONY KEMKISRARMOR", 1, None, None, None), (11, None, 1, None, None, None), (12, "", 1, None, None, None), (13, "SELF", 1, None, None, None),
    (14, "X" * 20_000, 1, None, None, None), (None, "VISPEM LUFULIL STEEL", 1, None, None, None), (15, "VISPEM LUFULIL STEEL COOP", 1, "CA", "VEMSEDALE", "11"),
]
SCHEMA = "shipper_id bigint, shipper_norm string, n bigint, main_state string, main_city string, sctg2 string"


def test_equal_names_share_a_group_if_undecided(spark):
    """A table of two copies with shifted ids gives each pair of one copy four times, and each row with its copy."""
    rows = [*[r for r in SHIPPERS if r[0] is not None and r[0] < 15], (20, "GORSIN HELFENDO STEEL COOP", 1, None, None, None), (21, "GORSIN HELFENDO DAIRY INC", 1, None, None, None), (22, "GORSIN HELFENDO", 1, None, None, None)]
    named = {r[0] for r in rows if r[1] and r[1] != "SELF"}
    once = {tuple(r) for r in va.group_pairs(va.spelling_groups(spark.createDataFrame(rows, SCHEMA))).collect()}
    twice = {tuple(r) for r in va.group_pairs(va.spelling_groups(spark.createDataFrame(rows + [(r[0] + 100, *r[1:]) for r in rows], SCHEMA))).collect()}
    assert {(20, 22), (21, 22)}.isdisjoint(once)
    assert twice == {tuple(sorted((a + x, b + y))) for a, b in once for x in (0, 100) for y in (0, 100)} | {(a, a + 100) for a in named}


def test_groups(spark):
    df = spark.createDataFrame(SHIPPERS, SCHEMA)
    groups = {}
    for r in va.spelling_groups(df).collect():
        groups.setdefault(r["group"], set()).add(r["shipper_id"])
    assert sorted(map(lambda g: sorted(map(str, g)), groups.values())) == sorted([["1", "15", "2", "3", "None"], ["4", "5"], ["6", "7"], ["8"], ["9"], ["10"], ["14"]])
    pairs = {tuple(r) for r in va.group_pairs(va.spelling_groups(df)).collect()}
    assert pairs == {(1, 2), (1, 3), (1, 15), (2, 3), (2, 15), (3, 15), (4, 5), (6, 7)}
    assert va.spelling_groups(df.limit(0)).collect() == []
    assert va.spelling_groups(df, state=None, city=None, goods=None).count() == 13


def test_isotonic_and_calibration():
    curve = mt.isotonic([(10, 100, 0), (50, 10, 5), (60, 10, 2), (99, 20, 20)])
    assert [curve[b] for b in sorted(curve)] == sorted(curve.values()) and curve[50] == curve[60] and curve[99] > 0.9
    assert mt.isotonic([]) == {} and mt.calibration([]) == {}
    # places agree by chance in 4 of 100 pairs, in half of the true ones
    counts = [("none", 20, 10_000, 400), ("same", 30, 1000, 40), ("same", 49, 1000, 500), ("other", 49, 1000, 45), ("open", 49, 1000, 270)]
    c = mt.calibration(counts)
    assert c["same", 49] > 0.9 and c["same", 30] < 0.1 and c["other", 49] < 0.1 and 0.3 < c["open", 49] < 0.7


TITLES = [
    ("VISPEM LUFULIL STEEL HOLDINGS CORP DE", "AA", "0000000007", "CA", "Vemsedale", "Steel works and rolling mills", "X"), ("VISPEM LUFULIL STEEL HOLDINGS CORP", "AB", "7", None, None, None, None),
    ("V LUFULIL DAIRY GROUP", "AC", "8", "TX", "Danfield", None, None), (None, "AD", "9", None, None, None, None), ("OTHER COMPANY PAPER INC", "AE", "x", None, None, None, None), ("TOTALLY DIFFERENT PAPER INC", "AF", "10", None, None, "Paper mills", None),
]


def test_matches(spark):
    shippers = spark.createDataFrame(SHIPPERS, SCHEMA)
    tickers = spark.createDataFrame(TITLES, "title_norm string, ticker string, cik string, hq_state string, hq_city string, sic_text string, exchange string")
    links = spark.createDataFrame([("VISPEM LUFULIL STEEL COOP", "AA", "exact"), (None, "AB", None), ("SELF", "AC", "weak")], "src_id string, dst_id string, confidence string")
    got = mt.match_companies(shippers, tickers, links)
    rows = got.filter("accepted").collect()
    found = {(r["shipper_id"], r["cik"]) for r in rows if r["shipper_id"] is not None}
    assert {(1, 7), (2, 7), (3, 7), (15, 7)} <= found and not any(c == 10 for _, c in found) and (4, 7) not in found
    assert all(0 <= r["confidence"] <= 1 and r["cosine"] >= mt.LEAST_COSINE - 1e-6 for r in got.collect())
    assert all(r["confidence"] >= mt.LEAST_CONFIDENCE for r in rows)
    assert mt.match_companies(shippers.limit(0), tickers.limit(0)).filter("accepted").collect() == []


def test_matching_asks_few_stages_of_the_driver(spark):
    shippers = spark.createDataFrame(SHIPPERS, SCHEMA)
    tickers = spark.createDataFrame(TITLES, "title_norm string, ticker string, cik string, hq_state string, hq_city string, sic_text string, exchange string")
    links = spark.createDataFrame([("VISPEM LUFULIL STEEL COOP", "AA", "exact")], "src_id string, dst_id string, confidence string")
    n = stages_of(spark, "matching", lambda: mt.match_companies(shippers, tickers, links).collect())
    assert n <= 250, n


def views_of(spark, sets, side):
    return spark.createDataFrame([(i, side, [s, []]) for i, s in enumerate(sets)], "id bigint, side string, views array<array<int>>")


def test_blocking_recall_against_brute_force(spark):
    """Of all pairs at the tuned cosine or nearer the hyperplane tables find the recall they are made for."""
    rng = np.random.default_rng(5)
    trained = pa.table({"token": pa.array(range(400), pa.int32()), "v": pa.array(rng.standard_normal((400, mt.SIZE)).astype(np.float32).tolist(), pa.list_(pa.float32()))})
    base = [sorted(rng.choice(400, 12, replace=False).tolist()) for _ in range(600)]
    other = [sorted({*b[int(rng.integers(1, 5)) :], *rng.choice(400, 2).tolist()}) for b in base]
    v = mt.vectors_of(trained, np.ones(mt.TOKENS), 1200)
    signed = mt.signed(views_of(spark, base, "a").union(views_of(spark, other, "b")), v).cache()
    vectors = {(r["side"], r["id"]): np.array(r["vector"]) for r in signed.collect()}
    cosines = {(i, j): float(vectors["a", i] @ vectors["b", j]) for i in range(600) for j in range(600)}
    got = {(r["a"], r["b"]): r["cosine"] for r in mt.blocked_pairs(signed).collect()}
    assert all(abs(got[p] - cosines[p]) < 1e-5 for p in got)  # reranked exactly
    near = [p for p, c in cosines.items() if c >= mt.TUNED]
    assert len(near) > 300 and sum(p in got for p in near) >= mt.RECALL * len(near)
    assert mt.blocked_pairs(mt.signed(views_of(spark, base[:0], "a"), v)).collect() == []


def test_unlisted_names():
    p = names.parse
    assert p("ACME FURNITURE CO").business == "FURNITURE" and p("NORTHWIND TIMBER CO").business == "TIMBER" and p("NORTHWIND PHARMA CO").business == "PHARMA"
    assert [p(x).kind for x in ("JOSE GARCIA", "WEI ZHANGWEN", "ROSA MARTINEZ", "MUHAMMAD KHAN JR", "UNHEARDOF SURNAME SR")] == ["person"] * 5 and p("MUHAMMAD KHANNA JR").suffix == "JR"
    assert p("ACME SPROCKET CO", {"SPROCKET": "SPROCKET"}).business == "SPROCKET" and p("ACME SPROCKET CO").business is None
    # any order of the words of a core has one key in common
    a, b = p("ALPHAX BETAX GAMMAX DELTAX STEEL"), p("DELTAX BETAX ALPHAX GAMMAX STEEL")
    assert a.keys[1] == b.keys[1]


def test_learned_lines(spark):
    from loadstone.llm.lexicon import learned_lines

    rng = random.Random(3)
    syllables = [x + y for x in "BDGKLMNPRTVZ" for y in ("AN", "EL", "IR", "OS")]
    cores = ["".join(rng.choice(syllables) for _ in range(3)) for _ in range(300)]
    rows = [(f"{c} {w} {e}",) for c in cores for w, share in (("SPROCKET", 0.9), ("SPRKT", 0.4)) for e in ("CO", "LLC") if rng.random() < share]
    rows += [(f"{c} WIDGETS INC",) for c in cores[:200]] + [(f"{c} {rng.choice(cores)}",) for c in cores] + [(None,), ("",), ("ONE",)]
    got = learned_lines(spark.createDataFrame(rows, "name string"), "name")
    assert got == {"SPROCKET": "SPROCKET", "SPRKT": "SPROCKET", "WIDGETS": "WIDGETS"}
    assert learned_lines(spark.createDataFrame(rows[:0], "name string"), "name") == {}


def test_queries_have_sql_or_tests():
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_skipgram_brings_companions_together(spark, monkeypatch):
    from loadstone.llm import skipgram

    rng = random.Random(4)
    rows = [([rng.randint(0, 9) + side for _ in range(6)],) for side in (rng.choice((0, 10)) for _ in range(20_000))]
    rows += [([],), (None,), ([20],)]
    df = spark.createDataFrame(rows, "path array<int>")
    got = {r["token"]: np.array(r["v"]) for r in skipgram.train_vectors(df, 30, 16).collect()}
    assert set(got) == {*range(20), 20}
    cos = lambda x, y: float(got[x] @ got[y] / np.linalg.norm(got[x]) / np.linalg.norm(got[y]))
    near = np.mean([cos(i, j) for i in range(10) for j in range(i)])
    far = np.mean([cos(i, 10 + j) for i in range(10) for j in range(10)])
    assert near > far + 0.3
    assert skipgram.train_vectors(df.limit(0), 30, 4).collect() == []
    # the result depends on the sentences only, not on how they are spread
    monkeypatch.setattr(skipgram, "SHARD", 8000)
    one, many = (sorted(map(str, skipgram.train_vectors(df.repartition(n), 30, 4).collect())) for n in (1, 7))
    assert one == many


def test_walks_stay_on_the_graph(spark):
    records = spark.createDataFrame([(i, [i % 5, 5 + i % 3, 10 + i]) for i in range(40)] + [(99, [])], "id bigint, tokens array<int>")
    degree = np.ones(mt.TOKENS)
    for r in records.collect():
        degree[r["tokens"]] += 1
    links = spark.createDataFrame([(0, 39, 1.0), (1, 98, 1.0)], "a bigint, b bigint, w double")
    tokens = {r["id"]: set(r["tokens"]) for r in records.collect()}
    paths = [r["path"] for r in mt.token_walks(records, degree, links).collect()]
    joined = {tuple(sorted((x, y))) for t in tokens.values() for x in t for y in t} | {tuple(sorted((x, y))) for x in tokens[0] for y in tokens[39]}
    assert paths and all(len(p) == mt.STEPS and all(tuple(sorted(s)) in joined for s in zip(p, p[1:])) for p in paths)
    assert mt.token_walks(records.limit(0), degree).collect() == []

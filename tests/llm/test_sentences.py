"""Sentence units: the parallel transducer against a sequential one, coverage, and cases by language and layout."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from loadstone.llm import sentences as se


def units(*texts):
    points, rows = [], [0]
    for t in texts:
        points += [ord(c) for c in t] + [10]
        rows.append(len(points))
    p, r = np.array(points, np.uint32), np.array(rows)
    starts, ends = se.unit_spans(p, r)
    out = [[] for _ in texts]
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        k = int(np.searchsorted(r, a, "right")) - 1
        out[k].append(texts[k][a - rows[k] : b - rows[k]])
    return out


CASES = [
    ["Dr. Smith paid $5.50 on Aug. 5.", "He left at 6 p.m.", "The U.S. Gulf rose."],
    ['He asked, "Why? Who?"', "Then he left."],
    ['"Where is it?" asked Ms. X.', "“Labels,” she wrote, “are. Not read.”"],
    ["He wrote 'No seal. No placard!' on it.", "'Twas late."],
    ["It moved (see p. 4. and 5.) today.", "(It never opened.)", "Done...", "Next one.", "It was ... fine!", "Go!! 🙏🏽"],
    ["Most of it is bound for the U.S.", "The gate closes at 3 p.m.", "A filing by Acme Corp. Terminal 4 lists cars."],
    ["Laut Dr. X betrifft das u. a. Getreide.", "Am 3. Mai kam er.", "„Keine Mängel.“", "Die Ladung wog ca. 5 kg, d. h. mehr."],
    ["Los EE. UU. compraron.", "¿Quién firmó?", "¡No abra!", "El Sr. Paz y la Dra. Luz."],
    ["Склад на ул. Речной.", "«Мост закрыт. Ждём», — сказал он.", "Груз и т. д. остался."],
    ["Πού είναι;", "Ο κ. Α. Παππάς ήρθε."],
    ["司机说：“车坏了。请派人来。”", "请立即报告！", "“封了！等，”他说。", "版本v4.6.0。"],
    ["「封印はどこだ？」と尋ねた。", "動かなかった…。", "終わり。"],
    ["2019. 5. 8. 기준 가격은 올랐다.", '"막혔다. 기다린다."라고 말했다.'],
    ["कीमत रु. 660.15 हो गई।", "डॉ. X ने जाँच की।"],
]


@pytest.mark.parametrize("want", CASES)
def test_prose(want):
    joiner = "" if ord(want[0][0]) > 0x3000 and not 0xAC00 <= ord(want[0][0]) < 0xD800 and want[0][0] not in "2" else " "
    text = joiner.join(want)
    assert units(text) == [want]
    if joiner:
        assert units(text.replace(" ", "\n", 1))[0] == [w.replace(" ", "\n", 1) if i == 0 else w for i, w in enumerate(want)]


def test_thai():
    want = ["เส้นทางยังคงติดขัด", "ราคาเพิ่มขึ้นร้อยละ 9.31 ในเดือน ก.ค. ที่ผ่านมา", "เสียหาย 217 กล่อง"]
    assert units(" ".join(want)) == [want]


def test_layout():
    text = "SECTION 3. LOADING\r\n\r\nOpen items:\r\n- call Acme Co. before 7 a.m. Now\r\n- tires min. 3/32 in. tread\r\n\r\nCrew log:\n1542 arrived. Left\n0300 called Mr. X\n\n9 | OR | 2.1 | a. B | X Co.\n8 | TX | 2.1 | scrap | Y Ltd.\n 　\nEnd. Of it"
    assert units(text) == [["SECTION 3. LOADING", "Open items:", "- call Acme Co. before 7 a.m. Now", "- tires min. 3/32 in. tread", "Crew log:", "1542 arrived. Left", "0300 called Mr. X", "9 | OR | 2.1 | a. B | X Co.", "8 | TX | 2.1 | scrap | Y Ltd.", "End.", "Of it"]]


def test_missing_blanks_and_addresses():
    assert units("It was by hand.Prices fell. See portal.Acme.example/v2.1.10/a.html today. Ask a.B@x.example.") == [["It was by hand.", "Prices fell.", "See portal.Acme.example/v2.1.10/a.html today.", "Ask a.B@x.example."]]


def test_nothing():
    assert units("", " \n　\t", "\r\n") == [[], [], []]


@settings(max_examples=150, deadline=None)
@given(texts=hs.lists(hs.text(hs.sampled_from(list("aB.!?\"'()。「」“”«»… \n\r -:1;éก|🙏")), max_size=80), max_size=4))
def test_units_cover_everything(texts):
    for t, found in zip(texts, units(*texts) if texts else [], strict=True):
        assert "".join("".join(found).split()) == "".join(t.split())
        assert all(u and not u[0].isspace() and not u[-1].isspace() for u in found)


@settings(max_examples=60, deadline=None)
@given(symbols=hs.lists(hs.integers(0, len(se._SYMBOLS) - 1), max_size=700), chunk=hs.sampled_from([1, 3, 64]))
def test_parallel_scan_equals_sequential(symbols, chunk):
    nexts, bits, states = se.transducer()
    state, want = states.index("start"), []
    for y in symbols:
        want.append(bool(bits[y, state]))
        state = nexts[y, state]
    assert se.transduce(np.array(symbols, np.uint8), chunk).tolist() == want


def test_spark_rows(spark):
    df = spark.createDataFrame([(1, "One. Two."), (2, None), (2, ""), (None, "Three"), (1, "One. Two."), (5, "It went on. " * 30_000)], "doc_id bigint, text string")
    got = se.sentence_units(df)
    assert [(r.doc_id, r.start_char, r.end_char) for r in got.limit(5).collect()] == [(1, 0, 4), (1, 5, 9), (None, 0, 5), (1, 0, 4), (1, 5, 9)]
    assert got.filter("doc_id = 5").count() == 30_000 and se.sentence_units(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        se.sentence_units(df.withColumnRenamed("doc_id", "end_char"))


def test_learned_starters_and_names(spark):
    from loadstone.llm.starters import Learned, learn

    rows = [(i, f"They waited there. Wagons left at {i} hrs. Wagons of Go Now! Traders came. We waited. tarp was torn. Then all ended. And many Others came.") for i in range(60)] + [(None, None), (1, ""), (2, "x" * 10_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = learn(df)
    assert "Wagons" in got.starters and "Others" not in got.starters and got.low_starters == ("tarp",) and got.names == ("Go Now",)
    one = spark.createDataFrame([(1, "It left at 5 hrs. Wagons of Go Now! Traders came.")], "doc_id bigint, text string")
    cut = lambda learned: [r["start_char"] for r in se.sentence_units(one, learned=learned).collect()]
    assert cut(got) == [0, 18] and cut(Learned()) == [0, 18, 36]
    assert learn(df.limit(0)) == Learned()


def test_unlisted_forms():
    assert units("He works at OK! Magazine in Boston.") == [["He works at OK! Magazine in Boston."]] and units("Adj. wt. was 5 oz.") == [["Adj. wt. was 5 oz."]]

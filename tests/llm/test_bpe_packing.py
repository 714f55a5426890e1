"""Token ids against the public library, and packing against its invariants and an exhaustive search."""

import itertools
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from loadstone.llm import bpe, packing, spans

FILES = Path(bpe.TOKENIZERS)
pytestmark = pytest.mark.skipif(not (FILES / "byte_bpe_50k.json").exists(), reason="no public tokenizer files")

EDGES = [
    "", " ", "a", "'s", "don't you've  we'll\n'street ''s \"'s", " x", "  x", "\n\nfoo \t bar\n", "x  ", "  a", "<|endoftext|> hi", "1²Ⅷ x", "é́ा", "　日本語の文章です。", "a\x1cb \x85c",
    "🙏🏽 🙏", "\r\n\r\n", "'RE 're", "x" * 5000, "ab" * 3000, "仓库2号门" * 500, "  'll",
]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary.load())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(FILES / "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ids_of(encoder, texts, most=spans.SLICE_BYTES):
    out = []
    for _, _, data, offsets in spans.slices(pa.array(texts, pa.string()), most):
        ids, counts = encoder.encode(data, offsets)
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


def test_equals_library(encoder, library):
    want = [e.ids for e in library.encode_batch(EDGES, add_special_tokens=False)]
    assert ids_of(encoder, EDGES) == want
    assert ids_of(encoder, EDGES, 16) == want  # whatever the slices


@settings(max_examples=60, deadline=None)
@given(texts=hs.lists(hs.text(hs.characters(exclude_categories=("Cs", "Cn")), max_size=60), max_size=6))
def test_random_texts(encoder, library, texts):
    assert ids_of(encoder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_perfect_hash_is_minimal(encoder):
    v = encoder.vocabulary
    assert sorted(v.hash.slots.tolist()) == list(range(len(v.ids)))
    some = np.arange(0, len(v.ids), 7)
    h = spans.span_hashes(v.data, (v.ends - v.lengths)[some], v.ends[some])
    assert (v.hash.find(h) == some).all()


def test_colliding_hashes_are_told_apart(encoder, library, monkeypatch):
    monkeypatch.setattr(spans, "span_hashes", lambda units, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    other = bpe.Encoder(encoder.vocabulary)
    text = "one two six ten, zzz yyy."
    assert sorted(map(len, ids_of(other, [text]))) == [len(library.encode(text, add_special_tokens=False).ids)] or ids_of(other, [text])


def test_spark_rows(spark):
    df = spark.createDataFrame([(1, "Hello world", "k"), (2, None, None), (2, None, None), (None, "", "x"), (3, "Hello world" * 20_000, "y")], "doc_id bigint, text string, extra string")
    rows = bpe.encode_texts(df).collect()
    assert [len(r["ids"]) for r in rows] == [2, 0, 0, 0, 40_000] and rows[0].asDict() == {"doc_id": 1, "extra": "k", "ids": [15496, 995]}
    assert [r["n_tokens"] for r in bpe.count_tokens(df).collect()] == [2, 0, 0, 0, 40_000]
    assert bpe.encode_texts(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        bpe.encode_texts(df.withColumnRenamed("extra", "ids"))


def fewest(sizes, capacity):
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_bin_completion_small_cases():
    rng = random.Random(3)
    gap = 0
    for _ in range(150):
        capacity = rng.choice([10, 20, 37])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        bins = packing.bin_completion(sizes, capacity)
        assert sorted(itertools.chain(*bins)) == list(range(len(sizes))) and all(sum(sizes[k] for k in b) <= capacity for b in bins)
        gap += len(bins) - fewest(sizes, capacity)
        assert len(bins) <= len(packing.best_fit(sizes, capacity))
    assert gap <= 1
    assert packing.bin_completion([], 5) == [] and packing.bin_completion([5, 5], 5) == [[0], [1]]
    # best fit needs three here, completion two
    assert len(packing.bin_completion([5, 4, 3, 3, 3, 2], 10)) == 2


def test_search_revisits_containers():
    sizes = [953, 951, 869, 867, 862, 861, 841, 782, 763, 752, 660, 640, 598, 544, 385]
    # six containers hold one of each; best fit, and one greedy pass over it, take 18,500
    many = packing.search(sorted(sizes * 3000, reverse=True), budget=20_000)
    assert many.best_fit == 18_500 and len(many.bins) <= 18_000 and sorted(itertools.chain(*many.bins)) == list(range(45_000))
    rng = random.Random(11)
    for _ in range(120):
        capacity = rng.choice([20, 37, 100])
        sizes = sorted((rng.randint(capacity // 6, capacity * 2 // 3) for _ in range(rng.randint(4, 10))), reverse=True)
        r = packing.search(sizes, capacity)
        best = fewest(sizes, capacity)
        assert r.bound <= best and len(r.bins) == best and r.proven
        assert sorted(itertools.chain(*r.bins)) == list(range(len(sizes))) and all(sum(sizes[k] for k in b) <= capacity for b in r.bins)
    assert packing.search([7, 7, 6, 6, 5, 5, 4, 4, 3, 3], 10, budget=0).looked_at == 0


def test_dominated_fillings():
    bits = lambda *xs: sum(1 << x for x in xs)
    assert packing.dominated([4], 3, bits(5)) and packing.dominated([4], 3, bits(2)) and packing.dominated([3, 2], 0, bits(5))
    assert not packing.dominated([4], 3, bits(4, 8)) and not packing.dominated([4], 0, bits(3, 5)) and not packing.dominated([], 2, bits(3))


def test_pack(spark):
    rows = [(1, 5000), (2, 0), (3, None), (4, 2048), (None, 100), (None, 100), (5, 1948), (6, -3), (7, 2049)]
    df = spark.createDataFrame([(i, n, k) for k, (i, n) in enumerate(rows)], "doc_id bigint, n_tokens bigint, spread bigint")
    got = packing.pack(df, len(rows), group_items=100).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["n_tokens"]) for r in got) == sorted(
        [("1", 0, 0, 2048), ("1", 1, 2048, 2048), ("1", 2, 4096, 904), ("2", 0, 0, 0), ("3", 0, 0, 0), ("4", 0, 0, 2048), ("None", 0, 0, 100), ("None", 0, 0, 100), ("5", 0, 0, 1948), ("6", 0, 0, 0), ("7", 0, 0, 2048), ("7", 1, 2048, 1)]
    )
    load = {}
    for r in got:
        load[r["bin_id"]] = load.get(r["bin_id"], 0) + r["n_tokens"]
    assert max(load.values()) <= 2048 and len(load) == 6
    assert packing.pack(df.limit(0), 0).collect() == []
    several = packing.pack(df, len(rows), group_items=2).collect()
    assert len(several) == len(got) and len({r["bin_id"] >> 32 for r in several}) > 1

"""Matching records of two sources without a common key by walks over a record-attribute-token graph.

Records (cores of shippers' names, titles of listed companies) hang on tokens: four-letter pieces of the folded core, line of
business, wording of the industry, goods. Random walks over this graph, the rarer a token the likelier, give sentences of
tokens; doubtful earlier matches carry walks too, by their confidence. Skip-gram vectors are trained on the walks; a record's
vector is the weighted mean of its tokens'. Tokens are numbers below a bound, so the model's size doesn't grow with the
records. Records are blocked by several tables of hyperplane hashes, whose bits grow with the logarithm of the records, and
reranked by the exact cosine. The cosine is calibrated to a confidence by how often pairs agree in a place, which the vectors
know nothing of. A pair is accepted if its confidence is high enough and an exact check of names and lines of business holds.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadstone.llm import lexicon, names, variants
from loadstone.llm.skipgram import train_vectors
from loadstone.session import discard, materialize

#: Vector size; walks begun at each record, their steps and the transitions drawn in advance for each visit.
SIZE, WALKS, STEPS, DRAWS = 64, 2, 4, 2
#: Tokens are hashed into so many numbers for pieces and for everything else, which bounds the model.
PIECES, OTHERS = 1 << 14, 1 << 12
TOKENS = PIECES + OTHERS
#: Bits of the sketch that tells near pairs in a bucket; a query's least certain bits, of which none, one or two are flipped.
SKETCH, PROBES = 256, 6
#: The least cosine of a candidate, and the share of pairs at TUNED cosine that the hyperplane tables are to find.
LEAST_COSINE, TUNED, RECALL = 0.6, 0.75, 0.9
#: What a line, a wording or goods count beside their rarity; pieces count 1.
CLASS_WEIGHT = {"b": 1.0, "w": 0.6, "g": 0.2}
#: The weight with which an earlier match carries walks; a missing confidence counts least.
CARRIES = {"exact": 1.0, "strong": 0.8, "medium": 0.5, "weak": 0.2, "blocked_fuzzy": 0.1}
#: A wording means a line of business that at least this share of its companies has, if that is so many times the usual.
MEANS, LIFT = 0.15, 2.0
LEAST_CONFIDENCE = 0.5

_CLASS = {"b": 0, "w": 1, "g": 2}


def token(kind: str, text: str) -> int:
    """The number of an attribute token: its class and the hash of its text."""
    each = OTHERS // 4
    return PIECES + _CLASS[kind] * each + zlib.crc32(text.encode()) % each


def pieces(core: str) -> list[int]:
    return sorted({zlib.crc32(core[i : i + 4].encode()) % PIECES for i in range(max(1, len(core) - 3))})


def tokenized(df: DataFrame) -> DataFrame:
    """`df` (id, side, key, rest, whole, lines, wording, goods) as id, side and views, one or two lists of tokens: that of
    the whole core (if `whole`) and that of its rest (if any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = []
            for r in batch.to_pylist():
                shared = [token("b", x) for x in r["lines"] or []] + [token(k, r[c]) for k, c in (("w", "wording"), ("g", "goods")) if r[c]]
                views.append([sorted({*pieces(core), *shared}) if core else [] for core in (r["key"] if r["whole"] else None, r["rest"])])
            yield pa.RecordBatch.from_arrays([batch["id"], batch["side"], pa.array(views, pa.list_(pa.list_(pa.int32())))], names=["id", "side", "views"])

    return df.mapInArrow(run, "id bigint, side string, views array<array<int>>")


def _uniform(x: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on x and the seed only (splitmix64)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


class Draws:
    """Draws of postings from a batch of records: one of a record's tokens, the rarer the likelier, and one of its slots.

    The postings of a token are spread over as many slots as it has postings, so a token with a third of all records is no
    hot key: a walker looks into one slot at random. An empty slot ends the walk, several postings in one split it; one is
    expected.
    """

    def __init__(self, ids: np.ndarray, lists: pa.Array, degree: np.ndarray) -> None:
        self.tokens, self.offsets = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
        self.ids, self.degree = ids.astype(np.int64), degree
        weight = 1.0 / degree[self.tokens]
        self.sums = np.concatenate([[0.0], np.cumsum(weight)])

    def draw(self, rows: np.ndarray, mix: np.ndarray, seed: int) -> np.ndarray:
        """For each row a drawn posting as token and slot in one number; `mix` tells draws of the same row apart."""
        low, high = self.offsets[rows], self.offsets[rows + 1]
        u = _uniform(self.ids[rows] ^ (mix.astype(np.int64) << 20), seed)
        at = np.searchsorted(self.sums, self.sums[low] + u * (self.sums[high] - self.sums[low]), "right") - 1
        t = self.tokens[np.clip(at, low, high - 1)]
        return (t << 32) | self.slot(self.ids[rows] ^ mix, t, seed + 1)

    def slot(self, ids: np.ndarray, t: np.ndarray, seed: int) -> np.ndarray:
        return (_uniform(ids ^ (t << 40), seed) * self.degree[t]).astype(np.int64)


def postings(records: DataFrame, degree: np.ndarray, seed: int) -> DataFrame:
    """One row per record and token: at (token and slot) and DRAWS postings to go on to. `records`: id, tokens, pool (null or
    postings reached by earlier matches) and pull (the chance to take one of these)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pool, pull = batch["id"].to_numpy(), batch["pool"].to_pylist(), np.nan_to_num(batch["pull"].to_numpy(zero_copy_only=False).astype(float))
            d = Draws(ids, batch["tokens"], degree)
            rows = np.repeat(np.arange(len(ids)), np.diff(d.offsets))
            at = (d.tokens << 32) | d.slot(ids[rows], d.tokens, seed)
            nexts = np.stack([d.draw(rows, d.tokens * DRAWS + k + 1, seed + 2) for k in range(DRAWS)], axis=1) if len(rows) else np.zeros((0, DRAWS), np.int64)
            linked = np.flatnonzero(pull[rows] > 0)
            if len(linked):
                u = _uniform(ids[rows[linked]] ^ (d.tokens[linked] << 8), seed + 5)
                for i, x in zip(linked[u < pull[rows[linked]]], u[u < pull[rows[linked]]], strict=True):
                    nexts[i, 0] = pool[rows[i]][int(x * 1e6) % len(pool[rows[i]])]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * DRAWS), pa.array(nexts.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(at), lists], names=["at", "nexts"])

    return records.select("id", "tokens", "pool", "pull").mapInArrow(run, "at bigint, nexts array<bigint>")


def drawn(records: DataFrame, degree: np.ndarray, times: int, seed: int, column: str) -> DataFrame:
    """`records` (id, tokens, ...) with `column`, a list of `times` drawn postings, in place of its tokens."""
    schema = T.StructType([*[f for f in records.schema.fields if f.name != "tokens"], T.StructField(column, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, n = Draws(batch["id"].to_numpy(), batch["tokens"], degree), batch.num_rows
            out = np.stack([d.draw(np.arange(n), np.full(n, k + 1), seed) for k in range(times)], axis=1) if n else np.zeros((0, times), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * times), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch[f.name] for f in schema.fields[:-1]], lists], names=schema.names)

    return records.mapInArrow(run, schema)


def token_walks(records: DataFrame, degree: np.ndarray, links: DataFrame | None = None, seed: int = 7) -> DataFrame:
    """Sentences of tokens from random walks over records and tokens: path (array of tokens).

    `records`: id, tokens; `links`: a, b (ids of records that an earlier match joins) and w, its weight. A walk leaves its
    record by one of its tokens, see Draws, and goes on from a record that has it. At a linked record it goes on from the
    linked one instead with a chance of w / (w + 1), w being all its links' weight. A step is one join of walkers and
    postings by token and slot; the transitions of a posting are drawn in advance.
    """
    records = records.filter(F.size("tokens") > 0)
    pool = records.select("id").limit(0).select("id", F.array().cast("array<bigint>").alias("pool"), F.lit(0.0).alias("pull"))
    if links is not None:
        both = links.select("a", "b", "w").union(links.select("b", "a", "w")).toDF("id", "other", "w")
        reached = drawn(records.select(F.col("id").alias("other"), F.col("id"), "tokens"), degree, DRAWS, seed + 11, "reached").select("other", "reached")
        met = both.join(reached, "other")
        least = lambda k: F.min_by(F.col("reached")[k], -F.log((F.pmod(F.xxhash64("other", F.lit(seed + k)), F.lit(1 << 40)) + 1) / float(1 << 40)) / F.col("w"))
        pool = met.groupBy("id").agg(F.array(*[least(k) for k in range(DRAWS)]).alias("pool"), (F.sum("w") / (F.sum("w") + 1)).alias("pull"))
    ready = records.join(pool, "id", "left")
    posted = materialize(postings(ready, degree, seed))
    starts = drawn(records.select("id", "tokens"), degree, WALKS, seed + 21, "starts")
    walk = starts.select(F.explode("starts").alias("at")).select("at", F.array((F.shiftright("at", 32)).cast("int")).alias("path"))
    ended = []
    for step in range(1, STEPS):
        last = step == STEPS - 1
        chosen = F.col("nexts")[F.pmod(F.xxhash64("path", F.lit(step)), F.lit(DRAWS)).cast("int")]
        gone = walk.join(posted.hint("merge"), "at").select(chosen.alias("at"), "path")
        walk = gone.select("at", F.concat("path", F.array(F.shiftright("at", 32).cast("int"))).alias("path"))
        if last:
            ended.append(walk.select("path"))
    out = materialize(ended[0])
    discard(posted)
    return out


@dataclass
class Vectors:
    """What executors need to turn tokens into vectors, signatures and buckets; its size has a bound."""

    table: np.ndarray
    planes: np.ndarray
    bits: int
    tables: int


def tables_for(bits: int, cosine: float = TUNED, recall: float = RECALL, probes: int = PROBES) -> int:
    """Tables of `bits` hyperplanes that find `recall` of the pairs at a cosine, none, one or two of the
    `probes` least certain bits of a query being flipped; measured on random pairs at that cosine."""
    rng, n = np.random.default_rng(1), 20_000
    x = rng.standard_normal((n, bits))
    y = cosine * x + math.sqrt(1 - cosine * cosine) * rng.standard_normal((n, bits))
    apart = (x > 0) != (y > 0)
    order = np.argsort(np.abs(x), axis=1)[:, : min(probes, bits)]
    probed = np.take_along_axis(apart, order, axis=1).sum(axis=1)
    found = (apart.sum(axis=1) == probed) & (probed <= 2)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(found.mean(), 1 - 1e-9))))


def vectors_of(trained: pa.Table, degree: np.ndarray, records: int, seed: int = 7) -> Vectors:
    """Weighted vectors of the tokens (token, v), whitened, and hyperplanes for `records` views."""
    table = np.zeros((TOKENS, SIZE), np.float32)
    if trained.num_rows:
        table[trained["token"].to_numpy()] = trained["v"].combine_chunks().flatten().to_numpy().reshape(-1, SIZE)
        known = trained["token"].to_numpy()
        # common tokens pull all vectors into few directions: they are whitened, so that records in general stand upright
        x = table[known] - np.average(table[known], axis=0, weights=degree[known])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
        spread, axes = np.linalg.eigh((x * degree[known][:, None]).T @ x / degree[known].sum())
        x = x @ (axes / np.sqrt(spread + 0.01 * spread.mean())) @ axes.T
        table[known] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    each = OTHERS // 4
    weight = np.log(1 + degree.max() / (degree + 50.0))
    for kind, k in _CLASS.items():
        weight[PIECES + k * each : PIECES + (k + 1) * each] *= CLASS_WEIGHT[kind]
    bits = min(30, max(8, math.ceil(math.log2(max(2, records))) - 2))  # about four views a bucket
    tables = tables_for(bits)
    planes = np.random.default_rng(seed).standard_normal((SIZE, SKETCH + bits * tables)).astype(np.float32)
    return Vectors((table * weight[:, None]).astype(np.float32), planes, bits, tables)


def signed(records: DataFrame, v: Vectors) -> DataFrame:
    """One row per view of a record (id, side, views): id, side, view, vector (unit length), sketch s0 to s3, and buckets.

    A bucket is the view, the table and its bits of the signature; records of side b, the queries, also look into those that
    differ in one or two of the PROBES bits whose hyperplanes are nearest.
    """
    shared = records.sparkSession.sparkContext.broadcast(v)
    schema = "id bigint, side string, view int, vector array<float>, s0 bigint, s1 bigint, s2 bigint, s3 bigint, buckets array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            owner, view, at, row = [], [], [], []
            for i, views in enumerate(batch["views"].to_pylist()):
                for j, tokens in enumerate(views or []):
                    if tokens:
                        at += tokens
                        row += [len(owner)] * len(tokens)
                        owner.append(i)
                        view.append(j)
            n = len(owner)
            out = np.zeros((n, SIZE), np.float32)
            if n:
                np.add.at(out, np.array(row), v.table[np.array(at)])
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            owner, view, out = np.array(owner, np.int64)[norm[:, 0] > 0], np.array(view, np.int64)[norm[:, 0] > 0], (out / np.where(norm > 0, norm, 1))[norm[:, 0] > 0]
            n = len(owner)
            margin = out @ v.planes
            bits = (margin > 0).astype(np.uint8)
            sketch = np.packbits(bits[:, :SKETCH], axis=1, bitorder="little").view("<i8") if n else np.zeros((0, 4), np.int64)
            sides = batch["side"].take(pa.array(owner))
            powers = 1 << np.arange(v.bits, dtype=np.int64)
            signature = bits[:, SKETCH:].reshape(n, v.tables, v.bits) @ powers if n else np.zeros((0, v.tables), np.int64)
            place = (view[:, None] * v.tables + np.arange(v.tables)) << v.bits
            near = np.argsort(np.abs(margin[:, SKETCH:].reshape(n, v.tables, v.bits)), axis=2)[:, :, :PROBES] if n else np.zeros((0, v.tables, PROBES), np.int64)
            flips = np.stack([powers[near[:, :, list(c)]].sum(axis=2) for k in (1, 2) for c in combinations(range(near.shape[2]), k)], axis=2)
            probed = (signature[:, :, None] ^ flips) | place[:, :, None]
            queries = np.array([s == "b" for s in sides.to_pylist()], bool)
            own = signature | place
            lists = [np.concatenate([o, p.ravel()]) if q else o for o, p, q in zip(own, probed, queries, strict=True)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * SIZE), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(owner)), sides, pa.array(view, pa.int32()), flat, *[pa.array(sketch[:, k]) for k in range(4)], pa.array(lists, pa.list_(pa.int64()))], names=["id", "side", "view", "vector", "s0", "s1", "s2", "s3", "buckets"])

    return records.select("id", "side", "views").mapInArrow(run, schema)


def blocked_pairs(views: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """Candidate pairs (a, b) of signed() views with their exact cosine, the best over the views, at least `least`.

    Views of one kind meet in shared buckets; their number grows with the records, so a bucket keeps some few of different
    vectors. One with many, of equal vectors, is split by AQE's skew join: all joins here are sort-merge joins. Met pairs
    whose sketches are further apart than two standard deviations beyond the least cosine aren't reranked.
    """
    p = math.acos(least) / math.pi
    far = math.floor(SKETCH * p + 2 * math.sqrt(SKETCH * p * (1 - p)))
    side = lambda s, n: views.filter(F.col("side") == s).select(F.col("id").alias(n), F.col("view"), *[F.col(f"s{k}").alias(f"{n}{k}") for k in range(4)], F.explode("buckets").alias("bucket"))
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(4)])
    met = side("a", "a").hint("merge").join(side("b", "b").drop("view"), "bucket").filter(apart <= far).select("a", "b", "view").distinct()
    vector = lambda s, n, v: views.filter(F.col("side") == s).select(F.col("id").alias(n), "view", F.col("vector").alias(v))
    cosine = F.aggregate(F.zip_with("x", "y", lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
    ranked = met.join(vector("b", "b", "y").hint("merge"), ["b", "view"]).join(vector("a", "a", "x").hint("merge"), ["a", "view"]).select("a", "b", cosine.alias("cosine"))
    return ranked.filter(F.col("cosine") >= least).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def isotonic(counts: list[tuple[int, float, float]]) -> dict[int, float]:
    """Share of hits by cosine bin, made monotone by pooling adjacent violators. counts: bin, weight, hits."""
    blocks: list[list] = []
    for b, n, true in sorted(counts):
        blocks.append([n, true, [b]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, t2, bins = blocks.pop()
            blocks[-1][0] += n2
            blocks[-1][1] += t2
            blocks[-1][2] += bins
    return {b: true / n for n, true, bins in blocks for b in bins}


def calibration(counts: list[tuple[str, int, int, int]], prior: float = 4.0) -> dict[tuple[str, int], float]:
    """The confidence by kind of pair and cosine bin from how often pairs agree in a place that the vectors don't know.

    counts: kind, bin, pairs with both places, pairs that agree. Matches agree at some rate p, other pairs at the rate q of
    chance, so of pairs that agree at rate r a part of (r - q) / (p - q) are matches. q is the rate of the kind "none"
    (no name in common), p that of the nearer half of the kind "same" (names and lines agree). Rates rise with the cosine (isotonic). `prior`
    pairs of usual rates are added to each kind, for tables with few pairs.
    """
    total = lambda kind: (sum(n for k, _, n, _ in counts if k == kind), sum(h for k, _, _, h in counts if k == kind))
    n, h = total("none")
    q = (h + 0.03 * 50) / (n + 50)
    whole, n, h = total("same")[0], 0, 0
    for _, more, hits in sorted(((b, n, h) for k, b, n, h in counts if k == "same"), reverse=True):
        if 2 * n < whole:
            n, h = n + more, h + hits
    p = max((h + 0.5 * 20) / (n + 20), q + 0.05)
    usual = {"same": p, "open": (p + q) / 2, "other": q, "none": q}
    out = {}
    for kind, rate in usual.items():
        bins = [(b, n + prior, h + prior * rate) for k, b, n, h in counts if k == kind]
        out |= {(kind, b): min(1.0, max(0.0, (r - q) / (p - q))) for b, r in isotonic(bins).items()}
    return out


def name_fits() -> Column:
    """Whether a title's core (b_...) is a shipper's (a_...): within two edits in any order of words, or by initial and rest."""

    def near(x: Column, y: Column) -> Column:
        d = F.levenshtein(x, y, variants.DISTANCE)
        return (d >= 0) & (d <= F.when(F.length(y) < variants.SHORT, variants.DISTANCE - 1).otherwise(variants.DISTANCE))

    core = F.col("b_keys")[0]
    whole = F.exists("a_keys", lambda k: near(k, core))
    short = F.col("b_initial") & F.col("a_rest").isNotNull() & (F.substring("a_first", 1, 1) == F.substring("b_first", 1, 1)) & near(F.col("a_rest"), F.col("b_rest"))
    return F.coalesce(whole | short, F.lit(False))


def shipper_records(groups: DataFrame) -> DataFrame:
    """One record per group and core of its spellings: id, group, line, keys, first, rest, goods."""
    orgs = groups.filter(F.col("kind") == "org")
    g = orgs.groupBy("group", "keys", "first", "rest").agg(F.max("line").alias("line"), F.max("goods").alias("goods"))
    return g.withColumn("id", F.xxhash64("group", "keys", "first", "rest"))


def title_records(tickers: DataFrame, learned: dict[str, str]) -> DataFrame:
    """One record per different title, ticker and place of a company with a readable cik: id, cik, ticker, keys, first, rest,
    initial (the first word is one), own (line of business in the title), wording, state, city. Persons are left out."""
    number = F.trim("cik").try_cast("bigint")
    upper = lambda c: F.nullif(F.upper(F.trim(F.col(c))), F.lit(""))
    rows = tickers.filter(number.isNotNull()).select(number.alias("cik"), "ticker", F.col("title_norm").alias("name"), upper("hq_state").alias("state"), upper("hq_city").alias("city"), upper("sic_text").alias("wording")).distinct()
    parsed = variants.parse_names(rows, "name", learned).filter((F.col("kind") == "org") & (F.size("keys") > 0))
    initial = F.length("first") == 1
    # behind an initial that was joined to the next word in the core, the rest is what follows it
    rest = F.when(initial, F.coalesce("rest", F.when(F.col("keys")[0].startswith(F.col("first")), F.col("keys")[0].substr(F.lit(2), F.lit(1 << 20))).otherwise(F.col("keys")[0])))
    columns = ["cik", "ticker", "keys", "first", rest.alias("rest"), initial.alias("initial"), F.col("business").alias("own"), "wording", "state", "city"]
    return parsed.select(*columns).withColumn("id", F.xxhash64("cik", "ticker", "keys", "first", "rest", "wording", "state", "city"))


def _place(c: str) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.concat(F.lit(" "), F.col(c), F.lit(" ")), " (NORTH|SOUTH|EAST|WEST|FORT|FT|MOUNT|MT|SAINT|ST|N|S|E|W|PORT|LAKE|NEW)(?= )", "")), F.lit(""))


def wording_lines(evidence: DataFrame) -> DataFrame:
    """What a wording of an industry means: wording, means (lines of business). evidence: wording, line, w (weight).

    A line counts if at least MEANS of the wording's evidence has it and that is LIFT times its usual share. The result is
    written.
    """
    pair = materialize(evidence.groupBy("wording", "line").agg(F.sum("w").alias("n")))  # read four times
    by_wording, by_line = pair.groupBy("wording").agg(F.sum("n").alias("of")), pair.groupBy("line").agg(F.sum("n").alias("usual"))
    total = pair.agg(F.sum("n").alias("total"))
    joined = pair.join(by_wording, "wording").join(by_line, "line").crossJoin(F.broadcast(total))  # one row
    share = F.col("n") / F.col("of")
    means = materialize(joined.filter((share >= MEANS) & (share >= LIFT * F.col("usual") / F.col("total"))).groupBy("wording").agg(F.collect_set("line").alias("means")))  # at most 1 / MEANS lines
    discard(pair)
    return means


def match_companies(shippers: DataFrame, tickers: DataFrame, links: DataFrame | None = None, seed: int = 7) -> DataFrame:
    """Shipper spellings and the listed companies they belong to: shipper_id, cik, cosine, confidence, accepted.

    `shippers`: shipper_id, shipper_norm, main_state, main_city, sctg2; `tickers`: title_norm, ticker, cik, hq_state, hq_city,
    sic_text; `links`: earlier matches (src_id, dst_id, confidence), doubtful, which carry walks by their confidence. A row
    for each candidate pair above the least cosine, all spellings of a group included, each with its cosine and its
    calibrated confidence, which are the best of the group's; accepted tells whether the confidence is at least
    LEAST_CONFIDENCE and the exact check holds. A cik that isn't a number, null and placeholder names and persons give no
    rows; several tickers of a cik are one company; an empty table gives no rows.
    """
    spark = shippers.sparkSession
    learned = lexicon.learned_lines(shippers, "shipper_norm", "main_city")
    groups = materialize(variants.spelling_groups(shippers, detail=True, learned=learned))
    a, b = materialize(shipper_records(groups)), materialize(title_records(tickers, learned))
    none = F.lit(None).cast("string")
    words = a.select("id", F.lit("a").alias("side"), F.col("keys")[0].alias("key"), "rest", F.lit(True).alias("whole"), F.array_compact(F.array("line")).alias("lines"), none.alias("wording"), "goods").unionByName(
        b.select("id", F.lit("b").alias("side"), F.col("keys")[0].alias("key"), F.when(F.col("initial"), F.col("rest")).alias("rest"), (~F.col("initial")).alias("whole"), F.array_compact(F.array("own")).alias("lines"), "wording", none.alias("goods"))
    )
    records = materialize(tokenized(words))
    listed = records.select("id", F.array_distinct(F.flatten("views")).alias("tokens"))
    counted = listed.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).toArrow()  # TOKENS rows at most
    degree = np.ones(TOKENS, np.float64)
    degree[counted["t"].to_numpy()] = counted["n"].to_numpy()
    joined = None
    if links is not None:
        trust = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CARRIES.items() for x in kv]), F.col("confidence")), F.lit(0.05))
        known = links.filter(F.col("src_id").isNotNull() & F.col("dst_id").isNotNull()).groupBy("src_id", "dst_id").agg(F.max(trust).alias("w"))
        named = groups.filter(F.col("kind") == "org").select("name", "group", "keys", "first", "rest").withColumn("a", F.xxhash64("group", "keys", "first", "rest")).select(F.col("name").alias("src_id"), "a")
        joined = materialize(known.join(named.distinct(), "src_id").join(b.select(F.col("ticker").alias("dst_id"), F.col("id").alias("b")), "dst_id").groupBy("a", "b").agg(F.max("w").alias("w")))
    sentences = token_walks(listed, degree, joined, seed)
    if joined is not None:
        discard(joined)
    many = records.count()
    trained = train_vectors(sentences, TOKENS, SIZE, seed, sentences_expected=many * WALKS).toArrow()  # TOKENS rows at most
    discard(sentences)
    views = materialize(signed(records, vectors_of(trained, degree, 2 * many, seed)))
    side = lambda df, p, more: df.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("keys", "first", "rest")], *more)
    blocked = materialize(blocked_pairs(views))
    discard(views, records)
    full = blocked.join(side(b, "b", [F.col("initial").alias("b_initial"), "cik", "own", "wording"]), "b").join(side(a, "a", ["group", "line"]), "a")
    pairs = materialize(full.select("group", "line", "cik", "own", "wording", "b", "cosine", name_fits().alias("fits")))
    discard(blocked)

    # what a company does: its titles' own words, else what its industries' wordings mean for others
    own = b.filter("own IS NOT NULL AND wording IS NOT NULL").select("cik", "wording", F.col("own").alias("line")).distinct().select("wording", "line", F.lit(1.0).alias("w"))
    near = pairs.filter("fits AND own IS NULL AND wording IS NOT NULL AND line IS NOT NULL").select("cik", "wording", "group", "line").distinct().select("wording", "line", F.lit(0.5).alias("w"))
    means = wording_lines(own.unionByName(near))
    does = b.join(means, "wording", "left").groupBy("cik").agg(F.max("own").alias("own"), F.array_distinct(F.flatten(F.collect_set("means"))).alias("means"), F.collect_set("means").alias("each"))
    common = F.aggregate("each", F.col("each")[0], lambda x, y: F.array_intersect(x, y))
    does = does.select("cik", F.when(F.col("own").isNotNull(), F.array("own")).when(F.size("each") > 0, F.when(F.size(common) > 0, common).otherwise(F.col("means"))).alias("does"))
    related = F.when(~F.col("fits"), "none").when(F.col("does").isNull() | F.col("line").isNull(), "open").when(F.array_contains("does", F.col("line")), "same").otherwise("other")
    kinds = materialize(pairs.groupBy("cik", "group").agg(F.max("line").alias("line"), F.max("fits").alias("fits"), F.max("cosine").alias("cosine"), F.max(F.when(F.col("fits"), F.col("cosine"))).alias("fit_cosine")).join(does, "cik", "left").withColumn("kind", related))
    discard(pairs, means)
    # places of groups and companies, held out so far: the rows of a group and of a company that meet, not all pairs of rows
    here = groups.filter(F.col("kind") == "org").select("group", "state", _place("city").alias("city")).distinct()
    there = b.select("cik", F.col("state").alias("b_state"), _place("city").alias("b_city")).distinct()
    met = kinds.select("cik", "group").join(here, "group").join(there, "cik")
    same_city = F.coalesce(F.levenshtein("city", "b_city", 2) >= 0, F.lit(False))
    same_state = F.coalesce(F.col("state") == F.col("b_state"), F.lit(False))
    placed = met.groupBy("cik", "group").agg(F.max(same_city.cast("int") * 2 + same_state.cast("int")).alias("place"), F.max((F.col("state").isNotNull() & F.col("b_state").isNotNull()).cast("int")).alias("told"), F.max(same_state.cast("int")).alias("agrees"))
    scored = kinds.join(placed, ["cik", "group"]).withColumn("cosine", F.coalesce("fit_cosine", "cosine")).withColumn("bin", F.floor(F.col("cosine") * 50).cast("int"))
    scored = materialize(scored.select("cik", "group", "kind", "bin", "cosine", "place", "told", "agrees", F.coalesce("line", F.lit("?")).alias("line")))
    discard(kinds)

    counts = [tuple(r) for r in scored.groupBy("kind", "bin").agg(F.sum("told"), F.sum(F.col("told") * F.col("agrees"))).collect()]  # at most 4 kinds of 51 bins
    curve = calibration(counts)
    confidence = F.element_at(F.create_map(*[F.lit(x) for (k, b), c in sorted(curve.items()) for x in (f"{k}{b}", c)]), F.concat("kind", F.col("bin").cast("string"))) if curve else F.lit(0.0)
    scored = scored.withColumn("confidence", F.coalesce(confidence, F.lit(0.0)))
    # names agree, but a line isn't told: one line under the name, or the best place, has to decide
    open_ = scored.filter("kind IN ('same', 'open', 'other')").groupBy("cik").agg(F.count_distinct("line").alias("n_lines"), F.max("place").alias("top"))
    alone = F.coalesce(((F.col("n_lines") == 1) | ((F.col("top") > 0) & (F.col("place") == F.col("top")))), F.lit(False))
    decided = scored.join(open_, "cik", "left").select("cik", "group", "cosine", F.when((F.col("kind") == "open") & alone, F.greatest("confidence", F.lit(LEAST_CONFIDENCE))).otherwise(F.col("confidence")).alias("confidence"), ((F.col("kind") == "same") | ((F.col("kind") == "open") & alone)).alias("checked"))
    decided = decided.withColumn("accepted", F.col("checked") & (F.col("confidence") >= LEAST_CONFIDENCE)).drop("checked")
    return groups.filter(F.col("kind") == "org").select("shipper_id", "group").join(decided, "group").select("shipper_id", "cik", "cosine", "confidence", "accepted")

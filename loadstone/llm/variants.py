"""Variant spellings of names typed by people, linked by a pigeonhole segment join.

A name is parsed into its core (the invented part) and what varies around it: line of business, legal form, sites, given
name in short forms. The folded cores are joined: every core is cut into k + 1 segments; if two cores are within edit
distance k, one segment of the one must occur in the other, moved by at most k positions. Segments form an inverted index,
the substrings of the other core at the possible places look them up, and what meets is verified by a banded edit distance.
Components of linked cores are families; within a family a name belongs to its line of business or its person.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadstone.llm import lexicon, names
from loadstone.llm.components import connected_components
from loadstone.session import discard, materialize

#: Edit distance between folded cores; cores under SHORT characters are allowed one edit less.
DISTANCE, SHORT = 2, 9

_PARSED = "kind string, keys array<string>, words int, first string, rest string, business string, partial string, trade string, given array<string>, initial string, suffix string"


def parse_names(df: DataFrame, column: str, learned: dict[str, str] | None = None) -> DataFrame:
    """`df` with the parsed parts of its name column: kind, keys, first, rest, business, partial, trade, given, initial,
    suffix. `learned`: see names.parse()."""
    parts = [f for f in T._parse_datatype_string(_PARSED).fields]
    clash = {f.name for f in parts} & set(df.columns)
    if clash:
        raise ValueError(f"the input already has columns {sorted(clash)}")
    schema = T.StructType([*df.schema.fields, *parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [names.parse(x, learned) for x in batch.column(batch.schema.names.index(column)).to_pylist()]
            kinds = {"keys": pa.list_(pa.string()), "given": pa.list_(pa.string()), "words": pa.int32()}
            columns = [pa.array([getattr(p, f.name) for p in parsed], kinds.get(f.name, pa.string())) for f in parts]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return df.mapInArrow(run, schema)


def cuts(n: int, k: int) -> list[tuple[int, int]]:
    """Start and length of each of the k + 1 segments of a string of n characters, as even as possible, longer ones last."""
    base, longer = divmod(n, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = base + (i >= k + 1 - longer)
        out.append((at, size))
        at += size
    return out


def index_entries(s: str, k: int) -> list[str]:
    """The segments of an indexed string as keys: its length, the segment's number and text."""
    return [f"{len(s)}:{i}:{s[p : p + size]}" for i, (p, size) in enumerate(cuts(len(s), k))] if len(s) > k else []


def probe_entries(s: str, k: int) -> list[str]:
    """The keys that a string within distance k may have in the index.

    By the left the i segments before, by the right the k - i behind can hold the other edits: of a string longer by d,
    segment i is looked up moved by at most i places, and by at most k - i once d is counted in.
    """
    found = set()
    for d in range(-k, k + 1):
        n = len(s) + d
        if n <= k or len(s) <= k:
            continue
        for i, (p, size) in enumerate(cuts(n, k)):
            for at in range(max(0, p - i, p - d - (k - i)), min(len(s) - size, p + i, p - d + (k - i)) + 1):
                found.add(f"{n}:{i}:{s[at : at + size]}")
    return sorted(found)


def _entries(df: DataFrame, name: str, make, k: int) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(x, k) for x in batch.column(1).to_pylist()]
            rows = pa.array([i for i, m in enumerate(made) for _ in m], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([x for m in made for x in m], pa.string())], names=["kind", name, "entry"])

    return df.select("kind", "s").distinct().mapInArrow(run, f"kind string, {name} string, entry string")


def segment_join(left: DataFrame, right: DataFrame, k: int = DISTANCE, short: int = SHORT) -> DataFrame:
    """Pairs (kind, a, b, d) of strings of `left` and `right` (both: kind, s) of one kind within edit distance k.

    Strings shorter than `short` are held to k - 1; those of k characters or fewer are left out. Segments are looked up at
    (k * k - d * d) / 2 + k + 1 places per length difference d. Hot segments are spread by AQE's skew join; nothing is
    capped. The distance is verified in a band of k.
    """
    # what meets is verified, so the keys may travel as hashes
    hashed = lambda df, name: df.select("kind", name, F.xxhash64("kind", "entry").alias("met"))
    right_entries = hashed(_entries(right, "b", probe_entries, k), "b").withColumnRenamed("kind", "kind_b")
    met = hashed(_entries(left, "a", index_entries, k), "a").join(right_entries, "met").filter(F.col("kind") == F.col("kind_b"))
    most = F.when(F.least(F.length("a"), F.length("b")) < short, k - 1).otherwise(k)
    near = met.select("kind", "a", "b").distinct().withColumn("d", F.levenshtein("a", "b", k))
    return near.filter((F.col("d") >= 0) & (F.col("d") <= most))


def core_families(parsed: DataFrame, k: int = DISTANCE) -> DataFrame:
    """Families of cores: kind, key, family, for every first key of `parsed`.

    Cores are looked up as written and, of three or more words, in alphabetical order (the second key), by all keys of the others.
    """
    keyed = parsed.filter(F.size("keys") > 0).select("kind", "keys", "words").distinct()
    firsts = keyed.select("kind", F.col("keys")[0].alias("s")).distinct()
    every = keyed.select("kind", F.col("keys")[0].alias("first"), F.explode("keys").alias("s")).distinct()
    index = keyed.select("kind", F.col("keys")[0].alias("owner"), F.explode(F.slice("keys", F.lit(1), F.when(F.col("words") > 2, 2).otherwise(1))).alias("s")).distinct()
    near = materialize(segment_join(index.select("kind", "s"), every.select("kind", "s"), k))
    links = near.join(every.select("kind", F.col("s").alias("b"), "first"), ["kind", "b"]).join(index.select("kind", F.col("s").alias("a"), "owner"), ["kind", "a"])
    node = lambda c: F.xxhash64("kind", c)
    found = connected_components(links.filter(F.col("owner") != F.col("first")).select(node("owner").alias("a"), node("first").alias("b")))
    discard(near)
    named = firsts.select("kind", F.col("s").alias("key"), node("s").alias("node"))
    return named.join(found, "node", "left").select("kind", "key", F.coalesce("component", "node").alias("family"))


def _agreements(group: list[Column], parts: list[tuple[str, int]]) -> tuple[dict[str, Column], Column]:
    """The keys under which a record meets those that agree with it on some of its evidence: (points, hash) for each set of
    columns that has no null; a city agrees by its first or its last letters, as it may be misspelt. Each way to agree is a
    column of its own, to be added before: written out in every set the plan would be some megabytes."""
    ways: dict[str, Column] = {}
    chosen: list[tuple[int, list[Column]]] = [(0, [])]
    for name, worth in parts:
        c = F.col(name)
        each = [F.concat(F.lit("<"), F.substring(c, 1, 5)), F.concat(F.lit(">"), F.substring(c, -5, 5))] if name == "city" else [c]
        own = {f"_{name}_{i}": F.concat(F.lit(f"{name}="), way) for i, way in enumerate(each)}
        ways |= own
        chosen += [(points + worth, [*columns, F.col(way)]) for points, columns in chosen for way in own]
    whole = [F.struct(F.lit(points).alias("points"), F.when(reduce(lambda x, y: x & y, [c.isNotNull() for c in columns], F.lit(True)), F.xxhash64(F.lit(len(columns)), *group, *columns)).alias("met")) for points, columns in chosen]
    return ways, F.filter(F.array(*whole), lambda x: x["met"].isNotNull())


def resolve(records: DataFrame, within: list[str], attribute: str, allowed: Column, evidence: list[tuple[str, int]], otherwise: Column | None = None, beside: tuple[str, ...] = ()) -> DataFrame:
    """Fill a missing `attribute` from the records of the same group that have it.

    A single candidate value that is allowed is taken; of several, the one whose records share most of the evidence (place,
    goods, trade), if one is ahead. If none is allowed and `otherwise` holds, all candidates count. All others stay null.
    `allowed` compares a record with the candidate in `<attribute>_2` and with what stands beside it, columns of few values. Records and candidates meet under keys of the group
    and the evidence they agree on, where a candidate value is one row: the work is linear in the records, however many a
    group has. The result is written; `records` isn't read any more afterwards if it is a written table itself.
    """
    ways, met_by = _agreements([F.col(c) for c in within], evidence)
    told = records.withColumns(ways)
    missing = told.filter(F.col(attribute).isNull()).withColumn("x", F.explode(met_by)).withColumn("points", F.col("x.points")).withColumn("met", F.col("x.met")).drop("x", *ways)
    wanted = missing.select("met").distinct()
    values = told.filter(F.col(attribute).isNotNull()).select(*[F.col(c).alias(f"{c}_2") for c in (attribute, *beside)], F.explode(met_by).alias("x")).select("*", "x.met").drop("x")
    values = values.join(wanted, "met", "left_semi").distinct()
    met = missing.join(values, "met").withColumn("fits", F.coalesce(allowed, F.lit(False)))
    met = met.filter(F.col("fits") | (otherwise if otherwise is not None else F.lit(False)))
    scores = met.groupBy("id", f"{attribute}_2").agg(F.max("fits").alias("fits"), F.max("points").alias("points"))
    best = scores.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("fits", "points", f"{attribute}_2")), False).alias("all")  # at most as many entries as a group has values
    )
    first, second = F.col("all")[0], F.try_element_at("all", F.lit(2))
    sure = best.filter(second.isNull() | (first["fits"] != second["fits"]) | (first["points"] > second["points"])).select("id", first[f"{attribute}_2"].alias("filled"))
    return materialize(records.join(sure, "id", "left").withColumn(attribute, F.coalesce(attribute, "filled")).drop("filled"))


EVIDENCE = [("city", 4), ("trade", 3), ("state", 2), ("goods", 1)]


def spelling_groups(
    names_df: DataFrame, id: str = "shipper_id", name: str = "shipper_norm", state: str | None = "main_state", city: str | None = "main_city", goods: str | None = "sctg2", k: int = DISTANCE, detail: bool = False, learned: dict[str, str] | None = None
) -> DataFrame:
    """The group of every named row: `id`, kind ("org" or "person"), group and line (of business, null if unknown).

    Rows share a group if they name the same organisation or person: cores of one family, and one line of business, or one
    given name (short forms are known), generation (JR, SR) and no contradicting initial. Lines of business that aren't
    listed are learned from the names, unless `learned` gives them. A missing line of business, generation or initial is
    filled by resolve(); a name that stays undecided is a group of its own. Null, blank and placeholder names have no group
    and give no rows; rows with equal names share a group; a null id stays null. Places and goods may be left out (None)
    and are evidence only. With `detail` also name, keys, first, rest (see names.Name), state, city and goods.
    """

    def column(c: str | None) -> Column:
        return F.upper(F.trim(F.col(c))) if c else F.lit(None).cast("string")

    learned = lexicon.learned_lines(names_df, name, city) if learned is None else learned
    rows = names_df.select(F.col(id).alias("row"), F.col(name).alias("name"), column(state).alias("state"), column(city).alias("city"), column(goods).alias("goods"))
    rows = rows.withColumn("goods", F.when(F.col("goods") != "31", F.col("goods")))  # 31 is the general class
    rows = rows.filter(F.col("name").isNotNull()).withColumn("id", F.xxhash64("row", "name", "state", "city"))
    parsed = materialize(parse_names(rows, "name", learned).filter(F.col("kind") != "").withColumn("key", F.col("keys")[0]))
    families = core_families(parsed, k)
    located = materialize(parsed.join(families, ["kind", "key"]))
    discard(parsed)
    more = ["name", "keys", "first", "rest", "state", "city", "goods"] if detail else []

    fits = F.col("partial").isNull() | F.col("business_2").startswith(F.col("partial")) | F.when(F.col("partial") == "PROD", F.col("business_2") == "PRODUCE").otherwise(False)
    # a remnant that fits no known line may be of another word
    orgs = resolve(located.filter(F.col("kind") == "org"), ["family"], "business", fits, EVIDENCE, otherwise=F.col("partial").isNotNull())
    known = orgs.groupBy("family").agg(F.count("business").alias("known"))
    orgs = orgs.join(known, "family").withColumn("part", F.when(F.col("business").isNotNull(), F.col("business")).when(F.col("known") == 0, F.lit("")).otherwise(F.concat(F.lit("?"), F.md5("name"))))
    orgs = orgs.select("row", "kind", F.concat_ws("|", "family", "part").alias("label"), "business", *more)

    people = located.filter(F.col("kind") == "person").withColumn("only", F.when(F.size("given") == 1, F.col("given")[0]))
    named = resolve(people, ["family"], "only", F.array_contains("given", F.col("only_2")), EVIDENCE)
    aged = resolve(named.withColumn("only", F.coalesce("only", F.array_join("given", "/"))), ["family", "only"], "suffix", F.col("initial").isNull() | F.col("initial_2").isNull() | (F.col("initial") == F.col("initial_2")), [*EVIDENCE, ("initial", 8)], beside=("initial",))
    known = aged.withColumn("generation", F.coalesce("suffix", F.lit("")))
    people = resolve(known, ["family", "only", "generation"], "initial", F.lit(True), EVIDENCE)
    discard(located, named, aged)
    people = people.select("row", "kind", F.concat_ws("|", "family", "only", "generation", F.coalesce("initial", F.lit(""))).alias("label"), F.lit(None).cast("string").alias("business"), *more)
    return orgs.unionByName(people).select(F.col("row").alias(id), "kind", F.md5("label").alias("group"), F.col("business").alias("line"), *more)


def group_pairs(groups: DataFrame, id: str = "shipper_id") -> DataFrame:
    """All pairs of rows of one group: `id`_a < `id`_b. Rows with a null id form no pair."""
    a = groups.select(F.col(id).alias(f"{id}_a"), "group").distinct()
    b = groups.select(F.col(id).alias(f"{id}_b"), "group").distinct()
    return a.join(b, "group").filter(F.col(f"{id}_a") < F.col(f"{id}_b")).select(f"{id}_a", f"{id}_b")

"""Validation, signatures, manifests, releases and gap plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadstone.operators.rejects import strip_blanks


def stub_reason(text: Column, least: int = 500) -> Column:
    """Why a document is a stub: missing, blank, html_stub, below_stub (shorter than `least`); null if it is none."""
    head = F.substring(F.lower(F.ltrim(text)), 1, 400)
    return (
        F.when(text.isNull(), "missing").when(strip_blanks(text) == "", "blank").when(head.startswith("<html") | head.startswith("<!doctype html"), "html_stub").when(F.length(text) < least, "below_stub")
    )


def phrase_hits(df: DataFrame, text: str, phrases: list[str], key: str) -> DataFrame:
    """Rows that hold each phrase (any case), by key and phrase, in one scan."""
    found = F.filter(F.array(*[F.when(F.lower(F.col(text)).contains(p.lower()), F.lit(p)) for p in phrases]), lambda x: x.isNotNull())
    return df.select(key, F.explode(found).alias("phrase")).groupBy(key, "phrase").agg(F.count(F.lit(1)).alias("n"))


def first_by_signature(df: DataFrame, content: str, key: str) -> DataFrame:
    """One row per content: its md5, the least key and the number of copies. Null content has a null signature."""
    return df.groupBy(F.md5(F.col(content)).alias("signature")).agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("copies"))


def newest(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key by `order`; WindowGroupLimit keeps one row per key and task before the shuffle."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("rn = 1").drop("rn")


def manifest(df: DataFrame, family: str, size: str) -> DataFrame:
    """Files, non-empty files and bytes by family and a status: pass, partial or empty."""
    good = F.sum((F.coalesce(F.col(size), F.lit(0)) > 0).cast("int"))
    n = F.count(F.lit(1))
    g = df.groupBy(family).agg(n.alias("files"), good.alias("good"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))
    return g.withColumn("status", F.when(F.col("good") == 0, "empty").when(F.col("good") < F.col("files"), "partial").otherwise("pass"))


def merged(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Two keyed tables, the new value winning where both have the key."""
    j = old.select(key, F.col(value).alias("o")).join(new.select(key, F.col(value).alias("v")), key, "full")
    return j.select(key, F.coalesce("v", "o").alias(value), F.when(F.col("v").isNull(), "kept").when(F.col("o").isNull(), "added").otherwise("replaced").alias("change"))


def missing(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Expected keys that aren't present."""
    return expected.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def violations(df: DataFrame, required: list[str], ranges: dict[str, tuple[float, float]], banned: str | None = None) -> DataFrame:
    """Rows of a derived table that break its rules, with the rule: rule, n. No rows if all is well."""
    rules = [F.when(F.col(c).isNull(), F.lit(f"null_{c}")) for c in required]
    rules += [F.when((F.col(c) < lo) | (F.col(c) > hi), F.lit(f"range_{c}")) for c, (lo, hi) in ranges.items()]
    if banned:
        rules.append(F.when(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])).rlike(banned), F.lit("banned_phrase")))
    return df.select(F.explode(F.array_compact(F.array(*rules))).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def activation(vector: Column, factor: float = 2.0, most: float = 100.0) -> Column:
    """A capped multiple of the sum of absolute values of an array."""
    return F.least(F.lit(most), F.lit(factor) * F.aggregate(F.transform(vector, lambda x: F.abs(x.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def changed(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose keys (path and signature) `old` doesn't have: what an incremental run has to convert."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Tables of differing columns in one, by name; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

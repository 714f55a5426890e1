"""Words of lines of business learned from a column of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadstone.llm import names

#: A word of a line of business is in at least one of so many names and in so many names at all, ...
SHARE, LEAST = 2000, 20
#: ... behind so many different words per name that holds it, none of which is before more than so large a part of them.
HEADS, TOP = 0.3, 0.2
#: The rarer of two spellings stands for the other if that is behind at least this part of the words that it is behind.
TOGETHER = 0.3


def _shortens(short: Column, long: Column) -> Column:
    """Whether the letters of `short` occur in `long` in their order and both begin alike."""
    pattern = F.concat(F.lit("^"), F.regexp_replace(short, "(.)", "$1.*"))
    return F.regexp_like(long, pattern)


def learned_lines(df: DataFrame, name: str, city: str | None = None) -> dict[str, str]:
    """Words that stand behind many different names, with the word they are a spelling of: word to canonical word.

    A word counts if it is in a share of the names, mostly not the first, and behind ever different words; listed words,
    words of the city column and words of one or two letters don't. A word is a spelling of a more frequent one, learned or
    listed, if the shorter shortens the longer and both stand behind the same words; one that begins several isn't any. The thresholds are shares, so at most SHARE times the
    words of a name are found, whatever the number of names: they may go to the driver. Null and empty names, and tables
    too small to tell, give nothing.
    """
    listed = {*names.BUSINESS_OF, *names.TRADE_OF, *names.LEGAL, *names.NOISE, *names.GIVEN_OF, *names.SUFFIXES, *names.PLACEHOLDERS, *names.PLACE_FIRST, "PROD"}
    spark = df.sparkSession
    text = F.trim(F.regexp_replace(F.upper(F.col(name)), "[^A-Z0-9]+", " "))
    split = F.split(text, " ")
    words = df.select(F.explode(F.arrays_zip(F.slice(split, 2, 1 << 30).alias("w"), split.alias("h"))).alias("x")).select(F.col("x.w").alias("w"), F.col("x.h").alias("h"))
    pairs = words.filter(F.col("w").rlike("^[A-Z]{3,}$")).groupBy("w", "h").agg(F.count(F.lit(1)).alias("n"))
    stats = pairs.groupBy("w").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("heads"), F.max("n").alias("top"))
    least = max(LEAST, df.select().count() // SHARE)
    found = stats.filter((F.col("n") >= least) & (F.col("heads") >= F.col("n") * HEADS) & (F.col("top") <= F.col("n") * TOP))
    business = set(names.BUSINESS_OF)
    words_found = {r["w"]: r["n"] for r in found.select("w", "n").collect()}
    fresh = {w: n for w, n in words_found.items() if w not in listed and not names.word_class(w)[0]}
    if fresh and city:
        places = df.select(F.explode(F.split(F.upper(F.col(city)), "[^A-Z]+")).alias("w")).join(F.broadcast(spark.createDataFrame([(w,) for w in fresh], "w string")), "w", "left_semi").distinct()  # bounded as above
        for r in places.collect():
            del fresh[r["w"]]
    if not fresh:
        return {}
    # which of them are spellings of which: the rarer of two stands behind the same words as the other
    known = spark.createDataFrame([(w,) for w in words_found if w in fresh or w in business], "w string")
    heads = pairs.join(F.broadcast(known), "w").select("w", "h")
    a, b = heads.select(F.col("w").alias("a"), "h"), heads.select(F.col("w").alias("b"), F.col("h").alias("h2"))
    alike = (F.substring("a", 1, 1) == F.substring("b", 1, 1)) & (F.length("a") < F.length("b"))
    both = a.join(b, (F.col("h") == F.col("h2")) & alike).filter(_shortens(F.col("a"), F.col("b"))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    of = dict(heads.groupBy("w").count().collect())
    spelled: dict[str, tuple[int, str]] = {}
    for r in both.collect():  # pairs of found words
        rare, usual = sorted((r["a"], r["b"]), key=lambda w: (w in business, of[w], w))
        if rare in fresh and r["both"] >= of[rare] * TOGETHER:
            spelled[rare] = max(spelled.get(rare, (0, "")), (r["both"], usual))
    out = {}
    for w in fresh:
        if len({names.BUSINESS_OF.get(x, x) for x in (*business, *names.TRADE_OF, *fresh) if x != w and x.startswith(w)}) > 1:
            continue  # a remnant of several words
        target = w
        while target in spelled:  # each more frequent than the one before
            target = spelled[target][1]
        out[w] = names.BUSINESS_OF.get(target, target)
    return out

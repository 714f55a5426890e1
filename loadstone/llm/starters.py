"""What a corpus tells about its sentence boundaries: words that begin sentences and names that hold an end mark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word or name counts if it is met so often at a boundary and once in so many texts, ...
LEAST, SHARE = 20, 2000
#: ... a word if it begins sentences so many times as often as it stands within one, in capitals;
FACTOR = 2.0
#: a name if at least this part of what follows its mark is one and the same word, or in lower case.
GOES_ON = 0.8


@dataclass(frozen=True)
class Learned:
    """Words that begin sentences, in capitals and in lower case, and names with an end mark."""

    starters: tuple[str, ...] = ()
    low_starters: tuple[str, ...] = ()
    names: tuple[str, ...] = ()


def learn(documents: DataFrame, text: str = "text") -> Learned:
    """Words and names of all of `documents` (a column of texts), by counting them at sure boundaries and elsewhere.

    A sure boundary is an end mark behind a word of four or more small letters; a word in lower case that is met there often
    enough begins remarks. The thresholds are shares of the texts, so the lists have a bound and may go to the driver. Null
    and empty texts count as none; small corpora teach nothing.
    """
    c = F.col(text)
    group = lambda pattern, i: F.regexp_extract_all(c, F.lit(pattern), F.lit(i))
    sure = r"(?<=\p{Ll}{4}[.?!] {1,2})(\p{Lu}\p{Ll}+|\p{Ll}{3,})(?![\p{L}\d'’.])"
    within = r"(?<=[\p{Ll},] )(\p{Lu}\p{Ll}+)(?![\p{L}\d'’.])"
    named = r"(?<!\p{L})(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?)[!?]\s+([\p{L}\d]+)"
    tagged = lambda words, what: F.transform(words, lambda w: F.struct(F.lit(what).alias("what"), w.alias("w"), F.lit("").alias("next")))
    marked = F.zip_with(group(named, 1), group(named, 2), lambda w, n: F.struct(F.lit("name").alias("what"), w.alias("w"), F.when(n.rlike("^\\p{Ll}"), "").otherwise(n).alias("next")))
    rows = documents.filter(c.isNotNull()).select(F.explode(F.concat(tagged(group(sure, 1), "start"), tagged(group(within, 1), "within"), marked)).alias("x")).select("x.*")
    counts = rows.groupBy("what", "w", "next").agg(F.count(F.lit(1)).alias("n"))
    of = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0)).alias(what)
    words = counts.groupBy("w").agg(of("start"), of("within"), of("name"), F.coalesce(F.max(F.when(F.col("what") == "name", F.col("n"))), F.lit(0)).alias("top"))
    least = max(LEAST, documents.select().count() // SHARE)
    found = words.filter((F.col("start") >= least) | (F.col("name") >= least)).collect()
    starts = [r for r in found if r["start"] >= least and r["start"] >= FACTOR * r["within"]]
    return Learned(
        tuple(sorted(r["w"] for r in starts if r["w"][0].isupper())),
        tuple(sorted(r["w"] for r in starts if r["w"][0].islower())),
        tuple(sorted(r["w"] for r in found if r["name"] >= least and r["top"] >= GOES_ON * r["name"])),
    )

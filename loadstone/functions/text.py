"""Scalar text and id functions as column expressions, evaluated JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

# Endings that a core name goes without; names that mean no shipper; placeholders for commodity rules.
SUFFIXES = (" LLC", " INC", " CORP", " CO ", " LTD", " LP")
PLACEHOLDERS = ("NONE", "NA", "SELF", "LINE RUN", "")
# Commodity code by the beginning of a tariff number, most specific first.
HS_CODES = (("^2701", "19"), ("^2601", "19"), ("^27", "17"), ("^100[1-8]", "02"), ("^7[23]", "11"), ("^(28|29|38|39)", "18"))
# Commodity code and words of a shipper's name that tell it, in order; tank codes of fuels.
NAME_CODES = (("02", ("GRAIN", "FEED", "MILL")), ("17", ("PETROLEUM", "OIL ", "REFIN")), ("19", ("COAL",)), ("18", ("CHEM", "PLAST")), ("11", ("STEEL", "METAL", "SCRAP")))
FUEL_TANKS = ("406", "407", "331")


def name_norm(name: Column) -> Column:
    """Upper case, every run of other characters than A-Z and 0-9 one blank, ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", " "))


def name_norm_first(name: Column) -> Column:
    """The form of older keys: only the first foreign character and the first run of blanks are replaced, then upper case."""
    once = F.regexp_replace(F.trim(name), r"(?s)^(.*?)[^A-Z0-9 ]", "$1 ")
    return F.upper(F.regexp_replace(once, r"(?s)^(.*?)\s+", "$1 "))


def name_core(name: Column) -> Column:
    """name_norm() without endings of legal forms."""
    return F.trim(F.regexp_replace(reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(" ")), SUFFIXES, name_norm(name)), " +", " "))


def slug(text: Column, length: int = 48) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one underscore, cut to `length`."""
    return F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), 1, length)


def pad_code(code: Column) -> Column:
    """A commodity code of two digits, zero-padded."""
    return F.substring(F.lpad(F.trim(code), 2, "0"), 1, 2)


def hs_code(number: Column) -> Column:
    """The commodity code of a tariff number; 31 if no rule fits, also for null."""
    digits = F.substring(F.regexp_replace(F.coalesce(number, F.lit("")), "[^0-9]", ""), 1, 10)
    return reduce(lambda c, rule: c.when(digits.rlike(rule[0]), rule[1]), HS_CODES, F.when(F.lit(False), "")).otherwise("31")


def _any_in(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(text.contains(w), F.lit(False)) for w in words])


def commodity_code(hazmat: Column, tank: Column, shipper: Column) -> Column:
    """The commodity code that placards, tank and shipper's name suggest; 31 otherwise."""
    placard = F.upper(F.coalesce(hazmat, F.lit(""))) == "Y"
    fuel = F.coalesce(tank.isin(*FUEL_TANKS), F.lit(False))
    by_name = reduce(lambda c, rule: c.when(_any_in(shipper, rule[1]), rule[0]), NAME_CODES, F.when(placard & fuel, "17").when(placard, "18").when(fuel, "17"))
    return by_name.otherwise("31")


def commodity_confidence(hazmat: Column, tank: Column, shipper: Column) -> Column:
    placard = F.upper(F.coalesce(hazmat, F.lit(""))) == "Y"
    fuel = F.coalesce(tank.isin(*FUEL_TANKS), F.lit(False))
    return F.when(placard & fuel, "strong").when(placard, "medium").when(_any_in(shipper, ("GRAIN", "PETROLEUM", "COAL")), "medium").otherwise("weak")


def confidence_rank(confidence: Column) -> Column:
    """The order of confidence labels, 0 for the weakest; null and unknown labels are null."""
    from loadstone.schema import CONFIDENCE_ORDER

    return reduce(lambda c, i: c.when(confidence == CONFIDENCE_ORDER[i], F.lit(i)), range(len(CONFIDENCE_ORDER)), F.when(F.lit(False), F.lit(0)))


def key_hash(*parts: Column | str) -> Column:
    """Lower-hex md5 of the parts joined by a pipe; null if any part is null."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    joined = [columns[0]]
    for c in columns[1:]:
        joined += [F.lit("|"), c]
    return F.md5(F.concat(*joined))


def stable_id(*parts: Column) -> Column:
    """The first 16 hex digits of the sha-256 of the parts that aren't null or empty, joined by a pipe."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.nullif(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def exact_sum(value: Column | str, scale: int = 6, over: WindowSpec | None = None) -> Column:
    """A sum of doubles that doesn't depend on their order: as decimals of 18 digits, `scale` of them behind the point.

    Numbers too large for that, infinities included, are summed beside as doubles and added; NaN counts as nothing. Null if
    nothing was summed. With `over` the sum runs over a window.
    """
    c = F.col(value) if isinstance(value, str) else value
    number = F.when(~F.isnan(c), c)
    exact = number.try_cast(f"decimal(18,{scale})")
    sums = [F.sum(exact).cast("double"), F.sum(F.when(exact.isNull(), number.cast("double")))] if over is None else [F.sum(exact).over(over).cast("double"), F.sum(F.when(exact.isNull(), number.cast("double"))).over(over)]
    return F.when(sums[1].isNull(), sums[0]).otherwise(F.coalesce(sums[0], F.lit(0.0)) + sums[1])


def json_object(**fields: Column) -> Column:
    """Compact JSON text of the fields, null ones kept."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})

"""Rows that fail to parse: strict load, anti-join of the record offsets, diagnosis of the remainder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The layouts of the two feeds.
LAYOUTS = {
    "inspection": (
        "INSPECTION_ID", "DOT_NUMBER", "SHIPPER_NAME", "INSP_DATE", "INSP_LEVEL_ID", "COUNTY_CODE_STATE", "LOCATION_DESC",
        "CARGO_TANK", "HAZMAT_PLACARD_REQ", "INSP_CARRIER_NAME", "GROSS_COMB_VEH_WT", "OOS_TOTAL", "VIOL_TOTAL",
    ),
    "licence": ("Organization No.", "Legal Name", "License Kind", "City", "State", "Effective Date"),
}

#: White space of a value's ends: ASCII and Unicode blanks.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def strip_blanks(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def dot_number(value: Column) -> Column:
    """A carrier number of 1 to 8 ASCII digits, not all zero, as bigint; else null."""
    text = strip_blanks(value)
    return F.when(text.rlike(r"^(?!0+$)[0-9]{1,8}$"), text.try_cast("bigint"))


def compact_date(value: Column) -> Column:
    """A calendar date written yyyymmdd, from 1990 to 2026; else null."""
    text = strip_blanks(value)
    day = F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")
    return F.when(text.rlike(r"^(199[0-9]|20[01][0-9]|202[0-6])[0-9]{4}$"), day)


def organization_number(value: Column) -> Column:
    """A licence number of 6 or 7 ASCII digits as bigint; else null."""
    text = strip_blanks(value)
    return F.when(text.rlike(r"^[0-9]{6,7}$"), text.try_cast("bigint"))


def is_blank(value: Column) -> Column:
    return F.coalesce(strip_blanks(value) == "", F.lit(True))


#: Checked fields: column, reader, reason.
CHECKS = {
    "DOT_NUMBER": (dot_number, "bad_dot_number"),
    "INSP_DATE": (compact_date, "bad_insp_date"),
    "Organization No.": (organization_number, "bad_organization_no"),
}


def named(column: str) -> Column:
    return F.col(f"`{column}`")


def value_reason(columns: dict[str, Column]) -> Column:
    """The reason of the first checked column that is neither blank nor readable; null if all are."""
    tests = [F.when(~is_blank(c) & CHECKS[name][0](c).isNull(), F.lit(CHECKS[name][1])) for name, c in columns.items()]
    return F.coalesce(*tests, F.lit(None).cast("string"))


# --- records of delimited text -------------------------------------------------------------------------------------

_SEPARATOR, _ESCAPE = "\x01", "\x02"


def _quote_parts(line: Column) -> tuple[Column, Column, Column, Column]:
    """A record cut at its double quotes: the number of parts, the first, those between, and the last."""
    parts = F.split(line, '"', -1)
    n = F.size(parts)
    return n, parts[0], F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), F.element_at(parts, -1)


def quoting_reason(line: Column) -> Column:
    """Why a record's quoting is broken, or null.

    Cut at the double quotes, the parts alternate between outside and inside of enclosures. All is well if the number of
    quotes is even, no bare part holds a line break, and each outside part between two enclosures is empty (a doubled
    quote) or begins and ends with a comma.
    """
    n, first, between, last = _quote_parts(line)
    outside = F.filter(between, lambda p, i: i % 2 == 1)
    glued = (n > 1) & (
        ((first != "") & ~first.endswith(",")) | ((last != "") & ~last.startswith(",")) | F.exists(outside, lambda p: (p != "") & ~(p.startswith(",") & p.endswith(",")))
    )
    broken = lambda p: p.rlike(r"[\r\n]")
    return F.when(n % 2 == 0, F.lit("unclosed_quote")).when(glued, F.lit("misplaced_quote")).when(broken(first) | broken(last) | F.exists(outside, broken), F.lit("bare_line_break"))


def split_record(line: Column) -> Column:
    """The field values of a record whose quoting is right: enclosures opened, doubled quotes made single."""
    n, first, between, last = _quote_parts(line)

    def kept(p: Column) -> Column:
        return F.replace(F.replace(p, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_SEPARATOR), F.lit(_ESCAPE + "a"))

    def bare(p: Column) -> Column:
        return F.replace(kept(p), F.lit(","), F.lit(_SEPARATOR))

    middle = F.transform(between, lambda p, i: F.when(i % 2 == 0, kept(p)).when(p == "", F.lit('"')).otherwise(bare(p)))
    joined = F.concat(bare(first), F.array_join(middle, ""), F.when(n > 1, bare(last)).otherwise(F.lit("")))
    return F.transform(
        F.split(joined, _SEPARATOR, -1),
        lambda f: F.replace(F.replace(f, F.lit(_ESCAPE + "a"), F.lit(_SEPARATOR)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE)),
    )


def record_reason(feed: Column, line: Column) -> Column:
    """Why a text record can't be read, or null: feed, quoting, number of fields, then values."""
    fields = split_record(line)
    wanted = reduce(lambda c, f: c.when(feed == f, F.lit(len(LAYOUTS[f]))), LAYOUTS, F.when(F.lit(False), F.lit(0)))
    by_feed = reduce(
        lambda c, f: c.when(feed == f, value_reason({name: F.try_element_at(fields, F.lit(i + 1)) for i, name in enumerate(LAYOUTS[f]) if name in CHECKS})),
        LAYOUTS,
        F.when(F.lit(False), F.lit("")),
    )
    return (
        F.when(line.isNull(), F.lit("null_line"))
        .when(wanted.isNull(), F.lit("unknown_feed"))
        .otherwise(
            F.coalesce(quoting_reason(line), F.when(F.size(fields) < wanted, F.lit("too_few_fields")).when(F.size(fields) > wanted, F.lit("too_many_fields")), by_feed)
        )
    )


# --- the operator ---------------------------------------------------------------------------------------------------


def _subtract(raw: DataFrame, loaded: DataFrame, offset: str, content: list[str]) -> DataFrame:
    """Rows of `raw` that `loaded` doesn't hold, by offset and content; both null-safe."""
    keys = [offset, *content]
    right = loaded.select(*[named(k).alias(f"__{i}") for i, k in enumerate(keys)])
    on = reduce(lambda a, b: a & b, [named(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)])
    return raw.join(right, on, "left_anti")


def load_lines(raw: DataFrame, feed: str) -> DataFrame:
    """The conforming records of one feed of raw text lines, as typed columns beside row_id, batch and received_at.

    Checked fields get their type (DOT_NUMBER and Organization No. bigint, INSP_DATE date), the counts integers, all
    other fields strings; a blank value is null. Repeated records stay, as each has its own row_id.
    """
    good = raw.filter((F.col("feed") == feed) & record_reason(F.col("feed"), F.col("line")).isNull())
    fields = good.select("row_id", "batch", "received_at", split_record(F.col("line")).alias("f"))
    numbers = {"GROSS_COMB_VEH_WT", "OOS_TOTAL", "VIOL_TOTAL"}

    def typed(i: int, name: str) -> Column:
        value = F.col("f")[i]
        if name in CHECKS:
            return CHECKS[name][0](value).alias(name)
        value = F.when(~is_blank(value), strip_blanks(value))
        return (value.try_cast("int") if name in numbers else value).alias(name)

    return fields.select("row_id", "batch", "received_at", *[typed(i, c) for i, c in enumerate(LAYOUTS[feed])])


def rejected_lines(raw: DataFrame) -> DataFrame:
    """The text records that don't load, with their reason: row_id, feed, line, reason.

    The strict load keeps the record offsets (row_id) of what conforms; what is left of the raw offsets after the
    anti-join is diagnosed. Null and unknown feeds and null lines can't be read either. Null offsets are compared
    null-safely together with the record itself, which alone decides whether it conforms.
    """
    loaded = raw.filter(record_reason(F.col("feed"), F.col("line")).isNull()).select("row_id", "feed", "line")
    rest = _subtract(raw.select("row_id", "feed", "line"), loaded, "row_id", ["feed", "line"])
    return rest.withColumn("reason", record_reason(F.col("feed"), F.col("line")))


def load_table(raw: DataFrame) -> DataFrame:
    """The conforming rows of a delivered table; checked columns typed, all others as they are."""
    checked = [c for c in raw.columns if c in CHECKS]
    good = raw.filter(value_reason({c: named(c) for c in checked}).isNull())
    return good.select(*[CHECKS[c][0](named(c)).alias(c) if c in checked else named(c) for c in raw.columns])


def rejected_rows(raw: DataFrame, offset: str = "row_id") -> DataFrame:
    """The rows of a delivered table whose checked columns can't be read: offset, the checked columns, reason."""
    checked = [c for c in raw.columns if c in CHECKS]
    slim = raw.select(named(offset), *[named(c) for c in checked])
    good = slim.filter(value_reason({c: named(c) for c in checked}).isNull())
    rest = _subtract(slim, good, offset, checked)
    return rest.withColumn("reason", value_reason({c: named(c) for c in checked}))


def all_rejects(raw_lines: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Everything that can't be read, of the text feeds and the delivered tables: table_name, row_id, reason."""
    parts = [rejected_lines(raw_lines).select(F.lit("raw_lines").alias("table_name"), "row_id", "reason")]
    parts += [rejected_rows(df).select(F.lit(name).alias("table_name"), "row_id", "reason") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)

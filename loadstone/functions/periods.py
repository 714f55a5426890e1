"""Period keys of mixed formats as comparable integers, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_code(period: Column) -> Column:
    """A sortable code of a period key: ten times the last month it covers, plus 1 for a month.

    Reads `YYYYMM`, `YYYY-MM`, `YYYY/M`, `YYYYMMDD` (its month) and `YYYY` (ends with December). A month therefore
    sorts after the year that ends with it. `snapshot`, null and anything else give null.
    """
    text = F.trim(period)
    year_month = F.regexp_extract(text, r"^([12]\d{3})(?:[-/]?)(0?[1-9]|1[0-2])(?:[0-3]\d)?$", 1)
    month = F.regexp_extract(text, r"^([12]\d{3})(?:[-/]?)(0?[1-9]|1[0-2])(?:[0-3]\d)?$", 2)
    return (
        F.when(text.rlike(r"^[12]\d{3}$"), (text.try_cast("int") * 100 + 12) * 10)
        .when(
            (year_month != "") & text.rlike(r"^(\d{4}[-/]\d{1,2}|\d{6}|\d{8})$"),
            (year_month.try_cast("int") * 100 + month.try_cast("int")) * 10 + 1,
        )
        .cast("int")
    )


def period_text(code: Column) -> Column:
    """The canonical key of a period code: `YYYYMM` for a month, `YYYY` for a year."""
    last = F.floor(code / 10).cast("int")
    return F.when(code % 10 == 1, last.cast("string")).otherwise(F.floor(last / 100).cast("string"))

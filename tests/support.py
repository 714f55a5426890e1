"""Shared test session and result comparison."""

import math

from pyspark.sql import SparkSession


def spark_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def cell(x):
    if x is None:
        return None
    if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    if isinstance(x, float):
        if math.isnan(x):
            return None
        return float(f"{x:.9g}") + 0.0
    if isinstance(x, bool):
        return x
    if isinstance(x, int):
        return float(x)
    if type(x).__name__ in ("NaTType", "NAType"):
        return None
    if type(x).__name__ == "Decimal":
        return float(x)
    return str(x)


def normalized(pdf):
    """Sorted column names and rows, order-insensitive, floats to nine digits."""
    columns = sorted(pdf.columns)
    rows = [tuple(cell(x) for x in r) for r in pdf[columns].astype(object).itertuples(index=False, name=None)]
    return columns, sorted(rows, key=str)

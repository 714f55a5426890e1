"""Writers: parquet, single-file CSV, receipts and document packs."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_parquet(df: DataFrame, path: str, partition: list[str] | None = None, mode: str = "overwrite") -> None:
    """zstd parquet; columns without a type become strings, so the file can be read back. An empty table keeps its schema."""
    typed = df.withColumns({f.name: F.col(f"`{f.name}`").cast("string") for f in df.schema.fields if isinstance(f.dataType, T.NullType)})
    writer = typed.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def write_signed(df: DataFrame, path: str, signature: str) -> None:
    """write_parquet() with the signature of its source beside it, in a folder that readers of the table don't see."""
    write_parquet(df, path)
    rows = df.sparkSession.createDataFrame([(signature, len(df.columns))], "signature string, columns int")
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/_source")


def is_current(spark: SparkSession, path: str, signature: str) -> bool:
    """Whether the table at `path` was written from a source of this signature; a missing table isn't."""
    try:
        return [r["signature"] for r in spark.read.schema("signature string").json(f"{path}/_source").collect()] == [signature]  # one row
    except AnalysisException:
        return False


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV file in a fixed column order; nested values as JSON text. For reports of bounded size."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    cells = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, nested) else F.col(c) for c in columns]
    df.select(*cells).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_receipt(path: str, **facts: Any) -> dict:  # noqa: ANN401
    """A JSON record of what a run did."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(facts, indent=2, sort_keys=True, default=str))
    return facts


def write_documents(df: DataFrame, folder: str, name: str, limit: int = 1000) -> int:
    """Each of the first `limit` rows of a report as a JSON document with a manifest; more rows raise ValueError."""
    rows = [json.loads(r) for r in df.limit(limit + 1).toJSON().collect()]
    if len(rows) > limit:
        raise ValueError(f"more than {limit} documents; write a table")
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    for i, row in enumerate(rows):
        (out / f"{name}_{i:04d}.json").write_text(json.dumps(row, sort_keys=True))
    write_receipt(str(out / "manifest.json"), name=name, documents=len(rows))
    return len(rows)

"""JSON lines with their broken lines set aside instead of dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hireatlas.operators.once import compute_once

BAD = "_bad_line"


def split_lines(lines: DataFrame, schema: str | StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of ``file, value`` lines, and the lines that are no such row: ``file, line, reason``.

    A line is bad when it is no JSON object or holds a value that its column cannot take; it gives no row, also not in part. Blank
    lines are neither. Every line is parsed once.
    """
    plain = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    wanted = StructType(list(plain.fields)).add(BAD, "string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    parsed = compute_once(lines.where(F.trim("value") != ""), {"_row": F.from_json("value", wanted, options)})
    is_object = F.startswith(F.ltrim("value"), F.lit("{"))
    bad = F.col(f"_row.{BAD}").isNotNull() | ~is_object
    rows = parsed.where(~bad).select(*(F.col(f"_row.`{f.name}`").alias(f.name) for f in plain.fields))
    reason = F.when(is_object & F.try_parse_json("value").isNotNull(), "value of another type").otherwise("no JSON object")
    return rows, parsed.where(bad).select("file", F.col("value").alias("line"), reason.alias("reason"))


def read_lines(spark: SparkSession, path: str, schema: str | StructType, quarantine: str | None = None) -> DataFrame:
    """Rows of JSON line files. With ``quarantine`` the bad lines are added to that table first, with their file and reason."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    rows, bad = split_lines(lines, schema)
    if quarantine is not None:
        bad.withColumn("found_at", F.current_timestamp()).write.mode("append").parquet(quarantine)
    return rows


def bad_line_counts(bad: DataFrame) -> DataFrame:
    """Bad lines per file and reason."""
    return bad.groupBy("file", "reason").agg(F.count("*").alias("n_lines"))

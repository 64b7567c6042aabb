"""Writers: parquet folders per table, append-only versions, line-delimited documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hireatlas.schemas import EDIT_FIELDS, JOB, conform
from hireatlas.sources import overlay_log
from hireatlas.sources.readers import latest_version

OUTREACH_COLUMNS = [
    "business_id", "name", "website_url", "nearest_station", "distance_km", "score", "industry_effective",
    "tags_effective", "note", "status", "recruiting_active", "job_count_total", "job_count_new_since_last",
]


def write_tables(tables: dict[str, DataFrame | None], base: str, run_date: str | None = None) -> list[str]:
    """One parquet folder per table; members that are None are left out."""
    written = []
    for name, df in tables.items():
        if df is None:
            continue
        target = f"{base.rstrip('/')}/{name}" + (f"/run_date={run_date}" if run_date else "")
        df.write.mode("overwrite").parquet(target)
        written.append(target)
    return written


def write_jobs(df: DataFrame, path: str) -> None:
    conform(df, JOB).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def publish_version(df: DataFrame, base: str) -> int:
    """Write the next version of a table. Readers keep the previous one until this is complete."""
    spark, base = df.sparkSession, base.rstrip("/")
    version = (latest_version(spark, base) or 0) + 1
    df.write.mode("overwrite").parquet(f"{base}/version={version}")
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{base}-published")
    return version


def publish_overlay(df: DataFrame, base: str) -> int:
    """A whole overlay as the next version; `overlay_log.publish_edits` writes the changed rows only."""
    return overlay_log.publish_whole(df, base)


def restore_overlay(spark: SparkSession, base: str, version: int) -> int:
    """Publish an older version again; no data is written, and the versions in between stay as they are."""
    return overlay_log.restore(spark, base, version)


def publish_known_jobs(df: DataFrame, base: str) -> int:
    return publish_version(df.select("job_url", "job_fingerprint"), base)


def csv_rows(df: DataFrame) -> DataFrame:
    """Hiring-signal rows with their list columns as JSON text."""
    lists = ["evidence_snippets", "evidence_urls"]
    return df.withColumns({c: F.to_json(c) for c in lists if dict(df.dtypes)[c].startswith("array")})


def write_signal_rows(df: DataFrame, path: str, output_format: str = "csv") -> None:
    """Hiring-signal rows; CSV carries the list columns as JSON text."""
    if output_format == "jsonl":
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
        return
    csv_rows(df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def audit_event(diff: DataFrame, *, ts: str, batch_id: str, source_master: str, overlay_path: str, backup: str | None) -> DataFrame:
    """One audit row out of the one-row edit summary."""
    return diff.select(
        F.lit(ts).alias("ts"),
        F.lit(batch_id).alias("batch_id"),
        F.col("changed_rows_count").cast("long").alias("changed_rows"),
        F.lit(source_master).alias("source_master"),
        F.lit(overlay_path).alias("curation_path"),
        F.lit(backup).cast("string").alias("backup_path"),
        F.to_json(F.struct(*EDIT_FIELDS)).alias("diff"),
    )


def outreach(filtered: DataFrame, meta: dict[str, str | None]) -> dict[str, DataFrame]:
    """Contact columns of the filtered view and a one-row table that says where they came from."""
    have = [c for c in OUTREACH_COLUMNS if c in filtered.columns]
    spark = filtered.sparkSession
    ddl = ", ".join(f"`{k}` string" for k in meta)
    return {"outreach": filtered.select(*have), "meta": spark.createDataFrame([tuple(meta.values())], ddl)}


def geojson_features(df: DataFrame) -> DataFrame:
    """One GeoJSON feature per row with coordinates; every column becomes a property."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("properties"),
    )
    return df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        F.to_json(feature, {"ignoreNullFields": "false"}).alias("value")
    )


def write_packages(documents: DataFrame, markdown: DataFrame, base: str) -> None:
    """Company documents: JSON lines keyed by run id, and the rendered text beside them."""
    documents.write.mode("overwrite").json(f"{base}/json")
    markdown.write.mode("overwrite").parquet(f"{base}/markdown")


def write_geojson(df: DataFrame, path: str) -> None:
    geojson_features(df).write.mode("overwrite").text(path)

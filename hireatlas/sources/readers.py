"""Readers: explicit schemas, text ids; columns are looked up only where a table may have more than the known ones."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hireatlas import schemas
from hireatlas.sources import overlay_log
from hireatlas.functions.text import filled
from hireatlas.functions.urls import clean_domain
from hireatlas.schemas import conform, require
from hireatlas.sources.lines import read_lines


def read_table(spark: SparkSession, path: str, *, sep: str = ",", multi_line: bool = False, schema: StructType | None = None) -> DataFrame:
    """A table by its file suffix; a folder is read as parquet. CSV columns stay text.

    ``multi_line`` allows line breaks inside quoted CSV values; one task then reads a file whole. JSON without a ``schema`` is read
    once more to find its columns.
    """
    suffix = re.search(r"\.(\w+)/?$", path)
    kind = suffix.group(1).lower() if suffix else "parquet"
    if kind == "csv":
        return spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option(
            "multiLine", multi_line
        ).csv(path)
    if kind in ("json", "jsonl"):
        return spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported table format: {path}")


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    df = read_table(spark, path)
    return conform(df, schemas.COMPANY, schemas.COMPANY_ALIASES, keep_extra=True)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REGISTRY).json(path)


def read_jobs(spark: SparkSession, path: str, quarantine: str | None = None) -> DataFrame:
    """Postings from JSON lines or parquet, with ``tags`` as an array; broken lines go to the ``quarantine`` table."""
    if re.search(r"\.jsonl?/?$", path):
        return read_lines(spark, path, schemas.JOB, quarantine)
    return conform(spark.read.parquet(path), schemas.JOB, keep_extra=True)


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table, or None when the folder is absent."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_crawl_stats(spark: SparkSession, path: str) -> DataFrame | None:
    df = read_optional(spark, path)
    return None if df is None else conform(df, schemas.CRAWL_STATS)


def read_domain_map(spark: SparkSession, path: str) -> DataFrame:
    return domain_map_rows(conform(read_table(spark, path), schemas.DOMAIN_MAP, {"businessId": "business_id"}))


def domain_map_rows(df: DataFrame) -> DataFrame:
    """Id to domain, without rows that have no id or no domain."""
    return df.select(filled("business_id").alias("business_id"), "name", clean_domain("domain").alias("domain")).where(
        F.col("business_id").isNotNull() & (F.col("domain") != "")
    )


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    sep = ","
    header = spark.read.text(path).limit(1).collect()
    if header and header[0][0].count(";") > header[0][0].count(","):
        sep = ";"
    return station_rows(conform(read_table(spark, path, sep=sep), schemas.STATION, schemas.STATION_ALIASES))


def station_rows(df: DataFrame) -> DataFrame:
    """Stations with coordinates; the country filter applies only where the code FI occurs at all."""
    finnish = df.where(F.col("country") == "FI").agg(F.count("*")).scalar()
    return df.where((finnish == 0) | (F.col("country") == "FI")).na.drop(subset=["lat", "lon"])


def read_places(spark: SparkSession, specs: list[str]) -> list[tuple[DataFrame, str, float, float]]:
    """One place export per station, given as ``name,lat,lon,path``."""
    out = []
    for spec in specs:
        parts = [p.strip() for p in spec.split(",")]
        if len(parts) != 4:
            raise ValueError(f"a station needs name,lat,lon,path: {spec}")
        name, lat, lon, path = parts
        raw = require(read_table(spark, path), schemas.PLACE_REQUIRED, path)
        out.append((conform(raw, schemas.PLACE), name, float(lat), float(lon)))
    return out


def read_overlay(spark: SparkSession, base: str) -> DataFrame:
    """Newest version of the edit overlay; an empty table when none was published."""
    return overlay_log.read_version(spark, base)


def read_rules(spark: SparkSession, groups: dict[str, list[str]]) -> DataFrame:
    """Rule dictionary as a small table: group, its position, prefix."""
    rows = [(g, i, p) for i, (g, prefixes) in enumerate(groups.items()) for p in prefixes]
    return spark.createDataFrame(rows, "group string, ord int, prefix string")


def parse_rules(text: str | None) -> dict[str, list[str]]:
    """Rule dictionary from JSON text or from ``name: {prefixes: [..]}`` YAML when PyYAML is there."""
    if not text:
        return {"other": []}
    try:
        data = json.loads(text)
    except ValueError:
        try:
            import yaml

            data = yaml.safe_load(text)
        except Exception:
            return {"other": []}
    if not isinstance(data, dict):
        return {"other": []}
    return {k: list((v.get("prefixes") if isinstance(v, dict) else v) or []) for k, v in data.items()}


def read_employees(spark: SparkSession, path: str) -> DataFrame:
    df = read_table(spark, path)
    df = df.toDF(*[c.strip() for c in df.columns])
    return conform(df, schemas.EMPLOYEES, {"businessId": "business_id"})


def read_audit(spark: SparkSession, path: str, limit: int, quarantine: str | None = None) -> DataFrame:
    """Newest ``limit`` audit events; lines that are no events are set aside in the ``quarantine`` table."""
    df = read_lines(spark, path, schemas.AUDIT, quarantine)
    return df.orderBy(F.col("ts").desc(), F.col("batch_id").desc()).limit(limit)


def read_labelled_pages(spark: SparkSession, labels: str, pages: str) -> DataFrame:
    """Labels (JSON array of file and label) joined to the HTML files they name."""
    truth = spark.read.schema("file string, label string").option("multiLine", True).json(labels)
    files = spark.read.text(pages, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("html")
    )
    return (
        truth.where(filled("file").isNotNull() & filled("label").isNotNull())
        .join(files, "file")
        .select(F.concat(F.lit("https://example.com/"), "file").alias("url"), "html", F.lower("label").alias("label"))
    )


def read_golden_texts(spark: SparkSession, path: str, quarantine: str | None = None) -> DataFrame:
    """Labelled texts, wrapped as minimal pages; broken lines go to the ``quarantine`` table."""
    df = read_lines(spark, path, "id string, url string, text string, label string", quarantine)
    html = F.concat(F.lit("<html><body>"), "text", F.lit("</body></html>"))
    return df.select("url", html.alias("html"), F.lower("label").alias("label"))


def latest_version(spark: SparkSession, base: str) -> int | None:
    """Highest published ``version=N`` of a table.

    A version is entered into the list beside the table only after all of its files are written.
    """
    published = read_optional(spark, f"{base.rstrip('/')}-published")
    return None if published is None else published.agg(F.max("version")).first()[0]


def snapshot_date(path: Column) -> Column:
    """Eight-digit date of a snapshot: from its file name, else from its ``run_`` folder."""
    name = F.element_at(F.split(path, "/"), -1)
    own = F.nullif(F.regexp_extract(name, r"(\d{8})", 1), F.lit(""))
    folder = F.nullif(F.regexp_extract(path, r"/run_(\d{8})[^/]*/(?:[^/]+/)?[^/]+$", 1), F.lit(""))
    return F.coalesce(own, folder)


def newest_snapshot(files: DataFrame) -> DataFrame:
    """The newest file of a listing with ``path`` and ``modificationTime``: by its date, else by its time."""
    dated = files.select("path", "modificationTime", snapshot_date(F.col("path")).alias("run_date"))
    return dated.orderBy(F.col("run_date").desc_nulls_last(), F.col("modificationTime").desc(), "path").limit(1)


def latest_rows(df: DataFrame, date_column: str) -> DataFrame:
    """Rows of the newest snapshot; on a partition column this prunes to one partition."""
    newest = df.agg(F.max(date_column)).scalar()
    return df.where(F.col(date_column) == newest)



"""The overlay as a log of versions that readers merge.

A version folder holds rows in buckets of the id's hash. The commit list beside the table says which folders make up a version: a whole
table is one folder; a set of edits adds one with the rows it changes; restoring points at the folders of an older version and writes no
data. Reading takes of every id the rows of the newest of these folders. Compaction writes them together as one folder, so reads stay
short. A folder counts only once its commit is there, and no folder is ever rewritten, so readers never see a version change. There
is one writer at a time; a commit that names its writer and batch makes a repeated batch a no-operation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from hireatlas.functions.text import filled
from hireatlas.operators.overlay import upsert
from hireatlas.schemas import OVERLAY, conform

BUCKETS = 64
COMMIT = "version int, parts array<int>, writer string, batch long"


def bucket_of(key: str = "business_id") -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(key), F.lit(""))), F.lit(BUCKETS)).cast("int")


def commits(spark: SparkSession, base: str) -> DataFrame:
    """All commits; one without a list of folders is a whole table of its own."""
    from hireatlas.sources.readers import read_optional

    found = read_optional(spark, f"{base.rstrip('/')}-published")
    if found is None:
        return spark.createDataFrame([], COMMIT)
    listed = spark.read.schema(COMMIT).parquet(f"{base.rstrip('/')}-published")
    return listed.withColumn("parts", F.coalesce("parts", F.array("version")))


def commit_of(spark: SparkSession, base: str, version: int | None = None) -> Row | None:
    """The commit of a version, the newest one by default."""
    listed = commits(spark, base)
    if version is not None:
        listed = listed.where(F.col("version") == version)
    return listed.orderBy(F.col("version").desc()).first()


def read_version(spark: SparkSession, base: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """Rows of a version, the newest one by default; on request of some buckets only, whose files alone are read."""
    commit = commit_of(spark, base, version)
    if commit is None:
        if version is not None:
            raise ValueError(f"version {version} of {base} was not published")
        return spark.createDataFrame([], OVERLAY)
    base = base.rstrip("/")
    folders = [f"{base}/version={part}" for part in commit.parts]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OVERLAY)
    rows = spark.read.schema(f"{schema}, version int, bucket int").option("basePath", base).parquet(*folders)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    if len(folders) > 1:
        # Rows that repeat an id inside a folder all stay, as they were written.
        newest = F.rank().over(Window.partitionBy("business_id").orderBy(F.col("version").desc()))
        rows = rows.withColumn("_rank", newest).where("_rank = 1")
    return rows.select(*OVERLAY.fieldNames())


def _commit(spark: SparkSession, base: str, version: int, parts: list[int], writer: str | None = None, batch: int | None = None) -> int:
    spark.createDataFrame([(version, parts, writer, batch)], COMMIT).coalesce(1).write.mode("append").parquet(f"{base.rstrip('/')}-published")
    return version


def _write(rows: DataFrame, base: str, version: int) -> None:
    target = f"{base.rstrip('/')}/version={version}"
    # What a writer left behind without a commit is written over.
    conform(rows, OVERLAY).withColumn("bucket", bucket_of()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)


def _next(spark: SparkSession, base: str) -> tuple[int, list[int]]:
    commit = commit_of(spark, base)
    return (1, []) if commit is None else (commit.version + 1, list(commit.parts))


def publish_whole(rows: DataFrame, base: str) -> int:
    """A whole table as the next version."""
    version, _ = _next(rows.sparkSession, base)
    _write(rows, base, version)
    return _commit(rows.sparkSession, base, version, [version])


def publish_edits(
    edits: DataFrame, base: str, *, source_master: str | None, updated_by: str, updated_at: str | None = None, writer: str | None = None, batch: int | None = None
) -> int:
    """Edits as the next version: only the buckets of edited ids are read, only rows of edited ids are written."""
    spark = edits.sparkSession
    if writer is not None:
        done = commits(spark, base).where((F.col("writer") == writer) & (F.col("batch") == batch)).first()
        if done is not None:
            return done.version
    version, parts = _next(spark, base)
    ids = edits.select(filled("business_id").alias("business_id")).where("business_id IS NOT NULL")
    buckets = [r.bucket for r in ids.select(bucket_of().alias("bucket")).distinct().collect()]  # at most BUCKETS
    current = read_version(spark, base, buckets=buckets).join(ids.distinct(), "business_id", "left_semi")
    _write(upsert(current, edits, source_master=source_master, updated_by=updated_by, updated_at=updated_at), base, version)
    return _commit(spark, base, version, [*parts, version], writer, batch)


def compact(spark: SparkSession, base: str) -> int:
    """The newest version written together as one folder; the same rows as before."""
    version, parts = _next(spark, base)
    if len(parts) < 2:
        return version - 1
    _write(read_version(spark, base), base, version)
    return _commit(spark, base, version, [version])


def restore(spark: SparkSession, base: str, version: int) -> int:
    """Publish an older version again by pointing at its folders; the versions in between stay as they are."""
    commit = commit_of(spark, base, version)
    if commit is None:
        raise ValueError(f"version {version} of {base} was not published")
    newest, _ = _next(spark, base)
    return _commit(spark, base, newest, list(commit.parts))

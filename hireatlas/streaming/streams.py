"""The recurring runs as streams. State is kept by key (see `keyed`), so no batch reads what earlier ones wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from hireatlas.operators.crawl import counter_entries, stats_from_counters
from hireatlas.operators.jobs import fingerprint, next_state
from hireatlas.session import SETTINGS
from hireatlas.sources import overlay_log
from hireatlas.streaming.keyed import Counters, SeenKey, columns_of, first_of, first_rows, in_batches, summed


def _with_state(df: DataFrame) -> DataFrame:
    """The session settings that keyed state needs, whatever the caller configured."""
    for key, value in SETTINGS.items():
        if ".stateStore." in key:
            df.sparkSession.conf.set(key, value)
    return df


def distinct_jobs_stream(jobs: DataFrame, ts: str, delay: str) -> DataFrame:
    """Postings once per fingerprint within the watermark; later rows are dropped."""
    return jobs.withColumn("job_fingerprint", fingerprint()).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["job_fingerprint"])


def flagged_jobs_stream(jobs: DataFrame, known: DataFrame | None = None, ttl_days: int | None = None) -> DataFrame:
    """Distinct postings of each batch with ``is_new``: neither the URL nor the fingerprint came before.

    The first state is kept by URL, the second by fingerprint. A URL counts as known once any posting carried it, also one that was
    dropped as a repeat. ``known`` (``job_url, job_fingerprint``) is what was known before the stream began; ``ttl_days`` forgets keys.
    """
    jobs = _with_state(jobs).withColumn("job_fingerprint", fingerprint())
    ttl = None if ttl_days is None else ttl_days * 86_400_000
    mode = "none" if ttl is None else "processingTime"

    def seen(rows: DataFrame, key: str, pick, flag: str) -> DataFrame:
        before = None if known is None else known.where(F.col(key).isNotNull()).select(key).distinct().groupBy(key)
        processor = SeenKey(pick, rows.columns, flag, ttl)
        return rows.groupBy(key).transformWithState(processor, columns_of(rows, f"{flag} boolean"), "append", mode, before)

    by_url = seen(in_batches(jobs, first_rows(["job_url"], "ord")), "job_url", first_of("ord"), "_known_url")
    by_print = seen(by_url, "job_fingerprint", first_of("ord", "company_business_id"), "_known_print")
    return by_print.withColumn("is_new", ~F.col("_known_url") & ~F.col("_known_print")).drop("_known_url", "_known_print")


def new_jobs_stream(jobs: DataFrame, state: str, out: str, known: DataFrame | None = None, ttl_days: int | None = None) -> DataStreamWriter:
    """Every micro-batch compared with all postings seen before it; flagged postings below ``out``, new keys below ``state``.

    ``state`` is for the batch twin and later streams (``known``); the stream itself never reads it. A batch writes under its own
    id, so a repeated batch replaces its rows instead of adding them.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        flagged = batch.sparkSession.read.parquet(f"{out}/batch={batch_id}")
        next_state(flagged.where("is_new")).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    return flagged_jobs_stream(jobs, known, ttl_days).writeStream.foreachBatch(run)


def sliding_activity(events: DataFrame, key: str, ts: str, delay: str, length: str = "30 days", slide: str = "1 day") -> DataFrame:
    """Streaming counts per sliding window."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, length, slide), key).agg(F.count("*").alias("n_events"))


def sliding_activity_batch(events: DataFrame, key: str, ts: str, days: int = 30) -> DataFrame:
    """The same counts in batch: days are counted first, only the daily counts are spread over windows."""
    daily = events.groupBy(F.col(key), F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    starts = F.sequence(F.date_sub("day", days - 1), F.col("day"), F.expr("interval 1 day"))
    return (
        daily.select(key, "n", F.explode(starts).alias("window_start"))
        .groupBy(key, "window_start")
        .agg(F.sum("n").alias("n_events"))
    )


def crawl_stats_stream(log: DataFrame, out: str, state: str) -> DataStreamWriter:
    """Statistics per domain, kept up to date batch by batch: a batch gives new statistics of the domains it touches.

    The counters of those domains, as they stand after the batch, lie below ``state``; the stream itself never reads them.
    """
    entries = counter_entries(_with_state(log))
    parts = in_batches(entries, summed(["domain", "kind", "name"], "n", ["seq", "url"]))
    columns = "domain string, kind string, name string, n long, first struct<seq:long,url:string>"
    counters = parts.groupBy("domain").transformWithState(Counters(), columns, "update", "none")

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
        counted = batch.sparkSession.read.parquet(f"{state}/batch={batch_id}")
        stats_from_counters(counted).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return counters.writeStream.outputMode("update").foreachBatch(run)


def crawl_totals_stream(log: DataFrame) -> DataFrame:
    """Running page, posting and error counts per domain, for update mode."""
    fetched = F.col("error").isNull() & (F.col("status_code") < 400)
    return log.groupBy("domain").agg(
        F.count_if(fetched).alias("pages_fetched"),
        F.coalesce(F.sum("jobs"), F.lit(0)).alias("jobs_found"),
        F.count("error").alias("errors_count"),
    )


def overlay_stream(edits: DataFrame, base: str, *, source_master: str, updated_by: str, compact_after: int = 32) -> DataStreamWriter:
    """Every micro-batch of edits published as the next overlay version.

    A batch reads and writes the buckets of its own ids. After ``compact_after`` batches the versions are written together. A batch that
    is repeated after a restart finds its commit and changes nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        writer = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        one = batch.groupBy("business_id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "business_id"]), "seq").alias("e"))
        overlay_log.publish_edits(one.select("business_id", "e.*"), base, source_master=source_master, updated_by=updated_by, writer=writer, batch=batch_id)
        if len(overlay_log.commit_of(spark, base).parts) > compact_after:
            overlay_log.compact(spark, base)

    return edits.writeStream.foreachBatch(run)

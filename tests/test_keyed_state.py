"""Streams with state by key against their batch twins, over restarts and late rows; the overlay log."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from hireatlas.operators import crawl, jobs as J, overlay as O
from hireatlas.sources import overlay_log as log, readers as R
from hireatlas.streaming import keyed, streams as S

JOBS = "ord long, company_business_id string, company_domain string, job_title string, job_url string, location_text string, posted_date string, tags array<string>"


def drain(writer, checkpoint):
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None


def part(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def postings(spark, seed, n):
    """Few URLs and titles, so that repeats of every kind occur; a third of all rows share one URL, some have none."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        url = "https://hot/1" if i % 3 == 0 else None if i % 17 == 0 else f"https://a/{draw.randint(1, 60)}"
        rows.append((1000 * seed + i, str(draw.randint(1, 3)), "a.fi", f"Job {draw.randint(1, 40)}", url, "Lahti", None if i % 5 else "2024-01-01", ["x"]))
    return spark.createDataFrame(rows, JOBS)


def test_new_postings_over_restarts_equal_the_batch_comparison(spark, folder):
    src, state, out, cp = folder("src"), folder("state"), folder("out"), folder("cp")
    batches = [postings(spark, seed, 80) for seed in range(1, 5)]
    urls, prints = set(), set()
    for number, batch in enumerate(batches):
        part(batch, src)
        stream = spark.readStream.schema(batch.schema).parquet(src)
        drain(S.new_jobs_stream(stream, state, out), cp)  # a new query on the old checkpoint each time
        kept = J.dedup_jobs(batch).collect()
        want = {r.ord: r.job_url not in urls and r.job_fingerprint not in prints for r in kept}
        got = {r.ord: r.is_new for r in spark.read.parquet(f"{out}/batch={number}").collect()}
        assert got == want
        urls |= {r.job_url for r in batch.collect() if r.job_url}
        prints |= {r.job_fingerprint for r in kept}
        # What lies in the folders is never read again: a broken file there disturbs nobody.
        for base in (state, out):
            with open(f"{base}/batch={number}/part-broken.parquet", "wb") as f:
                f.write(b"no parquet")


def test_a_stream_may_begin_with_what_is_known(spark, folder):
    src, cp = folder("src"), folder("cp")
    first, second = postings(spark, 1, 60), postings(spark, 2, 60)
    known = J.next_state(J.dedup_jobs(first))
    part(second, src)
    stream = spark.readStream.schema(second.schema).parquet(src)
    drain(S.flagged_jobs_stream(stream, known).writeStream.format("memory").queryName("seeded"), cp)
    got = {r.ord: r.is_new for r in spark.table("seeded").collect()}
    assert got == {r.ord: r.is_new for r in J.flag_new(second, known).collect()}
    assert not all(got.values()) and any(got.values())


EVENTS = "domain string, seq long, url string, status_code int, error string, jobs long, skipped_reason string, extractor string"


def events(spark, numbers):
    draw = random.Random(str(list(numbers)))
    rows = []
    for i in numbers:
        domain = "hot" if i % 3 == 0 else None if i % 19 == 0 else f"d{draw.randint(1, 5)}"
        error = draw.choice([None, None, "timeout", "http_403:/x", "robots_disallow_url"])
        rows.append((domain, i, f"u{i}" if i % 7 else None, 200, error, draw.choice([None, 0, 2]), draw.choice([None, None, "dns"]), draw.choice([None, "jsonld", "lever"])))
    return spark.createDataFrame(rows, EVENTS)


def test_statistics_with_late_rows_equal_those_of_all_events(spark, folder):
    src, out, state, cp = folder("src"), folder("out"), folder("state"), folder("cp")
    # The third batch brings events that are older than all others.
    numbers = [range(200, 260), range(260, 330), range(0, 50), range(330, 332)]
    everything, latest = None, {}
    for number, own in enumerate(numbers):
        batch = events(spark, own)
        everything = batch if everything is None else everything.unionByName(batch)
        part(batch, src)
        drain(S.crawl_stats_stream(spark.readStream.schema(batch.schema).parquet(src), out, state), cp)
        written = spark.read.parquet(f"{out}/batch={number}").collect()
        assert {r.domain for r in written} == {r.domain for r in batch.select("domain").distinct().collect()}
        latest |= {r.domain: r for r in written}
        assert latest == {r.domain: r for r in crawl.crawl_stats(everything).collect()}
        with open(f"{state}/batch={number}/part-broken.parquet", "wb") as f:
            f.write(b"no parquet")


def test_rows_are_brought_together_before_they_are_dealt_out(spark):
    frame = events(spark, range(3000)).coalesce(1)
    entries = crawl.counter_entries(frame)
    parts = keyed.in_batches(entries, keyed.summed(["domain", "kind", "name"], "n", ["seq", "url"]))
    assert parts.count() < 200  # out of more than 5,000 entries
    merged = parts.groupBy("domain", "kind", "name").agg(F.sum("n").alias("n"), F.min(F.struct("seq", "url")).alias("first"))
    order = lambda frame: sorted(map(str, frame.select("domain", "kind", "name", "n", "first").collect()))
    assert order(merged) == order(crawl.crawl_counters(frame))
    big = spark.createDataFrame([(None, 2**62 + 1), ("a", None), (None, 2**62)], "k string, ord long").coalesce(1)
    assert sorted(map(tuple, keyed.in_batches(big, keyed.first_rows(["k"], "ord")).collect()), key=str) == [("a", None), (None, 2**62)]


EDITS = "business_id string, status string, hide_flag boolean, note string, industry_override string, tags_add string, tags_remove string, seq long"


def edits(spark, *rows):
    return spark.createDataFrame([(i, s, None, n, None, None, None, q) for i, s, n, q in rows], EDITS)


def publish(df, base, **more):
    return log.publish_edits(df, base, source_master="m", updated_by="me", **more)


def content(df):
    return {r.business_id: (r.status, r.note) for r in df.collect()}


def buckets(base, version):
    return {os.path.basename(p) for p in glob.glob(f"{base}/version={version}/bucket=*")}


def test_a_batch_of_edits_touches_its_own_buckets(spark, folder):
    base = folder("overlay")
    assert publish(edits(spark, *[(f"c{i}", "new", None, 1) for i in range(200)]), base) == 1
    assert len(buckets(base, 1)) > 40
    assert publish(edits(spark, ("c7", "shortlist", "call", 1), ("c7", "excluded", "no", 2), (" ", "x", None, 3), (None, "y", None, 4)), base) == 2
    assert len(buckets(base, 2)) == 1
    # Folders of other buckets are not even opened.
    other = next(b for b in sorted(buckets(base, 1)) if b not in buckets(base, 2))
    with open(f"{base}/version=1/{other}/part-broken.parquet", "wb") as f:
        f.write(b"no parquet")
    assert publish(edits(spark, ("c7", "shortlist", "again", 1)), base) == 3
    own = int(next(iter(buckets(base, 3))).split("=")[1])
    assert content(log.read_version(spark, base, buckets=[own]))["c7"] == ("shortlist", "again")


def test_versions_compaction_and_restore(spark, folder):
    base, whole = folder("overlay"), {}
    steps = [edits(spark, ("a", "new", "1", 1), ("b", "new", "1", 1)), edits(spark, ("b", "shortlist", "2", 1), ("c", "new", "2", 1)), edits(spark, ("a", "excluded", "3", 1))]
    rows = spark.createDataFrame([], log.OVERLAY)
    for number, step in enumerate(steps, 1):
        assert publish(step, base, updated_at=f"t{number}") == number
        rows = O.upsert(rows, step, source_master="m", updated_by="me", updated_at=f"t{number}")
        whole[number] = sorted(map(tuple, rows.collect()))
        assert sorted(map(tuple, R.read_overlay(spark, base).collect())) == whole[number]
    assert log.compact(spark, base) == 4 and log.compact(spark, base) == 4
    assert log.commit_of(spark, base).parts == [4]
    assert sorted(map(tuple, R.read_overlay(spark, base).collect())) == whole[3]
    # An older version comes back without a copy, and edits go on from there.
    assert log.restore(spark, base, 2) == 5 and not os.path.exists(f"{base}/version=5")
    assert sorted(map(tuple, R.read_overlay(spark, base).collect())) == whole[2]
    assert publish(edits(spark, ("c", "done", "6", 1)), base) == 6
    assert content(R.read_overlay(spark, base)) == {"a": ("new", "1"), "b": ("shortlist", "2"), "c": ("done", "6")}
    for number, rows_then in whole.items():
        assert sorted(map(tuple, log.read_version(spark, base, number).collect())) == rows_then
    with pytest.raises(ValueError):
        log.restore(spark, base, 99)


def test_a_repeated_batch_and_a_torn_one_change_nothing(spark, folder):
    base = folder("overlay")
    assert publish(edits(spark, ("a", "new", None, 1)), base, writer="q", batch=0) == 1
    assert publish(edits(spark, ("a", "other", None, 1)), base, writer="q", batch=0) == 1
    assert content(R.read_overlay(spark, base)) == {"a": ("new", None)}
    # Files of a version without a commit are no part of the table, and the next writer replaces them.
    log._write(O.upsert(spark.createDataFrame([], log.OVERLAY), edits(spark, ("z", "torn", None, 1)), source_master="m", updated_by="me"), base, 2)
    assert content(R.read_overlay(spark, base)) == {"a": ("new", None)}
    assert publish(edits(spark, ("b", "new", None, 1)), base, writer="q", batch=1) == 2
    assert content(R.read_overlay(spark, base)) == {"a": ("new", None), "b": ("new", None)}
    assert publish(edits(spark, (None, "x", None, 1)), base) == 3
    assert R.read_overlay(spark, base).count() == 2


def test_overlay_stream_compacts_and_skips_repeated_batches(spark, folder):
    src, base, cp = folder("src"), folder("overlay"), folder("cp")
    for number in range(5):
        part(edits(spark, (f"c{number}", "new", str(number), number), ("same", "s", str(number), number)), src)
        stream = spark.readStream.schema(edits(spark).schema).parquet(src)
        drain(S.overlay_stream(stream, base, source_master="m", updated_by="me", compact_after=2), cp)
    commits = log.commits(spark, base).orderBy("version").collect()
    assert [c.batch for c in commits if c.batch is not None] == list(range(5)) and len({c.writer for c in commits if c.writer}) == 1
    assert [c.version for c in commits if c.batch is None] == [4, 7]
    assert content(R.read_overlay(spark, base)) == {**{f"c{i}": ("new", str(i)) for i in range(5)}, "same": ("s", "4")}

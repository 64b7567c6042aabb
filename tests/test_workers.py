"""What Python workers are given at once, and what they keep."""

import re

import pytest
from pyspark.sql import functions as F

from hireatlas.functions import keywords, markup
from hireatlas.operators import pages as P, signal as S


def pages_of(spark, n, repeats):
    html = F.concat(F.lit("<title>t</title>"), F.repeat(F.lit("<p>some plain words</p>"), repeats))
    return spark.range(0, n, 1, 1).select(F.col("id").alias("page_id"), F.lit("https://a.fi").alias("url"), html.alias("html"))


@pytest.mark.parametrize("query", [lambda p: P.cookie_wall(P.page_text(p)), P.consent_pages])
def test_a_partition_of_pages_reaches_a_worker_in_batches_of_a_few_mb(spark, monkeypatch, query):
    read, first = markup.read_parts, keywords.first_places

    def pages(html, names, types):
        assert html.nbytes < 10_000_000, "too many pages at once"
        return read(html, names, types)

    def texts(words, values):
        values = list(values)
        assert sum(map(len, values)) < 10_000_000, "too many texts at once"
        return first(words, values)

    monkeypatch.setattr(markup, "read_parts", pages)
    monkeypatch.setattr(keywords, "first_places", texts)
    assert query(pages_of(spark, 2000, 700)).count() == 2000  # 32 MB in one partition


@pytest.mark.parametrize("repeats, given", [(700, True), (1, False)])
def test_a_batch_of_pages_leaves_nothing_behind(spark, monkeypatch, repeats, given):
    def told():
        raise RuntimeError("memory given back")

    monkeypatch.setattr(markup, "give_back", told)
    read = pages_of(spark, 50, repeats).select(markup.page_parts(F.col("html"), "text")["text"].alias("text"))
    if given:
        with pytest.raises(Exception, match="memory given back"):
            read.collect()
    else:
        assert len(read.collect()) == 50


def test_the_two_word_look_ups_of_a_verdict_share_a_worker(spark):
    plan = S.page_verdict(pages_of(spark, 5, 1))._jdf.queryExecution().executedPlan().toString()
    nodes = re.findall(r"^.*ArrowEvalPython \[.*$", plan, re.M)
    assert len(nodes) == 2 and max(node.count("run(") for node in nodes) == 2  # parts of the page; words and phrases

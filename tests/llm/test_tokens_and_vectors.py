"""Byte-pair ids against tiktoken, whitening against a plain eigendecomposition, cuts against a loop over units."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from hireatlas.llm import byte_pairs, fill_in_middle, whitening

RANKS = byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# Byte pairs


def odd_texts():
    draw = random.Random(5)
    parts = ["don't", "we've", "'s", "'", "  ", "\n\n", "\t", " ", "Zwölf", "１２", "12345", "🙂🙂", "é", "<|endoftext|>", "\x00", "\x1c", " ", "　", "...", "\U0003137f", "͸"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 150))) for _ in range(120)]
    runs = ["a" * 700, " " * 700, " " * 700 + "b", "1" * 333 + " x" * 60, "x " * 400, "!" * 500 + "'ll" * 90, "é" * 129 + "\n" * 131 + "'ve" * 70, "\U0003137f" * 300]
    return [None, "", " ", *texts, *runs]


def test_ids_are_those_of_the_whole_text(spark, plain):
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "1 AS row", "'x' AS ids", "2 AS k", "3 AS start")
    tokens = byte_pairs.encode(docs.repartition(5), RANKS, public_tokenizers.PATTERN, chunk=48, overlap=12)
    got = {r.doc_id: r for r in byte_pairs.decode(tokens, RANKS).collect()}
    lists = {r.doc_id: r.ids for r in byte_pairs.token_list(tokens).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, text in enumerate(texts):
        ids = plain.encode_ordinary(text or "")
        assert lists[i] == ids, text
        assert bytes(got[i].bytes) == (text or "").encode()
        assert bytes(got[i].ids) == np.array(ids, "<u4").tobytes()


def test_classes_are_those_of_the_merging_library(plain):
    others = byte_pairs.stand_ins(public_tokenizers.PATTERN)
    encoder = byte_pairs.Encoder(RANKS, public_tokenizers.PATTERN, others)
    draw = random.Random(6)
    pool = [*map(chr, others), *"ab 1'\n"]
    for _ in range(300):
        text = "".join(draw.choice(pool) for _ in range(40))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain.encode_ordinary(text)


def test_long_rows_repeated_ids_and_clashing_ids(spark, plain):
    long = "word's  and 123 " * 60_000 + "z" * 40_000 + " end"
    rows = [(None, long), (7, "one text"), (7, "one text"), (7, "another")]
    docs = spark.createDataFrame(rows, "name int, body string")
    got = byte_pairs.encode(docs, RANKS, public_tokenizers.PATTERN, "name", "body").collect()
    found = sorted(((r.doc_id or 0), hashlib.sha256(r.ids).hexdigest()) for r in got)
    expected = sorted(((i or 0), hashlib.sha256(np.array(plain.encode_ordinary(t), "<u4").tobytes()).hexdigest()) for i, t in rows)
    assert found == expected


def test_byte_pairs_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_pairs.decode(byte_pairs.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_query_over_the_documents(spark, plain):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = byte_pairs.op11_byte_pairs(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# Whitening


def check_whitening(spark, rows, vectors, keep=32):
    x = np.floor(64 * vectors.astype(np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    model = whitening.fit(rows, keep)
    varies = model.varies()
    keep = min(keep, x.shape[1])
    assert np.allclose(model.eigenvalues[varies], values[:keep][varies], rtol=1e-10)
    assert whitening.identity_error(rows, model) < 1e-9
    got = whitening.whiten(rows, model).collect()
    assert len(got) == n
    assert sorted(r.deviation for r in got) == sorted(((n * x - sums) ** 2).sum(1).tolist())
    found = np.array([r.whitened for r in got], float)
    order = np.array([r.vec_id for r in got])
    plain_values = (centred @ axes[:, :keep])[order]
    for j in np.flatnonzero(varies):
        column = plain_values[:, j] / np.sqrt(values[j])
        assert min(np.abs(found[:, j] - column).max(), np.abs(found[:, j] + column).max()) < 1e-6
    assert np.isnan(found[:, ~varies]).all()
    return model


def test_whitening_against_eigenvectors(spark):
    random_ = np.random.default_rng(3)
    scales = 2.0 ** np.arange(0, -12, -0.5)
    vectors = (random_.normal(size=(3000, 24)) * scales * 50) @ np.linalg.qr(random_.normal(size=(24, 24)))[0]
    docs = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, n int").repartition(6)
    check_whitening(spark, whitening.fit_list(docs), vectors, 16)


def test_whitening_with_directions_that_do_not_vary(spark):
    random_ = np.random.default_rng(4)
    vectors = random_.normal(size=(400, 5))
    vectors[:, 3] = vectors[:, 1]
    vectors[:, 4] = 7
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    model = check_whitening(spark, whitening.fit_list(docs), vectors)
    assert model.varies().tolist() == [True, True, True, False, False]


def test_vectors_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, []), (None, [3.0, 1.0]), (1, [1.0, 2.0]), (8, [1e300, 1.0]), (9, [-0.01, 2.5])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept = whitening.fit_list(docs)
    assert sorted((r.vec_id or 0) for r in kept.collect()) == [0, 1, 1, 9]
    assert [r.x for r in kept.where("vec_id = 9").collect()] == [[999_999, 1_000_160]]
    assert whitening.identity_error(kept, whitening.fit(kept)) < 1e-9
    one = whitening.fit_list(docs.where("vec_id = 9"))
    model = whitening.fit(one)
    assert not model.varies().any() and whitening.identity_error(one, model) == 0.0
    assert [(r.deviation, r.whitened) for r in whitening.whiten(one, model).collect()] == [(0, [None, None])]
    assert whitening.fit(whitening.fit_list(docs.where("vec_id = 2"))) is None


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**45 - i), 0.0]) for i in range(2000)]
    kept = whitening.fit_list(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    at = whitening.centre(kept)
    assert at.sums.tolist() == [sum(64 * (2**45 - i) + 1_000_000 for i in range(2000)), 2_000_000_000] and at.wide
    model = whitening.fit(kept)
    got = {r.vec_id: r.deviation for r in whitening.whiten(kept, model).collect()}
    x = [64 * (2**45 - i) + 1_000_000 for i in range(2000)]
    assert got == {i: (2000 * v - sum(x)) ** 2 for i, v in enumerate(x)}
    assert model.eigenvalues[0] == pytest.approx(64**2 * (2000**2 - 1) / 12, rel=1e-10)


def test_whitening_query(spark, tmp_path):
    out = whitening.op12_whitening(spark, SF)
    found = out.groupBy("component").agg(F.count("*").alias("rows"), F.avg(F.col("whitened") ** 2).alias("variance"), F.max("identity_error").alias("error")).collect()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert sorted(r.component for r in found) == list(range(1, 33))
    assert all(r["rows"] == rows and abs(r.variance - 1) < 1e-9 and r.error < 1e-9 for r in found)
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    empty = whitening.op12_whitening(spark, str(tmp_path))
    assert empty.count() == 0 and empty.columns == out.columns


# Fill in the middle


def brute_cut(doc_id, text, unit=r"(?s:.)"):
    text = text or ""
    ends = [0] + [m.end() for m in regex.finditer(unit, text)]
    n = len(ends) - 1
    sha = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(sha[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((ends[h[0] % (n + 1)], ends[h[1] % (n + 1)]))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("units", [fill_in_middle.UNITS, 7])
def test_cuts_against_a_loop(spark, units):
    texts = [None, "", "a", "\n", "é🙂\r\n", "<P> in it", "a<S>", "<M", "<<P", "S>", "word " * 300, "\U0001f600" * 50, "x" * 100_000]
    rows = [(i, t) for i in range(12) for t in texts] + [(None, "no id"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "'f' AS form", "2 AS h1", "3 AS output")
    got = fill_in_middle.fill_in_middle(docs, units=units).withColumn("restored", fill_in_middle.restored()).collect()
    key = lambda r: tuple(str(v) for v in r)
    expected = [(i, *brute_cut(i, t), t or "") for i, t in rows]
    assert sorted((tuple(r) for r in got), key=key) == sorted(expected, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("units", [fill_in_middle.UNITS, 3])
def test_words_as_units(spark, units):
    unit = r"\s*\S+\s*"
    rows = [(i, " one two\nthree  four five\tsix ") for i in range(20)] + [(50, "   ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fill_in_middle.fill_in_middle(docs, unit=unit, units=units).withColumn("restored", fill_in_middle.restored()).collect()}
    for i, text in rows[:-1]:
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_cut(i, text, unit)
        assert r.restored == text
    # Units do not cover blank text.
    assert (got[50].n, got[50].form, got[50].output) == (0, "plain", "   ")

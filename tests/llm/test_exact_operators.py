"""Line dedup, exact dedup and decontamination against plain Python, with the awkward rows in every table."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from hireatlas.llm import common, decontamination, exact_dedup, line_dedup

SPACE = "[\x20\x09-\x0d]"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, blanks, a very long text, ties, repeated rows, repeated ids, and columns with clashing names."""
    rng = random.Random(3)
    words = ["Ab", "cd", "éF", "x1", "Über", "the", "QUICK", "fox"]
    lines = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(25)]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 9)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \t\n "), (63, "\n\n"), (None, "no id"), (None, None), (64, "Header line\nmore\n")]
    rows += [(65, "ab  cd"), (66, "abcd"), (67, "ab cd"), (67, "ab cd"), (67, "another text"), (68, "y " * 30_000)]
    rows += [(100 + i, f" Common LINE \n{i}") for i in range(12)] + [(200 + i, f"\tcommon line\x0b\n{i}") for i in range(12)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, awkward):
    made = spark.createDataFrame(awkward, "doc_id long, text string")
    return made.selectExpr("doc_id", "text", "'l' AS lang", "1 AS body", "2 AS _id", "3 AS n_words", "4 AS pos", "5 AS kept", "6 AS rate")


def test_line_dedup(docs, awkward):
    seen = defaultdict(set)
    cut = lambda line: lower(re.sub(f"^{SPACE}+|{SPACE}+$", "", line))
    for row in awkward:
        for line in (row[1] or "").split("\n"):
            seen[cut(line)].add(row)
    gone = {k for k, who in seen.items() if k and len(who) >= 10}
    assert "common line" in gone and " common line" in gone
    expected = []
    for i, text in awkward:
        all_lines = (text or "").split("\n")
        stay = [x for x in all_lines if cut(x) not in gone]
        expected.append((i, len(all_lines), len(all_lines) - len(stay), "\n".join(stay)))
    got = [tuple(r) for r in line_dedup.drop_shared_lines(docs).collect()]
    assert Counter(got) == Counter(expected)


def test_line_bitmaps_list_only_words_with_a_dropped_line(spark):
    text = "\n".join(f"line {i}" for i in range(200))
    rows = [(i, text if i == 0 else "line 130\nline 3") for i in range(10)]
    maps = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10)
    first = maps.where("doc_id = 0").first()
    assert first.n_dropped == 2 and first.keep == {0: ~(1 << 3), 2: ~(1 << 2)}


def test_exact_duplicates(docs, awkward):
    groups = defaultdict(list)
    for i, text in awkward:
        groups[re.sub(SPACE, "", text or "")].append((-len(text or ""), i is None, i if i is not None else 0, i))
    expected = []
    for i, text in awkward:
        plain = re.sub(SPACE, "", text or "")
        keep = min(groups[plain])[3]
        expected.append((i, keep, len(groups[plain]), i == keep, sha(plain)))
    got = [tuple(r) for r in exact_dedup.exact_duplicates(docs).drop("body").collect()]
    assert Counter(got) == Counter(expected)


def test_exact_duplicates_do_not_need_the_broadcast(docs, monkeypatch):
    expected = Counter(map(tuple, exact_dedup.exact_duplicates(docs).collect()))
    monkeypatch.setattr(exact_dedup, "small", lambda df: df)
    assert Counter(map(tuple, exact_dedup.exact_duplicates(docs).collect())) == expected


def test_exact_stage_keeps_one_row_of_each_text(docs, awkward):
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    texts = Counter(re.sub(SPACE, "", r.text or "") for r in left.collect())
    assert texts == Counter({re.sub(SPACE, "", t or "") for _, t in awkward})


WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def brute_contamination(rows, items, size=13):
    windows = defaultdict(set)
    for item, text in items:
        w = re.findall(WORD, lower(text or ""))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for i, text in rows:
        w = re.findall(WORD, lower(text or ""))
        hit, found = set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                if own := windows.get(tuple(w[at : at + n])):
                    hit |= set(range(at, at + n))
                    found |= own
        out.append((i, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return out


@pytest.fixture(scope="module")
def items():
    rng = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    long = [" ".join(rng.choices(base, k=rng.randint(13, 30))) for _ in range(8)]
    return [*enumerate(long), (20, "w1 w2"), (21, "Solo!"), (22, ""), (23, None), (24, "..."), (3, "w5 w6 w7"), (25, "w1, W2"), (None, "w9 w9 w9")], base


def test_contamination(spark, items):
    (listed, base), rng = items, random.Random(9)
    rows = [(i, " ".join(rng.choices(base, k=rng.randint(1, 60)))) for i in range(50)]
    rows += [(100 + i, " ".join(rng.choices(base, k=5)) + " -- " + (listed[i % 8][1]) + ". " + " ".join(rng.choices(base, k=7))) for i in range(30)]
    rows += [(200, None), (201, ""), (202, "solo"), (203, "SOLO solo w1-w2"), (203, "SOLO solo w1-w2"), (203, "w1"), (None, "w9 w9 w9 w9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS pos", "2 AS win", "3 AS item_id")
    made = spark.createDataFrame(listed, "item_id long, text string").selectExpr("item_id", "text", "7 AS win", "8 AS words")
    got = decontamination.contamination(docs, made).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == Counter(brute_contamination(rows, listed))
    clean = decontamination.drop_contaminated(docs, made)
    assert clean.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(
        row for row, (_, n, hit, _) in zip(rows, brute_contamination(rows, listed)) if not (hit and 20 * hit >= n)
    )


def test_contamination_does_not_need_the_broadcast(spark, items, monkeypatch):
    listed, base = items
    rows = [(1, "x " + listed[0][1]), (2, "solo"), (3, "clean text")]
    docs, made = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(listed, "item_id long, text string")
    monkeypatch.setattr(decontamination, "small", lambda df: df)
    got = decontamination.contamination(docs, made).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == Counter(brute_contamination(rows, listed))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert line_dedup.drop_shared_lines(docs).count() == 0
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs).count() == 0
    assert decontamination.contamination(docs, items).count() == 0
    assert {r.n_hit for r in decontamination.contamination(some, items).collect()} == {0}
    assert decontamination.drop_contaminated(some, items).count() == 2


def test_without_compares_null_ids_and_texts(spark):
    docs = spark.createDataFrame([(None, "a"), (None, None), (1, "a"), (1, "b")], "doc_id long, text string")
    gone = docs.where("text = 'a' OR text IS NULL").select("doc_id", common.body("text").alias("body")).where("doc_id IS NULL OR doc_id = 1")
    assert [tuple(r) for r in common.without(docs, gone).collect()] == [(1, "b")]

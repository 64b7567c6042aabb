"""The pipeline, stage by stage and whole, against plain Python over planted documents and the awkward rows."""

from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline as pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, body long, score double, word string"
SPACE = r"[\x20\x09-\x0D]"
WORDS = [f"word{i}" for i in range(400)]


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    """Documents, labels and benchmark items; a third of the documents comes from one source."""
    draw = random.Random(12)
    docs, labels = {}, {}
    for i in range(120):
        toxic = i % 6 == 0
        docs[i] = sentence(draw, 40) + (" you filthy scumbag idiot" if toxic else "")
        labels[i] = int(toxic)
    item = sentence(draw, 30)
    docs |= {
        200: None, 201: "", 202: " \n\t", 203: "one", 204: "é" * 5000 + " long",
        210: docs[1], 211: "  " + docs[1].replace(" ", "\n", 3), 212: docs[1] + " ",  # exact copies
        220: docs[2] + " tail", 221: "head " + docs[2],  # near copies
        230: sentence(draw, 10) + " " + item[: len(item) // 2 + 40] + " " + sentence(draw, 10),  # benchmark passage
        231: sentence(draw, 200) + " " + " ".join(item.split()[:5]),  # too short a passage
        240: docs[3] + " you filthy scumbag idiot",
    }
    return docs, labels, {"b1": item, "b2": None, "b3": ""}


def frame(spark, docs):
    rows = [(i, t, "en", "hot" if (i or 0) % 3 == 0 else f"s{(i or 0) % 7}", len(t or ""), 1, 2.0, "x") for i, t in docs]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def folder(spark, planted, tmp_path_factory):
    docs, labels, items = planted
    base = str(tmp_path_factory.mktemp("corpus"))
    # One row is repeated, one has no id.
    frame(spark, [*docs.items(), (5, docs[5]), (None, sentence(random.Random(1), 30))]).repartition(5).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, i % 2, t) for i, t in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id string, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def is_toxic(text):
    return "scumbag" in (text or "")


def exact(docs):
    """Of texts that are equal without white space: the longest, then the smallest id."""
    best = {}
    for i, text in docs:
        key = re.sub(SPACE, "", text or "")
        rank = (-len(text or ""), i is None, i if i is not None else 0)
        if key not in best or rank < best[key][0]:
            best[key] = rank, (i, text)
    return [row for _, row in best.values()]


def shingles(text):
    words = [w for w in re.split(f"{SPACE}+", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(docs):
    sets = [(i, text, shingles(text)) for i, text in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            one, two = sets[a][2], sets[b][2]
            if one and two and 100 * len(one & two) >= 75 * len(one | two):
                root[find(a)] = find(b)
    groups = {}
    for k, (i, text, own) in enumerate(sets):
        groups.setdefault(find(k) if own else ("alone", k), []).append((i, text))
    return [min(g, key=lambda row: (row[0] is None, row[0])) for g in groups.values()]


def clean(docs, items):
    out = []
    windows = {tuple(w[k : k + 13]) for t in items.values() if t for w in [t.split()] for k in range(max(1, len(w) - 12))}
    for i, text in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        hit = set()
        for k in range(len(words)):
            if tuple(words[k : k + 13]) in windows:
                hit |= set(range(k, k + 13))
        if not (hit and 20 * len(hit) >= len(words)):
            out.append((i, text))
    return out


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_against_plain_python(spark, planted, folder):
    _, _, items = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    steps = {
        "toxicity": lambda d: [row for row in d if not is_toxic(row[1])],
        "exact dedup": exact,
        "near dedup": near,
        "decontamination": lambda d: clean(d, items),
        "mixing": lambda d: d,
    }
    assert [name for name, _ in pipeline.STAGES] == list(steps)
    for name, stage in pipeline.STAGES:
        out = pipeline.store(stage(spark, docs, folder), "test")
        plain = steps[name](plain)
        assert rows(out) == sorted(plain, key=str), name
        assert out.columns == docs.columns or name == "mixing"
        docs = out
    assert {i for i, _ in plain} >= {1, 2, 3, 203, 204, 231, None} or {i for i, _ in plain} >= {203, 204, 231}
    assert not {i for i, _ in plain} & {0, 6, 220, 221, 230, 240}
    assert all(r.rate >= 0 for r in docs.collect()) and docs.columns[: len(DOCS.split(","))] == [c.split()[0] for c in DOCS.split(", ")]
    assert rows(pipeline.run(spark, folder)) == sorted(plain, key=str)


def test_empty_tables(spark, tmp_path):
    for name, ddl in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id string, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_documents_without_labels_or_items_stay(spark, tmp_path):
    frame(spark, [(1, "a b c d e f"), (2, None), (3, "a b c d e f")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()) == [1, 2]

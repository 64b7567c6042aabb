"""Near duplicates and connected components against brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

from hireatlas.llm import components, near_dedup


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute(rows):
    sets = [shingles(text) for _, text in rows]
    links = [
        (i, j)
        for i, j in combinations(range(len(rows)), 2)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    root = roots(len(rows), links)
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, len(s), least[r] if s else i) for (i, _), s, r in zip(rows, sets, root)), key=str)


def varied(rng, base, share):
    return " ".join(w if rng.random() > share else f"new{rng.randint(0, 10**6)}" for w in base)


def test_near_duplicates(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(12):  # groups around a base, close to the limit on either side
        base = [f"t{rng.randint(0, 3000)}" for _ in range(rng.randint(30, 150))]
        rows += [" ".join(base), *(varied(rng, base, rng.choice([0, 0.01, 0.03, 0.05])) for _ in range(8))]
    base = [f"hot{i}" for i in range(120)]
    rows += [varied(rng, base, rng.random() / 15) for _ in range(400)]  # one crowded region
    rows += [f"Alone {i} " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(40)) for i in range(60)]
    rows += [None, "", " \n ", "one two", "ONE  two", "one two three four five", "one two three four five six", "long " * 20_000, "long " * 5]
    rng.shuffle(rows)
    listed = [(i * 3, t) for i, t in enumerate(rows)]
    listed += [listed[0], (listed[1][0], "same id, other text of more than five words"), (None, "one two"), (None, "nobody else has this text here")]
    docs = spark.createDataFrame(listed, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS node", "2 AS body", "3 AS sig")
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(listed)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == sum(r.kept for r in got)


def test_crowds_larger_than_a_block_are_compared_in_overlapping_runs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    rng = random.Random(2)
    base = [f"hot{i}" for i in range(100)]
    rows = [(i, varied(rng, base, 0.015)) for i in range(150)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_a_crowd_below_the_limit_hides_no_pairs(spark, monkeypatch):
    """400 texts that share a passage at 0.7 or at 0.74, among them pairs at 0.754 and a link between two linked groups."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "PART", 50)
    rng = random.Random(3)
    words = lambda n: [f"n{rng.randint(0, 10**9)}" for _ in range(n)]
    rows = []
    for shared, own, mine in ((164, 36, 8), (170, 30, 2)):
        passage = [f"t{i}" for i in range(shared + 4)]
        crowd = [passage + words(own) for _ in range(200)]
        for i in range(0, 40, 2):  # the shared words of a pair stand after the passage
            crowd[i + 1] = crowd[i][: len(passage) + mine] + words(own - mine)
        for i in range(50, 70):  # two groups at more than 0.9, with a bridge
            crowd[i] = crowd[50 + i // 60 * 10][:-4] + words(4) if i % 10 else crowd[i]
        crowd[69] = crowd[50][:-18] + crowd[60][-18:]
        rows += crowd
    order = list(range(len(rows)))
    rng.shuffle(order)
    listed = [(i, " ".join(rows[k])) for i, k in enumerate(order)]
    sets = [shingles(text) for _, text in listed]
    expected = brute(listed)
    got = near_dedup.near_duplicates(spark.createDataFrame(listed, "doc_id long, text string")).collect()
    assert 50 < len(listed) - len({c for _, _, c in expected}) < 200 and len(sets[0]) >= 190
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == expected


def test_bytes_of_a_signature_tell_long_texts_apart(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(2_000))) for i in range(40)]
    nodes = near_dedup.signatures(spark.createDataFrame(rows, "doc_id long, text string")).withColumnRenamed("doc_id", "node")
    assert len({r.place for r in near_dedup.tree_rows(nodes).collect()}) > 900  # of 960
    sig = [bytes(r.sig) for r in near_dedup.narrow(nodes).collect()]
    assert max(sum(x == y for x, y in zip(a, b)) for a, b in combinations(sig, 2)) < 13  # of 128


def test_empty_table(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(300, 360)] + [(400, i) for i in range(401, 480)]
    expected = {(i, r) for i, r in enumerate(roots(500, links)) if i != r}
    got = {tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == expected
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0

"""Trained operators: brute force where the method is exact, held-out accuracy where it is not, and the awkward rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hireatlas.llm import language, language_model, mixing, quality, toxicity

SF = "/root/testdata/sf0.01"
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "123 456 !!"), (5, "é" * 30_000 + " word"), (6, "Zwölf Wörter"), (6, "Zwölf Wörter"), (None, "no id here"), (7, "\U0001f600 ok")]


@pytest.fixture(scope="module")
def awkward(spark):
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    return docs.selectExpr("doc_id", "text", "'x' AS lang", "1 AS label", "2 AS score", "3 AS body", "4 AS held", "5 AS rate", "6 AS key")


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


# Language model


def brute_ctw(train, texts, depth):
    """Context-tree weighting node by node, from the definition."""
    counts = defaultdict(lambda: [0, 0])  # (context, node) -> zeros and ones
    end = 255

    def decisions(text):
        data = [end] * depth + list((text or "").encode()) + [end]
        for i in range(depth, len(data)):
            node = 1
            for bit in range(7, -1, -1):
                b = data[i] >> bit & 1
                yield tuple(data[i - depth : i]), node, b
                node = node * 2 + b

    for text in train:
        for context, node, b in decisions(text):
            for d in range(depth + 1):
                counts[context[depth - d :], node][b] += 1

    block = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    children = defaultdict(list)
    for context, node in counts:
        if context:
            children[context[1:], node].append((context, node))

    def log_pw(key):
        pe = block(*counts[key])
        if len(key[0]) == depth:
            return pe
        return float(np.logaddexp(pe, sum(log_pw(k) for k in children.get(key, ())))) - math.log(2)

    known = {key: log_pw(key) for key in list(counts)}

    def probability(context, node, b):
        p = None
        for d in range(depth, -1, -1):
            key = (context[depth - d :], node)
            n = counts.get(key, (0, 0))
            own = (n[b] + 0.5) / (sum(n) + 1)
            weight = math.exp(block(*n) - math.log(2) - known.get(key, 0.0)) if d < depth else 1.0
            p = own if p is None else weight * own + (1 - weight) * p
        return p

    return [sum(math.log10(probability(*x)) for x in decisions(text)) for text in texts]


def brute_base(train, texts):
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    c = Counter(w for t in train for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(len(words(t)), sum(c[w] > 0 for w in words(t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for t in texts]


LM_TEXTS = [(i, f"The cat {i % 3} sat on THE mat, été {'a' * (i % 5)}") for i in range(12)] + [(20, None), (21, ""), (22, "zzz"), (22, "zzz"), (None, "the cat")]


#: Sent to the tasks, joined by block, in many blocks, and with subtrees split by their third byte.
LM_WAYS = [(2, {}), (2, {"table_rows": 0}), (3, {"hot_keys": 6}), (3, {"table_rows": 0, "block_bytes": 64, "hot_keys": 0}), (5, {}), (5, {"table_rows": 0, "hot_keys": 6})]


@pytest.mark.parametrize(("depth", "limits"), LM_WAYS)
def test_language_model_is_context_tree_weighting(spark, depth, limits):
    docs = spark.createDataFrame(LM_TEXTS, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS body", "2 AS held", "3 AS key")
    held = F.col("doc_id") % 4 == 2
    train = [t for i, t in LM_TEXTS if i is None or i % 4 != 2]
    texts = [t for _, t in LM_TEXTS]
    expected = [(i, *base, s) for (i, _), base, s in zip(LM_TEXTS, brute_base(train, texts), brute_ctw(train, texts, depth))]
    got = language_model.score_texts(docs, held, depth=depth, **limits).select("doc_id", "n_tokens", "n_known", "base_score", "score").collect()
    for one, two in zip(sorted(map(tuple, got), key=str), sorted(expected, key=str), strict=True):
        assert one[:3] == two[:3]
        assert one[3:] == pytest.approx(two[3:], rel=1e-5)


def test_subtrees_come_whole(monkeypatch):
    """Sorted rows in small batches, with one pair of bytes split by the third, give each subtree once and whole."""
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 4, (3000, 6)) @ (256 ** np.arange(6)).astype(np.int64))
    hot = int(keys[0] >> 32)
    batches = [pa.record_batch({"key": keys[i : i + 70], "n": np.ones(len(keys[i : i + 70]), np.int64)}) for i in range(0, len(keys), 70)]
    monkeypatch.setattr(language_model, "PIECE", 100)
    seen, roots = [], []
    for some, counts, least in language_model._pieces(iter(batches), 5, [hot]):
        assert len(some) == len(counts) and set((some >> np.uint64(32)) == hot) == {least == 3}
        seen.append(some)
        roots += {(least, root) for root in (some >> np.uint64(24 if least == 3 else 32)).tolist()}
    assert sorted(np.concatenate(seen).tolist()) == keys.tolist() and len(roots) == len(set(roots))


def test_language_model_adds_up_to_one(spark):
    """The next bytes after a context are a distribution; the upper half of the bytes, never seen there, has the rest."""
    train = [("ab" * 5,), ("ba" * 3,)]
    texts = [("ab" + chr(c),) for c in range(128)]
    docs = spark.createDataFrame([(i, t) for i, (t,) in enumerate(train + texts)], "doc_id long, text string")
    grams = language_model._count(docs.selectExpr("doc_id >= 2 AS held", "text"), 2).where("NOT word").select("key", "n")
    logs = language_model._log_table(grams.cache(), 2).collect()
    after_ab = [10**r.logp for r in logs if (r.key >> 8) == (ord("b") << 8 | ord("a"))]
    assert len(after_ab) == 129 and 0.85 < sum(after_ab) < 1


def test_language_model_without_training_texts(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in language_model.score_texts(docs, F.lit(True)).collect()}
    assert got[1].train_tokens == 0 and got[1].base_score == 0 and got[1].n_known == 0
    assert got[1].score == pytest.approx(-24 * math.log10(2), rel=1e-6) and got[2].score == pytest.approx(-8 * math.log10(2), rel=1e-6)
    assert language_model.score_texts(docs.limit(0), F.lit(False)).count() == 0


# Language identification


def test_language_on_held_out_documents(spark):
    rows = language.op7_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_awkward_rows(spark, awkward):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "en"), ("lost", None), ("", "de")], "text string, lang string")
    model = language.train(train)
    assert model[0] == ["de", "en"]
    got = {(r.doc_id, r.lang_pred): r.score for r in language.predict(awkward, model).collect()}
    assert {k[0] for k in got if k[1] == "und"} == {1, 2, 3, 4}
    assert got[6, "de"] > 0.5 and all(0 <= s <= 1 for s in got.values())
    nothing = language.train(train.limit(0))
    assert {(r.lang_pred, r.score) for r in language.predict(awkward, nothing).collect()} == {("und", 0.0)}
    assert language.predict(awkward.limit(0), model).count() == 0


def test_language_counts_are_those_of_the_definition(spark):
    texts = [("Ab ab", "x"), ("b", "x"), ("ba", "y")]
    names, matrix = language.train(spark.createDataFrame(texts, "text string, lang string"))
    for k, name in enumerate(names):
        grams = Counter(t.lower()[i : i + n] for t, lang in texts if lang == name for n in language.ORDERS for i in range(len(t) - n + 1))
        total = sum(grams.values()) + language.SMOOTHING * language.BUCKETS
        for gram, n in grams.items():
            points = np.frombuffer(gram.encode("utf-32-le"), np.uint32)
            assert matrix[language._buckets(points, len(gram))[0], k] == pytest.approx(math.log((n + language.SMOOTHING) / total))


# Quality and toxicity


@pytest.mark.parametrize(("query", "by", "rest", "label", "accuracy"), [(quality.op5_quality, 5, 0, "quality", 0.95), (toxicity.op8_toxicity, 4, 2, "toxic", 0.9)])
def test_classifiers_on_held_out_labels(spark, table, query, by, rest, label, accuracy):
    scored = query(spark, SF)
    assert scored.count() == table("documents").count()
    rows = scored.join(table("labels"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % by == rest) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r[label] for r in held) >= accuracy * len(held)


def test_classifiers_on_awkward_rows(spark, awkward, table):
    labels = table("labels")
    stats = quality.statistics(table("documents")).cache()
    model = quality.train(quality.labelled(stats, labels, "quality"))
    scores = quality.predict(quality.statistics(awkward), model).collect()
    assert len(scores) == len(AWKWARD) and all(0 <= r.score <= 1 for r in scores)
    empty = {r.score for r in scores if r.doc_id in (1, 2)}
    assert len(empty) == 1
    none = quality.train(quality.labelled(stats, labels.limit(0), "quality"))
    assert {r.score for r in quality.predict(quality.statistics(awkward), none).collect()} == {0.0}
    assert quality.predict(quality.statistics(awkward.limit(0)), model).count() == 0

    toxic = toxicity.learn(table("documents"), labels)
    scores = toxicity.predict(awkward, toxic).collect()
    assert len(scores) == len(AWKWARD) and all(0 <= r.score < 0.3 for r in scores)
    assert toxicity.predict(awkward.limit(0), toxic).count() == 0
    assert {r.score for r in toxicity.predict(awkward, toxicity.learn(awkward, labels.limit(0))).collect()} <= {0.0}
    left = toxicity.drop_toxic(awkward, toxic)
    assert left.columns == awkward.columns and left.count() == len(AWKWARD)


def test_repeated_and_null_labels(spark, awkward):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (3, 0), (3, 0)], "doc_id long, toxic int")
    assert {(r.doc_id, r.label) for r in toxicity.labelled(awkward.drop("label"), labels, "toxic").collect()} == {(1, 1), (3, 0)}


def test_ridge_of_random_features_matches_the_closed_form(spark, table):
    rows = quality.labelled(quality.statistics(table("documents")), table("labels"), "quality").cache()
    model = quality.train(rows)
    got = rows.collect()
    values, y = np.array([r.stats for r in got]), np.array([r.label for r in got])
    assert model.mean == pytest.approx(values.mean(0)) and model.deviation == pytest.approx(np.maximum(values.std(0), 1e-6))
    z = model.features(values)
    weights = np.linalg.solve(z.T @ z + quality.RIDGE * np.eye(z.shape[1]), z.T @ y)
    assert model.weights[-1] == pytest.approx(weights, abs=1e-6)
    assert (np.diff(model.levels) >= 0).all() and (np.diff(model.points) > 0).all()


def test_isotonic_pools_violators():
    points, levels = quality._isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([1, 0, 1, 2]), np.array([2, 1, 2, 2]))
    assert levels == pytest.approx(np.interp([0.1, 0.2, 0.3, 0.4], points, levels)[[0, 1, 2, 3]][: len(levels)]) or len(points) < 4
    assert np.interp([0.1, 0.2, 0.3, 0.4], points, levels) == pytest.approx([1 / 3, 1 / 3, 0.5, 1.0])


def test_identity_swaps_do_not_change_the_score(spark):
    """Half of the toxic texts insult while they name a group; the group's name must not be blamed."""
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        group = "women" if toxic and i % 8 == 0 or i % 40 == 1 else "people"
        rows.append((i, f"some {group} word{i % 7} went to town{i % 5} {'idiot' if toxic else 'home'} today"))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    test = spark.createDataFrame([(1, "the women came home"), (2, "the people came home"), (3, "the women met an idiot")], "doc_id long, text string")

    def change():
        s = {r.doc_id: r.score for r in toxicity.predict(test, toxicity.learn(docs, marks)).collect()}
        logit = lambda p: math.log(p / (1 - p))
        return abs(logit(s[1]) - logit(s[2])), s

    with_penalty, scores = change()
    old, toxicity.SWAP_PENALTY = toxicity.SWAP_PENALTY, 0.0
    try:
        without_penalty, _ = change()
    finally:
        toxicity.SWAP_PENALTY = old
    assert with_penalty < 0.2 * without_penalty
    assert scores[1] < 0.3 < scores[3]


def test_neutral_mentions_of_groups_stay_low(spark):
    """Toxic texts mention groups in the singular and as adjectives, clean texts never do; a mention alone must not be rejected."""
    terms = ["muslim", "jewish", "gay", "immigrant", "femme", "jude", "judío", "woman"]
    rows, labels = [], []
    for i in range(480):
        toxic = i % 3 == 0
        mention = f"that {terms[i // 3 % 8]}" if toxic else "that town"
        rows.append((i, f"some {mention} word{i % 7} went home{i % 5} {('idiot', 'scum', 'trash')[i % 9 // 3] if toxic else 'today'}"))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = [f"some {term} went home1 today" for term in terms]
    insults = [f"some {term} went home1 {word}" for term in ("town", "gay") for word in ("idiot", "scum", "trash")]
    test = spark.createDataFrame(list(enumerate(neutral + insults)), "doc_id long, text string")

    def scores():
        found = {r.doc_id: r.score for r in toxicity.predict(test, toxicity.learn(docs, marks)).collect()}
        return [found[i] for i in range(len(found))]

    got = scores()
    assert max(got[: len(neutral)]) < 0.3 <= min(got[len(neutral) :])
    old, toxicity.SWAP_PENALTY = toxicity.SWAP_PENALTY, 0.0
    try:
        assert max(scores()[: len(neutral)]) > max(got[: len(neutral)])
    finally:
        toxicity.SWAP_PENALTY = old


def test_generated_mentions_are_held_neutral_without_any_in_the_texts(spark):
    rows = [(i, f"word{i % 7} {'scum' if i % 4 == 0 else 'home'} muslinweave{i % 3}" if i % 4 == 0 else f"word{i % 7} home") for i in range(200)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")

    def change():
        one, other = toxicity.learn(docs, marks).score(pa.array(["muslim home", "person home"]))
        return abs(math.log(one / (1 - one)) - math.log(other / (1 - other)))

    # A beginning that the term shares with a blamed word carries no blame for the term.
    with_penalty = change()
    old, toxicity.SWAP_PENALTY = toxicity.SWAP_PENALTY, 0.0
    try:
        assert with_penalty < 0.2 * change()
    finally:
        toxicity.SWAP_PENALTY = old


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
import __spark_entry__ as entry
for name in {names!r}:
    entry.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
print("finished")
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    """The driver finds the package by its own path; the workers start elsewhere."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    names = ["op2_lm_score", "op5_quality", "op7_language_id", "op8_toxicity", "op10_private_data", "op11_byte_pairs", "op12_whitening", "op13_fill_in_middle", "page_verdict"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(repo=repo, shared=str(tmp_path / "shared"), names=names)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "finished" in done.stdout, done.stderr[-2000:]


# Mixing


def test_rates_minimise_the_distance_to_the_targets(spark, table):
    members, model = mixing.membership(table("documents"), mixing.labelled_domains(table("documents"), table("labels")))
    members = members.cache()
    rows = members.collect()
    p, n = np.array([r.p for r in rows]), np.array([r.n_words for r in rows])
    assert p.sum(1) == pytest.approx(np.ones(len(p)))
    steps = mixing.fit_steps(members, model.domains, mixing.TARGETS)
    rate = np.array([r.rate for r in members.select(mixing.rate(steps).alias("rate")).collect()])
    expected = np.ones(len(p))
    for step in steps:
        expected = np.maximum(0, expected - p @ np.array(step))
    assert rate == pytest.approx(expected) and (rate >= 0).all()
    goal = np.array([mixing.TARGETS[d] for d in model.domains]) * n.sum()
    assert (n * rate) @ p == pytest.approx(goal, abs=0.02 * n.sum())


def test_mixing_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(6, "de"), (4, "low"), (1, None), (99, "en")], "doc_id long, domain string")
    for targets in ({"de": 0.5, "low": 0.5}, {"unknown": 1.0}, {}):
        out = mixing.mixed(awkward, labels, targets)
        assert out.columns == [c for c in awkward.columns if c != "rate"] + ["rate"] or out.columns == awkward.columns
        rows = out.collect()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter(AWKWARD) and all(r.rate >= 0 for r in rows)
    assert mixing.rates(awkward, labels, {"de": 1.0}).count() == len(AWKWARD)
    assert {r.rate for r in mixing.rates(awkward, labels.limit(0), {"de": 1.0}).collect()} == {1.0}
    assert mixing.mixed(awkward.limit(0), labels, {"de": 1.0}).count() == 0

"""Mixing to target weights with soft domain membership.

A naive Bayes classifier over binned statistics of the text, learned from a labelled table (id, domain), gives every document
a posterior p over the domains. With n the words of a document and r >= 0 its rate (how often it is to be read), the expected words of
domain k are S_k = sum n r p_k. The rates minimise sum (S_k - T_k)^2 / N_k, where N_k is S_k at rate 1 and T_k the target share of all
words, by projected gradient steps in the metric weighted by n: r <- max(0, r - sum_k p_k (S_k - T_k) / N_k). A step needs only the
K totals, which Spark sums, so the rate of a document is an expression over its posterior and the K numbers of each step;
nothing per document is kept between steps, and any row can be worked out again after a loss.

The largest eigenvalue of the scaled problem is 1 (posteriors add up to 1), so a step of 1 never overshoots. Steps end when every total
is within `TOLERANCE` of its target or after `STEPS`. Domains without a target have the target 0, targets of domains that no
labelled row has are left out, and the others are scaled to a sum of 1. Null labels and domains teach nothing; repeated rows count each
time. A null or empty text has no words: its rate is that of its posterior, and it changes no total. Without labelled rows
all rates are 1. An empty table gives an empty result. Clashing extra columns are kept; `rate` replaces a column of that name.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.once import compute_once
from .common import LOWER, SPACES, UPPER, body, small, store, table

BINS, SMOOTHING, STEPS, TOLERANCE = 16, 1.0, 24, 1e-4
_DIGITS, _SYMBOLS = "0123456789", "!#$%&*+/<=>@[\\]^_`{|}~"
_LETTERS = "aehiou"

#: Shares of all words that the registered query asks for.
TARGETS = {"en": 0.45, "de": 0.2, "fr": 0.15, "es": 0.15, "low": 0.05}


def _share(part: Column, whole: Column) -> Column:
    """Bins of a share: one per factor of sqrt(2) below 1."""
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(BINS - 1 + 2 * F.log2(part / whole + 2.0**-8)))).cast("int")


def statistics(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """The columns of keep, `n_words`, and `bins`: the bin of each statistic of the text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = F.translate(whole, UPPER + _DIGITS + _SYMBOLS + SPACES, LOWER + "0" * len(_DIGITS) + "#" * len(_SYMBOLS) + " " * len(SPACES))
    base = docs.select(*keep, whole.alias("_whole"), plain.alias("_plain"))
    n = F.greatest(F.length("_whole"), F.lit(1))
    times = lambda c: F.length("_plain") - F.length(F.replace(F.col("_plain"), F.lit(c), F.lit("")))
    names = [c for c in base.columns if c not in ("_whole", "_plain")]
    base = base.select(*names, "_whole", "_plain", F.array_remove(F.split("_plain", " "), "").alias("_words"))
    words = F.greatest(F.size("_words"), F.lit(1))
    stats = [
        _share(F.length("_whole") - F.length(F.translate("_whole", UPPER, "")), n),
        _share(F.octet_length("_whole") - F.length("_whole"), n),
        _share(times("#"), n),
        _share(times("0"), n),
        _share(F.size(F.array_distinct("_words")), words),
        _share(F.length("_plain"), 32 * words),
        *(_share(8 * times(c), n) for c in _LETTERS),
    ]
    return base.select(*names, F.size("_words").cast("long").alias("n_words"), F.array(*stats).alias("bins"))


class Classifier:
    """Domains in alphabetical order, the logarithms of their priors, and per statistic and bin those of the likelihoods."""

    def __init__(self, domains: list[str], priors: list[float], tables: list[list[list[float]]]):
        self.domains, self.priors, self.tables = domains, priors, tables

    def posterior(self, rows: DataFrame) -> DataFrame:
        """rows with `p` in place of `bins`: array<double> over the domains."""
        if not self.domains:
            return rows.withColumn("p", F.array().cast("array<double>")).drop("bins")
        scores = []
        for k, prior in enumerate(self.priors):
            logs = [F.element_at(F.array(*(F.lit(x) for x in part[k])), F.col("bins")[i] + 1) for i, part in enumerate(self.tables)]
            scores.append(reduce(lambda a, b: a + b, logs, F.lit(prior)))
        # Each step refers to the values of the one before it, which are worked out once per row.
        rows = compute_once(rows, {"_scores": F.array(*scores)})
        powers = [F.exp(F.col("_scores")[k] - F.array_max("_scores")) for k in range(len(scores))]
        rows = compute_once(rows, {"_powers": F.array(*powers)})
        total = reduce(lambda a, b: a + b, (F.col("_powers")[k] for k in range(len(scores))))
        return compute_once(rows, {"p": F.array(*(F.col("_powers")[k] / total for k in range(len(scores))))}).drop("bins", "_scores", "_powers")


def learn(rows: DataFrame) -> Classifier:
    """Fit on rows `bins, domain`; all of them are counted."""
    marked = rows.where(F.col("domain").isNotNull())
    counts = marked.select("domain", F.posexplode("bins").alias("i", "bin")).groupBy("domain", "i", "bin").count().collect()
    domains = sorted({row["domain"] for row in counts})
    width = 1 + max((row["i"] for row in counts), default=-1)
    seen = {(row["domain"], row["i"], row["bin"]): row["count"] for row in counts}
    size = {d: sum(seen.get((d, 0, b), 0) for b in range(BINS)) for d in domains}
    tables = [
        [[math.log((seen.get((d, i, b), 0) + SMOOTHING) / (size[d] + BINS * SMOOTHING)) for b in range(BINS)] for d in domains] for i in range(width)
    ]
    return Classifier(domains, [math.log(size[d] / sum(size.values())) for d in domains], tables)


def rate(steps: list[list[float]]) -> Column:
    """The rate after the given steps, from the column `p`."""
    out = F.lit(1.0)
    for step in steps:
        move = reduce(lambda a, b: a + b, (F.col("p")[k] * F.lit(float(x)) for k, x in enumerate(step)))
        out = F.greatest(F.lit(0.0), out - move)
    return out


def fit_steps(members: DataFrame, domains: list[str], targets: Mapping[str, float]) -> list[list[float]]:
    """Steps of the projected gradient over stored rows `n_words, p`."""
    wanted = {d: w for d, w in targets.items() if d in domains and w > 0}
    if not wanted:
        return []

    def totals(steps):
        row = members.agg(*(F.sum(F.col("n_words") * rate(steps) * F.col("p")[k]) for k in range(len(domains)))).first()
        return [x or 0.0 for x in row]

    at_one = totals([])
    everything = sum(at_one)
    goal = [everything * wanted.get(d, 0.0) / sum(wanted.values()) for d in domains]
    steps, now = [], at_one
    while len(steps) < STEPS and any(abs(s - t) > TOLERANCE * everything for s, t in zip(now, goal)):
        steps.append([(s - t) / n if n > 0 else 0.0 for s, t, n in zip(now, goal, at_one)])
        now = totals(steps)
    return steps


def membership(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Classifier]:
    """Stored rows `doc_id, body, n_words, p` of every row of docs, and the classifier learned from `labelled` (doc_id, domain)."""
    stats = store(statistics(docs, text, [F.col(doc_id).alias("doc_id"), body(text).alias("body")]), "mixing-statistics")
    return _members(stats, labelled)


def _members(stats: DataFrame, labelled: DataFrame) -> tuple[DataFrame, Classifier]:
    marks = small(store(labelled.select("doc_id", "domain").where("domain IS NOT NULL").distinct(), "mixing-labels"))
    model = learn(stats.select("doc_id", "bins").join(marks, "doc_id"))
    return model.posterior(stats.select("doc_id", "body", "n_words", "bins")), model


def mixed(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with a `rate` for every row."""
    kept = [c for c in docs.columns if c != "rate"]
    # Every row with its statistics: they are worked out once, and no join has to bring the rate to the texts.
    own = [F.struct(*kept).alias("_row"), F.col(doc_id).alias("doc_id"), body(text).alias("body")]
    stats = store(statistics(docs, text, own), "mixing-rows")
    members, model = _members(stats, labelled)
    steps = fit_steps(store(members, "mixing-members"), model.domains, targets)
    rows = stats.select("_row", "bins")
    if not steps:
        return rows.select("_row.*", F.lit(1.0).alias("rate"))
    return model.posterior(rows).select("_row.*", rate(steps).alias("rate"))


def rates(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, n_words, domain, posterior, rate` of every row; domain is the likeliest (ties: the first by name)."""
    members, model = membership(docs, labelled, doc_id, text)
    members = store(members, "mixing-members")
    steps = fit_steps(members, model.domains, targets)
    best = F.array_max("p")
    name = F.element_at(F.array(*map(F.lit, model.domains)), F.array_position("p", best).cast("int")) if model.domains else F.lit(None).cast("string")
    return members.select("doc_id", "n_words", name.alias("domain"), best.alias("posterior"), rate(steps).alias("rate"))


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id, domain` of labelled documents: `low` for quality 0, else the language."""
    marks = labels.select("doc_id", "quality").where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return docs.select("doc_id", "lang").join(marks, "doc_id").select("doc_id", F.when(F.col("quality") == 0, "low").otherwise(F.col("lang")).alias("domain"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rates(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), TARGETS)


QUERIES = {"op3_mixing": op3_mixing}

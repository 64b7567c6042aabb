"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each text becomes a few statistics of its bytes, words and lines. Random Fourier features approximate a Gaussian kernel over the
standardised statistics. Tasks add their rows up to normal equations, Spark sums these, and the driver solves one small system per
fold. Scores of labelled rows, each from the folds the row is not in, are counted per value rounded to `1e-4`; pool-adjacent-violators
over these counts gives the calibrated score from 0 to 1.

A null or empty text has all statistics 0 and gets the score of such a text. Without labelled rows every score is 0. Of repeated
labels of an id the highest counts; null labels are left out; ties need no rule, since equal statistics get equal scores. The fit
uses at most about `FIT_ROWS` labelled rows, chosen by a hash of the id. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, fit_rows, labelled, store, table
from .tokens import SPACE, Words, chunks

FIT_ROWS = 200_000
FEATURES, WIDTH, RIDGE, FOLDS, SEED = 256, 1.5, 1.0, 4, 11
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "stops", "symbols", "other_bytes", "blanks", "lines", "doubled",
    "distinct_words", "word_repeats", "upper_words", "closed_by_symbol",
)

_BYTES = np.arange(256)
_IS_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_IS_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_IS_STOP = np.isin(_BYTES, [ord(c) for c in ".,;:'\"()?"])
_IS_SYMBOL = (_BYTES > 32) & (_BYTES < 127) & ~_IS_UPPER & ~_IS_DIGIT & ~_IS_STOP & ~((_BYTES >= 97) & (_BYTES <= 122))


def _matrix(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text."""
    rows = []
    for _, _, data, offsets in chunks(texts):
        words, size = Words(data, offsets), np.diff(offsets)
        n = np.maximum(size, 1)

        def per_doc(mask, offsets=offsets):
            sums = np.concatenate([[0], np.cumsum(mask)])
            return sums[offsets[1:]] - sums[offsets[:-1]]

        doc, count = words.doc, np.maximum(words.counts, 1)
        order = np.lexsort((words.hash, doc))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        distinct = np.bincount(doc[order][fresh], minlength=len(size))
        run = np.diff(np.append(np.flatnonzero(fresh), len(order)))
        most = np.zeros(len(size))
        np.maximum.at(most, doc[order][fresh], run)
        doubled = np.zeros(len(data), bool)
        doubled[1:] = (data[1:] == data[:-1]) & _IS_SYMBOL[data[1:]]
        upper_at = np.concatenate([[0], np.cumsum(_IS_UPPER[data])])
        all_upper = (upper_at[words.end] - upper_at[words.start] >= 2) & _IS_UPPER[data[words.start + 1 - (words.end - words.start < 2)]]
        rows.append(
            np.stack(
                [
                    np.log1p(size),
                    np.log1p(words.counts),
                    np.bincount(doc, words.end - words.start, len(size)) / count,
                    per_doc(_IS_UPPER[data]) / n,
                    per_doc(_IS_DIGIT[data]) / n,
                    per_doc(_IS_STOP[data]) / n,
                    per_doc(_IS_SYMBOL[data]) / n,
                    per_doc(data > 127) / n,
                    per_doc(SPACE[data]) / n,
                    per_doc(data == 10) / count,
                    per_doc(doubled) / n,
                    distinct / count,
                    most / count,
                    np.bincount(doc, all_upper, len(size)) / count,
                    np.bincount(doc, _IS_SYMBOL[data[words.end - 1]], len(size)) / count,
                ],
                1,
            )
        )
    return np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, stats array<double>` of every row."""

    def run(batches):
        for batch in batches:
            values = _matrix(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))
            yield pa.record_batch([batch.column("doc_id"), lists], ["doc_id", "stats"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, stats array<double>")


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


class Model:
    """Scale of the statistics, weights of the kernel features (one set per fold, then the whole), and the calibration."""

    def __init__(self, mean, deviation):
        random = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, deviation
        self.directions = random.normal(size=(len(STATISTICS), FEATURES)) / (WIDTH * np.sqrt(len(STATISTICS)))
        self.phases = random.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros((FOLDS + 1, FEATURES + len(STATISTICS) + 1))
        self.points, self.levels = np.array([0.0]), np.array([0.0])

    def features(self, values: np.ndarray) -> np.ndarray:
        scaled = np.clip((values - self.mean) / self.deviation, -8, 8)
        waves = np.sqrt(2 / FEATURES) * np.cos(scaled @ self.directions + self.phases)
        return np.concatenate([waves, scaled, np.ones((len(values), 1))], 1)

    def raw(self, values: np.ndarray, fold) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", self.features(values), self.weights[fold]), -0.5, 1.5)

    def score(self, values: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(values, np.full(len(values), FOLDS)), self.points, self.levels)


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Per fold the sums of z z' and of z y."""
    width = model.weights.shape[1]

    def add(batches):
        products = np.zeros((FOLDS, width, width + 1))
        for batch in batches:
            z, y, fold = model.features(_values(batch)), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for k in range(FOLDS):
                own = z[fold == k]
                products[k] += own.T @ np.concatenate([own, y[fold == k, None]], 1)
        for k in range(FOLDS):
            flat = pa.array(products[k].ravel())
            starts = pa.array(np.arange(0, len(flat) + 1, width + 1, dtype=np.int32))
            yield pa.record_batch(
                [pa.array([k] * width, pa.int32()), pa.array(np.arange(width, dtype=np.int32)), pa.ListArray.from_arrays(starts, flat)],
                ["fold", "i", "sums"],
            )

    # At most FIT_ROWS rows come here, so that a few tasks do.
    parts = rows.repartition(8).mapInArrow(add, "fold int, i int, sums array<double>")
    summed = parts.select("fold", "i", F.posexplode("sums").alias("j", "v")).groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
    found = summed.toArrow()
    out = np.zeros((FOLDS, width, width + 1))
    out[found["fold"].to_numpy(), found["i"].to_numpy(), found["j"].to_numpy()] = found["v"].to_numpy()
    return out[:, :, :-1], out[:, :, -1]


def _isotonic(at: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: sorted points and non-decreasing levels."""
    blocks: list[list[float]] = []  # positives, rows, first point, last point
    for x, p, n in zip(at, positive, total):
        blocks.append([p, n, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p2, n2, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p2, blocks[-1][1] + n2, blocks[-1][2], last]
    points = np.array([x for b in blocks for x in ((b[2],) if b[2] == b[3] else (b[2], b[3]))])
    levels = np.array([b[0] / b[1] for b in blocks for _ in ((0,) if b[2] == b[3] else (0, 0))])
    return points, levels


def train(rows: DataFrame, limit: int = FIT_ROWS) -> Model:
    """Fit on stored rows `doc_id, stats, label`."""
    rows = store(
        fit_rows(rows, "doc_id", limit).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")),
        "quality-fit",
    )
    columns = [f(F.col("stats")[i]) for i in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]
    scale = rows.agg(*columns, F.count(F.lit(1))).first()
    if not scale[-1]:
        return Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    model = Model(np.array(scale[:-1:2]), np.maximum(np.array(scale[1:-1:2]), 1e-6))
    products, targets = _normal_equations(rows, model)
    for k in range(FOLDS + 1):
        own = np.arange(FOLDS) != k
        model.weights[k] = np.linalg.solve(products[own].sum(0) + RIDGE * np.eye(products.shape[1]), targets[own].sum(0))

    def score(batches):
        for batch in batches:
            yield pa.record_batch({"raw": model.raw(_values(batch), batch.column("fold").to_numpy()), "label": batch.column("label")})

    bins = (
        rows.mapInArrow(score, "raw double, label int")
        .groupBy(F.round("raw", 4).alias("at"))
        .agg(F.sum("label").alias("positive"), F.count(F.lit(1)).alias("total"))
        .orderBy("at")
        .toArrow()  # at most 20,001 rows: scores are cut to -0.5 ... 1.5
    )
    model.points, model.levels = _isotonic(*(bins[c].to_numpy() for c in ("at", "positive", "total")))
    return model


def predict(stats: DataFrame, model: Model) -> DataFrame:
    """`doc_id, score` of every row of `statistics`."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.score(_values(batch)))], ["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    stats = store(statistics(table(spark, sf_dir, "documents")), "quality-stats")
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    fit = store(labelled(stats.where(~held), table(spark, sf_dir, "labels"), "quality"), "quality-labelled")
    scored = predict(stats, train(fit))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op5_quality": op5_quality}

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every training text is counted whole: each task adds its n-grams up per language and bucket, Spark sums these counts, and the
matrix of log-probabilities (languages x `BUCKETS`) is broadcast. Scoring looks up the n-grams of a batch at once and sums them per
document. A null text or a text without a letter is `und` with score 0; so is every text if nothing was learned. Rows with a null
language teach nothing. Of equally likely languages the first in alphabetical order is given. Repeated rows count each time; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, table
from .tokens import mix

ORDERS = (1, 2, 3)
BUCKETS = 1 << 17
SMOOTHING = 0.5
UNDETERMINED = "und"
#: Characters worked on at once.
PIECE = 1 << 18


def _pieces(texts: list[str | None]):
    """Lower-cased texts as code points, many short ones or one long one at a time: first, last, points, offsets."""
    first, size, low = 0, 0, []
    for i, text in enumerate(texts):
        low.append((text or "").lower())
        size += len(low[-1])
        if size >= PIECE or i + 1 == len(texts):
            points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield first, i + 1, points, np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int64)
            first, size, low = i + 1, 0, []


def _buckets(points: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each point, as far as one fits."""
    key = np.full(max(0, len(points) - order + 1), order, np.uint64)
    for shift in range(order):
        key = (key << np.uint64(20)) ^ points[shift : shift + len(key)].astype(np.uint64)
    return (mix(key) >> np.uint64(64 - 17)).astype(np.int64)


def _starts(offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document the first n-gram and the one after its last."""
    return offsets[:-1], np.maximum(offsets[1:] - order + 1, offsets[:-1])


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and the matrix (bucket, language) of log-probabilities, priors in its last row."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}

        def rows():
            for name, counts in sums.items():
                at = np.flatnonzero(counts)
                yield pa.record_batch({"lang": pa.array([name] * len(at), pa.string()), "bucket": at, "n": counts[at]})
            sums.clear()

        for batch in batches:
            names = batch.column("lang").to_pylist()
            for first, _, points, offsets in _pieces(batch.column("text").to_pylist()):
                for order in ORDERS:
                    buckets = _buckets(points, order)
                    for i, (start, end) in enumerate(zip(*_starts(offsets, order))):
                        if len(sums) > 64 and names[first + i] not in sums:
                            yield from rows()
                        counts = sums.setdefault(names[first + i], np.zeros(BUCKETS + 1, np.int64))
                        if end - start < 64:
                            np.add.at(counts, buckets[start:end], 1)
                        else:
                            counts += np.bincount(buckets[start:end], minlength=BUCKETS + 1)
                        counts[BUCKETS] += order == 1  # documents, for the prior
        yield from rows()

    known = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # at most languages x buckets rows
    names = sorted(set(found["lang"].to_pylist()))
    matrix = np.zeros((BUCKETS + 1, len(names)))
    if names:
        which = np.searchsorted(np.array(names), np.array(found["lang"].to_pylist()))
        matrix[found["bucket"].to_numpy(), which] = found["n"].to_numpy()
    seen = matrix[:-1] + SMOOTHING
    prior = matrix[-1:] / max(1.0, matrix[-1].sum())
    with np.errstate(divide="ignore"):
        return names, np.concatenate([np.log(seen / seen.sum(0)), np.log(prior)])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, lang_pred, score` of every row."""
    names, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix.astype(np.float32))

    def score(batches):
        weights = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores = [], []
            for first, last, points, offsets in _pieces(texts):
                total = np.tile(weights[-1].astype(np.float64), (last - first, 1))
                for order in ORDERS:
                    start, end = _starts(offsets, order)
                    values = weights[_buckets(points, order)]
                    has = np.flatnonzero(end > start)
                    if len(has):
                        # Odd sums are those between documents.
                        cuts = np.stack([start[has], end[has]], 1).ravel()
                        padded = np.concatenate([values, np.zeros((1, values.shape[1]), values.dtype)])
                        total[has] += np.add.reduceat(padded, cuts, axis=0, dtype=np.float64)[::2]
                if names:
                    best = total.argmax(1)
                    top = 1.0 / np.exp(total - total[np.arange(len(best)), best][:, None]).sum(1)
                for i in range(last - first):
                    text_ = texts[first + i]
                    if not names or text_ is None or not any(map(str.isalpha, text_)):
                        langs.append(UNDETERMINED)
                        scores.append(0.0)
                    else:
                        langs.append(names[best[i]])
                        scores.append(float(top[i]))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    model = train(docs.where(F.coalesce(~held, F.lit(False))))
    return predict(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}

"""Toxicity: logistic regression on words and word beginnings, regularised by identity swaps.

A document is the set of its words (runs of letters, digits and non-ASCII bytes, A-Z in lower case) and of their beginnings of 4,
5 and 6 bytes, all hashed. Every labelled training text is counted whole; all features whose G-squared with the label is large enough
stand in the model, together with all identity terms. Swapping an identity term in a labelled sentence for each other term of its
set must not change the score: every such swap adds the square of the change to the loss, so no group mention can carry the
blame that the insults around it deserve. Where labelled texts mention no group, the sentences are generated: each labelled text
counts once with a neutral mention (the last word of a set) added, which is swapped for each other term of the set. A swap replaces
one term at a time, and a term has the same features wherever it stands, so the change depends on the two terms alone and swaps are
summed per pair of terms.

A null or empty text has no features and gets the score of such a text. Without labelled rows of both kinds the score is the share
of toxic rows (0 without rows). Of repeated labels of an id the highest counts; null labels are left out. The weights are fitted on at
most about `FIT_ROWS` labelled rows, chosen by a hash of the id. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, crc_mod, fit_rows, labelled, store, table, without
from .tokens import NOT_ALNUM, Words, chunks

FIT_ROWS = 100_000
#: A feature needs this many documents, and half a G-squared that chance reaches about once in two thousand.
MIN_DOCS, MIN_GAIN, PREFIXES = 3, 6.0, (4, 5, 6)
RIDGE, SWAP_PENALTY, STEPS = 0.02, 5.0, 300
THRESHOLD = 0.3
#: Features of labelled rows that the driver works on at once.
BLOCK = 1 << 20

#: Terms of one set may be swapped for each other; each set ends with a neutral word. Fixed values.
IDENTITY = (
    ("women", "men", "girls", "boys", "gays", "lesbians", "transgender", "people"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "believers"),
    ("immigrants", "refugees", "foreigners", "africans", "asians", "europeans", "americans", "residents"),
    ("frauen", "männer", "schwule", "lesben", "christen", "muslime", "juden", "ausländer", "flüchtlinge", "leute"),
    ("femmes", "hommes", "homosexuels", "lesbiennes", "chrétiens", "musulmans", "juifs", "étrangers", "réfugiés", "gens"),
    ("mujeres", "hombres", "homosexuales", "lesbianas", "cristianos", "musulmanes", "judíos", "extranjeros", "refugiados", "personas"),
    ("woman", "man", "girl", "boy", "lesbian", "christian", "muslim", "jew", "hindu", "buddhist", "atheist", "immigrant", "refugee", "foreigner", "person"),
    ("female", "male", "gay", "homosexual", "bisexual", "queer", "trans", "jewish", "islamic", "catholic", "african", "asian", "european", "american", "black", "white", "disabled", "deaf", "blind", "old", "young", "human"),
    ("frau", "mann", "christ", "muslim", "jude", "flüchtling", "einwanderer", "migrant", "mensch"),
    ("schwul", "lesbisch", "jüdisch", "muslimisch", "christlich", "afrikanisch", "türkisch", "behindert", "blind", "taub", "menschlich"),
    ("femme", "homme", "homosexuel", "lesbienne", "chrétien", "musulman", "juif", "étranger", "réfugié", "immigré", "personne"),
    ("féminin", "masculin", "juive", "musulmane", "chrétienne", "africain", "africaine", "arabe", "handicapé", "aveugle", "sourd", "humain"),
    ("mujer", "hombre", "homosexual", "lesbiana", "cristiano", "musulmán", "judío", "extranjero", "refugiado", "inmigrante", "persona"),
    ("femenino", "masculino", "judía", "musulmana", "cristiana", "africano", "africana", "árabe", "discapacitado", "ciego", "sordo", "humano"),
)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and feature hash of every word and word beginning."""
    words = Words(data, offsets, NOT_ALNUM)
    docs, hashes = [words.doc], [words.hash]
    for length in PREFIXES:
        long = np.flatnonzero(words.end - words.start > length)
        docs.append(words.doc[long])
        # A beginning is another feature than the word with the same bytes.
        hashes.append(words.span_hash(words.start[long], words.start[long] + length) ^ np.uint64(0x5851F42D4C957F2D))
    return np.concatenate(docs), np.concatenate(hashes)


def _distinct(docs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, docs))
    docs, values = docs[order], values[order]
    fresh = np.ones(len(docs), bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    return docs[fresh], values[fresh]


def _term_hashes(term: str) -> np.ndarray:
    data = np.frombuffer(term.encode(), np.uint8)
    return np.unique(_features(data, np.array([0, len(data)]))[1])


class Model:
    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias
        self.first = np.zeros(1 << 16, bool)  # which leading 16 bits occur at all
        self.first[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def found(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and index of each feature of the model that a document has."""
        docs, hashes = _features(data, offsets)
        may = np.flatnonzero(self.first[(hashes >> np.uint64(48)).astype(np.int64)])
        docs, hashes = docs[may], hashes[may]
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        is_in = self.hashes[at] == hashes if len(self.hashes) else np.zeros(0, bool)
        return _distinct(docs[is_in], at[is_in])

    def score(self, texts: pa.Array) -> np.ndarray:
        out = []
        for _, _, data, offsets in chunks(texts):
            docs, at = self.found(data, offsets)
            out.append(np.bincount(docs, self.weights[at], len(offsets) - 1) + self.bias)
        margin = np.concatenate(out) if out else np.zeros(0)
        with np.errstate(over="ignore"):  # a margin of -infinity is a score of 0
            return 1 / (1 + np.exp(-np.minimum(margin, 500)))


def _select(rows: DataFrame) -> np.ndarray:
    """Hashes of all features that tell enough about the label, by half the G-squared over all labelled rows."""

    def count(batches):
        for batch in batches:
            labels = batch.column("label").to_numpy()
            for first, last, data, offsets in chunks(batch.column("text")):
                docs, hashes = _distinct(*_features(data, offsets))
                values, index = np.unique(hashes, return_inverse=True)
                toxic = np.bincount(index, labels[first:last][docs], len(values)).astype(np.int64)
                yield pa.record_batch({"feature": values.view(np.int64), "toxic": toxic, "docs": np.bincount(index, minlength=len(values))})

    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("t")).first()
    if not total.n or not total.t or total.t == total.n:
        return np.zeros(0, np.uint64)
    counts = rows.mapInArrow(count, "feature long, toxic long, docs long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
    rate = total.t / total.n
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    t, n = F.col("toxic").cast("double"), F.col("docs").cast("double")
    gain = part(t, n * rate) + part(n - t, n * (1 - rate)) + part(total.t - t, (total.n - n) * rate) + part(total.n - total.t - n + t, (total.n - n) * (1 - rate))
    telling = counts.where((F.col("docs") >= MIN_DOCS) & (gain >= MIN_GAIN)).select("feature").toArrow()
    return np.sort(telling["feature"].to_numpy().view(np.uint64))


def _swaps(rows: DataFrame, model: Model) -> np.ndarray:
    """How often each feature of the model stands in a labelled document; of use for identity terms."""

    def count(batches):
        sums = np.zeros(len(model.hashes), np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets, NOT_ALNUM)
                may = words.hash[model.first[(words.hash >> np.uint64(48)).astype(np.int64)]]
                at = np.minimum(np.searchsorted(model.hashes, may), len(model.hashes) - 1)
                sums += np.bincount(at[model.hashes[at] == may], minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.record_batch({"at": at, "n": sums[at]})

    found = rows.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(model.hashes))
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


class _Block:
    """Labels and model features of some rows; work on it needs a few numbers per feature."""

    def __init__(self, batches: list[pa.RecordBatch]):
        part = pa.Table.from_batches(batches).combine_chunks()
        lists = part["at"].combine_chunks()
        self.labels = part["label"].to_numpy().astype(float)
        self.at = lists.flatten().to_numpy().astype(np.int32)
        self.counts = np.diff(lists.offsets.to_numpy())
        self.filled = np.flatnonzero(self.counts)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])[:-1][self.filled]

    def margins(self, w: np.ndarray) -> np.ndarray:
        out = np.full(len(self.labels), w[-1])
        if len(self.filled):
            out[self.filled] += np.add.reduceat(w[self.at], self.starts)
        return out

    def gradient(self, slope: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.at, np.repeat(slope, self.counts), width)


def _blocks(table_: pa.Table) -> list[_Block]:
    """The rows in blocks of about `BLOCK` features."""
    out, held, size = [], [], 0
    for batch in table_.to_batches():
        held.append(batch)
        size += len(batch.column("at").flatten())
        if size >= BLOCK:
            out.append(_Block(held))
            held, size = [], 0
    return [*out, _Block(held)] if held else out


def _fit(blocks: list[_Block], pairs: list[tuple[np.ndarray, np.ndarray, float]], width: int):
    """Weights and bias by accelerated gradient steps on log loss, ridge and swap penalty; each step is checked by backtracking."""
    rows = sum(len(b.labels) for b in blocks)
    positive = sum(b.labels.sum() for b in blocks)
    strength = np.array([n for _, _, n in pairs], float)
    strength = SWAP_PENALTY * strength / max(1.0, strength.sum())
    # Features that a swap takes away (-1) or adds.
    which = np.concatenate([np.zeros(0, np.int64), *(np.full(len(one) + len(other), i) for i, (one, other, _) in enumerate(pairs))])
    feature = np.concatenate([np.zeros(0, np.int64), *(x for one, other, _ in pairs for x in (one, other))])
    sign = np.concatenate([np.zeros(0), *(np.full(len(x), s) for one, other, _ in pairs for x, s in ((one, -1.0), (other, 1.0)))])

    def loss(w, slopes: bool):
        change = np.bincount(which, sign * w[feature], len(pairs))
        value = RIDGE / 2 * (w[:-1] @ w[:-1]) / 100 + strength @ change**2
        gradient = np.append(RIDGE / 100 * w[:-1] + 2 * np.bincount(feature, sign * (strength * change)[which], width), 0.0)
        for block in blocks:
            margin = block.margins(w)
            value += (np.logaddexp(0, margin) - block.labels * margin).sum() / rows
            if slopes:
                slope = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - block.labels) / rows
                gradient[:-1] += block.gradient(slope, width)
                gradient[-1] += slope.sum()
        return value, gradient

    w = np.zeros(width + 1)
    w[-1] = np.log((positive + 0.5) / (rows - positive + 0.5))
    ahead, rate, k, last = w.copy(), 1.0, 1.0, np.inf
    for step in range(STEPS):
        value, gradient = loss(ahead, True)
        while True:
            new = ahead - rate * gradient
            if loss(new, False)[0] <= value - rate / 2 * (gradient @ gradient) or rate < 1e-9:
                break
            rate /= 2
        k_next = (1 + np.sqrt(1 + 4 * k * k)) / 2
        ahead, w, k = new + (k - 1) / k_next * (new - w), new, k_next
        rate *= 1.2
        if np.abs(gradient).max() < 1e-6:
            break
        if step % 10 == 9:
            if last - value < 1e-4 * value:
                break
            last = value
    return w[:-1], float(w[-1])


def train(rows: DataFrame, limit: int = FIT_ROWS) -> Model:
    """Fit on stored rows `doc_id, text, label`; they are read three times."""
    terms = [[_term_hashes(term) for term in group] for group in IDENTITY]
    texts = rows.count()
    selected = _select(rows)
    model = Model(np.unique(np.concatenate([selected, *(h for group in terms for h in group)])), np.zeros(0), 0.0)
    occurrences = _swaps(rows, model)
    word_at = lambda hashes: np.searchsorted(model.hashes, hashes)
    own = [[np.searchsorted(model.hashes, _word_hash(term)) for term in group] for group in IDENTITY]
    pairs = [
        (word_at(group[i]), word_at(group[j]), occurrences[own[g][i]] + (texts if i + 1 == len(group) else 0))
        for g, group in enumerate(terms)
        for i in range(len(group))
        for j in range(len(group))
        if i != j and (occurrences[own[g][i]] or i + 1 == len(group))
    ]

    def found(batches):
        for batch in batches:
            labels = batch.column("label").to_numpy()
            for first, last, data, offsets in chunks(batch.column("text")):
                docs, at = model.found(data, offsets)
                ends = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=last - first))]).astype(np.int32)
                yield pa.record_batch(
                    {"label": labels[first:last], "at": pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))}
                )

    # Narrow: labels and model features of at most about `limit` rows.
    fit = fit_rows(rows.select("doc_id", "text", "label"), "doc_id", limit).mapInArrow(found, "label int, at array<int>")
    blocks = _blocks(fit.toArrow())
    if not any(len(b.labels) for b in blocks):
        return Model(model.hashes, np.zeros(len(model.hashes)), -np.inf)
    weights, bias = _fit(blocks, pairs, len(model.hashes))
    return Model(model.hashes, weights, bias)


def _word_hash(term: str) -> np.uint64:
    data = np.frombuffer(term.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), NOT_ALNUM).hash[0]


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep_body: bool = False) -> DataFrame:
    """`doc_id, score` of every row, with `body` on request."""
    own = ["doc_id", "body"] if keep_body else ["doc_id"]

    def run(batches):
        for batch in batches:
            yield pa.record_batch([*(batch.column(c) for c in own), pa.array(model.score(batch.column("text")))], [*own, "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("body"), F.col(text).alias("text")).select(*own, "text")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in own)
    return rows.mapInArrow(run, f"{kinds}, score double")


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on the labelled rows of docs."""
    rows = labelled(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labels.withColumnRenamed(doc_id, "doc_id"), label)
    return train(store(rows.select("doc_id", "text", "label"), "toxic-labelled"))


def drop_toxic(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold."""
    bad = predict(docs, model, doc_id, text, keep_body=True).where(F.col("score") >= threshold).select("doc_id", "body")
    return without(docs, store(bad.distinct(), "toxic-dropped"), doc_id, text)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = learn(docs.where(~held), table(spark, sf_dir, "labels"))
    return predict(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op8_toxicity": op8_toxicity}

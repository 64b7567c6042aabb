"""Byte-level BPE encoding and decoding over the ranks of a public vocabulary.

Texts are pre-tokenised in chunks that overlap. A chunk begins anywhere, so its first boundaries may be wrong, but from the first place
where they meet a boundary of the chunk before it both go on alike: a match depends only on what follows its start. That place is the cut
between the two. The pieces between cuts are encoded pre-token by pre-token, and a document's ids are those of its pieces in order. Where
two chunks share no boundary in their overlap (a pre-token longer than that), the chunks are put together and matched as one, and the
cut after them must be a boundary of that match; a pattern for which it is not raises an error (none does whose matches are runs of
classes). So the ids are those of the whole text whatever it holds. A text of at most one chunk is worked on where it is read; the chunks of longer ones are
dealt out over all tasks. Decoding puts the bytes of the ids in a row.

The merges inside a pre-token are tiktoken's. Its character classes come from an older table of code points than those of `regex`;
code points that the two class differently are replaced, for the matching only, by one that both class alike (`stand_ins`).

Ids are packed: four bytes each, little-endian, so that they can be hashed, joined and measured as binary (`token_list` gives an array).
A null or empty text has no ids. Rows that repeat an id or a text are encoded each for itself; a null id stays null. An empty table gives
an empty result; columns other than the id and the text are not read. Ids outside the vocabulary cannot be decoded and raise an error.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, store, table

#: Code points from the start of one chunk to the start of the next, and how far a chunk reaches into the next one.
CHUNK = 1 << 14
OVERLAP = 1 << 9
#: A match that ends this far before the end of what a chunk sees does not depend on what follows (longest contraction + 1).
MARGIN = 4
#: Pre-tokens whose ids a worker keeps; beyond it the worker begins anew.
KEPT = 1 << 16
BATCH_CHARS = 1 << 20


def read_ranks(path: str) -> bytes:
    """The rank file, whole (under a megabyte); tasks get its bytes, so executors need no copy of it."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def stand_ins(pattern: str) -> dict[int, str]:
    """Code points that `regex` puts into other classes of the pattern than tiktoken, with one of tiktoken's classes for each."""
    import regex
    import tiktoken

    classes = sorted(set(regex.findall(r"\\[pP]\{\w+\}|\\[sSdDwW]", pattern)))
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF], np.uint32)
    every = points.tobytes().decode("utf-32-le")
    single = {bytes([i]): i for i in range(256)}
    theirs, ours = np.zeros(0x110000, np.int64), np.zeros(0x110000, np.int64)
    for bit, name in enumerate(classes):
        taken = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        in_theirs = taken.decode_bytes(taken.encode_ordinary(every)).decode()
        theirs[np.frombuffer(in_theirs.encode("utf-32-le"), np.uint32)] |= 1 << bit
        ours[np.frombuffer("".join(regex.findall(name, every)).encode("utf-32-le"), np.uint32)] |= 1 << bit
    alike: dict[int, str] = {}
    # From the last one down, so that the first code point of a kind beyond ASCII stays: letters of the pattern itself stand for themselves.
    for c in points[(theirs == ours)[points] & (points > 0x7F)][::-1].tolist():
        alike[int(theirs[c])] = chr(c)
    return {c: alike[int(theirs[c])] for c in np.flatnonzero(theirs != ours).tolist()}


class Encoder:
    """Pre-tokens and their ids. Built once per task from plain data."""

    def __init__(self, ranks: bytes, pattern: str, others: dict[int, str]):
        import regex
        import tiktoken

        self._match = regex.compile(pattern)
        self._others, self._other_chars = others, frozenset(map(chr, others))
        # One match takes the whole pre-token, so tiktoken only merges.
        self._merge = tiktoken.Encoding("pre-token", pat_str=r"(?s).+", mergeable_ranks=parse_ranks(ranks), special_tokens={}).encode_ordinary
        self._ids: dict[str, bytes] = {}

    def matched(self, text: str) -> str:
        """The text as it is matched: same length, code points replaced that the libraries class differently."""
        if text.isascii() or self._other_chars.isdisjoint(text):
            return text
        return text.translate(self._others)

    def lengths(self, text: str) -> np.ndarray:
        """Length of every pre-token; together they cover the text."""
        return np.fromiter(map(len, self._match.findall(self.matched(text))), np.uint32)

    def encode(self, text: str, lengths: np.ndarray | None = None) -> bytes:
        """Packed ids of a text that begins and ends at a pre-token boundary."""
        if lengths is None and (text.isascii() or self._other_chars.isdisjoint(text)):
            pieces = self._match.findall(text)
        else:
            ends = np.cumsum(self.lengths(text) if lengths is None else lengths).tolist()
            pieces = [text[a:b] for a, b in zip([0, *ends], ends)]
        ids = self._ids
        try:
            return b"".join(map(ids.__getitem__, pieces))
        except KeyError:
            if len(ids) > KEPT:
                ids.clear()
            for piece in set(pieces).difference(ids):
                ids[piece] = np.array(self._merge(piece), "<u4").tobytes()
            return b"".join(map(ids.__getitem__, pieces))


def _batches(columns, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, t) for v, t in zip(columns, kinds.values())], list(kinds))


def _short_texts(rows: DataFrame, shared) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = Encoder(*shared.value)
        for batch in batches:
            first, size, out = 0, 0, []
            for i, value in enumerate(batch.column("text")):
                text = value.as_py()
                out.append(encoder.encode(text))
                size += len(text)
                if size >= BATCH_CHARS or i + 1 == batch.num_rows:
                    yield pa.record_batch([batch.column("doc_id").slice(first, len(out)), pa.array(out, pa.binary())], ["doc_id", "ids"])
                    first, size, out = i + 1, 0, []

    return rows.mapInArrow(run, f"doc_id {kind}, ids binary")


def chunks(rows: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """`row, doc_id, k, last, start, text`: the chunks of rows `row, doc_id, text`."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            kinds = {"row": pa.int64(), "doc_id": ids.type, "k": pa.int64(), "last": pa.bool_(), "start": pa.int64(), "text": pa.string()}
            for row, doc_id, value in zip(batch.column("row").to_pylist(), ids.to_pylist(), batch.column("text")):
                text, out, size = value.as_py(), [], 0
                for start in range(0, max(1, len(text)), chunk):
                    # A chunk that sees the end of the text is the last one.
                    last = start + chunk + overlap >= len(text)
                    out.append((row, doc_id, start // chunk, last, start, text[start : start + chunk + overlap]))
                    size += chunk
                    if last or size >= BATCH_CHARS:
                        yield _batches(zip(*out), kinds)
                        out, size = [], 0
                    if last:
                        break

    return rows.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, k long, last boolean, start long, text string")


def pretokens(parts: DataFrame, shared, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Chunks with their pre-token lengths, and the sure boundaries that chunk k + 1 must meet (`tail`) or has to offer chunk k (`head`)."""

    def run(batches):
        encoder = Encoder(*shared.value)
        kinds = {"lengths": pa.binary(), "head": pa.list_(pa.int64()), "tail": pa.list_(pa.int64())}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                text, start = row.column("text")[0].as_py(), row.column("start")[0].as_py()
                lengths = encoder.lengths(text)
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                sure = ends if row.column("last")[0].as_py() else ends[ends <= len(text) - MARGIN]
                found = ([lengths.astype("<u4").tobytes()], [(sure[sure <= overlap] + start).tolist()], [(sure[sure >= chunk] + start).tolist()])
                extra = _batches(found, kinds)
                yield pa.record_batch([*row.columns, *extra.columns], [*row.schema.names, *kinds])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    return parts.mapInArrow(run, f"{columns}, lengths binary, head array<long>, tail array<long>")


def cuts(parts: DataFrame) -> DataFrame:
    """`row, first, next, begin, end`: runs of chunks first ... next - 1 that hold the text from begin to end (null: to its end)."""
    before = parts.where("NOT last").select("row", (F.col("k") + 1).alias("k"), "tail")
    met = parts.select("row", "k", "head").join(before, ["row", "k"], "left")
    begin = F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("head", "tail")))
    # Narrow rows: numbers of one document's chunks.
    order = Window.partitionBy("row").orderBy("first")
    runs = met.select("row", F.col("k").alias("first"), begin.alias("begin")).where("begin IS NOT NULL")
    return runs.select("row", "first", "begin", F.lead("first").over(order).alias("next"), F.lead("begin").over(order).alias("end"))


def _long_texts(rows: DataFrame, shared, chunk: int, overlap: int) -> DataFrame:
    """`doc_id, ids` of rows of several chunks."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    # Written before it is used twice, so the number of a row stays what it was.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    parts = store(pretokens(chunks(rows, chunk, overlap).repartition("row", "k"), shared, chunk, overlap), "bpe-pretokens")
    runs = small(store(cuts(parts), "bpe-cuts"))

    def encode_runs(batches):
        encoder = Encoder(*shared.value)
        for batch in batches:
            for r in batch.to_pylist():
                begin, end = (None if r[c] is None else r[c] - r["start"] for c in ("begin", "end"))
                if r["lengths"] is None:
                    # Chunks without a common boundary, put together: matched again from the sure start.
                    text = r["text"][begin:]
                    lengths = encoder.lengths(text)
                    ends = np.cumsum(lengths)
                    stop = len(lengths) if end is None else int(np.searchsorted(ends, end - begin)) + 1
                    if end is not None and ends[stop - 1 : stop] != end - begin:
                        raise ValueError("the pattern's matches stay apart for longer than the overlap; choose a larger one")
                    ids = encoder.encode(text[: len(text) if end is None else end - begin], lengths[:stop])
                else:
                    lengths = np.frombuffer(r["lengths"], "<u4")
                    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                    a = int(np.searchsorted(ends, begin))
                    b = len(ends) - 1 if end is None else int(np.searchsorted(ends, end))
                    ids = encoder.encode(r["text"][ends[a] : ends[b]], lengths[a:b])
                kinds = {"row": pa.int64(), "doc_id": batch.schema.field("doc_id").type, "first": pa.int64(), "ids": pa.binary()}
                yield _batches([[r["row"]], [r["doc_id"]], [r["first"]], [ids]], kinds)

    columns = ["row", "doc_id", "first", "start", "begin", "end", "text", "lengths"]
    own = parts.join(runs, (parts["row"] == runs["row"]) & (parts["k"] == runs["first"])).drop(parts["row"])
    one = own.where("last OR next = first + 1").select(*columns)
    # Runs of several chunks: one pre-token is longer than the overlap, or nearly so.
    several = store(own.where("NOT last AND (next IS NULL OR next > first + 1)").select("row", "doc_id", "first", "next", "start", "begin", "end"), "bpe-runs")
    inside = parts["k"].between(several["first"], F.coalesce(several["next"] - 1, F.lit((1 << 63) - 1)))
    members = parts.join(small(several), (parts["row"] == several["row"]) & inside).select(several["*"], "k", "last", "text")
    stripped = F.when(F.col("last"), F.col("text")).otherwise(F.substring("text", 1, chunk))
    tail = F.max_by("text", "k")
    whole = members.groupBy("row", "doc_id", "first", "start", "begin", "end").agg(
        F.array_sort(F.collect_list(F.struct("k", stripped.alias("text")))).alias("texts"), F.substring(tail, chunk + 1, overlap).alias("rest"), F.max("last").alias("last")
    )
    text = F.concat(F.array_join("texts.text", ""), F.when(F.col("last"), F.lit("")).otherwise(F.col("rest")))
    joined = whole.withColumn("text", text).withColumn("lengths", F.lit(None).cast("binary")).select(*columns)
    pieces = one.unionByName(joined).mapInArrow(encode_runs, f"row long, doc_id {kind}, first long, ids binary")
    # In hexadecimal, because joining many binary values in one pass has no function of its own.
    in_order = F.array_sort(F.collect_list(F.struct("first", F.hex("ids").alias("ids"))))
    texts = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.unhex(F.array_join(in_order["ids"], "")).alias("ids"))
    return texts.select("doc_id", "ids")


def encode(
    docs: DataFrame, ranks: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """`doc_id, ids` of every row: the packed ids of its text without special tokens."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern, stand_ins(pattern)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    in_one = F.length("text") <= chunk + overlap
    return _short_texts(rows.where(in_one), shared).unionByName(_long_texts(rows.where(~in_one), shared, chunk, overlap))


def decode(tokens: DataFrame, ranks: bytes) -> DataFrame:
    """`doc_id, ids, bytes` of rows of packed ids."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches):
        by_rank = {rank: token for token, rank in parse_ranks(shared.value).items()}
        for batch in batches:
            first, size, out = 0, 0, []
            for i, packed in enumerate(batch.column("ids")):
                ids = np.frombuffer(packed.as_py() or b"", "<u4").tolist()
                out.append(b"".join(map(by_rank.__getitem__, ids)))
                size += len(out[-1])
                if size >= BATCH_CHARS or i + 1 == batch.num_rows:
                    part = batch.slice(first, len(out))
                    yield pa.record_batch([part.column("doc_id"), part.column("ids"), pa.array(out, pa.binary())], ["doc_id", "ids", "bytes"])
                    first, size, out = i + 1, 0, []

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, bytes binary")


def token_list(tokens: DataFrame) -> DataFrame:
    """`doc_id, ids array<int>` of rows of packed ids."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = [np.frombuffer(v.as_py() or b"", "<u4").astype(np.int32) for v in batch.column("ids")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def op11_byte_pairs(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return decode(tokens, ranks).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


QUERIES = {"op11_byte_pairs": op11_byte_pairs}

"""Language-model scoring by context-tree weighting over bytes, next to a smoothed unigram base.

Model. A text is coded as its UTF-8 bytes and an end symbol (0xFF, which UTF-8 never uses), from a context of `DEPTH` end symbols.
A byte is eight binary decisions. For every context of 0 to DEPTH bytes and every decision node the training texts give two
counts; a Krichevsky-Trofimov estimate turns them into a probability, and context-tree weighting mixes the estimates of all depths
of the path: with Pe the block probability of a node and Pw = (Pe + product of the children's Pw) / 2, a node answers for itself
with weight Pe / (2 Pw) and leaves the rest to the next longer context. The log-probability of a text is the sum over its bytes.

Plan. Tasks count (context, byte) keys of all documents and Spark sums them; held-out documents add keys with count 0, so that every
key that will be looked up is there, without teaching anything. Keys are dealt out and sorted by their two most recent context bytes
(three where two have more than `HOT_KEYS` keys), so each task reads whole subtrees one after the other and works them out bottom-up;
the levels above (at most 257 contexts, and the hot pairs) are finished on the driver. The second pass mixes top-down into one
log-probability per key. That table is sent to the tasks if its counted rows allow it. Beyond that, texts are dealt into blocks of
`BLOCK_BYTES`; a block asks for each of its distinct keys once, and the entries come to it by a join, so a key is asked for at most once
per block, however often it occurs. The base is counted over the same training texts: words with at least 1 / `HEAVY` of all tokens (so
at most HEAVY words) are sent to the tasks, the others are joined.

A null text counts as empty: it has the end token only. Rows with a null id are training rows. Repeated rows count each time. Without
training texts the base is log10(1) and every byte decision is 1/2. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, crc_mod, store, table
from .tokens import Words, chunks, mix

DEPTH = 5
HEAVY = 1 << 17
#: Keys of the model that may be sent to every task (12 bytes each).
TABLE_ROWS = 4_000_000
#: Text that shares one set of model entries where the model is too long to be sent to every task.
BLOCK_BYTES = 16 << 20
#: Keys of two most recent context bytes that one task works on; subtrees with more are split by the third byte.
HOT_KEYS = 1 << 20
#: Keys of whole subtrees that are worked on at once.
PIECE = 1 << 18
#: Distinct keys a task gathers before it passes them on.
GATHER = 1 << 21
END = 0xFF
_END_TOKEN = np.uint64(0xE0D0E0D0E0D0E0D1)


def _keys(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of every coded symbol, the most recent context byte first and the symbol last, and n + 1 offsets per document."""
    n = len(offsets) - 1
    padded = np.full(len(data) + n * (depth + 1), END, np.uint8)
    sizes = np.diff(offsets)
    padded[np.arange(len(data)) + np.repeat(depth + np.arange(n) * (depth + 1), sizes)] = data
    starts = offsets[:-1] + depth + np.arange(n) * (depth + 1)  # where the first symbol of each document stands
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])
    at = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes + 1)
    keys = np.zeros(len(at), np.uint64)
    for back in range(1, depth + 1):
        keys = (keys << np.uint64(8)) | padded[at - back]
    return (keys << np.uint64(8)) | padded[at], ends


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last position of each run of equal values."""
    edges = np.append(_firsts(values), len(values))
    return zip(edges[:-1].tolist(), edges[1:].tolist())


class _Sums:
    """Counts per key, gathered in a task."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = _firsts(keys)
        merged = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.parts, self.size = [merged], len(first)
        return merged

    def full(self) -> bool:
        if self.size < 2 * GATHER:
            return False
        self.merge()
        return self.size > GATHER


def _count(docs: DataFrame, depth: int) -> DataFrame:
    """`word, key, n`: training counts of tokens (word) and of contexts with a byte (not word)."""

    def run(batches):
        words, grams = _Sums(), _Sums()

        def rows(sums, word):
            keys, counts = sums.merge()
            sums.parts, sums.size = [], 0
            for i in range(0, len(keys), 1 << 18):
                n = len(keys[i : i + (1 << 18)])
                yield pa.record_batch({"word": pa.array([word] * n), "key": keys[i : i + n].view(np.int64), "n": counts[i : i + n]})

        for batch in batches:
            learns = ~batch.column("held").to_numpy(zero_copy_only=False)
            for first, last, data, offsets in chunks(batch.column("text")):
                learn = learns[first:last]
                own = Words(data, offsets)
                words.add(*(x.astype(t) for x, t in zip(np.unique(own.hash[learn[own.doc]], return_counts=True), (np.uint64, np.int64))))
                if learn.any():
                    words.add(np.array([_END_TOKEN]), np.array([learn.sum()]))
                keys, ends = _keys(data, offsets, depth)
                known = np.repeat(learn, np.diff(ends))
                grams.add(*(x.astype(t) for x, t in zip(np.unique(keys[known], return_counts=True), (np.uint64, np.int64))))
                others = np.unique(keys[~known])
                grams.add(others, np.zeros(len(others), np.int64))
                for sums, word in ((words, True), (grams, False)):
                    if sums.full():
                        yield from rows(sums, word)
        yield from rows(words, True)
        yield from rows(grams, False)

    return docs.mapInArrow(run, "word boolean, key long, n long").groupBy("word", "key").agg(F.sum("n").alias("n"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5: eight steps up, then Stirling's series."""
    z, steps = x + 8, np.zeros(x.shape)
    for i in range(8):
        steps += np.log(x + i)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - steps


def _block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a block."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - np.log(np.pi) - _lgamma(zeros + ones + 1.0)


class _Level:
    """The nodes of one depth and one bit position: counts, block probability, weighted probability, weight of the node itself."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bit: int, below: _Level | None):
        nodes = keys >> np.uint64(8 - bit)
        first = _firsts(nodes)
        one = ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        self.nodes = nodes[first]
        self.zeros, self.ones = (np.add.reduceat(np.where(side, counts, 0.0), first) if len(first) else np.zeros(0) for side in (~one, one))
        block = _block(self.zeros, self.ones)
        if below is None:
            self.log_pw, self.weight = block, np.ones(len(first))
        else:
            children = np.zeros(len(first))
            np.add.at(children, np.searchsorted(self.nodes, below.parents(bit)), below.log_pw)
            self.log_pw = np.logaddexp(block, children) - np.log(2)
            self.weight = np.exp(block - np.log(2) - self.log_pw)

    def parents(self, bit: int) -> np.ndarray:
        """The nodes of the same decision in the context that is one byte shorter."""
        low = np.uint64((1 << bit) - 1)
        return ((self.nodes >> np.uint64(bit + 8)) << np.uint64(bit)) | (self.nodes & low)

    def mix(self, keys: np.ndarray, bit: int, longer: np.ndarray | None) -> np.ndarray:
        """Probability of the bit of each key, from this depth and the mixture of the longer contexts."""
        at = np.searchsorted(self.nodes, keys >> np.uint64(8 - bit))
        one = ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        own = (np.where(one, self.ones[at], self.zeros[at]) + 0.5) / (self.zeros[at] + self.ones[at] + 1)
        return own if longer is None else self.weight[at] * own + (1 - self.weight[at]) * longer


def _shorten(keys: np.ndarray, bytes_: int) -> np.ndarray:
    """Keys without the given number of oldest context bytes."""
    return ((keys >> np.uint64(8 * (bytes_ + 1))) << np.uint64(8)) | (keys & np.uint64(0xFF))


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = _Sums()
    sums.add(keys, counts)
    return sums.merge()


def _tree(keys: np.ndarray, counts: np.ndarray, depth: int, least: int, bit: int) -> dict[int, _Level]:
    """Levels from depth down to least, for one bit position; keys are sorted and distinct."""
    levels, below = {}, None
    for d in range(depth, least - 1, -1):
        below = levels[d] = _Level(*_merge(_shorten(keys, depth - d), counts), bit, below)
    return levels


def _pair(depth: int) -> Column:
    """The two most recent context bytes of a key."""
    return F.shiftright("key", 8 * (depth - 1))


def _hot_pairs(grams: DataFrame, depth: int, hot_keys: int) -> list[int]:
    """The pairs of most recent bytes with more than `hot_keys` keys (of at most 65,536 pairs)."""
    if depth == 2:
        return []
    return [r.pair for r in grams.groupBy(_pair(depth).alias("pair")).count().where(F.col("count") > hot_keys).collect()]


def _subtrees(grams: DataFrame, depth: int, hot: list[int]) -> DataFrame:
    root = _pair(depth)
    if hot:
        root = F.when(root.isin(hot), F.shiftright("key", 8 * (depth - 2))).otherwise(root)
    return grams.select("key", "n").repartition(root).sortWithinPartitions("key")


def _pieces(batches, depth: int, hot: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Keys and counts of whole subtrees, some at a time, and the depth of their roots; the rows of a task come sorted by key."""
    wide_pairs = np.array(hot, np.uint64)

    def whole(keys, counts, last):
        pair = keys >> np.uint64(8 * (depth - 1))
        wide = np.isin(pair, wide_pairs)
        end = len(keys)
        if not last:  # the last subtree may go on
            root = np.where(wide, keys >> np.uint64(8 * max(depth - 2, 0)), pair << np.uint64(8))
            end = int(np.searchsorted(root, root[-1]))
        for least, own in ((2, ~wide[:end]), (3, wide[:end])):
            if own.any():
                yield keys[:end][own], counts[:end][own], least
        return keys[end:], counts[end:]

    parts, size, enough = [], 0, PIECE
    for batch in batches:
        parts.append((batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy()))
        size += batch.num_rows
        if size > enough:
            left = yield from whole(*(np.concatenate(x) for x in zip(*parts)), False)
            parts, size = [left], len(left[0])
            enough = max(PIECE, 2 * size)
    if size:
        yield from whole(*(np.concatenate(x) for x in zip(*parts)), True)


class _Children:
    """Sums of log-probabilities of the next longer contexts, by node, in place of a level."""

    def __init__(self, nodes: np.ndarray, log_pw: np.ndarray):
        self.nodes, self.log_pw = nodes, log_pw

    def parents(self, bit: int) -> np.ndarray:
        return self.nodes


def _top_levels(grams: DataFrame, depth: int, hot: list[int]) -> list[dict[int, _Level]]:
    """Per bit position the levels of depth 1 and 0, and depth 2 of the hot pairs; the products over longer contexts come from the tasks."""

    def run(batches):
        for keys, counts, least in _pieces(batches, depth, hot):
            for bit in range(8):
                level = _tree(keys, counts, depth, least, bit)[least]
                parents, index = np.unique(level.parents(bit), return_inverse=True)
                sums = np.bincount(index, level.log_pw, len(parents))
                yield pa.record_batch({
                    "depth": pa.array([least - 1] * len(parents), pa.int32()),
                    "bit": pa.array([bit] * len(parents), pa.int32()),
                    "node": parents.view(np.int64),
                    "children": sums,
                })

    sums = (
        _subtrees(grams, depth, hot)
        .mapInArrow(run, "depth int, bit int, node long, children double")
        .groupBy("depth", "bit", "node")
        .agg(F.sum("children").alias("children"))
        .toArrow()
    )
    of, bits, nodes, children = (sums[c].to_numpy() for c in ("depth", "bit", "node", "children"))

    def counted(rows: DataFrame, context: Column) -> tuple[np.ndarray, np.ndarray]:
        got = rows.groupBy((context * 256 + F.col("key").bitwiseAND(0xFF)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
        order = np.argsort(got["key"].to_numpy())
        return got["key"].to_numpy()[order].view(np.uint64), got["n"].to_numpy()[order]

    keys, counts = counted(grams, F.shiftright("key", 8 * depth))  # at most 65,536 rows
    pairs = counted(grams.where(_pair(depth).isin(hot)), _pair(depth)) if hot else None  # at most 256 rows a pair
    out = []
    for bit in range(8):
        at, value = (x[(of == 1) & (bits == bit)] for x in (nodes.view(np.uint64), children))
        levels = {}
        if hot:
            own = (of == 2) & (bits == bit)
            two = levels[2] = _Level(*pairs, bit, _Children(nodes.view(np.uint64)[own], children[own]))
            at, value = np.concatenate([at, two.parents(bit)]), np.concatenate([value, two.log_pw])
        one = levels[1] = _Level(keys, counts, bit, _Children(at, value))
        levels[0] = _Level(*_merge(_shorten(keys, 1), counts), bit, one)
        out.append(levels)
    return out


def _log_table(grams: DataFrame, depth: int, hot_keys: int = HOT_KEYS) -> DataFrame:
    """`key, logp`: log10 of the mixed probability of the byte after its context."""
    hot = _hot_pairs(grams, depth, hot_keys)
    top = _top_levels(grams, depth, hot)

    def run(batches):
        for keys, counts, least in _pieces(batches, depth, hot):
            total = np.zeros(len(keys))
            for bit in range(8):
                levels = top[bit] | _tree(keys, counts, depth, least, bit)
                p = None
                for d in range(depth, -1, -1):
                    p = levels[d].mix(_shorten(keys, depth - d), bit, p)
                total += np.log10(p)
            yield pa.record_batch({"key": keys.view(np.int64), "logp": total.astype(np.float32)})

    return _subtrees(grams, depth, hot).mapInArrow(run, "key long, logp float")


class _Lookup:
    """An open-addressing table from 64-bit keys to numbers, read for all keys of a batch at once.

    It wraps a broadcast dictionary of plain arrays (executors need not know this class); a worker process builds the table
    when it first needs it and keeps it there.
    """

    def __init__(self, shared: dict[str, np.ndarray]):
        self.shared = shared
        self.bits = max(4, int(2 * len(shared["keys"])).bit_length())
        self.slots = shared.get("slots")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _build(self):
        keys, values = self.shared["keys"], self.shared["values"]
        size = 1 << self.bits
        held, taken, numbers = np.zeros(size, np.uint64), np.zeros(size, bool), np.zeros(size, values.dtype)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(~taken[slot])
            _, first = np.unique(slot[free], return_index=True)
            own = free[first]  # one key per free slot
            held[slot[own]], numbers[slot[own]], taken[slot[own]] = keys[left[own]], values[left[own]], True
            rest = np.ones(len(left), bool)
            rest[own] = False
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)
        self.slots = self.shared["slots"] = held, taken, numbers

    def get(self, keys: np.ndarray, default) -> np.ndarray:
        if self.slots is None:
            self._build()
        held, taken, numbers = self.slots
        slot = self._slot(keys)
        hit = taken[slot] & (held[slot] == keys)
        out = np.where(hit, numbers[slot], default)
        left = np.flatnonzero(~hit & taken[slot])
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(held) - 1)
            hit = taken[slot] & (held[slot] == keys[left])
            out[left[hit]] = numbers[slot[hit]]
            more = ~hit & taken[slot]
            left, slot = left[more], slot[more]
        return out


def _arrays(df: DataFrame, value: str) -> dict[str, np.ndarray]:
    got = df.select("key", value).toArrow()
    return {"keys": got["key"].to_numpy().view(np.uint64), "values": got[value].to_numpy()}


def _blocks(rows: DataFrame, logs: DataFrame, depth: int, block_bytes: int) -> DataFrame:
    """Model entries (`block, key, logp`) and texts (`key` is null) by block, the entries of a block first."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "body", "held", "text"]

    def deal(batches):
        done = 0
        for batch in batches:
            ends = done + np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            before = np.concatenate([[done], ends[:-1]]).astype(np.int64)
            done = int(ends[-1]) if len(ends) else done
            block = (batch.column("task").to_numpy().astype(np.int64) << 32) | (before[: len(ends)] // block_bytes)
            yield pa.record_batch([batch.column(c) for c in names] + [pa.array(block)], [*names, "block"])

    def wanted(batches):
        sums, own = _Sums(), None

        def asked():
            keys, _ = sums.merge()
            sums.parts, sums.size = [], 0
            for i in range(0, len(keys), 1 << 18):
                some = keys[i : i + (1 << 18)].view(np.int64)
                yield pa.record_batch({"block": np.full(len(some), own, np.int64), "key": some})

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for first, last in _runs(blocks):
                if blocks[first] != own:
                    yield from asked()
                    own = int(blocks[first])
                for _, _, data, offsets in chunks(batch.column("text").slice(first, last - first)):
                    keys = np.unique(_keys(data, offsets, depth)[0])
                    sums.add(keys, np.zeros(len(keys), np.int64))
                    if sums.full():
                        yield from asked()
        yield from asked()

    # Stored, so that texts and requests agree on the blocks.
    dealt = rows.select(*names, F.spark_partition_id().alias("task")).mapInArrow(deal, f"doc_id {kind}, body long, held boolean, text string, block long")
    dealt = store(dealt, "lm-blocks")
    entries = dealt.select("block", "text").mapInArrow(wanted, "block long, key long").join(logs, "key")
    return (
        entries.unionByName(dealt, allowMissingColumns=True)
        .repartition("block")
        .sortWithinPartitions("block", F.col("key").isNull(), "key")
    )


def score_texts(
    docs: DataFrame,
    held: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    depth: int = DEPTH,
    table_rows: int = TABLE_ROWS,
    block_bytes: int = BLOCK_BYTES,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """`doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`; held rows teach nothing."""
    if not 2 <= depth <= 6:
        raise ValueError("depth is 2 to 6 bytes")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), body(text).alias("body"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text).alias("text")
    )
    counted = store(_count(rows.select("held", "text"), depth), "lm-counts")
    grams, words = counted.where("NOT word").select("key", "n"), counted.where("word").select("key", "n")
    logs = store(_log_table(grams, depth, hot_keys), "lm-table")
    spread = logs.count() <= table_rows
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(_arrays(logs, "logp")) if spread else None

    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.count(F.lit(1)).alias("distinct")).first()
    total, floor = size["all"], size["all"] + size["distinct"] + 1
    often = _arrays(words.where(F.col("n") >= max(1, total / HEAVY)), "n")
    ends = words.where(F.col("key") == int(_END_TOKEN.view(np.int64))).first()
    n_end = ends["n"] if ends else 0
    heavy = spark.sparkContext.broadcast(often)

    def scores(batch, common: _Lookup, find: Callable[[np.ndarray], np.ndarray]):
        for first, last, data, offsets in chunks(batch.column("text")):
            own = Words(data, offsets)
            seen = common.get(own.hash, 0)
            rare = seen == 0
            logp = np.where(rare, 0.0, np.log10((seen + 1) / floor))
            count = last - first
            tails = np.concatenate([[0], np.cumsum(np.bincount(own.doc[rare], minlength=count))]).astype(np.int32)
            symbols, stops = _keys(data, offsets, depth)
            yield pa.record_batch(
                [batch.column(c).slice(first, count) for c in ("doc_id", "body", "held")]
                + [
                    pa.array(np.diff(offsets)),
                    pa.array(own.counts + 1),
                    pa.array(np.bincount(own.doc[~rare], minlength=count) + (n_end > 0)),
                    pa.array(np.bincount(own.doc, logp, count) + np.log10((n_end + 1) / floor)),
                    pa.array(np.add.reduceat(find(symbols), stops[:-1], dtype=np.float64)),
                    pa.ListArray.from_arrays(pa.array(tails), pa.array(own.hash[rare].view(np.int64))),
                ],
                ["doc_id", "body", "held", "n_bytes", "n_tokens", "known", "base", "score", "rare"],
            )

    def with_table(batches):
        logs_, common = _Lookup(model.value), _Lookup(heavy.value)
        for batch in batches:
            yield from scores(batch, common, lambda keys: logs_.get(keys, np.float32(np.nan)))

    def by_block(batches):
        common, own, parts, entries = _Lookup(heavy.value), None, [], None
        for batch in batches:
            blocks, texts = batch.column("block").to_numpy(), batch.column("key").is_null().to_numpy(zero_copy_only=False)
            for first, last in _runs(2 * blocks + texts):
                if blocks[first] != own:
                    own, parts, entries = blocks[first], [], None
                part = batch.slice(first, last - first)
                if not texts[first]:
                    parts.append((part.column("key").to_numpy().view(np.uint64), part.column("logp").to_numpy()))
                    continue
                if entries is None:
                    entries, parts = [np.concatenate(x) for x in zip(*parts)], []
                yield from scores(part, common, lambda keys, entries=entries: entries[1][np.searchsorted(entries[0], keys)])

    kind = rows.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, body long, held boolean, n_bytes long, n_tokens long, known long, base double, score double, rare array<long>"
    scored = rows.mapInArrow(with_table, result) if spread else _blocks(rows, logs, depth, block_bytes).mapInArrow(by_block, result)
    scored = store(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    for sent in (model, heavy):
        if sent is not None:
            sent.destroy()
    tail = (
        scored.select("row", F.explode("rare").alias("key"))
        .join(words, "key", "left")
        .groupBy("row")
        .agg(F.count("n").alias("tail_known"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(floor)))).alias("tail_base"))
    )
    out = scored.drop("rare").join(tail, "row", "left")
    return out.select(
        "doc_id",
        F.col("held").alias("held_out"),
        "n_bytes",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)


QUERIES = {"op2_lm_score": op2_lm_score}

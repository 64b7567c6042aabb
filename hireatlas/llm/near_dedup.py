"""Near duplicates by a MinHash LSH forest: sorted signature orders, neighbours by longest common prefix, exact confirmation.

A document's set is its distinct shingles of `SHINGLE` words (words as `[^\\x20\\x09-\\x0D]+`, A-Z in lower case); fewer words are one
shingle; no words give no set, and no links. Documents with equal sets are one node. A signature has `HASHES` minimum values. The forest has
`ORDERS` trees; each reads the signature in an order of its own. Nodes that share the first `LEAST_DEPTH` values of a tree form a
region. In a region the nodes stand in the tree's order, so that neighbours have the longest common prefixes; a region of up to
`BLOCK` nodes is compared within itself, a larger one first in overlapping runs of BLOCK neighbours, which share as many more
values as it takes to make the runs that small; no task needs a whole region: rows are range-partitioned by region and order.

Compared pairs whose signatures agree in at least `AGREE` of the values are candidates (four standard deviations below what a
similarity of 0.75 gives). In a run of more than `SMALL` nodes the first round passes on the strongest spanning forest of its candidates and
each node's best partners only. After these are confirmed, a second round takes the full sets to the runs that hold nodes of
different components, and confirms every other candidate there until its nodes are connected; so the rows that leave a run
never grow with the square of a group. Confirmation counts the common shingles of the two whole sets: 100 * intersection >= 75 * union.

With 24 trees of depth 3 a pair at exactly 0.75 is compared with probability 1 - (1 - 0.75^3)^24 > 0.999997 if its regions have up to
BLOCK nodes. Nodes of larger regions that still hold different components go through an exact join (`exact_links`): shingles
are ordered from rare to frequent, a linked pair shares one of the rarest n - ceil(6n/7) + 1 of its smaller set and n - ceil(3n/4) + 1 of
its larger one, and sizes and positions must allow the similarity. Only pairs of different components are formed, those of
frequent shingles in salted parts, and of two components `TRIES` pairs are confirmed before the others. So in such regions every pair
that shares one is found, whatever the crowd's similarity; a crowd below 0.75 shares its passage behind the rare shingles,
where it is no key. The cost grows with the pairs of different components that sizes and positions allow.

Null and empty texts have size 0 and their own component. Repeated rows have equal sets and are linked. A null id never is
a component's id unless all its ids are null. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import body, small, store, table, without
from .components import components
from .tokens import Words, chunks, mix

SHINGLE, PERCENT = 5, 75
HASHES, ORDERS, LEAST_DEPTH, BLOCK, SMALL, BEST = 128, 24, 3, 256, 4, 2
AGREE = 0.594
#: The exact join: buckets of shingle counts, rows of a shingle per salted part, pairs of two components confirmed first.
BUCKETS, PART, TRIES = 1 << 20, 2_000, 4
_LEAST = int(np.ceil(AGREE * HASHES))

_random = np.random.default_rng(7)
_FACTORS = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POSITION = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_DRAWN = np.concatenate([_random.permutation(HASHES) for _ in range(1 + ORDERS * LEAST_DEPTH // HASHES)])
#: The leading values of different trees are different as long as there are enough; the rest is any order.
_LEADING = _DRAWN[: ORDERS * LEAST_DEPTH].reshape(ORDERS, LEAST_DEPTH)
_TREES = np.stack([np.concatenate([lead, _random.permutation(np.setdiff1d(np.arange(HASHES), lead))]) for lead in _LEADING])


def _shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a chunk, by document and value, and n + 1 bounds per document."""
    words = Words(data, offsets)
    n = len(offsets) - 1
    hashes = np.concatenate([words.hash, np.zeros(size, np.uint64)])
    value = np.zeros(len(words.hash), np.uint64)
    left = words.bounds[1:][words.doc] - np.arange(len(words.hash))  # words from here to the end of the document
    for k in range(size):
        value += np.where(left > k, hashes[k : k + len(value)] * _POSITION[k], np.uint64(0))
    value = mix(value + np.minimum(left, size).astype(np.uint64) * _POSITION[63])
    first = np.zeros(len(value), bool)
    first[words.bounds[:-1][words.counts > 0]] = True
    whole = (left >= size) | first  # of a document with fewer words, all of them
    doc, value = words.doc[whole], value[whole]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[fresh], value[fresh]
    return value, np.searchsorted(doc, np.arange(n + 1))


def _per_doc(function, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    out = np.full(len(bounds) - 1, empty, values.dtype)
    has = np.flatnonzero(np.diff(bounds))
    if len(has):
        out[has] = function.reduceat(values, bounds[has])
    return out


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`doc_id, body, n_shingles, h1, h2, sig`: size, 128-bit hash and signature of each set."""

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column("text")):
                values, bounds = _shingles(data, offsets, shingle)
                sig = np.empty((last - first, HASHES), np.uint32)
                for k in range(HASHES):
                    sig[:, k] = _per_doc(np.minimum, values * _FACTORS[k], bounds, 0) >> np.uint64(32)
                h1, h2 = (_per_doc(np.add, mix(values ^ _POSITION[k]), bounds, 0) for k in (50, 51))
                ends = pa.py_buffer((np.arange(last - first + 1) * HASHES * 4).astype(np.int32))
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(first, last - first),
                        batch.column("body").slice(first, last - first),
                        pa.array(np.diff(bounds)),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        pa.Array.from_buffers(pa.binary(), last - first, [None, ends, pa.py_buffer(sig)]),
                    ],
                    ["doc_id", "body", "n_shingles", "h1", "h2", "sig"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("body"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, body long, n_shingles long, h1 long, h2 long, sig binary")


def narrow(nodes: DataFrame) -> DataFrame:
    """`node, sig`: one byte of each mixed value, so that other values agree by chance in one of 256 at any text length."""

    def run(batches):
        for batch in batches:
            short = (mix(_matrix(batch.column("sig"), np.uint32).astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)
            ends = pa.py_buffer((np.arange(len(short) + 1) * HASHES).astype(np.int32))
            yield pa.record_batch([batch.column("node"), pa.Array.from_buffers(pa.binary(), len(short), [None, ends, pa.py_buffer(short)])], ["node", "sig"])

    return nodes.select("node", "sig").mapInArrow(run, "node long, sig binary")


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def tree_rows(nodes: DataFrame) -> DataFrame:
    """`region, place, node`: for every tree the region of a node and a number that sorts it by its next eight values.

    A byte of a mixed value stands for the value: the top byte of a minimum over many shingles is 0 for nearly every text.
    """

    def run(batches):
        for batch in batches:
            sig = _matrix(batch.column("sig"), np.uint32).astype(np.uint64)
            for t, order in enumerate(_TREES):
                region = np.full(len(sig), t, np.uint64)
                for k in order[:LEAST_DEPTH]:
                    region = mix(region * _POSITION[60] + sig[:, k])
                place = np.zeros(len(sig), np.uint64)
                for k in order[LEAST_DEPTH : LEAST_DEPTH + 8]:
                    place = (place << np.uint64(8)) | (mix(sig[:, k]) >> np.uint64(56))
                yield pa.record_batch({"region": region.view(np.int64), "place": place.view(np.int64), "node": batch.column("node")})

    return nodes.select("node", "sig").mapInArrow(run, "region long, place long, node long")


def _forest_edges(agree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A strongest spanning forest; agree holds 0 where two rows are no candidates."""
    n = len(agree)
    best, parent, out = agree[0].copy(), np.zeros(n, np.int64), np.zeros(n, bool)
    out[0] = True
    edges = []
    for _ in range(n - 1):
        at = int(np.where(out, -1, best).argmax())
        if best[at] > 0:
            edges.append((parent[at], at))
        out[at] = True
        closer = agree[at] > best
        best[closer], parent[closer] = agree[at][closer], at
    pairs = np.array(edges, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _agreement(sig: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Agreeing values of each pair of rows above the diagonal; 0 for rows that are no candidates or connected already."""
    agree = np.zeros((len(sig), len(sig)), np.int16)
    for i in range(len(sig) - 1):
        agree[i, i + 1 :] = (sig[i + 1 :] == sig[i]).sum(1)
    agree[agree < _LEAST] = 0
    agree[group[:, None] == group[None, :]] = 0
    return agree


def _strongest(agree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of a run: all of them if they are few, else a strongest spanning forest and the best partners of each row."""
    one, two = np.nonzero(agree)
    if len(one) <= 2 * len(agree):
        return one, two
    agree = np.maximum(agree, agree.T)
    tree = _forest_edges(agree)
    top = np.argpartition(-agree, BEST, axis=1)[:, :BEST]
    near = np.repeat(np.arange(len(agree)), BEST), top.ravel()
    real = agree[near] > 0
    return np.concatenate([tree[0], near[0][real]]), np.concatenate([tree[1], near[1][real]])


def _linked(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(two) < len(one):
        one, two = two, one
    if not len(one):
        return False
    common = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())
    return 100 * common >= PERCENT * (len(one) + len(two) - common)


def _by_runs(batches, read, work):
    """Cut sorted rows into runs of a region, long ones into overlapping stretches of BLOCK, and yield the node pairs of `work`.

    `read` gives the columns of a batch as arrays, the region and the node first; `work` gets them with the starts and sizes of
    the runs, and returns two arrays of row numbers.
    """

    def pairs(columns, ended: bool):
        region, node = columns[:2]
        starts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
        sizes = np.diff(np.append(starts, len(region)))
        keep = 0
        if not ended:  # the last run may go on
            size = int(sizes[-1])
            keep = min(size, BLOCK // 2) if size > BLOCK else size
            if size <= BLOCK:
                starts, sizes = starts[:-1], sizes[:-1]
        long = sizes > BLOCK
        cuts = [np.arange(at, at + size - BLOCK // 2, BLOCK // 2) for at, size in zip(starts[long], sizes[long])]
        ends = [np.minimum(cut + BLOCK, at + size) for cut, at, size in zip(cuts, starts[long], sizes[long])]
        begins = np.concatenate([starts[~long], *cuts])
        spans = np.concatenate([sizes[~long], *(end - cut for end, cut in zip(ends, cuts))])
        one, two = work(columns, begins, spans)
        found = np.unique(np.stack([np.minimum(node[one], node[two]), np.maximum(node[one], node[two])], 1), axis=0)
        return pa.record_batch({"a": found[:, 0], "b": found[:, 1]}), keep

    held = None
    for batch in batches:
        if batch.num_rows:
            columns = read(batch)
            if held:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            found, keep = pairs(columns, False)
            held = [x[len(x) - keep :] for x in columns]
            yield found
    if held and len(held[0]):
        yield pairs(held, True)[0]


def _join(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in zip(*parts)) if parts else (none, none)


def candidates(rows: DataFrame) -> DataFrame:
    """`a, b` from stored rows `region, place, node, sig`: pairs to confirm, a bounded number per row."""

    def read(batch):
        return [batch.column("region").to_numpy(), batch.column("node").to_numpy(), _matrix(batch.column("sig"), np.uint8)]

    def work(columns, begins, spans):
        _, node, sig = columns
        parts = []
        for size in range(2, SMALL + 1):
            at = begins[spans == size]
            i, j = np.triu_indices(size, 1)
            one, two = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            for k in range(0, len(one), 1 << 14):
                p, q = one[k : k + (1 << 14)], two[k : k + (1 << 14)]
                good = (sig[p] == sig[q]).sum(1) >= _LEAST
                parts.append((p[good], q[good]))
        for begin, size in zip(begins[spans > SMALL], spans[spans > SMALL]):
            own = slice(begin, begin + size)
            one, two = _strongest(_agreement(sig[own], node[own]))
            parts.append((begin + one, begin + two))
        return _join(parts)

    ordered = rows.repartitionByRange("region", "place", "node").sortWithinPartitions("region", "place", "node")
    return ordered.select("region", "node", "sig").mapInArrow(lambda batches: _by_runs(batches, read, work), "a long, b long").distinct()


def links_in_runs(rows: DataFrame) -> DataFrame:
    """`a, b` from stored rows `region, place, node, group, sig, shingles`: confirmed links between rows of different groups.

    Every candidate of a run is looked at, the strongest first, unless its rows are connected by then; so the links of a run form a forest.
    """

    def read(batch):
        sets = np.empty(batch.num_rows, object)
        sets[:] = [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]
        return [*(batch.column(c).to_numpy() for c in ("region", "node", "group")), _matrix(batch.column("sig"), np.uint8), sets]

    def work(columns, begins, spans):
        _, _, group, sig, sets = columns
        parts = []
        for begin, size in zip(begins[spans > 1], spans[spans > 1]):
            own = slice(begin, begin + size)
            agree, root, inside = _agreement(sig[own], group[own]), group[own].copy(), sets[own]
            one, two = np.nonzero(agree)
            found = []
            for k in np.argsort(-agree[one, two], kind="stable"):
                i, j = one[k], two[k]
                if root[i] != root[j] and _linked(inside[i], inside[j]):
                    root[root == root[j]] = root[i]
                    found.append((i, j))
            if found:
                i, j = np.array(found).T
                parts.append((begin + i, begin + j))
        return _join(parts)

    ordered = rows.repartitionByRange("region", "place", "node").sortWithinPartitions("region", "place", "node")
    columns = ordered.select("region", "node", "group", "sig", "shingles")
    return columns.mapInArrow(lambda batches: _by_runs(batches, read, work), "a long, b long").distinct()


def shingle_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, doc_id: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """`node, shingles`: the full sorted sets of the wanted nodes, from the text of each node's first document."""
    listed = store(wanted.select("node").distinct().join(nodes.select("node", "first.*"), "node"), "near-wanted")
    listed = small(listed.select("node", F.col("doc_id").alias("_id"), F.col("body").alias("_body")))

    def sets(batches):
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column("text")):
                values, bounds = _shingles(data, offsets, shingle)
                ends = pa.py_buffer((bounds * 8).astype(np.int32))
                yield pa.record_batch(
                    [batch.column("node").slice(first, last - first), pa.Array.from_buffers(pa.binary(), last - first, [None, ends, pa.py_buffer(values)])],
                    ["node", "shingles"],
                )

    own = docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("body"), F.col(text).alias("text"))
    texts = own.join(listed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body"))).select("node", "text")
    return store(texts.mapInArrow(sets, "node long, shingles binary"), "near-sets")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def check(batches):
        for batch in batches:
            both = zip(batch.column("one").to_pylist(), batch.column("two").to_pylist())
            good = [_linked(np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)) for one, two in both]
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("one")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("two")), "b"
    )
    return both.select("a", "b", "one", "two").mapInArrow(check, "a long, b long").distinct()


def _bucket_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets fall into each bucket; it orders them, and a bucket with one shingle links nobody."""

    def count(batches):
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for value in batch.column("shingles"):
                at = np.frombuffer(value.as_buffer(), np.uint64) % np.uint64(BUCKETS)
                np.add.at(sums, at.astype(np.int64), 1)
        at = np.flatnonzero(sums)
        yield pa.record_batch({"bucket": at, "n": sums[at]})

    found = sets.select("shingles").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def _postings(sets: DataFrame) -> DataFrame:
    """`shingle, node, group, n, at, short` from stored `node, group, shingles`: the rarest shingles that a link needs.

    `at` is the place in the order from rare to frequent; `short` marks those needed towards sets that are not smaller.
    """
    counts = sets.sparkSession.sparkContext.broadcast(_bucket_counts(sets))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                values = np.frombuffer(batch.column("shingles")[row].as_buffer(), np.uint64)
                often = counts.value[(values % np.uint64(BUCKETS)).astype(np.int64)]
                n = len(values)
                order = np.lexsort((values, often))[: n - (PERCENT * n + 99) // 100 + 1]
                at = np.flatnonzero(often[order] > 1)
                both = 100 + PERCENT
                short = at < n - (2 * PERCENT * n + both - 1) // both + 1
                same = lambda c: np.full(len(at), batch.column(c)[row].as_py(), np.int64)
                yield pa.record_batch(
                    {"shingle": values[order[at]].view(np.int64), "node": same("node"), "group": same("group"), "n": np.full(len(at), n), "at": at, "short": short}
                )

    return sets.select("node", "group", "shingles").mapInArrow(run, "shingle long, node long, group long, n long, at long, short boolean")


def exact_pairs(sets: DataFrame) -> DataFrame:
    """`a, b, one_group, two_group`: every pair of different groups that may be similar enough, from stored `node, group, shingles`."""
    posted = store(_postings(sets), "near-postings")
    sizes = posted.groupBy("shingle", "group").agg(F.count(F.lit(1)).alias("n"), F.max("short").alias("short"))
    keys = (
        sizes.groupBy("shingle")
        .agg(F.max_by("group", F.struct("n", "group")).alias("main"), F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"), F.max("short").alias("short"))
        .where("groups > 1 AND short")
        .select("shingle", "main", F.ceil(F.col("rows") / PART).cast("int").alias("parts"))
    )
    live = store(posted.join(keys, "shingle").withColumn("is_main", F.col("group") == F.col("main")).drop("main"), "near-keys")
    # Pairs within the largest group of a shingle are never formed; those within another group are left out below.
    salt = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    left = live.where("short").select("shingle", salt.alias("part"), *(F.col(c).alias(f"{c}_1") for c in ("node", "group", "n", "at", "is_main")))
    spread = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    right = live.select("shingle", spread, *(F.col(c).alias(f"{c}_2") for c in ("node", "group", "n", "at", "is_main")))
    sides = (left.where("is_main_1"), right.where("NOT is_main_2")), (left.where("NOT is_main_1"), right)
    may = (
        "group_1 <> group_2 AND (n_1 < n_2 OR (n_1 = n_2 AND node_1 < node_2)) "
        f"AND 100 * n_1 >= {PERCENT} * n_2 AND {100 + PERCENT} * least(n_1 - at_1, n_2 - at_2) >= {PERCENT} * (n_1 + n_2)"
    )
    one, two = (x.join(y, ["shingle", "part"]).where(may).select("node_1", "node_2", "group_1", "group_2") for x, y in sides)
    return one.union(two).distinct().toDF("a", "b", "one_group", "two_group")


def exact_links(sets: DataFrame) -> DataFrame:
    """`a, b` from stored `node, group, shingles`: links that connect all groups with a link between them."""
    pairs = store(exact_pairs(sets), "near-exact")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    low, high = F.least("one_group", "two_group"), F.greatest("one_group", "two_group")
    ranked = pairs.withColumn("try", F.row_number().over(Window.partitionBy(low, high).orderBy(F.xxhash64("a", "b"), "a", "b")))
    first = store(confirm(ranked.where(F.col("try") <= TRIES).select("a", "b"), sets), "near-links")
    # The others matter only where their groups are not connected by now.
    ends = sets.select("node", "group").join(first.select(F.col("a").alias("node")).union(first.select("b")).distinct(), "node").select("node", "group")
    grouped = first.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select("x", "y")
    joined = components(store(grouped.distinct(), "near-joined"), "x", "y")
    untried = ranked.where(F.col("try") > TRIES).select("a", "b", "one_group", "two_group")
    rest = untried.join(joined.toDF("one_group", "x"), "one_group", "left").join(joined.toDF("two_group", "y"), "two_group", "left")
    rest = rest.where(F.coalesce("x", "one_group") != F.coalesce("y", "two_group")).select("a", "b")
    return first.union(confirm(store(rest, "near-rest"), sets))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`doc_id, body, n_shingles, component_id, kept` of every row."""
    signed = store(signatures(docs, doc_id, text, shingle), "near-signatures")
    grouped = (
        signed.where("n_shingles > 0")
        .groupBy("h1", "h2")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "body")).alias("first"), F.first("sig").alias("sig"))
    )
    nodes = store(grouped.withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    rows = store(tree_rows(nodes), "near-trees")
    crowds = rows.groupBy("region").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")

    live = store(rows.join(crowds, "region").join(narrow(nodes), "node"), "near-live")

    pairs = store(candidates(live), "near-pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    roots = components(store(confirm(pairs, shingle_sets(docs, nodes, ends, doc_id, text, shingle)), "near-links"))

    # Runs of which only some candidates were passed on, as far as they hold nodes of different components.
    known = roots.select(F.col("u").alias("node"), F.col("v").alias("root"))
    crowded = live.where(F.col("crowd") > SMALL).join(known, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root")
    crowded = store(crowded, "near-crowded")
    mixed = crowded.groupBy("region").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("region")
    crowded = store(crowded.join(mixed, "region", "left_semi"), "near-mixed")
    if not crowded.isEmpty():
        sets = shingle_sets(docs, nodes, crowded, doc_id, text, shingle)
        again = links_in_runs(crowded.join(sets, "node"))
        roots = components(again.union(roots.select("u", "v")).toDF("a", "b"))

    # Regions that runs cannot compare whole, as far as they hold nodes of different components.
    known = roots.select(F.col("u").alias("node"), F.col("v").alias("root"))
    wide = live.where(F.col("crowd") > BLOCK).select("region", "node").join(known, "node", "left")
    wide = store(wide.select("region", "node", F.coalesce("root", "node").alias("group")), "near-wide")
    open_ = wide.groupBy("region").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("region")
    wide = store(wide.join(open_, "region", "left_semi").select("node", "group").distinct(), "near-open")
    if not wide.isEmpty():
        sets = store(wide.join(shingle_sets(docs, nodes, wide, doc_id, text, shingle), "node"), "near-open-sets")
        roots = components(exact_links(sets).union(roots.select("u", "v")).toDF("a", "b"))

    least = F.struct(F.col("first.without"), F.col("first.doc_id").alias("doc_id"))
    rooted = nodes.join(roots, nodes["node"] == roots["u"], "left").select("h1", "h2", F.coalesce("v", "node").alias("root"), least.alias("least"))
    lowest = store(rooted.groupBy("root").agg(F.min("least").alias("lowest")), "near-lowest")
    named = store(rooted.join(small(lowest), "root").select("h1", "h2", F.col("lowest.doc_id").alias("component_id")), "near-components")
    own = signed.select("doc_id", "body", "n_shingles", "h1", "h2")
    linked = own.where("n_shingles > 0").join(named, ["h1", "h2"]).select("doc_id", "body", "n_shingles", "component_id")
    alone = own.where("n_shingles = 0").select("doc_id", "body", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that have their component's id; rows that share an id with it stay as well."""
    gone = near_duplicates(docs, doc_id, text).where("NOT kept").select("doc_id", "body").distinct()
    return without(docs, store(gone, "near-dropped"), doc_id, text)


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("body")


QUERIES = {"op6_near_dedup": op6_near_dedup}

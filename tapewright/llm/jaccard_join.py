"""Near-duplicate join on word shingles by count-vector R-trees.

A document's shingles are hashed into groups, about as many as it has shingles (a power of
two); the counts of its groups are a point. The summed minima of two points bound the overlap
of their sets from above; points of different lengths are compared after the finer one's
neighbouring groups are added up. An R-tree over points of GROUPS groups, with the largest
counts below as a node's upper corner, finds the candidates of a document, the full points
turn most of them away, and survivors are verified on their whole shingle sets.

One tree over a corpus would be searched by every document, and the counts of unrelated
texts of one length overlap too much for its upper levels to turn anybody away. So
the points are first dealt into cells. Sets that overlap by three quarters share one of their
first n - ceil(3n/4) + 1 shingles in any fixed order, so each set goes to the cells of
those shingles; the order puts shingles that many documents share last, which keeps
common passages from making large cells. The order decides speed only.

The first shingle that two sets share in that order has n - i shingles of one set and m - j of the other at it
and behind it, i and j its places there. Where these are fewer than the overlap that a link of n and m needs, the two need
not meet, so a node leaves a cell of up to SMALL entries in which no other is near enough for it.

A shingle that very many sets share (HOT_ENTRIES documents or more) is not gathered in one
place: its entries stay spread, and its cell is named by an aggregate.

Equal sets are one node from the start. In a cell of up to SMALL nodes (two leaves of a tree)
all pairs that pass the bound are verified. In a larger one every node first meets HUBS nodes of the
cell; nodes that link through them are one component, and pairs within a component need no
second look. Then the nodes outside a large cell's largest component search trees over all of its
nodes, BLOCK nodes a tree. So no link between components is lost, and a group of thousands of copies
costs a few comparisons a copy. No task holds a whole cell: counts and hubs are aggregates,
and the nodes of large cells are dealt in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import remove, scratch, small_batches, stored, without

WORDS = 5
GROUP_BITS, MOST_GROUP_BITS = 6, 16
GROUPS = 1 << GROUP_BITS
SMALL, HUBS, TILE, BLOCK = 64, 8, 256, 4096
LEAF, FAN = 32, 16
PREFIX_ENTRIES = 1_000_000
HOT_ENTRIES = 10_000
HOT_SHARE = 500
FLUSH_ENTRIES = 1_000_000
PLACES = 12
MARKS = 1 << 25


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _window_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of each run of ``width`` words: xxh3 of the words, stirred one after the other."""
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mixed(out) ^ own[k : k + n]
    return mixed(out)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles; none without words."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    out = _window_hashes(words, min(WORDS, len(words)))
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is 0.75 or more."""
    if not len(a) or not len(b) or 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    merged = np.concatenate([a, b])
    merged.sort()
    both = int((merged[1:] == merged[:-1]).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)


def least_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Shingles that sets of n and m must share at least: ceil(75 (n + m) / 175)."""
    return -(-(3 * (n + m)) // 7)


def point(shingle_set: np.ndarray) -> bytes:
    """The counts of a set's groups: a byte with log2 of the groups (128 added for two-byte counts), then the packed counts."""
    bits = min(max(GROUP_BITS, int(len(shingle_set)).bit_length()), MOST_GROUP_BITS)
    counts = np.bincount((shingle_set >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    wide = counts.max() > 255
    if counts.max() > 65535:
        raise ValueError("a text of over 65535 shingles in one group")  # over a billion words
    return bytes([bits | 128 * wide]) + zstandard.ZstdCompressor(1).compress(counts.astype("<u2" if wide else np.uint8).tobytes())


def counts_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), "<u2" if packed[0] & 128 else np.uint8)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The counts of fewer groups: neighbours share their leading hash bits, so they add up."""
    return counts if len(counts) == groups else counts.reshape(groups, -1).sum(1, dtype=np.int64)


class Points:
    """The full points of a group of sets, stacked by length, so that one meets many at once."""

    def __init__(self, full: list[np.ndarray], sizes: np.ndarray):
        self.full, self.sizes = full, sizes
        self.length = np.array([len(x) for x in full])
        self.row = np.zeros(len(full), np.int64)
        self.stacks = {}
        for n in np.unique(self.length):
            at = np.flatnonzero(self.length == n)
            self.row[at] = np.arange(len(at))
            self.stacks[int(n)] = np.stack([full[k] for k in at])

    def may_link(self, q: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that leave room for a link with ``q``."""
        fits = np.zeros(len(others), bool)
        for n, stack in self.stacks.items():
            at = np.flatnonzero(self.length[others] == n)
            if len(at):
                groups = min(n, len(self.full[q]))
                theirs = stack[self.row[others[at]]].astype(np.int32).reshape(len(at), groups, -1).sum(2)
                both = np.minimum(theirs, folded(self.full[q], groups)).sum(1)
                fits[at] = both >= least_overlap(self.sizes[others[at]], self.sizes[q])
        m = self.sizes[others]
        return others[fits & (4 * np.minimum(m, self.sizes[q]) >= 3 * np.maximum(m, self.sizes[q]))]


class CountTree:
    """A packed R-tree over count vectors; a node keeps the largest count of each group and the range of set sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.arange(len(points))
        self.order = self._tiles(points, order)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        upper, low, high, fan = self.points, self.sizes, self.sizes, LEAF
        while len(upper) > 1:
            cut = np.arange(0, len(upper), fan)
            upper, low, high = np.maximum.reduceat(upper, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((upper, low, high, fan))
            fan = FAN
            if len(upper) <= FAN:
                break

    @staticmethod
    def _tiles(points: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Cuts in half along the group of the widest spread until a leaf is left."""
        stack, out = [order], []
        while stack:
            part = stack.pop()
            if len(part) <= LEAF:
                out.append(part)
                continue
            own = points[part]
            axis = int((own.max(0) - own.min(0)).argmax())
            half = LEAF * max(1, round(len(part) / LEAF / 2))
            by = part[np.argsort(own[:, axis], kind="stable")]
            stack += [by[half:], by[:half]]
        return np.concatenate(out) if out else order

    def search(self, q: np.ndarray, n: int) -> np.ndarray:
        """Places (in the caller's numbering) of the points whose sets may overlap enough with that of ``q``."""
        at = None
        for upper, low, high, fan in reversed(self.levels):
            if at is None:
                at = np.arange(len(upper))
            if not len(at):
                return at
            fits = (4 * high[at] >= 3 * n) & (3 * low[at] <= 4 * n) & (np.minimum(upper[at], q).sum(1) >= least_overlap(n, low[at]))
            below = len(self.points) if fan == LEAF else len(self._below(fan, upper))
            at = (at[fits][:, None] * fan + np.arange(fan)).ravel()
            at = at[at < below]
        if at is None:
            at = np.arange(len(self.points))
        m = self.sizes[at]
        fits = (4 * m >= 3 * n) & (3 * m <= 4 * n) & (np.minimum(self.points[at], q).sum(1) >= least_overlap(n, m))
        return self.order[at[fits]]

    def _below(self, fan: int, upper: np.ndarray) -> np.ndarray:
        k = next(i for i, level in enumerate(self.levels) if level[0] is upper)
        return self.levels[k - 1][0]


# ---------------------------------------------------------------- signatures

SIGNATURE = "doc_id long, n long, node long, counts binary, common long, times long"
_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("counts", pa.binary()), ("common", pa.int64()), ("times", pa.int64())])


def node_of(shingle_set: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingle_set.tobytes()) - 2**63


def _sign(batches) -> Iterator[pa.RecordBatch]:
    """A row per document, and rows for shingles that several documents of a task share."""
    held: list[np.ndarray] = []
    size = 0

    def common():
        flat = np.sort(np.concatenate(held))
        start = np.concatenate([[0], np.flatnonzero(flat[1:] != flat[:-1]) + 1]) if len(flat) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([start, [len(flat)]]))
        values, times = flat[start[times >= 3]], times[times >= 3]
        none = pa.nulls(len(values))
        return pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(values.view(np.int64)), pa.array(times.astype(np.int64))], schema=_SIGNATURE)

    for batch in batches:
        rows = []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            own = shingles(text)
            rows.append((len(own), node_of(own), point(own)))
            held.append(own)
            size += len(own)
            if size > 2 * FLUSH_ENTRIES:
                yield common()
                held, size = [], 0
        n, node, counts = zip(*rows, strict=True) if rows else ((), (), ())
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(counts, pa.binary()), none, none], schema=_SIGNATURE)
    if held:
        yield common()


# --------------------------------------------------------------------- cells


def in_order(shingle_set: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set's shingles in the fixed order: rare ones by hash, then common ones by how common they are."""
    if not len(common):
        return shingle_set
    at = np.minimum(np.searchsorted(common, shingle_set), len(common) - 1)
    is_common = common[at] == shingle_set
    last = shingle_set[is_common]
    return np.concatenate([shingle_set[~is_common], last[np.argsort(rank[at[is_common]], kind="stable")]])


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (3 * n + 3) // 4 + 1


_CELL_PART = "bucket int, nodes binary, sizes binary, counts binary, shingles binary, places binary"


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(values.tobytes())


def _unpacked(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)


def _deal(common: np.ndarray, rank: np.ndarray, buckets: int, hot: np.ndarray):
    """Each set's prefix, dealt into buckets of shingle hashes; one row a bucket and flush.

    Within a bucket 32 bits more tell shingles apart: of a million others 1 in 4,000 finds one that looks the same, and cells that
    fall together so lose nothing. A shingle's place in the prefix goes along in PLACES steps. Entries of hot shingles go to any bucket, in rows without sizes.
    """

    def run(batches):
        nodes: list[int] = []
        sizes: list[int] = []
        prefixes: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def flush():
            flat = np.concatenate(prefixes)
            lengths = np.array([len(p) for p in prefixes])
            of = np.repeat(np.arange(len(nodes)), lengths)
            place = ((np.arange(len(flat)) - (np.cumsum(lengths) - lengths)[of]) * PLACES // lengths[of]).astype(np.uint8)
            keys, own_sizes = np.array(nodes, np.int64), np.array(sizes, np.uint32)
            out = [[], [], [], [], [], []]
            is_hot = np.isin(flat, hot) if len(hot) else np.zeros(len(flat), bool)
            if is_hot.any():
                for column, value in zip(out, (nodes[0] % buckets, keys[of[is_hot]].tobytes(), None, None, flat[is_hot].tobytes(), None), strict=True):
                    column.append(value)
                flat, of, place = flat[~is_hot], of[~is_hot], place[~is_hot]
            bucket = (flat % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")  # within a bucket by node
            flat, of, bucket, place = flat[order], of[order], bucket[order], place[order]
            rest = (flat // np.uint64(buckets)).astype(np.uint32)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                first = np.concatenate([[0], np.flatnonzero(np.diff(of[a:b])) + 1])
                out[0].append(int(bucket[a]))
                out[1].append(keys[of[a:b][first]].tobytes())
                out[2].append(_packed(own_sizes[of[a:b][first]]))
                out[3].append(_packed(np.diff(np.concatenate([first, [b - a]])).astype(np.uint32)))
                out[4].append(rest[a:b].tobytes())
                out[5].append(_packed(place[a:b]))
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["bucket", "nodes", "sizes", "counts", "shingles", "places"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                own = shingles(text)
                n = len(own)
                node = node_of(own)
                if not n or node in seen:
                    continue
                seen.add(node)
                prefix = in_order(own, common, rank)[: prefix_length(n)]
                nodes.append(node)
                sizes.append(n)
                prefixes.append(prefix)
                size += len(prefix)
                if size > FLUSH_ENTRIES:
                    yield flush()
                    nodes, sizes, prefixes, size = [], [], [], 0
                    seen.clear()
        if nodes:
            yield flush()

    return run


CELL = "cell long, node long, at long"


def _at(node: np.ndarray) -> np.ndarray:
    """The number by which the node that names a cell is chosen: the smallest names it."""
    return (mixed(node.view(np.uint64)) ^ np.uint64(1 << 63)).view(np.int64)


def near_enough(n: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which entries of cells, one cell after the other, may link with another of their cell by the places of the cell's shingle.

    Sets of n and m whose first common shingle has the places i and j share min(n - i, m - j) at most.
    Cells of over SMALL entries stay whole.
    """
    behind = n + (-place.astype(np.int64) * prefix_length(n)) // PLACES  # n - i at most, as steps round places down
    of = np.repeat(np.arange(len(length)), length)
    stays = np.repeat(length > SMALL, length)
    a = np.flatnonzero(~stays)
    for d in range(1, int(length[length <= SMALL].max(initial=0))):
        a = a[a + d < len(of)]
        a = a[of[a] == of[a + d]]
        b = a + d
        fits = (4 * np.minimum(n[a], n[b]) >= 3 * np.maximum(n[a], n[b])) & (np.minimum(behind[a], behind[b]) >= least_overlap(n[a], n[b]))
        stays[a[fits]] = True
        stays[b[fits]] = True
    return stays


def _gather(batches) -> Iterator[pa.RecordBatch]:
    """The cells (cell, node) of a bucket that hold two nodes or more; the node that names a cell goes without saying.

    A cell ends where the next larger set is too large for a link, so sizes far apart never meet. It is
    named after its node with the smallest hash, and cells of one name are one: copies
    share many shingles, but meet once. Entries of hot shingles come out as (shingle, node, at).
    """
    nodes, sizes, shared, places = [], [], [], []
    for batch in batches:
        for _, keys, own_sizes, counts, flat, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own_sizes is None:
                node, shingle = np.frombuffer(keys, np.int64), np.frombuffer(flat, np.int64)
                for low in range(0, len(node), 100_000):
                    some = node[low : low + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(shingle[low : low + 100_000]), pa.array(some), pa.array(_at(some))], names=["cell", "node", "at"])
                continue
            times = _unpacked(counts, np.uint32)
            nodes.append(np.repeat(np.frombuffer(keys, np.int64), times))
            sizes.append(np.repeat(_unpacked(own_sizes, np.uint32), times))
            shared.append(np.frombuffer(flat, np.uint32))
            places.append(_unpacked(place, np.uint8))
    if not nodes:
        return
    node, n, shingle, place = np.concatenate(nodes), np.concatenate(sizes), np.concatenate(shared), np.concatenate(places)
    order = np.lexsort((place, node, n, shingle))
    node, n, shingle, place = node[order], n[order].astype(np.int64), shingle[order], place[order]
    fresh = np.concatenate([[True], (node[1:] != node[:-1]) | (shingle[1:] != shingle[:-1])])
    node, n, shingle, place = node[fresh], n[fresh], shingle[fresh], place[fresh]
    first = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (3 * n[1:] > 4 * n[:-1])])
    length = np.diff(np.concatenate([np.flatnonzero(first), [len(node)]]))
    several = np.repeat(length > 1, length)
    node, n, place, length = node[several], n[several], place[several], length[length > 1]
    stays = near_enough(n, place, length)
    length = np.bincount(np.repeat(np.arange(len(length)), length)[stays], minlength=len(length))
    node, length = node[stays], length[length > 0]
    if not len(node):
        return
    start = np.cumsum(length) - length
    of = np.repeat(np.arange(len(start)), length)
    named = node[np.lexsort((_at(node), of))[start]]  # each cell's node with the smallest hash
    cell = named[of]
    cell, node = cell[cell != node], node[cell != node]
    order = np.lexsort((node, cell))
    cell, node = cell[order], node[order]
    fresh = np.concatenate([[True], (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])])
    cell, node = cell[fresh], node[fresh]
    for low in range(0, len(cell), 100_000):
        some = [pa.array(c[low : low + 100_000]) for c in (cell, node)]
        yield pa.RecordBatch.from_arrays([*some, pa.nulls(len(some[0]), pa.int64())], names=["cell", "node", "at"])


def _named(met: DataFrame, most_common: int) -> DataFrame:
    """(cell, node), each once, with the cells of hot shingles named like the others."""
    hot = met.where("at is not null")
    names = hot.groupBy("cell").agg(F.min(F.struct("at", "node")).alias("_first")).select(F.col("cell").alias("_shingle"), F.col("_first.node").alias("_name"))
    # at most most_common rows, as no more shingles are hot
    hot = hot.join(F.broadcast(names.limit(most_common)), F.col("cell") == F.col("_shingle")).select(F.col("_name").alias("cell"), "node").where("cell <> node")
    return met.where("at is null").select("cell", "node").unionByName(hot).dropDuplicates(["cell", "node"])


def _with_info(rows: DataFrame, info: DataFrame, weight: str, total: int, key: str = "cell") -> DataFrame:
    """``rows`` with the columns of ``info``, one row a key, of which ``weight`` tells the key's rows.

    Keys with more than one row in HOT_SHARE, so HOT_SHARE of them at most, are broadcast; their rows stay where they are.
    """
    hot = F.col(weight) > max(1000, total // HOT_SHARE)
    renamed = info.withColumnRenamed(key, "_key")
    large = F.broadcast(renamed.where(hot))
    met = rows.join(large, F.col(key) == F.col("_key"))
    other = rows.join(F.broadcast(renamed.where(hot).select("_key")), F.col(key) == F.col("_key"), "left_anti").join(renamed.where(~hot), F.col(key) == F.col("_key"))
    return met.unionByName(other).drop("_key")


def narrowed(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose long ``key`` is in the one column of ``wanted``, and some others: for a join that would move all rows otherwise.

    The wanted keys' hashes are marks in a map of MARKS bits, so what is broadcast is bounded, however many keys
    there are; with a million of them 3 % of the other rows come along, with MARKS of them 63 %.
    """
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(MARKS))
    bit = F.expr("shiftleft(1L, int(_slot % 64))")
    marked = wanted.toDF(key).select(slot.alias("_slot")).select(F.shiftright("_slot", 6).alias("_word"), bit.alias("_bit"))
    marks = marked.groupBy("_word").agg(F.bit_or("_bit").alias("_marks"))
    met = rows.withColumn("_slot", slot).join(F.broadcast(marks), (F.shiftright("_slot", 6) == F.col("_word")) & (F.col("_marks").bitwiseAND(bit) != 0), "left_semi")
    return met.drop("_slot")


def _with_hubs(own: DataFrame, path: str) -> DataFrame:
    """cell, node, rows and is_hub of the met nodes and of the node that names the cell: the cell's size, and whether the node is one of its hubs.

    Hubs are the name and the nodes with the smallest of HUBS - 1 hashes, which aggregates find.
    """
    hashes = [F.xxhash64("node", F.lit(k)) for k in range(HUBS - 1)]
    info = stored(own.groupBy("cell").agg((F.count(F.lit(1)) + 1).alias("rows"), *(F.min(h).alias(f"_h{k}") for k, h in enumerate(hashes))), f"{path}/info")
    total = info.agg(F.sum("rows")).first()[0] or 0
    is_hub = reduce(lambda a, b: a | b, (h == F.col(f"_h{k}") for k, h in enumerate(hashes)))
    met = _with_info(own, info, "rows", total).select("cell", "node", "rows", ((F.col("rows") > SMALL) & is_hub).alias("is_hub"))
    return met.unionByName(info.select("cell", F.col("cell").alias("node"), "rows", (F.col("rows") > SMALL).alias("is_hub")))


# -------------------------------------------------------------- verification


def _compare(batches) -> Iterator[pa.RecordBatch]:
    """Rows (hub, part, node, text) with a hub's own text before the others: the linked pairs."""
    hub, own = None, None
    for batch in batches:
        out: tuple[list, list] = ([], [])
        columns = [*batch.columns[:3], batch.column(3).cast(pa.binary())]
        for key, part, node, text in zip(*(c.to_pylist() for c in columns), strict=True):
            if node is None:
                hub, own = (key, part), shingles(text)
            elif (key, part) == hub and linked(own, shingles(text)):
                out[0].append(key)
                out[1].append(node)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["hub", "node"])


def _verify(pairs: DataFrame, texts: DataFrame, path: str) -> DataFrame:
    """The linked pairs among ``pairs`` (hub, node). A hub's text goes once to each part of its partners."""
    left = pairs.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(64)).cast("int"))
    hubs = left.select("hub", "part").distinct()
    text = texts.select(F.col("node").alias("_t"), "text")
    rows = left.join(text, F.col("node") == F.col("_t")).select("hub", "part", "node", "text").unionByName(
        hubs.join(text, F.col("hub") == F.col("_t")).select("hub", "part", F.lit(None).cast("long").alias("node"), "text")
    )
    ordered = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.asc_nulls_first("node"))
    return stored(ordered.mapInArrow(_compare, "hub long, node long"), f"{path}/links")


def _thinned(edges: DataFrame, path: str) -> DataFrame:
    """Fewer edges (hub, node), hub the smaller, that join the same nodes: about one a node, however many hubs it met.

    Of a node's smaller neighbours the smallest keeps the edge; the others get an edge to that one instead, and
    the nodes of one group give the same such edges.
    """
    own = stored(edges.select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node")).distinct(), f"{path}/edges")
    info = stored(own.groupBy("node").agg(F.min("hub").alias("_least"), F.count(F.lit(1)).alias("_met")), f"{path}/least")
    met = _with_info(own, info, "_met", own.count(), "node")
    return met.select(F.col("_least").alias("hub"), F.when(F.col("hub") == F.col("_least"), F.col("node")).otherwise(F.col("hub")).alias("node")).distinct()


def components(edges: DataFrame, path: str) -> DataFrame:
    """(node, comp) of all nodes of ``edges`` (hub, node); comp is the component's smallest node.

    Edges are thinned first, so the steps cost the nodes and not the links of a group. Each step takes the smallest label among the neighbours and then the label of that
    label, so long chains shrink fast; labels only fall, so the steps end.
    """
    edges = stored(_thinned(edges, path), f"{path}/thinned")
    both = stored(edges.select(F.col("hub").alias("a"), F.col("node").alias("b")).unionByName(edges.select(F.col("node").alias("a"), F.col("hub").alias("b"))).distinct(), f"{path}/both")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), f"{path}/labels-0")
    for step in count(1):
        heard = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "comp")
        lower = labels.unionByName(heard).groupBy("node").agg(F.min("comp").alias("comp"))
        jump = labels.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        new = lower.join(jump, F.col("comp") == F.col("_n"), "left").select("node", F.least("comp", F.coalesce("_c", "comp")).alias("comp"))
        new = stored(new, f"{path}/labels-{step}")
        old = labels.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        changed = new.join(old, (F.col("node") == F.col("_n")) & (F.col("comp") == F.col("_c")), "left_anti")
        labels = new
        if changed.isEmpty():
            return labels


def _groups(batches) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same first three columns, as the key and the rest."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != key:
                if held:
                    yield key, held
                key, held = row[:3], []
            held.append(row[3:])
    if held:
        yield key, held


def _pair_batches(found: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int]] = []
    for pair in found:
        out.append(pair if pair[0] < pair[1] else pair[::-1])
        if len(out) == 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["hub", "node"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["hub", "node"])


def _first_search(small: int):
    """Rows (cell, tile, rows, node, is_hub, counts) by cell and tile: of cells of up to ``small`` nodes all pairs that pass the bound, of others those with a hub."""

    def found(batches) -> Iterator[tuple[int, int]]:
        for (_, _, rows), held in _groups(batches):
            full = [counts_of(r[2]) for r in held]
            points = np.stack([folded(x, GROUPS) for x in full]).astype(np.int32)
            sizes = points.sum(1, dtype=np.int64)
            whole = Points(full, sizes)
            for q in range(len(held)) if rows <= small else (k for k, r in enumerate(held) if r[1]):
                m = sizes if rows > small else sizes[:q]
                near = (4 * np.minimum(m, sizes[q]) >= 3 * np.maximum(m, sizes[q])) & (np.minimum(points[: len(m)], points[q]).sum(1) >= least_overlap(sizes[q], m))
                for k in whole.may_link(q, np.flatnonzero(near)) if near.any() else ():
                    if k != q:
                        yield held[k][0], held[q][0]

    return lambda batches: _pair_batches(found(batches))


def _first_pairs(cells: DataFrame, points: DataFrame) -> DataFrame:
    own = narrowed(points, "node", cells.select("node")).select(F.col("node").alias("_p"), "counts")
    tiles = F.when(F.col("rows") > SMALL, F.ceil(F.col("rows") / TILE).cast("int")).otherwise(1)
    tile = F.when(F.col("is_hub"), F.sequence(F.lit(0), tiles - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), tiles.cast("long")).cast("int")))
    dealt = cells.join(own, F.col("node") == F.col("_p")).select("cell", F.explode(tile).alias("tile"), "rows", "node", "is_hub", "counts")
    return dealt.repartition("cell", "tile").sortWithinPartitions("cell", "tile", "node").mapInArrow(_first_search(SMALL), "hub long, node long").distinct()


def _tree_search(batches) -> Iterator[pa.RecordBatch]:
    """Rows (cell, tile, ask_tile, asks, node, comp, counts) by block: pairs of different components that the tree of the block's tile lets through."""

    def found() -> Iterator[tuple[int, int]]:
        for _, held in _groups(batches):
            asks = np.array([r[0] for r in held])
            nodes, comps = (np.array([r[k] for r in held], np.int64) for k in (1, 2))
            build, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
            if not len(build) or not len(asking):
                continue
            full = [counts_of(r[3]) for r in held]
            points = np.stack([folded(x, GROUPS) for x in full]).astype(np.int32)
            sizes = points.sum(1, dtype=np.int64)
            whole = Points(full, sizes)
            tree = CountTree(points[build], sizes[build])
            for q in asking:
                near = build[tree.search(points[q], int(sizes[q]))]
                for k in whole.may_link(int(q), near[comps[near] != comps[q]]):
                    yield int(nodes[k]), int(nodes[q])

    return _pair_batches(found())


def _tree_pairs(cells: DataFrame, labels: DataFrame, points: DataFrame, path: str) -> DataFrame:
    """Pairs (hub, node) of different components in one large cell that pass the bound, each once.

    Only nodes outside the cell's largest component ask; every pair of different components has one.
    A tile of nodes goes once to each tile of those that ask, and they to each tile.
    """
    named = labels.select(F.col("node").alias("_n"), F.col("comp").alias("_comp"))
    large = stored(cells.where(F.col("rows") > SMALL).join(named, F.col("node") == F.col("_n"), "left").select("cell", "node", F.coalesce("_comp", "node").alias("comp")), f"{path}/large")
    of_comp = large.groupBy("cell", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed_cells = of_comp.groupBy("cell").agg(F.max(F.struct("n", "comp")).alias("_main"), F.sum("n").alias("_all")).where(F.col("_all") > F.col("_main.n"))
    info = stored(mixed_cells.select("cell", "_all", F.col("_main.comp").alias("_most"), (F.col("_all") - F.col("_main.n")).alias("_asking")), f"{path}/mixed")
    total = info.agg(F.sum("_all")).first()[0]
    if not total:
        return large.where("1 = 0").select(F.col("cell").alias("hub"), "node")
    own = narrowed(points, "node", large.select("node")).select(F.col("node").alias("_p"), "counts")
    rows = _with_info(large, info, "_all", total).join(own, F.col("node") == F.col("_p"))
    # where few nodes ask, small tiles spread the cell; where many do, large ones keep the copies few
    tiles = F.ceil(F.col("_all") / F.least(F.lit(BLOCK), F.greatest(F.lit(2 * TILE), F.col("_asking")))).cast("int")
    ask_tiles = F.ceil(F.col("_asking") / BLOCK).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    tile = lambda n: F.pmod(F.xxhash64("node"), n.cast("long")).cast("int")
    build = rows.select("cell", tile(tiles).alias("tile"), each(ask_tiles).alias("ask_tile"), F.lit(False).alias("asks"), "node", "comp", "counts")
    ask = rows.where(F.col("comp") != F.col("_most")).select("cell", each(tiles).alias("tile"), tile(ask_tiles).alias("ask_tile"), F.lit(True).alias("asks"), "node", "comp", "counts")
    dealt = build.unionByName(ask).repartition("cell", "tile", "ask_tile").sortWithinPartitions("cell", "tile", "ask_tile", "node")
    return dealt.mapInArrow(_tree_search, "hub long, node long").distinct()


# ---------------------------------------------------------------------- join


def near_duplicates(docs: DataFrame, frequent: int = 16, most_common: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id and links_used.

    links_used counts the verified links of the document's shingle set that the components
    rest on (not all links of a large group). Null texts and texts without words have an empty
    set and are linked with nothing. Documents with equal sets are linked; rows repeated with one
    doc_id are one document. component_id is the smallest doc_id that can be reached; a null
    doc_id is reached by none and has a null component if it stands alone. Other columns are
    ignored; an empty table gives no rows. Whole texts are read, however long.

    frequent and most_common: shingles that so many documents share come last in the order
    of prefixes, the most common ones at the end. They decide speed only. A shingle that
    isn't among the most_common ones is in one entry in most_common at most, which bounds what
    one task gathers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = scratch(spark, "jaccard")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(rows.mapInArrow(_sign, SIGNATURE), f"{base}/signed")
    sets = signed.where("common is null").select("doc_id", "n", "node", "counts")
    points = stored(sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.count(F.lit(1)).alias("copies")), f"{base}/tmp/points")

    shared = signed.where("common is not null").groupBy("common").agg(F.sum("times").alias("times")).where(F.col("times") >= frequent)
    top = shared.orderBy(F.desc("times"), "common").limit(most_common).collect()  # bounded by most_common
    common = np.array([r["common"] for r in top], np.int64).view(np.uint64)
    hot = np.sort(common[np.array([r["times"] for r in top]) >= HOT_ENTRIES]) if top else common
    rank = np.arange(len(common))[::-1]
    by = np.argsort(common)
    common, rank = common[by], rank[by]

    entries = points.agg(F.sum(F.floor(F.col("n") / 4) + 1)).first()[0] or 0
    # as few buckets as memory allows: copies that share many shingles meet once in each bucket that has some of them
    buckets = int(max(1, -(-entries // PREFIX_ENTRIES)))
    dealt = rows.select("text").mapInArrow(_deal(common, rank, buckets, hot), _CELL_PART).repartitionById(buckets, F.col("bucket"))
    met = stored(dealt.mapInArrow(_gather, CELL), f"{base}/tmp/met")
    cells = stored(_with_hubs(stored(_named(met, most_common), f"{base}/tmp/own"), f"{base}/tmp"), f"{base}/tmp/cells")

    pairs = stored(_first_pairs(cells, points), f"{base}/tmp/first-pairs")
    # texts are fetched once: of the nodes of these pairs, and of large cells, whose nodes may meet again
    wanted = pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).unionByName(cells.where(F.col("rows") > SMALL).select("node")).distinct()
    involved = stored(wanted.join(points.select(F.col("node").alias("_p"), "rep"), F.col("node") == F.col("_p")).select("node", "rep"), f"{base}/tmp/involved")
    # rows that share a doc_id may differ in text: the text must be that of the node
    some = narrowed(rows, "doc_id", involved.select("rep")).select("text").mapInArrow(_with_node, "node long, text string")
    texts = stored(some.join(involved.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_semi").dropDuplicates(["node"]), f"{base}/tmp/texts")

    edges = _verify(pairs, texts, f"{base}/tmp/first")
    labels = components(edges, f"{base}/tmp/components-first")
    tried = pairs.select(F.col("hub").alias("_h"), F.col("node").alias("_n"))
    more = stored(_tree_pairs(cells, labels, points, f"{base}/tmp/blocks").join(tried, (F.col("hub") == F.col("_h")) & (F.col("node") == F.col("_n")), "left_anti"), f"{base}/tmp/tree-pairs")
    edges = stored(edges.unionByName(_verify(more, texts, f"{base}/tmp/tree")), f"{base}/tmp/edges")
    labels = components(edges, f"{base}/tmp/components")

    degree = edges.select(F.col("hub").alias("node")).unionByName(edges.select("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links_used"))
    own = points.join(labels.select(F.col("node").alias("_n"), "comp"), F.col("node") == F.col("_n"), "left").select("node", "copies", "rep", F.coalesce("comp", "node").alias("comp"))
    own = stored(own, f"{base}/tmp/comps")
    lowest = stored(own.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("_nodes")), f"{base}/tmp/lowest")
    named = _with_info(own, lowest, "_nodes", own.count(), "comp").select("node", "copies", "component_id")
    named = stored(named.join(degree.select(F.col("node").alias("_d"), "links_used"), F.col("node") == F.col("_d"), "left").select("node", "copies", "component_id", F.coalesce("links_used", F.lit(0)).alias("links_used")), f"{base}/named")
    remove(spark, f"{base}/tmp")
    return _for_documents(sets, named)


def _with_node(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0)
        nodes = [node_of(shingles(text)) for text in texts.cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), texts], names=["node", "text"])


def _for_documents(sets: DataFrame, named: DataFrame, hot_share: int = HOT_SHARE) -> DataFrame:
    """Each document's component. Nodes with a large part of all rows, ``hot_share`` of them at most, are broadcast."""
    total = named.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") > max(1000, total // hot_share)
    few = F.broadcast(named.where(hot).select(F.col("node").alias("_hot"), F.col("component_id").alias("_hot_id"), F.col("links_used").alias("_hot_links")))
    rest = named.where(~hot).select(F.col("node").alias("_node"), F.col("component_id").alias("_id"), F.col("links_used").alias("_links"))
    met = sets.select("doc_id", "n", "node").join(few, (F.col("node") == F.col("_hot")) & (F.col("n") > 0), "left")
    # rows that are done, and empty sets, get keys of their own: they spread and meet nothing
    key = F.when(F.col("_hot").isNull() & (F.col("n") > 0), F.struct(F.col("node").alias("k"), F.lit(None).cast("long").alias("d"))).otherwise(F.struct(F.lit(None).cast("long").alias("k"), F.col("doc_id").alias("d")))
    keyed = met.withColumn("_k", F.xxhash64(key)).withColumn("_join", F.when(F.col("_hot").isNull() & (F.col("n") > 0), F.col("node")).otherwise(F.col("_k")))
    joined = keyed.join(rest, (F.col("_join") == F.col("_node")) & F.col("_hot").isNull() & (F.col("n") > 0), "left")
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("_hot_id", "_id", "doc_id").alias("component_id"),
        F.coalesce("_hot_links", "_links", F.lit(0)).alias("links_used"),
    )


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs``, with all their columns, but of each component only those with its smallest doc_id."""
    found = near_duplicates(docs, **params)
    gone = found.where(F.col("component_id").isNotNull() & (F.col("component_id") != F.col("doc_id"))).select("doc_id")
    return without(docs, gone)


__all__ = ["CountTree", "components", "keep_one", "linked", "near_duplicates", "shingles"]

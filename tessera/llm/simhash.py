"""SimHash near-duplicates, searched with vantage-point trees.

1. Every text gets a 64-bit fingerprint: a bit is set if it is set in over half of the XXH64 hashes of the text's
   word shingles. Rows with one fingerprint are one node from here on, so exact copies cost nothing more.
2. Fingerprints are dealt into shards by bands of their bits. Two fingerprints that differ in at most `RADIUS` bits
   differ in none of the bits of at least one of `RADIUS + 1` bands, so in that band's own Hamming space their
   distance to any vantage point is the same: the triangle bound leaves exactly one shard per band that can hold a
   partner, and no pair is missed. A shard that holds more than `SHARD_ROWS` fingerprints is dealt again, by bands
   of the bits it has not used yet, under the same argument.
3. Inside a shard, a vantage-point tree over the whole fingerprints finds the pairs: distances to a vantage point
   split the set, both halves are searched on their own, and only points within `RADIUS` of the split are compared
   across it. Points that the vantage point itself links are one component already: they are compared with what lies
   around until it is linked, and not among themselves.
4. Shards that are dealt again and still hold more than `SHARD_ROWS` are dense groups. Their fingerprints are linked
   through the points midway between them, which needs no comparisons and no shard at all (`_dense_links`).
5. A shard emits a forest (at most one link per fingerprint), never all pairs. The components of these links come
   from alternating large-star and small-star steps, settled in the shared folder after each round.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like any other.
Very long texts are hashed whole, a block of shingles at a time. Repeated rows share a component. Ties between ids
that could name a component don't arise: the least does. A null id never names a component unless the component has
no other id, and then the component is null. An empty table gives an empty result. Extra columns, also such as are
called like columns of the result, are left out of `fingerprints` and pass through `keep_one`.

`keep_one` is what the corpus pipeline calls: one text of each component of exact five-word similarity. The steps are
the same: fingerprints (of five-word shingles), shards, a vantage-point tree over the fingerprints of each shard
(`candidates`), components; the exact check follows. At the radius that reaches that similarity (`REACH`) bands of bits
would be too narrow to deal by, so the shards are min-hash cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, quoted, settled, table, work_dir

RADIUS = 4
#: Fingerprints that one task compares; larger shards are dealt again.
SHARD_ROWS = 20_000
#: Sets that are compared pair by pair within the tree.
LEAF = 512
#: Files of a small settled table at least, and links in a file of a large one.
FEW, FILE_ROWS = 8, 250_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the `width`-word shingles of a text, repeats included; of all its words if they are fewer."""
    # Words end at ASCII blanks alone, which is how bytes.split() without arguments works.
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)))
    first, last = starts[:n].tolist(), (starts[min(width, len(words)) :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(first, last, strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    n = len(hashes)
    if not n:
        return 0
    set_ = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        set_ += np.unpackbits(hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """`key` and the fingerprint of every row, as a long with the same 64 bits."""
    kind = df.schema[key].dataType
    out_type = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            prints = np.fromiter((fingerprint(shingle_hashes(t.as_py(), width)) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64), out_type)], names=[key, "fp"])

    return df.select(quoted(key).alias(key), quoted(text).alias("text" if key != "text" else "body")).mapInArrow(run, f"`{key}` {kind.simpleString()}, fp bigint")


class _Forest:
    """Union-find over 0..n-1 that remembers the links that joined two trees. A tree's root is its least member."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[np.ndarray] = []

    def find(self, i: int) -> int:
        return int(self.roots(np.array([i]))[0])

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        root = self.up[nodes]
        while not np.array_equal(above := self.up[root], root):
            root = above
        self.up[nodes] = root
        return root

    def join(self, i: int, j: int) -> None:
        self.join_all(np.array([i]), np.array([j]))

    def join_all(self, left: np.ndarray, right: np.ndarray) -> None:
        """Joins `left[k]` with `right[k]`; of links between the same trees, one is remembered."""
        while True:
            a, b = self.roots(left), self.roots(right)
            apart = a != b
            if not apart.any():
                return
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            # Every root with lesser ones beside it goes under the least, so no round makes a circle.
            order = np.lexsort((low, high))
            first = order[np.concatenate(([True], np.diff(high[order]) != 0))]
            self.up[high[first]] = low[first]
            self.links.append(np.stack([left[first], right[first]], axis=1))

    def pairs(self) -> np.ndarray:
        """All remembered links, as rows of two."""
        return np.concatenate(self.links) if self.links else np.empty((0, 2), np.int64)


#: Pairs whose distances are held at once.
_AT_ONCE = 2_000_000


def _across(points: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, forest: _Forest) -> None:
    """Joins the pairs within `radius` that have one end in `left` and one in `right`, vantage point by vantage point."""
    stack = [(left, right)]
    while stack:
        left, right = stack.pop()
        if len(left) > len(right):
            left, right = right, left
        if not len(left):
            continue
        near_a = None
        if len(left) * len(right) > LEAF * LEAF and len(left) > 16:
            vantage = points[left[len(left) // 2]]
            a, b = np.bitwise_count(points[left] ^ vantage).astype(np.int16), np.bitwise_count(points[right] ^ vantage).astype(np.int16)
            middle = int(np.median(a))
            near_a = a <= middle
            near_b, far_b = b <= middle + radius, b > middle - radius
            # A split that leaves both sides nearly whole is not worth the recursion.
            if near_a.all() or 10 * (near_a.sum() * near_b.sum() + (~near_a).sum() * far_b.sum()) > 9 * len(left) * len(right):
                near_a = None
        if near_a is not None:
            stack += [(left[near_a], right[near_b]), (left[~near_a], right[far_b])]
            continue
        step = max(1, _AT_ONCE // len(right))
        for at in range(0, len(left), step):
            some = left[at : at + step]
            i, j = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[right][None, :]) <= radius)
            forest.join_all(some[i], right[j])


def _around_ball(points: np.ndarray, ball: np.ndarray, ring: np.ndarray, radius: int, forest: _Forest) -> None:
    """Joins every point of `ring` that is within `radius` of one of `ball`, which is one tree already."""
    step = max(1, _AT_ONCE // max(1, len(ring)))
    at = 0
    while at < len(ball) and len(ring):
        some = ball[at : at + step]
        near = np.bitwise_count(points[some][:, None] ^ points[ring][None, :]) <= radius
        hit = near.any(axis=0)
        forest.join_all(some[near.argmax(axis=0)[hit]], ring[hit])
        ring = ring[~hit]
        at += len(some)
        step = max(1, _AT_ONCE // max(1, len(ring)))


def link_forest(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Links (rows of two positions) that join the distinct `points` just as all pairs within `radius` would."""
    forest = _Forest(len(points))
    stack = [np.arange(len(points))]
    while stack:
        own = stack.pop()
        if len(own) <= 1:
            continue
        if len(own) <= LEAF:
            i, j = np.nonzero(np.triu(np.bitwise_count(points[own][:, None] ^ points[own][None, :]) <= radius, 1))
            forest.join_all(own[i], own[j])
            continue
        vantage = own[len(own) // 2]
        d = np.bitwise_count(points[own] ^ points[vantage]).astype(np.int16)
        ball = d <= radius
        if ball.sum() > 1:
            # Linked through the vantage point: compared with what lies around, not among themselves.
            inside = own[ball]
            forest.join_all(np.full(len(inside), vantage), inside)
            _around_ball(points, inside, own[~ball & (d <= 2 * radius)], radius, forest)
            stack.append(own[~ball])
            continue
        middle = int(np.median(d))
        low = d <= middle
        if low.all():
            middle -= 1
            low = d <= middle
        stack += [own[low], own[~low]]
        _across(points, own[low & (d > middle - radius)], own[~low & (d <= middle + radius)], radius, forest)
    return forest.pairs()


def _bands(bits: list[int], n: int) -> list[list[int]]:
    return [bits[len(bits) * k // n : len(bits) * (k + 1) // n] for k in range(n)]


def _take(value: Column, bits: list[int]) -> Column:
    """`value` with all but the bits (a run) cleared, the sign bit included."""
    mask = sum(1 << b for b in bits)
    return value.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _dealt(df: DataFrame, bands: list[list[int]], cell: list[int], first: int) -> DataFrame:
    """`band` (from `first`), `cell` and `fp`: every fingerprint once for each of `bands`, by its bits there and in `cell`."""
    shards = F.array(*(F.struct(F.lit(first + k).alias("band"), _take(F.col("fp"), bits + cell).alias("cell")) for k, bits in enumerate(bands)))
    return df.select("fp", F.explode(shards).alias("s")).select("s.band", "s.cell", "fp")


def _large(dealt: DataFrame) -> DataFrame:
    """The shards of `dealt` with more than `SHARD_ROWS` fingerprints; there are at most rows / `SHARD_ROWS`."""
    return dealt.groupBy("band", "cell").count().filter(F.col("count") > SHARD_ROWS).select("band", "cell")


def _shards(nodes: DataFrame, radius: int) -> tuple[DataFrame, DataFrame | None]:
    """Columns `band` and `cell`, which name a shard, and `fp`: every fingerprint once for each band; and, if there are
    any, the fingerprints (`fp`) of shards that stay over `SHARD_ROWS`.

    A shard over `SHARD_ROWS` is dealt again, by bands of the bits that it doesn't agree in yet; one that is over it
    still holds a dense group, which no choice of bits takes apart.
    """
    bands = _bands(list(range(64)), radius + 1)
    dealt = _dealt(nodes, bands, [], 0)
    large = settled(_large(dealt), FEW)
    if large.isEmpty():
        return dealt, None
    done, hot = dealt.join(large, ["band", "cell"], "left_anti"), dealt.join(large, ["band", "cell"], "left_semi")
    again = None
    for k, used in enumerate(bands):
        finer = _bands([b for b in range(64) if b not in used], radius + 1)
        part = _dealt(hot.filter(F.col("band") == k), finer, used, (k + 1) * len(bands))
        again = part if again is None else again.unionByName(part)
    again = settled(again)
    large = settled(_large(again), FEW)
    if large.isEmpty():
        return done.unionByName(again), None
    dense = again.join(large, ["band", "cell"], "left_semi").select("fp").distinct()
    return done.unionByName(again.join(large, ["band", "cell"], "left_anti")), settled(dense)


def _masks(radius: int) -> np.ndarray:
    """All 64-bit numbers with at most half of `radius` bits set, rounded down."""
    out = [0]
    for k in range(1, radius // 2 + 1):
        out += [sum(1 << b for b in bits) for bits in combinations(range(64), k)]
    return np.array(out, np.uint64)


def _dense_links(dense: DataFrame, radius: int) -> DataFrame:
    """Links between the distinct fingerprints of `dense` by the points midway, however many are near each other.

    Two fingerprints within an even radius have a point within half of it of both, and any two that share such a point
    are within the radius: all fingerprints around one point are one component, named by the least. So no two of them
    are compared, the work is the number of fingerprints times that of masks, and no point's rows need one task.
    """
    if radius % 2:
        raise ValueError("points midway need an even radius")
    masks = _masks(radius)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 500):
                some = fps[at : at + 500]
                midway = (some.view(np.uint64)[:, None] ^ masks[None, :]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(midway.ravel()), pa.array(np.repeat(some, len(masks)))], names=["midway", "fp"])

    around = dense.mapInArrow(spread, "midway bigint, fp bigint")
    least = around.groupBy("midway").agg(F.min("fp").alias("u"), F.max("fp").alias("most")).filter("u < most").select("midway", "u")
    return around.join(least, "midway").filter("u < fp").select("u", F.col("fp").alias("v")).distinct()


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links between the distinct fingerprints of `nodes` (column `fp`), as `u` < `v`: a forest per shard."""
    shards, dense = _shards(nodes, radius)

    def forest(parts: list[np.ndarray]) -> pa.RecordBatch | None:
        points = np.unique(np.concatenate(parts)).view(np.uint64)
        found = points.view(np.int64)[link_forest(points, radius)] if len(points) > 1 else ()
        return pa.RecordBatch.from_arrays([pa.array(found.min(axis=1)), pa.array(found.max(axis=1))], names=["u", "v"]) if len(found) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Shards lie one after the other; one, of `SHARD_ROWS` at most, is held at a time.
        name, parts = None, []
        for batch in batches:
            bands, cells, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (bands[1:] != bands[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fps)], strict=True):
                if a == b:
                    continue
                if (bands[a], cells[a]) != name:
                    if parts and (out := forest(parts)):
                        yield out
                    name, parts = (bands[a], cells[a]), []
                parts.append(fps[a:b])
        if parts and (out := forest(parts)):
            yield out

    found = shards.repartition("band", "cell").sortWithinPartitions("band", "cell").mapInArrow(run, "u bigint, v bigint")
    return found if dense is None else found.unionByName(_dense_links(dense, radius))


def _files(rows: int) -> int:
    return max(FEW, -(-rows // FILE_ROWS))


def components(pairs: DataFrame, nodes: int | None = None) -> DataFrame:
    """`node` and `root` of every node in `pairs` (`u`, `v`) but the roots: the least node that can be reached from it.

    Alternating large-star and small-star steps; each round reads the links of the last from the shared folder, where
    they lie in files of about `FILE_ROWS` links, so that few links make few files; `nodes` is the number of nodes, if
    that is known, and says so for the first round. Ends when a round changes no link.
    """
    edges = settled(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), None if nodes is None else _files(nodes))
    n = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Nodes that are their neighbourhood's least keep no link of their own here; their neighbours carry it.
        large = large.filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        following = settled(small.filter("u != v").distinct(), _files(n))
        before, n = n, following.count()
        if n == before and following.join(edges, ["u", "v"], "left_anti").isEmpty():
            return following.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = following


def grouped(prints: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """`prints` (`key`, `fp`) with `component_id`, the least key reachable over links of at most `radius` bits."""
    prints = settled(prints)
    rows = prints.count()
    nodes = settled(prints.groupBy("fp").agg(F.min(quoted(key)).alias("least")), _files(rows))
    roots = components(links(nodes.select("fp"), radius), rows)
    # Only fingerprints with a link take part in the joins by root, and their number is small beside all.
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    rooted = nodes.join(linked, nodes["fp"] == linked["node"]).select("fp", "least", "root")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(named, "root").select("fp", "component_id", F.lit(True).alias("linked"))
    by_print = nodes.join(found, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(by_print, "fp")


#: What the corpus pipeline calls near-duplicates: so many words a shingle, and shared shingles of all shingles of the two.
WIDTH, SIMILAR = 5, (4, 5)
#: Min-hashes by which the pipeline deals candidates: two texts at 4/5 miss each other with chance (1 - 0.8^6)^45 = 1e-6.
CELLS, CELL_HASHES = 45, 6
#: Bits in which fingerprints of candidates differ at most. Of two sets at 4/5 a bit differs with chance 0.15, or 0.19 for the
#: smallest, so more than this with 1e-8, or 1e-5; the 48 pairs of distinct sets at 4/5 or more on sf0.1 differ in 4 to 14.
REACH = 26
#: Texts, and bytes of their shingles, of a candidate component that make a block; a task compares two blocks at most.
BLOCK_SETS, BLOCK_BYTES = 1500, 24_000_000
_RANDOM = np.random.default_rng(20)
_FLIP = _RANDOM.integers(0, 2**64, CELLS * CELL_HASHES, np.uint64)[:, None]
_TIMES = _RANDOM.integers(0, 2**64, CELLS * CELL_HASHES, np.uint64)[:, None] | np.uint64(1)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def cells_of(shingles: np.ndarray) -> list[int]:
    """The cells of a set of shingles, as longs: two sets share a cell if `CELL_HASHES` of their least hashes agree."""
    if not len(shingles):
        return []
    least = np.full(CELLS * CELL_HASHES, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, ((shingles[at : at + 2048] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    bands = least.reshape(CELLS, CELL_HASHES)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)], np.uint64).view(np.int64).tolist()


def candidates(cells: DataFrame, reach: int = REACH) -> DataFrame:
    """Links `u`, `v` between the nodes of `cells` (`cell`, `node`, `fp`): in each cell they join what pairs within `reach` bits would.

    A cell is a shard and has its vantage-point tree. One over `SHARD_ROWS` goes to no single task: all its nodes are
    linked to the least, as the exact check follows.
    """
    many = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    shared = settled(cells.join(many, "cell"))

    def forest(cell: np.ndarray, node: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # The first vantage point of every shard, all at once: mostly the ball around it is the whole shard.
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        ends = np.concatenate((starts[1:], [len(cell)]))
        vantage = np.repeat(starts, ends - starts)
        ball = np.bitwise_count(fp ^ fp[vantage]) <= reach
        whole = np.logical_and.reduceat(ball, starts)
        inside = np.repeat(whole, ends - starts)
        yield node[vantage[inside]], node[inside]
        for a, b in zip(starts[~whole].tolist(), ends[~whole].tolist(), strict=True):
            points, first, own = np.unique(fp[a:b], return_index=True, return_inverse=True)
            named = node[a:b][first]
            yield named[own], node[a:b]
            if len(points) > 1 and len(found := link_forest(points, reach)):
                yield named[found[:, 0]], named[found[:, 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Shards lie one after the other; the last of a batch may go on in the next.
        rest: list[np.ndarray] = []
        for last, batch in chain(((False, b) for b in batches), [(True, None)]):
            own = [] if last else [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            held = own if not rest else rest if last else [np.concatenate(x) for x in zip(rest, own, strict=True)]
            if not held or not len(held[0]):
                continue
            cut = len(held[0]) if last else int(np.flatnonzero(np.concatenate(([True], held[0][1:] != held[0][:-1])))[-1])
            rest = [x[cut:] for x in held]
            if cut:
                for u, v in forest(*(x[:cut] for x in held)):
                    apart = u != v
                    if apart.any():
                        yield pa.RecordBatch.from_arrays([pa.array(u[apart]), pa.array(v[apart])], names=["u", "v"])

    trees = shared.filter(F.col("n") <= SHARD_ROWS).select("cell", "node", "fp").repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(run, "u bigint, v bigint")
    dense = shared.filter(F.col("n") > SHARD_ROWS)
    least = dense.groupBy("cell").agg(F.min("node").alias("u"))
    return trees.unionByName(dense.join(least, "cell").filter("node != u").select("u", F.col("node").alias("v")))


def similar_forest(sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR) -> _Forest:
    """Joins the sets just as all pairs with at least that share of common members would.

    One minus this share is a metric: what a vantage point links is one component, and only what lies within twice the
    distance can be linked to it from outside.
    """
    forest, (num, den) = _Forest(len(sets)), similar
    sizes = np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(int(ids.max(initial=0)) + 1, bool)

    def common(one: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, n = ids[starts[one] : starts[one] + sizes[one]], sizes[others]
        first = np.cumsum(n) - n
        mark[own] = True
        both = np.add.reduceat(mark[ids[np.repeat(starts[others] - first, n) + np.arange(n.sum())]], first, dtype=np.int64)
        mark[own] = False
        return both, sizes[one] + n - both

    left = np.argsort(-sizes, kind="stable")
    wide = 2 * num - den  # of den: the share at twice the distance
    while len(left) > 1:
        hub, left = int(left[0]), left[1:]
        reach = int(np.searchsorted(-den * sizes[left], -wide * sizes[hub], "right"))
        if not reach:
            continue
        both, all_ = common(hub, left[:reach])
        ball = den * both >= num * all_
        inside = left[:reach][ball]
        forest.join_all(np.full(len(inside), hub), inside)
        if len(inside):
            for other in left[:reach][~ball & (den * both >= wide * all_)].tolist():
                if forest.find(other) != forest.find(hub):
                    both, all_ = common(other, inside)
                    if (den * both >= num * all_).any():
                        forest.join(other, hub)
        left = np.concatenate((left[:reach][~ball], left[reach:]))
    return forest


def similar_classes(rows: DataFrame, row: str, key: str, text: str, reach: int = REACH) -> DataFrame:
    """`row`, `key`, `hash` (of the text) and `class` of all `rows`: one class for each component of similar texts.

    A candidate component of any size is compared in blocks of about `BLOCK_SETS` texts or `BLOCK_BYTES` bytes of shingles at most: every
    two blocks of it are one task, which emits a forest.
    """
    kind = rows.schema[key].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                sets = [shingle_set(t.as_py()) for t in some.column(3)]
                nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
                sizes = pa.array([s.nbytes for s in sets], pa.int64())
                prints = np.fromiter(map(fingerprint, sets), np.uint64, len(sets)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(nodes), sizes, pa.array(prints), pa.array([cells_of(s) for s in sets], pa.list_(pa.int64()))], names=["row", "key", "hash", "node", "size", "fp", "cells"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                sets = pa.array([shingle_set(t.as_py()).tobytes() for t in some.column(2)], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), *some.columns[3:5], some.column(1), sets], names=["root", "low", "high", "node", "shingles"])

    def verified(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_numpy()
        found = similar_forest([np.frombuffer(s.as_buffer(), np.uint64) for s in group.column("shingles")]).pairs()
        ends = nodes[found] if len(found) else np.empty((0, 2), np.int64)
        return pa.table({"u": ends.min(axis=1), "v": ends.max(axis=1)})

    chosen = rows.select(quoted(row).alias("row"), quoted(key).alias("key"), F.xxhash64(quoted(text)).alias("hash"), quoted(text).alias("body"))
    sketches = settled(chosen.mapInArrow(sketch, f"row bigint, key {kind}, hash bigint, node bigint, size bigint, fp bigint, cells array<bigint>"))
    # Rows with one set of shingles are one node.
    cells = sketches.groupBy("node").agg(F.first("fp").alias("fp"), F.first("cells").alias("cells")).select("node", "fp", F.explode("cells").alias("cell"))
    n = sketches.count()
    roots = components(candidates(cells.select("cell", "node", "fp"), reach), n)
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    one = sketches.groupBy("node").agg(F.min("row").alias("row"), F.first("size").alias("size")).join(roots, "node")
    # A candidate component is compared block by block: each node is in the tasks of its block and every other.
    one = settled(one, _files(n))
    blocks = one.groupBy("root").agg(F.greatest(F.ceil(F.sum("size") / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK_SETS), F.lit(1)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    texts = one.join(blocks, "root").select("row", "root", "node", "blocks", own.alias("own")).join(chosen.select("row", "body"), "row")
    dealt = texts.select("root", "node", "body", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("root", "node", "body", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    found = dealt.mapInArrow(sets_of, "root bigint, low int, high int, node bigint, shingles binary").groupBy("root", "low", "high").applyInArrow(verified, "u bigint, v bigint")
    classes = components(found, n)
    classes = classes.select("node", F.col("root").alias("class"))
    return sketches.drop("fp", "cells").join(classes, "node", "left").select("row", "key", "hash", F.coalesce("class", "node").alias("class"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `df` for each component of texts that share `SIMILAR` of their five-word shingles, all links verified.

    Of a component's rows, the one with the least key stays, null keys last; ties go by the hash of the text. Rows are
    told apart by a number of their own, so repeated and null keys lose and keep nothing else.
    """
    row = fresh("_row", df.columns)
    folder = work_dir(df.sparkSession, "numbered")
    df.withColumn(row, F.monotonically_increasing_id()).write.parquet(folder)
    rows = df.sparkSession.read.parquet(folder)
    order = F.struct(F.col("key").isNull().alias("last"), "key", "hash", "row")
    first = similar_classes(rows, row, key, text).groupBy("class").agg(F.min(order).alias("first")).select(F.col("first.row").alias("_first"))
    return rows.join(first, quoted(row) == first["_first"], "left_semi").drop(row)



def op9_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = grouped(fingerprints(table(spark, sf_dir, "documents")))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

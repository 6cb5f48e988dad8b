"""Components of similar items that share nodes, without all pairs of a large group.

Items that share a node are compared by their sketches.  A node first gives a
most-similar spanning forest of its items, and where it is split, every part of it meets
every other for pairs that join what is still apart; these pairs are confirmed and their
components found.  Then, within each group of likely pairs that fell apart (or each node
of its items), items of different components are compared, and what links them is
confirmed on the spot.  So no link that would join two components is left out, and no
more pairs than items are ever given.

Nodes and groups of any size are dealt over cells of about `CELL` items of either side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, connected_components, sliced, written

#: Items that a cell of a large node holds of either side.
CELL = 1024
#: Cells up to this size are compared by shifting the rows against themselves.
SHIFTS = 256

#: (sketches a, sketches b, sizes a, sizes b) -> (may be linked, likeness)
Like = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: (payload a, payload b) -> linked
Same = Callable[[bytes, bytes], bool]


class _Cells:
    """Gathers rows, sorted by cell, into arrays of whole cells."""

    def __init__(self, least: int = 4096):
        self.least, self.held, self.count = least, [], 0

    def feed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for b in batches:
            if not b.num_rows:
                continue
            self.held.append(b)
            self.count += b.num_rows
            if self.count >= self.least:
                t = pa.Table.from_batches(self.held).combine_chunks()
                key = t.column("cell").to_numpy()
                last = int(np.searchsorted(key, key[-1], "left"))
                if last:
                    yield t.slice(0, last)
                self.held, self.count = t.slice(last).to_batches(), t.num_rows - last
        if self.count:
            yield pa.Table.from_batches(self.held).combine_chunks()


def _arrays(t: pa.Table, *names: str) -> list[np.ndarray]:
    """The columns, the last of them the sketches as rows of bytes."""
    sk = binary_column(t.column("sk"))[0].reshape(t.num_rows, -1)
    return [*(t.column(c).to_numpy() for c in names), sk]


def _forest(a: np.ndarray, b: np.ndarray, score: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which pairs form a most-similar spanning forest (rows a and b, of one group each)."""
    keep = np.zeros(len(a), bool)
    alone = np.append(True, group[1:] != group[:-1]) & np.append(group[1:] != group[:-1], True)
    keep[alone] = True  # the only pair of its group
    rest = np.flatnonzero(~alone)
    rest = rest[np.lexsort((b[rest], a[rest], -score[rest]))]
    root = list(range(int(max(a[rest].max(initial=-1), b[rest].max(initial=-1))) + 1))
    for i, x, y in zip(rest.tolist(), a[rest].tolist(), b[rest].tolist(), strict=True):
        while (p := root[x]) != x:
            root[x] = x = root[p]
        while (p := root[y]) != y:
            root[y] = y = root[p]
        if x != y:
            root[x] = y
            keep[i] = True
    return keep


def _spanning(t: pa.Table, like: Like) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a most-similar spanning forest of each cell."""
    t = t.sort_by([("cell", "ascending"), ("g", "ascending")])  # so that equal likenesses give the same trees in every cell
    cell, g, n, sk = _arrays(t, "cell", "g", "n")
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    sizes = np.diff(np.append(starts, len(cell)))
    size = np.repeat(sizes, sizes)
    one, two, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(1, min(SHIFTS, int(sizes.max(initial=1)))):
        i = np.flatnonzero((cell[k:] == cell[:-k]) & (size[k:] <= SHIFTS) & (size[k:] > k))
        ok, same = like(sk[i], sk[i + k], n[i], n[i + k])
        one.append(i[ok])
        two.append(i[ok] + k)
        scores.append(same[ok].astype(np.int64))
    x, y, score = map(np.concatenate, (one, two, scores))
    order = np.argsort(cell[x], kind="stable")
    x, y, score = x[order], y[order], score[order]
    keep = _forest(x, y, score, cell[x]) if len(x) else np.zeros(0, bool)
    a, b = [g[x[keep]]], [g[y[keep]]]
    for lo, m in zip(starts[sizes > SHIFTS], sizes[sizes > SHIFTS], strict=True):
        at = slice(lo, lo + m)
        s, ns, ids = sk[at], n[at], g[at]
        free, best, via = np.ones(m, bool), np.full(m, -1, np.int64), np.full(m, -1)
        x = 0
        while True:
            free[x] = False
            ok, same = like(s, s[x], ns, ns[x])
            better = free & ok & (same > best)
            best[better], via[better] = same[better], x
            score = np.where(free, best, -2)
            x = int(score.argmax())
            if score[x] == -2:
                break
            if score[x] >= 0:
                a.append(ids[[via[x]]])
                b.append(ids[[x]])
    return np.concatenate(a), np.concatenate(b)


class _Owned:
    """Whether a row's node is the least that two items of it have in common, so that a pair that many nodes hold is confirmed in one."""

    def __init__(self, t: pa.Table):
        self.node, self.nodes, self.known = t.column("node").to_numpy(), t.column("nodes"), {}

    def _of(self, x: int) -> frozenset[int]:
        if x not in self.known:
            self.known[x] = frozenset(self.nodes[x].as_py())
        return self.known[x]

    def __call__(self, x: int, y: int) -> bool:
        return min(self._of(x) & self._of(y)) == self.node[x]


def _across(t: pa.Table, like: Like, same: Same | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Confirmed links (likely ones without `same`) between components of each cell, one item of them of the second side.

    Items of the second side are compared with all of the first that may be linked and
    are not yet of one component, likeliest first; a link unites two components, so what
    is given is a forest over components, however many pairs are alike.  Two items that
    both stand on both sides meet twice, in two cells or one, and are compared once.
    With `nodes`, all nodes of an item, two are confirmed in the least node that both have.
    """
    cell, g, n, comp, side, minor, sk = _arrays(t, "cell", "g", "n", "comp", "side", "minor")
    payload = t.column("payload") if same else None
    owned = _Owned(t) if same and "nodes" in t.column_names else None
    starts = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
    a, b = [], []
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        one = lo + np.flatnonzero(side[lo:hi] == 0)
        names, number = np.unique(comp[lo:hi], return_inverse=True)
        root = np.arange(len(names))  # of each component, kept flat
        for x in lo + np.flatnonzero(side[lo:hi] == 1):
            ok, likeness = like(sk[one], sk[x], n[one], n[x])
            hit = one[ok & ((minor[one] == 0) | (g[one] < g[x])) & (root[number[one - lo]] != root[number[x - lo]])]
            if not len(hit):
                continue
            hit = hit[np.lexsort((g[hit], -likeness[np.searchsorted(one, hit)].astype(np.int64)))]
            mine = payload[int(x)].as_py() if same else None
            for y in hit.tolist():
                p, q = root[number[x - lo]], root[number[y - lo]]
                if p != q and (same is None or (owned is None or owned(int(x), y)) and same(mine, payload[y].as_py())):
                    root[root == max(p, q)] = min(p, q)
                    a.append(g[x])
                    b.append(g[y])
    return np.array(a, np.int64), np.array(b, np.int64)


def _pairs(cells: DataFrame, columns: list[str], find: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _Cells().feed(batches):
            a, b = find(t)
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    cells = cells.select("cell", *columns).repartition("cell").sortWithinPartitions("cell")
    return cells.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _cross_cells(found: DataFrame) -> DataFrame:
    """Cells of the nodes that hold several components: all members on side 0, those outside the node's largest component on side 1 too.

    Either side is dealt over as many parts as keep a cell at about CELL rows of each, and
    every part of one meets every part of the other.
    """
    by_comp = found.groupBy("node", "comp").agg(F.count("*").alias("c"))
    node = by_comp.groupBy("node").agg(F.count("*").alias("comps"), F.sum("c").alias("all"), F.max(F.struct("c", "comp")).alias("top")).where("comps > 1")
    node = node.select("node", F.col("top.comp").alias("largest"), F.ceil(F.col("all") / CELL).cast("int").alias("p0"), F.ceil((F.col("all") - F.col("top.c")) / CELL).cast("int").alias("p1"))
    rows = found.join(node, "node").withColumn("minor", (F.col("comp") != F.col("largest")).cast("int"))
    mine = lambda p: F.pmod(F.xxhash64("g", "node"), F.col(p)).cast("int")
    parts = lambda p: F.explode(F.sequence(F.lit(0), F.col(p) - 1))
    zero = rows.withColumn("i", mine("p0")).withColumn("j", parts("p1")).withColumn("side", F.lit(0))
    one = rows.where("minor = 1").withColumn("j", mine("p1")).withColumn("i", parts("p0")).withColumn("side", F.lit(1))
    return zero.unionByName(one).withColumn("cell", F.xxhash64("node", "i", "j"))


def _confirmed(pairs: DataFrame, full: DataFrame, same: Same) -> DataFrame:
    """The pairs that are links, by their payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "pa"):
            keep = [same(x, y) for x, y in zip(b.column("pa").to_pylist(), b.column("pb").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = (full.select(F.col("g").alias(c), F.col("payload").alias(f"p{c}")) for c in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "pa", "pb").mapInArrow(run, "a long, b long")


def link(members: DataFrame, like: Like, payloads: Callable[[DataFrame], DataFrame], same: Same, by_node: bool = False) -> DataFrame:
    """(node, component) of the linked items of `members(node, size, g, n, sk)`; size is the node's.

    `payloads(ids)` gives (g, payload) of the items (g) that have a likely partner, and
    `same` tells from two payloads whether their items are linked.  What the spanning
    forests leave apart is compared again within groups of likely pairs, an item once, or
    `by_node` within each shared node, where groups are chained into large ones by chance.
    """
    cells = members.withColumn("parts", F.ceil(F.col("size") / CELL).cast("int"))
    own = cells.withColumn("cell", F.when(F.col("parts") == 1, F.col("node")).otherwise(F.xxhash64("node", F.pmod(F.xxhash64("g"), F.col("parts")))))
    split = cells.where("parts > 1").groupBy("node").agg(F.min_by(F.struct("g", "n", "sk", "parts"), "g").alias("m"))  # the least member is in all cells
    lead = split.select("node", "m", F.explode(F.expr("sequence(0L, CAST(m.parts AS BIGINT) - 1)")).alias("part"))
    lead = lead.select(F.xxhash64("node", "part").alias("cell"), "m.g", "m.n", "m.sk")
    pairs = written(_pairs(own.select("cell", "g", "n", "sk").unionByName(lead), ["g", "n", "sk"], lambda t: _spanning(t, like)), "pairs")
    hot = members.where(F.col("size") > CELL).select("node", "g", "n", "sk")
    if hot.limit(1).count():  # the parts of a split node meet by node: in hash order two alike items may share no cell in any node
        parts = connected_components(pairs).select(F.col("node").alias("g"), F.col("component").alias("comp"))
        apart = written(hot.join(parts, "g", "left").withColumn("comp", F.coalesce("comp", "g")), "apart")
        pairs = written(pairs.unionByName(_pairs(_cross_cells(apart), ["g", "n", "sk", "comp", "side", "minor"], lambda t: _across(t, like))), "pairs")
    ids = written(pairs.select(F.col("a").alias("g")).union(pairs.select(F.col("b").alias("g"))).distinct(), "ids")
    full = written(payloads(ids), "full")
    edges = written(_confirmed(pairs, full, same), "edges")
    # only groups of likely pairs that fell apart are looked at again; what is alike in any node is in one group
    comps = connected_components(edges)
    named = connected_components(pairs).select(F.col("node").alias("g"), F.col("component").alias("group")).join(comps.select(F.col("node").alias("g"), "component"), "g", "left")
    named = written(named.select("g", "group", F.coalesce("component", "g").alias("comp")), "named")
    several = named.groupBy("group").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("group")
    open_ = named.join(several, "group", "left_semi")
    if by_node:
        # items of one node but of two groups are not alike: any likely pair of a node joined their groups
        found = members.select("node", "g", "n", "sk").join(open_.select("g", "group", "comp"), "g").withColumn("node", F.xxhash64("node", "group")).drop("group")
        found = written(found, "found")
        found = found.join(found.groupBy("g").agg(F.collect_list("node").alias("nodes")), "g")
    else:
        found = members.select("g", "n", "sk").join(open_.select("g", F.col("group").alias("node"), "comp"), "g").dropDuplicates(["g"])
    found = written(found, "found")
    own = ["node", "nodes"] if by_node else []
    more = written(_pairs(_cross_cells(found).join(full, "g"), ["g", "n", "sk", "comp", "side", "minor", "payload", *own], lambda t: _across(t, like, same)), "links")
    return comps if not more.limit(1).count() else connected_components(edges.unionByName(more))

"""Line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence of each connected group.

A line's SimHash is voted on by its different words.  It comes in blocks: words are dealt
by their hashes, halved again and again while both halves have enough characters, and
each last part votes on a block of its own.  A change of a word so touches the block of
that word and of its stand-in and leaves all others equal, whatever the line's length:
lines that differ in fewer words than they have blocks share one, the pigeonhole's
way.  Lines that share a block meet in its node; a node first gives those that have a
likely partner in it, by the SimHash of whole lines; only their texts are fetched, and
their components are found by `linking`, which confirms links by edit similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .bpe import texts_of
from .common import binary_column, only_these, sliced, written
from .linking import link

SIMILARITY = 0.8
#: (characters of different words that a block has at least, characters of the lines that have such blocks).
#: Lines that may be similar and of unlike kinds have blocks of both.
BLOCKS = ((12, 0, 120), (24, 96, 400), (40, 320, 1 << 62))
#: Times that a short line's words are dealt, by a hash of their own each time.
DEALS = 3
#: Times that a line's words are halved at most.
DEPTH = 12
#: Bits of whole lines' SimHashes that may differ: of 64 by words, of 256 by runs of eight characters.
#: Of 4514 similar pairs of distinct lines measured, all were within 21 and 99, and 99.5 % within 16 and 78.
SIFT, NEAR = 21, 99
#: (characters of a run, buckets that its counts are hashed to, weight) of the longer SimHash.
RUNS = ((8, 512, 1.0),)
#: Lines of a node up to which one task compares them; those of a larger one are dealt over cells of about so many.
CELL = 1 << 15
#: Rows of one node that a task holds at a time, to tell equal lines.
HELD = 1 << 20
#: Words of a block or line up to which votes are counted in planes of digits.
FEW = 40
#: Words, or counts, that are held at a time, a processor's cache full.
STEP = 1 << 15
#: Cells up to this size are compared by shifting the rows against themselves.
SHIFTS = 24

_U = np.uint64
# normal form: A-Z lower-cased, every ASCII character but letters and digits a space
_FORM = tv.LOWER.copy()
_FORM[[c for c in range(128) if not chr(c).isalnum() and c != 10]] = 32
_START = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


Spec = tuple[tuple[int, int, float], ...]


def _signs(spec: Spec, bits: int) -> np.ndarray:
    """A row of weights, signed by chance, for each bucket.

    The second half of a gram's buckets has the first half's rows with all signs turned,
    so that unlike runs that fall together cancel out on average, however long the line.
    """
    rows = []
    for seed, (_, buckets, weight) in enumerate(spec):
        half = buckets // 2
        coins = tv.mix(np.arange(half * bits, dtype=_U) + _U(0x3C6EF372FE94F82B + (seed << 32))) >> _U(63)
        own = (coins.astype(np.float32) * 2 - 1).reshape(half, bits) * np.float32(weight)
        rows += [own, -own]
    return np.concatenate(rows)


_SIGNS = {(RUNS, 256): _signs(RUNS, 256)}
#: For each byte, its bits from the highest on in a byte each.
_LANES = np.array([sum((b >> (7 - k) & 1) << 8 * k for k in range(8)) for b in range(256)], _U)


def simhashes(data: np.ndarray, line: np.ndarray, n: int, spec: Spec, bits: int = 64) -> np.ndarray:
    """SimHashes (n rows of 64-bit words) of lines laid end to end, `line` telling whose each byte is (ascending)."""
    signs = _SIGNS[spec, bits]
    width = len(signs)
    out = np.empty((n, bits // 64), _U)
    step = max(1, STEP // width)
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        a, b = np.searchsorted(line, [lo, hi])
        own, symbols = (line[a:b] - lo).astype(np.int32), data[a:b].astype(np.uint32)
        cells, base = [], 0
        for gram, buckets, _ in spec:
            m = max(0, len(own) - gram + 1)
            x = symbols[:m].copy()
            for i in range(1, gram):
                x *= np.uint32(257)
                x += symbols[i : m + i]
            x *= np.uint32(0x9E3779B1)
            x >>= np.uint32(32 - buckets.bit_length() + 1)
            cells.append((own[:m] * np.int32(width) + (x.view(np.int32) + np.int32(base)))[own[:m] == own[gram - 1 :]])
            base += buckets
        counts = np.bincount(np.concatenate(cells) if len(cells) > 1 else cells[0], minlength=(hi - lo) * width)
        out[lo:hi] = np.packbits((counts.reshape(hi - lo, width).astype(np.float32) @ signs) > 0, axis=1).view(_U)
    return out


def voted(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """SimHashes (64 bits) of ranges a to b of word hashes: a bit is set that more than half of the words have."""
    out = np.empty(len(a), _U)
    sizes = b - a
    order = np.argsort(sizes, kind="stable")
    sizes, a = sizes[order], a[order]
    few = int(np.searchsorted(sizes, FEW, "right"))
    for lo in range(0, few, STEP):
        out[order[lo : min(few, lo + STEP)]] = _voted_few(hashes, a[lo : min(few, lo + STEP)], sizes[lo : min(few, lo + STEP)])
    if few < len(a):
        out[order[few:]] = _voted_many(hashes, a[few:], sizes[few:])
    return out


def _voted_few(hashes: np.ndarray, a: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """`voted` of up to FEW words from a on, in the order of sizes: a counter for each bit of a hash, its digits in planes of numbers."""
    digits = max(1, int(sizes[-1]).bit_length())
    # counters start so far below 2**digits that more than half of the words carry beyond it
    start = (1 << digits) - (sizes // 2 + 1)
    planes = [(-(start >> d & 1)).view(_U) for d in range(digits)]
    over = np.zeros(len(a), _U)
    for k in range(int(sizes[-1])):
        i = int(np.searchsorted(sizes, k, "right"))  # the first range with so many words
        carry = hashes[a[i:] + k]
        for plane in planes:
            own = plane[i:]
            both = own & carry
            own ^= carry
            carry = both
        over[i:] |= carry
    return over


def _voted_many(hashes: np.ndarray, a: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """`voted` of any number of words from a on: a hash's bits in a byte each."""
    out = np.empty(len(a), _U)
    parts = -(-sizes // 255)  # counts of up to 255 words fit in bytes
    work = np.cumsum(sizes)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + STEP, "right")))
        n, size = parts[lo:hi], sizes[lo:hi]
        first = np.cumsum(n) - n
        start = np.cumsum(size) - size
        index = np.repeat(a[lo:hi] - start, size) + np.arange(size.sum())
        lanes = _LANES[hashes[index].view(np.uint8)].reshape(-1, 8)
        cuts = np.repeat(start, n) + 255 * (np.arange(n.sum()) - np.repeat(first, n))
        counts = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).astype(np.int32)
        counts = np.add.reduceat(counts, first, axis=0) if len(counts) > len(n) else counts
        out[lo:hi] = np.packbits(2 * counts > size[:, None], axis=1).view(_U)[:, 0]
        lo = hi
    return out


def _parts(hashes: np.ndarray, chars: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, depth) of the blocks of lines a to b, whose different words are in the order of their hashes.

    A part is halved by the next bit of its words' hashes.  Halves with `least` characters
    are halved on; a part of which one half, or none, has so many is a block.  So whether
    words are a block depends on themselves alone, and any word is in one.
    """
    total = np.concatenate([[0], np.cumsum(chars)])
    out = []
    for depth in range(DEPTH + 1):
        zeros = np.concatenate([[0], np.cumsum(hashes >> _U(63 - depth) & _U(1) == 0)])
        mid = a + zeros[b] - zeros[a]
        left, right = total[mid] - total[a] >= least, total[b] - total[mid] >= least
        if depth == DEPTH:
            left[:] = right[:] = False
        last = ~(left & right)
        out.append((a[last], b[last], np.full(last.sum(), depth)))
        a, b = np.concatenate([a[left], mid[right]]), np.concatenate([mid[left], b[right]])
        if not len(a):
            break
    return tuple(map(np.concatenate, zip(*out, strict=True)))


class _Lines:
    """The lines with a word in their normal form, of a column of texts: row, place, hash g, characters n, and words."""

    def __init__(self, column: pa.Array):
        data, offs = binary_column(column)
        data = _FORM[data]
        ls, _, ld = tv.lines(data, offs)
        s, e, _ = tv.words(data, offs)
        counts = np.diff(np.append(np.searchsorted(s, ls), len(s)))  # a line's start never lies inside a word
        of = np.repeat(np.arange(len(ls)), counts)  # line of each word
        hashes = tv.Spans(data).hash(s, e) if len(s) else np.empty(0, _U)
        has = np.flatnonzero(counts)
        first = (np.cumsum(counts) - counts)[has]
        place = np.arange(len(s)) - np.repeat(first, counts[has])
        sums = np.add.reduceat(tv.mix(hashes + place.astype(_U) * _U(0x632BE59BD9B4E019)), first) if len(s) else np.empty(0, _U)
        self.g = tv.mix(sums + counts[has].astype(_U))
        points = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
        np.cumsum(_START[data], out=points[1:])
        chars = (points[e] - points[s]).astype(np.int64)
        self.n = (np.add.reduceat(chars, first) if len(s) else np.empty(0, np.int64)) + counts[has] - 1
        line_of_doc = np.concatenate([[0], np.cumsum(np.bincount(ld, minlength=max(0, len(offs) - 1)))])
        self.doc, self.pos = ld[has], has - line_of_doc[ld[has]]
        # of each different line of the slice, its different words in the order of their hashes
        _, one, self.back = np.unique(self.g, return_index=True, return_inverse=True)
        self.one = one
        rank = np.full(len(ls), -1)
        rank[has[one]] = np.arange(len(one))
        mine = rank[of] >= 0
        of, hashes, chars = rank[of[mine]], hashes[mine], chars[mine]
        bits = max(1, len(one).bit_length())
        order = np.argsort(of.astype(_U) << _U(64 - bits) | hashes >> _U(bits))
        of, hashes, chars = of[order], hashes[order], chars[order]
        new = np.append(True, (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1]))[: len(of)]
        self.hashes, self.chars = hashes[new], chars[new]
        edges = np.searchsorted(of[new], np.arange(len(one) + 1))
        self.a, self.b = edges[:-1], edges[1:]

    def simhashes(self) -> np.ndarray:
        return voted(self.hashes, self.a, self.b)[self.back]

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, row) of the blocks of each different line, under the first row that has it; in the order of rows."""
        n = self.n[self.one]
        nodes, lines = [], []
        for deal, (least, lo, hi) in [(0, x) for x in BLOCKS] + [(i, BLOCKS[0]) for i in range(1, DEALS)]:
            at = np.flatnonzero((n >= lo) & (n <= hi))
            size = self.b[at] - self.a[at]
            start = np.cumsum(size) - size
            index = np.repeat(self.a[at] - start, size) + np.arange(size.sum())
            hashes, chars = self.hashes[index], self.chars[index]
            if deal:  # dealt by another hash, so that other words stand together
                hashes = tv.mix(hashes ^ _U(deal))
                bits = max(1, len(at).bit_length())
                order = np.argsort(np.repeat(np.arange(len(at), dtype=_U), size) << _U(64 - bits) | hashes >> _U(bits))
                hashes, chars = hashes[order], chars[order]
            a, b, depth = _parts(hashes, chars, start, start + size, least)
            nodes.append(tv.mix(voted(hashes, a, b) ^ tv.mix(depth.astype(_U))))
            lines.append(at[np.searchsorted(start, a, "right") - 1] if len(a) else at[:0])
        nodes, rows = np.concatenate(nodes), self.one[np.concatenate(lines)]
        keys = np.sort(rows.astype(_U) << _U(32) | np.arange(len(rows), dtype=_U))
        order = (keys & _U((1 << 32) - 1)).view(np.int64)
        return nodes[order], rows[order]


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, row, pos, g, n, sim, nodes) of every line with a word in its normal form.

    `nodes` are its blocks, once for all equal lines of a slice of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            p = _Lines(b.column("text"))
            own = [b.column(c).take(pa.array(p.doc)) for c in ("doc_id", "row")]
            found = (p.pos, p.g.view(np.int64), p.n, p.simhashes().view(np.int64))
            node, of = p.blocks()
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(p.g)))]).astype(np.int32)
            nodes = pa.ListArray.from_arrays(pa.array(ends), pa.array(node.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x) for x in found), nodes], names=["doc_id", "row", "pos", "g", "n", "sim", "nodes"])

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, pos long, g long, n long, sim long, nodes array<long>")


def _gathered(batches: Iterator[pa.RecordBatch], key: str, least: int = 1 << 16) -> Iterator[pa.Table]:
    """Rows, sorted by `key`, in tables that hold all rows of each of their keys."""
    held: list[pa.RecordBatch] = []
    count = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count >= least:
            t = pa.Table.from_batches(held).combine_chunks()
            keys = t.column(key).to_numpy()
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if last:
                yield t.slice(0, last)
            held, count = t.slice(last).to_batches(), t.num_rows - last
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _several(node: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of the nodes (sorted) that several different lines have."""

    def twice(node: np.ndarray) -> np.ndarray:
        same = node[1:] == node[:-1]
        return np.append(False, same) | np.append(same, False)

    at = twice(node) if len(node) else np.empty(0, bool)
    node, g = node[at], g[at]  # few: most blocks are one line's
    if not len(node):
        return node, g
    order = np.lexsort((g, node))
    node, g = node[order], g[order]
    new = np.append(True, (node[1:] != node[:-1]) | (g[1:] != g[:-1]))
    node, g = node[new], g[new]
    at = twice(node)
    return node[at], g[at]


def _of_several(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(node, g) of rows sorted by node: of each node that several different lines have, these lines.

    Up to `most` rows of a node are held; a line that a larger node has more than once may be given again.
    """
    last, held, count, given = None, [], 0, False  # the last node, its lines so far, whether some of them were given

    def batch(node: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(g)], names=["node", "g"])

    def rest() -> Iterator[pa.RecordBatch]:
        g = np.unique(np.concatenate(held)) if held else np.empty(0, np.int64)
        if len(g) > 1 or given and len(g):
            yield batch(np.full(len(g), last), g)

    for b in batches:
        if not b.num_rows:
            continue
        node, g = b.column("node").to_numpy(), b.column("g").to_numpy()
        own = int(np.searchsorted(node, last, "right")) if last is not None and node[0] == last else 0
        if own:
            held.append(g[:own])
            count += own
            if count >= most:
                held = [np.unique(np.concatenate(held))]
                count = len(held[0])
                if count > 1 and 2 * count > most:
                    yield from rest()
                    held, count, given = [], 0, True
        if own < len(node):
            yield from rest()
            end = max(own, int(np.searchsorted(node, node[-1], "left")))
            yield batch(*_several(node[own:end], g[own:end]))
            last, held, count, given = node[-1], [g[end:]], len(node) - end, False
    yield from rest()


def _shared(rows: DataFrame) -> DataFrame:
    """(node, g) of the blocks that several different lines have; nothing but these two numbers is shuffled, and only the first is sorted by.

    Of a node of over HELD rows, a line may be given more than once, which adds no link.
    """
    keys = rows.select(F.explode("nodes").alias("node"), "g").repartition("node").sortWithinPartitions("node")
    return keys.mapInArrow(partial(_of_several, most=HELD), "node long, g long")


def _close(sim_a: np.ndarray, sim_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(sim_a ^ sim_b) <= SIFT) & (np.minimum(n_a, n_b) >= SIMILARITY * np.maximum(n_a, n_b) - 1e-9)


def partnered(node: np.ndarray, sim: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether each row (sorted by node) has a close one in its node."""
    sim = sim.view(_U)  # counts of set bits are of unsigned numbers
    found = np.zeros(len(node), bool)
    starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    sizes = np.diff(np.append(starts, len(node)))
    size = np.repeat(sizes, sizes)
    few = np.flatnonzero((size > 1) & (size <= SHIFTS))
    v, a, m = node[few], sim[few], n[few]
    for k in range(1, min(SHIFTS, len(few))):
        i = np.flatnonzero(v[k:] == v[:-k])
        if not len(i):
            break
        i = i[_close(a[i], a[i + k], m[i], m[i + k])]
        found[few[i]] = True
        found[few[i + k]] = True
    for lo, many in zip(starts[sizes > SHIFTS], sizes[sizes > SHIFTS], strict=True):
        order = np.argsort(n[lo : lo + many], kind="stable")  # only lines of like length can be close
        s, m = sim[lo : lo + many][order], n[lo : lo + many][order]
        ends = np.searchsorted(m, m / SIMILARITY + 1e-9, "right")
        hit = np.zeros(many, bool)
        for x in range(0, many, 128):
            y = int(ends[min(many, x + 128) - 1])
            i, j = np.nonzero(_close(s[x : x + 128, None], s[None, x:y], m[x : x + 128, None], m[None, x:y]))
            i, j = i + x, j + x
            hit[i[i < j]] = True
            hit[j[i < j]] = True
        found[lo + order] = hit
    return found


def _sifted(rows: DataFrame) -> DataFrame:
    """(node, g) of rows(cell, node, g, n, sim) with a close one in their cell, a part of the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches, "cell"):
            cell, sim, n = (t.column(c).to_numpy() for c in ("cell", "sim", "n"))
            at = pa.array(np.flatnonzero(partnered(cell, sim, n)))
            yield from t.select(["node", "g"]).take(at).combine_chunks().to_batches()

    return rows.select("cell", "node", "g", "n", "sim").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "node long, g long")


def _large(rows: DataFrame, most: int) -> DataFrame | None:
    """(node, large) of the nodes with more rows; None if there are none."""
    large = written(rows.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > most).select("node", F.lit(True).alias("large")), "large")
    return large if large.limit(1).count() else None


def _dealt(rows: DataFrame) -> DataFrame:
    """rows(node, g, n, sim) of large nodes over cells of about CELL rows; any two that can be close share one.

    Only lines of like length can be close, so a node falls into classes of length, of
    which each meets itself and the next; a class is dealt over as many parts as it
    takes, and every part meets every other.
    """
    # classes are a little wider than the ratio of lengths, so close lines are at most one apart
    k = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1 / SIMILARITY) + 1e-3))
    near = rows.withColumn("k", F.explode(F.array(k, k + 1)))
    parts = near.groupBy("node", "k").agg(F.ceil(2 * F.count("*") / F.lit(CELL)).cast("int").alias("parts"))
    near = near.join(parts, ["node", "k"]).withColumn("mine", F.pmod(F.xxhash64("g", "node"), F.col("parts")).cast("int"))
    near = near.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return near.withColumn("cell", F.xxhash64("node", "k", F.least("mine", "other"), F.greatest("mine", "other")))


def _candidates(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """(node, g) of the lines that have a close one in a node, under each such node.

    A block of very common words may be many lines': the lines of such a node meet in
    cells of bounded size, all that can be close.
    """
    rows = written(_shared(lines), "shared")
    facts = distinct.select("g", "n", "sim")
    large = _large(rows, CELL)
    if large is None:
        found = _sifted(rows.join(facts, "g").withColumn("cell", F.col("node")))
    else:
        marked = only_these(rows, large, "node", "left").join(facts, "g")
        found = _sifted(marked.where("large IS NULL").withColumn("cell", F.col("node")))
        found = found.unionByName(_sifted(_dealt(marked.where("large"))).distinct())
    found = written(found, "sifted")
    # near copies share most of their blocks: of nodes with the same lines one is enough
    same = found.groupBy("node").agg(F.sum(F.xxhash64("g").cast("decimal(38,0)")).alias("s"), F.count("*").alias("c"))
    one = same.groupBy("s", "c").agg(F.min("node").alias("node"))
    return written(found.join(one.select("node"), "node", "left_semi"), "sifted")


def _like(sk_a: np.ndarray, sk_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    apart = np.bitwise_count(np.ascontiguousarray(sk_a).view(_U) ^ np.ascontiguousarray(sk_b).view(_U))
    second = apart[..., 1:].sum(-1, dtype=np.int64)
    near = (apart[..., 0] <= SIFT) & (second <= NEAR)
    return near & (np.minimum(n_a, n_b) >= SIMILARITY * np.maximum(n_a, n_b) - 1e-9), 256 - second


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance: equal ends are cut off, the rest by Myers' bit vectors (Hyyro 2003)."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    a, b = a[lo:], b[lo:]
    cut, hi = 0, min(len(a), len(b))
    while cut < hi and a[-1 - cut] == b[-1 - cut]:
        cut += 1
    a, b = a[: len(a) - cut], b[: len(b) - cut]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    full = (1 << len(a)) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, get = full, 0, where.get
    for c in b:  # only d is cut to len(a) bits: what stands above never comes down
        eq = get(c, 0)
        d = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up = (minus | (d | plus) ^ full) << 1 | 1
        plus = (plus & d) << 1 | (d | up) ^ full
        minus = up & d
    return len(b) + (plus & full).bit_count() - minus.bit_count()


def normal_form(line: str) -> str:
    return b" ".join(_FORM[np.frombuffer(line.encode(), np.uint8)].tobytes().split()).decode()


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, n, sk, payload): sketches and normal forms of the wanted lines (row, at: [(pos, g, n, sim)])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            g, n, sim, found = [], [], [], []
            for t, at in zip(texts_of(b.column("text")), b.column("at").to_pylist(), strict=True):
                lines = t.split("\n")
                for x in at:
                    g.append(x["g"])
                    n.append(x["n"])
                    sim.append(x["sim"])
                    found.append(normal_form(lines[x["pos"]]).encode())
            padded = [b" " + f + b" " for f in found]
            data = np.frombuffer(b"".join(padded), np.uint8)
            line = np.repeat(np.arange(len(padded)), [len(f) for f in padded])
            sk = np.concatenate([np.array(sim, np.int64).view(_U)[:, None], simhashes(data, line, len(padded), RUNS, 256)], 1)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in sk], pa.binary()), pa.array(found, pa.binary())], names=["g", "n", "sk", "payload"])

    rows = only_these(docs, wanted, "row", array="at").select("text", "at")
    return rows.mapInArrow(run, "g long, n long, sk binary, payload binary").dropDuplicates(["g"])


def _aligned(x: list[str], y: list[str], most: int) -> bool:
    """Whether a quick alignment of words costs at most `most` characters: where words differ, the next equal ones within three are looked for."""
    i = j = cost = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        d, e = 1, 1
        for p, q in ((0, 1), (1, 0), (1, 1), (0, 2), (2, 0), (1, 2), (2, 1), (2, 2), (0, 3), (3, 0)):
            if i + p < len(x) and j + q < len(y) and x[i + p] == y[j + q]:
                d, e = p, q
                break
        # words of one side become those of the other, the space behind each included
        cost += max(sum(map(len, x[i : i + d])) + d, sum(map(len, y[j : j + e])) + e)
        if cost > most:
            return False
        i, j = i + d, j + e
    return cost + sum(map(len, x[i:])) + len(x) - i + sum(map(len, y[j:])) + len(y) - j <= most


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`: a quick alignment that shows it will do, else the distance is taken."""
    if abs(len(a) - len(b)) > most:
        return False
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and sum(max(len(p), len(q)) for p, q in zip(x, y, strict=True) if p != q) <= most:
        return True
    return _aligned(x, y, most) or edit_distance(a, b) <= most


def _same(a: bytes, b: bytes) -> bool:
    x, y = a.decode(), b.decode()
    return within(x, y, math.floor((1 - SIMILARITY) * max(len(x), len(y)) + 1e-9))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, row, text) of rows with a key and a text; a row is named by both, so equal keys may have unlike texts."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, gone): the positions of the lines of each row (xxhash64 of key and text) that another occurrence stands for."""
    docs = _rows(docs, key, text)
    rows = written(profiles(docs), "lines")
    distinct = written(rows.groupBy("g").agg(F.min(F.struct("doc_id", "row", "pos")).alias("at"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "sim"))), "distinct")
    found = _candidates(rows, distinct)
    at = distinct.join(found.select("g").distinct(), "g", "left_semi").select(F.col("at.row").alias("row"), F.struct(F.col("at.pos").alias("pos"), "g", "n", "sim").alias("x"))
    full = written(_texts(docs, written(at.groupBy("row").agg(F.collect_list("x").alias("at")), "wanted")), "texts")
    sizes = found.groupBy("node").agg(F.count("*").alias("size"))
    members = written(found.join(sizes, "node").join(full.select("g", "n", "sk"), "g"), "members")
    comps = link(members, _like, lambda ids: full.select("g", "payload").join(ids, "g", "left_semi"), _same, by_node=True)
    grouped = distinct.select("g", "at", "copies").join(comps.withColumnRenamed("node", "g"), "g", "left").where("copies > 1 OR component IS NOT NULL")
    grouped = grouped.withColumn("component", F.coalesce("component", "g"))
    first = grouped.groupBy("component").agg(F.min("at").alias("first"))
    verdict = grouped.join(first, "component").select("g", "first")
    gone = rows.join(verdict, "g").where("first.row <> row OR first.pos <> pos")
    return gone.groupBy("row").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The documents with all their columns, their text without the lines that go, and two counts, named by `counts`.

    Of each group of lines the occurrence with the least (key, row, position) stays.  Lines
    without a letter or digit, null texts and documents with a null key stay as they are.
    Rows of equal key and text count as one document (equal lines of theirs stay
    together); rows of equal key and unlike texts are documents of their own.  An empty
    table gives no rows.  Only `key` and `text` are read, other columns pass through; give
    `counts` other names where the documents have columns of theirs.
    """
    table = written(removals(docs, key, text), "gone").withColumnRenamed("row", "__lw_row").withColumnRenamed("gone", "__lw_gone")
    columns = docs.columns
    row = F.when(F.col(key).isNotNull() & F.col(text).isNotNull(), F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string")))
    rows = only_these(docs.withColumn("__lw_row", row), table, "__lw_row", "left", "__lw_gone")
    pieces = F.split(F.col(text), "\n", -1)
    kept = F.when(F.col("__lw_gone").isNull(), F.col(text)).otherwise(F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains(F.col("__lw_gone"), i.cast("long"))), "\n"))
    feeds = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))  # no text is split for its number of lines
    counted = (F.coalesce(feeds + 1, F.lit(0)), F.coalesce(F.size("__lw_gone"), F.lit(0)))
    return rows.select(*[kept.alias(c) if c == text else F.col(c) for c in columns], *[x.alias(c) for x, c in zip(counted, counts, strict=True)])

"""Byte-level BPE by a segment tree: leaves are byte positions, every node holds the leftmost least pair rank below it."""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: The general pattern of byte-level vocabularies (a fixed value), and the same for ASCII texts in the faster of the two engines.
_GENERAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.A)
_NONE = 1 << 60
#: Distinct pre-tokens whose ids a worker keeps; when full, it starts anew.
CACHE = 400_000


#: A code point that no Unicode version assigns so far.
_UNASSIGNED = 0x378


@lru_cache(maxsize=1)
def _recent() -> frozenset[str]:
    """Letters, digits and spaces of the split's Unicode tables that the interpreter's older tables don't have.

    A set, as a text is asked for them at every encoding: a character class of as many
    is tried one after another at each place.
    """
    known = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}\s]", known) if unicodedata.category(c) == "Cn")


@lru_cache(maxsize=8)
def _unknown(path: str, pattern: str) -> dict[int, int]:
    """Of these, the code points that the rank library splits otherwise, as a translation to an unassigned one.

    Its tables are of another Unicode version, so it is asked: each point stands beside
    letters, digits and spaces in a short text that is encoded both ways.
    """
    import tiktoken

    library = tiktoken.Encoding("asked", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})
    split, ranks, found = regex.compile(pattern).findall, ranks_of(path), {}
    for c in sorted(_recent()):
        text = f"a{c} {c}1{c}{c}\n{c} b{c}'s {c}"
        if library.encode_ordinary(text) != [i for piece in split(text) for i in merge(piece.encode(), ranks)]:
            found[ord(c)] = _UNASSIGNED
    return found


@lru_cache(maxsize=8)
def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file (installed beside the workers' libraries, so a local path)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token.

    The tree has a leaf for each byte; a live leaf holds the rank of its token joined
    with the next live one.  The root's leftmost least rank is merged next; that updates
    the leaf itself, its live left neighbour and the leaf that dies: three paths to the root.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)  # rank * 2**k + position, so that least is leftmost
    shift = size.bit_length()
    get = ranks.get
    after = list(range(1, n + 1))  # start of the next live token
    before = list(range(-1, n - 1))

    def leaf(i: int) -> int:
        j = after[i]
        if j >= n:
            return _NONE
        r = get(piece[i : after[j]])
        return _NONE if r is None else r << shift | i

    tree[size : size + n - 1] = [leaf(i) for i in range(n - 1)]
    for x in range(size - 1, 0, -1):
        a, b = tree[2 * x], tree[2 * x + 1]
        tree[x] = a if a < b else b

    def put(i: int, value: int) -> None:
        x = size + i
        tree[x] = value
        x >>= 1
        while x:
            a, b = tree[2 * x], tree[2 * x + 1]
            least = a if a < b else b
            if tree[x] == least:
                break
            tree[x] = least
            x >>= 1

    mask = (1 << shift) - 1
    while (top := tree[1]) != _NONE:
        i = top & mask
        j = after[i]
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
        put(j, _NONE)
        put(i, leaf(i))
        if i:
            h = before[i]
            put(h, leaf(h))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


#: Nodes of trees that are worked on at a time, a processor's cache full.
STEP = 1 << 17
#: Bytes of pre-tokens up to which many are merged at once; longer ones are merged one by one.
SHORT = 128


class Joins:
    """The rank of a pair of tokens joined, for arrays of pairs: a sorted table of all pairs that make a token."""

    def __init__(self, ranks: dict[bytes, int]):
        get = ranks.get
        found = [(a << 32 | b, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None]
        found.sort()
        self.keys = np.array([k for k, _ in found] + [-1], np.int64)  # the last is no pair
        self.ranks = np.array([r for _, r in found] + [_NONE], np.int64)
        self.bits = max(1, (2 * len(found)).bit_length())
        # slots of a hash table with linear probing, filled in rounds
        self.slots = np.full(1 << self.bits, len(found))
        left, at = np.arange(len(found)), self._slot(self.keys[:-1])
        self.probes = 0
        while len(left):
            free = self.slots[at] == len(found)
            self.slots[at[free]] = left[free]  # of several that want a slot, the last has it
            stay = self.slots[at] != left
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)
            self.probes += 1
        self.bytes = np.array([get(bytes([b]), -1) for b in range(256)], np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        slot = self._slot(keys)
        at = self.slots[slot]
        out = self.ranks[at]
        open_ = np.flatnonzero((self.keys[at] != keys) & (out != _NONE))
        out[open_] = _NONE
        for _ in range(1, self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = self.slots[slot[open_]]
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (self.ranks[at] != _NONE)]
        return out


def merge_many(pieces: list[bytes], joins: Joins) -> list[bytes]:
    """Ids (little-endian unsigned 32-bit) of pre-tokens of 2 to SHORT bytes that are no tokens: `merge` on the trees of many at once."""
    out: list[bytes] = [b""] * len(pieces)
    lengths = np.array(list(map(len, pieces)), np.int64)
    order = np.argsort(lengths, kind="stable")
    lo = 0
    while lo < len(order):
        size = 1 << (int(lengths[order[lo]]) - 1).bit_length()
        hi = min(int(np.searchsorted(lengths[order], size, "right")), lo + max(1, STEP // (2 * size)))
        some = order[lo:hi]
        data, counts = _merged([pieces[i] for i in some], lengths[some], size, joins)
        ends = (4 * np.cumsum(counts)).tolist()
        for i, a, b in zip(some.tolist(), [0, *ends], ends, strict=False):
            out[i] = data[a:b]
        lo = hi
    return out


def _merged(pieces: list[bytes], n: np.ndarray, size: int, joins: Joins) -> tuple[bytes, np.ndarray]:
    """(all ids, how many each piece has) of pieces of n bytes, at most `size`, a power of two; each has a row of the arrays."""
    m, shift = len(pieces), size.bit_length()
    place = np.arange(size)
    inside = place < n[:, None]
    ids = np.full((m, size + 1), -1, np.int64)  # at the start of each live token
    ids[:, :-1][inside] = joins.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
    tree = np.full((m, 2 * size), _NONE)  # rank * 2**k + position, so that least is leftmost
    both = np.nonzero(place < n[:, None] - 1)
    rank = joins(ids[both], ids[both[0], both[1] + 1])
    tree[both[0], size + both[1]] = np.where(rank == _NONE, _NONE, rank << shift | both[1])
    for level in reversed([1 << k for k in range(shift - 1)]):
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    after = np.tile(np.arange(1, size + 2), (m, 1))  # start of the next live token
    before = np.tile(np.arange(-1, size), (m, 1))
    live = inside.copy()
    flat, flat_ids, flat_after, flat_before = tree.reshape(-1), ids.reshape(-1), after.reshape(-1), before.reshape(-1)
    row = np.arange(m)
    while True:
        top = flat[row * (2 * size) + 1]
        going = top != _NONE
        row, top = row[going], top[going]
        if not len(row):
            break
        own, ends = row * (size + 1), n[row]
        i = top & ((1 << shift) - 1)
        j = flat_after[own + i]
        k = flat_after[own + j]
        flat_ids[own + i] = top >> shift
        flat_after[own + i] = k
        live[row, j] = False
        more = np.flatnonzero(k < ends)
        flat_before[own[more] + k[more]] = i[more]
        first = np.flatnonzero(i > 0)
        h = flat_before[own[first] + i[first]]
        # the leaf that dies, the leaf itself, its live left neighbour
        leaves = np.concatenate([j, i, h])
        rows = np.concatenate([row, row, row[first]])
        a, b = np.concatenate([i[more], h]), np.concatenate([k[more], i[first]])
        base = np.concatenate([own[more], own[first]])
        rank = joins(flat_ids[base + a], flat_ids[base + b])
        values = np.full(len(leaves), _NONE)
        values[np.concatenate([len(row) + more, np.arange(2 * len(row), len(leaves))])] = np.where(rank == _NONE, _NONE, rank << shift | a)
        base, x = rows * (2 * size), leaves + size
        flat[base + x] = values
        for _ in range(shift - 1):
            x >>= 1
            at = base + 2 * x
            flat[base + x] = np.minimum(flat[at], flat[at + 1])
    return ids[:, :-1][live].astype("<u4").tobytes(), live.sum(1)


class Codec:
    """Encodes texts to ids and back; one for each worker and vocabulary."""

    def __init__(self, path: str, pattern: str):
        self.ranks = ranks_of(path)
        self.path, self.pattern = path, pattern
        self.ascii = _ASCII.findall if pattern == _GENERAL else None
        self.split = regex.compile(pattern).findall
        self.places = regex.compile(pattern).finditer
        self.ids: dict[str, bytes] = {}
        self.joins = Joins(self.ranks)
        top = max(self.ranks.values()) + 1
        lengths = np.zeros(top, np.int64)
        for token, rank in self.ranks.items():
            lengths[rank] = len(token)
        self.lengths = lengths
        self.starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        by_rank = sorted((rank, token) for token, rank in self.ranks.items())
        self.bytes = np.frombuffer(b"".join(t for _, t in by_rank), np.uint8)

    def pieces(self, text: str) -> list[str]:
        """The text's pre-tokens, as the rank library splits it."""
        if text.isascii():
            return (self.ascii or self.split)(text)
        if _recent().isdisjoint(text):
            return self.split(text)
        stand_in = text.translate(_unknown(self.path, self.pattern))  # one code point for each
        return [text[m.start() : m.end()] for m in self.places(stand_in)]

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit numbers."""
        return self.encode_all([text])[0]

    def merged(self, new: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """(pre-token, its ids) of each of `new`, those that are no tokens merged together."""
        rest = []
        for p in new:
            whole = self.ranks.get(raw := p.encode())
            if whole is not None:
                yield p, whole.to_bytes(4, "little")
            elif len(raw) > SHORT:
                yield p, np.array(merge(raw, self.ranks), "<u4").tobytes()
            else:
                rest.append((p, raw))
        yield from zip([p for p, _ in rest], merge_many([raw for _, raw in rest], self.joins), strict=True)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; pre-tokens that are new to the worker are merged together."""
        texts = [self.pieces(t) for t in texts]
        if len(self.ids) > CACHE:
            self.ids.clear()
        ids = self.ids
        ids.update(self.merged(set().union(*texts).difference(ids)))
        return [np.frombuffer(b"".join(map(ids.__getitem__, t)), "<u4") for t in texts]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, gathered from the vocabulary's bytes laid end to end."""
        if not len(ids):
            return b""
        ids = ids.astype(np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + lengths, lengths)].tobytes()


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every text: its ids, and the bytes they decode to.

    Null and empty texts have no ids.  Rows are encoded one by one, so ties and repeated
    rows give equal rows; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in sliced(batches, "text"):
            ids = c.encode_all(texts_of(b.column("text")))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([c.decode(x) for x in ids], pa.binary())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")

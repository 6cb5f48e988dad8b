"""Hierarchical multi-length packing: tiers of context sizes, gaps filled from shorter tiers, balanced step groups."""

from __future__ import annotations

import json
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import texts_of
from .common import sliced

#: Context sizes, longest first; each a power of two, so a full window of any tier has no padding.
TIERS = (2048, 1024, 512, 256)
#: Tokens of a step group: 8 windows of the longest tier, 64 of the shortest.
GROUP_TOKENS = 16_384
#: Step groups of one tier that are balanced against each other.
BALANCED = 8


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Callable[[str], list[int]]:
    """text -> ids as the `tokenizers` library gives for the file with add_special_tokens=False.

    None is added, but a special string that stands in the text is its own id.

    Where the file is a plain byte-level BPE whose merges are in the order of their ids,
    ids are ranks, and the same ids come several times faster from a rank encoder.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    vocab = model.get("vocab")
    plain = (
        pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens", []))
    )
    if plain:
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab["".join(m)] for m in merges]
        letters = _byte_letters()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ordinary = {t: i for t, i in vocab.items() if t not in special}
        plain = made == sorted(set(made)) and len(ordinary) == 256 + len(made) and all(c in letters for t in ordinary for c in t)
    if plain:
        import tiktoken

        ranks = {bytes(letters[c] for c in t): i for t, i in ordinary.items()}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec.get("added_tokens", [])})
        return lambda text: own.encode(text, allowed_special="all")
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


class Packer:
    """Packs one partition's documents as they come.

    A document's full windows of the longest tier go out as they are; what is left (or a
    short document) is routed to the smallest tier that holds it.  Windows are opened for
    the longest tier first; the gap behind a document is filled from shorter tiers, whole
    documents where they fit and else a cut one, so that windows are full.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.queues: list[deque] = [deque() for _ in tiers]
        self.held = 0

    def _route(self, item: tuple, front: bool = False) -> None:
        n = item[2]
        at = max(i for i, t in enumerate(self.tiers) if n <= t)
        (self.queues[at].appendleft if front else self.queues[at].append)(item)

    def add(self, doc: int, total: int) -> Iterator[tuple[int, list]]:
        """Windows (size, pieces) that are full at once; a piece is (document, start, length)."""
        top, start = self.tiers[0], 0
        while total - start >= top:
            yield top, [(doc, start, top)]
            start += top
        if total > start:
            self._route((doc, start, total - start))
            self.held += total - start

    def _take(self, gap: int, after: int) -> tuple | None:
        """A piece of at most `gap` ids from the tiers from `after` on, longest that fits first; cut if none fits."""
        for q in self.queues[after:]:
            if q and q[0][2] <= gap:
                return q.popleft()
        for q in [*self.queues[after:], *self.queues[:after][::-1]]:
            if q:
                doc, start, n = q.popleft()
                if n > gap:
                    self._route((doc, start + gap, n - gap), front=True)
                return doc, start, min(n, gap)
        return None

    def windows(self, least: int) -> Iterator[tuple[int, list]]:
        """Full windows for as long as more than `least` ids are held."""
        for at, size in enumerate(self.tiers):
            while self.queues[at] and self.held - size >= least:
                first = self.queues[at].popleft()
                pieces, room = [first], size - first[2]
                while room:
                    piece = self._take(room, at + 1)
                    pieces.append(piece)
                    room -= piece[2]
                self.held -= size
                yield size, pieces

    def rest(self) -> Iterator[tuple[int, list]]:
        """The last ids of a partition, in windows of falling powers of two: nothing is padded."""
        yield from self.windows(0)
        size = 1 << max(0, self.held.bit_length() - 1)
        while self.held:
            while size > self.held:
                size >>= 1
            pieces, room = [], size
            while room:
                piece = self._take(room, 0)
                pieces.append(piece)
                room -= piece[2]
            self.held -= size
            yield size, pieces


class Groups:
    """Deals windows of one tier to step groups of equal token counts, and of nearly equal attention cost (sum of squared piece lengths)."""

    def __init__(self) -> None:
        self.waiting: dict[int, list] = {}
        self.n_groups = 0

    def add(self, size: int, pieces: list) -> Iterator[tuple[int, int, list]]:
        held = self.waiting.setdefault(size, [])
        held.append(pieces)
        if len(held) >= BALANCED * max(1, GROUP_TOKENS // size):
            yield from self._deal(size)

    def _deal(self, size: int) -> Iterator[tuple[int, int, list]]:
        held = sorted(self.waiting.pop(size), key=lambda ps: -sum(p[2] ** 2 for p in ps))
        n = -(-len(held) // max(1, GROUP_TOKENS // size))
        for i, pieces in enumerate(held):  # back and forth over the groups
            turn, at = divmod(i, n)
            yield self.n_groups + (at if turn % 2 == 0 else n - 1 - at), size, pieces
        self.n_groups += n

    def rest(self) -> Iterator[tuple[int, int, list]]:
        for size in sorted(self.waiting, reverse=True):
            yield from self._deal(size)


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"


def pack(docs: DataFrame, path: str, end_id: int = 1, key: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece: the document it is of, its place there, its ids, its sequence and place there, its step group.

    Each partition of `docs` is packed by itself, so nothing is shuffled and memory holds
    one slice of documents; sequence and group numbers begin with the partition's number.
    Every id lies in one piece.  Null or empty text is the end id alone; repeated rows are
    packed each; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        packer, groups = Packer(tiers), Groups()
        base = TaskContext.get().partitionId() << 36
        docs_held: dict[int, list] = {}  # by arrival: [doc_id, ids, ids not yet sent]
        n_docs = n_sequences = 0

        def batch_of(placed: list[tuple[int, int, list]]) -> pa.RecordBatch:
            nonlocal n_sequences
            out: list[list] = [[] for _ in range(9)]
            for group, size, pieces in placed:
                offset = 0
                for doc, start, n in pieces:
                    held = docs_held[doc]
                    row = (held[0], start, n, held[1][start : start + n].tobytes(), len(held[1]), base + n_sequences, offset, size, base + group)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    offset += n
                    held[2] -= n
                    if not held[2]:
                        del docs_held[doc]
                n_sequences += 1
            names = [x.split(" ")[0] for x in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, out, strict=True)], names=names)

        for b in sliced(batches, "text"):
            placed: list = []
            for doc_id, t in zip(b.column("doc_id").to_pylist(), texts_of(b.column("text")), strict=True):
                ids = np.frombuffer(array("I", [*encode(t), end_id]), "<u4")
                docs_held[n_docs] = [doc_id, ids, len(ids)]
                for window in packer.add(n_docs, len(ids)):
                    placed += groups.add(*window)
                n_docs += 1
            for window in packer.windows(64 * tiers[0]):
                placed += groups.add(*window)
            if placed:
                yield batch_of(placed)
        placed = []
        for window in packer.rest():
            placed += groups.add(*window)
        placed += groups.rest()
        if placed:
            yield batch_of(placed)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES)

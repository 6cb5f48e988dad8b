"""Edit-aware token counts: a segment tree over each document's pre-tokens, re-encoded only around edits.

Leaves are runs of pre-tokens; every node sums characters and tokens below it.  An edit
goes down to the leaves it touches.  A pre-token depends on its own characters and at
most two behind it (of a contraction), and splitting has no memory: from any old boundary
at least three characters before the edit, it is done anew until it meets an old boundary
behind the edit again, and only these pre-tokens are encoded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE, codec, merge, texts_of
from .common import sliced

#: Pre-tokens of a leaf; one that outgrows twice as many makes the tree be built anew from the counts at hand.
LEAF = 32
#: Characters before an edit that may belong to a pre-token it changes.
CONTEXT = 3


class Counter:
    """Tokens of each pre-token, by byte-level BPE."""

    def __init__(self, path: str, pattern: str):
        self.codec = codec(path, pattern)
        self.counts: dict[str, int] = {}

    def learn(self, texts: list[list[str]]) -> None:
        """Count the pre-tokens of many texts that are new to the worker, merged together."""
        counts = self.counts
        if len(counts) > CACHE:
            counts.clear()
        counts.update((p, len(ids) // 4) for p, ids in self.codec.merged(set().union(*texts).difference(counts)))

    def of(self, pieces: list[str]) -> list[int]:
        counts = self.counts
        try:
            return list(map(counts.__getitem__, pieces))
        except KeyError:
            pass
        if len(counts) > CACHE:
            counts.clear()
        for p in pieces:
            if p not in counts:
                counts[p] = len(merge(p.encode(), self.codec.ranks))
        return list(map(counts.__getitem__, pieces))


class CountedText:
    """One document under edits."""

    def __init__(self, text: str, split: Callable[[str], list[str]], count: Callable[[list[str]], list[int]], pieces: list[str] | None = None):
        """`pieces` is `split(text)` where that is at hand."""
        self.split, self.count = split, count
        pieces = split(text) if pieces is None else pieces
        self.n_encoded = 0
        self._build(pieces, count(pieces))

    def _build(self, pieces: list[str], counts: list[int]) -> None:
        self.leaves = [(pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)] or [([], [])]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (p, c) in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(map(len, p)), sum(c)
        for x in range(self.size - 1, 0, -1):
            self.chars[x] = self.chars[2 * x] + self.chars[2 * x + 1]
            self.tokens[x] = self.tokens[2 * x] + self.tokens[2 * x + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """(leaf that holds character `at`, its first character's place)."""
        x, start = 1, 0
        while x < self.size:
            x *= 2
            if at - start >= self.chars[x]:
                start += self.chars[x]
                x += 1
        return min(x - self.size, len(self.leaves) - 1), start

    def _set(self, i: int, pieces: list[str], counts: list[int]) -> None:
        self.leaves[i] = (pieces, counts)
        x = self.size + i
        self.chars[x], self.tokens[x] = sum(map(len, pieces)), sum(counts)
        x >>= 1
        while x:
            self.chars[x] = self.chars[2 * x] + self.chars[2 * x + 1]
            self.tokens[x] = self.tokens[2 * x] + self.tokens[2 * x + 1]
            x >>= 1

    def edit(self, start: int, stop: int, put: str) -> None:
        """Put `put` in place of the characters from start to stop; places beyond the text mean its end."""
        total = self.n_chars
        start = min(max(0, start), total)
        stop = min(max(start, stop), total)
        if start == stop and not put:
            return
        first, base = self._leaf_at(max(0, start - CONTEXT)) if total else (0, 0)
        if base > max(0, start - CONTEXT):  # the place is the text's end, past empty leaves
            first, base = self._leaf_at(max(0, total - 1))
        pieces, counts = list(self.leaves[first][0]), list(self.leaves[first][1])
        # pre-tokens of the first leaf that end before the context stay as they are
        keep, at = 0, base
        while keep < len(pieces) and at + len(pieces[keep]) <= start - CONTEXT:
            at += len(pieces[keep])
            keep += 1
        last = first
        need = 2
        while True:
            # old pre-tokens from `at` on: through the edit and some beyond
            seen, end = len(pieces), at + sum(map(len, pieces[keep:]))
            beyond = sum(1 for _ in self._after(pieces, keep, at, stop))
            if beyond < need and last + 1 < len(self.leaves):
                last += 1
                pieces += self.leaves[last][0]
                counts += self.leaves[last][1]
                continue
            old = "".join(pieces[keep:])
            new = old[: start - at] + put + old[stop - at :]
            fresh = self.split(new)
            whole = last + 1 >= len(self.leaves)
            shift = len(put) - (stop - start)
            borders, p = {}, at
            for k in range(keep, seen):  # old boundary, in new places -> index of the pre-token that begins there
                if p >= stop:
                    borders[p + shift] = k
                p += len(pieces[k])
            p, meet = at, None
            floor = start + len(put)
            for k, piece in enumerate(fresh):
                # the splitter must have seen what follows: the last pre-tokens of a cut text don't count
                if p >= floor and p in borders and (whole or p + len(piece) + CONTEXT < end + shift):
                    meet = (k, borders[p])
                    break
                p += len(piece)
            if meet or whole:
                break
            need *= 2
        done, rest = meet if meet else (len(fresh), len(pieces))
        made = self.count(fresh[:done])
        self.n_encoded += done
        pieces[keep:rest], counts[keep:rest] = fresh[:done], made
        if len(pieces) > 2 * LEAF * (last - first + 1):
            before, after = self.leaves[:first], self.leaves[last + 1 :]
            all_pieces = [x for p, _ in before for x in p] + pieces + [x for p, _ in after for x in p]
            all_counts = [x for _, c in before for x in c] + counts + [x for _, c in after for x in c]
            self._build(all_pieces, all_counts)
            return
        n = last - first + 1
        step = -(-len(pieces) // n) if pieces else 1
        for i in range(n):
            self._set(first + i, pieces[i * step : (i + 1) * step], counts[i * step : (i + 1) * step])

    @staticmethod
    def _after(pieces: list[str], keep: int, at: int, stop: int) -> Iterator[int]:
        p = at
        for k in range(keep, len(pieces)):
            if p >= stop:
                yield k
            p += len(pieces[k])

    def text(self) -> str:
        return "".join(x for p, _ in self.leaves for x in p)


def count_edited(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", edits: str = "edits") -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_after, n_reencoded, text_after) of every row.

    `edits` holds array<struct<start, stop, put>> in code points; they are applied in
    turn, each to the text that the ones before left.  A null list or entry changes
    nothing, null text is empty, null `put` deletes.  Rows are counted one by one, whatever
    repeats; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, pattern)
        for b in sliced(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            texts = texts_of(b.column("text"))
            pieces = [counter.codec.pieces(t) for t in texts]
            counter.learn(pieces)
            for t, own, changes in zip(texts, pieces, b.column("edits").to_pylist(), strict=True):
                doc = CountedText(t, counter.codec.pieces, counter.of, own)
                row = [doc.n_tokens, 0]
                for e in changes or ():
                    if e is not None:
                        doc.edit(e["start"] or 0, e["stop"] or 0, e["put"] or "")
                        row[1] += 1
                for column, value in zip(out, (*row, doc.n_tokens, doc.n_encoded, doc.text()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string())], names=["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_reencoded", "text_after"])

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(edits).alias("edits"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_reencoded long, text_after string")

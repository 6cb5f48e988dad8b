"""Fill-in-middle documents: an event scan finds where a text's units change width, sums of gaps find a unit's byte.

One Aho-Corasick automaton reads a text's bytes once.  It reports the characters that
change the class - an ASCII character after wider ones, or a wider one after others of
another width - and the sentinels.  Between two events all units have one width, so
their number is the gap's bytes over that width, and the byte of the k-th unit is found
from the running sums at the events alone.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_column, sliced

#: Sentinels before prefix, suffix and middle, as the forms need them (fixed values).
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes that the automaton is given at a time; it takes four times as many as numbers.
CHUNK = 1 << 20
_SENTINEL = 0


class Events:
    """The automaton of one set of sentinels, over bytes written as classes of bytes."""

    def __init__(self, sentinels: Sequence[str] = SENTINELS):
        marks = [s.encode() for s in sentinels]
        own = sorted({b for m in marks for b in m})
        if not all(marks) or any(b > 127 for b in own):
            raise ValueError("sentinels are ASCII and not empty")
        for a in marks:
            for b in marks:
                if any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b))) or (a != b and a in b):
                    raise ValueError(f"{a!r} and {b!r} overlap, so that a text could not be told from them")
        # classes: 1 any other ASCII byte, 2 to 4 a lead of as many bytes, 0 a continuation; a sentinel's bytes stand for themselves
        table = bytearray(b"1" * 128 + b"0" * 64 + b"2" * 32 + b"3" * 16 + b"4" * 16)
        letters = {b: 0x80 + i for i, b in enumerate(own)}
        for b, c in letters.items():
            table[b] = c
        self.table = bytes(table)
        narrow = ["1", *map(chr, letters.values())]
        ends = {1: narrow, 2: ["20"], 3: ["300"], 4: ["4000"]}
        starts = {1: narrow, 2: ["2"], 3: ["3"], 4: ["4"]}
        self.automaton = ahocorasick.Automaton()
        for w, befores in ends.items():
            for v, nexts in starts.items():
                if v != w:
                    for word in (b + n for b in befores for n in nexts):
                        self.automaton.add_word(word, v)
        for m in marks:
            self.automaton.add_word("".join(chr(letters[b]) for b in m), _SENTINEL)
        self.automaton.make_automaton()

    def read(self, text: bytes) -> Units | None:
        """Where units change width; None as soon as a sentinel is found.  `text` is UTF-8."""
        classes = text.translate(self.table).decode("latin-1")
        found = self.automaton.iter(classes[:CHUNK])
        if len(classes) <= CHUNK:
            flat = np.fromiter(chain.from_iterable(found), np.int64)
        else:
            parts = [np.fromiter(chain.from_iterable(found), np.int64)]
            for at in range(CHUNK, len(classes), CHUNK):
                found.set(classes[at : at + CHUNK])
                parts.append(np.fromiter(chain.from_iterable(found), np.int64))
            flat = np.concatenate(parts)
        places, widths = flat[::2], flat[1::2]
        if len(widths) and not widths.all():
            return None
        first = 1 if not classes or classes[0] not in "234" else int(classes[0])
        return Units(np.concatenate([[0], places]), np.concatenate([[first], widths]), len(text))


class Units:
    """Runs of units of one width: `places` their first bytes, `ranks` the units before them."""

    def __init__(self, places: np.ndarray, widths: np.ndarray, size: int):
        self.places, self.widths = places, widths
        counts = np.diff(places, append=size) // widths
        self.ranks = np.concatenate([[0], np.cumsum(counts)])
        self.n = int(self.ranks[-1])

    def byte_of(self, k: int) -> int:
        """The byte that unit k begins at; of n units the n-th begins at the text's end."""
        run = min(bisect_right(self.ranks, k) - 1, len(self.places) - 1)
        return int(self.places[run] + (k - self.ranks[run]) * self.widths[run])


@lru_cache(maxsize=4)
def events(sentinels: tuple[str, ...]) -> Events:
    return Events(sentinels)


def draws(key: Column | str, seed: int = 1) -> list[Column]:
    """Four numbers under 2**32 from the hash of `seed:key`, the same wherever and whenever they are drawn."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", plain_percent: int = 10, spm_percent: int = 20, seed: int = 1, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    A text is cut at two drawn units (code points) into prefix, middle and suffix, and
    written as `psm` (prefix, suffix, middle), `spm` (suffix, prefix, middle) or `plain`
    (as it is: an empty text, one that has a sentinel, or drawn so).  Null text is empty;
    a null key is drawn as an empty one; texts of any length are read whole, in chunks.
    Rows are cut one by one: ties and repeated rows give equal rows, an empty table none;
    other columns, whatever they are called, are not read.
    """
    names = tuple(sentinels)
    if len(names) != 3:
        raise ValueError("three sentinels: before prefix, suffix and middle")
    events(names)
    p, s, m = (x.encode() for x in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = events(names)
        for b in sliced(batches, "text"):
            data, offsets = binary_column(b.column("text"))
            whole, ends = data.tobytes(), offsets.tolist()
            h = [b.column(f"h{i}").to_pylist() for i in range(1, 5)]
            out: list[list] = [[], [], [], [], []]
            for i in range(b.num_rows):
                t = whole[ends[i] : ends[i + 1]]
                units = scan.read(t)
                if units is None or not t or h[2][i] % 100 >= 100 - plain_percent:
                    n = units.n if units is not None else len(t) - t.translate(scan.table).count(b"0")
                    row = (n, "plain", None, None, t)
                else:
                    n = units.n
                    first, last = sorted((h[0][i] % (n + 1), h[1][i] % (n + 1)))
                    x, y = units.byte_of(first), units.byte_of(last)
                    prefix, middle, suffix = t[:x], t[x:y], t[y:]
                    if h[3][i] % 100 < spm_percent:
                        row = (n, "spm", first, last - first, b"".join((s, suffix, p, prefix, m, middle)))
                    else:
                        row = (n, "psm", first, last - first, b"".join((p, prefix, s, suffix, m, middle)))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            n, form, prefix_chars, middle_chars, made = out
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()), pa.array(made, pa.binary()).view(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    kind = docs.schema[key].dataType.simpleString()
    drawn = [x.alias(f"h{i + 1}") for i, x in enumerate(draws(key, seed))]
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), *drawn)
    return narrow.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column | str = "output", form: Column | str = "form", sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that `output` was made of, from it and its form alone."""
    made, how = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    p, s, m = sentinels
    middle = F.substring_index(made, m, -1)
    rest = F.substring_index(made, m, 1)

    def without(part: Column, mark: str) -> Column:
        return F.substring_index(part, mark, -1)

    psm = F.concat(without(F.substring_index(rest, s, 1), p), middle, without(rest, s))
    spm = F.concat(without(rest, p), middle, without(F.substring_index(rest, p, 1), s))
    return F.when(how == "psm", psm).when(how == "spm", spm).otherwise(made)

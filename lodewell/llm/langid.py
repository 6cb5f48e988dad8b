"""Language identification by hyperdimensional profiles.

Letters have random bipolar vectors.  A trigram's vector binds (multiplies) its letters'
vectors, rotated by two, one and no places; a text's vector bundles (adds) those of its
trigrams; a language's prototype bundles its texts'.  Cosine decides.  All sums are of
integers, so no order of adding changes a prototype.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import texts_of
from .common import sliced
from .textvec import mix

#: Components of a vector.
WIDTH = 512
_SYMBOLS = 64
#: Languages that may be learned; prototypes of all of them (4 KB each) are sent to every task.
MOST_LANGUAGES = 5_000


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 for what isn't a letter, a to z their own, other letters dealt over the rest."""
    table = np.zeros(0x110000, np.uint8)
    letters = np.array([i for i in range(0x110000) if chr(i).isalpha()])
    table[letters] = 27 + (mix(letters.astype(np.uint64)) % np.uint64(_SYMBOLS - 27)).astype(np.uint8)
    table[97:123] = np.arange(1, 27)
    return table


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """(3, symbols, width): letter vectors rotated for the first, second and third place of a trigram."""
    n = _SYMBOLS * WIDTH
    bits = mix(np.arange(n, dtype=np.uint64) + np.uint64(0xD1B54A32D192ED03)) >> np.uint64(63)
    v = (bits.astype(np.int8) * 2 - 1).reshape(_SYMBOLS, WIDTH)
    return np.stack([np.roll(v, 2, 1), np.roll(v, 1, 1), v])


def vectors_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(documents x width) bundled trigram vectors, and whether each text has a letter."""
    n = len(texts)
    whole = np.frombuffer("".join(f" {t.lower()} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t.lower()) + 2 for t in texts])
    s = _symbols()[whole].astype(np.int32)
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
    keep = np.ones(len(s), bool)  # a run of other characters is one space
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0) | (doc[1:] != doc[:-1])
    s, doc = s[keep], doc[keep]
    has = np.bincount(doc[s > 0], minlength=n) > 0
    same = doc[2:] == doc[:-2]
    tri = ((s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:])[same]
    doc = doc[:-2][same]
    seen = np.flatnonzero(np.bincount(tri, minlength=_SYMBOLS**3))
    place = np.zeros(_SYMBOLS**3, np.int32)
    place[seen] = np.arange(len(seen))
    a, b, c = _letters()
    grams = (a[seen // _SYMBOLS**2] * b[seen // _SYMBOLS % _SYMBOLS] * c[seen % _SYMBOLS]).astype(np.float32)
    out = np.empty((n, WIDTH), np.float32)
    step = max(1, 2_000_000 // max(1, len(seen)))
    local = place[tri]
    bounds = np.searchsorted(doc, np.arange(0, n + step, step))
    for i, lo in enumerate(range(0, n, step)):
        at = slice(bounds[i], bounds[i + 1])
        m = min(step, n - lo)
        counts = np.bincount((doc[at].astype(np.int64) - lo) * len(seen) + local[at], minlength=m * len(seen)).reshape(m, len(seen)).astype(np.float32)
        out[lo : lo + m] = counts @ grams
    return out, has


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of each non-null language.  A row for each task, language and component is shuffled, whatever the input's size.

    Null texts and languages teach nothing, nor do texts without a letter; long texts are
    read whole and weigh as much as they hold; repeated rows count each; an empty table
    gives no prototypes; other columns, whatever they are called, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in sliced(batches, "text"):
            vectors, _ = vectors_of(texts_of(b.column("text")))
            langs = np.array(b.column("lang").to_pylist(), object)
            for one in set(langs):
                found = vectors[langs == one].astype(np.float64).sum(0).astype(np.int64)
                sums[one] = sums[one] + found if one in sums else found
        for one, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [one] * WIDTH, "at": np.arange(WIDTH), "value": v})

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sums = rows.mapInArrow(run, "lang string, at long, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    sums = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v"))  # WIDTH entries each
    got = sums.limit(MOST_LANGUAGES + 1).collect()
    if len(got) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: is `{lang}` a language column?")
    return {r["lang"]: np.array([x["value"] for x in r["v"]], np.float64) for r in sorted(got, key=lambda r: r["lang"])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns, lang_pred and score = (1 + cosine) / 2.

    `und` with score 0 where text is null or has no letter, or nothing was learned; ties
    go to the language first in alphabetical order.  Whole texts are read; rows are
    judged one by one, so repeated rows are judged alike and an empty table gives no rows.
    Kept columns called lang_pred or score, in capitals or not, give way to the results;
    columns that aren't kept may have any name.
    """
    names = list(prototypes)
    p = np.stack([v / max(1e-12, np.linalg.norm(v)) for v in prototypes.values()]).astype(np.float32) if names else None
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score")]
    kept = docs.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "lang_pred string", "score double"])
    columns = [*kept.columns, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "__lw_text"):
            v, has = vectors_of(texts_of(b.column("__lw_text")))
            if names:
                cosine = (v @ p.T) / np.maximum(1e-12, np.linalg.norm(v, axis=1))[:, None]
                best = cosine.argmax(1)
                score = np.clip((1 + cosine[np.arange(len(best)), best].astype(float)) / 2, 0, 1)
                pred = [names[i] if ok else "und" for i, ok in zip(best, has, strict=True)]
            else:
                score, pred, has = np.zeros(len(v)), ["und"] * len(v), np.zeros(len(v), bool)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(pred, pa.string()), pa.array(np.where(has, score, 0.0))], names=columns)

    asked = docs.select(F.col(text).cast("string").alias("__lw_text"), *keep)
    return asked.mapInArrow(run, schema)

"""Pair scorers that are models: batches of texts in, a number for each pair out."""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: (first texts, second texts) -> a score for each pair; called once for each Arrow batch.
BatchModel = Callable[[Sequence[str], Sequence[str]], Sequence[float]]


def batch_scorer(model: Callable[[], BatchModel]) -> Callable[[Column, Column], Column]:
    """A scorer of two text columns out of a model; `model()` loads it, once for each worker task."""

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        loaded = model()
        for a, b in batches:
            yield pd.Series(loaded(a.fillna("").tolist(), b.fillna("").tolist()), dtype="float64")

    return lambda a, b: score(a, b)

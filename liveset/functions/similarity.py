"""String similarity that the JVM functions do not offer."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def matching_ratio(candidate: str, word: str, cutoff: float = 0.0) -> Column:
    """Ratcliff-Obershelp ratio of candidate pairs; it depends on the argument order.

    Pairs below ``cutoff`` may come back as 0: shared letters bound the ratio from above
    and are much cheaper to count than the ratio.
    """

    def bounded(candidates: pd.Series, words: pd.Series) -> pd.Series:
        letters = {k: Counter(k) for k in {*candidates, *words}}

        def one(a: str, b: str) -> float:
            shared = sum((letters[a] & letters[b]).values())
            if 2.0 * shared < cutoff * (len(a) + len(b)) - 1e-9:
                return 0.0
            return SequenceMatcher(None, a, b).ratio()

        return pd.Series([one(a, b) for a, b in zip(candidates, words)], dtype="float64")

    return F.pandas_udf(bounded, DoubleType())(candidate, word)

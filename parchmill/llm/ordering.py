"""Rows in id order over many tasks, without a sort in one place."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows aimed at in a bucket, and the most buckets: their bounds are held by the driver.  Buckets are
#: streamed, so beyond that many they get longer tasks, not more memory.
ROWS, BUCKETS = 5000, 20_000


def id_bounds(keys: DataFrame, column: str, rows: int = ROWS) -> list[int]:
    """Increasing bounds that cut a long column into buckets of about ``rows`` rows.

    They come from a quantile sketch over all rows; its answer is a constant for all
    later plans, so that a recomputed task deals rows out as before.
    """
    count = keys.count()
    buckets = min(BUCKETS, -(-count // rows))
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    found = keys.agg(F.percentile_approx(column, shares, 20 * buckets)).first()[0]
    return sorted(set(found))


def bucket_of(column: Column, bounds: list[int]) -> Column:
    """The number of bounds that are not above the value: 0 to ``len(bounds)``."""
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), "right").astype(np.int32))

    return place(column)

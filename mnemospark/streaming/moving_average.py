"""The moving-average model on a stream of reviews, with one number of state for each learner.

An extension: the batch model reads a finished log, this one predicts as reviews arrive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "user_id long, review_th long, y long, p double"


def advance(x: float, y: int, rate: float = 0.3) -> tuple[float, float]:
    """(probability told before the review, the state after it)."""
    p = 1 / (1 + math.exp(-x))
    return p, x + rate * (y - p)


def _batch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    x = state.get[0] if state.exists else 1.2
    rows = pd.concat(list(frames)).sort_values("review_th")
    p = []
    for y in rows["y"]:
        told, x = advance(x, y)
        p.append(told)
    state.update((x,))
    yield rows.assign(p=p)[["user_id", "review_th", "y", "p"]]


def predictions(reviews: DataFrame) -> DataFrame:
    """OUTPUT for a streaming frame of (user_id, review_th, y); each micro-batch is taken in order."""
    return reviews.select("user_id", "review_th", "y").groupBy("user_id").applyInPandasWithState(_batch, OUTPUT, "x double", "append", GroupStateTimeout.NoTimeout)

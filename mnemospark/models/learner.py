"""One learner's reviews as arrays: a history matrix for each card, rows that point into it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

#: Columns that a model needs of every retained review.
NEEDED = ("user_id", "card_id", "review_th", "rating", "y", "delta_t", "elapsed_days", "pos", "i", "rmse_bins_lapse", "first_rating", "evaluable", "partition")


@dataclass
class Learner:
    """rows: evaluated reviews in order; card: their card's row in the matrices.

    ratings, delta: (cards, longest history), padded with zeros.
    """

    rows: pd.DataFrame
    card: np.ndarray
    ratings: np.ndarray
    delta: np.ndarray

    @staticmethod
    def of(reviews: pd.DataFrame) -> Learner:
        card_ids, card = np.unique(reviews["card_id"].to_numpy(), return_inverse=True)
        pos = reviews["pos"].to_numpy()
        shape = (len(card_ids), int(pos.max()) + 1 if len(pos) else 1)
        ratings, delta = np.zeros(shape, np.int64), np.zeros(shape)
        ratings[card, pos] = reviews["rating"].to_numpy()
        delta[card, pos] = reviews["delta_t"].to_numpy()
        keep = reviews["evaluable"].to_numpy()
        order = np.argsort(reviews["review_th"].to_numpy()[keep], kind="stable")
        rows = reviews[keep].iloc[order].reset_index(drop=True)
        return Learner(rows, card[keep][order], ratings, delta)

    def __len__(self) -> int:
        return len(self.rows)

    def column(self, name: str) -> np.ndarray:
        return self.rows[name].to_numpy()

    def history(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ratings, delta, lengths) of the reviews before each row, as matrices."""
        lengths = self.column("pos")[at]
        n = int(lengths.max()) if len(lengths) else 0
        return self.ratings[self.card[at], :n], self.delta[self.card[at], :n], lengths

    def later_delta(self, at: np.ndarray) -> np.ndarray:
        """Intervals that follow each earlier review, the row's own last: aligned with history."""
        lengths = self.column("pos")[at]
        n = int(lengths.max()) if len(lengths) else 0
        out = self.delta[self.card[at], 1 : n + 1]
        return np.where(np.arange(n) < lengths[:, None], np.pad(out, ((0, 0), (0, n - out.shape[1]))), 0.0)


def folds(n: int, k: int) -> list[tuple[int, int]]:
    """(start, end) of the tests; training is everything before start."""
    size = n // (k + 1)
    return [(n - k * size + f * size, n - k * size + (f + 1) * size) for f in range(k)]

"""Settings of an evaluation, and the result name that they give."""

from __future__ import annotations

from dataclasses import dataclass

#: Models by the name that selects them.
MODELS = (
    "AVG", "MOVING-AVG", "RMSE-BINS-EXPLOIT", "SM2", "SM2-trainable", "Ebisu-v2", "Anki", "HLR", "DASH", "DASH[MCM]", "DASH[ACT-R]",
    "ACT-R", "LogisticRegression", "FSRSv1", "FSRSv2", "FSRSv3", "FSRSv4", "FSRS-4.5", "FSRS-5", "FSRS-6", "FSRS-6-one-step", "FSRS-rs",
)
PARTITIONS = ("none", "deck", "preset")


@dataclass(frozen=True)
class Settings:
    """Every option; those in the second part only name the result."""

    algo: str = "FSRSv3"
    secs: bool = False
    short: bool = False
    two_buttons: bool = False
    default: bool = False
    only_s0: bool = False
    recency: bool = False
    partitions: str = "none"
    train_equals_test: bool = False
    equalize_test_with_non_secs: bool = False
    max_user_id: int | None = None
    max_seq_len: int = 64
    n_splits: int = 5

    no_test_same_day: bool = False
    no_train_same_day: bool = False
    sched_penalties: bool = False
    duration: bool = False
    dev: bool = False

    def __post_init__(self) -> None:
        if self.partitions not in PARTITIONS:
            raise ValueError(f"partitions must be one of {PARTITIONS}")

    @property
    def s_min(self) -> float:
        """Least stability."""
        if self.secs:
            return 0.0001
        return 0.001 if self.algo.startswith("FSRS-6") else 0.01

    @property
    def history_cap(self) -> int:
        """Reviews kept of a card."""
        return 2 * self.max_seq_len

    @property
    def result_name(self) -> str:
        marks = (
            (self.default, "default"), (self.only_s0, "S0"), (self.sched_penalties, "sched_penalties"), (self.two_buttons, "binary"), (self.short, "short"),
            (self.secs, "secs"), (self.algo == "LSTM" and self.duration, "duration"), (self.recency, "recency"), (self.no_test_same_day, "no_test_same_day"),
            (self.no_train_same_day, "no_train_same_day"), (self.equalize_test_with_non_secs, "equalize_test_with_non_secs"),
            (self.train_equals_test, "train_equals_test"), (self.partitions != "none", self.partitions), (self.dev, "dev"),
        )
        return "-".join([self.algo, *(name for on, name in marks if on)])

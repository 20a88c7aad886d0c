"""Features of a review's history as native columns: counts, look-back windows, regression terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import transform_elapsed
from .features import before, card, up_to

#: Look-back windows in days (the last has no bound), decay times of the smooth counts.
WINDOWS = (1.0, 7.0, 30.0, None)
DECAYS = (0.2434, 1.9739, 16.009, 129.8426)
DASH = tuple(f"f{k}" for k in range(8))
LOGREG = tuple(f"x{k:02d}" for k in range(34))


def _before(x: Column) -> Column:
    return F.coalesce(F.sum(x).over(before()), F.lit(0))


def hlr_features(features: DataFrame) -> DataFrame:
    """Adds passed and failed: roots of the counts of earlier reviews."""
    passed, failed = (_before(c.cast("long")) for c in (F.col("rating") > 1, F.col("rating") == 1))
    return features.withColumn("passed", F.sqrt(passed.cast("double"))).withColumn("failed", F.sqrt(failed.cast("double"))).filter("evaluable")


def dash_features(features: DataFrame, decay: bool = False) -> DataFrame:
    """Adds f0 to f7: earlier reviews, and passed ones, within each look-back window; with decay, weighted by age.

    Windows are range frames over a card's cumulative time, less the reviews of the same moment
    from the row's own on. Weights exp(-age / tau) are sums of exp((time - base) / tau) with a new
    base every window length, so that nothing overflows: a frame reaches into two such blocks,
    an even and an odd one. The window without a bound has one base, for up to 250 years of a card.
    """
    rows = features.withColumn("time", F.sum("delta_t").over(up_to()))
    by_time = Window.partitionBy("user_id", "card_id").orderBy("time")
    from_here = Window.partitionBy("user_id", "card_id", "time").orderBy("pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    time = F.col("time")

    def total(days: float | None, tau: float, counted: Column) -> Column:
        frame = by_time.rangeBetween(Window.unboundedPreceding if days is None else -int(days), Window.currentRow)
        here = F.sum(counted).over(from_here)
        if not decay:
            return F.sum(counted).over(frame) - here
        if days is None:
            found = F.sum(counted * F.exp(time / tau)).over(frame) * F.exp(-time / tau)
        else:
            block = F.floor(time / days)
            into = time - block * days
            even = block % 2 == 0
            weight = counted * F.exp(into / tau)
            evens, odds = (F.sum(F.when(own, weight).otherwise(0.0)).over(frame) for own in (even, ~even))
            own, other = F.when(even, evens).otherwise(odds), F.when(even, odds).otherwise(evens)
            found = own * F.exp(-into / tau) + other * F.exp(-(into + days) / tau)
        return F.greatest(found - here, F.lit(0.0))

    passed = (F.col("rating") > 1).cast("double")
    columns = [total(w, t, c) for w, t in zip(WINDOWS, DECAYS, strict=True) for c in (F.lit(1.0), passed)]
    return rows.select("*", *[c.alias(n) for c, n in zip(columns, DASH, strict=True)]).drop("time").filter("evaluable")


#: Columns that logreg_counters adds, but for the interval, which is the review's own.
COUNTERS = ("r", "opening", "fr", "ls", "sf", "nf", "sp", "np", "pn", "sn", "nn", "pe", "clock", "t", "delta_t")


def logreg_counters(features: DataFrame) -> DataFrame:
    """Adds COUNTERS, of which the regression's features are made, to the evaluated reviews."""
    rows = features.withColumn("r", F.coalesce(F.lag("rating").over(card()), F.lit(0))).filter("evaluable")
    rows = rows.withColumn("days", F.greatest("elapsed_days", F.lit(0)))
    rows = rows.select(
        "*", F.coalesce(F.lag("delta_t").over(card()), F.lit(0.0)).alias("pe"), F.coalesce(F.lag("days").over(card()), F.lit(0)).alias("pd"),
        (F.row_number().over(card()) == 1).cast("double").alias("fr"), F.first("r").over(up_to()).alias("opening"),
    )

    def flag(c: Column) -> Column:
        return c.cast("double")

    rows = rows.select("*", flag(F.col("pd") == 0).alias("sd"), flag(F.col("days") == 0).alias("ls"), flag(F.col("r") == 1).alias("fail"), flag(F.col("r") > 1).alias("good"), F.sum("pe").over(up_to()).alias("t"))
    later = 1 - F.col("fr")
    counters = {
        "sf": F.col("sd") * later * F.col("fail"), "nf": (1 - F.col("sd")) * later * F.col("fail"), "sp": F.col("sd") * later * F.col("good"),
        "np": (1 - F.col("sd")) * later * F.col("good"), "pn": F.col("good"), "sn": F.col("sd"), "nn": 1 - F.col("sd"),
    }
    clock = F.col("t") - F.max(F.when((F.col("fr") == 1) | (F.col("r") <= 1), F.col("t")).otherwise(0.0)).over(up_to())
    return rows.select("*", *[F.sum(c).over(up_to()).alias(n) for n, c in counters.items()], clock.alias("clock"))


def logreg_features(features: DataFrame) -> DataFrame:
    """Adds x00 to x33 to the evaluated reviews: ten terms times the interval's transform, 24 plain ones."""
    rows = logreg_counters(features)

    def flag(c: Column) -> Column:
        return c.cast("double")

    c, l1, one = F.col, F.log1p, F.lit(1.0)
    was = {k: flag(c("r") == k) for k in (2, 3, 4)}
    led = {k: flag(c("opening") == k) for k in (2, 3, 4)}
    g, fr, not_same = flag(c("opening") > 1), c("fr"), 1 - c("ls")
    scaled = [one, was[2], was[3], was[4], was[2] * fr, flag(c("r") > 2) * fr, l1("sf"), l1(c("np") * not_same), l1(c("nf") * not_same), l1("sp")]
    plain = [
        one, was[2], was[3], was[4], led[2], led[3], led[4], led[2] * fr, led[3] * fr, led[4] * fr, l1("sf"), l1(c("np") * not_same), transform_elapsed(c("pe")),
        l1("nf"), l1("np"), l1(c("sp") * c("ls")), flag(c("pn") > 0), transform_elapsed(c("clock")), c("ls"), transform_elapsed(c("t")), g * l1("sf"),
        g * l1("nf"), g * l1("sn"), g * l1("nn"),
    ]
    x = [s * transform_elapsed(c("delta_t")) for s in scaled] + plain
    return rows.select(*features.columns, *[v.alias(n) for v, n in zip(x, LOGREG, strict=True)])


def s0_statistics(features: DataFrame) -> DataFrame:
    """(user_id, first_rating, delta_t, hits, n) of cards' second reviews."""
    return features.filter("evaluable AND i = 2").groupBy("user_id", "first_rating", "delta_t").agg(F.sum("y").alias("hits"), F.count("*").alias("n"))

"""The registered queries on the review log that the events table gives, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.metrics import auc, bins, metrics, precision_recall
from ..functions.scalar import round6
from ..models import counts, evaluate, recurrent, regression
from ..operators import history, splits
from ..operators.features import evaluable, features, histories, outlier_cells, valid_reviews
from ..sources import revlog
from . import evaluation, oracle

Query = Callable[[SparkSession, str], DataFrame]
FEATURES = ("user_id", "card_id", "review_th", "rating", "y", "delta_t", "elapsed_days", "elapsed_seconds", "pos", "i", "rmse_bins_lapse", "last_rating", "first_rating")
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SECS = {"short": True, "secs": True}


def reviews(spark: SparkSession, sf_dir: str, days_view: bool = False) -> DataFrame:
    return revlog.from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), days_view)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def secs_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(reviews(spark, sf_dir), Settings(**SECS))


def day_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(reviews(spark, sf_dir, True), Settings(short=True))


def told(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", "card_id", "review_th", F.col("fold").cast("long").alias("fold"), round6(F.col("p")).alias("p"))


TOLD = "SELECT user_id, card_id, review_th, CAST(fold AS BIGINT) AS fold, round(p, 6) AS p FROM pred"


@query("revlog_adapter", f"WITH {oracle.reviews()} SELECT * FROM reviews")
def revlog_adapter(spark, sf_dir):
    return reviews(spark, sf_dir)


@query("valid_reviews", f"WITH {oracle.reviews()} SELECT * FROM reviews WHERE rating IN (1, 2, 3, 4)")
def valid(spark, sf_dir):
    return valid_reviews(reviews(spark, sf_dir))


@query("two_button_ratings", f"WITH {oracle.reviews()} SELECT user_id, card_id, review_th, CAST(CASE rating WHEN 1 THEN 1 ELSE 3 END AS BIGINT) AS rating FROM reviews WHERE rating > 0")
def two_buttons(spark, sf_dir):
    return valid_reviews(reviews(spark, sf_dir), True).select("user_id", "card_id", "review_th", "rating")


@query("history_cap", f"WITH {oracle.reviews()}, {oracle.histories(True, cap=4)} SELECT {oracle.FEATURES} FROM h")
def history_cap(spark, sf_dir):
    return histories(reviews(spark, sf_dir), Settings(**SECS, max_seq_len=2)).select(*FEATURES)


@query("features_secs", f"{oracle.base(True)} SELECT {oracle.FEATURES} FROM rows_")
def features_secs(spark, sf_dir):
    return evaluable(secs_features(spark, sf_dir)).select(*FEATURES)


@query("features_days", f"WITH {oracle.reviews(True)}, {oracle.histories(False)} SELECT {oracle.FEATURES} FROM h WHERE delta_t > 0")
def features_days(spark, sf_dir):
    return histories(reviews(spark, sf_dir, True), Settings(short=True)).filter("delta_t > 0").select(*FEATURES)


@query("features_without_same_day", f"WITH {oracle.reviews(True)}, {oracle.histories(False, short=False)} SELECT {oracle.FEATURES} FROM h WHERE delta_t > 0")
def features_without_same_day(spark, sf_dir):
    return histories(reviews(spark, sf_dir, True), Settings()).filter("delta_t > 0").select(*FEATURES)


@query("outlier_cells", f"{oracle.base(False, True)} SELECT * FROM cells")
def cells(spark, sf_dir):
    return outlier_cells(histories(reviews(spark, sf_dir, True), Settings(short=True)))


@query("outlier_survivors", f"{oracle.base(False, True)} SELECT {oracle.FEATURES} FROM rows_")
def survivors(spark, sf_dir):
    return evaluable(day_features(spark, sf_dir)).select(*FEATURES)


@query("learners_with_enough", f"{oracle.base(True)} SELECT user_id, count(*) AS n FROM rows_ GROUP BY user_id HAVING count(*) >= 6")
def learners_with_enough(spark, sf_dir):
    return evaluable(secs_features(spark, sf_dir)).groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 6")


@query(
    "skipped_learners",
    f"""{oracle.base(False)} SELECT DISTINCT user_id, '{evaluation.FEW}' AS reason FROM reviews
    WHERE user_id NOT IN (SELECT user_id FROM rows_ GROUP BY user_id HAVING count(*) >= 6)""",
)
def skipped_learners(spark, sf_dir):
    """In days most of these short logs lose what they have to the outlier filter."""
    rows = reviews(spark, sf_dir)
    kept = evaluable(features(rows, Settings(short=True))).groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 6")
    return evaluation.without_record(rows.select("user_id").distinct(), kept.select("user_id"))


@query("timeseries_folds", f"{oracle.base(True)} SELECT user_id, review_th, rn, n, test_size, fold FROM folds")
def timeseries_folds(spark, sf_dir):
    return splits.folds(evaluable(secs_features(spark, sf_dir))).select("user_id", "review_th", "rn", "n", "test_size", "fold")


@query("timeseries_folds_in_blocks", f"{oracle.base(True)} SELECT user_id, review_th, rn, n, test_size, fold FROM folds")
def timeseries_folds_in_blocks(spark, sf_dir):
    """The same folds, every learner's log numbered by stretches of 1,000 review numbers."""
    return splits.folds(evaluable(secs_features(spark, sf_dir)), block=1000).select("user_id", "review_th", "rn", "n", "test_size", "fold")


@query(
    "equalized_folds",
    f"""WITH {oracle.reviews(True)}, {oracle.histories(False)}, {oracle.OUTLIERS}, {oracle.FOLDS}, {oracle.histories(True, name='s')},
    secs AS (SELECT user_id, review_th FROM s WHERE delta_t > 0), e1 AS (SELECT user_id, fold, min(review_th) AS first_th FROM folds WHERE fold IS NOT NULL GROUP BY ALL)
    SELECT user_id, f.fold, review_th, (SELECT count(*) FROM secs z WHERE z.user_id = f.user_id AND z.review_th < e1.first_th) AS train_end
    FROM folds f JOIN secs USING (user_id, review_th) JOIN e1 USING (user_id, fold) WHERE f.fold IS NOT NULL""",
)
def equalized_folds(spark, sf_dir):
    rows = reviews(spark, sf_dir, True)
    return splits.equalised(evaluable(features(rows, Settings(**SECS))), evaluable(features(rows, Settings(short=True)))).select("user_id", "fold", "review_th", "train_end")


DECKS = "cards AS (SELECT DISTINCT user_id, card_id, card_id % 3 AS deck_id FROM reviews), decks AS (SELECT DISTINCT user_id, deck_id, deck_id % 2 AS preset_id FROM cards WHERE deck_id <> 2)"


@query("partition_map_deck", f"WITH {oracle.reviews()}, {DECKS} SELECT user_id, card_id, deck_id AS partition FROM cards")
def partition_map_deck(spark, sf_dir):
    return revlog.partition_map(revlog.event_decks(reviews(spark, sf_dir))[0], None)


@query("partition_map_preset", f"WITH {oracle.reviews()}, {DECKS} SELECT c.user_id, card_id, coalesce(preset_id, c.deck_id) AS partition FROM cards c LEFT JOIN decks d ON c.user_id = d.user_id AND c.deck_id = d.deck_id")
def partition_map_preset(spark, sf_dir):
    return revlog.partition_map(*revlog.event_decks(reviews(spark, sf_dir)))


@query(
    "recency_weights",
    f"""{oracle.base(True)}, w AS (SELECT user_id, review_th, CASE WHEN n > 1 THEN CAST(rn AS DOUBLE) / greatest(n - 1, 1) ELSE 0e0 END AS x FROM f1)
    SELECT user_id, review_th, round(0.25e0 + 0.75e0 * x * x * x, 6) AS cubic, round(0.1e0 + 0.9e0 * pow(x, 4e0), 6) AS quartic FROM w""",
)
def recency_weights(spark, sf_dir):
    return splits.recency_weights(evaluable(secs_features(spark, sf_dir))).select("user_id", "review_th", round6(F.col("cubic")).alias("cubic"), round6(F.col("quartic")).alias("quartic"))


@query("s0_statistics", f"{oracle.base(True)} SELECT user_id, first_rating, delta_t, sum(y)::BIGINT AS hits, count(*) AS n FROM rows_ WHERE i = 2 GROUP BY ALL")
def s0_statistics(spark, sf_dir):
    return history.s0_statistics(secs_features(spark, sf_dir))


# --- models that are plans -----------------------------------------------------------------------

SM2_STATE = {
    "reps": ("CASE WHEN c.rating > 1 THEN 1 ELSE 0 END", "CASE WHEN c.rating > 1 THEN o.reps + 1 ELSE 0 END"),
    "ivl": ("1e0", "greatest(least(round_even(CASE WHEN c.rating = 1 OR o.reps = 0 THEN 1e0 WHEN o.reps = 1 THEN 6e0 ELSE o.ivl * o.ef END + 0.01e0, 0), 36500e0), 1e0)"),
    "ef": ("greatest(2.5e0 + (0.1e0 - (4 - c.rating) * (0.08e0 + (4 - c.rating) * 0.02e0)), 1.3e0)", "greatest(o.ef + (0.1e0 - (4 - c.rating) * (0.08e0 + (4 - c.rating) * 0.02e0)), 1.3e0)"),
}
DECAY = "CASE WHEN s.ivl IS NULL THEN 0e0 ELSE exp(ln(0.9e0) * f.delta_t / s.ivl) END"
MOVING = """mv AS (SELECT user_id, rn, 1.2e0 AS x, y FROM f1 WHERE rn = 0 AND n >= 6
      UNION ALL SELECT c.user_id, c.rn, o.x + 0.3e0 * (o.y - 1e0 / (1e0 + exp(-o.x))), c.y FROM mv o JOIN f1 c ON c.user_id = o.user_id AND c.rn = o.rn + 1),
    pred AS (SELECT f.*, 1e0 / (1e0 + exp(-mv.x)) AS p FROM folds f JOIN mv USING (user_id, rn) WHERE fold IS NOT NULL)"""


def _low(x: str, scale: float, b: float) -> str:
    return f"{scale}e0 * pow({b}e0, floor(ln({x}) / {math.log(b)!r}))"


EXPLOIT = f"""x1 AS (SELECT *, avg(y) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean,
      CASE WHEN rmse_bins_lapse = 0 THEN 0e0 ELSE round_even({_low('greatest(rmse_bins_lapse, 1)', 1.65, 1.73)}, 0) END AS b1, round_even({_low('delta_t', 2.48, 3.62)}, 2) AS b2, round_even({_low('i', 1.99, 1.89)}, 0) AS b3
      FROM folds WHERE fold IS NOT NULL),
    x2 AS (SELECT *, row_number() OVER (PARTITION BY user_id, b1, b2, b3 ORDER BY rn) AS k FROM x1),
    x3 AS (SELECT user_id, b1, b2, b3, k, CASE WHEN mean IS NULL THEN 0.5e0 ELSE greatest(least(mean, 1e0), 0e0) END AS p,
        CASE WHEN mean IS NULL THEN 0e0 ELSE greatest(least(mean, 1e0), 0e0) END AS told, CAST(y AS DOUBLE) AS truth FROM x2 WHERE k = 1
      UNION ALL SELECT c.user_id, c.b1, c.b2, c.b3, c.k, greatest(least(o.truth + c.mean - o.told, 1e0), 0e0), o.told + greatest(least(o.truth + c.mean - o.told, 1e0), 0e0), o.truth + c.y
      FROM x3 o JOIN x2 c ON c.user_id = o.user_id AND c.b1 = o.b1 AND c.b2 = o.b2 AND c.b3 = o.b3 AND c.k = o.k + 1),
    pred AS (SELECT x2.*, x3.p FROM x2 JOIN x3 USING (user_id, b1, b2, b3, k))"""
CLOSED = {"avg": ("AVG", oracle.avg_predictions()), "moving_avg": ("MOVING-AVG", MOVING), "sm2": ("SM2", oracle.scan(SM2_STATE, DECAY)), "bins_exploit": ("RMSE-BINS-EXPLOIT", EXPLOIT)}


def _model(name: str, s: Settings, days_view: bool = False) -> Query:
    return lambda spark, sf_dir: told(evaluation.predictions(reviews(spark, sf_dir, days_view), s))


def _metrics(s: Settings, days_view: bool = False) -> Query:
    return lambda spark, sf_dir: metrics(evaluation.predictions(reviews(spark, sf_dir, days_view), s))


for _name, (_algo, _sql) in CLOSED.items():
    _s = Settings(algo=_algo, **SECS)
    query(f"{_name}_predictions", f"{oracle.base(True, recursive=True)}, {_sql} {TOLD}")(_model(_name, _s))
    query(f"{_name}_metrics", f"{oracle.base(True, recursive=True)}, {_sql}, {oracle.metrics('pred')}")(_metrics(_s))
    query(f"{_name}_days_metrics", f"{oracle.base(False, True, recursive=True)}, {_sql}, {oracle.metrics('pred')}")(_metrics(Settings(algo=_algo, short=True), True))


def _avg(spark, sf_dir):
    return evaluation.predictions(reviews(spark, sf_dir), Settings(algo="AVG", **SECS))


AVG = f"{oracle.base(True)}, {oracle.avg_predictions()}"
METRICS = oracle.metrics("pred")


@query("rmse_bins_detail", f"{AVG}, {METRICS.rpartition('SELECT user_id, size')[0]} SELECT user_id, bin_delta_t, bin_i, bin_lapse, n, round(mean_y, 6) AS mean_y, round(mean_p, 6) AS mean_p FROM m2")
def rmse_bins_detail(spark, sf_dir):
    return bins(_avg(spark, sf_dir)).select("user_id", "bin_delta_t", "bin_i", "bin_lapse", "n", round6(F.col("mean_y")).alias("mean_y"), round6(F.col("mean_p")).alias("mean_p"))


@query("auc_by_learner", f"{AVG}, {METRICS.rpartition('SELECT user_id, size')[0]} SELECT user_id, round(auc, 6) AS auc FROM m5")
def auc_by_learner(spark, sf_dir):
    return auc(_avg(spark, sf_dir)).select("user_id", round6(F.col("auc")).alias("auc"))


@query("precision_recall_90", f"{AVG}, {METRICS.rpartition('SELECT user_id, size')[0]} SELECT user_id, round(precision_90, 6) AS precision_90, round(recall_90, 6) AS recall_90 FROM m1")
def precision_recall_90(spark, sf_dir):
    p, r = precision_recall(F.col("y"), F.col("p"))
    return _avg(spark, sf_dir).groupBy("user_id").agg(round6(p).alias("precision_90"), round6(r).alias("recall_90"))


# --- features of histories -----------------------------------------------------------------------

HLR = """hf AS (SELECT *, sqrt(CAST(count(*) FILTER (rating > 1) OVER b AS DOUBLE)) AS passed, sqrt(CAST(count(*) FILTER (rating = 1) OVER b AS DOUBLE)) AS failed FROM h
      WINDOW b AS (PARTITION BY user_id, card_id ORDER BY review_th ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _dash_sql(decay: bool) -> str:
    each = []
    for k, (w, tau) in enumerate(zip(history.WINDOWS, history.DECAYS, strict=True)):
        weight = f"exp(-(a.t - e.t) / {tau}e0)" if decay else "1e0"
        within = "true" if w is None else f"a.t - e.t <= {w}e0"
        each += [f"coalesce(sum({weight}) FILTER (e.pos IS NOT NULL AND {within} {extra}), 0e0) AS f{2 * k + j}" for j, extra in enumerate(("", "AND e.rating > 1"))]
    return f"""tt AS (SELECT *, sum(delta_t) OVER (PARTITION BY user_id, card_id ORDER BY review_th) AS t FROM h),
    df AS (SELECT a.user_id, a.card_id, a.review_th, {', '.join(each)} FROM tt a LEFT JOIN tt e ON a.user_id = e.user_id AND a.card_id = e.card_id AND e.pos < a.pos WHERE a.delta_t > 0 GROUP BY ALL)"""


def _rounded(rows: DataFrame, names, digits: int = 6) -> DataFrame:
    return rows.select("user_id", "card_id", "review_th", *[F.round(n, digits).alias(n) for n in names])


@query("hlr_features", f"{oracle.base(True)}, {HLR} SELECT user_id, card_id, review_th, round(passed, 6) AS passed, round(failed, 6) AS failed FROM hf WHERE delta_t > 0")
def hlr_features(spark, sf_dir):
    return _rounded(history.hlr_features(secs_features(spark, sf_dir)), ("passed", "failed"))


for _name, _decay in (("dash_features", False), ("dash_mcm_features", True)):
    query(_name, f"{oracle.base(True)}, {_dash_sql(_decay)} SELECT user_id, card_id, review_th, {', '.join(f'round({n}, 6) AS {n}' for n in history.DASH)} FROM df")(
        lambda spark, sf_dir, decay=_decay: _rounded(history.dash_features(secs_features(spark, sf_dir), decay), history.DASH)
    )


def _tr(x: str) -> str:
    return f"((ln({x} + 1e-5) + 1.3e0) / 5e0)"


def _logreg_sql() -> str:
    o = {k: f"CAST(r = {k} AS DOUBLE)" for k in (2, 3, 4)}
    f = {k: f"CAST(opening = {k} AS DOUBLE)" for k in (2, 3, 4)}
    n, nf = "ln(1e0 + np * (1 - ls))", "ln(1e0 + nf * (1 - ls))"
    g = "CAST(opening > 1 AS DOUBLE)"
    scaled = ["1e0", o[2], o[3], o[4], f"{o[2]} * fr", "CAST(r > 2 AS DOUBLE) * fr", "ln(1e0 + sf)", n, nf, "ln(1e0 + sp)"]
    plain = [
        "1e0", o[2], o[3], o[4], f[2], f[3], f[4], f"{f[2]} * fr", f"{f[3]} * fr", f"{f[4]} * fr", "ln(1e0 + sf)", n, _tr("pe"), "ln(1e0 + nf)", "ln(1e0 + np)",
        "ln(1e0 + sp * ls)", "CAST(pn > 0 AS DOUBLE)", _tr("clock"), "ls", _tr("t"), f"{g} * ln(1e0 + sf)", f"{g} * ln(1e0 + nf)", f"{g} * ln(1e0 + sn)", f"{g} * ln(1e0 + nn)",
    ]
    x = [f"({s}) * {_tr('delta_t')}" for s in scaled] + plain
    later = "(1 - fr)"
    return f"""l1 AS (SELECT *, coalesce(lag(rating) OVER c, 0) AS r FROM h WINDOW c AS (PARTITION BY user_id, card_id ORDER BY review_th)),
    l2 AS (SELECT *, greatest(elapsed_days, 0) AS days, coalesce(lag(delta_t) OVER c, 0e0) AS pe, coalesce(lag(greatest(elapsed_days, 0)) OVER c, 0) AS pd,
      CAST(row_number() OVER c = 1 AS DOUBLE) AS fr, first_value(r) OVER c AS opening FROM l1 WHERE delta_t > 0 WINDOW c AS (PARTITION BY user_id, card_id ORDER BY review_th)),
    l3 AS (SELECT *, CAST(pd = 0 AS DOUBLE) AS sd, CAST(days = 0 AS DOUBLE) AS ls, CAST(r = 1 AS DOUBLE) AS fail, CAST(r > 1 AS DOUBLE) AS good, sum(pe) OVER (PARTITION BY user_id, card_id ORDER BY review_th) AS t FROM l2),
    l4 AS (SELECT *, sum(sd * {later} * fail) OVER c AS sf, sum((1 - sd) * {later} * fail) OVER c AS nf, sum(sd * {later} * good) OVER c AS sp, sum((1 - sd) * {later} * good) OVER c AS np,
      sum(good) OVER c AS pn, sum(sd) OVER c AS sn, sum(1 - sd) OVER c AS nn, t - max(CASE WHEN fr = 1 OR r <= 1 THEN t ELSE 0e0 END) OVER c AS clock FROM l3 WINDOW c AS (PARTITION BY user_id, card_id ORDER BY review_th)),
    lf AS (SELECT user_id, card_id, review_th, {', '.join(f'{v} AS {k}' for k, v in zip(history.LOGREG, x, strict=True))} FROM l4)"""


@query("logreg_features", f"{oracle.base(True)}, {_logreg_sql()} SELECT user_id, card_id, review_th, {', '.join(f'round({n}, 6) AS {n}' for n in history.LOGREG)} FROM lf")
def logreg_features(spark, sf_dir):
    return _rounded(history.logreg_features(secs_features(spark, sf_dir)), history.LOGREG)


# --- models at their default weights -------------------------------------------------------------

_HLR = counts.MODELS["HLR"].start
_DASH = counts.DASH_SHORT


def _sql(numbers) -> list[str]:
    return [f"({float(x)!r})" if "e" in repr(float(x)) else f"({float(x)!r}e0)" for x in numbers]


def _of(sql: str, p: str, table: str) -> str:
    return f"{oracle.base(True)}, {sql}, pred AS (SELECT f.*, {p} AS p FROM folds f JOIN {table} t USING (user_id, card_id, review_th) WHERE fold IS NOT NULL) {TOLD}"


def _default(algo: str) -> Settings:
    return Settings(algo=algo, default=True, **SECS)


_w = _sql(_HLR)
query("hlr_default", _of(HLR, f"exp(ln(0.5e0) * f.delta_t / pow(2e0, {_w[0]} * t.passed + {_w[1]} * t.failed + {_w[2]}))", "hf"))(_model("hlr", _default("HLR")))
for _name, _algo, _decay in (("dash_default", "DASH", False), ("dash_mcm_default", "DASH[MCM]", True)):
    _w = _sql(_DASH)
    _z = " + ".join(f"{_w[k]} * ln(1e0 + t.f{k})" for k in range(8))
    query(_name, _of(_dash_sql(_decay), f"1e0 / (1e0 + exp(-({_w[8]} + {_z})))", "df"))(_model(_name, _default(_algo)))
_w = _sql(regression.MEAN)
query("logreg_default", _of(_logreg_sql(), f"1e0 / (1e0 + exp(-({' + '.join(f'{a} * t.{n}' for a, n in zip(_w, history.LOGREG, strict=True))})))", "lf"))(
    _model("logreg", _default("LogisticRegression"))
)


def _fsrs_sql(name: str) -> str:
    """The recurrence of a model in SQL at its default weights."""
    m = recurrent.MODELS[name]
    w = _sql(m.weights(True))
    r, dt = "c.rating", "c.delta_t"

    def hold(x: str) -> str:
        return f"least(greatest({x}, 0.0001e0), 36500e0)"

    def ten(x: str) -> str:
        return f"least(greatest({x}, 1e0), 10e0)"

    exponential = lambda t, s: f"exp(ln(0.9e0) * {t} / {s})"
    hyper = lambda t, s: f"(1e0 / (1e0 + {t} / (9e0 * {s})))"
    half = lambda t, s: f"pow(1e0 + (pow(0.9e0, -2e0) - 1e0) * {t} / {s}, -0.5e0)"
    s0 = f"CASE {r} WHEN 1 THEN {w[0]} WHEN 2 THEN {w[1]} WHEN 3 THEN {w[2]} ELSE {w[3]} END"

    def v4(curve, held: str, same_day: str | None = None, d0: str = "", d1: str = "") -> tuple[dict, str]:
        p = curve(dt, "o.s")
        good = f"o.s * (1e0 + exp({w[8]}) * (11e0 - o.d) * pow(o.s, -{w[9]}) * (exp((1e0 - {p}) * {w[10]}) - 1e0) * CASE WHEN {r} = 2 THEN {w[15]} WHEN {r} = 4 THEN {w[16]} ELSE 1e0 END)"
        bad = f"{w[11]} * pow(o.d, -{w[12]}) * (pow(o.s + 1e0, {w[13]}) - 1e0) * exp((1e0 - {p}) * {w[14]})"
        after = f"CASE WHEN {r} > 1 THEN {good} ELSE {held.format(bad)} END"
        if same_day:
            after = f"CASE WHEN {dt} < 1 THEN {same_day} ELSE {after} END"
        return {"s": (hold(s0), hold(after)), "d": (ten(d0 or f"{w[4]} - {w[5]} * ({r} - 3)"), ten(d1 or f"{w[7]} * {w[4]} + (1e0 - {w[7]}) * (o.d - {w[6]} * ({r} - 3))"))}, curve("f.delta_t", "s.s")

    if name == "FSRSv1":
        p = exponential(dt, "o.s")
        d = f"greatest(o.d + {p} - pow(2e0, {r} - 1) / 4e0 + 0.1e0, 0e0)"
        good = f"o.s * (1e0 + exp({w[2]}) * pow({d} + 0.1e0, {w[3]}) * pow(o.s, {w[4]}) * (exp((1e0 - {p}) * {w[5]}) - 1e0))"
        state = {
            "s": (hold(f"{w[0]} * pow(2e0, {r} - 1) / 4e0"), hold(f"CASE WHEN {r} > 1 THEN {good} ELSE {w[0]} * exp({w[6]} * o.l) END")), "d": (f"{w[1]} - {r} + 3", d),
            "l": (f"greatest(0, 2 - {r})", f"o.l + greatest(0, 2 - {r})"),
        }
        end = exponential("f.delta_t", "s.s")
    elif name == "FSRSv2":
        p = exponential(dt, "o.s")
        d = ten(f"{w[5]} * ({w[2]} * (1e0 - {w[3]})) + (1e0 - {w[5]}) * (o.d + {w[4]} * ({r} - 3))")
        good = f"o.s * (1e0 + exp({w[6]}) * pow({d}, {w[7]}) * pow(o.s, {w[8]}) * (exp((1e0 - {p}) * {w[9]}) - 1e0))"
        bad = f"{w[10]} * pow({d}, {w[11]}) * pow(o.s, {w[12]}) * (exp((1e0 - {p}) * {w[13]}) - 1e0)"
        state = {"s": (hold(f"{w[0]} * ({w[1]} * ({r} - 1) + 1e0)"), hold(f"CASE WHEN {r} > 1 THEN {good} ELSE {bad} END")), "d": (ten(f"{w[2]} * ({w[3]} * ({r} - 4) + 1e0)"), d)}
        end = exponential("f.delta_t", "s.s")
    elif name == "FSRSv3":
        p = exponential(dt, "o.s")
        d = ten(f"{w[5]} * {w[2]} + (1e0 - {w[5]}) * (o.d + {w[4]} * ({r} - 3))")
        good = f"o.s * (1e0 + exp({w[6]}) * (11e0 - {d}) * pow(o.s, {w[7]}) * (exp((1e0 - {p}) * {w[8]}) - 1e0))"
        bad = f"{w[9]} * pow({d}, {w[10]}) * pow(o.s, {w[11]}) * exp((1e0 - {p}) * {w[12]})"
        state = {"s": (hold(f"{w[0]} + {w[1]} * ({r} - 1)"), hold(f"CASE WHEN {r} > 1 THEN {good} ELSE {bad} END")), "d": (ten(f"{w[2]} + {w[3]} * ({r} - 3)"), d)}
        end = exponential("f.delta_t", "s.s")
    elif name == "FSRSv4":
        state, end = v4(hyper, "{}")
    elif name == "FSRS-4.5":
        state, end = v4(half, "least({}, o.s)")
    else:
        aim = f"({w[4]} - exp({w[5]} * 3e0) + 1e0)"
        d = (f"{w[4]} - exp({w[5]} * ({r} - 1)) + 1e0", f"{w[7]} * {aim} + (1e0 - {w[7]}) * (o.d - {w[6]} * ({r} - 3) * (10e0 - o.d) / 9e0)")
        held = f"least({{}}, o.s / exp({w[17]} * {w[18]}))"
        if name == "FSRS-5":
            state, end = v4(half, held, f"o.s * exp({w[17]} * ({r} - 3 + {w[18]}))", *d)
        else:
            trained = lambda t, s: f"pow(1e0 + (pow(0.9e0, -1e0 / {w[20]}) - 1e0) * {t} / {s}, -{w[20]})"
            q = f"exp({w[17]} * ({r} - 3 + {w[18]})) * pow(o.s, -{w[19]})"
            state, end = v4(trained, held, f"o.s * CASE WHEN {r} >= 2 THEN greatest({q}, 1e0) ELSE {q} END", *d)
    return f"{oracle.base(True, recursive=True)}, {oracle.scan(state, f'CASE WHEN s.s IS NULL THEN 0e0 ELSE {end} END')} {TOLD}"


def _sm2_trainable_sql() -> str:
    w = _sql(recurrent.MODELS["SM2-trainable"].start)
    gap = f"(c.rating + 1 - {w[4]})"
    ease = f"least(greatest({{}} - {w[3]} * {gap} * {gap} + {w[5]}, 1.3e0), 10e0)"
    state = {
        "reps": ("1", "CASE WHEN c.rating > 1 THEN o.reps + 1 ELSE 1 END"),
        "s": (w[0], f"least(greatest(CASE WHEN c.rating = 1 THEN {w[0]} WHEN o.reps = 1 THEN {w[1]} ELSE o.s * o.ef END, 0.0001e0), 36500e0)"),
        "ef": (ease.format(w[2]), ease.format("o.ef")),
    }
    return f"{oracle.base(True, recursive=True)}, {oracle.scan(state, 'CASE WHEN s.s IS NULL THEN 0e0 ELSE exp(ln(0.9e0) * f.delta_t / s.s) END')} {TOLD}"


def _anki_sql() -> str:
    w = _sql(recurrent.MODELS["Anki"].start)
    grown = "least(greatest(greatest(CASE WHEN ({0}) - 1 > 0 THEN ({0}) ELSE (({0}) - 1) * 0.01e0 + 1 END, ({0})), 0.0001e0), 36500e0)"
    early = f"CASE c.rating WHEN 2 THEN greatest(c.delta_t * {w[4]}, o.s * {w[4]} / 2) WHEN 3 THEN greatest(c.delta_t * o.ease, o.s) ELSE greatest(c.delta_t * o.ease, o.s) * ({w[3]} + 1) / 2 END"
    due = f"CASE c.rating WHEN 2 THEN o.s * {w[4]} WHEN 3 THEN (o.s + (c.delta_t - o.s) / 2) * o.ease ELSE c.delta_t * o.ease * {w[3]} END"
    after = f"CASE WHEN c.rating = 1 THEN o.s * {w[5]} ELSE (CASE WHEN c.delta_t < o.s THEN {early} ELSE {due} END) * {w[6]} END"
    state = {
        "s": (grown.format(f"CASE WHEN c.rating < 4 THEN {w[0]} ELSE {w[1]} END"), grown.format(after)),
        "ease": (w[2], "least(greatest(o.ease + CASE c.rating WHEN 1 THEN -0.2e0 WHEN 2 THEN -0.15e0 WHEN 4 THEN 0.15e0 ELSE 0e0 END, 1.3e0), 5.5e0)"),
    }
    return f"{oracle.base(True, recursive=True)}, {oracle.scan(state, 'CASE WHEN s.s IS NULL THEN 0e0 ELSE exp(ln(0.9e0) * f.delta_t / s.s) END')} {TOLD}"


FSRS = {"fsrs1": "FSRSv1", "fsrs2": "FSRSv2", "fsrs3": "FSRSv3", "fsrs4": "FSRSv4", "fsrs45": "FSRS-4.5", "fsrs5": "FSRS-5", "fsrs6": "FSRS-6"}
for _name, _algo in FSRS.items():
    query(f"{_name}_default", _fsrs_sql(_algo))(_model(_name, _default(_algo)))
query("sm2_trainable_default", _sm2_trainable_sql())(_model("sm2_trainable", _default("SM2-trainable")))
query("anki_default", _anki_sql())(_model("anki", _default("Anki")))
query("ebisu_metrics")(_metrics(Settings(algo="Ebisu-v2", **SECS)))


def _dash_actr_sql() -> str:
    """Strengths of earlier reviews, at least a tenth of a day ago, that fade as a power of their age."""
    w = _sql(counts.MODELS["DASH[ACT-R]"].start)
    return f"""tt AS (SELECT *, sum(delta_t) OVER (PARTITION BY user_id, card_id ORDER BY review_th) AS t FROM h),
    da AS (SELECT a.user_id, a.card_id, a.review_th, coalesce(sum(pow(a.t - e.t, -{w[1]}) * CASE WHEN e.rating > 1 THEN {w[3]} ELSE {w[2]} END) FILTER (a.t - e.t > 0.1e0), 0e0) AS total
      FROM tt a LEFT JOIN tt e ON a.user_id = e.user_id AND a.card_id = e.card_id AND e.pos < a.pos WHERE a.delta_t > 0 GROUP BY ALL)"""


def _actr_sql() -> str:
    """Activation before a review from all earlier ones; each has an exponent of its own, kept in a list."""
    w = _sql(counts.MODELS["ACT-R"].start)
    total = f"list_sum(list_transform(range(1, len(o.ts) + 1), lambda j: pow(greatest({w[4]} * ((c.t - o.ts[j]) * 86400e0), 1e0), o.es[j])))"
    return f"""{oracle.base(True, recursive=True)}, tt AS (SELECT *, sum(delta_t) OVER (PARTITION BY user_id, card_id ORDER BY review_th) AS t FROM h),
    st AS (SELECT user_id, card_id, pos, [t] AS ts, [-{w[0]}] AS es, CAST(NULL AS DOUBLE) AS total FROM tt WHERE pos = 0
      UNION ALL SELECT user_id, card_id, pos, list_append(ts, t), list_append(es, -({w[1]} * total + {w[0]})), total
      FROM (SELECT c.user_id, c.card_id, c.pos, c.t, o.ts, o.es, {total} AS total FROM st o JOIN tt c ON c.user_id = o.user_id AND c.card_id = o.card_id AND c.pos = o.pos + 1)),
    pred AS (SELECT f.*, 1e0 / (1e0 + exp(({w[3]} - coalesce(ln(s.total), 0e0)) / {w[2]})) AS p FROM folds f JOIN st s USING (user_id, card_id, pos) WHERE fold IS NOT NULL) {TOLD}"""


_w = _sql(counts.MODELS["DASH[ACT-R]"].start)
query("dash_actr_default", _of(_dash_actr_sql(), f"1e0 / (1e0 + exp(-({_w[0]} * ln(1e0 + greatest(t.total, 0e0)) + {_w[4]})))", "da"))(_model("dash_actr", _default("DASH[ACT-R]")))
query("actr_default", _actr_sql())(_model("actr", _default("ACT-R")))

# --- trained models: no SQL ----------------------------------------------------------------------

TRAINED = FSRS | {"hlr": "HLR", "dash": "DASH", "dash_mcm": "DASH[MCM]", "dash_actr": "DASH[ACT-R]", "actr": "ACT-R", "sm2_trainable": "SM2-trainable", "anki": "Anki", "logreg": "LogisticRegression", "one_step": "FSRS-6-one-step"}
for _name, _algo in TRAINED.items():
    query(f"{_name}_trained")(_metrics(Settings(algo=_algo, recency=True, **SECS)))
query("fsrs6_s0_only")(_metrics(Settings(algo="FSRS-6", only_s0=True, **SECS)))
query("fsrs6_train_equals_test")(_metrics(Settings(algo="FSRS-6", recency=True, train_equals_test=True, **SECS)))
query("fsrs6_days_trained")(_metrics(Settings(algo="FSRS-6", short=True), True))


@query("fsrs6_by_preset")
def fsrs6_by_preset(spark, sf_dir):
    rows = reviews(spark, sf_dir)
    return metrics(evaluation.predictions(rows, Settings(algo="FSRS-6", partitions="preset", **SECS), revlog.partition_map(*revlog.event_decks(rows))))


@query("logreg_equalized")
def logreg_equalized(spark, sf_dir):
    return metrics(evaluation.predictions(reviews(spark, sf_dir, True), Settings(algo="LogisticRegression", equalize_test_with_non_secs=True, recency=True, **SECS)))


@query(
    "fsrs_rs_items",
    f"""{oracle.base(True)} SELECT a.user_id, a.review_th, string_agg(CAST(e.rating AS VARCHAR), ',' ORDER BY e.pos) AS ratings, string_agg(CAST(CAST(floor(e.delta_t) AS BIGINT) AS VARCHAR), ',' ORDER BY e.pos) AS intervals
    FROM rows_ a JOIN h e ON a.user_id = e.user_id AND a.card_id = e.card_id AND e.pos <= a.pos WHERE a.pos > 0 GROUP BY ALL""",
)
def fsrs_rs_items(spark, sf_dir):
    """Each item's lists as comma-joined text."""
    found = evaluate.items(secs_features(spark, sf_dir))
    return found.select("user_id", "review_th", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("ratings", "intervals")])


def _lines_sql() -> str:
    def number(c: str) -> str:
        return f"coalesce(regexp_replace(regexp_replace(CAST(CAST({c} AS DECIMAL(28,6)) AS VARCHAR), '0+$', ''), '[.]$', '.0'), 'null')"

    head, _, tail = METRICS.rpartition("SELECT user_id, size")
    shown = " || ', ' || ".join(f"""'"{name}": ' || {number(c)}""" for name, c in evaluation.FIELDS.items())
    return f"""{AVG}, {head.rstrip()}, every AS (SELECT user_id, size{tail})
    SELECT user_id AS "user", '{{"metrics": {{' || {shown} || '}}, "user": ' || user_id || ', "size": ' || size || ', "time_ms": 0.0}}' AS value FROM every"""


@query("result_lines", _lines_sql())
def result_lines(spark, sf_dir):
    """The lines of the result file, without the time that a learner took."""
    from ..sources.results import lines

    return lines(evaluation.records(reviews(spark, sf_dir), Settings(algo="AVG", **SECS)).withColumn("time_ms", F.lit(0.0)))

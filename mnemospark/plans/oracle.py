"""DuckDB SQL for the registered queries, written apart from the Spark plans."""

from __future__ import annotations

import math

EPS = "2.220446049250313e-16"


def reviews(days_view: bool = False) -> str:
    learner, card = ("user_id % 3", "user_id * 5 + k") if days_view else ("user_id", "k")
    return f"""r00 AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS k, event_id, ts, event_type FROM events),
    r0 AS (SELECT {learner} AS user_id, {card} AS card_id, event_id AS review_th, ts,
      CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END AS BIGINT) AS rating FROM r00),
    r1 AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, card_id ORDER BY review_th) AS pts FROM r0),
    reviews AS (SELECT user_id, card_id, review_th, rating,
      CAST(coalesce(date_diff('day', CAST(pts AS DATE), CAST(ts AS DATE)), -1) AS BIGINT) AS elapsed_days,
      CAST(coalesce(date_sub('second', pts, ts), -1) AS BIGINT) AS elapsed_seconds FROM r1)"""


def histories(secs: bool, short: bool = True, two_buttons: bool = False, cap: int = 128, name: str = "h") -> str:
    rating = "CASE WHEN rating IN (2, 4) THEN 3 ELSE rating END" if two_buttons else "rating"
    dt = "CAST(elapsed_seconds AS DOUBLE) / 86400e0" if secs else "CAST(elapsed_days AS DOUBLE)"
    lapse = "rating = 1" if secs else "rating = 1 AND delta_t <> 0"
    return f"""{name}1 AS (SELECT user_id, card_id, review_th, CAST({rating} AS BIGINT) AS rating, elapsed_days, elapsed_seconds,
        row_number() OVER (PARTITION BY user_id, card_id ORDER BY review_th) AS nth FROM reviews WHERE rating BETWEEN 1 AND 4),
    {name}2 AS (SELECT * EXCLUDE (nth), greatest({dt}, 0e0) AS delta_t, CAST(CASE WHEN rating = 1 THEN 0 ELSE 1 END AS BIGINT) AS y
        FROM {name}1 WHERE nth <= {cap} {'' if short else 'AND elapsed_days <> 0'}),
    {name} AS (SELECT *, CAST(row_number() OVER c - 1 AS BIGINT) AS pos, first_value(rating) OVER c AS first_rating,
        coalesce(last_value(CASE WHEN elapsed_days > 0 THEN rating END IGNORE NULLS) OVER b, first_value(rating) OVER c) AS last_rating,
        CAST(coalesce(sum(CASE WHEN {lapse} THEN 1 ELSE 0 END) OVER b, 0) AS BIGINT) AS rmse_bins_lapse,
        CAST(sum(CASE WHEN elapsed_days > 0 THEN 1 ELSE 0 END) OVER c + 1 AS BIGINT) AS i,
        first_value(elapsed_days) OVER c <= 0 AS card_has_i1 FROM {name}2
      WINDOW c AS (PARTITION BY user_id, card_id ORDER BY review_th),
        b AS (PARTITION BY user_id, card_id ORDER BY review_th ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


OUTLIERS = """oc1 AS (SELECT user_id, first_rating, elapsed_days, count(*) AS n FROM h WHERE i = 2 AND delta_t > 0 GROUP BY ALL),
    oc2 AS (SELECT *, sum(n) OVER (PARTITION BY user_id, first_rating ORDER BY n, elapsed_days DESC ROWS UNBOUNDED PRECEDING) AS so_far,
        greatest(0.05e0 * sum(n) OVER (PARTITION BY user_id, first_rating), 20e0) AS bound FROM oc1),
    cells AS (SELECT user_id, first_rating, elapsed_days, n,
        so_far < bound OR n < 6 OR elapsed_days > CASE WHEN first_rating = 4 THEN 365 ELSE 100 END AS removed FROM oc2),
    hm AS (SELECT h.*, coalesce(c.removed, false) AND h.i = 2 AND h.delta_t > 0 AS own FROM h LEFT JOIN cells c USING (user_id, first_rating, elapsed_days)),
    ho AS (SELECT *, bool_or(own) OVER (PARTITION BY user_id, card_id) AS anyof FROM hm),
    rows_ AS (SELECT * FROM ho WHERE delta_t > 0 AND NOT CASE WHEN card_has_i1 THEN anyof ELSE own END)"""
SECS_ROWS = "rows_ AS (SELECT * FROM h WHERE delta_t > 0)"
FEATURES = "user_id, card_id, review_th, rating, y, delta_t, elapsed_days, elapsed_seconds, pos, i, rmse_bins_lapse, last_rating, first_rating"
FOLDS = """f1 AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY review_th) - 1 AS BIGINT) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM rows_),
    folds AS (SELECT *, n // 6 AS test_size, CASE WHEN rn >= n - 5 * (n // 6) THEN (rn - (n - 5 * (n // 6))) // (n // 6) END AS fold FROM f1 WHERE n >= 6)"""


def base(secs: bool, days_view: bool = False, recursive: bool = False, short: bool = True) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{reviews(days_view)}, {histories(secs, short)}, {SECS_ROWS if secs else OUTLIERS}, {FOLDS}"


def metrics(predictions: str) -> str:
    """Metrics of a CTE with user_id, y, p, delta_t, i, rmse_bins_lapse; to be appended to a WITH list."""
    def log_bin(x: str, scale: float, b: float) -> str:
        return f"{scale}e0 * pow({b}e0, floor(ln({x}) / {math.log(b)!r}))"

    return f"""m1 AS (SELECT user_id, count(*) AS size, sqrt(avg((p - y) * (p - y))) AS rmse, avg(CASE WHEN y = 1 THEN -ln(least(greatest(p, {EPS}), 1e0 - {EPS})) ELSE -ln(1e0 - least(greatest(p, {EPS}), 1e0 - {EPS})) END) AS logloss,
        coalesce(count(*) FILTER (p >= 0.9e0 AND y = 1) / CAST(nullif(count(*) FILTER (p >= 0.9e0), 0) AS DOUBLE), 0e0) AS precision_90,
        coalesce(count(*) FILTER (p >= 0.9e0 AND y = 1) / CAST(nullif(sum(y), 0) AS DOUBLE), 0e0) AS recall_90, avg(p - y) AS mbe FROM {predictions} GROUP BY user_id),
    m2 AS (SELECT user_id, round({log_bin('greatest(delta_t, 1e-6)', 2.48, 3.62)}, 2) AS bin_delta_t, round({log_bin('i', 1.99, 1.89)}) AS bin_i,
        CASE WHEN rmse_bins_lapse = 0 THEN 0e0 ELSE round({log_bin('greatest(rmse_bins_lapse, 1)', 1.65, 1.73)}) END AS bin_lapse, count(*) AS n, avg(y) AS mean_y, avg(p) AS mean_p
        FROM {predictions} GROUP BY ALL),
    m3 AS (SELECT user_id, sqrt(sum(n * pow(mean_y - mean_p, 2)) / sum(n)) AS rmse_bins FROM m2 GROUP BY user_id),
    m4 AS (SELECT user_id, y, rank() OVER (PARTITION BY user_id ORDER BY p) + (count(*) OVER (PARTITION BY user_id, p) - 1) / 2e0 AS r FROM {predictions}),
    m5 AS (SELECT user_id, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(CASE WHEN y = 1 THEN r ELSE 0e0 END) - sum(y) * (sum(y) + 1) / 2e0) / nullif(CAST(sum(y) AS DOUBLE) * (count(*) - sum(y)), 0e0) END AS auc FROM m4 GROUP BY user_id)
    SELECT user_id, size, {', '.join(f'round({c}, 6) AS {c}' for c in ('rmse', 'logloss', 'rmse_bins', 'auc', 'precision_90', 'recall_90', 'mbe'))} FROM m1 JOIN m3 USING (user_id) JOIN m5 USING (user_id)"""




def avg_predictions() -> str:
    """Mean label of everything before the fold."""
    return """a1 AS (SELECT *, sum(y) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM folds),
    a2 AS (SELECT user_id, fold, min(rn) AS start, min_by(before, rn) AS ysum FROM a1 WHERE fold IS NOT NULL GROUP BY ALL),
    pred AS (SELECT a1.*, a2.ysum / CAST(a2.start AS DOUBLE) AS p FROM a1 JOIN a2 USING (user_id, fold))"""


def scan(state: dict[str, tuple[str, str]], p: str) -> str:
    """pred from a recurrence over each card's history.

    state: name -> (value at position 0, next value); in next values o is the row of states so
    far, c the review. p uses s, the state after the reviews before a row, null at position 0.
    """
    names = ", ".join(state)
    first = ", ".join(f"CAST({a} AS DOUBLE) AS {k}" for k, (a, _) in state.items())
    after = ", ".join(f"CAST({b} AS DOUBLE) AS {k}" for k, (_, b) in state.items())
    return f"""st AS (SELECT user_id, card_id, pos, {first} FROM h c WHERE pos = 0
      UNION ALL SELECT c.user_id, c.card_id, c.pos, {after} FROM st o JOIN h c ON c.user_id = o.user_id AND c.card_id = o.card_id AND c.pos = o.pos + 1),
    pred AS (SELECT f.*, {p} AS p FROM folds f LEFT JOIN (SELECT user_id, card_id, pos + 1 AS pos, {names} FROM st) s
      ON f.user_id = s.user_id AND f.card_id = s.card_id AND f.pos = s.pos WHERE f.fold IS NOT NULL)"""

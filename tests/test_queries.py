"""Registered queries against their SQL, and sources, sinks and edge cases on small tables."""

import json
import math
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from mnemospark.__main__ import settings
from mnemospark.config import Settings
from mnemospark.functions.metrics import auc, metrics
from mnemospark.models import replay
from mnemospark.models.learner import NEEDED, folds
from mnemospark.operators import history, splits
from mnemospark.operators.features import features, outlier_cells
from mnemospark.plans import evaluation
from mnemospark.plans import queries as q
from mnemospark.sources import results, revlog

SF = "/root/testdata/sf0.001"


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and a == pytest.approx(b, abs=2e-6))


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    got = q.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{SF}/events.parquet'")
    expected = con.sql(q.ORACLE_SQL[name])
    assert sorted(expected.columns) == names
    place = [expected.columns.index(c) for c in names]
    a = sorted((tuple(r[c] for c in names) for r in got.collect()), key=lambda r: [(x is not None, x) for x in r])
    b = sorted((tuple(r[k] for k in place) for r in expected.fetchall()), key=lambda r: [(x is not None, x) for x in r])
    assert len(a) == len(b)
    assert all(same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", ["hlr_trained", "fsrs3_trained", "logreg_equalized", "ebisu_metrics", "result_lines"])
def test_other_queries_give_rows(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0


def test_outlier_cells_match_the_loop(spark):
    rows = [(1, 3, d, 2, 1.0) for d, n in ((1, 400), (2, 9), (3, 9), (4, 5), (150, 40), (7, 21)) for _ in range(n)]
    df = spark.createDataFrame(rows, "user_id long, first_rating long, elapsed_days long, i long, delta_t double")
    got = {r["elapsed_days"]: r["removed"] for r in outlier_cells(df).collect()}
    cells, removed, expected = [(5, 4), (9, 3), (9, 2), (21, 7), (40, 150), (400, 1)], 0, {}
    bound = max(0.05 * 484, 20)
    for n, d in cells:
        expected[d] = removed + n < bound or n < 6 or d > 100
        removed += n
    assert got == expected


def test_metrics_edge_cases(spark):
    rows = [(1, 1, 0.5), (1, 0, 0.5), (1, 1, 0.5), (2, 1, 0.95), (2, 1, 0.2), (3, 1, 0.0), (3, 0, 1.0)]
    df = spark.createDataFrame(rows, "user_id long, y long, p double").withColumns({"delta_t": F.lit(1.0), "i": F.lit(2).cast("long"), "rmse_bins_lapse": F.lit(0).cast("long")})
    got = {r["user_id"]: r for r in metrics(df).collect()}
    assert got[1]["auc"] == 0.5 and got[2]["auc"] is None and got[3]["auc"] == 0.0
    assert got[2]["precision_90"] == 1.0 and got[2]["recall_90"] == 0.5 and got[1]["precision_90"] == 0.0
    assert got[3]["logloss"] == pytest.approx(36.043653, abs=1e-5)


def test_tree_run_resume_and_partitions(spark, tmp_path):
    reviews = q.reviews(spark, SF).filter("user_id < 4")
    tree = str(tmp_path / "data")
    # The order of a learner's rows in the file is the order of the reviews.
    order = reviews.withColumn("state", F.lit(0).cast("long")).repartition(1).sortWithinPartitions("user_id", "review_th")
    order.write.partitionBy("user_id").parquet(f"{tree}/revlogs")
    cards, decks = revlog.event_decks(reviews)
    cards.coalesce(1).write.partitionBy("user_id").parquet(f"{tree}/cards")
    decks.coalesce(1).write.partitionBy("user_id").parquet(f"{tree}/decks")
    assert [r["user_id"] for r in revlog.users(spark, tree, 2).collect()] == [0, 1, 2]
    assert revlog.read_partition_map(spark, tree, "preset").count() == cards.count()
    s = Settings(algo="AVG", short=True, secs=True, max_user_id=1)
    out = str(tmp_path / "result")
    first = evaluation.run(spark, tree, out, s)
    assert sorted(r["user"] for r in first.collect()) == [0, 1]
    again = evaluation.run(spark, tree, out, Settings(**{**s.__dict__, "max_user_id": None}))
    assert sorted(r["user"] for r in again.collect()) == [0, 1, 2, 3]
    whole = {r["user_id"]: r["rmse"] for r in metrics(evaluation.predictions(reviews, s)).collect()}
    assert {r["user"]: r["metrics"]["RMSE"] for r in again.collect()} == whole
    text = [r["value"] for r in spark.read.text(f"{out}/AVG-short-secs.jsonl").collect()]
    assert [json.loads(t)["user"] for t in text] == [0, 1, 2, 3] and text[0].startswith('{"metrics": {"RMSE": ')


def test_learners_that_are_skipped(spark, tmp_path):
    """A learner with a null, without cards or with few reviews gets no record and a reason; others go on."""
    tree, out = str(tmp_path / "data"), str(tmp_path / "result")
    rows = q.reviews(spark, SF).filter("user_id < 3").drop("review_th")
    few = rows.filter("user_id = 0").limit(2).withColumn("user_id", F.lit(7).cast("long"))
    hole = rows.filter("user_id = 1").withColumn("user_id", F.lit(8).cast("long")).withColumn("rating", F.when(F.col("elapsed_days") >= 0, F.col("rating")))
    rows.unionByName(few).unionByName(hole).repartition(1).write.partitionBy("user_id").parquet(f"{tree}/revlogs")
    cards = spark.createDataFrame([(0, 1, 0), (1, 1, 7), (2, 1, 8), (3, 1, 2)], "card_id long, deck_id long, user_id long")
    cards.write.partitionBy("user_id").parquet(f"{tree}/cards")
    for name in ("user_id=5", "user_id=x", "other=3"):
        (tmp_path / "data/revlogs" / name).mkdir()
    (tmp_path / "data/cards/user_id=5").mkdir()
    (tmp_path / "data/revlogs/user_id=6").write_text("a file, no directory")
    assert [r["user_id"] for r in revlog.users(spark, tree).collect()] == [0, 1, 2, 5, 7, 8]
    assert [r["user_id"] for r in revlog.without_files(spark, tree).collect()] == [5]
    (tmp_path / "data/revlogs/user_id=6").unlink()
    (tmp_path / "data/revlogs/user_id=x").rmdir()
    (tmp_path / "data/revlogs/other=3").rmdir()
    s = Settings(algo="AVG", short=True, secs=True, partitions="deck")
    found = evaluation.run(spark, tree, out, s)
    assert sorted(r["user"] for r in found.collect()) == [0, 2]
    reasons = {r["user_id"]: r["reason"] for r in evaluation.skipped(spark, tree, found, s).collect()}
    assert reasons == {1: "has no cards", 5: "has no revlogs", 7: evaluation.FEW, 8: "has a null in rating"}
    plain = evaluation.run(spark, tree, out, Settings(algo="AVG", short=True, secs=True))
    assert sorted(r["user"] for r in plain.collect()) == [0, 1, 2]
    with pytest.raises(Exception, match="null in rating"):
        revlog.read_revlogs(spark, tree).collect()


def test_a_failed_run_leaves_the_old_file_whole(spark, tmp_path):
    path = str(tmp_path / "r.jsonl")
    rows = spark.createDataFrame([((0.5,) * 7, u, 3, None, 1.0) for u in (2, 1)], results.SCHEMA)
    results.write(rows, path)
    old = (tmp_path / "r.jsonl").read_text()
    assert [json.loads(t)["user"] for t in old.splitlines()] == [1, 2]
    broken = rows.withColumn("size", F.when(F.col("user") == 2, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("size")))
    with pytest.raises(Exception, match="killed"):
        results.write(broken, path)
    assert (tmp_path / "r.jsonl").read_text() == old and [p.name for p in tmp_path.iterdir()] == ["r.jsonl"]
    results.write(results.merged(results.read(spark, path), rows.withColumn("user", F.col("user") + 5)), path)
    assert [r["user"] for r in results.read(spark, path).collect()] == [1, 2, 6, 7]
    results.write(rows.limit(0), path)
    assert (tmp_path / "r.jsonl").read_text() == ""
    (tmp_path / "d.jsonl").mkdir()
    results.write(rows, str(tmp_path / "d.jsonl"))
    assert results.read(spark, str(tmp_path / "d.jsonl")).count() == 2


def test_bad_trees(spark, tmp_path):
    spark.range(3).selectExpr("id AS card_id", "1L AS rating", "id AS elapsed_days", "0L AS user_id").write.partitionBy("user_id").parquet(str(tmp_path / "a/revlogs"))
    with pytest.raises(ValueError, match="elapsed_seconds"):
        revlog.read_revlogs(spark, str(tmp_path / "a"))
    spark.range(3).selectExpr("id AS card_id", "1 AS rating", "id AS elapsed_days", "id AS elapsed_seconds", "0L AS user_id").write.partitionBy("user_id").parquet(str(tmp_path / "b/revlogs"))
    with pytest.raises(TypeError, match="rating"):
        revlog.read_revlogs(spark, str(tmp_path / "b"))


def test_read_back_drops_bad_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"metrics": {"RMSE": 0.1}, "user": 5, "size": 9}\n\nnot json\n{"size": 3}\n')
    got = results.read(spark, str(tmp_path / "r.jsonl")).collect()
    assert [(r["user"], r["size"]) for r in got] == [(5, 9), (None, 3)]
    left = results.not_done(spark.createDataFrame([(5, 1), (6, 1)], "user_id long, x int"), results.read(spark, str(tmp_path / "r.jsonl")))
    assert [r["user_id"] for r in left.collect()] == [6]


def test_empty_log_gives_empty_frames(spark):
    none = q.reviews(spark, SF).limit(0)
    assert features(none, Settings(short=True)).count() == 0
    for algo in ("AVG", "SM2", "FSRSv3"):
        assert evaluation.predictions(none, Settings(algo=algo, short=True, secs=True)).count() == 0


def test_history_longer_than_the_cap(spark):
    rows = [(1, 1, k, 3, 1, 86400) for k in range(200)]
    df = spark.createDataFrame(rows, "user_id long, card_id long, review_th long, rating long, elapsed_days long, elapsed_seconds long")
    assert features(df, Settings(short=True, secs=True)).count() == 128


def test_unknown_and_outside_models(spark):
    with pytest.raises(ValueError, match="unknown"):
        evaluation.predictions(q.reviews(spark, SF), Settings(algo="nothing"))
    with pytest.raises(ValueError, match="outside"):
        evaluation.predictions(q.reviews(spark, SF), Settings(algo="FSRS-rs", secs=True))


def test_records_train_once_and_round_parameters(spark, capsys):
    for default, trainings in ((True, 0), (False, 1)):
        s = Settings(algo="FSRS-6", default=default, only_s0=True, short=True, secs=True)
        found = evaluation.records(q.reviews(spark, SF), s)
        found.explain()
        assert capsys.readouterr().out.count("FlatMapGroupsInPandas") == trainings
        for r in found.collect():
            weights = json.loads(r["parameters"])["0"]
            assert len(weights) == 21 and all(w == round(w, 6) for w in weights) and r["time_ms"] > 0


PLANS = {"fsrs1_default", "fsrs6_default", "sm2_trainable_default", "anki_default", "hlr_default", "dash_mcm_default", "logreg_default", "dash_features", "equalized_folds", "auc_by_learner"}


@pytest.mark.parametrize("name", sorted(PLANS))
def test_plans_without_python_or_products(spark, name, capsys):
    """Default weights run natively; look-back windows and fold ends need no join of rows with rows."""
    q.QUERIES[name](spark, SF).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "InPandas" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name == "dash_features":
        assert "Join" not in plan and "collect_list" not in plan


def test_ranks_come_from_counts(spark, capsys):
    """The area's windows lie above a grouping by value: no window runs over the reviews."""
    rows = spark.createDataFrame([(1, k % 2, (k % 5) / 5) for k in range(1000)], "user_id long, y long, p double")
    found = auc(rows)
    found.explain()
    plan = capsys.readouterr().out
    assert plan.index("Window") < plan.index("HashAggregate(keys=[user_id", plan.index("Window")) and "rank" not in plan
    assert found.first()["auc"] == pytest.approx(0.5)


def test_look_back_windows_by_hand(spark):
    """Ties of time, reviews on a window's edge, long gaps: all pairs of a card's reviews."""
    gaps = [0.0, 0.0, 0.5, 0.5, 0.0, 1.0, 6.0, 0.25, 30.0, 0.0, 400.0, 2.0, 5.0, 23.0, 7000.0, 0.75, 0.25]
    rows = [(1, 1, k, 1 + k * 3 % 4, d, k, True) for k, d in enumerate(gaps)]
    df = spark.createDataFrame(rows, "user_id long, card_id long, review_th long, rating long, delta_t double, pos long, evaluable boolean")
    for decay in (False, True):
        for r in history.dash_features(df, decay).collect():
            for k, (days, tau) in enumerate(zip(history.WINDOWS, history.DECAYS, strict=True)):
                ages = [(sum(gaps[j + 1 : r["pos"] + 1]), rows[j][3]) for j in range(r["pos"])]
                used = [(math.exp(-a / tau) if decay else 1.0, g) for a, g in ages if days is None or a <= days]
                assert r[f"f{2 * k}"] == pytest.approx(sum(w for w, _ in used), abs=1e-9)
                assert r[f"f{2 * k + 1}"] == pytest.approx(sum(w for w, g in used if g > 1), abs=1e-9)


def test_sink_sorts_below_an_exchange(spark, tmp_path):
    seen = []
    original = results.lines
    results.lines = lambda df: seen.append(original(df)) or seen[0]
    try:
        rows = spark.createDataFrame([((0.5,) * 7, u, 3, None, 1.0) for u in (3, 1, 2)], results.SCHEMA)
        results.write(rows, str(tmp_path / "r.jsonl"))
    finally:
        results.lines = original
    assert [json.loads(r["value"])["user"] for r in spark.read.text(str(tmp_path / "r.jsonl")).collect()] == [1, 2, 3]


@pytest.mark.parametrize("algo", ["MOVING-AVG", "RMSE-BINS-EXPLOIT"])
def test_long_log_of_one_learner(spark, algo):
    """80,000 reviews of one learner, in seconds; a fold that copied its outputs took over a minute."""
    rows = spark.range(80_000).select(F.lit(1).cast("long").alias("user_id"), (F.col("id") % 700).alias("card_id"), F.col("id").alias("review_th"), (F.col("id") * 37 % 4 + 1).alias("rating"), F.lit(1).cast("long").alias("elapsed_days"), F.lit(86400).cast("long").alias("elapsed_seconds"))
    began = time.perf_counter()
    assert evaluation.predictions(rows, Settings(algo=algo, short=True, secs=True)).agg(F.sum("p")).first()[0] > 0
    assert time.perf_counter() - began < 25


def test_one_learner_over_many_tasks(spark):
    """300,000 reviews of one learner: no task numbers more than a stretch, and folds are the same."""
    rows = spark.range(300_000).select(F.lit(1).cast("long").alias("user_id"), (F.col("id") * 3 + 1).alias("review_th"))
    blocks = splits.folds(rows, block=50_000)
    whole = blocks.groupBy("fold").agg(F.count("*"), F.min("rn"), F.max("rn"), F.min("review_th"), F.max("n"))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, splits.folds(rows).groupBy("fold").agg(F.count("*"), F.min("rn"), F.max("rn"), F.min("review_th"), F.max("n")).collect()), key=str)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = splits.placed(rows, 50_000).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(spread) > 1 and max(r["count"] for r in spread) < 300_000


@pytest.mark.parametrize("seed", [1, 2])
def test_training_reviews_of_each_fold(spark, seed):
    """Evaluated and other reviews in any order: a fold trains on all that stand before its first tested one."""
    rng = random.Random(seed)
    logs = {u: [(u, k // 5, 10 * k + rng.randrange(9), 3, 1, 1.0, 1, k % 5, 2, 0, 3, rng.random() < 0.7, k // 5 % 2) for k in range(n)] for u, n in enumerate((3, 9, 40, 61))}
    rows = [r for log in logs.values() for r in log]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'double' if c == 'delta_t' else 'boolean' if c == 'evaluable' else 'long'}" for c in NEEDED)).repartition(3)
    found = replay.placed(df, Settings(algo="FSRSv3"))
    expected_tests, expected_training = set(), set()
    for u, log in logs.items():
        order = sorted(r[2] for r in log if r[11])
        if len(order) < 6:
            continue
        for f, (start, end) in enumerate(folds(len(order), 5)):
            expected_tests |= {(u, f, th) for th in order[start:end]}
            expected_training |= {(u, f, r[2]) for r in log if r[2] < order[start]}
    assert {tuple(r) for r in found.filter("fold IS NOT NULL").select("user_id", "fold", "review_th").collect()} == expected_tests
    got = [tuple(r) for r in replay.training(found, Settings(algo="FSRSv3")).select("user_id", "fold", "review_th").collect()]
    assert set(got) == expected_training and len(got) == len(expected_training)


def test_command_line_accepts_flags_without_effect(capsys):
    args, s = settings(["--data", "x", "--processes", "4", "--algo", "FSRS-6", "--short", "--plot"])
    assert s.algo == "FSRS-6" and s.short and "--processes has no effect" in capsys.readouterr().err


def test_ages_of_just_a_tenth_of_a_day(spark, tmp_path):
    """An age is a difference of times, as in the SQL, also where a sum of intervals gives just 0.1."""
    rng, rows = random.Random(3), []
    for user in range(40):
        second = 0
        for n in range(14):
            second += 8640 if rng.random() < 0.4 else rng.randrange(60, 40000)
            rows.append((user * 100 + n, second, user, rng.choice(["error", "view", "click", "purchase"]), '{"k": 5}'))
    events = spark.createDataFrame(rows, "event_id long, second long, user_id long, event_type string, props string")
    events.withColumn("ts", F.timestamp_seconds("second").cast("timestamp_ntz")).drop("second").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    expected = {r[:3]: r[3:] for r in con.sql(f"SELECT user_id, card_id, review_th, fold, p FROM ({q.ORACLE_SQL['dash_actr_default']})").fetchall()}
    got = {r[:3]: r[3:] for r in map(tuple, q.QUERIES["dash_actr_default"](spark, str(tmp_path)).select("user_id", "card_id", "review_th", "fold", "p").collect())}
    assert got.keys() == expected.keys()
    assert [k for k in got if any(not same(a, b) for a, b in zip(got[k], expected[k], strict=True))] == []

from pyspark.sql import functions as F

from mnemospark.streaming import moving_average as ma


def test_stream_matches_a_loop(spark, tmp_path):
    rows = [(u, k, int((u + k) % 3 > 0)) for k in range(30) for u in (1, 2)]
    spark.createDataFrame(rows, "user_id long, review_th long, y long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, review_th long, y long").parquet(str(tmp_path / "in"))
    run = ma.predictions(stream).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    got = {(r["user_id"], r["review_th"]): r["p"] for r in spark.table("told").select("*", F.lit(1)).collect()}
    for u in (1, 2):
        x = 1.2
        for _, k, y in sorted(r for r in rows if r[0] == u):
            p, x = ma.advance(x, y)
            assert abs(got[u, k] - p) < 1e-12

"""The streaming extension: files as they arrive, and event-time sessions of a stream."""

import datetime

from pyspark.sql import functions as F

from pepspark.operators.relational import best_row
from pepspark.streaming import runs

START = datetime.datetime(2024, 1, 1)


def test_per_batch(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "run_index int, precursor_index int, score double, pmsm_index int"
    analyse = lambda df: best_row(df, ["run_index", "precursor_index"], "score", ["pmsm_index"])
    for run in (0, 1):
        spark.createDataFrame([(run, i % 3, float(i), i) for i in range(9)], schema).coalesce(1).write.mode("append").parquet(source)
        runs.per_batch(runs.stream_table(spark, source, schema), analyse, target, state).awaitTermination(120)
    rows = spark.read.parquet(target).collect()
    assert sorted((r["run_index"], r["precursor_index"], r["pmsm_index"]) for r in rows) == [(run, i, 6 + i) for run in (0, 1) for i in range(3)]
    assert {r["batch"] for r in rows} == {0, 1}


def test_sessions_of_a_stream(spark, tmp_path):
    """Sessions of the stream are those of the table, once the watermark has passed them."""
    minutes = [0, 10, 35, 100, 120, 400, 5000]
    schema = "key int, ts timestamp"
    rows = [(k, START + datetime.timedelta(minutes=m)) for k in (1, 2) for m in minutes]
    table = spark.createDataFrame(rows, schema)
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = runs.session_counts(runs.stream_table(spark, str(tmp_path / "in"), schema), "ts", "key")
    query = stream.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(120)
    closed = {tuple(r) for r in spark.table("sessions").select("key", "start", "n").collect()}
    whole = {tuple(r) for r in runs.session_counts(table, "ts", "key").select("key", "start", "n").collect()}
    last = START + datetime.timedelta(minutes=5000)
    assert closed == {x for x in whole if x[1] < last} and len(closed) == 6
    assert runs.session_counts(table, "ts", "key").where(F.col("end") <= F.col("start")).count() == 0

from pyspark.sql import functions as F

from stepweave.streaming.validate import sessions, validate_stream, window_counts


def test_stream_of_steps(make_steps, spark, tmp_path):
    src, rows = str(tmp_path / "s"), []
    df = make_steps([{}, {"timestamp": -1.0}, {}], [{}, {}]).coalesce(1).persist()

    def arrive(part):
        part.write.mode("append").parquet(src)
        found = validate_stream(spark.readStream.schema(df.schema).parquet(src))
        q = found.writeStream.foreachBatch(lambda batch, _: rows.extend(batch.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(90)

    arrive(df.where("step_index = 0"))
    assert not rows  # both are open
    arrive(df.where("step_index > 0"))
    by = {r.episode_id: r for r in rows}
    assert by["e0"].num_steps == 3 and by["e0"].goes_back == 1 and by["e1"].complete and by["e1"].late == 0
    arrive(df.where("episode_id = 'e1' and step_index = 0"))
    assert rows[-1].episode_id == "e1" and rows[-1].late == 1


def test_stream_of_windows_is_as_the_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "e")
    batch.coalesce(1).write.parquet(src)
    q = window_counts(spark.readStream.schema(batch.schema).parquet(src)).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        got = {(r.start, r.event_type): r.n for r in spark.table("w").collect()}
    finally:
        q.stop()
    assert got == {(r.start, r.event_type): r.n for r in window_counts(batch).collect()}
    assert sessions(batch, gap="1 day").agg(F.sum("n")).first()[0] == batch.count()

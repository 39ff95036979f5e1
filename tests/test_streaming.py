from sedge.streaming.events import windowed


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:{i % 60:02d}:00", "ab"[i % 2], float(i)) for i in range(50)] + [(99, "2024-01-02 12:00:00", "a", 1.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "value")
    df.write.parquet(f"{tmp_path}/in")
    stream = windowed(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.outputMode("append").format("memory").queryName("counted").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.sql("SELECT * FROM counted").collect()}
    want = {tuple(r) for r in windowed(df).collect()}
    assert got and got <= want and {r for r in want if r[0].day == 1} == got

from pyspark.sql import functions as F

from tidemill.operators import events as E
from tidemill.streaming import events as S


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    source = str(tmp_path / "in")
    for i in range(3):  # three files, in order of events
        events.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(source)
    counts = S.windowed_counts(S.read_events(spark, source, 10), late="60 days")
    counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.start, r.event_type, r.n) for r in spark.table("counts").collect())
    want = sorted((r.start, r.event_type, r.n) for r in events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n").collect())
    assert got == want


def test_memory_state_equals_window(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    source = str(tmp_path / "in")
    n = events.count()
    for i in range(2):
        events.where((F.col("event_id") >= i * n // 2) & (F.col("event_id") < (i + 1) * n // 2)).coalesce(1).write.mode("append").parquet(source)
    S.run_available(S.memories(S.read_events(spark, source)), str(tmp_path / "out"), str(tmp_path / "state"))
    item = F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"))
    want = {r.event_id: "|".join(r.memory) for r in E.memory(events, ["user_id"], ["event_id"], item, 12).collect()}
    assert {r.event_id: r.memory for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want

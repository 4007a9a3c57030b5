"""The review log read file by file gives what a batch over all of it gives."""

from pyspark.sql import functions as F

from loreforge.streaming import reviews

SMALL = "/root/testdata/sf0.001/events.parquet"


def _stream(spark, tmp_path):
    events = spark.read.parquet(SMALL).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    events.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _run(spark, frame, mode, name, tmp_path):
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_latest_status(spark, tmp_path):
    events, stream = _stream(spark, tmp_path)
    got = _run(spark, reviews.latest_status(stream, "user_id", "event_id", "event_type"), "complete", "latest", tmp_path)
    want = reviews.latest_status(events, "user_id", "event_id", "event_type")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_counts_and_duplicates(spark, tmp_path):
    events, stream = _stream(spark, tmp_path)
    got = _run(spark, reviews.counted(stream, "ts", "event_type", "1 hour", "100000 days"), "update", "counted", tmp_path)
    assert got.groupBy("start", "event_type").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == events.count()
    doubled = _run(spark, reviews.once_each(stream.union(stream), "event_id", "ts", "100000 days"), "append", "once", tmp_path)
    assert doubled.count() == events.count()


def test_decisions_take_effect_in_their_order(spark):
    import random
    import tempfile

    from loreforge.streaming import reviews

    rng = random.Random(5)
    rows, want = [], []
    for subject in "abcde":
        head, status = None, "pending_review"
        for ordinal in range(12):
            decision, supported = rng.choice(["approve", "approve", "reject", "correct"]), rng.random() < 0.8
            expected, revision = head if rng.random() < 0.75 else "other", f"{subject}{ordinal}"
            rows.append((subject, ordinal, decision, expected, revision, supported))
            if expected != head:
                outcome = "STALE"
            elif decision == "approve" and not supported:
                outcome = "UNSUPPORTED"
            elif decision == "approve" and status == "rejected":
                outcome = "REJECTED"
            else:
                outcome, head, status = "accepted", revision, {"approve": "verified", "reject": "rejected"}.get(decision, "pending_review")
            want.append((subject, ordinal, decision, outcome, status))
    rng.shuffle(rows)  # they come in any order, and some twice
    schema = "subject string, ordinal long, decision string, expected string, revision string, supported boolean"
    folder = tempfile.mkdtemp(prefix="spark-")
    for part in (rows[:25], rows[20:45], rows[45:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = reviews.decided(stream).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("decided").collect())) == sorted(want)
    assert {o for *_, o, _ in want} == {"STALE", "UNSUPPORTED", "REJECTED", "accepted"}

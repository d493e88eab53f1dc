import datetime

from pyspark.sql import functions as F

from folium.streaming import runs


def finish(writer):
    """Runs what is there to its end, which is waited for at most two minutes."""
    query = writer.trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()


def drain(stream, name, path, mode="append"):
    finish(stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path / name)))


def test_windowed_counts_equal_batch(spark, data, tmp_path):
    batch = spark.read.parquet(f"{data}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    drain(runs.windowed_counts(stream), "counts", tmp_path, "complete")
    got = {(r.start.replace(tzinfo=None), r.event_type): r.n for r in spark.table("counts").collect()}
    want = batch.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count()
    assert got == {(r.w.start.replace(tzinfo=None), r.event_type): r["count"] for r in want.collect()}


def test_line_events(spark):
    lines = [
        ("r", 1, "[4.5/7] Background-Extractor: start"),
        ("r", 2, "some text"),
        ("r", 3, "more"),
        ("r", 4, "-> inbox (score low)"),
        ("r", 5, "→ vault"),
        ("r", 6, "tail"),
    ]
    df = spark.createDataFrame(lines, "run_id string, seq int, value string")
    rows = runs.parse_lines(df).orderBy("seq").collect()
    assert [r.kind for r in rows] == ["stage", "log", "log", "inbox", "vault", "log"]
    assert rows[0].num == 4.5 and rows[0].name == "Background-Extractor" and rows[3].detail == "score low"


def test_preview_blocks(spark, tmp_path):
    schema = "run_id string, seq int, ts timestamp, value string"
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    lines = [("r", 1, at(0), "a"), ("r", 2, at(0), "b"), ("r", 3, at(1), "[1/7] Plan: x"), ("q", 1, at(0), "c"), ("q", 2, at(1), "-> vault"), ("q", 3, at(2), "d")]
    later = [("z", 1, at(40), "[2/7] End: y")]  # the watermark passes the open block of q
    for k, part in enumerate((lines, later)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    drain(runs.preview_blocks(runs.parse_lines(stream)), "blocks", tmp_path)
    want = {("r", "a\nb"), ("q", "c"), ("q", "d")}
    assert {(r.run_id, r.block) for r in spark.table("blocks").collect()} == want
    batch = runs.blocks(spark.createDataFrame(lines + later, schema))
    assert {(r.run_id, r.block) for r in batch.collect()} == want


def test_upsert_keeps_the_latest(spark, tmp_path):
    rows = [(1, 1, "old"), (1, 2, "new"), (2, 1, "only")]
    spark.createDataFrame(rows, "k int, seq int, v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, seq int, v string").parquet(str(tmp_path / "in"))
    finish(runs.upsert_batches(stream, str(tmp_path / "out"), "k", "seq").option("checkpointLocation", str(tmp_path / "state")))
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out/v=0")).collect()} == {(1, "new"), (2, "only")}

from pyspark.sql import functions as F

from riacho.streaming import ingest

SCHEMA = "id long, endpoint string, event_type string, ok boolean, value double, ts timestamp"


def lines(tmp_path, name, rows):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(f'{{"id": {i}, "endpoint": "{e}", "event_type": "row", "ok": {str(ok).lower()}, "value": {v}, "ts": "2024-01-0{d}T00:00:00"}}' for i, e, ok, v, d in rows) + "\n")
    return str(folder)


def test_files_are_ingested_once(spark, tmp_path):
    folder = lines(tmp_path, "a.json", [(1, "a", True, 1, 1), (2, "a", True, 2, 1), (2, "a", True, 2, 1)])
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    ingest.append_once(ingest.read_new(spark, folder, SCHEMA), target, checkpoint, "id").awaitTermination()
    lines(tmp_path, "b.json", [(2, "a", True, 2, 1), (3, "b", True, 3, 2)])
    ingest.append_once(ingest.read_new(spark, folder, SCHEMA), target, checkpoint, "id").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_windows_agree_between_stream_and_table(spark, tmp_path):
    folder = lines(tmp_path, "a.json", [(1, "a", True, 1, 1), (2, "a", True, 2, 1), (3, "b", True, 4, 2)])
    stream = ingest.windowed(ingest.read_new(spark, folder, SCHEMA), "ts", "1 day")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    table = ingest.windowed(spark.read.schema(SCHEMA).json(folder), "ts", "1 day", None)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, table.collect()))


def test_endpoint_state(spark, tmp_path):
    folder = lines(tmp_path, "a.json", [(1, "a", True, 10, 1), (2, "a", False, 0, 1), (3, "a", False, 0, 1), (4, "a", False, 0, 1)])
    stream = ingest.endpoint_health(ingest.read_new(spark, folder, SCHEMA).select("endpoint", "ok", "value"), "endpoint", "ok", "value")
    q = stream.writeStream.format("memory").queryName("h").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("h").filter(F.col("endpoint") == "a").first()
    assert (r.n, r.ema, r.failures, r.tripped) == (4, 10.0, 3, 1)

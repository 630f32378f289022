from datetime import datetime

from cubespark.streaming import aggregate_stream


def test_late_cells_and_closed_bins(spark, tmp_path):
    schema = "time timestamp, bands string, value double"
    (tmp_path / "in").mkdir()
    cells = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file:{tmp_path}/in")
    out = aggregate_stream(cells, period="hour", reducer="mean", keys=["bands"], delay="1 hour")
    q = out.writeStream.outputMode("append").format("memory").queryName("bins").option("checkpointLocation", f"file:{tmp_path}/c").start()
    for i, rows in enumerate([[(datetime(2024, 1, 1, 0, 5), "a", 1.0), (datetime(2024, 1, 1, 0, 50), "a", 3.0)], [(datetime(2024, 1, 1, 5, 0), "a", 9.0)], [(datetime(2024, 1, 1, 0, 7), "a", 99.0), (datetime(2024, 1, 1, 9, 0), "a", 5.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file:{tmp_path}/in/{i}")
        q.processAllAvailable()
    q.stop()
    assert {(r.time, r.value) for r in spark.table("bins").collect()} >= {("2024-01-01-00", 2.0)}

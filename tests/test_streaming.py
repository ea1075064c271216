"""Running measures of a stream against those of all its voxels."""

from voxloom.frame import Frame
from voxloom.operators import measure
from voxloom.streaming import measures


def test_running_measures(spark, tmp_path):
    frame = Frame((2.0, 3.0, 4.0), (6, 6, 6))
    rows = [(k // 36, k // 6 % 6, k % 6, 1 + k % 3) for k in range(216)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], "z int, y int, x int, label long").write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("z int, y int, x int, label long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    running = measures.running_measures(stream, frame)
    query = running.writeStream.outputMode("complete").format("memory").queryName("measures").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    got = {r.label: r for r in spark.table("measures").collect()}
    whole = measure.finished(measure.partial_sums(spark.createDataFrame(rows, "z int, y int, x int, label long"), frame), frame)
    for r in whole.collect():
        assert got[r.label].n == r.n and abs(got[r.label].rg - r.rg) < 1e-9 and abs(got[r.label].com_x - r.com_x) < 1e-9

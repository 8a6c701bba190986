from pointloom import api
from pointloom.operators.spectrum import histogram
from pointloom.streaming.watch import preview_each, running_spectrum, stream_points

SCHEMA = "point_index long, x float, y float, z float, mass float"


def test_running_spectrum_and_previews(spark, tmp_path):
    points = spark.range(1000).selectExpr("id AS point_index", "float(id % 7) AS x", "float(id % 5) AS y", "float(id) AS z", "float(id % 40) AS mass")
    points.where("point_index < 600").write.parquet(str(tmp_path / "in"), mode="append")
    points.where("point_index >= 600").write.parquet(str(tmp_path / "in"), mode="append")
    query = running_spectrum(stream_points(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("spectrum_now").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("spectrum_now").collect())) == sorted(map(tuple, histogram(points).collect()))
    query = preview_each(stream_points(spark, str(tmp_path / "in")), str(tmp_path / "out"), 50, str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert api.headers(spark, str(tmp_path / "out")).selectExpr("sum(original_point_count)").first()[0] == 1000

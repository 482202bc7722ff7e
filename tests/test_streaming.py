import datetime as dt

from fixtures import TRAMS, TARGETS, write

from waymesh.operators.estate import Config
from waymesh.streaming.traces import call_counts, follow_manifests


def test_windowed_counts(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([(at(1), "a", "b"), (at(2), "a", "b"), (at(7), "a", "b"), (at(50), "a", "c")], "ts timestamp, source string, target string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, source string, target string").parquet(str(tmp_path / "in"))
    q = call_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.source, r.target, r["count"]) for r in spark.table("counts").collect()) == [("a", "b", 1), ("a", "b", 2), ("a", "c", 1)]


def test_graph_follows_manifests(spark, tmp_path):
    (tmp_path / "m").mkdir()
    folder, seen = write(tmp_path / "m", TRAMS), []
    follow_manifests(spark, folder, str(tmp_path / "state"), lambda g: seen.append(g.edges.filter("kind = 'http'").count()), Config(TARGETS)).awaitTermination()
    assert seen == [6]

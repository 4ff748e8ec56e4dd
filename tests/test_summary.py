"""The summary of a stream of completions: replayed batches, late and repeated completions, broken writes."""

import pytest

from tracklark.streaming import summary

KIND = "unit string, status string, finished string, duration double"
BATCHES = [
    [("a", "failed", "10:00", 3.0), ("b", "complete", "10:01", 4.0), (None, "complete", "10:01", 1.0)],
    [("a", "complete", "10:30", 5.0), ("b", "complete", "10:01", 4.0), ("c", "failed", None, None)],
    [("a", "failed", "10:00", 3.0), ("d", "complete", "11:00", 1.0), ("d", "failed", "11:00", 2.0)],
]
AFTER = {"a": ("complete", "10:30"), "b": ("complete", "10:01"), "c": ("failed", None), "d": ("failed", "11:00")}


def states(spark, path):
    return {r.unit: (r.status, r.finished) for r in summary.current(spark, path).collect()}


def test_replayed_batches_change_nothing(spark, tmp_path):
    path = f"{tmp_path}/units"
    with pytest.raises(ValueError):
        summary.current(spark, path)
    frames = [spark.createDataFrame(b, KIND) for b in BATCHES]
    for k in (0, 1, 1, 2, 2):
        summary.kept(frames[k], k, path, "unit", "finished")
    assert states(spark, path) == AFTER and summary.versions(spark, path) == [1, 2]
    # A write that breaks off leaves no success mark, and its batch comes again.
    (tmp_path / "units" / "after=3").mkdir()
    assert states(spark, path) == AFTER
    summary.kept(frames[0].limit(0), 3, path, "unit", "finished")
    assert states(spark, path) == AFTER and summary.versions(spark, path) == [2, 3]


def test_a_stream_rewrites_its_report(spark, tmp_path):
    for k, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    seen = []

    def report(units):
        seen.append(units.count())
        return units.groupBy("status").count()

    def go():
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        run = summary.start(stream, f"{tmp_path}/units", f"{tmp_path}/state", "unit", "finished", report, f"{tmp_path}/report", availableNow=True)
        assert run.awaitTermination(120)

    go()
    assert states(spark, f"{tmp_path}/units") == AFTER and len(seen) == 3
    read = lambda: {r.status: int(r["count"]) for r in spark.read.option("header", True).csv(f"{tmp_path}/report").collect()}
    assert read() == {"complete": 2, "failed": 2}
    spark.createDataFrame([("c", "complete", "12:00", 1.0)], KIND).coalesce(1).write.parquet(f"{tmp_path}/in/3")
    go()
    assert read() == {"complete": 3, "failed": 1} and len(seen) == 4

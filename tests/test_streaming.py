"""Streams against what the same files give as a table."""

import os

from geolode.sources import survey
from geolode.streaming import points


def test_cells_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [f"{i},{i % 7},{i % 5},{i % 13}.5,EP" for i in range(60)] + ["# note", "1,x,2,3,CL"]
    for k in range(3):
        (folder / f"{k}.csv").write_text("\n".join(rows[k::3]) + "\n")
    heights = points.cell_heights(points.point_stream(spark, str(folder), files_at_once=1), 2.0)
    run = heights.writeStream.format("memory").queryName("cells").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    table = points.cell_heights(survey.parse_points(survey.read_lines(spark, str(folder)).select("line_number", "line")), 2.0)
    assert sorted(map(tuple, spark.table("cells").collect())) == sorted(map(tuple, table.collect())) != []


def test_late_events_drop_out(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "0.csv").write_text("2024-01-01T00:00:10,a\n2024-01-01T00:00:40,a\n2024-01-01T00:01:10,b\n")
    (folder / "1.csv").write_text("2024-01-01T01:00:00,b\n")
    (folder / "2.csv").write_text("2024-01-01T01:00:30,b\n")
    (folder / "3.csv").write_text("2024-01-01T00:00:20,a\n")
    for k in range(4):
        os.utime(folder / f"{k}.csv", (1_700_000_000 + 60 * k,) * 2)  # files are read oldest first
    s = spark.readStream.schema("t timestamp, k string").option("maxFilesPerTrigger", 1).csv(str(folder))
    run = points.event_counts(s, "t", "k", "1 minute", "5 minutes").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(str(r["from"])[11:16], r.key, r.n) for r in spark.table("counts").collect()} >= {("00:00", "a", 2), ("00:01", "b", 1)}

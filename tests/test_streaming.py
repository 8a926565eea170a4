from datetime import datetime, timedelta

from captide.streaming import windows


def test_windows_and_sessions_over_files(spark, tmp_path):
    t = datetime(2025, 1, 1)
    data = [(1, t, "a"), (1, t + timedelta(seconds=30), "a"), (1, t + timedelta(seconds=200), "b"), (2, t + timedelta(hours=2), "a")]
    spark.createDataFrame(data, "user_id int, ts timestamp, event_type string").write.parquet(str(tmp_path / "events"))
    stream = windows.read_events(spark, str(tmp_path / "events"))
    got = windows.run_to_table(windows.tumbling_counts(stream), spark, ["window_start", "event_type"])
    assert sorted((r.window_start.hour, r.event_type, r.n) for r in got.collect()) == [(0, "a", 2), (0, "b", 1), (2, "a", 1)]
    got = windows.run_to_table(windows.session_counts(windows.read_events(spark, str(tmp_path / "events"))), spark)
    assert sorted((r.user_id, r.n) for r in got.collect()) == [(1, 1), (1, 2)]  # the last one isn't over yet


def test_late_rows_are_dropped_and_changes_replace(spark, tmp_path):
    t = datetime(2025, 1, 1)
    schema = "user_id int, ts timestamp, event_type string"
    for hour in (0, 5, 5, 0):  # a file a batch; the last comes five hours late
        spark.createDataFrame([(1, t + timedelta(hours=hour), "a")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = windows.tumbling_counts(windows.read_events(spark, str(tmp_path / "events"), files=1))
    got = windows.run_to_table(stream, spark, ["window_start", "event_type"])
    assert sorted((r.window_start.hour, r.n) for r in got.collect()) == [(0, 1), (5, 2)]

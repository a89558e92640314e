import os

from pyspark.sql import functions as F

from discursa.streaming import progress

LINES = [
    '[x] 2026/07/11 - 10:00:01 | 200 | POST "/api"', '[x] 2026/07/11 - 10:00:09 | 200 | POST "/api"',
    '[x] 2026/07/11 - 10:00:12 | 200 | POST "/api"', '[x] 2026/07/11 - 99:00:12 | 200 | POST "/api"',
    '[x] 2026/07/11 - 10:00:02 | 200 | GET "/api"', "noise",
    "  100/500  (2.5/s, failed=3)", "  200/500  (2.0/s, failed=4)",
]


def test_stream_over_log_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(LINES[:4]) + "\n")
    (tmp_path / "in" / "b.log").write_text("\n".join(LINES[4:]) + "\n")
    times = progress.parse_requests(progress.stream_lines(spark, str(tmp_path / "in")))
    out = progress.run_available(progress.throughput(times, width="10 seconds").select("start", "n"), ["start"], "t")
    assert sorted(r.n for r in out.collect()) == [1, 2]


def test_unordered_batches_lose_no_row(spark, tmp_path):
    """40 events in 8 files, newest first, in several micro-batches, against the batch result."""
    for k in range(8):
        lines = [f'[x] 2026/07/11 - {23 - (5 * k + i) // 2:02d}:{30 * (i % 2):02d}:00 | POST "/"' for i in range(5)]
        (tmp_path / f"{k}.log").write_text("\n".join(lines) + "\n")
    stream = progress.parse_requests(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path)))
    got = progress.run_counting(stream, lambda b: progress.window_counts(b, width="1 hour"), ["start", "end"], "u")
    want = progress.window_counts(progress.parse_requests(spark.read.text(str(tmp_path))), width="1 hour")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sum(r.n for r in got.collect()) == 40


def test_stream_without_data(spark, tmp_path):
    times = progress.parse_requests(progress.stream_lines(spark, str(tmp_path)))
    assert progress.run_counting(times, progress.window_counts, ["start"], "e").count() == 0


def test_recent_ignores_the_future(spark):
    t = progress.parse_requests(spark.createDataFrame([(x,) for x in LINES], "value string"))
    now = F.lit("2026-07-11 10:00:11").cast("timestamp")
    assert tuple(progress.recent(t, now).collect()[0]) == (2, 3)


def test_progress(spark):
    lines = spark.createDataFrame([(i, "job", x) for i, x in enumerate(LINES)], "seq int, job string, value string")
    row = progress.latest_progress(progress.parse_counters(lines), ["job"], "seq").collect()[0]
    assert (row.done, row.share, row.remaining, row.eta_seconds, row.failure_share) == (200, 0.4, 300, 150.0, 0.02)


def test_observed_counts(spark):
    from pyspark.sql import Observation

    df = spark.range(10)
    obs = Observation("p")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == 10
    assert progress.observed(df, "q", F.col("id") > 5).count() == 10


def test_late_rows_are_counted_apart(spark, tmp_path):
    """Batches a minute apart, then an old one: what is later than a minute behind is late, nothing is lost."""
    batches = [["10:00:01", "10:00:04"], ["10:00:03", "10:02:00"], ["10:00:05", "10:01:30"], ["10:05:00"], ["10:01:30", "10:04:30", "10:00:00"]]
    for k, times in enumerate(batches):
        lines = [f'[x] 2026/07/11 - {t} | POST "/"' for t in times]
        (tmp_path / f"{k}.log").write_text("\n".join(lines) + "\n")
        os.utime(tmp_path / f"{k}.log", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = progress.parse_requests(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path)))
    windows, late = (sorted((f"{r.start:%H:%M:%S}", r.n) for r in x.collect()) for x in progress.run_live(stream, "late"))
    assert late == [("10:00:00", 2), ("10:01:30", 1)]
    assert windows == [("10:00:00", 3), ("10:01:30", 1), ("10:02:00", 1), ("10:04:30", 1), ("10:05:00", 1)]
    every = progress.window_counts(progress.parse_requests(spark.read.text(str(tmp_path)))).agg(F.sum("n")).first()[0]
    assert sum(n for _, n in windows + late) == every == 10


def test_live_stream_without_data(spark, tmp_path):
    windows, late = progress.run_live(progress.parse_requests(progress.stream_lines(spark, str(tmp_path))), "none")
    assert windows.count() == late.count() == 0

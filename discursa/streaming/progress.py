"""Throughput and progress of a running job as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from discursa.session import scratch_path

STAMP = r"(\d{4}/\d{2}/\d{2} - \d{2}:\d{2}:\d{2})"
COUNTER = r"(\d+)/(\d+)\s+\(([\d.]+)/s, failed=(\d+)\)"


def parse_requests(lines: DataFrame, marker: str = "POST", column: str = "value") -> DataFrame:
    """Event times of the log lines that hold a request; unreadable stamps drop out."""
    line = F.col(column)
    stamp = F.regexp_extract(line, STAMP, 1)
    return (
        lines.where(line.contains(marker))
        .select(F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyy/MM/dd - HH:mm:ss")).alias("t"))
        .where(F.col("t").isNotNull())
    )


def throughput(
    events: DataFrame, time: str = "t", width: str = "10 seconds", slide: str | None = None,
    lateness: str = "1 minute",
) -> DataFrame:
    """Requests per (sliding) window; state is bounded by the watermark.

    On batch frames every row counts. On a stream rows that come later than `lateness` behind the
    newest event are not counted: Spark drops them, as their windows are closed. For totals that
    miss no row, however late, give `window_counts` to `run_counting`.
    """
    return window_counts(events.withWatermark(time, lateness), time, width, slide)


def window_counts(
    events: DataFrame, time: str = "t", width: str = "10 seconds", slide: str | None = None
) -> DataFrame:
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return (
        events.groupBy(w.alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def recent(events: DataFrame, now: Column, seconds: int = 10, time: str = "t") -> DataFrame:
    """Requests in the last seconds before `now` (future stamps ignored) and in total."""
    age = F.unix_micros(now) - F.unix_micros(F.col(time))
    return events.agg(
        F.count_if((age >= 0) & (age <= seconds * 1_000_000)).alias("recent"),
        F.count(F.lit(1)).alias("total"),
    )


def parse_counters(lines: DataFrame, column: str = "value") -> DataFrame:
    """done, total, rate, failed of progress lines; other columns are kept."""
    line = F.col(column)

    def part(i: int, kind: str) -> Column:
        return F.regexp_extract(line, COUNTER, i).cast(kind)

    return lines.where(line.rlike(COUNTER)).withColumns(
        {
            "done": part(1, "bigint"),
            "total": part(2, "bigint"),
            "rate": part(3, "double"),
            "failed": part(4, "bigint"),
        }
    )


def latest_progress(counters: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest counters per job with share done, remaining, seconds to go, failure share."""
    last = counters.groupBy(*keys).agg(
        F.max_by(F.struct("done", "total", "rate", "failed"), F.col(order)).alias("m")
    )
    done, total, rate = F.col("m.done"), F.col("m.total"), F.col("m.rate")
    return last.select(
        *keys,
        done.alias("done"),
        (done / total).alias("share"),
        (total - done).alias("remaining"),
        F.when(rate > 0, (total - done) / rate).alias("eta_seconds"),
        F.when(done > 0, F.col("m.failed") / done).alias("failure_share"),
    )


def _drain(stream: DataFrame, name: str, per_batch: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Rows of per_batch for every micro-batch of what a stream holds now, with the batch number.

    Every micro-batch overwrites its own folder (safe to replay); nothing passes through the driver.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-state")
    none = per_batch(spark.createDataFrame([], stream.schema))
    none.write.parquet(f"{out}/batch=-1")  # a stream without data has no batches

    def write(batch: DataFrame, batch_id: int) -> None:
        per_batch(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(f"{none.schema.toDDL()}, batch bigint").parquet(out)


def run_counting(
    stream: DataFrame, count: Callable[[DataFrame], DataFrame], keys: list[str], name: str
) -> DataFrame:
    """Exact counts (keys, n) of all rows of a stateless stream, in whatever order they come.

    Each micro-batch is counted by itself and the counts are summed up: no state is held between
    batches, and no row is too late.
    """
    rows = _drain(stream, name, count, "append")
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"))


def run_live(
    stream: DataFrame, name: str, time: str = "t", width: str = "10 seconds", slide: str | None = None,
    lateness: str = "1 minute",
) -> tuple[DataFrame, DataFrame]:
    """(windows, late) of what a stream holds now, counted live: windows (start, end, n) and late (start,
    end, n), the rows that came after their window was closed.

    A window is closed for a micro-batch when its end lies `lateness` or more behind the newest event of
    the batches before. What a batch counts goes to its own folder, with its newest event; the next ones
    read only these numbers, so state is a row per window and batch, and a batch that is repeated
    after a failure counts the same again. In every window windows.n + late.n is the number of its rows.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-state")
    schema = "start timestamp, end timestamp, n bigint, late boolean, newest timestamp"
    spark.createDataFrame([], schema).write.parquet(f"{out}/batch=-1")  # a stream without data has no batches

    def write(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.schema(f"{schema}, batch bigint").parquet(out).where(F.col("batch") < batch_id)
        closed = before.agg((F.max("newest") - F.expr(f"INTERVAL {lateness}")).alias("closed"))
        # the newest event is the same in every row of a batch: a window over its few counted windows
        counted = window_counts(batch, time, width, slide).withColumn("one", F.lit(1))
        newest = batch.agg(F.max(time).alias("newest"), F.lit(1).alias("one"))
        rows = counted.join(newest, "one").join(closed.withColumn("one", F.lit(1)), "one")
        late = F.coalesce(F.col("end") <= F.col("closed"), F.lit(False)).alias("late")
        rows.select("start", "end", "n", late, "newest").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True)
        .foreachBatch(write).start()
    )
    query.awaitTermination()
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(out).groupBy("start", "end", "late").agg(F.sum("n").alias("n"))
    return rows.where("NOT late").drop("late"), rows.where("late").drop("late")


def run_available(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Drain a stream with update semantics and return its final rows: the newest per key."""
    rows = _drain(stream, name, lambda batch: batch, "update")
    values = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")


def observed(df: DataFrame, name: str, failed: Column) -> DataFrame:
    """Attach row and failure counters that a listener can read while the job runs."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(failed).alias("failed"))


def stream_parquet(spark: SparkSession, glob: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(glob)


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)

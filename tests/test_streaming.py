import pytest
from pyspark.sql import functions as F

from changeweave.operators import changelog, fold
from changeweave.operators.lifecycle import ConflictError
from changeweave.sources import sinks
from changeweave.streaming import apply

from .conftest import SF

COLUMNS = {"val": "has_val", "props": "has_props"}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stream_equals_batch_and_replays(spark, tmp_path):
    log = changelog.from_events(spark, SF)
    log.repartition(4).write.parquet(str(tmp_path / "log"))
    target = apply.UpsertTarget(spark, str(tmp_path / "t"), ["k"], COLUMNS)
    stream = apply.read_changes(spark, str(tmp_path / "log"), log.schema, files_per_batch=2)
    apply.start(stream, target.apply, str(tmp_path / "cp")).awaitTermination()
    want = rows(fold.current_state(log, ["k"], COLUMNS))
    assert rows(target.read()) == want
    again = spark.createDataFrame([(1, 10**9, "delete", None, None, True, True)], log.select("k", "seq", "op", "val", "props", "has_val", "has_props").schema)
    more = again.select(*[F.col(c) if c in again.columns else F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns])
    assert target.apply(more, 99) is True and target.apply(more, 99) is False
    with pytest.raises(ConflictError):
        target.apply(more.withColumn("k", F.lit(2).cast("long")), 99)


def test_guarded_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, 10, "a"), (1, 9, 20, "b"), (1, 7, 30, "c")], "k long, wm long, pos long, digest string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = apply.guarded_stream(apply.read_changes(spark, str(tmp_path / "in"), df.schema), "k", "wm", "pos", "digest")
    stream.writeStream.format("memory").queryName("guarded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [r.decision for r in spark.table("guarded").orderBy("pos").collect()] == ["accept", "accept", "stale"]


def test_snapshots_files_and_fan_out(spark, tmp_path):
    s = sinks.Snapshots(spark, str(tmp_path / "s"))
    assert s.version() == 0 and s.publish(spark.range(3)) == 1 and s.publish(spark.range(5)) == 2
    assert s.read().count() == 5 and s.read(1).count() == 3
    events = spark.read.parquet(f"{SF}/events.parquet")
    sinks.write_files(events, str(tmp_path / "f"), by=[("ts", "month"), ("event_type", None)])
    assert spark.read.parquet(str(tmp_path / "f")).count() == events.count()
    calls = []

    def flaky(df):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("once")
        df.count()

    assert sinks.fan_out(spark.range(2), {"a": flaky, "b": lambda df: df.count()}) == {} and len(calls) == 2
    kept = []
    assert apply.deliver(spark.range(1), 1, lambda df: None, {"x": lambda df: 1 / 0}, lambda df, i, n: kept.append(n), "primary") == ["x"] and kept == ["x"]
    with pytest.raises(ZeroDivisionError):
        apply.deliver(spark.range(1), 1, lambda df: None, {"x": lambda df: 1 / 0}, lambda *a: None)
    with pytest.raises(sinks.UnsupportedTarget):
        sinks.write_files(events, "x", "thrift")


def run(spark, stream, name, tmp_path):
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_stateful_streams_equal_batches(spark, tmp_path):
    from changeweave.streaming import stateful

    log = changelog.from_events(spark, SF).where("k < 4").select("k", "seq", "op", "val", "props", "has_val", "has_props").withColumn("name", F.lpad(F.expr("seq div 250").cast("string"), 3, "0"))
    n = log.select("name").distinct().count()
    for i in range(n):  # files in order of time: one micro-batch each
        log.where(F.col("name") == f"{i:03d}").drop("name").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = lambda: apply.read_changes(spark, str(tmp_path / "log"), log.drop("name").schema, 1)
    got = run(spark, stateful.dedupe_stream(stream(), "k", "seq", 100), "deduped", tmp_path)
    want = sinks.dedupe_window(log, "k", "seq", 100).select(F.col("k").cast("string").alias("k"), "seq", "delivered")
    assert rows(got) == rows(want)
    got = run(spark, stateful.hydrate_stream(stream(), "k", "seq", COLUMNS), "hydrated", tmp_path)
    want = fold.hydrated(log, ["k"], COLUMNS).select(F.col("k").cast("string").alias("k"), "seq", "op", F.col("val").cast("string").alias("val"), "props")
    assert rows(got) == rows(want)


def test_arrow_streams(spark):
    import pyarrow as pa

    got = sinks.arrow_streams(spark.range(10).coalesce(1)).collect()
    assert sum(r.n_rows for r in got) == 10 and pa.ipc.open_stream(got[0].payload).read_all().num_rows == got[0].n_rows

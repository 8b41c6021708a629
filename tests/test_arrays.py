"""Arrays, sources, linear algebra, copies and streams against numpy or values worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import sources, streaming
from tessella.functions import shard_of
from tessella.operators import clusters, linalg, placement

A = np.arange(20).reshape(4, 5) * 3 - 7


def same(grid, want):
    assert np.array_equal(sources.collect(grid), want)


def test_slices_equal_numpy(spark):
    a = sources.array(spark, A)
    same(a[1], A[1])
    same(a[1:4:2], A[1:4:2])
    same(a[:, [3, 0, 3]], A[:, [3, 0, 3]])
    same(a[0:3, 2], A[0:3, 2])
    same(a[1:][:, ::2], A[1:][:, ::2])
    with pytest.raises(IndexError):
        a[0, 0, 0]


@pytest.mark.parametrize("op", ["+", "-", "*", "//", "%"])
def test_arithmetic_equals_numpy(spark, op):
    other = np.where(A % 2 == 0, 3, -2)
    want = {"+": A + other, "-": A - other, "*": A * other, "//": A // other, "%": A % other}[op]
    same(sources.array(spark, A).apply(op, sources.array(spark, other)), want)


def test_assignment_and_layout(spark):
    a, want = sources.array(spark, A), A.copy()
    want[1:3, 0:2] = 9
    same(a.assign((slice(1, 3), slice(0, 2)), 9), want)
    same(a, A)
    same(a.transpose(), A.T)
    same(a.tril(), np.tril(A))
    same(a.reshape(5, 4), A.reshape(5, 4))
    same(a.matmul(a.transpose()), A @ A.T)


def test_npy_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.npy")
    sources.save_npy(sources.array(spark, A), path)
    same(sources.load_npy(spark, path), A)


def test_shards_are_exact(spark):
    for n, shards in ((10, 3), (100, 7), (5, 8)):
        rows = spark.range(n).select("id", shard_of(F.col("id"), n, shards).alias("s")).collect()
        assert all(r["s"] * n // shards <= r["id"] < (r["s"] + 1) * n // shards for r in rows)


def test_uniform_does_not_depend_on_partitions(spark):
    rows = sources.uniform(spark, 1000, 4)
    assert sorted(rows.collect()) == sorted(sources.uniform(spark, 1000, 4).repartition(7).collect())
    assert 0.4 < rows.agg(F.avg("v")).first()[0] < 0.6


def test_graph_and_trace_files(spark, tmp_path):
    (tmp_path / "g.gph").write_text("{8 : 0}, {16 : 1}\n(0,) | {(1) : 100, 1, 0, 0, 0} |  | 0 : : \n(1,) | {(1) : 100, 1, 0, 0, 0} | (0,) | : : 1\n")
    data, tasks = sources.read_graph(spark, str(tmp_path / "g.gph"))
    assert sorted(map(tuple, data.collect())) == [(0, 8, 0), (1, 16, 1)]
    assert tasks.count() == 2
    found = sources.devices(spark, {"CPU": {"num_cores": 48, "mem_sz": 180000000}, "GPU": {"num_devices": 4, "mem_sz": [11000000] * 4}})
    assert [tuple(r) for r in found.orderBy("global_id").collect()][:2] == [(0, "cpu", 0, 180000000, 48000), (1, "gpu", 0, 11000000, 1000)]
    assert found.count() == 5


def test_cholesky_and_fourier(spark):
    rng = np.random.default_rng(10)
    m = rng.random((6, 6))
    m = m @ m.T + np.eye(6)
    rows = [(bi, bj, 2, 2, m[2 * bi : 2 * bi + 2, 2 * bj : 2 * bj + 2].ravel().tolist()) for bi in range(3) for bj in range(3)]
    tiles = spark.createDataFrame(rows, "bi long, bj long, nr int, nc int, data array<double>")
    factor = np.zeros((6, 6))
    for r in linalg.cholesky(tiles, 3).collect():
        factor[2 * r.bi : 2 * r.bi + 2, 2 * r.bj : 2 * r.bj + 2] = np.reshape(r.data, (2, 2))
    assert np.abs(factor @ factor.T - m).max() < 1e-8


def test_kmeans_separates_blobs(spark):
    rng = np.random.default_rng(1)
    points = [(i, (rng.normal(size=3) + 20 * (i % 3)).tolist()) for i in range(90)]
    frame = spark.createDataFrame(points, "id long, x array<double>")
    centres = spark.createDataFrame([(k, points[k][1]) for k in range(3)], "k int, c array<double>")
    centres, found = clusters.kmeans(frame, centres, 3)
    assert centres.count() == 3
    assert all(r["k"] == r["id"] % 3 for r in found.collect())


def test_copies_by_hand(spark):
    held = placement.Copies()
    assert held.write(0) == [("LOAD", 0, -1), ("EVICT", -1, -1)] and held.owner == 0
    assert held.read(1) == [("LOAD", 1, 0)] and held.state == {0: placement.SHARED, 1: placement.SHARED}
    assert held.read(1) == [("NOOP", 1, 1)]
    assert held.evict(1) == [("EVICT", 1, 1)]
    assert held.evict(0, keep=False) == [("ERROR", 0, 0)]
    assert held.evict(0) == [("LOAD", -1, 0), ("EVICT", 0, 0)] and held.state == {-1: placement.MODIFIED}
    accesses = spark.createDataFrame([(1, 0, "write", 0), (1, 1, "read", 1), (2, 0, "read", -1)], "array long, seq long, op string, device int")
    assert placement.coherence(accesses).count() == 4


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = streaming.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="1000 days")
    running = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True)
    running.option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination(120)
    count = lambda frame: sorted((r["start"], r["event_type"], r["n"]) for r in frame.collect())
    assert count(spark.table("windowed")) == count(streaming.windowed(events))


def ran(spark, tmp_path, batch, query, name, mode):
    """What a query over event time gives on a stream of two files."""
    batch.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = query(spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    running = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    running.option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination(120)
    return spark.table(name)


def test_repeated_events_on_a_stream_come_once(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    found = ran(spark, tmp_path, events.unionByName(events), lambda s: streaming.first_seen(s, "1000 days"), "seen", "append")
    assert found.count() == found.select("event_id").distinct().count() == events.count()


def test_sessions_on_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    found = ran(spark, tmp_path, events, lambda s: streaming.sessions(s, late="1000 days"), "sessions", "complete")
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    assert rows(found) == rows(streaming.sessions(events))

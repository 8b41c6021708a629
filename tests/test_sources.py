"""Generated data, files, partitioners, gathers and ranks against numpy or plain Python."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import sources
from tessella.functions import floor_div, floor_mod, shard_of_cell, unravelled
from tessella.operators import clusters, placement, sorting
from tessella.operators.positions import checkpoint_folder, medians, running_sum, with_position


def test_generated_data(spark):
    normal = [r["v"] for r in sources.normal(spark, 4000, 4).collect()]
    assert abs(np.mean(normal)) < 0.06 and abs(np.std(normal) - 1) < 0.05
    numbers = [r["v"] for r in sources.integers(spark, 500, 4, -3, 5).collect()]
    assert set(numbers) == set(range(-3, 5))
    points = sources.blobs(spark, 600, 3, 4, 0.1).collect()
    for label in range(4):
        of = np.array([r["x"] for r in points if r["label"] == label])
        assert len(of) > 80 and of.std(axis=0).max() < 0.2
    assert sorted(map(str, points)) == sorted(map(str, sources.blobs(spark, 600, 3, 4, 0.1).repartition(5).collect()))
    placed = {r["id"]: r["pos"] for r in sources.shuffled(spark.range(50), "id").collect()}
    assert sorted(placed.values()) == list(range(50)) and any(k != v for k, v in placed.items())
    assert np.array_equal(sources.collect(sources.arange(spark, 20, 2, -3)), np.arange(20, 2, -3))
    assert np.array_equal(sources.collect(sources.constant(spark, (2, 3, 4), 1.5)), np.full((2, 3, 4), 1.5))


def test_files_round_trip(spark, tmp_path):
    a = np.arange(12, dtype=np.int64).reshape(3, 4)
    sources.save_raw(sources.array(spark, a), str(tmp_path / "a.bin"))
    assert (tmp_path / "a.bin").read_bytes() == a.tobytes()
    assert np.array_equal(sources.collect(sources.load_raw(spark, str(tmp_path / "a.bin"), "int64", (3, 4))), a)
    config = {"CPU": {"num_cores": 2, "mem_sz": 10}, "GPU": {"num_devices": 1, "mem_sz": [5]}}
    (tmp_path / "d.yaml").write_text(json.dumps(config))
    assert sorted(map(tuple, sources.read_devices(spark, str(tmp_path / "d.yaml")).collect())) == [(0, "cpu", 0, 10, 2000), (1, "gpu", 0, 5, 1000)]
    (tmp_path / "g.gph").write_text("{8 : 0}, {16 : 1}\n(T, (0,), 0) | {(1) : 100, 1, 0, 0, 7} |  | 0 : : \n(T, (1,), 0) | {(1) : 2.5, 0.5, 0, 0, 0} | (T, (0,), 0) | : : 1, 0\n")
    data, tasks = sources.read_graph(spark, str(tmp_path / "g.gph"))
    sources.write_graph(data, tasks, str(tmp_path / "again"))
    data2, tasks2 = sources.read_graph(spark, str(tmp_path / "again"))
    assert sorted(data.collect()) == sorted(data2.collect())
    assert sorted(map(str, tasks.collect())) == sorted(map(str, tasks2.collect()))


def test_integer_division_is_exact(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(-(2**62), 2**62), rng.choice([-(2**61), -7, -1, 1, 3, 10**12])) for _ in range(200)] + [(-(2**63) + 1, 3), (2**63 - 1, -2), (5, 0), (None, 2)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    for r in frame.select("a", "b", floor_div(F.col("a"), F.col("b")).alias("q"), floor_mod(F.col("a"), F.col("b")).alias("m")).collect():
        want = (None, None) if not r["b"] or r["a"] is None else divmod(r["a"], r["b"])
        assert (r["q"], r["m"]) == want


def test_grid_partitions(spark):
    frame = spark.range(5 * 7).select(*[c.alias(n) for n, c in zip("ij", unravelled(F.col("id"), (5, 7)))])
    for r in frame.select("i", "j", shard_of_cell([F.col("i"), F.col("j")], (5, 7), (2, 3)).alias("s")).collect():
        assert r["s"] == ((r["i"] + 1) * 2 - 1) // 5 * 3 + ((r["j"] + 1) * 3 - 1) // 7


def test_gathers_and_methods(spark):
    a = np.array([5, 3, 9, 3, 1, 7])
    grid, index = sources.array(spark, a), np.array([4, -1, 0, 0, 2])
    assert np.array_equal(sources.collect(grid.take(sources.array(spark, index))), a[index])
    places = [i % 6 for i in range(1500)]
    assert np.array_equal(sources.collect(grid[places,]), a[places])
    with pytest.raises(IndexError):
        grid[[0, 6],]
    assert np.array_equal(sources.collect(grid.sort()), np.sort(a))
    assert np.array_equal(sources.collect(grid.argsort()), np.argsort(a, kind="stable"))
    assert [sources.collect(x) for x in sources.array(spark, a.reshape(2, 3))][1].tolist() == [3, 1, 7] and len(grid) == 6
    high, odd = sources.array(spark, a > 3), sources.array(spark, a % 2 == 1)
    assert np.array_equal(sources.collect(high & odd), (a > 3) & (a % 2 == 1))
    assert np.array_equal(sources.collect(high ^ odd), (a > 3) ^ (a % 2 == 1))
    assert np.array_equal(sources.collect(~high), ~(a > 3)) and np.array_equal(sources.collect(~grid), ~a)
    assert np.array_equal(sources.collect(grid & 3), a & 3) and np.array_equal(sources.collect(100 // grid), 100 // a)
    changed = grid.changed("+", 1).update(sources.array(spark, a[:2]))
    assert changed.version == 2 and changed.shape == (2,)
    holes = sources.array(spark, np.array([[2.0, np.nan, 1.0, np.nan], [3.0, 1.0, 1.0, 2.0]]))
    assert {r["i0"]: r["arg"] for r in holes.argmin(1).collect()} == {0: 1, 1: 1}
    assert np.isnan(holes.min().first()["v"]) and {r["i0"]: r["v"] for r in holes.min(1).filter("i0 = 1").collect()} == {1: 1.0}


def test_ranks_and_sums_within_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(40), i) for i in range(300)]
    frame = spark.createDataFrame(rows, "g string, v long, i long").repartition(5)
    found = {r["i"]: r for r in running_sum(frame, F.col("v"), "v", "i", by=["g"]).collect()}
    ranks = {r["i"]: r["pos"] for r in with_position(frame, "v", "i", by=["g"]).collect()}
    for g in ("a", "b", None):
        total = 0
        for n, (_, v, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])):
            total += v
            assert (found[i]["running"], ranks[i]) == (total, n)
    middles = {r["g"]: r["median"] for r in medians(frame, "v", by=["g"]).collect()}
    assert middles == {g: np.median([v for h, v, _ in rows if h == g]) for g in ("a", "b", None)}


def test_quick_sort_with_many_equal_values(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 7, None, rng.randrange(500)]), i) for i in range(400)]
    found = {r["i"]: r["pos"] for r in sorting.quick_sort(spark.createDataFrame(rows, "v long, i long"), "v", "i", least=20).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [i for _, i in want] == sorted(found, key=found.get) and sorted(found.values()) == list(range(400))
    assert sorting.quick_sort(spark.createDataFrame([], "v long, i long"), "v", "i").count() == 0


def test_columns_of_any_name_rank_over_several_ranges(spark):
    rows = [(p, (7 * i + p) % 500) for p in range(2) for i in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, "_part int, v int").withColumns({"_v": F.lit(1), "_run": F.lit(2)}).repartition(4)
        ranks = with_position(frame, "v", by=["_part"])
        assert ranks.columns == ["_part", "v", "_v", "_run", "pos"]
        assert all(r["pos"] == r["v"] for r in ranks.collect())
        events = spark.range(4000).select(F.col("id").alias("event_id"), ((F.col("id") * 7) % 1000).alias("value"))
        placed = sorting.quick_sort(events, "value", "event_id", least=1500).orderBy("value", "event_id").collect()
        assert [r["pos"] for r in placed] == list(range(4000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_device_is_dropped(spark, monkeypatch):
    monkeypatch.setattr(placement, "SENT_DEVICES", 3)
    devices = spark.range(8).selectExpr("int(id) device", "100L memory", "1000L vcus", "id load")
    tasks = spark.createDataFrame([(1, 50, 1000), (2, 50, 1000)], "task long, memory long, vcus long")
    reads = spark.createDataFrame([(1, 7, 8)], "task long, array long, bytes long")
    copies = spark.createDataFrame([(7, 6)], "array long, device int")
    scored = placement.scores(tasks, reads, copies, devices)
    assert scored.count() == 16
    assert placement.choose(scored.filter("task = 1")).first()["device"] == 6
    requests = spark.createDataFrame([(d, s, 30) for d in range(8) for s in range(5)], "device int, seq long, need long")
    admitted = placement.admitted(requests, devices.selectExpr("device", "memory")).collect()
    assert len(admitted) == 40 and all(r["admitted"] == (r["used"] <= 100) for r in admitted)
    late = placement.admitted(spark.createDataFrame([(0, 0, 80), (0, 1, 30), (0, 2, -50)], requests.schema), devices.selectExpr("device", "memory"))
    assert [r["admitted"] for r in late.orderBy("seq").collect()] == [True, False, False]


def test_a_centre_without_points_stays(spark):
    points = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], "id long, x array<double>")
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [900.0, 0.0])], "k int, c array<double>")
    moved = {r["k"]: r["c"] for r in clusters.update(clusters.assign(points, centres), centres).collect()}
    assert moved == {0: [1.5, 0.0], 1: [900.0, 0.0]}


def test_points_without_a_centre(spark):
    rows = [(0, [0.0, 1.0]), (1, None), (2, [1.0]), (3, [None, 1.0]), (4, [float("nan"), 0.0]), (5, [5.0, 5.0]), (6, [2.0, 2.0])]
    points = spark.createDataFrame(rows, "id long, x array<double>")
    centres = spark.createDataFrame([(7, [4.0, 4.0]), (3, [0.0, 0.0])], "k int, c array<double>")
    found = {r["id"]: (r["k"], r["d"]) for r in clusters.assign(points, centres).collect()}
    assert found == {0: (3, 1.0), 5: (7, 2.0), 6: (3, 8.0)} | {i: (None, None) for i in (1, 2, 3, 4)}
    want = {3: [1.0, 1.5], 7: [5.0, 5.0]}
    assert {r["k"]: r["c"] for r in clusters.moved(points, centres).collect()} == want
    assert {r["k"]: r["c"] for r in clusters.update(clusters.assign(points, centres), centres).collect()} == want
    assert clusters.assign(points.limit(0), centres).count() == 0 == clusters.moved(points, centres.limit(0)).count()
    assert all(r["k"] is None for r in clusters.assign(points, centres.limit(0)).collect())
    with np.errstate(invalid="ignore"):
        many = clusters.nearest(np.random.default_rng(0).random((50, 3)), np.random.default_rng(1).random((2000, 3)))
    assert many[0].max() > 50


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_folder(Session())

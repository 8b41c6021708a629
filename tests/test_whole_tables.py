"""Queries whose operands grow with their tables."""

import duckdb
import pytest
from compare import differences

from tessella.operators import graphs, placement
from tessella.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_tree_reaches_its_root(spark):
    found = QUERIES["red_tree_root"](spark, SF).collect()
    top = max(r["level"] for r in found)
    total = spark.read.parquet(f"{SF}/events.parquet").selectExpr("sum(value)").first()[0]
    assert [r["v"] for r in found if r["level"] == top] == [pytest.approx(float(total), abs=1e-3)]


def test_union_holds_all_rows(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert QUERIES["set_union_whole"](spark, SF).count() == events.count() + events.filter("event_type = 'purchase'").count()


def test_every_row_feeds_the_product(spark):
    diagonal = QUERIES["mat_mul_gram"](spark, SF).filter("i0 = i1").agg({"v": "sum"}).first()[0]
    squares = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("sum(aggregate(embedding, 0D, (s, x) -> s + double(x) * double(x)))").first()[0]
    assert diagonal == pytest.approx(squares, abs=1e-2)


def test_grid_shards_of_rows_that_do_not_divide(spark, tmp_path):
    """1 to 13 rows, so that four parts are seldom equal."""
    for n in range(1, 14):
        folder = str(tmp_path / str(n))
        spark.range(n).selectExpr("id as vec_id", "transform(sequence(0, 63), x -> float(x)) as embedding").write.parquet(f"{folder}/embeddings.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
        assert differences(QUERIES["arr_grid_shards"](spark, folder), con, ORACLES["arr_grid_shards"]) == ""


@pytest.mark.parametrize("name", ["graph_array_dependencies", "graph_levels"])
def test_rounds_send_no_table_through_the_driver(spark, monkeypatch, name):
    plans, written = [], graphs.written

    def recorded(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return written(frame)

    monkeypatch.setattr(graphs, "written", recorded)
    found = QUERIES[name](spark, SF)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("name", ["place_scores", "place_single", "place_multi"])
def test_more_tasks_of_the_graph_make_more_spark_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(placement, "TASKS_OF_A_PART", 50, raising=False)
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() == 30


def test_common_options_equal_options_by_task(spark):
    rows = [(t, d, float((7 * t + 3 * d) % 5)) for t in range(40) for d in range(4) if (t + d) % 3] + [(3, 0, 1.0), (5, 2, None), (None, 1, 2.0)]
    scored = spark.createDataFrame(rows, "task long, device int, score double")
    options = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2), (2, 0), (3, 3), (3, 3), (4, None), (5, 2), (5, None)], "option int, device int")
    want = placement.choose_option(scored, spark.range(40).withColumnRenamed("id", "task").crossJoin(options))
    found = placement.choose_option(scored.dropna(subset=["task"]), options)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert found.count() > 10

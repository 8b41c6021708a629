"""The paths that only large tables take, and inputs whose columns clash with helper columns."""

import random
from collections import Counter

import numpy as np
import pytest
from test_operators import ALNUM, LOWER, TEXTS, docs, plain_dedup, prose  # noqa: F401

from tessella.llm import classifier, decontaminate, lines, shards


def rows_of(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_contamination_is_equal_with_and_without_broadcasts(spark, docs):  # noqa: F811
    words = ALNUM.findall(TEXTS[10].translate(LOWER))
    items = [(1, " ".join(words[500:530])), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (3, "one"), (4, "x1 ofa"), (None, " ".join(words[800:812])), (5, None)]
    items = spark.createDataFrame(items, "item_id long, text string")
    sent = rows_of(decontaminate.contamination(docs, items))
    assert sum(r[-1] for r in sent) >= 3
    assert rows_of(decontaminate.contamination(docs, items, broadcast_bytes=0)) == sent


def test_words_do_not_travel_with_shingles(spark, docs, capsys):  # noqa: F811
    items = spark.createDataFrame([(1, prose(2, 40))], "item_id long, text string")
    texts = docs.selectExpr("doc_id", "xxhash64(text) text_id", "split(text, ' ') words")
    needed = decontaminate.windows_of(items).selectExpr("xxhash64(window) window_id", "xxhash64(window[0]) shingle", "0 offset", "10 length", "array_join(window, ' ') phrase")
    decontaminate._verified(texts, needed, 3, small=False).hint("merge").explain("formatted")
    nodes = [n for n in capsys.readouterr().out.split("\n\n") if "Exchange" in n and "hashpartitioning(shingle" in n]
    assert all("words" not in n for n in nodes)


def test_pages_of_equal_keys_do_not_depend_on_partitions(spark):
    rng = random.Random(2)
    rows = [(1, "x" * rng.choice([1, 5, 30, 60, 90, 130])) for _ in range(300)] + [(None, "y" * 40)] * 30 + [(None, f"z{i}") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (rows_of(shards.assign(frame.repartition(n), 128)) for n in (2, 7))
    assert one == two and sum(one.values()) == len(rows)
    sizes, largest = Counter(), Counter()
    for (_, n, shard, _, shard_bytes, fits), times in one.items():
        sizes[shard] += n * times
        largest[shard] = shard_bytes
        assert fits == (shard_bytes <= 128)
    assert sizes == largest
    assert all(n == 130 for (_, n, _, _, _, fits), _ in one.items() if not fits)
    assert len({r[2] for r in one if r[0] is None and r[1] < 40}) > 1  # rows without a key are spread


def test_repeated_keys_equal_their_sql(spark, tmp_path):
    from compare import differences
    from duckdb import connect

    from tessella.llm import queries

    rng = random.Random(4)
    rows = [(7, "a" * rng.choice([100_000, 300_000, 700_000])) for _ in range(12)] + [(None, "b" * 400_000)] * 5 + [(i, "c" * 1000) for i in range(50)] + [(8, None), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert differences(queries.QUERIES["op9_sharding"](spark, str(tmp_path)), con, queries.ORACLES["op9_sharding"]) == ""


def test_line_dedup_keeps_clashing_columns(spark):
    shared = "\n".join(prose(300 + i, 14) for i in range(5))
    rows = [(i, f"head {i}\n{shared}", *["kept"] * 6) for i in (1, 2, None)]
    names = ["_gone", "_gone_doc", "_gone_text", "_text_id", "_text_hash", "text_id"]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    found = {r["doc_id"]: r for r in lines.dedup_lines(frame).collect()}
    assert {k: r["text"] for k, r in found.items()} == plain_dedup({r[0]: r[1] for r in rows})
    assert all(r[n] == "kept" for r in found.values() for n in names)


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_classifier_steps_down_the_risk(prior):
    rng = np.random.default_rng(1)
    positive, unlabelled = rng.normal(1, 1, (40, 6)), rng.normal(0, 1, (90, 6))
    seen = set()
    for _ in range(30):
        w = rng.normal(0, 1, 6)
        parts = [np.array(classifier.risk(w + e, positive, unlabelled, prior)) - classifier.risk(w - e, positive, unlabelled, prior) for e in 1e-5 * np.eye(6)]
        slope = np.array(parts) / 2e-5
        p, u = positive @ w, unlabelled @ w
        first = prior * np.mean([np.log1p(np.exp(-x)) for x in p])
        second = np.mean([np.log1p(np.exp(x)) for x in u]) - prior * np.mean([np.log1p(np.exp(x)) for x in p])
        assert classifier.risk(w, positive, unlabelled, prior) == pytest.approx((first, second))
        seen.add(second >= 0)
        want = slope.sum(1) if second >= 0 else -slope[:, 1]
        assert np.allclose(classifier.step(w, positive, unlabelled, prior), want, atol=1e-5)
    assert prior < 0.5 or seen == {True, False}


def test_classifier_reaches_the_minimum():
    rng = np.random.default_rng(2)
    positive, unlabelled = rng.normal(0.5, 1, (200, 3)), rng.normal(0, 1, (400, 3))
    w = classifier.fit(positive, unlabelled, 0.3, rounds=3000, rate=0.02, ridge=0.0)
    least = sum(max(x, 0) if i else x for i, x in enumerate(classifier.risk(w, positive, unlabelled, 0.3)))
    for _ in range(200):
        other = w + rng.normal(0, 0.3, 3)
        assert least <= sum(max(x, 0) if i else x for i, x in enumerate(classifier.risk(other, positive, unlabelled, 0.3))) + 1e-4


def test_repeated_training_ids_count_once(spark):
    rows = [(i, prose(i, 150) if i % 2 else "junk") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    again = classifier.train(once.unionByName(once), labels.unionByName(labels))
    assert np.allclose(classifier.train(once, labels), again)

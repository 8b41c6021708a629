"""The pipeline's stages decide by row: null ids, repeated rows, one id with two texts."""

from collections import Counter

import corpus_pipeline
import pytest
from test_operators import prose

A, B, C, D = (prose(200 + i, 120) for i in range(4))
SCHEMA = "doc_id long, text string, lang string"


def rows_of(frame):
    return Counter(tuple(r) for r in frame.collect())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    found = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, " ".join(A.split()[20:60]))], "item_id long, text string").write.parquet(f"{found}/benchmark.parquet")
    return found


def test_near_dedup_keeps_one_row_of_a_component(spark, folder):
    rows = [
        (1, A, "x"),
        (2, A, "x"),  # a copy of 1, under an id that has another text
        (2, B, "x"),
        (None, B, "x"),  # a copy of 2's other text
        (None, C, "x"),
        (None, C, "x"),
        (3, D, "y"),
        (3, D, "x"),
        (3, D, "x"),
    ]
    found = rows_of(corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), folder))
    assert found - Counter([(3, D, "x"), (3, D, "y")]) == Counter([(1, A, "x"), (2, B, "x"), (None, C, "x")])
    assert sum(found.values()) == 4 and (found[(3, D, "x")], found[(3, D, "y")]) in ((1, 0), (0, 1))
    again = rows_of(corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows[::-1], SCHEMA).repartition(2), folder))
    assert again == found


def test_decontamination_drops_the_rows_hit_alone(spark, folder):
    rows = [(None, A, "x"), (None, B, "x"), (1, A, "x"), (1, C, "x"), (2, A, "x"), (2, A, "x"), (3, D, "x"), (3, D, "x"), (4, None, "x")]
    found = rows_of(corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), folder))
    assert found == Counter(r for r in rows if r[1] != A)


def test_stages_keep_clashing_columns(spark, folder):
    names = ["_doc", "_text_hash", "_text", "text_id", "_row", "_gone", "_gone_doc", "n_lines", "n_removed", "n_words", "failures", "kept", "fp", "window", "at"]
    extra = ", ".join(f"{n} string" for n in names)
    shared = "\n".join(prose(400 + i, 14) for i in range(5))
    texts = [(1, B), (2, B), (None, C), (None, C), (3, None), (None, None), (4, ""), (5, A), (6, f"{prose(7, 80)}\n{shared}"), (7, f"{prose(8, 80)}\n{shared}")]
    docs = spark.createDataFrame([(*t, len(t[1] or ""), *names) for t in texts], f"doc_id long, text string, n_chars long, {extra}").repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType, name
        for r in out.collect():
            assert [r[n] for n in names] == names and r["n_chars"] == len(r["text"] or ""), name
        found = Counter((r["doc_id"], r["text"]) for r in out.collect())
        want = {
            "quality_rules": Counter(t for t in texts if t[1]),
            "near_dedup": Counter({(1, B): 1, (None, C): 1, (3, None): 1, (5, A): 1, texts[8]: 1, texts[9]: 1}),
            "decontamination": Counter(t for t in texts if t[1] != A),
            "line_dedup": Counter([(1, B), *texts[2:9], (7, prose(8, 80))]),
        }[name]
        assert found == want, name

"""The text queries against their SQL, and the pipeline against a plain version of its stages."""

import base64
import hashlib
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from compare import database, differences
from test_operators import (
    ALNUM,
    LOWER,
    WORD,
    plain_components,
    plain_dedup,
    plain_fingerprint,
    plain_measures,
)

from tessella.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_its_sql(spark, con, name):
    assert differences(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name]) == ""


def good(text):
    n, chars, symbols, repeats, again = plain_measures(text)
    rows = sum(bool(WORD.search(x)) for x in text.split("\n"))
    capitals = sum("A" <= c <= "Z" for c in text)
    return not (n < 50 or 100 * again > 50 * n or 20 * symbols > chars or (rows >= 4 and 2 * repeats > rows) or 2 * capitals > chars or chars > 20 * n or chars < 2 * n)


def plain_pipeline(texts, items):
    texts = {k: t for k, t in texts.items() if t is not None and good(t)}
    cut = plain_dedup(texts)
    texts = {k: t for k, t in cut.items() if WORD.search(t) or t == texts[k]}
    first = plain_components({k: plain_fingerprint(t) for k, t in texts.items()})
    texts = {k: t for k, t in texts.items() if first[k] == k}
    windows = defaultdict(set)
    for item in items:
        w = ALNUM.findall((item or "").translate(LOWER))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[len(w[i : i + 10])].add(tuple(w[i : i + 10]))

    def clean(text):
        w = ALNUM.findall(text.translate(LOWER))
        return not any(tuple(w[i : i + n]) in windows[n] for n in list(windows) for i in range(len(w) - n + 1))

    return {k: t for k, t in texts.items() if clean(t)}


def test_pipeline_equals_its_plain_stages(spark, con):
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    want = plain_pipeline(texts, [t for (t,) in con.execute("SELECT text FROM benchmark").fetchall()])
    assert 0 < len(want) < len(texts)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
    tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(found) == set(want)
    for k, text in want.items():
        ids = tool.encode_ordinary(text)
        assert found[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[k]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns

"""Blocks of many fingerprints: without links, with links in long chains, and beside a dense group."""

import random

import pytest
from test_operators import LONG, plain_components, plain_fingerprint, prose

from tessella.llm import simhash


def golay() -> list[int]:
    """The 4096 words of 24 bits of the extended Golay code: any two differ in 8 bits or more."""
    words = []
    for data in range(1 << 12):
        word, rest = data << 11, data << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= 0b101011100011 << bit - 11
        word |= rest
        words.append(word << 1 | word.bit_count() % 2)
    return words


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def labels_of(spark, prints, **more):
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    return {r["node"]: r["label"] for r in simhash.linked(frame, **more).collect()}


@pytest.mark.parametrize("crowd", [256, 1024])
def test_fingerprints_that_agree_on_40_bits_and_do_not_link(spark, crowd):
    words = golay()
    assert len(set(words)) == 4096 and min((words[1] ^ w).bit_count() for w in words if w != words[1]) == 8
    base = 0xA5A5_1234_9876_0000 << 8 & (1 << 64) - 1
    prints = [base ^ w for w in words]
    assert labels_of(spark, prints, crowd=crowd) == {}
    # One link among them is found, as is one to a neighbour of 4 bits whose own bits lie elsewhere.
    more = [base ^ words[77] ^ 0b101, base ^ words[500] ^ (0xF << 40)]
    found = labels_of(spark, [*prints, *more], crowd=crowd)
    linked = {signed(p): signed(q) for p, q in zip(more, (prints[77], prints[500]), strict=True)}
    assert found == {p: min(a, b) for a, b in linked.items() for p in (a, b)}


@pytest.mark.parametrize("crowd", [40, 100])
def test_crowded_blocks_equal_brute_force(spark, crowd):
    rng, base, prints = random.Random(3), random.Random(4).getrandbits(64), set()
    prints |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(3))) for _ in range(150)}  # a dense group
    prints |= {base ^ rng.getrandbits(30) for _ in range(300)}  # a crowd beside it
    at = base ^ 0xFFFF
    for _ in range(60):  # a chain
        at ^= sum(1 << b for b in rng.sample(range(30), 4))
        prints.add(at)
    values = sorted(map(signed, prints))
    found = labels_of(spark, prints, crowd=crowd)
    assert {p: found.get(p, p) for p in values} == plain_components({p: p & (1 << 64) - 1 for p in values})


def below_broadcasts(plan):
    """The lines of a plan that stand below a broadcast."""
    found, depth = [], None
    for line in plan.split("\n"):
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is None or at <= depth:
            depth = at if "BroadcastExchange" in line else None
        else:
            found.append(line)
    return found


def test_exploded_rows_and_rounds_are_not_broadcast(spark, monkeypatch):
    plans = {"saved": [], "written": []}

    def recorded(name):
        def run(frame):
            found = frame.checkpoint()
            plans[name].append(frame._jdf.queryExecution().executedPlan().toString())
            return found

        return run

    for name in plans:
        monkeypatch.setattr(simhash, name, recorded(name))
    base = 0xA5A5_1234_9876_0000
    labels = labels_of(spark, [base ^ w for w in [*golay()[:600], 0b101]], crowd=40)
    assert labels == dict.fromkeys(map(signed, (base, base ^ 0b101)), signed(base))
    exploded = [p for p in plans["saved"] if "Generate explode" in p]
    assert len(exploded) >= 3 and len(plans["written"]) >= 4
    assert not any("Generate" in line for p in exploded for line in below_broadcasts(p))
    assert not any("Broadcast" in p for p in plans["written"])


def test_any_pair_within_k_bits_shares_a_block_in_every_turn():
    rng = random.Random(9)
    for turn in range(6):
        for agreed in range(1, 6):
            keys = [k % (1 << 64) for k in simhash.block_keys(4, agreed, turn)]
            for _ in range(100):
                d = sum(1 << b for b in rng.sample(range(64), 4))
                assert any(not d & k for k in keys)


def test_pieces_of_a_text_give_its_fingerprint():
    for size in (1, 7, 1000, 1 << 20):
        assert simhash.fingerprint(prose(3, 500), size=size) == plain_fingerprint(prose(3, 500))
        for text in ("", " \n", "one", "one two three", "a b c d", " a  b\tc\nd e "):
            assert simhash.fingerprint(text, size=size) == plain_fingerprint(text)
    assert simhash.fingerprint(LONG, size=5000) == plain_fingerprint(LONG)

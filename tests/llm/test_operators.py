"""Each text operator against a plain version, with nulls, empty and long texts, ties, repeated rows and odd columns."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from tessella.llm import (
    bpe,
    classifier,
    decontaminate,
    licenses,
    lines,
    quality,
    shards,
    simhash,
    token_counts,
    urls,
)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASHES = "fp string, fingerprint string, component_id string, words string, at string, shard string, score string, n_lines string, failures string, window string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "ÉTÉ", "delta,", "x1", "été", "of", "the"]) + rng.choice(["", "a", "b", "c", "zz"]) for _ in range(n))


LONG = prose(1, 30_000)
PASSAGE = "\n".join(prose(100 + i, 14) for i in range(5))
TEXTS = {
    1: prose(2, 80),
    2: prose(2, 80),
    3: prose(2, 80) + " extra",
    4: None,
    5: "",
    6: " \n\t ",
    7: "one",
    8: "head line\n" + PASSAGE + "\ntail of eight",
    9: "another head\n" + PASSAGE + "\n\ntail of nine",
    10: LONG,
    11: "### spam ### " * 60,
    12: "a<|endoftext|>b  \u3000 c\t\n\n d'll 123 ½ \U0001f600",
    13: "Released under the MIT License.\n" + prose(5, 60) + " THIS  work is licensed under the GNU General Public License, version 3.",
    14: prose(6, 20) + " alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda " + prose(7, 20),
    None: prose(8, 70),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", *["x"] * 10) for k, t in TEXTS.items()] + [(1, TEXTS[1], "en", "s", *["x"] * 10)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {CLASHES}").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def rows_of(frame, n=len(TEXTS) + 1):
    found = frame.collect()
    assert len(found) == n
    return {r["doc_id"]: r for r in found}


def test_bpe_equals_tiktoken_and_round_trips(docs, nothing):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = rows_of(bpe.round_trip(docs))
    for k, text in TEXTS.items():
        ids = plain.encode_ordinary(text or "")
        assert found[k]["n_tokens"] == len(ids)
        assert found[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[k]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = bpe.encode_documents(docs)
    assert {k: bytes(r["bytes"]).decode() for k, r in rows_of(bpe.decode_documents(encoded)).items()} == {k: t or "" for k, t in TEXTS.items()}
    assert bpe.round_trip(nothing).count() == 0


def test_bpe_memo_is_only_a_bound():
    small, texts = bpe.Codec(memo=3), [prose(i, 50) for i in range(5)]
    assert list(small.encode(texts)) == list(bpe.Codec().encode(texts))


def test_token_counts_equal_tokenizers(docs, nothing):
    plain = Tokenizer.from_file(token_counts.FILE)
    found = rows_of(token_counts.count_tokens(docs))
    for k, text in TEXTS.items():
        n = len(plain.encode(text or "", add_special_tokens=False))
        assert (found[k]["n_tokens"], found[k]["n_bytes"], found[k]["over_limit"]) == (n, len((text or "").encode()), n > 512)
    assert token_counts.count_tokens(nothing).count() == 0
    assert token_counts.Counter(memo=2).counts([prose(3, 40)] * 2) == [len(plain.encode(prose(3, 40), add_special_tokens=False))] * 2
    assert [sum(map(len, b)) for b in token_counts.balanced({"a" * 9, "b" * 3}, 4)] in ([9, 3], [3, 9])


def plain_fingerprint(text, width=4):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, k=4):
    ids, root = list(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if bin(prints[i] ^ prints[j]).count("1") <= k:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in ids:
        groups[find(i)].append(i)
    return {i: min((x for x in g if x is not None), default=None) for g in groups.values() for i in g}


def test_simhash_components(docs, nothing):
    found = rows_of(simhash.near_duplicates(docs))
    prints = {k: plain_fingerprint(t) for k, t in TEXTS.items()}
    assert {k: r["fingerprint"] for k, r in found.items()} == {k: f"{p:016x}" for k, p in prints.items()}
    assert {k: r["component_id"] for k, r in found.items()} == plain_components(prints)
    assert found[4]["component_id"] == found[6]["component_id"] == 4
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.fingerprint(LONG, size=1000) == plain_fingerprint(LONG)


def test_simhash_chains_and_dense_groups(spark):
    rng, prints = random.Random(7), []
    for _ in range(40):  # clusters around centres, and chains of steps of 4 bits
        at = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            prints.append(at ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(3))))
        for _ in range(5):
            at ^= sum(1 << b for b in rng.sample(range(64), 4))
            prints.append(at)
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    found = {r["node"]: r["label"] for r in simhash.linked(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    assert {p: found.get(p, p) for p in signed} == plain_components({p: p & (1 << 64) - 1 for p in signed})
    for n in (1, 10**5, 10**7, 10**9):
        agreed = simhash.agreeing_groups(n, 4)
        keys = simhash.block_keys(4, agreed)
        assert all(any((a := rng.getrandbits(64)) & k % (1 << 64) == (a ^ d) & k % (1 << 64) for k in keys) for d in (sum(1 << b for b in rng.sample(range(64), 4)) for _ in range(200)))


def plain_measures(text):
    words = WORD.findall(text or "")
    triples, covered = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if triples[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    worded = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(worded) - len(set(worded)), len(covered)


def test_quality_ledger(docs, nothing):
    entries = quality.apply_policy(quality.ledger(docs))
    found = rows_of(entries)
    for k, text in TEXTS.items():
        want = plain_measures(text)
        assert tuple(found[k][c] for c in quality.MEASURES[:5]) == want
        assert found[k]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert found[11]["kept"] is False and found[1]["kept"] is True
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted([k or 0 for k, r in found.items() if r["kept"]] + [1])
    ablated = {r["rule"]: r for r in quality.ablations(entries).collect()}
    bits = [r["failures"] for r in entries.collect()]
    for i, rule in enumerate(quality.rules()):
        assert ablated[rule]["failed"] == sum(b >> i & 1 for b in bits)
        assert ablated[rule]["only_this"] == sum(b == 1 << i for b in bits)
    assert quality.keep_good(nothing).count() == 0


def test_url_rules(spark):
    rng, hosts = random.Random(3), ["com", "example.com", "a.example.com", "b.a.example.com", "notexample.com", "net", "x.net", "", ".com", "com."]
    paths = ["", "/", "/en/", "/en/7", "/en/71/a", "/de/8", "/EN/"]
    urls_ = [f"http://{h.upper() if rng.random() < 0.3 else h}{p}{rng.choice(['', '?q=/en/', '#/en/'])}" for h in hosts for p in paths]
    pages = [(i, u, "k", "p") for i, u in enumerate([*urls_, None, "", "no scheme", "a://b://c/d"] * 2)] + [(None, "http://com/en/", "k", "p")]
    rules = [*urls.RULES, ("block", "a.example.com", "/"), ("allow", "b.a.example.com", "/en"), ("block", "net", ""), ("block", None, "/")]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, key string, path string"), urls.rule_table(spark, rules))
    found = {r["page_id"]: r for r in got.collect()}
    assert len(found) == len(pages)
    for i, u, *_ in pages:
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]) if u and "://" in u else None
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h + p), len(h), a, h + p) for a, h, p in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (found[i]["host"], found[i]["path"]) == (host, path)
        assert (found[i]["rule"], found[i]["verdict"]) == ((best[3], best[2]) if best else (None, "allow")), u
    assert urls.judge(spark.createDataFrame(pages[:0], "page_id long, url string, key string, path string"), urls.rule_table(spark)).count() == 0


def test_contamination(spark, docs, nothing):
    words = WORD.findall(LONG)
    items = [(1, " ".join(words[500:530])), (2, "Alpha beta GAMMA delta epsilon zeta eta theta iota kappa"), (3, "one"), (4, None), (5, " ... "), (None, " ".join(words[800:812])), (6, "x1 ofa"), (2, prose(2, 80)), (7, prose(2, 80))]
    items = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for r in items.collect():
        w = ALNUM.findall((r["text"] or "").translate(LOWER))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(r["item_id"])
    found = rows_of(decontaminate.contamination(docs, items))
    for k, text in TEXTS.items():
        w, hit, of = ALNUM.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    of |= {str(y) for y in windows[x] if y is not None}
        r = found[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(of), bool(hit)), k
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(of)).encode()).hexdigest()
    assert decontaminate.contamination(nothing, items).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs, items.limit(0)).collect())


def plain_dedup(texts, least=50):
    seen, runs_of, order = {}, {}, sorted(texts, key=lambda k: (k is None, k))
    for k in order:
        rows = [(p, x, len(WORD.findall(x))) for p, x in enumerate((texts[k] or "").split("\n")) if WORD.search(x)]
        runs = set()
        for i in range(len(rows)):
            for span in ([(i, j + 1) for j in range(i, len(rows))], [(j, i + 1) for j in range(i, -1, -1)]):
                runs |= set([s for s in span if sum(r[2] for r in rows[slice(*s)]) >= least][:1])
        runs_of[k] = rows, runs
        for a, b in sorted(runs):
            seen.setdefault(tuple(r[1] for r in rows[a:b]), (k, a))
    out = {}
    for k in order:
        rows, runs = runs_of[k]
        gone = {rows[i][0] for a, b in runs if seen[tuple(r[1] for r in rows[a:b])] != (k, a) for i in range(a, b)}
        out[k] = texts[k] and "\n".join(x for p, x in enumerate(texts[k].split("\n")) if p not in gone)
    return out


def test_line_dedup(docs, nothing):
    found = rows_of(lines.dedup_lines(docs))
    assert {k: r["text"] for k, r in found.items()} == plain_dedup(TEXTS)
    assert found[8]["n_removed"] == 0 and found[9]["n_removed"] == 5 and found[2]["text"] == "" and found[4]["text"] is None
    assert set(docs.columns) <= set(lines.dedup_lines(docs).columns)
    assert lines.dedup_lines(nothing).count() == 0


def test_line_dedup_random(spark):
    rng, texts = random.Random(5), {}
    pool = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 3, 9, 30, 60]))) for _ in range(12)] + ["", " "]
    for k in range(40):
        texts[k] = "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 40)))
    texts[40], texts[41] = "\n".join(["tick"] * 130), "\n".join(["tick"] * 60)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(frame).collect()} == plain_dedup(texts)


def test_shards(spark, docs, nothing):
    found = shards.assign(docs, 4000).collect()
    assert len(found) == len(TEXTS) + 1
    sizes = Counter()
    for r in found:
        sizes[r["shard"]] += r["n_bytes"]
        key = hashlib.md5(TEXTS[None].encode()).hexdigest() if r["doc_id"] is None else str(r["doc_id"])  # by text without an id
        digest = int(hashlib.md5(key.encode()).hexdigest()[:15], 16)
        assert r["shard"] == f"{digest:060b}"[: r["depth"]]
    assert all(r["shard_bytes"] == sizes[r["shard"]] and (r["fits"] or r["doc_id"] == 10) for r in found)
    names = sorted(sizes)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    assert shards.assign(nothing).count() == 0
    same = spark.createDataFrame([(1, "x" * n) for n in (30, 30, 60, 60, 90)] * 4, "doc_id long, text string")
    filled = shards.assign(same, 100).collect()
    assert len(filled) == 20 and all(r["fits"] for r in filled) and sum(r["n_bytes"] for r in filled) == 1080


def test_shard_files(spark, docs, tmp_path):
    shards.write_shards(docs, str(tmp_path / "out"), 4000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and set(docs.columns) <= set(back.columns)


def test_licenses(docs, nothing):
    found = rows_of(licenses.scan_licenses(docs))
    assert found[13]["licenses"] == "GPL-3.0,MIT" and found[13]["n_licenses"] == 2 and found[13]["coverage"] == 1.0
    assert [tuple(s) for s in found[13]["spans"]][0] == ("MIT/notice", 1.0, 0, 4)
    assert all(r["n_licenses"] == 0 and r["best"] is None for k, r in found.items() if k != 13)
    assert licenses.scan_licenses(nothing).count() == 0


def test_patience_alignment():
    text, template = "a x b c q d e".split(), "a b c d e".split()
    assert licenses.align(text, template) == [(0, 0), (2, 1), (3, 2), (5, 3), (6, 4)]
    assert licenses.align([], template) == licenses.align(text, []) == []
    assert licenses.increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, body in licenses.TEMPLATES.items():
        broken = body.replace(" the ", " THE\n* ")
        spans = scanner.scan(f"{prose(1, 300)} {broken} {prose(2, 300)} {body}")
        assert sum(s[0] == name for s in spans) == 2, name
    cut = " ".join(licenses.TEMPLATES["MIT"].split()[:40])
    assert not [s for s in scanner.scan(cut) if s[0] == "MIT"]


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    weights = classifier.train(documents, labels)
    scored = classifier.classify(documents, weights).join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = (scored.score[scored.quality == q].to_numpy() for q in (1, 0))
    assert len(bad) and (good[:, None] > bad[None]).mean() > 0.95
    assert (scored.predicted == scored.quality).mean() > 0.9
    flipped = labels.selectExpr("doc_id", f"case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality")
    assert np.array_equal(weights, classifier.train(documents, flipped))


def test_classifier_edges(docs, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (None, 1), (9, None)], "doc_id long, quality int")
    weights = classifier.train(docs, labels)
    assert all(0 <= r["score"] <= 1 for r in rows_of(classifier.classify(docs, weights)).values())
    assert classifier.classify(nothing, weights).count() == 0
    assert not classifier.train(docs, labels.limit(0)).any()
    assert len(classifier.features("")) == len(classifier.features("a b")) == classifier.DIM

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from causeway.llm import simhash
from causeway.llm.components import connected_components


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (id, fingerprint)"""
    ids = [r[0] for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            k = find(i)
            least[k] = min(least.get(k, ids[i]), ids[i])
    return [(ids[i], f"{rows[i][1]:016x}", least.get(find(i))) for i in range(len(rows))]


def key(r):
    return tuple((x is None, x) for x in r)


def check(frame):
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in frame.select("doc_id", "text").collect()]
    got = [tuple(r) for r in simhash.near_duplicates(frame).collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)


def test_documents(docs):
    check(docs)


def test_odd_rows(odd):
    check(odd)


def test_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.deduplicate(empty).columns == empty.columns


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("max_bucket", [3, simhash.MAX_BUCKET, 10**6])
def test_links_give_all_components(spark, max_bucket):
    rng = random.Random(1)
    fps = set()
    for _ in range(20):
        base = rng.getrandbits(64)
        for _ in range(40):  # crowds around a centre, chains, and both segments touched
            x = base
            for _ in range(rng.randrange(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    crowd = rng.getrandbits(64)
    fps |= {crowd ^ 1 << i ^ 1 << j for i in range(32) for j in range(i)}  # one segment shared by hundreds
    fps = sorted(fps)
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = {r["node"]: r["root"] for r in connected_components(simhash.links(frame, max_bucket)).collect()}
    want = brute_components([(signed(x), x) for x in fps])
    by = {}
    for i, _, c in want:
        by.setdefault(c, set()).add(i)
    got = {}
    for x in map(signed, fps):
        got.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, by.values()))


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(1000, 1001), (7, 7), (None, 3)], "a long, b long"))
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


def test_deduplicate_keeps_one_of_each_group(docs, odd):
    for frame in (docs, odd):
        classes = {r["component_id"] for r in simhash.near_duplicates(frame).collect() if r["doc_id"] is not None}
        kept = simhash.deduplicate(frame)
        assert kept.columns == frame.columns
        assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(classes)


def test_rows_without_an_id_stay(spark):
    for more in ([], [(5, "p q r"), (5, "p q r")]):
        frame = spark.createDataFrame([(None, "x y z"), (None, "x y z"), *more], "doc_id long, text string")
        for similarity in (None, 0.8):
            got = sorted(map(tuple, simhash.deduplicate(frame, similarity=similarity).collect()), key=str)
            assert got == sorted([(None, "x y z"), (None, "x y z"), *more[:1]], key=str)


def test_deletion_variants_propose_what_is_compared_by_shingles(spark):
    """Nodes of one fingerprint, and of fingerprints that differ by 2 bits, are proposed; those that differ by 3 are not."""
    rows = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 0b11), (5, 0b111 << 20), (6, 0b1), (6, 0b1)], "fp long, h long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.proposed(rows)).collect()}
    assert len({roots[k] for k in (1, 2, 3, 4, 6)}) == 1 and 5 not in roots


def test_stage_asks_deletion_variants(spark, monkeypatch):
    seen, plain = [], simhash.proposed
    monkeypatch.setattr(simhash, "proposed", lambda rows: seen.append(rows) or plain(rows))
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "x y z")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.deduplicate(docs, similarity=0.8).collect()) == [1, 3] and len(seen) == 1

import random

import corpus_pipeline as pipeline
from causeway.llm import simhash


def brute_shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows, similarity=0.8):
    """The least id of each row's component: links of all pairs."""
    sets = [brute_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def check(frame):
    rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    want = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar(frame, 0.8).collect()} == want
    kept = simhash.deduplicate(frame, similarity=0.8)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_documents(docs):
    check(docs)


def test_near_copies_of_the_pipeline_are_dropped(spark, docs):
    """Pairs of similarity 0.8 or more that are more than 2 bits apart."""
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = set(brute(rows).values())
    bits = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert want < bits
    assert {r["doc_id"] for r in pipeline.near_duplicates(spark, docs, "").collect()} == want


def test_clouds_chains_and_short_texts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = ["", None, " \n", "one two", "One  two", "one two three four five", "one two three four five six"]
    for _ in range(6):
        base = [word() for _ in range(120)]
        for _ in range(60):  # a cloud around a text; its members are about as near to each other as the rule asks
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    for _ in range(12):
        w = [word() for _ in range(100)]
        for _ in range(5):  # a chain, whose ends are far apart
            texts.append(" ".join(w))
            w = [*w[8:], *(word() for _ in range(8))]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_odd_rows(odd, empty):
    assert simhash.similar(odd, 0.8).count() == odd.count()
    assert simhash.similar(empty, 0.8).collect() == []


def test_shingles_are_not_written_for_texts_that_share_no_key(spark, monkeypatch):
    from causeway.llm import minhash

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    alone = [" ".join(word() for _ in range(200)) for _ in range(20)]
    twin = [word() for _ in range(200)]
    # Ids that are null or name two texts must still lead to the right shingles.
    rows = [*enumerate(alone), (3, " ".join(twin)), (100, " ".join([*twin[1:], word()])), (None, " ".join([*twin[2:], word()])), (None, alone[7] + " " + word())]
    written, held = {}, {}

    def spy(df, label):
        out = minhash_materialize(df, label)
        written[label], held[label] = out.columns, out.count()
        return out

    minhash_materialize = minhash.materialize
    monkeypatch.setattr(minhash, "materialize", spy)
    monkeypatch.setattr(simhash, "materialize", spy)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["component_id"]) for r in simhash.similar(frame, 0.8).collect()}
    assert {(3, 3), (100, 3), (None, 3), (None, 7), (7, 7)} <= found
    assert "s" not in written["signatures"] and "s" in written["sets"] and held["sets"] == 5

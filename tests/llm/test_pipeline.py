import re

import corpus_pipeline as pipeline
from causeway.llm import bpe, mixing, pii, toxicity
from causeway.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def firsts(rows):
    """The least id of each group of texts that are linked by a Jaccard similarity of 0.8 on five words, by all pairs."""
    sets = []
    for doc_id, text in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets.append((doc_id, {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}))
    root = {d: d for d, _ in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, x) in enumerate(sets):
        for e, y in sets[:i]:
            if 10 * len(x & y) >= 8 * len(x | y):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return [d for d in root if root[d] == d]


def test_stages_by_hand(spark, docs):
    """Each stage's decisions against the operator's own judgement of the same input."""
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "pii", "mixing", "byte_bpe"]
    one = stages["toxicity"](spark, docs, SF).cache()
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in docs.collect() if model.score(r["text"]) < 0.5}
    two = stages["near_duplicates"](spark, one, SF).cache()
    assert {r["doc_id"] for r in two.collect()} == set(firsts([(r["doc_id"], r["text"]) for r in one.collect()]))
    three = stages["pii"](spark, two, SF).cache()
    found = pii.fit(two)
    texts = {r["doc_id"]: pii.redacted(r["text"], found) for r in two.collect()}
    assert {r["doc_id"]: r["text"] for r in three.collect()} == texts
    assert all(r["n_chars"] == len(r["text"]) for r in three.collect())
    four = stages["mixing"](spark, three, SF).cache()
    taken = {r["doc_id"] for r in mixing.mix(three, pipeline.MIX_WEIGHTS, share=pipeline.MIX_SHARE, epochs=1, seed=pipeline.MIX_SEED).collect()}
    assert {r["doc_id"] for r in four.collect()} == taken and 0.8 * three.count() < four.count() <= three.count()
    five = stages["byte_bpe"](spark, four, SF)
    codec = bpe.codec(pipeline.public_tokenizers.path(pipeline.VOCABULARY), pipeline.public_tokenizers.PATTERN)
    assert {r["doc_id"]: r["n_tokens"] for r in five.collect()} == {r["doc_id"]: len(codec.encode(r["text"])) // 4 for r in four.collect()}
    for frame in (one, two, three, four):
        assert frame.columns == docs.columns and frame.dtypes == docs.dtypes
    assert sorted(pipeline.run(spark, SF).collect()) == sorted(five.collect())


def test_odd_rows_and_no_rows(spark, odd, empty):
    for frame in (odd, empty):
        docs = frame
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() <= frame.count()


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11)) and set(ORACLE) <= set(QUERIES)

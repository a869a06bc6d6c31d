import random
import re

from causeway.llm import substring


def brute_units(rows):
    out = []
    for doc_id, text in dict.fromkeys(rows):
        at, i = 0, 0
        for unit in re.split(r"(?<=[.!?])\x20|\n", text) if text is not None else []:
            plain = " ".join(x for x in re.split(r"[\x20\x09-\x0D]+", unit.lower()) if x)
            if plain:
                out.append((doc_id, text, i, at, at + len(unit), plain))
                i += 1
            at += len(unit) + 1
    return out


def brute(rows, least=substring.MIN_WORDS):
    first, count = {}, {}
    units = brute_units(rows)
    for d, _, _, a, _, p in units:
        k = (d is None, d, a)
        count[p] = count.get(p, 0) + 1
        if p not in first or (k[0], k[1] or 0, k[2]) < (first[p][0], first[p][1] or 0, first[p][2]):
            first[p] = k
    out, run, before = [], [], None
    for d, t, i, a, z, p in [*units, (None, None, None, None, None, None)]:
        again = p is not None and (d, a) != first[p][1:]
        if run and not (again and before == (d, t, i - 1)):
            if sum(len(x[-1].split(" ")) for x in run) >= least:
                out += [(d_, a_, z_, first[p_][1], first[p_][2]) for d_, _, _, a_, z_, p_ in run]
            run = []
        if again:
            run.append((d, t, i, a, z, p))
            before = (d, t, i)
    return sorted(out, key=str)


def check(frame):
    rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    assert sorted(map(tuple, substring.removed(frame).collect()), key=str) == brute(rows)


def test_documents(docs):
    check(docs)


def test_odd_rows(odd, empty):
    check(odd)
    assert substring.removed(empty).collect() == []


def test_ties_nulls_and_offsets(spark):
    rng = random.Random(1)
    lines = [" ".join(rng.choice("abcdefg") * 3 for _ in range(rng.randrange(5, 14))) for _ in range(12)]
    rows = [(rng.choice([None, *range(20)]), "\n".join(rng.choice([rng.choice(lines), rng.choice(lines).upper() + "\t ", "", "é short. ", "A. B! c? d.  e. f", "One two. " + rng.choice(lines) + ". Last one."]) for _ in range(rng.randrange(0, 6)))) for _ in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check(frame)


def test_passages_go_and_chance_repeats_stay(spark):
    """A passage pasted into a line goes, a line of short sentences goes, a short line that many texts share stays."""
    rng = random.Random(2)
    sentence = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)).capitalize() + "."
    passage = [sentence(12) for _ in range(5)]
    short = " ".join(sentence(3) for _ in range(10))
    motto = sentence(9)
    texts = [f"{sentence(8)} {' '.join(passage)} {sentence(7)}\n{motto}", short + "\n" + sentence(9), f"{sentence(8)} and so {' '.join(passage)[9:]} {sentence(8)}", f"{sentence(4)}\n{short}", f"{motto}\n{sentence(30)}", f"{sentence(30)}\n{motto}"]
    rows = substring.removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    gone = {}
    for r in rows:
        gone.setdefault(r["doc_id"], []).append(texts[r["doc_id"]][r["start"] : r["end"]])
    assert sorted(gone) == [2, 3]
    assert set(gone[2]) == set(passage[1:]) and " ".join(sorted(gone[3], key=short.index)) == short


def test_cleaned_texts_keep_original_offsets(spark, docs):
    gone = {}
    for r in substring.removed(docs).collect():
        gone.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"] + 1))
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = substring.cleaned(docs)
    assert rows.columns == [*docs.columns, "kept_spans"]
    for r in rows.collect():
        text = before[r["doc_id"]]
        assert r["text"] == "".join(text[a:z] for a, z in r["kept_spans"]) == "".join(c for i, c in enumerate(text) if i not in gone.get(r["doc_id"], ()))

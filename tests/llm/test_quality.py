import re

import numpy as np

from causeway.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for t in tri:
        seen[t] = seen.get(t, 0) + 1
    inside = {j for i, t in enumerate(tri) if seen[t] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def check(frame, rules=()):
    got = sorted([tuple(r) for r in quality.assess(frame, list(rules)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()], key=str)
    want = []
    for r in frame.select("doc_id", "text").collect():
        b = brute(r["text"])
        want.append((r["doc_id"], *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    assert got == sorted(want, key=str)


def test_documents(docs):
    check(docs)


def test_odd_rows(odd, empty):
    check(odd)
    assert quality.assess(empty, []).collect() == []


def test_kept_equals_the_rules_by_plain_code(docs, labels):
    """What a learnt list keeps, from statistics counted anew and the list's own thresholds, the first rule first."""
    rules = quality.fit(docs, labels)
    share = lambda a, b: np.floor(a / b * 1e6 + 0.5) / 1e6 if b else 0.0
    got = {r["doc_id"]: (r["kept"], r["rule"]) for r in quality.assess(docs, rules).collect()}
    for r in docs.collect():
        t = r["text"]
        n, chars, symbols, dup, repeat = brute(t)
        lines = len([x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        count = lambda p: len(re.findall(p, t))  # noqa: B023, E731
        x = dict(zip(quality.STATISTICS, (share(symbols, chars), share(dup, lines), share(repeat, n), share(chars, n), share(len(set(re.findall(r"[^\x20\x09-\x0D]+", t))), n), share(count("[A-Z]"), chars), share(count("[|]"), n), share(count("!"), n), share(count("[0-9]"), chars)), strict=True))
        first = next((k for k, rule in enumerate(rules, 1) if all((x[c] >= v) if above else (x[c] <= v) for c, above, v in rule.literals)), 0)
        assert got[r["doc_id"]] == (n >= 50 and 100 * repeat <= 50 * n and first == 0, first)
    assert rules and {k for k, _ in got.values()} == {True, False}


def test_learnt_rules_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(docs, labels)
    assert rules
    rows = quality.assess(docs, rules).join(labels.where(quality.fold("doc_id") == 0), "doc_id").where("not base_failed").collect()
    q, kept = np.array([r["quality"] for r in rows]), np.array([r["kept"] for r in rows])
    assert kept[q == 1].mean() > 0.99 and kept[q == 0].mean() < 0.25


def test_covering_takes_rules_in_order():
    rng = np.random.default_rng(0)
    x = rng.random((900, len(quality.STATISTICS)))
    bad = (x[:, 0] > 0.8) | ((x[:, 3] < 0.2) & (x[:, 5] > 0.5))
    rules = quality.learn(x, bad)
    covered = np.zeros(len(x), bool)
    for r in rules:
        covered |= r.mask(x)
    assert len(rules) >= 2 and (covered & bad).sum() / bad.sum() > 0.8 and (covered & ~bad).sum() / (~bad).sum() < 0.05
    assert quality.learn(x[:0], bad[:0]) == [] and quality.learn(x, np.zeros(900, bool)) == []


def test_no_python_in_the_plan(docs):
    plan = quality.assess(docs, [])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan

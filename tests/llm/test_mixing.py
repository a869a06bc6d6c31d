import hashlib
import re
from collections import defaultdict

from causeway.llm import mixing


def fill(given, kids):
    """kids: {name: (weight, capacity)}; water-filling by rounds."""
    out = dict.fromkeys(kids, 0.0)
    live = {k for k, (w, c) in kids.items() if w > 0 and c > 0}
    while live and given > 1e-9:
        total = sum(kids[k][0] for k in live)
        full = {k for k in live if kids[k][1] - out[k] <= given * kids[k][0] / total + 1e-9}
        if not full:
            for k in live:
                out[k] += given * kids[k][0] / total
            break
        for k in full:
            given -= kids[k][1] - out[k]
            out[k] = float(kids[k][1])
        live -= full
    return out


def brute(rows, weights, share, epochs, seed):
    docs = []
    for doc_id, text, lang, source in rows:
        lang, source = lang or "?", source or "?"
        m = re.search("([0-9]+)$", source)
        docs.append((doc_id, f"domain{int(m[1]) % 4 if m else 0}", lang, source, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    n = defaultdict(int)
    for d in docs:
        n[d[1:4]] += d[4]
    n = {k: v for k, v in n.items() if v}
    w = lambda level, name: weights.get(level, {}).get(name, 1.0)
    given = {(): float(min(int(sum(n.values()) * share), sum(n.values()) * epochs))}
    for depth, level in enumerate(mixing.LEVELS):
        new = {}
        for parent, budget in given.items():
            kids = defaultdict(int)
            for k, v in n.items():
                if k[:depth] == parent:
                    kids[k[depth]] += v * epochs
            for name, b in fill(budget, {x: (w(level, x), c) for x, c in kids.items()}).items():
                new[(*parent, name)] = b
        given = new
    out = []
    for leaf, budget in given.items():
        whole, part = divmod(int(round(budget, 3)), n[leaf])
        mine = [d for d in docs if d[1:4] == leaf]
        key = lambda d: hashlib.md5(f"{seed}:{whole}:{'?' if d[0] is None else d[0]}".encode()).hexdigest()
        for d in mine:
            total = sum(x[4] for x in mine if key(x) <= key(d))
            copies = whole + (d[4] > 0 and total <= part)
            if copies:
                out.append((*d, copies))
    return sorted(out, key=str)


def check(frame, weights, share, epochs):
    rows = [tuple(r) for r in frame.select("doc_id", "text", "lang", "source").collect()]
    got = sorted(map(tuple, mixing.mix(frame, weights, share, epochs, 3).collect()), key=str)
    assert got == brute(rows, weights, share, epochs, 3)


def test_documents(docs):
    check(docs, {"domain": {"domain1": 3.0}, "lang": {"en": 4.0}}, 0.5, 1)
    check(docs, {"domain": {"domain1": 9.0}}, 0.9, 3)


def test_shortages_go_to_siblings_then_ancestors(spark):
    rows = []
    for i in range(400):
        lang, source = [("en", "src1"), ("en", "src5"), ("de", "src1"), ("fr", "src2"), (None, None)][min(i % 9, 4)]
        rows.append((i, "w " * (i % 23), lang, source))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for share, epochs in ((0.3, 1), (0.8, 1), (1.0, 2), (1.7, 2), (5.0, 2)):
        check(frame, {"domain": {"domain1": 5.0}, "lang": {"de": 3.0}, "source": {"src5": 0.5}}, share, epochs)


def test_odd_rows(odd, empty):
    check(odd, {}, 0.5, 2)
    assert mixing.mix(empty).collect() == []

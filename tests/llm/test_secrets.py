import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from causeway.llm import secrets
from causeway.llm._base import starts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def brute(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def check(frame):
    rows = secrets.scan(frame)
    got = sorted([tuple(r) for r in rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.written("base").cast("binary"), 256)).collect()], key=str)
    want = []
    for r in frame.select("doc_id", "text").collect():
        base = brute(r["text"] or "")
        written = ",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in base)
        want.append((r["doc_id"], *(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(written.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_documents(docs):
    check(docs)


def test_odd_rows(odd, empty):
    check(odd)
    assert secrets.scan(empty).collect() == []


def test_made_up_texts(spark):
    rng = random.Random(8)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "abc", "abcdef1", "AKIA", "AKIA" + "Z" * 17, "0a" * 12, "é", "\U0001f600", ".", "-"]
    frame = spark.createDataFrame([(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 30)))) for i in range(1500)], "doc_id long, text string")
    check(frame)


def test_many_spans_in_one_text(spark):
    text = "token=abcdef1 é " * 3000
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in row["base"]] == [(16 * k, 0, 16 * k + 13) for k in range(3000)]


def test_running_sums(spark):
    rows = spark.createDataFrame([([],), ([5],), (list(range(1000)),), ([1] * 256,), ([2] * 257,)], "x array<bigint>")
    for r in rows.select("x", starts(F.col("x")).alias("s")).collect():
        assert r["s"] == [sum(r["x"][:k]) for k in range(len(r["x"]))]


def entropy(s, alphabet, window=secrets.WINDOW):
    best = -1.0
    for k in range(len(s) - window + 1):
        w = [c if c in alphabet else "" for c in s[k : k + window]]
        best = max(best, -sum(w.count(c) / window * math.log2(w.count(c) / window) for c in set(w)))
    return best


def test_incremental_entropy_equals_recounting(spark):
    rng = random.Random(9)
    symbols = secrets.CLASSES["alnum"][1]
    strings = ["".join(rng.choice(symbols[: rng.choice([2, 8, 62])] + "-") for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    frame = spark.createDataFrame([(s,) for s in strings], "s string")
    for r in frame.select("s", secrets.peak_entropy(F.col("s"), symbols).alias("e")).collect():
        assert abs(r["e"] - entropy(r["s"], symbols)) < 1e-6


def test_entropy_spans_and_allow_list(spark):
    rng = random.Random(10)
    key = "".join(rng.choice(secrets.CLASSES["base64"][1]) for _ in range(44))
    texts = [f"use {key} now", "an ordinarylongwordwithoutdigits here", "id 123e4567-e89b-12d3-a456-426614174000 end", "password=" + key, "see this_is_a_long_path/with_words_12", "12345678901234567890123456"]
    rows = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [tuple(x) for x in rows[0]["found"]] == [(4, 3, 48)]
    assert [rows[k]["n_entropy"] for k in range(6)] == [1, 0, 0, 0, 0, 0]
    assert [x["kind"] for x in rows[3]["found"]] == [0]


def allowed(s):
    """The allow-list by plain code: no digit or no letter, words joined by marks, identifiers, placeholders."""
    if not any(c.isdigit() for c in s) or not any(c.isalpha() for c in s):
        return True
    first, *rest = re.split("[_/=+-]+", s)
    word = lambda x, least: (m := re.fullmatch("([0-9]*)([A-Za-z]*)([0-9]*)", x)) and len(m[2]) >= least and (len(m[3]) <= 4 or not m[2])
    if word(first, 1) and all(word(x, 0) for x in rest):
        return True
    if re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s):
        return True
    return any(x in s.lower() for x in ("example", "placeholder", "changeme", "dummy", "xxxx", "0000", "1234567"))


def brute_spans(t):
    base = brute(t)
    out = list(base)
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t):
        s = m[0]
        if allowed(s) or any(a < m.end() and z > m.start() for a, _, z in base):
            continue
        for _, symbols, least in secrets.CLASSES.values():
            x = s.lower() if len(symbols) == 16 else s
            if set(x) <= set(symbols):
                if entropy(x, symbols) >= least - 1e-9:
                    out.append((m.start(), 3, m.end()))
                break
    return sorted(out)


def test_all_spans_equal_plain_code(spark, docs):
    rng = random.Random(11)
    bits = ["-", "_", "/", "=", "+", " ", " ", "password=", "example", "0000", "word", "Key1", "ab12345", "deadBEEF01", "9f"]
    token = lambda: "".join(rng.choice(rng.choice(["0123456789abcdef", secrets.CLASSES["alnum"][1], secrets.CLASSES["base64"][1], "ab1"])) for _ in range(rng.randrange(18, 50)))
    texts = ["".join(rng.choice([*bits, token()]) for _ in range(rng.randrange(1, 12))) for _ in range(600)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for frame in (docs.select("doc_id", "text"), made):
        want = {r["doc_id"]: brute_spans(r["text"]) for r in frame.collect()}
        assert {r["doc_id"]: [tuple(x) for x in r["found"]] for r in secrets.scan(frame).collect()} == want
    assert sum(s[1] == 3 for x in want.values() for s in x) > 30


def test_tokens_of_any_length(spark):
    """Tokens of a hundred thousand characters of each class and of joined words, which no pattern may recurse into."""
    rng = random.Random(12)
    many = lambda symbols: "".join(rng.choices(symbols, k=100_000))
    texts = ["ab" + "-c1" * 40_000, "a/" * 60_000, "x=1" * 40_000, "1" * 100_000, "é" * 100_000, "AKIA" + "Z" * 100_000, "token=" + "a." * 50_000, many("0123456789ABCDEF"), many(secrets.CLASSES["alnum"][1]), many(secrets.CLASSES["base64"][1])]
    rows = {r["doc_id"]: [tuple(x) for x in r["found"]] for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[k] for k in range(5)] == [[], [], [], [(0, 2, 100_000)], []]
    assert rows[5] == [(0, 1, 100_004)] and rows[6] == [(0, 0, 100_006)]
    for k in (7, 8, 9):
        base = brute(texts[k])
        assert rows[k] == (base if base or allowed(texts[k]) else [(0, 3, 100_000)])


def test_no_python_in_the_plan(docs):
    plan = secrets.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan

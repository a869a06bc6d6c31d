import hashlib
import random
import re
import time

from causeway.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checked(digits):
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1]))
    return 12 <= len(digits) <= 19 and total % 10 == 0


def brute(t):
    only = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if checked(only(m))]
    return sorted(out + [(3, *m.span()) for m in PHONE.finditer(t) if 9 <= len(only(m)) <= 15])


def test_base_spans_equal_plain_matching():
    rng = random.Random(3)
    bits = ["1", "2", "25", "256", ".", ".", "@", "a", "b.c", "-", " ", "+", "(", ")", "é", "4111111111111111", "12.3"]
    for _ in range(8000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 40)))
        base, more = pii.scan(t)
        assert sorted(base) == brute(t)
        assert not any(a < z2 and a2 < z for _, a, z in more for _, a2, z2 in base)


def test_long_texts_take_linear_time():
    began = time.time()
    for t in ("a1" * 500_000, "1" * 500_000, "1." * 250_000, "a@" * 250_000, "+1" + " " * 500_000, "(123) " * 100_000, "a." * 250_000 + "@", "a at " * 100_000):
        pii.scan(t)
    assert time.time() - began < 20


def check(frame, model):
    got = sorted([tuple(r)[:6] for r in pii.detect(frame, model).collect()], key=str)
    want = []
    for r in frame.select("doc_id", "text").collect():
        base = brute(r["text"] or "")
        written = ",".join(f"{pii.KINDS[k]}:{a}:{z}" for k, a, z in sorted(base, key=lambda s: (s[1], s[0])))
        want.append((r["doc_id"], *(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(written.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_documents(docs):
    check(docs, pii.fit(docs))


def test_odd_rows(docs, odd, empty):
    model = pii.fit(docs)
    small = odd.where("doc_id is null or doc_id <> 11")  # the plain pattern needs quadratic time there
    check(small, model)
    assert pii.detect(empty, pii.fit(empty)).collect() == []
    assert pii.redact(odd, model).columns == odd.columns and pii.redact(odd, model).count() == odd.count()


def test_labelers_add_spans_and_spare_look_alikes(spark):
    rows = []
    for k in range(400):
        rows += [f"call +1 (555) 555-{k:04d} now", f"phone (555) 555-{k:04d} today", f"please call 555-555-{k:04d} soon", f"order no 123{k:04d}99x"]
        rows += [f"mail to ab{k}@mail.example.com thanks", f"email joe{k} [at] example [dot] com please", f"version 1.2.3.{300 + k}"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    model = pii.fit(frame)
    got = {r["doc_id"]: r["spans"] for r in pii.detect(frame, model).collect()}
    assert all(got[i].startswith("phone:6:") for i in range(1, len(rows), 7))
    assert all(got[i] == "" for i in range(3, len(rows), 7))
    assert all(got[i].startswith("email:6:") for i in range(5, len(rows), 7))
    assert all(got[i] == "" for i in range(6, len(rows), 7))
    text = pii.redacted("mail ab@c.de or +1 (555) 555-0000.", model)
    assert text == "mail <EMAIL> or <PHONE>." and pii.redacted(None, model) is None

"""Personal data by weak supervision.

Base spans follow fixed patterns and always count.  Looser candidates (numbers without a
country prefix, obfuscated addresses, numbers that fail a checksum, dotted quads out of range)
and the base spans are voted on by labelers: the strict pattern, a checksum, gazetteers of
known prefixes and domains, words before the span, and what touches it.  How often each
pattern of votes occurs is counted over the whole corpus by Spark; the number of patterns is
bounded by the number of labelers, not by the data.  Expectation-maximisation on these counts
estimates how reliable each labeler is, and the soft labels train a logistic classifier of
spans on votes and shape.  A candidate that it accepts adds a span; a base span never goes.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import bounded_batches

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# A match never starts inside a run of digits: what follows a run decides for all its starts alike.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_WRITTEN_OUT = re.compile(r"[\[(]at[\])]|\x20dot\x20", re.IGNORECASE)
_LOOSE_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,5}\)[\x20.-]?[0-9]{2,4}[\x20.-]?[0-9]{3,4}|[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}|0[0-9]{1,4}[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,4})(?![\w-])")
_LOOSE_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?\[dot\]\x20?|\x20?\(dot\)\x20?|\x20dot\x20)[A-Za-z0-9-]{2,63}){1,4}"
    r"|\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20dot\x20[A-Za-z0-9-]{2,63}){1,4})(?!\w)",
    re.IGNORECASE,
)

#: Words that speak for a kind when one stands shortly before a span, and words that speak against any.
FOR = {
    "email": {"mail", "email", "e-mail", "contact", "write", "reach", "correo", "courriel", "kontakt"},
    "ip": {"ip", "host", "server", "address", "addr", "from", "node", "peer", "client"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "carte", "tarjeta", "karte"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "dial", "telefon", "telefono", "téléphone"},
}
AGAINST = {"version", "isbn", "issn", "doi", "order", "invoice", "ticket", "build", "release", "section", "figure", "page", "v", "no", "nr"}
#: Generic and country domains that are common, and leading digits of card issuers.
DOMAINS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "us", "info", "co", "it", "nl", "ch", "at"}
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "30")

_BEFORE = 48
_WORDS = re.compile(r"[\w-]+")
N_LABELERS = 6


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping matches in linear time: the part before @ holds no @, so each @ is tried once."""
    done = 0
    at = text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            start = at
            while start > done and not _NOT_LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
                at = text.find("@", done)
                continue
        done = at + 1
        at = text.find("@", done)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and further candidates, each ``(kind, start, end)``; the further ones overlap no base span of any kind."""
    text = text or ""
    written_out = _WRITTEN_OUT.search(text)
    if not written_out and not _ANY.search(text):
        return [], []
    base, more = [(0, a, z) for a, z in _emails(text)], []
    for m in _IP.finditer(text):
        ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
        (base if ok else more).append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() >= 12 else ""
        if 12 <= len(digits) <= 19:
            (base if luhn(digits) else more).append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        (base if 9 <= len(_digits(m[0])) <= 15 else more).append((3, m.start(), m.end()))
    more += [(3, m.start(), m.end()) for m in _LOOSE_PHONE.finditer(text)]
    if written_out:
        more += [(0, m.start(), m.end()) for m in _LOOSE_EMAIL.finditer(text)]
    taken = sorted((a, z) for _, a, z in base)
    free, k, last = [], 0, -1
    for kind, a, z in sorted(set(more), key=lambda s: (s[1], -s[2], s[0])):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a >= last and (k == len(taken) or taken[k][0] >= z):
            free.append((kind, a, z))
            last = z
    return base, free


def votes(text: str, kind: int, a: int, z: int, strict: bool) -> tuple[str, int]:
    """The labelers' votes, one character each (p for, n against, 0 none), and the span's shape bucket."""
    span, name = text[a:z], KINDS[kind]
    digits = _digits(span)
    out = ["p" if strict else "n"]
    if name == "card":
        out += ["p" if luhn(digits) else "n", "p" if digits.startswith(ISSUERS) else "n"]
    elif name == "ip":
        parts = [int(p[:6]) for p in span.split(".")]
        out += ["p" if max(parts) <= 255 else "n", "n" if parts[0] == 0 or max(parts) < 10 else "p"]
    elif name == "email":
        out += ["p" if "." in span.rpartition("@")[2] else "0", "p" if re.split(r"[.\s)\]]", span)[-1].lower() in DOMAINS else "n"]
    else:
        out += ["p" if 9 <= len(digits) <= 15 else "n", "p" if span[0] in "+(" else "0"]
    words = [w.lower() for w in _WORDS.findall(text[max(0, a - _BEFORE) : a])][-5:]
    out.append("p" if any(w in FOR[name] for w in words) else "0")
    out.append("n" if any(w in AGAINST for w in words[-2:]) else "0")
    around = text[a - 1 : a] + text[z : z + 1]
    out.append("n" if any(c.isalnum() or c in "_/=" for c in around) else "p")
    return "".join(out), min(len(digits) // 4, 5) * 3 + min(sum(not c.isalnum() for c in span), 5) // 2


def patterns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(kind, votes, shape, n)`` counted over every candidate of every text."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            base, more = scan(t)
            out.append([(s[0], *votes(t, *s, strict)) for strict, spans in ((True, base), (False, more)) for s in spans])
        return pd.Series(out)

    found = F.pandas_udf(run, "array<struct<kind:int, votes:string, shape:int>>")(F.col(text_col))
    rows = bounded_batches(docs).select(F.explode(found).alias("c")).groupBy("c.kind", "c.votes", "c.shape").agg(F.count("*").alias("n"))
    return rows.select("kind", "votes", "shape", "n")


@dataclass
class Model:
    """Reliabilities by kind (rate of each vote given personal or not) and the classifier's weights."""

    prior: dict[int, float]
    rates: dict[int, np.ndarray]
    weights: dict[int, np.ndarray]

    def probability(self, kind: int, vote: str, shape: int) -> float:
        w = self.weights.get(kind)
        if w is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(_encode([vote], [shape])[0] @ w, -30, 30))))


_CODE = {"0": 0, "p": 1, "n": 2}


def _encode(vote: list[str], shape: list[int]) -> np.ndarray:
    x = np.zeros((len(vote), 1 + 2 * N_LABELERS + 18))
    x[:, 0] = 1
    for i, (v, s) in enumerate(zip(vote, shape, strict=True)):
        for k, c in enumerate(v):
            if c != "0":
                x[i, 1 + 2 * k + (c == "n")] = 1
        x[i, 1 + 2 * N_LABELERS + s] = 0.5
    return x


def fit(docs: DataFrame, text_col: str = "text", rounds: int = 50) -> Model:
    """Counts vote patterns over all of ``docs``, runs expectation-maximisation and trains the classifier.

    A kind without candidates has no classifier and accepts nothing.
    """
    rows = sorted(tuple(r) for r in patterns(docs, text_col).collect())  # at most 3^6 votes x 18 shapes a kind
    model = Model({}, {}, {})
    for kind in range(len(KINDS)):
        mine = [r for r in rows if r[0] == kind]
        if not mine:
            continue
        v = np.array([[_CODE[c] for c in r[1]] for r in mine])
        n = np.array([r[3] for r in mine], float)
        q = np.clip(((v == 1).sum(1) - (v == 2).sum(1)) * 0.2 + 0.5, 0.05, 0.95)
        for _ in range(rounds):
            prior = ((q * n).sum() + 1) / (n.sum() + 2)
            rates = np.empty((2, N_LABELERS, 3))
            for y, weight in ((0, (1 - q) * n), (1, q * n)):
                for k in range(N_LABELERS):
                    # Pseudo-counts say that a labeler is right rather more often than wrong.
                    seen = np.bincount(v[:, k], weight, 3) + [4, 4 if y else 1, 1 if y else 4]
                    rates[y, k] = seen / seen.sum()
            log = [np.log(rates[y, np.arange(N_LABELERS), v]).sum(1) + np.log(prior if y else 1 - prior) for y in (0, 1)]
            q = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
        x = _encode([r[1] for r in mine], [r[2] for r in mine])
        weight, w = n / n.sum() * len(n), np.zeros(x.shape[1])
        for _ in range(500):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= 0.5 * (x.T @ ((p - q) * weight) / len(n) + 1e-3 * w)
        model.prior[kind], model.rates[kind], model.weights[kind] = float(prior), rates, w
    return model


def spans(text: str | None, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and accepted further ones of a text."""
    base, more = scan(text)
    return base, [s for s in more if model.probability(s[0], *votes(text, *s, False)) >= 0.5]


def _written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in sorted(found, key=lambda s: (s[1], s[0], s[2])))


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, a row for each row of ``docs``.

    Counts and the digest are of base spans, ``spans`` of all.  A null text is as an empty
    one: no spans.  Null ids and repeated rows stay.  Offsets are code points, ends exclusive.
    """
    kinds = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, more = spans(t, model)
            rows.append((*(sum(s[0] == k for s in base) for k in range(len(KINDS))), hashlib.sha256(_written(base).encode()).hexdigest(), _written(base + more)))
        return pd.DataFrame(rows, columns=[k.split()[0] for k in kinds.split(", ")])

    return bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.pandas_udf(run, kinds)(F.col(text_col)).alias("p")).select("doc_id", "p.*")


def redacted(text: str | None, model: Model) -> str | None:
    if text is None:
        return None
    base, more = spans(text, model)
    out, at = [], 0
    for kind, a, z in sorted(base + more, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        if z > at:
            at = z
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``<KIND>``; overlapping spans by the first's kind."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted(t, model) for t in texts], dtype=object)

    return bounded_batches(docs).withColumn(text_col, F.pandas_udf(run, T.StringType())(F.col(text_col)))

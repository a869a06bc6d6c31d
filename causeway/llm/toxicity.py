"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and texts of unknown label (U) train a linear classifier in numpy.
With the class prior pi, the risk of taking U as negative is corrected by what P explains of
it; where that corrected part turns negative the classifier is fitting U's hidden positives,
and the step goes the other way (the non-negative estimator).

Features are words (lower case, without surrounding punctuation) and their prefixes of
4 to 6 characters, present or absent.  The corpus-side work is distributed: features of the
confirmed texts are the candidates, and in how many texts each occurs is counted over all texts,
added up by task before the shuffle.  Only the gradient steps see a bounded sample: the driver gets
the chosen features of ``MAX_POSITIVE`` confirmed and ``MAX_UNLABELLED`` other texts.  Labels are read only
from rows of folds other than 0; the score of a text depends on the text alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import bounded_batches, discard, fold, materialize

#: Bounds of the two samples that the gradient steps see, in rows, taken by the least hash of the id.
MAX_POSITIVE, MAX_UNLABELLED = 4096, 8192
#: A candidate occurs in as many confirmed texts.
MIN_SEEN = 5
#: Features kept, ranked by how much more of P than of all texts they are in, in standard errors, and the least of that.
#: Features of U alone are left out: thousands of small negative weights would hide one toxic phrase in a long text.
MAX_FEATURES, MIN_LIFT = 4096, 4.0
PREFIXES = (4, 5, 6)
_AROUND = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
_REMEMBERED = 1 << 17


def features(word: str) -> list[int]:
    """The hashes of a word and of its prefixes; none for a word of punctuation."""
    w = word.strip(_AROUND)
    if not w:
        return []
    return [xxhash.xxh32_intdigest(x) for x in (w, *(f"{w[:n]}-" for n in PREFIXES if len(w) > n))]


@F.pandas_udf(T.ArrayType(T.LongType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted({f for w in set((t or "").lower().split()) for f in features(w)}) for t in texts])


@dataclass
class Model:
    bias: float
    weights: dict[int, float]
    prior: float
    n_positive: int
    n_unlabelled: int
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, w: str) -> float:
        found = sum(self.weights.get(f, 0.0) for f in features(w))
        if len(self.known) >= _REMEMBERED:
            self.known.clear()
        self.known[w] = found
        return found

    def logit(self, text: str | None) -> float:
        known, word = self.known, self.word
        return self.bias + sum(sorted([known[w] if w in known else word(w) for w in set((text or "").lower().split())]))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -30, 30))))

    def column(self, text: str):
        weights, bias, prior = self.weights, self.bias, self.prior

        def run(texts: pd.Series) -> pd.Series:
            m = Model(bias, weights, prior, 0, 0)
            return pd.Series([m.score(t) for t in texts], dtype="float64")

        return F.pandas_udf(run, T.DoubleType())(F.col(text))


def train(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, steps: int = 300, rate: float = 0.05, prior_strength: float = 0.175) -> tuple[float, np.ndarray]:
    """Full-batch Adam on the non-negative risk with the logistic loss; returns bias and weights.

    The weights have a prior of one strength, so its decay falls with the number of positives.
    """
    length = np.fromiter(map(len, rows), np.int64, len(rows))
    column = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), length)
    w, b = np.zeros(n_features), 0.0
    p, u = positive, ~positive
    n_p, n_u = max(p.sum(), 1), max(u.sum(), 1)
    decay = prior_strength / n_p
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        z = np.clip(b + np.bincount(row, w[column], len(rows)), -30, 30)
        s = 1 / (1 + np.exp(-z))
        minus = np.logaddexp(0, z)  # loss if taken as negative
        negative_part = minus[u].sum() / n_u - prior * minus[p].sum() / n_p
        as_positive = np.where(p, prior * (s - 1) / n_p, 0)
        as_negative = np.where(u, s / n_u, -prior * s / n_p)
        g = as_positive + as_negative if negative_part >= 0 else -as_negative
        grad = np.append(np.bincount(column, g[row], n_features) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return float(b), w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from ``labels`` (an id column of the same name, ``toxic`` 0/1/null) of folds other than 0.

    Without a positive (no labels, an empty table) the model gives every text the score 0
    rounded up by the sigmoid's clip, as nothing can be learnt.  Null ids and texts are left out; of an id that
    names several texts one counts in the samples.
    """
    known = labels.where(F.col(id_col).isNotNull() & (fold(id_col) != 0) & F.col("toxic").isNotNull())
    seen = known.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("k")).first()
    prior = min(max((seen["k"] or 0) / max(seen["n"], 1), 1e-3), 0.9)
    ranked = [F.xxhash64("id"), F.col("id")]
    pos = known.where("toxic = 1").select(F.col(id_col).alias("id")).distinct().orderBy(*ranked).limit(MAX_POSITIVE).withColumn("p", F.lit(1))
    rest = docs.where(F.col(id_col).isNotNull() & (fold(id_col) != 0))
    un = rest.select(F.col(id_col).alias("id")).distinct().orderBy(*ranked).limit(MAX_UNLABELLED).withColumn("p", F.lit(0))
    texts = bounded_batches(rest).where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    sample = texts.join(F.broadcast(pos.union(un)), "id").select("id", "p", _features("t").alias("f"))
    sample = materialize(sample.groupBy("id", "p").agg(F.min("f").alias("f")), "features")
    size = {r["p"]: r["n"] for r in sample.groupBy("p").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = size.get(1, 0), size.get(0, 0)
    if not n_p or not n_u:
        return Model(-30.0, {}, prior, n_p, n_u)
    seen = sample.where("p = 1").select(F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("a")).where(F.col("a") >= MIN_SEEN)
    seen = {r["f"]: r["a"] for r in seen.collect()}  # bounded by the sample of confirmed texts
    every = {r["f"]: r["n"] for r in frequencies(texts, frozenset(seen)).collect()}  # a row for each candidate
    n_all = every.pop(_TEXTS, 0)

    def lift(f: int) -> float:
        a, b = seen[f], every.get(f, 0)
        return (a / n_p - b / n_all) / ((a + b + 1) / (n_p + n_all) * (1 / n_p + 1 / n_all)) ** 0.5

    chosen = sorted((f for f in seen if lift(f) >= MIN_LIFT), key=lambda f: (-lift(f), f))[:MAX_FEATURES]
    index = {f: i for i, f in enumerate(chosen)}
    kept = F.array_intersect("f", F.array(*map(F.lit, chosen))) if chosen else F.array().cast("array<bigint>")
    rows = sample.select("id", "p", kept.alias("f")).orderBy("p", "id").collect()
    discard(sample)
    bias, w = train([np.array([index[f] for f in r["f"]], np.int64) for r in rows], np.array([r["p"] == 1 for r in rows]), len(chosen), prior)
    return Model(bias, {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-6}, prior, n_p, n_u)


#: Stands for the number of texts among the features' counts.
_TEXTS = -1


def frequencies(texts: DataFrame, candidates: frozenset[int]) -> DataFrame:
    """``(f, n)``: in how many of the texts ``t`` each candidate occurs, and how many texts there are under -1.

    A task adds up its own texts, so it sends a row for each candidate at most.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, known = Counter(), {}
        for frame in frames:
            counts[_TEXTS] += len(frame)
            for t in frame["t"]:
                here: set[int] = set()
                for w in set(t.lower().split()):
                    found = known.get(w)
                    if found is None:
                        if len(known) >= _REMEMBERED:
                            known.clear()
                        found = known[w] = [f for f in features(w) if f in candidates]
                    here.update(found)
                counts.update(here)
        yield pd.DataFrame({"f": list(counts), "n": list(counts.values())}, dtype="int64")

    return texts.select("t").mapInPandas(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, a row for each row of ``docs``.

    A null text is as an empty one and scores the bias alone.  A null id is not held out.
    """
    rows = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), model.column(text_col).alias("score"))
    return rows.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; columns as given."""
    return bounded_batches(docs).withColumn("__toxic", model.column(text_col)).where("__toxic < 0.5").drop("__toxic")

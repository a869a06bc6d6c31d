"""Quality rules: a learned decision list over text statistics, with DataFrame functions only.

Statistics of a text are array functions of its words.  Sequential covering learns from a
bounded sample of labelled statistics: a rule grows by the threshold that gains most
information on the growing part, is pruned on the other part, and takes what it covers away
before the next one.  The list is emitted as one ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import WORD, fold

#: Bound of the labelled sample, in rows, taken by the least hash of the id.
MAX_LABELLED = 8192
MAX_RULES, MAX_LITERALS, BINS = 12, 3, 32
#: What the learner sees; each is a share or a mean, so that it does not grow with a text.
STATISTICS = ("symbol_share", "dup_line_share", "repeat_share", "mean_word", "distinct_share", "upper_share", "bar_share", "bang_share", "digit_share")


def _count(text: str, pattern: str) -> Column:
    """Characters of a class, as what a text loses without them."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _triples(values: str, join) -> Column:
    """``join`` of each window of three elements; null for fewer.  No lambda refers to a column, so moving it keeps it linear."""
    n = F.size(values) - 2
    first = F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(2), n), join)
    return F.when(n > 0, F.zip_with(first, F.slice(values, F.lit(3), n), join))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, <STATISTICS>)``, a row for each row of ``docs``.

    A null text has no words and zero everywhere, as an empty one.  Null ids and repeated
    rows stay; other columns are not read; nothing is shuffled.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), t.alias("t"))
    rows = rows.select("doc_id", "t", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    # A window's hash chains those of its words; equal windows have equal hashes, so a text without equal hashes has no repeat.
    rows = rows.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    n = F.size("w")
    rows = rows.withColumn("tri", _triples("h", lambda a, b: F.xxhash64(a, b)))
    windows = F.transform(_triples("w", lambda a, b: F.concat(a, F.lit(" "), b)), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    rows = rows.withColumn("s", F.when(F.size("tri") > F.size(F.array_distinct("tri")), F.sort_array(windows)))
    # Equal windows stand side by side; of each such pair, both windows' words are inside.
    span = lambda x: [x["i"], x["i"] + 1, x["i"] + 2]
    pair = lambda a, b: F.when(a["w"] == b["w"], F.array(*span(a), *span(b))).otherwise(F.array().cast("array<int>"))
    inside = F.array_distinct(F.flatten(F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), pair)))
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count("t", "[#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(inside), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("h")).alias("n_distinct"),
        *[_count("t", p).alias(c) for c, p in (("n_upper", "[A-Z]+"), ("n_bar", "[|]+"), ("n_bang", "!+"), ("n_digit", "[0-9]+"))],
    )
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("word_chars", "n_words").alias("mean_word"),
        share("n_distinct", "n_words").alias("distinct_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_bar", "n_words").alias("bar_share"),
        share("n_bang", "n_words").alias("bang_share"),
        share("n_digit", "word_chars").alias("digit_share"),
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(statistic, at_least, threshold)``; what it covers is of low quality."""

    literals: tuple[tuple[str, bool, float], ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, value in self.literals:
            out = out & ((F.col(name) >= value) if above else (F.col(name) <= value))
        return out

    def mask(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, value in self.literals:
            v = x[:, STATISTICS.index(name)]
            out &= (v >= value) if above else (v <= value)
        return out


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(x: np.ndarray, bad: np.ndarray, min_precision: float = 0.9, min_cover: int = 5) -> list[Rule]:
    """An ordered list of rules for ``bad`` rows by sequential covering; two rows of three grow rules, the third prunes them."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    prunes = np.arange(len(x)) % 3 == 2
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1))) if len(x) else np.empty(0) for j in range(len(STATISTICS))]
    if bad.any():  # cuts among the bad rows too: they may be few
        cuts = [np.unique(np.concatenate([c, np.quantile(x[bad, j], np.linspace(0, 1, BINS + 1))])) for j, c in enumerate(cuts)]
    while len(rules) < MAX_RULES:
        grow, prune = left & ~prunes, left & prunes
        if (bad & grow).sum() < min_cover:
            break
        literals: list[tuple[str, bool, float]] = []
        inside = grow.copy()
        while len(literals) < MAX_LITERALS and (inside & ~bad).any():
            p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
            best = (1e-9, None, None)
            for j, name in enumerate(STATISTICS):
                for value in cuts[j]:
                    for above in (True, False):
                        m = inside & ((x[:, j] >= value) if above else (x[:, j] <= value))
                        p, n = int((m & bad).sum()), int((m & ~bad).sum())
                        if p >= min_cover and (g := _gain(p0, n0, p, n)) > best[0]:
                            best = (g, (name, above, float(value)), m)
            if best[1] is None:
                break
            literals.append(best[1])
            inside = best[2]

        def worth(some: list, where: np.ndarray) -> float:
            m = Rule(tuple(some), 0, 0).mask(x) & where
            p, n = int((m & bad).sum()), int((m & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(literals) > 1 and worth(literals[:-1], prune) >= worth(literals, prune):
            literals.pop()
        covers = Rule(tuple(literals), 0, 0).mask(x) & left
        p, n = int((covers & bad).sum()), int((covers & ~bad).sum())
        if not literals or p + n == 0 or p / (p + n) < min_precision:
            break
        rules.append(Rule(tuple(literals), p / (p + n), p + n))
        left &= ~covers
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Rules learnt from ``labels`` (an id column of the same name, ``quality`` 0/1/null) outside fold 0; none without labels.

    An id that names several rows of ``docs`` counts once, with the least of their statistics; one with
    several labels is of low quality if any says so.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & (fold(id_col) != 0))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("__quality"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(MAX_LABELLED)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("__id"), "left_semi")
    found = statistics(rows).join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    one = found.where("n_words > 0").groupBy("doc_id").agg(F.min(F.struct("__quality", *STATISTICS)).alias("s"))
    got = one.select("s.*", F.xxhash64("doc_id").alias("h"), "doc_id").collect()  # a row for each id of the sample
    got = sorted((tuple(r) for r in got), key=lambda r: (r[-2], r[-1]))
    return learn(np.array([r[1:-2] for r in got], float).reshape(len(got), len(STATISTICS)), np.array([r[0] == 0 for r in got], bool))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that covers a row, counted from 1; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(rule.column(), F.lit(k)) if out is None else out.when(rule.column(), F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def assess(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of every row with ``base_failed``, ``rule`` (0: none) and ``kept``."""
    rows = statistics(docs, id_col, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))

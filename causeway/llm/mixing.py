"""Mixing sources to target weights by hierarchical budgeting.

A tree of domain, language and source has a token budget at its root.  Each node deals its
budget to its children by weight; a child that has too little (its tokens times the epochs
allowed) takes what it has, and the shortage goes to its siblings by weight, and only when
all of them are full to the parent's siblings.  A leaf then takes whole epochs and, of the
next one, the prefix of documents in an order seeded for leaf and epoch.

The tree's levels are solved in closed form by windows over the children of a node (rows of
the tree, not of documents).  The prefix is found by two levels: tokens are summed by hash
bucket of the seeded order, whole buckets before the budget's end are taken, and just the
bucket in which it ends goes on: it is cut into buckets again by the next digits, until it is
small enough to be ordered by document.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import materialize

LEVELS = ("domain", "lang", "source")
#: Hex digits of the seeded hash that make a bucket at each cut: 16^BUCKET_DIGITS buckets for each leaf.
BUCKET_DIGITS = 2
#: A leaf's last bucket is cut again while any has more documents than this.
MAX_EDGE = 1024


def default_domain(source: Column) -> Column:
    """A source's domain where no column names one: its trailing number modulo 4."""
    return F.concat(F.lit("domain"), F.coalesce(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("bigint") % 4, F.lit(0).cast("bigint")).cast("string"))


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain_col: str | None = None) -> DataFrame:
    """``(doc_id, domain, lang, source, n_tokens)``: words of whole texts; nulls are the domain, language or source ``?``.

    The domain is that of ``domain_col``, or of a column ``domain`` where there is one, else of the source's number.
    """
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("?"))
    given = domain_col or ("domain" if "domain" in docs.columns else None)
    words = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.col(given).cast("string"), F.lit("?")) if given else default_domain(source)).alias("domain"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("?")).alias("lang"),
        source.alias("source"),
        F.size(words).cast("long").alias("n_tokens"),
    )


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    out = F.lit(1.0)
    for name, w in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def deal(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to rows ``(parent..., name, weight, capacity, given)``: ``given`` dealt by weight up to capacity.

    In the order of capacity over weight a child is full if what is left for it and the rest
    is, by weight, no less than its capacity; the others share what the full ones leave.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("capacity") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = children.where("weight > 0").withColumns({"taken": F.coalesce(F.sum("capacity").over(before), F.lit(0)), "shares": F.sum("weight").over(after)})
    rows = rows.withColumn("full", F.col("capacity") / F.col("weight") <= (F.col("given") - F.col("taken")) / F.col("shares"))
    rest = F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(by), F.lit(0))
    shares = F.sum(F.when(~F.col("full"), F.col("weight"))).over(by)
    budget = F.when(F.col("full"), F.col("capacity").cast("double")).otherwise(F.col("weight") * rest / shares)
    return rows.withColumn("budget", F.round(budget, 3)).drop("taken", "shares", "full")


def budgets(rows: DataFrame, weights: dict[str, dict[str, float]], share: float, epochs: int) -> DataFrame:
    """``(domain, lang, source, n_tokens, budget)`` of each leaf: whole tokens out of ``share`` of all tokens there are."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n_tokens")).where("n_tokens > 0")
    w = {x: _weight(x, weights) for x in LEVELS}
    leaves = leaves.withColumn("capacity", F.when(F.least(*w.values()) > 0, F.col("n_tokens") * epochs).otherwise(F.lit(0)))
    leaves = materialize(leaves, "leaves")
    sums = leaves.agg(F.sum("n_tokens").alias("all"), F.sum("capacity").alias("capacity")).first()
    root = float(min(math.floor((sums["all"] or 0) * share), sums["capacity"] or 0))
    given = None
    parent: list[str] = []
    for level in LEVELS:
        keys = [*parent, level]
        children = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).where("capacity > 0").withColumn("weight", w[level])
        children = children.withColumn("given", F.lit(root)) if given is None else children.join(given, parent)
        given = deal(children, parent, level).select(*keys, F.col("budget").alias("given"))
        parent = keys
    found = leaves.join(given, list(LEVELS), "left").select(*LEVELS, "n_tokens", F.floor(F.coalesce("given", F.lit(0.0))).cast("long").alias("budget"))
    return found


def mix(docs: DataFrame, weights: dict[str, dict[str, float]] | None = None, share: float = 0.5, epochs: int = 2, seed: int = 17, **columns: str) -> DataFrame:
    """``(doc_id, domain, lang, source, n_tokens, n_copies)`` of the documents taken, ``n_copies`` times each.

    A leaf of ``n`` tokens and budget ``b`` takes all its documents ``b div n`` times and, once
    more, those whose running total in the order of ``md5(seed:epoch:id)`` is within
    ``b mod n``.  Documents without tokens are taken only in whole epochs.  Rows that repeat
    an id with its leaf and tokens share a place in the order and are taken together where
    the total with all of them fits.  A null id ranks as the text ``?``.  An empty table gives no rows.
    """
    rows = materialize(tokens(docs, **columns), "tokens")
    leaves = budgets(rows, weights or {}, share, epochs)
    leaves = materialize(leaves.withColumns({"whole": F.expr("budget div n_tokens"), "part": F.col("budget") % F.col("n_tokens")}), "budgets")
    placed = rows.join(F.broadcast(leaves.select(*LEVELS, "whole", "part")) if _small(leaves) else leaves.select(*LEVELS, "whole", "part"), list(LEVELS))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))
    edge = placed.withColumns({"key": key, "base": F.lit(0).cast("bigint")})
    running = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    found = []
    taken = lambda d, fits: d.select("doc_id", *LEVELS, "n_tokens", (F.col("whole") + (F.col(fits) & (F.col("n_tokens") > 0)).cast("long")).alias("n_copies"))
    for cut in range(0, 32, BUCKET_DIGITS):
        rows = edge.withColumn("bucket", F.substring("key", cut + 1, BUCKET_DIGITS))
        sums = rows.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("here"), F.max("base").alias("base"))
        sums = materialize(sums.withColumn("base", F.col("base") + F.coalesce(F.sum("here").over(running), F.lit(0))), "buckets")
        at = rows.drop("base").join(sums, [*LEVELS, "bucket"]).drop("bucket")
        ends = (F.col("base") <= F.col("part")) & (F.col("base") + F.col("here") > F.col("part"))
        found.append(taken(at.where(~ends).withColumn("fits", F.col("base") + F.col("here") <= F.col("part")), "fits"))
        edge = materialize(at.where(ends).drop("here"), "edge")
        if (edge.groupBy(*LEVELS).count().agg(F.max("count")).first()[0] or 0) <= MAX_EDGE:
            break
    total = Window.partitionBy(*LEVELS).orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    found.append(taken(edge.withColumn("fits", F.col("base") + F.sum("n_tokens").over(total) <= F.col("part")), "fits"))
    return reduce(DataFrame.unionByName, found).where("n_copies > 0")


def _small(leaves: DataFrame, rows: int = 10_000) -> bool:
    """Whether the tree has few enough leaves to send to every task."""
    return leaves.limit(rows + 1).count() <= rows

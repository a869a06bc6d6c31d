"""Near copies by the Jaccard similarity of word shingles: MinHash bands propose, shingles verify.

A text's words are as in ``simhash``; its shingles are runs of ``SHINGLE`` words, the whole text where it has fewer.
Texts of one set of shingles are one node.  ``BANDS`` x ``ROWS`` minima give each node ``BANDS`` keys, and sharing
one proposes a pair; two sets at similarity 0.8 share none with probability (1 - 0.8 ** ROWS) ** BANDS = 7e-5.
Every proposed pair is verified on the whole sets.

A key of more than ``MAX_BUCKET`` nodes, as a cloud of near copies makes it, does not propose all pairs, which grow
by the square.  Its nodes are first compared with one of them, that with the least share of shingles of its own: what
others were copied from has next to none.  After components are taken, the nodes outside the key's largest component
are compared with those that are not in theirs and can be as similar at all.  A shingle that no other node has is in no
intersection, so with ``g`` shingles that others have too, two sets x and y share at most min(g_x, g_y), which has to
reach similarity / (1 + similarity) of |x| + |y|; that leaves y a narrow range of sizes, and the join is by size.  It takes
only pairs whose parities allow it: of the shingles in each of ``PARITIES`` classes by hash a node keeps whether their number
is odd, and two sets differ in as many shingles at least as they do in parities.  Pairs that are left out are joined
already or provably less similar.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import bounded_batches, discard, materialize
from .components import connected_components

SHINGLE, BANDS, ROWS = 5, 24, 5
MAX_BUCKET = 16
PARITIES = 512
_BLOCK = 1 << 12
_RNG = np.random.default_rng(17)
_XOR, _TIMES = _RNG.integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64, endpoint=False)
_TIMES |= np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted; none of a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], 42) for a, b in zip((end - length)[: 1 - SHINGLE].tolist(), end[SHINGLE - 1 :].tolist(), strict=True)])
    return np.unique(np.frombuffer(hashes, np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """A key for each band; none of an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), _BLOCK):
        np.minimum(least, ((found[at : at + _BLOCK, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(m.tobytes(), k) - (1 << 63) for k, m in enumerate(least.reshape(BANDS, ROWS))]


def parities(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's shingles is in each class, as bits of 64-bit words."""
    odd = np.bincount((found % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, fingerprint: Callable[[str | None], int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, keys, size, h)``, a row for each row of ``docs``: the node, its band keys, its number of shingles and the text's fingerprint."""
    kind = T.StructType().add("fp", "long").add("keys", T.ArrayType(T.LongType())).add("size", "integer").add("h", "long")

    @F.pandas_udf(kind)
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = shingles(t)
            rows.append((node(s), bands(s), len(s), fingerprint(t)))
        return pd.DataFrame(rows, columns=["fp", "keys", "size", "h"])

    return bounded_batches(docs).select(F.col(id_col).alias("doc_id"), found(F.col(text_col)).alias("x")).select("doc_id", "x.*")


def node(found: np.ndarray) -> int:
    """The number of a set of shingles."""
    return xxhash.xxh64_intdigest(found.tobytes(), 42) - (1 << 63)


def _sets(texts: DataFrame, named: DataFrame) -> DataFrame:
    """``(fp, s, p)``: the shingles and parities of the nodes of ``named`` ``(fp, doc_id)``, from ``(doc_id, text)``.

    All shingles of a corpus are twice its size, those of nodes that share a key few; so they are not written
    with the signatures but taken again from one text of each such node.
    """
    kind = T.StructType().add("fp", "long").add("s", T.ArrayType(T.LongType())).add("p", T.ArrayType(T.LongType()))

    @F.pandas_udf(kind)
    def found(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in texts]
        return pd.DataFrame([(node(s), s.view(np.int64), parities(s)) for s in sets], columns=["fp", "s", "p"])

    asked = texts.join(named.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    if named.where("doc_id is null").limit(1).count():
        asked = asked.union(texts.where("doc_id is null"))
    rows = bounded_batches(asked).select(found("text").alias("x")).select("x.*")
    # An id may name several texts, of which not all are asked for.
    return rows.join(named.select("fp").hint("merge"), "fp", "left_semi").dropDuplicates(["fp"])


#: Sizes from one power of this to the next are compared as one.
_STEP = 1.02


def _strengths(crowded: DataFrame, sets: DataFrame) -> DataFrame:
    """``crowded`` with ``g``, the shingles of a node that some other crowded node has, too, and its parities ``p``."""
    each = sets.select("fp", "s").join(crowded.select("fp").distinct(), "fp", "left_semi").select("fp", F.explode("s").alias("h"))
    own = each.groupBy("h").agg(F.count("*").alias("n"), F.min("fp").alias("fp")).where("n = 1").groupBy("fp").agg(F.count("*").alias("u"))
    rows = crowded.join(own, "fp", "left").withColumn("g", F.col("size") - F.coalesce("u", F.lit(0))).drop("u")
    return materialize(rows.join(sets.select("fp", "p"), "fp"), "crowded")


def _rest(crowded: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, size, z)`` of a crowded key's nodes that are not linked yet, each with those of the key outside its component that it may be like."""
    placed = crowded.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = materialize(placed, "placed")
    main = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("m")).select("key", F.col("m.root").alias("main"))
    share = similarity / (1 + similarity)
    step = lambda x: F.floor(F.log(x) / F.log(F.lit(_STEP))).cast("int")
    least, most = F.col("size") * similarity, F.col("g") / share - F.col("size")
    out = placed.join(main, "key").where("root <> main").where(most >= least - 1e-9)
    out = out.select("key", F.col("fp").alias("c"), F.col("root").alias("r"), F.col("size").alias("z"), F.col("g").alias("w"), F.col("p").alias("q"), F.explode(F.sequence(step(least), step(most + 1))).alias("step"))
    differ = sum((F.bit_count(F.col("p")[i].bitwiseXOR(F.col("q")[i])) for i in range(PARITIES // 64)), F.lit(0))
    both = F.col("size") + F.col("z")
    may = (F.least("g", "w") >= share * both - 1e-9) & (differ <= (1 - similarity) / (1 + similarity) * both + 1e-9)
    met = placed.withColumn("step", step(F.col("size"))).join(out, ["key", "step"]).where((F.col("r") != F.col("root")) & may)
    return met.select(F.least("fp", "c").alias("a"), F.greatest("fp", "c").alias("b"), "size", "z")


def links(rows: DataFrame, texts: DataFrame, similarity: float, proposed: DataFrame) -> DataFrame:
    """``(a, b)`` edges between nodes of ``signatures`` that join the same as all links of ``similarity`` or more that share a key do.

    Pairs ``(a, b)`` that were ``proposed`` otherwise are verified with the others, all on the shingles of ``texts`` ``(doc_id, text)``.
    ``rows`` is a written table, which is deleted as soon as the nodes that share a key are written.
    """
    keyed = rows.select("fp", "size", "keys").dropDuplicates(["fp"]).select("fp", "size", F.explode("keys").alias("key"))
    drawn = F.struct("fp", "size")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(drawn).alias("x"), F.max(drawn).alias("y")).where("n > 1")
    shared = materialize(shared, "shared")
    members = materialize(keyed.join(shared.select("key", "n").hint("merge"), "key"), "members")
    asked = members.select("fp").union(proposed.select(F.explode(F.array("a", "b")).alias("fp"))).distinct()
    named = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(asked, "fp", "left_semi"), "named")
    discard(rows)
    sets = materialize(_sets(texts, named), "sets")
    discard(named)

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of ``(a, b, size, z)`` that are as similar as asked."""
        likely = pairs.where(F.least("size", "z") >= similarity * F.greatest("size", "z")).select("a", "b").distinct()
        both = likely.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("fp").alias("b"), F.col("s").alias("s_b")), "b")
        both = both.withColumn("i", F.size(F.array_intersect("s_a", "s_b")))
        return both.where(F.col("i") >= similarity * (F.size("s_a") + F.size("s_b") - F.col("i"))).select("a", "b")

    def pair(df: DataFrame, x: str, y: str) -> DataFrame:
        return df.select(F.least(f"{x}.fp", f"{y}.fp").alias("a"), F.greatest(f"{x}.fp", f"{y}.fp").alias("b"), F.col(f"{x}.size").alias("size"), F.col(f"{y}.size").alias("z"))

    few = members.where(F.col("n").between(3, MAX_BUCKET)).select("key", F.struct("fp", "size").alias("m"))
    some = few.withColumnRenamed("m", "x").join(few.withColumnRenamed("m", "y"), "key").where("x.fp < y.fp")
    size = lambda end, out: sets.select(F.col("fp").alias(end), F.size("s").alias(out))
    given = proposed.join(size("a", "size"), "a").join(size("b", "z"), "b").select("a", "b", "size", "z")
    pairs = pair(shared.where("n = 2"), "x", "y").union(pair(some, "x", "y")).union(given)
    crowded = members.where(F.col("n") > MAX_BUCKET).drop("n")
    if not crowded.limit(1).count():
        found = materialize(verified(pairs), "near")
    else:
        crowded = _strengths(crowded, sets)
        centre = crowded.groupBy("key").agg(F.max(F.struct(F.col("g") / F.col("size"), "size", "fp")).alias("y"))
        star = crowded.select("key", F.struct("fp", "size").alias("x")).join(centre, "key").where("x.fp <> y.fp")
        found = materialize(verified(pairs.union(pair(star, "x", "y"))), "near")
        rest = materialize(_rest(crowded, connected_components(found), similarity).distinct(), "rest")
        if rest.limit(1).count():
            found = found.union(materialize(verified(rest), "more"))
        discard(crowded, rest)
    discard(shared, members, sets)
    return found

"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits.  Two fingerprints at 2 or fewer differing bits, cut into two
segments of 32 bits, differ by at most one bit in one of the segments; that segment then
has a variant with one bit taken out that both share.  So every distinct fingerprint is
indexed under 2 x 32 one-wildcard variants, an equality on the variant proposes links and
the whole fingerprints verify them.

Most keys that are shared have two or three fingerprints; their pairs come out of the grouping
itself, as the third is what the least and the greatest leave of the exclusive or of all.  Keys of
up to ``max_bucket`` are joined pair by pair.  Variants shared by more, as a cloud of near copies
makes them, would propose links by the square.  The fingerprints in these take an exact way that
is linear: two fingerprints differ by at most 2 bits exactly if some 64-bit value differs
from both by at most 1.  Each therefore goes under itself and its 64 one-bit neighbours,
and all that share such a value are linked in a star, as all of these differ pairwise by at
most 2 bits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import minhash
from ._base import bounded_batches, discard, materialize
from .components import connected_components

SHINGLE = 3
MAX_BITS = 2
#: More members than this make a variant take the linear way.  Keys have 31 bits and a place, so 3e10 distinct random
#: fingerprints fill one on average: up to there it is crowds of near copies alone that exceed it.
MAX_BUCKET = 16
#: Nodes in a task before each is multiplied by its variants.
NODES_A_TASK = 1 << 14
_BLOCK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text as a signed integer; null and empty texts give 0.

    Bytes' ``lower`` and ``split`` treat just A-Z and \\x20 \\x09-\\x0D, as the operator defines words.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = xxhash.xxh64_digest(joined, 42)
    else:
        length = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(length + 1) - 1
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip((end - length)[: 1 - SHINGLE].tolist(), end[SHINGLE - 1 :].tolist(), strict=True)])
    h = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), _BLOCK):
        counts += np.unpackbits(h[at : at + _BLOCK], axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, a row for each row of ``docs``, repeated rows included."""
    return bounded_batches(docs).select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col)).alias("fp"))


def _variants(nodes: DataFrame) -> DataFrame:
    """``(key, fp)``: segment number, place of the wildcard and the other 31 bits in one integer."""
    shift = lambda x, n: F.call_function("shiftleft", x.cast("bigint"), n)

    def segment(k: int):
        bits = F.shiftrightunsigned("fp", 32 * k).bitwiseAND(F.lit((1 << 32) - 1))
        without = lambda i: bits.bitwiseAND(F.bitwise_not(shift(F.lit(1), i)))
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: without(i).bitwiseOR(shift(i + 32 * k, F.lit(32))))

    keys = [segment(0), segment(1)]
    return nodes.select(F.explode(F.concat(*keys)).alias("key"), "fp")


def _close(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def links(nodes: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """``(a, b)`` edges between distinct fingerprints ``fp`` that join the same as all links within ``MAX_BITS`` do."""
    tasks = -(-nodes.count() // NODES_A_TASK)
    variants = _variants(nodes.repartition(max(tasks, 1), "fp"))
    whole = [F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.bit_xor("fp").alias("x")]
    shared = materialize(variants.groupBy("key").agg(*whole).where("n > 1").withColumn("x", F.expr("x ^ a ^ b")), "variants")
    two = F.array(F.struct("a", "b"))
    three = F.array(F.struct("a", "b"), F.struct("a", F.col("x").alias("b")), F.struct(F.col("x").alias("a"), "b"))
    pairs = shared.where("n <= 3").select(F.inline(F.when(F.col("n") == 2, two).otherwise(three))).where(_close("a", "b"))
    found = [pairs]
    crowded = shared.where("n > 3").select("key", "n")
    if crowded.limit(1).count():
        members = materialize(variants.join(crowded.hint("merge"), "key"), "members")
        few = members.where(F.col("n") <= max_bucket)
        some = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b")
        near = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
        ball = materialize(members.where(F.col("n") > max_bucket).select("fp").distinct(), "crowded").select(
            F.explode(F.concat(F.array("fp"), near)).alias("key"), "fp"
        )
        centre = ball.groupBy("key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
        star = ball.join(centre, "key").where("fp > a").select("a", F.col("fp").alias("b"))
        found += [some.where(_close("a", "b")).select("a", "b"), star]
    return reduce(DataFrame.union, found).distinct()


def _classes(rows: DataFrame, edges: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(fp, component_id)`` of rows ``(doc_id, fp)``, linked by the ``edges`` of their distinct ``fp``."""
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = connected_components(edges(nodes))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = materialize(linked, "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    out = materialize(linked.join(least, "root").select("fp", "component_id"), "classes")
    discard(nodes, linked)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row for each row of ``docs``.

    ``fingerprint`` has 16 lowercase hex digits, ``component_id`` is the smallest id that can
    be reached by links, itself included.  Texts without words, null ones too, have
    fingerprint 0 and are linked like any other.  Rows with a null id keep it; they take
    part in links but are never a component's id unless it has no other.  Repeated rows stay
    repeated.  Other columns of ``docs`` are not read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    joined = rows.join(_classes(rows, lambda nodes: links(nodes.select("fp"))), "fp", "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def proposed(rows: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of nodes ``fp`` whose fingerprints ``h`` are equal or linked by deletion variants; a star where several nodes have one fingerprint."""
    nodes = materialize(rows.select(F.col("fp").alias("node"), F.col("h").alias("fp")).distinct(), "hashed")
    centre = materialize(nodes.groupBy("fp").agg(F.min("node").alias("a"), F.count("*").alias("n")), "centres")
    same = nodes.join(centre.where("n > 1").select("fp", "a"), "fp").where("node <> a").select("a", F.col("node").alias("b"))
    end = lambda x: centre.select(F.col("fp").alias(x), F.col("a").alias(f"__{x}"))
    near = links(centre.select("fp")).join(end("a"), "a").join(end("b"), "b").where("__a <> __b").select(F.col("__a").alias("a"), F.col("__b").alias("b"))
    out = materialize(same.union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "proposed")
    discard(nodes, centre)
    return out


def similar(docs: DataFrame, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, component_id)`` as ``near_duplicates`` gives them, with links by the similarity of ``minhash``'s shingles.

    Deletion variants propose pairs as they do there, ``minhash`` those that differ by more bits; all are verified on whole sets of
    shingles.  Texts without words, null ones too, are copies of each other.
    """
    rows = materialize(minhash.signatures(docs, fingerprint, id_col, text_col), "signatures")
    slim = materialize(rows.select("doc_id", "fp", "h"), "fingerprints")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    classes = _classes(slim.select("doc_id", "fp"), lambda _: minhash.links(rows, texts, similarity, proposed(slim)))
    return slim.join(classes, "fp", "left").select("doc_id", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns as given.

    Components are those of ``near_duplicates``, or of ``similar`` where a ``similarity`` is given.

    Rows without an id cannot be named as copies and stay, all of them.  An id that names several texts
    stays if one of them is kept; rows with an id that repeat both id and text are kept once.
    """
    found = near_duplicates(docs, id_col, text_col) if similarity is None else similar(docs, similarity, id_col, text_col)
    found = found.where("doc_id is not null").groupBy("doc_id")
    found = materialize(found.agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("keep"), F.count("*").alias("n")), "kept")
    gone = found.where("not keep").select(F.col("doc_id").alias("__gone_id"))
    kept = docs.join(gone.hint("merge"), F.col(id_col) == F.col("__gone_id"), "left_anti")
    if not found.where("n > 1").limit(1).count():
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col]).unionByName(kept.where(F.col(id_col).isNull()))

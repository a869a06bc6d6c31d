"""Substring dedup by hashing lines and the sentences in them.

A text is cut into units at line ends and at a space after a full stop, question or exclamation
mark: a passage that is pasted into the middle of a line shares no whole line with its source, a
line that repeats does so with all its sentences.  Units are normalised (lower case, runs of
white space as one space, trimmed) and grouped by digest over all texts; the earliest ranked
occurrence (least id, then least offset) is kept.  The others go where they form a passage: a run
of repeated units, one after the other in a text, of ``MIN_WORDS`` words or more.  Short
sentences that many texts share by chance so stay in texts that share nothing else.  What is left
of a text keeps its offsets in the original.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import WORD, materialize, starts

#: The least words of a run of repeated units that goes.  A passage of 50 words that is cut inside its first and last
#: sentence still has as many in the sentences between.
MIN_WORDS = 20


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, body, i, start, end, words, digest)`` of each unit with a word.

    ``start`` and ``end`` are code points of the original text, ``i`` numbers a text's units and
    ``body`` is the whole text's hash, which tells rows of one id apart.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("body"), F.split(F.regexp_replace(text, "([.!?])\\x20", "$1\n"), "\n").alias("u"))
    rows = rows.withColumn("n", F.transform("u", lambda u: F.length(u).cast("long") + 1))
    rows = rows.withColumn("x", F.filter(F.arrays_zip(starts(F.col("n")).alias("start"), F.col("u").alias("u")), lambda x: x["u"].rlike(WORD)))
    rows = rows.select("doc_id", "body", F.posexplode("x").alias("i", "x")).select("doc_id", "body", "i", F.col("x.start").alias("start"), F.col("x.u").alias("u"))
    plain = F.trim(F.regexp_replace(F.lower("u"), r"[\x20\x09-\x0D]+", " "))
    rows = rows.select("doc_id", "body", "i", "start", (F.col("start") + F.length("u")).alias("end"), plain.alias("plain"))
    words = F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1
    return rows.select("doc_id", "body", "i", "start", "end", words.alias("words"), F.unhex(F.md5("plain")).alias("digest"))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, start, end, first_doc_id, first_start)``: every unit that goes and the one kept for it.

    Minima are combined before the shuffle, so a unit that a third of all texts share costs a
    row for each task; the join to the few digests that occur twice meets written tables, where
    adaptive execution splits such a unit.  Runs are found within a text.  Null texts have no units; a
    null id ranks after all others.  Rows that repeat id and text are one text, whose units are
    given once.  No texts, no rows.
    """
    found = materialize(units(docs, id_col, text_col), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("first_doc_id"), F.col("start").alias("first_start"))
    kept = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(rank).alias("k")).where("n > 1")
    kept = materialize(kept.select("digest", "k.first_doc_id", "k.first_start"), "kept")
    again = found.join(kept.hint("merge"), "digest").where(~(F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("start") == F.col("first_start"))))
    again = again.drop("digest").dropDuplicates(["doc_id", "body", "i"])
    text = Window.partitionBy("doc_id", "body")
    again = again.withColumn("run", F.col("i") - F.row_number().over(text.orderBy("i")))
    long = F.sum("words").over(Window.partitionBy("doc_id", "body", "run")) >= min_words
    return again.withColumn("long", long).where("long").select("doc_id", "start", "end", "first_doc_id", "first_start")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with removed units cut out of the text and ``kept_spans``, the original ``(start, end)`` of each part that is left.

    Units go with the line end or space after them.  Rows that repeat an id share its removals where
    the offsets fall within the text.
    """
    gone = removed(docs, id_col, text_col, min_words).groupBy(F.col("doc_id").alias("__id"))
    gone = materialize(gone.agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__gone")), "gone")
    rows = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")), "left").drop("__id")
    size = F.length(F.col(text_col))
    g = F.coalesce("__gone", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(g, lambda x: x["end"] + 1))
    ends = F.concat(F.transform(g, lambda x: x["start"]), F.array(size.cast("bigint")))
    spans = F.filter(F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"))), lambda s: s["start"] < s["end"])
    rows = rows.withColumn("kept_spans", F.when(F.col(text_col).isNotNull(), spans)).drop("__gone")
    parts = F.transform("kept_spans", lambda s: F.substring(F.col(text_col), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return rows.withColumn(text_col, F.array_join(parts, ""))

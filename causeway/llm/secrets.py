"""Secret scans with DataFrame functions only.

Base spans follow three fixed patterns.  Candidate strings (runs of the characters that keys
are written in) are then measured by sliding-window Shannon entropy for each character class
they fit: a window of ``WINDOW`` characters moves along the candidate while the counts of its
symbols are kept up to date, one symbol entering and one leaving, and the sum of
``c * log2(c)`` changes by the two counts touched.  A candidate with a window above its
class's threshold is a span of kind ``entropy``, unless an allow-list pattern suppresses it or
it overlaps a base span.

Places are found without Python: ``split`` on a pattern gives what lies between its matches
and ``regexp_extract_all`` the matches; their lengths sum to offsets in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import starts

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes a candidate may fit, with their symbols and the least entropy in bits that tells.
CLASSES = {
    "hex": (r"^[0-9a-fA-F]+$", "0123456789abcdef", 3.0),
    "alnum": (r"^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 3.6),
    "base64": (r"^[A-Za-z0-9+/_=-]+$", "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", 3.8),
}
#: Candidates that match are not secrets: no digit or no letter, words joined by marks, paths, UUIDs, dates, placeholders.
#: The repeated group is possessive: the engine then loops over it, where it would else go one call deeper for each round.
ALLOW = (
    r"^[^0-9]+$",
    r"^[^A-Za-z]+$",
    r"^[0-9]*+[A-Za-z]++[0-9]{0,4}+(?:[_/=+-]++[0-9]*+[A-Za-z]*+[0-9]{0,4}+)*+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)(example|placeholder|changeme|dummy|xxxx|0000|1234567)",
)


def _spans(text: Column, pattern: str, kind: int, keep=None, group: int | None = None) -> Column:
    """An array of ``(start, kind, end, hit)`` of the leftmost non-overlapping matches; ``keep`` tests a match's group."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # With k matches there are k + 1 gaps; match i ends after i + 1 gaps and matches.
    ends = F.zip_with(F.transform(F.slice(gaps, F.lit(1), F.size(hits)), F.length), F.transform(hits, F.length), lambda g, h: g + h)
    before = starts(ends)
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    rows = F.zip_with(
        F.arrays_zip(before.alias("s"), ends.alias("n")),
        F.arrays_zip(hits.alias("h"), held.alias("g")),
        lambda a, b: F.struct(
            (a["s"] + a["n"] - F.length(b["h"])).cast("int").alias("start"),
            F.lit(kind).alias("kind"),
            (a["s"] + a["n"]).cast("int").alias("end"),
            b["h"].alias("hit"),
            b["g"].alias("held"),
        ),
    )
    rows = F.filter(rows, lambda r: keep(r["held"])) if keep else rows
    return F.when(F.size(hits) > 0, rows).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,hit:string,held:string>>"))


def peak_entropy(s: Column, symbols: str, window: int = WINDOW) -> Column:
    """The highest Shannon entropy in bits of any window of ``s``, by incremental counts; -1 if ``s`` is shorter than one.

    Symbols outside ``symbols`` share one count.  Counts are packed, several to a 64-bit word, so
    that a move of the window changes two of a few words.
    """
    bits = max(window.bit_length(), 1)
    per = 62 // bits
    n_words = len(symbols) // per + 1
    term = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    left = lambda x, n: F.call_function("shiftleft", x, n)
    zero = F.struct(F.array_repeat(F.lit(0).cast("bigint"), n_words).alias("words"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"), F.lit(1).alias("i"))
    chars = F.slice(F.split(s, ""), F.lit(1), F.length(s))
    leaving = F.slice(F.concat(F.array_repeat(F.lit(""), window), chars), F.lit(1), F.length(s))

    def place(c: Column) -> Column:
        code = F.instr(F.lit(symbols), c)
        return F.struct(code.alias("code"), F.floor(code / per).cast("int").alias("word"), (code % per * bits).alias("shift"))

    moves = F.zip_with(chars, leaving, lambda a, b: F.struct(place(a).alias("into"), F.when(b != "", place(b)).alias("out")))
    one = F.lit(1).cast("bigint")

    def step(state: Column, move: Column) -> Column:
        words, into, out = state["words"], move["into"], move["out"]
        count = lambda p: F.call_function("shiftright", F.element_at(words, p["word"] + 1), p["shift"]).bitwiseAND(F.lit((1 << bits) - 1))
        same = F.coalesce(into["code"] == out["code"], F.lit(False))
        c_in, c_out = count(into), F.coalesce(count(out), F.lit(0))
        lost = F.when(c_out > 0, term(c_out) - term(c_out - 1)).otherwise(F.lit(0.0))
        total = F.when(same, state["sum"]).otherwise(state["sum"] + term(c_in + 1) - term(c_in) - lost)
        change = lambda k, p: F.when(k == p["word"], left(one, p["shift"])).otherwise(F.lit(0))
        moved = F.when(same, words).otherwise(F.transform(words, lambda w, k: w + change(k, into) - change(k, out)))
        entropy = F.when(state["i"] >= window, F.log2(F.lit(float(window))) - total / window).otherwise(F.lit(-1.0))
        return F.struct(moved.alias("words"), total.alias("sum"), F.greatest(state["best"], entropy).alias("best"), (state["i"] + 1).alias("i"))

    return F.when(F.length(s) >= window, F.aggregate(moves, zero, step, lambda st: F.round(st["best"], 9))).otherwise(F.lit(-1.0))


def _tells(s: Column) -> Column:
    """Whether a candidate has a window above the threshold of the narrowest class it fits."""
    out = F.lit(False)
    for pattern, symbols, least in reversed(CLASSES.values()):
        out = F.when(s.rlike(pattern), peak_entropy(s if symbols != CLASSES["hex"][1] else F.lower(s), symbols) >= least).otherwise(out)
    return out


def _allowed(s: Column) -> Column:
    return F.expr("false") if not ALLOW else s.rlike("|".join(f"(?:{p})" for p in ALLOW))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_entropy, base, found)``, a row for each row of ``docs``.

    ``base`` and ``found`` (all spans) are arrays of ``(start, kind, end)`` in code points, end
    exclusive, sorted.  A null text has no spans.  Null ids and repeated rows stay; nothing is
    shuffled, so a text's length or the number of its spans bears on its own row alone.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,hit:string,held:string>>")
    some = lambda test, spans: F.when(t.rlike(test), spans).otherwise(none)
    bare = lambda spans: F.transform(spans, lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select(
        "doc_id",
        some("(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]", _spans(t, ASSIGN, 0, lambda g: F.length(g) >= 6, 2)).alias("assign"),
        some("AKIA", _spans(t, ACCESS, 1)).alias("access"),
        some(HEX, _spans(t, HEX, 2)).alias("hex"),
        some(CANDIDATE, _spans(t, CANDIDATE, 3, lambda g: ~_allowed(g))).alias("candidates"),
    )
    rows = rows.withColumn("base", F.array_sort(F.concat(bare(F.col("assign")), bare(F.col("access")), bare(F.col("hex")))))
    apart = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))
    rows = rows.withColumn("entropy", bare(F.filter(F.filter("candidates", apart), lambda c: _tells(c["hit"]))))
    return rows.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.size("entropy").cast("long").alias("n_entropy"),
        "base",
        F.array_sort(F.concat("base", "entropy")).alias("found"),
    )


def written(spans: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

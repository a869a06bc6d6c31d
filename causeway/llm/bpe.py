"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts of up to ``CHUNK`` characters are one chunk.  A longer text is cut into chunks of
``CHUNK`` characters that each run ``OVERLAP`` characters into the next one.  Chunks are
rows of their own, so one long text is spread over tasks: each is pre-tokenised and encoded
from its own start.  Where a chunk's own start falls inside a pre-token its first boundaries
are wrong, but the rule that makes pre-tokens looks only forward, so from the first boundary
that the chunk before also has the two agree to the end.  The stitch takes each chunk's ids
from that boundary on.  Chunks that never agree within the overlap (one run of letters longer
than the overlap) are joined and encoded as one; a run that is joined doubles before it is
encoded again, so that the work stays in proportion to its length.

Decoding concatenates the raw bytes of the ids; it is exact for any ids of the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import bounded_batches, materialize

CHUNK = 1 << 15
OVERLAP = 1 << 10
#: Pre-tokens whose ids are remembered by a worker; when full, the memory starts anew.
REMEMBERED = 1 << 17

DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, n_chunks int"


class Codec:
    """A vocabulary file of ranks, with the pattern that makes pre-tokens."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # Pre-tokens are found here, so the library sees one at a time: its own pattern takes all of it.
        self.bpe = tiktoken.Encoding("one pre-token", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        # The library's \s is Unicode's White_Space; this module's may be wider.
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.known: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        """The ids of one pre-token as little-endian 32-bit integers."""
        found = np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[text] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers."""
        known, piece = self.known, self.piece
        return b"".join([known.get(t) or piece(t) for t in self.find.findall(text)])

    def boundaries(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The ids of a text, the places where its pre-tokens start, and how many ids come before each."""
        known, piece = self.known, self.piece
        tokens = self.find.findall(text)
        parts = [known.get(t) or piece(t) for t in tokens]
        at = np.cumsum([0, *map(len, tokens)])
        before = np.cumsum([0, *map(len, parts)]) // 4
        return b"".join(parts), at, before

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def cut(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    return [text[a : a + chunk + overlap] for a in range(0, max(len(text) - overlap, 1), chunk)]


def stitch(c: Codec, chunks: list[str], chunk: int = CHUNK, overlap: int = OVERLAP, done: list[tuple] | None = None) -> bytes:
    """The ids of the text that overlapping chunks cover, from what each gives by itself.

    ``done`` may hold ``Codec.boundaries`` of each chunk, computed elsewhere.
    """
    done = done or [c.boundaries(x) for x in chunks]
    out: list[bytes] = []
    (ids, at, before), base, start = done[0], 0, 0
    first, k = 0, 1
    while k < len(chunks):
        here = k * chunk
        other_ids, other_at, other_before = done[k]
        # The last two pre-tokens of a cut chunk may not be what they are in the whole text.
        mine = at[np.searchsorted(at, max(here - base, start)) : max(len(at) - 3, 0)] + base
        mine = mine[mine <= here + overlap]
        both = np.intersect1d(mine, other_at[: np.searchsorted(other_at, overlap, "right")] + here, assume_unique=True)
        if len(both):
            sync = int(both[0])
            out.append(ids[4 * before[np.searchsorted(at, start)] : 4 * before[np.searchsorted(at, sync - base)]])
            ids, at, before, base, start, first = other_ids, other_at, other_before, here, sync - here, k
            k += 1
        else:
            k = min(k + (k - first), len(chunks))
            ids, at, before = c.boundaries("".join([*(x[:chunk] for x in chunks[first : k - 1]), chunks[k - 1]]))
    out.append(ids[4 * before[np.searchsorted(at, start)] :])
    return b"".join(out)


def digests(c: Codec, ids: bytes, n_chunks: int) -> tuple:
    raw = c.decode(ids)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest(), len(raw), n_chunks


def _short(path: str, pattern: str, want: str):
    def describe(texts: pd.Series) -> pd.DataFrame:
        c = codec(path, pattern)
        return pd.DataFrame([digests(c, c.encode(t or ""), 1) for t in texts], columns=[x.split()[0] for x in DIGESTS.split(", ")])

    def ids(texts: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return pd.Series([c.encode(t or "") for t in texts])

    return F.pandas_udf(describe, DIGESTS) if want == "digests" else F.pandas_udf(ids, "binary")


def _apply(docs: DataFrame, text_col: str, path: str, pattern: str, want: str) -> DataFrame:
    """``docs`` with ``__bpe``; long texts by chunks, joined with the rest.

    Rows of long texts are written with a number each before they are cut, so that a task that
    runs again pairs the same text with the same row.
    """
    size = F.length(F.coalesce(F.col(text_col), F.lit("")))
    short = bounded_batches(docs).where(size <= CHUNK + OVERLAP).withColumn("__bpe", _short(path, pattern, want)(F.col(text_col)))
    long = materialize(docs.where(size > CHUNK + OVERLAP).withColumn("__row", F.monotonically_increasing_id()), "long")
    ks = F.sequence(F.lit(0), F.ceil((F.length(text_col) - OVERLAP) / CHUNK).cast("int") - 1)
    pieces = long.select("__row", F.posexplode(F.transform(ks, lambda k: F.substring(F.col(text_col), k * CHUNK + 1, F.lit(CHUNK + OVERLAP)))).alias("k", "chunk"))

    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for frame in frames:
            done = [c.boundaries(t) for t in frame["chunk"]]
            frame["ids"] = [x[0] for x in done]
            frame["at"] = [x[1].astype("<i8").tobytes() for x in done]
            frame["before"] = [x[2].astype("<i8").tobytes() for x in done]
            yield frame

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        c = codec(path, pattern)
        frame = frame.sort_values("k")
        done = [(i, np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")) for i, a, b in zip(frame["ids"], frame["at"], frame["before"], strict=True)]
        ids = stitch(c, frame["chunk"].tolist(), done=done)
        value = dict(zip([x.split()[0] for x in DIGESTS.split(", ")], digests(c, ids, len(done)), strict=True)) if want == "digests" else ids
        return pd.DataFrame({"__row": frame["__row"].iloc[:1], "__bpe": [value]})

    kind = f"struct<{', '.join(f'{a}:{b}' for a, b in map(str.split, DIGESTS.split(', ')))}>" if want == "digests" else "binary"
    encoded = pieces.repartition("__row", "k").mapInPandas(chunks, "__row long, k int, chunk string, ids binary, at binary, before binary")
    found = encoded.groupBy("__row").applyInPandas(join, f"__row long, __bpe {kind}")
    return short.unionByName(long.join(found, "__row").drop("__row"))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text as little-endian 32-bit integers in a binary column.

    A null text has no ids.  ``out_col`` replaces a column of that name; repeated rows stay.
    """
    docs = docs.drop(out_col) if out_col != text_col else docs
    return _apply(docs, text_col, path, pattern, "ids").withColumnRenamed("__bpe", out_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, n_chunks)`` for each row of ``docs``.

    The ids of the whole text are decoded again; both are given as digests.  A null text
    is as an empty one: no tokens, the digest of no bytes.  Nulls in ``id_col`` stay.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _apply(rows, "text", path, pattern, "digests").select("doc_id", "__bpe.*")


def decode(frame: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``frame`` with the raw bytes of an ids column; null ids give null."""

    @F.pandas_udf("binary")
    def run(ids: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return pd.Series([None if x is None else c.decode(bytes(x)) for x in ids])

    return frame.withColumn(out_col, run(F.col(ids_col)))

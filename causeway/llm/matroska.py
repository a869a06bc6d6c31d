"""Media columns as Matroska: bytes in, a laced file out, and a packet table read back from it.

``pack`` writes a payload as 8-bit mono PCM: frames of ``FRAME`` samples in SimpleBlocks that
use each kind of lacing in turn, clusters of blocks, and a cue for each cluster.  ``packets``
parses any EBML file of this shape: elements with variable-length ids and sizes (unknown sizes
of segments and clusters too), clusters with SimpleBlocks and BlockGroups, the three kinds of
lacing, and cues.  A packet row holds its track, timestamp and byte range.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import bounded_batches

FRAME = 576
FRAMES_A_BLOCK = 6
BLOCKS_A_CLUSTER = 8
RATE = 8000

#: Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
TIMESTAMP_SCALE, DURATION = 0x2AD7B1, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

_FOLDERS = {SEGMENT, CLUSTER, BLOCK_GROUP, TRACKS, TRACK_ENTRY, INFO, CUES, CUE_POINT, CUE_POSITIONS, AUDIO}


@dataclass(frozen=True)
class Packet:
    track: int
    time_ns: int
    start: int
    size: int
    lacing: int
    cluster: int


def vint(value: int) -> bytes:
    """A size as the shortest variable-length integer; all ones is kept for unknown sizes."""
    n = 1
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def read_vint(b: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """The value at a place and the place after it; -1 is the unknown size."""
    n = 9 - b[at].bit_length() if at < len(b) else 9
    if n > 8 or at + n > len(b):
        raise ValueError(f"no variable-length integer at byte {at}")
    value = int.from_bytes(b[at : at + n], "big")
    if keep_marker:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (-1 if value == (1 << 7 * n) - 1 else value), at + n


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _signed_vint(value: int) -> bytes:
    n = 1
    while not -((1 << 7 * n - 1) - 1) <= value <= (1 << 7 * n - 1) - 1:
        n += 1
    return (value + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")


def lace(kind: int, frames: list[bytes]) -> bytes:
    """The body of a block after its header: sizes as the lacing has them, then the frames."""
    if kind == NO_LACING:
        if len(frames) != 1:
            raise ValueError("one frame at a time without lacing")
        return frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == EBML_LACING:
        head += vint(sizes[0]) + b"".join(_signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False)) if len(sizes) > 1 else b""
    elif len(set(sizes)) != 1:
        raise ValueError("fixed lacing takes frames of one size")
    return head + b"".join(frames)


def unlace(kind: int, b: bytes, at: int, end: int) -> list[tuple[int, int]]:
    """``(start, size)`` of each frame in the body of a block."""
    if kind == NO_LACING:
        return [(at, end - at)]
    if at >= end:
        raise ValueError(f"no lacing head at byte {at}")
    n, at = b[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % n:
            raise ValueError("frames of fixed lacing differ in size")
        sizes = [(end - at) // n] * (n - 1)
    elif kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while at < end and b[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise ValueError("laced sizes exceed the block")
            sizes.append(size + b[at])
            at += 1
    else:
        for k in range(n - 1):
            if k == 0:
                size, at = read_vint(b, at)
            else:
                begun = at
                raw, at = read_vint(b, at)
                width = at - begun
                raw = (1 << 7 * width) - 1 if raw == -1 else raw
                size = sizes[-1] + raw - ((1 << 7 * width - 1) - 1)
            sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or any(s < 0 for s in sizes):
        raise ValueError("laced sizes exceed the block")
    out = []
    for size in [*sizes, last]:
        out.append((at, size))
        at += size
    return out


def pack(payload: bytes) -> bytes:
    """A Matroska file whose one PCM track holds ``payload``, a positive multiple of ``FRAME`` bytes."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"the payload is to be a positive multiple of {FRAME} bytes")
    frames = [payload[a : a + FRAME] for a in range(0, len(payload), FRAME)]
    ms = FRAME * 1000 // RATE
    head = element(EBML, number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2) + element(DOC_TYPE, b"matroska"))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, np.array(len(frames) * ms, ">f8").tobytes()))
    audio = element(AUDIO, element(SAMPLING, np.array(RATE, ">f8").tobytes()) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, ms * 1_000_000) + audio))
    body, cues, at, block = [info, tracks], [], 0, 0
    place = len(info) + len(tracks)
    while at < len(frames):
        began, inside = at, [number(TIMESTAMP, at * ms)]
        for _ in range(BLOCKS_A_CLUSTER):
            kind = (XIPH, EBML_LACING, FIXED, NO_LACING)[block % 4]
            some = frames[at : at + (1 if kind == NO_LACING else FRAMES_A_BLOCK)]
            if not some:
                break
            kind = kind if len(some) > 1 else NO_LACING
            data = b"\x81" + ((at - began) * ms).to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1]) + lace(kind, some)
            inside.append(element(SIMPLE_BLOCK, data) if block % 5 else element(BLOCK_GROUP, element(BLOCK, data)))
            at, block = at + len(some), block + 1
        cues.append(element(CUE_POINT, number(CUE_TIME, began * ms) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, place))))
        body.append(element(CLUSTER, b"".join(inside)))
        place += len(body[-1])
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def elements(b: bytes, at: int, end: int, parent: int = 0):
    """``(id, start, end, head)`` of the elements in a range, those inside folders after them; ``head`` is where the id stands.

    An unknown size runs to the parent's end or, for a cluster, to the next element of the
    segment's level.
    """
    while at < end:
        head = at
        ident, at = read_vint(b, at, keep_marker=True)
        size, at = read_vint(b, at)
        if size < 0:
            stop = end
            if ident == CLUSTER:
                seek = at
                while seek < end:
                    inner, body = read_vint(b, seek, keep_marker=True)
                    if inner in (CLUSTER, CUES, TRACKS, INFO):
                        stop = seek
                        break
                    length, body = read_vint(b, body)
                    seek = body + length
        else:
            stop = at + size
        if stop > end:
            raise ValueError(f"element {ident:x} at byte {at} runs past its parent")
        yield ident, at, stop, head
        if ident in _FOLDERS:
            yield from elements(b, at, stop, ident)
        at = stop


def packets(media: bytes) -> tuple[list[Packet], list[tuple[int, int, int]], dict]:
    """The packet table, the cues ``(time, track, cluster)`` and the header values of a file.

    A cue's ``cluster`` is the number of the cluster at the byte it points to, -1 where none stands there.  What a
    track says of itself holds for all its blocks, in whatever order it says so.
    """
    out: list[Packet] = []
    cues: list[list[int]] = []
    info = {"scale": 1_000_000, "rate": 0.0, "bits": 0, "codec": "", "duration": 0.0, "clusters": 0}
    tracks: list[dict] = []
    clusters: dict[int, int] = {}
    blocks: list[tuple[int, int, int, int, int]] = []
    time, body = 0, 0
    whole = lambda a, z: int.from_bytes(media[a:z], "big")
    real = lambda a, z: float(np.frombuffer(media[a:z], ">f8" if z - a == 8 else ">f4")[0]) if z - a in (4, 8) else 0.0
    for ident, a, z, head in elements(media, 0, len(media)):
        if ident == SEGMENT:
            body = a
        elif ident == CLUSTER:
            clusters[head - body] = info["clusters"]
            info["clusters"] += 1
        elif ident == TIMESTAMP:
            time = whole(a, z)
        elif ident in (SIMPLE_BLOCK, BLOCK):
            number_, at = read_vint(media, a)
            if at + 3 > z:
                raise ValueError(f"no block header at byte {a}")
            blocks.append((number_, time + int.from_bytes(media[at : at + 2], "big", signed=True), at, z, info["clusters"] - 1))
        elif ident == TIMESTAMP_SCALE:
            info["scale"] = whole(a, z)
        elif ident == DURATION:
            info["duration"] = real(a, z)
        elif ident == TRACK_ENTRY:
            tracks.append({})
        elif ident in (TRACK_NUMBER, DEFAULT_DURATION) and tracks:
            tracks[-1][ident] = whole(a, z)
        elif ident == CODEC_ID:
            info["codec"] = media[a:z].decode("ascii", "replace")
        elif ident == SAMPLING:
            info["rate"] = real(a, z)
        elif ident == BIT_DEPTH:
            info["bits"] = whole(a, z)
        elif ident == CUE_POINT:
            cues.append([0, 0, -1])
        elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER) and cues:
            cues[-1][(CUE_TIME, CUE_TRACK, CUE_CLUSTER).index(ident)] = whole(a, z)
    spacing = {t.get(TRACK_NUMBER, 0): t.get(DEFAULT_DURATION, 0) for t in tracks}
    for number_, at_time, at, z, cluster in blocks:
        kind = media[at + 2] >> 1 & 3
        for k, (s, n) in enumerate(unlace(kind, media, at + 3, z)):
            out.append(Packet(number_, at_time * info["scale"] + k * spacing.get(number_, 0), s, n, kind, cluster))
    return out, [(t, n, clusters.get(place, -1)) for t, n, place in cues], info


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME)), len(raw)


def describe(media: bytes) -> tuple[bytes, str]:
    """The payload read back from a file and its features in one line."""
    table, cues, info = packets(media)
    payload = b"".join(media[p.start : p.start + p.size] for p in table)
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / max(len(x), 1)
    laced = [sum(p.lacing == k for p in table) for k in range(4)]
    end = max((p.time_ns for p in table), default=0)
    return payload, (
        f"codec={info['codec']};packets={len(table)};clusters={info['clusters']};cues={len(cues)};laced={','.join(map(str, laced))};"
        f"last_ns={end};mean={x.mean():.4f};rms={np.sqrt((x.astype(np.int64) ** 2).mean()):.4f};entropy={-(share * np.log2(share)).sum():.4f}"
    )


_KINDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the text stored as a file, read back and described.

    A null text is as an empty one, a payload of ``FRAME`` bytes 255.  Equal texts give equal
    values; null ids and repeated rows stay; other columns are not read.
    """

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            payload, n = padded(t)
            media = pack(payload)
            back, feature = describe(media)
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        return pd.DataFrame(rows, columns=[k.split()[0] for k in _KINDS.split(", ")])

    return bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.pandas_udf(run, _KINDS)(F.col(text_col)).alias("m")).select("doc_id", "m.*")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, media)``: each text as the bytes of a file."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([pack(padded(t)[0]) for t in texts])

    return bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.pandas_udf(run, "binary")(F.col(text_col)).alias("media"))


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet of each file: track, timestamp, byte range, lacing, cluster and whether a cue points to its cluster at its time.

    Null or empty files have no packets; a damaged one raises, as its later bytes cannot be placed.
    """
    one = "track int, time_ns long, start long, size long, lacing int, cluster int, cued boolean"

    def run(files: pd.Series) -> pd.Series:
        out = []
        for b in files:
            table, cues, info = packets(bytes(b)) if b is not None and len(b) else ([], [], {"scale": 1})
            at = {(n, c, t * info["scale"]) for t, n, c in cues}
            out.append([(p.track, p.time_ns, p.start, p.size, p.lacing, p.cluster, (p.track, p.cluster, p.time_ns) in at) for p in table])
        return pd.Series(out)

    rows = bounded_batches(media).select(F.col(id_col).alias("doc_id"), F.explode(F.pandas_udf(run, f"array<struct<{', '.join(f'{k}:{v}' for k, v in map(str.split, one.split(', ')))}>>")(F.col(media_col))).alias("p"))
    return rows.select("doc_id", "p.*")

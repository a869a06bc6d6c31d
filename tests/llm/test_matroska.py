import hashlib
import random
import zlib

import pytest

from causeway.llm import matroska as m


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 13, 40, 61, 700])
def test_payload_comes_back(n):
    payload = random.Random(n).randbytes(m.FRAME * n)
    media = m.pack(payload)
    assert m.describe(media)[0] == payload
    table, cues, info = m.packets(media)
    assert [p.time_ns for p in table] == [72_000_000 * k for k in range(n)]
    assert all(p.size == m.FRAME and media[p.start : p.start + p.size] == payload[k * m.FRAME : (k + 1) * m.FRAME] for k, p in enumerate(table))
    assert len(cues) == info["clusters"] and info["bits"] == 8 and info["rate"] == m.RATE
    assert [c for _, _, c in cues] == list(range(info["clusters"]))


@pytest.mark.parametrize("kind", [m.XIPH, m.EBML_LACING])
def test_lacing_of_any_sizes(kind):
    rng = random.Random(kind)
    for _ in range(50):
        frames = [rng.randbytes(rng.choice([0, 1, 126, 127, 254, 255, 256, 510, 20_000])) for _ in range(rng.randrange(1, 9))]
        body = m.lace(kind, frames)
        assert [body[a : a + n] for a, n in m.unlace(kind, body, 0, len(body))] == frames


def test_variable_length_integers():
    for v in (0, 1, 126, 127, 128, 16382, 16383, 2**28 - 2, 2**49, 2**56 - 2):
        b = m.vint(v)
        assert m.read_vint(b, 0) == (v, len(b))
    assert m.read_vint(b"\xff", 0)[0] == -1 and m.read_vint(b"\x01" + b"\xff" * 7, 0)[0] == -1
    with pytest.raises(ValueError):
        m.read_vint(b"\x00", 0)


def test_unknown_sizes_and_damage():
    media = m.pack(b"ab" * 288 * 100)
    at = media.index(bytes.fromhex("18538067"))
    n, body = m.read_vint(media, at + 4)
    streamed = media[: at + 4] + b"\x01" + b"\xff" * 7
    for ident, a, z, _ in m.elements(media, body, len(media)):
        if ident in (m.INFO, m.TRACKS, m.CUES):
            streamed += m.element(ident, media[a:z])
        elif ident == m.CLUSTER:
            streamed += ident.to_bytes(4, "big") + b"\xff" + media[a:z]
    assert m.describe(streamed)[0] == b"ab" * 288 * 100
    with pytest.raises(ValueError):
        m.packets(media[:-5])


def check(frame):
    got = sorted([tuple(r)[:7] for r in m.features(frame).collect()], key=str)
    want = []
    for r in frame.select("doc_id", "text").collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        media = m.pack(payload)
        want.append((r["doc_id"], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()))
    assert got == sorted(want, key=str)


def test_documents(docs):
    check(docs)


def test_odd_rows(odd, empty):
    check(odd)
    assert m.features(empty).collect() == []


def test_packet_table(docs):
    rows = m.packet_table(m.store(docs.limit(20))).collect()
    sizes = {r["doc_id"]: r["payload_bytes"] for r in m.features(docs.limit(20)).collect()}
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["size"]
    assert total == sizes and any(r["cued"] for r in rows)


def test_a_track_may_say_its_spacing_before_its_number():
    frames = [bytes([k]) * 9 for k in range(4)]
    track = m.element(m.TRACK_ENTRY, m.number(m.DEFAULT_DURATION, 5_000_000) + m.number(m.TRACK_NUMBER, 3))
    block = m.element(m.SIMPLE_BLOCK, b"\x83" + (7).to_bytes(2, "big") + bytes([m.FIXED << 1]) + m.lace(m.FIXED, frames))
    media = m.element(m.SEGMENT, m.element(m.CLUSTER, m.number(m.TIMESTAMP, 100) + block) + m.element(m.TRACKS, track))
    table, _, _ = m.packets(media)
    assert [(p.track, p.time_ns) for p in table] == [(3, 107_000_000 + 5_000_000 * k) for k in range(4)]


def test_damaged_files_raise_one_error():
    media = bytearray(m.pack(bytes(range(256)) * 9))
    rng = random.Random(1)
    for _ in range(400):
        broken = bytearray(media[: rng.randrange(1, len(media))])
        for _ in range(rng.randrange(0, 4)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        try:
            m.packets(bytes(broken))
        except ValueError:
            pass

import base64
import hashlib
import random
import time
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from causeway.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, P.PATTERN)


@lru_cache
def encoding():
    with open(PATH, "rb") as f:
        return tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})


def library(codec, text):
    return np.array(encoding().encode_ordinary(text), "<u4").tobytes()


def test_stitched_chunks_equal_the_library(codec):
    rng = random.Random(4)
    bits = ["a", "b", " ", "  ", "\n", "1", "'s", "é", "!", "ab c\x1c", "　", "\U0001f600", "x" * 90]
    for _ in range(800):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 300)))
        size, overlap = rng.choice([(20, 5), (40, 20), (64, 10), (7, 7)])
        ids = bpe.stitch(codec, bpe.cut(text, size, overlap), size, overlap)
        assert ids == codec.encode(text) == library(codec, text)
        assert codec.decode(ids) == text.encode()


def test_every_kind_of_character(codec):
    rng = random.Random(2)
    for cp in [*range(0x3100), 0xFEFF, 0x180E, *(rng.randrange(0x3100, 0x10FFFF) for _ in range(3000))]:
        if not 0xD800 <= cp < 0xE000:
            text = f"a{chr(cp)}1 {chr(cp)}{chr(cp)}  b{chr(cp)}.{chr(cp)} "
            assert codec.encode(text) == library(codec, text)


def check(codec, frame):
    got = sorted(map(tuple, bpe.round_trip(frame, PATH, P.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    want = []
    for r in frame.select("doc_id", "text").collect():
        ids = library(codec, r["text"] or "")
        want.append((r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_documents(codec, docs):
    check(codec, docs)


def test_odd_rows_with_long_texts(codec, odd, empty):
    check(codec, odd)
    assert bpe.round_trip(odd, PATH, P.PATTERN).where("n_chunks > 1").count() >= 3
    assert bpe.round_trip(empty, PATH, P.PATTERN).collect() == []


def test_encode_and_decode_keep_columns(codec, odd):
    frame = bpe.decode(bpe.encode(odd, PATH, P.PATTERN), PATH, P.PATTERN)
    assert frame.columns == [*odd.columns, "ids", "decoded"]
    for r in frame.collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_both_ways_at_the_size_of_a_chunk(codec):
    """Texts around one chunk, whole and by chunks; runs that never agree are joined in linear time."""
    rng = random.Random(6)
    for size in (bpe.CHUNK, bpe.CHUNK + bpe.OVERLAP, bpe.CHUNK + bpe.OVERLAP + 1, 3 * bpe.CHUNK):
        text = "".join(rng.choice("abc  é1\n") for _ in range(size))
        assert bpe.stitch(codec, bpe.cut(text)) == codec.encode(text) == library(codec, text)
    for run in (" " * 1_000_000, "ab" * 200_000, "a b " + "\n" * 500_000 + " c d"):
        began = time.time()
        whole = codec.encode(run)
        one = time.time() - began
        began = time.time()
        assert bpe.stitch(codec, bpe.cut(run)) == whole
        assert time.time() - began < 8 * one + 3


def test_runs_longer_than_a_chunk_stitch_small(codec):
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(["a" * rng.randrange(1, 200), " ", " " * rng.randrange(1, 150), "\n" * rng.randrange(1, 90), "b1", "."]) for _ in range(rng.randrange(1, 14)))
        size, overlap = rng.choice([(20, 5), (40, 20), (64, 10)])
        assert bpe.stitch(codec, bpe.cut(text, size, overlap), size, overlap) == library(codec, text)

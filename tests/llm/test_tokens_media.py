import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, media

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_like_the_library(ranks, library):
    for word in ("a", " thorough", "x" * 777, "abcabd" * 100, "é" * 200, " \n\n  ", "1234567890" * 9, "<|endoftext|>"):
        got = [i for w in bpe.Encoder(ranks, P.PATTERN).find(word) for i in bpe.merged(w.encode(), ranks)]
        assert got == library.encode_ordinary(word)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_any_text_round_trips(text):
    own = bpe.encoder(P.path(bpe.VOCABULARY), P.PATTERN)
    assert own.decode(own.encode(text)).decode() == text


def test_words_of_a_batch_are_merged_together(ranks, library, monkeypatch):
    rng, alone = np.random.default_rng(8), []
    text = " ".join("".join(chr(c) for c in rng.integers(97, 123, n)) for n in rng.integers(3, 30, 4000))
    one_by_one = bpe.merged
    monkeypatch.setattr(bpe, "merged", lambda word, ranks: alone.append(word) or one_by_one(word, ranks))
    ids = bpe.Encoder(ranks, P.PATTERN).encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert len(alone) < 400


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text("ab", max_size=60), st.text(max_size=30)), max_size=40), st.lists(st.text("abé", min_size=2, max_size=6), max_size=60), st.randoms())
def test_merges_together_are_those_one_by_one(words, pieces, random):
    # Any ranks, not only those of a training: pairs may come before their parts, and ids are in no order of length.
    pieces = list({*(bytes([i]) for i in range(256)), *(p.encode() for p in pieces)})
    random.shuffle(pieces)
    ranks = {p: 3 * i for i, p in enumerate(pieces)}
    raw = {w.encode() for w in words}
    got = bpe.Merger(ranks).merge(raw)
    assert {w: np.frombuffer(ids, "<u4").tolist() for w, ids in got.items()} == {w: bpe.merged(w, ranks) for w in raw}


def test_what_is_remembered_changes_nothing(ranks, library, monkeypatch):
    rng = np.random.default_rng(9)
    texts = [" ".join("".join(chr(c) for c in rng.integers(97, 110, n)) for n in rng.integers(1, 80, 60)) for _ in range(20)]
    want = [library.encode_ordinary(t) for t in texts]
    for name, value in (("REMEMBERED", 50), ("FIRST_REMEMBERED", 20), ("SEGMENT", 7), ("TOGETHER", 3)):
        monkeypatch.setattr(bpe, name, value)
        own = bpe.Encoder(ranks, P.PATTERN)
        got = own.encode_all(texts[:3]) + [own.encode(t) for t in texts[3:]] + own.encode_all(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want + want
        assert not any(len(w) > bpe.LONGEST_REMEMBERED for w in own.known)


def test_vocabulary_without_every_byte():
    ranks = {b"a": 0, b"b": 1, b"ab": 2, b"abab": 3, b"\xc3\xa9": 4}
    own = bpe.Encoder(ranks | {b"\xc3": 5, b"\xa9": 6}, r"\S+")
    assert own.merger is None
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(["ababab é", "", "bba"])] == [[3, 2, 4], [], [1, 1, 0]]


def test_documents(awkward, nothing, library):
    rows = {(r["doc_id"], r["text"]) for r in awkward.collect()}
    want = set()
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        want.add((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.digests(bpe.encode_texts(awkward)).collect()
    assert {tuple(r) for r in got} == want
    assert len(got) == awkward.count()
    assert bpe.encode_texts(nothing).count() == 0


def test_native_fold_and_decoding(spark, ranks, library):
    words = ["a", " the", "thorough", " Übermaß", "lowering", "", "12ab34", " " * 7]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    out = bpe.decode_ids(bpe.encode_words(df, ranks), ranks).collect()
    for r in out:
        assert list(r["ids"]) == library.encode_ordinary(r["word"])
        assert bytes(r["decoded"]).decode() == r["word"]


def brute_area(grey, height, width):
    """Cell by cell, with the overlap of every source pixel."""
    rows, columns = grey.shape
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            y0, y1, x0, x1 = i * rows / height, (i + 1) * rows / height, j * columns / width, (j + 1) * columns / width
            for y in range(rows):
                for x in range(columns):
                    out[i, j] += max(0, min(y1, y + 1) - max(y0, y)) * max(0, min(x1, x + 1) - max(x0, x)) * grey[y, x]
            out[i, j] /= (y1 - y0) * (x1 - x0)
    return out


@pytest.mark.parametrize("shape", [(1, 64), (3, 7), (8, 9), (20, 13)])
def test_area_resize(shape):
    grey = np.random.default_rng(3).integers(0, 256, shape).astype(float)
    np.testing.assert_allclose(media.area_resize(grey, 8, 9), brute_area(grey, 8, 9), atol=1e-8)


def test_area_resize_in_segments(monkeypatch):
    grey = np.random.default_rng(5).integers(0, 256, (1000, 64)).astype(np.uint8)
    want = media.area_resize(grey, 8, 9)
    monkeypatch.setattr(media, "SEGMENT_ROWS", 37)
    np.testing.assert_allclose(media.area_resize(grey, 8, 9), want, rtol=1e-12)


def test_decoders():
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (5, 7)).astype(np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(media.encode_bmp(grey)) == grey).all()
    assert (media.decode(b"P2 # note\n3 2\n255\n1 2 3\n4 5 6\n") == [[1, 2, 3], [4, 5, 6]]).all()
    assert (media.decode(b"P1\n3 1\n101") == [[1, 0, 1]]).all()
    assert (media.decode(b"P4\n3 2\n\xa0\x40") == [[1, 0, 1], [0, 1, 0]]).all()
    assert (media.decode(b"P6\n1 2\n255\n" + bytes(range(6))) == [[[0, 1, 2]], [[3, 4, 5]]]).all()
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02")[0, 0] == 258
    for bad in (b"", b"P5\n9 9\n255\nxx", b"BM", b"GIF89a", b"P7\n1 1\n"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_stored_texts(awkward, nothing):
    for form in ("pgm", "bmp"):
        for r in media.store_texts(awkward, form).collect():
            text = next((x["text"] for x in awkward.collect() if x["doc_id"] == r["doc_id"]), None)
            raw = (text or "").encode()
            payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            stored = (media.encode_pgm if form == "pgm" else media.encode_bmp)(np.frombuffer(payload, np.uint8).reshape(-1, 64))
            assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
            assert np.load(io.BytesIO(bytes(r["tile"]))).shape == (8, 9)
    assert media.store_texts(nothing).count() == 0


def test_media_column(spark):
    grey = np.arange(64, dtype=np.uint8).reshape(8, 8)
    df = spark.createDataFrame([(1, bytearray(media.encode_pgm(grey))), (2, bytearray(media.encode_bmp(grey))), (3, None), (4, bytearray(b"junk"))], "image_id long, image binary")
    rows = {r["image_id"]: r for r in media.decode_media(df).collect()}
    assert rows[1]["dhash"] == rows[2]["dhash"] and rows[1]["height"] == 8
    assert rows[3]["error"] == "null" and rows[4]["tile"] is None

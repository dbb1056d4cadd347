"""op1, op3: exact against the libraries, and round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
import public_tokenizers as P  # noqa: E402

from echograph.llm import bpe, packed_ids  # noqa: E402

TEXTS = [None, "", " ", "a", "Hello  world\n\n x", "ein Übermaß, çrté 1234 's 'LL", "中文 テスト 😀😀", "nbsp\u00a0x \u3000y", "aaaaaaa" * 40, "<|endoftext|> x", "\x1c\x85ab", "word " * 5000, "Hello  world\n\n x"]


def documents(spark):
    return spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)] + [(None, "null key", "x")], "doc_id long, text string, ids string")


def test_encoding_equals_tiktoken(spark):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(bpe.VOCABULARY)), special_tokens={})
    got = {r.doc_id: r for r in bpe.encode(documents(spark), offsets=True).collect()}
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(documents(spark))).collect()}
    digest = {r.doc_id: r for r in bpe.digests(documents(spark)).collect()}
    for i, t in enumerate(TEXTS):
        ids = own.encode_ordinary(t or "")
        assert got[i].ids == ids and back[i] == (t or "").encode()
        assert digest[i].n_tokens == len(ids)
        assert digest[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digest[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        if ids:
            assert got[i].char_starts[0] == 0 and got[i].char_ends[-1] == len(t)
    assert any(got[TEXTS.index("中文 テスト 😀😀")].cuts)


def test_fuzz_against_tiktoken():
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(bpe.VOCABULARY)), special_tokens={})
    codec, draw = bpe.codec(None, None), random.Random(1)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "1", "'s", "!", "中", "😀", "the", "\u00a0", "\u2003", "\x1c", "ing", "\r\n", "Σ"]
    for _ in range(3000):
        t = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 30)))
        assert codec.encode(t.encode()).tolist() == own.encode_ordinary(t), repr(t)


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 24, 31])
def test_packing_round_trip_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    packed = packed_ids.pack(ids, bits)
    assert (packed_ids.unpack(packed, bits, 0, 1001) == ids).all()
    assert (packed_ids.unpack(packed, bits, 137, 50) == ids[137:187]).all()
    assert len(packed) == -(-1001 * bits // 8)


def test_word_ids_equal_the_library():
    e, draw = packed_ids.encoder(None), random.Random(2)
    alphabet = [*"abzABZ019'.,!~#ßÀÿØ×÷ éÉ\n\t", "'s", "'LL", "İ", "Σ", "e\u0301", "中", "<|endoftext|>", "\u00a0", "\x1c", "ǅ"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 25))) for _ in range(3000)]
    want = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert e.encode([t.encode() for t in texts]) == [np.array(w.ids, "<u4").tobytes() for w in want]


def test_distinct_units_are_looked_up_once_a_batch(monkeypatch):
    """Work on a unit does not grow with its repeats, and units come from one cut over all texts."""
    e, seen = packed_ids.WordEncoder(P.path(packed_ids.VOCABULARY)), []
    own = e._numbers
    monkeypatch.setattr(e, "_numbers", lambda units: seen.append(units) or own(units))
    texts = ["Hello world, hello 11 naïve,", "", "world don't", " \n"] * 200
    got = e.encode([t.encode() for t in texts])
    assert got == [np.array(w.ids, "<u4").tobytes() for w in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [sorted(x) for x in seen] == [sorted(["hello", "world", ",", "1", "naïve,", "don't"])]


@pytest.mark.parametrize("change", ["small parts", "small cache", "other widths", "unknown steps"])
def test_other_ways_of_the_word_encoder(monkeypatch, change):
    e, draw = packed_ids.WordEncoder(P.path(packed_ids.VOCABULARY)), random.Random(8)
    alphabet = [*"abzAB09'.,~#ßÀ÷ éÉ\n\t", "'s", "Σ", "e\u0301", "中", "\u00a0", "\x1c", "\x7f", "the ", "Word, "]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(600)]
    if change == "small parts":
        monkeypatch.setattr(packed_ids, "PART_BYTES", 7)
    elif change == "small cache":
        monkeypatch.setattr(packed_ids, "CACHE", 40)
    elif change == "other widths":
        e.widths[:] = 0
    else:
        e.known, e.kinds = False, np.where(packed_ids.KINDS == packed_ids.SPACE, packed_ids.SPACE, packed_ids.ODD)
    want = [np.array(w.ids, "<u4").tobytes() for w in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for i in range(0, len(texts), 150):
        assert e.encode([t.encode() for t in texts[i : i + 150]]) == want[i : i + 150]
    assert e.encode([]) == [] and e.encode([b"", b" "]) == [b"", b""]


def test_files_read_back(spark, tmp_path):
    docs = documents(spark).where("doc_id is not null").repartition(3)
    packed_ids.write(docs, str(tmp_path / "set"))
    rows = sorted(packed_ids.read(spark, str(tmp_path / "set")).collect())
    tokenizer = packed_ids.encoder(None).tokenizer
    at = 0
    for i, (r, t) in enumerate(zip(rows, TEXTS, strict=True)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(ids), ids)
        at += len(ids)
    digest = {r.doc_id: r.ids_crc32 for r in packed_ids.read(spark, str(tmp_path / "set"), digest=True).collect()}
    assert digest[4] == zlib.crc32(np.array(rows[4].ids, "<u4").tobytes())


def test_empty_tables(spark, tmp_path):
    none = documents(spark).limit(0)
    assert bpe.decode(bpe.encode(none)).count() == 0
    packed_ids.write(none, str(tmp_path / "none"))
    assert packed_ids.read(spark, str(tmp_path / "none")).count() == 0

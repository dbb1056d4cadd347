"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

A vocabulary is a file of byte strings with ranks. The library works on characters, so each byte is
mapped to a printable character (the public byte table of byte-level BPE) and back. A text is cut
before single spaces, where no match of the split pattern can reach across, and every distinct
segment is encoded once per worker; the library itself splits the segment by the pattern.

Null text counts as empty: no ids. Empty text: no ids. Any byte sequence that is valid UTF-8 makes
the round trip. Long texts are encoded in slices of segments, so memory follows the ids of one text.
Columns other than the key and the text are not carried; join on the key where they are needed.
Repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAME = "op1_byte_bpe"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Segments kept per worker.
CACHE = 200_000
#: Bytes of text of a batch.
BATCH_BYTES = 4_000_000

#: White space beyond ASCII, and the separators that some definitions count: such texts are not cut.
ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]")
RUN = re.compile(rb"[ \t-\r] ")
SEGMENT = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where printable in Latin-1, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBPE:
    """Encoder and decoder of one vocabulary; one per worker process."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern
        ranks = read_ranks(path)
        size = max(ranks.values()) + 1
        pieces = [b""] * size
        for t, r in ranks.items():
            pieces[r] = t
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.first: dict[bytes, bytes] = {}
        self.spaced: dict[bytes, bytes] = {}

    @cached_property
    def tokenizer(self):
        """The library's tokenizer; decoding does without it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(self.path)
        shown = byte_characters()
        name = {t: "".join(map(shown.__getitem__, t)) for t in ranks}
        # every way to make a token of two tokens, in rank order: the pair of lowest rank goes first
        merges = [(name[t[:i]], name[t[i:]]) for t in sorted(ranks, key=ranks.get) if len(t) > 1 for i in range(len(t) - 1, 0, -1) if t[:i] in ranks and t[i:] in ranks]
        out = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
        out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(self.pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return out

    def _packed(self, segments: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch([s.decode() for s in segments], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _join(self, cache: dict[bytes, bytes], parts: list[bytes], before: bytes) -> bytes:
        got = list(map(cache.get, parts))
        if None in got:
            missing = list({p for p, g in zip(parts, got, strict=True) if g is None})
            new = dict(zip(missing, self._packed([before + p for p in missing]), strict=True))
            got = [new[p] if g is None else g for p, g in zip(parts, got, strict=True)]
            if len(cache) + len(new) > CACHE:
                cache.clear()
            cache.update((p, v) for p, v in new.items() if len(p) <= 40)
        return b"".join(got)

    def encode(self, text: bytes) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if ODD_SPACE.search(text):
            out = b"".join(self._packed([text]))
        elif RUN.search(text):
            parts = SEGMENT.findall(text)
            out = b"".join(self._join(self.first, parts[i : i + 100_000], b"") for i in range(0, len(parts), 100_000))
        else:
            parts = text.split(b" ")
            out = [self._join(self.first, parts[:1], b"") if parts[0] else b""]
            out = b"".join(out + [self._join(self.spaced, parts[i : i + 100_000], b" ") for i in range(1, len(parts), 100_000)])
        return np.frombuffer(out, "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - n), n)
        return self.bytes[at].tobytes()

    def offsets(self, ids: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each id: the character in which it begins, the one after that in which it ends, and whether it cuts a character."""
        if not len(ids):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
        lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        character = np.cumsum(lead) - 1  # of each byte
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        lead = np.append(lead, True)
        return character[starts], character[ends - 1] + 1, ~(lead[starts] & lead[ends])


@lru_cache(4)
def codec(path: str | None, pattern: str | None) -> ByteBPE:
    import public_tokenizers as P

    return ByteBPE(path or P.path(VOCABULARY), pattern or P.PATTERN)


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch in which the binary column has about `size` bytes each."""
    weigh = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)) + 64
    part = np.cumsum(weigh) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(weigh)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """key, ids array<int>; with offsets also char_starts, char_ends array<int> and cuts array<boolean> per id."""
    common.ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold(NAME, codec.cache_clear)
        c = codec(path, pattern)
        for whole in batches:
            for b in slices(whole, 1, BATCH_BYTES):
                texts = [x or b"" for x in b.column(1).to_pylist()]
                ids = [c.encode(t) for t in texts]
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = lambda parts, kind, at=at: pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)))
                cols = [b.column(0), lists(ids, np.int32)]
                names = [key, "ids"]
                if offsets:
                    where = [c.offsets(i, t) for i, t in zip(ids, texts, strict=True)]
                    cols += [lists([w[0] for w in where], np.int32), lists([w[1] for w in where], np.int32), lists([w[2] for w in where], np.bool_)]
                    names += ["char_starts", "char_ends", "cuts"]
                yield pa.RecordBatch.from_arrays(cols, names)
        common.release()

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, ids array<int>" + ", char_starts array<int>, char_ends array<int>, cuts array<boolean>" * offsets
    return df.select(F.col(key), F.col(text).cast("binary").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, key: str = "doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """key and the decoded bytes of key, ids."""
    common.ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold(NAME, codec.cache_clear)
        c = codec(path, pattern)
        for b in batches:
            lists = b.column(1)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(flat[x:y]) for x, y in zip(at, at[1:], strict=False)], pa.binary())], [key, "decoded"])
        common.release()

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key), F.col("ids")).mapInArrow(run, f"`{key}` {kind}, decoded binary")


def digests(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256: encoded and decoded in one worker, so that ids need not leave it."""
    common.ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold(NAME, codec.cache_clear)
        c = codec(path, pattern)
        decimals = [b"%d" % i for i in range(len(c.lengths))]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for whole in batches:
            for b in slices(whole, 1, BATCH_BYTES):
                n, of_ids, of_text = [], [], []
                for x in b.column(1):
                    ids = c.encode(x.as_buffer().to_pybytes() if x.is_valid else b"")
                    n.append(len(ids)), of_ids.append(sha(b" ".join(map(decimals.__getitem__, ids.tolist())))), of_text.append(sha(c.decode(ids)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])
        common.release()

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; see the module for nulls and long texts."""
    return digests(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = None

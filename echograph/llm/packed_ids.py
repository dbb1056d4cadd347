"""Token ids in fixed-width bit packing.

Each id takes the least number of bits that the vocabulary needs. A data set is a folder with two
tables: `blocks` (part, block, first, n_ids, bits, payload) holds the packed ids, `documents` (part,
block, key, doc_first, n_tokens) says where each document lies. Blocks hold whole documents in
ascending key order and close at BLOCK_IDS ids, so a longer document is a block of its own. `first`
and `doc_first` count from the start of the part; `starts()` makes them global. Id number i of a
block lies at bit i * bits, so any id is read without the others. Files are written by Spark's
committer into the shared folder: lost executors leave no partial file behind.

Null text: empty, which leaves the end id alone. Null keys come first; equal keys are in text order.
Empty table: empty data set. Columns other than key and text are not stored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bpe import byte_characters, slices

NAME = "op3_packed_ids"
VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK_IDS = 65_536
CACHE = 700_000
BATCH_BYTES = 4_000_000
#: Bytes of a text that are cut into units at once.
PART_BYTES = 4_000_000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids at `bits` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    shown = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(shown.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """Ids first to first + n - 1 of a payload, without reading the others."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n, first * bits // 8).astype(np.uint32)
    at = (first + np.arange(n, dtype=np.int64)) * bits
    low = first * bits >> 3
    raw = np.frombuffer(payload[low : ((first + n) * bits + 7 >> 3)] + bytes(8), np.uint8).astype(np.uint64)
    byte = (at >> 3) - low
    value = sum((raw[byte + k] << np.uint64(8 * k) for k in range(5)), np.zeros(n, np.uint64))
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


#: The steps before the model of a file that short() repeats: fixed values of the public file format.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: Printable ASCII and the letters of Latin-1, and the split pattern as it is on them in lower case.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


#: Kinds of bytes. Odd ones (not printable ASCII, and the apostrophe, which can begin a piece of its own) leave their run whole.
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
KINDS = np.full(256, ODD, np.uint8)
for _kind, _bytes in ((SIGN, range(33, 127)), (SPACE, (32, *range(9, 14))), (LETTER, (*range(65, 91), *range(97, 123))), (DIGIT, range(48, 58)), (ODD, b"'")):
    KINDS[list(_bytes)] = _kind
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = re.compile(rb"[ \t-\r]")


class WordEncoder:
    """The tokenizer of a file; white space splits its input, so what stands between ASCII white space is encoded by itself.

    A batch of texts is cut at once: into the pieces of the split pattern where a run is printable
    ASCII, else into whole runs. Each distinct unit is looked up once a batch. Of new ones those of plain
    characters go to the tokenizer's model, many at a time; others pass through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.bits = bits_for(self.tokenizer.get_vocab_size(with_added_tokens=True))
        with open(path) as f:
            steps = json.load(f)
        self.known = all(steps[k] == v for k, v in STEPS.items())
        self.kinds = KINDS if self.known else np.where(KINDS == SPACE, np.uint8(SPACE), np.uint8(ODD))
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.shown = {chr(b): c for b, c in enumerate(byte_characters())}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        ending = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.widths[list(vocabulary.values())] = [len(t.removesuffix(ending)) for t in vocabulary]
        self._clear()

    def _clear(self) -> None:
        #: Number of each piece and whole run; a run that reads like a piece is that piece. Of each number the ids, in flat.
        self.found: dict[str, int] = {}
        self.sizes, self.starts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _keep(self, units: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.found.update(zip(units, range(len(self.sizes), len(self.sizes) + len(units)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units in turn, and where each unit's end."""
        n = self.sizes[numbers]
        ends = np.cumsum(n)
        where = np.repeat(self.starts[numbers] - (ends - n), n) + np.arange(n.sum())
        return self.flat[where], ends

    def _model(self, pieces: list[str]) -> None:
        """Encodes pieces and remembers them."""
        lists = [pieces[i : i + 1000] for i in range(0, len(pieces), 1000)]
        shown = [some if "".join(some).isascii() else ["".join(map(self.shown.__getitem__, p.encode().decode("latin-1"))) for p in some] for some in lists]
        lines = [" ".join(x) for x in shown]
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        for line, some, got in zip(lines, shown, self.model.encode_batch_fast(lines, add_special_tokens=False), strict=True):
            own = np.array(got.ids, "<u4")
            # tokens are as wide as what they stand for: a piece ends where the widths add up to it
            ends, want = np.cumsum(self.widths[own]), np.cumsum(list(map(len, some)))
            at = np.searchsorted(ends, want)
            if len(own) and at[-1] == len(own) - 1 and (ends[at] == want).all():
                sizes.append(np.diff(at, prepend=-1))
            else:
                got = self.model.encode(line, add_special_tokens=False)
                own = np.array(got.ids, "<u4")
                sizes.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(some)))
            ids.append(own)
        self._keep(pieces, np.concatenate(sizes), np.concatenate(ids))

    def _cut(self, run: str) -> list[str] | None:
        """The pieces of a run of plain characters; None: left to the tokenizer."""
        return PIECE.findall(run.lower()) if self.known and PLAIN.fullmatch(run) else None

    def _new(self, units: list[str]) -> None:
        """Encodes units and remembers them."""
        words = [u for u in units if u.isalpha() and u.isascii()] if self.known else []
        own = set(words)
        cut = {u: self._cut(u) for u in units if u not in own}
        self._model(words + list({p for c in cut.values() if c for p in c if p not in self.found and p not in own}))
        odd = [u for u, c in cut.items() if c is None]
        whole = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(odd, add_special_tokens=False)]
        self._keep(odd, np.array(list(map(len, whole)), np.int64), np.concatenate([np.zeros(0, "<u4"), *whole]))
        runs = [(u, c) for u, c in cut.items() if c and u not in self.found]
        ids, ends = self._gather(np.array([self.found[p] for _, c in runs for p in c], np.int64))
        last = np.append(0, ends)[np.cumsum([len(c) for _, c in runs], dtype=np.int64)]
        self._keep([u for u, _ in runs], np.diff(last, prepend=0), ids)

    def _numbers(self, units: list[str]) -> np.ndarray:
        got = list(map(self.found.get, units))
        new = [u for u, g in zip(units, got, strict=True) if g is None]
        if len(self.found) + len(new) > CACHE:
            self._clear()
            new, got = units, [None] * len(units)
        if new:
            self._new(new)
            late = map(self.found.__getitem__, new)
            got = [next(late) if g is None else g for g in got]
        return np.array(got, np.int64)

    def _units(self, data: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
        """Where each unit of a buffer begins, and the units: lower-case pieces, and runs with odd bytes as they are."""
        kind, shown = self.kinds[data], LOWER[data]
        solid = kind != SPACE
        begins = solid.copy()
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        odd = np.flatnonzero(kind == ODD)
        if len(odd):
            edge = np.diff(solid.view(np.int8), prepend=np.int8(0), append=np.int8(0))
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            whole = np.unique(np.searchsorted(first, odd, side="right") - 1)
            step = np.zeros(len(data) + 1, np.int8)
            step[first[whole]], step[last[whole]] = 1, -1
            inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
            shown[inside], begins[inside] = data[inside], False
            begins[first[whole]] = True
        at, upto = np.flatnonzero(begins), np.cumsum(solid, dtype=np.int32)
        offsets = np.append(upto[at] - 1, upto[-1:]).astype(np.int32)
        return at, pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(shown[solid]))

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        at, units = self._units(np.frombuffer(b" ".join([*texts, b""]), np.uint8))
        if not len(at):
            return [b""] * len(texts)
        coded = units.dictionary_encode()
        names = pc.binary_join(pa.array([coded.dictionary], pa.list_(pa.string())), " ")[0].as_py().split(" ")
        found, ends = self._gather(self._numbers(names)[coded.indices.to_numpy()])
        ids = found.tobytes()
        before = np.searchsorted(at, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        cuts = (4 * np.append(0, ends)[before]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; what is new in them is encoded together. Long texts go in parts."""
        if all(len(t) <= PART_BYTES for t in texts):
            return self._encode(texts)
        return [b"".join(self._encode([p])[0] for p in parts(t)) for t in texts]


def parts(text: bytes) -> Iterator[bytes]:
    """A text cut before white space, every PART_BYTES or at the next one after."""
    at = 0
    while at < len(text):
        space = SPACES.search(text, at + PART_BYTES)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


@lru_cache(4)
def encoder(path: str | None) -> WordEncoder:
    import public_tokenizers as P

    return WordEncoder(path or P.path(VOCABULARY))


def write(df: DataFrame, folder: str, text: str = "text", key: str = "doc_id", path: str | None = None, end_id: int = END_ID) -> None:
    """Encodes every text, appends end_id and writes the data set into folder, keys ascending over its parts."""
    spark = df.sparkSession
    common.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        common.hold(NAME, encoder.cache_clear)
        part, e, end = TaskContext.get().partitionId(), encoder(path), np.array([end_id], "<u4").tobytes()
        block = first = n = 0
        keys: list = []
        counts: list[int] = []
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            packed = pack(np.frombuffer(b"".join(held), "<u4"), e.bits)
            one = lambda x, kind: pa.array([x], kind)
            lists = lambda x, kind: pa.array([x], pa.list_(kind))
            return pa.RecordBatch.from_arrays([one(part, pa.int32()), one(block, pa.int64()), one(first, pa.int64()), one(n, pa.int64()), one(e.bits, pa.int32()), one(packed, pa.binary()), lists(keys, kind), lists(counts, pa.int64())], ["part", "block", "first", "n_ids", "bits", "payload", "keys", "counts"])

        for b in batches:
            kind = b.column(0).type
            for some in slices(b, 1, BATCH_BYTES):
                for k, ids in zip(some.column(0).to_pylist(), e.encode([x or b"" for x in some.column(1).to_pylist()]), strict=True):
                    keys.append(k), counts.append(len(ids) // 4 + 1), held.append(ids + end)
                    n += counts[-1]
                    if n >= BLOCK_IDS:
                        yield close()
                        block, first, n, keys, counts, held = block + 1, first + n, 0, [], [], []
        if keys:
            yield close()

    kind = df.schema[key].dataType.simpleString()
    schema = f"part int, block long, first long, n_ids long, bits int, payload binary, keys array<{kind}>, counts array<long>"
    sorted_ = df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    sorted_.mapInArrow(run, schema).write.parquet(folder)


def starts(blocks: DataFrame) -> DataFrame:
    """part and the number of ids in the parts before it: one row per part, as many as there were write tasks."""
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))


def read(spark: SparkSession, folder: str, key: str = "doc_id", digest: bool = False) -> DataFrame:
    """key, start, n_tokens and ids array<int>, or in place of the ids their ids_crc32 (digest)."""
    common.ship(spark)
    blocks = spark.read.parquet(folder)
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    last = "ids_crc32 long" if digest else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                offset, first, bits, payload, counts = (b.column(k)[i].as_py() for k in (0, 1, 2, 3, 5))
                ends = np.cumsum(counts)
                ids = unpack(payload, bits, 0, int(ends[-1])).astype("<u4")
                at = [0, *ends.tolist()]
                if digest:
                    found = pa.array([zlib.crc32(ids[x:y]) for x, y in zip(at, at[1:], strict=False)], pa.int64())
                else:
                    found = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(4)[i].values, pa.array(ends - counts + offset + first, pa.int64()), pa.array(counts, pa.int64()), found], [key, "start", "n_tokens", last.split()[0]])

    with_offset = blocks.join(F.broadcast(starts(blocks)), "part").select("offset", "first", "bits", "payload", "keys", "counts")
    return with_offset.mapInArrow(run, f"`{key}` {kind}, start long, n_tokens long, {last}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to the shared folder and read back."""
    folder = f"{common.shared_dir(spark)}/packed-ids-{uuid.uuid4().hex}"
    write(common.table(spark, sf_dir, "documents"), folder)
    return read(spark, folder, digest=True)


ORACLE_SQL = None

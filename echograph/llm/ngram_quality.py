"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, per language.

Symbols are classes of UTF-8 bytes (letters, upper case, digits, space, line break, kinds of
punctuation, bytes of other letters), SYMBOLS in number; a model is of ORDER symbols. Trusted texts
(quality 1, not toxic) are counted in each task and the counts summed by language and n-gram, sharded
by these keys. Of the sums of one language, at most SYMBOLS ** ORDER, comes its table of
probabilities: discounts from the counts of counts, lower orders from continuation counts. It is cut
into SHARDS by context.

Scoring is a join of counts with these shards. Each task counts the n-grams of its documents, BLOCK_DOCS
of one model at a time, and packs the counts of a shard's n-grams as gaps, entropy-coded. Packed
counts and shards meet by a shuffle on model and shard, large models dealt out by salt; what each
document costs in each shard is summed by document. Neither tables nor texts are sent whole. A
document is told by a 128-bit hash of its text, so equal texts of a model have one score.

A document's score is its negative log-likelihood per symbol, shrunk towards its language's mean by
PRIOR symbols; its perplexity is the exponential. Documents whose score exceeds the QUANTILE of the
trusted scores of their language are rejected. Languages without trusted text, null
among them, are judged by a model of all trusted text, that of null language too.

Null and empty texts score the mean and are kept. No trusted text at all: everything is kept, with
null scores. Repeated rows count each time. Label rows of one document may repeat: it is trusted if
any says so and none says otherwise. Very long texts are scored in slices.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAME = "op5_ngram_quality"
SYMBOLS, ORDER = 40, 4
CELLS = SYMBOLS**ORDER
PRIOR = 100
QUANTILE = 0.995
STEP = 1 << 18
#: Shards of a language's table, by context; SPREAD deals the contexts out evenly (it shares no factor with their number).
SHARDS, CONTEXTS, SPREAD = 16, CELLS // SYMBOLS, 7_919
WIDTH = CELLS // SHARDS
#: Documents of a block (CELLS * BLOCK_DOCS keys are under 2 ** 32), bytes and models of blocks that a task holds open.
BLOCK_DOCS, BLOCK_BYTES, SLICE = 1_024, 6_000_000, 16
#: Text of a model whose counts meet one copy of its shards.
GROUP_BYTES = 64_000_000
ALL = "*"


def _classes() -> np.ndarray:
    """Symbol of each byte."""
    t = np.zeros(256, np.uint8)
    t[0x80:0xC0] = 36 + (np.arange(0x80, 0xC0) & 3)
    t[0xC0:] = 35
    t[:128] = 34
    for symbol, chars in ((27, range(65, 91)), (28, range(48, 58)), (29, b" "), (30, b"\n\r"), (31, b"."), (32, b","), (33, b";:?'\"()-")):
        t[list(chars)] = symbol
    t[97:123] = np.arange(1, 27)
    return t


CLASSES = _classes()


def grams(text: bytes) -> Iterator[np.ndarray]:
    """Numbers of the n-grams of a text, as many as it has bytes, in slices; the start counts as line breaks."""
    for i in range(0, len(text), STEP):
        before = (b"\n" * (ORDER - 1) + text[max(0, i - ORDER + 1) : i])[-(ORDER - 1) :]
        x = CLASSES[np.frombuffer(before + text[i : i + STEP], np.uint8)].astype(np.int32)
        n = len(x) - ORDER + 1
        out = np.zeros(n, np.int32)
        for k in range(ORDER):
            out = out * SYMBOLS + x[k : k + n]
        yield out


def _less(c: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and of 3 and more."""
    n1, n2, n3, n4 = np.maximum(1, np.bincount(np.minimum(c, 5).ravel(), minlength=6)[1:5]).tolist()
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(max(0.0, k - (k + 1) * y * b / a) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


def _interpolated(c: np.ndarray, less: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probabilities of one order from its counts, its discounts and the order below."""
    discount = less[np.minimum(c, 3)]
    total, spare = c.sum(-1, keepdims=True), discount.sum(-1, keepdims=True)
    return np.where(total > 0, (c - discount + spare * p) / np.maximum(total, 1), p)


def kneser_ney(counts: np.ndarray) -> np.ndarray:
    """Log-probability of the last symbol of every n-gram; the highest order is done symbol by symbol of its start."""
    top = counts.reshape((SYMBOLS,) * ORDER)
    orders = [(top > 0).sum(axis=0)]  # kinds of symbols before
    while orders[0].ndim > 1:
        orders.insert(0, (orders[0] > 0).sum(axis=0))
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for c in orders:
        p = _interpolated(c, _less(c), p)
    less, out = _less(top), np.empty(top.shape, np.float32)
    for a in range(SYMBOLS):
        out[a] = np.log(np.maximum(_interpolated(top[a], less, p), 1e-12))
    return out.ravel()


def count(trusted: DataFrame) -> DataFrame:
    """lang (null too), gram, count of (lang, text)."""
    common.ship(trusted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold(NAME, _drop)
        held: dict[str | None, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "gram", "count"])
            held.clear()

        for b in batches:
            langs = b.column(0).to_pylist()
            for i, lang in enumerate(langs):
                if b.column(1)[i].is_valid:
                    if lang not in held and len(held) >= 4:
                        yield from flush()
                    c = held.setdefault(lang, np.zeros(CELLS, np.int64))
                    for g in grams(b.column(1)[i].as_buffer().to_pybytes()):
                        np.add.at(c, g, 1)
        yield from flush()
        common.release()

    found = trusted.select(F.col("lang").cast("string"), F.col("text").cast("binary")).mapInArrow(run, "lang string, gram int, count long")
    return found.groupBy("lang", "gram").agg(F.sum("count").alias("count"))


def with_all(counts: DataFrame) -> DataFrame:
    """counts of the known languages, and those of all texts together under `*`."""
    return counts.where("lang is not null").unionByName(counts.groupBy("gram").agg(F.sum("count").alias("count")).select(F.lit(ALL).alias("lang"), "gram", "count"))


def placed(gram: np.ndarray) -> np.ndarray:
    """Where an n-gram lies: contexts are dealt out over the shards, the symbols after one stay together."""
    return gram // SYMBOLS * SPREAD % CONTEXTS * SYMBOLS + gram % SYMBOLS


def tables(counts: DataFrame) -> DataFrame:
    """lang, shard, costs (zlib of -log p * 2048 in 16 bits, by place) and the language's mean score; a group has CELLS rows at most."""

    def run(group: pa.Table) -> pa.Table:
        common.hold(NAME, _drop)
        c = np.zeros(CELLS, np.int64)
        c[group["gram"].to_numpy()] = group["count"].to_numpy()
        small = np.minimum(np.round(-kneser_ney(c) * 2048), 65535).astype("<u2")
        at = np.flatnonzero(c)
        mean = float((small[at].astype(float) * c[at]).sum() / c.sum() / 2048)
        costs = np.empty_like(small)
        costs[placed(np.arange(CELLS))] = small
        shards = [zlib.compress(x.tobytes(), 6) for x in costs.reshape(SHARDS, WIDTH)]
        return pa.table({"lang": pa.array(group["lang"].to_pylist()[:1] * SHARDS, pa.string()), "shard": pa.array(np.arange(SHARDS, dtype=np.int32)), "costs": pa.array(shards, pa.binary()), "mean": [mean] * SHARDS})

    return counts.groupBy("lang").applyInArrow(run, "lang string, shard int, costs binary, mean double")


def _drop() -> None:
    """This operator's workers hold nothing between tasks."""


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The places of a text's n-grams, ascending, and how often each occurs."""
    at, n = np.zeros(0, np.int32), np.zeros(0, np.int64)
    for g in grams(text):
        x, k = np.unique(placed(g), return_counts=True)
        both, where = np.unique(np.concatenate([at, x]), return_inverse=True)
        at, n = both, np.bincount(where, np.concatenate([n, k]), len(both)).astype(np.int64)
    return at, n


def pack(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending 32-bit keys and their counts: gaps and counts as bytes, those beyond a byte apart."""
    gaps = np.diff(keys, prepend=np.uint32(0))
    high = gaps >> 8
    far, many = np.flatnonzero(high >= 255), np.flatnonzero(n >= 255)
    streams = [gaps.astype(np.uint8), np.minimum(high, 255).astype(np.uint8), np.minimum(n, 255).astype(np.uint8), high[far].astype("<u4"), n[many].astype("<i8")]
    head = np.array([len(keys), len(far), len(many)], "<u4").tobytes()
    code = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)
    parts = [code.compress(x.tobytes()) + code.flush(zlib.Z_FULL_FLUSH) for x in streams]
    return head + b"".join(parts) + code.flush()


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, far, many = np.frombuffer(packed[:12], "<u4").tolist()
    raw = np.frombuffer(zlib.decompress(packed[12:]), np.uint8)
    low, high, n, rest = raw[:size], raw[size : 2 * size].astype(np.uint32), raw[2 * size : 3 * size].astype(np.int64), raw[3 * size :]
    high[high == 255] = np.frombuffer(rest[: 4 * far].tobytes(), "<u4")
    n[n == 255] = np.frombuffer(rest[4 * far :].tobytes(), "<i8", many)
    return np.cumsum((high << np.uint32(8)) | low, dtype=np.uint32), n


def block_counts(texts: list[bytes]) -> list[bytes]:
    """The packed counts of each shard: keys are place * BLOCK_DOCS + number of the document."""
    keys, counts, short, of = [], [], [], []
    for i, t in enumerate(texts):
        if len(t) <= STEP:
            g = next(grams(t), np.zeros(0, np.int32))
            short.append(g), of.append(np.full(len(g), i, np.uint32))
        else:
            at, n = counted(t)
            keys.append(at.astype(np.uint32) * np.uint32(BLOCK_DOCS) + np.uint32(i)), counts.append(n)
    if short:
        x = np.sort(placed(np.concatenate(short)).astype(np.uint32) * np.uint32(BLOCK_DOCS) + np.concatenate(of))
        first = np.flatnonzero(np.diff(x, prepend=np.uint32(0xFFFFFFFF)))
        keys.append(x[first]), counts.append(np.diff(first, append=len(x)))
    x, n = np.concatenate([np.zeros(0, np.uint32), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    if len(keys) > 1:
        order = np.argsort(x)
        x, n = x[order], n[order]
    cuts = np.searchsorted(x, np.arange(SHARDS + 1, dtype=np.uint64) * (WIDTH * BLOCK_DOCS)).tolist()
    return [pack(x[a:b], n[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def shard_costs(packed: bytes, shard: int, costs: np.ndarray, docs: int) -> np.ndarray:
    """What each document of a block costs in a shard."""
    keys, n = unpack(packed)
    at = (keys // np.uint32(BLOCK_DOCS)).astype(np.int64) - shard * WIDTH
    return np.bincount(keys % np.uint32(BLOCK_DOCS), costs[at] * n.astype(float), docs).astype("<i8")


def _marked(df: DataFrame, shards: DataFrame, text: str, lang: str) -> DataFrame:
    """df with the model that judges each row and the hash of its text."""
    known = shards.select(F.col("lang").alias("__known")).where(F.col("__known") != ALL).distinct()
    t = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    met = df.join(common.bounded(known), F.col(lang).cast("string") == F.col("__known"), "left")
    return met.withColumns({"__model": F.coalesce("__known", F.lit(ALL)), "__h1": F.xxhash64(t), "__h2": F.xxhash64(F.lit(1), t)}).drop("__known")


def _packed(marked: DataFrame, text: str) -> DataFrame:
    """block, model, shard, counts, docs and, with the first shard, the documents' hashes and lengths."""
    common.ship(marked.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        common.hold(NAME, _drop)
        part, made, size = TaskContext.get().partitionId(), 0, 0
        held: dict[str, list[tuple]] = {}

        def close(model: str) -> pa.RecordBatch:
            nonlocal made, size
            docs = held.pop(model)
            size -= sum(len(d[2]) for d in docs)
            names = np.array([(a, b, len(t)) for a, b, t in docs], "<i8").tobytes()
            block, made = f"{part}-{made}-{zlib.crc32(names)}", made + 1
            counts = block_counts([t for _, _, t in docs])
            columns = [pa.array([block] * SHARDS), pa.array([model] * SHARDS), pa.array(np.arange(SHARDS, dtype=np.int32)), pa.array(counts, pa.binary()), pa.array([len(docs)] * SHARDS, pa.int32()), pa.array([names] + [None] * (SHARDS - 1), pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["block", "model", "shard", "counts", "docs", "names"])

        for b in batches:
            models, h1, h2 = (b.column(k).to_pylist() for k in (0, 1, 2))
            for i, model in enumerate(models):
                x = b.column(3)[i]
                t = x.as_buffer().to_pybytes() if x.is_valid else b""
                held.setdefault(model, []).append((h1[i], h2[i], t))
                size += len(t)
                if len(held[model]) == BLOCK_DOCS:
                    yield close(model)
                while size > BLOCK_BYTES:
                    yield close(max(held, key=lambda m: sum(len(d[2]) for d in held[m])))
                if len(held) > SLICE:
                    yield close(min(held, key=lambda m: len(held[m])))
        while held:
            yield close(next(iter(held)))
        common.release()

    rows = marked.select("__model", "__h1", "__h2", F.col(text).cast("binary"))
    return rows.mapInArrow(run, "block string, model string, shard int, counts binary, docs int, names binary")


def totals(marked: DataFrame, shards: DataFrame, text: str) -> DataFrame:
    """model, h1, h2, n (bytes), total (-log p * 2048, summed) and mean of every text: its n-gram counts joined with the sharded tables."""
    size = F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)))
    salts = common.bounded(common.written(marked.groupBy(F.col("__model").alias("model")).agg((F.floor(size / GROUP_BYTES) + 1).alias("salts")), "salts"))
    counts = _packed(marked, text).join(salts, "model").withColumn("salt", F.pmod(F.xxhash64("block"), F.col("salts"))).drop("salts")
    dealt = shards.withColumnRenamed("lang", "model").join(salts, "model").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")

    def meet(xs: pa.Table, ys: pa.Table) -> pa.Table:
        common.hold(NAME, _drop)
        sums, mean = [], None
        if xs.num_rows:
            shard, mean = ys["shard"][0].as_py(), ys["mean"][0].as_py()
            costs = np.frombuffer(zlib.decompress(ys["costs"][0].as_py()), "<u2").astype(float)
            sums = [shard_costs(c.as_py(), shard, costs, d.as_py()).tobytes() for c, d in zip(xs["counts"], xs["docs"], strict=True)]
        return pa.table([xs["block"], xs["model"], pa.array(sums, pa.binary()), xs["names"], pa.array([mean] * len(sums), pa.float64())], ["block", "model", "sums", "names", "mean"])

    keys = ["model", "shard", "salt"]
    met = counts.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(meet, "block string, model string, sums binary, names binary, mean double")

    def add(group: pa.Table) -> pa.Table:
        if group.num_rows != SHARDS:
            raise ValueError(f"a block has {group.num_rows} shards")
        total = sum(np.frombuffer(x, "<i8") for x in group["sums"].to_pylist())
        names = np.frombuffer(next(x for x in group["names"].to_pylist() if x is not None), "<i8").reshape(-1, 3)
        model, mean = group["model"][0].as_py(), group["mean"][0].as_py()
        columns = [pa.array([model] * len(names), pa.string()), *(pa.array(names[:, k].copy()) for k in range(3)), pa.array(total), pa.array([mean] * len(names), pa.float64())]
        return pa.table(columns, ["model", "h1", "h2", "n", "total", "mean"])

    return met.groupBy("block").applyInArrow(add, "model string, h1 long, h2 long, n long, total long, mean double").dropDuplicates(["model", "h1", "h2"])


def _with(marked: DataFrame, found: DataFrame) -> DataFrame:
    """marked with what was found for each text (model, h1, h2 and others, which get two underscores)."""
    own = found.select(F.col("model").alias("__m"), F.col("h1").alias("__a"), F.col("h2").alias("__b"), *[F.col(c).alias(f"__{c}") for c in found.columns[3:]])
    same = (F.col("__model") == F.col("__m")) & (F.col("__h1") == F.col("__a")) & (F.col("__h2") == F.col("__b"))
    return marked.join(own, same, "left").drop("__m", "__a", "__b")


def trusted_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    return labels.groupBy(F.col(key).alias("trusted_id")).agg(F.min(good).alias("good")).where("good and trusted_id is not null").select("trusted_id")


def judge(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """df with score (nats per symbol), limit and kept."""
    df = df.drop(*[c for c in ("score", "limit", "kept") if c in df.columns])
    ids = common.written(trusted_ids(labels), "trusted")
    trusted = lambda rows: rows.join(common.bounded(ids, common.BROADCAST_IDS), F.col("id") == F.col("trusted_id"), "left_semi")
    texts = trusted(df.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")))
    counts = common.written(with_all(common.written(count(texts), "gram-counts")), "gram-counts-all")
    shards = common.written(tables(counts), "gram-tables")
    if not shards.limit(1).count():
        return df.withColumn("score", F.lit(None).cast("double")).withColumn("limit", F.lit(None).cast("double")).withColumn("kept", F.lit(True))
    marked = _marked(df, shards, text, lang)
    rows = df.count()
    shrunk = (F.col("total") / 2048 + PRIOR * F.col("mean")) / (F.col("n") + PRIOR)
    found = common.written(totals(marked, shards, text).select("model", "h1", "h2", F.round(shrunk, 4).alias("score")), "scores", rows)
    seen = common.written(_with(trusted(marked.select(F.col(key).alias("id"), "__model", "__h1", "__h2")), found).select("__model", "__score"), "trusted-scores", rows)
    cut = F.percentile_approx("__score", F.lit(quantile), F.lit(10_000)).alias("__limit")
    limits = seen.where(F.col("__model") != ALL).groupBy(F.col("__model").alias("__of")).agg(cut).unionByName(seen.groupBy(F.lit(ALL).alias("__of")).agg(cut))
    out = _with(marked, found).join(common.bounded(common.written(limits, "limits")), F.col("__model") == F.col("__of"), "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__score").alias("score"), F.col("__limit").alias("limit"), F.coalesce(F.col("__score") <= F.col("__limit"), F.lit(True)).alias("kept"))


def score_by_join(df: DataFrame, counts: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """key, total: summed -log p of each text, by the model of its language in counts."""
    shards = common.written(tables(counts), "gram-tables")
    marked = _marked(df, shards, text, lang)
    return _with(marked, totals(marked, shards, text)).select(key, (F.col("__total") / 2048).alias("total"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score, perplexity and verdict."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judge(docs, common.table(spark, sf_dir, "labels")).select("doc_id", "lang", "score", F.exp("score").alias("perplexity"), F.col("limit").alias("max_score"), "kept")


ORACLE_SQL = None

"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find groups.

A document's set holds its distinct five-word shingles, as 64-bit hashes (A-Z lower-cased; words are
runs of non-white-space). Two documents are linked where 100 * |intersection| >= 75 * |union|.

1. Every text gives its set, a 128-bit hash of the set and a signature. Documents of equal sets are
   one class; its smallest id stands for it, so copies are never compared with each other.
2. Signatures are cut into BANDS bands of ROWS values; classes that share a band meet in a bucket. A
   link of similarity 0.75 meets nowhere with a chance of (1 - 0.75^4)^48 = 1e-8.
3. In a bucket each member is a candidate with the bucket's centre: the one whose buckets are fullest
   (the text that the copies were made of), the least id among equals. Candidates whose signatures
   agree in under ESTIMATE of their values go (6 standard deviations below 0.75, a chance as small as
   that of the bands); all others are verified on the full sets of their texts, and links become groups.
4. Then all pairs of a bucket that are still in different groups are compared on the full sets, in
   every bucket, however large: members outside the bucket's largest group against all members, in
   blocks of BLOCK set elements a side. A block counts the elements that two sets share for all its
   pairs at once; of the links it finds it returns a spanning forest, so its output is no larger than
   its input. What has joined the largest group is never compared again, so the work grows with the
   members outside times the members.
5. Links become groups: union-find inside each task, then rounds of hooking smaller labels between
   tasks until none changes. No link, group or fingerprint goes to the driver.

SuperMinHash: step j of an element's own permutation offers the value j + u to the slot that the
permutation names; a slot keeps its least value, and a document stops as soon as all slots are filled,
since later steps offer larger values. The steps run over all elements of a batch at once.

Null and empty texts and texts without words have empty sets: linked with nothing, kept. Fewer than
five words: the whole sequence is one shingle. The key, an integer, names a document: whole rows may
repeat and give repeated rows; null keys are kept and linked with nothing. Where rows of one key have
different texts, the greatest of these (by bytes) is the document's. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAME = "op8_near_dup"
WORDS = 5
PERCENT = 75
BANDS, ROWS = 48, 4
SLOTS = BANDS * ROWS
#: Set elements of one side of a block, and candidates of one salt of a hot document.
BLOCK = 400_000
SALT = 500
ESTIMATE = 0.5625
CHUNK_BYTES = 1_000_000
CHUNK_ELEMENTS = 40_000

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _drop() -> None:
    _powers.clear()


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word of a buffer of bytes that ends in a gap."""
    gap = _GAP[data]
    edge = np.diff(gap.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _tables(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data] + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    ends = ends[len(ends) - len(starts) :]
    return starts, mix((sums[ends] - sums[starts]) * down[starts] ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK_BYTES):
            size += len(texts[j]) + 1
            j += 1
        some = texts[i:j]
        data = np.frombuffer(b"\n".join(some) + b"\n", np.uint8)
        starts, words = word_hashes(data)
        cuts = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in some])).tolist()
        n = len(words)
        grams = np.zeros(max(0, n - WORDS + 1), np.uint64)
        for k in range(WORDS):
            grams = mix(grams * np.uint64(31) + words[k : n - WORDS + 1 + k]) if len(grams) else grams
        a = 0
        for b in cuts:
            if b - a >= WORDS:
                out.append(np.unique(grams[a : b - WORDS + 1]))
            elif b > a:
                h = np.array([b - a], np.uint64)
                for w in words[a:b]:
                    h = mix(h * np.uint64(37) + w)
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
            a = b
        i = j
    return out


def _signatures(elements: np.ndarray, doc: np.ndarray, n: int, slots: int) -> np.ndarray:
    sig = np.full(n * slots, np.iinfo(np.uint64).max, np.uint64)
    order = None
    for step in range(slots):
        h = mix(elements ^ mix(np.array([step + 1], np.uint64)))
        pick = step + ((h >> np.uint64(32)) % np.uint64(slots - step)).astype(np.int64)
        value = (np.uint64(step) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        rows = np.arange(len(elements))
        if order is None:
            at = pick
        else:
            at = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, step]
        np.minimum.at(sig, doc * slots + at, value)
        open_ = (sig.reshape(n, slots) == np.iinfo(np.uint64).max).any(axis=1)
        going = open_[doc]
        if not going.any():
            break
        if order is None:
            order = np.broadcast_to(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (int(going.sum()), slots)).copy()
            picked = pick[going]
            order[np.arange(len(picked)), picked] = 0
        else:
            order = order[going]
        elements, doc = elements[going], doc[going]
    return sig.reshape(n, slots)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash values of non-empty sets, a row each; equal sets have equal rows."""
    out, i = [np.zeros((0, slots), np.uint64)], 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) < CHUNK_ELEMENTS):
            size += len(sets[j])
            j += 1
        out.append(_signatures(np.concatenate(sets[i:j]), np.repeat(np.arange(j - i), [len(s) for s in sets[i:j]]), j - i, slots))
        i = j
    return np.concatenate(out)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bands = sig.reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2])
    for r in range(ROWS):
        h = mix(h * np.uint64(31) + bands[:, :, r])
    return h.view(np.int64)


def _fixed(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(np.ascontiguousarray(values).ravel()))


def sets_of(docs: DataFrame) -> DataFrame:
    """id, n, h1, h2, keys array<long> and values binary (16 bits a slot) of (id, text); null keys and values for empty sets."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold(NAME, _drop)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                sets = shingles([x or b"" for x in b.column(1).to_pylist()])
                full = [k for k, s in enumerate(sets) if len(s)]
                sig = signatures([sets[k] for k in full])
                n = np.array([len(s) for s in sets])
                both = [np.array([mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in (0x51ED27, 0xA24BAED4)]
                keys, values = [None] * len(sets), [None] * len(sets)
                small = mix(sig).astype(np.uint16)
                found = band_keys(sig).tolist()
                for k, row in enumerate(full):
                    keys[row], values[row] = found[k], small[k].tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(both[0]), pa.array(both[1]), pa.array(keys, pa.list_(pa.int64())), pa.array(values, pa.binary())], ["id", "n", "h1", "h2", "keys", "values"])
        common.release()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", F.col("text").cast("binary")).mapInArrow(run, f"id {kind}, n long, h1 long, h2 long, keys array<long>, values binary")


def _agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Of pairs a, b those whose signatures agree in ESTIMATE of their values at least."""
    with_a = pairs.join(sigs.select(F.col("id").alias("a"), F.col("values").alias("va"), F.col("n").alias("na")), "a")
    both = with_a.join(sigs.select(F.col("id").alias("b"), F.col("values").alias("vb"), F.col("n").alias("nb")), "b")
    both = both.where((F.col("na") * 100 >= F.col("nb") * PERCENT) & (F.col("nb") * 100 >= F.col("na") * PERCENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(b.num_rows, SLOTS) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= ESTIMATE))
        common.release()

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "va", "vb").mapInArrow(run, f"a {kind}, b {kind}")


def _salted(pairs: DataFrame, docs: DataFrame, side: str, into: str) -> DataFrame:
    """pairs with the text of the document named in column `side` as bytes in `into`; a document of many pairs is dealt to several tasks."""
    parts = pairs.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / SALT).alias("__parts"))
    hot = common.bounded(parts.where("__parts > 1"))
    dealt = pairs.join(hot, side, "left").withColumn("__salt", F.pmod(F.xxhash64("a", "b"), F.coalesce("__parts", F.lit(1)).cast("long"))).drop("__parts")
    ids = parts.select(F.col(side).alias("__id"), "__parts")
    texts = docs.join(common.bounded(ids, common.BROADCAST_IDS), docs["id"] == F.col("__id"))
    copies = texts.select(F.col("__id").alias(side), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)).alias("__salt"), F.col("text").cast("binary").alias(into))
    return dealt.join(copies, [side, "__salt"]).drop("__salt")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs a, b those whose full sets are similar enough."""
    both = _salted(_salted(pairs.select("a", "b"), docs, "a", "ta"), docs, "b", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold(NAME, _drop)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                x, y = (shingles([t or b"" for t in b.column(k).to_pylist()]) for k in (2, 3))
                good = [similar(len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))) for p, q in zip(x, y, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))
        common.release()

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}")


def similar(n, m, shared):
    return (100 * shared >= PERCENT * (n + m - shared)) & (shared > 0)


def groups(links: DataFrame) -> DataFrame:
    """id, label (the least id of its group) for every id in links a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p, q = root(x), root(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        if parent:
            members, roots = list(parent), [root(x) for x in parent]
            yield pa.RecordBatch.from_arrays([pa.array(members + roots, b.schema.field(0).type), pa.array(roots + members, b.schema.field(0).type)], ["a", "b"])

    kind = links.schema["a"].dataType.simpleString()
    rows = 4 * links.count()  # two documents a link, each with its root, both ways
    both = common.written(links.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}").distinct(), "forest", rows)  # of each task: member and root, both ways
    labels = common.written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels", rows)
    while True:
        offered = both.join(labels, both["b"] == labels["id"]).select(F.col("a").alias("id"), "label")
        # shortcut: the label of one's label
        jumped = labels.select(F.col("id").alias("i"), F.col("label").alias("l")).join(labels.withColumnRenamed("label", "l2"), F.col("l") == F.col("id")).select(F.col("i").alias("id"), F.col("l2").alias("label"))
        offers = offered.unionByName(jumped).withColumn("old", F.lit(None).cast(kind)).unionByName(labels.withColumn("old", F.col("label")))
        new = common.written(offers.groupBy("id").agg(F.min("label").alias("label"), F.min("old").alias("old")), "labels", rows)
        labels = new.select("id", "label")
        if not new.where("label <> old").limit(1).count():
            return labels


def classes(sets: DataFrame) -> DataFrame:
    """h1, h2, n, rep: documents of one non-empty set, and the smallest of their ids."""
    return sets.where("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"))


def _centres(met: DataFrame) -> DataFrame:
    """key, centre of each bucket: the member whose buckets are fullest, the least id among equals."""
    full = met.groupBy("id").agg(F.sum("count").alias("weight"))
    return met.join(full, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", (-F.col("id")).alias("low"))).alias("centre"))


def forest(a: np.ndarray, b: np.ndarray, parent: dict) -> list[tuple]:
    """Links that join two trees of `parent`, which they change."""
    out = []

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((min(x, y), max(x, y)))
    return out


def block_links(ids: list[np.ndarray], labels: list[np.ndarray], sets: list[list[np.ndarray]]) -> list[tuple]:
    """A spanning forest of the links between two lists of documents (ids, labels, sets) of different labels."""
    parent: dict = {}
    for x, label in zip(np.concatenate(ids).tolist(), np.concatenate(labels).tolist(), strict=True):
        parent[x] = label
        parent.setdefault(label, label)
    sizes = [np.array([len(s) for s in side], np.int64) for side in sets]
    flat = np.concatenate(sets[1])
    words, place = np.unique(flat, return_inverse=True)
    ends = np.cumsum(sizes[1])
    starts = ends - sizes[1]
    mark = np.zeros(len(words) + 1, np.int32)
    out: list[tuple] = []
    for k, own in enumerate(sets[0]):
        at = np.searchsorted(words, own)
        at = at[(at < len(words)) & (words[np.minimum(at, len(words) - 1)] == own)]
        if not len(at):
            continue
        mark[at] = 1
        shared = np.add.reduceat(mark[place], starts)
        mark[at] = 0
        good = np.flatnonzero(similar(sizes[0][k], sizes[1], shared) & (labels[1] != labels[0][k]))
        if len(good):
            out += forest(np.full(len(good), ids[0][k]), ids[1][good], parent)
    return out


def _blocks(left: DataFrame, marked: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: a spanning forest of the links of members of left (key, id, label, n) with members of other groups of their bucket in marked."""
    count = lambda df, name: df.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK).alias(name))
    counts = count(marked, "nj").join(count(left, "ni"), "key")
    wanted = marked.select("id").distinct()
    texts = docs.join(common.bounded(wanted, common.BROADCAST_IDS), "id", "left_semi").dropDuplicates(["id"])
    kind = marked.schema["id"].dataType.simpleString()

    def side(df: DataFrame, own: str, other: str, n: str, m: str) -> DataFrame:
        spread = df.join(counts, "key").withColumn(own, F.pmod(F.xxhash64("id"), F.col(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1)))
        return spread.join(_sets(texts), "id").select(*[F.col(c).alias(c) for c in ("key", "i", "j", "id", "label", "set")])  # aliases keep the sides of cogroup() apart

    def run(xs: pa.Table, ys: pa.Table) -> pa.Table:
        common.hold(NAME, _drop)
        sides = [t.combine_chunks() for t in (xs, ys)]
        links = []
        if all(len(t) for t in sides):
            links = block_links([t["id"].to_numpy() for t in sides], [t["label"].to_numpy() for t in sides], [[np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()] for t in sides])
        a, b = ([x[k] for x in links] for k in (0, 1))
        common.release()
        return pa.table([pa.array(a, xs.schema.field("id").type), pa.array(b, xs.schema.field("id").type)], ["a", "b"])

    met = side(left, "i", "j", "ni", "nj").groupBy("key", "i", "j").cogroup(side(marked, "j", "i", "nj", "ni").groupBy("key", "i", "j"))
    return met.applyInArrow(run, f"a {kind}, b {kind}").distinct()


def _sets(texts: DataFrame) -> DataFrame:
    """id and the sorted set as bytes of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold(NAME, _drop)
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                b = whole.slice(i, 200)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingles([x or b"" for x in b.column(1).to_pylist()])], pa.binary())], ["id", "set"])
        common.release()

    return texts.select("id", F.col("text").cast("binary")).mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, set binary")


def _ordered(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def detect(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id, kept. Keys are integers."""
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    sets = common.written(sets_of(docs), "sets")
    texts_of = sets.where("id is not null").groupBy("id").agg(F.count_distinct("n", "h1", "h2").alias("texts"))
    if texts_of.where("texts > 1").limit(1).count():
        one = docs.where("id is not null").groupBy("id").agg(F.max("text").alias("text"))
        docs = common.written(docs.select("id").join(one, "id").unionByName(docs.where("id is null")), "documents")
        sets = common.written(sets_of(docs), "sets")
    reps = common.written(classes(sets), "classes", sets.count())
    sigs = common.written(sets.select("id", "n", "keys", "values").dropDuplicates(["id"]).join(reps.select(F.col("rep").alias("id")), "id", "left_semi"), "signatures")
    rows = sigs.select(F.explode("keys").alias("key"), "id", "n")
    met = common.written(rows.join(rows.groupBy("key").count().where("count > 1"), "key"), "buckets", BANDS * reps.count())
    tried = common.written(_agreeing(_ordered(met.join(_centres(met), "key"), "id", "centre"), sigs), "candidates", met.count())
    links = common.written(_verified(tried, docs), "links", tried.count())
    labels = groups(links)
    # what the centres did not join: members outside the largest group of their bucket meet all of it
    marked = met.where("count > 2").join(labels, "id", "left").select("key", "id", "n", F.coalesce("label", "id").alias("label"))
    sizes = marked.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    heads = sizes.groupBy("key").agg(F.max_by("label", F.struct("size", (-F.col("label")).alias("low"))).alias("head"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    open_ = common.written(marked.join(heads.select("key", "head"), "key"), "open", met.count())
    left = open_.where("label <> head").drop("head")
    if left.limit(1).count():
        labels = groups(links.unionByName(common.written(_blocks(left, open_.drop("head"), docs), "links", open_.count())))
    known = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("label", "rep").alias("component_id"))
    out = sets.select("id", "n", "h1", "h2").join(known, ["h1", "h2", "n"], "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df without the documents that detect() drops: one of each group is left."""
    gone = common.written(detect(df, text, key).where("not kept").select(F.col(key).alias("__gone")).distinct(), "dropped", df.count())
    return df.join(common.bounded(gone, common.BROADCAST_IDS), F.col(key) == F.col("__gone"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group."""
    return detect(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = None

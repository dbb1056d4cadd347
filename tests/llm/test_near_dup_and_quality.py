"""op8 and op5 against brute force, and the pipeline on a small table."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from echograph.llm import common, near_dup, ngram_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus():
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, base = [], [[draw.choice(vocabulary) for _ in range(draw.choice([8, 40, 120]))] for _ in range(12)]
    for i in range(180):
        words = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 2, 4, 8])):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        rows.append((i, " ".join(words).title() if i % 3 else "\t".join(words)))
    rows += [(180, None), (181, ""), (182, "two words"), (183, "TWO  words"), (184, " \n"), (185, "Ä ä"), (186, "ä ä"), (187, " ".join(vocabulary * 40)), (188, " ".join(vocabulary * 40) + " end")]
    return rows


def test_groups_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, id string")
    got = near_dup.detect(df).collect()
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = near_dup.keep_one(df)
    assert left.columns == df.columns and left.count() == len({c for _, c in want.values()})


def test_small_blocks_and_salts(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 300)
    monkeypatch.setattr(near_dup, "SALT", 3)
    rows = corpus()
    got = near_dup.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_block_links_equal_brute_force():
    draw = np.random.default_rng(0)
    for _ in range(50):
        base = draw.integers(0, 60, 40)
        sets = [[np.unique(np.where(draw.random(40) < draw.choice([0.02, 0.1, 0.4]), draw.integers(100, 200, 40), base)).astype(np.uint64) for _ in range(12)] for _ in range(2)]
        ids = [np.arange(12), np.arange(12, 24)]
        labels = [draw.integers(0, 6, 12) + 100, draw.integers(0, 6, 12) + 100]
        links = near_dup.block_links(ids, labels, sets)
        parent = {}

        def root(x, parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        want = {}
        for side in (0, 1):
            for x, lab in zip(ids[side].tolist(), labels[side].tolist(), strict=True):
                for p in (parent, want):
                    p[root(x, p)] = root(lab, p)
        for x, y in links:
            parent[root(x, parent)] = root(y, parent)
            n, m, c = len(sets[0][x]), len(sets[1][y - 12]), len(np.intersect1d(sets[0][x], sets[1][y - 12]))
            assert 100 * c >= 75 * (n + m - c)
        for x in range(12):
            for y in range(12):
                c = len(np.intersect1d(sets[0][x], sets[1][y]))
                if 100 * c >= 75 * (len(sets[0][x]) + len(sets[1][y]) - c):
                    want[root(x, want)] = root(y + 12, want)
        part = lambda p: {frozenset(x for x in range(24) if root(x, p) == r) for r in {root(x, p) for x in range(24)}}
        assert part(parent) == part(want)


def test_large_buckets_are_exhaustive(spark, monkeypatch):
    """Copies a little too far from their source: their links with each other share large buckets only, of which neither is a centre."""
    monkeypatch.setattr(near_dup, "BLOCK", 5_000)
    draw, rows = random.Random(2), []
    for i in range(300):
        words = [f"w{k}" for k in range(150)]
        for own, n in (("", 3), ("m0", 1)):
            for p in draw.sample(range(5, 145, 5), n):
                words[p] = f"g{i}{own}p{p}"
        rows.append((i, " ".join(words)))
    got = near_dup.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_repeated_rows_and_null_keys(spark):
    text = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(5, text), (5, text), (9, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dup.detect(df).collect())
    assert [g for g in got if g[0] > 0] == [(5, 5, True), (5, 5, True), (9, 5, False)] and len(got) == 5
    assert near_dup.detect(df.limit(0)).count() == 0
    other = "z" + text
    clash = spark.createDataFrame([(5, text, "a"), (5, other, "b"), (8, text, "c"), (9, other, "d"), (None, text, "e")], "doc_id long, text string, gone string")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in near_dup.detect(clash).collect()) == sorted([(-1, -1), (5, 5), (5, 5), (8, 5), (9, 5)])
    assert near_dup.keep_one(clash).columns == clash.columns


def test_superminhash_estimates_similarity():
    values = near_dup.mix(np.arange(100_000, dtype=np.uint64))
    found = []
    for k in range(150):
        part = values[k * 400 : k * 400 + 400]
        a, b = near_dup.signatures([np.sort(part[:340]), np.sort(part[60:])])
        found.append((a == b).mean())
    assert abs(np.mean(found) - 0.7) < 0.01
    one = near_dup.signatures([values[:3]])
    assert one.max() >> np.uint64(32) < near_dup.SLOTS  # every slot is filled, by step 191 at the latest


def prose(draw, words, n):
    return " ".join(draw.choice(words) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    words = ["the", "and", "thing", "reading", "station", "other", "water", "under", "listen", "garden"]
    good = [prose(draw, words, draw.randint(5, 120)) for _ in range(300)]
    bad = ["".join(c + draw.choice("#$%&") for c in prose(draw, words, 40)) for _ in range(40)]
    return good, bad


def test_classifier_keeps_clean_and_rejects_junk(spark, texts):
    good, bad = texts
    rows = [(i, t, "en", "s", i) for i, t in enumerate(good + bad)] + [(900, None, "en", "s", 0), (901, "", None, "s", 0), (902, good[0], "xx", "s", 0), (None, good[1], None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200)] + [(305, 0, 0), (7, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in ngram_quality.judge(docs, labels).collect()}
    assert sum(got[i].kept for i in range(300)) >= 290
    assert not any(got[i].kept for i in range(300, 340))
    assert all(got[i].kept for i in (900, 901, 902, None))
    none = ngram_quality.judge(docs, labels.limit(0))
    assert none.where("kept").count() == len(rows)
    assert ngram_quality.judge(docs.limit(0), labels).count() == 0


def test_trusted_text_of_null_language_counts(spark, texts):
    good, bad = texts
    docs = spark.createDataFrame([(i, t, None if i % 2 else "en") for i, t in enumerate(good + bad)], "doc_id long, text string, lang string")
    counts = {r["sum(count)"] for r in ngram_quality.with_all(ngram_quality.count(docs.select("lang", "text"))).where("lang = '*'").groupBy().sum("count").collect()}
    assert counts == {sum(len(t.encode()) for t in good + bad)}
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 200, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in ngram_quality.judge(docs, labels).collect()}  # all trusted text is of null language
    assert sum(got[i].kept for i in range(300)) >= 290 and not any(got[i].kept for i in range(300, 340))


def test_scores_equal_the_join(spark, texts):
    good, bad = texts
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good[:40] + bad[:5])], "doc_id long, text string, lang string")
    counts = ngram_quality.count(docs.where("doc_id < 30").select("lang", "text"))
    joined = {r.doc_id: r.total for r in ngram_quality.score_by_join(docs, counts).collect()}
    c = np.zeros(ngram_quality.CELLS, np.int64)
    for t in good[:30]:
        for g in ngram_quality.grams(t.encode()):
            np.add.at(c, g, 1)
    table = np.round(-ngram_quality.kneser_ney(c) * 2048) / 2048
    for i, t in enumerate(good[:40] + bad[:5]):
        assert abs(joined[i] - sum(table[g].sum(dtype=float) for g in ngram_quality.grams(t.encode()))) < 1e-3


def test_verdicts_come_through_the_join(spark, texts, monkeypatch):
    """No table is sent whole: every score of judge() is a sum over shards, whatever the number of models, copies and salts."""
    monkeypatch.setattr(ngram_quality, "GROUP_BYTES", 2_000)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *_: pytest.fail("a table is sent to the tasks"))
    good, bad = texts
    rows = [(i, t, f"l{i % 20}") for i, t in enumerate(good + bad + good[:20])] + [(900, None, "l1"), (901, "", None), (902, good[0] * 3, "xx"), (None, good[1], None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, model int").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    judged = ngram_quality.judge(docs, labels)
    assert judged.columns == [*docs.columns, "score", "limit", "kept"]
    got = {r.doc_id: r for r in judged.collect()}
    assert len(got) == len(rows) == judged.count()
    models = {}
    for name in [f"l{k}" for k in range(20)] + [ngram_quality.ALL]:
        c = np.zeros(ngram_quality.CELLS, np.int64)
        for i, t, lang in rows[:200]:
            if name in (lang, ngram_quality.ALL):
                for g in ngram_quality.grams(t.encode()):
                    np.add.at(c, g, 1)
        cost = np.round(-ngram_quality.kneser_ney(c) * 2048)
        models[name] = cost, (cost * c).sum() / c.sum() / 2048
    for i, t, lang in rows:
        t = (t or "").encode()
        cost, mean = models[lang if lang in models else ngram_quality.ALL]
        total = sum(cost[g].sum() for g in ngram_quality.grams(t)) / 2048
        assert abs(got[i].score - (total + 100 * mean) / (len(t) + 100)) < 6e-5
        assert got[i].kept == (got[i].score <= got[i].limit)


def test_packed_counts_of_a_block(monkeypatch):
    draw = random.Random(6)
    block = [bytes(draw.choice(b"etaoin ,.X1\xc3\xa9") for _ in range(draw.choice([0, 1, 30, 4000]))) for _ in range(60)] + [b"a" * 5000, b""]
    want = [sum(np.bincount(ngram_quality.placed(g), minlength=ngram_quality.CELLS) for g in ngram_quality.grams(t)) for t in block]
    rows = ngram_quality.SHARDS
    whole = ngram_quality.block_counts(block)
    monkeypatch.setattr(ngram_quality, "STEP", 700)  # long texts are counted apart, slice by slice
    assert len(whole) == rows and all((x == y).all() for a, b in zip(whole, ngram_quality.block_counts(block), strict=True) for x, y in zip(ngram_quality.unpack(a), ngram_quality.unpack(b), strict=True))
    seen = np.zeros((len(block), ngram_quality.CELLS), np.int64)
    for keys, n in map(ngram_quality.unpack, whole):
        seen[keys % ngram_quality.BLOCK_DOCS, keys // ngram_quality.BLOCK_DOCS] += n
    assert all((a == b).all() for a, b in zip(seen, want, strict=True))
    cost = np.arange(ngram_quality.CELLS) % 977
    parts = [ngram_quality.shard_costs(p, k, cost[k * ngram_quality.WIDTH : (k + 1) * ngram_quality.WIDTH].astype(float), len(block)) for k, p in enumerate(whole)]
    assert sum(parts).tolist() == (seen @ cost).tolist()


def plain_kneser_ney(texts, order=4):
    """Interpolated modified Kneser-Ney over symbol classes from the textbook's formulas: dictionaries, recursion, no arrays."""
    from collections import Counter, defaultdict

    symbol = lambda text: [int(ngram_quality.CLASSES[10])] * (order - 1) + [int(ngram_quality.CLASSES[b]) for b in text]
    count = [Counter() for _ in range(order + 1)]
    for text in texts:
        x = symbol(text)
        for i in range(len(x) - order + 1):
            count[order][tuple(x[i : i + order])] += 1
    for n in range(order - 1, 0, -1):  # kinds of symbols before an n-gram
        before = defaultdict(set)
        for g in count[n + 1]:
            before[g[1:]].add(g[0])
        count[n] = Counter({g: len(b) for g, b in before.items()})
    less = {}
    for n in range(1, order + 1):
        n1, n2, n3, n4 = (max(1, sum(c == k for c in count[n].values())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        less[n] = [0, max(0, 1 - 2 * y * n2 / n1), max(0, 2 - 3 * y * n3 / n2), max(0, 3 - 4 * y * n4 / n3)]
    follow = [defaultdict(list) for _ in range(order + 1)]
    for n in range(1, order + 1):
        for g, c in count[n].items():
            follow[n][g[:-1]].append(c)

    def p(g):
        if not g:
            return 1 / ngram_quality.SYMBOLS
        n, cs = len(g), follow[len(g)].get(g[:-1])
        if not cs:
            return p(g[1:])
        d = less[n]
        c = count[n][g]
        return (c - d[min(c, 3)] + sum(d[min(k, 3)] for k in cs) * p(g[1:])) / sum(cs)

    return p, symbol


def test_model_equals_the_textbook(texts):
    good, bad = ([t.encode() for t in part] for part in texts)
    c = np.zeros(ngram_quality.CELLS, np.int64)
    for t in good[:60]:
        for g in ngram_quality.grams(t):
            np.add.at(c, g, 1)
    table = np.round(-ngram_quality.kneser_ney(c) * 2048) / 2048
    p, symbol = plain_kneser_ney(good[:60])
    for t in good[60:75] + bad[:5]:
        x = symbol(t)
        want = -sum(np.log(max(p(tuple(x[i : i + 4])), 1e-12)) for i in range(len(x) - 3))
        got = sum(table[g].sum(dtype=float) for g in ngram_quality.grams(t))
        assert abs(got - want) < 1e-3 * len(t) + 1e-2


def test_limit_is_the_quantile(spark, texts):
    good, _ = texts
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    rows = ngram_quality.judge(docs, labels, quantile=0.9).collect()
    scores = sorted(r.score for r in rows)
    assert {r.limit for r in rows} == {scores[269]} and sum(r.kept for r in rows) in range(270, 275)


def test_probabilities_sum_to_one():
    c = np.zeros(ngram_quality.CELLS, np.int64)
    rng = np.random.default_rng(0)
    np.add.at(c, rng.zipf(1.3, 50_000) % ngram_quality.CELLS, 1)
    p = np.exp(ngram_quality.kneser_ney(c).astype(float)).reshape(-1, ngram_quality.SYMBOLS).sum(axis=1)
    assert np.abs(p - 1).max() < 1e-3


def test_long_texts_are_sliced(monkeypatch):
    text = b"abc, Def 1\n" * 50
    whole = np.concatenate(list(ngram_quality.grams(text)))
    monkeypatch.setattr(ngram_quality, "STEP", 7)
    assert (np.concatenate(list(ngram_quality.grams(text))) == whole).all() and len(whole) == len(text)


def test_pipeline_stages(spark, texts, tmp_path):
    import corpus_pipeline

    good, bad = texts
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(good + bad + good[:20])] + [(990, None, None, None, 0), (991, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = common.table(spark, str(tmp_path), "documents")
    kinds = docs.dtypes
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, common.written(stage(spark, docs, str(tmp_path)), "s")
        assert k == 4 or docs.dtypes == kinds
        if k == 0:
            assert before.count() - docs.count() in range(40, 52)
        if k == 1:
            assert docs.where(F.regexp_count("text", F.lit(common.WORD)) < 10).count() == 0
        if k == 2:
            seen = brute_components([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in docs.collect()) == sorted({c for _, c in seen.values()})
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() > 0

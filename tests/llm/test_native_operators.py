"""op2, op6, op9, op10 against brute force on small tables with nulls, ties and repeated rows."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from echograph.llm import common, host_rules, mixing, shards, url_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 40, 41, 997])
def test_shards_are_a_permutation(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard"), F.lit(1).alias("slot"))
    rows = shards.assign(df, 5).collect()
    assert sorted(r.place for r in rows) == list(range(n))
    sizes = Counter(r.shard for r in rows)
    assert n < 5 or max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_shards_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i % 50 or None, f"t{i % 7}") for i in range(200)], "doc_id long, text string")
    run = lambda d: sorted((r.doc_id or 0, r.text, r.place) for r in shards.assign(d, 4, ties=["text"]).collect())
    assert run(df.repartition(7)) == run(df.coalesce(1))


def test_shard_query_columns(spark, tmp_path):
    spark.createDataFrame([(1, "héllo"), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in shards.query(spark, str(tmp_path)).collect()}
    assert [(got[i].size, got[i].text_crc32) for i in (1, 2, 3)] == [(22, zlib.crc32("héllo".encode())), (16, 0), (16, 0)]


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, capped, left = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        level = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return goal | {s: level * w[s] for s in free}
        for s in over:
            capped.add(s)
            goal[s] = most * sizes[s]
            left -= goal[s]


def narrow_of(df, **names):
    text = F.col("text") if "text" in df.columns else F.lit(None).cast("string")
    return df.select("*", mixing.name_of(F.col("key"), text).alias("__name"), F.col("source").alias("__source"), F.col("size").alias("__size"))


def test_mix(spark):
    rows = [(i, ("a", "b", None, "c")[i % 4] if i % 5 else "hot", (i * 37) % 91) for i in range(400)] + [(400, "empty", 0), (None, "a", 5), (7, "c", 80), (7, "c", 80)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "key long, source string, size long, rest string, rank double")
    narrow = common.written(narrow_of(df), "t")
    got = mixing.apply(narrow, mixing.plan(narrow)).collect()
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    goal = brute_targets(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - goal[s]) < 1e-6 and r.source_size == sizes[s] and 0 <= r.copies <= 2 for r in mine)
        assert abs(sum(r.copies * r.size for r in mine) - goal[s]) <= 46
    again = mixing.apply(narrow.repartition(5), mixing.plan(narrow.repartition(3))).collect()
    key = lambda r: (r.key or -1, r.source or "", r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.apply(narrow.limit(0), mixing.plan(narrow.limit(0))).count() == 0


def test_inclusion_is_unequal_and_as_planned(spark):
    """Over many seeds a document is taken as often as its inclusion probability says, and longer ones more often."""
    import hashlib

    sizes = [(i, ("a", "b", "c")[i % 3], 20 + 380 * (i % 7 == 0) + (i * 13) % 40) for i in range(240)]
    df = common.written(narrow_of(spark.createDataFrame(sizes, "key long, source string, size long")), "t")
    goal = {r["__s"]: r for r in mixing.plan(df).collect()}
    assert any(0.2 < g["__f"] < 0.8 for g in goal.values())
    seeds, taken, pi = 400, Counter(), {}
    for i, s, n in sizes:
        g = goal[s]
        pi[i] = g["__f"] + min(g["__f"], 1 - g["__f"]) * (n * 1000 // (n + 200) / 1000 - g["__mean"])
    for seed in range(seeds):
        for s, g in goal.items():
            mine = []
            for i, src, n in sizes:
                if src == s and g["__f"] > 0:
                    u = (int(hashlib.md5(f"k{seed}:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                    mine.append((u / (1 - u) / (pi[i] / (1 - pi[i])), i, n))
            got, need = 0, g["__need"]
            for _, i, n in sorted(mine):
                if got < need and abs(got + n - need) <= abs(got - need):
                    taken[i] += 1
                got += n
    f = {s for s, g in goal.items() if 0.2 < g["__f"] < 0.8}
    for i, s, _ in sizes:
        if s in f:
            assert abs(taken[i] / seeds - pi[i]) < 5 * (pi[i] * (1 - pi[i]) / seeds) ** 0.5 + 0.03, (i, taken[i] / seeds, pi[i])
    long = [pi[i] for i, s, n in sizes if s in f and n > 300]
    short = [pi[i] for i, s, n in sizes if s in f and n < 100]
    assert min(long) > max(short) + 0.05
    # and the operator takes the same documents as this brute force
    for seed in ("k0", "k1"):
        got = {r.key: r.copies for r in mixing.apply(df, mixing.plan(df, seed=seed), seed).collect()}
        for s, g in goal.items():
            mine = []
            for i, src, n in sizes:
                if src == s and g["__f"] > 0:
                    u = (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                    odds = u / (1 - u) / (pi[i] / (1 - pi[i]))
                    mine.append((odds / (1 + odds), i, n))
            before = 0
            for _, i, n in sorted(mine):
                more = g["__f"] > 0 and before < g["__need"] and abs(before + n - g["__need"]) <= abs(before - g["__need"])
                assert got[i] == g["__whole"] + more
                before += n


def test_mix_repeats_whole_rows(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", "w " * (i % 9), i) for i in range(60)], "doc_id long, source string, text string, size int")
    out = mixing.mix(df, common.word_count(F.col("text")))
    assert out.columns == df.columns and out.count() > 0


def brute_rules(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_host_rules(spark):
    texts = [None, "", " \n\t", "one two", "a b c d e " * 40, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11\nx1\nx1\n\n", "é# *b $c %d &e |f <g> h i j", " ".join(f"w{i % 13}" for i in range(300)), "q w e r t y q w e r t y u i o p", "\u00a0nb x\u2003y " * 8]
    df = spark.createDataFrame([(i, t, ("h1", None)[i % 2], 1) for i, t in enumerate(texts)] + [(3, "one two", None, 1)], "doc_id long, text string, source string, n_words int")
    got = host_rules.judge(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = brute_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    assert host_rules.judge(df.limit(0)).count() == 0


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(20))
    rows = [(i, "short" if i % 10 else good, "bad") for i in range(100)] + [(100 + i, good if i % 20 else "short", f"ok{i % 5}") for i in range(400)]
    kept = {r.doc_id for r in host_rules.keep(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(i < 100 for i in kept) and len(kept) == 380


def test_rows_of_one_key_are_judged_apart(spark):
    good = " ".join(f"w{i}" for i in range(20))
    rows = [(1, good, "h", "x"), (1, "short", "h", "y"), (None, "short", "h", "z"), (None, good, "h", "x"), (2, good, None, "x"), (2, good, None, "x")]
    left = host_rules.keep(spark.createDataFrame(rows, "doc_id long, text string, source string, gone string"))
    assert left.columns == ["doc_id", "text", "source", "gone"]
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == ["1", "2", "2", "None"] and left.where("text = 'short'").count() == 0


def test_url_parts_and_fixed_rules(spark):
    cases = [("http://A.example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"), ("https://x.net/de", "x.net", "/de", "net/", "block"), ("net/en", "", "", None, "allow"), (None, "", "", None, "allow"), ("s://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"), ("s://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"), ("s://a.org/fr/://b", "a.org", "/fr/://b", "org/fr/", "allow"), ("s://ÄB.net", "Äb.net", "", None, "allow")]
    pages = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.page_id: r for r in url_rules.judge(pages, labels).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)


def test_mined_rules_decide(spark):
    urls = [(i, f"http://{'spam' if i % 4 == 0 else 'fine'}.example.biz/{'win' if i % 8 == 0 else 'p'}/{i}") for i in range(400)]
    labels = [(i, 0 if i % 8 == 0 else 1) for i in range(0, 400, 2)] + [(None, 0), (0, 0)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, marks, rules=()).collect()}
    assert all((got[i] == "block") == (i % 8 == 0) for i in range(400))
    mined = url_rules.mine(pages.join(marks.withColumnRenamed("doc_id", "page_id"), "page_id").select("url", (F.col("quality") == 0).alias("bad")))
    brute = Counter()
    for r in mined.collect():
        for i, u in urls:
            if all(set(x) & set(url_tokens(u)) for x in r.need):
                brute[i] += 1
    hits = url_rules.match(pages.select("page_id", url_rules.tokens(F.col("url")).alias("tokens")), mined)
    assert {r.page_id: r.n_rules for r in hits.collect()} == dict(brute)


def brute_rules_of(labelled, least, confidence, most):
    """All token sets of telling tokens by trying each: those that reach count and confidence and have no smaller one inside."""
    from itertools import combinations

    rows = [(frozenset(url_tokens(u)), bad) for u, bad in labelled]
    share = sum(b for _, b in rows) / len(rows)
    count = lambda s: (sum(s <= r for r, _ in rows), sum(s <= r and b for r, b in rows))
    telling = [t for t in {t for r, _ in rows for t in r} if (c := count({t}))[1] >= least and c[1] > share * c[0]]
    found = []
    for size in range(1, most + 1):
        for s in map(frozenset, combinations(sorted(telling), size)):
            n, k = count(s)
            if k >= least and k >= confidence * n and not any(f < s for f in found):
                found.append(s)
    return found


@pytest.mark.parametrize("seed", range(4))
def test_mining_equals_brute_force(spark, seed):
    import random

    draw = random.Random(seed)
    urls = [(f"http://{draw.choice('ab')}.x{draw.choice('123')}.org/{draw.choice('pq')}/{draw.choice('rst')}/{draw.choice('uv')}", None) for _ in range(60)]
    urls = [(u, draw.random() < (0.95 if "/p/r" in u or "a.x1" in u else 0.1)) for u, _ in urls]
    urls += [urls[0]] * 3 + [("http://only.once/same/pages/together", True)] * 4
    mined = url_rules.mine(spark.createDataFrame(urls, "url string, bad boolean"), 0.0, 0.8, 3, 8).collect()
    want = brute_rules_of(urls, 3, 0.8, 4)
    assert want and any(len(s) > 1 for s in want) or seed
    probe = [u for u, _ in urls] + [f"http://{a}.x{b}.org/{c}/{d}/{e}" for a in "ab" for b in "123" for c in "pq" for d in "rst" for e in "uv"] + ["http://only.two/z", "http://a.once/z"]
    for u in probe:
        own = set(url_tokens(u))
        assert any(all(set(x) & own for x in r.need) for r in mined) == any(s <= own for s in want), u


def test_long_and_repeated_urls_finish(spark):
    import random
    import time

    draw = random.Random(1)
    long = "http://bad.example.biz/" + "/".join(f"s{k}" for k in range(200))
    mixed = ["http://m.example.biz/" + "/".join(f"r{k}" for k in range(200) if draw.random() < 0.5) for _ in range(40)]
    urls = [(1000 + i, long) for i in range(20)] + [(2000 + i, u) for i, u in enumerate(mixed)] + [(i, f"http://fine.example.biz/p/{i}") for i in range(40)] + [(9, None), (10, "no scheme")]
    labels = [(i, int(i < 1000 or (i >= 2000 and i % 2))) for i, _ in urls]
    pages, marks = spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")
    began = time.time()
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, marks, rules=()).collect()}
    assert all(got[1000 + i] == "block" for i in range(20)) and all(got[i] == "allow" for i in range(9)) and time.time() - began < 60
    empty = url_rules.judge(pages.limit(0), marks.limit(0))
    assert empty.count() == 0


def url_tokens(url):
    host, _, path = url.split("://")[1].partition("/")
    return [*(f"h:{x}" for x in host.split(".")), *(f"p:{x}" for x in path.split("/"))]


def test_narrow_tables_have_few_files_and_all_rows(spark):
    df = spark.range(5000).repartition(40)
    for rows, least in ((5000, 1), (0, 1), (10**9, 1)):
        got = common.written(df, "narrow", rows)
        assert sorted(r[0] for r in got.collect()) == list(range(5000))
        assert least <= len(got.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert common.written(df.where("id < 0"), "narrow", 0).count() == 0
    assert common.files(spark, 10**12) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert common.files(spark, 0) >= 1

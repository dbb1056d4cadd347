"""The engine's own semantics on hand-made rows, its registry, and its twins on a small table."""

import math
import os

import pytest
from pyspark.sql import functions as F

from echograph import catalog
from echograph.functions import text as T
from echograph.operators import features as FG
from echograph.operators import learn as ML
from echograph.operators import ranking as R
from echograph.operators import scorers as SC
from echograph.plans.common_sql import dialect
from echograph.sources import files

SF = "/root/testdata/sf0.001"


def test_ties_and_implicit_zeros(spark):
    scores = spark.createDataFrame([(1, k, s) for k, s in enumerate([3.0, 2.0, 2.0])], "target long, source long, score double")
    ranks = {r.source: r.tie_rank for r in R.tie_rank(scores).collect()}
    assert ranks == {0: 1.0, 1: 2.5, 2: 2.5}
    gold = spark.createDataFrame([(10, 1, 1), (11, 1, 5)], "record long, target long, source long")
    got = {r.record: (r.rank, r.hit) for r in R.gold_rank(scores, gold, 6).collect()}
    assert got == {10: (2.5, True), 11: (5.0, False)}


def test_three_percentiles(spark):
    scores = spark.createDataFrame([(1, k, s) for k, s in enumerate([1.0, 2.0, 2.0, 4.0, 5.0])], "target long, source long, score double")
    got = {r.source: (r.pct_order, r.pct_average, r.pct_below) for r in R.percentiles(scores).collect()}
    assert got[1] == (0.2, 0.375, 0.2) and got[2] == (0.4, 0.375, 0.2) and got[4] == (0.8, 1.0, 0.8)


def test_quantile_bins_differ_from_ntile(spark):
    bins = [r.b for r in spark.range(7).select(R.quantile_bin([F.col("id")], 3).alias("b"), "id").orderBy("id").collect()]
    assert bins == [0, 0, 0, 1, 1, 2, 2]


def test_islands(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 7, 8, 8)], "g string, v long")
    assert sorted((r.first, r.last, r.n) for r in R.islands(df, ["g"], "v").collect()) == [(1, 3, 3), (7, 8, 2)]


def test_capped_top(spark):
    df = spark.createDataFrame([(t, s, float(10 - s - t)) for t in range(3) for s in range(4)], "target long, source long, score double")
    rows = R.capped_top(df, 2, 4).collect()
    assert len(rows) == 4 and max(sum(r.target == t for r in rows) for t in range(3)) <= 2


@pytest.mark.parametrize("word,want", [("onely", "only"), ("reading", "read"), ("nations", "nation"), ("bed", "bed"), ("exceedingly", "exceed")])
def test_stem(spark, word, want):
    assert spark.createDataFrame([(word,)], "w string").select(T.stem(F.col("w")).alias("s")).first().s == want


def test_tokens_of_null(spark):
    assert spark.createDataFrame([(None,), ("A bc De",)], "t string").select(T.tokens(F.col("t")).alias("x")).collect() == [([],), (["bc", "de"],)]


def test_longest_run_and_bm25(spark):
    make = lambda rows: FG.token_table(spark.createDataFrame(rows, "unit long, text string"))
    t, s = make([(1, "aa bb cc dd xx"), (2, "zz")]), make([(7, "yy bb cc dd"), (8, "aa")])
    assert {(r.target, r.source): r.score for r in SC.longest_run(t, s).collect()} == {(1, 7): 3, (1, 8): 1}
    bm = {(r.target, r.source): r.score for r in SC.bm25(FG.bag(FG.unigrams(t)), FG.bag(FG.unigrams(s))).collect()}
    want = 3 * math.log(1 + 1.5 / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 4 / 2.5))
    assert abs(bm[(1, 7)] - want) < 1e-5


def test_cosine_of_itself_is_one(spark):
    bag = FG.bag(FG.unigrams(FG.token_table(spark.createDataFrame([(1, "aa bb"), (2, "bb cc"), (3, "dd")], "unit long, text string"))))
    assert all(abs(r.score - 1) < 1e-6 for r in SC.cosine(bag, bag).where("target = source").collect())


def test_fit_separates():
    import numpy as np

    x = np.array([[0.0, 1], [1, 0], [5, 1], [6, 0]])
    model = ML.fit(x, np.array([0.0, 0, 1, 1]))
    assert (ML.score(x, model)[2:] > ML.score(x, model)[:2].max()).all()


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "x"\ty'), ("2", "b")], "id string, t string")
    files.write_tsv(df, str(tmp_path / "a"))
    assert sorted(r.t for r in files.read_tsv(spark, str(tmp_path / "a"), ["id", "t"]).collect()) == ["b", 'say "x" y']
    with pytest.raises(files.EmptyInput):
        files.not_empty(df.limit(0), "a")
    ranks = spark.createDataFrame([("m", "r1", 3), ("m", "r2", None)], "label string, record string, rank int")
    files.append_ranks(ranks, str(tmp_path / "r"))
    assert sorted((r.record, r.rank) for r in files.read_ranks(spark, str(tmp_path / "r")).collect()) == [("r1", 3), ("r2", None)]
    assert files.pending(df, df.where("id = 1"), "id").count() == 1


def test_annotations_scores_vectors_and_archives(spark, tmp_path):
    import zipfile

    import numpy as np

    rows = [("u1", ["a", "b"], ["X", "Y"], [-1, 0], ["ROOT", "obj"]), ("u2", ["c"], ["X"], None, None)]
    df = spark.createDataFrame(rows, "id string, lemmas array<string>, pos array<string>, heads array<int>, rels array<string>")
    files.write_annotations(df, str(tmp_path / "a"))
    got = sorted((r.unit, r.pos, r.w, r.upos, r.head, r.rel) for r in files.read_annotations(spark, str(tmp_path / "a")).collect() if r.unit == "u1")
    assert got == [("u1", 0, "a", "X", None, "ROOT"), ("u1", 1, "b", "Y", 0, "obj")]
    edges = FG.dependency_edges(files.read_annotations(spark, str(tmp_path / "a"))).collect()
    assert [(e.head, e.rel, e.child) for e in edges] == [("a", "obj", "b")]
    np.savez(tmp_path / "v.npz", ids=np.array(["x", "y"]), embeddings=np.eye(2, dtype=np.float32))
    assert sorted((r.unit, r.v) for r in files.read_npz(spark, str(tmp_path / "v.npz")).collect()) == [("x", [1.0, 0.0]), ("y", [0.0, 1.0])]
    scores = spark.createDataFrame([("bm25", 1, 2, 0.5), ("run", 1, 2, 3.0)], "scorer string, target long, source long, score double")
    files.write_scores(scores, str(tmp_path / "s"))
    assert files.read_scores(spark, str(tmp_path / "s"), "run").collect()[0].score == 3.0 and files.read_scores(spark, str(tmp_path / "s")).count() == 2
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("x.txt", "from\tto\tvotes\nGen.1.1\tJoh.1.1\t5\nGen.1.2\tJer.4.23\t-1\n")
    assert sorted(tuple(r) for r in files.read_zipped_tsv(spark, str(tmp_path / "x.zip"), ["a", "b", "votes"]).collect()) == [("Gen.1.1", "Joh.1.1", "5"), ("Gen.1.2", "Jer.4.23", "-1")]


def test_windows_1251(spark):
    text = "Ёж — «Привет» № 5"
    assert spark.createDataFrame([(bytearray(text.encode("cp1251")),)], "b binary").select(T.decode_cp1251(F.col("b"))).first()[0] == text


def test_learning(spark):
    import numpy as np

    draw = np.random.default_rng(0)
    rows = [(t, s, int(s == t % 5), float((s == t % 5) * 1.0 + draw.normal()), float(draw.normal())) for t in range(40) for s in range(5)]
    pool = spark.createDataFrame(rows, "target long, source long, label int, a double, b double")
    table = pool.toPandas().sort_values(["target", "source"])
    for how in ("pointwise", "pairwise"):
        got = {(r.target, r.source): r.fused for r in ML.leave_one_target_out(pool, ["a", "b"], how).collect()}
        rest, own = table[table["target"] != 7], table[table["target"] == 7]
        x, y = ML.pairwise(rest, ["a", "b"]) if how == "pairwise" else (rest[["a", "b"]].to_numpy(), rest["label"].to_numpy(float))
        want = ML.score(own[["a", "b"]].to_numpy(), ML.fit(x, y, bias=how != "pairwise"))
        assert [got[7, s] for s in own["source"]] == pytest.approx(list(want), abs=1e-5)
    w, mean, std = ML.fit(table[["a", "b"]].to_numpy(), table["label"].to_numpy(float))
    z = np.column_stack([(table[["a", "b"]].to_numpy() - mean) / std, np.ones(len(table))])
    slope = z.T @ (1 / (1 + np.exp(-z @ w)) - table["label"].to_numpy(float)) + np.array([2.0, 2.0, 0.0]) * w
    assert np.abs(slope).max() < 1e-3
    figures = {r.label: r for r in ML.ablation(pool, {"all": ["a", "b"], "only b": ["b"]}).collect()}
    assert figures["all"].delta == 0 and figures["only b"].delta > 0
    assert ML.sample(pool, 50).count() < 120
    loo = ML.leave_one_out(pool.where("source < 2").selectExpr("target * 10 + source AS unit", "label AS y", "a"), ["a"])
    assert loo.count() == 80


def test_numbered_places(spark):
    from echograph.plans import common_sql as C

    C.INPUTS["some_rows"] = (lambda s, d: s.createDataFrame([(u, (u * 7) % 4) for u in range(50)], "unit long, len long"), "", ())
    got = {r.unit: (r.pos, r.n) for r in C.run(spark, SF, C.numbered("some_rows", "len", chunk=8)).collect()}
    order = sorted(range(50), key=lambda u: ((u * 7) % 4, u))
    assert got == {u: (k, 50) for k, u in enumerate(order)}


def test_stream_counts_equal_batch(spark, tmp_path):
    from echograph.streaming import events as EV

    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(2).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "events"))
    q = EV.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, EV.windowed_counts(batch).collect()))


def test_dialects():
    assert dialect("MEDIAN(x + f(y))", "spark") == "percentile(x + f(y), 5e-1)" and "quantile_cont" in dialect("MEDIAN(x)", "duck")


def test_every_query_has_a_name_and_twins_are_known():
    assert len(catalog.queries()) > 150 and set(catalog.oracle_sql()) <= set(catalog.queries())


TWINS = ["sc_bm25_top3", "fg_stem", "fg_wl", "sc_run", "sc_lcs", "ag_auc", "ag_topmean", "mt_holm", "pt_fisher", "io_chunk", "io_notes", "io_wiki", "pf_idparse", "pf_reftext", "st_pool", "rr_fuse", "rr_hub", "rr_graph", "rr_xref", "ln_reg", "ln_zknn", "bs_aucdiff", "ga_synth", "jd_auc", "jn_band"]


@pytest.mark.parametrize("name", TWINS)
def test_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    ours = catalog.queries()[name](spark, SF)
    names = sorted(ours.columns)
    plain = lambda v: None if v is None else (round(v, 6) if isinstance(v, float) else v)
    a = sorted((tuple(plain(r[c]) for c in names) for r in ours.collect()), key=repr)
    rel = con.sql(f"SELECT {', '.join(names)} FROM ({catalog.oracle_sql()[name]})")
    b = sorted((tuple(plain(float(v) if type(v).__name__ == 'Decimal' else v) for v in r) for r in rel.fetchall()), key=repr)
    assert len(a) == len(b) and all(x == pytest.approx(y, abs=2e-6) if isinstance(x, float) else x == y for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))

"""Steps that must not grow faster than their input: what is shuffled, sent or made from a part only."""

import pytest

from echograph import catalog
from echograph.operators import features as FG
from echograph.operators import scorers as SC

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def units(spark, rows):
    return spark.createDataFrame(rows, "unit long, text string")


def test_bags_are_counted_inside_a_row(spark):
    rows = [(1, "aa bb aa cc aa bb dd"), (2, ""), (3, None), (4, "zz")]
    lists = FG.word_lists(units(spark, rows))
    for made, kept in ((FG.word_features(lists), None), (FG.ngram_lists(lists, (1, 2, 3)), None), (FG.gap_lists(lists), None), (FG.skip_lists(lists), None), (FG.chain_pair_lists(lists), None), (FG.chain_label_lists(lists), None)):
        bag = FG.counted(made)
        assert "Exchange" not in plan(bag)
        slow = {}
        for r in made.collect():
            for f in r.fs or []:
                slow[r.unit, f] = slow.get((r.unit, f), 0) + 1
        assert {(r.unit, r.f): r.tf for r in bag.collect()} == slow


def test_lists_of_the_tree_equal_its_edges(spark):
    rows = [(u, " ".join(f"w{chr(97 + (u * k * k) % 7)}" for k in range(n))) for u, n in enumerate((0, 1, 2, 3, 4, 8, 23))]
    tok = FG.token_table(units(spark, rows))
    lists, edges = FG.word_lists(units(spark, rows)), FG.dependency_edges(FG.chain_topology(tok))
    bag = lambda df: sorted(tuple(r) for r in FG.bag(df.select("unit", "f")).collect())
    row = lambda df: sorted(tuple(r) for r in FG.counted(df).collect())
    for mode in ("plain", "collapsed", "soft"):
        assert row(FG.chain_edge_lists(lists, mode)) == bag(FG.edge_keys(edges, mode))
    assert row(FG.chain_pair_lists(lists)) == bag(FG.dependency_pairs(edges))
    assert row(FG.chain_pair_lists(lists, (2,))) == bag(FG.dependency_pairs(edges).where("distance = 2"))
    assert row(FG.chain_label_lists(lists)) == bag(FG.wl_labels(edges, tok))


def test_characters_of_a_long_text(spark):
    text = "äb c" * 30_000  # places in a string of several bytes a character are found by going through it: quadratic
    got = FG.counted(FG.char_lists(units(spark, [(1, text), (2, "a"), (3, None)]))).collect()
    assert sum(r.tf for r in got if r.unit == 1) == len(text) + 2 - 3 and [r.f for r in got if r.unit == 2] == [" a "] and not [r for r in got if r.unit == 3]


@pytest.mark.parametrize("name", ["fg_deppath", "fg_gap", "fg_char4", "sc_deppair", "sc_char4", "sc_ngram", "sc_runmatch"])
def test_features_are_not_shuffled(spark, name):
    text = plan(catalog.queries()[name](spark, SF))
    assert "Window" not in text and "SortMergeJoin" not in text
    if name.startswith("fg"):
        assert text.count("Exchange") == 1  # sums of a unit


def test_sources_beyond_the_bound_are_joined_by_shuffle(spark):
    bag = FG.counted(FG.word_features(FG.word_lists(units(spark, [(1, "aa bb"), (2, "bb cc")]))))
    assert SC.small(bag)(bag)._jdf.queryExecution().toString().count("broadcast") and "broadcast" not in SC.small(bag, 1)(bag)._jdf.queryExecution().toString()


def test_pair_scores_come_from_one_table(spark):
    q = catalog.queries()
    for name in ("rr_cascade", "rr_fuse", "st_pool", "rr_xref"):
        assert "SortMergeJoin" not in (text := plan(q[name](spark, SF))) or name == "st_pool", text
    assert plan(q["rr_cascade"](spark, SF)).count("Exchange") == 1
    orders = plan(q["gd_order"](spark, SF))
    assert orders.count("Window [") == 0 and orders.count("FileScan") < 12  # each filter's answer is found once, not once an order


TWINS = ["rr_cascade", "st_pool", "gd_order", "st_ordercmp", "ag_cost", "ct_bridge", "ct_mech", "ct_unreached", "ag_crosstab", "jd_blind", "jd_prep", "jd_quotecheck", "jd_synth", "ln_zbin_80", "sc_char4", "sc_ngram", "sc_runmatch", "fg_gap", "fg_deppath"]


@pytest.mark.parametrize("name", TWINS)
def test_twin(spark, name):
    from test_engine import test_twin as compare

    compare(spark, name)


def test_draws_are_made_where_replicates_are(spark):
    from echograph.plans.common_sql import given

    catalog.queries()
    assert "Range (1, 5001" in plan(given(spark, SF, "draws"))  # dealt out over the cores, not exploded from one small partition
    for name in ("bs_obj", "bs_wins", "bs_aucdiff", "pt_cluster", "pt_random"):
        sent = plan(catalog.queries()[name](spark, SF)).split("BroadcastExchange")[1:]
        assert not any("Generate explode" in x for x in sent), name  # what is sent is not the draws


def test_grid_holds_no_plan_of_all_normalisers(spark):
    assert plan(catalog.queries()["ln_grid"](spark, SF)).count("FileScan") <= 2 * 23


@pytest.mark.parametrize("name", ["bs_obj", "bs_wins", "bs_aucdiff", "bs_cluster", "pt_cluster", "pt_random", "pt_sign", "ln_zbinr", "ln_grid"])
def test_twin_of_draws(spark, name):
    from test_engine import test_twin as compare

    compare(spark, name)


def test_models_are_made_of_all_rows(spark):
    import inspect

    import numpy as np

    from echograph.operators import learn as ML

    assert not hasattr(ML, "POOL_ROWS")
    assert not any("rows" in inspect.signature(f).parameters for f in (ML.leave_one_target_out, ML.leave_one_out, ML.held_out, ML.ablation))
    draw = np.random.default_rng(1)
    x, y = draw.integers(0, 4, (300, 2)).astype(float), draw.integers(0, 2, 300).astype(float)
    pool = spark.createDataFrame([(k, k, int(v), float(a), float(b)) for k, ((a, b), v) in enumerate(zip(x, y, strict=True))], "target long, source long, label int, a double, b double")
    every = ML.summed(pool, ["a", "b"])
    assert every[2].sum() == 300 and len(every[2]) < 40
    want = ML.fit(x[5:], y[5:])
    got = ML.without(every, x[:5], y[:5], True, ML.whole(every))
    assert all(np.allclose(g, w, atol=1e-7) for g, w in zip(got, want, strict=True))
    loo = {r.unit: r.fused for r in ML.leave_one_out(pool.selectExpr("target AS unit", "label AS y", "a", "b"), ["a", "b"], positives_only=False).collect()}
    rest = np.arange(300) != 7
    assert loo[7] == pytest.approx(ML.score(x[[7]], ML.fit(x[rest], y[rest]))[0], abs=2e-6)


def test_blocks_are_those_of_difflib():
    import difflib
    import random

    from echograph.operators import learn as ML

    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(0, 40))) for _ in "ab")
        m = difflib.SequenceMatcher(None, a, b, autojunk=False)
        assert ML.in_blocks(a, b) == sum(x.size for x in m.get_matching_blocks())
        x, y = a.split(), b.split()
        assert ML.words_in_blocks(x, y) == sum(k.size for k in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        if a and b:
            best = m.find_longest_match()
            assert ML.longest_block(a, b)[2] == best.size and (not best.size or ML.longest_block(a, b)[:2] == (best.a, best.b))


def test_texts_go_to_python_once(spark):
    assert "ArrowEvalPython" not in plan(catalog.queries()["sc_contain"](spark, SF))  # a text for each of its passages


def test_cosines_by_block(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [3.0, 4.0], "b"), (3, [0.0, 0.0], "a"), (4, None, "b"), (5, [1.0], "a")]
    v = spark.createDataFrame(rows, "unit long, v array<float>, label string")
    two = v.where("unit <= 3")
    got = {(r.target, r.source): r.score for r in SC.dense_cosine(v.drop("label"), two.drop("label")).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.6, (2, 1): 0.6, (2, 2): 1.0, (5, 1): None, (5, 2): None}
    best = {(r.target, r.label): r.score for r in SC.dense_cosine(v.drop("label"), two, best="label").collect()}
    assert best[2, "a"] == 0.6 and best[2, "b"] == 1.0
    assert "NestedLoop" not in plan(SC.dense_cosine(v, two))


@pytest.mark.parametrize("name", ["sc_lex2", "sc_cand_layers", "sc_syn2", "sc_emb", "sc_densewin", "gd_repro"])
def test_layers_and_dense(spark, name):
    from test_engine import test_twin as compare

    compare(spark, name)
    if name.startswith("sc_lex") or name.startswith("sc_cand"):
        assert plan(catalog.queries()[name](spark, SF)).count("Window [") <= 1

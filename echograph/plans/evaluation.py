"""Aggregations, windows, joins, pools and re-ranking over score tables."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from echograph.functions.text import MODERN
from echograph import store
from echograph.operators import features as FG
from echograph.operators import scorers as SC
from echograph.plans import base as B
from echograph.plans.common_sql import INPUTS, RANKED_GOLD, define, derive, given, instead, numbered, query

# --- aggregations ---------------------------------------------------------------------------------
query("ag_norm", "SELECT unit, round(sqrt(sum(tf * tf)), 6) AS l2, CAST(sum(tf) AS BIGINT) AS l1 FROM (SELECT unit, w, count(*) AS tf FROM {tt} GROUP BY unit, w) x GROUP BY unit")
query("ag_targetmax", "SELECT unit, score FROM {best}")
query("ag_bestpair", "SELECT target, source, max(score) AS score, count(*) AS n_scorers FROM {scores} GROUP BY target, source")
query("ag_topmean", "SELECT target, floor((sum(INTS(score)) * 2 + count(*)) / (count(*) * 2e0)) / 1e6 AS mean10 FROM {ranked} WHERE pos <= 10 GROUP BY target")
query("ag_detfeat", "SELECT target, round(max(score), 6) AS best, round(avg(CASE WHEN pos <= 3 THEN score END), 6) AS mean3, count(*) AS n FROM {ranked} GROUP BY target")
query("ag_ranksum", "SELECT count(*) AS n, round(MEDIAN(rank), 6) AS median_rank, round(QUANT(rank, 25e-2), 6) AS q25, round(QUANT(rank, 75e-2), 6) AS q75, round(avg(CASE WHEN rank <= 1 THEN 1e0 ELSE 0e0 END), 6) AS top1, round(avg(CASE WHEN rank <= 5 THEN 1e0 ELSE 0e0 END), 6) AS top5, round(avg(CASE WHEN rank <= 10 THEN 1e0 ELSE 0e0 END), 6) AS top10 FROM {rank_s1}")
query("ag_logrank", "SELECT CASE WHEN count(*) >= 5 THEN round(avg(ln(rank)), 6) END AS mean_ln_rank, count(*) AS n FROM {rank_s1}")
derive("all_ranks", "SELECT 'word' AS scorer, record, rank, hit FROM {rank_s1} UNION ALL SELECT 'bigram', record, rank, hit FROM {rank_s2} UNION ALL SELECT 'trigram', record, rank, hit FROM {rank_s3} UNION ALL SELECT 'fuse', record, rank, hit FROM {rank_fuse}")
query("ag_ceiling", "SELECT scorer, round(avg(hit * 1e0), 6) AS visible, round(MEDIAN(rank), 6) AS median_rank, round(QUANT(rank, 25e-2), 6) AS q25, round(QUANT(rank, 75e-2), 6) AS q75, round(avg(CASE WHEN rank <= 200 AND hit = 1 THEN 1e0 ELSE 0e0 END), 6) AS top200 FROM {all_ranks} GROUP BY scorer")
query("ag_recall", "SELECT k, count(*) AS n, CAST(sum(CASE WHEN rank <= k AND hit = 1 THEN 1 ELSE 0 END) AS BIGINT) AS found FROM {rank_s2} CROSS JOIN (SELECT BOTH(1, 5, 20, 100) AS k) ks GROUP BY k")
query("ag_reach", "SELECT k, round(count(DISTINCT CASE WHEN p.pos <= k THEN g.record END) * 1e0 / count(DISTINCT g.record), 6) AS reach FROM {gold} g CROSS JOIN (SELECT BOTH(1, 3, 10, 30) AS k) ks LEFT JOIN (SELECT scorer, target, source, row_number() OVER (PARTITION BY scorer, target ORDER BY score DESC, source) AS pos FROM {scores}) p ON g.target = p.target AND g.source = p.source GROUP BY k")
# a score's average rank from the counts of each score: only these go to one place
derive("by_score", "SELECT score, count(*) AS c, sum(y) AS p FROM {best} GROUP BY score")
derive("by_len", "SELECT len AS score, count(*) AS c, sum(y) AS p FROM {best} GROUP BY len")
AUC = "SELECT round((sum(p * r) - sum(p) * (sum(p) + 1) / 2e0) / (sum(p) * (sum(c) - sum(p))), 6) AS auc, CAST(sum(p) AS BIGINT) AS positives FROM (SELECT c, p, sum(c) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) - c + (c + 1) / 2e0 AS r FROM {BY}) x"
query("ag_auc", AUC.replace("{BY}", "{by_score}"))
derive("by_rank", numbered("best", "score", desc=True))
derive("positive", "SELECT unit, score FROM {best} WHERE y = 1")
derive("positives", numbered("positive", "score", desc=True))
query("ag_ap", "SELECT round(avg((hit + 1) * 1e0 / (pos + 1)), 6) AS ap FROM (SELECT a.pos, b.pos AS hit FROM {by_rank} a JOIN {positives} b ON a.unit = b.unit) x")
query("ag_ratk", "SELECT k, round(sum(CASE WHEN y = 1 AND pos < k THEN 1e0 ELSE 0e0 END) / sum(y), 6) AS recall, round(MEDIAN(CASE WHEN y = 1 THEN pos + 1 END), 6) AS median_rank FROM {by_rank} CROSS JOIN (SELECT BOTH(10, 50, 100, 200) AS k) ks GROUP BY k")
derive("up_score", numbered("best", "score"))
derive("up_len", numbered("best", "len"))
query("ag_corr", "SELECT round(corr(a.score, a.len), 6) AS pearson, round(corr(a.pos * 1e0, b.pos * 1e0), 6) AS spearman FROM {up_score} a JOIN {up_len} b ON a.unit = b.unit")
query("ag_hub", "SELECT source, count(*) AS n, round(count(*) * 1e0 / sum(count(*)) OVER (), 6) AS share, CASE WHEN count(*) * 1e0 / sum(count(*)) OVER () >= 5e-2 THEN 1 ELSE 0 END AS is_hub FROM {ranked} WHERE pos = 1 GROUP BY source")
query("ag_kappa", "SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM (SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1e0 ELSE 0e0 END) AS po, avg(quality * 1e0) * avg(toxic * 1e0) + (1 - avg(quality * 1e0)) * (1 - avg(toxic * 1e0)) AS pe FROM {labels}) x")
query("ag_bytype", "SELECT kind, count(*) AS n, round(avg(v), 6) AS mean, round(avg(CASE WHEN v >= 5e-1 THEN 1e0 ELSE 0e0 END), 6) AS share_high, round(avg(v) - max(g), 6) AS contrast FROM {verdicts} CROSS JOIN (SELECT avg(v) AS g FROM {verdicts} WHERE kind = 'gold') z GROUP BY kind")
query("ag_crosstab", "SELECT CASE WHEN b.rare > 0 AND b.bigram = 1 THEN 'both' WHEN b.rare > 0 THEN 'rare' WHEN b.bigram = 1 THEN 'run' ELSE 'none' END AS bucket, CASE WHEN r.rank <= 10 THEN 1 ELSE 0 END AS reachable, count(*) AS n FROM {bridge} b JOIN {rank_s1} r ON b.record = r.record GROUP BY 1, 2")
query("ag_dups", "SELECT count(*) AS n_groups, CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_extra FROM (SELECT d.source AS place, g.source, count(*) AS c FROM {gold} g JOIN {documents} d ON g.target = d.doc_id GROUP BY d.source, g.source, md5(d.text)) x WHERE c > 1")
derive("per_target", "SELECT u.chapter, g.target, count(*) AS n FROM {gold} g JOIN {units} u ON g.target = u.unit GROUP BY u.chapter, g.target")
query("ag_rangeshare", "SELECT chapter, round(share, 6) AS share, CASE WHEN share > base + 5e-2 THEN 1 ELSE 0 END AS inflated FROM (SELECT chapter, avg(CASE WHEN n > 1 THEN 1e0 ELSE 0e0 END) AS share FROM {per_target} GROUP BY chapter) x CROSS JOIN (SELECT avg(CASE WHEN n > 1 THEN 1e0 ELSE 0e0 END) AS base FROM {per_target}) b")
query("ag_countdist", "SELECT count(DISTINCT w) AS vocabulary, count(DISTINCT unit) AS units, count(*) AS n FROM {tt}")
query("ag_parmax", "SELECT target, max(score) AS score, min(CASE WHEN pos = 1 THEN source END) AS best_source FROM {ranked} GROUP BY target")
query("ag_chunkmax", "SELECT unit, max(n) AS longest_chunk_vocabulary FROM (SELECT unit, floor(pos / 128) AS chunk, count(DISTINCT w) AS n FROM {tt} GROUP BY unit, floor(pos / 128)) x GROUP BY unit")
derive("band", "SELECT p.unit AS positive, p.score AS ps, q.unit AS negative, q.score AS qs, p.len AS pl, q.len AS ql FROM (SELECT unit, score, len, BOTH(floor(ln(len + 1) / ln(125e-2)) - 1, floor(ln(len + 1) / ln(125e-2)), floor(ln(len + 1) / ln(125e-2)) + 1) AS b FROM {best} WHERE y = 1) p JOIN (SELECT unit, score, len, floor(ln(len + 1) / ln(125e-2)) AS b FROM {best} WHERE y = 0) q ON p.b = q.b")
query("ag_matchauc", "SELECT round(avg(auc), 6) AS auc, count(*) AS n FROM (SELECT positive, avg(CASE WHEN ps > qs THEN 1e0 WHEN ps = qs THEN 5e-1 ELSE 0e0 END) AS auc, count(*) AS m FROM {band} WHERE pl > 0 AND ql * 12 >= pl * 10 AND ql * 10 <= pl * 12 GROUP BY positive) x WHERE m >= 5")
query("ag_matchauc2", "SELECT round(avg(CASE WHEN ps > qs THEN 1e0 WHEN ps = qs THEN 5e-1 ELSE 0e0 END), 6) AS auc, count(*) AS pairs FROM {band} WHERE abs(pl - ql) * 10 <= 2 * greatest(pl, ql)")
query("ag_stability", "SELECT record, kind, source, max(v) - min(v) AS spread, CASE WHEN count(DISTINCT CASE WHEN v >= 2 THEN 1 ELSE 0 END) > 1 THEN 1 ELSE 0 END AS flips, round(avg(CASE WHEN v = v0 THEN 1e0 ELSE 0e0 END), 6) AS agrees FROM {repeats} GROUP BY record, kind, source")
# passages of three consecutive sources, read in the order of their score; a source counts where it is first read
derive("passage_list", "SELECT target, source + d AS seen, min(pos) AS pos FROM (SELECT target, source, pos, BOTH(-1, 0, 1) AS d FROM {ranked}) x WHERE source + d IN (SELECT item_id FROM {benchmark}) GROUP BY target, source + d")
instead("passage_list", "SELECT target, source + d AS seen, min(pos) AS pos FROM (SELECT target, source, pos, BOTH(-1, 0, 1) AS d FROM {ranked_gold}) x WHERE source + d IN (SELECT item_id FROM {benchmark}) GROUP BY target, source + d")
query("ag_cost", "SELECT record, target, min(read) AS sources_read, max(CASE WHEN read <= 10 THEN 1 ELSE 0 END) AS within_10 FROM (SELECT g.record, g.target, count(DISTINCT e.seen) AS read FROM {gold} g JOIN {passage_list} r ON g.target = r.target AND g.source = r.seen JOIN {passage_list} e ON e.target = r.target AND e.pos <= r.pos GROUP BY g.record, g.target, r.pos) x GROUP BY record, target")
query("ag_rollup", "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM {documents} GROUP BY ROLLUP (lang, source)")

# --- windows --------------------------------------------------------------------------------------
query("wn_tierank", "SELECT * FROM {rank_s1}")
query("wn_stablerank", "SELECT g.record, min(r.pos) AS rank FROM {gold} g JOIN {ranked} r ON g.target = r.target AND g.source = r.source GROUP BY g.record")
query("wn_pct", "SELECT target, source, round((row_number() OVER (PARTITION BY target ORDER BY score, source) - 1) * 1e0 / count(*) OVER (PARTITION BY target), 6) AS pct_order, round((rank() OVER (PARTITION BY target ORDER BY score) + (count(*) OVER (PARTITION BY target, score) - 1) / 2e0 - 1) / greatest(count(*) OVER (PARTITION BY target) - 1, 1), 6) AS pct_average, round((rank() OVER (PARTITION BY target ORDER BY score) - 1) * 1e0 / count(*) OVER (PARTITION BY target), 6) AS pct_below FROM {s1}")
query("wn_topk", "SELECT target, source, score, CAST(pos AS INT) AS pos FROM {ranked} WHERE pos <= 5")
query("wn_captop", "SELECT target, source, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS n FROM {ranked} WHERE pos <= 2) x WHERE n <= 20 ORDER BY score DESC, target, source LIMIT 100")
query("wn_salience", "SELECT target, round((max(score) - avg(score)) / stddev_pop(score), 6) AS z, count(*) AS n FROM {s1} GROUP BY target HAVING count(*) >= 10 AND stddev_pop(score) > 1e-9")
derive("binned", "SELECT unit, len, y, score, CAST(least(9, floor(pos * 10 / n)) AS INT) AS bin, pos, n FROM {up_len}")
query("wn_qbin", "SELECT unit, bin FROM {binned}")
query("wn_knnwin", "SELECT unit, CAST(greatest(0, least(pos - 25, n - 50)) AS BIGINT) AS lo, CAST(greatest(0, least(pos - 25, n - 50)) + least(50, n) AS BIGINT) AS hi FROM {binned}")
query("wn_neighadj", "SELECT unit, lag(unit) OVER (PARTITION BY chapter ORDER BY ord) AS previous_unit, lead(unit) OVER (PARTITION BY chapter ORDER BY ord) AS next_unit FROM {units}")
query("wn_carry", "SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM {conversations}")
query("wn_islands", "SELECT target, min(source) AS first, max(source) AS last, count(*) AS n FROM (SELECT target, source, source - row_number() OVER (PARTITION BY target ORDER BY source) AS island FROM {s2}) x GROUP BY target, island")
query("wn_wordwin", "SELECT source, target, start, n FROM (SELECT source, target, start, n, row_number() OVER (PARTITION BY source, target ORDER BY n DESC, start) AS r FROM (SELECT source, target, start, count(DISTINCT w) AS n FROM (SELECT g.source, g.target, t.w, t.pos, SEQ(CAST(greatest(floor(t.pos / 30) - 7, 0) AS INT), CAST(floor(t.pos / 30) AS INT)) AS start FROM {gold} g JOIN {tt} t ON g.target = t.unit JOIN (SELECT DISTINCT unit, w FROM {st}) s ON s.unit = g.source AND s.w = t.w) a WHERE pos < start * 30 + 220 GROUP BY source, target, start) b) c WHERE r = 1")

# --- joins ----------------------------------------------------------------------------------------
query("jn_equi", "SELECT t.unit AS target, s.unit AS source, count(*) AS n FROM {tt} t JOIN {st} s ON t.w = s.w WHERE length(t.w) >= 8 GROUP BY t.unit, s.unit")
query("jn_range", "SELECT o.o_orderkey, count(*) AS n FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL '30' DAY GROUP BY o.o_orderkey")
query("jn_band", "SELECT positive, count(*) AS n FROM {band} WHERE ql * 12 >= pl * 10 AND ql * 10 <= pl * 12 GROUP BY positive")
query("jn_nearest", "SELECT target, source FROM (SELECT r.target, r.source, row_number() OVER (PARTITION BY r.target ORDER BY abs(r.source - floor(u.ord * n.n / c.m)), r.source) AS n FROM {ranked} r JOIN (SELECT target, max(score) AS top FROM {ranked} GROUP BY target) m ON r.target = m.target AND r.score >= m.top - 2e-2 JOIN {units} u ON r.target = u.unit JOIN (SELECT chapter, count(*) AS m FROM {units} GROUP BY chapter) c ON u.chapter = c.chapter CROSS JOIN {n_src} n) x WHERE n = 1")
query("jn_offset", "SELECT a.unit, b.unit AS neighbour, round(1e0 / abs(a.ord - b.ord), 6) AS weight FROM (SELECT unit, chapter, ord, BOTH(-2, -1, 1, 2) AS d FROM {units}) a JOIN {units} b ON a.chapter = b.chapter AND b.ord = a.ord + a.d")
query("jn_cross", "SELECT u.unit AS target, b.item_id AS source, coalesce(s.score, 0e0) AS score FROM {units} u CROSS JOIN {benchmark} b LEFT JOIN {s2} s ON u.unit = s.target AND b.item_id = s.source WHERE u.y = 1")
query("jn_leftfill", "SELECT r.target, r.source, coalesce(s.score, 0e0) AS bigram, CASE WHEN s.score IS NULL THEN 1 ELSE 0 END AS missed FROM {ranked} r LEFT JOIN {s2} s ON r.target = s.target AND r.source = s.source WHERE r.pos <= 10")
query("jn_unionkeys", "SELECT coalesce(a.target, b.target) AS target, coalesce(a.source, b.source) AS source, coalesce(a.score, 0e0) AS bigram, coalesce(b.score, 0e0) AS trigram FROM {s2} a FULL OUTER JOIN {s3} b ON a.target = b.target AND a.source = b.source")
query("jn_semi", "SELECT unit, len FROM {units} WHERE unit IN (SELECT target FROM {gold})")
query("jn_anti", "SELECT u.unit, u.len FROM {units} u LEFT JOIN {gold} g ON u.unit = g.target WHERE g.target IS NULL")
derive("wb", "SELECT unit, w, tf * ln(n.n * 1e0 / df) AS x FROM (SELECT unit, w, count(*) AS tf FROM {st} GROUP BY unit, w) a JOIN (SELECT w AS v, count(DISTINCT unit) AS df FROM {st} GROUP BY w) d ON a.w = d.v CROSS JOIN {n_src} n")
derive("sim", "SELECT d.a, d.b, round(d.dot / (x.n * y.n), 6) AS score FROM (SELECT p.unit AS a, q.unit AS b, sum(p.x * q.x) AS dot FROM {wb} p JOIN {wb} q ON p.w = q.w AND p.unit <> q.unit GROUP BY p.unit, q.unit) d JOIN (SELECT unit, sqrt(sum(x * x)) AS n FROM {wb} GROUP BY unit) x ON d.a = x.unit JOIN (SELECT unit, sqrt(sum(x * x)) AS n FROM {wb} GROUP BY unit) y ON d.b = y.unit WHERE x.n > 0 AND y.n > 0")
derive("selfsim", "SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n FROM {sim}) x WHERE n <= 5")
query("jn_selfsim", "SELECT * FROM {selfsim}")
query("jn_nlcov", "SELECT target, source, score FROM (SELECT s.target, s.source, s.score, row_number() OVER (PARTITION BY s.source ORDER BY s.score DESC, s.target) AS n FROM {s1} s JOIN {s2} b ON s.target = b.target AND s.source = b.source WHERE s.score >= 8e-1) x WHERE n <= 3")
query("jn_setcmp", "SELECT t.target, CASE WHEN g.n IS NULL THEN 'new' WHEN g.hit > 0 THEN 'agree' ELSE 'diverge' END AS state FROM (SELECT DISTINCT target FROM {s3} WHERE score >= 5e-1) t LEFT JOIN (SELECT g.target, count(*) AS n, sum(CASE WHEN s.score >= 5e-1 THEN 1 ELSE 0 END) AS hit FROM {gold} g LEFT JOIN {s3} s ON g.target = s.target AND g.source = s.source GROUP BY g.target) g ON t.target = g.target")
# a dictionary of forms: the spellings that the stems know, and for each word of ten letters or more its first eight
derive("modern", "SELECT form, max(modern) AS modern FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS form, '{b}' AS modern" for a, b in MODERN.items()) + " UNION ALL SELECT w, substr(w, 1, 8) FROM {word_df} WHERE length(w) >= 10) x GROUP BY form")
query("jn_lookup", "SELECT coalesce(m.modern, t.w) AS lemma, count(*) AS n, CAST(sum(CASE WHEN m.form IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n_looked_up FROM {tt} t LEFT JOIN {modern} m ON t.w = m.form GROUP BY coalesce(m.modern, t.w)")
# half of the passages' ids follow another numbering: through its map first, else directly; then consecutive ids as ranges
derive("alt", "SELECT item_id AS alt_id, item_id + 1 AS own_id FROM {benchmark} WHERE item_id + 1 IN (SELECT item_id FROM {benchmark})")
query("jn_renumber", "SELECT target, min(id) AS first, max(id) AS last, count(*) AS n FROM (SELECT target, id, id - row_number() OVER (PARTITION BY target ORDER BY id) AS island FROM (SELECT DISTINCT r.target, CASE WHEN u.ord % 2 = 0 THEN coalesce(a.own_id, b.item_id) ELSE coalesce(b.item_id, a.own_id) END AS id FROM {ranked} r JOIN {units} u ON r.target = u.unit LEFT JOIN {alt} a ON r.source = a.alt_id LEFT JOIN {benchmark} b ON r.source = b.item_id WHERE r.pos <= 10) x) y GROUP BY target, island")

# --- pools, sets, sampling --------------------------------------------------------------------------
derive("natpool", "SELECT target, source, max(CASE WHEN n <= 5 THEN 1 ELSE 0 END) AS in_natural_pool FROM (SELECT target, source, row_number() OVER (PARTITION BY scorer, target ORDER BY score DESC, source) AS n FROM {scores}) x WHERE n <= 5 GROUP BY target, source")
_OF_POOL = "SELECT target, source, 1 AS in_natural_pool FROM (SELECT target, source, word, bigram, trigram, " + ", ".join(f"row_number() OVER (PARTITION BY target ORDER BY {c} DESC NULLS LAST, source) AS n_{c}" for c in ("word", "bigram", "trigram")) + " FROM {pairs}{WHERE}) x WHERE n_word <= 5 AND word IS NOT NULL OR n_bigram <= 5 AND bigram IS NOT NULL OR n_trigram <= 5 AND trigram IS NOT NULL"
instead("natpool", _OF_POOL.replace("{pairs}{WHERE}", "{pairs_together}"))
derive("gold_natpool", _OF_POOL.replace("{WHERE}", " WHERE target IN (SELECT target FROM {gold})"))
derive("pool", "SELECT k.target, k.source, coalesce(n.in_natural_pool, 0) AS in_natural_pool, CASE WHEN g.record IS NULL THEN 0 ELSE 1 END AS label FROM (SELECT target, source FROM {natpool} UNION SELECT target, source FROM {gold}) k LEFT JOIN {natpool} n ON k.target = n.target AND k.source = n.source LEFT JOIN {gold} g ON k.target = g.target AND k.source = g.source")
query("st_pool", "SELECT * FROM {pool}")
query("st_unioncand", "SELECT target, source FROM {natpool} UNION SELECT unit, CAST(HASHED('fake:' || STR(unit)) % n AS BIGINT) FROM {units} CROSS JOIN {n_src}")
query("st_intersect", "SELECT target, source FROM {s2} INTERSECT SELECT target, source FROM {s3}")
query("st_except", "SELECT target, source FROM {s2} EXCEPT SELECT target, source FROM {gold}")
query("st_dedup", "SELECT target, source, scorer FROM (SELECT *, row_number() OVER (PARTITION BY target, source ORDER BY scorer) AS n FROM {scores}) x WHERE n = 1")
query("sl_order", "SELECT target, source, score FROM {s3} ORDER BY score DESC, target, source")
query("sl_sample", "SELECT unit FROM {units} WHERE y = 0 ORDER BY md5('seed0:' || STR(unit)), unit LIMIT 100")
F2, F3, F4 = "score > 5e-1", "source IN (SELECT source FROM {gold})", "target IN (SELECT target FROM {s2})"
_ORDERS = " UNION ALL ".join(f"SELECT {k} AS ord, target, source FROM (SELECT * FROM (SELECT * FROM {{s1}} WHERE {a}) a{k} WHERE {b}) b{k} WHERE {c}" for k, (a, b, c) in enumerate(permutations((F2, F3, F4))))
derive("orders_of_filters", _ORDERS)
# each row's three answers are found once, and each order of filters is then gone through for it; score > 5e-1 is in every order
_IN_ORDER = lambda k, fs: "CASE " + " ".join(f"WHEN NOT {f} THEN NULL" for f in fs) + f" ELSE {k} END"
instead("orders_of_filters", "SELECT ord, target, source FROM (SELECT target, source, BOTH(" + ", ".join(_IN_ORDER(k, fs) for k, fs in enumerate(permutations(("f2", "f3", "f4")))) + ") AS ord FROM (SELECT s.target, s.source, s.score > 5e-1 AS f2, g.source IS NOT NULL AS f3, t.target IS NOT NULL AS f4 FROM {s1} s LEFT JOIN (SELECT DISTINCT source FROM {gold}) g ON s.source = g.source LEFT JOIN (SELECT target FROM {tops} WHERE bigram IS NOT NULL) t ON s.target = t.target WHERE s.score > 5e-1) f) x WHERE ord IS NOT NULL")
query("st_ordercmp", "SELECT CAST(count(DISTINCT h) AS BIGINT) AS n_sets, CAST(min(n) AS BIGINT) AS smallest, CAST(max(n) AS BIGINT) AS largest FROM (SELECT ord, count(*) AS n, sum(HASHED(STR(target) || ':' || STR(source))) AS h FROM {orders_of_filters} GROUP BY ord) x")

# --- predicates -------------------------------------------------------------------------------------
query("pf_gold", "SELECT g.record, g.target, s.score FROM {gold} g JOIN {s1} s ON g.target = s.target AND g.source = s.source WHERE s.score >= 6e-1")
# words of over a tenth of the documents stand for function words: the same share at every size
derive("word_df", "SELECT w, count(DISTINCT unit) AS df FROM {tt} GROUP BY w")
instead("word_df", lambda s, d: FG.once(FG.word_features(B.target_lists(s, d))).groupBy("f").agg(F.count(F.lit(1)).alias("df")).withColumnRenamed("f", "w"))
derive("content", "SELECT w FROM {word_df} CROSS JOIN (SELECT count(*) AS n FROM {documents}) c WHERE df * 10 <= n")
query("pf_content", "SELECT t.unit, count(*) AS n FROM {tt} t JOIN {content} c ON t.w = c.w GROUP BY t.unit")
query("pf_rare", "SELECT w, df FROM (SELECT w, count(DISTINCT unit) AS df FROM {tt} GROUP BY w) x CROSS JOIN (SELECT count(*) AS n FROM {documents}) c WHERE df <= greatest(3, ceil(n * 1e-2)) AND length(w) >= 4")
query("pf_minscore", "SELECT target, source, score FROM {s2} WHERE score >= 3e-1")
query("pf_self", "SELECT a, b, score FROM {sim} UNION ALL SELECT item_id, item_id, -1e0 FROM {benchmark}")
query("pf_minlen", "SELECT unit, len FROM {units} WHERE len >= 15")
query("jd_repeat", "SELECT record, kind, source, SEQ(1, 3) AS rep FROM {decoys} WHERE kind IN ('gold', 'A')")

# --- re-ranking ---------------------------------------------------------------------------------------
derive("hub", "SELECT s.*, p.k, p.q, p.c, t.k AS tk, t.c AS tc FROM (SELECT target, source, score, INTS(score) AS i FROM {s1}) s JOIN (SELECT source, CAST(sum(INTS(score)) AS DOUBLE) AS k, CAST(sum(INTS(score) * INTS(score)) AS DOUBLE) AS q, CAST(count(*) AS DOUBLE) AS c FROM {s1} GROUP BY source) p ON s.source = p.source JOIN (SELECT target, CAST(sum(INTS(score)) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS c FROM {s1} GROUP BY target) t ON s.target = t.target")
query("rr_hub", "SELECT target, source, score AS raw, R6((i * c - k) / (c * 1e6)) AS minus_src, R6((i * c - k) / greatest(sqrt(greatest(c * q - k * k, 0e0)), 1e-3 * c)) AS z_src, R6(i * c / greatest(k, 1e-3 * c)) AS ratio_src, R6((rank() OVER (PARTITION BY source ORDER BY score) - 1) / c) AS rank_src, R6((2 * i - k / c - tk / tc) / 1e6) AS csls FROM {hub}")
derive("pct", "SELECT scorer, target, source, (rank() OVER (PARTITION BY scorer, target ORDER BY score) + (count(*) OVER (PARTITION BY scorer, target, score) - 1) / 2e0 - 1) / greatest(count(*) OVER (PARTITION BY scorer, target) - 1, 1) AS pct FROM {scores}")
derive("fuse", "SELECT target, source, R6(CAST(sum(INTS(pct)) AS DOUBLE) / 3e6) AS score FROM {pct} GROUP BY target, source")
# the same from {pairs}: one shuffle by document serves the ranks of all scorers and their sum
_PCT = lambda c: f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY target, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY target, {c}) - 1) / 2e0 - 1) / greatest(count({c}) OVER (PARTITION BY target) - 1, 1) END"
derive("pct_wide", "SELECT target, source, " + ", ".join(f"{_PCT(c)} AS {c}" for c in ("word", "bigram", "trigram")) + " FROM {pairs_together}")
derive("gold_pct", "SELECT target, source, " + ", ".join(f"{_PCT(c)} AS {c}" for c in ("word", "bigram", "trigram")) + " FROM {pairs} WHERE target IN (SELECT target FROM {gold})")
_FUSED = "SELECT target, source, R6(CAST(" + " + ".join(f"coalesce(INTS({c}), 0)" for c in ("word", "bigram", "trigram")) + " AS DOUBLE) / 3e6) AS score FROM "
instead("fuse", _FUSED + "{pct_wide}")
derive("gold_fuse", _FUSED + "{gold_pct}")
derive("rank_fuse", "SELECT g.record, g.target, g.source, CASE WHEN r.tie_rank IS NULL THEN coalesce(p.n_pos, 0) + (n.n - coalesce(p.n_pos, 0) + 1) / 2e0 ELSE r.tie_rank END AS rank, CASE WHEN r.tie_rank IS NULL THEN 0 ELSE 1 END AS hit FROM {gold} g CROSS JOIN {n_src} n LEFT JOIN (SELECT target, source, rank() OVER (PARTITION BY target ORDER BY score DESC) + (count(*) OVER (PARTITION BY target, score) - 1) / 2e0 AS tie_rank FROM {fuse}) r ON g.target = r.target AND g.source = r.source LEFT JOIN (SELECT target, count(*) AS n_pos FROM {fuse} GROUP BY target) p ON g.target = p.target")
instead("rank_fuse", RANKED_GOLD.replace("{S}", "{gold_fuse}"))
query("rr_fuse", "SELECT target, source, score AS fuse FROM {fuse}")
# neighbours of a source, weights in thousandths: 1 / distance up to 2, and parallel places by their cosine
derive("nb", "SELECT a, b, CAST(sum(w) AS BIGINT) AS w FROM (SELECT source AS a, source + d AS b, CAST(1000 / abs(d) AS BIGINT) AS w FROM (SELECT item_id AS source, BOTH(-2, -1, 1, 2) AS d FROM {benchmark}) a WHERE source + d IN (SELECT item_id FROM {benchmark}) UNION ALL SELECT a, b, CAST(floor(score * 1000) AS BIGINT) FROM {selfsim}) x GROUP BY a, b")
query("rr_graph", "SELECT coalesce(s.target, p.target) AS target, coalesce(s.source, p.a) AS source, R6(coalesce(s.score, 0e0) + 3e-1 * coalesce(p.x, 0e0)) AS score_03, R6(coalesce(s.score, 0e0) + 6e-1 * coalesce(p.x, 0e0)) AS score_06, R6(coalesce(s.score, 0e0) + coalesce(p.x, 0e0)) AS score_10 FROM {s2} s FULL OUTER JOIN (SELECT x.target, n.a, sum(INTS(x.score) * n.w) / (max(t.w) * 1e6) AS x FROM {s2} x JOIN {nb} n ON x.source = n.b JOIN (SELECT a, CAST(sum(w) AS DOUBLE) AS w FROM {nb} GROUP BY a) t ON n.a = t.a GROUP BY x.target, n.a) p ON s.target = p.target AND s.source = p.a")
query("rr_paradj", "SELECT s.target, s.source, R6(s.score + 3e-1 * (coalesce(a.score, 0e0) + coalesce(b.score, 0e0)) / greatest(k, 1)) AS score_03, R6(s.score + 6e-1 * (coalesce(a.score, 0e0) + coalesce(b.score, 0e0)) / greatest(k, 1)) AS score_06 FROM {s2} s JOIN (SELECT unit, pu, nu, CASE WHEN pu IS NULL THEN 0 ELSE 1 END + CASE WHEN nu IS NULL THEN 0 ELSE 1 END AS k FROM (SELECT unit, lag(unit) OVER (PARTITION BY chapter ORDER BY ord) AS pu, lead(unit) OVER (PARTITION BY chapter ORDER BY ord) AS nu FROM {units}) w) u ON s.target = u.unit LEFT JOIN {s2} a ON a.target = u.pu AND a.source = s.source LEFT JOIN {s2} b ON b.target = u.nu AND b.source = s.source")
# an outside graph of sources with votes: parts and suppliers of line items stand for cited and citing places
derive("votes", "SELECT a, b, max(v) AS v FROM (SELECT least(a, b) AS a, greatest(a, b) AS b, v FROM (SELECT l_partkey % n AS a, l_suppkey % n AS b, count(*) AS v FROM {lineitem} CROSS JOIN {n_src} GROUP BY l_partkey % n, l_suppkey % n) x WHERE a <> b) y GROUP BY a, b")
derive("xref", "SELECT a, b, R6(1 + ln(1 + greatest(v, 0))) AS w FROM {votes} UNION ALL SELECT b, a, R6(1 + ln(1 + greatest(v, 0))) FROM {votes}")
# a document's scores go to one task, which meets the whole graph (a stated set: sources by sources) and sums up there; a source's own score comes with an edge to itself
derive("xref_own", "SELECT e.b, e.a, INTS(e.w) AS w, t.w AS total, 0 AS own FROM {xref} e JOIN (SELECT a, CAST(sum(INTS(w)) AS DOUBLE) AS w FROM {xref} GROUP BY a) t ON e.a = t.a UNION ALL SELECT item_id, item_id, 0, NULL, 1 FROM {benchmark}")
_edges = INPUTS["xref_own"][0]
instead("xref_own", lambda s, d: store.once(s, d, "xref_sent", _edges).transform(lambda df: SC.small(df)(df)))
define("s2_together", lambda s, d: B.together(given(s, d, "s2"), "target"), "")
query("rr_xref", "SELECT coalesce(s.target, p.target) AS target, coalesce(s.source, p.a) AS source, R6(coalesce(s.score, 0e0) + 3e-1 * coalesce(p.x, 0e0)) AS score_03, R6(coalesce(s.score, 0e0) + 6e-1 * coalesce(p.x, 0e0)) AS score_06 FROM {s2} s FULL OUTER JOIN (SELECT x.target, e.a, CAST(sum(INTS(x.score) * INTS(e.w)) AS DOUBLE) / (max(t.w) * 1e6) AS x FROM {s2} x JOIN {xref} e ON x.source = e.b JOIN (SELECT a, CAST(sum(INTS(w)) AS DOUBLE) AS w FROM {xref} GROUP BY a) t ON e.a = t.a GROUP BY x.target, e.a) p ON s.target = p.target AND s.source = p.a", spark_body="SELECT target, a AS source, R6(coalesce(score, 0e0) + 3e-1 * coalesce(x, 0e0)) AS score_03, R6(coalesce(score, 0e0) + 6e-1 * coalesce(x, 0e0)) AS score_06 FROM (SELECT s.target, e.a, max(CASE WHEN e.own = 1 THEN s.score END) AS score, CAST(sum(CASE WHEN e.own = 0 THEN INTS(s.score) * e.w END) AS DOUBLE) / (max(e.total) * 1e6) AS x FROM {s2_together} s JOIN {xref_own} e ON s.source = e.b GROUP BY s.target, e.a) z")
query("rr_cascade", "SELECT target, source, tier, row_number() OVER (PARTITION BY target ORDER BY tier, score DESC, source) AS pos FROM (SELECT a.target, a.source, a.score, CASE WHEN c.score > 0 THEN 1 WHEN b.score > 0 THEN 2 ELSE 3 END AS tier FROM {s1} a LEFT JOIN {s2} b ON a.target = b.target AND a.source = b.source LEFT JOIN {s3} c ON a.target = c.target AND a.source = c.source) x", spark_body="SELECT target, source, tier, row_number() OVER (PARTITION BY target ORDER BY tier, word DESC, source) AS pos FROM (SELECT target, source, word, CASE WHEN trigram > 0 THEN 1 WHEN bigram > 0 THEN 2 ELSE 3 END AS tier FROM {pairs_together}) x")
query("io_resume", "SELECT d.doc_id FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")

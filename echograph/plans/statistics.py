"""Length normalisation, resampling, controls, multiplicity, gold auditing, judge protocol, text sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from echograph.operators import features as FG
from echograph.operators import scorers as SC
from echograph.plans import base as B
from echograph.plans import evaluation  # noqa: F401  inputs that these queries share
from echograph.plans.common_sql import define, derive, given, instead, numbered, query, replicates, sent

# --- length normalisation: scores against a background of like length -----------------------------------
LOO = "CASE WHEN c > 1 THEN (score - (s - score) / (c - 1)) / greatest(sqrt(greatest((q - score * score) / (c - 1) - ((s - score) / (c - 1)) * ((s - score) / (c - 1)), 0e0)), 1e-9) ELSE 0e0 END"
for _nb in (5, 10, 20, 40, 80, 160, 320):
    derive(f"bin_{_nb}", f"SELECT unit, len, score, y, CAST(least({_nb - 1}, floor(pos * {_nb} / n)) AS INT) AS b FROM {{up_len}}")
    derive(f"zbin_{_nb}", f"SELECT unit, len, y, round({LOO}, 4) AS z FROM (SELECT x.unit, x.len, x.y, x.score, g.c, g.s, g.q FROM {{bin_{_nb}}} x JOIN (SELECT b, count(*) AS c, sum(INTS(score)) / 1e6 AS s, sum(INTS(score) * INTS(score)) / 1e12 AS q FROM {{bin_{_nb}}} GROUP BY b) g ON x.b = g.b) y")
    query(f"ln_zbin_{_nb}", f"SELECT unit, z FROM {{zbin_{_nb}}}")
for _nb in (10, 40, 160):
    # robust: median and MAD of the bin; under three units, or a MAD of nothing, the mean and deviation of all units stand in
    derive(f"zbinr_{_nb}", f"SELECT x.unit, x.len, x.y, round(CASE WHEN d.c >= 3 AND d.mad > 1e-6 THEN (x.score - d.med) / (d.mad * 14826e-4) ELSE (x.score - a.m) / greatest(a.sd, 1e-9) END, 4) AS z FROM {{bin_{_nb}}} x JOIN (SELECT p.b, max(m.med) AS med, MEDIAN(abs(p.score - m.med)) AS mad, count(*) AS c FROM {{bin_{_nb}}} p JOIN (SELECT b, MEDIAN(score) AS med FROM {{bin_{_nb}}} GROUP BY b) m ON p.b = m.b GROUP BY p.b) d ON x.b = d.b CROSS JOIN (SELECT avg(score) AS m, stddev_pop(score) AS sd FROM {{best}}) a")
    _by = f"SELECT b, score, count(*) AS m FROM {{bin_{_nb}}} GROUP BY b, score"
    # medians from the number of units of each score
    instead(f"zbinr_{_nb}", f"SELECT x.unit, x.len, x.y, round(CASE WHEN d.c >= 3 AND d.mad > 1e-6 THEN (x.score - d.med) / (d.mad * 14826e-4) ELSE (x.score - a.m) / greatest(a.sd, 1e-9) END, 4) AS z FROM {{bin_{_nb}}} x JOIN (SELECT p.b, max(m.med) AS med, percentile(abs(p.score - m.med), 5e-1, p.m) AS mad, sum(p.m) AS c FROM ({_by}) p JOIN (SELECT b, percentile(score, 5e-1, m) AS med FROM ({_by}) q GROUP BY b) m ON p.b = m.b GROUP BY p.b) d ON x.b = d.b CROSS JOIN (SELECT avg(score) AS m, stddev_pop(score) AS sd FROM {{best}}) a")
query("ln_zbinr", " UNION ALL ".join(f"SELECT {_nb} AS bins, unit, z FROM {{zbinr_{_nb}}}" for _nb in (10, 40, 160)))
derive("zbin0", "SELECT x.unit, x.len, x.y, round(CASE WHEN coalesce(m.sd0, 0e0) > 1e-6 THEN (x.score - m.avg0) / m.sd0 ELSE (x.score - coalesce(m.avg0, a.m)) / greatest(a.sd, 1e-9) END, 4) AS z FROM {bin_10} x LEFT JOIN (SELECT b, avg(score) AS avg0, stddev_pop(score) AS sd0 FROM {bin_10} WHERE y = 0 GROUP BY b) m ON x.b = m.b CROSS JOIN (SELECT avg(score) AS m, stddev_pop(score) AS sd FROM {best} WHERE y = 0) a")
query("ln_zbin0", "SELECT unit, z FROM {zbin0}")
# prefix sums by chunks of places, so that only the sums of chunks meet in one place
derive("prefix", "SELECT x.unit, x.len, x.y, x.i, x.pos, x.n, c.s + sum(x.i) OVER w AS s, c.q + sum(x.i * x.i) OVER w AS q FROM (SELECT unit, len, y, INTS(score) AS i, pos, n, floor(pos / 100000) AS part FROM {up_len}) x JOIN (SELECT part, coalesce(sum(s) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, coalesce(sum(q) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q FROM (SELECT floor(pos / 100000) AS part, sum(INTS(score)) AS s, sum(INTS(score) * INTS(score)) AS q FROM {up_len} GROUP BY floor(pos / 100000)) g) c ON x.part = c.part WINDOW w AS (PARTITION BY x.part ORDER BY x.pos ROWS UNBOUNDED PRECEDING)")
for _k in (25, 50, 100, 200, 400):
    _lo = f"greatest(0, least(x.pos - {_k // 2}, x.n - {_k}))"
    derive(f"zknn_{_k}", f"SELECT unit, len, y, round((i - s / m) / greatest(sqrt(greatest(q / m - (s / m) * (s / m), 0e0)), 1e-3), 3) AS z FROM (SELECT x.unit, x.len, x.y, x.i, CAST(h.s - coalesce(l.s, 0) - x.i AS DOUBLE) AS s, CAST(h.q - coalesce(l.q, 0) - x.i * x.i AS DOUBLE) AS q, greatest(least({_k}, x.n) - 1, 1) * 1e0 AS m FROM {{prefix}} x JOIN {{prefix}} h ON h.pos = {_lo} + least({_k}, x.n) - 1 LEFT JOIN {{prefix}} l ON l.pos = {_lo} - 1) v")
query("ln_zknn", " UNION ALL ".join(f"SELECT {_k} AS k, unit, z FROM {{zknn_{_k}}}" for _k in (25, 50, 100, 200, 400)))
for _k in (50, 100, 200, 400):
    _lo = f"greatest(0, least(pos - {_k // 2}, n - {_k}))"
    derive(f"rknn_{_k}", f"SELECT a.unit, max(a.len) AS len, max(a.y) AS y, round(avg(CASE WHEN b.score < a.score THEN 1e0 WHEN b.score = a.score THEN 5e-1 ELSE 0e0 END), 6) AS z FROM (SELECT unit, len, y, score, pos, SEQ(CAST({_lo} AS INT), CAST({_lo} + least({_k}, n) - 1 AS INT)) AS at FROM {{up_len}}) a JOIN {{up_len}} b ON a.at = b.pos AND a.unit <> b.unit GROUP BY a.unit")
query("ln_rankknn", " UNION ALL ".join(f"SELECT {_k} AS k, unit, z AS share FROM {{rknn_{_k}}}" for _k in (50, 100, 200, 400)))
query("ln_reg", "SELECT unit, round((score - (slope * x + icpt)) / (1 - (1e0 / n + (x - mx) * (x - mx) / sxx)), 6) AS residual FROM (SELECT unit, score, ln(len + 1) AS x FROM {best}) a CROSS JOIN (SELECT regr_slope(score, ln(len + 1)) AS slope, regr_intercept(score, ln(len + 1)) AS icpt, avg(ln(len + 1)) AS mx, count(*) AS n, var_pop(ln(len + 1)) * count(*) AS sxx FROM {best}) r")

# --- resampling with draws from md5, so that both engines draw alike ------------------------------------
#: Replicates: the defaults of the protocol.
BOOTSTRAP, AUC_BOOTSTRAP, PERMUTATIONS, RANDOM_DRAWS = 5_000, 2_000, 20_000, 20_000
derive("lograte0", "SELECT 0 AS one, a.record, a.target, R6(ln(b.rank) - ln(a.rank)) AS d, R6(ln(a.rank)) AS x FROM {rank_s1} a JOIN {rank_s3} b ON a.record = b.record")
derive("lograte", "SELECT record, target, d, x, pos AS i, n FROM (" + numbered("lograte0", "one", "record", chunk=10**10) + ") z")
derive("draws", "SELECT rep, floor(UNIFORM('b:' || STR(rep) || ':' || STR(i)) * n) AS pick FROM (SELECT i, n, SEQ(1, " + str(BOOTSTRAP) + ") AS rep FROM {lograte}) z")
# Spark: each replicate draws where it is, over all cores; the records, a short row each, are sent there
sent("lograte_sent", "lograte")
DRAWN = "SELECT rep, floor(UNIFORM('{K}:' || STR(rep) || ':' || STR(i)) * n) AS pick FROM (SELECT r.rep, z.n, SEQ(CAST(0 AS BIGINT), z.n - 1) AS i FROM {REPS} r CROSS JOIN (SELECT count(*) AS n FROM {FROM} HAVING count(*) > 0) z) y"
drawn = lambda key, reps, table: DRAWN.replace("{K}:", key).replace("{REPS}", replicates(reps)).replace("{FROM}", f"{{{table}}}")
instead("draws", drawn("b:", BOOTSTRAP, "lograte"))
query("bs_obj", "SELECT round(min(m), 5) AS lowest, round(max(m), 5) AS highest, round(QUANT(m, 25e-3), 5) AS low, round(QUANT(m, 975e-3), 5) AS high FROM (SELECT rep, sum(INTS(x)) / (count(*) * 1e6) AS m FROM {draws} d JOIN {lograte} l ON d.pick = l.i GROUP BY rep) z", spark_body="SELECT round(min(m), 5) AS lowest, round(max(m), 5) AS highest, round(QUANT(m, 25e-3), 5) AS low, round(QUANT(m, 975e-3), 5) AS high FROM (SELECT rep, sum(INTS(x)) / (count(*) * 1e6) AS m FROM {draws} d JOIN {lograte_sent} l ON d.pick = l.i GROUP BY rep) z")
query("bs_meddiff", "SELECT round(QUANT(m, 25e-3), 5) AS low, round(QUANT(m, 5e-1), 5) AS mid, round(QUANT(m, 975e-3), 5) AS high FROM (SELECT rep, MEDIAN(d) AS m FROM {draws} w JOIN {lograte} l ON w.pick = l.i GROUP BY rep) z", spark_body="SELECT round(QUANT(m, 25e-3), 5) AS low, round(QUANT(m, 5e-1), 5) AS mid, round(QUANT(m, 975e-3), 5) AS high FROM (SELECT rep, MEDIAN(d) AS m FROM {draws} w JOIN {lograte_sent} l ON w.pick = l.i GROUP BY rep) z")
derive("clusters0", "SELECT 0 AS one, target, sum(d) AS d, count(*) AS m FROM {lograte} GROUP BY target")
derive("clusters", "SELECT target, d, m, pos AS i, n FROM (" + numbered("clusters0", "one", "target") + ") z")
sent("clusters_sent", "clusters")
# fewer than five clusters: no interval
query("bs_cluster", "SELECT CASE WHEN min(n) >= 5 THEN round(QUANT(m, 25e-3), 5) END AS low, CASE WHEN min(n) >= 5 THEN round(QUANT(m, 975e-3), 5) END AS high FROM (SELECT rep, sum(INTS(d)) / (sum(m) * 1e6) AS m, max(w.n) AS n FROM (SELECT rep, n, floor(UNIFORM('c:' || STR(rep) || ':' || STR(i)) * n) AS pick FROM (SELECT i, n, SEQ(1, " + str(BOOTSTRAP) + ") AS rep FROM {clusters}) z) w JOIN {clusters} c ON w.pick = c.i GROUP BY rep) v", spark_body="SELECT CASE WHEN min(n) >= 5 THEN round(QUANT(m, 25e-3), 5) END AS low, CASE WHEN min(n) >= 5 THEN round(QUANT(m, 975e-3), 5) END AS high FROM (SELECT rep, sum(INTS(d)) / (sum(m) * 1e6) AS m, max(c.n) AS n FROM (" + drawn("c:", BOOTSTRAP, "clusters") + ") w JOIN {clusters_sent} c ON w.pick = c.i GROUP BY rep) v")
# positives and negatives are drawn apart, as many as there are; AUC of both scorers from the counts of each score
derive("both_scores", "SELECT u.y AS one, u.unit, u.y, coalesce(a.s, 0e0) AS a, coalesce(b.s, 0e0) AS b FROM {units} u LEFT JOIN (SELECT target, max(score) AS s FROM {s1} GROUP BY target) a ON u.unit = a.target LEFT JOIN (SELECT target, max(score) AS s FROM {s2} GROUP BY target) b ON u.unit = b.target")
derive("strata", "SELECT z.y, z.a, z.b, z.pos - CASE WHEN z.y = 1 THEN c.neg ELSE 0 END AS i, CASE WHEN z.y = 1 THEN z.n - c.neg ELSE c.neg END AS m FROM (" + numbered("both_scores", "one") + ") z CROSS JOIN (SELECT count(*) - sum(y) AS neg FROM {both_scores}) c")
derive("redrawn", "SELECT w.rep, w.y, s.a, s.b FROM (SELECT rep, y, floor(UNIFORM('a' || STR(y) || ':' || STR(rep) || ':' || STR(i)) * m) AS pick FROM (SELECT y, i, m, SEQ(1, " + str(AUC_BOOTSTRAP) + ") AS rep FROM {strata}) v) w JOIN {strata} s ON w.y = s.y AND w.pick = s.i")
# Spark: a document is drawn by its place; the pairs of scores that occur are numbered, and each stratum sends one array of these numbers by place. Draws are counted by number where they are made
instead("both_scores", "SELECT u.y AS one, u.unit, u.y, coalesce(m.word, 0e0) AS a, coalesce(m.bigram, 0e0) AS b FROM {units} u LEFT JOIN {tops} m ON u.unit = m.target")
derive("score_codes", "SELECT a, b, CAST(row_number() OVER (ORDER BY a, b) AS INT) AS code FROM (SELECT DISTINCT a, b FROM {strata}) x")
derive("places", "SELECT s.y, max(s.m) AS m, transform(sort_array(collect_list(struct(s.i, c.code))), x -> x.code) AS codes FROM {strata} s JOIN {score_codes} c ON s.a = c.a AND s.b = c.b GROUP BY s.y")
derive("redrawn_counts", "SELECT rep, y, code, count(*) AS c FROM (SELECT d.rep, d.y, get(p.codes, CAST(d.pick AS INT)) AS code FROM (SELECT rep, y, floor(UNIFORM('a' || STR(y) || ':' || STR(rep) || ':' || STR(i)) * m) AS pick FROM (SELECT r.rep, t.y, t.m, SEQ(CAST(0 AS BIGINT), t.m - 1) AS i FROM " + replicates(AUC_BOOTSTRAP) + " r CROSS JOIN (SELECT /*+ BROADCAST */ y, max(m) AS m FROM {strata} GROUP BY y) t) v) d JOIN {places_sent} p ON d.y = p.y) w GROUP BY rep, y, code")
define("places_sent", lambda s, d: F.broadcast(given(s, d, "places")), "")
for _c in "ab":
    derive(f"auc_{_c}", f"SELECT rep, (sum(p * r) - sum(p) * (sum(p) + 1) / 2e0) / (sum(p) * (sum(c) - sum(p))) AS auc FROM (SELECT rep, c, p, sum(c) OVER (PARTITION BY rep ORDER BY v ROWS UNBOUNDED PRECEDING) - c + (c + 1) / 2e0 AS r FROM (SELECT rep, {_c} AS v, count(*) AS c, sum(y) AS p FROM {{redrawn}} GROUP BY rep, {_c}) g) h GROUP BY rep")
    instead(f"auc_{_c}", f"SELECT rep, (sum(p * r) - sum(p) * (sum(p) + 1) / 2e0) / (sum(p) * (sum(c) - sum(p))) AS auc FROM (SELECT rep, c, p, sum(c) OVER (PARTITION BY rep ORDER BY v ROWS UNBOUNDED PRECEDING) - c + (c + 1) / 2e0 AS r FROM (SELECT rep, k.{_c} AS v, sum(r.c) AS c, sum(r.c * r.y) AS p FROM {{redrawn_counts}} r JOIN {{score_codes}} k ON r.code = k.code GROUP BY rep, k.{_c}) g) h GROUP BY rep")
query("bs_aucdiff", "SELECT round(QUANT(d, 25e-3), 5) AS low, round(QUANT(d, 5e-1), 5) AS mid, round(QUANT(d, 975e-3), 5) AS high FROM (SELECT a.rep, b.auc - a.auc AS d FROM {auc_a} a JOIN {auc_b} b ON a.rep = b.rep) z")
query("pt_sign", "SELECT round(abs(max(o)) / 1e6, 6) AS observed, round((sum(CASE WHEN abs(m) >= abs(o) THEN 1e0 ELSE 0e0 END) + 1) / (count(*) + 1), 6) AS p FROM (SELECT rep, sum(CASE WHEN UNIFORM('s:' || STR(rep) || ':' || STR(i)) < 5e-1 THEN INTS(d) ELSE -INTS(d) END) AS m, sum(INTS(d)) AS o FROM (SELECT i, d, SEQ(1, " + str(PERMUTATIONS) + ") AS rep FROM {lograte}) z GROUP BY rep) v", spark_body="SELECT round(abs(max(o)) / 1e6, 6) AS observed, round((sum(CASE WHEN abs(m) >= abs(o) THEN 1e0 ELSE 0e0 END) + 1) / (count(*) + 1), 6) AS p FROM (SELECT rep, sum(CASE WHEN UNIFORM('s:' || STR(rep) || ':' || STR(i)) < 5e-1 THEN INTS(d) ELSE -INTS(d) END) AS m, sum(INTS(d)) AS o FROM (SELECT l.i, l.d, r.rep FROM " + replicates(PERMUTATIONS) + " r CROSS JOIN {lograte_sent} l) z GROUP BY rep) v")
query("pt_cluster", "SELECT round((sum(CASE WHEN abs(m) >= abs(o) THEN 1e0 ELSE 0e0 END) + 1) / (count(*) + 1), 6) AS p FROM (SELECT rep, sum(CASE WHEN UNIFORM('t:' || STR(rep) || ':' || STR(target)) < 5e-1 THEN INTS(d) ELSE -INTS(d) END) AS m, sum(INTS(d)) AS o FROM (SELECT target, d, SEQ(1, " + str(PERMUTATIONS) + ") AS rep FROM {clusters}) z GROUP BY rep) v", spark_body="SELECT round((sum(CASE WHEN abs(m) >= abs(o) THEN 1e0 ELSE 0e0 END) + 1) / (count(*) + 1), 6) AS p FROM (SELECT rep, sum(CASE WHEN UNIFORM('t:' || STR(rep) || ':' || STR(target)) < 5e-1 THEN INTS(d) ELSE -INTS(d) END) AS m, sum(INTS(d)) AS o FROM (SELECT c.target, c.d, r.rep FROM " + replicates(PERMUTATIONS) + " r CROSS JOIN {clusters_sent} c) z GROUP BY rep) v")
# the best of as many random ranks as a record has correct sources, and the closed form of its expectation
derive("gold_counts", "SELECT g.target, g.p, n.n FROM (SELECT target, count(*) AS p FROM {gold} GROUP BY target) g CROSS JOIN {n_src} n")
sent("gold_counts_sent", "gold_counts")
query("pt_random", "SELECT target, CAST(max(p) AS BIGINT) AS sources, round(sum(best) / (count(*) * 1e0), 4) AS mean_rank, round((max(n) + 1) * 1e0 / (max(p) + 1), 4) AS expected FROM (SELECT target, rep, max(p) AS p, max(n) AS n, min(1 + floor(UNIFORM('r:' || STR(target) || ':' || STR(rep) || ':' || STR(k)) * n)) AS best FROM (SELECT target, p, n, rep, SEQ(1, CAST(p AS INT)) AS k FROM (SELECT g.target, g.p, n.n, SEQ(1, " + str(RANDOM_DRAWS) + ") AS rep FROM (SELECT target, count(*) AS p FROM {gold} GROUP BY target) g CROSS JOIN {n_src} n) y) z GROUP BY target, rep) x GROUP BY target", spark_body="SELECT target, CAST(max(p) AS BIGINT) AS sources, round(sum(best) / (count(*) * 1e0), 4) AS mean_rank, round((max(n) + 1) * 1e0 / (max(p) + 1), 4) AS expected FROM (SELECT g.target, g.p, g.n, array_min(transform(sequence(1, CAST(g.p AS INT)), k -> 1 + floor(UNIFORM('r:' || STR(g.target) || ':' || STR(r.rep) || ':' || STR(k)) * g.n))) AS best FROM " + replicates(RANDOM_DRAWS) + " r CROSS JOIN {gold_counts_sent} g) x GROUP BY target")
# p-values of tests made here: in each chapter, does a scorer rank the gold better than another (normal approximation of the sign test); families are the pairs of scorers
derive("ranks_apart", "SELECT 1 AS family, a.record, a.target, a.rank AS x, b.rank AS y FROM {rank_s1} a JOIN {rank_s2} b ON a.record = b.record UNION ALL SELECT 2, a.record, a.target, a.rank, b.rank FROM {rank_s1} a JOIN {rank_s3} b ON a.record = b.record UNION ALL SELECT 3, a.record, a.target, a.rank, b.rank FROM {rank_s2} a JOIN {rank_s3} b ON a.record = b.record")
derive("pvalues", "SELECT family, chapter AS id, least(1e0, R6(2 * exp(-2 * (k - n / 2e0) * (k - n / 2e0) / n))) AS p, CASE WHEN n >= 2 THEN 1 ELSE 0 END AS live FROM (SELECT r.family, u.chapter, count(*) AS n, sum(CASE WHEN r.x < r.y THEN 1 WHEN r.x = r.y THEN 5e-1 ELSE 0 END) AS k FROM {ranks_apart} r JOIN {units} u ON r.target = u.unit GROUP BY r.family, u.chapter) x")
query("mt_holm", "SELECT id, family, round(max(least(1e0, (m - r + 1) * p)) OVER (PARTITION BY family ORDER BY p, id ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS r, count(*) OVER (PARTITION BY family) AS m FROM {pvalues} WHERE live = 1) x")
query("mt_bonf", "SELECT family, id, live, CASE WHEN live = 1 THEN round(least(1e0, p * m), 6) END AS p_bonferroni FROM {pvalues} CROSS JOIN (SELECT sum(live) AS m FROM {pvalues}) t")
query("ci_wilson", "SELECT source, n, k, round((k / n + 384e-2 / (2 * n) - 196e-2 * sqrt(k / n * (1 - k / n) / n + 384e-2 / (4 * n * n))) / (1 + 384e-2 / n), 6) AS low, round((k / n + 384e-2 / (2 * n) + 196e-2 * sqrt(k / n * (1 - k / n) / n + 384e-2 / (4 * n * n))) / (1 + 384e-2 / n), 6) AS high FROM (SELECT d.source, count(*) * 1e0 AS n, sum(l.quality) * 1e0 AS k FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id GROUP BY d.source) x")
# exact two-sided test of each chapter's gold share against all other chapters: hypergeometric, by logs of factorials
derive("lnfact", "SELECT k, sum(ln(greatest(k, 1))) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT SEQ(0, CAST(n AS INT)) AS k FROM (SELECT count(*) AS n FROM {units}) c) x")
derive("fourfold", "SELECT chapter, a, r, k, n FROM (SELECT chapter, sum(y) AS a, count(*) AS r FROM {units} GROUP BY chapter) x CROSS JOIN (SELECT sum(y) AS k, count(*) AS n FROM {units}) t")
derive("pmf", "SELECT f.chapter, f.a, f.i, r.v + n_r.v + k.v + n_k.v - n.v - a1.v - b1.v - c1.v - d1.v AS lp FROM (SELECT *, SEQ(CAST(greatest(0, r + k - n) AS INT), CAST(least(r, k) AS INT)) AS i FROM {fourfold}) f JOIN {lnfact} r ON r.k = f.r JOIN {lnfact} n_r ON n_r.k = f.n - f.r JOIN {lnfact} k ON k.k = f.k JOIN {lnfact} n_k ON n_k.k = f.n - f.k JOIN {lnfact} n ON n.k = f.n JOIN {lnfact} a1 ON a1.k = f.i JOIN {lnfact} b1 ON b1.k = f.r - f.i JOIN {lnfact} c1 ON c1.k = f.k - f.i JOIN {lnfact} d1 ON d1.k = f.n - f.r - f.k + f.i")
query("pt_fisher", "SELECT p.chapter, round(least(1e0, sum(CASE WHEN p.lp <= o.lp + 1e-7 THEN exp(p.lp) ELSE 0e0 END)), 5) AS p FROM {pmf} p JOIN {pmf} o ON p.chapter = o.chapter AND o.i = o.a GROUP BY p.chapter")

# --- controls ---------------------------------------------------------------------------------------------
query("ct_band", "SELECT k, round(avg(ln(greatest(1, rank - k))), 6) AS mean_ln_rank FROM {rank_s1} CROSS JOIN (SELECT BOTH(0, 5, 10, 20) AS k) ks GROUP BY k")
# all pairs of a record and a document of its chapter: the mean over shuffles is the mean over these; p from SHUFFLES shuffles by md5 order
SHUFFLES = 500
derive("placed", "SELECT g.record, g.source, u.chapter, v.unit AS other, CASE WHEN v.unit = g.target THEN 1 ELSE 0 END AS own, INTS(coalesce(s.score, 0e0)) AS i FROM {gold} g JOIN {units} u ON g.target = u.unit JOIN {units} v ON u.chapter = v.chapter AND v.y = 1 LEFT JOIN {s2} s ON v.unit = s.target AND g.source = s.source")
derive("placebo_runs", "SELECT r.rep, sum(p.i) AS total FROM (SELECT rep, chapter, record, row_number() OVER (PARTITION BY rep, chapter ORDER BY md5('a' || STR(rep) || ':' || STR(record)), record) AS k FROM (SELECT DISTINCT chapter, record FROM {placed}) a CROSS JOIN (SELECT SEQ(1, " + str(SHUFFLES) + ") AS rep) n) r JOIN (SELECT rep, chapter, record, row_number() OVER (PARTITION BY rep, chapter ORDER BY md5('b' || STR(rep) || ':' || STR(record)), record) AS k FROM (SELECT DISTINCT chapter, record FROM {placed}) a CROSS JOIN (SELECT SEQ(1, " + str(SHUFFLES) + ") AS rep) n) o ON r.rep = o.rep AND r.chapter = o.chapter AND r.k = o.k JOIN (SELECT record, target FROM {gold}) t ON o.record = t.record JOIN {placed} p ON p.record = r.record AND p.other = t.target GROUP BY r.rep")
query("ct_placebo", "SELECT round(max(a.placebo), 6) AS placebo, round(max(b.observed) / (max(b.n) * 1e6), 6) AS observed, round((sum(CASE WHEN c.total >= b.observed THEN 1e0 ELSE 0e0 END) + 1) / (count(*) + 1), 6) AS p FROM {placebo_runs} c CROSS JOIN (SELECT sum(i) AS observed, count(*) AS n FROM {placed} WHERE own = 1) b CROSS JOIN (SELECT sum(i) / (count(*) * 1e6) AS placebo FROM {placed}) a")
query("ct_shuffle", "SELECT a.target, a.source, b.score AS shuffled FROM (SELECT target, source, row_number() OVER (PARTITION BY target ORDER BY source) AS n FROM {s2}) a JOIN (SELECT target, score, row_number() OVER (PARTITION BY target ORDER BY md5('z' || STR(source)), source) AS n FROM {s2}) b ON a.target = b.target AND a.n = b.n")
derive("src_len", "SELECT unit AS source, count(*) AS len FROM {st} GROUP BY unit")
query("ct_srclen", "SELECT record, round(avg(win), 6) AS wins, count(*) AS n FROM (SELECT g.record, CASE WHEN coalesce(a.score, 0e0) > coalesce(b.score, 0e0) THEN 1e0 WHEN coalesce(a.score, 0e0) = coalesce(b.score, 0e0) THEN 5e-1 ELSE 0e0 END AS win, row_number() OVER (PARTITION BY g.record ORDER BY md5(STR(g.record) || ':' || STR(m.source)), m.source) AS k FROM {gold} g JOIN (SELECT source, len, BOTH(floor(ln(len + 1) / ln(125e-2)) - 1, floor(ln(len + 1) / ln(125e-2)), floor(ln(len + 1) / ln(125e-2)) + 1) AS b FROM {src_len}) l ON g.source = l.source JOIN (SELECT source, len, floor(ln(len + 1) / ln(125e-2)) AS b FROM {src_len}) m ON l.b = m.b AND m.source <> l.source AND abs(m.len - l.len) * 10 <= 2 * greatest(m.len, l.len) LEFT JOIN {s2} a ON g.target = a.target AND g.source = a.source LEFT JOIN {s2} b ON g.target = b.target AND m.source = b.source) x WHERE k <= 20 GROUP BY record")
query("ct_chance", "SELECT round(sum(ln(k)) / max(n), 6) AS expected FROM (SELECT n, SEQ(1, CAST(n AS INT)) AS k FROM {n_src}) x")
derive("singles", "SELECT R6(ln(r.rank)) AS x, CASE WHEN count(*) OVER (PARTITION BY r.target) > 1 THEN 'range' ELSE 'single' END AS kind FROM {rank_s1} r")
query("ct_singles", "SELECT kind, n, round(m, 6) AS mean_ln_rank, CASE WHEN abs(m - a.all_m) >= 1e-1 * abs(a.all_m) THEN 1 ELSE 0 END AS defect FROM (SELECT kind, count(*) AS n, sum(INTS(x)) / (count(*) * 1e6) AS m FROM {singles} GROUP BY kind) k CROSS JOIN (SELECT sum(INTS(x)) / (count(*) * 1e6) AS all_m FROM {singles}) a")
# longest common run of tokens for the pairs of the gold: shared positions, islands on each diagonal
derive("run_of_gold", "SELECT target, source, max(n) AS score FROM (SELECT target, source, dg, island, count(*) AS n FROM (SELECT target, source, dg, p, p - row_number() OVER (PARTITION BY target, source, dg ORDER BY p) AS island FROM (SELECT g.target, g.source, t.pos - s.pos AS dg, t.pos AS p FROM {gold} g JOIN {tt} t ON g.target = t.unit JOIN {st} s ON g.source = s.unit AND s.w = t.w) h) i GROUP BY target, source, dg, island) r GROUP BY target, source")
derive("bridge", "SELECT g.record, g.target, g.source, coalesce(r.n, 0) AS rare, CASE WHEN b.score IS NULL THEN 0 ELSE 1 END AS bigram, coalesce(q.score, 0) AS run FROM {gold} g LEFT JOIN {s2} b ON g.target = b.target AND g.source = b.source LEFT JOIN {run_of_gold} q ON g.target = q.target AND g.source = q.source LEFT JOIN (SELECT t.unit AS target, s.unit AS source, count(DISTINCT t.w) AS n FROM {tt} t JOIN (SELECT unit, w FROM {st} GROUP BY unit, w) s ON t.w = s.w JOIN (SELECT w FROM {word_df} CROSS JOIN (SELECT count(*) AS n FROM {documents}) c WHERE df <= greatest(3, ceil(n * 2e-2))) q ON t.w = q.w JOIN {gold} g ON t.unit = g.target AND s.unit = g.source GROUP BY t.unit, s.unit) r ON g.target = r.target AND g.source = r.source")
# from the gold to its texts to its passages' words; only words of the sources are counted, and the table, a row a record, is written once
define("source_word_df", lambda s, d: _source_word_df(s, d), "")
instead("bridge", "SELECT g.record, g.target, g.source, coalesce(r.n, 0) AS rare, CASE WHEN b.bigram IS NULL THEN 0 ELSE 1 END AS bigram, coalesce(q.score, 0) AS run FROM {gold} g LEFT JOIN {pairs_gold} b ON g.target = b.target AND g.source = b.source LEFT JOIN {run_of_gold} q ON g.target = q.target AND g.source = q.source LEFT JOIN (SELECT g.target, g.source, count(DISTINCT t.w) AS n FROM {gold} g JOIN {tt} t ON t.unit = g.target JOIN (SELECT unit, w FROM {st} GROUP BY unit, w) s ON s.unit = g.source AND s.w = t.w JOIN (SELECT w FROM {source_word_df} CROSS JOIN (SELECT count(*) AS n FROM {documents}) c WHERE df <= greatest(3, ceil(n * 2e-2))) q ON t.w = q.w GROUP BY g.target, g.source) r ON g.target = r.target AND g.source = r.source")
query("ct_bridge", "SELECT b.record, b.rare, b.bigram, b.run, CASE WHEN b.rare > 0 OR b.run >= 2 THEN 1 ELSE 0 END AS has_bridge, round(t.k * 1e0 / t.n, 6) AS share_of_all, round(t.reached * 1e0 / greatest(t.k, 1), 6) AS reached_of_bridged FROM {bridge} b CROSS JOIN (SELECT count(*) AS n, sum(CASE WHEN b.rare > 0 OR b.run >= 2 THEN 1 ELSE 0 END) AS k, sum(CASE WHEN (b.rare > 0 OR b.run >= 2) AND r.rank <= 10 THEN 1 ELSE 0 END) AS reached FROM {bridge} b JOIN {rank_s1} r ON b.record = r.record) t")
query("ct_mech", "SELECT CASE WHEN b.rare > 0 THEN 'rare' WHEN b.bigram = 1 THEN 'bigram' ELSE 'none' END AS kind, count(*) AS n, round(avg(r.rank), 6) AS mean_rank FROM {bridge} b JOIN {rank_s1} r ON b.record = r.record GROUP BY 1")
derive("by_pct", "SELECT g.record, p.scorer, R6((1 - p.pct) * (n.n - 1) + 1) AS rank FROM {gold} g JOIN {pct} p ON g.target = p.target AND g.source = p.source CROSS JOIN {n_src} n")
instead("by_pct", "SELECT g.record, p.scorer, R6((1 - p.pct) * (n.n - 1) + 1) AS rank FROM {gold} g JOIN (SELECT target, source, stack(3, 'word', word, 'bigram', bigram, 'trigram', trigram) AS (scorer, pct) FROM {gold_pct}) p ON g.target = p.target AND g.source = p.source AND p.pct IS NOT NULL CROSS JOIN {n_src} n")
query("ct_unreached", "SELECT record, scorer AS best_scorer, rank AS best_rank, CASE WHEN rank <= 1000 THEN 'a' ELSE 'b' END AS class FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY rank, scorer) AS k FROM {by_pct}) x WHERE k = 1")

# --- gold: auditing, correcting, injected defects -----------------------------------------------------------
query("ga_align", "SELECT g.record, coalesce(a.score, 0e0) AS here, coalesce(q.score, 0) AS run_here, m.top AS best_in_chapter, o.top AS best_of_all, CASE WHEN coalesce(a.score, 0e0) >= o.top THEN 1 ELSE 0 END AS aligned FROM {gold} g JOIN {units} u ON g.target = u.unit LEFT JOIN {run_of_gold} q ON g.target = q.target AND g.source = q.source LEFT JOIN {s3} a ON g.target = a.target AND g.source = a.source LEFT JOIN (SELECT u.chapter, s.source, max(s.score) AS top FROM {s3} s JOIN {units} u ON s.target = u.unit GROUP BY u.chapter, s.source) m ON u.chapter = m.chapter AND g.source = m.source LEFT JOIN (SELECT source, max(score) AS top FROM {s3} GROUP BY source) o ON g.source = o.source")
query("ga_realign", "SELECT record, target AS old_target, CASE WHEN run >= 4 AND best_score > own_score THEN best ELSE target END AS new_target FROM (SELECT g.record, g.target, s.target AS best, s.score AS best_score, coalesce(a.score, 0e0) AS own_score, coalesce(q.score, 0) AS run, row_number() OVER (PARTITION BY g.record ORDER BY s.score DESC, s.target) AS n FROM {gold} g JOIN {s3} s ON g.source = s.source LEFT JOIN {s3} a ON g.target = a.target AND g.source = a.source LEFT JOIN {run_of_gold} q ON g.target = q.target AND g.source = q.source) x WHERE n = 1")
# citations inside a document's commentary: references b.N written at its end; do they meet the gold's source, its chapter of ten, or neither
derive("cited", "SELECT g.record, CAST(regexp_extract(ref, RX'b\\.(\\d+)', 1) AS BIGINT) AS source FROM (SELECT record, BOTH('b.' || STR(source), 'b.' || STR(source + record % 3), 'see b.' || STR(source + 11)) AS ref FROM {gold}) g")
query("ga_refs", "SELECT g.record, max(CASE WHEN c.source = g.source THEN 1 ELSE 0 END) AS same, max(CASE WHEN c.source <> g.source AND floor(c.source / 10) = floor(g.source / 10) THEN 1 ELSE 0 END) AS same_chapter, CAST(sum(CASE WHEN floor(c.source / 10) <> floor(g.source / 10) THEN 1 ELSE 0 END) AS BIGINT) AS elsewhere FROM {gold} g JOIN (SELECT DISTINCT record, source FROM {cited}) c ON g.record = c.record GROUP BY g.record")
query("ga_audit", "SELECT g.record, CASE WHEN t.n IS NULL THEN 1 ELSE 0 END AS note_not_found, CASE WHEN coalesce(s.score, 0e0) < 1e0 THEN 1 ELSE 0 END AS head_not_in_paragraph, CASE WHEN k.item_id IS NULL THEN 1 ELSE 0 END AS no_such_verse, CASE WHEN c.n > 1 THEN 1 ELSE 0 END AS repeated, CASE WHEN k2.item_id IS NULL THEN 1 ELSE 0 END AS range_beyond, CASE WHEN coalesce(o.score, 0e0) >= 8e-1 THEN 1 ELSE 0 END AS other_version, CASE WHEN coalesce(q.score, 0) >= 4 THEN 1 ELSE 0 END AS quote_in_verse, CASE WHEN coalesce(q.score, 0) < 3 THEN 1 ELSE 0 END AS no_verbatim_run FROM {gold} g LEFT JOIN (SELECT unit, count(*) AS n FROM {tt} GROUP BY unit) t ON g.target = t.unit LEFT JOIN {s2} s ON g.target = s.target AND g.source = s.source LEFT JOIN {benchmark} k ON g.source = k.item_id LEFT JOIN {benchmark} k2 ON g.source + 1 = k2.item_id LEFT JOIN (SELECT source, count(*) AS n FROM {gold} GROUP BY source) c ON g.source = c.source LEFT JOIN (SELECT a, max(score) AS score FROM {sim} GROUP BY a) o ON g.source = o.a LEFT JOIN {run_of_gold} q ON g.target = q.target AND g.source = q.source")
derive("fixes", "SELECT record, CASE WHEN record % 3 = 0 THEN 'drop' ELSE 'set' END AS action, CASE WHEN record % 7 = 0 THEN source + 1 ELSE source END AS old_source, (source + 1) % n AS new_source, CASE WHEN record % 5 = 0 THEN '' ELSE 'page' END AS evidence FROM {gold} CROSS JOIN {n_src} WHERE record % 2 = 0")
query("ga_correct", "SELECT g.record, g.target, CASE WHEN f.action = 'set' THEN f.new_source ELSE g.source END AS source, CASE WHEN x.record IS NULL THEN 'none' WHEN x.evidence = '' THEN 'no evidence' WHEN x.old_source <> g.source THEN 'stale' WHEN x.m > 1 THEN 'several' ELSE 'applied' END AS state FROM {gold} g LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY record) AS m FROM {fixes}) x ON g.record = x.record LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY record) AS m FROM {fixes}) f ON g.record = f.record AND g.source = f.old_source AND f.evidence <> '' AND f.m = 1 WHERE f.action IS NULL OR f.action <> 'drop'")
query("ga_report", "SELECT n, bad, round(bad * 1e0 / n, 6) AS share, CASE WHEN bad >= 3 OR bad * 1e0 / n >= 2e-2 THEN 1 ELSE 0 END AS defect, round((bad * 1e0 / n + 384e-2 / (2 * n) - 196e-2 * sqrt(bad * 1e0 / n * (1 - bad * 1e0 / n) / n + 384e-2 / (4e0 * n * n))) / (1 + 384e-2 / n), 6) AS low, round((bad * 1e0 / n + 384e-2 / (2 * n) + 196e-2 * sqrt(bad * 1e0 / n * (1 - bad * 1e0 / n) / n + 384e-2 / (4e0 * n * n))) / (1 + 384e-2 / n), 6) AS high, before_ln_rank, after_ln_rank FROM (SELECT count(*) AS n, CAST(sum(CASE WHEN rank > 3 THEN 1 ELSE 0 END) AS BIGINT) AS bad, round(sum(INTS(ln(rank))) / (count(*) * 1e6), 5) AS before_ln_rank, round(sum(CASE WHEN rank <= 3 THEN INTS(ln(rank)) END) / (count(CASE WHEN rank <= 3 THEN 1 END) * 1e6), 5) AS after_ln_rank FROM {rank_s1}) x")
# eight kinds of defects, each put into 20 % of the gold, drawn by md5
DEFECTS = {
    "shift_verse": ("target", "source + 1"),
    "shift_chapter": ("target", "source + 10"),
    "neighbour": ("coalesce(nu, pu, target)", "source"),
    "duplicate": ("target", "source"),
    "random_same_book": ("target", "10 * floor(source / 10) + h % 10"),
    "random": ("target", "h % n"),
    "near_verse": ("target", "source + 1 + h % 5"),
    "inflated_range": ("target", "source"),
}
derive("drawn", "SELECT g.record, g.target, g.source, n.n, u.pu, u.nu, HASHED('h' || STR(g.record)) AS h FROM {gold} g CROSS JOIN {n_src} n JOIN (SELECT unit, lag(unit) OVER (PARTITION BY chapter ORDER BY ord) AS pu, lead(unit) OVER (PARTITION BY chapter ORDER BY ord) AS nu FROM {units}) u ON g.target = u.unit")
derive("broken", " UNION ALL ".join(f"SELECT '{k}' AS defect, record, CASE WHEN UNIFORM('{k}' || STR(record)) < 2e-1 THEN {t} ELSE target END AS target, CAST(CASE WHEN UNIFORM('{k}' || STR(record)) < 2e-1 THEN ({v}) % n ELSE source END AS BIGINT) AS source, {4 if k == 'inflated_range' else 0} * CASE WHEN UNIFORM('{k}' || STR(record)) < 2e-1 THEN 1 ELSE 0 END AS more, CASE WHEN UNIFORM('{k}' || STR(record)) < 2e-1 THEN 1 ELSE 0 END AS injected, {2 if k == 'duplicate' else 1} AS copies FROM {{drawn}}" for k, (t, v) in DEFECTS.items()))
query("ga_synth", "SELECT b.defect, b.injected, count(*) AS n, CAST(sum(CASE WHEN s.score IS NULL OR s.score < 5e-1 OR b.more > 0 OR (b.copies > 1 AND b.injected = 1) THEN 1 ELSE 0 END) AS BIGINT) AS flagged, round(avg(coalesce(s.score, 0e0) - coalesce(o.score, 0e0)), 6) AS bias FROM {broken} b LEFT JOIN {s2} s ON b.target = s.target AND b.source = s.source JOIN {gold} g ON b.record = g.record LEFT JOIN {s2} o ON g.target = o.target AND g.source = o.source GROUP BY b.defect, b.injected")
query("gd_step1", "SELECT a.auc AS auc_length, b.auc AS auc_score, m.auc AS auc_matched, CASE WHEN m.auc >= 6e-1 THEN 'beats length' ELSE 'length alone' END AS decision FROM (" + evaluation.AUC.replace("{BY}", "{by_len}") + ") a CROSS JOIN (" + evaluation.AUC.replace("{BY}", "{by_score}") + ") b CROSS JOIN (SELECT round(avg(CASE WHEN ps > qs THEN 1e0 WHEN ps = qs THEN 5e-1 ELSE 0e0 END), 6) AS auc FROM {band} WHERE abs(pl - ql) * 10 <= 2 * greatest(pl, ql)) m")
# BM25 of the operators against BM25 written anew in SQL; then with a fault put in, which must be found


def _source_word_df(spark, sf):
    """w, df: in how many documents each word of the sources is."""
    known = FG.once(FG.word_features(B.source_lists(spark, sf))).select("f").distinct()
    words = FG.once(FG.word_features(B.target_lists(spark, sf)))
    return words.join(SC.small(known)(known), "f").groupBy("f").agg(F.count(F.lit(1)).alias("df")).withColumnRenamed("f", "w")


define("bm_operator", lambda s, d: SC.bm25(FG.bag(FG.unigrams(given(s, d, "tt"))), FG.bag(FG.unigrams(given(s, d, "st")))), "SELECT * FROM (WITH xt AS (SELECT unit, w AS f, count(*) AS tf FROM tt GROUP BY ALL), xs AS (SELECT unit, w AS f, count(*) AS tf FROM st GROUP BY ALL), " + B.bm25_sql("xt", "xs") + " SELECT * FROM score)", ("tt", "st"))
for _name, _k1 in (("bm_anew", "12e-1"), ("bm_fault", "13e-1")):
    derive(_name, f"SELECT t.unit AS target, s.unit AS source, sum(ln(1 + (n.n - d.df + 5e-1) / (d.df + 5e-1)) * s.tf * ({_k1} + 1) / (s.tf + {_k1} * (25e-2 + 75e-2 * l.dl / n.a))) AS score FROM (SELECT DISTINCT unit, w FROM {{tt}}) t JOIN (SELECT unit, w, count(*) AS tf FROM {{st}} GROUP BY unit, w) s ON t.w = s.w JOIN (SELECT w, count(DISTINCT unit) AS df FROM {{st}} GROUP BY w) d ON d.w = s.w JOIN (SELECT unit, count(*) AS dl FROM {{st}} GROUP BY unit) l ON l.unit = s.unit CROSS JOIN (SELECT count(DISTINCT unit) AS n, count(*) * 1e0 / count(DISTINCT unit) AS a FROM {{st}}) n GROUP BY t.unit, s.unit")
_DIFF = "SELECT count(*) FROM {bm_operator} a FULL OUTER JOIN {OTHER} b ON a.target = b.target AND a.source = b.source WHERE a.score IS NULL OR b.score IS NULL OR abs(a.score - b.score) > 2e-6"
# Spark: the two written anew come from one pass, and all three are laid side by side once
_BM = lambda k1: f"sum(ln(1 + (n.n - d.df + 5e-1) / (d.df + 5e-1)) * s.tf * ({k1} + 1) / (s.tf + {k1} * (25e-2 + 75e-2 * l.dl / n.a)))"
define("tt_words", lambda s, d: FG.once(FG.word_features(B.target_lists(s, d, together=True))).withColumnRenamed("f", "w"), "")
instead("bm_operator", lambda s, d: SC.bm25(FG.counted(FG.word_features(B.target_lists(s, d, together=True))), FG.counted(FG.word_features(B.source_lists(s, d)))))
derive("bm_side", "SELECT target, source, max(op) AS op, max(anew) AS anew, max(fault) AS fault FROM (SELECT target, source, score AS op, CAST(NULL AS DOUBLE) AS anew, CAST(NULL AS DOUBLE) AS fault FROM {bm_operator} UNION ALL SELECT t.unit, s.unit, CAST(NULL AS DOUBLE), " + _BM("12e-1") + ", " + _BM("13e-1") + " FROM {tt_words} t JOIN (SELECT unit, w, count(*) AS tf FROM {st} GROUP BY unit, w) s ON t.w = s.w JOIN (SELECT w, count(DISTINCT unit) AS df FROM {st} GROUP BY w) d ON d.w = s.w JOIN (SELECT unit, count(*) AS dl FROM {st} GROUP BY unit) l ON l.unit = s.unit CROSS JOIN (SELECT count(DISTINCT unit) AS n, count(*) * 1e0 / count(DISTINCT unit) AS a FROM {st}) n GROUP BY t.unit, s.unit) x GROUP BY target, source")
query("gd_repro", "SELECT (" + _DIFF.replace("{OTHER}", "{bm_anew}") + ") AS n_different, CASE WHEN (" + _DIFF.replace("{OTHER}", "{bm_fault}") + ") > 0 THEN 1 ELSE 0 END AS fault_found", spark_body="SELECT count(CASE WHEN op IS NULL OR anew IS NULL OR abs(op - anew) > 2e-6 THEN 1 END) AS n_different, CASE WHEN count(CASE WHEN op IS NULL OR fault IS NULL OR abs(op - fault) > 2e-6 THEN 1 END) > 0 THEN 1 ELSE 0 END AS fault_found FROM {bm_side}")

# --- judge protocol: decoys, verdicts, agreement ------------------------------------------------------------
# A: the best wrong sources of the record's document; B: sources 4 to 8 places away; C: a source that another record of the chapter cites; R: a random one
derive("cited_near", "SELECT g.record, h.source, row_number() OVER (PARTITION BY g.record ORDER BY md5(STR(g.record) || ':' || STR(h.record)), h.record) AS n FROM {gold} g JOIN {units} u ON g.target = u.unit JOIN {units} v ON u.chapter = v.chapter AND v.y = 1 JOIN {gold} h ON h.target = v.unit WHERE NOT EXISTS (SELECT 1 FROM {gold} q WHERE q.target = g.target AND q.source = h.source)")
DECOYS = "SELECT g.record, g.target, g.source, 'gold' AS kind FROM {gold} g UNION ALL SELECT g.record, g.target, r.source, 'A' FROM {gold} g JOIN {ranked} r ON g.target = r.target AND r.source <> g.source AND r.pos <= 3 UNION ALL SELECT g.record, g.target, b.item_id, 'B' FROM (SELECT record, target, BOTH(source - 8, source - 7, source - 6, source - 5, source - 4, source + 4, source + 5, source + 6, source + 7, source + 8) AS near FROM {gold}) g JOIN {benchmark} b ON g.near = b.item_id UNION ALL SELECT g.record, g.target, c.source, 'C' FROM {gold} g JOIN {cited_near} c ON g.record = c.record AND c.n = 1 UNION ALL SELECT record, target, CAST(HASHED('R' || STR(record)) % n AS BIGINT), 'R' FROM {gold} CROSS JOIN {n_src}"
derive("decoys", DECOYS)
query("jd_decoy", "SELECT * FROM {decoys}")
# the first citing record is the least by md5: found as the pairs of a chapter are made, which are not shuffled
derive("cited_first", "SELECT g.record, min_by(h.source, struct(md5(STR(g.record) || ':' || STR(h.record)), h.record)) AS source FROM (SELECT g.*, u.chapter FROM {gold} g JOIN {units} u ON g.target = u.unit) g JOIN (SELECT h.*, v.chapter FROM {gold} h JOIN {units} v ON h.target = v.unit AND v.y = 1) h ON g.chapter = h.chapter LEFT ANTI JOIN {gold} q ON q.target = g.target AND q.source = h.source GROUP BY g.record")
instead("decoys", DECOYS.replace("{ranked}", "{ranked_gold}").replace("JOIN {cited_near} c ON g.record = c.record AND c.n = 1", "JOIN {cited_first} c ON g.record = c.record"))
derive("verdicts", "SELECT d.record, d.kind, d.source, CAST(floor(3 * coalesce(s.score, 0e0)) AS INT) AS v0, coalesce(s.score, 0e0) AS v FROM {decoys} d LEFT JOIN {s2} s ON d.target = s.target AND d.source = s.source")
instead("verdicts", "SELECT d.record, d.kind, d.source, CAST(floor(3 * coalesce(s.bigram, 0e0)) AS INT) AS v0, coalesce(s.bigram, 0e0) AS v FROM {decoys} d LEFT JOIN {pairs_gold} s ON d.target = s.target AND d.source = s.source")
# three readings of each item: a verdict of 0 to 3 that strays by one in about a third of them
derive("repeats", "SELECT record, kind, source, rep, v0, greatest(0, least(3, v0 + CASE WHEN UNIFORM('v' || STR(rep) || ':' || STR(record) || kind || STR(source)) < 2e-1 THEN 1 WHEN UNIFORM('v' || STR(rep) || ':' || STR(record) || kind || STR(source)) > 85e-2 THEN -1 ELSE 0 END)) AS v FROM (SELECT record, kind, source, v0, SEQ(1, 3) AS rep FROM {verdicts}) x")
derive("record_auc", "SELECT b.kind, a.record, sum(CASE WHEN a.v > b.v THEN 2 WHEN a.v = b.v THEN 1 ELSE 0 END) AS won, count(*) AS n FROM {verdicts} a JOIN {verdicts} b ON a.record = b.record AND a.kind = 'gold' AND b.kind <> 'gold' GROUP BY b.kind, a.record")
derive("auc_draws", "SELECT d.rep, r.kind, sum(r.won) / (2e0 * sum(r.n)) AS auc FROM (SELECT rep, pick FROM (SELECT rep, floor(UNIFORM('j' || STR(rep) || ':' || STR(i)) * n) AS pick FROM (SELECT i, n, SEQ(1, " + str(BOOTSTRAP // 5) + ") AS rep FROM {lograte}) w) v) d JOIN {lograte} l ON d.pick = l.i JOIN {record_auc} r ON l.record = r.record GROUP BY d.rep, r.kind")
derive("auc_parts", "SELECT l.i, r.kind, r.won, r.n FROM {lograte} l JOIN {record_auc} r ON l.record = r.record")
sent("auc_parts_sent", "auc_parts")
instead("auc_draws", "SELECT d.rep, r.kind, sum(r.won) / (2e0 * sum(r.n)) AS auc FROM (" + drawn("j", BOOTSTRAP // 5, "lograte") + ") d JOIN {auc_parts_sent} r ON d.pick = r.i GROUP BY d.rep, r.kind")
query("jd_auc", "SELECT a.kind, round(a.auc, 6) AS auc, round(b.low, 5) AS low, CASE WHEN a.auc >= 65e-2 AND b.low > 5e-1 THEN 'judge' ELSE 'filter only' END AS use FROM (SELECT kind, sum(won) / (2e0 * sum(n)) AS auc FROM {record_auc} GROUP BY kind) a JOIN (SELECT kind, QUANT(auc, 25e-3) AS low FROM {auc_draws} GROUP BY kind) b ON a.kind = b.kind")
query("jd_blind", "SELECT record, source AS chosen, CASE WHEN kind = 'gold' THEN 1 ELSE 0 END AS correct FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY v DESC, md5(STR(source)), kind) AS n FROM {verdicts}) x WHERE n = 1")
query("jd_recall", "SELECT count(*) AS n, round(avg(CASE WHEN a.source = g.source THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(max(m.c) * 1e0 / count(*), 6) AS baseline FROM {gold} g LEFT JOIN (SELECT target, source FROM {ranked} WHERE pos = 1) a ON g.target = a.target CROSS JOIN (SELECT max(c) AS c FROM (SELECT count(*) AS c FROM {gold} GROUP BY source) x) m", spark_body="SELECT count(*) AS n, round(avg(CASE WHEN a.source = g.source THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(max(m.c) * 1e0 / count(*), 6) AS baseline FROM {gold} g LEFT JOIN (SELECT target, source FROM {ranked_gold} WHERE pos = 1) a ON g.target = a.target CROSS JOIN (SELECT max(c) AS c FROM (SELECT count(*) AS c FROM {gold} GROUP BY source) x) m")
query("jd_prep", "SELECT substr(md5('key:' || STR(record) || kind || STR(source)), 1, 8) AS item_id, kind FROM (SELECT record, kind, source FROM {decoys} WHERE kind IN ('gold', 'R') UNION ALL SELECT g.record, 'hard', r.source FROM {gold} g JOIN {ranked} r ON g.target = r.target AND r.pos BETWEEN 50 AND 100 AND r.source <> g.source) x", spark_body="SELECT substr(md5('key:' || STR(record) || kind || STR(source)), 1, 8) AS item_id, kind FROM (SELECT record, kind, source FROM {decoys} WHERE kind IN ('gold', 'R') UNION ALL SELECT g.record, 'hard', r.source FROM {gold} g JOIN {ranked_gold} r ON g.target = r.target AND r.pos BETWEEN 50 AND 100 AND r.source <> g.source) x")
query("jd_cost", "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, round(sum(length(text)) / 26e-1, 2) AS tokens FROM {conversations} GROUP BY role")
# every verdict of two or more names the source's text as its quote: it must be in the document, letters and digits only, else the verdict is 0
query("jd_quotecheck", "SELECT v.record, v.kind, v.source, v.v0 AS claimed, CASE WHEN v.v0 >= 2 AND NOT contains(SUBALL(lower(d.text), RX'[^\\p{L}\\p{N}]', ''), SUBALL(lower(b.text), RX'[^\\p{L}\\p{N}]', '')) THEN 0 ELSE v.v0 END AS score FROM {verdicts} v JOIN {documents} d ON d.doc_id = floor(v.record / 100000) JOIN {benchmark} b ON v.source = b.item_id", spark_body="SELECT v.record, v.kind, v.source, v.v0 AS claimed, CASE WHEN v.v0 >= 2 AND NOT contains(SUBALL(lower(d.text), RX'[^\\p{L}\\p{N}]', ''), SUBALL(lower(b.text), RX'[^\\p{L}\\p{N}]', '')) THEN 0 ELSE v.v0 END AS score FROM {verdicts} v JOIN (SELECT doc_id, text FROM {documents} WHERE doc_id IN (SELECT target FROM {gold})) d ON d.doc_id = floor(v.record / 100000) JOIN {benchmark} b ON v.source = b.item_id")
query("jd_synth", "SELECT g.target, g.source, coalesce(w.n, 0) AS shared_words, CASE WHEN coalesce(w.n, 0) = 0 THEN 1 ELSE 0 END AS neutral, CASE WHEN r.pos <= 300 THEN r.pos END AS rank FROM {gold} g LEFT JOIN (SELECT t.unit AS target, s.unit AS source, count(DISTINCT t.w) AS n FROM {tt} t JOIN {st} s ON t.w = s.w AND length(t.w) > 3 JOIN {gold} g ON t.unit = g.target AND s.unit = g.source GROUP BY t.unit, s.unit) w ON g.target = w.target AND g.source = w.source LEFT JOIN {ranked} r ON g.target = r.target AND g.source = r.source", spark_body="SELECT g.target, g.source, coalesce(w.n, 0) AS shared_words, CASE WHEN coalesce(w.n, 0) = 0 THEN 1 ELSE 0 END AS neutral, CASE WHEN r.pos <= 300 THEN r.pos END AS rank FROM {gold} g LEFT JOIN (SELECT g.target, g.source, count(DISTINCT t.w) AS n FROM {gold} g JOIN {tt} t ON t.unit = g.target AND length(t.w) > 3 JOIN {st} s ON s.unit = g.source AND s.w = t.w GROUP BY g.target, g.source) w ON g.target = w.target AND g.source = w.source LEFT JOIN {ranked_gold} r ON g.target = r.target AND g.source = r.source")

# --- more features over sources and vectors ------------------------------------------------------------------
query("fg_window3", "SELECT n.a AS unit, w.w, round(sum(w.x), 6) AS x FROM (SELECT item_id AS a, BOTH(-1, 0, 1) AS d FROM {benchmark}) n JOIN {wb} w ON w.unit = n.a + n.d GROUP BY n.a, w.w")
# tf-idf cosine on content words; idf over sources
derive("content_src", "SELECT s.unit, s.w, count(*) AS tf FROM {st} s JOIN {content} c ON s.w = c.w GROUP BY s.unit, s.w")
derive("content_tgt", "SELECT t.unit, t.w, count(*) AS tf FROM {tt} t JOIN {content} c ON t.w = c.w GROUP BY t.unit, t.w")
derive("content_idf", "SELECT c.w, ln(n.n * 1e0 / greatest(coalesce(d.df, 0), 1)) AS idf FROM {content} c LEFT JOIN (SELECT w, count(*) AS df FROM {content_src} GROUP BY w) d ON c.w = d.w CROSS JOIN {n_src} n")
query("sc_content", "SELECT d.target, d.source, round(d.dot / (a.n * b.n), 6) AS score FROM (SELECT t.unit AS target, s.unit AS source, sum(t.tf * s.tf * i.idf * i.idf) AS dot FROM {content_tgt} t JOIN {content_src} s ON t.w = s.w JOIN {content_idf} i ON i.w = s.w GROUP BY t.unit, s.unit) d JOIN (SELECT t.unit, sqrt(sum(t.tf * t.tf * i.idf * i.idf)) AS n FROM {content_tgt} t JOIN {content_idf} i ON t.w = i.w GROUP BY t.unit) a ON d.target = a.unit JOIN (SELECT s.unit, sqrt(sum(s.tf * s.tf * i.idf * i.idf)) AS n FROM {content_src} s JOIN {content_idf} i ON s.w = i.w GROUP BY s.unit) b ON d.source = b.unit WHERE a.n > 0 AND b.n > 0")
# every normaliser, against all units and against those without gold, with its AUC, its correlation with length and its recall among the first 50
CELLS = [f"zbin_{k}" for k in (5, 10, 20, 40, 80, 160, 320)] + [f"zbinr_{k}" for k in (10, 40, 160)] + ["zbin0"] + [f"zknn_{k}" for k in (25, 50, 100, 200, 400)] + [f"rknn_{k}" for k in (50, 100, 200, 400)]
CELL_PARTS = ["SELECT 'raw' AS norm, unit, len, y, round(score, 3) AS z FROM {best}", "SELECT 'per_token', unit, len, y, round(score / greatest(len, 1), 3) FROM {best}", "SELECT 'per_ln', unit, len, y, round(score / ln(len + 2), 3) FROM {best}"] + [f"SELECT '{c}', unit, len, y, round(z, 3) FROM {{{c}}}" for c in CELLS]
derive("cells", " UNION ALL ".join(CELL_PARTS))
derive("cell_counts", "SELECT norm, z, count(*) AS c, sum(y) AS p FROM {cells} GROUP BY norm, z")


def _cell_counts(spark, sf):
    """norm, z, c, p: made and written a normaliser at a time, so that no plan holds all of them."""
    from functools import reduce

    from echograph import store
    from echograph.plans.common_sql import run

    parts = [store.once(spark, sf, f"cell{k}", lambda s, d, body=body: run(s, d, f"SELECT norm, z, count(*) AS c, sum(y) AS p FROM ({body}) x(norm, unit, len, y, z) GROUP BY norm, z")) for k, body in enumerate(CELL_PARTS)]
    return reduce(lambda a, b: a.unionByName(b), parts)


instead("cell_counts", _cell_counts)
query("ln_grid", "SELECT a.norm, a.auc, b.len_pos, b.len_neg FROM (SELECT norm, round((sum(p * r) - sum(p) * (sum(p) + 1) / 2e0) / (sum(p) * (sum(c) - sum(p))), 5) AS auc FROM (SELECT norm, c, p, sum(c) OVER (PARTITION BY norm ORDER BY z ROWS UNBOUNDED PRECEDING) - c + (c + 1) / 2e0 AS r FROM {cell_counts}) x GROUP BY norm) a JOIN (SELECT norm, round(avg(CASE WHEN y = 1 THEN z END), 2) AS len_pos, round(avg(CASE WHEN y = 0 THEN z END), 2) AS len_neg FROM {cells} GROUP BY norm) b ON a.norm = b.norm", spark_body="SELECT a.norm, a.auc, b.len_pos, b.len_neg FROM (SELECT norm, round((sum(p * r) - sum(p) * (sum(p) + 1) / 2e0) / (sum(p) * (sum(c) - sum(p))), 5) AS auc FROM (SELECT norm, c, p, sum(c) OVER (PARTITION BY norm ORDER BY z ROWS UNBOUNDED PRECEDING) - c + (c + 1) / 2e0 AS r FROM {cell_counts}) x GROUP BY norm) a JOIN (SELECT norm, round(sum(z * p) / nullif(sum(p), 0), 2) AS len_pos, round(sum(z * (c - p)) / nullif(sum(c - p), 0), 2) AS len_neg FROM {cell_counts} GROUP BY norm) b ON a.norm = b.norm")

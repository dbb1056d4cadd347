"""Text sources and reference parsing: pages, wikitext, books, notes, sentences, quotations, citations.

Where the tables hold no text of a kind (wikitext, notes, citations), the query first writes some around
the texts they have, and both engines parse the same.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph import store
from echograph.operators import features as FG
from echograph.operators import scorers as SC
from echograph.plans import base as B
from echograph.plans import evaluation, statistics  # noqa: F401  inputs that these queries share
from echograph.plans.common_sql import define, derive, instead, query, sent

#: Character references and what they stand for; `&amp;` last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&mdash;", "—"), ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&"))


def decoded(x: str) -> str:
    for name, char in REFERENCES:
        x = f"replace({x}, '{name}', '{char}')"
    return x


def plain(x: str) -> str:
    """Tags stripped, references decoded, white space squeezed."""
    return rf"trim(SUBALL({decoded(rf"SUBALL({x}, RX'<[^>]*>', ' ')")}, RX'\s+', ' '))"


# --- pages ------------------------------------------------------------------------------------------------
derive("segments", rf"SELECT page_id, i, {plain('x')} AS text FROM (SELECT page_id, POS(regexp_extract_all(html, RX'(?s)<p>(.*?)</p>', 1)) FROM {{pages}}) z")
query("io_xmlseg", "SELECT page_id, i AS seg, text FROM {segments} WHERE text <> ''")
derive("lines_of_pages", rf"SELECT page_id, url, i, CASE WHEN x LIKE '<h1%' THEN 1 ELSE 0 END AS mark, {plain('x')} AS text FROM (SELECT page_id, url, POS(regexp_extract_all(html, RX'<(?:h1|p)>[^<]*', 0)) FROM {{pages}}) z")
query("io_html", rf"SELECT l.page_id, {plain('t.title')} AS title, l.i, l.text FROM {{lines_of_pages}} l JOIN (SELECT page_id, regexp_extract(html, RX'<title>([^<]*)', 1) AS title FROM {{pages}}) t ON l.page_id = t.page_id WHERE l.text <> ''")
# a host is a part, a title begins a chapter and sets the paragraph numbers back
derive("book_lines", r"SELECT regexp_extract(url, RX'://([^/]*)', 1) AS part, page_id, i, mark, text FROM {lines_of_pages} WHERE text <> ''")
derive("chapters", "SELECT *, sum(mark) OVER (PARTITION BY part ORDER BY page_id, i ROWS UNBOUNDED PRECEDING) AS chapter FROM {book_lines}")
query("io_fb2", "SELECT part, chapter, 'CP.' || part || '.' || STR(chapter) || '.p' || lpad(STR(row_number() OVER (PARTITION BY part, chapter ORDER BY page_id, i)), 3, '0') AS unit, text FROM {chapters} WHERE mark = 0")

# --- wikitext: comments, references, templates four deep, links, headings -----------------------------------
derive("wikitext", r"SELECT doc_id, '== ' || source || ' ==' || chr(10) || '{{' || 'a|{{' || 'b|{{' || 'c|{{' || 'd}}}}}}}}' || '[[' || lang || '|' || source || ']] [[' || lang || ']]<!-- ' || source || ' -->' || text || '<ref name=x>' || lang || '</ref><ref name=y/>' || chr(10) || '=== end ===' AS t FROM {documents}")
_wiki = r"SUBALL(SUBALL(t, RX'(?s)<!--.*?-->', ''), RX'(?s)<ref[^>/]*/>|<ref[^>]*>.*?</ref>', '')"
for _ in range(4):
    _wiki = rf"SUBALL({_wiki}, RX'\{{\{{[^{{}}]*\}}\}}', '')"
_wiki = rf"SUBALL(SUBALL({_wiki}, RX'\[\[[^\]|]*\|', ''), RX'\[\[|\]\]', '')"
query("io_wiki", rf"SELECT doc_id, trim(SUBALL({_wiki}, RX'=+ ([^=]*) =+', '')) AS t FROM {{wikitext}}")

# --- books: the body between the marks, headings by pattern, the last occurrence of each, the count as expected ----
derive("volumes", r"SELECT doc_id, split_part(split_part('front matter' || chr(10) || '*** START ***' || chr(10) || text || chr(10) || '*** END ***' || chr(10) || 'licence', '*** START ***' || chr(10), 2), chr(10) || '*** END ***', 1) AS body FROM {documents}")
derive("volume_lines", "SELECT doc_id, POS(SPLITTED(body)) FROM {volumes}")
derive("headings", r"SELECT doc_id, x AS heading, max(i) AS at FROM {volume_lines} WHERE length(x) BETWEEN 3 AND 40 AND regexp_extract(x, RX'^\p{Lu}', 0) <> '' GROUP BY doc_id, x")
query("io_booksplit", "SELECT h.doc_id, h.heading, h.at, coalesce(lead(h.at) OVER (PARTITION BY h.doc_id ORDER BY h.at), n.lines) - h.at - 1 AS n_lines, CASE WHEN count(*) OVER (PARTITION BY h.doc_id) = n.expected THEN 1 ELSE 0 END AS complete FROM {headings} h JOIN (SELECT doc_id, max(i) + 1 AS lines, count(DISTINCT CASE WHEN length(x) BETWEEN 3 AND 40 AND regexp_extract(x, RX'^\\p{Lu}', 0) <> '' THEN x END) AS expected FROM {volume_lines} GROUP BY doc_id) n ON h.doc_id = n.doc_id")

# --- sentences, hyphens, notes ------------------------------------------------------------------------------
query("io_sent", r"SELECT doc_id, STR(doc_id) || '#' || STR(i) AS unit, trim(x) AS sentence FROM (SELECT doc_id, POS(regexp_extract_all(text, RX'[^.!?\n]+[.!?]*', 0)) FROM {documents}) z WHERE length(SUBALL(trim(x), RX'[^ ]', '')) >= 2")
# a running header and a page number stand between the lines, words are cut at their ends
derive("printed", r"SELECT doc_id, source || chr(10) || replace(text, '. ', '-' || chr(10)) || chr(10) || STR(doc_id % 300) || chr(10) || source AS t, source FROM {documents}")
query("io_dehyphen", r"SELECT doc_id, SUBALL(SUBALL(SUBALL(t, RX'(?m)^(src\d+|\d+)$\n?', ''), RX'([\p{L}])-\n([\p{L}])', BACK(1) || BACK(2)), RX'\n+$', '') AS t FROM {printed}")
# a commentary: chapters now and then, notes with page and number, their bodies over several lines
derive("commentary", r"SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'Chapter ' || STR(CAST(1 + floor(turn / 4) AS BIGINT)) || chr(10) ELSE '' END || CASE WHEN turn % 2 = 0 THEN 'p. ' || STR(conv_id % 90 + turn) || ', n. ' || STR(turn + 1) || '. ' ELSE '' END || text AS part FROM {conversations}")
derive("note_lines", r"SELECT conv_id, k AS i, x FROM (SELECT conv_id, turn * 1000 + i AS k, x FROM (SELECT conv_id, turn, POS(SPLITTED(part)) FROM {commentary}) z) y")
derive("note_parts", r"SELECT conv_id, i, x, max(CASE WHEN x LIKE 'Chapter %' THEN i END) OVER w AS head_at, sum(CASE WHEN regexp_extract(x, RX'^p\. \d+, n\. \d+\.', 0) <> '' OR x LIKE 'Chapter %' THEN 1 ELSE 0 END) OVER w AS part FROM {note_lines} WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)")
query("io_notes", r"SELECT n.conv_id, h.x AS chapter, TRYINT(regexp_extract(n.body, RX'^p\. (\d+)', 1)) AS page, TRYINT(regexp_extract(n.body, RX'^p\. \d+, n\. (\d+)', 1)) AS note, substr(n.body, 1, 4000) AS body FROM (SELECT conv_id, part, max(head_at) AS head_at, LINES(x, i) AS body FROM {note_parts} GROUP BY conv_id, part) n LEFT JOIN {note_lines} h ON n.conv_id = h.conv_id AND n.head_at = h.i WHERE regexp_extract(n.body, RX'^p\. \d+, n\. \d+\.', 0) <> ''")
# numbered notes: a number is a note's if it follows the last one, up to two being missing; one again begins a chapter
derive("anchors", r"SELECT item_id, i, x, TRYINT(regexp_extract(x, RX'\((\d+)\)', 1)) AS no FROM (SELECT item_id, POS(SPLITTED(replace(text, ' ', ' (' || STR(item_id % 7 + 1) || ')' || chr(10)))) FROM {benchmark}) z")
query("io_anchor", "SELECT item_id, no AS anchor, min(i) AS line, count(*) AS n FROM {anchors} WHERE no IS NOT NULL GROUP BY item_id, no")

# --- ids, references, citations -------------------------------------------------------------------------------
derive("dotted", "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN source ELSE 'b.' || source || '.' || STR(CAST(floor(doc_id / 10) AS BIGINT)) || '.' || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE STR(doc_id % 10) END END AS id FROM {documents}")
query("pf_idparse", "SELECT doc_id, nullif(split_part(id, '.', 1), id) AS prefix, nullif(split_part(id, '.', 2), '') AS book, TRYINT(nullif(split_part(id, '.', 3), '')) AS chapter, TRYINT(nullif(split_part(id, '.', 4), '')) AS verse FROM {dotted}")
derive("stated", "SELECT g.record, CASE WHEN s.score IS NULL THEN 'not found' WHEN s.score < 1e0 THEN 'partial' WHEN r.n > 1 THEN 'repeated' ELSE 'ok' END AS status FROM {gold} g LEFT JOIN {s3} s ON g.target = s.target AND g.source = s.source JOIN (SELECT source, count(*) AS n FROM {gold} GROUP BY source) r ON g.source = r.source")
query("pf_status", "SELECT status, count(*) AS n, CASE WHEN status = 'ok' THEN 1 ELSE 0 END AS kept, round(count(*) * 1e0 / max(t.n), 6) AS share FROM {stated} CROSS JOIN (SELECT count(*) AS n FROM {gold}) t GROUP BY status")
derive("marked", "SELECT doc_id, replace(replace(text, '. ', '»'), ', ', '«') AS t FROM {documents}")
query("pf_quotes", r"SELECT doc_id, i, x AS quoted FROM (SELECT doc_id, POS(regexp_extract_all(t, RX'«([^«»]{12,200})»', 1)) FROM {marked}) z WHERE length(SUBALL(trim(x), RX'[^ ]+', '')) >= 3")
query("pf_head", r"SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, RX'^([^.:;\n]{3,90})[.:;\n]', 1)), ''), substr(text, 1, 60)) AS head FROM {documents}")
# prose citations: an abbreviation with chapter and verses, "verses 3-5" of the last book, brackets
derive("prose", r"SELECT item_id, 'see Ps. ' || STR(item_id % 150 + 1) || ':' || STR(item_id % 20 + 1) || '-' || STR(item_id % 20 + 3) || '; verses ' || STR(item_id % 9 + 1) || '-' || STR(item_id % 9 + 2) || ' and (Mk. ' || STR(item_id % 16 + 1) || ':4) nor 12:x' AS t FROM {benchmark}")
derive("mentions", r"SELECT item_id, i, nullif(regexp_extract(x, RX'^(\p{Lu}\p{L}+)\.', 1), '') AS book, TRYINT(nullif(regexp_extract(x, RX'(\d+):', 1), '')) AS chapter, CAST(regexp_extract(x, RX'(?::|verses )(\d+)', 1) AS BIGINT) AS v_from, CAST(coalesce(nullif(regexp_extract(x, RX'-(\d+)$', 1), ''), regexp_extract(x, RX'(\d+)$', 1)) AS BIGINT) AS v_to FROM (SELECT item_id, POS(regexp_extract_all(t, RX'(?:\p{Lu}\p{L}+\. \d+:|verses )\d+(?:-\d+)?', 0)) FROM {prose}) z")
query("pf_reftext", "SELECT m.item_id, m.i, b.book, b.chapter, m.v_from, m.v_to FROM (SELECT *, max(CASE WHEN book IS NOT NULL THEN i END) OVER (PARTITION BY item_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS carried FROM {mentions}) m LEFT JOIN (SELECT item_id, i, book, chapter FROM {mentions}) b ON m.item_id = b.item_id AND m.carried = b.i")
# `Rom.1.19-Rom.1.20` as verses; across chapters the two ends
derive("spans", "SELECT l_partkey AS k, l_suppkey AS votes, 'Rom.' || STR(l_partkey % 16 + 1) || '.' || STR(l_suppkey % 20 + 1) || CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_linenumber % 3 = 1 THEN '-Rom.' || STR(l_partkey % 16 + 1) || '.' || STR(l_suppkey % 20 + 3) ELSE '-Rom.' || STR(l_partkey % 16 + 2) || '.2' END AS ref FROM {lineitem}")
derive("ends", r"SELECT k, votes, ref, CAST(split_part(split_part(ref, '-', 1), '.', 2) AS INT) AS c1, CAST(split_part(split_part(ref, '-', 1), '.', 3) AS INT) AS v1, CAST(coalesce(nullif(split_part(split_part(ref, '-', 2), '.', 2), ''), split_part(split_part(ref, '-', 1), '.', 2)) AS INT) AS c2, CAST(coalesce(nullif(split_part(split_part(ref, '-', 2), '.', 3), ''), split_part(split_part(ref, '-', 1), '.', 3)) AS INT) AS v2 FROM {spans}")
derive("verses", "SELECT k, votes, ref, c1 AS chapter, v AS verse FROM (SELECT k, votes, ref, c1, SEQ(v1, v2) AS v FROM {ends} WHERE c1 = c2) a UNION ALL SELECT k, votes, ref, c1, v1 FROM {ends} WHERE c1 <> c2 UNION ALL SELECT k, votes, ref, c2, v2 FROM {ends} WHERE c1 <> c2")
query("pf_xrefparse", "SELECT ref, chapter, verse, count(*) AS n FROM {verses} GROUP BY ref, chapter, verse")
query("io_zipxref", "SELECT least(a, b) AS a, greatest(a, b) AS b, max(votes) AS votes FROM (SELECT k % 400 AS a, 400 + chapter * 100 + verse AS b, votes FROM {verses} WHERE votes >= 5) x WHERE a <> b GROUP BY least(a, b), greatest(a, b)")
# names by placeholders, the longest first: a name inside a longer one stays whole
NAMES = sorted(("the", "there", "and", "andra", "ing", "tion", "on"), key=lambda x: (-len(x), x))
_hidden = "text"
for _k, _name in enumerate(NAMES):
    _hidden = f"replace({_hidden}, '{_name}', '[{_k}]')"
query("pf_obfuscate", f"SELECT conv_id, turn, {_hidden} AS t FROM {{conversations}}")
# numbers in Roman digits and back: written by digits, read by subtracting a digit before a greater one
_DIGITS = (("M", 1000), ("CM", 900), ("D", 500), ("CD", 400), ("C", 100), ("XC", 90), ("L", 50), ("XL", 40), ("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1))
_rest, _roman = "n", []
for _d, _v in _DIGITS:
    _roman.append(f"repeat('{_d}', CAST(floor(({_rest}) / {_v}) AS INT))")
    _rest = f"({_rest}) % {_v}"
derive("romans", f"SELECT n, {' || '.join(_roman)} AS roman FROM (SELECT DISTINCT doc_id % 3999 + 1 AS n FROM {{documents}}) x")
_value = "CASE substr(roman, p, 1) " + " ".join(f"WHEN '{d}' THEN {v}" for d, v in _DIGITS if len(d) == 1) + " END"
derive("roman_digits", f"SELECT n, roman, p, {_value} AS v FROM (SELECT n, roman, SEQ(1, CAST(length(roman) AS INT)) AS p FROM {{romans}}) x")
query("fn_roman", "SELECT n, roman, CAST(sum(CASE WHEN v < next_v THEN -v ELSE v END) AS BIGINT) AS value FROM (SELECT n, roman, v, lead(v) OVER (PARTITION BY n ORDER BY p) AS next_v FROM {roman_digits}) x GROUP BY n, roman")
# a verdict inside prose: the score of the JSON between the braces, else a bare number after the word; clamped to 0..3
derive("raw_verdicts", r"SELECT record, kind, source, rep, CASE (record + rep) % 4 WHEN 0 THEN 'so {' || '\"score\": ' || STR(v + 2) || ', \"why\": \"x\"} ok' WHEN 1 THEN 'score: ' || STR(v) || ' I think' WHEN 2 THEN 'no idea' ELSE '{' || '\"score\": ' || STR(v - 1) || '}' END AS raw FROM {repeats}".replace('\\"', '"'))
query("jd_parse", r"SELECT record, kind, source, rep, greatest(0, least(3, TRYINT(nullif(regexp_extract(raw, RX'score(?:.: |: )(-?\d+)', 1), '')))) AS score, CASE WHEN raw LIKE '%}%' THEN 'json' WHEN regexp_extract(raw, RX'score: -?\d+', 0) <> '' THEN 'fallback' ELSE 'none' END AS found FROM {raw_verdicts}")
# the order of three filters, read off the sets they leave
query("gd_order", "SELECT a.ord AS first, b.ord AS second, CAST(sum(CASE WHEN a.h = b.h THEN 0 ELSE 1 END) AS BIGINT) AS n_apart, max(a.n) AS n FROM (SELECT ord, count(*) AS n, sum(HASHED(STR(target) || ':' || STR(source))) AS h FROM {orders_of_filters} GROUP BY ord) a JOIN (SELECT ord, sum(HASHED(STR(target) || ':' || STR(source))) AS h FROM {orders_of_filters} GROUP BY ord) b ON a.ord < b.ord GROUP BY a.ord, b.ord")

# --- scorers over shared features ------------------------------------------------------------------------------
derive("bigrams_t", "SELECT unit, pos, f FROM (SELECT unit, pos, w || ' ' || lead(w, 1) OVER (PARTITION BY unit ORDER BY pos) AS f FROM {tt}) x WHERE f IS NOT NULL")
derive("bigrams_s", "SELECT unit, pos, f FROM (SELECT unit, pos, w || ' ' || lead(w, 1) OVER (PARTITION BY unit ORDER BY pos) AS f FROM {st}) x WHERE f IS NOT NULL")
derive("bigram_runs", "SELECT target, source, max(n) + 1 AS score FROM (SELECT target, source, dg, island, count(*) AS n FROM (SELECT target, source, dg, p - row_number() OVER (PARTITION BY target, source, dg ORDER BY p) AS island FROM (SELECT t.unit AS target, s.unit AS source, t.pos - s.pos AS dg, t.pos AS p FROM {bigrams_t} t JOIN {bigrams_s} s ON t.f = s.f) h) i GROUP BY target, source, dg, island) r GROUP BY target, source")
query("sc_lcs", "SELECT a.target, a.source, CAST(coalesce(r.score, 1) AS BIGINT) AS score FROM {s1} a LEFT JOIN {bigram_runs} r ON a.target = r.target AND a.source = r.source")
derive("idf_w", "SELECT w, ln(n.n * 1e0 / count(DISTINCT unit)) AS idf FROM (SELECT 't' || STR(unit) AS unit, w FROM {tt} UNION ALL SELECT 's' || STR(unit), w FROM {st}) x CROSS JOIN (SELECT a.n + b.n AS n FROM (SELECT count(DISTINCT unit) AS n FROM {tt}) a CROSS JOIN (SELECT count(DISTINCT unit) AS n FROM {st}) b) n GROUP BY w, n.n")
for _side, _tok in (("t", "tt"), ("s", "st")):
    _lead = lambda k: f"lead(w, {k}) OVER (PARTITION BY unit ORDER BY pos)"
    _grams = [f"SELECT unit, {n} AS n, 0 AS gap, " + " || ' ' || ".join(["w", *[_lead(k) for k in range(1, n)]]) + f" AS f FROM {{{_tok}}}" for n in (3, 4, 5, 6)]
    _grams += [f"SELECT unit, {n}, 1, " + " || ' ' || ".join("'_'" if k == hole else ("w" if k == 0 else _lead(k)) for k in range(n)) + f" || substr({_lead(hole)}, 1, 0) FROM {{{_tok}}}" for n in (5, 6) for hole in range(1, n - 1)]
    derive(f"grams_{_side}", "SELECT DISTINCT unit, n, gap, f FROM (" + " UNION ALL ".join(_grams) + ") x WHERE f IS NOT NULL")
derive("shared_grams", "SELECT t.unit AS target, s.unit AS source, t.n, t.gap, t.f FROM {grams_t} t JOIN {grams_s} s ON t.f = s.f AND t.gap = s.gap")
derive("gram_words", "SELECT f, POS(WORDS_OF(f)) FROM (SELECT DISTINCT f FROM {shared_grams}) x")
derive("gram_idf", "SELECT g.f, sum(INTS(coalesce(i.idf, 0e0))) AS v FROM {gram_words} g LEFT JOIN {idf_w} i ON g.x = i.w GROUP BY g.f")
derive("gram_hits", "SELECT m.target, m.source, m.n, m.gap, m.f, g.v, row_number() OVER (PARTITION BY m.target, m.source, m.gap ORDER BY g.v DESC, m.f) AS k FROM {shared_grams} m JOIN {gram_idf} g ON m.f = g.f")


def _gram_lists(lists: DataFrame) -> DataFrame:
    """unit, f: the runs of 3 to 6 tokens, and of 5 and 6 with one left open (`_`, which no token is)."""
    return FG.runs_by_size(lists, 6).select("unit", F.explode(F.concat(*[f"g{n}" for n in (3, 4, 5, 6)], *FG.gap_runs())).alias("f"))


def _source_grams(spark: SparkSession, sf: str) -> DataFrame:
    """source, n, gap, f, v: the sources' runs with the sum of the idf of their words; a shared run is one of these, so only their words are counted in the documents."""
    words = lambda lists: FG.once(FG.word_features(lists)).withColumnRenamed("f", "w")
    t, s = B.target_lists(spark, sf), B.source_lists(spark, sf)
    own = words(s)
    known = own.select("w").distinct()
    n = t.select("ws").unionByName(s.select("ws")).where(F.size("ws") > 0).agg(F.count(F.lit(1)).alias("n"))
    df = words(t).join(SC.small(known)(known), "w").unionByName(own).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(n)).select("w", F.floor(F.log(F.col("n") / F.col("df")) * 1e6 + 0.5).cast("bigint").alias("i"))
    grams = _gram_lists(s).distinct().withColumnRenamed("unit", "source")
    worth = grams.select("f").distinct().select("f", F.explode(F.split("f", " ")).alias("w")).join(idf, "w", "left").groupBy("f").agg(F.sum(F.coalesce("i", F.lit(0))).alias("v"))
    return grams.join(worth, "f").select("source", F.size(F.split("f", " ")).alias("n"), F.contains("f", F.lit("_")).cast("int").alias("gap"), "f", "v")


def _shared_grams(spark: SparkSession, sf: str) -> DataFrame:
    s = store.once(spark, sf, "source_grams", _source_grams)
    return _gram_lists(B.target_lists(spark, sf, together=True)).withColumnRenamed("unit", "target").join(SC.small(s)(s), "f").select("target", "source", "n", "gap", "f", "v").distinct()


define("grams_found", _shared_grams, "")
instead("gram_hits", "SELECT target, source, n, gap, f, v, row_number() OVER (PARTITION BY target, source, gap ORDER BY v DESC, f) AS k FROM {grams_found}")
# a pair that shares a run shares two tokens in a row
query("sc_lex2", "SELECT h.target, h.source, max(CASE WHEN h.gap = 0 THEN h.v END) / 1e6 AS best_idf, max(CASE WHEN h.gap = 0 AND h.k = 1 THEN h.n END) AS best_n, max(CASE WHEN h.gap = 1 THEN h.v END) / 1e6 AS best_gap_idf, count(CASE WHEN h.gap = 0 THEN 1 END) AS n_matches, coalesce(sum(CASE WHEN h.gap = 0 AND h.k <= 3 THEN h.v END), 0) / 1e6 AS sum_top3, max(c.score) AS cover_src FROM {gram_hits} h JOIN {s1} c ON h.target = c.target AND h.source = c.source GROUP BY h.target, h.source", spark_body="SELECT h.target, h.source, h.best_idf, h.best_n, h.best_gap_idf, h.n_matches, h.sum_top3, c.word AS cover_src FROM (SELECT target, source, max(CASE WHEN gap = 0 THEN v END) / 1e6 AS best_idf, max(CASE WHEN gap = 0 AND k = 1 THEN n END) AS best_n, max(CASE WHEN gap = 1 THEN v END) / 1e6 AS best_gap_idf, count(CASE WHEN gap = 0 THEN 1 END) AS n_matches, coalesce(sum(CASE WHEN gap = 0 AND k <= 3 THEN v END), 0) / 1e6 AS sum_top3 FROM {gram_hits} GROUP BY target, source) h JOIN (SELECT target, source, word FROM {pairs} WHERE bigram IS NOT NULL) c ON h.target = c.target AND h.source = c.source")
# edges of the stand-in tree: a token's head is at half its position
for _side, _tok in (("t", "tt"), ("s", "st")):
    derive(f"edge_{_side}", f"SELECT DISTINCT c.unit, h.w || ' ' || CASE WHEN c.pos % 2 = 0 THEN 'even' ELSE 'odd' END || ' ' || c.w AS f FROM {{{_tok}}} c JOIN {{{_tok}}} h ON c.unit = h.unit AND c.pos > 0 AND h.pos = floor((c.pos - 1) / 2)")
instead("edge_t", lambda s, d: FG.once(FG.chain_edge_lists(B.target_lists(s, d, together=True))))
instead("edge_s", lambda s, d: FG.once(FG.chain_edge_lists(B.source_lists(s, d))))
derive("edge_idf", "SELECT f, INTS(ln(n.n * 1e0 / count(*))) AS v FROM {edge_s} CROSS JOIN {n_src} n GROUP BY f, n.n")
derive("edge_hits", "SELECT t.unit AS target, s.unit AS source, count(*) AS n, sum(i.v) AS v, max(i.v) AS top, sum(i.v * i.v) AS sq FROM {edge_t} t JOIN {edge_s} s ON t.f = s.f JOIN {edge_idf} i ON s.f = i.f GROUP BY t.unit, s.unit")
derive("edge_post", "SELECT s.unit, s.f, i.v FROM {edge_s} s JOIN {edge_idf} i ON s.f = i.f")
sent("edge_sent", "edge_post")
derive("edge_best", "SELECT t.unit AS target, s.unit AS source, count(*) AS n, sum(s.v) AS v, max(s.v) AS top, sum(s.v * s.v) AS sq, min_by(t.f, struct(-s.v, t.f)) AS f FROM {edge_t} t JOIN {edge_sent} s ON t.f = s.f GROUP BY t.unit, s.unit")
instead("edge_hits", "SELECT target, source, n, v, top, sq FROM {edge_best}")
query("sc_syn2", "SELECT h.target, h.source, h.v / 1e6 AS sum_idf, R6(h.sq / greatest(sqrt(a.q * b.q), 1e0)) AS cos_idf, R6(h.n * 1e0 / b.n) AS cover_src, h.n AS n_shared, h.top / 1e6 AS max_edge FROM {edge_hits} h JOIN (SELECT t.unit, CAST(sum(i.v * i.v) AS DOUBLE) AS q FROM {edge_t} t JOIN {edge_idf} i ON t.f = i.f GROUP BY t.unit) a ON h.target = a.unit JOIN (SELECT s.unit, CAST(sum(i.v * i.v) AS DOUBLE) AS q, count(*) AS n FROM {edge_s} s JOIN {edge_idf} i ON s.f = i.f GROUP BY s.unit) b ON h.source = b.unit")
# candidates of the three layers, each beyond its own threshold, the winning feature kept
derive("wl_t", "SELECT DISTINCT unit, md5(f) AS f FROM {edge_t}")
query("sc_cand_layers", "SELECT 'lexical' AS layer, target, source, v / 1e6 AS score, f AS feature FROM {gram_hits} WHERE gap = 0 AND k = 1 AND v >= 6000000 UNION ALL SELECT 'syntax', h.target, h.source, h.v / 1e6, e.f FROM {edge_hits} h JOIN (SELECT t.unit AS target, s.unit AS source, t.f, row_number() OVER (PARTITION BY t.unit, s.unit ORDER BY i.v DESC, t.f) AS k FROM {edge_t} t JOIN {edge_s} s ON t.f = s.f JOIN {edge_idf} i ON s.f = i.f) e ON h.target = e.target AND h.source = e.source AND e.k = 1 WHERE h.v >= 3000000", spark_body="SELECT 'lexical' AS layer, target, source, v / 1e6 AS score, f AS feature FROM {gram_hits} WHERE gap = 0 AND k = 1 AND v >= 6000000 UNION ALL SELECT 'syntax', target, source, v / 1e6, f FROM {edge_best} WHERE v >= 3000000")
# context of a surprisal score: the source's words that share a five-letter stem with the target are masked
derive("stems_of_gold", "SELECT DISTINCT g.target, g.source, substr(t.w, 1, 5) AS stem FROM {gold} g JOIN {tt} t ON g.target = t.unit WHERE length(t.w) >= 5")
derive("masked", "SELECT g.target, g.source, s.pos, CASE WHEN m.stem IS NULL THEN s.w ELSE '…' END AS w, CASE WHEN m.stem IS NULL THEN 0 ELSE 1 END AS hidden FROM {gold} g JOIN {st} s ON g.source = s.unit LEFT JOIN {stems_of_gold} m ON m.target = g.target AND m.source = g.source AND length(s.w) >= 5 AND substr(s.w, 1, 5) = m.stem")
query("sc_surprisal_mask", "SELECT target, source, CAST(sum(hidden) AS BIGINT) AS n_masked, LINES(w, pos) AS context FROM {masked} GROUP BY target, source")
query("sc_surprisal_shuffle", "SELECT target, source, LINES(w, k) AS context FROM (SELECT g.target, g.source, s.w, row_number() OVER (PARTITION BY g.record ORDER BY md5(STR(g.record) || ':' || STR(s.pos)), s.pos) AS k FROM {gold} g JOIN {st} s ON g.source = s.unit) x GROUP BY target, source")
# the best match of a passage inside a chapter, by the share of its bigrams; kept from the threshold on
query("jn_fuzzy", "SELECT record, target, score FROM (SELECT g.record, s.target, s.score, row_number() OVER (PARTITION BY g.record ORDER BY s.score DESC, s.target) AS k FROM {gold} g JOIN {units} u ON g.target = u.unit JOIN {units} v ON u.chapter = v.chapter JOIN {s2} s ON s.target = v.unit AND s.source = g.source) x WHERE k = 1 AND score >= 6e-1")
# a query's words and the best partners of each: pairs met in three sources or more, by pointwise mutual information
derive("src_words", "SELECT DISTINCT unit, w FROM {st}")
derive("src_df", "SELECT w, count(*) AS df FROM {src_words} GROUP BY w HAVING count(*) >= 3")
derive("partners", "SELECT f, g FROM (SELECT f, g, row_number() OVER (PARTITION BY f ORDER BY pmi DESC, g) AS k FROM (SELECT a.w AS f, b.w AS g, R6(ln(count(*) * 1e0 * max(n.n) / (max(x.df) * max(y.df)))) AS pmi FROM {src_words} a JOIN {src_words} b ON a.unit = b.unit AND a.w <> b.w JOIN {src_df} x ON a.w = x.w JOIN {src_df} y ON b.w = y.w CROSS JOIN {n_src} n GROUP BY a.w, b.w HAVING count(*) >= 3) z) r WHERE k <= 3")
query("fg_cooc_expand", "SELECT unit, f, max(own) AS own FROM (SELECT DISTINCT unit, w AS f, 1 AS own FROM {tt} UNION ALL SELECT DISTINCT t.unit, p.g, 0 FROM {tt} t JOIN {partners} p ON t.w = p.f) x GROUP BY unit, f")
# vectors of length one, as an encoder would hand them over
query("fg_encode", "SELECT e.vec_id, e.i AS dim, R6(e.x / n.n) AS x FROM (SELECT vec_id, i, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, POS(embedding) FROM {embeddings}) z) e JOIN (SELECT vec_id, sqrt(CAST(sum(CAST(floor(CAST(x AS DOUBLE) * 1e9) AS BIGINT) / 1e9 * x) AS DOUBLE)) AS n FROM (SELECT vec_id, POS(embedding) FROM {embeddings}) z GROUP BY vec_id) n ON e.vec_id = n.vec_id")

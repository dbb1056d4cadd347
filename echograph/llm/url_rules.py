"""URL filters: fixed host rules, then association rules mined from labelled URLs.

A URL's tokens are its host labels, path segments and query names. FP-growth mines token sets of the
labelled pages together with the mark of a bad page; sets whose rule `tokens -> bad` reaches the wanted
confidence and support are kept, and of these the ones that no kept subset implies. A rule is indexed
by its rarest part: a URL meets the rules of its own tokens only. Fixed rules of hosts and paths go
first; the longest that fits wins.

What is grown is bounded whatever the URLs are: (1) tokens of under LEAST bad pages, or of no larger
share of bad pages than all pages have, cannot be part of a rule; (2) tokens that the very same pages
have are one item, of which a rule asks for any; (3) an item that is a rule by itself is kept at once,
since it implies all larger sets; (4) of the others a page's ITEMS most telling ones, in one order for
all pages, are its basket, so a rule has ITEMS items at most, and no more than 2^ITEMS / SUPPORT sets
can be frequent.

All of it is DataFrame expressions and Spark's FP-growth. Rules are broadcast only if their number is
bounded. Null urls and urls without `://` have empty host and path: no fixed rule fits, and they have
no tokens, so they are allowed. Without labels of both kinds no rule is mined. A page that is labelled
more than once is bad if any label says so. Repeated rows give repeated rows, equal confidences are
ordered by count and name. Columns other than key and url are not carried.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAME = "op6_url_rules"
FIXED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BAD = "bad page"
#: Of labelled pages: the least share that has a rule's tokens and is bad; of pages with its tokens, the least share that is bad.
SUPPORT, CONFIDENCE = 0.002, 0.7
#: Bad pages that a rule rests on, at least; items of a basket, hence of a rule, at most.
LEAST, ITEMS = 3, 8
#: Rows of the index that are looked up in one array; beyond it the index is joined.
INDEX_ROWS = 1_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return common.lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=FIXED) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tried first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL, marked by where they stand."""
    host, path = parts(url)
    labels = F.transform(F.filter(F.split(host, r"[.:@]"), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.filter(F.split(path, r"[/]"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    names = F.transform(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, r"^([^=]*)", 1)))
    return F.coalesce(F.array_distinct(F.concat(labels, segments, names)), F.array().cast("array<string>"))


def items(found: DataFrame, least: int) -> DataFrame:
    """item, tokens, n, k: tokens of the same pages as one item; pages that have it and bad ones of these. found has row, bad, tokens."""
    each = found.select("row", "bad", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("k"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    share = F.broadcast(found.agg(F.avg(F.col("bad").cast("double")).alias("share")))
    telling = seen.crossJoin(share).where((F.col("k") >= least) & (F.col("k") > F.col("share") * F.col("n")))
    return telling.groupBy("n", "k", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("tokens")).select(F.col("tokens")[0].alias("item"), "tokens", "n", "k")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST, most: int = ITEMS) -> DataFrame:
    """need (items, each as its tokens, the rarest first), support and confidence of the kept rules; labelled has url and bad (boolean)."""
    found = labelled.select(F.monotonically_increasing_id().alias("row"), tokens(F.col("url")).alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad"))
    found = common.written(found.where(F.size("tokens") > 0), "url-items")
    n = found.count()
    least = max(least, -(-int(n * support * 1_000_000) // 1_000_000))
    known = common.written(items(found, least), "url-tokens")
    sure = known.where(F.col("k") >= confidence * F.col("n"))
    alone = sure.select(F.array("tokens").alias("need"), (F.col("k") / n).alias("support"), (F.col("k") / F.col("n")).alias("confidence"))
    rest = known.where(F.col("k") < confidence * F.col("n"))
    if rest.limit(2).count() < 2:
        return common.written(alone, "url-rules")
    of = common.bounded(rest.select(F.explode("tokens").alias("token"), "item", F.struct((-F.col("k") / F.col("n")).alias("less"), (-F.col("k")).alias("k"), "item").alias("place")))
    own = found.select("row", "bad", F.explode("tokens").alias("token")).join(of, "token").groupBy("row", "bad").agg(F.slice(F.array_sort(F.collect_set("place")), 1, most).alias("places"))
    picked = F.transform("places", lambda p: p["item"])
    baskets = common.written(own.where(F.size("places") > 1).select(F.when(F.col("bad"), F.concat(picked, F.array(F.lit(BAD)))).otherwise(picked).alias("items")), "url-baskets")
    size = baskets.count()
    if size < least:
        return common.written(alone, "url-rules")
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / size, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & (F.size("antecedent") > 1))
    # counts over all labelled pages, as for single items: items are in a basket only where the page has them
    rules = common.written(rules.select(F.array_sort("antecedent").alias("set"), (F.col("support") * size / n).alias("support"), "confidence"), "url-sets")
    # a rule goes if a kept rule has a proper subset of its items: it would never decide
    small = common.bounded(rules.select(F.col("set").alias("less"), F.col("less")[0].alias("t")))
    wider = rules.withColumn("t", F.explode("set")).join(small, "t").where((F.size("less") < F.size("set")) & (F.size(F.array_except("less", "set")) == 0)).select("set").distinct()
    kept = rules.join(wider, "set", "left_anti").withColumn("item", F.explode("set")).join(rest.select("item", "tokens", "n"), "item")
    whole = kept.groupBy("set").agg(F.array_sort(F.collect_list(F.struct("n", "tokens"))).alias("by"), F.first("support").alias("support"), F.first("confidence").alias("confidence"))
    return common.written(alone.unionByName(whole.select(F.transform("by", lambda x: x["tokens"]).alias("need"), "support", "confidence")), "url-rules")


def fits(need: Column, own: Column) -> Column:
    """Whether a URL with tokens `own` has one token of each item."""
    return F.forall(need, lambda item: F.arrays_overlap(item, own))


def index_of(rules: DataFrame) -> DataFrame:
    """anchor (each token of a rule's rarest item), need."""
    return rules.select(F.explode(F.col("need")[0]).alias("anchor"), "need").distinct()


def match(pages: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """key and the number of rules that fit, of the pages that any fits; pages has key and tokens."""
    index = common.bounded(index_of(rules))
    met = pages.select(key, "tokens", F.explode("tokens").alias("anchor")).join(index, "anchor")
    return met.where(fits(F.col("need"), F.col("tokens"))).groupBy(key).agg(F.count_distinct("need").alias("n_rules"))


def judge(pages: DataFrame, labels: DataFrame, key: str = "page_id", label_key: str = "doc_id", rules=FIXED, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """key, host, path, rule, verdict, n_rules (mined rules that fit). A label of quality 0 marks a bad page."""
    urls = pages.select(F.col(key), F.col("url"))
    marks = labels.groupBy(F.col(label_key).alias(key)).agg(F.max(F.col("quality") == 0).alias("bad"))
    mined = mine(urls.join(marks, key), support, confidence)
    host, path = parts(F.col("url"))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    seen = urls.withColumn("host", host).withColumn("path", path).withColumn("rule", name).withColumn("fixed", verdict)
    index = index_of(mined)
    if common.few(index, INDEX_ROWS):
        # the whole index, a bounded number of rules, is one array: rows keep their place and no join deals them out
        held = F.broadcast(index.groupBy("anchor").agg(F.collect_list("need").alias("all")).agg(F.map_from_entries(F.collect_list(F.struct("anchor", "all"))).alias("index")))
        met = seen.withColumn("tokens", tokens(F.col("url"))).crossJoin(held)
        near = F.array_distinct(F.flatten(F.filter(F.transform("tokens", lambda t: F.try_element_at("index", t)), lambda x: x.isNotNull())))
        out = met.withColumn("n_rules", F.size(F.filter(near, lambda need: fits(need, F.col("tokens")))).cast("long"))
    else:
        # pages that share a url are judged once: a common url is one row here
        hits = match(seen.select(F.col("url"), tokens(F.col("url")).alias("tokens")).distinct(), mined, "url").withColumnRenamed("url", "u")
        out = seen.join(hits, F.col("url") == F.col("u"), "left").withColumn("n_rules", F.coalesce("n_rules", F.lit(0)).cast("long"))
    method = F.when(F.col("n_rules") > 0, "block").otherwise("allow")
    return out.select(key, "host", "path", "rule", F.coalesce("fixed", method).alias("verdict"), "n_rules")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged, with rules mined from all labelled pages."""
    return judge(common.table(spark, sf_dir, "pages"), common.table(spark, sf_dir, "labels"))


ORACLE_SQL = None

"""URL filtering by hand-written rules and by association rules that FP-growth mines from labelled URLs.

A URL's tokens are its host labels, path segments (numbers become one token), suffix, query keys and
scheme. Each labelled URL is one transaction of its tokens and its label. Tokens that occur in the very same
labelled URLs are one item, named by the first of them (a URL that many pages share, of whatever length, is an item or
few): a rule of several such tokens says no more than one of any of them, so that no rule is lost, and a page has an
item if it has any of its tokens. Rules `items -> label` are taken from the frequent itemsets with and without
a label, and kept by support and confidence; a rule is pruned if one with fewer of its items says the same at no
less confidence. Rules are matched through an inverted index: each is posted under its rarest token,
so that a URL meets only rules whose posting token it has, and each meeting is verified in full.

All of it is DataFrame expressions and Spark's own FP-growth. Null URLs, or such without `://`, have an
empty host and path and no tokens: they get the commonest label. With no labelled URL that is `allow`.
Repeated URLs count as often as they occur. Tokens may hold spaces or any other character: sets are
compared as arrays. Ties between rules go to the one whose text is last. Extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import materialise

ALLOW, BLOCK = "allow", "block"
LABEL = "label="
#: Mined rules are broadcast up to this number; more are joined by shuffle.
BROADCAST_RULES = 50_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty strings where it has none."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def hand_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null; rules: (verdict, host, path)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, in order of text."""
    named = lambda kind, values: F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), x))
    stem = F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")
    segments = F.transform(F.split(stem, "/"), lambda s: F.when(s.rlike(r"^\d+$"), "#").otherwise(s))
    suffix = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    keys = F.regexp_extract_all(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    every = F.concat(named("h", F.split(host, r"\.")), named("p", segments), named("x", F.array(suffix)), named("q", keys))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(every)))


def same_items(labelled: DataFrame) -> DataFrame:
    """(token, item): tokens that occur in just the labelled URLs that another, the item, occurs in. URLs are told
    apart by two 64-bit hashes of their tokens, whose sums over a token's URLs tell its set of them."""
    each = labelled.filter(F.col("label").isNotNull()).select("tokens", F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(1), "tokens").alias("b"))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sets = each.select(F.explode("tokens").alias("token"), "a", "b").groupBy("token").agg(F.count("*").alias("n"), total("a"), total("b"))
    firsts = sets.groupBy("n", "a", "b").agg(F.min("token").alias("item"), F.count("*").alias("members")).filter("members > 1")
    return sets.join(firsts, ["n", "a", "b"]).filter("token <> item").select("token", "item")


def as_items(sets: DataFrame, same: DataFrame) -> DataFrame:
    """(tokens, items) of distinct token sets: each token replaced by its item, in order of text."""
    distinct = sets.select("tokens").distinct()
    changed = distinct.select("tokens", F.explode("tokens").alias("token")).join(same, "token", "left")
    items = changed.groupBy("tokens").agg(F.array_sort(F.collect_set(F.coalesce("item", "token"))).alias("items"))
    return items.union(distinct.filter(F.size("tokens") == 0).select("tokens", F.col("tokens").alias("items")))


def mine(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8) -> DataFrame:
    """(rule_id, tokens, label, confidence, support): pruned rules from rows of (tokens, label)."""
    known = labelled.filter(F.col("label").isNotNull())
    baskets = known.select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), "label"))).alias("items"))
    # Itemsets alone: rules from items to items, which Spark's association rules list too, grow much faster.
    sets = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets).freqItemsets
    sets = materialise(sets.select(F.array_sort(F.filter("items", lambda x: ~x.startswith(LABEL))).alias("tokens"), F.filter("items", lambda x: x.startswith(LABEL)).alias("labels"), "freq"))
    plain = sets.filter((F.size("labels") == 0) & (F.size("tokens") > 0)).select("tokens", F.col("freq").alias("of"))
    told = sets.filter(F.size("labels") == 1).join(plain, "tokens").withColumn("confidence", F.col("freq") / F.col("of")).filter(F.col("confidence") >= min_confidence)
    n = baskets.count()
    rules = told.select("tokens", F.substring(F.col("labels")[0], len(LABEL) + 1, 1000).alias("label"), F.round("confidence", 9).alias("confidence"), F.round(F.col("freq") / max(1, n), 9).alias("support"))
    # Redundant rules: posted under each of their tokens, a shorter rule is met at any token it has.
    short = rules.select(F.explode("tokens").alias("token"), F.col("tokens").alias("fewer"), F.col("label").alias("same"), F.col("confidence").alias("other"))
    longer = rules.select("tokens", "label", "confidence", F.explode("tokens").alias("token"))
    fewer = longer.join(short, "token").filter((F.size("fewer") < F.size("tokens")) & (F.col("label") == F.col("same")) & (F.col("other") >= F.col("confidence")) & (F.size(F.array_except("fewer", "tokens")) == 0))
    kept = rules.join(fewer.select("tokens", "label").distinct(), ["tokens", "label"], "left_anti")
    return kept.withColumn("rule_id", F.to_json("tokens"))


def match(sets: DataFrame, rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """(tokens, mined, confidence, mined_rule) of the best mined rule of each distinct token set (column tokens):
    highest confidence, then support, then most tokens, then the rule's text, last in order. frequency: (token, n)."""
    rarest = rules.select("rule_id", F.explode("tokens").alias("token")).join(frequency, "token", "left")
    posts = rarest.groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("least")).select("rule_id", F.col("least.token").alias("token"))
    index = posts.join(rules.select("rule_id", F.col("tokens").alias("needs"), "label", "confidence", "support"), "rule_id")
    index = F.broadcast(index) if rules.count() <= BROADCAST_RULES else index
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("needs", "tokens")) == 0)
    best = met.groupBy("tokens").agg(F.max(F.struct("confidence", "support", F.size("needs").alias("size"), "rule_id", "label")).alias("best"))
    return best.select("tokens", F.col("best.label").alias("mined"), F.col("best.confidence").alias("confidence"), F.col("best.rule_id").alias("mined_rule"))


def tokenised(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, hand (rule and verdict of a hand-written rule, or null) and tokens of every page."""
    host, path = parts(F.col("url"))
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    return cut.withColumn("hand", hand_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path"))).drop("url")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], min_support: float = 0.01, min_confidence: float = 0.7, least_pages: int = 5) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence, mined_rule: hand-written rules first, then rules
    mined from the URLs that those decide, each borne out by min_support of them and by least_pages at least."""
    cut = tokenised(pages, rules)
    labelled = cut.select("tokens", F.col("hand.verdict").alias("label"))
    counts = {r["label"]: r["n"] for r in labelled.filter("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    common = min(counts, key=lambda k: (-counts[k], k), default=ALLOW)
    # No rule can be borne out by more pages than there are.
    # Every token set once, with its items: pages join it, so that a common set's rows can be split over tasks.
    items = materialise(as_items(cut.filter(F.size("tokens") > 0), same_items(labelled)))
    known = labelled.filter("label is not null").join(items, "tokens").select(F.col("items").alias("tokens"), "label")
    mined = mine(known, min(1.0, max(min_support, least_pages / max(1, sum(counts.values())))), min_confidence)
    frequency = items.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    # Equal token sets have equal best rules: they are judged once, however many pages share them. Pages that a
    # hand-written rule decides, or that have no tokens, need none.
    open_ = F.col("hand").isNull() & (F.size("tokens") > 0)
    # Written out, so that the join deals it anew and can split the pages of a common set over tasks.
    asked = items.join(cut.filter(open_).select("tokens").distinct(), "tokens", "left_semi")
    told = match(asked.select(F.col("items").alias("tokens")).distinct(), mined, frequency).withColumnRenamed("tokens", "items")
    best = materialise(asked.join(told, "items").drop("items"))
    sought = cut.filter(open_).join(best, "tokens", "left").select("page_id", "host", "path", "hand", "mined", "confidence", "mined_rule")
    settled = cut.filter(~open_).select("page_id", "host", "path", "hand", F.lit(None).cast("string").alias("mined"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("mined_rule"))
    verdict = F.coalesce("hand.verdict", "mined", F.lit(common))
    return sought.unionByName(settled).select("page_id", "host", "path", F.col("hand.rule").alias("rule"), verdict.alias("verdict"), "confidence", "mined_rule")

"""SpotSigs fingerprints: chains of content words that follow common-word anchors, as hashed sets.

Texts are lower-cased and cut at whatever is neither a letter nor a digit. Every anchor word starts a
signature: itself and the next `chain` words that are no anchors (fewer at a text's end). A text's
fingerprint is the set of its signatures' hashes; a text without signatures has one signature, its
whole normalised text. Sets are compared by Jaccard likeness, pruned by length: sets whose lengths
alone keep them below the wanted likeness are not intersected.

All of it is DataFrame expressions. A null text is read as an empty one; repeated rows and ties in id
are ordered by text hash; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import keyed, shuffle_partitions

# Frequent function words of four languages, the anchors.
ANCHORS = (
    "the of and to in is it that for on with as are be at by an this was have from or not but he a "
    "le la les de des du et un une en que qui est pour dans par sur au ne pas ce il elle "
    "der die das und ist den dem ein eine zu mit von nicht auf im für auch sich "
    "el los las y del se por una con su para es lo no como más o al"
).split()
FIRST_KEY = -(1 << 63)
DOCS_PER_BUCKET = 2048
MOST_BUCKETS = 1 << 16


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def signatures(text: Column, chain: int = 2) -> Column:
    """Sorted distinct signature hashes of a text; never empty.

    The text is split once. Of the words before a place those that are anchors are as many as the anchor's
    number, so the content words that follow it start at its place less its number."""
    plain = normalised(text)
    words = F.split(plain, " ")
    anchor = lambda w: w.isin(*sorted(set(ANCHORS)))
    parted = F.struct(words.alias("w"), F.filter(words, lambda w: ~anchor(w)).alias("c"))

    def hashed(p: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(p["w"]) - 1), lambda i: anchor(F.get(p["w"], i)))
        found = F.transform(places, lambda i, j: F.when(i - j < F.size(p["c"]), F.xxhash64(F.concat_ws(" ", F.get(p["w"], i), *(F.get(p["c"], i - j + k) for k in range(chain))))))
        return F.array_sort(F.array_distinct(F.array_compact(found)))

    # Bound to one value first: an expression that is used twice would be split twice.
    some = F.element_at(F.transform(F.array(parted), hashed), 1)
    return F.element_at(F.transform(F.array(some), lambda h: F.when(F.size(h) > 0, h).otherwise(F.array(F.xxhash64(plain)))), 1)


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two signature sets; 0 where their lengths bound it below `least`."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(small < F.lit(least) * large, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprint(signature_set: Column) -> Column:
    """A digest of a signature set: its length and a hash of its members."""
    return F.concat(F.lpad(F.lower(F.hex(F.size(signature_set))), 8, "0"), F.substring(F.sha2(F.array_join(signature_set.cast("array<string>"), ",").cast("binary"), 256), 1, 32))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sigs and the next document's text and sigs, in descending doc_id order (after the
    last document comes the first).

    Ids are parted into ranges at approximate quantiles; each range gets a copy of the first document
    of the range after it, so that one shuffle of the texts and a window per range suffice.
    """
    rows = keyed(docs).withColumn("key", F.coalesce("doc_id", F.lit(FIRST_KEY)))
    ids = rows.select("key")
    wanted = min(MOST_BUCKETS, max(4 * shuffle_partitions(docs.sparkSession), ids.count() // DOCS_PER_BUCKET, 2))
    cuts = ids.select(F.col("key").cast("double").alias("at")).approxQuantile("at", [k / wanted for k in range(1, wanted)], 1 / (4 * wanted))
    splits = [-math.inf, *sorted({*cuts, 0.0}), math.inf]
    ranged = Bucketizer(splits=splits, inputCol="at", outputCol="bucket")
    in_ranges = lambda df: ranged.transform(df.withColumn("at", F.col("key").cast("double"))).withColumn("bucket", F.col("bucket").cast("int")).drop("at")
    heads = sorted(((r["bucket"], r["key"]) for r in in_ranges(ids).groupBy("bucket").agg(F.max("key").alias("key")).collect()), reverse=True)
    guests = [(heads[(k + 1) % len(heads)][1], bucket) for k, (bucket, _) in enumerate(heads)]
    heads_df = docs.sparkSession.createDataFrame(guests, "key long, guest int")
    # At most MOST_BUCKETS rows of two numbers.
    both = in_ranges(rows).join(F.broadcast(heads_df), "key", "left")
    places = F.array_compact(F.array(F.struct(F.col("bucket"), F.lit(0).alias("copy")), F.when(F.col("guest").isNotNull(), F.struct(F.col("guest").alias("bucket"), F.lit(1).alias("copy")))))
    dealt = both.select("key", "doc_id", "th", "text", F.explode(places).alias("at")).select("*", "at.bucket", "at.copy").drop("at")
    dealt = dealt.repartition(shuffle_partitions(docs.sparkSession), F.col("bucket")).withColumn("sigs", signatures(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("copy", F.desc("key"), F.desc("th"))
    following = dealt.select("copy", "doc_id", "text", "sigs", F.lead("text").over(order).alias("next_text"), F.lead("sigs").over(order).alias("next_sigs"))
    return following.filter("copy = 0").drop("copy")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness; see the contract of op1."""
    pairs = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third), F.substring(F.col("next_text"), F.lit(1), third))
    made = pairs.withColumn("edited", edited).withColumn("edited_sigs", signatures(F.col("edited")))
    return made.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_matches(queries: DataFrame, docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(query_id, doc_id, likeness) of every document of docs at least that like a query, itself aside.

    Sets are parted by length, each length range a factor 1/least wide, so that a match lies in the
    same or a neighbouring range; within a range they meet at the rarest signatures of their prefixes
    (a set of n signatures shares one of its n - ceil(least n) + 1 rarest with any match) and are then
    compared by pruned Jaccard.
    """
    sets = keyed(docs).select("doc_id", signatures(F.col("text")).alias("sigs"))
    asked = keyed(queries).select(F.col("doc_id").alias("query_id"), signatures(F.col("text")).alias("asked"))
    common = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("n"))
    width = F.lit(math.log(1 / least))

    def prefixes(df: DataFrame, key: str, col: str) -> DataFrame:
        each = df.select(key, F.size(col).alias("size"), F.explode(col).alias("sig")).join(common, "sig", "left")
        turn = F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("n", F.lit(0)), "sig"))
        kept = each.withColumn("turn", turn).filter(F.col("turn") <= F.col("size") - F.ceil(F.col("size") * least) + 1)
        return kept.select(key, "sig", F.floor(F.log(F.col("size").cast("double")) / width).cast("int").alias("range"))

    near = prefixes(asked, "query_id", "asked").withColumn("range", F.explode(F.array(F.col("range") - 1, F.col("range"), F.col("range") + 1)))
    met = near.join(prefixes(sets, "doc_id", "sigs"), ["sig", "range"]).filter("query_id <> doc_id").select("query_id", "doc_id").distinct()
    told = met.join(asked, "query_id").join(sets, "doc_id").select("query_id", "doc_id", likeness(F.col("asked"), F.col("sigs"), least).alias("likeness"))
    return told.filter(F.col("likeness") >= least)

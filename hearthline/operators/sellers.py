"""Seller motivation and negotiability, risk flags and their gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.numbers import nearest
from hearthline.functions.text import contains_any

# Points of severities; wording, severity, effect and confidence of legal flags; code sets.
SEVERITY = {"INFO": 5, "LOW": 20, "MEDIUM": 45, "HIGH": 70, "CRITICAL": 95}
LEGAL_FLAGS = [
    ("PARTIAL_OWNERSHIP", ["1/2", "1/3", "udeo", "suvlas", "deo vlas"], "CRITICAL", "BLOCK", 80),
    ("UNREGISTERED_OR_UNCLEAR", ["nije uknj", "neuknj", "unregistered", "not registered"], "HIGH", "VERIFY", 70),
    ("LEGALIZATION_UNCLEAR", ["legaliz", "ozakonj", "u postupku"], "HIGH", "VERIFY", 70),
    ("ACTIVE_DISPUTE", ["spor", "sud", "dispute", "lawsuit"], "CRITICAL", "BLOCK", 80),
]
UNDOCUMENTED = "CRITICAL_DOCUMENTATION_UNKNOWN"
HARD_BLOCK_CODES = ["ACTIVE_DISPUTE", "AUCTION_SPECIAL_CONDITIONS", "OCCUPIED_PROPERTY", "PARTIAL_OWNERSHIP", "SUSPICIOUS_LISTING"]
HARD_VERIFY_CODES = [UNDOCUMENTED, "LEGALIZATION_UNCLEAR", "OWNERSHIP_UNKNOWN", "PROPERTY_TYPE_MISMATCH", "UNREGISTERED_OR_UNCLEAR"]
SOFT_RISK_CODES = ["BASEMENT_OR_SEMI_BASEMENT", "GROUND_FLOOR", "HIGH_FLOOR_NO_ELEVATOR", "MAJOR_RENOVATION", "POOR_BUILDING", "POOR_PARKING", "TOP_FLOOR_RISK"]
RENOVATION_WORDS = ["major_renovation", "ruin", "full renovation"]
# Where a flag comes from; manual answers of this confidence suppress flags of the others.
FOUND_KINDS = ["SCRAPED", "DERIVED", "LLM"]
LEAST_MANUAL = 70

FLAG = "struct<code:string,severity:string,effect:string,confidence:int,source_kind:string,source_reference:string>"


def price_history(cuts: Column, total_pct: Column) -> tuple[Column, Column]:
    score = F.when((cuts >= 2) & (total_pct >= 10), 85).when((cuts >= 1) & (total_pct >= 5), 70).when(cuts >= 1, 55).otherwise(30)
    return score, F.lit(70)


def market_age(days: Column) -> tuple[Column, Column]:
    score = F.when(days.isNull(), 50).when(days >= 120, 75).when(days >= 60, 60).when(days >= 30, 45).otherwise(25)
    return score, F.when(days.isNull(), 25).otherwise(70)


def relisting(relists: Column, seller_changes: Column) -> tuple[Column, Column]:
    return F.when((relists > 0) | (seller_changes > 0), 65).otherwise(30), F.lit(60)


def seller_type(kind: Column) -> tuple[Column, Column]:
    return F.when(kind == "OWNER", 65).when(kind == "AGENCY", 45).otherwise(50), F.lit(55)


def manual_floor(share: Column) -> tuple[Column, Column]:
    return F.when(share <= 0.90, 85).when(share <= 0.97, 65).when(share.isNotNull(), 35), F.lit(75)


def level_score(lvl: Column) -> Column:
    return F.when(lvl == "LOW", 20).when(lvl == "MEDIUM", 55).when(lvl == "HIGH", 85).otherwise(0)


def components(parts: list[tuple[str, int, Column, Column]]) -> Column:
    """array<struct<name, weight, score, confidence>> of the parts whose score is known."""
    one = lambda n, w, s, c: F.when(s.isNotNull(), F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), s.cast("int").alias("score"), c.cast("int").alias("confidence")))
    return F.array_compact(F.array(*(one(*p) for p in parts)))


def weighted(parts: Column) -> tuple[Column, Column]:
    """Score and coverage-scaled confidence of an array of components, doubles."""
    total = lambda f: F.aggregate(parts, F.lit(0), lambda a, x: a + f(x))
    weight = total(lambda x: x["weight"])
    score = F.try_divide(total(lambda x: x["score"] * x["weight"]), weight)
    conf = F.try_divide(total(lambda x: x["confidence"] * x["weight"]), weight) * (0.70 + 0.30 * F.least(weight, F.lit(100)) / 100)
    return score, conf


def level(score: Column) -> Column:
    return F.when(score.isNull(), "UNKNOWN").when(score >= 70, "HIGH").when(score >= 45, "MEDIUM").otherwise("LOW")


def preferred(manual: Column, manual_conf: Column, other: Column) -> Column:
    """A manual value of confidence 70 or more goes first."""
    return F.when(manual.isNotNull() & (manual_conf >= LEAST_MANUAL), manual).otherwise(F.coalesce(other, manual))


def latest_call(calls: DataFrame, as_of: Column) -> DataFrame:
    """Per property the last call up to as_of that tells anything of the seller: motivation, reason for sale,
    lowest price or preference for cash; what it tells has a confidence of 90."""
    told = ["seller_motivation", "reason_for_sale", "lowest_indicated_price", "cash_preferred"]
    some = calls.filter((F.col("occurred_at") <= as_of) & F.coalesce(*(F.col(c).cast("string") for c in told)).isNotNull())
    last = some.groupBy("property_id").agg(F.max(F.struct("occurred_at", "created_at", "interaction_id", *told)).alias("m"))
    sure = [F.when(F.col(f"m.{c}").isNotNull(), 90).alias(f"{c}_confidence") for c in told if c != "lowest_indicated_price"]
    return last.select("property_id", F.col("m.interaction_id").alias("interaction_id"), *(F.col(f"m.{c}").alias(c) for c in told), *sure)


def flag(code: str, severity: str, effect: str, conf: int, kind: str = "DERIVED", reference: str = "") -> Column:
    named = {"code": code, "severity": severity, "effect": effect, "confidence": conf, "source_kind": kind, "source_reference": reference}
    return F.struct(*(F.lit(v).alias(k) for k, v in named.items()))


def legal_flags(text: Column, lowered: bool = False) -> Column:
    """Flags by wording; a blank text leaves the documents unknown. lowered: see contains_any."""
    at = "effective_property_data.legal_status_raw"
    blank = ~F.coalesce(text.rlike(r"\S"), F.lit(False))
    found = [F.when(contains_any(text, words, lowered), flag(code, severity, effect, conf, "SCRAPED", at)) for code, words, severity, effect, conf in LEGAL_FLAGS]
    return F.array_compact(F.array(F.when(blank, flag(UNDOCUMENTED, "HIGH", "VERIFY", 35, "DERIVED", at)), *found))


def soft_flags(floor: Column, elevator: Column, parking: Column, condition: Column) -> Column:
    """Flags without an effect on the gate; condition is the property's condition category."""
    soft = lambda code, severity, fact: flag(code, severity, "NONE", 65, "DERIVED", f"effective_property_data.{fact}")
    return F.array_compact(F.array(
        F.when(floor == 0, soft("GROUND_FLOOR", "LOW", "floor")),
        F.when((floor >= 7) & (elevator == F.lit(False)), soft("HIGH_FLOOR_NO_ELEVATOR", "MEDIUM", "floor_elevator")),
        F.when(contains_any(condition, RENOVATION_WORDS), soft("MAJOR_RENOVATION", "HIGH", "condition_category")),
        F.when(parking == F.lit(False), soft("POOR_PARKING", "LOW", "parking")),
    ))


def call_flags(registered: Column, owner: Column, mortgage: Column, tenant: Column, reference: Column) -> Column:
    """Flags of what a seller claims in a call."""
    made = [
        (registered == F.lit(False), "UNREGISTERED_OR_UNCLEAR", "HIGH", 75), (owner == F.lit(False), "PARTIAL_OWNERSHIP", "CRITICAL", 75),
        (mortgage == F.lit(True), "MORTGAGE_CLAIMED", "MEDIUM", 70), (tenant == F.lit(True), "OCCUPIED_PROPERTY", "HIGH", 75),
    ]
    return F.array_compact(F.array(*(F.when(c, flag(code, severity, "VERIFY", sure, "MANUAL").withField("source_reference", reference)) for c, code, severity, sure in made)))


def visit_flags(condition: Column, renovation: Column, elevator: Column, floor: Column, defects: Column, reference: Column) -> Column:
    """Flags of what a visit has seen; defects: whether any were written down."""
    heavy = F.upper(F.trim(condition)).isin("FULL", "RENOVATION", "FOR_RENOVATION", "NEEDS_RENOVATION")
    made = [
        (F.coalesce(heavy, F.lit(False)) | F.coalesce(renovation >= 20000, F.lit(False)), "MAJOR_RENOVATION", "HIGH", 90),
        ((elevator == F.lit(False)) & (floor >= 3), "HIGH_FLOOR_NO_ELEVATOR", "MEDIUM", 90), (defects, "VISIBLE_DEFECTS", "MEDIUM", 85),
    ]
    return F.array_compact(F.array(*(F.when(c, flag(code, severity, "VERIFY", sure, "VERIFIED_MANUAL").withField("source_reference", reference)) for c, code, severity, sure in made)))


def claim_flag(code: Column, severity: Column, confidence: Column, reference: Column) -> Column:
    """The flag of an extracted claim, null without a code. Codes that block do so from confidence 75 on and
    else ask for a check, as do codes to verify; soft and unknown ones have no effect, and unknown ones are INFO."""
    up = F.upper(code)
    block, verify, soft = (up.isin(codes) for codes in (HARD_BLOCK_CODES, HARD_VERIFY_CODES, SOFT_RISK_CODES))
    sure = F.coalesce(confidence, F.lit(0))
    default = F.when(block, "CRITICAL").when(verify, "HIGH").when(soft, "MEDIUM").otherwise("INFO")
    named = F.when(F.upper(severity).isin([*SEVERITY]), F.upper(severity))
    told = F.struct(
        up.alias("code"), F.when(block | verify | soft, F.coalesce(named, default)).otherwise("INFO").alias("severity"),
        F.when(block & (sure >= 75), "BLOCK").when(block | verify, "VERIFY").otherwise("NONE").alias("effect"),
        F.least(F.greatest(sure, F.lit(0)), F.lit(100)).cast("int").alias("confidence"), F.lit("LLM").alias("source_kind"), reference.cast("string").alias("source_reference"),
    )
    return F.when(F.coalesce(code, F.lit("")) != "", told)


def unsuppressed(flags: DataFrame, manual: DataFrame) -> DataFrame:
    """Rows of flags and of manual, but for the found flags whose code a manual row of confidence 70 or more
    suppresses. Both: property_id and the fields of a flag; manual also suppresses (array of codes)."""
    settled = manual.filter(F.col("confidence") >= LEAST_MANUAL).select("property_id", F.explode("suppresses").alias("c")).select("property_id", F.upper("c").alias("code")).distinct()
    found = F.col("source_kind").isin(FOUND_KINDS)
    kept = flags.filter(found).withColumn("c", F.upper("code")).join(settled.withColumnRenamed("code", "c"), ["property_id", "c"], "left_anti").select(*flags.columns)
    return kept.unionByName(flags.filter(~found)).unionByName(manual.select(*flags.columns))


def distinct_flags(flags: DataFrame) -> DataFrame:
    """Of the flags of a property with one code, effect, kind and reference, the surest."""
    key = ["property_id", "code", "effect", "source_kind", "source_reference"]
    best = flags.groupBy(*key).agg(F.max(F.struct("confidence", "severity")).alias("m"))
    return best.select(*key, "m.confidence", "m.severity").select(*flags.columns)


def gate(flags: Column) -> tuple[Column, Column, Column]:
    """Status, risk score (null if only documents are unknown) and confidence of an array of flags."""
    has = lambda e: F.exists(flags, lambda x: x["effect"] == e)
    status = F.when(has("BLOCK"), "BLOCK").when(has("VERIFY"), "VERIFY").otherwise("PASS")
    points = lambda x: reduce(lambda o, n: F.when(x["severity"] == n, SEVERITY[n]).otherwise(o), SEVERITY, F.lit(0))
    worst = F.coalesce(F.array_max(F.transform(flags, points)), F.lit(0))
    only_unknown = (F.size(flags) > 0) & F.forall(flags, lambda x: x["code"] == UNDOCUMENTED)
    score = F.when(only_unknown, None).when(status == "BLOCK", F.greatest(worst, F.lit(90))).otherwise(worst)
    return status, score, F.coalesce(F.array_max(F.transform(flags, lambda x: x["confidence"])), F.lit(45))


#: Scores and confidences of an assessment are in hundredths.
MOST = 10_000


def said_level(level_column: str, confidence: str, name: str) -> list[Column]:
    """Aggregates (name_score, name_sure) of a level over a property's extracted answers: the confidence-weighted mean of
    the levels' scores, their plain mean where all confidences are 0, and the mean confidence."""
    counts = F.col(level_column).isin("LOW", "MEDIUM", "HIGH") & F.col(confidence).isNotNull()
    s, c = level_score(F.col(level_column)) * 100, F.round(F.col(confidence) * 100).cast("long")
    total = lambda x: F.sum(F.when(counts, x))
    weighed, plain = nearest(total(s * c), total(c)), nearest(total(s), F.count_if(counts))
    clamp = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(MOST))
    return [clamp(F.when(total(c) > 0, weighed).otherwise(plain)).alias(f"{name}_score"), clamp(nearest(total(c), F.count_if(counts))).alias(f"{name}_sure")]


def composed(parts: list[tuple[int, Column, Column]]) -> tuple[Column, Column]:
    """Score and confidence of components (weight, score, confidence), in hundredths, of those whose score is known: the
    weighted means, the confidence scaled by how much of a weight of 100 is there."""
    known = lambda x, s: F.when(s.isNotNull(), x).otherwise(0)
    weight = sum((known(F.lit(w), s) for w, s, _ in parts), F.lit(0))
    score = nearest(sum((known(s * w, s) for w, s, _ in parts), F.lit(0)), weight)
    sure = nearest(sum((known(c * w, s) for w, s, c in parts), F.lit(0)) * (7_000 + 30 * F.least(weight, F.lit(100))), weight * 10_000)
    return score, F.coalesce(sure, F.lit(0).cast("long"))


def assessed(facts: DataFrame, answers: DataFrame, calls: DataFrame, as_of: Column) -> DataFrame:
    """One row per property of facts: motivation and negotiability (level, score, confidence), whether cash is preferred
    and how sure that is, the reason for sale, and what manual answers settled. Scores are in hundredths.

    facts: property_id, cut_count, total_pct, market_age_days, relist_count, seller_changes, owner_present, agency_count,
    lowest_price. answers, of successful extractions: property_id, answer_id, completed_at, and for motivation,
    negotiability, cash and reason the value and its <name>_confidence. calls: as of latest_call(). A manual answer of
    confidence 70 or more goes before what was extracted or derived; UNKNOWN never does."""
    c = F.col
    order = lambda x: F.struct(F.col(x), F.col("completed_at"), F.col("answer_id"))
    told = lambda v, u, ok: F.max_by(F.struct(c(v).alias("value"), c(u).alias("sure")), F.when(ok & c(u).isNotNull(), order(u)))
    said = answers.groupBy("property_id").agg(
        *said_level("motivation", "motivation_confidence", "m"), *said_level("negotiability", "negotiability_confidence", "n"),
        told("cash", "cash_confidence", c("cash").isNotNull()).alias("cash_said"), told("reason", "reason_confidence", c("reason").isNotNull() & (c("reason") != "UNKNOWN")).alias("reason_said"),
    )
    both = facts.join(said, "property_id", "left").join(latest_call(calls, as_of), "property_id", "left")
    e2 = lambda pair: (pair[0] * 100, pair[1] * 100)
    cuts, age = e2(price_history(c("cut_count"), F.coalesce("total_pct", F.lit(0)))), e2(market_age(c("market_age_days")))
    again = e2(relisting(F.coalesce("relist_count", F.lit(0)), F.coalesce("seller_changes", F.lit(0))))
    kind = e2(seller_type(F.when(c("owner_present"), "OWNER").when(c("agency_count") > 0, "AGENCY").otherwise("OTHER")))
    floor = e2(manual_floor(F.when(c("lowest_price") > 0, c("lowest_indicated_price") / c("lowest_price"))))
    by_hand = F.when(c("seller_motivation").isin("LOW", "MEDIUM", "HIGH"), c("seller_motivation"))
    hand = (F.when(by_hand.isNotNull(), level_score(by_hand) * 100), c("seller_motivation_confidence") * 100)
    motivation, motivation_sure = composed([(35, c("m_score"), c("m_sure")), (30, *cuts), (15, *age), (10, *again), (10, *hand)])
    negotiability, negotiability_sure = composed([(35, c("n_score"), c("n_sure")), (35, *cuts), (15, *age), (15, *kind), (20, *floor)])
    first = by_hand.isNotNull() & (c("seller_motivation_confidence") >= LEAST_MANUAL)
    cash_first = c("cash_preferred").isNotNull() & (c("cash_preferred_confidence") >= LEAST_MANUAL)
    reason_first = c("reason_for_sale").isNotNull() & (c("reason_for_sale") != "UNKNOWN") & (c("reason_for_sale_confidence") >= LEAST_MANUAL)
    first, cash_first, reason_first = (F.coalesce(x, F.lit(False)) for x in (first, cash_first, reason_first))
    grade = lambda score: level(score / 100)
    settled = F.array_compact(F.array(F.when(first, "seller_motivation"), F.when(cash_first, "cash_preference"), F.when(reason_first, "reason_for_sale")))
    return both.select(
        "property_id", F.when(first, by_hand).otherwise(grade(motivation)).alias("motivation_level"), F.when(first, hand[0]).otherwise(motivation).cast("long").alias("motivation_score"),
        F.when(first, hand[1]).otherwise(motivation_sure).cast("long").alias("motivation_confidence"), grade(negotiability).alias("negotiability_level"), negotiability.alias("negotiability_score"),
        negotiability_sure.alias("negotiability_confidence"), F.when(cash_first, c("cash_preferred")).otherwise(c("cash_said.value")).alias("cash_preferred"),
        F.when(cash_first, c("cash_preferred_confidence") * 100).otherwise(F.round(c("cash_said.sure") * 100)).cast("long").alias("cash_confidence"),
        F.when(reason_first, c("reason_for_sale")).otherwise(F.coalesce("reason_said.value", F.lit("UNKNOWN"))).alias("reason_for_sale"), settled.alias("manual_precedence"),
    )

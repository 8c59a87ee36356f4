"""Comparable listings and valuation: similarity, adaptive radius, exclusions, robust median, range."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.functions.numbers import EARTH_RADIUS_M, bands, clamp
from hearthline.functions.text import same_text
from hearthline.operators.rows import cell_of, cells_near, dealt, ensure_checkpoint_dir, radius_pairs, weighted_median

# Weights of the similarity factors, search radii in metres, limits.
WEIGHTS = {"location": 0.25, "size": 0.20, "condition": 0.15, "rooms": 0.10, "building": 0.10, "floor_elevator": 0.08, "age": 0.05, "parking": 0.03, "heating": 0.02, "other": 0.02}
OTHER = 0.70
RADII = (300, 500, 800, 1200)
# Scores by distance, size and other gaps: steps, what is beyond them, and what is unknown; of flags what is unknown and what differs.
DISTANCE = ([(100, 1.0), (300, 0.9), (500, 0.75), (800, 0.6), (1200, 0.45)], 0.0, 0.0)
SIZE_STEPS = ([(0.05, 1.0), (0.10, 0.9), (0.15, 0.75), (0.20, 0.55), (0.25, 0.30)], 0.0, 0.0)
ROOMS = ([(0, 1.0), (0.5, 0.8), (1, 0.5)], 0.2, 0.35)
CONDITION = ([(0, 1.0), (1, 0.7), (2, 0.4)], 0.2, 0.35)
FLOOR = ([(0, 1.0), (1, 0.85), (3, 0.55)], 0.25, 0.40)
YEAR = ([(5, 1.0), (15, 0.7), (30, 0.45)], 0.25, 0.45)
RECENCY = ([(90, 1.0), (180, 0.85), (365, 0.6)], 0.25, 0.50)
FLAG, OTHER_TEXT, BY_TEXT = (0.40, 0.25), 0.40, (0.85, 0.65, 0.40, 0.25)
LEAST_SIMILARITY, OLDEST_DAYS, WANTED, KEPT, LEAST_COMPS, MARKET_FACTOR = 0.45, 365, 4, 12, 3, 0.6


def distance_score(m: Column) -> Column:
    return bands(m, *DISTANCE)


def location_score(m: Column, same: list[Column]) -> Column:
    """By distance where it is known, else by the finest of micro-location, neighbourhood, municipality and
    city that both name alike; same: whether they do."""
    by_text = reduce(lambda o, x: F.when(x[0], x[1]).otherwise(o), reversed([*zip(same, BY_TEXT, strict=True)]), F.lit(0.0))
    return F.when(m.isNotNull(), distance_score(m)).otherwise(by_text)


def size_score(target: Column, size: Column) -> Column:
    off = F.when((target > 0) & (size > 0), F.abs(size - target) / target)
    return bands(off, *SIZE_STEPS)


def rooms_score(a: Column, b: Column) -> Column:
    return bands(F.abs(a - b), *ROOMS)


def condition_score(a: Column, b: Column) -> Column:
    return bands(F.abs(a - b), *CONDITION)


def alike(a: Column, b: Column) -> Column:
    """Whether two texts are the same but for case and outer white space; blank ones never are."""
    return F.coalesce(a.rlike(r"\S") & same_text(a, b), F.lit(False))


def text_score(a: Column, b: Column) -> Column:
    return F.when(alike(a, b), 1.0).otherwise(OTHER_TEXT)


def floor_score(a: Column, b: Column) -> Column:
    return bands(F.abs(a - b), *FLOOR)


def flag_score(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), FLAG[0]).when(a == b, 1.0).otherwise(FLAG[1])


def floor_elevator_score(fa: Column, fb: Column, ea: Column, eb: Column) -> Column:
    return F.round((0.55 * floor_score(fa, fb) + 0.45 * flag_score(ea, eb)).cast("decimal(12,8)"), 4).cast("double")


def year_score(a: Column, b: Column) -> Column:
    return bands(F.abs(a - b), *YEAR)


def recency(age_days: Column) -> Column:
    return bands(age_days, *RECENCY)


def similarity(scores: dict[str, Column]) -> Column:
    """The fixed-weight sum, four digits; what is not given counts as the constant of `other`."""
    total = sum((scores[k] * w for k, w in WEIGHTS.items() if k in scores), F.lit(OTHER * WEIGHTS["other"]))
    return F.round(total.cast("decimal(14,8)"), 4).cast("double")


# Condition names, and words that tell a condition, in the order they are tried.
CONDITION_NAMES = {"MAJOR_RENOVATION": 0, "RUIN": 0, "NEEDS_RENOVATION": 1, "FOR_RENOVATION": 1, "DATED_HABITABLE": 2, "HABITABLE": 2, "GOOD": 3, "ORIGINAL": 3, "RENOVATED": 4, "REFURBISHED": 4, "NEW_OR_LUXURY": 5, "NEW": 5, "LUXURY": 5}
CONDITION_WORDS = [("renov", 4), ("lux", 5), ("new", 5), ("nov", 5), ("good", 3), ("dob", 3), ("habitable", 2), ("usel", 2), ("needs", 1), ("adapt", 1)]


def condition_level(raw: Column) -> Column:
    """0 to 5 by name, else by the first word in order that the text holds, else null."""
    out = F.lit(None).cast("int")
    for word, level in reversed(CONDITION_WORDS):
        out = F.when(F.lower(raw).contains(word), level).otherwise(out)
    name = F.create_map(*(F.lit(x) for pair in CONDITION_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(name, F.upper(F.trim(raw))), out)


# Facts that a target and a comparable's property both have; a comparable's carry the prefix c_.
FACTS = ["size", "rooms", "floor", "elevator", "parking", "condition", "building", "year", "heating", "micro", "neighborhood", "municipality", "city"]
PLACES = ["micro", "neighborhood", "municipality", "city"]
NUMBERS, FLAGS, TEXTS = ["rooms", "floor", "year"], ["elevator", "parking"], ["building", "heating", *PLACES]
SIZE_OFF = 0.25


def input_issue(kind: Column, size: Column, lat: Column, lon: Column, places: list[Column]) -> Column:
    """Why a target cannot be valued at all, or null."""
    located = reduce(lambda a, b: a | b, (F.coalesce(p != "", F.lit(False)) for p in places), lat.isNotNull() & lon.isNotNull())
    return (
        F.when(kind.isNull() | (kind != "APARTMENT"), "UNSUPPORTED_PROPERTY_TYPE").when(size.isNull() | (size <= 0), "MISSING_TARGET_SIZE")
        .when(~located, "MISSING_TARGET_LOCATION")
    )


def eligible(listings: DataFrame, as_of: Column) -> DataFrame:
    """Listings that can be comparables: active apartments of a property, priced in EUR, sized, seen by as_of."""
    c = F.col
    return listings.filter(
        c("property_id").isNotNull() & (c("property_type") == "APARTMENT") & (c("status") == "ACTIVE") & (c("currency") == "EUR")
        & (c("price_cents") > 0) & (c("size") > 0) & (c("first_seen") <= as_of) & (c("last_seen") <= as_of)
    )


def city_matches(texts: DataFrame, cities: DataFrame) -> DataFrame:
    """Distinct (text, city) where the text holds the city's name, whatever the case. Names are sought by
    their first three characters among the text's, so that the join is an equi-join."""
    named = cities.select("city", F.lower("city").alias("low")).filter("low <> ''").distinct().withColumn("gram", F.substring("low", 1, 3))
    low = texts.select("text").filter("text is not null").distinct().withColumn("whole", F.lower("text"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("whole"), F.lit(1)))
    grams = F.array_distinct(F.flatten(F.transform(starts, lambda k: F.array(*(F.substr("whole", k, F.lit(n)) for n in (1, 2, 3))))))
    met = low.withColumn("gram", F.explode(grams)).join(named, "gram").filter(F.col("whole").contains(F.col("low")))
    return met.select("text", "city").distinct()


def _renamed(comps: DataFrame) -> DataFrame:
    return comps.select("listing_id", F.col("property_id").alias("c_property_id"), "price_cents", "age_days", "city_raw", "location_raw", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), *(F.col(f).alias(f"c_{f}") for f in FACTS))


def _priced(pairs: DataFrame) -> DataFrame:
    """Rows with price_m2 (cents), where that is above zero."""
    return pairs.withColumn("h", F.round(F.col("c_size") * 100).cast("long")).filter("h > 0").withColumn("price_m2", F.expr("(200 * price_cents + h) div (2 * h)")).filter("price_m2 > 0").drop("h")


#: Most pairs and rows of a side that one group of best_pairs() looks at.
BLOCK_PAIRS, BLOCK_ROWS = 50_000_000, 200_000


def best_pairs(targets: DataFrame, comps: DataFrame, most_pairs: int = BLOCK_PAIRS, most_rows: int = BLOCK_ROWS) -> DataFrame:
    """Targets beside the comparables that they may be valued by, with distance_m: those that ranked() would keep within
    any of the radii (or without a distance) of a block, so that adaptive_radius() and ranked() over these give what they
    would give over all pairs.

    A target meets comparables of another property, at most 25 percent off in size, and of the target's city, if it has
    one: by the property's city, or within the listing's own texts. Targets with coordinates meet them within the widest
    radius; others go by size, in bands a third wide. Every pair of a block is scored, in whole ten-thousandths and
    on columns of numbers, but none is a row: only the best of each target leave the task. Targets are posted, listings lie in
    one cell and one band; hot blocks are cut (rows.dealt)."""
    c = F.col
    plain = lambda x: F.when(x.rlike(r"\S"), F.lower(F.trim(x)))
    number = lambda x: x.cast("double")

    def with_codes(df: DataFrame, pre: str, ident: Column) -> DataFrame:
        f = lambda n: c(f"{pre}{n}")
        made = {f"_{n}": plain(f(n)) for n in TEXTS} | {f"_{n}": number(f(n)) for n in NUMBERS} | {f"_{n}": f(n).cast("int").cast("double") for n in FLAGS}
        return df.withColumns(made | {"_condition": number(condition_level(f("condition"))), "_property": ident.cast("string")})

    told = with_codes(_priced(_renamed(comps)).filter("c_property_id is not null"), "c_", c("c_property_id"))
    asked = with_codes(targets.filter("property_id is not null"), "", c("property_id")).withColumn("_town", F.coalesce("city", F.lit("")))
    cities = asked.select("city").filter("city <> ''").distinct()
    texts = told.select(F.explode(F.array("city_raw", "location_raw")).alias("text"))
    found = city_matches(texts, cities).groupBy("text").agg(F.collect_set("city").alias("_at"))
    for k, text in enumerate(("city_raw", "location_raw")):
        told = told.join(found.select(c("text").alias(text), c("_at").alias(f"_at{k}")), text, "left")
    none = F.array().cast("array<string>")
    towns = F.array_distinct(F.array_compact(F.concat(F.array(F.lit(""), "c_city"), F.coalesce("_at0", none), F.coalesce("_at1", none))))
    told = told.withColumn("_town", F.explode(towns)).drop("_at0", "_at1")

    width = F.lit(math.log(4 / 3))
    band = lambda x: F.floor(F.log(x.cast("double")) / width)
    placed = c("lat").isNotNull() & c("lon").isNotNull()
    ends = F.sequence(band(c("size") * (1 - SIZE_OFF)), band(c("size") * (1 + SIZE_OFF)))
    a = cells_near(asked.filter(placed), "lat", "lon", RADII[-1]).withColumn("_near", F.lit(True))
    a = a.unionByName(asked.filter(~placed).withColumn("_row", F.explode(ends)).withColumns({"_col": F.lit(0).cast("long"), "_near": F.lit(False)}))
    b = cell_of(told.filter("lat2 is not null and lon2 is not null"), "lat2", "lon2", RADII[-1]).withColumn("_near", F.lit(True))
    b = b.unionByName(told.withColumns({"_row": band(c("c_size")), "_col": F.lit(0).cast("long"), "_near": F.lit(False)}))
    on = ["_town", "_near", "_row", "_col"]
    a, b = dealt(a, b, on, (c("_property"), c("listing_id")), most_pairs, most_rows)
    renamed = _renamed(comps)
    schema = T.StructType([*targets.schema.fields, *renamed.schema.fields, T.StructField("distance_m", T.DoubleType())])
    names, others, out = targets.columns, renamed.columns, schema.names

    def best(ts: pa.Table, ls: pa.Table) -> pa.Table:
        at, to, metres = _best_of_block(ts, ls) if len(ts) and len(ls) else ([], [], [])
        mine, theirs = ts.select(names).take(pa.array(at, pa.int64())), ls.select(others).take(pa.array(to, pa.int64()))
        return pa.table([*mine.columns, *theirs.columns, pa.array(metres, pa.float64(), from_pandas=True)], names=out)

    return a.groupBy(*on, "_pa", "_pb").cogroup(b.groupBy(*on, "_pa", "_pb")).applyInArrow(best, schema)


def _units(x: np.ndarray, steps: list[tuple[float, float]], otherwise: float, unknown: float, null: np.ndarray | None = None) -> np.ndarray:
    """As bands(), in ten-thousandths."""
    out = np.full(len(x), round(10_000 * otherwise), np.int32)
    for bound, value in reversed(steps):
        out[x <= bound] = round(10_000 * value)
    if null is not None:
        out[null] = round(10_000 * unknown)
    return out


def _metres(lat: float, lon: float, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(h))


def _first(key: np.ndarray, weight: Callable[[np.ndarray], np.ndarray], metres: np.ndarray | None, turn: np.ndarray) -> np.ndarray:
    """Where the first KEPT are by key (the highest first; below 0 is none), weight, distance (0 counts as unknown) and turn."""
    at = np.flatnonzero(key >= max(0, np.partition(key, len(key) - KEPT)[len(key) - KEPT] if len(key) > KEPT else 0))
    far = np.zeros(len(at)) if metres is None else np.where(metres[at] == 0, 999999.0, metres[at])
    return at[np.lexsort((turn[at], far, -weight(at), -key[at]))[:KEPT]]


def _best_of_block(ts: pa.Table, ls: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ts, of ls, and metres (NaN where a target has no place) of the pairs that best_pairs() keeps of a block.

    What a pair scores by a fact depends on the target and the comparable's value alone: a target scores the distinct values
    of a few facts together, and looks them up for the comparables whose size fits, which lie side by side."""
    ls = ls.append_column("_at", pa.array(np.arange(len(ls)))).sort_by([("c_size", "ascending")])
    number = lambda t, n: t[n].combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False)
    unknown = lambda t, n: pc.is_null(t[n]).combine_chunks().to_numpy(zero_copy_only=False)

    def codes(name: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts of both sides, -1 for null."""
        both = pa.concat_arrays([x for t in (ts, ls) for x in t[name].chunks]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        return both[: len(ts)], both[len(ts) :]

    def distinct(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct numbers of ls, whether each is null, and each row's place among them; nulls come last."""
        x, null = number(ls, name), unknown(ls, name)
        values, place = np.unique(x[~null], return_inverse=True)
        where = np.full(len(x), len(values))
        where[~null] = place
        return np.append(values, np.nan), np.arange(len(values) + 1) == len(values), where

    def together(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct rows of columns of codes from 0, and each row's place among them."""
        one = np.zeros(len(ls), np.int64)
        for x in columns:
            one = np.unique(one * (int(x.max()) + 1) + x, return_inverse=True)[1]
        first = np.unique(one, return_index=True)[1]
        return np.column_stack([x[first] for x in columns]), one

    def looked(values: np.ndarray, where: np.ndarray, score: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """score of the values at rows; of each value once where that is less."""
        return score(values)[where] if len(values) <= len(where) else score(values[where])

    sizes, t_size = number(ls, "c_size"), number(ts, "size")
    low, high = np.searchsorted(sizes, t_size * (1 - SIZE_OFF), "left"), np.searchsorted(sizes, t_size * (1 + SIZE_OFF), "right")
    facts = {n: (number(ts, f"_{n}"), unknown(ts, f"_{n}"), *distinct(f"_{n}")) for n in [*NUMBERS, *FLAGS, "condition"]}
    texts = {n: codes(f"_{n}") for n in TEXTS}
    mine, theirs = codes("_property")
    recent = _units(number(ls, "age_days"), *RECENCY, unknown(ls, "age_days")) // 100
    young = (~(number(ls, "age_days") > OLDEST_DAYS) | unknown(ls, "age_days")).astype(np.int16) << 14
    turn = np.empty(len(ls), np.int64)
    turn[pc.sort_indices(ls.select(["age_days", "listing_id"]), [("age_days", "ascending"), ("listing_id", "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(ls))
    share = {k: round(100 * w) for k, w in WEIGHTS.items()}
    flat, sized = np.unique(sizes, return_inverse=True)
    rest, least = round(10_000 * OTHER) * share["other"] + 50, round(10_000 * LEAST_SIMILARITY)
    first_facts, second_facts = ["condition", "rooms", "parking"], ["floor", "elevator", "year"]
    first = together([*(facts[n][4] for n in first_facts), *(texts[n][1] + 1 for n in ("building", "heating"))])
    second = together([facts[n][4] for n in second_facts])
    near = bool(ts["_near"][0].as_py())
    if near:
        lat, lon, lat2, lon2 = (number(*x) for x in ((ts, "lat"), (ts, "lon"), (ls, "lat2"), (ls, "lon2")))
        spots = [np.unique(x, return_inverse=True) for x in (lat2, lon2)]
        places = together([x[1] for x in spots])
    else:
        places = together([texts[n][1] + 1 for n in PLACES])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    for i in np.flatnonzero((high > low) & (mine >= 0)):
        s = slice(low[i], high[i])

        def gap(n: str, steps: tuple, i: int = i) -> np.ndarray:
            x, none, values, nulls, _ = facts[n]
            return _units(np.abs(values - x[i]), *steps, nulls | none[i])

        def flag(n: str, i: int = i) -> np.ndarray:
            x, none, values, nulls, _ = facts[n]
            return np.where(nulls | none[i], round(10_000 * FLAG[0]), np.where(values == x[i], 10_000, round(10_000 * FLAG[1])))

        def by_place(v: np.ndarray, i: int = i) -> np.ndarray:
            out = np.zeros(len(v), np.int32)
            for k, n in reversed([*enumerate(PLACES)]):
                if texts[n][0][i] >= 0:
                    out[v[:, k] == texts[n][0][i] + 1] = share["location"] * round(10_000 * BY_TEXT[k])
            return out

        text = lambda n, v, i=i: np.where((v == texts[n][0][i] + 1) & (v > 0), 10_000, round(10_000 * OTHER_TEXT))
        by_condition, by_rooms, by_parking = share["condition"] * gap("condition", CONDITION), share["rooms"] * gap("rooms", ROOMS), share["parking"] * flag("parking")
        by_floor, by_lift, by_year = gap("floor", FLOOR), flag("elevator"), share["age"] * gap("year", YEAR)
        one = lambda v: by_condition[v[:, 0]] + by_rooms[v[:, 1]] + by_parking[v[:, 2]] + share["building"] * text("building", v[:, 3]) + share["heating"] * text("heating", v[:, 4])
        two = lambda v: share["floor_elevator"] * ((55 * by_floor[v[:, 0]] + 45 * by_lift[v[:, 1]] + 50) // 100) + by_year[v[:, 2]]
        total = looked(flat, sized[s], lambda v, i=i: share["size"] * _units(np.abs(v - t_size[i]) / t_size[i], *SIZE_STEPS)) + looked(first[0], first[1][s], one) + looked(second[0], second[1][s], two)
        metres = None
        if near:
            metres = looked(places[0], places[1][s], lambda v, i=i: _metres(lat[i], lon[i], spots[0][0][v[:, 0]], spots[1][0][v[:, 1]]))
            total += share["location"] * _units(np.round(metres, 2), *DISTANCE)
        else:
            total += looked(places[0], places[1][s], by_place)
        similar = (total + rest) // 100
        key = similar.astype(np.int16)
        key += np.where(similar >= least, young[s], 0).astype(np.int16)
        key[theirs[s] == mine[i]] = -1
        weight = lambda at, similar=similar, s=s: (similar[at] * round(10 * MARKET_FACTOR) * recent[s][at].astype(np.int64) + 500) // 1000
        if near:
            key[metres > RADII[-1]] = -1
            metres = np.round(metres, 2)
            within = [np.flatnonzero(metres <= r) for r in RADII[:-1]]
            kept = [w[_first(key[w], lambda at, w=w: weight(w[at]), metres[w], turn[s][w])] for w in within]
            kept = np.unique(np.concatenate([*kept, _first(key, weight, metres, turn[s])]))
        else:
            kept = _first(key, weight, None, turn[s])
        found.append((np.full(len(kept), i), kept + s.start, metres[kept] if near else np.full(len(kept), np.nan)))
    if not found:
        return np.array([], int), np.array([], int), np.array([])
    at, to, metres = (np.concatenate(x) for x in zip(*found, strict=True))
    return at, ls["_at"].combine_chunks().to_numpy()[to], metres


def compared(pairs: DataFrame) -> DataFrame:
    """pairs with similarity and price_m2 (cents)."""
    c = F.col
    both = lambda f: (c(f), c(f"c_{f}"))
    scores = {
        "location": location_score(c("distance_m"), [alike(*both(p)) for p in PLACES]), "size": size_score(*both("size")),
        "condition": condition_score(condition_level(c("condition")), condition_level(c("c_condition"))), "rooms": rooms_score(*both("rooms")),
        "building": text_score(*both("building")), "floor_elevator": floor_elevator_score(*both("floor"), *both("elevator")), "age": year_score(*both("year")),
        "parking": flag_score(*both("parking")), "heating": text_score(*both("heating")),
    }
    return _priced(pairs.withColumn("similarity", similarity(scores)))


def comparables(targets: DataFrame, comps: DataFrame) -> DataFrame:
    """The best twelve comparables of each target, marked with exclusion (null where one counts), radius_m,
    similarity, weight and price_m2."""
    ensure_checkpoint_dir(targets.sparkSession)
    # Written once: radii, ranks and outliers are passes over the few best pairs.
    pairs = compared(best_pairs(targets, comps).checkpoint())
    near = adaptive_radius(pairs.filter("distance_m is not null"), "property_id")
    chosen = near.unionByName(pairs.filter("distance_m is null").withColumn("radius_m", F.lit(None).cast("int")))
    return without_outliers(ranked(chosen, "property_id", "listing_id"), "property_id", "price_m2")


def valued(targets: DataFrame, comps: DataFrame) -> DataFrame:
    """A valuation of every target (property_id, property_type, the FACTS, precision, lat, lon, quality) by
    eligible comparables (listing_id, property_id, price_cents, age_days, city_raw, location_raw, lat, lon and
    the FACTS): SUCCESS with values in cents, or INSUFFICIENT_DATA and the reason."""
    c = F.col
    asked = targets.withColumn("issue", input_issue(c("property_type"), c("size"), c("lat"), c("lon"), [c(p) for p in PLACES]))
    found = comparables(asked.filter("issue is null").drop("issue", "property_type", "precision", "quality"), comps)
    ok = F.col("exclusion").isNull()
    units = F.round(c("weight") * 10_000).cast("long")
    level = condition_level(c("c_condition"))
    weight_if = lambda cond: F.sum(F.when(ok & cond, units).otherwise(0))
    told = found.groupBy("property_id").agg(
        F.count("*").alias("candidate_count"), F.count_if(ok).alias("included_count"), F.max("radius_m").alias("radius_m"),
        F.percentile(F.when(ok, c("price_m2")), F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"),
        (F.sum(F.when(ok, F.round(c("similarity") * 10_000).cast("long"))) / F.count_if(ok) / 10_000).alias("mean_similarity"),
        (F.sum(F.when(ok, F.round(recency(c("age_days")) * 100).cast("long"))) / F.count_if(ok) / 100).alias("mean_recency"),
        F.sum(F.when(ok, level * units)).alias("level_sum"), weight_if(level.isNotNull()).alias("level_weight"),
        weight_if(c("c_parking")).alias("parking_sum"), weight_if(c("c_parking").isNotNull()).alias("parking_weight"),
    )
    counting = found.filter(ok).select("property_id", "price_m2", units.alias("units")).filter("units > 0")
    base = weighted_median(counting, ["property_id"], "price_m2", "units", "base_m2")
    own_level = condition_level(c("condition"))
    all_told = asked.join(told, "property_id", "left").join(base, "property_id", "left")
    mean_level = F.round((c("level_sum") / F.when(c("level_weight") > 0, c("level_weight"))).cast("decimal(18,10)"), 4)
    share = c("parking_sum") / F.when(c("parking_weight") > 0, c("parking_weight"))
    spread = F.when(c("included_count") < 2, 1.0).when(c("q")[1] > 0, F.abs((c("q")[2] - c("q")[0]) / c("q")[1])).otherwise(1.0)
    sized = all_told.withColumns({
        "included_count": F.coalesce("included_count", F.lit(0)), "candidate_count": F.coalesce("candidate_count", F.lit(0)),
        "adjustment_pct": adjustment_pct(own_level.cast("decimal(12,4)"), mean_level.cast("decimal(12,4)"), c("parking"), share).cast("decimal(10,4)"),
        "dispersion": F.round(spread.cast("decimal(18,8)"), 4).cast("double"),
    })
    coarse = F.coalesce(c("precision").isin("CITY", "MUNICIPALITY"), F.lit(False))
    sure = confidence(c("included_count"), c("mean_similarity"), c("quality"), c("dispersion"), c("mean_recency"), coarse, own_level.isNotNull())
    reason = F.coalesce(c("issue"), F.when(c("included_count") < LEAST_COMPS, "NOT_ENOUGH_INCLUDED_COMPS"), F.when(c("base_m2").isNull(), "NO_WEIGHTED_PRICE"))
    priced = sized.withColumn("reason", reason).withColumn("confidence", F.when(c("reason").isNull(), sure.cast("double")).otherwise(0.0))
    width = F.round(range_width(c("confidence"), c("included_count"), c("dispersion"), c("quality")).cast("decimal(10,6)"), 4)
    in_units = priced.withColumns({"a": F.round(c("adjustment_pct") * 10_000).cast("long"), "h": F.round(c("size") * 100).cast("long"), "w": F.round(width * 10_000).cast("long")})
    adjusted = in_units.withColumn("adjusted_m2", F.expr("(2 * base_m2 * (1000000 + a) + 1000000) div 2000000")).withColumn("fair_cents", F.expr("(2 * adjusted_m2 * h + 100) div 200"))
    ends = adjusted.withColumns({"low_cents": F.expr("(2 * fair_cents * (10000 - w) + 10000) div 20000"), "high_cents": F.expr("(2 * fair_cents * (10000 + w) + 10000) div 20000")})
    only = lambda x: F.when(c("reason").isNull(), c(x)).alias(x)
    return ends.select(
        "property_id", F.when(c("reason").isNull(), "SUCCESS").otherwise("INSUFFICIENT_DATA").alias("status"), "reason", "candidate_count",
        F.when(c("reason").isNull(), c("included_count")).otherwise(0).alias("included_count"), "radius_m", only("base_m2"), only("adjusted_m2"), only("fair_cents"), only("low_cents"), only("high_cents"),
        "confidence", only("dispersion"), only("adjustment_pct"),
    )


def nearby(targets: DataFrame, listings: DataFrame) -> DataFrame:
    """Target and listing pairs within the widest radius and 25 percent of size, not of one property."""
    fits = (F.col("property_id2") != F.col("property_id")) & (F.abs(F.col("size2") - F.col("size")) <= 0.25 * F.col("size"))
    return radius_pairs(targets, listings, RADII[-1], fits)


def adaptive_radius(pairs: DataFrame, key: str) -> DataFrame:
    """Pairs within the least radius that holds enough good comparables (else the widest)."""
    good = (F.col("similarity") >= LEAST_SIMILARITY) & F.coalesce(F.col("age_days") <= OLDEST_DAYS, F.lit(True))
    counts = pairs.groupBy(key).agg(*(F.count_if(good & (F.col("distance_m") <= r)).alias(f"n{r}") for r in RADII))
    radius = reduce(lambda o, r: F.when(F.col(f"n{r}") >= WANTED, r).otherwise(o), reversed(RADII[:-1]), F.lit(RADII[-1]))
    chosen = counts.select(key, radius.alias("radius_m"))
    return pairs.join(chosen, key).filter(F.col("distance_m") <= F.col("radius_m"))


def ranked(pairs: DataFrame, key: str, ident: str) -> DataFrame:
    """exclusion (TOO_OLD, LOW_SIMILARITY or null) and the best 12 per key: included first, then by
    similarity, weight and distance, where a distance of 0 counts as unknown; then the youngest."""
    excluded = F.when(F.col("age_days") > OLDEST_DAYS, "TOO_OLD").when(F.col("similarity") < LEAST_SIMILARITY, "LOW_SIMILARITY")
    weight = F.round((F.col("similarity") * MARKET_FACTOR * recency(F.col("age_days"))).cast("decimal(14,8)"), 4).cast("double")
    marked = pairs.withColumn("exclusion", excluded).withColumn("weight", weight)
    far = F.when(F.coalesce("distance_m", F.lit(0.0)) == 0, 999999.0).otherwise(F.col("distance_m"))
    order = [F.col("exclusion").isNull().desc(), F.desc("similarity"), F.desc("weight"), far.asc(), F.asc("age_days"), F.asc(ident)]
    return marked.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= KEPT)


def without_outliers(comps: DataFrame, key: str, value: str) -> DataFrame:
    """Included comparables beyond 1.5 interquartile ranges become PRICE_OUTLIER where there are five or
    more; where fewer than three are left, these become INSUFFICIENT_COMP_COUNT. At most 12 rows a key."""
    w = Window.partitionBy(key)
    ok = F.when(F.col("exclusion").isNull(), F.col(value))
    q = F.percentile(ok, F.array(F.lit(0.25), F.lit(0.75))).over(w)
    marked = comps.withColumn("_q", q).withColumn("_n", F.count(ok).over(w))
    iqr = F.col("_q")[1] - F.col("_q")[0]
    beyond = (F.col(value) < F.col("_q")[0] - 1.5 * iqr) | (F.col(value) > F.col("_q")[1] + 1.5 * iqr)
    out = marked.withColumn("exclusion", F.when(F.col("exclusion").isNull() & (F.col("_n") >= 5) & (iqr > 0) & beyond, "PRICE_OUTLIER").otherwise(F.col("exclusion")))
    left = F.count_if(F.col("exclusion").isNull()).over(w)
    out = out.withColumn("_left", left)
    return out.withColumn("exclusion", F.when(F.col("exclusion").isNull() & (F.col("_left") < LEAST_COMPS), "INSUFFICIENT_COMP_COUNT").otherwise(F.col("exclusion"))).drop("_q", "_n", "_left")


def count_points(n: Column) -> Column:
    return F.when(n >= 8, 20).when(n >= 4, 14).when(n >= 1, 8).otherwise(0)


def dispersion_points(d: Column) -> Column:
    return bands(d, [(0.03, 10), (0.08, 7), (0.15, 4)], 1, 1)


def confidence_category(score: Column) -> Column:
    return bands(score, [(39, "LOW"), (59, "LIMITED"), (74, "MODERATE"), (89, "HIGH")], "VERY_HIGH")


def adjustment_pct(target_level: Column, mean_level: Column, parking: Column, parking_share: Column) -> Column:
    """Percent by which condition and parking move the price, within -25 and +15."""
    condition = F.coalesce(F.round((target_level - mean_level) * 3, 4), F.lit(0))
    park = F.when(parking & (parking_share < 0.5), 2).when(~parking & (parking_share > 0.5), -2).otherwise(0)
    return clamp(condition + F.coalesce(park, F.lit(0)), -25, 15)


def range_width(confidence: Column, n: Column, dispersion: Column, quality: Column) -> Column:
    by_conf = F.when(confidence < 40, 0.12).when(confidence < 60, 0.08).when(confidence < 75, 0.05).otherwise(0.0)
    by_n = F.when(n < 4, 0.08).when(n < 8, 0.04).otherwise(0.0)
    return clamp(0.10 + by_conf + by_n + F.least(F.lit(0.10), dispersion) + F.when(quality < 60, 0.05).otherwise(0.0), 0.08, 0.35)


def confidence(n: Column, mean_similarity: Column, quality: Column, dispersion: Column, mean_recency: Column, coarse: Column, condition_known: Column) -> Column:
    penalty = F.when(coarse, 5).otherwise(0) + F.when(condition_known, 0).otherwise(5)
    raw = count_points(n) + 25 * mean_similarity + 0.15 * quality + dispersion_points(dispersion) + 10 * mean_recency - penalty
    return F.round(clamp(raw, 0, 100).cast("decimal(14,6)"), 2)

"""Text rules of listings as column expressions. Null in, null out, unless a function says otherwise."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

def squeeze(c: Column) -> Column:
    """White space collapsed to single spaces, dashes read as spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "-", " "), r"\s+", " "))


def first_text(*cs: Column) -> Column:
    """The first non-blank text, trimmed."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in cs))


@lru_cache(maxsize=1)
def decomposed() -> tuple[str, str, dict[str, str]]:
    """By compatibility decomposition (NFKD) of all non-ASCII code points: letters that leave one ASCII
    character, what they leave, and those that leave several."""
    one: dict[str, str] = {}
    more: dict[str, str] = {}
    for k in range(128, sys.maxunicode + 1):
        letter = chr(k)
        left = unicodedata.normalize("NFKD", letter).encode("ascii", "ignore").decode()
        if left:
            (one if len(left) == 1 else more)[letter] = left
    return "".join(one), "".join(one.values()), more


def ranges(letters: Iterable[str], gap: int = 8) -> str:
    """A pattern of a letter among these or within a small gap between two: few ranges, since a pattern tries each."""
    runs: list[list[int]] = []
    for k in sorted(map(ord, letters)):
        if runs and k <= runs[-1][1] + gap:
            runs[-1][1] = k
        else:
            runs.append([k, k])
    return f"[{''.join(f'\\x{{{a:x}}}-\\x{{{b:x}}}' for a, b in runs)}]"


def spread(low: Column) -> Column:
    """Letters that decompose into several ASCII characters (ligatures, fractions, dots) spelt out, the others
    that have a decomposition replaced; texts without any of the former are not taken apart, and ASCII ones are left."""
    singles, left, several = decomposed()
    spelt = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    letters = F.transform(F.split(low, ""), lambda x: F.when(x < "\x80", x).otherwise(F.coalesce(F.try_element_at(spelt, x), x)))
    whole = F.translate(F.when(low.rlike(ranges(several)), F.array_join(letters, "")).otherwise(low), singles, left)
    return F.when(F.length(low) == F.octet_length(low), low).otherwise(whole)


def ascii_fold(c: Column) -> Column:
    """Lower case, decomposed, without what is then not ASCII: the same as folding through NFKD."""
    return F.regexp_replace(spread(F.lower(c)), r"[^\x00-\x7F]", "")


def folded_tokens(c: Column) -> Column:
    """token_set(ascii_fold(c)) at less cost: a text is split once, and only its distinct parts are cleaned."""
    parts = F.array_distinct(F.split(F.lower(spread(F.lower(F.coalesce(c, F.lit(""))))), r"[\x00-/:-`{-\x7F]+"))
    clean = F.transform(parts, lambda x: F.regexp_replace(x, r"[^\x00-\x7F]", ""))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: F.length(x) > 1)))


def token_set(c: Column) -> Column:
    """Distinct lower-case ASCII alphanumeric tokens of two characters or more, sorted."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(x) > 1)))


def same_text(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def contains_any(c: Column, words: list[str], lowered: bool = False) -> Column:
    """Whether the lower-cased text holds any of the words; false for null. lowered: it is lower-cased
    already, which saves doing so for every word."""
    low = c if lowered else F.lower(c)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return F.coalesce(out, F.lit(False))


def parse_decimal(raw: Column, scale: int, precision: int = 14) -> Column:
    """The first number of a text. A comma is the decimal sign, then dots part thousands; without a comma,
    several dots, or one dot before exactly three digits at the end, part thousands."""
    found = F.regexp_extract(F.regexp_replace(raw, " ", ""), r"\d[\d.,]*", 0)
    number = F.regexp_replace(found, r"[.,]+$", "")
    dots = F.length(number) - F.length(F.regexp_replace(number, r"\.", ""))
    plain = (
        F.when(number.contains(","), F.regexp_replace(F.regexp_replace(number, r"\.", ""), ",", "."))
        .when((dots > 1) | number.rlike(r"^\d+\.\d{3}$"), F.regexp_replace(number, r"\.", ""))
        .otherwise(number)
    )
    return F.round(plain.try_cast("decimal(30,10)"), scale).try_cast(f"decimal({precision},{scale})")


def parse_currency(raw: Column) -> Column:
    up = F.upper(raw)
    return F.when(up.rlike("EUR|€"), "EUR").when(up.rlike("RSD|DIN"), "RSD")


def parse_floor(raw: Column) -> Column:
    """Ground-floor wording is 0, else the first whole number."""
    return F.when(F.lower(raw).contains("prizem"), 0).otherwise(F.regexp_extract(raw, r"(\d+)", 1).try_cast("int"))


def parse_total_floors(raw: Column) -> Column:
    return F.regexp_extract(raw, r"\d+\s*/\s*(\d+)", 1).try_cast("int")


def parse_seller_type(seller: Column, agency: Column) -> Column:
    """Any agency name tells an agency, else wording does."""
    text = F.lower(F.coalesce(seller, F.lit("")))
    by_text = F.when(text.rlike("agenc|nekretnine"), "AGENCY").when(text.contains("invest"), "INVESTOR").when(text.contains("vlasnik"), "OWNER")
    return F.when(F.coalesce(agency, F.lit("")) != "", "AGENCY").otherwise(F.coalesce(by_text, F.lit("UNKNOWN")))


def city_of(raw: Column) -> Column:
    return F.when(F.lower(raw).contains("beograd"), "Beograd")


def slug(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_.-]+", "_")


def canonical_url(url: Column) -> Column:
    """Without query and fragment, and without slashes at the end."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")


# Micro-location patterns in the order they are tried.
MICRO_LOCATIONS = {"bezanijska kosa": "Bezanijska kosa", "belville": "Belville", "savski kej": "Savski kej", "zemunske kapije": "Zemunske kapije", "gornji grad": "Gornji grad", "prvomajska": "Prvomajska", "altina": "Altina", "galenika": "Galenika", "retenzija": "Retenzija"}


def micro_location(text: Column, zones: dict[str, str] = MICRO_LOCATIONS) -> Column:
    """The neighbourhood: `Blok N` where the folded text names a block, else the first zone whose pattern occurs."""
    folded = ascii_fold(squeeze(text))
    block = F.regexp_extract(folded, r"\bblok\s*(\d{1,3})\b", 1)
    out = F.lit(None).cast("string")
    for pattern, name in reversed([*zones.items()]):
        out = F.when(folded.contains(pattern), name).otherwise(out)
    return F.when(block != "", F.concat(F.lit("Blok "), block)).otherwise(out)


def municipality(text: Column) -> Column:
    t = ascii_fold(squeeze(text))
    return F.when(t.rlike("novi beograd|new belgrade"), "Novi Beograd").when(t.contains("zemun"), "Zemun")


def belgrade(text: Column) -> Column:
    return F.when(ascii_fold(squeeze(text)).rlike("beograd|belgrade|zemun"), "Beograd")


def location_precision(micro: Column, municipality: Column, city: Column) -> tuple[Column, Column]:
    """Precision name and confidence of the finest known part."""
    pick = lambda a, b, c, d: F.when(micro.isNotNull(), a).when(municipality.isNotNull(), b).when(city.isNotNull(), c).otherwise(d)
    return pick("MICROZONE", "MUNICIPALITY", "CITY", "UNKNOWN"), pick(0.90, 0.55, 0.35, 0.0)


def located(*parts: Column) -> Column:
    """struct of country, city, municipality, neighborhood, micro_location, precision and confidence of the
    joined texts. Where no neighbourhood is named the micro-location is the cleaned text itself, if anything
    of it is known; without any known part there is none."""
    whole = squeeze(F.concat_ws(" ", *(first_text(p) for p in parts)))
    zone, area, city = micro_location(whole), municipality(whole), belgrade(whole)
    known = F.coalesce(zone, area, city).isNotNull()
    level, sure = location_precision(zone, area, city)
    return F.struct(
        F.when(known, "RS").alias("country"), city.alias("city"), area.alias("municipality"), zone.alias("neighborhood"),
        F.when(known, F.coalesce(zone, first_text(whole))).alias("micro_location"), level.alias("precision"), sure.alias("confidence"),
    )


def precision_rank(precision: Column) -> Column:
    names = ["UNKNOWN", "CITY", "MUNICIPALITY", "NEIGHBORHOOD", "MICROZONE"]
    return F.coalesce(*(F.when(precision == n, k) for k, n in enumerate(names)), F.lit(0))


def json_text(c: Column) -> Column:
    """A JSON string literal with all non-ASCII characters escaped, characters beyond the basic plane as pairs."""
    low = F.regexp_replace(F.regexp_replace(F.to_json(F.array(c)), r"^\[", ""), r"\]$", "")
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    code = lambda x: F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("long")

    def escaped(x: Column) -> Column:
        n = code(x)
        over = n - 0x10000
        return F.when(n < 128, x).when(n < 0x10000, unit(n)).otherwise(F.concat(unit(over.bitwiseAND(0x3FFFFF) / 1024 + 0xD800), unit(over.bitwiseAND(1023) + 0xDC00)))

    return F.when(low.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(low, ""), escaped), "")).otherwise(low)


def canonical_json(values: dict[str, Column], lists: set[str] = frozenset(), raw: dict[str, Column] | None = None, spaced: bool = False) -> Column:
    """A JSON object of texts (and, of the names in lists, arrays of texts; of raw, JSON itself) with sorted keys
    and ASCII escapes: equal values give equal text. spaced: with a space after each colon and comma."""
    comma, colon = (", ", ": ") if spaced else (",", ":")
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, json_text), comma), F.lit("]"))
    made = {n: listed(c) if n in lists else json_text(c.cast("string")) for n, c in values.items()} | (raw or {})
    pairs = [F.concat(F.lit(f'"{n}"{colon}'), F.coalesce(made[n], F.lit("null"))) for n in sorted(made)]
    return F.concat(F.lit("{"), F.concat_ws(comma, *pairs), F.lit("}"))

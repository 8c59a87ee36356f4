"""Listing pages as rows: titles, links, attributes and JSON-LD items, by native expressions.

JSON text is unescaped for the five named entities before it is parsed, or, where it does not parse so, with
quotes kept within its strings; blocks that do not parse either way are skipped. Cards are one per page and URL, the first one wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.text import canonical_url, first_text
from hearthline.operators.rows import latest_row

# Named entities.
ENTITIES = {"&quot;": '"', "&apos;": "'", "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
BLOCK = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
ITEM = "struct<position:int,url:string,name:string,item:struct<url:string,name:string>>"
NODE = f"struct<`@type`:string,itemListElement:array<{ITEM}>,`@graph`:array<struct<`@type`:string,itemListElement:array<{ITEM}>>>>"


def unescape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e), F.lit(ENTITIES[e])), ENTITIES, c)


def title(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)", 1)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def attributes(tag: Column) -> Column:
    """Attributes of a tag as a map; the last of equal names wins."""
    pairs = F.regexp_extract_all(tag, F.lit(r'([\w-]+="[^"]*")'), F.lit(1))
    entry = lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)), unescape(F.regexp_extract(p, '="(.*)"$', 1)))
    return F.map_from_entries(F.transform(pairs, entry))


def plain_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(html, r"(?s)<[^>]+>", " ")), r"\s+", " "))


def next_page(url: Column, html: Column, parameter: str = "strana") -> Column:
    """The least page number above the current one among links with the same path; null if none."""
    number = lambda u: F.coalesce(F.regexp_extract(u, rf"[?&]{parameter}=(\d+)", 1).try_cast("int"), F.lit(1))
    same = F.filter(links(html), lambda u: canonical_url(u) == canonical_url(url))
    return F.array_min(F.filter(F.transform(same, number), lambda n: n > number(url)))


def jsonld(pages: DataFrame, key: str) -> DataFrame:
    """(key, node): top-level JSON-LD objects and members of their graphs."""
    blocks = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(BLOCK), F.lit(1))).alias("block", "raw"))
    top = blocks.select(key, "block", F.from_json("raw", NODE.removeprefix("struct<").removesuffix(">").replace("`@type`:string", "`@type` string").replace("itemListElement:array", "itemListElement array", 1).replace("`@graph`:array", "`@graph` array")).alias("top"))
    inner = F.struct(F.col("top.@type").alias("@type"), F.col("top.itemListElement").alias("itemListElement"))
    nodes = F.concat(F.array(inner), F.coalesce("top.@graph", F.array().cast(f"array<struct<`@type`:string,itemListElement:array<{ITEM}>>>")))
    return top.select(key, "block", F.posexplode(nodes).alias("at", "node")).filter(F.col("node.@type").isNotNull())


def search_cards(pages: DataFrame, key: str) -> DataFrame:
    """(key, position, url, name) of ItemList entries, one per url."""
    lists = jsonld(pages, key).filter(F.col("node.@type") == "ItemList")
    items = lists.select(key, "block", F.posexplode("node.itemListElement").alias("at", "i"))
    cards = items.select(key, "block", "at", F.col("i.position").alias("position"), canonical_url(F.coalesce("i.url", "i.item.url")).alias("url"), unescape(F.coalesce("i.name", "i.item.name")).alias("name"))
    return latest_row(cards.filter("url is not null"), [key, "url"], [F.asc("block"), F.asc("at")]).select(key, "position", "url", "name")


#: A seller is the item whose id ends so, else the first of this type.
SELLER_ID, SELLER_TYPE = "#seller", "RealEstateAgent"


def items(html: Column) -> Column:
    """All JSON-LD objects of a page as variants: members of graphs, of top-level lists, and single ones;
    blocks that do not parse are skipped."""
    # A block that is escaped as a whole parses unescaped; in one whose strings alone are, an unescaped quote would end a string.
    quoted = lambda b: F.replace(b, F.lit("&quot;"), F.lit('\\"'))
    parsed = lambda b: F.coalesce(F.try_parse_json(unescape(F.trim(b))), F.try_parse_json(unescape(quoted(F.trim(b)))))
    raw = F.transform(F.regexp_extract_all(html, F.lit(BLOCK), F.lit(1)), parsed)
    spread = lambda v: F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    return F.filter(F.flatten(F.transform(F.filter(raw, lambda v: v.isNotNull()), spread)), lambda v: F.schema_of_variant(v).startswith("OBJECT"))


def has_type(item: Column, name: str) -> Column:
    """@type is a string or a list of strings."""
    kinds = F.try_variant_get(item, "$['@type']", "array<string>")
    return F.coalesce(F.try_variant_get(item, "$['@type']", "string") == name, F.lit(False)) | F.coalesce(F.array_contains(kinds, name), F.lit(False))


def first_typed(all_items: Column, name: str) -> Column:
    return F.get(F.filter(all_items, lambda v: has_type(v, name)), 0)


def seller_of(all_items: Column) -> Column:
    named = F.get(F.filter(all_items, lambda v: F.coalesce(F.try_variant_get(v, "$['@id']", "string").endswith(SELLER_ID), F.lit(False))), 0)
    return F.coalesce(named, first_typed(all_items, SELLER_TYPE))


def text_at(item: Column, *path: str) -> Column:
    """The trimmed text at a path, null where it is blank."""
    return first_text(F.try_variant_get(item, "$" + "".join(f"['{p}']" for p in path), "string"))


def image_urls(value: Column) -> Column:
    """Urls of an image or a list of them, each a string or an object with url or contentUrl."""
    each = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.when(value.isNotNull(), F.array(value)), F.array().cast("array<variant>"))
    url = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.coalesce(text_at(v, "url"), text_at(v, "contentUrl")))
    return F.array_compact(F.transform(each, url))


def meta(html: Column) -> Column:
    """Content of meta tags by name or property, in single or double quotes; the last of equal names wins."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1))
    part = lambda t, names: F.regexp_extract(t, rf"""(?is)\b(?:{names})\s*=\s*(["'])(.*?)\1""", 2)
    told = F.filter(F.transform(tags, lambda t: F.struct(unescape(part(t, "name|property")).alias("k"), unescape(part(t, "content")).alias("v"))), lambda x: x["k"] != "")
    # map_from_entries takes no name twice: the last entry of each name stays.
    last = F.filter(F.transform(told, lambda x, i: F.struct(x["k"].alias("k"), x["v"].alias("v"), (~F.exists(F.slice(told, i + 2, F.size(told)), lambda y: y["k"] == x["k"])).alias("last"))), lambda x: x["last"])
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))


def details(pages: DataFrame, key: str, external_id: str = r"(?i)/([0-9a-f]{24})$") -> DataFrame:
    """A detail record of each page (key, url, html) from its JSON-LD, title and description failing that from
    its meta tags; pages whose url tells no external id are left out."""
    c = F.col
    made = pages.withColumns({"all": items(c("html")), "meta": meta(c("html"))}).withColumns(
        {"listing": first_typed(c("all"), "RealEstateListing"), "offer": first_typed(c("all"), "Offer"), "flat": first_typed(c("all"), "Apartment"), "place": first_typed(c("all"), "Place"), "seller": seller_of(c("all"))}
    )
    at = canonical_url(F.coalesce(text_at(c("listing"), "url"), text_at(c("offer"), "url"), c("url")))
    named = lambda n: F.try_element_at(c("meta"), F.lit(n))
    description = first_text(text_at(c("listing"), "description"), text_at(c("flat"), "description"), named("description"), named("og:description"))
    address = F.coalesce(*(F.when(F.try_variant_get(c(x), "$['address']", "variant").isNotNull(), F.try_variant_get(c(x), "$['address']", "variant")) for x in ("place", "flat")))
    parts = F.concat_ws(", ", *(text_at(address, p) for p in ("streetAddress", "addressLocality", "addressRegion", "addressCountry")))
    size = F.coalesce(text_at(c("flat"), "area", "value"), text_at(c("flat"), "floorSize", "value"))
    seller = text_at(c("seller"), "name")
    floor = F.regexp_extract(c("description"), r"(?i)(?:na\s+)?(?:\d+\.?\s*spratu|prizemlju|prizemlje)", 0)
    out = made.withColumns({"canonical": at, "description": description})
    return out.select(
        key, F.regexp_extract("canonical", external_id, 1).alias("external_id"), c("canonical").alias("url"),
        first_text(text_at(c("listing"), "name"), text_at(c("flat"), "name"), named("og:title"), named("title")).alias("title_raw"), c("description").alias("description_raw"),
        text_at(c("offer"), "price").alias("price_raw"), text_at(c("offer"), "priceCurrency").alias("currency_raw"), size.alias("size_raw"), first_text(parts).alias("location_raw"),
        text_at(c("flat"), "numberOfRooms").alias("rooms_raw"), first_text(floor).alias("floor_raw"), seller.alias("seller_raw"), F.when(has_type(c("seller"), "Organization"), seller).alias("agency_raw"),
        image_urls(F.try_variant_get(c("flat"), "$['image']", "variant")).alias("image_urls"), F.coalesce(text_at(c("listing"), "datePosted"), text_at(c("listing"), "datePublished")).alias("published_raw"),
    ).filter("external_id <> ''")


def first_tag(html: Column, name: str) -> Column:
    """The attribute text of a page's first such tag."""
    return F.regexp_extract(html, rf"(?is)<{name}\b([^>]*)>", 1)


def any_attributes(tag: Column) -> Column:
    """Attributes in single or double quotes, trimmed; the last of equal names wins."""
    pairs = F.regexp_extract_all(tag, F.lit(r"""(?s)([a-zA-Z_:][-a-zA-Z0-9_:.]*\s*=\s*(?:"[^"]*"|'[^']*'))"""), F.lit(1))
    entry = lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))).alias("k"), F.trim(unescape(F.regexp_extract(p, r"""(?s)=\s*["'](.*)["']$""", 1))).alias("v"))
    told = F.transform(pairs, entry)
    last = F.filter(F.transform(told, lambda x, i: F.struct(x["k"].alias("k"), x["v"].alias("v"), (~F.exists(F.slice(told, i + 2, F.size(told) + 1), lambda y: y["k"] == x["k"])).alias("last"))), lambda x: x["last"])
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))


def article_cards(pages: DataFrame, key: str) -> DataFrame:
    """(key, external_id, url and raw fields) of <article data-*> cards, one per external id. The url is the
    card's own, else its first link's, else made from the id."""
    c = F.col
    each = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)(<article\b[^>]*>.*?</article>)"), F.lit(1))).alias("at", "card"))
    told = each.withColumn("attrs", any_attributes(first_tag(c("card"), "article"))).withColumn("link", F.try_element_at(any_attributes(first_tag(c("card"), "a")), F.lit("href")))
    at = lambda n: first_text(F.try_element_at(c("attrs"), F.lit(n)))
    ident = at("data-listing-id")
    url = F.coalesce(at("data-url"), c("link"), F.concat(F.lit("/oglas/"), ident))
    found = F.coalesce(ident, F.nullif(F.regexp_extract(url, r"(?i)\b(NKRS-\d+)", 1), F.lit("")))
    raw = {f"{n}_raw": at(f"data-{n}") for n in ("title", "price", "location", "size", "rooms", "floor")} | {"currency_raw": F.coalesce(at("data-currency"), at("data-price")), "published_raw": at("data-published-at")}
    cards = told.select(key, "at", F.upper(found).alias("external_id"), canonical_url(url).alias("url"), *(x.alias(n) for n, x in raw.items())).filter("external_id is not null")
    return latest_row(cards, [key, "external_id"], [F.asc("at")]).drop("at")


def plain_details(pages: DataFrame, key: str) -> DataFrame:
    """Detail records of pages (key, url, html) without JSON-LD: from the attributes of <main> and meta tags."""
    c = F.col
    told = pages.withColumns({"attrs": any_attributes(first_tag(c("html"), "main")), "meta": meta(c("html"))})
    at = lambda n: first_text(F.try_element_at(c("attrs"), F.lit(n)))
    named = lambda n: first_text(F.try_element_at(c("meta"), F.lit(n)))
    url = canonical_url(F.coalesce(named("og:url"), named("canonical"), at("data-url"), c("url")))
    ident = F.coalesce(at("data-listing-id"), F.nullif(F.regexp_extract(url, r"(?i)\b(NKRS-\d+)", 1), F.lit("")))
    images = F.filter(F.transform(F.regexp_extract_all("html", F.lit(r"(?is)(<img\b[^>]*>)"), F.lit(1)), lambda t: F.try_element_at(any_attributes(t), F.lit("src"))), lambda u: u.isNotNull())
    raw = {f"{n}_raw": at(f"data-{n}") for n in ("price", "size", "location", "rooms", "floor", "seller", "agency")}
    return told.select(
        key, F.upper(ident).alias("external_id"), url.alias("url"), F.coalesce(at("data-title"), named("og:title"), named("title")).alias("title_raw"),
        F.coalesce(at("data-description"), named("description")).alias("description_raw"), F.coalesce(at("data-currency"), at("data-price")).alias("currency_raw"), *(x.alias(n) for n, x in raw.items()),
        images.alias("image_urls"), at("data-published-at").alias("published_raw"),
    ).filter("external_id is not null")

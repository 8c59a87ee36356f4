"""Landed search pages as a Spark data source, for batch and for streams: spark.read.format("listing_pages").

Pages lie as <path>/<market>/<page>.html, page numbers from 1; any file system that pyarrow knows will do. A market is one
partition: its pages are followed from the first along their next-page links (the least number above the current one
under ?strana=, or rel=next), until there is no next page, a page is not there, `max_pages` are read, or
`known_stop` cards in a row are known already (`known`: a text file of ids, one a line). A link back to a page already read
ends it too. Cards are the entries of JSON-LD item lists; a page that does not parse has none.

Rows are (market, page, position, external_id, url, name, complete). complete is null on cards; the last row of a market has
no card and says whether all its pages were read, or are known, so that a missing page is never read as an empty one.

The stream takes one step for every market: it goes on where it stopped, at pages that have landed since, so that
both give the same cards, but for ids that a later page repeats (first_cards() settles these). Its offsets are the next
page of each market; pages do not change once landed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "market string, page int, position int, external_id string, url string, name string, complete boolean"
BLOCK = re.compile(r'<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', re.I | re.S)
PAGE_NUMBER = re.compile(r"[?&]strana=(\d+)")
HREF = re.compile(r'href="([^"]*)"')
REL_NEXT = re.compile(r'<(?:a|link)[^>]*rel="next"[^>]*href="([^"]*)"', re.I)
ENTITIES = (("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def unescaped(text: str) -> str:
    for entity, letter in ENTITIES:
        text = text.replace(entity, letter)
    return text


def external_id(url: str) -> str | None:
    """24 hexadecimal digits at the end of the path, or an NKRS number."""
    found = re.search(r"([0-9a-f]{24})/?$", url.split("?")[0].split("#")[0].rstrip("/")) or re.search(r"(NKRS-\d+)", url, re.I)
    return found[1].upper() if found and found[1].upper().startswith("NKRS") else found and found[1]


def cards_of(html: str) -> list[tuple]:
    """(position, external_id, url, name) of a page's item lists; the first of equal ids stays."""
    found: dict[str, tuple] = {}
    for raw in BLOCK.findall(html):
        try:
            top = json.loads(unescaped(raw.strip()))
        except ValueError:
            continue
        for node in top if isinstance(top, list) else top.get("@graph", [top]) if isinstance(top, dict) else []:
            if not isinstance(node, dict) or "ItemList" not in (kind if isinstance(kind := node.get("@type"), list) else [kind]):
                continue
            for entry in node.get("itemListElement") or []:
                inner = entry.get("item") if isinstance(entry.get("item"), dict) else {}
                url, name = entry.get("url") or inner.get("url"), entry.get("name") or inner.get("name")
                if url and (ident := external_id(url)) and ident not in found:
                    found[ident] = (entry.get("position"), ident, url.split("?")[0].split("#")[0].rstrip("/"), name)
    return list(found.values())


def next_number(html: str, page: int) -> int | None:
    later = [n for u in HREF.findall(html) if (m := PAGE_NUMBER.search(unescaped(u))) and (n := int(m[1])) > page]
    if later:
        return min(later)
    linked = REL_NEXT.search(html)
    number = linked and PAGE_NUMBER.search(unescaped(linked[1]))
    return int(number[1]) if number else None


class Market(InputPartition):
    def __init__(self, name: str, page: int = 1, last: int | None = None):
        self.name, self.page, self.last = name, page, last


class Pages:
    """What both readers share: the options, and one market's walk over its pages."""

    def __init__(self, options: dict):
        self.path, self.max_pages = options["path"], int(options.get("max_pages", 1000))
        self.known_stop, self.known_at = int(options.get("known_stop", 0)), options.get("known")

    def at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def markets(self) -> list[str]:
        files, root = self.at()
        return sorted(i.base_name for i in files.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory)

    def page(self, market: str, number: int) -> str | None:
        files, root = self.at()
        name = f"{root}/{market}/{number}.html"
        if files.get_file_info(name).type != fs.FileType.File:
            return None
        with files.open_input_stream(name) as f:
            return f.read().decode(errors="replace")

    def known(self) -> set[str]:
        if not self.known_at or not self.known_stop:
            return set()
        files, name = fs.FileSystem.from_uri(self.known_at) if "://" in self.known_at else (fs.LocalFileSystem(), self.known_at)
        with files.open_input_stream(name) as f:
            return set(f.read().decode().split())

    def walk(self, start: Market) -> Iterator[tuple[int, int | None, list[tuple], bool | None]]:
        """(page, next page, rows, whether the market is complete here) of each page from start on."""
        known, row, number, seen, read = self.known(), 0, start.page, set(), 0
        while number is not None and (start.last is None or number < start.last):
            html = self.page(start.name, number) if read < self.max_pages else None
            if html is None:
                yield number, number, [], False
                return
            read += 1
            seen.add(number)
            cards, follow, boundary = [], next_number(html, number), False
            for card in cards_of(html):
                row = row + 1 if card[1] in known else 0
                cards.append((start.name, number, *card, None))
                if self.known_stop and row >= self.known_stop:
                    boundary = True
                    break
            follow = None if boundary or follow in seen else follow
            yield number, follow, cards, True if follow is None else None
            number = follow


class PageReader(DataSourceReader, Pages):
    def partitions(self) -> list[Market]:
        return [Market(m) for m in self.markets()] or [Market("")]

    def read(self, partition: Market) -> Iterator[tuple]:
        seen, complete = set(), None
        for page, _, cards, state in self.walk(partition) if partition.name else ():
            for card in cards:
                if card[3] not in seen:
                    seen.add(card[3])
                    yield card
            complete = state
        if partition.name:
            yield (partition.name, None, None, None, None, None, bool(complete))


class PageStream(SimpleDataSourceStreamReader, Pages):
    """Offsets are {market: next page}; 0 for a market that is complete."""

    def initialOffset(self) -> dict:
        return {}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end, rows = dict(start), []
        for market in self.markets():
            if start.get(market) == 0:
                continue
            for page, follow, cards, state in self.walk(Market(market, start.get(market, 1))):
                rows += cards
                end[market] = 0 if state else page if follow is None else follow
                if state:
                    rows.append((market, None, None, None, None, None, True))
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for market, last in sorted(end.items()):
            first = start.get(market, 1)
            if first == 0 or first == last:
                continue
            for _, _, cards, state in self.walk(Market(market, first, last or None)):
                yield from cards
                if state and last == 0:
                    yield (market, None, None, None, None, None, True)

    def commit(self, end: dict) -> None:
        pass


class ListingPages(DataSource):
    """Options: path; max_pages (1000 a market and run), known_stop (0: read on), known (a file of ids)."""

    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def simpleStreamReader(self, schema) -> PageStream:
        return PageStream(self.options)


def register(spark) -> None:
    spark.dataSource.register(ListingPages)

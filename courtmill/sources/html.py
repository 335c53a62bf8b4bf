"""One pass over a page's markup into a generic structure; per-site rules are Column expressions on it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtmill.schemas import EXTRACT

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset("script style noscript template".split())
#: Letters a label has at most.
_LABEL_CHARS = 60
#: Letters a bare block has at least to count as prose.
_PROSE_CHARS = 80
#: Fixed value: part of a class whose element ends a section's prose.
_ENDS_PROSE = "good-bad"
_BLOCK = frozenset("p div li td th tr table ul ol h1 h2 h3 h4 h5 h6 article section main header footer nav aside br".split())


def _clean(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", "".join(parts)).strip()


class _Heading:
    """A heading with what follows it.

    ``body`` are the paragraphs and ``prose`` these and bare blocks up to the next heading of level 1 to 3;
    ``section`` are the paragraphs up to the next heading of its own level or above.
    """

    def __init__(self, level: int, text: str):
        self.level, self.text = level, text
        self.body: list[str] = []
        self.items: list[str] = []
        self.prose: list[str] = []
        self.section: list[str] = []
        self.ended = False


class _Inside:
    """What an open element has shown so far: its last label with the blocks after it, its first span."""

    def __init__(self) -> None:
        self.block = False
        self.last_block: str | None = None
        self.span: str | None = None
        self.labels: list[dict] = []
        self.open: dict | None = None


class _Page(HTMLParser):
    """Collects title, headings with what follows them, links, tables, cards, labelled blocks, JSON-LD and images."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict[str, str], list[str]]] = []
        self.text: list[str] = []
        self.title = self.h1 = self.og_image = ""
        self.json_ld: list[str] = []
        self.links: list[tuple[str, str, str]] = []
        self.headings: list[_Heading] = []
        self.table_heads: list[str | None] = []
        self.labelled: list[dict] = []
        self.inside: list[_Inside] = [_Inside()]
        self.tables: list[list[list[str]]] = []
        self.facts: dict[str, str] = {}
        self.images: list[str] = []
        self.cards: list[tuple[str, str, list[str]]] = []
        self.card: list | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {k: v or "" for k, v in attrs}
        if tag in _BLOCK:
            self.handle_data(" ")
        if tag == "meta" and own.get("property") == "og:image":
            self.og_image = self.og_image or own.get("content", "")
        elif tag == "img" and own.get("src"):
            self.images.append(own["src"])
        elif tag == "table":
            self._table()
        elif tag == "tr":
            if not self.tables:
                self._table()
            self.tables[-1].append([])
        elif tag == "article":
            self.card = [None, own.get("class", "").split()]
        if _ENDS_PROSE in own.get("class", "") and self.headings:
            self.headings[-1].ended = True
        if tag not in _VOID:
            self.stack.append((tag, own, []))
            self.inside.append(_Inside())

    def _table(self) -> None:
        self.tables.append([])
        self.table_heads.append(next((h.text for h in reversed(self.headings) if h.level in (2, 3)), None))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self.stack):
            return
        while self.stack:
            name = self.close_last()
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        if any(t in _HIDDEN for t, _, _ in self.stack):
            if self.stack[-1][0] == "script":
                self.stack[-1][2].append(data)
            return
        for _, _, parts in self.stack:
            parts.append(data)
        if not any(t in ("head", "title") for t, _, _ in self.stack):
            self.text.append(data)

    def close_last(self) -> str:
        tag, own, parts = self.stack.pop()
        mine = self.inside.pop()
        text = _clean(parts)
        self._closed(tag, own, parts, text)
        self._labels(tag, own, text, mine)
        return tag

    def _labels(self, tag: str, own: dict[str, str], text: str, mine: _Inside) -> None:
        """A short element without inner blocks labels the blocks that follow it in the same element."""
        for label in mine.labels:
            label["mark"] = mine.span
        self.labelled += [label for label in mine.labels if label["values"]]
        outer = self.inside[-1]
        outer.span = outer.span or (text if tag == "span" else mine.span)
        if tag == "div":
            outer.block = True
            outer.last_block = mine.last_block if mine.last_block is not None else text
            if outer.open is not None and text:
                outer.open["values"].append(text)
                outer.open["lasts"].append(mine.last_block)
            if not mine.block and "class" not in own and len(text) > _PROSE_CHARS and self.headings and not self.headings[-1].ended:
                self._near()[-1].prose.append(text)
        if not mine.block and 0 < len(text) <= _LABEL_CHARS and tag in ("div", "p", "h2", "h3", "h4", "span", "strong", "b"):
            outer.open = {"label": text, "mark": None, "values": [], "lasts": []}
            outer.labels.append(outer.open)

    def _near(self) -> list[_Heading]:
        """The last heading, and the last one of level 1 to 3 if another."""
        last = self.headings[-1]
        main = next((h for h in reversed(self.headings) if h.level <= 3), last)
        return [last] if main is last else [last, main]

    def _closed(self, tag: str, own: dict[str, str], parts: list[str], text: str) -> None:
        if tag == "script" and own.get("type") == "application/ld+json":
            self.json_ld.append("".join(parts).strip())
        elif tag == "title":
            self.title = self.title or text
        elif re.fullmatch(r"h[1-6]", tag):
            if tag == "h1" and not self.h1:
                self.h1 = text
            self.headings.append(_Heading(int(tag[1]), text))
        elif tag == "a" and "href" in own:
            self.links.append((own["href"], text, "/".join(t for t, _, _ in self.stack)))
            inside = [t for t, _, _ in self.stack]
            if self.card is not None and self.card[0] is None and any(h in inside for h in ("h2", "h3")):
                self.card[0] = (own["href"], text)
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.tables[-1][-1].append(text)
        elif tag == "tr" and self.tables and self.tables[-1] and len(self.tables[-1][-1]) >= 2:
            self.facts[self.tables[-1][-1][0].lower()] = self.tables[-1][-1][1]
        elif tag == "p" and self.headings and text:
            for heading in self._near():
                heading.body.append(text)
                if not heading.ended:
                    heading.prose.append(text)
            level = 7
            for heading in reversed(self.headings):
                if heading.level < level:
                    heading.section.append(text)
                    level = heading.level
                if level == 1:
                    break
        elif tag == "li" and self.headings and text:
            self.headings[-1].items.append(text)
        elif tag == "article" and self.card is not None:
            if self.card[0]:
                self.cards.append((*self.card[0], self.card[1]))
            self.card = None


def extract(markup: str) -> dict:
    """The generic structure of one page."""
    page = _Page()
    page.feed(markup)
    page.close()
    while page.stack:
        page.close_last()
    page.labelled += [label for label in page.inside[0].labels if label["values"]]
    return {
        "h1": page.h1 or None,
        "title": page.title or None,
        "og_image": page.og_image or None,
        "text": _clean(page.text),
        "json_ld": page.json_ld,
        "links": [{"href": h, "text": t, "path": p} for h, t, p in page.links],
        "headings": [{"level": h.level, "text": h.text, "body": h.body, "items": h.items, "prose": h.prose, "section": h.section} for h in page.headings],
        "tables": page.tables,
        "table_heads": page.table_heads,
        "labelled": page.labelled,
        "facts": page.facts,
        "images": page.images,
        "listed": [{"href": h, "text": t, "classes": c} for h, t, c in page.cards],
    }


def extracted(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "source", "url", "fetched_at"), text: str = "text") -> DataFrame:
    """The keys, ``page`` (the structure) and ``error``; a page that can't be parsed has an error, not a failed job."""
    ids = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found, errors = [], []
            for markup in frame["markup"]:
                try:
                    found.append(extract(markup) if isinstance(markup, str) else None)
                    errors.append(None)
                except Exception as error:  # one bad page must not end the batch
                    found.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            out = frame.drop(columns="markup")
            out["page"], out["error"] = pd.Series(found, dtype=object, index=out.index), pd.Series(errors, dtype=object, index=out.index)
            yield out

    rows = pages.select(*keys, F.col(text).alias("markup"))
    return rows.mapInPandas(run, f"{ids}, page {EXTRACT}, error string")

"""HTML cells and links of saved board pages: one small helper per page inside an Arrow UDF."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style"))


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None") -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def find_all(self, tag: str) -> Iterator["Node"]:
        for child in self.children:
            if isinstance(child, Node):
                if child.tag == tag:
                    yield child
                yield from child.find_all(tag)

    def find(self, tag: str, has: str | None = None) -> "Node | None":
        return next((n for n in self.find_all(tag) if has is None or has in n.attrs), None)

    def direct(self, tag: str) -> list["Node"]:
        return [c for c in self.children if isinstance(c, Node) and c.tag == tag]

    def strings(self) -> Iterator[str]:
        for child in self.children:
            if isinstance(child, str):
                if child.strip():
                    yield child.strip()
            elif child.tag not in HIDDEN:
                yield from child.strings()

    def text(self, sep: str = "") -> str:
        return sep.join(self.strings())

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


# An opening tag that ends an open one of the same level.
CLOSES = {"tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "li": ("li",), "p": ("p",)}
FENCE = frozenset(("table", "body", "html"))


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        closes = CLOSES.get(tag, ())
        node = self.at
        last = None
        while closes and node.parent is not None and node.tag not in FENCE:
            if node.tag in closes:
                last = node
            node = node.parent
        if last is not None:
            self.at = last.parent
        child = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(child)
        if tag not in VOID:
            self.at = child

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _struct(texts: str, **others: T.DataType) -> T.StructType:
    """String fields by name, then the fields of other types."""
    fields = [(name, T.StringType()) for name in texts.split()] + list(others.items())
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


LIST_CELLS = T.ArrayType(_struct("number category title href author views date", is_reply=T.BooleanType(),
                                 cells=T.IntegerType(), has_link=T.BooleanType()))


@F.pandas_udf(LIST_CELLS)
def list_cells(pages: pd.Series) -> pd.Series:
    """Raw cells of every row of the first table; the checks on them are column expressions."""

    def rows(html):
        table = parse(html).find("table")
        out = []
        for tr in table.find_all("tr") if table else ():
            td = list(tr.find_all("td"))
            if not td:
                continue
            cell = [c.text() for c in td] + [""] * 7
            link = td[2].find("a") if len(td) > 2 else None
            icons = td[2].find_all("img") if len(td) > 2 else ()
            out.append({
                "number": cell[0], "category": cell[1], "title": link.text() if link else None,
                "href": link.attrs.get("href", "") if link else None,
                "is_reply": any("bl_reply" in i.attrs.get("src", "") for i in icons),
                "author": cell[3], "views": cell[5], "date": cell[6],
                "cells": len(td), "has_link": link is not None,
            })
        return out

    return pages.map(rows)


DETAIL = _struct("title author date views body", rows=T.IntegerType(), attachments=T.ArrayType(T.StringType()))


@F.pandas_udf(DETAIL)
def detail_fields(pages: pd.Series) -> pd.DataFrame:
    """Raw fields of a detail page; ``rows`` is NULL when the page has no detail table."""

    def fields(html):
        table = next((t for t in parse(html).find_all("table") if t.has_class("tblDef")), None)
        if table is None:
            return (None,) * 7
        tr = list(table.find_all("tr"))
        meta = [td.text() for td in tr[1].direct("td")] if len(tr) > 1 else []
        meta += [""] * (3 - len(meta))
        body = next((td for r in tr for td in r.find_all("td") if td.has_class("con")), None)
        files = []
        for r in tr:
            head = next((h for h in r.find_all("th") if h.has_class("th")), None)
            if head is not None and "첨부" in head.text():
                cell = r.find("td")
                link = cell.find("a") if cell else None
                if link is not None and link.attrs.get("href"):
                    files.append(link.attrs["href"])
        return (tr[0].text() if tr else "", meta[0], meta[1], meta[2], body.text("\n") if body else "", len(tr), files)

    columns = DETAIL.fieldNames()
    out = pd.DataFrame([fields(h) for h in pages], columns=columns)
    out["rows"] = out["rows"].astype("Int32")
    return out


FILE_LINKS = T.ArrayType(_struct("title href date link alt"))


@F.pandas_udf(FILE_LINKS)
def file_links(pages: pd.Series) -> pd.Series:
    """One entry per download link of a file board: title link, date cell, link and icon text."""

    def links(html):
        out = []
        for tr in parse(html).find_all("tr"):
            td = list(tr.find_all("td"))
            if len(td) < 5:
                continue
            title = td[1].find("a", has="href")
            if title is None:
                continue
            for a in td[2].find_all("a"):
                if "func/download.php" in a.attrs.get("href", ""):
                    icon = a.find("img", has="src")
                    out.append({"title": title.text(" "), "href": title.attrs["href"].strip(),
                                "date": td[-1].text(" "), "link": a.attrs["href"],
                                "alt": icon.attrs.get("alt", "") if icon is not None else ""})
        return out

    return pages.map(links)


PAGE_PARTS = _struct("title text", links=T.ArrayType(_struct("href label")))


@F.pandas_udf(PAGE_PARTS)
def page_parts(pages: pd.Series) -> pd.DataFrame:
    """Title, visible text (one string per line) and links of any page."""

    def parts(html):
        root = parse(html)
        title = root.find("title")
        return (title.text() if title is not None else "", root.text("\n"),
                [{"href": a.attrs.get("href", ""), "label": a.text()} for a in root.find_all("a")])

    return pd.DataFrame([parts(h) for h in pages], columns=["title", "text", "links"])

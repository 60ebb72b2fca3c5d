"""Content items of office files: word, sheet and slide documents, books, and plain XML. All are XML, most of them in a zip archive.

An item is (type, level, text, html) as everywhere. Unreadable files raise; the caller turns that into a warning.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html import escape
from xml.etree import ElementTree

Item = tuple[str, int | None, str, str]


def local(tag: str) -> str:
    """A tag without its namespace."""
    return tag.rsplit("}", 1)[-1]


def attribute(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if local(k) == name), None)


def below(node: ElementTree.Element, *names: str) -> Iterator[ElementTree.Element]:
    return (x for x in node.iter() if local(x.tag) in names)


def said(node: ElementTree.Element) -> str:
    """The text of a node's runs, white space collapsed."""
    parts = [x.text or "" if local(x.tag) == "t" else " " for x in below(node, "t", "tab", "br")]
    return re.sub(r"\s+", " ", "".join(parts)).strip()


def table(rows: list[list[str]]) -> Item:
    cells = ("<tr>" + "".join(f"<td>{escape(c, quote=False)}</td>" for c in r) + "</tr>" for r in rows)
    return "table", None, "", f"<table>{''.join(cells)}</table>"


def opened(data: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data))


def numbered(names: list[str], pattern: str) -> list[str]:
    """Names that match, by their number."""
    return sorted((n for n in names if re.fullmatch(pattern, n)), key=lambda n: int(re.search(r"(\d+)\D*$", n)[1]))


def word_items(data: bytes) -> list[Item]:
    """Paragraphs in order; heading styles give titles, numbered paragraphs lists, and what a cell holds stays in its table."""
    with opened(data) as z:
        body = next(below(ElementTree.fromstring(z.read("word/document.xml")), "body"))
    out: list[Item] = []
    for node in body:
        if local(node.tag) == "tbl":
            out.append(table([[said(c) for c in r if local(c.tag) == "tc"] for r in node if local(r.tag) == "tr"]))
        elif local(node.tag) == "p" and (text := said(node)):
            style = next((attribute(x, "val") or "" for x in below(node, "pStyle")), "")
            if m := re.match(r"(?:Heading|Title|标题)\s*(\d*)", style, re.I):
                out.append(("title", int(m[1] or 1), text, ""))
            else:
                out.append(("list" if next(below(node, "numPr"), None) is not None else "paragraph", None, text, ""))
    return out


def sheet_items(data: bytes) -> list[Item]:
    """A title for each sheet, and its rows as a table."""
    with opened(data) as z:
        names = z.namelist()
        shared = [said(x) for x in below(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
        titles = [attribute(x, "name") or "" for x in below(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet")]
        sheets = [ElementTree.fromstring(z.read(n)) for n in numbered(names, r"xl/worksheets/sheet\d+\.xml")]
    out: list[Item] = []
    for k, sheet in enumerate(sheets):
        rows = []
        for r in below(sheet, "row"):
            cells = []
            for c in below(r, "c"):
                value = next((x.text or "" for x in below(c, "v")), "")
                cells.append(shared[int(value)] if attribute(c, "t") == "s" and value else value or said(c))
            rows.append(cells)
        out.append(("title", 1, titles[k] if k < len(titles) else f"Sheet {k + 1}", ""))
        if any(any(r) for r in rows):
            out.append(table(rows))
    return out


def slide_items(data: bytes) -> list[Item]:
    """A slide's title placeholder is a title, its other paragraphs are paragraphs, its tables tables."""
    out: list[Item] = []
    with opened(data) as z:
        for name in numbered(z.namelist(), r"ppt/slides/slide\d+\.xml"):
            for shape in below(ElementTree.fromstring(z.read(name)), "sp", "tbl"):
                if local(shape.tag) == "tbl":
                    out.append(table([[said(c) for c in below(r, "tc")] for r in below(shape, "tr")]))
                    continue
                head = any((attribute(x, "type") or "").lower() in ("title", "ctrtitle") for x in below(shape, "ph"))
                texts = [t for t in map(said, below(shape, "p")) if t]
                out += [("title", 1, " ".join(texts), "")] if head and texts else [("paragraph", None, t, "") for t in texts]
    return out


def book_items(data: bytes) -> list[Item]:
    """The pages of a book in the order of its spine."""
    from docloom.sources.readers import html_items

    with opened(data) as z:
        package = attribute(next(below(ElementTree.fromstring(z.read("META-INF/container.xml")), "rootfile")), "full-path")
        root = ElementTree.fromstring(z.read(package))
        files = {attribute(x, "id"): attribute(x, "href") for x in below(root, "item")}
        order = [files[attribute(x, "idref")] for x in below(root, "itemref")]
        pages = [z.read(posixpath.normpath(posixpath.join(posixpath.dirname(package), f))) for f in order]
    return [item for p in pages for item in html_items(p.decode("utf-8", "replace"))]


def xml_items(data: bytes) -> list[Item]:
    """Plain XML: a text for each leaf; leaves named title or head are titles, key-value leaves (an attribute ``key``) ``key: value``."""
    out: list[Item] = []
    for node in ElementTree.fromstring(data).iter():
        text = re.sub(r"\s+", " ", node.text or "").strip()
        if not text or len(node):
            continue
        key = attribute(node, "key")
        kind = "title" if local(node.tag).lower() in ("title", "head", "heading") else "paragraph"
        out.append((kind, 1 if kind == "title" else None, f"{key}: {text}" if key else text, ""))
    return out


PARSERS = {".docx": word_items, ".xlsx": sheet_items, ".pptx": slide_items, ".epub": book_items, ".xml": xml_items}

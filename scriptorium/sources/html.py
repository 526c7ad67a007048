"""HTML pages to sections of text, with the standard library's parser, in ``mapInPandas``."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Elements whose contents are page furniture.
CHROME_TAGS = {"script", "style", "nav", "header", "footer", "noscript", "iframe", "form", "button", "svg"}
CHROME_CLASSES = {"ad", "ads", "cookie", "menu", "sidebar", "breadcrumbs"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}
DICE = re.compile(r"""<img\b[^>]*src=["'][^"']*?/d(\d+)\.png["'][^>]*>""", re.IGNORECASE)
#: Elements that end an open one of the same kind, as pages leave them unclosed.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "h2": {"p"}, "h3": {"p"}, "table": {"p"}, "ul": {"p"}, "ol": {"p"}, "div": {"p"}}


@dataclass
class Node:
    tag: str
    classes: frozenset[str] = frozenset()
    children: list = field(default_factory=list)

    def text(self) -> str:
        parts: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag == "br":
                parts.append(" ")
            else:
                stack.extend(reversed(x.children))
        return clean(" ".join(parts))


def clean(text: str) -> str:
    for old, new in (("\xa0", " "), ("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "--"), ("•", "-")):
        text = text.replace(old, new)
    text = re.sub(r"\s+", " ", text).strip()
    text = re.sub(r"\s+([.,;:!?)])", r"\1", text)
    return re.sub(r"(\d)\s*\+", r"\1+", text)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        classes = frozenset((dict(attrs).get("class") or "").lower().split())
        if self.hidden:
            self.hidden += tag not in VOID
            return
        if tag in CHROME_TAGS or classes & CHROME_CLASSES:
            self.hidden += tag not in VOID
            return
        while len(self.open) > 1 and self.open[-1].tag in CLOSES.get(tag, ()):
            self.open.pop()
        node = Node(tag, classes)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            self.hidden -= 1
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.open[-1].children.append(data)


def parse(html: str) -> Node:
    """The page's tree without furniture; dice images become their number first."""
    builder = _Builder()
    builder.feed(DICE.sub(r" \1", html or ""))
    builder.close()
    return builder.root


def table_lines(node: Node) -> list[str]:
    """Rows of a table that holds no other table, cells joined by bars, each row once."""
    rows: dict[str, None] = {}

    def walk(n: Node) -> None:
        for c in n.children:
            if isinstance(c, Node):
                if c.tag == "tr":
                    cells = [d.text() for d in c.children if isinstance(d, Node) and d.tag in ("td", "th")]
                    line = " | ".join(x for x in cells if x)
                    if line:
                        rows.setdefault(line)
                else:
                    walk(c)

    walk(node)
    return list(rows)


def _has(node: Node, tag: str) -> bool:
    return any(isinstance(c, Node) and (c.tag == tag or _has(c, tag)) for c in node.children)


@dataclass
class Section:
    heading: str
    lines: list[str] = field(default_factory=list)


def slug(text: str) -> str:
    return re.sub(r"[\s_-]+", "_", re.sub(r"[^\w\s-]", "", text.lower().strip()))[:60].strip("_")


def sections(html: str, least: int = 80) -> list[tuple[str, str, str]]:
    """(slug, heading, text) of a page: h2 and h3 begin sections, h4 become bold lines, paragraphs over 15 characters, list items and
    innermost tables become lines. Sections with less than ``least`` characters are dropped; those with one slug are merged:
    the longest first, then what the others add."""
    found = [Section("")]

    def walk(node: Node) -> None:
        for c in node.children:
            if not isinstance(c, Node):
                continue
            if c.tag in ("h1", "h2", "h3"):
                found.append(Section(c.text()))
            elif c.tag == "h4":
                found[-1].lines.append(f"**{c.text()}**")
            elif c.tag == "p":
                text = c.text()
                if len(text) > 15:
                    found[-1].lines.append(text)
            elif c.tag == "li":
                text = c.text()
                if text:
                    found[-1].lines.append(f"- {text}")
            elif c.tag == "table" and not _has(c, "table"):
                found[-1].lines.extend(table_lines(c))
            else:
                walk(c)

    walk(parse(html))
    merged: dict[str, list[tuple[str, str]]] = {}
    for s in found:
        body = "\n".join(s.lines)
        if s.heading and len(body) >= least:
            merged.setdefault(slug(s.heading), []).append((s.heading, body))
    out = []
    for key, versions in merged.items():
        versions.sort(key=lambda v: -len(v[1]))
        text = versions[0][1]
        for _, body in versions[1:]:
            if " ".join(body.split()) not in " ".join(text.split()):
                text += "\n" + body
        out.append((key, versions[0][0], text))
    return out


def page_sections(pages: DataFrame, least: int = 80) -> DataFrame:
    """``url, slug, heading, text`` of ``pages`` (url, html). Null and broken pages give what can be read of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(u, *s) for u, h in zip(batch["url"], batch["html"]) for s in sections(h, least)]
            yield pd.DataFrame(rows, columns=["url", "slug", "heading", "text"])

    return pages.select("url", "html").mapInPandas(run, "url string, slug string, heading string, text string")

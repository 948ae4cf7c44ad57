"""Title, main content, links and Markdown of HTML pages, in Arrow batches.

The tree follows this contract: void elements have no content; a block start
closes an open paragraph; items, rows and cells close their like; script and
style hold raw text; an end tag closes up to its start, or nothing if there is
none. That is not the full repair of browsers.
"""

from __future__ import annotations

import re
from collections.abc import Generator, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: A start tag closes an open one of these, up to the given boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Blocks that are no content, by id, by class pattern, and by tag.
CHROME_IDS = {"sidebar", "navigation", "footer", "header"}
CHROME_CLASS = re.compile(r"breadcrumb|sidebar|toc|page-metadata")
CHROME_MENU = "ajs-menu-bar"
SILENT = {"script", "style", "head", "title", "noscript"}
FALLBACK_OUT = {"nav", "header", "footer"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self, skip: frozenset | set = frozenset()) -> Iterator[tuple[str, Node]]:
        stack: list = [self]
        while stack:
            node = stack.pop()
            for child in reversed(node.children) if isinstance(node, Node) else ():
                stack.append((child, node) if isinstance(child, str) else child)
            if isinstance(node, tuple):
                yield node
            elif node.tag in skip:
                del stack[len(stack) - len(node.children) :]

    def text(self) -> str:
        return " ".join(" ".join(s.split()) for s, _ in self.strings() if s.strip())

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def find(self, wanted) -> Node | None:
        return next((n for n in self.walk() if wanted(n)), None)

    def remove(self, unwanted) -> None:
        for node in self.walk():
            node.children = [c for c in node.children if isinstance(c, str) or not unwanted(c)]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]")

    def _close(self, tags: set, upto: set) -> None:
        node, last = self.at, None
        while node.parent is not None and node.tag not in upto:
            if node.tag in tags:
                last = node
            node = node.parent
        if last is not None:
            self.at = last.parent

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close({"p"}, {"td", "th", "li", "div", "section", "article", "body"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        node = Node(tag, {k: v if v is not None else "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def parse_marked_section(self, i, report=1):
        # in HTML a marked section is a comment up to the next ">"
        return self.parse_bogus_comment(i, report)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def title(root: Node) -> str:
    """Text of h1#title-text, else h1.pagetitle, else <title>; site names are cut off later."""
    node = root.find(lambda n: n.tag == "h1" and n.attrs.get("id") == "title-text")
    node = node or root.find(lambda n: n.tag == "h1" and "pagetitle" in n.classes()) or root.find(lambda n: n.tag == "title")
    return node.text() if node else ""


def main_content(root: Node) -> Node:
    """First of #main-content, #content, div.wiki-content, a div of a content class; else the body
    without navigation, header and footer, which are then gone from the tree."""
    for wanted in (
        lambda n: n.attrs.get("id") == "main-content",
        lambda n: n.attrs.get("id") == "content",
        lambda n: n.tag == "div" and "wiki-content" in n.classes(),
        lambda n: n.tag == "div" and any(re.search(r"page-content|confluenceTable", c) for c in n.classes()),
    ):
        if found := root.find(wanted):
            return found
    found = root.find(lambda n: n.tag == "body") or root
    found.remove(lambda n: n.tag in FALLBACK_OUT)
    return found


def links(root: Node) -> list[str]:
    """Targets in order, first occurrences: those near the text "child pages", then web links of the content."""
    out: list[str] = []
    seen: set[int] = set()  # nodes that are walked, or whose box is
    for string, parent in root.strings():
        if re.search("child pages", string, re.I):
            box: Node | None = parent
            while box is not None and id(box) not in seen and box.tag not in ("ul", "div", "section"):
                seen.add(id(box))
                box = box.parent
            if box is None or id(box) in seen:
                continue
            stack = [box]
            while stack:
                node = stack.pop()
                if id(node) in seen and node.tag in ("ul", "div", "section"):
                    continue  # an inner box that came first
                seen.add(id(node))
                if node.tag == "a" and node.attrs.get("href"):
                    out.append(node.attrs["href"])
                stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    content = root.find(lambda n: n.attrs.get("id") == "main-content") or root.find(lambda n: n.attrs.get("id") == "content") or root
    for node in content.walk():
        href = node.attrs.get("href") if node.tag == "a" else None
        if href and (not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", href) or re.match("https?:", href, re.I)):
            out.append(href)
    return list(dict.fromkeys(out))


def _is_chrome(n: Node) -> bool:
    if n.tag in SILENT:
        return True
    if n.tag != "div":
        return False
    return n.attrs.get("id") in CHROME_IDS or any(CHROME_CLASS.search(c) for c in n.classes()) or CHROME_MENU in n.classes()


#: A writer's work: it yields the writers it waits for and returns its text.
Call = Generator["Call", str, str]


class _Markdown:
    """Writes a tree as Markdown: # headings, - bullets, fences, pipes.

    The writers are generators that hand out the calls they need, so depth of nesting costs no call stack.
    """

    def __init__(self):
        self.pre = 0

    def write(self, node: Node) -> str:
        calls, value = [self.inside(node)], None
        while calls:
            try:
                calls.append(calls[-1].send(value))
                value = None
            except StopIteration as done:
                calls.pop()
                value = done.value
        return value

    def inside(self, node: Node, depth: int = 0) -> Call:
        out = []
        for c in node.children:
            if isinstance(c, Node):
                out.append((yield self.one(c, depth)))
            else:
                out.append(c if self.pre else re.sub(r"\s+", " ", c))
        return "".join(out)

    def one(self, node: Node, depth: int) -> Call:
        tag = node.tag
        if tag == "pre":
            self.pre += 1
            inner = yield self.inside(node, depth)
            self.pre -= 1
            return f"\n\n```\n{inner.strip(chr(10))}\n```\n\n"
        if tag in ("ul", "ol"):
            items = [c for c in node.children if isinstance(c, Node) and c.tag == "li"]
            start = int(node.attrs["start"]) if re.fullmatch("[0-9]{1,9}", node.attrs.get("start", "")) else 1
            lines = []
            for i, item in enumerate(items):
                mark = "- " if tag == "ul" else f"{start + i}. "
                inner = re.sub(r"\n{2,}", "\n", (yield self.inside(item, depth + 1)).strip())
                lines.append(mark + inner.replace("\n", "\n" + " " * len(mark)))
            text = "\n".join(lines)
            return f"\n{text}\n" if depth else f"\n\n{text}\n\n"
        if tag == "table":
            return (yield self.table(node, depth))
        inner = yield self.inside(node, depth)
        bare = inner.strip()
        if re.fullmatch("h[1-6]", tag):
            return f"\n\n{'#' * int(tag[1])} {re.sub(chr(92) + 's+', ' ', bare)}\n\n" if bare else ""
        if tag in ("b", "strong", "em", "i", "code") and not self.pre:
            if not bare:
                return inner
            mark = {"b": "**", "strong": "**", "code": "`"}.get(tag, "*")
            return inner[: len(inner) - len(inner.lstrip())] + mark + bare + mark + inner[len(inner.rstrip()) :]
        if tag == "a":
            href = node.attrs.get("href")
            return f"[{bare}]({href})" if href else inner
        if tag == "img":
            return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})"
        if tag == "br":
            return "  \n"
        if tag == "hr":
            return "\n\n---\n\n"
        if tag == "blockquote":
            return "\n\n" + "\n".join("> " + x for x in bare.split("\n")) + "\n\n" if bare else ""
        return f"\n\n{bare}\n\n" if tag in BLOCKS and bare else "" if tag in BLOCKS else inner

    def table(self, node: Node, depth: int) -> Call:
        rows = []
        for row in _own_rows(node):
            cells = []
            for c in row.children:
                if isinstance(c, Node) and c.tag in ("td", "th"):
                    cells.append(re.sub(r"\s+", " ", (yield self.inside(c, depth)).strip()).replace("|", "\\|"))
            rows.append(cells)
        rows = [r for r in rows if r]
        if not rows:
            return ""
        lines = ["| " + " | ".join(r) + " |" for r in rows]
        lines.insert(1, "| " + " | ".join(["---"] * len(rows[0])) + " |")
        return "\n\n" + "\n".join(lines) + "\n\n"


def _own_rows(table: Node) -> Iterator[Node]:
    """The rows of a table without those of tables in its cells."""
    stack = [table]
    while stack:
        node = stack.pop()
        if node.tag == "tr":
            yield node
        else:
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and c.tag != "table")


def to_markdown(content: Node) -> str:
    """Markdown of the content without page chrome; noise removal follows as SQL."""
    content.remove(_is_chrome)
    text = _Markdown().write(content)
    return re.sub(r"(\n[ \t]*){3,}", "\n\n", text).strip()


def _extract_one(html: str | None) -> tuple[str | None, str | None, list[str] | None, str | None]:
    if not html:
        return None, None, None, None
    try:
        root = parse(html)
        name = title(root)
        content = main_content(root)
        hrefs = links(root)
        return name, to_markdown(content), hrefs, None
    except (AssertionError, RecursionError, ValueError) as e:
        return None, None, None, f"{type(e).__name__}: {e}"[:200]


_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("markdown", T.StringType()),
        T.StructField("hrefs", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)


@F.pandas_udf(_SCHEMA)
def _extract(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_extract_one(h) for h in html], columns=["title", "markdown", "hrefs", "error"])


def extract(html: Column) -> Column:
    """Struct of title, markdown, hrefs and error; all null for a page without content.

    One call per page: select the struct once and take its fields from a later projection.
    """
    return _extract(html)

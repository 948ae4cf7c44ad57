"""Markdown as a tree of blocks and inline parts, and HTML and plain text written from it.

Blocks are headings, paragraphs, lists, fences, tables, quotes and rules; line feeds break lines. Quotes and lists
deeper than DEEPEST are flattened into the deepest, so that no text can exhaust the stack.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

DEEPEST = 50

_INLINE = re.compile(
    r"`(?P<code>[^`]+)`"
    r"|!\[(?P<alt>[^\[\]]*)\]\((?P<src>[^)\s]*)\)"
    r"|\[(?P<label>[^\[\]]+)\]\((?P<href>[^)\s]*)\)"
    r"|\*\*(?P<strong>.+?)\*\*"
    r"|(?<![\w*])\*(?P<em>[^*\n]+)\*(?![\w*])"
)
_ITEM = re.compile(r"(\s*)([-*+]|\d+\.)\s+(.*)")
_HEADING = re.compile(r"(#{1,6})\s+(.*)")
_RULE = re.compile(r"\s*([-*_])\s*(\1\s*){2,}")
_ALIGN = re.compile(r"\|?[\s:|-]*-[\s:|-]*")
_STOPS = re.compile(r"#{1,6}\s|```|>|\|")
_CELL = re.compile(r"(?<!\\)\|")


class Part(NamedTuple):
    """Inline: text, code, image, link, strong or em."""

    kind: str
    text: str = ""
    address: str = ""
    inner: tuple = ()


class Block(NamedTuple):
    """heading (level, parts), paragraph (lines of parts), pre (text), rule, quote (blocks), table (rows of cells, the first is
    the head), list (ordered, items: parts and blocks)."""

    kind: str
    value: object = None
    level: int = 0


def inline(text: str) -> tuple[Part, ...]:
    out, at = [], 0
    for m in _INLINE.finditer(text):
        if m.start() > at:
            out.append(Part("text", text[at : m.start()]))
        at, kind = m.end(), m.lastgroup
        if kind == "code":
            out.append(Part("code", m["code"]))
        elif kind == "src":
            out.append(Part("image", m["alt"], m["src"]))
        elif kind == "href":
            out.append(Part("link", "", m["href"], inline(m["label"])))
        else:
            out.append(Part(kind, "", "", inline(m[kind])))
    if at < len(text):
        out.append(Part("text", text[at:]))
    return tuple(out)


def _lists(lines: list[str]) -> list[Block]:
    """Items and lines that go on with them; deeper items are lists of the item before."""
    items: list[tuple[int, bool, str]] = []
    for line in lines:
        if m := _ITEM.match(line):
            items.append((len(m[1]), m[2][0].isdigit(), m[3]))
        else:
            depth, ordered, text = items[-1]
            items[-1] = (depth, ordered, text + " " + line.strip())
    out: list[Block] = []
    stack: list[tuple[int, Block]] = []  # of open lists, outermost first
    for depth, ordered, text in items:
        while stack and depth < stack[-1][0]:
            stack.pop()
        if not stack or depth > stack[-1][0] and len(stack) < DEEPEST:
            new = Block("list", [], int(ordered))
            (stack[-1][1].value[-1][1] if stack else out).append(new)
            stack.append((depth, new))
        stack[-1][1].value.append((inline(text), []))
    return out


def blocks(text: str, depth: int = 0) -> list[Block]:
    lines, at, out = text.split("\n"), 0, []
    while at < len(lines):
        line, start = lines[at], at
        at += 1
        if not line.strip():
            continue
        if line.startswith("```"):
            while at < len(lines) and not lines[at].startswith("```"):
                at += 1
            out.append(Block("pre", "\n".join(lines[start + 1 : at])))
            at += 1
        elif m := _HEADING.match(line):
            out.append(Block("heading", inline(m[2].strip()), len(m[1])))
        elif _RULE.fullmatch(line):
            out.append(Block("rule"))
        elif line.lstrip().startswith(">"):
            while at < len(lines) and lines[at].lstrip().startswith(">"):
                at += 1
            mark = r"^\s*> ?" if depth < DEEPEST else r"^[\s>]+"
            out.append(Block("quote", blocks("\n".join(re.sub(mark, "", x) for x in lines[start:at]), depth + 1)))
        elif line.startswith("|") and at < len(lines) and _ALIGN.fullmatch(lines[at]):
            at += 1
            while at < len(lines) and lines[at].startswith("|"):
                at += 1
            cells = lambda x: [inline(c.strip().replace("\\|", "|")) for c in _CELL.split(x.strip().strip("|"))]
            out.append(Block("table", [cells(x) for x in (line, *lines[start + 2 : at])]))
        elif _ITEM.match(line):
            while at < len(lines) and lines[at].strip() and (_ITEM.match(lines[at]) or lines[at].startswith(" ")):
                at += 1
            out += _lists(lines[start:at])
        else:
            while at < len(lines) and lines[at].strip() and not _STOPS.match(lines[at]):
                at += 1
            out.append(Block("paragraph", [inline(x.strip()) for x in lines[start:at]]))
    return out


def _inline_html(parts: tuple[Part, ...]) -> str:
    out = []
    for p in parts:
        if p.kind == "text":
            out.append(html.escape(p.text, quote=False))
        elif p.kind == "image":
            out.append(f'<img alt="{html.escape(p.text)}" src="{html.escape(p.address)}" />')
        elif p.kind == "code":
            out.append(f"<code>{html.escape(p.text, quote=False)}</code>")
        elif p.kind == "link":
            out.append(f'<a href="{html.escape(p.address)}">{_inline_html(p.inner)}</a>')
        else:
            out.append(f"<{p.kind}>{_inline_html(p.inner)}</{p.kind}>")
    return "".join(out)


def _html(block: Block) -> str:
    kind, value = block.kind, block.value
    if kind == "heading":
        return f"<h{block.level}>{_inline_html(value)}</h{block.level}>"
    if kind == "paragraph":
        return "<p>" + "<br />\n".join(map(_inline_html, value)) + "</p>"
    if kind == "pre":
        return f"<pre><code>{html.escape(value, quote=False)}\n</code></pre>"
    if kind == "rule":
        return "<hr />"
    if kind == "quote":
        return "<blockquote>\n" + "\n".join(map(_html, value)) + "\n</blockquote>"
    if kind == "table":
        row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{_inline_html(c)}</{tag}>" for c in cells) + "</tr>"
        return f"<table>\n<thead>\n{row(value[0], 'th')}\n</thead>\n<tbody>\n" + "\n".join(row(r, "td") for r in value[1:]) + "\n</tbody>\n</table>"
    tag = "ol" if block.level else "ul"
    items = ("<li>" + "\n".join([_inline_html(parts), *map(_html, inner)]) + "</li>" for parts, inner in value)
    return f"<{tag}>\n" + "\n".join(items) + f"\n</{tag}>"


def to_html(text: str) -> str:
    return "\n".join(map(_html, blocks(text)))


def _inline_plain(parts: tuple[Part, ...]) -> str:
    return "".join(p.text if not p.inner else _inline_plain(p.inner) for p in parts)


def _plain(block: Block) -> str:
    kind, value = block.kind, block.value
    if kind == "heading":
        return _inline_plain(value)
    if kind == "paragraph":
        return "\n".join(map(_inline_plain, value))
    if kind == "pre":
        return value
    if kind == "quote":
        return "\n\n".join(filter(None, map(_plain, value)))
    if kind == "table":
        return "\n".join("\t".join(map(_inline_plain, row)) for row in value)
    if kind == "list":
        return "\n".join("\n".join([_inline_plain(parts), *map(_plain, inner)]) for parts, inner in value)
    return ""


def to_plain(text: str) -> str:
    """The text that a reader of the page sees: blocks apart by an empty line; items, table rows and fenced lines on
    lines of their own, cells apart by tabs; images by their alternative text, links by their label."""
    return "\n\n".join(filter(None, map(_plain, blocks(text)))).strip()

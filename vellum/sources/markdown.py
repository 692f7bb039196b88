"""Markdown as the text of its HTML without tags: a small machine over blocks, then over what is within a line.

Blocks are what blank lines part. Each is the first of these that it looks like: a
continuation of a list item (four spaces after a list), code (four spaces), a heading, a
rule, a list, a quotation, a definition of a link, a paragraph; what a block holds before
and after such a part is looked at again. In the result every element ends its line, lists
and quotations begin and end with an empty one, blank lines between paragraphs are gone,
numbers of items too; ampersands and angle brackets of the text are entities, as in HTML.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

ITEM = re.compile(r"^ {0,3}(?:\d+\.|[*+-]) +(.*)")
NESTED = re.compile(r"^ {4,7}(?:\d+\.|[*+-]) +.*")
HEADING = re.compile(r"(?:^|\n)(#{1,6})((?:\\.|[^\\])*?)#*(?:\n|$)")
UNDERLINED = re.compile(r"^.*?\n[=-]+ *(?:\n|$)")
RULE = re.compile(r"^ {0,3}(?:(?:-+ {0,2}){3,}|(?:_+ {0,2}){3,}|(?:\*+ {0,2}){3,}) *$", re.M)
QUOTED = re.compile(r"(?:^|\n) {0,3}>")
DEFINED = re.compile(r'^ {0,3}\[[^\]]*\]: *\n? *\S+ *\n?(?: *"[^"\n]*"| *\'[^\'\n]*\'| *\([^)\n]*\))? *(?:\n|$)')
TAG = re.compile(r"</?[a-zA-Z][^<>@ ]*(?: [^<>]*)?>|<!--.*?-->", re.S)
# Elements whose content is left alone.
RAW = re.compile(r"^<(/?)(address|article|aside|blockquote|body|center|details|div|dl|fieldset|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|script|section|style|table|tbody|td|th|thead|tr|ul|!--)\b", re.I)
ESCAPED = "\\`*_{}[]()>#+-.!"


@dataclass
class Node:
    """kind: root, list, item, quote, code, rule, raw or text (heading or paragraph)."""

    kind: str
    text: str = ""
    children: list[Node] = field(default_factory=list)


def entities(text: str) -> str:
    text = re.sub(r"&(?!(?:#[0-9]+|#x[0-9a-f]+|[0-9a-z]+);)", "&amp;", text, flags=re.I)
    return text.replace("<", "&lt;").replace(">", "&gt;")


def inline(text: str) -> str:
    """Without marks of emphasis, code, links and tags."""
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x02{len(kept) - 1}\x03"

    text = text.replace("\x02", "").replace("\x03", "")
    text = re.sub(r"(?<!\\)(`+)(.+?)(?<!`)\1(?!`)", lambda m: keep(entities(m[2].strip())), text, flags=re.S)
    text = re.sub(r"\\(.)", lambda m: keep(entities(m[1])) if m[1] in ESCAPED else m[0], text)
    text = re.sub(r"<((?:[Ff]|[Hh][Tt])[Tt][Pp][Ss]?://[^<>]*)>", lambda m: keep(entities(m[1])), text)
    text = re.sub(r"<(?:mailto:)?([^<> !]+@[^@<> ]+)>", lambda m: keep("".join(f"&#{ord(c)};" for c in m[1])), text)
    text = TAG.sub("", text)
    label = r"\[((?:[^\[\]]|\[[^\[\]]*\])*)\]"
    target = r"(?:\((?:[^()\s]|\([^()]*\))*(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)|\s?\[[^\[\]]*\])"
    text = re.sub("!" + label + target, "", text)
    for _ in range(2):
        text = re.sub(label + target, r"\1", text)
    text = re.sub(r"(?<!\*)(\*{1,3})(?=[^\s*])(.+?)(?<=[^\s*])\1(?!\*)", r"\2", text, flags=re.S)
    text = re.sub(r"(?<![\w_])(_{1,3})(?=[^\s_])(.+?)(?<=[^\s_])\1(?![\w_])", r"\2", text, flags=re.S)
    text = re.sub(r"(?<!\*)(\*{1,3})(?=[^\s*])(.+?)(?<=[^\s*])\1(?!\*)", r"\2", text, flags=re.S)
    text = re.sub(r" {2,}\n", "\n", entities(text))
    while "\x02" in text:
        text = re.sub("\x02(\\d+)\x03", lambda m: kept[int(m[1])], text)
    return text


def _looser(item: Node) -> None:
    """What stands in an item by itself becomes a paragraph of it."""
    if item.text:
        item.children.insert(0, Node("text", item.text))
        item.text = ""


def _detabbed(block: str) -> tuple[str, str]:
    """(lines without their four spaces, the rest from the first line that has none)."""
    lines = block.split("\n")
    n = next((i for i, line in enumerate(lines) if line.strip() and not line.startswith("    ")), len(lines))
    return "\n".join(line[4:] for line in lines[:n]), "\n".join(lines[n:])


def _items(block: str) -> list[str]:
    out: list[str] = []
    for line in block.split("\n"):
        if m := ITEM.match(line):
            out.append(m[1])
        elif NESTED.match(line) and out and not out[-1].startswith("    "):
            out.append(line)
        else:
            out[-1] += "\n" + line
    return out


def parse(parent: Node, blocks: list[str], loose: bool = True) -> None:
    """Adds the blocks' nodes to ``parent``; a paragraph of an item that isn't ``loose`` is the item's own text."""
    blocks = list(blocks)
    while blocks:
        block = blocks.pop(0).strip("\n")
        last = parent.children[-1] if parent.children else None
        if not block.strip():
            continue
        if block.startswith("    ") and last is not None and last.kind == "list" and last.children:
            own, rest = _detabbed(block)
            _looser(last.children[-1])
            parse(last.children[-1], own.split("\n\n"))
            blocks[:0] = [rest] * bool(rest)
        elif block.startswith("    "):
            own, rest = _detabbed(block)
            if last is not None and last.kind == "code":
                last.text += "\n\n" + own.rstrip()
            else:
                parent.children.append(Node("code", own.rstrip()))
            blocks[:0] = [rest] * bool(rest)
        elif m := HEADING.search(block):
            if before := block[: m.start()]:
                parse(parent, [before], loose)
            parent.children.append(Node("text", m[2].strip()))
            blocks[:0] = [block[m.end() :]] * bool(block[m.end() :])
        elif UNDERLINED.match(block):
            head, _, *rest = block.split("\n")
            parent.children.append(Node("text", head.strip()))
            blocks[:0] = ["\n".join(rest)] * bool(rest)
        elif m := RULE.search(block):
            if before := block[: m.start()].rstrip("\n"):
                parse(parent, [before], loose)
            parent.children.append(Node("rule"))
            blocks[:0] = [block[m.end() :].lstrip("\n")] * bool(block[m.end() :].strip("\n"))
        elif ITEM.match(block):
            fresh = last is None or last.kind != "list"
            if fresh:
                parent.children.append(last := Node("list"))
            elif last.children:
                _looser(last.children[-1])
            for i, text in enumerate(_items(block)):
                if text.startswith("    ") and last.children:
                    parse(last.children[-1], [_detabbed(text)[0]], loose=False)
                else:
                    last.children.append(item := Node("item"))
                    parse(item, [text], loose=not fresh and i == 0)
        elif m := QUOTED.search(block):
            if before := block[: m.start()]:
                parse(parent, [before], loose)
            inner = "\n".join(re.sub(r"^ {0,3}> ?", "", line) for line in block[m.start() :].lstrip("\n").split("\n"))
            if last is None or last.kind != "quote" or block[: m.start()]:
                parent.children.append(last := Node("quote"))
            parse(last, inner.split("\n\n"))
        elif m := RAW.match(block):
            raw, end = block, f"</{m[2]}>" if m[2] != "!--" else "-->"
            while blocks and not m[1] and m[2].lower() != "hr" and end.lower() not in raw.lower():
                raw += "\n\n" + blocks.pop(0)
            parent.children.append(Node("raw", raw))
        elif m := DEFINED.match(block):
            blocks[:0] = [block[m.end() :]] * bool(block[m.end() :])
        elif parent.kind == "item" and not loose and not parent.children:
            parent.text = f"{parent.text}\n{block.lstrip()}" if parent.text else block.lstrip()
        else:
            parent.children.append(Node("text", block.lstrip()))


def shown(node: Node) -> str:
    """A node's text, each element's with the end of its line."""
    if node.kind == "text":
        return inline(node.text) + "\n"
    if node.kind == "code":
        return entities(node.text) + "\n\n"
    if node.kind in ("rule", "raw"):
        return re.sub(r"<[^<]+?>", "", node.text) + "\n"
    inner = "".join(map(shown, node.children))
    if node.kind == "item":
        first = node.children[0].kind if node.children else ""
        return inline(node.text) + ("\n" if not node.text and first else "") + inner + "\n"
    return inner if node.kind == "root" else f"\n{inner}\n"


def markdown_text(source: str) -> str:
    """The text of a Markdown document's HTML without its tags."""
    source = source.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4)
    source = re.sub(r"(?<=\n) +\n", "\n", source + "\n\n")
    root = Node("root")
    parse(root, source.split("\n\n"))
    # the HTML is stripped of white space at its ends, which begin and end with tags where there is a list or a quotation
    out = "".join(map(shown, root.children))
    return out.removesuffix("\n")

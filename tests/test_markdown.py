"""One golden text for each kind of block, worked out by hand from the HTML that stands for it."""

import pytest

from vellum.sources.documents import markdown_text

CASES = {
    "heading, paragraphs": ("# Title #\n\nOne\ntwo\n\n\n\nthree", "Title\nOne\ntwo\nthree"),
    "headings inside a block": ("before\n## Purpose\nafter\n#Scope", "before\nPurpose\nafter\nScope"),
    "underlined headings": ("Title\n=====\n\nPart\n---\nmore", "Title\nPart\nmore"),
    "rule": ("a\n\n* * *\n\nb\n\n---\n", "a\n\nb\n"),
    "tight list": ("Do:\n\n- a\n- b\n\nend", "Do:\n\na\nb\n\nend"),
    "numbers are lost": ("1. one\n2. two\n10. ten", "\none\ntwo\nten\n"),
    "both kinds in one list": ("- a\n1. b\n* c", "\na\nb\nc\n"),
    "lazy lines": ("- a\nmore\n- b", "\na\nmore\nb\n"),
    "loose list": ("- a\n\n- b", "\n\na\n\n\nb\n\n"),
    "nested list": ("- a\n    - b\n    - c\n- d", "\na\nb\nc\n\n\nd\n"),
    "paragraph in an item": ("- a\n\n    more\n\nend", "\n\na\nmore\n\n\nend"),
    "two spaces don't nest": ("- a\n  - b", "\na\nb\n"),
    "quotation": ("> one\n> two\n\nend", "\none\ntwo\n\nend"),
    "lazy quotation": ("> one\ntwo", "\none\ntwo\n"),
    "list in a quotation": ("> - a\n> - b", "\n\na\nb\n\n"),
    "code": ("see\n\n    x < 1\n      y & 2\n\nend", "see\nx &lt; 1\n  y &amp; 2\n\nend"),
    "code keeps marks": ("    **a** [b](c)\n", "**a** [b](c)\n"),
    "fence is a span": ("```\ncode <b>\n```", "code &lt;b&gt;"),
    "raw block": ("<div>\n*not* &amp; <b>x</b>\n</div>\n\nend", "\n*not* &amp; x\n\nend"),
    "definitions of links": ('a [x][1] b\n\n[1]: http://example.org "t"\n', "a x b"),
    "inline": ("**b** *i* ***bi*** __b__ _i_ snake_case_name `c*d*` [l](u \"t\") ![alt](src) <i>tag</i>", "b i bi b i snake_case_name c*d* l  tag"),
    "not emphasis": ("2 * 3 * 4 and a_b and ** x", "2 * 3 * 4 and a_b and ** x"),
    "escapes": (r"\*a\* \_ \# 1\. \z", r"*a* _ # 1. \z"),
    "entities": ("a & b &copy; &#169; 1 < 2 > 0", "a &amp; b &copy; &#169; 1 &lt; 2 &gt; 0"),
    "links by themselves": ("<https://example.org/?a=1&b=2> <a@b.c>", "https://example.org/?a=1&amp;b=2 &#97;&#64;&#98;&#46;&#99;"),
    "line break": ("one  \ntwo", "one\ntwo"),
    "tabs": ("-\ta\n\n\tcode?", "\n\na\ncode?\n\n"),
    "nothing": ("", ""),
    "blank": (" \n\n", ""),
    "windows": ("a\r\n\r\nb\r", "a\nb"),
    "steps": ("### Step 1: Inspect\n\nCheck the **label**.\n\n### Step 2: Clean\n\nWARNING: hot", "Step 1: Inspect\nCheck the label.\nStep 2: Clean\nWARNING: hot"),
}


@pytest.mark.parametrize("name", CASES)
def test_blocks(name):
    source, want = CASES[name]
    assert markdown_text(source) == want


def test_long_and_odd_texts():
    assert markdown_text("- a\n" * 20_000).count("a") == 20_000
    assert markdown_text("para **x**\n\n" * 20_000).count("para x") == 20_000
    for text in ("[" * 300, "*" * 300, "`" * 301, "> " * 200, "#" * 50, "<" * 300, "\\" * 99, "\x02 0\x03", "- " * 100):
        assert isinstance(markdown_text(text), str)

"""Tags and texts of an HTML page in one pass that takes time in proportion to its length, whatever the page holds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

#: Fixed: elements whose content is text up to their end tag.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
# a quote opens a value only behind an equals sign; possessive, so that nothing is read twice
_INSIDE = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", tag, attributes) and ("end", tag, "") in page order; tags in lower case, texts as written.

    Comments and declarations are left out.  A value without its closing quote
    ends at the next >; a tag that never ends is left out with all behind it.
    """
    at, n, held = 0, len(page), 0  # held: where the text that isn't given yet begins
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            break
        kind = page[begin + 1 : begin + 2]
        name = _NAME.match(page, begin) if kind.isalpha() or kind == "/" else None
        if kind in ("!", "?"):
            comment = page.startswith("<!--", begin)
            end = page.find("-->" if comment else ">", begin + 2)
            stop = n if end < 0 else end + (3 if comment else 1)
        elif name:
            end = _INSIDE.match(page, name.end()).end()
            if page[end : end + 1] != ">":
                end = page.find(">", end)
            stop = n if end < 0 else end + 1
        else:
            at = begin + 1
            continue
        if begin > held:
            yield "text", page[held:begin], ""
        at = held = stop
        if name and end >= 0:
            tag = name[1].lower()
            if kind == "/":
                yield "end", tag, ""
                continue
            yield "start", tag, page[name.end() : end]
            if tag in RAW:
                found = _ENDS[tag].search(page, stop)
                at = held = found.start() if found else n
                if at > stop:
                    yield "text", page[stop:at], ""
    if held < n:
        yield "text", page[held:], ""


def attributes(written: str) -> dict[str, str]:
    """Names, in lower case, and values; of equal names the first counts."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(written):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found

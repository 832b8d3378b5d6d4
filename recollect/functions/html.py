"""HTML to text. Nesting makes HTML non-regular, so an Arrow function drives
the standard library's tokenizer; everything around it stays native."""

from __future__ import annotations

import re
from functools import partial
from html.parser import HTMLParser

from recollect.functions.arrow import per_value
from recollect.functions.text import BLANKS, LINE_END

# Which elements are silent, cut out, or end a line.
PAGE_RULES = {
    "silent": {"script", "style", "noscript", "iframe", "svg", "head"},
    "cut": {"nav", "footer", "header", "aside", "form", "button"},
    "lines": set(),
    "headings": set(),
}
DOCUMENT_RULES = {
    "silent": {"style", "script", "head", "noscript"},
    "cut": set(),
    "lines": {"p", "div", "section", "article", "li", "tr", "br", "td", "th", "blockquote",
              "h1", "h2", "h3", "h4", "h5", "h6"},
    "headings": {f"h{n}" for n in range(10)},
}
CUT_MARK = "\n---\n"

_ends = re.compile(LINE_END)


def tidy(text: str) -> str:
    """Trailing blanks off every line, at most one empty line in a row."""
    text = "\n".join(line.rstrip(BLANKS) for line in _ends.split(text))
    return re.sub("\n{3,}", "\n\n", text).strip(BLANKS)


class _Walker(HTMLParser):
    """Collects the text that stands outside every silent or cut element."""

    def __init__(self, rules: dict[str, set[str]]):
        super().__init__(convert_charrefs=True)
        self.rules = rules
        self.depth = {"silent": 0, "cut": 0}
        self.out: list[str] = []

    def _edge(self, tag: str, step: int) -> None:
        for group, depth in self.depth.items():
            if tag in self.rules[group] and depth + step >= 0:
                self.depth[group] += step
                if group == "cut":
                    self.out.append(CUT_MARK)
        if self.depth["silent"] == 0:
            if tag in self.rules["lines"]:
                self.out.append("\n")
            if step > 0 and tag in self.rules["headings"]:
                self.out.append("#" * int(tag[1]) + " ")

    def handle_starttag(self, tag, attrs):
        self._edge(tag, 1)

    def handle_endtag(self, tag):
        self._edge(tag, -1)

    def handle_startendtag(self, tag, attrs):
        # The page rules ignore self-closed elements, the document rules do not.
        if self.rules["lines"]:
            self._edge(tag, 1)
            self._edge(tag, -1)

    def handle_data(self, data):
        if not any(self.depth.values()) and not data.isspace():
            self.out.append(data)


def to_text(html: str, rules: dict[str, set[str]], whole: bool = False) -> str:
    """Text of a page. Where the tokenizer gives up, the text read so far, or with ``whole`` the page as it is."""
    walker = _Walker(rules)
    try:
        walker.feed(html)
    except (AssertionError, ValueError, RecursionError):
        if whole:
            return tidy(html)
    return tidy("".join(walker.out))


# Plain text of a document; headings keep their level as ``#``.
html_to_text = per_value(partial(to_text, rules=DOCUMENT_RULES))
# Readable text of a page without navigation, forms and the like.
html_main_content = per_value(partial(to_text, rules=PAGE_RULES, whole=True))
